import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import centroids, license_scan, wavelet_search
from tidewright.llm.license_rules import compiled, parsed, stem

# --- centroid clustering ------------------------------------------------------------------


def plain_clusters(rows, k, rounds, seed, dim):
    """The contract step by step, in Python's integers."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v):
            kept.append((key, [int(c) * 1024 if abs(c) >= 1 << 52 else math.floor(1024 * c) for c in v]))
    if not kept:
        return []
    digest = lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (digest(r), np.array(r[1], float).tobytes()))[:k]]

    def place(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, x, strict=True)) for x in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [place(v)[0] for _, v in kept]
        for i in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == i]
            if mine:
                c[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    ends = [place(v) for _, v in kept]
    inertia = [sum(d for i, d in ends if i == j) for j in range(len(c))]
    most = lambda d: min(d, (1 << 63) - 1)
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((key, i, most(d), most(inertia[i]), most(sum(inertia)), name[i]) for (key, _), (i, d) in zip(kept, ends, strict=True)), key=str)


def vectors(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for c in ("x", "cluster", "distance", "inertia", "sums", "digest"):
        d = d.withColumn(c, F.lit(f"own {c}"))
    return d


@pytest.mark.parametrize("size", [1.0, 1e5, 1e7, 1e30])
def test_clusters_equal_the_contract(spark, size):
    """Small numbers go by the matrix product, larger ones by integers, the largest by Python's."""
    r = random.Random(3)
    rows = [(i, [size * r.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(i, rows[0][1]) for i in range(60, 75)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None), (80, []), (81, [1.0] * 3), (82, [1.0] * 5)]
    rows += [(83, [1.0, None, 2.0, 3.0]), (84, [1.0, float("nan"), 0.0, 0.0]), (85, [float("inf"), 0.0, 0.0, 0.0]), (86, [-0.0, 0.0, -1e-9, 1e-9])]
    out = centroids.clusters(vectors(spark, rows), 5, 4, 3, 4)
    assert sorted(map(tuple, out.collect()), key=str) == plain_clusters(rows, 5, 4, 3, 4)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-7.0, 1.0])]
    assert sorted(map(tuple, centroids.clusters(vectors(spark, rows), 8, 10, 3, 2).collect()), key=str) == plain_clusters(rows, 8, 10, 3, 2)
    assert centroids.clusters(vectors(spark, [(1, None), (2, [1.0])]), 8, 10, 3, 2).count() == 0
    assert centroids.clusters(vectors(spark, []), 8, 10, 3, 2).count() == 0


def test_magnitude_bounds():
    """On both sides of each bound the distances are those of Python's integers."""
    c = [[0, 0], [1 << 20, -(1 << 20)]]
    for top in (1 << 24, 1 << 25, 1 << 26, 1 << 27, 1 << 29, 1 << 31, 1 << 40):
        x = np.array([[top - 1, -top + 3], [1, 2], [top, top]], float)
        cluster, d = centroids.nearest(x, c)
        want = [[sum((int(a) - b) ** 2 for a, b in zip(row, v, strict=True)) for v in c] for row in x]
        assert [int(v) for v in d] == [min(w) for w in want] and list(cluster) == [w.index(min(w)) for w in want]
    huge = [[1 << 40, 0], [-(1 << 40), 0]]
    cluster, d = centroids.nearest(np.array([[5.0, 1.0], [0.0, 0.0]]), huge)
    assert list(cluster) == [0, 0] and int(d[0]) == ((1 << 40) - 5) ** 2 + 1


def test_too_many_centroids_are_refused(spark):
    with pytest.raises(ValueError):
        centroids.clusters(vectors(spark, []), 1 << 20, 1, 3, 64)


# --- licence scans ------------------------------------------------------------------------

EXAMPLES = {
    "SPDX-License-Identifier: MIT": {"mit"},
    "Released under the MIT License.": {"mit"},
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0", "gpl", "clue-license"},
    "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": {"gpl", "gpl-2.0-or-later"},
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0", "clue-license"},
    "CC-BY-SA": {"cc-by", "cc-by-sa"},
    "https://creativecommons.org/licenses/by-sa/4.0/": {"cc-by-sa-4.0"},
    "Dual-licensed: MIT licensed; GPLv2 or later": {"mit", "gpl-2.0-or-later"},
    "3-clause BSD license": {"bsd-3-clause"},
    "the Mozilla Public License, v. 2.0": {"mpl-2.0"},
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "Placed in the public domain": {"public-domain"},
    "Copyright (c) 2019 Someone. All rights reserved.": {"copyright", "reserved"},
    "CC0 1.0 Universal": {"cc0-1.0"},
    "SIL Open Font License 1.1": {"ofl-1.1"},
    "GNU Affero General Public License v3": {"agpl-3.0", "gpl"},
    "no licence words: limit, account by, accordingly, mitigate, generally public": set(),
    "": set(),
}


def test_there_are_hundreds_of_rules():
    rules = parsed()
    assert len(rules) >= 200
    assert all(r.level in (1, 2, 3, 4) and r.gate and r.label for r in rules)
    # a gate is a piece of what its own rule spells out
    spelled = lambda r: re.sub(r"\[cs\]e\b.*|\[cs\]ed.*", "", r.regex) + " " + r.regex
    assert all(r.gate.split()[0] in spelled(r) for r in rules)


@pytest.mark.parametrize("text", EXAMPLES)
def test_examples(text):
    out = license_scan.Scanner().scan(text.encode())
    assert set(filter(None, out[5].split(","))) == EXAMPLES[text]
    assert out[6] == 0 if not EXAMPLES[text] else 0 < out[6] <= 1


def plain_base(text):
    """The base columns from the words alone."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return words, (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def plain_scan(text):
    """Every rule without its gate or keyword, suppression by comparing each with each."""
    words, base = plain_base(text)
    flat, rules = " ".join(words), parsed()
    found = []
    for k, r in enumerate(rules):
        for m in compiled(r).finditer(flat):
            a = flat[: m.start()].count(" ")
            found.append((a, flat[: m.end()].rstrip(" ").count(" ") + 1, k))
    beats = lambda p, q: p[0] <= q[0] and p[1] >= q[1] and (rules[p[2]].level, p[1] - p[0], -p[2]) > (rules[q[2]].level, q[1] - q[0], -q[2]) and rules[p[2]].level >= rules[q[2]].level
    kept = [q for q in found if not any(beats(p, q) for p in found)]
    return base, set(filter(None, base[4].split(","))) | {rules[k].label for _, _, k in kept}


PIECES = ["cc", "by", "CC BY", "nc", "sa", "4.0", "GNU", "general", "public", "license", "licence", "version", "2", "2.0", "3", "or", "later", "Apache", "MIT", "the", "under", "licensed", "all", "rights", "reserved", "BSD", "3-clause", "GPL", "LGPL", "é", "ñcc", "by-", ".", "\n", "creative commons", "attribution", "mozilla", "Copyright 2020", "domain", "word", "spdx license identifier"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25), st.sampled_from([" ", "  ", "-", "\t"]))
def test_scan_against_every_rule_tried(pieces, gap):
    text = gap.join(pieces)
    out = license_scan.Scanner().scan(text.encode())
    base, labels = plain_scan(text)
    assert out[:5] == base
    assert set(filter(None, out[5].split(","))) == labels


def test_keywords_are_in_every_example_of_their_rules():
    for text in EXAMPLES:
        flat = " ".join(plain_base(text)[0])
        for r in parsed():
            if compiled(r).search(flat):
                assert r.gate in flat and (stem(r) is None or stem(r) in text.lower())


def test_scan_of_all_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = license_scan.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base, labels = plain_scan(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base
        assert r.labels == ",".join(sorted(labels)) and {s.label for s in r.spans} <= labels


def test_scan_of_odd_tables(spark):
    long = "mit license " * 60_000 + "cc by"
    rows = [(1, None), (2, ""), (3, " \n"), (None, "CC BY"), (4, "cc by cc by cc"), (4, "cc by cc by cc"), (5, long)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_words", "labels", "score", "spans", "base"):
        d = d.withColumn(c, F.lit("own"))
    out = license_scan.scan(d, spans=False).collect()
    got = sorted([(r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in out], key=str)
    assert got == sorted(
        [(1, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", ""), (3, 0, 0, None, None, "", ""), (0, 2, 1, 0, 0, "cc-by", "cc-by"), (5, 120_002, 1, 120_000, 120_000, "cc-by", "cc-by,mit")]
        + [(4, 5, 2, 0, 2, "cc-by", "cc-by")] * 2, key=str,
    )
    assert license_scan.scan(d.limit(0)).count() == 0


# --- ranked search ------------------------------------------------------------------------


def plain_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    all_ = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in all_), sum(sum(c.values()) for _, c in all_)
    df = Counter(w for _, c in all_ for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in all_:
            m = 25 + (75 * sum(c.values()) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def made(seed, n_docs, n_items):
    """Documents of few different words, many alike, so that scores tie."""
    r = random.Random(seed)
    words = ["one", "Two", "three", "fOUr", "né", "six6", "7", "eight", "ño"]
    text = lambda m: " ".join(r.choice(words) for _ in range(r.randrange(m)))
    docs = [(r.randrange(-5, n_docs), text(9)) for _ in range(n_docs)]
    return docs, [(i, text(7)) for i in range(n_items)]


@pytest.mark.parametrize("seed", range(6))
def test_shards_against_scoring_every_document(monkeypatch, seed):
    """Small shards and few ranges opened at a time; what earlier shards found is passed on."""
    monkeypatch.setattr(wavelet_search, "OPENED", 2 + seed % 3)
    monkeypatch.setattr(wavelet_search, "SHARD_DOCS", [1, 7, 300, 40, 1 << 13, 3][seed])
    docs, items = made(seed, 150, 12)
    counts = [Counter(wavelet_search.terms_of(t.encode())) for _, t in docs]
    vocabulary = sorted(set().union(*(wavelet_search.terms_of(t.encode()) for _, t in items)))
    n, total, k = sum(map(bool, counts)), sum(sum(c.values()) for c in counts), 4
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in docs], pa.int64()), pa.array([sum(c.values()) for c in counts], pa.int64())]
        + [pa.array([[f(v, c) for v, w in enumerate(vocabulary) if c[w]] for c in counts], pa.list_(pa.int32())) for f in (lambda v, c: v, lambda v, c: c[vocabulary[v]])],
        names=["doc_id", "n", "terms", "tf"],
    )
    df = Counter(w for c in counts for w in c)
    got = []
    shards = list(wavelet_search.shards_of(iter([batch.slice(0, 60), batch.slice(60)]), len(vocabulary), n, total))
    for item, text in items:
        c = Counter(wavelet_search.terms_of(text.encode()))
        terms = np.array(sorted(vocabulary.index(w) for w in c), np.int64)
        weights = np.array([c[vocabulary[t]] * wavelet_search.weight(n, df[vocabulary[t]]) for t in terms], np.int64)
        best = []
        for shard in shards:
            best = wavelet_search.best_of(shard, terms, weights, k, best)
        got += [(item, r + 1, -d, s) for r, (s, d) in enumerate(best)]
    assert sorted(got, key=str) == plain_search(docs, items, k)


def test_search_of_odd_tables(spark):
    docs, items = made(9, 200, 6)
    docs += [(None, "one two three"), (None, "one two three"), (7, None), (8, ""), (9, " .,;"), (10, "one " * 50_000), (11, "one two three"), (11, "one two three")]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "one two three one")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    for c in ("n", "terms", "score", "rank", "item", "salt"):
        d, i = d.withColumn(c, F.lit("own")), i.withColumn(c, F.lit("own"))
    assert sorted(map(tuple, wavelet_search.search(d, i, 10).collect()), key=str) == plain_search(docs, items, 10)
    assert wavelet_search.search(d.limit(0), i).count() == 0 and wavelet_search.search(d, i.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(wavelet_search, "BLOCK_BYTES", 300)
    docs, items = made(4, 80, 10)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, wavelet_search.search(d, i, 3).collect()), key=str) == plain_search(docs, items, 3)


def test_items_that_repeat_an_id_are_items_each(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d")], "doc_id long, text string")
    i = spark.createDataFrame([(5, "b"), (5, "c d")], "item_id long, text string")
    assert sorted((r["item_id"], r["rank"], r.doc_id) for r in wavelet_search.search(d, i).collect()) == [(5, 1, 1), (5, 1, 3), (5, 2, 2), (5, 2, 2)]
