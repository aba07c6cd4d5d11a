import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import bpe, common, line_spread, ngram_rules, oracle_sql, pareto_mix, piecewise, ppm_language, quality_compression, queries, setsketch, token_cache

DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, size long, h long, bin int, digest string"
LONG = "word another thing " * 30_000


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, g, s, None if t is None else len(t), "k", 1, 2, 3, 4, "d") for i, t, g, s in rows]
    return spark.createDataFrame(full, DDL)


ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "one", "en", "a"), (5, LONG, "de", "b"), (6, LONG, "de", "b"),
    (7, "same words in a row\nsame words in a row", None, None), (7, "same words in a row\nsame words in a row", None, None), (8, "äöü ß é 日本   x", "de", "b"), (None, "no id here at all", "en", "a"),
]
LABELS = [(i, i % 2, 0) for i in range(1, 8)]

RUNS = {
    "op1": lambda s, d: quality_compression.score_compression(d, quality_compression.train_compression(d, labels(s))),
    "op2": lambda s, d: line_spread.line_report(d),
    "op3": lambda s, d: ppm_language.identify(d, ppm_language.train_ppm(d)),
    "op4": lambda s, d: pareto_mix.mix(d),
    "op5": lambda s, d: ngram_rules.judge(d, ngram_rules.train_ngram(d, labels(s))),
    "op6": lambda s, d: bpe.encode_decode(d),
    "op7": lambda s, d: setsketch.near_duplicates(d),
    "op9": lambda s, d: piecewise.fingerprints(d),
    "op10": lambda s, d: token_cache.token_counts(d),
}


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op", RUNS)
def test_odd_and_empty_tables(spark, op):
    out = RUNS[op](spark, frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ODD)
    assert RUNS[op](spark, frame(spark, [])).count() == 0


#: Names that the operators use inside, now or earlier, as extra columns of other types.
CLASHES = "n_lines n_removed gone doc stay _gone _doc _stay _d _s _z _copies _words _copy copies time j last salt place rows class u c0_ c1_ h keeper component_id kept n_shingles".split()


def clashing(spark, rows):
    d = frame(spark, rows)
    for k, c in enumerate(CLASHES):
        d = d.withColumn(c, F.lit(f"own {k}"))
    return d


@pytest.mark.parametrize("stage", ["quality", "lines", "near_duplicates", "mixing", "tokens"])
def test_stages_on_odd_empty_and_clashing_tables(spark, tmp_path, stage):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "tokens"]
    labels(spark).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    d = clashing(spark, ODD)
    out = f(spark, d, str(tmp_path))
    rows = out.collect()
    assert f(spark, d.limit(0), str(tmp_path)).count() == 0
    if stage == "tokens":
        assert len(rows) == len(ODD)
        return
    assert out.columns == d.columns and out.dtypes == d.dtypes
    assert all(r[c] == f"own {k}" for r in rows for k, c in enumerate(CLASHES))
    ids = [r.doc_id for r in rows]
    if stage == "near_duplicates":
        assert sorted(map(str, ids)) == sorted(map(str, [r[0] for r in ODD if r[0] != 6]))
    if stage == "lines":
        assert len(rows) == len(ODD)
    if stage == "mixing":
        assert not {1, 2, 3} & set(ids) and all(ids.count(i) <= 6 for i in set(ids))


@pytest.mark.parametrize("op", ["op1", "op3", "op5", "op6", "op7", "op9", "op10"])
def test_operators_pass_over_clashing_columns(spark, op):
    assert RUNS[op](spark, clashing(spark, ODD)).count() == len(ODD)


def test_lines_by_any_white_space(spark, monkeypatch):
    """Tabs and carriage returns are white space; many shared lines are met by salted keys."""
    rows = [(i, f"a\tshared  line\r\nown {i} words here\n  a\tshared  line\ntwo\twords", "en", f"s{i}") for i in range(12)]
    d = frame(spark, rows)
    few = sorted(map(tuple, line_spread.line_report(d).collect()))
    assert [r[2] for r in few] == [0] + [2] * 11
    near = [(i, f"a line near the threshold\nown {i} of them", "en", f"s{i % 10}") for i in range(100)]
    before = sorted(map(tuple, line_spread.line_report(frame(spark, near)).collect()))
    assert sum(r[2] for r in before) == 99
    monkeypatch.setattr(line_spread, "FEW", 0)
    assert sorted(map(tuple, line_spread.line_report(d).collect())) == few
    assert sorted(map(tuple, line_spread.line_report(frame(spark, near)).collect())) == before
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    assert sorted(con.execute(line_spread.ORACLE).fetchall()) == few


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, data, compare, name):
    compare(queries()[name](spark, data), oracle_sql()[name])


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    q = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    held = queries()["op1_quality_classifier"](spark, d).where("held_out").join(q, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    assert held.where("quality = 1 AND predicted = 0").count() <= 2


def test_quality_is_the_size_difference(spark):
    """The query's scores against sizes measured one block at a time, and one curve for all."""
    import zstandard

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = quality_compression.train_compression(docs, spark.read.parquet(f"{d}/labels.parquet"))

    def size(text, dictionary):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + 512])) for i in range(0, len(text), 512))

    out = {r.doc_id: r.score for r in queries()["op1_quality_classifier"](spark, d).collect()}
    for r in docs.collect():
        t = (r.text or "").encode()
        g, b = size(t, m.good), size(t, m.bad)
        z = m.curve[0] + (g + b) / (g + b + 100) * (m.curve[1] + m.curve[2] * (b - g) / max(1, g + b))
        assert np.isclose(out[r.doc_id], 1 / (1 + np.exp(-z)))


def test_dictionaries_take_texts_in_turn():
    long, short = b"x" * 50_000, [b"y" * 900, b"z" * 900]
    parts = quality_compression.pieces([long, *short], 6_000)
    assert [p[:1] for p in parts[:4]] == [b"x", b"y", b"z", b"x"] and sum(map(len, parts)) >= 6_000
    assert quality_compression.dictionary([b"few bytes"]) == b"few bytes"


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").where("lang IS NOT NULL")
    held = queries()["op3_language_id"](spark, d).where("held_out").join(lang, "doc_id")
    assert held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_pieces_of_a_long_text_add_up():
    """Reading in pieces changes no code length, no count and no margin."""
    rng = random.Random(8)
    model = ppm_language.fit_ppm([(1, "the cat and the hat on the mat " * 20, "en"), (2, "der hund und das haus größer " * 20, "de")], 3)
    words = ["the", "hund", "größer", "cat", "x", "#$", "日本"]
    text = "".join(rng.choice(words) + rng.choice((" ", "  ", "\n", " \t")) for _ in range(800)) + "end"
    for t in (text, "ab" * 700, " " * 900 + "x", "", "a " * 3):
        whole = ppm_language.code_lengths(model, [t.encode()])
        assert all(np.allclose(ppm_language.code_lengths(model, [t.encode(), b"hat"], k)[0], whole[0]) for k in (1, 7, 64))
        assert all(ngram_rules.base_counts(t, k) == ngram_rules.base_counts(t) == plain_base(t) for k in (5, 40))
        weights = np.random.default_rng(3).normal(size=1 << ngram_rules.BITS)
        assert all(np.allclose(ngram_rules.margins(weights, ["hat", t, "mat"], k), ngram_rules.margins(weights, ["hat", t, "mat"])) for k in (11, 64, 300))


def test_the_trees_drop_nothing():
    """Every run of bytes of the sample has its own code length, however rare and however many languages."""
    rows = [(i, " ".join(random.Random(i).choices(["".join(random.Random(j).choices("abcdefgh", k=4)) for j in range(300)], k=200)), f"l{i}") for i in range(40)]
    model = ppm_language.fit_ppm(rows)
    grams = {t[i : i + 4] for _, t, _ in rows for i in range(len(t) - 3)}
    assert len(model.grams[3]) == len(grams) and model.bits[3].shape == (len(grams), 40)
    assert ppm_language.languages_of(model, [rows[7][1].encode(), rows[31][1].encode()])[0] == ["l7", "l31"]


def test_a_long_labelled_text_costs_no_other_its_place(spark):
    """The text of the smallest hash is far over the bound; all other rows and languages are learned."""
    words = {"en": "the cat and the hat on a mat", "de": "der hund und das haus im wald"}
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, (words[g] + " ") * (40_000 if n < 4 else 3), g, "s") for n, i in enumerate(ids) for g in [("en", "de")[n % 2]]]
    d = frame(spark, rows)
    marks = spark.createDataFrame([(i, n % 2, 0) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    got = quality_compression.training_rows(d, marks, "quality", (5, 0), 1000)
    assert sorted((r[0], r[2]) for r in got) == sorted((i, n % 2) for n, i in enumerate(ids))
    long = [r[1] for r in got if len(r[1]) > 1000]
    assert len(long) == 4 and all(60_000 < len(t) <= 70_000 for t in long)
    assert ppm_language.train_ppm(d).languages == ("de", "en")


def test_parts_of_a_long_text_come_from_all_over_it(spark):
    text = "".join(chr(97 + k // 100 % 26) for k in range(2600)) + "é"
    d = spark.createDataFrame([(text,), ("short",), (None,), ("",)], "text string")
    got = [r[0] for r in d.select(common.sample_text(F.col("text"), 160, 16)).collect()]
    lines = got[0].split("\n")
    assert len(lines) == 16 and all(len(x) == 10 for x in lines) and lines[0] == "a" * 10 and lines[-1].endswith("é") and got[1:] == ["short", None, ""]


def test_verdicts_against_a_plain_scorer(spark):
    """The query's scores and verdicts from features spelled out one by one."""
    d = "/root/testdata/sf0.001"
    docs, labels_ = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = ngram_rules.train_ngram(docs, labels_)
    m64 = (1 << 64) - 1

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & m64
        return x ^ x >> 31

    codes = (np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)).tolist()
    word = lambda w: mixed(sum((codes[b] * 2 + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w.encode())) & m64)

    def score(text):
        h = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        slots = [x >> 46 for x in h] + [mixed(a * 3 + b & m64) >> 46 for a, b in zip(h, h[1:])]
        points = [mixed(ord(c) + 0x9E3779B97F4A7C15 & m64) for c in text]
        for n in ngram_rules.CHAR_N:
            for k in range(len(points) - n + 1):
                g = 0
                for p in points[k : k + n]:
                    g = g * 0x100000001B3 + p & m64
                slots.append((g * 0x9E3779B97F4A7C15 & m64) >> 46)
        z = m.calibration[0] * (sum(m.weights[i] for i in slots) / len(slots) if slots else 0.0) + m.calibration[1]
        return 1 / (1 + np.exp(-z))

    out = {r.doc_id: r for r in queries()["op5_quality_rules"](spark, d).collect()}
    for r in docs.orderBy("doc_id").collect()[::5]:
        t, o = r.text or "", out[r.doc_id]
        base = plain_base(t) if len(t) < 20_000 else ngram_rules.base_counts(t)
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == base
        assert o.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        s = score(t)
        assert np.isclose(o.score, s, atol=1e-9) and o.kept == (not o.base_failed and s >= 0.3)


def test_letterless_texts_are_unknown(spark):
    model = ppm_language.fit_ppm([(1, "the cat and the hat", "en"), (2, "der hund und das haus", "de")])
    assert ppm_language.languages_of(model, [b"", b"12 \xc2\xb2 _!", b"the hat", "der Hund".encode()])[0] == ["und", "und", "en", "de"]


def test_code_lengths_are_those_of_the_context_tree():
    """Against a plain walk from the longest context down."""
    rows = [(i, "abracadabra " * 3 + "alakazam ", g) for i, g in enumerate(("x", "y"))] + [(9, "banana bandana ", "y")]
    model = ppm_language.fit_ppm(rows, 2)
    train = {g: b"\n".join(t.encode() for _, t, h in rows if h == g) for g in ("x", "y")}

    def bits_of(g, text):
        total = 0.0
        for i, c in enumerate(text):
            past, esc = text[max(0, i - 2) : i], 0.0
            for k in range(len(past), -1, -1):
                ctx = past[len(past) - k :]
                after = [train[g][j + k] for j in range(len(train[g]) - k) if train[g][j : j + k] == ctx]
                if not after:
                    continue
                whole = len(after) + len(set(after))
                if c in after:
                    total += esc - np.log2(after.count(c) / whole)
                    break
                esc -= np.log2(len(set(after)) / whole)
            else:
                total += esc + 8
        return total

    for text in (b"abracadabra", b"banana", b"zebra a"):
        assert np.allclose(ppm_language.code_lengths(model, [text])[0], [bits_of("x", text), bits_of("y", text)], atol=1e-3)


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #*\n\t é", max_size=60))
def test_base_counts(text):
    assert ngram_rules.base_counts(text) == plain_base(text)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = {}
    for path in (bpe.default_path(), token_cache.default_path()):
        out[path] = Tokenizer.from_file(path)
        out[path].no_truncation()
        out[path].no_padding()
    out["words"] = token_cache.word_counter(token_cache.default_path())
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aAé '\n\t 1²日<|>endoftext", max_size=60))
def test_bpe_is_the_librarys(library, text):
    t, c = library[bpe.default_path()], bpe.codec(bpe.default_path())
    for x in (text, f"{text}<|endoftext|>{text}", text * 9):
        ids = t.encode(x, add_special_tokens=False).ids
        own = c.encode(x)
        assert np.frombuffer(own, "<u4").tolist() == ids
        assert c.decode(own) == t.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aAé '\n\t 1²́<|>s", max_size=40))
def test_word_counts_add_up(library, text):
    t = library[token_cache.default_path()]
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    assert n(text) == sum(n(w.decode()) for w in text.encode().split())
    assert token_cache.words_stand_alone(token_cache.default_path()) and not token_cache.words_stand_alone(bpe.default_path())


def test_codec_query_is_the_librarys(spark, library):
    d = "/root/testdata/sf0.001"
    t = library[bpe.default_path()]
    out = {r.doc_id: r for r in queries()["op6_bpe_codec"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(out) == len(docs)
    for r in docs:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        o = out[r.doc_id]
        assert o.n_tokens == len(ids) and o.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and o.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=8) | st.text(alphabet="aAé\u0301İıß日'’<|>endoftext\u200d\u0327²", max_size=20), max_size=60))
def test_words_together_count_as_alone(library, words):
    t = library[token_cache.default_path()]
    words = list(dict.fromkeys(w.decode() for x in words for w in x.encode("utf-8", "ignore").split()))
    assert library["words"](words) == [len(t.encode(w, add_special_tokens=False).ids) for w in words]


def test_token_cache_is_used(spark, tmp_path, library):
    d = frame(spark, ODD)
    cache = str(tmp_path / "cache")
    first = sorted((str(r[0]), r[2]) for r in token_cache.token_counts(d, cache=cache).collect())
    stored = spark.read.parquet(cache).count()
    assert sorted((str(r[0]), r[2]) for r in token_cache.token_counts(d, cache=cache).collect()) == first
    assert spark.read.parquet(cache).count() == stored == 7  # "" for null and blank texts, copies once
    t = library[token_cache.default_path()]
    assert first == sorted((str(i), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in ODD)


def test_second_run_of_the_query_encodes_nothing(spark, library):
    d = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, queries()["op10_token_counts"](spark, d).collect()))
    first = rows()
    stored = spark.read.parquet(token_cache.cache_of(spark, d))
    n = stored.count()
    counters = token_cache.counter, token_cache.word_counter
    try:  # no text may reach a tokenizer
        token_cache.counter = token_cache.word_counter = lambda path: lambda x: [1 / 0 for _ in x]
        assert rows() == first
    finally:
        token_cache.counter, token_cache.word_counter = counters
    assert spark.read.parquet(token_cache.cache_of(spark, d)).count() == n == stored.distinct().count()
    t = library[token_cache.default_path()]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = [(i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts.items()]
    assert first == sorted((i, b, k, k > 2048) for i, b, k in want)


def plain_components(rows, size, percent):
    sets = {}
    for i, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_counts_of_other_tokenizers(spark):
    """White space counts where the tokenizer's file doesn't drop it."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    texts = ["two  spaces", "two spaces", "a\n\n\nb", "a b", "", None, " x ", "x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    piece = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {"byte_bpe_50k.json": lambda x: len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(x, add_special_tokens=False)), "piece_bpe_32k.model": lambda x: len(piece.encode(x))}
    for name, count in plain.items():
        got = {r.doc_id: r.n_tokens for r in token_cache.token_counts(d, public_tokenizers.path(name)).collect()}
        assert got == {i: count(t or "") for i, t in enumerate(texts)}


@pytest.mark.parametrize("words, rare", [(60, False), (700, False), (60, True), (700, True)])
def test_near_copies_of_a_large_group(spark, monkeypatch, words, rare):
    """A group whose members are about as alike as the threshold, some of them with no partner."""
    if rare:  # buckets of over 64 are large, and their members meet by rare shingles
        monkeypatch.setattr(setsketch, "TURN", 1)
        figures = iter((0.0, 1.0))
        monkeypatch.setattr(setsketch, "comparisons", lambda mixed: next(figures))
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randint(0, words // 9)):
            t[rng.randrange(words)] = rng.choice(vocabulary)
        rows.append((i + 1, " ".join(t)))
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(2000 + i, "a b c d" if i % 2 else "A b\tc  d e") for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(d).collect()}
    want = plain_components(rows, 2, 80)
    assert out == want and len({c for _, c in want.values()}) > 60
    assert not rare or next(figures, None) is None


def test_a_large_bucket_whose_members_stay_apart(spark, monkeypatch):
    """1,200 texts of one template are 0.76 alike; a few have a partner that only rare shingles show."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(base + [f"t{rng.randrange(10**9)}" for _ in range(22)])) for i in range(1160)]
    rows += [(2000 + i, rows[29 * i][1].replace("w3 ", "v3 ") + " end") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    figures, plain = [], setsketch.comparisons
    monkeypatch.setattr(setsketch, "comparisons", lambda mixed: figures.append(plain(mixed)) or figures[-1])
    out = {r.doc_id: r.component_id for r in setsketch.near_duplicates(d).collect()}
    assert out == {i: i for i in range(1160)} | {2000 + i: 29 * i for i in range(40)}
    fewer, all_pairs = figures
    assert all_pairs > 500 * 500 and fewer < 20 * len(rows)


def stage_tasks(spark, group, job):
    """The result of job() and the largest number of tasks that one of its stages took."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = job()
        tracker = spark.sparkContext.statusTracker()
        stages = {k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds}
        return out, max(info.numTasks for info in map(tracker.getStageInfo, stages) if info)
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


@pytest.mark.parametrize("rare", [False, True])
def test_a_large_bucket_does_not_multiply_tasks(spark, monkeypatch, rare):
    """Where Spark deals skewed joins anew, both sides of a group that met by a join went to the
    product of their pieces, a task each."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(base + [f"t{rng.randrange(10**9)}" for _ in range(22)])) for i in range(900)]
    rows += [(2000 + i, rows[29 * i][1].replace("w3 ", "v3 ") + " end") for i in range(30)]
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "16k"}
    conf |= {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    figures = iter((0.0, 1.0) if rare else (1.0, 0.0))
    monkeypatch.setattr(setsketch, "comparisons", lambda mixed: next(figures))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
        found, most = stage_tasks(spark, f"large-{rare}", lambda: setsketch.near_duplicates(d).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in found} == {i: i for i in range(900)} | {2000 + i: 29 * i for i in range(30)}
    assert most <= 600


@pytest.mark.parametrize("r, m", [(1, 1), (1, 700), (300, 300), (700, 1300), (2, 0), (0, 5)])
def test_each_pair_of_rest_and_met_shares_one_cell(spark, r, m):
    """r members of the rest, the last of them met as well, and m others that are met."""
    both = r // 3
    d = spark.range(r + m).selectExpr("id doc_id", "5L key", f"id < {r} rest", f"id >= {r - both} met")
    n = F.lit(r).cast("long"), F.lit(m + both).cast("long")
    at = d.select("doc_id", F.explode(setsketch.cells(F.col("rest"), F.col("met"), *n, 0)).alias("x")).select("doc_id", "x.*").collect()
    groups = {}
    for x in at:
        p, z = groups.setdefault((x.turn, x.i, x.j), ([], []))
        p += [x.doc_id] * x.rest
        z += [x.doc_id] * x.met
    pairs = [(a, b) for p, z in groups.values() for a in p for b in z]
    assert sorted(pairs) == [(a, b) for a in range(r) for b in range(r - both, r + m)]
    assert all(len(p) < 400 and len(z) < 700 for p, z in groups.values())


def test_ids_with_an_empty_row_beside_a_full_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, text), (1, ""), (2, text + " end"), (2, None), (3, text + " end"), (4, "other words")], "doc_id long, text string")
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in setsketch.near_duplicates(d).collect())
    assert out == [(1, 0, 1), (1, 59, 1), (2, 0, 2), (2, 60, 1), (3, 60, 1), (4, 1, 4)]


def test_rare_shingles_of_partners_meet(spark):
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = {1: a, 2: np.sort(np.concatenate((a[40:], rng.integers(0, 1 << 63, 40).astype(np.uint64)))), 3: a[:1], 4: a[:320]}
    d = spark.createDataFrame([(k, k, bytearray(v.tobytes())) for k, v in sets.items()], "doc_id long, comp long, items binary")
    found, ahead = {}, {}
    for r in setsketch.rare_shingles(d, 80).collect():
        assert r.band == -1 and r.comp == r.doc_id and r.n == len(sets[r.doc_id])
        found.setdefault(r.doc_id, set()).add(r.key)
        if r.first:
            ahead.setdefault(r.doc_id, set()).add(r.key)
    assert {k: len(v) for k, v in found.items()} == {1: 81, 2: 81, 3: 1, 4: 65}
    assert {k: len(v) for k, v in ahead.items()} == {1: 45, 2: 45, 3: 1, 4: 36}
    assert found[1] & ahead[2] and ahead[1] & found[2] and found[1] & ahead[4]  # 0.82 and 0.8 alike
    assert not setsketch.rare_shingles(d.limit(0), 80).count()


def test_joint_estimate():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    for share in (0.5, 0.8, 1.0):
        k = int(1000 * 2 * share / (1 + share))
        a, b = h[:1000], np.concatenate((h[:k], h[2000 : 3000 - k]))
        r = setsketch.registers([a, b])
        got = setsketch.joint_estimate(r[:1], r[1:], np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(got - share) < 0.15
        merged = np.maximum(r[0], r[1])  # a sketch of the union
        assert (merged == setsketch.registers([np.union1d(a, b)])[0]).all()


def test_mix_is_near_target_and_repeats(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    a = pareto_mix.mix(d)
    assert a.where("taken > 3 * size").count() == 0
    assert sorted(map(str, a.collect())) == sorted(map(str, pareto_mix.mix(d.repartition(7)).collect()))
    one = a.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.g) <= r.m for r in one)
    assert sum(r.copies for r in a.collect()) == pareto_mix.mixed_documents(d).count()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_miss_their_targets_by_half_a_document_at_most(spark, sf):
    """Half of the smallest document of the source that was left out; a word for the rounding."""
    rows = pareto_mix.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        target, whole = own[0].target, int(own[0].target / own[0].source_size + 1e-9)
        left = [r["size"] for r in own if r["size"] and r.copies == whole]
        assert not left or abs(sum(r.taken for r in own) - target) <= min(left) / 2 + 1


def test_mix_of_clashing_columns_and_long_fills(spark):
    """A large document blocks the cut; smaller ones behind it fill the room, over many rounds."""
    rows = [(i, "w " * n, "en", g) for g in ("a", None) for i, n in enumerate([900, 700, 500, 300, 200, 120, 64, 32, 16, 8, 4, 2, 1] * 3)]
    d = clashing(spark, rows)
    for c in ("room", "low", "high", "key", "ratio", "left", "extra", "span"):
        d = d.withColumn(c, F.lit("own"))
    out = pareto_mix.mix(d).collect()
    assert len(out) == len(rows)
    for g in ("a", None):
        own = [r for r in out if r.source == g]
        left = [r["size"] for r in own if r.copies == int(own[0].target / own[0].source_size + 1e-9)]
        assert abs(sum(r.taken for r in own) - own[0].target) <= min(left) / 2
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text", "source").toArrow())
    want = sorted(con.execute(pareto_mix.ORACLE).fetchall())
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in out) == want


def test_mix_tells_repeated_ids_apart(spark):
    """1,000 rows of one doc_id, 1,000 of none and single ones in each source: within a document."""
    rows = [(i, "some words of text " * (1 + i % 9), "en", s) for i in range(500) for s in "abcd"]
    rows += [(7_000, "ten words " * 5, "en", s) for s in "abcd" for _ in range(1000)] + [(None, "ten words " * 5, "en", s) for s in "abcd" for _ in range(1000)]
    d = frame(spark, rows).repartition(5)
    out = pareto_mix.mix(d)
    assert out.count() == len(rows) and out.where("taken > 3 * size").count() == 0
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m"), F.countDistinct("copies").alias("k")).collect():
        assert abs(r.t - r.g) <= r.m and r.k >= 2
    mixed = pareto_mix.mixed_documents(d)
    want = {(r.source, r.doc_id, r["size"]): r.c for r in out.groupBy("source", "doc_id", "size").agg(F.sum("copies").alias("c")).collect() if r.c}
    got = mixed.groupBy("source", "doc_id", pareto_mix.word_count(F.col("text")).alias("size")).count().collect()
    assert {(r.source, r.doc_id, r["size"]): r["count"] for r in got} == want
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    theirs = con.execute(pareto_mix.ORACLE).fetchall()
    ours = out.select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(str((r[1], r[2], r[4])) for r in theirs) == sorted(str((r[1], r[2], r[4])) for r in ours)


def test_inclusion_follows_the_size_class(spark):
    rows = [(i, "w " * (1 << (i % 8)), "en", s) for i in range(8_000) for s in "ab"]
    out = pareto_mix.mix(frame(spark, rows)).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("c")).orderBy("size").collect()
    share = [r.c for r in out]  # source a is due two thirds of its size
    assert all(x <= y + 0.05 for x, y in zip(share, share[1:])) and share[0] < 0.35 and share[-1] > 0.6


def test_targets_share_the_excess(spark):
    s = spark.createDataFrame([("a", 900), ("b", 10), ("c", 90)], "source string, source_size long")
    t = {r.source: r.target for r in pareto_mix.source_targets(s).collect()}
    assert t["b"] == 30 and t["c"] == 270 and np.isclose(t["a"], 700)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_edit_distance(a, b):
    assert piecewise.edit_distance(a, b) == plain_distance(a, b)


def plain_print(text):
    """Every chunk's character, one chunk at a time."""
    data = np.frombuffer(text.encode(), np.uint8)
    block = piecewise.LEAST_BLOCK
    while block * piecewise.LENGTH < len(data):
        block *= 2
    roll, out = piecewise.rolling(data).tolist(), [str(block)]
    for size in (block, 2 * block):
        ends = [i + 1 for i, h in enumerate(roll) if h % size == size - 1 and i + 1 < len(data)] + [len(data)]
        chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
        out.append("".join(piecewise.ALPHABET[int(piecewise.span_hashes(c, np.array([0]), np.array([len(c)]))[0]) >> 58] for c in chunks))
    return ":".join(out)


def test_periodic_texts_keep_all_chunks():
    following = "".join(random.Random(5).choice("klmnopqrst uvw") for _ in range(2000))
    long = 0
    for k in range(200):
        rng = random.Random(k)
        text = ("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) + " ") * 600
        text = text[:2000]
        own = plain_print(text)
        assert piecewise.fingerprint(text.encode()) == own
        a = own.split(":")[1]
        if len(a) <= 128:
            continue
        long += 1
        other = plain_print(piecewise.edited(text, following))
        b = other.split(":")[1]
        near = piecewise.likeness(own, other)
        assert piecewise.edit_distance(a, b) == plain_distance(a, b)
        assert near == piecewise.row(1, text, own, following, own)[5] and 0.5 < near < 0.85  # the last third is another text
    assert long > 3


def spelled(text):
    """A fingerprint without the operator's code: the rolling hash, boundaries and chunk hashes in
    whole numbers, from the definition and its fixed random codes."""
    m64, data = (1 << 64) - 1, text.encode()
    codes = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64).tolist()
    rng = np.random.default_rng(20240607)
    byte_code = [int(x) * 2 + 1 & m64 for x in rng.integers(1, 1 << 63, 256, dtype=np.uint64)]

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & m64
        return x ^ x >> 31

    if not data:
        return "3::"
    block = 3
    while block * 64 < len(data):
        block *= 2
    roll = [mixed(sum(codes[data[i - k]] << 5 * k for k in range(min(7, i + 1))) & m64) >> 32 for i in range(len(data))]
    out = [str(block)]
    for size in (block, 2 * block):
        letters, chunk = "", []
        for i, (b, r) in enumerate(zip(data, roll)):
            chunk.append(b)
            if r % size == size - 1 or i + 1 == len(data):
                h = sum(byte_code[c] * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(chunk)) & m64
                letters += piecewise.ALPHABET[mixed(h) >> 58]
                chunk = []
        out.append(letters)
    return ":".join(out)


def plain_alike(a, b):
    """Likeness by a full table of edit distances and every common run."""
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    best = 0.0 if a != b else 1.0
    for p, q in {1.0: ((a1, b1), (a2, b2)), 2.0: ((a1, b2),), 0.5: ((a2, b1),)}.get(int(x) / int(y), ()):
        short, long = sorted((p, q), key=len)
        run = max(1, min(7, len(short) // 3))
        if short and any(short[i : i + run] in long for i in range(len(short) - run + 1)):
            best = max(best, 1 - plain_distance(p, q) / len(long))
    return best


def test_fingerprint_columns_against_the_definition(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()), reverse=True)
    out = {r.doc_id: r for r in queries()["op9_fingerprints"](spark, d).collect()}
    assert len(out) == len(rows)
    for k in range(0, len(rows), 4):
        i, t = rows[k]
        following = rows[(k + 1) % len(rows)][1]
        if len(t) + len(following) > 12_000:  # the definition in whole numbers is slow
            continue
        n = len(t) // 3
        e, r = t[: len(t) - n] + following[:n], out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        own, other, ahead = spelled(t), spelled(e), spelled(following)
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        assert np.isclose(r.near_edited, plain_alike(own, other)) and np.isclose(r.near_next, plain_alike(own, ahead))


def test_fingerprints_of_repeated_ids(spark):
    """One doc_id, or none, on most rows: they spread over partitions, and equal texts agree."""
    rows = [(5, f"text {i % 40} " * 30) for i in range(400)] + [(None, "no id " * 20)] * 200 + [(i, f"other {i}") for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = piecewise.fingerprints(d, 8)
    assert out.count() == len(rows)
    assert out.groupBy("fingerprint").agg(F.countDistinct("n_chars").alias("k")).where("k > 1").count() == 0
    a = sorted(map(str, out.collect()))
    assert a == sorted(map(str, piecewise.fingerprints(d.repartition(3), 5).collect()))


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_fingerprints_follow_descending_ids(spark, partitions):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdefg hij") for _ in range(rng.randint(0, 400)))) for i in rng.sample(range(1000), 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in piecewise.fingerprints(d, partitions).collect()}
    order = sorted(rows, reverse=True)
    assert len(out) == 40
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        e = piecewise.edited(t, following)
        r = out[i]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.fingerprint == piecewise.fingerprint(t.encode())
        assert r.near_edited == piecewise.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == piecewise.likeness(r.fingerprint, piecewise.fingerprint(following.encode()))


def test_line_spread_near_the_threshold(spark):
    rows = [(100 * k + i, f"a line that {k} sites share\nown line of {k} and {i} only", "en", f"s{i}") for k in (8, 9, 10, 11, 40) for i in range(k)]
    out = {r.doc_id: r.n_removed for r in line_spread.line_report(frame(spark, rows)).collect()}
    for k in (8, 9, 10, 11, 40):
        assert sum(out[100 * k + i] for i in range(k)) == (k - 1 if k >= line_spread.MIN_SITES else 0)


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.toPandas().to_dict("records")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, d).collect())
    model = quality_compression.train_compression(docs, spark.read.parquet(f"{d}/labels.parquet"))
    score = model.scorer().scores([(r["text"] or "").encode() for r in rows])
    rows = [r for r, s in zip(rows, score, strict=True) if s >= 0.3]
    sites, keeper = {}, {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            x = x.strip(" \t\v\f\r")
            if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 3:
                sites.setdefault(x, set()).add(r["source"])
                keeper[x] = min(keeper.get(x, r["doc_id"]), r["doc_id"])
    shared = {x for x, s in sites.items() if len(s) >= line_spread.MIN_SITES}
    for r in rows:
        if r["text"] is not None:
            left = [x for x in r["text"].split("\n") if (y := x.strip(" \t\v\f\r")) not in shared or keeper[y] == r["doc_id"]]
            r["gone"] = len(left) < len(r["text"].split("\n"))
            r["text"] = "\n".join(left)
    rows = [r for r in rows if not r.get("gone") or re.search(r"[^\x20\x09-\x0D]", r["text"])]
    comp = plain_components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    rows = [r for r in rows if comp[r["doc_id"]][1] == r["doc_id"]]
    left = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in pareto_mix.mix(left).collect()}
    c = bpe.codec(bpe.default_path())
    want = [(r["doc_id"], len(c.encode(r["text"] or "")) // 4, hashlib.sha256(c.encode(r["text"] or "")).hexdigest()) for r in rows for _ in range(copies[r["doc_id"]])]
    assert got == sorted(want)
