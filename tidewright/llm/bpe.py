"""Byte-level BPE: encoding by a contiguous rank array, and decoding.

A word's parts are held as two parallel arrays: the tokens between neighbouring boundaries
and the merge rank of each adjacent pair. The array is scanned for its minimum, the boundary
there is deleted and the two neighbouring ranks are looked up again, until no pair has a
rank. Words over ``LONG`` bytes, where rescanning would be quadratic, take a heap instead;
the merges come in the same order. Each task keeps a bounded cache of words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewright.llm.common import small_batches

LONG = 128
CACHE_WORDS = 1 << 18
NO_RANK = 1 << 30
#: The byte-level pre-tokeniser's pattern (fixed by the vocabulary file's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte: printable Latin-1 stands for itself, the other
    bytes follow from code point 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = file["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_token = [0] * 256
        for c, b in alphabet.items():
            self.byte_token[b] = vocab[c]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        parts = [self.byte_token[b] for b in word]
        if len(parts) > LONG:
            return self.merge_long(parts)
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < NO_RANK:
            i = ranks.index(low)
            parts[i] = merged[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j >= 0 and (r := self.ranks.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # a boundary here is gone
            parts[i], parts[j] = self.merged[r], -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
                offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers."""
        ids = array("I", self.merge(word.encode()))
        if array("I", [1]).tobytes()[0] != 1:
            ids.byteswap()
        out = ids.tobytes()
        if len(word) <= LONG:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        known, new, found = self.cache.get, self.word, self.pattern.findall
        out: list[bytes] = []
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            out += [known(w) or new(w) for w in found(text[at : m.start()])]
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += [known(w) or new(w) for w in found(text[at:] if at else text)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        view = memoryview(ids).cast("I") if array("I", [1]).tobytes()[0] == 1 else [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
        get = self.token_bytes.__getitem__
        return b"".join(map(get, view)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    return Codec(path)


def encode_decode(docs: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``keep`` also ``ids``
    (array of int) and ``decoded``.

    A null text is an empty one: no tokens, the digests of nothing. Special tokens' strings in
    a text become the special ids. Long texts are encoded whole. Repeated rows are encoded each, null
    ids stay null; an empty table gives an empty one. Other columns are not read, whatever their
    names. Each executor finds its own copy of the public vocabulary; a ``path`` has to be one that
    all of them can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for batch in (s for x in batches for s in small_batches(x)):
            n, a, b, kept_ids, kept_text = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "")
                decoded = c.decode(ids)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep:
                    kept_ids.append(array("I", ids).tolist())
                    kept_text.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array(kept_ids, pa.list_(pa.int32())), pa.array(kept_text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, ddl + (", ids array<int>, decoded string" if keep else ""))
