"""Token counts through a digest cache.

The digest of a text's normalised content, with that of the tokenizer's version, is the key
of a stored count. Texts are joined to the stored counts by it; only distinct texts that
miss are encoded, and their counts are appended to the cache.

Normalising only does what the tokenizer does first itself: where its file makes the tokens
of a text those of its words, a run of ASCII white space counts as one space; elsewhere the
text is taken as it is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import SPACES, kept_dir, shared_dir, small_batches, text_bytes, written

LIMIT = 2048
#: Words whose counts a task keeps.
WORDS = 1 << 19
#: Copies of one text in more than one of so many rows are met by a broadcast.
COMMON = 1000
CACHE_DDL = "digest binary, version string, n_tokens long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def version_digest(path: str) -> str:
    """Digest of the tokenizer's file and its library's version."""
    import importlib

    library = importlib.import_module("sentencepiece" if path.endswith(".model") else "tokenizers")
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def content_digest(text: Column, by_word: bool = True) -> Column:
    """SHA-256 of the text, where words stand alone with each run of ASCII white space as one
    space, as 32 bytes. A single space is such a run already and is not touched."""
    normal = F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ") if by_word else text
    return F.unhex(F.sha2(normal, 256))


def cache_of(spark: SparkSession, sf_dir: str) -> str:
    """The lasting cache of the tables in ``sf_dir``: a later run encodes only what is new there."""
    return kept_dir(spark, "token-counts", sf_dir)


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version; none where the cache is new.

    Two writers that miss the same text store it twice with one count; it is read once.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_DDL).select("digest", "n_tokens")
    stored = spark.read.schema(CACHE_DDL).parquet(cache).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def words_stand_alone(path: str) -> bool:
    """Whether the tokenizer's file makes the tokens of a text those of its words one after the
    other: white space is dropped, and no rule reaches across it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    rules = json.dumps([file.get("normalizer"), file.get("pre_tokenizer")])
    plain = not any(x["lstrip"] or x["rstrip"] or x["normalized"] or set(x["content"]) & set(SPACES) for x in file.get("added_tokens", []))
    dropped = '"pattern": {"Regex": "\\\\s+"}, "content": " "' in rules and '"behavior": "Removed", "invert": true' in rules
    return plain and dropped and not file["model"].get("ignore_merges")


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens by the library of the file: sentencepiece for .model, else tokenizers."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda x: [len(e) for e in model.encode(x, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda x: [len(e) for e in t.encode_batch_fast(x, add_special_tokens=False)]


#: Words that are encoded as one string.
TOGETHER = 512


def word_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of words that stand alone: they are encoded as one string with spaces
    between, and each token counts for the word that its first character lies in."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def count(words: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            starts = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            encoded = t.encode(" ".join(part), add_special_tokens=False)
            at = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded))
            out += np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(part)).tolist()
        return out

    return count


def encoded_counts(texts: DataFrame, path: str | None) -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows by the tokenizer's library. Each executor finds its
    own copy of the public file; a ``path`` has to be one that all of them can open.

    Where words stand alone, each distinct word of a task is encoded once and its count kept
    (up to WORDS of them); else whole texts are.
    """
    by_word = words_stand_alone(path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (word_counter if by_word else counter)(path or default_path())
        kept: dict[bytes, int] = {}
        for batch in (s for x in batches for s in small_batches(x, 64)):
            if by_word:
                words = [x.split() for x in text_bytes(batch.column(1))]  # at ASCII white space
                if len(kept) > WORDS:
                    kept.clear()
                new = list({w for x in words for w in x if w not in kept})
                kept.update(zip(new, lengths([w.decode() for w in new]), strict=True))
                n = [sum(map(kept.__getitem__, x)) for x in words]
            else:
                n = lengths(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, path: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    ``cache`` is a folder that all executors share; without one a new cache is used. Null and
    empty texts share the count of an empty one; repeated rows share one count, and rows with a null
    doc_id are counted as well. Long texts are counted whole. An empty table gives an empty one.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    file = path or default_path()
    cache = cache or shared_dir(spark, "token-counts")
    version = version_digest(file)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = content_digest(F.col("text"), words_stand_alone(file))
    keyed = written(rows.select("doc_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    # copies meet in the map tasks first, then each distinct text is shuffled once
    distinct = rows.select(digest.alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text"))
    texts = distinct.join(cached_counts(spark, cache, version), "digest", "left_anti").select("digest", "text")
    encoded_counts(texts, path).select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = cached_counts(spark, cache, version)
    # a digest of over a COMMON-th of all rows would crowd one task; there are fewer than COMMON of them
    copies = keyed.groupBy("digest").agg(F.count("*").alias("copies"))
    often = written(copies.where(F.col("copies") * COMMON > keyed.count()).select("digest").join(counts, "digest"), "token-common")
    met = keyed.join(F.broadcast(often), "digest", "left")  # fewer than COMMON rows
    rest = met.where(F.col("n_tokens").isNull()).drop("n_tokens").join(counts, "digest")
    out = met.where(F.col("n_tokens").isNotNull()).unionByName(rest).select("doc_id", "n_bytes", "n_tokens")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
