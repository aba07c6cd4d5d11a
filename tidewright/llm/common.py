"""What several operators share: inputs, shared folders, bounded samples, byte hashing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: 0x20 and 0x09-0x0D. Everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's ``spark.checkpoint.dir``.
    Where that is unset, the warehouse serves a local session; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tidewright"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one. What lies there serves one run; the cluster clears it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept_dir(spark: SparkSession, name: str, key: str) -> str:
    """A lasting folder under the shared one, the same for the same key."""
    return f"{shared_root(spark)}/{name}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed to c0_, c1_, .. by position, and what each is called now:
    an operator may then add columns of any other name. ``toDF(*df.columns)`` names them back."""
    names = {c: f"c{i}_" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to a shared folder and read back: cuts the lineage so
    that a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


#: Code points that a labelled text gives to a fit, at most, and the parts that a longer one gives them in.
SAMPLE_TEXT, SAMPLE_PARTS = 1 << 16, 16


def sample_text(text: Column, most: int = SAMPLE_TEXT, parts: int = SAMPLE_PARTS) -> Column:
    """``text`` for a fit: whole up to ``most`` code points; of a longer one as many in ``parts`` pieces,
    one a line, spread evenly from its start to its end. A text never costs another its place."""
    size = max(1, most // parts)
    start = lambda k: (F.floor((F.length(text) - size) * k / max(1, parts - 1)) + 1).cast("int")
    return F.when(F.length(text) <= most, text).when(text.isNotNull(), F.concat_ws("\n", *[F.substring(text, start(k), F.lit(size)) for k in range(parts)]))


#: Classes whose sizes are broadcast, at most; more meet their rows by a shuffled join.
FEW_CLASSES = 1 << 14


def bounded_sample(df: DataFrame, class_col: str, key_col: str, k: int) -> DataFrame:
    """At most ``k`` rows of each class: those with the smallest hash of the key.

    The class sizes (one row a class) decide a hash threshold first, so that the ranking
    window sees about ``2 k`` rows a class however large the table is. Repeated rows count once.
    Rows with a null class are left out. Ties on the hash are broken by the key. Sizes are broadcast
    up to FEW_CLASSES classes.
    """
    sizes = df.where(F.col(class_col).isNotNull()).groupBy(class_col).agg(F.count("*").alias("_n"))
    spread = F.pmod(F.xxhash64(F.col(key_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    few = sizes.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES
    near = (
        df.join(F.broadcast(sizes) if few else sizes, class_col)  # a row a class
        .withColumn("_u", spread)
        .where(F.col("_u") * F.col("_n") <= F.lit(2.0 * k + 50))
        .distinct()
    )
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(class_col).orderBy("_u", key_col))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank", "_u", "_n")


# --- Arrow batches -----------------------------------------------------------------------


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def by_bytes(docs: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of consecutive documents of about ``limit`` bytes; one long document is a
    run of its own."""
    a = size = 0
    for i, x in enumerate(docs):
        if i > a and size + len(x) > limit:
            yield a, i
            a, size = i, 0
        size += len(x)
    if a < len(docs):
        yield a, len(docs)


def small_batches(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2^64.
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    kept = _powers.get(str(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 16), base, np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if n <= 1 << 22:
            _powers[str(base)] = kept
    return kept[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span: differences of one running polynomial sum,
    moved to a common exponent by the inverse powers."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=total[1:])
    return mix64((total[ends] - total[starts]) * powers(len(data) + 1, INVERSE)[starts])


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
