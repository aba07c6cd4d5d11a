"""Line de-duplication by distinct-site spread.

A line that many sites share is boilerplate. Its spread is the number of distinct sites it
is found on: a HyperLogLog sketch for each line hash, merged by partial aggregation. Lines
whose estimate is near the threshold get an exact distinct count. A boilerplate line stays
in the document of smallest doc_id and goes from all others.

DataFrame operations only. The lines' text is never shuffled: hashes travel, and the
documents meet their own list of hashes at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SPACES, WORD, plain_names, written

MIN_SITES = 10
MIN_WORDS = 3
LG_K = 12
#: Up to so many shared lines (16 bytes each) are met by a broadcast; more are salted.
FEW = 1 << 18
SALTS = 32
#: Relative error band of a sketch with 2^12 registers, eight standard errors wide.
BAND = 8 * 1.04 / 2 ** (LG_K / 2)


def trimmed(line: Column) -> Column:
    """Without white space (0x20, 0x09 to 0x0D) at its ends."""
    return F.trim(line, F.lit(SPACES))


def line_hash(line: Column) -> Column:
    return F.xxhash64(trimmed(line))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """(h, keeper): hashes of lines found on ``min_sites`` sites or more, with the smallest
    doc_id that holds them. A null source is a site of its own; lines of fewer than
    ``min_words`` words never count, and white space at a line's ends is no part of it."""
    line = F.col("line")
    lines = (
        docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("site"), F.explode(split_lines(F.col("text"))).alias("line"))
        .where(F.regexp_count(line, F.lit(WORD)) >= min_words)
        .select("doc_id", "site", line_hash(line).alias("h"))
    )
    spread = lines.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min("doc_id").alias("keeper")
    )
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    wide = written(spread.where(F.col("sites") >= low), "spread")
    near = wide.where(F.col("sites") <= high).select("h")
    exact = (
        met(lines, near, "site").select("h", "site").distinct()
        .groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h")
    )
    clear = wide.where(F.col("sites") > high).select("h", "keeper")
    return clear.unionByName(wide.join(exact, "h", "left_semi").select("h", "keeper"))


def met(lines: DataFrame, shared: DataFrame, spread: str) -> DataFrame:
    """``lines`` (h, ..) with the rows of ``shared`` (h, ..) that have their hash. A shared line is a hot
    key by nature: where the shared lines are few, by count, they are broadcast; else the key is
    salted by the column ``spread`` of the lines."""
    if shared.limit(FEW + 1).count() <= FEW:
        return lines.join(F.broadcast(shared), "h")  # FEW rows at most
    salt = F.pmod(F.xxhash64(spread, "h"), F.lit(SALTS)).cast("int")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", salt).join(salted, ["h", "salt"])


def removed_lines(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, gone): for each document the hashes of the lines that it loses."""
    own = docs.select("doc_id", F.explode(split_lines(F.col("text"))).alias("line")).select("doc_id", line_hash(F.col("line")).alias("h"))
    shared = written(shared, "shared-lines")
    hits = met(own, shared, "doc_id").where(F.col("doc_id") != F.col("keeper"))
    # a document's own distinct shared lines: bounded by its length
    return hits.groupBy("doc_id").agg(F.collect_set("h").alias("gone"))


def shortened(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under plain names, with the shared lines taken out of the text, and with n_lines
    and n_removed; and what each column is called there."""
    d, at = plain_names(docs)
    slim = docs.select("doc_id", "text", "source")
    gone = removed_lines(slim, shared_lines(slim, min_sites, min_words)).withColumnRenamed("doc_id", "doc")
    text = F.col(at["text"])
    lines, hit = split_lines(text), F.col("gone").isNotNull()
    stay = F.filter(lines, lambda x: ~F.array_contains(F.col("gone"), line_hash(x)))
    out = d.join(gone, F.col(at["doc_id"]) == F.col("doc"), "left").withColumn("stay", F.when(hit, stay))
    out = out.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_removed", F.when(hit, F.col("n_lines") - F.size("stay")).otherwise(0).cast("long"))
    out = out.withColumn(at["text"], F.when(hit, F.array_join("stay", "\n")).otherwise(text))
    return out.select(*d.columns, "n_lines", "n_removed"), at


def drop_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with the shared lines taken out of ``text``;
    columns unchanged, whatever their names.

    Null text stays null; an empty text is one empty line. Rows that repeat a doc_id lose the
    same lines. A row with a null doc_id is never a keeper and loses nothing. Long texts keep their
    order; an empty table gives an empty one.
    """
    out, at = shortened(docs, min_sites, min_words)
    return out.select(*at.values()).toDF(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """One row a document: what it lost and a digest of what is left. Null text has no lines and
    the digest of an empty text; for the other cases see ``drop_shared_lines``."""
    out, at = shortened(docs.select("doc_id", "text", "source"))
    text = F.coalesce(at["text"], F.lit(""))
    return out.select(F.col(at["doc_id"]).alias("doc_id"), "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, coalesce('s' || source, '') AS site, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents)
), b AS (
  SELECT t, min(doc_id) AS keeper FROM l
  WHERE len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) >= {MIN_WORDS}
  GROUP BY t HAVING count(DISTINCT site) >= {MIN_SITES}
), m AS (
  SELECT l.doc_id, l.i, l.line, (b.t IS NOT NULL AND l.doc_id <> b.keeper) AS gone
  FROM l LEFT JOIN b ON l.t = b.t
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed,
       length(coalesce(g.text, '')) AS n_chars, sha256(coalesce(g.text, '')) AS text_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
