"""Mixing sources to target weights by Pareto order sampling.

A source's target, in words, over its size is the number of copies that its documents are due.
The whole part is taken for certain. What is left of the target is a sample of fixed size, in
words, in which documents have unequal inclusion probabilities p: in proportion to the bit
length of their size, so that longer documents are likelier, scaled so that the words expected
are what is left. Classes whose p would pass 1 are certain and get one more whole copy. The
others are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the
smallest ratios are taken up to the size.

The smallest ratios are taken as long as they fit into the size; a document that doesn't is passed
over and the next ones are tried for the room that is left (first fit in the order of ratios). At the
end the smallest document left out is taken if that brings the sum nearer to the size. So a source
misses its target by half of the smallest document that it left out, at most.

The order within a source is never built in one task: ratios fall into equal bins of r / (1 + r),
the bins' sums are cumulated, and only the one bin where a source runs out of room is ordered, once for
each document that blocks it; room falls below that document's size each time.
Rows that repeat a source, doc_id and size are told apart by a number j, each with a u of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WORD, plain_names, written

#: No document is taken more often than this.
MAX_COPIES = 3
#: Bins of the ranking; the ordered bin holds about this share of a source.
BINS = 4096
#: Copies of one document that are numbered in one go.
RUN = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, j: Column, salt: str = "mix") -> Column:
    """A number in (0, 1) from 48 bits of the md5 of key and j; the same in every run."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), j.cast("string"), F.lit(f":{salt}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def same(a: str, b: str, *columns: str) -> Column:
    """Null-safe equality of columns of two aliased frames."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> the same with ``target``: weights 1, 2, 3 repeating in code
    point order (null last), shares of the whole, capped at MAX_COPIES times the size and the
    excess dealt out again by weight.

    The dealing stops where target = min(cap, weight * level) with one level for all; sources
    are filled in the order of cap / weight. One row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("_w", ((place - 1) % 3 + 1).cast("double")).withColumn("_cap", MAX_COPIES * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_w", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", (F.sum(F.col("source_size").cast("double")).over(every) - F.col("_full")) / F.col("_rest"))
    # the level at the first source that it does not fill; it falls from there on
    s = s.withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(every))
    target = F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return s.withColumn("target", target).select("source", "source_size", "target")


def numbered(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, j, class, u): a row for each row of ``docs``; those of one source,
    doc_id and size have j = 1, 2, .. and are counted before they are numbered, so that a doc_id
    that many rows repeat crowds no task."""
    rows = docs.select("source", "doc_id", word_count(F.col("text")).alias("size"))
    alike = rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    few = alike.where(F.col("n") <= RUN).select("source", "doc_id", "size", F.lit(1).cast("long").alias("a"), F.col("n").alias("b"))
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN).cast("long")))
    many = alike.where(F.col("n") > RUN).withColumn("a", starts).select("source", "doc_id", "size", "a", F.least("n", F.col("a") + RUN - 1).alias("b"))
    runs = few.unionByName(many.repartition("source", "doc_id", "size", "a"))
    out = runs.select("source", "doc_id", "size", F.explode(F.sequence("a", "b")).alias("j"))
    return out.withColumn("class", F.length(F.bin("size"))).withColumn("u", uniform(F.col("doc_id"), F.col("j")))


def class_plan(rows: DataFrame) -> DataFrame:
    """(source, class, source_size, target, whole, p, left): of each source's size classes, 64 at
    most. ``left`` is what the ranked documents have to bring."""
    classes = rows.groupBy("source", "class").agg(F.sum("size").alias("words"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("whole", F.floor(ratio + 1e-9).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    t = classes.alias("c").join(plan.alias("t"), same("c", "t", "source")).select("c.source", "class", "words", "source_size", "target", "whole", "rest")
    own = Window.partitionBy("source")
    above = F.coalesce(F.sum("words").over(own.orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum(F.col("words") * F.col("class")).over(own.orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("rate", F.when(upto > 0, (F.col("rest") - above) / upto))
    # classes from the largest down are certain until the rate fits
    fits = F.when(F.col("rate") * F.col("class") <= 1, F.struct("class", "rate"))
    t = t.withColumn("top", F.max(fits).over(own))
    p = F.when(F.col("class") > F.col("top.class"), 1.0).otherwise(F.least(F.lit(1.0), F.col("top.rate") * F.col("class")))
    t = t.withColumn("p", F.coalesce(p, F.lit(0.0)))
    certain = F.coalesce(F.sum(F.when(F.col("p") >= 1, F.col("words"))).over(own), F.lit(0))
    return t.select("source", "class", "source_size", "target", "whole", "p", (F.col("rest") - certain).alias("left"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, j, source_size, target, copies, taken for every row of ``docs``
    (doc_id, text, source).

    Null and empty texts and texts without words have size 0 and are taken 0 times. A null source
    is one source, a null doc_id one id. Rows that repeat a source, doc_id and size are numbered by
    j and sampled apart. Equal ratios: by doc_id, size, j. An empty table gives an empty one; other
    columns are not read, whatever their names.
    """
    rows = written(numbered(docs), "mix")
    plan = written(class_plan(rows), "mix-plan")
    p = F.col("p")
    known = rows.alias("r").join(plan.alias("q"), same("r", "q", "source", "class")).select("r.source", "doc_id", "size", "j", "u", "source_size", "target", "whole", "p", "left")
    ranked = known.where((F.col("size") > 0) & (p > 0) & (p < 1)).withColumn("ratio", F.col("u") / (1 - F.col("u")) / (p / (1 - p)))
    ranked = ranked.withColumn("bin", F.floor(F.col("ratio") / (1 + F.col("ratio")) * BINS).cast("int"))
    # whole words: what follows is exact
    room = F.greatest(F.lit(0), F.floor(F.col("left") + 1e-6)).cast("long")
    ranked = written(ranked.withColumn("left", room).withColumn("key", F.struct("ratio", "doc_id", "size", "j")), "mix-ranked")
    chosen = first_fit(ranked)
    out = ["doc_id", "source", "size", "j", "source_size", "target", "whole", "extra"]
    rest = known.where((F.col("size") == 0) | (p <= 0) | (p >= 1)).withColumn("extra", (p >= 1).cast("int"))
    dealt = rest.select(*out).unionByName(chosen.select(*out))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.col("extra")).cast("int")
    dealt = dealt.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return dealt.select("doc_id", "source", "size", "j", "source_size", "target", "copies", "taken")


def first_fit(ranked: DataFrame) -> DataFrame:
    """Rows (source, key, bin, size, left, ..) with ``extra``: 1 for those that are taken in the order
    of ``key``, each if it fits into what the source has left, and for the smallest one left out if
    half of it fits.

    A round takes, for each source, all that fits up to the first document that doesn't, and says so
    in one row: documents between two keys of at most the room's size. Rounds end where nothing blocks."""
    state = ranked.groupBy("source").agg(F.first("left").alias("room")).withColumn("low", F.lit(None).cast(ranked.schema["key"].dataType))
    spans = []
    while True:
        state = written(state, "mix-room")
        open_ = ranked.alias("r").join(state.alias("s"), same("r", "s", "source")).where("r.size <= s.room AND (s.low IS NULL OR r.key > s.low)").select("r.source", "key", "bin", "size", "room")
        # (source, bin) rows: at most BINS + 1 a source
        bins = open_.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
        before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
        cut = bins.where(F.col("below") + F.col("words") > F.col("room")).groupBy("source").agg(F.min(F.struct("bin", "below")).alias("at"))
        edge = open_.alias("o").join(cut.alias("c"), same("o", "c", "source") & (F.col("o.bin") == F.col("c.at.bin"))).select("o.*", "c.at.below")
        reach = F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
        blocked = edge.withColumn("reach", reach).where(F.col("reach") > F.col("room")).groupBy("source").agg(F.min(F.struct(F.col("key"), (F.col("reach") - F.col("size")).alias("used"))).alias("b"))
        met = state.alias("s").join(blocked.alias("b"), same("s", "b", "source"), "left")
        span = written(met.select("s.source", "low", F.col("b.b.key").alias("high"), "room", (F.col("room") - F.col("b.b.used")).alias("next")), "mix-span")
        spans.append(span.select("source", "low", "high", "room"))
        going = span.where("high IS NOT NULL")
        if not going.limit(1).count():
            break
        state = going.select("source", F.col("next").alias("room"), F.col("high").alias("low"))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    # a row a source and round; a document lies in one span at most
    every = every.withColumnRenamed("source", "s_source")
    held = F.col("source").eqNullSafe(F.col("s_source")) & F.expr("(low IS NULL OR key > low) AND (high IS NULL OR key < high)")
    placed = ranked.join(every, held, "left").withColumn("extra", F.coalesce((F.col("size") <= F.col("room")).cast("int"), F.lit(0))).select(*ranked.columns, "extra")
    placed = written(placed, "mix-placed")
    sums = placed.groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("used"), F.first("left").alias("all"), F.min(F.when(F.col("extra") == 0, F.struct("size", "key"))).alias("least"))
    last = sums.where(F.col("least.size") < 2 * (F.col("all") - F.col("used"))).select(F.col("source").alias("l_source"), F.col("least.key").alias("l_key"))
    joined = placed.join(last, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("key") == F.col("l_key")), "left")
    return joined.withColumn("extra", F.when(F.col("l_key").isNotNull(), 1).otherwise(F.col("extra"))).drop("l_source", "l_key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns unchanged, whatever their names.

    Of rows that repeat a source, doc_id and size, which are the first, second, .. of ``mix`` is
    settled by a number within their input partition, in order of text, on top of the counts of
    earlier partitions: they are numbered without being gathered.
    """
    d, at = plain_names(docs)
    key = ["source", "doc_id", "size"]
    every_row = written(mix(docs).select(*key, "j", "copies"), "mix-copies")
    copies, repeated = every_row.where("copies > 0"), every_row.where("j = 2").select(*key)
    every = d.select("*", F.col(at["source"]).alias("source"), F.col(at["doc_id"]).alias("doc_id"), word_count(F.col(at["text"])).alias("size"), F.spark_partition_id().alias("salt"))
    groups = copies.groupBy(*key).agg(F.max("j").alias("last"), F.max("copies").alias("copies"))
    times = lambda x: F.explode(F.sequence(F.lit(1), x))
    met = every.alias("d").join(groups.alias("g"), same("d", "g", *key)).select("d.*", "copies")
    if repeated.isEmpty():
        return met.withColumn("time", times(F.col("copies"))).select(*d.columns).toDF(*docs.columns)
    single = met.alias("d").join(repeated.alias("g"), same("d", "g", *key), "left_anti")
    single = single.withColumn("time", times(F.col("copies"))).select(*d.columns)
    many = written(every.alias("d").join(repeated.alias("g"), same("d", "g", *key), "left_semi"), "mix-repeated")
    counts = many.groupBy(*key, "salt").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition of the input
    counts = written(counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows"), "mix-counts")
    place = F.row_number().over(Window.partitionBy(*key, "salt").orderBy(at["text"]))
    placed = many.withColumn("place", place).alias("d").join(counts.alias("c"), same("d", "c", *key, "salt"))
    placed = placed.select("d.*", (F.col("before") + F.col("place")).alias("j"))
    found = placed.alias("d").join(copies.alias("c"), same("d", "c", *key, "j")).select("d.*", "copies")
    return single.unionByName(found.withColumn("time", times(F.col("copies"))).select(*d.columns)).toDF(*docs.columns)


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) AS j, length(bin(size)) AS c FROM d
), w AS (
  SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || j || ':mix'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM n
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, {MAX_COPIES} * sum(size)::DOUBLE AS cap,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS wt
  FROM w GROUP BY source
), f AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS filled,
         sum(wt) OVER () - coalesce(sum(wt) OVER before, 0) AS rest, sum(source_size) OVER () AS total
  FROM s WINDOW before AS (ORDER BY cap / wt, wt, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, max(CASE WHEN (total - filled) / rest * wt <= cap THEN (total - filled) / rest END) OVER () AS level FROM f
), t AS (
  SELECT source, source_size, least(cap, coalesce(level * wt, cap)) AS target FROM v
), p AS (
  SELECT source, source_size, target,
         floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-9::DOUBLE)::INT AS whole
  FROM t
), r AS (
  SELECT *, greatest(0.0, target - whole * source_size) AS rest FROM p
), k AS (
  SELECT w.source, c, sum(size)::DOUBLE AS words FROM w GROUP BY ALL
), g AS (
  SELECT k.*, (r.rest - coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(words * c) OVER (PARTITION BY k.source ORDER BY c ROWS UNBOUNDED PRECEDING), 0) AS rate
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
), h AS (
  SELECT *, max(CASE WHEN rate * c <= 1 THEN c END) OVER (PARTITION BY source) AS top FROM g
), q AS (
  SELECT source, c, words, coalesce(CASE WHEN c > top THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, max(CASE WHEN c = top THEN rate END) OVER (PARTITION BY source) * c) END, 0.0::DOUBLE) AS p FROM h
), z AS (
  SELECT *, coalesce(sum(CASE WHEN p >= 1 THEN words END) OVER (PARTITION BY source), 0) AS certain FROM q
), x AS (
  SELECT w.*, z.p, z.certain, r.source_size, r.target, r.whole, r.rest,
         CASE WHEN size > 0 AND z.p > 0 AND z.p < 1 THEN u / (1 - u) / (z.p / (1 - z.p)) END AS ratio
  FROM w JOIN z ON w.source IS NOT DISTINCT FROM z.source AND w.c = z.c JOIN r ON w.source IS NOT DISTINCT FROM r.source
), o AS (
  SELECT *, greatest(0, floor(rest - certain + 1e-6::DOUBLE))::BIGINT AS room, row_number() OVER (PARTITION BY source ORDER BY ratio NULLS LAST, doc_id NULLS FIRST, size, j) AS i FROM x
), walk AS (
  SELECT DISTINCT source, 0::BIGINT AS i, room AS left_, 0 AS extra, NULL::BIGINT AS size FROM o
  UNION ALL
  SELECT o.source, o.i, CASE WHEN o.size <= left_ THEN left_ - o.size ELSE left_ END, (o.size <= left_)::INT, o.size
  FROM walk g JOIN o ON g.source IS NOT DISTINCT FROM o.source AND o.i = g.i + 1 AND o.ratio IS NOT NULL
), y AS (
  SELECT source, min(left_) AS left_, arg_min(i, (size, i)) FILTER (extra = 0 AND i > 0) AS least, min(size) FILTER (extra = 0 AND i > 0) AS smallest FROM walk GROUP BY source
)
SELECT doc_id, o.size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (o.size * (whole + CASE WHEN p >= 1 THEN 1 WHEN ratio IS NOT NULL AND (g.extra = 1 OR (o.i = y.least AND y.smallest < 2 * y.left_)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o LEFT JOIN walk g ON o.source IS NOT DISTINCT FROM g.source AND o.i = g.i AND o.ratio IS NOT NULL LEFT JOIN y ON o.source IS NOT DISTINCT FROM y.source
"""
