"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's target is min(cap * size, level * weight) with the one level at which the targets
sum to the wished total: clamping the full sources and resharing their excess by weight until
none is above ends in just this. The level comes from a running sum over sources in order of
capacity per weight, so there is no loop. A document is then taken floor(epochs) times whole,
and once more where it lies in the seeded fraction of its source.

The fraction is cut from a seeded order of the source's documents, a hash of their ids. Words are summed by source and slice of the
order; running sums over slices tell in which one a source's cut lies, and running sums over the documents of these slices alone tell the
last document that is taken. That place in the order, one a source, is all that the others need: documents are compared
with it where they are, so neither texts nor a hot source ever move or meet. There are some sqrt(n) slices of sqrt(n) documents, so neither
the slices of a source nor the documents of a slice are many. The cut is as exact as one running sum over the source: the taken words miss the target
by at most half the size of one document.

Defined cases: null and blank texts have size 0 and are taken 0 words; a null source is a
source of its own, ordered last; sources without words have target 0; equal ids are ordered
by size, equal rows by where they stand, and are interchangeable; very long texts are counted whole, in the JVM; extra columns are kept, whatever
their names, by `repeated`, while `plan` replaces input columns that have the names of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faturaflow.llm.common import free, n_words, table, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row a source."""
    # Sums and ranks over the sources themselves, one row each, never over documents.
    every = W.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight)
    s = s.withColumn("room", F.lit(cap) * F.col("source_size"))
    before = every.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    # If all sources up to this one are full, the rest is shared by the weights that remain.
    s = s.withColumns(
        {
            "wished": F.lit(share) * F.sum("source_size").over(every),
            "full": F.sum("room").over(before.rowsBetween(W.unboundedPreceding, -1)),
            "open": F.sum("weight").over(before.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    )
    level = (F.col("wished") - F.coalesce("full", F.lit(0.0))) / F.col("open")
    s = s.withColumn("fits", F.when(level * F.col("weight") <= F.col("room"), level))
    # The first source, in this order, that stays below its room sets the level.
    s = s.withColumn("level", F.first("fits", ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("room"), F.coalesce(F.col("level") * F.col("weight"), F.col("room")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _key(column: str):
    """A join key that null sources share, and that no real source equals."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def _place(seed: str, size: Column) -> Column:
    """Where a document stands in the order of its source."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.struct(F.md5(F.concat(F.lit(seed), text).cast("binary")).alias("o"), F.col("doc_id").alias("i"), size.alias("s"), F.monotonically_increasing_id().alias("r"))


def _bits(n: int) -> int:
    """Bits of the order that make a slice of n documents: about sqrt(n) slices."""
    return min(31, math.ceil(math.log2(max(1, n)) / 2))


def _slice(order: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), 32 - bits)


def cuts(base: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, int]:
    """(key, source_size, target, whole, slice, last), a row a source, of base (key, source, place); and how many bits of the order make a slice.

    Every document is taken `whole` times, and once more if its slice is below `slice`, or equal to it and its place is not above `last`.
    """
    bits = _bits(base.count())
    base = base.withColumn("slice", _slice(F.col("place.o"), bits))
    parts = base.groupBy("key", "slice").agg(F.sum("place.s").alias("part"), F.first("source").alias("source"))
    parts = written(parts, "slices", small=True)
    sizes = parts.groupBy("key").agg(F.sum("part").alias("source_size"), F.first("source").alias("source"))
    wanted = targets(sizes.drop("key"), weights, share, cap).withColumn("key", _key("source")).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = wanted.withColumn("whole", F.floor(epochs)).withColumn("cut", (epochs - F.col("whole")) * F.col("source_size"))
    wanted = written(wanted, "targets", small=True)
    before = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("part").over(before), F.lit(0))).join(F.broadcast(wanted), "key")
    # The slice in which the cut lies; slices before it are taken whole, those after it not at all.
    at = ahead.filter(F.col("ahead") + F.col("part") > F.col("cut")).groupBy("key").agg(F.min(F.struct("slice", "ahead", "cut")).alias("x")).select("key", "x.*")
    inside = W.partitionBy("key").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = base.join(F.broadcast(at), ["key", "slice"]).withColumn("upto", F.sum("place.s").over(inside))
    rows = rows.filter(F.col("ahead") + F.col("upto") - F.col("place.s") / 2 <= F.col("cut"))
    last = rows.groupBy("key").agg(F.max("place").alias("last"))
    found = wanted.join(at.select("key", "slice"), "key", "left").join(last, "key", "left")
    return found.select("key", "source_size", "target", "whole", "slice", "last"), bits


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "") -> DataFrame:
    """docs with size, source_size, target and copies, the times the mix takes the document."""
    return _planned(docs, ["size", "source_size", "target", "copies"], n_words(text_of()), weights, share, cap, seed)


def _planned(docs: DataFrame, names: list[str], size: Column, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "") -> DataFrame:
    """docs with the four columns of `plan` under these names; size counts the words of a row."""
    base = written(docs.select(_key("source").alias("key"), "source", _place(seed, size).alias("place")), "places")
    key, own, info = free(docs, "__key", "__place", "__info")
    found, bits = cuts(base, weights, share, cap)
    found = found.select(F.col("key").alias(key), F.struct("source_size", "target", "whole", "slice", "last").alias(info))
    rows = docs.drop(*names).withColumn(own, _place(seed, size)).withColumn(key, _key("source")).join(F.broadcast(found), key)
    mine = _slice(F.col(f"{own}.o"), bits)
    extra = (mine < F.col(f"{info}.slice")) | ((mine == F.col(f"{info}.slice")) & (F.col(own) <= F.col(f"{info}.last")))
    copies = F.when(F.col(f"{own}.s") > 0, F.col(f"{info}.whole") + F.coalesce(extra, F.lit(False)).cast("int")).otherwise(F.lit(0)).cast("int")
    values = F.col(f"{own}.s"), F.col(f"{info}.source_size"), F.col(f"{info}.target"), copies
    return rows.withColumns(dict(zip(names, values, strict=True))).drop(key, own, info)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with the columns of docs."""
    names = free(docs, "__size", "__source_size", "__target", "__copies", "__copy")
    mixed = _planned(docs, names[:4], n_words(text_of()), **how).filter(F.col(names[3]) > 0)
    return mixed.withColumn(names[4], F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the mix of all `documents`, one row a document; their words are counted once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(text_of()).alias("__n"))
    mixed = _planned(written(docs, "sizes"), ["size", "source_size", "target", "copies"], F.col("__n"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def sql() -> str:
    """The digest in DuckDB's SQL, with plain running sums in place of slices."""
    return r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{9}-\x{D}]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
      FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS room FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY room / w, encode(source) NULLS LAST) AS k, 1.5::DOUBLE * sum(source_size) OVER () AS wished FROM r),
l AS (SELECT *, (wished - coalesce(sum(room) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(room, coalesce((SELECT arg_min(level, k) FROM l WHERE level * w <= room) * w, room)) AS target FROM l),
c AS (SELECT doc_id, size, source_size, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS middle,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(e) + CASE WHEN middle <= (e - floor(e)) * source_size AND e > floor(e) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c"""
