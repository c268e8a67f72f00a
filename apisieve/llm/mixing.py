"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded hash that make a document's bucket; a third of 10^10 documents in one source leaves some 10^6 rows a bucket.
BUCKET_HEX = 3


def n_words(text):
    """Words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def water_fill(sizes: DataFrame, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """Targets for sources: (source, source_size) gets weight and target columns.

    A target is weight x level, clamped at max_epochs x source_size, where the level makes the targets
    add up to the sizes' total: what clamped sources leave is reshared among the others in proportion
    to weight until none is above its cap. That fixed point is found at once: sources sorted by
    cap / weight are clamped in this order, so the level after k clamps needs prefix sums only.
    The table has one row a source, already aggregated.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("nth"))
    every = Window.partitionBy(F.lit(1))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("clamped_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.col("clamped_size") * F.lit(float(max_epochs))) / F.col("open_weight"))
    )
    # The first source in this order that its level leaves at or below its cap sets the level of all.
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("k", "level"))).over(every)["level"]
    final = levels.withColumn("k", F.row_number().over(fill)).withColumn("level", reached)
    return final.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: str = "mix-1", size=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken, whole.

    docs: doc_id, source and text (or, with size, any column that size reads). A source's target over its
    size is the number of its epochs: every document is taken whole floor(epochs) times, and the fraction
    left is filled with further whole documents in a seeded order (by md5 of seed and doc_id, then doc_id
    and size), the last of which is cut where the target is met. So a source's taken words are its target
    rounded, no document is taken more than max_epochs times, and reruns agree. `whole` counts a document's
    whole repetitions.

    The order's prefix sums go through (source, bucket of the hash): a third of all rows in one source
    makes 4096 partial sums, and only the bucket where the fraction ends is ordered row by row.

    Null text: size 0, taken 0. Null source: a source of its own, last in order. Null doc_id: ordered by
    its size under an empty id. Repeated rows count each. Empty table: no rows. Columns named in carry follow; others are ignored.
    """
    size = n_words(F.col("text")) if size is None else size
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slim = materialize(docs.select("doc_id", "source", *carry, size.alias("size"), key.alias("key"), F.substring(key, 1, BUCKET_HEX).alias("bucket")), "mix")
    buckets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = water_fill(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), max_epochs, weights)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    along = Window.partitionBy("source").orderBy("bucket")
    targets = targets.withColumnRenamed("source", "of")
    buckets = (
        buckets.withColumn("end", F.sum("bucket_size").over(along))
        .join(targets, F.col("source").eqNullSafe(F.col("of")))
        .select(
            "of", F.col("bucket").alias("at"), "source_size", "target", "epochs",
            # what the fraction leaves for this bucket: all of it, none, or a cut inside
            F.greatest(F.lit(0), F.least(F.col("bucket_size"), F.col("rest") - (F.col("end") - F.col("bucket_size")))).alias("part"), "bucket_size",
        )
    )
    buckets = materialize(buckets, "mixb")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("bucket_size"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))
    rows = slim.join(buckets, same).select("doc_id", "source", *carry, "bucket", "key", "size", "source_size", "target", "epochs", "part", "bucket_size")
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - (F.sum("size").over(inside) - F.col("size"))))
    whole = rows.where(~cut).withColumn("extra", F.when(F.col("part") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    split = rows.where(cut).withColumn("extra", extra)
    out = whole.unionByName(split)
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        (F.col("epochs") + F.when(full, 1).otherwise(0)).cast("long").alias("whole"), *carry,
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: weights 1, 2, 3, repeating, 3 epochs at most."""
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM o),
t AS (
  SELECT source, source_size,
         least(cap, (SELECT arg_min(level, k) FROM l WHERE level * weight <= cap) * weight) AS target
  FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (r.epochs * d.size + greatest(0, least(d.size,
          (round(r.target)::BIGINT - r.epochs * r.source_size)
          - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size))))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
