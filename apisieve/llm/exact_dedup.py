"""Exact dedup of incoming batches against an immutable snapshot, screened by binary fuse filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read
from .fuse import BinaryFuse

#: Distinct digests of the snapshot that one filter holds, about 230 KB of filter.
KEYS_A_FILTER = 200_000
#: Digests that are broadcast at most (32 bytes each), beyond which Spark joins by shuffle.
BROADCAST_DIGESTS = 200_000
FILTER_SCHEMA = "bucket long, seed long, segment long, count long, fuse binary"


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def build_filters(groups: DataFrame, n_buckets: int) -> DataFrame:
    """A filter for each bucket of the snapshot's digests: rows of FILTER_SCHEMA, kept beside the snapshot and never changed."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(pdf["k"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([(int(pdf["bucket"].iloc[0]), *made.to_row())], columns=["bucket", "seed", "segment", "count", "fuse"])

    return _bucketed(groups, n_buckets).select("bucket", "k").groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def _bucketed(groups: DataFrame, n_buckets: int) -> DataFrame:
    k = F.xxhash64("key")
    return groups.withColumn("k", k).withColumn("bucket", F.pmod(F.shiftright(k, 7), F.lit(n_buckets)))


def screen(groups: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """(key, maybe): whether a filter takes an incoming digest for one of the snapshot's. Digests come distinct, so buckets are even."""

    def probe(new: pd.DataFrame, fuse: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return pd.DataFrame({"key": [], "maybe": []})
        if len(fuse):
            maybe = BinaryFuse.from_row(*fuse.iloc[0][["seed", "segment", "count", "fuse"]]).contains(new["k"].to_numpy(np.int64).view(np.uint64))
        else:
            maybe = np.zeros(len(new), bool)
        return pd.DataFrame({"key": new["key"], "maybe": maybe})

    incoming = _bucketed(groups, n_buckets).select("bucket", "k", "key").groupBy("bucket")
    return incoming.cogroup(filters.groupBy("bucket")).applyInPandas(probe, "key binary, maybe boolean")


def _groups(rows: DataFrame) -> DataFrame:
    """A row for each key: its rows' number and the one that stays (most code points, smallest doc_id, null last). Summed before the shuffle."""
    return rows.groupBy("key").agg(F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id", "rid")).alias("best"), F.count("*").alias("n"))


def exact_dedup(docs: DataFrame, incoming: Column | None = None, digest=sha256, rid: Column | None = None) -> DataFrame:
    """Groups of equal normalised texts, one row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, rid.

    rid is a number of the rows (default: by place). incoming tells the rows of the new batch from those of
    the snapshot (default: by crc32 of doc_id); the result does not depend on it. Steps:
    1. digests of both, in one pass; equal ones are summed per task, so a huge group is a few rows per task;
    2. the snapshot's distinct digests get one binary fuse filter per bucket of KEYS_A_FILTER;
    3. the batch's distinct digests are grouped among themselves and screened: those that a filter refuses
       are new, the others join the snapshot's exact buckets;
    4. every group of several rows is checked byte by byte: grouped by digest and text. Texts that differ
       under one digest are told apart by their bytes.

    Null text is empty; null doc_id loses ties; rows repeated in full count each and one stays. Very long
    texts are digested and compared whole. Empty tables give no rows. Other columns are ignored.
    """
    rid, text = F.monotonically_increasing_id() if rid is None else rid, normalised(F.col("text"))
    incoming = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)) == 1 if incoming is None else incoming
    base = docs.select("doc_id", rid.alias("rid"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), incoming.alias("incoming"), text.alias("norm"))
    base = base.withColumn("key", digest(F.col("norm"))).withColumn("sha", F.col("key") if digest is sha256 else sha256(F.col("norm")))
    slim = materialize(base.drop("norm"), "digests")
    merged, clash = _merged(slim, base)
    if clash is not None:
        apart = F.when(F.col("clash"), F.concat("key", F.encode("norm", "utf-8"))).otherwise(F.col("key"))
        base = base.join(clash.withColumn("clash", F.lit(True)), "key", "left").withColumn("clash", F.coalesce("clash", F.lit(False)))
        base = base.withColumn("key", apart).drop("clash")
        slim = materialize(base.drop("norm"), "digests")
        merged, _ = _merged(slim, None)
    return slim.join(merged, "key").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.rid") == F.col("rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "rid"
    )


def _merged(slim: DataFrame, base: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Groups over snapshot and batch; with base, also the keys under which texts differ, None if there are none."""
    old = materialize(_groups(slim.where(~F.col("incoming"))), "snapshot")
    new = materialize(_groups(slim.where("incoming")), "batch")
    n_buckets = -(-max(old.count(), new.count(), 1) // KEYS_A_FILTER)
    filters = materialize(build_filters(old, n_buckets), "fuse")
    seen = new.join(screen(new, filters, n_buckets), "key")
    hits = materialize(seen.where("maybe").select("key", F.col("best").alias("b2"), F.col("n").alias("n2")), "hits")
    fresh = seen.where(~F.col("maybe")).select("key", "best", "n")
    # only hits meet the snapshot, which is not shuffled as long as they are few enough to be broadcast
    few = hits.count() <= BROADCAST_DIGESTS
    both = materialize(old.join(F.broadcast(hits) if few else hits, "key", "left").select("key", F.least("best", "b2").alias("best"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.col("b2").isNotNull().alias("hit")), "both")
    met = both.where("hit").select("key")  # of the hits, those that are in the snapshot; the others came through the filter by chance
    chance = hits.join(F.broadcast(met) if few else met, "key", "left_anti").select("key", F.col("b2").alias("best"), F.col("n2").alias("n"))
    merged = materialize(both.drop("hit").unionByName(fresh).unionByName(chance), "groups")
    if base is None:
        return merged, None
    several = merged.where("n > 1").select("key")
    several = F.broadcast(several) if several.count() <= BROADCAST_DIGESTS else several
    texts = base.select("key", "norm").join(several, "key", "left_semi").groupBy("key", "norm").agg(F.lit(1).alias("one"))
    clash = materialize(texts.groupBy("key").agg(F.sum("one").alias("texts")).where("texts > 1").select("key"), "clash")
    return merged, None if clash.isEmpty() else clash


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents, whose odd half by crc32 comes as a batch on the other half's snapshot."""
    return exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("rid")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
