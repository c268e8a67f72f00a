"""Best-fit packing: documents into bins of a fixed number of tokens, without two of one source or one duplicate cluster in a bin."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import materialize, read
from .exact_dedup import normalised
from .mixing import n_words

#: Tokens of a bin; rows that one task packs in the first pass, about, and shards that one task of the second takes up.
CAPACITY, SHARD_ROWS, TOGETHER = 2048, 2_000, 16
#: Bins with less of their capacity in use after the first pass are packed anew in the second.
FILLED = 0.9
#: Bits of a bin's source bitmap, for the commonest sources of a shard; each bin has the exact set of its other sources.
SOURCE_BITS = 64
#: From so many members in a shard on, a cluster has a bit of its own in the index, so its members skip full levels.
LARGE_CLUSTER = 24


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item (0 < size <= capacity, in the order given), each in the tightest compatible bin.

    Bins are kept by residual. A bin carries a bitmap of its sources and one of its clusters, and exact sets
    of the sources and clusters that have no bit; an item fits if none of them has its own. For every bit the index counts, residual by residual, the bins without it, so
    the successor search goes from the item's size upwards through residuals that have a bin without its
    source and, if its cluster is large, one without its cluster, and on until a bin is compatible in both;
    of equal residuals the oldest such bin is taken. None compatible: a new bin. clusters < 0 conflict with none.
    """
    _, source, members = np.unique(sources, return_inverse=True, return_counts=True)
    source_bit = np.zeros(len(members), np.int64)  # bit 0 is every bin's: it stands for sources without a bit
    source_bit[np.argsort(-members, kind="stable")[:SOURCE_BITS]] = 1 + np.arange(min(len(members), SOURCE_BITS))
    ids, cluster, members = np.unique(clusters, return_inverse=True, return_counts=True)
    large = np.flatnonzero((members >= LARGE_CLUSTER) & (ids >= 0))
    n_bits = 1 + SOURCE_BITS + len(large)
    own_bit = np.full(len(ids), -1)
    own_bit[large] = 1 + SOURCE_BITS + np.arange(len(large))
    without = np.zeros((n_bits, capacity + 1), np.int32)  # bins at a residual that lack a bit
    lacks, held, others, residual = [], [], [], []  # by bin: bits that it lacks, its small clusters, its sources without a bit, its residual
    levels: list[dict[bytes, list[int]]] = [{} for _ in range(capacity + 1)]  # bins of a residual by what they lack, oldest first
    out = np.empty(len(sizes), np.int64)
    for i in range(len(sizes)):
        size, src, c = int(sizes[i]), int(source[i]), int(cluster[i])
        bit = int(source_bit[src])
        extra = int(own_bit[c])
        open_ = without[bit, size:] > 0
        if extra >= 0:
            open_ &= without[extra, size:] > 0
        found, at = -1, int(open_.argmax()) if open_.size else 0
        while found < 0 and open_.size and open_[at]:
            for groups in levels[size + at].values():
                free = lacks[groups[0]]
                if free[bit] and (extra < 0 or free[extra]):
                    for b in groups:
                        if (extra >= 0 or ids[c] < 0 or c not in held[b]) and (bit or src not in others[b]):
                            found = b if found < 0 else min(found, b)
                            break
            if found < 0:
                more = open_[at + 1 :]
                step = int(more.argmax()) if more.size else 0
                if not more.size or not more[step]:
                    break
                at += 1 + step
        if found < 0:
            found = len(residual)
            lacks.append(np.ones(n_bits, bool))
            held.append(set())
            others.append(set())
            residual.append(capacity)
        else:
            key = lacks[found].tobytes()
            group = levels[residual[found]][key]
            group.remove(found)
            if not group:
                del levels[residual[found]][key]
            without[:, residual[found]] -= lacks[found]
        if bit:
            lacks[found][bit] = False
        else:
            others[found].add(src)
        if extra >= 0:
            lacks[found][extra] = False
        else:
            held[found].add(c)
        residual[found] -= size
        left = residual[found]
        if left:  # a full bin takes nothing more
            without[:, left] += lacks[found]
            group = levels[left].setdefault(lacks[found].tobytes(), [])
            group.append(found)
            if len(group) > 1 and group[-2] > found:
                group.sort()
        out[i] = found
    return out


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["last", "cluster", "source", "h", "rid"], ascending=[False, True, True, True, True], na_position="last", ignore_index=True)


def _bins(pdf: pd.DataFrame, capacity: int) -> np.ndarray:
    """Bins of the last pieces of ordered rows, -1 for rows without tokens."""
    some = (pdf["last"] > 0).to_numpy()
    bins = np.full(len(pdf), -1, np.int64)
    clusters, _ = pd.factorize(pdf["cluster"][some])
    clusters[pdf["no_cluster"].to_numpy()[some]] = -1
    sources, _ = pd.factorize(pdf["source"][some], use_na_sentinel=False)
    bins[some] = best_fit(pdf["last"].to_numpy()[some], sources, clusters, capacity)
    return bins


def pack(docs: DataFrame, capacity: int = CAPACITY, size=None, cluster=None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Bins for documents: doc_id, rid, piece, pieces, start, length, shard, bin, source, cluster; a row for each piece of a document.

    size and cluster are columns over docs: tokens (default: white-space words) and duplicate cluster
    (default: equal texts without white space). A document of more than `capacity` tokens is cut into full pieces, each a bin of its own, and
    a last piece that is packed like the others. Rows go to shards of about shard_rows by a hash of doc_id
    and text, so a source with a third of all rows is spread evenly; a shard is packed by one task, largest
    first, then by cluster, source and hash. In a second pass, the bins that are less than FILLED are taken up and their
    documents packed anew, those of TOGETHER shards by one task, so that what shards leave part-empty meets. Bins
    are numbered within shards, so (shard, bin) names one; those of the second pass have shards from the first pass's number on.

    Documents without tokens (null, empty or blank text) get one piece of length 0 in bin -1. A null source is a
    source of its own. Repeated rows are packed each, never in one bin, as they are of one cluster; only rows that repeat more than
    a quarter of shard_rows times are dealt by their place, others by what they hold, whatever the table's layout. Very long
    texts make many pieces. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    words = n_words(F.col("text")) if size is None else size
    same = F.xxhash64(normalised(F.col("text"))) if cluster is None else cluster
    # pandas has no long that may be null, so nulls travel as flags
    slim = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "source", words.cast("long").alias("size"), F.coalesce(same.cast("long"), F.lit(0)).alias("cluster"), same.isNull().alias("no_cluster"), F.xxhash64("doc_id", "text").alias("h"))
    slim = materialize(slim.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    shards = max(1, -(-slim.count() // shard_rows))
    groups = -(-shards // TOGETHER)
    full = F.floor((F.col("size") - 1) / capacity).cast("int")  # pieces before the last
    slim = slim.withColumn("before", F.greatest(F.lit(0), full)).withColumn("last", F.col("size") - F.col("before") * capacity)
    # crowds of rows that repeat in full: at most 4 of them a shard
    crowds = slim.groupBy(F.col("h").alias("crowd")).agg(F.count("*").alias("n")).where(F.col("n") * 4 > shard_rows).select("crowd")
    slim = slim.join(F.broadcast(crowds), F.col("h") == F.col("crowd"), "left")
    slim = slim.withColumn("shard", F.pmod(F.xxhash64("h", F.when(F.col("crowd").isNotNull(), F.col("rid"))), F.lit(shards)).cast("int")).drop("crowd")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        pdf["bin"] = _bins(pdf, capacity)
        used = np.bincount(pdf["bin"] + 1, pdf["last"], pdf["bin"].max() + 2)
        pdf["open"] = (pdf["bin"] >= 0) & (used[pdf["bin"] + 1] < FILLED * capacity) & (shards > 1)
        # bins of full pieces are numbered after the others
        pdf["home"], pdf["own"] = pdf["shard"], pdf["bin"].max() + 1 + np.cumsum(pdf["before"]) - pdf["before"]
        return pdf

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        pdf["bin"], pdf["shard"] = _bins(pdf, capacity), shards + pdf["shard"] % groups
        return pdf

    schema = StructType([*slim.schema, StructField("bin", LongType()), StructField("open", BooleanType()), StructField("home", IntegerType()), StructField("own", LongType())])
    packed = materialize(slim.groupBy("shard").applyInPandas(first, schema), "first")
    again = packed.where("open").groupBy(F.pmod("shard", F.lit(groups))).applyInPandas(second, schema)
    packed = packed.where("not open").unionByName(again)
    piece = F.posexplode(F.sequence(F.lit(0), F.col("before"))).alias("piece", "at")
    packed = packed.select("*", piece)
    last = F.col("piece") == F.col("before")
    return packed.select(
        F.expr("if(no_id, null, doc_id)").alias("doc_id"), "rid", "piece", (F.col("before") + 1).alias("pieces"), (F.col("piece") * F.lit(capacity).cast("long")).alias("start"),
        F.when(last, F.col("last")).otherwise(F.lit(capacity).cast("long")).alias("length"), F.when(last, F.col("shard")).otherwise(F.col("home")).alias("shard"), F.when(last, F.col("bin")).otherwise(F.col("own") + F.col("piece")).alias("bin"), "source", F.expr("if(no_cluster, null, cluster)").alias("cluster"),
    )


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Bins of 2048 words for all documents."""
    return pack(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("rid")
