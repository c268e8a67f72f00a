"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import functools
import math
import zlib
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import materialize, mix64, read, text_slices, tune, word_hashes
from .components import connected_components

#: Words of a shingle, least similarity, samples in a band and bands: similarity 0.8 shares a band with probability 0.9994.
SHINGLE, SIMILARITY, ROWS, BANDS = 5, 0.8, 4, 14
#: Buckets of more members that the first hubs leave open have their members' shared weights counted, in this many bins.
LARGE_BUCKET, BINS = 16, 32
#: What a text without such counts has in each bin: it bounds nothing.
_UNBOUND = 1e300
#: A shingle's weight is tf * idf with idf = ln(1 / f) / ln(1 / RARE), f being its share of all documents, held between
#: LEAST_IDF and 1: what fewer than a twentieth of the documents have counts in full, a passage that many share counts less.
#: Unbounded idf would split groups of near copies: what these share is common just because of them, and their differences are rare.
RARE, LEAST_IDF = 0.05, 0.25
#: Cells and rows of the count-min sketch of document frequencies. A cell holds the mean shingles per document / CELLS of N
#: beside its own (0.2 % at 500 words), well under RARE at every number of documents, and idf is 1 wherever f < RARE.
CELLS, DEPTH = 1 << 18, 2
#: Entries of the sampler's pool, and bytes of shingle bags that a task which compares texts remembers.
_CHUNK, _POOL_BITS, _CACHE_BYTES = 8192, 13, 24 << 20
#: The size of the Bloom filter of texts that are compared at all: 2^26 bits, 8 MB, at every size of the table.
_SCREEN_BITS = 26


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes) of texts data[at[i]:at[i + 1]], how often each occurs, and where each text's begin.

    A shingle is SHINGLE words in a row, A-Z in lower case; a text of fewer words is one shingle, an empty one has none.
    """
    words, first = word_hashes(data, at)
    n = len(words) - SHINGLE + 1
    whole = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            whole = mix64(whole + words[j : j + len(whole)]) if len(whole) else whole
    items, counts, sizes = [], [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            x, c = np.unique(whole[a : b - SHINGLE + 1], return_counts=True)
        elif b > a:
            with np.errstate(over="ignore"):
                h = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    h = mix64(h + w)
            x, c = h, np.ones(1, np.int64)
        else:
            x, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        items.append(x)
        counts.append(c)
        sizes.append(len(x))
    return np.concatenate(items), np.concatenate(counts), np.concatenate([[0], np.cumsum(sizes)])


def _cells(items: np.ndarray) -> list[np.ndarray]:
    return [(mix64(items + np.uint64(0x51ED270B * (d + 1))) >> np.uint64(64 - 18)).astype(np.int64) for d in range(DEPTH)]


class Frequencies:
    """Document frequencies from a count-min sketch, and the weights that follow."""

    def __init__(self, table: np.ndarray, n_docs: int):
        self.table, self.n_docs = table, n_docs

    def weights(self, items: np.ndarray, counts: np.ndarray) -> np.ndarray:
        df = np.min([self.table[d][c] for d, c in enumerate(_cells(items))], axis=0) if len(items) else np.zeros(0)
        share = np.clip(df / max(1, self.n_docs), 1e-12, 1.0)
        return counts * np.clip(np.log(share) / np.log(RARE), LEAST_IDF, 1.0)


def frequencies(docs: DataFrame) -> Frequencies:
    """The sketch over all documents: each task counts its own, and sketches add up in two rounds of groups that stay small, chunk by chunk."""

    def count(batches):
        table, n = np.zeros((DEPTH, CELLS), np.int32), 0
        for b in batches:
            for _, data, at in text_slices(b.column(0)):
                items, _, _ = shingles(data, at)
                n += len(at) - 1
                for d, c in enumerate(_cells(items)):
                    table[d] += np.bincount(c, minlength=CELLS).astype(np.int32)
        if n:
            flat = table.ravel()
            chunks = [flat[i : i + _CHUNK].astype(np.int64).tobytes() for i in range(0, len(flat), _CHUNK)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(chunks), dtype=np.int32)), pa.array(np.full(len(chunks), part, np.int32)), pa.array(np.where(np.arange(len(chunks)) == 0, n, 0)), pa.array(chunks, pa.binary())], names=["chunk", "part", "docs", "sums"]
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in pdf["sums"]], axis=0)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [pdf["part"].iloc[0]], "docs": [pdf["docs"].sum()], "sums": [total.tobytes()]})

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    schema = "chunk int, part int, docs long, sums binary"
    sketches = texts.mapInArrow(count, schema).withColumn("part", F.pmod("part", F.lit(max(1, math.isqrt(texts.rdd.getNumPartitions())))))
    rows = sketches.groupBy("chunk", "part").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema).collect()  # 64 rows of 64 kB
    if not rows:
        return Frequencies(np.zeros((DEPTH, CELLS), np.int64), 0)
    rows.sort(key=lambda r: r.chunk)
    return Frequencies(np.concatenate([np.frombuffer(r.sums, np.int64) for r in rows]).reshape(DEPTH, CELLS), sum(r.docs for r in rows))


class Sampler:
    """Improved consistent weighted sampling: for each of ROWS * BANDS samples the item with the least ln a = ln c - r (t - beta + 1), where t = floor(ln w / r + beta).

    r and c are Gamma(2, 1) and beta uniform, drawn in advance by a pool that an item's hash indexes. Equal
    (item, t) in a sample have the probability of the weighted Jaccard similarity. An item of weight 1, as
    most are, has t = 0, so its ln a is one number of the pool.
    """

    def __init__(self, seed: int = 17):
        rng, k, pool = np.random.default_rng(seed), ROWS * BANDS, 1 << _POOL_BITS
        self.r = rng.gamma(2, 1, (k, pool)).astype(np.float32)
        self.beta = rng.random((k, pool), np.float32)
        self.c = np.log(rng.gamma(2, 1, (k, pool))).astype(np.float32)
        self.odd = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.one = self.c - self.r * (1 - self.beta)

    def bands(self, items: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash for each text and band; texts without items get none (zeros). A text's items ascend, so ties go to the least."""
        full = np.flatnonzero(np.diff(at) > 0)
        out = np.zeros((len(at) - 1, BANDS), np.uint64)
        if not len(full):
            return out
        starts, sizes = at[:-1][full], np.diff(at)[full]
        other = np.flatnonzero(weights != 1)
        log_w = np.log(weights[other]).astype(np.float32)
        steps = np.zeros(len(items), np.int64)
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                h = np.full(len(full), band + 1, np.uint64)
                for k in range(band * ROWS, band * ROWS + ROWS):
                    i = (items * self.odd[k] >> np.uint64(64 - _POOL_BITS)).astype(np.int64)
                    a = self.one[k][i]
                    if len(other):
                        j = i[other]
                        r, beta = self.r[k][j], self.beta[k][j]
                        t = np.floor(log_w / r + beta)
                        a[other] = self.c[k][j] - r * (t - beta + 1)
                        steps[other] = t
                    hits = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
                    best = hits[np.searchsorted(hits, starts)]
                    h = mix64(h ^ items[best]) + steps[best].astype(np.uint64)
                out[full, band] = mix64(h)
        return out


@functools.cache
def sampler() -> Sampler:
    """The sampler that all share: each Python worker draws it once from its seed, which costs less than sending it."""
    return Sampler()


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of largest weights; items ascend."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total else 1.0


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, whole: bool = False) -> DataFrame:
    """Classes of near copies: doc_id, rid, class_id, class_size and kept, one row per row of docs, and with `whole` also the row itself as a struct.

    Documents are linked if the weighted Jaccard similarity of their TF-IDF shingles is `similarity` or
    more; a class is a connected component, class_id its smallest doc_id (null last), whose row is kept.

    1. Document frequencies over all texts, in a sketch of fixed size; 2. a signature per text, and a
    bucket per band; 3. equal texts become one representative, with as many rows as they are; 4. within a
    bucket of m representatives, pairs are compared hub by hub: first those with about 2 of the m members,
    then with 16, 128 and so on, in the order of a hash, until all are done. Members that are already in one
    class are not compared again, so a large group of near copies costs a few comparisons per member, yet no
    pair of different classes in a bucket is left out. Pairs are skipped only if a bound rules the similarity
    out: two texts of a large bucket share no more than what either shares with any other text of the large buckets
    still open, bin by bin of the shingles' hashes, so that what one lacks and the other has adds up. In buckets of up
    to LARGE_BUCKET members this bound is not used.

    Texts without words (null, empty, blank) are all alike as texts go: equal ones are copies, others link
    to none. Very long texts are compared whole; a task takes such a text by itself. Equal texts are told by sha256. Repeated rows are
    copies; which of several rows of the smallest doc_id stays is decided by their place. Empty tables give no
    rows. Other columns than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    others = [c for c in docs.columns if whole and c not in ("doc_id", "text")]
    carried = F.struct(F.col("text").isNull().alias("no_text"), *others).alias("carried")
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"), carried)
    held = spark.sparkContext.broadcast(frequencies(docs))

    def sign(batches):
        df = held.value
        for b in batches:
            for row, data, at in text_slices(b.column(1)):
                items, counts, starts = shingles(data, at)
                w = df.weights(items, counts)
                n = len(at) - 1
                sums = np.bincount(np.repeat(np.arange(n), np.diff(starts)), w, n).astype(np.float64)  # whole numbers if there are no items
                bands = sampler().bands(items, w, starts).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands))
                yield pa.RecordBatch.from_arrays([*(c[row : row + n] for c in b.columns), pa.array(sums), lists], names=names)

    keyed = plain.withColumn("key", F.unhex(F.sha2("text", 256))).select("doc_id", "text", "rid", "key", "carried")
    schema = StructType([*keyed.schema, StructField("weight", DoubleType()), StructField("bands", ArrayType(LongType()))])
    names = schema.names
    rows = materialize(keyed.mapInArrow(sign, schema), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    groups = materialize(rows.groupBy("key").agg(first, F.count("*").alias("n")).select("key", "first", F.col("first.rid").alias("rep"), "n"), "texts")

    component = _link(rows, groups, held, similarity)
    groups = groups.join(component, F.col("rep") == F.col("node"), "left").withColumn("class", F.coalesce("component", "rep")).select("key", "first", "n", "class")
    classes = groups.groupBy("class").agg(F.min("first").alias("best"), F.sum("n").alias("class_size"))
    named = groups.select("key", "class").join(classes, "class").select("key", F.col("best.doc_id").alias("class_id"), F.col("best.rid").alias("best_rid"), "class_size")
    told = rows.select("doc_id", "rid", "key", *(["text", "carried"] if whole else [])).join(named, "key")
    out = told.select("doc_id", "rid", "class_id", "class_size", (F.col("rid") == F.col("best_rid")).alias("kept"), *(["text", "carried"] if whole else []))
    if not whole:
        return out
    own = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("carried.no_text"), F.col("text"))}
    return out.select("doc_id", "rid", "class_id", "class_size", "kept", F.struct(*[own.get(c, F.col("carried")[c]).alias(c) for c in docs.columns]).alias("row"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each class, as the table held them that was numbered and compared: docs are not read a second time."""
    return near_dedup(docs, similarity, whole=True).where("kept").select("row.*")


def _link(rows: DataFrame, groups: DataFrame, held, similarity: float) -> DataFrame:
    """(node, component) of representatives that are linked to another."""
    reps = rows.where("weight > 0").select("rid", "weight", "bands").join(groups.select("rep"), F.col("rid") == F.col("rep"))
    bucketed = materialize(reps.select(F.col("rid").alias("node"), "weight", F.explode("bands").alias("bucket")), "bands")
    shared = bucketed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    u = F.pmod(F.xxhash64("node", F.lit(23)), F.lit(1 << 40)) / float(1 << 40)
    members = materialize(bucketed.join(shared, "bucket").select("bucket", "m", "node", "weight", u.alias("u")), "members")
    nodes = materialize(members.select("node").distinct(), "nodes")
    texts = materialize(_screened(rows, nodes).join(nodes, F.col("rid") == F.col("node"), "left_semi"), "rep-texts")
    component = rows.sparkSession.createDataFrame([], "node long, component long")

    def verify(batches):
        df, seen, held_bytes = held.value, OrderedDict(), 0

        def bag(node: int, packed: bytes):
            nonlocal held_bytes
            if node not in seen:
                data = np.frombuffer(zlib.decompress(packed), np.uint8)
                items, counts, _ = shingles(data, np.array([0, len(data)]))
                seen[node] = (items, df.weights(items, counts))
                held_bytes += 16 * len(items)
                while held_bytes > _CACHE_BYTES and len(seen) > 2:
                    held_bytes -= 16 * len(seen.popitem(last=False)[1][0])
            seen.move_to_end(node)
            return seen[node]

        for b in batches:
            yes = [(x, y) for x, y, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if weighted_jaccard(bag(x, s), bag(y, t)) >= similarity]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in yes], pa.int64()), pa.array([y for _, y in yes], pa.int64())], names=["a", "b"])

    names_of_bins = [f"bin{i}" for i in range(BINS)]  # columns, which compile to plain arithmetic

    def shared_weights(now: DataFrame) -> DataFrame:
        """(node, bin0, bin1, ...) for the members of large open buckets: the weight of their shingles that another of these texts has, too, by bins of the shingles' hashes."""
        some = now.where(F.col("m") > LARGE_BUCKET).select("node").distinct()
        bags = materialize(texts.join(some, F.col("rid") == F.col("node"), "left_semi").select("rid", "text").mapInArrow(explode, "node long, item long, w double"), "bags")
        common = bags.groupBy("item").agg(F.count("*").alias("n")).where("n > 1").select("item")
        found = bags.join(common, "item").groupBy("node", F.pmod("item", F.lit(BINS)).cast("int").alias("bin")).agg(F.sum("w").alias("w"))
        found = found.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("bin", "w"))).alias("by"))
        bins = [F.coalesce(F.element_at("by", F.lit(i)), F.lit(0.0)).alias(b) for i, b in enumerate(names_of_bins)]
        return materialize(some.join(found, "node", "left").select("node", *bins), "shared")

    def explode(batches):
        df = held.value
        for b in batches:
            for row, data, at in text_slices(pa.array([zlib.decompress(x) for x in b.column(1).to_pylist()]).cast(pa.large_string())):
                items, counts, starts = shingles(data, at)
                nodes = np.repeat(b.column(0)[row : row + len(at) - 1].to_numpy(), np.diff(starts))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(items.view(np.int64)), pa.array(df.weights(items, counts))], names=["node", "item", "w"])

    least = similarity - 1e-9
    most = members.agg(F.max("m")).first()[0] or 0
    unbound = {b: F.lit(_UNBOUND) for b in names_of_bins}
    members = members.withColumns(unbound)
    add = lambda columns: functools.reduce(lambda x, y: x + y, columns)
    low, high = 0, 2
    while most and low < most:
        now = members.join(component, "node", "left").select("bucket", "m", "node", "weight", *names_of_bins, "u", F.coalesce("component", "node").alias("class"))
        now = materialize(now, "now")
        open_ = now.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("bucket")
        now = materialize(now.join(open_, "bucket"), "open")
        if now.isEmpty():
            break
        if low == 2:  # the first hubs have joined what they could
            # counts are over members of large buckets alone, so they bound nothing in the smaller buckets of the same texts
            large = {b: F.when(F.col("m") > LARGE_BUCKET, F.col(b)).otherwise(_UNBOUND) for b in names_of_bins}
            now = now.drop(*names_of_bins).join(shared_weights(now), "node", "left").withColumns(large)
            # a text that shares less than this with all others of large buckets together has no near copy left to find there
            now = materialize(now.where(add(map(F.col, names_of_bins)) >= least * F.col("weight")), "open")
            members = now.drop("class")
        hubs = now.where((F.col("u") * F.col("m") >= low) & (F.col("u") * F.col("m") < high)).select("bucket", *[F.col(c).alias(f"hub_{c}") for c in ("node", "weight", *names_of_bins, "u", "class")])
        could = lambda overlap: overlap >= least * (F.col("weight") + F.col("hub_weight") - overlap)
        counted = could(add(F.least(b, f"hub_{b}") for b in names_of_bins))
        near = (F.col("class") != F.col("hub_class")) & (F.col("u") > F.col("hub_u")) & could(F.least("weight", "hub_weight")) & counted
        pairs = now.join(hubs, (now["bucket"] == hubs["bucket"]) & near).select(F.col("hub_node").alias("x"), F.col("node").alias("y")).distinct()
        pairs = materialize(pairs, "pairs")
        one = pairs.join(texts.select(F.col("rid").alias("x"), F.col("text").alias("text_x")), "x")
        two = one.join(texts.select(F.col("rid").alias("y"), F.col("text").alias("text_y")), "y").select("x", "y", "text_x", "text_y")
        found = materialize(two.mapInArrow(verify, "a long, b long"), "links")
        if not found.isEmpty():
            component = materialize(_joined(component, found), "classes")
        low, high = high, high * 8
    return component


def _screened(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rid, text) of rows whose rid may be among the nodes, by a Bloom filter of 2^_SCREEN_BITS bits, whatever the number of nodes: so texts
    that no bucket pairs with another are not shuffled. What passes by chance is left to the join. Texts are
    compressed, as they go through several shuffles."""
    spots = lambda c: [F.shiftrightunsigned(F.xxhash64(c, F.lit(seed)), 64 - _SCREEN_BITS) for seed in (3, 5)]
    words = nodes.select(F.explode(F.array(*spots("node"))).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (_SCREEN_BITS - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast(table)

    def pick(batches):
        for b in batches:
            hit = np.ones(b.num_rows, bool)
            for spot in (b.column(2).to_numpy(), b.column(3).to_numpy()):
                hit &= (held.value[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            some = b.select([0, 1]).filter(pa.array(hit))
            packed = [zlib.compress(x, 1) for x in some.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(packed, pa.binary())], names=["rid", "text"])

    return rows.select("rid", "text", *spots("rid")).mapInArrow(pick, "rid long, text binary")


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (a, b): components of the graph whose nodes are the classes so far, so old links aren't gone through again."""
    of = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"class_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    classes = connected_components(between)
    moved = classes.select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = component.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return known.unionByName(classes.join(component.select("node"), "node", "left_anti"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents."""
    return near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("rid")
