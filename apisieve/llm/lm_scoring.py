"""LM scoring: prediction by partial matching over bytes, and a unigram base score over words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, read, text_slices, tune, word_hashes

#: Contexts of the trie are this many bytes long at most.
ORDER = 3
#: Words and leaves (contexts of ORDER bytes and the byte after) whose counts are broadcast, the commonest, 16 bytes each; the others' counts are joined.
HEAD_WORDS, HEAD_LEAVES = 1 << 19, 1 << 21
#: What stands before a text and for its end: bytes that UTF-8 never has.
PAD, STOP = 0xFE, 0xFF
#: The end of a text as a token.
END = int(mix64(np.array([0xE0F], np.uint64))[0])
#: Words that a task counts together before it passes the counts on.
_TOGETHER = 1_500_000


# ---------------------------------------------------------------- PPM


class PPMTrie:
    """The plain trie: counts of next bytes by context, updated a byte at a time. For adaptive code lengths, and to test PPMTable by."""

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, {}

    def _codes(self, text: str) -> bytes:
        return bytes([PAD]) * self.order + text.encode("utf-8", "surrogatepass") + bytes([STOP])

    def probability(self, context: bytes, symbol: int) -> float:
        """Method C escapes; symbols that a longer context has seen are excluded from the shorter ones."""
        p, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            node = self.nodes.get(context[len(context) - k :])
            left = {s: c for s, c in node.items() if s not in gone} if node else {}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return p * left[symbol] / total
            p *= len(left) / total
            gone |= left.keys()
        return p / (256 - len(gone))

    def add(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            node = self.nodes.setdefault(context[len(context) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def learn(self, text: str) -> None:
        data = self._codes(text)
        for i in range(self.order, len(data)):
            self.add(data[i - self.order : i], data[i])

    def log10(self, text: str, adapt: bool = False) -> float:
        """The log10 probability of the text and its end; with adapt, the trie learns each byte after it is coded."""
        data, total = self._codes(text), 0.0
        for i in range(self.order, len(data)):
            context = data[i - self.order : i]
            total += math.log10(self.probability(context, data[i]))
            if adapt:
                self.add(context, data[i])
        return total


def _ascending(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    return keys[order].astype(np.uint32), *(v[order].astype(np.float64) for v in values)


def gram_codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of texts data[at[i]:at[i + 1]] and each end (STOP): the three bytes before it (PAD before the text) and itself as one number, and its text's index."""
    sizes = np.diff(at)
    of = np.repeat(np.arange(len(sizes)), sizes)
    wide = np.full(len(data) + 4 * len(sizes), PAD, np.uint32)
    wide[np.arange(len(data)) + 4 * of + 3] = data
    wide[at[1:] + 4 * np.arange(len(sizes)) + 3] = STOP
    codes = wide[3:] | wide[2:-1] << 8 | wide[1:-2] << 16 | wide[:-3] << 24
    # the text i has its codes at at[i] + 4 i .. at[i + 1] + 4 i, its end's among them
    of_code = np.repeat(np.arange(len(sizes)), sizes + 1)
    return codes[np.arange(len(data) + len(sizes)) + 3 * of_code], of_code


class PPMTable:
    """The trie of order 3 as sorted arrays: the same probabilities as PPMTrie's, by whole arrays.

    It has every context (3-byte ones: their number of symbols d, total n, and what the context one byte
    shorter counts for the same symbols, seen) and every count of 3-byte codes, each 2^24 at most. Of the leaves,
    4-byte codes, it may hold a part only: `unsure` tells for which codes the leaf has to be looked up elsewhere.
    """

    def __init__(self, contexts: tuple[np.ndarray, ...], low: tuple[np.ndarray, np.ndarray], leaves: tuple[np.ndarray, np.ndarray]):
        context, d, n, seen = _ascending(*contexts)
        levels = [_ascending(*low)]
        for mask in (0xFFFF, 0xFF):
            at, where = np.unique(levels[-1][0] & np.uint32(mask), return_inverse=True)
            levels.append((at, np.bincount(where, levels[-1][1], len(at))))
        self.code2, self.code1, self.code0 = (x for x, _ in levels)
        self.log2, self.log1, self.log0 = (np.log10(c) for _, c in levels)
        # by context: its symbols' number d and total n, then what it leaves of them at the next shorter context
        tables = [(context, d, n, seen)]
        for k, (x, c) in enumerate(levels):
            ctx, where = np.unique(x >> np.uint32(8), return_inverse=True)
            d_k, n_k = np.bincount(where, minlength=len(ctx)), np.bincount(where, c, len(ctx))
            shorter = None
            if k < 2:
                low_x, low_c = levels[k + 1]
                shorter = np.bincount(where, low_c[np.searchsorted(low_x, x & np.uint32((1 << 8 * (2 - k)) - 1))], len(ctx))
            tables.append((ctx, d_k, n_k, shorter))
        own, rest = [], []
        for k, (ctx, d_k, n_k, shorter) in enumerate(tables):
            own.append((np.log10(n_k + d_k), np.log10(d_k / (n_k + d_k))))
            if k < 3:
                low_context, low_d, low_n, _ = tables[k + 1]
                j = np.searchsorted(low_context, ctx & np.uint32((1 << max(0, 8 * (2 - k))) - 1))
                left_d, left_n = low_d[j] - d_k, low_n[j] - shorter
                with np.errstate(divide="ignore", invalid="ignore"):
                    rest.append((np.log10(left_n + left_d), np.where(left_d > 0, np.log10(left_d / (left_n + left_d)), 0.0)))
        self.context = [t[0] for t in tables]
        self.own, self.rest = own, rest
        self.code, count = _ascending(*leaves)
        above = np.searchsorted(context, self.code >> np.uint32(8))
        self.logp = np.log10(count) - own[0][0][above] if len(self.code) else np.zeros(0)
        self.partly = np.bincount(above, minlength=len(context)) < d  # contexts of which it lacks leaves
        self.last = math.log10(256 - len(self.code0)) if len(self.code0) < 256 else 0.0

    @classmethod
    def of_counts(cls, codes: np.ndarray, counts: np.ndarray) -> PPMTable:
        """The table of all leaves."""
        low, where = np.unique(codes & np.uint32(0xFFFFFF), return_inverse=True)
        low_count = np.bincount(where, counts, len(low))
        context, of = np.unique(codes >> np.uint32(8), return_inverse=True)
        d, n, seen = (np.bincount(of, x, len(context)) for x in (None, counts, low_count[where]))
        return cls((context, d, n, seen), (low, low_count), (codes, counts))

    def unsure(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the codes are whose leaf isn't held though their context has such leaves, and log10 of these contexts' n + d."""
        _, hit = self._find(self.code, codes)
        at, known = self._find(self.context[0], codes >> np.uint32(8))
        some = np.flatnonzero(~hit & known)
        some = some[self.partly[at[some]]]
        return some, self.own[0][0][at[some]]

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """The log10 probability of each code's last byte after the bytes before it."""
        at, hit = self._find(self.code, codes)
        out = np.zeros(len(codes))
        out[hit] = self.logp[at[hit]]
        todo = np.flatnonzero(~hit)
        if len(todo):
            out[todo] = self._shorter(codes[todo])
        return out

    def _shorter(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        above, above_seen = self._find(self.context[0], x >> np.uint32(8))
        total += np.where(above_seen, self.own[0][1][above] if len(self.own[0][1]) else 0.0, 0.0)
        open_ = np.ones(len(x), bool)
        for k, (keys, logs) in enumerate(((self.code2, self.log2), (self.code1, self.log1), (self.code0, self.log0)), 1):
            mask = np.uint32((1 << 8 * (4 - k)) - 1)
            at, hit = self._find(keys, x & mask)
            here, seen = self._find(self.context[k], (x & mask) >> np.uint32(8))
            if len(keys):
                size = np.where(above_seen, self.rest[k - 1][0][above] if len(self.rest[k - 1][0]) else 0.0, self.own[k][0][here])
                escape = np.where(above_seen, self.rest[k - 1][1][above] if len(self.rest[k - 1][1]) else 0.0, self.own[k][1][here])
                take = open_ & hit & seen
                total[take] += (logs[at] - size)[take]
                go = open_ & ~hit & seen
                total[go] += escape[go]
                open_ &= ~hit
            above, above_seen = here, seen
        total[open_] -= self.last
        return total


# ---------------------------------------------------------------- Spark


def _counts(docs: DataFrame) -> DataFrame:
    """Counts over the training texts: kind 0 words by hash, kind 1 codes of four bytes."""

    def count(batches):
        words, codes, n = [], [], 0
        for b in batches:
            for _, data, at in text_slices(b.column(0)):
                w, _ = word_hashes(data, at)
                words += [w, np.full(len(at) - 1, END, np.uint64)]
                codes.append(np.unique(gram_codes(data, at)[0], return_counts=True))
                n += len(w) + len(at)
                if n > _TOGETHER:
                    yield from tell(words, codes)
                    words, codes, n = [], [], 0
        yield from tell(words, codes)

    def tell(words, codes):
        if words:
            w, n = np.unique(np.concatenate(words), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(w), np.int8)), pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "item", "n"])
            c, where = np.unique(np.concatenate([x for x, _ in codes]), return_inverse=True)
            n = np.bincount(where, np.concatenate([x for _, x in codes]), len(c)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(c), np.int8)), pa.array(c.astype(np.int64)), pa.array(n)], names=["kind", "item", "n"])

    return docs.select("text").mapInArrow(count, "kind tinyint, item long, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def _at_least(rows: DataFrame, most: int) -> int:
    """The least count from which on `rows` (item, n) are at most `most`, in steps of an eighth of a power of two."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    floor, total = 1, 0
    for r in sorted(rows.groupBy(step.alias("s")).agg(F.count("*").alias("m"), F.min("n").alias("n")).collect(), reverse=True):  # some 500 rows at most
        total += r.m
        if total > most:
            return floor if floor > 1 else r.n + 1
        floor = r.n
    return 1


def _arrays(rows: DataFrame) -> tuple[np.ndarray, ...]:
    return tuple(c.to_numpy() for c in rows.toArrow().columns)


def lm_score(docs: DataFrame, training, head_words: int = HEAD_WORDS, head_leaves: int = HEAD_LEAVES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Training rows (by the condition `training`) are counted in one pass: words with their ends, and byte
    contexts of up to ORDER bytes. score is the trie's log10 probability of the text's UTF-8 bytes and end, with
    escapes of method C and symbol exclusion. base_score sums log10((c + 1) / (N + V + 1)). Broadcast are the
    trie's contexts, which three bytes bound, and the commonest head_words words and head_leaves leaves; the
    counts of all others are joined, from words or distinct leaves of a text to their count, so that every count
    learnt has its effect at every size and no key of these joins is hot. Words are told apart by 64-bit hashes.

    Null text is empty: its end is its only token. Repeated rows are scored each; equal texts have equal scores. Very
    long texts are scored whole. No training rows: N = V = 0, base_score 0, and every byte has probability 1/256. No
    rows give none. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", training.alias("training"), F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(_counts(rows.where("training")), "counts")
    words = counts.where("kind = 0").select("item", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    leaves = counts.where("kind = 1").select(F.col("item").alias("code"), "n")
    low_of = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFF))
    low = materialize(leaves.groupBy(low_of("code").alias("low")).agg(F.sum("n").alias("n")), "low")
    contexts = leaves.join(low.withColumnRenamed("n", "low_n"), low_of("code") == F.col("low")).groupBy(F.shiftright("code", 8).alias("context"))
    contexts = _arrays(contexts.agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.sum("low_n").alias("seen")))
    least, least_leaf = _at_least(words, head_words), _at_least(leaves, head_leaves)
    hashes, n_head = _arrays(words.where(F.col("n") >= least))
    order = np.argsort(hashes := hashes.view(np.uint64))
    table = PPMTable(contexts, _arrays(low), _arrays(leaves.where(F.col("n") >= least_leaf)))
    held = spark.sparkContext.broadcast((table, hashes[order], np.log10(n_head[order] + 1.0)))

    def apply(batches):
        ppm, known, logs = held.value
        for b in batches:
            for row, data, at in text_slices(b.column(2)):
                n, (w, first) = len(at) - 1, word_hashes(data, at)
                ends = np.arange(1, n + 1) + first[1:] - 1  # where each text's end goes among its words
                w, of = np.insert(w, first[1:], np.uint64(END)), np.repeat(np.arange(n), np.diff(first) + 1)
                assert (w[ends] == END).all()
                hit = np.zeros(len(w), bool)
                log_c = np.zeros(len(w))
                if len(known):
                    j = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    hit = known[j] == w
                    log_c[hit] = logs[j[hit]]
                codes, of_code = gram_codes(data, at)
                pairs, times = np.unique(of_code.astype(np.uint64) << np.uint64(32) | codes, return_counts=True)
                doc, code = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                value = ppm.log10(code)
                value[~np.isfinite(value)] = 0.0  # no escape leads there, so these leaves are learnt ones, found below
                score = np.bincount(doc, value * times, n)
                some, size = ppm.unsure(code)
                leaves_at = np.concatenate([[0], np.cumsum(np.bincount(doc[some], minlength=n))]).astype(np.int32)
                # a leaf found elsewhere, of count c, is worth log10(c) - size in place of the escape's value
                fields = [pa.array(code[some].astype(np.int64)), pa.array(times[some].astype(np.int64)), pa.array(value[some] + size)]
                unheld = pa.ListArray.from_arrays(pa.array(leaves_at), pa.StructArray.from_arrays(fields, names=["code", "times", "less"]))
                rest = np.flatnonzero(~hit)
                ends_of = np.concatenate([[0], np.cumsum(np.bincount(of[rest], minlength=n))]).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends_of), pa.array(w[rest].view(np.int64)))
                sums = [pa.array(np.diff(first) + 1), pa.array(np.bincount(of, hit, n).astype(np.int64)), pa.array(np.bincount(of, log_c, n)), pa.array(score), others, unheld]
                yield pa.RecordBatch.from_arrays([b.column(0)[row : row + n], b.column(1)[row : row + n], b.column(3)[row : row + n], *sums], names=names)

    schema = "rid long, doc_id long, training boolean, n_tokens long, n_head long, head double, score double, others array<long>, unheld array<struct<code:long,times:long,less:double>>"
    names = ["rid", "doc_id", "training", "n_tokens", "n_head", "head", "score", "others", "unheld"]
    scored = materialize(rows.select("rid", "doc_id", "text", "training").mapInArrow(apply, schema), "scored")
    tail = scored.select("rid", F.explode("others").alias("item"))
    seen = tail.join(words.where(F.col("n") < least), "item").groupBy("rid").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("tail"), F.count("*").alias("n_tail"))
    size = F.lit(math.log10(total + distinct + 1))
    more = scored.select("rid", F.explode("unheld").alias("u")).select("rid", "u.*").join(leaves.where(F.col("n") < least_leaf), "code")
    more = more.groupBy("rid").agg(F.sum(F.col("times") * (F.log10(F.col("n").cast("double")) - F.col("less"))).alias("more"))
    return scored.drop("others", "unheld").join(seen, "rid", "left").join(more, "rid", "left").select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by what the six sevenths of them teach whose crc32(doc_id) mod 7 is not 2."""
    return lm_score(read(spark, sf_dir, "documents"), F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) != 2)
