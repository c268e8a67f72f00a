"""Quality classifier: supervised subword embeddings, trained and applied in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, text_slices, tune, word_hashes

#: Labelled documents that training takes at most, in the order of a hash of doc_id, and the bytes of their whole texts, which come to the driver.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 48 << 20
BUCKET_BITS, DIM, EPOCHS, RATE = 17, 16, 6, 1.0
THRESHOLD = 0.3
_BUCKETS = 1 << BUCKET_BITS
#: Features that stand for a word which repeats the one before it, or another before that in the last 8.
_AGAIN, _NEAR = 1, 2


def features(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature ids (hashed words, repetitions, character 3- and 4-grams within words) and the text that each belongs to, kind by kind and ascending by text, for texts data[at[i]:at[i + 1]] in UTF-8."""
    words, first = word_hashes(data, at, lower=False)
    of_word = np.repeat(np.arange(len(at) - 1), np.diff(first))
    out = [((words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), of_word)]
    for back in (1, 1, 1, 1, *range(2, 9)):  # the word just before counts four times
        same = np.flatnonzero((words[back:] == words[:-back]) & (of_word[back:] == of_word[:-back])) + back
        out.append((np.full(len(same), _AGAIN if back == 1 else _NEAR, np.int64), of_word[same]))
    lead = (data & 0xC0) != 0x80
    ends = np.concatenate([[0], np.cumsum(lead)])[at]
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    of_char = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(ends))
    blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
    chars = np.where(blank, np.uint32(32), chars)
    with np.errstate(over="ignore"):
        for n in (3, 4):
            if len(chars) < n:
                continue
            k = len(chars) - n + 1
            h = np.zeros(k, np.uint32)
            ok = of_char[:k] == of_char[n - 1 :]
            for j in range(n):
                h = (h ^ chars[j : j + k]) * np.uint32(0x9E3779B1 + 2 * n)
                h ^= h >> np.uint32(15)
                if 0 < j < n - 1:
                    ok &= ~blank[j : j + k]
            h *= np.uint32(0x85EBCA77)
            out.append(((h[ok] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), of_char[:k][ok]))
    return out


class Subwords:
    """Embeddings of hashed features, averaged per document, and a softmax over two classes."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (_BUCKETS, DIM)).astype(np.float32)
        self.out = np.zeros((2, DIM), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Subwords:
        """Stochastic gradient descent, a document at a time, with a rate that falls to zero. bags: feature ids and their shares of the document."""
        rng, steps, done = np.random.default_rng(seed), epochs * max(1, len(bags)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                rate, done = np.float32(RATE * (1 - done / steps)), done + 1
                ids, share = bags[i]
                held = self.vectors[ids]
                mean = share @ held
                z = self.out @ mean + self.bias
                p = np.exp(z - z.max())
                g = -p / p.sum()
                g[labels[i]] += 1
                back = g @ self.out
                self.out += rate * np.outer(g, mean)
                self.bias += rate * np.float32(0.1) * g
                # all features of a document move together; their mean moves by the rate, as sum(share) = 1
                self.vectors[ids] = held + (rate * np.sqrt(share))[:, None] * back
        return self

    def margins(self) -> tuple[np.ndarray, float]:
        """Each feature's part in the margin of class 1; a document's margin is their mean plus the bias."""
        return (self.vectors @ (self.out[1] - self.out[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    ids, counts = np.unique(np.concatenate([x for x, _ in features(data, np.array([0, len(data)]))]), return_counts=True)
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


def score_column(column, weights: np.ndarray, bias: float) -> np.ndarray:
    """P(label 1) of each text of an Arrow column."""
    out = np.empty(len(column))
    for row, data, at in text_slices(column):
        total, n = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        for ids, of in features(data, at):
            if len(ids):  # each text's features are one run, so its sum doesn't depend on its neighbours
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                total[of[starts]] += np.add.reduceat(weights[ids].astype(np.float64), starts)
                n += np.bincount(of, minlength=len(n))
        out[row : row + len(n)] = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))
    return out


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> list:
    """(doc_id, text, quality) of at most `most` labelled documents and `most_bytes` of text, in the order of doc_id's hash.

    Null labels and unlabelled texts take no part, and of a doc_id's several labels the highest counts. Of several rows
    of one doc_id one is taken, that of the least hash, so repeated ids bring no more to the driver. A text that would pass the
    bound of bytes ends the sample.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    texts = texts.withColumn("h", F.xxhash64("text")).withColumn("size", F.octet_length("text"))
    one = texts.groupBy("doc_id").agg(F.min(F.struct("h", "size")).alias("one"))
    sizes, ids = 0, []
    for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "one.h", "one.size").collect():  # `most` rows at most
        sizes += r.size
        if sizes > most_bytes:
            break
        ids.append((r.doc_id, r.h))
    if not ids:
        return []
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long, h long")
    rows = texts.join(F.broadcast(picked), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "quality").collect()
    return sorted(rows, key=lambda r: r.doc_id)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> Subwords:
    """A model from the sample of labelled documents."""
    rows = sample(docs, labels, most)
    return Subwords().fit([bag(r.text) for r in rows], np.array([int(r.quality > 0) for r in rows], np.int64))


def score(docs: DataFrame, model: Subwords, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, then score: the probability of label 1 by the text alone. Null and empty texts get the bias's."""
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model.margins())

    def apply(batches):
        weights, bias = held.value
        for b in batches:
            scores = pa.array(score_column(b.column(b.num_columns - 1), weights, bias), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], names=[*keep, "score"])

    frame = docs.select(*keep, F.col("text").alias("__text"))
    schema = docs.select(*keep).schema.add("score", "double")
    return frame.mapInArrow(apply, schema)


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Scores for all documents by a model of the labels' training rows (those not held out).

    Without usable labels every score is 0.5. Null and empty texts get the score of no evidence, very long ones are scored
    whole. Repeated rows, ties and extra columns have no effect on a row's score. An empty table gives no rows.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model, ["doc_id"] if keep is None else keep)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = quality(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
