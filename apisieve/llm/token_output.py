"""Token ids of documents in ORC: run-length encoded stripes with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, scratch_path, text_bytes, tune

#: Input bytes (as stored) of one output file, bytes of a stripe as the writer counts them, and rows of an entry of the row index.
FILE_BYTES, STRIPE_BYTES, STRIDE = 24 << 20, 8 << 20, 2000
#: Words whose ids a Python worker remembers; beyond, it starts over.
CACHE_WORDS = 900_000

_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: What the tokenizer file's own pattern cuts, for lower-case Latin-1 text.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Text with any of these goes through the tokenizers library whole: other alphabets, control signs, and the brackets of special tokens.
_OTHER = re.compile(r"[^\x09-\x0d\x20-\x7e\xa0-\xff]|<\|")


#: The normalizer and pre-tokenizer that the above is made for, as the tokenizer's JSON states them (fixed values).
_CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def cuts_words(tokenizer_json: str) -> bool:
    """Whether the tokenizer cuts text as WordEncoder does: the same normalizer and pre-tokenizer, nothing after, special tokens in <| only, and no dropout."""
    made = json.loads(tokenizer_json)
    special = all(t["content"].startswith("<|") for t in made.get("added_tokens") or [])
    return special and made["model"].get("type") == "BPE" and not made["model"].get("dropout") and all(made.get(k) == v for k, v in _CUTS.items())


class WordEncoder(dict):
    """Ids of texts under any tokenizer; under one that cuts lower-case words before byte-pair encoding, word by word.

    There, encoding a word apart from its neighbours gives the same ids as within the text, so each distinct word
    is encoded once by the library's model and remembered: the texts repeat most of their words. Under
    other tokenizers the library encodes whole texts.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model, self.by_words = self.tokenizer.model, cuts_words(tokenizer_json)
        shown = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._reset()

    def _reset(self):
        self.clear()
        self.flat, self.ends = array("I"), array("q", [0])

    def __missing__(self, word: str) -> int:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        self.flat.extend([t.id for t in self.model.tokenize(mapped)])
        self.ends.append(len(self.flat))
        self[word] = n = len(self.ends) - 2
        return n

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words or _OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self) > CACHE_WORDS:
            self._reset()
        pieces = _PIECES.findall(text.lower())
        if not pieces:
            return np.zeros(0, np.uint32)
        at = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        flat, ends = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.int64)
        starts = ends[at]
        sizes = ends[at + 1] - starts
        total = np.cumsum(sizes)
        return flat[np.repeat(starts - total + sizes, sizes) + np.arange(total[-1])]


_ENCODERS: dict[int, WordEncoder] = {}


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, files: int | None = None, stripe_bytes: int = STRIPE_BYTES, stride: int = STRIDE) -> None:
    """Encode docs (doc_id, text) and write ORC files to path, in ascending doc_id order (null last) over the files' part numbers.

    Columns: part (the file's number), local_start (ids before the row in its file), doc_id, ids (with the
    end id). Rows are dealt by ranges of doc_id and, within one doc_id, of the text's hash, so repeated ids
    do not land in one task. ids are written as ORC integers (run-length encoded); a file has stripes of some stripe_bytes,
    which are read in parallel, a row index entry holds `stride` rows, and doc_id has a Bloom filter per entry.

    Null and empty texts have the end id alone. Very long texts are encoded whole, one row each. An empty table makes files
    without rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    n = files or max(2, -(-text_bytes(docs) // FILE_BYTES))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches):
        key = hash(held.value)
        coder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, WordEncoder(held.value))
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [np.append(coder.encode(t), np.uint32(end_id)) for t in b.column(1).to_pylist()]
            if not ids:
                continue
            sizes = np.array([len(x) for x in ids], np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(done + ends - sizes), b.column(0), lists], names=["part", "local_start", "doc_id", "ids"])
            done += int(ends[-1])

    schema = "part int, local_start long, doc_id long, ids array<int>"
    writer = rows.mapInArrow(encode, schema).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer.option("orc.row.index.stride", str(stride)).option("orc.create.index", "true").option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids, only theirs: stripes and row groups that statistics or Bloom filters rule out are not read. Stripes are read in parallel."""
    rows = spark.read.schema("part int, local_start long, doc_id long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def describe_tokens(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (over 32-bit little-endian ids) of rows that read_tokens gave."""
    tune(rows.sparkSession)

    def digest(batches):
        for b in batches:
            lists = b.column(3)
            at, ids = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(), np.dtype("<u4")).tobytes())
            crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "local_start", "doc_id", "n_tokens", "ids_crc32"])

    slim = materialize(rows.mapInArrow(digest, "part int, local_start long, doc_id long, n_tokens long, ids_crc32 long"), "ids")
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = slim.groupBy(F.col("part").alias("at")).agg(F.sum("n_tokens").alias("n")).select("at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return slim.join(parts, F.col("part") == F.col("at")).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents' ids through ORC files and back.

    Null texts are empty and have the end id alone; repeated doc_ids follow one another by their texts'
    hashes; very long texts are encoded whole; an empty table makes no rows; other columns are ignored.
    """
    import public_tokenizers

    path = scratch_path(spark, "orc")
    write_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), path)
    return describe_tokens(read_tokens(spark, path))
