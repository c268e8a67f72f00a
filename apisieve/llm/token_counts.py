"""Token counts as rollups that signed deltas maintain, with idempotent batch commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, scratch_path

KEYS = ("source", "lang", "tokenizer_version")
TOTALS_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: The versions that the query counts with: white-space words, and runs of letters or digits with every other sign by itself.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"}


def count_tokens(text, version: str):
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])).cast("long"), F.lit(0).cast("long"))


def inserts(rows: DataFrame) -> DataFrame:
    """Signed deltas that add rows (source, lang, tokenizer_version, n_tokens)."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").cast("long").alias("d_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Signed deltas that take rows back, with the counts that were inserted."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).cast("long").alias("d_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed deltas that put new counts in the old ones' place."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version in a folder of any Hadoop file system.

    A commit writes a whole new version of the totals to a folder of its own, w=<unique>/totals, and its batch id to w=<unique>/batch, and then
    creates the file DONE-N, whose text names that folder, without overwriting. That publishes version N: of two
    committers at once one creates it, and the other starts over from what the first has published. Folders that
    no DONE names are not read. Batch ids of all versions together are those that were applied; one among them
    changes nothing, so deliveries may be repeated. Totals add up, so a commit reads the last totals and the batch, not the documents.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _published(self) -> dict[int, str]:
        """Versions and the folders that hold them."""
        if not self._fs.exists(self._path(self.folder)):
            return {}
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))]
        return {int(n[5:]): self._text(f"{self.folder}/{n}") for n in names if n.startswith("DONE-")}

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        """Create the file; fails if it is there."""
        stream = self._fs.create(self._path(path), False)
        try:
            stream.writeUTF(text)
        finally:
            stream.close()

    def version(self) -> int:
        """The last published version, 0 before any."""
        return max(self._published(), default=0)

    def totals(self, version: int | None = None) -> DataFrame:
        done = self._published()
        v = max(done, default=0) if version is None else version
        return self.spark.read.schema(TOTALS_SCHEMA).parquet(f"{self.folder}/{done[v]}/totals") if v else self.spark.createDataFrame([], TOTALS_SCHEMA)

    def batches(self) -> list[str]:
        """Ids of all batches applied, in their order."""
        return [self._text(f"{self.folder}/{where}/batch") for _, where in sorted(self._published().items())]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Apply a batch of signed deltas; False if it was applied before.

        Deltas are summed per task before the shuffle, so a hot source is one row per task. Keys may be
        null, each null a key of its own. Repeated rows count each. Groups whose totals come to nothing are dropped. An
        empty batch makes a version with the same totals. Other columns than the keys, d_docs and d_tokens are ignored.
        """
        while True:
            if batch_id in self.batches():
                return False
            v = self.version()
            where = self.prepare(batch_id, deltas, v)
            if self.publish(where, v + 1):
                return True

    def prepare(self, batch_id: str, deltas: DataFrame, version: int) -> str:
        """Write what the batch makes of a version's totals to a new folder, whose name it returns."""
        old = self.totals(version).select(*KEYS, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        new = old.unionByName(deltas.select(*KEYS, "d_docs", "d_tokens")).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        where = f"w={uuid.uuid4().hex}"
        new.where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.folder}/{where}/totals")
        self._write(f"{self.folder}/{where}/batch", batch_id)
        return where

    def publish(self, where: str, version: int) -> bool:
        """Make the folder that version, unless another has."""
        if version in self._published():
            return False
        try:
            self._write(f"{self.folder}/DONE-{version}", where)
        except Exception:  # the file system's error for a file that is there, whatever its name
            if version in self._published():
                return False
            raise
        return True


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals after four deliveries over all documents: all inserted with words-1; those not in English
    revised to words-2; that batch once more; texts of under 20 words deleted.

    Null and empty texts count no tokens, so they are among the deleted. Null sources and languages are keys of their
    own. Very long texts are counted whole, repeated rows each. An empty table gives no rows. Other columns are ignored.
    """
    docs = read(spark, sf_dir, "documents")
    counts = materialize(docs.select("source", "lang", *[count_tokens(F.col("text"), v).alias(v) for v in TOKENIZERS]), "counts")
    of = lambda rows, v: rows.select("source", "lang", F.lit(v).alias("tokenizer_version"), F.col(v).alias("n_tokens"))
    foreign, short = ~F.col("lang").eqNullSafe("en"), F.col("words-1") < 20
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("load", inserts(of(counts, "words-1")))
    for _ in range(2):
        rollup.commit("revise", revisions(of(counts.where(foreign), "words-1"), of(counts.where(foreign), "words-2")))
    rollup.commit("purge", deletes(of(counts.where(short & ~foreign), "words-1").unionByName(of(counts.where(short & foreign), "words-2"))))
    return rollup.totals()


ORACLE_SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS w1,
         coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')), 0) AS w2
  FROM documents)
SELECT source, lang, CASE WHEN lang IS DISTINCT FROM 'en' THEN 'words-2' ELSE 'words-1' END AS tokenizer_version,
       count(*)::BIGINT AS n_docs, sum(CASE WHEN lang IS DISTINCT FROM 'en' THEN w2 ELSE w1 END)::BIGINT AS n_tokens
FROM d WHERE w1 >= 20 GROUP BY 1, 2, 3
"""
