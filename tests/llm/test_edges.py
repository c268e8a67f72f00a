"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from apisieve.llm import ann, exact_dedup, lm_scoring, mixing, near_dedup, packing, quality, secret_scan, token_counts, token_output
from apisieve.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "size key bucket rid kept class_id class_size score at of n leaf h shard bin item target keep_id group_size text_sha256 incoming norm part weight spans base training word start piece cluster".split()
LONG = " ".join(f"wort{i % 977} und{i % 31}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "web", 49), (1, "the quick brown fox jumps over the lazy dog again", "en", "web", 49), (2, "the quick  brown fox jumps over the lazy dog again", "en", "web", 50),
    (3, None, None, None, None), (4, "", "de", "web", 0), (5, " \t\n ", "de", None, 4), (None, "no id here but some words to read", "fr", "books", 33), (None, None, None, None, None), (6, LONG, "de", "books", len(LONG)),
    (7, "é ß 漢字 🙂 <|endoftext|> token=abcdef123456 x", "xx", "web", 40), (8, "word", "en", "", 4),
]


def training():
    return F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))



@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, 0, 0), (4, None, 0), (None, 1, 1), (6, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


def run_tokens(docs):
    import public_tokenizers

    path = scratch_path(docs.sparkSession, "test-orc")
    token_output.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    return token_output.describe_tokens(token_output.read_tokens(docs.sparkSession, path))


def rollup(docs):
    r = token_counts.Rollup(docs.sparkSession, scratch_path(docs.sparkSession, "test-rollup"))
    n = token_counts.count_tokens(F.col("text"), "words-1")
    r.commit("a", token_counts.inserts(docs.withColumn("n_tokens", n).withColumn("tokenizer_version", F.lit("words-1"))))
    return r.totals()


def operators(labels):
    return {
        "tokens": run_tokens, "secrets": lambda d: secret_scan.secret_scan(d, secret_scan.CharCNN()), "mixing": mixing.mix, "lm": lambda d: lm_scoring.lm_score(d, training()), "quality": lambda d: quality.quality(d, labels),
        "near": near_dedup.near_dedup, "exact": exact_dedup.exact_dedup, "packing": packing.pack, "rollup": rollup,
    }


NAMES = ["tokens", "secrets", "mixing", "lm", "quality", "near", "exact", "packing", "rollup"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, name):
    assert operators(labels)[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_extra_columns(spark, docs, labels, name):
    op = operators(labels)[name]
    plain = sorted(map(repr, op(docs).drop("rid").collect()))
    crowded = docs.withColumns({c: F.lit(f"extra {c}") for c in EXTRA})
    rows = op(crowded).drop("rid").collect()
    # rows that repeat in full are told apart by their place alone, so what is kept may change places
    assert sorted(map(repr, rows)) == plain
    if name == "rollup":
        assert sum(r.n_docs for r in rows) == len(ROWS)
    elif name == "packing":
        assert sum(r.piece == 0 for r in rows) == len(ROWS)
        assert sum(r.length for r in rows) == sum(len((t or "").split()) for _, t, *_ in ROWS)
    else:
        assert len(rows) == len(ROWS)


def test_defined_results(docs, labels):
    by = lambda df: {r.doc_id: r for r in df.collect() if r.doc_id is not None}
    exact = by(exact_dedup.exact_dedup(docs))
    assert exact[1].keep_id == 2 and exact[1].group_size == 3 and exact[3].group_size == 4 and exact[2].kept and not exact[1].kept
    assert exact[5].kept and exact[3].keep_id == 5  # of texts without anything but white space the longest stays
    near = by(near_dedup.near_dedup(docs))
    assert near[1].class_id == near[2].class_id == 1 and near[8].class_id == 8 and near[5].class_size == 1
    lm = by(lm_scoring.lm_score(docs, training()))
    assert lm[3].n_tokens == 1 and lm[3].n_known == 1 and lm[3].held_out and lm[6].n_tokens == 120_001
    mixed = by(mixing.mix(docs))
    assert mixed[3].size == 0 and mixed[3].taken == 0
    scores = quality.quality(docs, labels.limit(0)).collect()
    assert {r.score for r in scores} == {0.5}
    found = by(secret_scan.secret_scan(docs, secret_scan.CharCNN()))
    assert found[7].n_assign == 1 and found[3].spans == ""


def test_one_source_and_many_equal_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "copied text of some six words").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"), F.lit("en").alias("lang"), F.lit("one").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    exact = exact_dedup.exact_dedup(rows)
    assert exact.where("kept").count() == 2001 and exact.agg(F.max("group_size")).first()[0] == 1000
    near = near_dedup.near_dedup(rows)
    assert near.where("kept").count() == 2001 and near.count() == 3000
    mixed = mixing.mix(rows).agg(F.sum("taken"), F.max("target")).first()
    assert mixed[0] == round(mixed[1]) == 1000 * 6 + 2000 * 2
    packed = packing.pack(rows.limit(200))
    assert packed.groupBy("shard", "bin", "source").count().where("count > 1").isEmpty()


def test_vectors(spark):
    rows = [(i, [float(i % 5 + 1), 1.0, -0.0]) for i in range(30)] + [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [float("nan"), 1.0, 1.0]), (104, [1.0, None, 1.0]), (105, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(df.withColumns({c: F.lit(1) for c in ("leaf", "v", "score", "rank", "block", "query_id")}), lambda i: i % 20 == 0, k=20).collect()
    assert {r.query_id for r in found} == {0, 20} and len(found) == 40
    mine = sorted((r.rank, r.vec_id) for r in found if r.query_id == 0)
    assert [v for _, v in mine[:6]] == [4, 9, 14, 19, 24, 29]  # ties to the smaller id
    few = ann.search(df.where("vec_id < 4"), lambda i: i == 0, k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
