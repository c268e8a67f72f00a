"""The pipeline's stages, each held against a plain computation on its own input."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from apisieve.llm import exact_dedup, quality, registry
from apisieve.llm.common import read
from tests.llm.test_operators import near_classes


def brute_mix(docs) -> dict[int, int]:
    """Words taken of each document: sources filled by a loop until none is over its cap, then documents in the seeded order."""
    docs = docs.assign(size=docs.text.fillna("").str.findall(r"[^\x20\x09-\x0D]+").str.len())
    sizes = docs.groupby("source", dropna=False)["size"].sum().sort_index(na_position="last")
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes.index)}
    open_, left, target = set(sizes.index), float(sizes.sum()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else weight[s] * level
            left -= target[s] if full else 0
        open_ = open_ - set(full) if full else set()
    taken = {}
    for s, rows in docs.groupby("source", dropna=False):
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest = round(target[s]) - epochs * int(sizes[s])
        for r in sorted(rows.itertuples(), key=lambda r: (hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest(), r.doc_id, r.size)):
            more = max(0, min(r.size, rest))
            taken[r.doc_id], rest = epochs * r.size + more, rest - more
    return taken


def test_stages(spark, sf_dir, tmp_path):
    docs, held = read(spark, sf_dir, "documents"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        held[name] = (docs.select(*pipeline.COLUMNS).toPandas(), spark.read.parquet(path).toPandas())
        docs = spark.read.parquet(path)
    for name, (_, out) in list(held.items())[:-1]:
        assert list(out.columns) == pipeline.COLUMNS, name

    before, after = held["quality classifier"]
    scores = quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).toPandas().set_index("doc_id").score
    assert set(after.doc_id) == set(scores.index[scores >= quality.THRESHOLD]) and len(after) < len(before)

    before, after = held["exact dedup"]
    key = before.text.fillna("").str.replace(r"[\x20\x09-\x0D]", "", regex=True)
    best = before.assign(key=key, n=-before.text.fillna("").str.len()).sort_values(["n", "doc_id"]).drop_duplicates("key")
    assert set(after.doc_id) == set(best.doc_id) and len(after) == len(best)

    before, after = held["near dedup"]
    classes, _ = near_classes(spark.createDataFrame(before[["doc_id", "text"]]))
    assert sorted(after.doc_id) == sorted(min(c) for c in classes)

    before, after = held["mixing"]
    taken = {k: v for k, v in brute_mix(before).items() if v}
    words = after.assign(n=after.text.str.findall(r"[^\x20\x09-\x0D]+").str.len()).groupby("doc_id").n.sum()
    assert words.to_dict() == taken
    assert (after.n_chars == after.text.str.len()).all()

    before, after = held["best-fit packing"]
    some = after[after["bin"] >= 0]
    assert not some.duplicated(["shard", "bin", "source"]).any() and not some.duplicated(["shard", "bin", "cluster"]).any()
    assert (some.groupby(["shard", "bin"])["length"].sum() <= 2048).all()
    assert after["length"].sum() == before.text.str.findall(r"[^\x20\x09-\x0D]+").str.len().sum()


def test_run_and_registry(spark, sf_dir):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(registry.QUERIES) <= set(names) and "pipeline" in names
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values()) and set(entry.oracle_sql()) <= set(names)
    assert pipeline.run(spark, sf_dir).count() > 0


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "", None, "a", 0), (2, "some words of no great worth here", "en", "a", 33), (2, "some words of no great worth here", "en", "a", 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("rid", "row", "cut", "size", "taken", "kept")})
    long = " ".join(f"wort{i % 977} und{i % 31}" for i in range(40_000))
    ties = [(i, "alike but for blanks" if i % 2 else "alike  but for blanks", "en", "b", 20) for i in range(10, 16)] + [(20, long, "de", "b", len(long))]
    docs = docs.unionByName(spark.createDataFrame(ties, docs.schema.fieldNames()[:5]), allowMissingColumns=True)
    for some in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, some, sf_dir)
            assert out.count() <= 3 * docs.count() + 3 * 40 and (name == "best-fit packing" or out.columns == pipeline.COLUMNS)
    # blank texts, the repeated one, those alike (of the longest the smallest doc_id stays), the long one
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).where("kept").collect()) == [1, 2, 10, 20]
