"""Sources, usage counts, graphs, purity, matching and carrying on small tables of their own."""

import json

import pytest
from pyspark.sql import functions as F

from apisieve.functions import similarity
from apisieve.operators import catalogue, dependencies, graph, matching, purity, usages
from tests import fixtures
from apisieve.sources import files, json_io, python_source, tables
from apisieve.streaming import usage_stream


def test_scan(spark, tmp_path):
    for name, text in {"lib/__init__.py": "from lib.core import f\n", "lib/core.py": "def f(x=1):\n    return x\n", "lib/tests/test_f.py": "import lib\n", "lib/notes.txt": "no code"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = files.with_module(files.scan(spark, str(tmp_path / "lib")), str(tmp_path / "lib"))
    assert sorted((r.module, r.is_init) for r in rows.collect()) == [("lib.__init__", True), ("lib.core", False)]
    built = catalogue.build(rows.select("module", "content", "is_init"), "lib")
    assert [(r.id, r.is_public) for r in built["functions"].collect()] == [("lib/lib.core/f", True)]
    listed = spark.createDataFrame([("lib.core",), ("",)], "value string")
    assert [r.module for r in files.exclude(rows, listed, "module").collect()] == ["lib.__init__"]


def test_files_in_other_encodings(spark, tmp_path):
    for name in ("a.py", "_b.py"):
        (tmp_path / name).write_bytes("from lib import f  # caf\u00e9\n".encode("latin-1"))
    (tmp_path / "c.py").write_text("from lib import f\nf(1)\n", encoding="utf-8")
    rows = files.scan(spark, str(tmp_path))
    found = files.parse_calls(rows, "lib").collect()
    assert sorted((r.path[-4:], r.error, r.qname) for r in found) == [("/a.py"[-4:], "UnicodeDecodeError", None), ("_b.py"[-4:], "UnicodeDecodeError", None), ("/c.py"[-4:], None, "lib.f")]


def test_api_round_trip(spark, tmp_path):
    built = catalogue.build(fixtures.library(spark), "shop", "numpydoc")
    path = str(tmp_path / "api")
    json_io.write_api(built, ("shop-dist", "shop", "1.0"), path)
    again = json_io.read_api(spark, path)
    key = lambda df: sorted((r.id, r.name, r.is_public) for r in df.select("id", "name", "is_public").collect())
    for part in ("classes", "functions", "parameters"):
        assert key(again[part]) == key(built[part])
    assert again["header"].first().package == "shop"
    assert again["parameters"].where("id = 'shop/shop._core/Basket/__init__/size'").first().default_value == "5"


def test_usages_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([("class", "a/B", None, 3, 1), ("function", "a/B/f", None, 3, 1), ("parameter", "a/B/f/x", None, 3, 1), ("value", "a/B/f/x", "1", 2, 1), ("value", "a/B/f/x", "'q'", 1, 2)], "kind string, id string, value string, n long, first_seen long")
    path = str(tmp_path / "usages")
    json_io.write_usages(counts, path)
    one = lambda df: sorted(map(tuple, df.select("kind", "id", "value", "n").collect()), key=repr)
    assert one(json_io.read_usages(spark, path)) == one(counts)
    text = next(p for p in (tmp_path / "usages").iterdir() if p.suffix == ".json").read_text()
    assert list(json.loads(text)["value_counts"]["a/B/f/x"]) == ["1", "'q'"]


def test_annotations_round_trip(spark, tmp_path):
    rows = fixtures.annotated(spark)
    path = str(tmp_path / "annotations")
    json_io.write_annotations(rows, path)
    again = json_io.read_annotations(spark, path)
    one = lambda df: sorted(repr((r.kind, r.target, r.newName, r.variant, r.default_value, r.interval, r.destination)) for r in df.collect())
    assert one(again) == one(rows)
    (tmp_path / "old.json").write_text('{"schemaVersion": 1}')
    with pytest.raises(ValueError):
        json_io.read_annotations(spark, str(tmp_path / "old.json"))


def test_binding(spark):
    params = [("f", n, i, k) for i, (n, k) in enumerate([("self", "IMPLICIT"), ("a", "POSITION_ONLY"), ("b", "POSITION_OR_NAME"), ("c", "NAME_ONLY")])]
    params = spark.createDataFrame(params, "function_id string, name string, ordinal int, assigned_by string")
    calls = [("1", "f", 1, ["x", "y", "surplus"], [("c", "z")]), ("2", "f", 1, ["x", "y"], [("b", "late"), ("q", "w")]), ("3", "f", 1, [], []), ("4", "g", 0, ["x"], [("k", "v")]), ("5", "f", 0, ["s"], None), ("6", "f", 1, None, [("b", "one"), ("b", "two")])]
    calls = spark.createDataFrame(calls, "call_id string, function_id string, n_implicit int, positional array<string>, keywords array<struct<name:string,value:string>>")
    found = sorted((r.call_id, r.parameter_id, r.value) for r in usages.bind_arguments(calls, params).collect())
    assert found == [("1", "f/a", "x"), ("1", "f/b", "y"), ("1", "f/c", "z"), ("2", "f/a", "x"), ("2", "f/b", "y"), ("2", "f/q", "w"), ("4", "g/k", "v"), ("5", "f/self", "s"), ("6", "f/b", "one")]


def test_counts_merge_and_cascade(spark):
    one = spark.createDataFrame([("function", "a/b", None, 2, 1), ("function", "a/b1", None, 1, 2), ("value", "a/c/p", "1", 1, 3)], "kind string, id string, value string, n long, first_seen long")
    minus = spark.createDataFrame([("value", "a/c/p", "1", -1, 1)], one.schema)
    merged = usages.merge_counts(one, one, minus, minus)
    assert sorted((r.id, r.n) for r in merged.collect()) == [("a/b", 4), ("a/b1", 2)]
    assert [r.id for r in usages.remove_cascade(one, spark.createDataFrame([("a/b",)], "prefix string")).collect()] == ["a/c/p"]


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 6), (7, 1), (4, 8), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (15, 16)]


def reachable(edges):
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    return reach


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([*EDGES, (1, 2)], "src int, dst int")
    reach = graph.closure(edges)
    assert sorted(map(tuple, reach.collect())) == sorted(reachable(EDGES))
    assert sorted(map(tuple, graph.cycles(reach).collect())) == [(1, 1), (2, 1), (3, 1), (6, 6)]
    assert sorted(map(tuple, graph.cycles(edges).collect())) == [(1, 1), (2, 1), (3, 1), (6, 6)]
    assert graph.closure(edges.limit(0)).isEmpty() and graph.cycles(edges.limit(0)).isEmpty()


@pytest.mark.parametrize("nodes", [0, 12, 1000])
def test_large_components_go_round_by_round(spark, monkeypatch, nodes):
    """Results don't depend on what one task may take on: nothing, some components, all."""
    import random

    monkeypatch.setattr(graph, "LOCAL_NODES", nodes)
    pick = random.Random(3)
    pairs = [(100 * c + pick.randrange(k), 100 * c + pick.randrange(k)) for c, k in enumerate((4, 9, 12, 30, 40)) for _ in range(k + k // 5)] + [(900, 900)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    reach = reachable(pairs)
    assert sorted(map(tuple, graph.closure(edges).collect())) == sorted(reach)
    facts = spark.createDataFrame([(b, f"f{b % 7}") for _, b in pairs[::3]] + [(5000, "alone")], "fn long, reason string")
    told = {(f.fn, f.reason) for f in facts.collect()}
    assert sorted(map(tuple, graph.spread(edges, facts).collect())) == sorted(told | {(a, r) for a, b in reach for f, r in told if f == b})
    mutual = {n: min(x for x in {a for a, b in reach if b == n} & {b for a, b in reach if a == n}) for n in {a for a, b in reach if a == b}}
    assert dict(map(tuple, graph.cycles(edges).collect())) == mutual


def test_propagation(spark):
    edges = spark.createDataFrame(EDGES, "src int, dst int")
    reasons = spark.createDataFrame([(16, "FileRead.a"), (2, "FileWrite.b"), (6, "x"), (16, "FileRead.a")], "fn int, reason string")
    found = {r.fn: (r.is_pure, r.reasons) for r in graph.propagate(spark.range(1, 18).select(F.col("id").cast("int").alias("fn")), edges, reasons).collect()}
    reach = reachable(EDGES)
    for n in range(1, 18):
        own = sorted({r for f, r in [(16, "FileRead.a"), (2, "FileWrite.b"), (6, "x")] if f == n or (n, f) in reach})
        assert found[n] == (not own, own)


def test_purity_of_source(spark):
    found = {r.name: r for r in purity.analyse(files.parse_facts(fixtures.library(spark))).collect()}
    assert found["even"].is_pure and found["odd"].is_pure and found["price"].is_pure
    assert found["remember"].reasons == ["NonLocalVariableWrite.GlobalVariable.seen"] or "NonLocalVariableWrite.GlobalVariable.seen" in found["remember"].reasons
    assert "FileRead.ParameterAccess.path" in found["load"].reasons
    assert "FileWrite.Builtin.print" in found["log"].reasons and "CallOfParameter.ParameterAccess.sink" in found["log"].reasons
    assert set(found["log"].reasons) <= set(found["total"].reasons)


def test_reference_tables(spark):
    modes = dict(tables.open_modes())
    assert modes["r"] == "READ" and modes["wb"] == "WRITE" and modes["a+"] == "READ_WRITE"
    builtin = {n: (p, r) for n, p, r in tables.builtin_purity()}
    assert builtin["len"][0] and builtin["print"] == (False, ["FileWrite"]) and builtin["ValueError"] == (False, [])


def test_mapping_stages(spark):
    v1, v2 = fixtures.elements(spark), fixtures.elements(spark, True)
    found = {(r.stage, tuple(r.v1_ids), tuple(r.v2_ids)) for r in matching.map_api(v1, v2).collect()}
    assert ("unchanged", ("lib/m/Basket",), ("lib/m/Basket",)) in found
    assert any(a == ("lib/m/price",) and b == ("lib/m/prices",) for _, a, b in found)
    assert any(a == ("lib/m/price/x",) and b == ("lib/m/prices/x",) for _, a, b in found)


def test_list_distances_agree(spark):
    rows = [([], []), (["a"], []), (["a", "b", "c"], ["a", "c"]), (list("kitten"), list("sitting")), (list("abcab"), list("bcaba"))]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select(similarity.list_similarity("a", "b").alias("x"), similarity.short_list_similarity(F.col("a"), F.col("b")).alias("y")).collect():
        assert r.x == pytest.approx(r.y)


def test_prefix_merge(spark):
    rows = [("class", "v", f"w{i}", s, 1, i) for i, s in enumerate([0.9, 0.8, 0.62])]
    df = spark.createDataFrame(rows, "kind string, v1_id string, v2_id string, similarity double, ord1 int, ord2 int")
    r = matching.merge_prefix(df).first()
    # 0.9 and 0.8 give 0.85, which is 0.23 above 0.62 and so stays apart
    assert r.v2_ids == ["w0", "w1"] and r.similarity == pytest.approx(0.85)


def test_running_counts_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "f"), ("2024-01-01 00:20:00", "f"), ("2024-01-01 01:10:00", "g"), ("2024-01-01 05:00:00", "f")]
    batch = spark.createDataFrame(rows, "t string, function_id string").select(F.col("t").cast("timestamp").alias("ts"), "function_id")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for made, mode in ((usage_stream.running_counts(stream), "complete"), (usage_stream.windowed_counts(stream), "append")):
        q = made.writeStream.format("memory").queryName(f"counts_{mode}").outputMode(mode).option("checkpointLocation", str(tmp_path / mode)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    assert sorted(map(tuple, spark.table("counts_complete").collect())) == [("f", 3), ("g", 1)]
    assert sorted((str(r.start), r.function_id, r.n) for r in spark.table("counts_append").collect()) == [("2024-01-01 00:00:00", "f", 2), ("2024-01-01 01:00:00", "g", 1)]


def test_dependencies_and_their_file(spark, tmp_path):
    rows = [("f", "f/a", "a", "This parameter is ignored when b is set to False."), ("f", "f/b", "b", "If a is None , then b will be the identity. If x is 3, raises."), ("f", "f/c", "c", None), ("g", "g/a", "a", "If metric is a string, it must be one of a list."), ("g", "g/metric", "metric", "None.")]
    found = dependencies.sibling_dependencies(spark.createDataFrame(rows, "function_id string, parameter_id string, name string, description string"))
    told = sorted((r.parameter_id, r.dependee_id, r.condition, r.condition_kind, r.action, r.action_kind) for r in found.collect())
    assert told == [
        ("f/a", "f/b", "when b is set to False", "has_value", "This parameter is ignored", "is_ignored"),
        ("f/b", "f/a", "If a is None", "is_none", "then b will be the identity", "other"),
        ("g/a", "g/metric", "If metric is a string", "other", "it must be one of a list", "is_illegal"),
    ]
    json_io.write_dependencies(found, str(tmp_path / "dependencies"))
    lines = next(p for p in (tmp_path / "dependencies").iterdir() if p.suffix == ".json").read_text().splitlines()
    assert [json.loads(x)["function_id"] for x in lines] == ["f", "g"] and json.loads(lines[0])["parameters"]["f/a"][0]["action"]["variant"] == "is_ignored"


def test_purity_file(spark, tmp_path):
    json_io.write_purity(purity.analyse(files.parse_facts(fixtures.library(spark))), str(tmp_path / "purity"))
    line = json.loads(next(p for p in (tmp_path / "purity").iterdir() if p.suffix == ".json").read_text().splitlines()[0])
    by = {f["fn"].split(".")[-3]: f for f in line["functions"]}
    assert by["price"]["purity"] == "Pure" and json.loads(by["log"]["reasons"])["CallOfParameter"] == ["CallOfParameter.ParameterAccess.sink"]


def test_files_are_parsed_in_small_parts(spark, monkeypatch):
    """Rows of catalogue, calls and facts don't depend on how many files a worker holds, and a filter on what a parse gives stays behind it."""
    monkeypatch.setattr(files, "PARSED_ROWS", 3)
    monkeypatch.setattr(files, "KEPT_TEXTS", 2)
    rows = spark.range(0, 20, 1, 1).selectExpr("concat('lib.m', id) AS module", "concat('c', id) AS path", "concat('from lib.m import f', chr(10), 'f(', id % 4, ')', CASE WHEN id % 5 = 0 THEN ' f' ELSE '' END, chr(10)) AS content")
    called = files.parse_calls(rows, "lib")
    assert sorted((r.path, r.error, r.positional) for r in called.collect()) == sorted((f"c{i}", None if i % 5 else "SyntaxError", [str(i % 4)] if i % 5 else None) for i in range(20))
    plan = called.where("error IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PythonUDF" not in plan and plan.index("Filter") < plan.index("MapInArrow")
    assert files.parse_facts(rows).where("fact = 'error'").count() == 4 and files.parse_declarations(rows.select("module", "content"), "lib").where("d.error IS NULL").count() == 16


def test_texts_as_unparsed():
    import ast
    import textwrap

    for text in ("1", "'a\\'b\"'", "u'x'", "None", "True", "1e400", "2j", "b'x'", "...", "-1", "x", "x.y", "[1, 'a']", "f'{x}'"):
        node = ast.parse(text, mode="eval").body
        assert python_source._text(node) == ast.unparse(node)
    for text in ("a\n  \n b", "  a\n\t\n  b", "", "\n x", "a", "\f a\n  b", "if x:\n    '''\n   \n'''"):
        assert python_source._dedented(text) == textwrap.dedent(text)
    f = ast.parse("def f(self):\n  if a:\n    self.x = 1\n    try:\n      self.u = 1\n    except E:\n      self.v = lambda: 0\n  self.y = 2\n  with a:\n    self.z = 1\n  def g():\n    self.w = 1\n  match x:\n    case 1:\n      self.q = 1\n").body[0]
    assert [n for n in python_source._statements(f) if isinstance(n, ast.Assign)] == [n for n in ast.walk(f) if isinstance(n, ast.Assign)]


def test_method_names_shared_by_many_classes(spark):
    """Edges of method calls are as many as calls and methods, not their product."""
    text = "class C:\n    def show(self):\n        print(self)\n\ndef f(c):\n    return c.show()\n"
    facts = files.parse_facts(spark.range(40).selectExpr("concat('lib.m', id) AS module").withColumn("content", F.lit(text)))
    assert purity.resolve(facts)[1].count() == 80
    assert {(r.is_pure, tuple(r.reasons)) for r in purity.analyse(facts).collect()} == {(False, ("FileWrite.Builtin.print",))}


@pytest.mark.parametrize("together", [1, 3, 1000])
def test_components_found_where_edges_lie(spark, monkeypatch, together):
    """Results don't depend on how edges are cut into chunks; components whose edges lie in one chunk take no rounds."""
    rounds = []
    monkeypatch.setattr(graph, "CHUNK_EDGES", together)
    monkeypatch.setattr(graph, "components", lambda links, real=graph.components: rounds.append(1) or real(links))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", together)
    try:
        edges = spark.createDataFrame([(str(a), str(b)) for a, b in [*EDGES, *EDGES[:3]]], "src string, dst string").coalesce(1)
        assert sorted(map(tuple, graph.closure(edges).collect())) == sorted((str(a), str(b)) for a, b in reachable(EDGES))
        assert sorted(map(tuple, graph.cycles(edges).collect())) == [("1", "1"), ("2", "1"), ("3", "1"), ("6", "6")]
        assert bool(rounds) == (together < 1000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_likely_pairs_are_all_that_reach_the_threshold(spark):
    """Against all pairs: elements of few and many items, empty ones, defaults and paths of all sorts, names a few letters apart."""
    import random

    pick = random.Random(5)
    some = lambda xs, k: [pick.choice(xs) for _ in range(pick.randrange(k + 1))]
    stems = ["abcdefghijklmnopqrstuvwx", "0123456789abcdef01234567", "zyxwvutsrqponmlkjihgfedc", "aé", "b"]

    def element(kind, i):
        name = "".join(pick.choice("qw") if pick.random() < 0.05 else c for c in pick.choice(stems))
        text = pick.choice(["", None, "a b", "c ", "d e f"])
        id_ = "/".join(["lib", pick.choice(["m", "m.n", "k"]), *some(["C", "D"], 2), f"{name}{i}"])
        return (kind, id_, name, "lib/m", "module", i, text, some("abc", 2), some("xy", 2), some("pqr", 2), pick.choice([None, [], ["int"], ["s"], ["t"]]), pick.choice(["POSITION_OR_NAME", "NAME_ONLY"]), pick.choice([None, "1", "2", "1.0", "True", "'x'", "None"]), [])

    columns = "kind string, id string, name string, parent_id string, parent_kind string, ord int, description string, members array<string>, attributes array<string>, code_lines array<string>, types array<string>, assigned_by string, default_value string, superclasses array<string>"
    made = lambda: spark.createDataFrame([element(k, i) for k in ("class", "function", "parameter", "attribute", "result") for i in range(25)], columns).cache()
    v1, v2 = made(), made()
    for threshold in (0.61,):
        pairs = lambda df: set(map(tuple, df.select("kind", "v1_id", "v2_id").collect()))
        held = pairs(matching.likely(v1, v2, threshold))
        assert pairs(matching.candidates(v1, v2, matching.by_kind, threshold)) <= held
        assert len({x for x in held if x[0] == "parameter"}) < 625


def test_large_catalogues_are_several_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_io, "ONE_DOCUMENT", 3)
    monkeypatch.setattr(json_io, "PART_DOCUMENT", 2)
    built = catalogue.build(fixtures.library(spark), "shop", "numpydoc")
    json_io.write_api(built, ("shop-dist", "shop", "1.0"), str(tmp_path / "api"))
    texts = [json.loads(x.read_text()) for x in (tmp_path / "api").iterdir() if x.suffix == ".json"]
    assert len(texts) > 1 and all({"modules", "classes", "functions"} <= set(x) and [f["id"] for f in x["functions"]] == sorted(f["id"] for f in x["functions"]) for x in texts)
    again = json_io.read_api(spark, str(tmp_path / "api"))
    for part in ("modules", "classes", "functions", "parameters"):
        assert sorted(r.id for r in again[part].select("id").collect()) == sorted(r.id for r in built[part].select("id").collect())
    assert again["header"].count() == 1
