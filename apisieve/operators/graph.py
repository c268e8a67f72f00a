"""Reachability, cycles and purity over a call graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..checkpoints import cut

#: Nodes of a weakly connected component that one task takes on whole; pairs of nodes and edges that a task takes on together, about.
LOCAL_NODES, LOCAL_PAIRS, LOCAL_EDGES = 1000, 1_000_000, 200_000
#: Edges that a task reads together to find components where they lie.
CHUNK_EDGES = 100_000
#: Rounds after which the tables of single rounds are written together, so that plans stay short.
_TOGETHER = 8


def _grow(start: DataFrame, step) -> DataFrame:
    """start and all that step adds to it, round by round: step(fresh) gives rows that follow from the last round's.

    Only rows that are new go on, so each row takes part in one round. Rounds are written to the shared folder:
    plans don't grow, and lost executors cost one round. There are as many rounds as the longest of the
    shortest derivations.
    """
    every = fresh = cut(start.distinct())
    done = 0
    while True:
        fresh = cut(step(fresh).distinct().join(every, start.columns, "left_anti"))
        if fresh.isEmpty():
            return every
        every, done = every.unionByName(fresh), done + 1
        if done % _TOGETHER == 0:
            every = cut(every)


def components(edges: DataFrame, save=cut) -> DataFrame:
    """(node, component) of the undirected graph of edges (a, b); a component is its smallest node.

    Every round takes the smallest label among neighbours and then the label's own label, so paths halve.
    Sums before the shuffles keep a node with very many edges from gathering them in one task; the
    joins that such a node skews are inner joins, which adaptive execution splits. Rounds end when no
    label changes. Loops and repeated edges do no harm; no edges give no rows. save writes a round's table.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct()
    both = save(both)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    while True:
        labels = save(labels)
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        lower = save(lower)
        if lower.where("low < label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        jump = lower.select(F.col("node").alias("of"), F.col("low").alias("further"))
        labels = lower.join(jump, F.col("low") == F.col("of")).select("node", F.least("low", "further").alias("label"))


def _in_chunks(batches, together):
    """Edges, read so many together and without repeated ones: with the least node of the component that they make in their chunk, and how many of its nodes an edge is the first to meet."""
    import pyarrow as pa

    def run(held):
        src, dst = ([x for b in held for x in b.column(c).to_pylist()] for c in (0, 1))
        edges, root, met = dict.fromkeys(zip(src, dst, strict=True)), {}, []

        def find(x):
            while (up := root[x]) != x:
                root[x] = x = root[up]
            return x

        for a, b in edges:
            before = len(root)
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            met.append(len(root) - before)
            if a != b:
                root[max(a, b)] = min(a, b)
        kind = held[0].schema.field(0).type
        columns = [pa.array([e[0] for e in edges], kind), pa.array([e[1] for e in edges], held[0].schema.field(1).type), pa.array([find(a) for a, _ in edges], kind), pa.array(met, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["src", "dst", "part", "met"])

    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= together:
            yield run(held)
            held, n = [], 0
    if n:
        yield run(held)


def _parts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of components of LOCAL_NODES nodes or fewer, with a bucket of components that one task takes on together, and the other edges, distinct.

    Edges are read in chunks where they lie. A chunk's components are named by a node of theirs, so those of one name are one; nodes
    in components of several names link these, and only such links go through rounds. Where a component's edges lie together, there are next to none.
    """
    kind = edges.schema["src"]
    schema = StructType([kind, edges.schema["dst"], StructField("part", kind.dataType), StructField("met", IntegerType())])
    together = CHUNK_EDGES
    known = cut(edges.select("src", "dst").dropna().mapInArrow(lambda batches: _in_chunks(batches, together), schema))
    of_node = lambda rows, *more: rows.select(F.col("src").alias("node"), *more).unionAll(rows.select(F.col("dst").alias("node"), *more))
    met = of_node(known, "part").groupBy("node").agg(F.min("part").alias("least"), F.max("part").alias("last"))
    shared = cut(met.where("least <> last").select("node", "least"))
    count = [F.sum("met").alias("nodes"), F.count("*").alias("edges")]
    known = known.withColumn("component", F.col("part"))
    sizes = None
    if not shared.isEmpty():
        of = cut(components(of_node(known, "part").join(shared, "node").select(F.col("part").alias("a"), F.col("least").alias("b"))))
        known = cut(known.drop("component").join(of, F.col("part") == F.col("node"), "left").select("src", "dst", "met", F.coalesce("component", "part").alias("component"), F.col("component").isNotNull().alias("linked")))
        linked = known.where("linked").select("src", "dst", "component").distinct()  # a node may have been met by several chunks
        nodes = of_node(linked, "component").distinct().groupBy("component").agg(F.count("*").alias("nodes"))
        sizes = linked.groupBy("component").agg(F.count("*").alias("edges")).join(nodes, "component").select("component", "nodes", "edges")
        alone = known.where("NOT linked").groupBy("component").agg(*count)
    else:
        alone = known.groupBy("component").agg(*count)
    sizes = cut(alone if sizes is None else alone.unionByName(sizes))
    small = (F.col("nodes") <= LOCAL_NODES) & (F.col("edges") <= LOCAL_EDGES)
    work = sizes.where(small).agg(F.sum(F.greatest(F.col("nodes") * F.col("nodes") / LOCAL_PAIRS, F.col("edges") / LOCAL_EDGES))).first()[0] or 0
    told = known.select("src", "dst", "component", F.pmod(F.xxhash64("component"), F.lit(int(work) + 1)).alias("bucket"))
    great = cut(sizes.where(~small).select("component"))
    if great.isEmpty():
        return told.select("bucket", "src", "dst"), told.select("src", "dst").limit(0)
    return told.join(great, "component", "left_anti").select("bucket", "src", "dst"), told.join(great, "component", "left_semi").select("src", "dst").distinct()


def _onward(pdf: pd.DataFrame) -> dict:
    out: dict = {}
    for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
        out.setdefault(a, []).append(b)
    return out


def _reach(pdf: pd.DataFrame) -> pd.DataFrame:
    onward, src, dst = _onward(pdf), [], []
    for a in onward:
        seen, todo = set(), [a]
        while todo:
            for x in onward.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        src += [a] * len(seen)
        dst += seen
    return pd.DataFrame({"src": src, "dst": dst})


def _mutual(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes on cycles by depth-first search over edges, then over reversed ones in the order that nodes were left."""
    onward, left, seen = _onward(pdf), [], set()
    back = _onward(pdf.rename(columns={"src": "dst", "dst": "src"}))
    for a in onward:
        todo = [(a, iter(onward[a]))] if a not in seen else []
        seen.add(a)
        while todo:
            node, rest = todo[-1]
            x = next((y for y in rest if y not in seen), None)
            if x is None:
                left.append(node)
                todo.pop()
            else:
                seen.add(x)
                todo.append((x, iter(onward.get(x, ()))))
    taken, rows = set(), []
    for a in reversed(left):
        members, todo = [], [a] if a not in taken else []
        taken.add(a)
        while todo:
            members.append(todo.pop())
            more = [y for y in dict.fromkeys(back.get(members[-1], ())) if y not in taken]
            taken.update(more)
            todo += more
        if len(members) > 1 or members and a in onward.get(a, ()):
            rows += [(m, min(members)) for m in members]
    return pd.DataFrame(rows, columns=["node", "component"])


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) pairs joined by a path of one edge or more.

    As many rows as there are such pairs, so for graphs whose closure is wanted whole; spread() needs none. Weakly connected
    components of up to LOCAL_NODES nodes are closed by one task each, many of them together; larger ones go round by round.
    """
    edges = edges.select("src", "dst")
    local, large = _parts(edges)
    near = local.groupBy("bucket").applyInPandas(_reach, edges.schema)
    if large.isEmpty():
        return near
    large = cut(large)
    onward = large.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    return near.unionByName(_grow(large, lambda fresh: fresh.join(onward, "dst").select("src", F.col("next").alias("dst"))))


def spread(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of facts (fn, other columns) and the same for all functions that reach fn over edges (src, dst), distinct.

    Facts go up the edges without the closure, which may have a row for each pair of functions; here there is
    one for each function and fact at most. Weakly connected components of up to LOCAL_NODES nodes are done by one task each,
    many of them together; in larger ones facts go round by round. Null facts would never be found again, so there must be none.
    """
    local, large = _parts(edges)
    others = [c for c in facts.columns if c != "fn"]
    nodes = local.select(F.col("src").alias("fn"), "bucket").union(local.select("dst", "bucket")).distinct()
    known = cut(facts.select("fn", *others).distinct().join(nodes, "fn", "left"))

    def rise(calls: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        callers = _onward(calls.rename(columns={"src": "dst", "dst": "src"}))
        parts = [told[["fn", *others]].iloc[:0]]
        for fact, rows in told.groupby(others, sort=False):
            seen = set(rows["fn"].tolist())
            todo = list(seen)
            while todo:
                more = [x for x in callers.get(todo.pop(), ()) if x not in seen]
                seen.update(more)
                todo += more
            parts.append(pd.DataFrame({"fn": list(seen)}).assign(**dict(zip(others, fact, strict=True))))
        return pd.concat(parts, ignore_index=True)

    schema = StructType([facts.schema["fn"], *(facts.schema[c] for c in others)])
    near = local.groupBy("bucket").cogroup(known.where("bucket IS NOT NULL").groupBy("bucket")).applyInPandas(rise, schema)
    rest = known.where("bucket IS NULL").drop("bucket")
    if not large.isEmpty():
        callers = cut(large.select(F.col("dst").alias("fn"), F.col("src").alias("caller")))
        rest = _grow(rest, lambda fresh: fresh.join(callers, "fn").select(F.col("caller").alias("fn"), *others))
    return near.unionByName(rest)


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles and the least node of their strongly connected component.

    No closure is needed. Weakly connected components of up to LOCAL_NODES nodes are searched by one task each, many of them
    together. In larger ones, every node takes the least node that reaches it as its colour; those of a colour
    that reach the node it is named by are a strong component, which goes, and the rest is coloured anew.
    """
    kind = edges.schema["src"].dataType.simpleString()
    local, large = _parts(edges)
    found = local.groupBy("bucket").applyInPandas(_mutual, f"node {kind}, component {kind}")
    large = large if large.isEmpty() else cut(large)
    left = cut(large.where("src <> dst"))
    lonely = large.where("src = dst")
    loops = lonely.select(F.col("src").alias("node"))
    done = None
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colours = cut(_least_before(nodes, left))
        same = cut(_inside(left, colours))
        strong = _grow(colours.where("node = colour"), lambda fresh, e=same: fresh.join(e, (F.col("dst") == F.col("node")) & (F.col("of") == F.col("colour"))).select(F.col("src").alias("node"), "colour"))
        strong = cut(strong)
        done = strong if done is None else done.unionByName(strong)
        gone = strong.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return found.unionByName(lonely.select(F.col("src").alias("node"), F.col("src").alias("component")))
    sizes = done.groupBy("colour").agg(F.count("*").alias("n"))
    whole = done.join(sizes, "colour").join(loops.withColumn("loop", F.lit(True)), "node", "left").where("n > 1 OR loop").select("node", F.col("colour").alias("component"))
    alone = lonely.select(F.col("src").alias("node")).join(done.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(whole).unionByName(alone)


def _least_before(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches a node, itself included; only nodes whose colour fell pass it on."""
    colours = changed = cut(nodes.select("node", F.col("node").alias("colour")))
    while True:
        told = changed.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
        now = cut(colours.join(told, "node", "left").select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.coalesce("new", "colour") < F.col("colour")).alias("fell")))
        changed, colours = now.where("fell").select("node", "colour"), now.select("node", "colour")
        if changed.isEmpty():
            return colours


def _inside(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(src, dst, of): edges between nodes of one colour."""
    a, b = colours.toDF("src", "of"), colours.toDF("dst", "to")
    return edges.join(a, "src").join(b, "dst").where(F.col("of") == F.col("to")).select("src", "dst", "of")


def propagate(functions: DataFrame, edges: DataFrame, reasons: DataFrame) -> DataFrame:
    """(fn, is_pure, reasons): own reasons and those of all that a function reaches.

    functions: fn; edges: src, dst; reasons: fn, reason. Functions on a cycle reach one another and so share their reasons.
    """
    sets = spread(edges, reasons.select("fn", "reason")).groupBy("fn").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return functions.select("fn").join(sets, "fn", "left").select("fn", F.col("reasons").isNull().alias("is_pure"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def reason_counts(reasons: DataFrame) -> DataFrame:
    """Distinct reasons by function and kind: fn, kind, n. reasons: fn, kind, reason."""
    return reasons.groupBy("fn", "kind").agg(F.countDistinct("reason").alias("n")).where("n > 0")
