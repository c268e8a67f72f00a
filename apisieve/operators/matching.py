"""Matching the elements of two versions of an API."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import similarity
from ..functions.literals import INTEGER, to_double
from ..functions.similarity import SIMILARITIES
from . import graph

CREATE, GAP = 0.61, 0.23
SURE, LIKELY = 0.85, 0.75


def unchanged(v1: DataFrame, v2: DataFrame, compare: list[str]) -> DataFrame:
    """(kind, id) in both versions; parameters, attributes and results also have to agree in the compared columns."""
    left, right = v1.alias("a"), v2.alias("b")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    strict = F.col("a.kind").isin("parameter", "attribute", "result")
    return left.join(right, ["kind", "id"]).where(~strict | same).select("kind", "id")


def unmapped(v1: DataFrame, v2: DataFrame, mapped: DataFrame) -> DataFrame:
    """Elements of either version that no mapping holds: (kind, version, id). mapped: kind, v1_id, v2_id."""
    one = v1.select("kind", "id").join(mapped.select("kind", F.col("v1_id").alias("id")), ["kind", "id"], "left_anti")
    two = v2.select("kind", "id").join(mapped.select("kind", F.col("v2_id").alias("id")), ["kind", "id"], "left_anti")
    return one.withColumn("version", F.lit(1)).unionByName(two.withColumn("version", F.lit(2)))


def candidates(v1: DataFrame, v2: DataFrame, score, threshold: float = CREATE, gate: DataFrame | None = None) -> DataFrame:
    """Pairs of one kind whose score reaches the threshold: kind, v1_id, v2_id, similarity, ord1, ord2.

    score(a, b) gets functions from a field's name to a column. All pairs of a kind are scored, unless
    gate (kind, v1_id, v2_id) names those that may be; both versions carry ord, their order in the catalogue.
    """
    a, b = v1.alias("a"), v2.alias("b")
    field = lambda side: lambda name: F.col(f"{side}.{name}")
    if gate is None:
        pairs = a.join(b, F.col("a.kind") == F.col("b.kind"))
    else:
        g = gate.select("kind", "v1_id", "v2_id").distinct().alias("g")
        pairs = g.join(a, (F.col("g.kind") == F.col("a.kind")) & (F.col("g.v1_id") == F.col("a.id"))).join(b, (F.col("g.kind") == F.col("b.kind")) & (F.col("g.v2_id") == F.col("b.id")))
    scored = pairs.select(F.col("a.kind").alias("kind"), F.col("a.id").alias("v1_id"), F.col("b.id").alias("v2_id"), F.col("a.ord").alias("ord1"), F.col("b.ord").alias("ord2"), score(field("a"), field("b")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


#: Measures as means of terms: lists compared by edit distance, whether descriptions count, how many terms there are without descriptions and defaults.
_MEASURES = {
    "class": (similarity.class_similarity, ("attributes", "members", "code_lines"), True, 5),
    "function": (similarity.function_similarity, ("code_lines", "members"), True, 4),
    "parameter": (similarity.parameter_similarity, ("types",), True, 4),
    "attribute": (similarity.attribute_similarity, ("types",), False, 2),
}


def likely(v1: DataFrame, v2: DataFrame, threshold: float = CREATE) -> DataFrame:
    """(kind, v1_id, v2_id): all pairs that may reach the threshold under by_kind, and as few others as bounds allow.

    A list's term is 0 unless an item is shared or both are empty. Elements fall into groups by which lists are empty and
    which sort of default they have; where the other terms can't bring two groups to the threshold, only pairs that share an item are likely.
    Where they can, parameters of equal paths or defaults are, and those whose names are as near as the rest of the terms demands, which have a piece
    in common. Of other groups, and of kinds with a measure that isn't known here, all pairs are.
    """
    known = [k for k, (f, *_) in _MEASURES.items() if SIMILARITIES.get(k) is f]
    side = lambda v, c: v.select("kind", F.col("id").alias(c)).where(~F.col("kind").isin(*known))
    out = side(v1, "v1_id").join(side(v2, "v2_id"), "kind")
    for kind in known:
        _, lists, described, terms = _MEASURES[kind]
        a, b = _grouped(v1, "v1_id", kind, lists, described), _grouped(v2, "v2_id", kind, lists, described)
        item = lambda v, c: v.select("kind", c, F.explode("items").alias("item"))
        out = out.unionByName(item(a, "v1_id").join(item(b, "v2_id"), ["kind", "item"]).select("kind", "v1_id", "v2_id"))
        of = lambda v: [(r["group"], r["deep"]) for r in v.groupBy("group").agg(F.max(F.size(F.split("path", "/"))).alias("deep")).collect()]
        ones, twos, near = of(a), of(b), []
        met: dict[str, list] = {"kind": [], "path": [], "number": []}
        for g, deep1 in ones:
            for h, deep2 in twos:
                *empty1, told1, sort1 = g.split(",")
                *empty2, told2, sort2 = h.split(",")
                rest, count = float(sum(x == y == "true" for x, y in zip(empty1, empty2, strict=True))), terms
                if described and not told1 == told2 == "true":
                    rest, count = rest + (0.5 if "true" in (told1, told2) else 0), count + 1  # an empty text and one with an empty token
                rest += {"attribute": 0, "parameter": 2}.get(kind, 1)  # paths, and assignments
                # what defaults that aren't equal numbers add at most
                unequal, most = {("null", "null"): (0, 0), ("int", "int"): (0.5, 1)}.get((sort1, sort2), (0, 0) if "null" in (sort1, sort2) else (1, 1)) if kind == "parameter" else (0, 0)
                count += kind == "parameter" and (sort1, sort2) != ("null", "null")
                need = threshold * count - 1e-9
                if 1 + rest + most < need:
                    continue
                deep = max(deep1, deep2)
                name = need - unequal - (rest - 2 / (deep * (deep + 1)))  # how alike names must be where paths aren't equal: one step at a path's end costs least
                if kind != "parameter" or name <= 0.5:
                    met["kind"].append((g, h))
                    continue
                met["path"].append((g, h))
                if most > unequal:
                    met["number"].append((g, h))
                if name <= 1:
                    near.append((g, h, name))
        for column, pairs in met.items():
            if pairs:
                told = F.broadcast(v1.sparkSession.createDataFrame(pairs, "g string, h string"))
                x, y = a.select("kind", "v1_id", F.col(column).alias("x"), F.col("group").alias("g")).join(told, "g"), b.select("v2_id", F.col(column).alias("x"), F.col("group").alias("h"))
                out = out.unionByName(x.join(y, ["x", "h"]).select("kind", "v1_id", "v2_id"))
        if near:
            x, y = (v.where(F.col("group").isin(*{n[i] for n in near})) for i, v in enumerate((a, b)))
            out = out.unionByName(_near_names(x, y, min(n[2] for n in near)).select("kind", "v1_id", "v2_id"))
    return out.distinct()


def _grouped(v: DataFrame, id_: str, kind: str, lists: tuple[str, ...], described: bool) -> DataFrame:
    """Elements of a kind with group (emptiness of lists and description, sort of default), items of lists and description, path and default as a number."""
    none = F.array().cast("array<string>")
    told, default, parts = F.coalesce("description", F.lit("")), F.col("default_value"), F.split("id", "/")
    sort = F.when(default.isNull(), "null").when(default.rlike(INTEGER), "int").otherwise("other")
    group = [*[(F.size(F.coalesce(x, none)) == 0).cast("string") for x in lists], (told == "").cast("string"), sort if kind == "parameter" else F.lit("")]
    marked = lambda f, x: F.transform(x, lambda y: F.concat(F.lit(f + ":"), y))
    items = [marked(f, F.coalesce(f, none)) for f in lists] + [F.when(told != "", marked("description", F.split(told, "[\n ]"))).otherwise(none)] * described
    path = F.concat_ws("/", F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))))
    rows = v.where(F.col("kind") == kind)
    return rows.select("kind", F.col("id").alias(id_), "name", F.concat_ws(",", *group).alias("group"), F.array_distinct(F.concat(*items)).alias("items"), F.translate(path, ".", "/").alias("path"), F.when(sort == "int", to_double(default)).alias("number"))


def _near_names(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs (kind, v1_id, v2_id, similarity) with 1 - edit distance / longer length >= least, above a half.

    A name of n letters has at most e = (1 - least) * n / least edits to the other, so of e + 1 pieces one is whole in the other.
    """
    edits = lambda n: int((1 - least) * n / least + 1e-9)
    lengths = [r[0] for r in a.select(F.length("name")).distinct().collect()]
    widths = {n: n // (edits(n) + 1) for n in lengths}
    wide = sorted(set(widths.values()))
    width = F.element_at(F.create_map(*[F.lit(x) for n in lengths for x in (n, widths[n])]), F.length("name")) if lengths else F.lit(1)
    cut_at = lambda starts, w: F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("name"), i, w)))
    # names of fewer letters than pieces have the piece of no letters, which every name has
    whole = F.when(F.col("w") > 0, F.sequence(F.lit(1), F.greatest(F.length("name") - F.col("w") + 1, F.lit(1)), F.greatest(F.col("w"), F.lit(1)))).otherwise(F.array(F.lit(1)))
    left = a.withColumn("w", width).select("kind", "v1_id", F.col("name").alias("n1"), "w", F.explode(cut_at(whole, F.col("w"))).alias("piece"))
    every = F.when(F.col("w") > 0, F.sequence(F.lit(1), F.greatest(F.length("name") - F.col("w") + 1, F.lit(1)))).otherwise(F.array(F.lit(1)))
    right = b.withColumn("w", F.explode(F.array(*[F.lit(w) for w in wide]).cast("array<int>"))).select("kind", "v2_id", F.col("name").alias("n2"), "w", F.explode(cut_at(every, F.col("w"))).alias("piece"))
    met = left.join(right, ["kind", "w", "piece"])
    return met.select("kind", "v1_id", "v2_id", similarity.name_similarity(F.col("n1"), F.col("n2")).alias("similarity")).where(F.col("similarity") >= least - 1e-9)


def short_edit_pairs(v1: DataFrame, v2: DataFrame, threshold: float = CREATE) -> DataFrame:
    """Pairs of names with 1 - edit distance / longer length >= threshold, by blocks of lengths instead of all pairs.

    |la - lb| / max(la, lb) <= 1 - threshold is necessary, so a name only meets lengths in that range. Each distinct name is
    compared once, however many elements have it.
    """
    names = lambda v: v.select("kind", "name").distinct()
    reach = F.sequence(F.ceil(F.length("name") * threshold).cast("int"), F.floor(F.length("name") / threshold).cast("int"))
    a = names(v1).select("kind", F.col("name").alias("n1"), F.explode(reach).alias("len"))
    b = names(v2).select("kind", F.col("name").alias("n2"), F.length("name").alias("len"))
    longer = F.greatest(F.length("n1"), F.length("n2"), F.lit(1))
    near = a.join(b, ["kind", "len"]).withColumn("similarity", 1 - F.levenshtein(F.col("n1"), F.col("n2")) / longer).where(F.col("similarity") >= threshold)
    one = v1.select("kind", F.col("id").alias("v1_id"), F.col("name").alias("n1"))
    two = v2.select("kind", F.col("id").alias("v2_id"), F.col("name").alias("n2"))
    return near.join(one, ["kind", "n1"]).join(two, ["kind", "n2"]).select("kind", "v1_id", "v2_id", "similarity")


def merge_prefix(pairs: DataFrame, gap: float = GAP) -> DataFrame:
    """One mapping per v1 element: kind, v1_id, similarity, v2_ids, ord1.

    Candidates by falling similarity are folded into the first as long as the mean so far is less than
    `gap` above the next; a merge takes the mean of both, so earlier ones weigh less. Needs ord1, ord2.
    """
    row = F.struct((-F.col("similarity")).alias("minus"), F.col("ord2"), F.col("v2_id"))
    grouped = pairs.groupBy("kind", "v1_id", "ord1").agg(F.array_sort(F.collect_list(row)).alias("c"))
    first = F.struct((-F.col("c")[0]["minus"]).alias("s"), F.array(F.col("c")[0]["v2_id"]).alias("ids"), F.lit(False).alias("done"))

    def fold(acc, x):
        stop = acc["done"] | ((acc["s"] + x["minus"]) >= gap)
        return F.struct(F.when(stop, acc["s"]).otherwise((acc["s"] - x["minus"]) / 2).alias("s"), F.when(stop, acc["ids"]).otherwise(F.concat(acc["ids"], F.array(x["v2_id"]))).alias("ids"), stop.alias("done"))

    folded = F.aggregate(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), first, fold)
    return grouped.withColumn("m", folded).select("kind", "v1_id", "ord1", F.col("m.s").alias("similarity"), F.array_distinct("m.ids").alias("v2_ids"))


def _collapse(rows):
    """Mappings of one component, merged in the order of their v1 elements wherever they share a v2 element."""
    done: list[list] = []
    for r in sorted(rows, key=lambda r: r["ord1"]):
        new = [r["similarity"], [r["v1_id"]], list(r["v2_ids"])]
        rest = []
        for old in done:
            if set(old[2]) & set(r["v2_ids"]):
                new = [(new[0] + old[0]) / 2, list(dict.fromkeys(new[1] + old[1])), list(dict.fromkeys(new[2] + old[2]))]
            else:
                rest.append(old)
        done = [*rest, new]
    return done


def merge_shared(mappings: DataFrame) -> DataFrame:
    """Mappings that share v2 elements become one: kind, similarity, v1_ids, v2_ids.

    Similarities are means taken in v1's order, so each connected component of mappings that share elements is folded in that
    order by one task; mappings that share none stay as they are.
    """
    import pandas as pd

    rows = cut(mappings.select("kind", "v1_id", "similarity", "v2_ids", "ord1"))
    pairs = rows.select("kind", "v1_id", F.explode("v2_ids").alias("v2_id"))
    several = pairs.groupBy("kind", "v2_id").agg(F.count("*").alias("n")).where("n > 1").select("kind", "v2_id")
    node = lambda side, c: F.concat_ws("|", F.lit(side), "kind", c)
    links = pairs.join(several, ["kind", "v2_id"]).select(node("1", "v1_id").alias("a"), node("2", "v2_id").alias("b"))
    of = graph.components(links).withColumnRenamed("node", "a")
    told = rows.withColumn("a", node("1", "v1_id")).join(of, "a", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _collapse(pdf.to_dict("records"))
        return pd.DataFrame({"kind": pdf["kind"].iloc[0], "similarity": [x[0] for x in out], "v1_ids": [x[1] for x in out], "v2_ids": [x[2] for x in out]})

    alone = told.where("component IS NULL").select("kind", "similarity", F.array("v1_id").alias("v1_ids"), "v2_ids")
    shared = told.where("component IS NOT NULL").drop("a").groupBy("kind", "component")
    return alone.unionByName(shared.applyInPandas(fold, "kind string, similarity double, v1_ids array<string>, v2_ids array<string>"))


def shape(mappings: DataFrame) -> DataFrame:
    """Adds shape: 1:1, 1:n, n:1 or n:m."""
    side = lambda c, many: F.when(F.size(c) == 1, "1").otherwise(many)
    both = F.concat_ws(":", side("v1_ids", "n"), F.when(F.size("v2_ids") == 1, "1").when(F.size("v1_ids") == 1, "n").otherwise("m"))
    return mappings.withColumn("shape", both)


def route(mappings: DataFrame) -> DataFrame:
    """Adds store and review: annotations along many-to-many or unlikely mappings go to the unsure store, likely ones are marked unsure."""
    reliable = (F.col("shape") != "n:m") & (F.col("similarity") >= LIKELY)
    return mappings.withColumn("store", F.when(reliable, "reliable").otherwise("unsure")).withColumn("review", F.when(reliable & (F.col("similarity") < SURE), "unsure").otherwise(""))


def first_match(annotations: DataFrame, mappings: DataFrame) -> DataFrame:
    """Annotations with the first mapping, by ord, that has their target among its v1_ids; attributes and results take no annotations."""
    where = mappings.where(F.col("kind").isin("class", "function", "parameter"))
    flat = where.select(F.explode("v1_ids").alias("target"), "ord", *[c for c in where.columns if c not in ("ord", "kind")], F.col("kind").alias("element_kind"))
    first = Window.partitionBy("target").orderBy("ord")
    return annotations.join(flat.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn"), "target")


def duplicates(annotations: DataFrame) -> DataFrame:
    """One annotation per (kind, target): the first by review result, the others' differing payloads gathered, review unsure where they differ.

    annotations: kind, target, payload, reviewResult.
    """
    order = F.expr("CASE reviewResult WHEN 'correct' THEN 0 WHEN '' THEN 1 WHEN 'unsure' THEN 2 ELSE 3 END")
    grouped = annotations.withColumn("o", order).groupBy("kind", "target").agg(F.min_by(F.struct("payload", "reviewResult"), F.struct("o", "payload")).alias("kept"), F.array_sort(F.collect_set("payload")).alias("all"), F.count("*").alias("n"))
    others = F.filter("all", lambda p: p != F.col("kept.payload"))
    return grouped.select("kind", "target", F.col("kept.payload").alias("payload"), others.alias("conflicts"), F.when(F.size(others) > 0, "unsure").otherwise(F.col("kept.reviewResult")).alias("reviewResult"), "n")


def parent_gate(v1: DataFrame, v2: DataFrame, mapped: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Pairs of children whose parents are mapped to one another: kind, v1_id, v2_id. v1, v2: kind, id, parent_id, parent_kind; global functions' parents are modules, which always pass.

    With among (kind, v1_id, v2_id), the pairs of elements at the top are taken from there instead of all.
    """
    m = mapped.select(F.col("kind").alias("pk"), F.col("v1_id").alias("p1"), F.col("v2_id").alias("p2"))
    a = v1.select("kind", F.col("id").alias("v1_id"), F.col("parent_id").alias("p1"), F.col("parent_kind").alias("pk"))
    b = v2.select("kind", F.col("id").alias("v2_id"), F.col("parent_id").alias("p2"))
    under = a.join(m, ["pk", "p1"]).join(b, ["kind", "p2"]).select("kind", "v1_id", "v2_id")
    top = lambda x: x.where((F.col("kind") == "class") | (F.col("parent_kind") == "module"))
    one, two = top(v1).select("kind", F.col("id").alias("v1_id")), top(v2).select("kind", F.col("id").alias("v2_id"))
    free = one.join(two, "kind") if among is None else among.join(one, ["kind", "v1_id"], "left_semi").join(two, ["kind", "v2_id"], "left_semi")
    return under.unionByName(free.select("kind", "v1_id", "v2_id"))


def inheritance_gate(classes2: DataFrame, mapped: DataFrame) -> DataFrame:
    """(v1_id, v2_id) of classes where v2 is, or by name is a super- or subclass of, a class that v1 is mapped to."""
    named = classes2.select(F.col("id").alias("cid"), F.col("name").alias("cname"))
    up = classes2.select("id", F.explode("superclasses").alias("cname")).join(named, "cname").select(F.col("id").alias("sub"), F.col("cid").alias("sup"))
    near = up.select(F.col("sub").alias("x"), F.col("sup").alias("y")).union(up.select("sup", "sub")).union(classes2.select("id", "id")).distinct()
    return mapped.where("kind = 'class'").join(near, F.col("v2_id") == F.col("x")).select("v1_id", F.col("y").alias("v2_id")).distinct()


INHERITANCE_BOOST = 0.15


def boosted(score):
    return lambda a, b: score(a, b) * (1 - INHERITANCE_BOOST) + INHERITANCE_BOOST


def by_kind(a, b):
    """The registered similarity of a pair's kind."""
    out = None
    for kind, f in SIMILARITIES.items():
        out = F.when(a("kind") == kind, f(a, b)) if out is None else out.when(a("kind") == kind, f(a, b))
    return out


def map_api(v1: DataFrame, v2: DataFrame, threshold: float = CREATE, gap: float = GAP, carry_one_to_one: bool = True) -> DataFrame:
    """The stages in turn: unchanged, simple, strict, inheritance. Gives kind, similarity, v1_ids, v2_ids, stage.

    v1, v2: kind, id, name, parent_id, parent_kind, ord, description, members, attributes, code_lines,
    types, assigned_by, default_value, superclasses. Unchanged elements are mapped by id; the others of a kind are scored
    with each other; those that are not mapped one to one are scored again where their parents are mapped;
    what stays unmapped is tried under inheritance with a boost.
    """
    same = unchanged(v1, v2, ["default_value", "assigned_by", "types"])
    sure = same.select("kind", F.lit(1.0).alias("similarity"), F.array("id").alias("v1_ids"), F.array("id").alias("v2_ids"), F.lit("unchanged").alias("stage"))
    flat = lambda m: m.select("kind", F.explode("v1_ids").alias("v1_id"), "v2_ids").select("kind", "v1_id", F.explode("v2_ids").alias("v2_id"))
    rest = lambda v, done, c: v.join(done.select("kind", F.col(c).alias("id")).distinct(), ["kind", "id"], "left_anti")

    def stage(name, a, b, score, gate=None):
        return merge_shared(merge_prefix(candidates(a, b, score, threshold, gate), gap)).withColumn("stage", F.lit(name))

    done = flat(sure)
    a, b = cut(rest(v1, done, "v1_id")), cut(rest(v2, done, "v2_id"))
    simple = cut(stage("simple", a, b, by_kind, likely(a, b, threshold)))
    single = (F.size("v1_ids") == 1) & (F.size("v2_ids") == 1)
    one, many = flat(simple.where(single)), flat(simple.where(~single))
    gate = parent_gate(v1, v2, done.unionByName(flat(simple)), many).join(many, ["kind", "v1_id", "v2_id"], "left_semi")
    strict = cut(stage("strict", a, b, by_kind, gate))
    kept = done.unionByName(flat(strict))
    if carry_one_to_one:
        kept = kept.unionByName(one)
    near = inheritance_gate(v2.where("kind = 'class'"), kept)
    parents = near.select(F.lit("class").alias("kind"), "v1_id", "v2_id")
    free1, free2 = cut(rest(a, kept, "v1_id")), cut(rest(b, kept, "v2_id"))
    unboosted = (threshold - INHERITANCE_BOOST) / (1 - INHERITANCE_BOOST)
    under = parent_gate(free1, free2, parents, likely(free1, free2, unboosted)).where("kind <> 'class'")
    late = stage("inheritance", free1, free2, boosted(by_kind), parents.unionByName(under))
    return sure.unionByName(simple.where(single)).unionByName(strict).unionByName(late)


#: The kinds that a report tells of.
REPORTED = ("class", "function", "parameter")


def report(mappings: DataFrame, v1: DataFrame | None = None, v2: DataFrame | None = None) -> DataFrame:
    """(kind, similarity, line): lines similarity|`v1`|`v2`| of a mapping table, similarity with four significant digits; attributes and results don't appear.

    With both versions' elements, lines with - for those that are in no mapping follow.
    """
    number = F.regexp_replace(F.format_string("%.4f", F.col("similarity")), r"(\.\d*?)0+$", "$1")
    number = F.when(F.endswith(number, F.lit(".")), F.concat(number, F.lit("0"))).otherwise(number)
    line = F.format_string("%s|`%s`|`%s`|", number, F.array_join("v1_ids", ", "), F.array_join("v2_ids", ", "))
    out = mappings.where(F.col("kind").isin(*REPORTED)).select("kind", "similarity", line.alias("line"))
    if v1 is None or v2 is None:
        return out
    held = mappings.select("kind", F.explode("v1_ids").alias("v1_id"), "v2_ids").select("kind", "v1_id", F.explode("v2_ids").alias("v2_id"))
    rest = unmapped(v1, v2, held).where(F.col("kind").isin(*REPORTED))
    alone = F.when(F.col("version") == 1, F.format_string("-|`%s`||", F.col("id"))).otherwise(F.format_string("-||`%s`|", F.col("id")))
    return out.unionByName(rest.select("kind", F.lit(None).cast("double").alias("similarity"), alone.alias("line")))
