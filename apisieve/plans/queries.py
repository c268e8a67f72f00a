"""Queries by name, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import literals, names, similarity, stats, types
from ..operators import dependencies, graph, matching, suggest, usages
from ..sources import tables
from ..streaming import usage_stream
from . import projections as p

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


# ---------------------------------------------------------------- usage counts




@query(f"WITH {p.CALLS_SQL} SELECT function_id AS id, count(*) AS n FROM calls GROUP BY 1")
def usage_function_counts(spark, d):
    c = p.calls(spark, d)
    return usages.count_usages(c, p.bound(spark, d), "seen").where("kind = 'function'").select("id", "n")


@query(f"WITH {p.CALLS_SQL} SELECT class_id, function_id, count(*) AS n FROM calls GROUP BY GROUPING SETS ((class_id), (function_id), (class_id, function_id), ())")
def usage_class_function_rollup(spark, d):
    return p.calls(spark, d).groupingSets([["class_id"], ["function_id"], ["class_id", "function_id"], []], "class_id", "function_id").agg(F.count("*").alias("n"))


@query(f"WITH {p.BOUND_SQL} SELECT parameter_id AS id, count(*) AS n FROM bound GROUP BY 1")
def usage_parameter_counts(spark, d):
    return usages.count_usages(p.calls(spark, d), p.bound(spark, d), "seen").where("kind = 'parameter'").select("id", "n")


@query(f"WITH {p.BOUND_SQL} SELECT parameter_id AS id, value, count(*) AS n FROM bound GROUP BY 1, 2")
def usage_value_counts(spark, d):
    return usages.count_usages(p.calls(spark, d), p.bound(spark, d), "seen").where("kind = 'value'").select("id", "value", "n")


@query(
    f"""WITH {p.CALLS_SQL},
parts AS (SELECT function_id AS id, count(*) - CASE WHEN l_linestatus = 'O' THEN 0 ELSE 400 END AS n FROM calls GROUP BY function_id, l_linestatus)
SELECT id, sum(n)::BIGINT AS n FROM parts GROUP BY 1 HAVING sum(n) > 0"""
)
def usage_merge_partial_final(spark, d):
    """Two partial counts, one of them brought below zero for some."""
    c = p.calls(spark, d)
    part = lambda s, off: c.where(F.col("l_linestatus") == s).groupBy(F.col("function_id").alias("id")).agg((F.count("*") - off).alias("n"), F.min("seen").alias("first_seen")).select(F.lit("function").alias("kind"), "id", F.lit(None).cast("string").alias("value"), "n", "first_seen")
    return usages.merge_counts(part("O", 0), part("F", 400)).select("id", "n")


def _catalogue(spark, d) -> DataFrame:
    """Functions of all brands and as many that nobody calls."""
    known = p.read(spark, d, "part").select(F.concat(F.lit("shop/"), "p_brand").alias("id")).distinct()
    more = spark.range(20).select(F.concat(F.lit("shop/Unused#"), F.col("id").cast("string")).alias("id"))
    return known.unionByName(more).withColumn("kind", F.lit("function"))


_CATALOGUE_SQL = "catalogue AS (SELECT DISTINCT 'shop/' || p_brand AS id FROM part UNION ALL SELECT 'shop/Unused#' || range::VARCHAR FROM range(20))"


def _padded(spark, d) -> DataFrame:
    return usages.pad_unused(_catalogue(spark, d), usages.count_usages(p.calls(spark, d), p.bound(spark, d), "seen"))


@query(f"WITH {p.CALLS_SQL}, {_CATALOGUE_SQL}, n AS (SELECT function_id AS id, count(*) AS n FROM calls GROUP BY 1) SELECT 'function' AS kind, id, coalesce(n, 0) AS n FROM catalogue LEFT JOIN n USING (id)")
def usage_pad_unused(spark, d):
    return _padded(spark, d).select("kind", "id", "n")


@query(f"WITH {p.BOUND_SQL} SELECT parameter_id AS id, count(*) AS n FROM bound WHERE NOT starts_with(parameter_id, 'shop/Brand#1') GROUP BY 1")
def usage_remove_prefix_cascade(spark, d):
    """Removing Brand#1 also removes Brand#10 and its like: containment goes by prefix."""
    counts = usages.count_usages(p.calls(spark, d), p.bound(spark, d), "seen").where("kind = 'parameter'")
    return usages.remove_cascade(counts, values(spark, "('shop/Brand#1')", "prefix")).select("id", "n")


def _implicit(spark, d) -> DataFrame:
    """Value counts with implicit defaults. first_seen is a number: the rank of the earliest row among a parameter's values. All counts come from one table of repeated calls."""
    grouped = cut(p.repeats(spark, d))  # three counts read it
    v = p.bound(spark, d, grouped).groupBy("parameter_id", "value").agg(F.sum("times").alias("n"), F.min("seen").alias("seen"))
    v = v.withColumn("first_seen", F.row_number().over(Window.partitionBy("parameter_id").orderBy("seen")).cast("long")).drop("seen")
    pc = v.groupBy("parameter_id").agg(F.sum("n").alias("n"))
    fc = grouped.groupBy("function_id").agg(F.sum("times").alias("n"))
    return usages.implicit_defaults(v, p.parameters(spark, d), pc, fc)


@query(f"WITH {p.IMPLICIT_SQL} SELECT parameter_id, value, n FROM explicit_implicit")
def usage_implicit_default(spark, d):
    return _implicit(spark, d).select("parameter_id", "value", "n")


_TOP_SQL = f"""WITH {p.IMPLICIT_SQL},
ranked AS (
  SELECT parameter_id, value, n, row_number() OVER (PARTITION BY parameter_id ORDER BY n DESC, seen NULLS LAST, value) AS rank
  FROM explicit_implicit WHERE n > 0)"""


@query(f"{_TOP_SQL} SELECT parameter_id, value, n, rank FROM ranked WHERE rank <= 2")
def value_most_common_top2(spark, d):
    return usages.most_common(_implicit(spark, d), 2).select("parameter_id", "value", "n", "rank")


_LITERAL_SQL = r"""CASE WHEN {v} = 'None' THEN 'none' WHEN {v} IN ('True', 'False') THEN 'boolean'
 WHEN regexp_full_match({v}, '\s*[+-]?((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?\s*') OR regexp_full_match({v}, '\s*[+-]?(?i:nan|inf|infinity)\s*') THEN 'number'
 WHEN length({v}) > 0 AND starts_with({v}, '''') AND ends_with({v}, '''') THEN 'string' END"""

_CLASS_SQL = (
    _TOP_SQL
    + f""",
top AS (
  SELECT parameter_id, count(*) AS k, max(value) FILTER (rank = 1) AS v1, max(n) FILTER (rank = 1) AS n1, max(value) FILTER (rank = 2) AS v2, max(n) FILTER (rank = 2) AS n2
  FROM ranked GROUP BY 1),
lit AS (SELECT t.*, default_value, {_LITERAL_SQL.format(v="v1")} AS kind1 FROM top t JOIN parameters USING (parameter_id)),
tails AS (
  SELECT parameter_id, 2 * sum(exp(lgamma(n1 + n2 + 1) - lgamma(i + 1) - lgamma(n1 + n2 - i + 1) - (n1 + n2) * ln(2))) AS pv
  FROM (SELECT parameter_id, n1, n2, unnest(range(n1, n1 + n2 + 1)) AS i FROM lit WHERE k > 1 AND n1 <> n2) GROUP BY 1),
v AS (
  SELECT parameter_id AS target, kind1, v1,
    CASE WHEN k = 1 THEN CASE WHEN v1 = default_value THEN 'omitted' WHEN kind1 IS NOT NULL THEN 'constant' ELSE 'required' END
         WHEN kind1 IS NOT NULL AND pv <= 0.05 THEN 'optional' ELSE 'required' END AS variant
  FROM lit LEFT JOIN tails USING (parameter_id))"""
)


def _value_annotations(spark, d) -> DataFrame:
    return suggest.value_annotations(_implicit(spark, d), p.parameters(spark, d))


@query(
    _CLASS_SQL
    + """ SELECT target, variant, CASE WHEN variant IN ('constant', 'optional') THEN kind1 END AS default_value_type,
 CASE WHEN variant IN ('constant', 'optional') THEN CASE WHEN kind1 = 'string' THEN v1[2:-2] ELSE v1 END END AS default_value FROM v"""
)
def value_annotation_class(spark, d):
    return _value_annotations(spark, d).select("target", "variant", "default_value_type", "default_value")


@query(
    _CLASS_SQL.replace("v AS (\n  SELECT parameter_id AS target, kind1, v1,", "v AS (\n  SELECT parameter_id AS target, kind1, v1, n1, n2, v2, k, pv,")
    + """ SELECT target, CASE WHEN variant = 'omitted' THEN 'I omitted this parameter because it is always set to the original default value (' || v1 || ').'
  WHEN variant = 'constant' THEN 'I replaced this parameter with a constant because it is always set to the same literal value (' || v1 || ').'
  WHEN variant = 'optional' THEN 'I made this parameter optional because there is a statistically significant most common value (p-value ' || printf('%.2f%%', pv * 100) || ' <= significance level 5%).'
  WHEN k = 1 THEN 'I made this parameter required because, even though it is always set to the same value (' || v1 || '), that value is not a literal.'
  WHEN kind1 IS NULL THEN 'I made this parameter required because the most common value (' || v1 || ') is not a literal.'
  WHEN n1 = n2 THEN 'I made this parameter required because there is no single most common value (' || v1 || ' and ' || v2 || ' are both used ' || n1 || CASE WHEN n1 = 1 THEN ' time' ELSE ' times' END || ').'
  ELSE 'I made this parameter required because there is no statistically significant most common value (p-value (' || printf('%.2f%%', pv * 100) || ') > significance level (5%).' END AS comment FROM v"""
)
def value_annotation_comments(spark, d):
    """What each annotation says to its reader."""
    return _value_annotations(spark, d).select("target", "comment")


@query(_CLASS_SQL + " SELECT variant, count(*) AS n FROM v GROUP BY 1")
def value_annotation_summary(spark, d):
    return _value_annotations(spark, d).groupBy("variant").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT p_partkey, p_partkey + 1 AS n, (p_partkey + 2) // 2 + ((p_partkey + 1) // 2 * p_size) // 100 AS k FROM part)
SELECT p_partkey, k, n, round(2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) + 1e-9, 6) AS p FROM (SELECT *, unnest(range(k, n + 1)) AS i FROM t) GROUP BY 1, 2, 3"""
)
def value_binomial_pvalue(spark, d):
    """k of n uses for every part: n grows with its number, k lies above half of it by its size."""
    n = F.col("p_partkey") + 1
    rows = p.read(spark, d, "part").repartition(p.spread_over(spark)).select("p_partkey", F.expr("(p_partkey + 2) div 2 + ((p_partkey + 1) div 2 * p_size) div 100").alias("k"), n.alias("n"))
    return rows.select("p_partkey", "k", "n", F.round(stats.fair_coin_p(F.col("k"), F.col("n")) + 1e-9, 6).alias("p"))


@query(f"WITH {p.CALLS_SQL}, {_CATALOGUE_SQL} SELECT 'remove' AS kind, id AS target, 'I removed this function because it has no known usages.' AS comment FROM catalogue WHERE id NOT IN (SELECT function_id FROM calls)")
def remove_annotations(spark, d):
    return suggest.remove_annotations(_padded(spark, d))


# ---------------------------------------------------------------- types


_NAME_SQL = "concat(CASE WHEN p_partkey % 3 = 0 THEN '_' ELSE '' END, replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '__' END), '_', p_type)"


@query(
    f"""SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(name, '_') IF w <> ''], '') AS enum_name,
 CASE WHEN i = '' OR regexp_matches(i, '^[0-9]') THEN '_' || i ELSE i END AS instance_name
FROM (SELECT p_partkey, name, array_to_string([y FOR y IN [upper(regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')) FOR w IN regexp_split_to_array(p_size || '-' || p_brand || '+.9', '[_.-]')] IF y <> ''], '_') AS i FROM (SELECT *, {_NAME_SQL} AS name FROM part))"""
)
def enum_names(spark, d):
    rows = p.read(spark, d, "part").withColumn("name", F.expr(_NAME_SQL))
    value = F.concat(F.col("p_size").cast("string"), F.lit("-"), "p_brand", F.lit("+.9"))
    return rows.select("p_partkey", types.enum_name(F.col("name")).alias("enum_name"), types.enum_instance_name(value).alias("instance_name"))


_TEXTS = """CASE p_partkey % 5 WHEN 0 THEN concat('Float in the range [0, ', p_size, ']') WHEN 1 THEN concat('int in range (', p_size, ', ', p_size + 5, '] here') WHEN 2 THEN concat('is of interval of [-1.5, infinity) ', p_name)
 WHEN 3 THEN concat('float in the range (negative_infinity, ', p_size, ')') ELSE p_name END"""


@query(
    """SELECT p_partkey, p_partkey % 5 = 1 AS discrete, [0, p_size, -1.5, 0][p_partkey % 5 + 1]::DOUBLE AS lo, [0, 1, 0, 2][p_partkey % 5 + 1] AS lo_type, [p_size, p_size + 5, 0, p_size][p_partkey % 5 + 1]::DOUBLE AS hi, [0, 0, 2, 1][p_partkey % 5 + 1] AS hi_type
FROM part WHERE p_partkey % 5 < 4"""
)
def boundary_from_text(spark, d):
    """Stated ranges of all descriptions, as intervals; descriptions without one give no row."""
    rows = p.read(spark, d, "part").withColumn("b", types.boundary(F.expr(_TEXTS))).where("b IS NOT NULL").withColumn("i", types.interval(F.col("b")))
    return rows.select("p_partkey", F.col("i.isDiscrete").alias("discrete"), F.col("i.lowerIntervalLimit").alias("lo"), F.col("i.lowerLimitType").alias("lo_type"), F.col("i.upperIntervalLimit").alias("hi"), F.col("i.upperLimitType").alias("hi_type"))


@query(
    """SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [p_type, p_brand] WHEN 1 THEN [p_type, 'None', p_brand] WHEN 2 THEN [p_type] ELSE ['array-like', 'None'] END) AS member FROM part"""
)
def type_split_or(spark, d):
    text = "CASE p_partkey % 4 WHEN 0 THEN concat(p_type, ' or ', p_brand) WHEN 1 THEN concat(p_type, ', None, or ', p_brand) WHEN 2 THEN concat(p_type, ', default=', p_size) ELSE 'array-like,  or   None' END"
    rows = p.read(spark, d, "part").withColumn("type", F.expr(text))
    return rows.select("p_partkey", F.explode(types.simple_types(F.col("type"))).alias("member"))


@query(_CLASS_SQL + " SELECT parameter_id, name FROM parameters WHERE NOT EXISTS (SELECT 1 FROM v WHERE target = parameter_id AND variant = 'constant')")
def exclude_constant_enum(spark, d):
    """Parameters that may become enums: those that aren't constant."""
    return suggest._not_constant(p.parameters(spark, d), _value_annotations(spark, d)).select("parameter_id", "name")


@query(
    _CLASS_SQL
    + r""" SELECT parameter_id AS target, upper(name[1]) || name[2:] AS enum_name, 'API,WEB' AS instances FROM parameters
WHERE name IN ('channel', 'currency') AND NOT EXISTS (SELECT 1 FROM v WHERE target = parameter_id AND variant = 'constant')"""
)
def enum_annotations(spark, d):
    one = F.array(F.struct(F.lit("EnumType").alias("kind"), F.array(F.lit("web"), F.lit("api")).alias("values"), F.lit("{'web', 'api'}").alias("full_match")))
    rows = p.parameters(spark, d).where(F.col("name").isin("channel", "currency")).withColumn("types", one)
    return suggest.enum_annotations(rows, _value_annotations(spark, d)).select("target", "enum_name", F.array_join(F.transform("pairs", lambda x: x["instanceName"]), ",").alias("instances"))


@query(_CLASS_SQL + " SELECT parameter_id AS target, 0.0::DOUBLE AS lo, 0 AS lo_type, 1 AS hi_type FROM parameters WHERE name IN ('discount', 'channel') AND NOT EXISTS (SELECT 1 FROM v WHERE target = parameter_id AND variant = 'constant')")
def boundary_annotations(spark, d):
    b = types.boundary(F.lit("float in the range [0, 1)"))
    member = F.struct(F.lit("BoundaryType").alias("kind"), *[b[c].alias(c) for c in ("base_type", "min", "max", "min_inclusive", "max_inclusive", "full_match")])
    rows = p.parameters(spark, d).where(F.col("name").isin("discount", "channel")).withColumn("types", F.array(member))
    out = suggest.boundary_annotations(rows, _value_annotations(spark, d))
    return out.select("target", F.col("interval.lowerIntervalLimit").alias("lo"), F.col("interval.lowerLimitType").alias("lo_type"), F.col("interval.upperLimitType").alias("hi_type"))


# ---------------------------------------------------------------- names

_QNAME_SQL = "concat('pkg.', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END, 'mod', p_size, '.', CASE WHEN p_partkey % 3 = 0 THEN '_f' WHEN p_partkey % 3 = 1 THEN '__init__' ELSE 'f' END)"


@query(
    """SELECT p_partkey, p_partkey % 3 <> 0 AND (p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 2 = 1) AS public, p_partkey % 2 = 1 AND p_partkey % 3 = 2 AS open_module FROM part"""
)
def public_filter(spark, d):
    """Every second module and every third name is private; every fifth element is re-exported, every seventh has such a parent."""
    q = F.col("qname")
    rows = p.read(spark, d, "part").withColumn("qname", F.expr(_QNAME_SQL))
    public = names.is_public(names.last_name(q), q, F.expr("p_partkey % 5 = 0"), F.expr("p_partkey % 7 = 0"))
    return rows.select("p_partkey", public.alias("public"), names.is_public_module(q).alias("open_module"))


@query(
    r"""SELECT id, regexp_replace(id, '/[^/]*$', '') AS parent, len(string_split(id, '/')) AS depth, string_split(q, '.')[-1] AS name, regexp_replace(q, '\.[^.]*$', '') AS parent_q, len(string_split(id, '/')) = 3 AS global_function
FROM (SELECT 'shop/' || c_mktsegment || '/' || c_name AS id, 'shop.' || c_mktsegment || '.' || c_name AS q FROM customer)"""
)
def id_parent_ops(spark, d):
    rows = p.read(spark, d, "customer").select(names.make_id(F.lit("shop"), "c_mktsegment", "c_name").alias("id"), F.concat_ws(".", F.lit("shop"), "c_mktsegment", "c_name").alias("q"))
    return rows.select("id", names.parent_id("id").alias("parent"), names.depth(F.col("id")).alias("depth"), names.last_name(F.col("q")).alias("name"), names.parent_qname("q").alias("parent_q"), names.is_global_function(F.col("id")).alias("global_function"))


# ---------------------------------------------------------------- two versions


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Parts as parameters, and an edited second version: some gone, some renamed, some of another size."""
    part = p.read(spark, d, "part").select(F.lit("parameter").alias("kind"), F.concat(F.lit("shop/p"), F.col("p_partkey").cast("string")).alias("id"), "p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    v2 = part.where("p_partkey % 7 <> 0").withColumn("size", F.expr("if(p_partkey % 5 = 0, size + 1, size)")).withColumn("id", F.expr("if(p_partkey % 11 = 0, concat(id, '_new'), id)"))
    return part, v2


_V_SQL = """v1 AS (SELECT 'parameter' AS kind, 'shop/p' || p_partkey AS id, p_name AS name, p_size AS size FROM part),
v2 AS (SELECT 'parameter' AS kind, 'shop/p' || p_partkey || CASE WHEN p_partkey % 11 = 0 THEN '_new' ELSE '' END AS id, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 7 <> 0)"""


@query(f"WITH {_V_SQL} SELECT v1.kind, v1.id FROM v1 JOIN v2 ON v1.id = v2.id AND v1.size = v2.size AND v1.name = v2.name")
def unchanged_mapping(spark, d):
    v1, v2 = _versions(spark, d)
    return matching.unchanged(v1, v2, ["name", "size"])


@query(
    f"""WITH {_V_SQL}, m AS (SELECT v1.id FROM v1 JOIN v2 ON v1.id = v2.id AND v1.size = v2.size AND v1.name = v2.name)
SELECT kind, 1 AS version, id FROM v1 WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT kind, 2, id FROM v2 WHERE id NOT IN (SELECT id FROM m)"""
)
def unmapped_elements(spark, d):
    v1, v2 = _versions(spark, d)
    same = matching.unchanged(v1, v2, ["name", "size"]).select("kind", F.col("id").alias("v1_id"), F.col("id").alias("v2_id"))
    return matching.unmapped(v1, v2, same).select("kind", "version", "id")


_SIM_SQL = """n AS (SELECT DISTINCT p_name AS name FROM part),
pairs AS (
  SELECT a.name AS v1_id, b.name AS v2_id, 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name), 1) AS similarity
  FROM n a, n b WHERE 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name), 1) >= 0.61)"""


def _name_pairs(spark, d) -> DataFrame:
    n = p.read(spark, d, "part").select(F.lit("function").alias("kind"), F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    return matching.short_edit_pairs(n, n)


@query(f"WITH {_SIM_SQL} SELECT v1_id, v2_id, round(similarity, 6) AS similarity FROM pairs")
def name_similarity_pairs(spark, d):
    return _name_pairs(spark, d).select("v1_id", "v2_id", F.round("similarity", 6).alias("similarity"))


_GAP_SQL = f"""WITH {_SIM_SQL},
l AS (SELECT v1_id, list({{'s': similarity, 'i': v2_id}} ORDER BY similarity DESC, v2_id) AS c FROM pairs GROUP BY 1)"""


@query(f"{_GAP_SQL} SELECT v1_id, len(c) AS n, round(c[1].s, 6) AS best, len(c) > 1 AND c[1].s - c[2].s < 0.23 AS merged FROM l")
def gap_prefix_merge(spark, d):
    pairs = _name_pairs(spark, d).withColumn("ord1", F.col("v1_id")).withColumn("ord2", F.col("v2_id"))
    merged = matching.merge_prefix(pairs)
    best = pairs.groupBy("v1_id").agg(F.count("*").alias("n"), F.round(F.max("similarity"), 6).alias("best"))
    return merged.join(best, "v1_id").select("v1_id", "n", "best", (F.size("v2_ids") > 1).alias("merged"))


@query(
    """SELECT p_partkey, CASE WHEN a > 1 AND b > 1 THEN 'n:m' WHEN a > 1 THEN 'n:1' WHEN b > 1 THEN '1:n' ELSE '1:1' END AS shape, CASE WHEN (a > 1 AND b > 1) OR s < 75 THEN 'unsure' ELSE 'reliable' END AS store,
 CASE WHEN NOT (a > 1 AND b > 1) AND s >= 75 AND s < 85 THEN 'unsure' ELSE '' END AS review FROM (SELECT p_partkey, 50 + p_size AS s, p_partkey % 3 + 1 AS a, p_partkey % 2 + 1 AS b FROM part)"""
)
def similarity_routing(spark, d):
    ids = lambda n: F.transform(F.sequence(F.lit(1), F.expr(n)), lambda i: i.cast("string"))
    rows = p.read(spark, d, "part").select("p_partkey", ((F.col("p_size") + 50) / 100).alias("similarity"), ids("CAST(p_partkey % 3 + 1 AS INT)").alias("v1_ids"), ids("CAST(p_partkey % 2 + 1 AS INT)").alias("v2_ids"))
    return matching.route(matching.shape(rows)).select("p_partkey", "shape", "store", "review")


_DEFAULTS_SQL = "CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(p_size, '.5') WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END WHEN 3 THEN concat(chr(39), p_brand, chr(39)) WHEN 4 THEN 'None' END"


@query(
    f"""WITH v AS (SELECT p_partkey, p_partkey % 6 AS form, p_size, p_brand, {_DEFAULTS_SQL.replace("STRING", "VARCHAR")} AS v FROM part)
SELECT a.p_partkey, CASE WHEN a.v IS NULL AND b.v IS NULL THEN -1 WHEN a.v IS NULL OR b.v IS NULL THEN 0 WHEN a.form <> b.form THEN CASE WHEN a.form IN (0, 1) AND b.form IN (0, 1) AND a.v::DOUBLE = b.v::DOUBLE THEN 1 ELSE 0 END WHEN a.v = b.v THEN 1 WHEN a.form = 1 THEN 0
  WHEN a.form = 2 THEN 1 ELSE 0.5 END::DOUBLE AS similarity FROM v a JOIN v b ON b.p_partkey = a.p_partkey + 6 * (1 + a.p_size % 2) + CASE WHEN a.p_size % 5 = 0 THEN 1 ELSE 0 END"""
)
def default_value_similarity(spark, d):
    """Defaults of every part and one some places on, of the same form or the next: whole and broken numbers, flags, texts, None, nothing."""
    v = p.read(spark, d, "part").select("p_partkey", "p_size", F.expr(_DEFAULTS_SQL).alias("v"))
    rows = v.alias("a").join(v.alias("b"), F.expr("b.p_partkey = a.p_partkey + 6 * (1 + a.p_size % 2) + CASE WHEN a.p_size % 5 = 0 THEN 1 ELSE 0 END"))
    return rows.select("a.p_partkey", literals.default_similarity(F.col("a.v"), F.col("b.v")).alias("similarity"))


#: Similarities of parameter assignments (fixed values): rows and columns in the order of the kinds above them.
_ASSIGNED = ["IMPLICIT", "POSITION_ONLY", "POSITION_OR_NAME", "NAME_ONLY", "POSITIONAL_VARARG", "NAMED_VARARG"]


@query(
    f"""WITH t(k, v, b) AS (VALUES ('IMPLICIT', -1, 0.0), ('POSITION_ONLY', 0, 0.0), ('POSITION_OR_NAME', 0, 0.5), ('NAME_ONLY', 0, 1.0), ('POSITIONAL_VARARG', 1, 0.0), ('NAMED_VARARG', 1, 1.0)),
p AS (SELECT p_partkey, {_ASSIGNED!r}[p_partkey % 6 + 1] AS a, {_ASSIGNED!r}[p_size % 6 + 1] AS b FROM part)
SELECT p_partkey, round(1 - 0.3 * CASE WHEN x.k = y.k THEN 0 WHEN x.v < 0 THEN 1 + y.v * (1 + (y.b = 1)::INT) WHEN y.v < 0 THEN 1 + x.v * (1 + (x.b = 1)::INT) ELSE abs(x.v - y.v) + abs(x.b - y.b) END, 6)::DOUBLE AS similarity FROM p JOIN t x ON p.a = x.k JOIN t y ON p.b = y.k"""
)
def assignment_similarity(spark, d):
    kind = lambda c: F.element_at(F.array(*[F.lit(k) for k in _ASSIGNED]), (F.col(c) % 6 + 1).cast("int"))
    return p.read(spark, d, "part").select("p_partkey", similarity.assignment_similarity(kind("p_partkey"), kind("p_size")).alias("similarity"))


_LITERAL_TEXT = """CASE p_partkey % 10 WHEN 0 THEN 'None' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END WHEN 2 THEN CAST(p_size AS STRING) WHEN 3 THEN concat('-', p_size, '.5e3') WHEN 4 THEN concat(p_size, '_000')
 WHEN 5 THEN concat(chr(39), p_brand, chr(39)) WHEN 6 THEN concat('f(', p_size, ')') WHEN 7 THEN '' WHEN 8 THEN concat('"', p_brand, '"') ELSE concat(' .', p_size, ' ') END"""


@query("SELECT p_partkey, ['none', 'boolean', 'number', 'number', 'number', 'string', NULL, NULL, NULL, 'number'][p_partkey % 10 + 1] AS kind FROM part")
def default_literal_kind(spark, d):
    rows = p.read(spark, d, "part").withColumn("value", F.expr(_LITERAL_TEXT))
    return rows.select("p_partkey", literals.kind(F.col("value")).alias("kind"))


@query("SELECT n_name AS target, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS mapping FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def mapping_first_match(spark, d):
    """Nations as annotated elements, customers as mappings in the order of their balance: the first that touches a nation decides."""
    c = p.read(spark, d, "customer").join(F.broadcast(p.read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    mappings = c.select(F.lit("class").alias("kind"), F.array("n_name").alias("v1_ids"), F.struct(-F.col("c_acctbal"), "c_custkey").alias("ord"), F.col("c_custkey").alias("mapping"))
    annotations = p.read(spark, d, "nation").select(F.col("n_name").alias("target"))
    return matching.first_match(annotations, mappings).select("target", "mapping")


_REVIEW_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'correct' WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN 'unsure' ELSE 'wrong' END"


@query(
    f"""WITH t AS (SELECT o_orderstatus AS kind, o_custkey AS target, floor(o_totalprice / 100000)::INT::VARCHAR AS payload, {_REVIEW_SQL} AS r FROM orders),
o AS (SELECT *, CASE r WHEN 'correct' THEN 0 WHEN '' THEN 1 WHEN 'unsure' THEN 2 ELSE 3 END AS o FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY kind, target ORDER BY o, payload) AS nth FROM o),
g AS (SELECT kind, target, max(payload) FILTER (nth = 1) AS payload, max(r) FILTER (nth = 1) AS r, count(*) AS n, count(DISTINCT payload) AS k FROM f GROUP BY 1, 2)
SELECT kind, target, payload, k - 1 AS conflicts, CASE WHEN k > 1 THEN 'unsure' ELSE r END AS reviewResult, n FROM g"""
)
def duplicate_resolution(spark, d):
    """Orders as annotations of their customers, the same ones several times."""
    rows = p.read(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("target"), F.floor(F.col("o_totalprice") / 100000).cast("int").cast("string").alias("payload"), F.expr(_REVIEW_SQL).alias("reviewResult"))
    return matching.duplicates(rows).withColumn("conflicts", F.size("conflicts").cast("long"))


# ---------------------------------------------------------------- graph


def _edges(spark, d) -> DataFrame:
    """Orders as functions: each calls its customer's next one, and in the building segment the last calls the first."""
    o = p.read(spark, d, "orders").join(p.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = F.when(F.col("c_mktsegment") == "BUILDING", F.first("o_orderkey").over(w))
    rows = o.select(F.col("o_orderkey").alias("src"), F.coalesce(F.lead("o_orderkey").over(w), first).alias("dst"))
    return rows.where("dst IS NOT NULL AND dst <> src")  # a customer's lie together; what reads them leaves out repeated ones


_EDGES_SQL = """e AS (
  SELECT o_orderkey AS src, coalesce(lead(o_orderkey) OVER w, CASE WHEN c_mktsegment = 'BUILDING' THEN first_value(o_orderkey) OVER w END) AS dst
  FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS (SELECT DISTINCT src, dst FROM e WHERE dst IS NOT NULL AND src <> dst)"""
_REACH_SQL = f"""WITH RECURSIVE {_EDGES_SQL},
reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, x.dst FROM reach r JOIN edges x ON r.dst = x.src)"""


@query(f"{_REACH_SQL} SELECT src, dst FROM reach")
def call_graph_closure(spark, d):
    return graph.closure(_edges(spark, d))


@query(f"{_REACH_SQL} SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def call_graph_cycles(spark, d):
    return graph.cycles(_edges(spark, d))


_REASONS_SQL = """r AS (SELECT o_orderkey AS fn, 'FileWrite.' || o_orderpriority AS reason, 'FileWrite' AS kind FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT o_orderkey, 'NonLocalVariableRead.' || o_orderstatus, 'NonLocalVariableRead' FROM orders WHERE o_totalprice > 200000)"""


def _reasons(spark, d) -> DataFrame:
    """Finished orders write a file, dear ones read a variable."""
    o = p.read(spark, d, "orders")
    row = lambda k, c: (F.col("o_orderkey").alias("fn"), F.concat(F.lit(k + "."), c).alias("reason"), F.lit(k).alias("kind"))
    return o.where("o_orderstatus = 'F'").select(*row("FileWrite", "o_orderpriority")).unionByName(o.where("o_totalprice > 200000").select(*row("NonLocalVariableRead", "o_orderstatus"))).distinct()


@query(
    f"""{_REACH_SQL}, {_REASONS_SQL}, f AS (SELECT o_orderkey AS fn FROM orders),
every AS (SELECT fn, reason FROM r UNION SELECT src, reason FROM reach JOIN r ON dst = fn)
SELECT f.fn, count(reason) = 0 AS is_pure, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM f LEFT JOIN every USING (fn) GROUP BY 1"""
)
def purity_propagation(spark, d):
    functions = p.read(spark, d, "orders").select(F.col("o_orderkey").alias("fn"))
    return graph.propagate(functions, _edges(spark, d), _reasons(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""{_REACH_SQL}, {_REASONS_SQL}, every AS (SELECT fn, kind, reason FROM r UNION SELECT src, kind, reason FROM reach JOIN r ON dst = fn)
SELECT fn, kind, count(DISTINCT reason) AS n FROM every GROUP BY 1, 2"""
)
def purity_reason_counts(spark, d):
    every = graph.spread(_edges(spark, d), _reasons(spark, d))
    return graph.reason_counts(every)


@query(
    """SELECT r.event_id AS read_id, count(*) AS definitions, min(w.event_id) AS first_definition FROM events r JOIN events w ON r.user_id = w.user_id AND w.ts <= r.ts
WHERE r.event_type = 'purchase' AND w.event_type = 'signup' GROUP BY 1"""
)
def reads_before_use(spark, d):
    """A local read sees all earlier definitions of its name in its function: here a user's purchases and the signups before them."""
    e = p.read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    r, w = e.where("event_type = 'purchase'").alias("r"), e.where("event_type = 'signup'").alias("w")
    rows = r.join(w, (F.col("r.user_id") == F.col("w.user_id")) & (F.col("w.ts") <= F.col("r.ts")))
    return rows.groupBy(F.col("r.event_id").alias("read_id")).agg(F.count("*").alias("definitions"), F.min("w.event_id").alias("first_definition"))


_MODE_SQL = "concat(substring('rwaxz', CAST(p_partkey % 5 AS INT) + 1, 1), CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'b' WHEN 2 THEN 't+' ELSE '+b' END)"


@query(
    f"""SELECT p_partkey, {_MODE_SQL} AS mode, CASE WHEN p_partkey % 5 = 4 THEN 'UNKNOWN' WHEN p_size % 4 > 1 THEN 'READ_WRITE' WHEN p_partkey % 5 = 0 THEN 'READ' ELSE 'WRITE' END AS effect FROM part"""
)
def open_mode_effects(spark, d):
    rows = p.read(spark, d, "part").withColumn("mode", F.expr(_MODE_SQL))
    return rows.join(F.broadcast(tables.frame(spark, "open_modes")), "mode", "left").select("p_partkey", "mode", F.coalesce("effect", F.lit("UNKNOWN")).alias("effect"))


# ---------------------------------------------------------------- what the streaming operators give on a whole table


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    return usage_stream.windowed_counts(p.read(spark, d, "events").select("ts", "event_type"), key="event_type")


@query(
    """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, session"""
)
def stream_sessions(spark, d):
    return usage_stream.sessions(p.read(spark, d, "events").select("ts", "user_id"))


_CLAUSES = """CASE p_partkey % 5 WHEN 0 THEN concat('Ignored when `mode` is ', p_brand) WHEN 1 THEN concat('The size of ', p_name, '. If mode is None, then ', p_size, ' rows are drawn') WHEN 2 THEN 'If mode == "x", a ValueError is raised.'
 WHEN 3 THEN 'When other is set, nothing happens.' ELSE concat('About ', p_name, '.') END"""


@query(
    """WITH f AS (SELECT *, 'shop/' || p_brand AS function_id, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part)
SELECT function_id, function_id || '/' || CASE WHEN first THEN 'mode' ELSE 'p' || p_partkey END AS parameter_id, function_id || '/mode' AS dependee_id, CASE p_partkey % 5 WHEN 1 THEN 1 ELSE 0 END AS nth,
 CASE p_partkey % 5 WHEN 0 THEN 'when mode is ' || p_brand WHEN 1 THEN 'If mode is None' ELSE 'If mode equals x' END AS condition, CASE p_partkey % 5 WHEN 0 THEN 'Ignored' WHEN 1 THEN 'then ' || p_size || ' rows are drawn' ELSE 'a ValueError is raised' END AS action,
 ['other', 'is_none', 'has_value'][p_partkey % 5 + 1] AS condition_kind, CASE p_partkey % 5 WHEN 0 THEN 'is_ignored' WHEN 1 THEN 'other' ELSE 'is_illegal' END AS action_kind
FROM f WHERE p_partkey % 5 < 3"""
)
def sibling_dependencies(spark, d):
    """Brands as functions, parts as their parameters, of which the first is called mode: clauses about it, sentence by sentence."""
    part = p.read(spark, d, "part").withColumn("function_id", F.concat(F.lit("shop/"), "p_brand"))
    first = part.groupBy("function_id").agg(F.min("p_partkey").alias("first"))
    rows = part.join(F.broadcast(first), "function_id").withColumn("name", F.when(F.col("p_partkey") == F.col("first"), "mode").otherwise(F.concat(F.lit("p"), "p_partkey")))
    return dependencies.sibling_dependencies(rows.select("function_id", F.concat_ws("/", "function_id", "name").alias("parameter_id"), "name", F.expr(_CLAUSES).alias("description")))
