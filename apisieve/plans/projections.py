"""The test tables seen as canonical ones: line items are calls of a shop's functions. They are not code; they give operators volume and a second opinion by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEEN = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread_over(spark: SparkSession) -> int:
    """Partitions for work that takes long by row: a table is one file of few row groups, which would leave it to as many tasks."""
    return max(2, 4 * spark.sparkContext.defaultParallelism)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """function_id by the part's brand, class_id by its type, a seen key, and the values passed."""
    line = read(spark, sf_dir, "lineitem").select(*SEEN, "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumn("function_id", F.concat(F.lit("shop/"), "p_brand")).withColumn("class_id", F.concat(F.lit("shop/"), "p_type")).withColumn("seen", F.struct(*SEEN))


CALLS_SQL = """calls AS (
  SELECT *, 'shop/' || p_brand AS function_id, 'shop/' || p_type AS class_id,
         struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_quantity, f := l_extendedprice) AS seen
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

#: name, Spark SQL for the value, DuckDB SQL for it, default.
PARAMETERS = [
    ("flag", "concat('''', l_returnflag, '''')", "'''' || l_returnflag || ''''", "'A'"),
    ("large", "if(l_quantity > 24, 'True', 'False')", "CASE WHEN l_quantity > 24 THEN 'True' ELSE 'False' END", None),
    ("bulk", "if(l_quantity > 10, 'True', 'False')", "CASE WHEN l_quantity > 10 THEN 'True' ELSE 'False' END", None),
    ("currency", "'''USD'''", "'''USD'''", "'USD'"),
    ("channel", "'''web'''", "'''web'''", "'api'"),
    ("factory", "concat('f(', l_suppkey % 7, ')')", "'f(' || (l_suppkey % 7)::VARCHAR || ')'", None),
    ("discount", "format_string('%.2f', l_discount)", "printf('%.2f', l_discount)", "0.00"),
    ("only", "'g(x)'", "'g(x)'", None),
]


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one function with the same arguments counted together, before any of them is taken apart: function_id, a column for each value, times, the first seen."""
    values = [f"{value} AS {name}" for name, value, _, _ in PARAMETERS]
    rows = calls(spark, sf_dir).selectExpr("function_id", "seen", *values)
    return rows.groupBy("function_id", *[name for name, *_ in PARAMETERS]).agg(F.count("*").alias("times"), F.min("seen").alias("seen"))


def bound(spark: SparkSession, sf_dir: str, grouped: DataFrame | None = None) -> DataFrame:
    """One row for each argument that a call writes out, with how often: those equal to the default are left out for flag and discount."""
    pairs = ", ".join(f"'{name}', {name}" for name, *_ in PARAMETERS)
    rows = (repeats(spark, sf_dir) if grouped is None else grouped).selectExpr("function_id", "seen", "times", f"stack({len(PARAMETERS)}, {pairs}) AS (name, value)")
    left_out = ((F.col("name") == "flag") & (F.col("value") == "'A'")) | ((F.col("name") == "discount") & (F.col("value") == "0.00"))
    return rows.where(~left_out).withColumn("parameter_id", F.concat_ws("/", "function_id", "name"))


BOUND_SQL = (
    CALLS_SQL
    + ",\nbound AS (\n"
    + "\n  UNION ALL ".join(f"SELECT function_id, seen, '{n}' AS name, {d} AS value, function_id || '/{n}' AS parameter_id FROM calls" + {"flag": " WHERE l_returnflag <> 'A'", "discount": " WHERE printf('%.2f', l_discount) <> '0.00'"}.get(n, "") for n, _, d, _ in PARAMETERS)
    + ")"
)


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = read(spark, sf_dir, "part").select(F.concat(F.lit("shop/"), "p_brand").alias("function_id")).distinct()
    rows = spark.createDataFrame([(n, d) for n, _, _, d in PARAMETERS], "name string, default_value string")
    return functions.join(F.broadcast(rows)).select("function_id", F.concat_ws("/", "function_id", "name").alias("parameter_id"), "name", "default_value", F.lit("POSITION_OR_NAME").alias("assigned_by"))


_DEFAULTS = ", ".join("('{}', {})".format(n, "NULL" if d is None else "'" + d.replace("'", "''") + "'") for n, _, _, d in PARAMETERS)
PARAMETERS_SQL = f"""parameters AS (
  SELECT DISTINCT 'shop/' || p_brand AS function_id, 'shop/' || p_brand || '/' || v.name AS parameter_id, v.name, v.default_value
  FROM part, (VALUES {_DEFAULTS}) v(name, default_value))"""
VALUES_SQL = """value_counts AS (SELECT parameter_id, value, count(*) AS n, min(seen) AS seen FROM bound GROUP BY 1, 2)"""
IMPLICIT_SQL = (
    BOUND_SQL + ",\n" + PARAMETERS_SQL + ",\n" + VALUES_SQL
    + """,
fc AS (SELECT function_id, count(*) AS calls FROM calls GROUP BY 1),
pc AS (SELECT parameter_id, count(*) AS passed FROM bound GROUP BY 1),
left_out AS (
  SELECT parameter_id, default_value AS value, coalesce(calls, 0) - coalesce(passed, 0) AS n
  FROM parameters LEFT JOIN fc USING (function_id) LEFT JOIN pc USING (parameter_id) WHERE default_value IS NOT NULL),
explicit_implicit AS (
  SELECT parameter_id, value, sum(n)::BIGINT AS n, min(seen) AS seen
  FROM (SELECT parameter_id, value, n, seen FROM value_counts UNION ALL SELECT parameter_id, value, n, NULL FROM left_out) GROUP BY 1, 2)"""
)
