"""Usage counts: how often classes, functions, parameters and values of a package are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: first_seen of implicit values: behind all that are written out.
LAST = (1 << 62)


def bind_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Arguments of calls bound to parameters: call_id, function_id, parameter_id, name, value.

    calls: call_id, function_id, n_implicit, positional array<string>, keywords array<struct<name, value>>.
    parameters: function_id, name, ordinal, assigned_by (position-only and ordinary ones are bound by
    position, after the implicit ones). Positional arguments beyond them are dropped; a parameter that is
    passed both ways takes the positional value; keywords of other names count as they are. Each call is bound
    within its row, against its function's positions, so no call is shuffled but to meet them.
    """
    slots = parameters.where(F.col("assigned_by").isin("IMPLICIT", "POSITION_ONLY", "POSITION_OR_NAME"))
    slots = slots.groupBy(F.col("function_id").alias("of")).agg(F.map_from_entries(F.collect_set(F.struct(F.col("ordinal").cast("int"), "name"))).alias("slots"))
    rows = calls.select("call_id", "function_id", "n_implicit", "positional", "keywords").join(slots, F.col("function_id") == F.col("of"), "left")
    place = lambda v, i: F.struct(F.element_at("slots", (i + F.col("n_implicit")).cast("int")).alias("name"), v.alias("value"))
    by_position = F.filter(F.transform(F.coalesce("positional", F.array().cast("array<string>")), place), lambda x: x["name"].isNotNull())
    rows = rows.withColumn("by_position", F.coalesce(by_position, F.array().cast("array<struct<name:string,value:string>>")))
    words = F.coalesce("keywords", F.array().cast("array<struct<name:string,value:string>>"))
    names = F.concat(F.transform("by_position", lambda x: x["name"]), F.transform(words, lambda k: k["name"]))
    # of several values under one name the first counts, and positions come before keywords
    first = lambda k, i: F.array_position(names, k["name"]) == F.size("by_position") + i + 1
    plain = F.transform(F.filter(words, first), lambda k: F.struct(k["name"].alias("name"), k["value"].alias("value")))
    bound = rows.select("call_id", "function_id", F.explode(F.concat("by_position", plain)).alias("b"))
    return bound.select("call_id", "function_id", F.concat_ws("/", "function_id", "b.name").alias("parameter_id"), "b.name", "b.value")


def count_usages(calls: DataFrame, bound: DataFrame, order: str = "call_id") -> DataFrame:
    """(kind, id, value, n, first_seen): a call adds one to its function, to its class if it is of a method, and to each bound parameter and value.

    calls: function_id, class_id (null for plain functions) and the order column; bound: parameter_id, value and the order column.
    Either may have a column times: how often the call is made, where equal ones were counted together.
    """
    seen = F.min(order).alias("first_seen")
    times = lambda rows: (F.sum("times") if "times" in rows.columns else F.count("*")).alias("n")
    functions = calls.groupBy(F.lit("function").alias("kind"), F.col("function_id").alias("id")).agg(times(calls), seen)
    classes = calls.where(F.col("class_id").isNotNull()).groupBy(F.lit("class").alias("kind"), F.col("class_id").alias("id")).agg(times(calls), seen)
    values = bound.groupBy(F.col("parameter_id").alias("id"), "value").agg(times(bound), seen)
    parameters = values.groupBy(F.lit("parameter").alias("kind"), "id").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    return classes.unionByName(functions).unionByName(parameters).withColumn("value", F.lit(None).cast("string")).unionByName(values.withColumn("kind", F.lit("value"))).select("kind", "id", "value", "n", "first_seen")


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sums of partial counts; what isn't above zero goes."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("kind", "id", "value").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen")).where("n > 0")


def pad_unused(catalogue: DataFrame, counts: DataFrame) -> DataFrame:
    """A count for every (kind, id) of the catalogue, 0 where none is known."""
    return catalogue.select("kind", "id").join(counts.where(F.col("value").isNull()).select("kind", "id", "n"), ["kind", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def remove_cascade(counts: DataFrame, removed: DataFrame) -> DataFrame:
    """Counts without the removed ids and all that they contain; containment is by prefix, so a/b1 goes with a/b.

    removed: prefix. For few removals (they are names to be taken out by hand), which are broadcast.
    """
    return counts.join(F.broadcast(removed.select("prefix")), F.startswith(counts["id"], F.col("prefix")), "left_anti")


def implicit_defaults(values: DataFrame, parameters: DataFrame, parameter_counts: DataFrame, function_counts: DataFrame) -> DataFrame:
    """Value counts with the uses of defaults that calls leave out: function's count less parameter's, added to the default's value. May be 0 or less.

    values: parameter_id, value, n, first_seen; parameters: parameter_id, function_id, default_value;
    counts: parameter_id or function_id, and n. Parameters without a default add nothing.
    """
    left_out = (
        parameters.where(F.col("default_value").isNotNull())
        .join(function_counts.withColumnRenamed("n", "calls"), "function_id", "left")
        .join(parameter_counts.withColumnRenamed("n", "passed"), "parameter_id", "left")
        .select("parameter_id", F.col("default_value").alias("value"), (F.coalesce("calls", F.lit(0)) - F.coalesce("passed", F.lit(0))).cast("long").alias("n"), F.lit(LAST).cast("long").alias("first_seen"))
    )
    both = values.select("parameter_id", "value", "n", F.col("first_seen").cast("long").alias("first_seen")).unionByName(left_out)
    return both.groupBy("parameter_id", "value").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))


def most_common(values: DataFrame, top: int | None = None) -> DataFrame:
    """Values with a count above zero and their rank by count, ties by first_seen and then value."""
    order = Window.partitionBy("parameter_id").orderBy(F.col("n").desc(), "first_seen", "value")
    ranked = values.where("n > 0").withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
