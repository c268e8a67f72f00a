"""The catalogue of a package: tables of modules, classes, functions, parameters, from one parse of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import names, types
from ..sources import files as source_files


def build(files: DataFrame, package: str, style: str = "plaintext") -> dict[str, DataFrame]:
    """modules, classes, functions, parameters, attributes, errors of files (module, content).

    Whether an element is public depends on re-exports by any file, so these are a table of their own, joined by qualified name.
    """
    parsed = cut(source_files.parse_declarations(files, package, style))  # parsed once for all tables
    again = parsed.select(F.explode("d.reexports").alias("r")).groupBy("r.qname").agg(F.array_sort(F.collect_set("r.module_id")).alias("reexported_by"))
    of = lambda f: parsed.select(F.explode(f"d.{f}").alias("x")).select("x.*")

    def published(rows: DataFrame) -> DataFrame:
        up = again.select(F.col("qname").alias("up"), F.lit(True).alias("up_again"))
        rows = rows.join(again, "qname", "left").withColumn("up", names.parent_qname("qname")).join(up, "up", "left")
        public = names.is_public(F.col("name"), F.col("qname"), F.col("reexported_by").isNotNull(), F.coalesce("up_again", F.lit(False)))
        return rows.withColumn("is_public", public).withColumn("reexported_by", F.coalesce("reexported_by", F.array().cast("array<string>"))).drop("up", "up_again")

    functions = published(of("functions"))
    classes = published(of("classes"))
    open_functions = functions.select(F.col("id").alias("function_id"), "is_public")
    parameters = of("parameters").join(open_functions, "function_id").withColumn("types", types.parse_type("docstring.type", "docstring.description"))
    return {
        "modules": parsed.where("d.module IS NOT NULL").select("d.module.*"), "classes": classes, "functions": functions, "parameters": parameters,
        "attributes": classes.select(F.col("id").alias("class_id"), F.explode("instance_attributes").alias("a")).select("class_id", "a.*"),
        "errors": parsed.where("d.error IS NOT NULL").select("module", "d.error"),
    }


def public_only(catalogue: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All modules, public classes with their public methods, public functions and their parameters."""
    functions = catalogue["functions"].where("is_public")
    methods = functions.select(F.col("id").alias("method"))
    kept = catalogue["classes"].where("is_public").select("id", F.posexplode("methods").alias("at", "method")).join(methods, "method").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "method"))), lambda m: m["method"]).alias("kept"))
    classes = catalogue["classes"].where("is_public").join(kept, "id", "left").withColumn("methods", F.coalesce("kept", F.array().cast("array<string>"))).drop("kept")
    return catalogue | {"functions": functions, "classes": classes, "parameters": catalogue["parameters"].where("is_public")}


def requirement(default_value: Column) -> Column:
    """optional for a parameter with a default, else required."""
    return F.when(default_value.isNotNull(), "optional").otherwise("required")


def summary(catalogue: dict[str, DataFrame]) -> DataFrame:
    """kind, total and public: counts of classes, functions and parameters."""
    one = lambda k, t: catalogue[t].agg(F.count("*").alias("total"), F.count_if("is_public").alias("public")).select(F.lit(k).alias("kind"), "total", "public")
    return one("class", "classes").unionByName(one("function", "functions")).unionByName(one("parameter", "parameters"))


def usages_of(client: DataFrame, catalogue: dict[str, DataFrame], package: str) -> tuple[DataFrame, DataFrame]:
    """(calls, bound) of client files (path, content), for count_usages.

    A call's qname is a function's, or a class's whose __init__ it runs; names that the package re-exports
    are followed to where they are declared. Implicit parameters are those that no argument meets: the first of
    methods, unless a class calls its method unbound.
    """
    from .usages import bind_arguments

    called = source_files.parse_calls(client, package).where("qname IS NOT NULL").withColumn("call_id", F.concat_ws(":", "path", F.format_string("%09d", "line"), F.format_string("%06d", "col")))
    f, c = catalogue["functions"], catalogue["classes"]
    direct = f.select("qname", F.col("id").alias("function_id"), F.when(F.col("parent_kind") == "class", F.col("parent_id")).alias("class_id"))
    made = c.select(F.col("qname"), F.col("id").alias("cid")).join(f.where("name = '__init__'").select(F.col("parent_id").alias("cid"), F.col("id").alias("function_id")), "cid").select("qname", "function_id", F.col("cid").alias("class_id"))
    known = direct.unionByName(made)
    short = catalogue["functions"].select("qname", "reexported_by").unionByName(c.select("qname", "reexported_by")).select("qname", F.explode("reexported_by").alias("by"))
    origin = F.regexp_replace(F.substring_index("by", "/", -1), r"\.__init__$", "")
    again = known.join(short, "qname").withColumn("qname", F.concat_ws(".", origin, names.last_name("qname"))).drop("by")
    held = c.select(F.col("id").alias("class_id"), F.col("name").alias("holder"), F.explode("reexported_by").alias("by"))
    methods = direct.join(held, "class_id").withColumn("qname", F.concat_ws(".", origin, "holder", names.last_name("qname"))).select("qname", "function_id", "class_id")
    target = known.unionByName(again).unionByName(methods).dropDuplicates(["qname", "function_id"])
    calls = called.join(target, "qname")
    implicit = catalogue["parameters"].groupBy("function_id").agg(F.count_if(F.col("assigned_by") == "IMPLICIT").cast("int").alias("n"))
    unbound = (F.col("class_id").isNotNull()) & ~F.col("instance") & ~F.endswith("function_id", F.lit("/__init__"))
    calls = calls.join(implicit, "function_id", "left").withColumn("n_implicit", F.when(unbound, 0).otherwise(F.coalesce("n", F.lit(0)))).drop("n")
    return calls, bind_arguments(calls, catalogue["parameters"])
