"""The JSON files that catalogues, usage counts and annotations are exchanged in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

API_VERSION, USAGE_VERSION, ANNOTATION_VERSION = 1, 1, 2
#: Functions that a catalogue of one document has at most; those in each document of a larger one, about.
ONE_DOCUMENT, PART_DOCUMENT = 50_000, 5_000

_PARAM = f"struct<id:string,name:string,qname:string,default_value:string,assigned_by:string,is_public:boolean,docstring:{schema.DOC}>"
API = (
    "schemaVersion int, distribution string, package string, version string, "
    "modules array<struct<id:string,name:string,imports:array<struct<module:string,alias:string>>,from_imports:array<struct<module:string,declaration:string,alias:string>>,classes:array<string>,functions:array<string>>>, "
    "classes array<struct<id:string,name:string,qname:string,decorators:array<string>,superclasses:array<string>,methods:array<string>,is_public:boolean,reexported_by:array<string>,description:string,docstring:string,code:string>>, "
    f"functions array<struct<id:string,name:string,qname:string,decorators:array<string>,is_public:boolean,reexported_by:array<string>,description:string,docstring:string,code:string,parameters:array<{_PARAM}>>>"
)


def read_api(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """modules, classes, functions, parameters and header; missing fields take their defaults: public, POSITION_OR_NAME, the last part of the qname."""
    raw = spark.read.schema(API).option("multiLine", True).json(path)
    of = lambda f: raw.select(F.explode(f).alias("x")).select("x.*")
    functions = of("functions").withColumn("name", F.coalesce("name", F.substring_index("qname", ".", -1))).withColumn("is_public", F.coalesce("is_public", F.lit(True)))
    parameters = functions.select(F.col("id").alias("function_id"), F.posexplode("parameters").alias("ordinal", "p")).select("function_id", "ordinal", "p.*")
    parameters = parameters.withColumn("assigned_by", F.coalesce("assigned_by", F.lit("POSITION_OR_NAME"))).withColumn("is_public", F.coalesce("is_public", F.lit(True)))
    classes = of("classes").withColumn("name", F.coalesce("name", F.substring_index("qname", ".", -1))).withColumn("is_public", F.coalesce("is_public", F.lit(True)))
    return {"header": raw.select("schemaVersion", "distribution", "package", "version").distinct(), "modules": of("modules"), "classes": classes, "functions": functions.drop("parameters"), "parameters": parameters}


def write_api(catalogue: dict[str, DataFrame], header: tuple[str, str, str], path: str) -> None:
    """One JSON document, elements sorted by id. A catalogue of more than ONE_DOCUMENT functions, which is more than one library's, becomes several
    such documents, a file each, with the same header and elements dealt by their ids: no task holds more than about PART_DOCUMENT functions. read_api takes either."""
    spark, n = catalogue["functions"].sparkSession, catalogue["functions"].count()
    documents = 1 if n <= ONE_DOCUMENT else -(-n // PART_DOCUMENT)
    p = catalogue["parameters"].groupBy("function_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "name", "qname", "default_value", "assigned_by", "is_public", "docstring"))).alias("p"))
    inner = F.transform(F.coalesce("p", F.array().cast(f"array<struct<ordinal:int,{_PARAM[7:]}>")), lambda x: F.struct(*[x[c].alias(c) for c in ("id", "name", "qname", "default_value", "assigned_by", "is_public", "docstring")]))
    f = catalogue["functions"].join(p, F.col("id") == F.col("function_id"), "left").withColumn("parameters", inner)
    f = f.select("id", "name", "qname", "decorators", "is_public", "reexported_by", "description", "docstring", "code", "parameters")
    c = catalogue["classes"].select("id", "name", "qname", "decorators", "superclasses", "methods", "is_public", "reexported_by", "description", "docstring", "code")
    rows = spark.range(documents).select(F.col("id").alias("document"))
    for name, part in (("modules", catalogue["modules"]), ("classes", c), ("functions", f)):
        dealt = part.select(F.pmod(F.xxhash64("id"), F.lit(documents)).alias("document"), F.struct(*part.columns).alias("x"))
        held = dealt.groupBy("document").agg(F.array_sort(F.collect_list("x")).alias(name))
        rows = rows.join(held, "document", "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))
    names = ("distribution", "package", "version")
    out = rows.select(F.lit(API_VERSION).alias("schemaVersion"), *[F.lit(v).alias(n) for n, v in zip(names, header, strict=True)], "modules", "classes", "functions")
    (out.coalesce(1) if documents == 1 else out).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


USAGES = "schemaVersion int, class_counts map<string,long>, function_counts map<string,long>, parameter_counts map<string,long>, value_counts map<string,map<string,long>>"


def read_usages(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, value, n, first_seen): first_seen is the place in the file, which is sorted by frequency."""
    raw = spark.read.schema(USAGES).option("multiLine", True).json(path)
    one = lambda k: raw.select(F.lit(k).alias("kind"), F.posexplode(f"{k}_counts").alias("first_seen", "id", "n")).select("kind", "id", F.lit(None).cast("string").alias("value"), "n", F.col("first_seen").cast("long").alias("first_seen"))
    values = raw.select(F.explode("value_counts").alias("id", "m")).select(F.lit("value").alias("kind"), "id", F.posexplode("m").alias("first_seen", "value", "n")).select("kind", "id", "value", "n", F.col("first_seen").cast("long").alias("first_seen"))
    return one("class").unionByName(one("function")).unionByName(one("parameter")).unionByName(values)


def write_usages(counts: DataFrame, path: str) -> None:
    """One JSON document, entries by falling count and first_seen."""
    def earlier(a, b):
        """By the first field that differs; the entry itself may be a map, which has no order."""
        out = F.lit(0)
        for f in ("k", "first_seen", "m"):
            out = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(out)
        return out

    entries = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first_seen", F.col(k).alias("k"), F.col(v).alias("v"))), earlier), lambda x: F.struct(x["k"], x["v"]))
    one = lambda kind: counts.where(F.col("kind") == kind).agg(F.map_from_entries(entries("id", "n")).alias(f"{kind}_counts"))
    inner = counts.where("kind = 'value'").groupBy("id").agg(F.map_from_entries(entries("value", "n")).alias("m"), F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    values = inner.agg(F.map_from_entries(entries("id", "m")).alias("value_counts"))
    out = one("class").join(one("function")).join(one("parameter")).join(values)
    out.select(F.lit(USAGE_VERSION).alias("schemaVersion"), "*").coalesce(1).write.mode("overwrite").json(path)


_COMMON = "target:string,authors:array<string>,reviewers:array<string>,comment:string,reviewResult:string"
_PAYLOADS = {
    "boundary": "interval:struct<isDiscrete:boolean,lowerIntervalLimit:double,lowerLimitType:int,upperIntervalLimit:double,upperLimitType:int>", "calledAfter": "calledAfterName:string", "complete": "", "dependency": "is_depending_on:array<string>,has_dependent_parameter:array<string>,condition:string,action:string",
    "description": "newDescription:string", "enum": "enumName:string,pairs:array<struct<stringValue:string,instanceName:string>>", "expert": "", "group": "groupName:string,parameters:array<string>", "move": "destination:string", "pure": "", "remove": "", "rename": "newName:string", "todo": "newTodo:string",
    "value": "variant:string,defaultValueType:string,defaultValue:string",
}
_COLUMNS = {"enumName": "enum_name", "defaultValueType": "default_value_type", "defaultValue": "default_value"}


def _annotation_schema() -> str:
    each = [f"{k}Annotations map<string,struct<{_COMMON}{',' + v if v else ''}>>" for k, v in _PAYLOADS.items()]
    return ", ".join(["schemaVersion int", *each])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """schema.ANNOTATIONS rows of all 14 kinds; another schema version than ours is refused."""
    raw = spark.read.schema(_annotation_schema()).option("multiLine", True).json(path)
    found = raw.select("schemaVersion").first()
    if found is None or found[0] != ANNOTATION_VERSION:
        raise ValueError(f"annotations of schema version {found and found[0]}, not {ANNOTATION_VERSION}")
    out = spark.createDataFrame([], schema.ANNOTATIONS)
    for kind in _PAYLOADS:
        rows = raw.select(F.explode(F.map_values(f"{kind}Annotations")).alias("a")).select(F.lit(kind).alias("kind"), "a.*")
        out = out.unionByName(rows.withColumnsRenamed({a: b for a, b in _COLUMNS.items() if a in rows.columns}), allowMissingColumns=True)
    return out


def write_annotations(rows: DataFrame, path: str) -> None:
    """One JSON document; of annotations with one kind and target the last by the column ord stays, or by comment where there is none."""
    order = F.col("ord") if "ord" in rows.columns else F.coalesce("comment", F.lit(""))
    back = {v: k for k, v in _COLUMNS.items()}
    out = None
    for kind, payload in _PAYLOADS.items():
        fields = [x.split(":")[0] for x in (_COMMON + ("," + payload if payload else "")).replace("struct<isDiscrete:boolean,lowerIntervalLimit:double,lowerLimitType:int,upperIntervalLimit:double,upperLimitType:int>", "x").replace("struct<stringValue:string,instanceName:string>", "x").split(",")]
        columns = [F.col(_COLUMNS.get(f, f)).alias(back.get(f, f)) for f in fields]
        last = rows.where(F.col("kind") == kind).groupBy("target").agg(F.max_by(F.struct(*columns), order).alias("a"))
        one = last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "a")))).alias(f"{kind}Annotations"))
        out = one if out is None else out.join(one)
    out.select(F.lit(ANNOTATION_VERSION).alias("schemaVersion"), "*").coalesce(1).write.mode("overwrite").json(path)


def write_dependencies(rows: DataFrame, path: str) -> None:
    """One JSON document: function, parameter, list of dependencies in the order of their sentences. rows: what sibling_dependencies gives."""
    one = F.struct("nth", F.struct("dependee_id", F.struct("condition", F.col("condition_kind").alias("variant")).alias("condition"), F.struct("action", F.col("action_kind").alias("variant")).alias("action")).alias("d"))
    per = rows.groupBy("function_id", "parameter_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]).alias("found"))
    functions = per.groupBy("function_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter_id", "found")))).alias("parameters"))
    functions.select("function_id", "parameters").orderBy("function_id").coalesce(1).write.mode("overwrite").json(path)


def write_purity(purity: DataFrame, path: str) -> None:
    """A JSON line for each module, with its functions by line: Pure, or Impure with the reasons by kind. purity: what operators.purity.analyse gives."""
    kinds = F.transform("reasons", lambda r: F.substring_index(r, ".", 1))
    by_kind = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.filter("reasons", lambda r: F.substring_index(r, ".", 1) == k))))
    row = F.struct("line", "fn", F.when(F.col("is_pure"), "Pure").otherwise("Impure").alias("purity"), F.to_json(by_kind).alias("reasons"))
    purity.groupBy("module").agg(F.array_sort(F.collect_list(row)).alias("functions")).orderBy("module").coalesce(1).write.mode("overwrite").json(path)
