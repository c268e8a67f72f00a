"""Source files as rows, and the tables that one parse of each gives."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..functions import names
from . import python_source, scopes

HIDDEN_FILES_A_TASK = 500
#: Files whose facts a worker holds at a time; texts whose calls it keeps.
PARSED_ROWS, KEPT_TEXTS = 200, 500
_TEST = re.compile("/tests?/")


def _listed(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths below root whose file name matches: the file system's own listing, as Spark's readers make it on the driver, too."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(root)
    found = where.getFileSystem(conf).listFiles(where, True)
    out = []
    while found.hasNext():
        path = found.next().getPath()
        if fnmatch.fnmatchcase(path.getName(), pattern):
            out.append(path.toString())
    return out


def _read_hidden(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of files that Spark's readers take for hidden ones. Executors open them through Arrow's file systems."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            texts = []
            for path in b.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])
                with system.open_input_stream(inner) as f:
                    texts.append(f.read())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=["path", "content"])

    rows = spark.createDataFrame([(x,) for x in paths], "path string")
    return rows.repartition(max(1, len(paths) // HIDDEN_FILES_A_TASK)).mapInArrow(run, "path string, content binary")


def scan(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(path, content, error) of all files below root that match; files that aren't UTF-8 have the error UnicodeDecodeError and no content. Test folders are left out by the path before anything is read further.

    Spark's readers skip names that begin with an underscore, which most packages have (__init__.py,
    _core.py, _internal/): those are listed by the file system and read by tasks of HIDDEN_FILES_A_TASK files.
    """
    base = root.rstrip("/")
    hidden = [x for x in _listed(spark, root, pattern) if "/_" in x.split(base, 1)[-1]]
    shown = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root).select("path", "content")
    if hidden:
        shown = shown.unionByName(_read_hidden(spark, [x for x in hidden if not _TEST.search(x)]))
    text = F.col("content").cast("string")
    rows = shown.where(~names.is_test_path("path"))
    return rows.select("path", F.when(F.is_valid_utf8(text), text).alias("content"), F.when(~F.is_valid_utf8(text), "UnicodeDecodeError").alias("error"))


def exclude(rows: DataFrame, listed: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose column no line of `listed` (value) names."""
    return rows.join(listed.select(F.trim("value").alias(column)).where(F.length(column) > 0), column, "left_anti")


def relevant(files: DataFrame, package: str) -> DataFrame:
    """Files that mention the package at all; goes before the parse, which Catalyst would not reorder."""
    return files.where(F.contains("content", F.lit(package)))


def _struct(ddl: str, drop: tuple[str, ...] = ()) -> str:
    """Columns as the inside of a struct type."""
    parts, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            if name not in drop:
                parts.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return "struct<" + ",".join(parts) + ">"


_COMPUTED = ("is_public", "reexported_by")
DECLARED = (
    f"struct<module:{_struct(schema.MODULES)},classes:array<{_struct(schema.CLASSES, _COMPUTED)}>,functions:array<{_struct(schema.FUNCTIONS, _COMPUTED)}>,"
    f"parameters:array<{_struct(schema.PARAMETERS, ('is_public',))}>,reexports:array<struct<qname:string,module_id:string>>,error:string>"
)
CALLED = "struct<calls:array<struct<qname:string,instance:boolean,line:int,col:int,positional:array<string>,keywords:array<struct<name:string,value:string>>>>,error:string>"
FACTS = "array<struct<fn:string,name:string,klass:string,line:int,fact:string,target:string,receiver:string,n_args:int,keywords:array<string>,extra:string>>"


def _parsed(files: DataFrame, keep: list[str], inputs: list[str], column: str, ddl: str, run) -> DataFrame:
    """Columns keep of files and what run makes of the columns inputs of each row, as column of type ddl.

    Rows are parsed PARSED_ROWS at a time, so a worker holds the facts of so many files, however many its task has. Unlike a
    function's column in a filter, a map stays where it is: after the repartition that deals files to all cores, and once.
    """
    fields = [files.schema[c] for c in keep]
    kind = StructType.fromDDL(f"{column} {ddl}")[0]

    def parse(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        made = to_arrow_type(kind.dataType)
        for batch in batches:
            for at in range(0, batch.num_rows, PARSED_ROWS):
                b = batch.slice(at, PARSED_ROWS)
                rows = [run(*r) for r in zip(*(b.column(c).to_pylist() for c in inputs), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, made)], names=[*keep, column])

    return files.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(parse, StructType([*fields, kind]))


def parse_declarations(files: DataFrame, package: str, style: str = "plaintext", include_async: bool = False) -> DataFrame:
    """files (module, content) with a column d of type DECLARED instead of content."""
    is_init = F.coalesce(F.col("is_init"), F.lit(False)) if "is_init" in files.columns else F.endswith("module", F.lit("__init__"))
    run = lambda module, content, init: python_source.declarations(content, package, module, style, bool(init), include_async)
    return _parsed(files.withColumn("_init", is_init), [c for c in files.columns if c != "content"], ["module", "content", "_init"], "d", DECLARED, run)


def parse_calls(files: DataFrame, package: str) -> DataFrame:
    """Calls in client files that mention the package: path, qname, line, col, positional, keywords; files that can't be parsed, or have an error already, give it and no call.

    A worker keeps what the last KEPT_TEXTS different texts gave, so copies that lie together are parsed once.
    """

    def told(content):
        calls, error = python_source.calls(content, package)
        return {"calls": calls, "error": error}

    parsed = _parsed(relevant(files, package), ["path"], ["content"], "r", CALLED, _Kept(told))
    told = parsed.select("path", "r.error", F.explode_outer("r.calls").alias("c")).select("path", "error", "c.*")
    if "error" not in files.columns:
        return told
    return told.unionByName(files.where("error IS NOT NULL").select("path", "error"), allowMissingColumns=True)


class _Kept:
    """A function of one text that keeps its last KEPT_TEXTS results; a worker's copy begins with none."""

    def __init__(self, f):
        self.f, self.kept = f, {}

    def __call__(self, text):
        if text not in self.kept:
            if len(self.kept) >= KEPT_TEXTS:
                del self.kept[next(iter(self.kept))]
            self.kept[text] = self.f(text)
        return self.kept[text]


def parse_facts(files: DataFrame) -> DataFrame:
    """Facts for purity: module and the columns of FACTS."""
    rows = _parsed(files, ["module"], ["module", "content"], "f", FACTS, lambda module, content: scopes.module_facts(content, module))
    return rows.select("module", F.explode("f").alias("f")).select("module", "f.*")


def with_module(files: DataFrame, root: str) -> DataFrame:
    """Adds module: the dotted path below root's parent."""
    parent = root.rstrip("/").rsplit("/", 1)[0]
    inner = F.substring_index(F.col("path"), parent + "/", -1)
    return files.withColumn("module", F.translate(F.replace(inner, F.lit(".py"), F.lit("")), "/", ".")).withColumn("is_init", names.is_init_path("path"))


def package_version(package: str) -> tuple[str, str, str]:
    """(distribution, package, version) of an installed package; empty where unknown."""
    from importlib import metadata

    dist = (metadata.packages_distributions().get(package) or [""])[0]
    return dist, package, metadata.version(dist) if dist else ""
