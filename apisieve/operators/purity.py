"""Purity of functions: own reasons from facts, and those of all that they call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..sources import scopes, tables
from . import graph


#: What the node of a method name begins with; functions begin with their module.
_ANY = "*."


def resolve(facts: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, edges, reasons) of facts (module and the columns of sources.files.FACTS).

    A plain name may be a function of the module (if the numbers of arguments agree), a class, whose
    constructors or its base's it then calls, or a builtin, and several of these; a method name may be that of any class, of a
    builtin type (pure), or unknown. x.m is the class or instance variable m of the receiver's class, if that has one, else
    of every class of the module that has; reading a property calls it. A call of a parameter and one of an import that `known` (fn, is_pure,
    reasons, by qualified name) and the given modules don't explain are reasons of their own, imports of modules without
    source as native calls. open() tells by its mode what it does to which file. Edges of method calls go by nodes that stand for
    a method's name (_ANY and the name), which are no functions.
    """
    spark = facts.sparkSession
    functions = facts.where("fact = 'function'").select("module", "fn", "name", "klass", "n_args", F.col("extra").cast("int").alias("most"))
    calls = facts.where("fact = 'call'").select("module", "fn", F.col("target").alias("called"), "receiver", F.col("n_args").alias("given"), F.size(F.coalesce("keywords", F.array().cast("array<string>"))).alias("named"))
    calls = calls.withColumn("call", F.monotonically_increasing_id())
    plain = calls.where("receiver IS NULL")
    own = functions.where("klass IS NULL").select("module", F.col("name").alias("called"), F.col("fn").alias("dst"), "n_args", "most")
    fits = (F.col("given") + F.col("named") >= F.col("n_args")) & (F.col("most").isNull() | (F.col("given") <= F.col("most")))
    to_function = plain.join(own, ["module", "called"]).where(fits).select("call", "fn", "dst")
    classes = facts.where("fact = 'class'").select("module", F.col("name").alias("called"), F.col("extra").alias("maker"))
    makers = functions.where(F.col("name").isin(*scopes.MAKERS)).select("module", F.col("klass").alias("maker"), F.col("fn").alias("dst"))
    of_class = plain.join(classes, ["module", "called"])
    to_maker = of_class.join(makers, ["module", "maker"]).select("call", "fn", "dst")
    methods = functions.where("klass IS NOT NULL").select(F.col("name").alias("called"), F.col("fn").alias("dst"))
    by_method = calls.where("receiver IS NOT NULL AND receiver NOT IN ('parameter', 'import')")
    # a call by a name that many classes have meets all of them: both sides meet a node that stands for the name, so edges are as many as calls and methods
    named_by = F.concat(F.lit(_ANY), "called")
    to_method = by_method.join(methods.select("called").distinct(), "called", "left_semi").select("call", "fn", named_by.alias("dst"))
    of_name = methods.join(by_method.select("called").distinct(), "called", "left_semi").select(F.lit(None).cast("long").alias("call"), named_by.alias("fn"), "dst")
    imported = calls.where("receiver = 'import'")
    elsewhere = functions.where("klass IS NULL").select(F.concat_ws(".", F.regexp_replace("module", r"\.__init__$", ""), "name").alias("called"), F.col("fn").alias("dst"))
    to_import = imported.join(elsewhere, "called").select("call", "fn", "dst")
    made = classes.select(F.concat_ws(".", F.regexp_replace("module", r"\.__init__$", ""), "called").alias("called"), "module", "maker").join(makers, ["module", "maker"], "left")
    of_import = imported.join(made.select("called", "dst"), "called").select("call", "fn", "dst")
    to_import = to_import.unionByName(of_import.where("dst IS NOT NULL"))
    accesses, properties = _accesses(facts, functions)
    edges = to_function.unionByName(to_maker).unionByName(to_method).unionByName(of_name).unionByName(to_import).unionByName(properties.withColumn("call", F.lit(None).cast("long")).select("call", "fn", "dst"))

    builtin = F.broadcast(tables.frame(spark, "builtin_purity").withColumnRenamed("name", "called"))
    shadowed = edges.select("call").unionByName(of_class.select("call")).distinct()
    of_builtin = plain.join(shadowed, "call", "left_anti").join(builtin, "called", "left")
    why = of_builtin.where("is_pure IS NULL").select("fn", F.concat(F.lit("UnknownCall.UnknownFunctionCall."), "called").alias("reason"))
    effect = of_builtin.where("NOT is_pure").select("fn", F.explode_outer("reasons").alias("r"), "called").select("fn", F.when(F.col("r").isNull(), F.lit(None).cast("string")).otherwise(F.concat("r", F.lit(".Builtin."), "called")).alias("reason"))
    pure_names = F.broadcast(tables.frame(spark, "method_names").withColumnRenamed("name", "called"))
    file_names = F.col("called").isin(*tables.OPEN_LIKE)
    strange = by_method.join(shadowed, "call", "left_anti").join(pure_names, "called", "left_anti").where(~file_names).select("fn", F.concat(F.lit("UnknownCall.UnknownFunctionCall."), "called").alias("reason"))
    passed = calls.where("receiver = 'parameter'").select("fn", F.concat(F.lit("CallOfParameter.ParameterAccess."), "called").alias("reason"))
    foreign = imported.join(shadowed.unionByName(of_import.select("call")), "call", "left_anti")
    told = None
    if known is not None:
        held = known.select(F.col("fn").alias("called"), "is_pure", "reasons" if "reasons" in known.columns else F.array().cast("array<string>").alias("reasons"))
        told = foreign.join(held.where("NOT is_pure AND size(reasons) > 0"), "called").select("fn", F.explode("reasons").alias("reason"))
        foreign = foreign.join(held.where("is_pure OR size(reasons) > 0").select("called"), "called", "left_anti")
    native = F.substring_index("called", ".", 1).isin(*tables.NATIVE)
    foreign = foreign.select("fn", F.concat(F.when(native, "NativeCall.").otherwise("UnknownCall.Import."), "called").alias("reason"))
    foreign = foreign if told is None else foreign.unionByName(told)
    read_or_write = lambda c: F.when(F.col(c) == "read", "NonLocalVariableRead.").otherwise("NonLocalVariableWrite.")
    touched = facts.where("fact IN ('read', 'write')").select("fn", F.concat(read_or_write("fact"), "target").alias("reason")).unionByName(accesses.select("fn", F.concat(read_or_write("extra"), "variable").alias("reason")))
    modes = F.broadcast(tables.frame(spark, "open_modes"))
    opened = facts.where("fact = 'open'").select("fn", F.coalesce("target", F.lit("UNKNOWN")).alias("file"), F.col("extra").alias("mode")).join(modes, "mode", "left")
    # a file named by a literal but opened in a mode that isn't known is only read, by the engine's rule
    guess = F.when(F.startswith("file", F.lit("StringLiteral")), "READ").otherwise("READ_WRITE")
    does = F.when(F.col("file") == "UNKNOWN", "READ_WRITE").otherwise(F.coalesce("effect", guess))
    kinds = F.when(does == "READ", F.array(F.lit("FileRead"))).when(does == "WRITE", F.array(F.lit("FileWrite"))).otherwise(F.array(F.lit("FileRead"), F.lit("FileWrite")))
    files = opened.select("fn", F.explode(kinds).alias("k"), "file").select("fn", F.concat_ws(".", "k", "file").alias("reason"))
    reasons = why.unionByName(effect).unionByName(strange).unionByName(passed).unionByName(foreign).unionByName(touched).unionByName(files).distinct()
    return functions, edges.select(F.col("fn").alias("src"), "dst").distinct(), reasons


def _accesses(facts: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fn, extra, variable) of reads and writes of members by the classes that have them, and (fn, dst) of reads of properties."""
    members = facts.where("fact = 'member'").select("module", F.col("target").alias("member"), F.col("klass").alias("holder"), F.col("extra").alias("kind")).distinct()
    every = facts.where("fact = 'access'").select("module", "fn", F.col("target").alias("member"), "receiver", "extra").distinct()
    met = every.join(members, ["module", "member"])
    # the receiver's own member, where it has one, stands before those of other classes
    mine = met.where(F.col("receiver") == F.col("holder")).select("module", "fn", "member", "receiver").distinct().withColumn("own", F.lit(True))
    met = met.join(mine, ["module", "fn", "member", "receiver"], "left").where(F.col("own").isNull() | (F.col("receiver") == F.col("holder")))
    getters = functions.select("module", F.col("klass").alias("holder"), F.col("name").alias("member"), F.col("fn").alias("dst"))
    properties = met.where("kind = 'Property' AND extra = 'read'").join(getters, ["module", "holder", "member"]).select("fn", "dst")
    variables = met.where("kind <> 'Property'").select("fn", "extra", F.concat_ws(".", "kind", "holder", "member").alias("variable"))
    return variables, properties


def local_links(facts: DataFrame) -> DataFrame:
    """(fn, name, kind, line, defined): uses of local names and the definitions they may see, all on the same or an earlier line; and
    reassignments with every earlier definition. Parameters are defined before the first line, with defined null."""
    rows = facts.where("fact = 'local'").select("fn", F.col("target").alias("name"), "line", F.col("extra").alias("kind")).distinct()
    defined = rows.where("kind = 'def'").select("fn", "name", F.col("line").alias("defined"))
    later = F.col("line").isNotNull() & (F.col("defined").isNull() | F.when(F.col("kind") == "use", F.col("defined") <= F.col("line")).otherwise(F.col("defined") < F.col("line")))
    return rows.join(defined, ["fn", "name"]).where(later).select("fn", "name", F.when(F.col("kind") == "use", "read").otherwise("reassign").alias("kind"), "line", "defined")


def bases(facts: DataFrame) -> DataFrame:
    """(module, klass, base, kind): each class's bases, as a class of the module, a builtin or another name."""
    builtin = F.broadcast(tables.frame(facts.sparkSession, "builtin_purity").select(F.col("name").alias("base"), F.lit(True).alias("known")))
    rows = facts.where("fact = 'base'").select("module", "klass", F.col("target").alias("base"), "extra").join(builtin, "base", "left")
    return rows.select("module", "klass", "base", F.when(F.col("extra") == "class", "class").when(F.col("known"), "builtin").otherwise("other").alias("kind"))


def combined(facts: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A package's classes by name, of which the last module's counts, and its functions of one name together: (package, name, module), (package, name, fns).

    packages: module, package, ord.
    """
    of = facts.join(packages, "module")
    last = of.where("fact = 'class'").groupBy("package", "name").agg(F.max_by("module", "ord").alias("module"))
    every = of.where("fact = 'function' AND klass IS NULL").groupBy("package", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fn"))), lambda x: x["fn"]).alias("fns"))
    return last, every


#: Stands for a reason that can't be named.
_MUTE = ""


def analyse(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """module, fn, name, line, is_pure, reasons of every function: own reasons and those of all that it calls, which go up the call graph."""
    facts = cut(facts)  # sources are parsed once for all the joins over their facts
    functions, edges, reasons = resolve(facts, known)
    # impure without a reason that can be named: calls of exceptions and their like
    out = graph.propagate(functions, edges, reasons.withColumn("reason", F.coalesce("reason", F.lit(_MUTE))))
    lines = facts.where("fact = 'function'").select("fn", "module", "name", "line")
    return out.join(lines, "fn").select("module", "fn", "name", "line", "is_pure", F.filter("reasons", lambda r: r != _MUTE).alias("reasons"))


def package_report(purity: DataFrame, modules: DataFrame) -> DataFrame:
    """One row per module (module), also those without functions: its functions by line, with counts of reasons by kind."""
    kinds = F.transform("reasons", lambda r: F.substring_index(r, ".", 1))
    counted = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    rows = purity.withColumn("counts", counted)
    per = rows.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("line", "fn", "name", F.when(F.col("is_pure"), "Pure").otherwise("Impure").alias("purity"), "counts")), lambda a, b: F.when(a["line"] < b["line"], -1).when(a["line"] > b["line"], 1).otherwise(0)).alias("functions"))
    return modules.select("module").join(per, "module", "left")
