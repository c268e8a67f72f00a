"""Queries over source code, docstrings and versions of an API, made from whole test tables: a module, a text or an element for every part.

What goes in is written by expressions that Spark and DuckDB read alike; the answers in SQL come from the tables'
columns, not from the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..checkpoints import cut, new_path
from ..functions import names, similarity, textmine, types
from ..operators import carry, catalogue, matching, purity, suggest, usages
from ..sources import files, json_io
from . import projections as p
from .queries import ORACLES, QUERIES, query

# ---------------------------------------------------------------- facts in docstrings


def _told(spark, d, kind: str, text: str) -> DataFrame:
    """A documented parameter for every part: id, name, type, description."""
    return p.read(spark, d, "part").repartition(p.spread_over(spark)).selectExpr("p_partkey AS id", "concat('p', p_partkey) AS name", f"{kind} AS type", f"{text} AS description")


_BOUND_TYPES = "CASE p_partkey % 7 WHEN 1 THEN 'int' WHEN 3 THEN concat('int < ', p_size) WHEN 4 THEN 'int or float' WHEN 5 THEN 'str' WHEN 6 THEN 'non-negative float' ELSE 'float' END"
_BOUND_TEXTS = """CASE p_partkey % 7 WHEN 0 THEN concat('Should be between 0 and ', p_size, '.') WHEN 1 THEN concat('Values are at least ', p_size, '.')
 WHEN 2 THEN concat('It must lie in the interval (', p_size, ', ', p_size + 10, '].') WHEN 4 THEN concat('If int, values in [1, ', p_size, ']. If float, it should be in (0, 1).')
 ELSE concat('The size of ', p_name, '.') END"""


@query(
    """WITH b AS (
  SELECT p_partkey AS id, p_size, unnest(CASE p_partkey % 7 WHEN 4 THEN ['int', 'float'] WHEN 5 THEN [] WHEN 1 THEN ['int'] WHEN 3 THEN ['int'] ELSE ['float'] END) AS base_type, p_partkey % 7 AS form FROM part)
SELECT id, base_type, CASE form WHEN 3 THEN NULL WHEN 1 THEN p_size WHEN 2 THEN p_size WHEN 4 THEN CASE base_type WHEN 'int' THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS low,
  CASE form WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN base_type = 'int' ELSE true END AS low_closed,
  CASE form WHEN 0 THEN p_size WHEN 2 THEN p_size + 10 WHEN 3 THEN p_size WHEN 4 THEN CASE base_type WHEN 'int' THEN p_size ELSE 1 END END::DOUBLE AS high,
  CASE form WHEN 0 THEN true WHEN 2 THEN true WHEN 4 THEN base_type = 'int' ELSE false END AS high_closed FROM b"""
)
def boundary_extract(spark, d):
    """Bounds that types and descriptions state; open ends are null."""
    rows = _told(spark, d, _BOUND_TYPES, _BOUND_TEXTS).select("id", F.explode(textmine.boundaries("type", "description")).alias("b"))
    end = lambda c: F.when(F.abs(c) != float("inf"), c)
    return rows.select("id", "b.base_type", end(F.col("b.min")).alias("low"), F.col("b.min_inclusive").alias("low_closed"), end(F.col("b.max")).alias("high"), F.col("b.max_inclusive").alias("high_closed"))


_LITERAL_TYPES = "CASE p_partkey % 5 WHEN 1 THEN 'bool' WHEN 2 THEN concat('{''', p_brand, ''', ''none''}') WHEN 3 THEN 'str or None' WHEN 4 THEN 'float' ELSE 'str' END"
_LITERAL_TEXTS = "CASE p_partkey % 5 WHEN 0 THEN concat('Valid values are ''', p_brand, ''' and ''', p_type, '''.') ELSE concat('About ', p_name, '.') END"


@query(
    """SELECT p_partkey AS id, array_to_string(list_sort(CASE p_partkey % 5 WHEN 0 THEN ['"' || p_brand || '"', '"' || p_type || '"'] WHEN 1 THEN ['False', 'True']
 WHEN 2 THEN ['"' || p_brand || '"', '"none"'] WHEN 3 THEN ['None', 'unlistable_str'] ELSE [] END), ',') AS literals FROM part"""
)
def literal_extract(spark, d):
    rows = _told(spark, d, _LITERAL_TYPES, _LITERAL_TEXTS)
    return rows.select("id", F.array_join(textmine.valid_literals("description", "type"), ",").alias("literals"))


_ORDER_TEXTS = """CASE p_partkey % 4 WHEN 0 THEN concat('Note that `set', p_size, '` must be called before `p', p_partkey, '`.') WHEN 1 THEN concat('Here p', p_partkey, ' must be called after set', p_size, ' or load.')
 WHEN 2 THEN concat('Before p', p_partkey, ' is called, set', p_size, ' must be called.') ELSE concat('Calls ', p_name, '.') END"""


@query(
    """SELECT p_partkey AS id, 'set' || p_size || CASE p_partkey % 4 WHEN 1 THEN ',load' ELSE '' END AS others, CASE p_partkey % 4 WHEN 0 THEN 'before' ELSE 'after' END AS "order" FROM part WHERE p_partkey % 4 < 3"""
)
def called_after_extract(spark, d):
    """Which functions have to be called before or after; texts that don't say so give no row."""
    rows = _told(spark, d, "''", _ORDER_TEXTS).select("id", textmine.called_after("name", "description").alias("c"))
    return rows.where("c.order IS NOT NULL").select("id", F.array_join("c.others", ",").alias("others"), "c.order")


_DEPENDENCY_TEXTS = """CASE p_partkey % 6 WHEN 0 THEN concat('Only used if mode is set to ''', p_brand, '''.') WHEN 1 THEN concat('Ignored when mode is ', p_size, '.') WHEN 2 THEN 'If mode is None, it must be None.'
 WHEN 3 THEN concat('Only applies if mode is not callable.') WHEN 4 THEN concat('If mode >= ', p_size, ', an error is raised.') ELSE concat('The number of ', p_name, '.') END"""
_DEPENDENCY_SQL = """SELECT p_partkey AS id, 'mode' AS dependee, ['has_value', 'has_value', 'is_none', 'has_not_type', 'in_relation'][p_partkey % 6 + 1] AS variant,
 CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN p_size::VARCHAR WHEN 3 THEN 'not callable' WHEN 4 THEN '>= ' || p_size END AS value,
 ['is_ignored', 'is_ignored', 'is_restricted', 'is_ignored', 'is_illegal'][p_partkey % 6 + 1] AS action_variant, ['not ignored', 'ignored', 'None', 'not ignored', 'illegal'][p_partkey % 6 + 1] AS action
FROM part WHERE p_partkey % 6 < 5"""


@query(_DEPENDENCY_SQL)
def dependency_extract(spark, d):
    rows = _told(spark, d, "''", _DEPENDENCY_TEXTS).select("id", F.explode(textmine.dependencies("name", "description")).alias("x"))
    return rows.select("id", "x.dependee", "x.variant", "x.value", "x.action_variant", "x.action")


@query(
    """WITH f AS (SELECT p_brand AS function, p_partkey AS id, p_partkey % 6 AS form, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 AS first FROM part),
m AS (SELECT function, min(id) AS mode FROM f GROUP BY 1),
e AS (SELECT 'shop/' || function || '/' || CASE WHEN first THEN 'mode' ELSE 'p' || id END AS target, 'shop/' || function || '/mode' AS on_, form < 5 AS depends FROM f),
b AS (SELECT on_ AS target, array_to_string(list_sort(list(target)), ',') AS dependents FROM e WHERE depends GROUP BY 1)
SELECT target, CASE WHEN depends THEN on_ ELSE '' END AS depends_on, coalesce(dependents, '') AS dependents FROM e LEFT JOIN b USING (target) WHERE depends OR dependents IS NOT NULL"""
)
def dependency_annotations(spark, d):
    """Annotations both ways from what the descriptions of all parameters state: brands are functions, parts their parameters, the first part of a brand is called mode."""
    told = _told(spark, d, "''", _DEPENDENCY_TEXTS)
    part = p.read(spark, d, "part").select("p_partkey", F.concat(F.lit("shop/"), "p_brand").alias("function_id"))
    first = part.groupBy("function_id").agg(F.min("p_partkey").alias("mode"))
    rows = told.join(part, F.col("id") == F.col("p_partkey")).join(F.broadcast(first), "function_id").withColumn("name", F.when(F.col("id") == F.col("mode"), "mode").otherwise(F.col("name")))
    params = rows.select("function_id", F.concat_ws("/", "function_id", "name").alias("parameter_id"), "name", "description")
    out = suggest.dependency_annotations(suggest.dependencies_told(params), params)
    return out.select("target", F.array_join("is_depending_on", ",").alias("depends_on"), F.array_join("has_dependent_parameter", ",").alias("dependents"))


@query(
    """SELECT p_partkey AS id, p_name || ' GEQ$ ' || p_size || ' and LT$x GT$ ' || p_brand AS for_bounds,
 p_name || ' `' || p_brand || '`  or  `x`' AS for_values, p_name || ' `' || p_brand || '` or `x`' AS for_types FROM part"""
)
def normalised_texts(spark, d):
    """Texts as the rules read them: relations as words, runs of backticks and blanks as one."""
    part = p.read(spark, d, "part").withColumn("bound", F.expr("concat(p_name, ' >= ', p_size, '  and <`x` > ``', p_brand, '``')")).withColumn("value", F.expr("concat(p_name, ' ``', p_brand, '``  or  ```x`')"))
    return part.select(F.col("p_partkey").alias("id"), textmine.bounds_text(F.col("bound")).alias("for_bounds"), textmine.values_text(F.col("value")).alias("for_values"), textmine.values_text(F.col("value"), True).alias("for_types"))


@query("SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_brand, p_type, p_type, p_name])), ',') AS merged, array_to_string(CASE WHEN p_size > 25 THEN [p_name] ELSE [p_brand, p_name] END, ',') AS rest FROM part")
def type_set_operations(spark, d):
    """Values of two enumerations together, and a type's members less others."""
    part, some = p.read(spark, d, "part"), F.array("p_brand", "p_type")
    less = types.without(F.array("p_brand", "p_type", "p_name"), F.when(F.col("p_size") > 25, some).otherwise(F.array("p_type")))
    return part.select(F.col("p_partkey").alias("id"), F.array_join(types.merged_values(some, F.array("p_type", "p_name")), ",").alias("merged"), F.array_join(less, ",").alias("rest"))


_PARSED_TYPES = """CASE p_partkey % 5 WHEN 0 THEN concat('{"', p_brand, '", "', p_type, '"} or int, default=', p_size) WHEN 1 THEN 'float' WHEN 2 THEN concat('(int, ', p_type, ') or (float, float), str') WHEN 3 THEN concat(p_type, ' or ', p_brand, ',  or None')
 ELSE concat('array-like of shape (n, ', p_size, ')') END"""
_PARSED_TEXTS = "CASE p_partkey % 5 WHEN 1 THEN concat('A float in the range [0, ', p_size, ').') ELSE concat('About ', p_name, '.') END"


@query(
    """SELECT p_partkey AS id, unnest(CASE p_partkey % 5
  WHEN 0 THEN ['EnumType:' || array_to_string(list_sort([p_brand, p_type]), '|'), 'NamedType:int'] WHEN 1 THEN ['BoundaryType:float 0.0 ' || p_size::DOUBLE || ' true false', 'NamedType:float']
  WHEN 2 THEN ['NamedType:(int, ' || p_type || ') or (float, float)', 'NamedType:str'] WHEN 3 THEN ['NamedType:' || p_type, 'NamedType:' || p_brand, 'NamedType:None']
  ELSE ['NamedType:array-like of shape (n, ' || p_size || ')'] END) AS member FROM part"""
)
def type_parse(spark, d):
    """Members of documented types, one a row, written as kind:content."""
    rows = _told(spark, d, _PARSED_TYPES, _PARSED_TEXTS).select("id", F.explode(types.parse_type("type", "description")).alias("t"))
    bounded = F.concat_ws(" ", "t.base_type", "t.min", "t.max", "t.min_inclusive", "t.max_inclusive")
    content = F.when(F.col("t.kind") == "EnumType", F.array_join(F.array_sort("t.values"), "|")).when(F.col("t.kind") == "BoundaryType", bounded).otherwise(F.col("t.name"))
    return rows.select("id", F.concat_ws(":", "t.kind", content).alias("member"))


# ---------------------------------------------------------------- source code: a module for every part

#: Every fifth module is private by its name, every tenth can't be parsed, every third has a private function.
_MODULE = "concat('shop.', CASE WHEN p_partkey % 5 = 0 THEN '_m' ELSE 'm' END, p_partkey)"
_NAME = "concat(CASE WHEN p_partkey % 3 = 0 THEN '_price' ELSE 'price' END, p_partkey)"
_INIT = "concat('    def __init__(self, size=', p_size, ', *, brand=''', p_brand, '''):')"
_GROW = "'    def grow(self, by, /, *more, twice=False, **rest):'"
_PRICE = f"concat('def ', {_NAME}, '(items, rate=', p_size, '.5):')"
_LINES = f"""concat_ws(chr(10), 'import json', 'LIMIT = 10', '', '', concat('class Item', p_partkey, ':'), '    \"\"\"An item.', '', '    Parameters', '    ----------', concat('    size : int, default=', p_size),
 concat('        Size in the range [1, ', p_size, '].'), '    \"\"\"', '', {_INIT}, '        self.size = size', '        self.brand = brand', '', {_GROW}, '        return by', '', '', {_PRICE}, concat('    \"\"\"The price of ', p_name, '.\"\"\"'), '    return items', '')"""


def shop(spark, d) -> DataFrame:
    """module and content for every part."""
    rows = p.read(spark, d, "part").selectExpr(f"{_MODULE} AS module", f"concat({_LINES}, CASE WHEN p_partkey % 10 = 9 THEN 'def f(:' ELSE '' END) AS content")
    return rows.repartition(p.spread_over(spark))  # one file has all parts; parsing is for all cores


def shop_catalogue(spark, d) -> dict[str, DataFrame]:
    return catalogue.build(shop(spark, d), "shop", "numpydoc")


_SHOP_SQL = f"""WITH s AS (
  SELECT *, {_MODULE} AS module, {_NAME} AS fname, 'Item' || p_partkey AS class, p_partkey % 5 <> 0 AS open FROM part WHERE p_partkey % 10 <> 9),
f AS (
  SELECT module, class, open, p_partkey, p_size, p_brand, 'shop/' || module || '/' || class || '/__init__' AS id, module || '.' || class || '.__init__' AS qname, open AS is_public, 'class' AS parent_kind,
    {_INIT} || chr(10) || '        self.size = size' || chr(10) || '        self.brand = brand' AS code FROM s
  UNION ALL SELECT module, class, open, p_partkey, p_size, p_brand, 'shop/' || module || '/' || class || '/grow', module || '.' || class || '.grow', open, 'class', {_GROW} || chr(10) || '        return by' FROM s
  UNION ALL SELECT module, class, open, p_partkey, p_size, p_brand, 'shop/' || module || '/' || fname, module || '.' || fname, open AND p_partkey % 3 <> 0, 'module',
    {_PRICE} || chr(10) || '    \"\"\"The price of ' || p_name || '.\"\"\"' || chr(10) || '    return items' FROM s),
q(ending, name, ordinal, assigned_by) AS (VALUES ('__init__', 'self', 0, 'IMPLICIT'), ('__init__', 'size', 1, 'POSITION_OR_NAME'), ('__init__', 'brand', 2, 'NAME_ONLY'), ('grow', 'self', 0, 'IMPLICIT'), ('grow', 'by', 1, 'POSITION_ONLY'),
  ('grow', 'more', 2, 'POSITIONAL_VARARG'), ('grow', 'twice', 3, 'NAME_ONLY'), ('grow', 'rest', 4, 'NAMED_VARARG'), ('price', 'items', 0, 'POSITION_OR_NAME'), ('price', 'rate', 1, 'POSITION_OR_NAME')),
params AS (
  SELECT f.id AS function_id, f.id || '/' || name AS id, ordinal, assigned_by, is_public,
    CASE name WHEN 'size' THEN p_size::VARCHAR WHEN 'brand' THEN '''' || p_brand || '''' WHEN 'twice' THEN 'False' WHEN 'rate' THEN p_size || '.5' END AS default_value,
    CASE WHEN name = 'size' THEN 'int' ELSE '' END AS doc_type, CASE WHEN name = 'size' THEN 'Size in the range [1, ' || p_size || '].' ELSE '' END AS doc
  FROM f JOIN q ON ending = CASE WHEN parent_kind = 'module' THEN 'price' ELSE string_split(qname, '.')[-1] END)"""


@query(f"{_SHOP_SQL} SELECT id, qname, is_public, parent_kind, code FROM f")
def source_py_parse(spark, d):
    """Functions of all modules; those that can't be parsed declare nothing."""
    return shop_catalogue(spark, d)["functions"].select("id", "qname", "is_public", "parent_kind", "code")


@query(f"{_SHOP_SQL} SELECT id, ordinal, assigned_by, default_value, is_public, doc_type, doc FROM params")
def source_parameters(spark, d):
    rows = shop_catalogue(spark, d)["parameters"]
    return rows.select("id", "ordinal", "assigned_by", "default_value", "is_public", F.col("docstring.type").alias("doc_type"), F.col("docstring.description").alias("doc"))


@query(
    f"""{_SHOP_SQL} SELECT 'class' AS kind, count(*) AS total, count(*) FILTER (open) AS public FROM s
UNION ALL SELECT 'function', count(*), count(*) FILTER (is_public) FROM f UNION ALL SELECT 'parameter', count(*), count(*) FILTER (is_public) FROM params"""
)
def catalogue_summary(spark, d):
    return catalogue.summary(shop_catalogue(spark, d))


@query(f"{_SHOP_SQL} SELECT 'optional' AS requirement, count(*) AS n FROM params WHERE default_value IS NOT NULL UNION ALL SELECT 'required', count(*) FROM params WHERE default_value IS NULL")
def parameter_requirement(spark, d):
    """Parameters with a default are optional, the others required."""
    rows = shop_catalogue(spark, d)["parameters"]
    return rows.groupBy(catalogue.requirement(F.col("default_value")).alias("requirement")).agg(F.count("*").alias("n"))


@query(f"{_SHOP_SQL} SELECT 'shop/' || module || '/' || class || '/' || a AS id, CASE a WHEN 'size' THEN 0 ELSE 0 END AS n_types FROM s, (VALUES ('size'), ('brand')) v(a)")
def source_attributes(spark, d):
    """Attributes that constructors assign; plain parameters without hints tell no type."""
    return shop_catalogue(spark, d)["attributes"].select("id", F.size("types").alias("n_types"))


@query(
    f"""WITH m AS (SELECT {_MODULE} AS module, p_partkey, p_brand FROM part)
SELECT module, 'json' AS origin, NULL AS declaration, NULL AS alias FROM m UNION ALL SELECT module, 'fast' || p_partkey, NULL, 'quick' FROM m UNION ALL SELECT module, 'shop.base', 'Item', NULL FROM m UNION ALL SELECT module, 'shop', 'rest', 'r' FROM m"""
)
def source_imports(spark, d):
    """Imports of every module, also within try; relative ones by the module's place, those in functions are none of the module's."""
    text = "concat_ws(chr(10), 'import json', 'try:', concat('    import fast', p_partkey, ' as quick'), 'except ImportError:', '    from .base import Item', 'from . import rest as r', 'def f():', '    import csv', '')"
    rows = p.read(spark, d, "part").selectExpr(f"{_MODULE} AS module", f"{text} AS content").repartition(p.spread_over(spark))
    m = catalogue.build(rows, "shop")["modules"]
    plain = m.select(F.col("name").alias("module"), F.explode("imports").alias("i")).select("module", F.col("i.module").alias("origin"), F.lit(None).cast("string").alias("declaration"), "i.alias")
    return plain.unionByName(m.select(F.col("name").alias("module"), F.explode("from_imports").alias("i")).select("module", F.col("i.module").alias("origin"), "i.declaration", "i.alias"))


# Clients: a file for every order, about the part whose number is the customer's.
_CLIENT = f"""CASE o_orderstatus WHEN 'F' THEN concat_ws(chr(10), concat('from ', {_MODULE}, ' import Item', p_partkey), concat('b = Item', p_partkey, '(', o_orderkey % 5, ', brand=''x'')'), concat('b.grow(', o_orderkey % 3, ', twice=True)'), '')
 WHEN 'O' THEN concat_ws(chr(10), concat('from ', {_MODULE}, ' import ', {_NAME}), concat({_NAME}, '([1], 2.0)'), concat({_NAME}, '([2])'), '') ELSE concat_ws(chr(10), 'import shop', 'this is no code') END"""


def clients(spark, d) -> DataFrame:
    """path and content for every order; those about one part, among which are copies, lie together."""
    rows = p.read(spark, d, "orders").join(p.read(spark, d, "part"), F.col("o_custkey") == F.col("p_partkey"))
    rows = rows.repartition(p.spread_over(spark), "o_custkey").sortWithinPartitions("o_custkey", "o_orderstatus")
    return rows.selectExpr("concat('c', o_orderkey, '.py') AS path", f"{_CLIENT} AS content")


@query(
    f"""{_SHOP_SQL}, o AS (SELECT *, 'shop/' || module || '/' || class AS c, 'shop/' || module || '/' || fname AS g FROM orders JOIN s ON o_custkey = p_partkey),
u AS (
  SELECT 'class' AS kind, c AS id, NULL AS value, 2 AS n FROM o WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'function', c || '/' || m, NULL, 1 FROM o, (VALUES ('__init__'), ('grow')) v(m) WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'parameter', c || '/' || m, NULL, 1 FROM o, (VALUES ('__init__/size'), ('__init__/brand'), ('grow/by'), ('grow/twice')) v(m) WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'value', c || '/__init__/size', (o_orderkey % 5)::VARCHAR, 1 FROM o WHERE o_orderstatus = 'F' UNION ALL SELECT 'value', c || '/__init__/brand', '''x''', 1 FROM o WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'value', c || '/grow/by', (o_orderkey % 3)::VARCHAR, 1 FROM o WHERE o_orderstatus = 'F' UNION ALL SELECT 'value', c || '/grow/twice', 'True', 1 FROM o WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'function', g, NULL, 2 FROM o WHERE o_orderstatus = 'O' UNION ALL SELECT 'parameter', g || '/items', NULL, 2 FROM o WHERE o_orderstatus = 'O' UNION ALL SELECT 'parameter', g || '/rate', NULL, 1 FROM o WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'value', g || '/items', v, 1 FROM o, (VALUES ('[1]'), ('[2]')) w(v) WHERE o_orderstatus = 'O' UNION ALL SELECT 'value', g || '/rate', '2.0', 1 FROM o WHERE o_orderstatus = 'O')
SELECT kind, id, value, sum(n)::BIGINT AS n FROM u GROUP BY 1, 2, 3"""
)
def usages_from_source(spark, d):
    """Usage counts of the whole catalogue by all clients."""
    calls, bound = catalogue.usages_of(clients(spark, d), shop_catalogue(spark, d), "shop")
    return usages.count_usages(cut(calls), cut(bound)).select("kind", "id", "value", "n")


@query("SELECT 'c' || o_orderkey || '.py' AS path, 'SyntaxError' AS error FROM orders JOIN part ON o_custkey = p_partkey WHERE o_orderstatus NOT IN ('F', 'O')")
def source_errors(spark, d):
    """Files that can't be parsed don't stop the scan."""
    return files.parse_calls(clients(spark, d), "shop").where("error IS NOT NULL").select("path", "error")


# ---------------------------------------------------------------- purity: a module for every part, of one of sixteen forms

_BODIES = [
    # (lines, line of f, reasons of f, further functions as (name, line, reasons))
    (["'def f(x):'", "concat('    return x + ', p_size)"], 1, [], []),
    (["concat('total', p_size, ' = 0')", "''", "'def f(x):'", "concat('    global total', p_size)", "concat('    total', p_size, ' = x')"], 3, ["'NonLocalVariableWrite.GlobalVariable.total' || p_size"], []),
    (["'def f(x):'", "'    print(x)'"], 1, ["'FileWrite.Builtin.print'"], []),
    (["'def f(path):'", "'    with open(path, ''w'') as h:'", "'        h.write(''a'')'"], 1, ["'FileWrite.ParameterAccess.path'"], []),
    (["'def g(x, sink):'", "'    sink(x)'", "''", "'def f(x):'", "'    g(x, None)'"], 4, ["'CallOfParameter.ParameterAccess.sink'"], [("g", 1, ["'CallOfParameter.ParameterAccess.sink'"])]),
    (["'LIMIT = 3'", "''", "'def f(x):'", "'    return x > LIMIT'"], 3, ["'NonLocalVariableRead.GlobalVariable.LIMIT'"], []),
    (["'def even(n):'", "'    return True if n == 0 else odd(n - 1)'", "''", "'def odd(n):'", "'    print(n)'", "'    return even(n - 1)'", "''", "'def f(n):'", "'    return even(n)'"], 8, ["'FileWrite.Builtin.print'"], [("even", 1, ["'FileWrite.Builtin.print'"]), ("odd", 4, ["'FileWrite.Builtin.print'"])]),
    (["'def f(x: int) -> int:'", "'    y: dict = {k: v for k, v in x}'", "'    return y'"], 1, [], []),
    (["concat('def f(x):')", "concat('    with open(''data', p_size, '.txt'') as h:')", "'        return h.read()'"], 1, ["'FileRead.StringLiteral.data' || p_size || '.txt'"], []),
    (["'seen = 1'", "''", "'def f(xs):'", "'    return [seen for seen in xs]'"], 3, [], []),
    (
        ["'class Box:'", "'    limit = 9'", "''", "'    def __init__(self, size):'", "'        self.size = size'", "''", "'    @property'", "'    def full(self):'", "'        return self.size > self.limit'", "''", "'def f(box):'", "'    return box.full'"],
        11, ["'NonLocalVariableRead.InstanceVariable.Box.size'", "'NonLocalVariableRead.ClassVariable.Box.limit'"], [("__init__", 4, []), ("full", 8, ["'NonLocalVariableRead.InstanceVariable.Box.size'", "'NonLocalVariableRead.ClassVariable.Box.limit'"])],
    ),
    (["'class Base:'", "'    def __init__(self):'", "'        print(1)'", "''", "'class Child(Base):'", "'    pass'", "''", "'def f():'", "'    return Child()'"], 8, ["'FileWrite.Builtin.print'"], [("__init__", 2, ["'FileWrite.Builtin.print'"])]),
    (["'class A(Exception):'", "'    x = 1'", "''", "'class B:'", "'    x = 2'", "''", "'def f(o):'", "'    return o.x'", "''", "'def g():'", "'    return A.x'"], 7, ["'NonLocalVariableRead.ClassVariable.A.x'", "'NonLocalVariableRead.ClassVariable.B.x'"], [("g", 10, ["'NonLocalVariableRead.ClassVariable.A.x'"])]),
    (["'try:'", "'    from math import floor'", "'except ImportError:'", "'    floor = None'", "''", "'def f(x):'", "'    import time'", "'    return floor(x) + time.time()'"], 6, ["'NativeCall.math.floor'", "'NativeCall.time.time'"], []),
    (["'double = lambda x: x * 2'", "'class C:'", "'    show = lambda self: print(self)'", "''", "'def f(c):'", "'    return c.show() + double(1)'"], 5, ["'FileWrite.Builtin.print'"], [("double", 1, []), ("show", 3, ["'FileWrite.Builtin.print'"])]),
    (["concat('LIMIT', p_size, ' = 3')", "''", "'def f(xs):'", "concat('    return [x for x in xs if x > LIMIT', p_size, ']')"], 3, ["'NonLocalVariableRead.GlobalVariable.LIMIT' || p_size"], []),
]


def _purity_rows() -> list[tuple[int, str, int, list[str]]]:
    return [(form, *r) for form, (_, line, reasons, more) in enumerate(_BODIES) for r in [("f", line, reasons), *more]]


def pure_modules(spark, d) -> DataFrame:
    form = " ".join(f"WHEN {i} THEN concat_ws(chr(10), {', '.join(lines)}, '')" for i, (lines, *_) in enumerate(_BODIES))
    rows = p.read(spark, d, "part").selectExpr("concat('shop.m', p_partkey) AS module", f"CASE p_partkey % {len(_BODIES)} {form} END AS content")
    return rows.repartition(p.spread_over(spark))


_PURITY_SQL = "WITH e AS (\n" + "\n  UNION ALL ".join(
    f"SELECT p_partkey, '{name}' AS name, {line} AS line, [{', '.join(reasons)}]::VARCHAR[] AS reasons FROM part WHERE p_partkey % {len(_BODIES)} = {form}" for form, name, line, reasons in _purity_rows()
) + ")"


@query(f"{_PURITY_SQL} SELECT 'shop.m' || p_partkey AS module, name, line, len(reasons) = 0 AS is_pure, array_to_string(list_sort(reasons), ',') AS reasons FROM e")
def purity_from_source(spark, d):
    """Purity of every function of all modules, with reasons gathered over calls."""
    rows = purity.analyse(files.parse_facts(pure_modules(spark, d)))
    return rows.select("module", "name", "line", "is_pure", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


@query(
    f"""{_PURITY_SQL}, r AS (SELECT p_partkey, name, line, unnest(CASE WHEN len(reasons) = 0 THEN ['Pure'] ELSE ['Impure.' || string_split(reasons[1], '.')[1]] END) AS told FROM e)
SELECT 'shop.m' || p_partkey AS module, string_agg(name || ':' || line || ':' || told, ' ' ORDER BY line) AS functions FROM r GROUP BY p_partkey"""
)
def purity_package_report(spark, d):
    """One row per module: its functions by line, each pure or impure by the kinds of its reasons."""
    modules = pure_modules(spark, d)
    rows = purity.package_report(purity.analyse(files.parse_facts(modules)), modules.select("module"))
    one = lambda f: F.concat_ws(":", f["name"], f["line"].cast("string"), F.concat_ws(".", f["purity"], F.array_join(F.array_sort(F.map_keys(f["counts"])), ".")))
    told = F.transform("functions", one)
    return rows.select("module", F.regexp_replace(F.array_join(told, " "), "Pure\\.", "Pure").alias("functions"))


@query("SELECT 'shop.m' || p_partkey AS module, unnest(CASE p_partkey % 16 WHEN 11 THEN ['Child'] WHEN 12 THEN ['A'] ELSE [] END) AS klass, CASE p_partkey % 16 WHEN 11 THEN 'Base' ELSE 'Exception' END AS base, CASE p_partkey % 16 WHEN 11 THEN 'class' ELSE 'builtin' END AS kind FROM part")
def class_bases(spark, d):
    """Bases of all classes: classes of the module, or builtins."""
    return purity.bases(files.parse_facts(pure_modules(spark, d)))


@query(
    """WITH c AS (SELECT 'shop/' || p_brand AS package, unnest(CASE p_partkey % 16 WHEN 10 THEN ['Box'] WHEN 11 THEN ['Base', 'Child'] WHEN 12 THEN ['A', 'B'] WHEN 14 THEN ['C'] ELSE [] END) AS name, p_partkey FROM part)
SELECT package, name, 'shop.m' || max(p_partkey) AS module FROM c GROUP BY 1, 2"""
)
def package_classes(spark, d):
    """Brands as packages, whose modules are their parts: of classes of one name the last module's counts."""
    packages = p.read(spark, d, "part").select(F.concat(F.lit("shop.m"), "p_partkey").alias("module"), F.concat(F.lit("shop/"), "p_brand").alias("package"), F.col("p_partkey").alias("ord"))
    return purity.combined(files.parse_facts(pure_modules(spark, d)), packages)[0]


@query(
    """WITH c AS (
  SELECT 'shop/' || p_brand AS package, p_partkey, unnest(CASE p_partkey % 16 WHEN 4 THEN ['f', 'g'] WHEN 6 THEN ['f', 'even', 'odd'] WHEN 12 THEN ['f', 'g'] WHEN 14 THEN ['f', 'double'] ELSE ['f'] END) AS name FROM part)
SELECT package, name, count(*) AS n, 'shop.m' || min(p_partkey) AS first FROM c GROUP BY 1, 2"""
)
def package_functions(spark, d):
    """Functions of one name in a package stand together, in the order of their modules."""
    packages = p.read(spark, d, "part").select(F.concat(F.lit("shop.m"), "p_partkey").alias("module"), F.concat(F.lit("shop/"), "p_brand").alias("package"), F.col("p_partkey").alias("ord"))
    rows = purity.combined(files.parse_facts(pure_modules(spark, d)), packages)[1]
    return rows.select("package", "name", F.size("fns").cast("long").alias("n"), F.substring_index(F.col("fns")[0], ".", 2).alias("first"))


@query(
    """SELECT 'shop.m' || p_partkey AS module, v.* FROM part, (VALUES ('x', 'read', 2, 0), ('a', 'read', 3, 2), ('a', 'read', 3, 3), ('a', 'reassign', 3, 2), ('a', 'read', 4, 2), ('a', 'read', 4, 3)) v(name, kind, line, defined)"""
)
def local_references(spark, d):
    """Local reads with all earlier definitions, and reassignments with those before them."""
    text = "concat_ws(chr(10), 'def f(x):', '    a = x', concat('    a = a + ', p_size), '    return a', '')"
    rows = p.read(spark, d, "part").selectExpr("concat('shop.m', p_partkey) AS module", f"{text} AS content").repartition(p.spread_over(spark))
    links = purity.local_links(cut(files.parse_facts(rows)))
    return links.select(F.substring_index("fn", ".", 2).alias("module"), "name", "kind", "line", F.coalesce("defined", F.lit(0)).alias("defined"))


# ---------------------------------------------------------------- files: written to the shared folder and read again


@query(
    f"""WITH {p.BOUND_SQL} SELECT 'function' AS kind, function_id AS id, NULL AS value, count(*) AS n FROM calls GROUP BY 2 UNION ALL SELECT 'class', class_id, NULL, count(*) FROM calls GROUP BY 2
UNION ALL SELECT 'parameter', parameter_id, NULL, count(*) FROM bound GROUP BY 2 UNION ALL SELECT 'value', parameter_id, value, count(*) FROM bound GROUP BY 2, 3"""
)
def usages_file(spark, d):
    """All usage counts through their JSON file."""
    counts = usages.count_usages(p.calls(spark, d), p.bound(spark, d), "seen").withColumn("first_seen", F.lit(0).cast("long"))
    json_io.write_usages(counts, path := new_path(spark, "usages"))
    return json_io.read_usages(spark, path).select("kind", "id", "value", "n")


@query(f"{_SHOP_SQL} SELECT id, assigned_by, default_value, is_public FROM params")
def api_file(spark, d):
    """The catalogue of all modules through its JSON file."""
    json_io.write_api(shop_catalogue(spark, d), ("dist", "shop", "1"), path := new_path(spark, "api"))
    return json_io.read_api(spark, path)["parameters"].select("id", "assigned_by", "default_value", "is_public")


@query(f"{_SHOP_SQL} SELECT id, parent_kind FROM f WHERE is_public")
def public_functions(spark, d):
    return catalogue.public_only(shop_catalogue(spark, d))["functions"].select("id", "parent_kind")


@query(f"{_SHOP_SQL} SELECT 'shop/' || module || '/' || class AS id, 2 AS methods FROM s WHERE open")
def public_classes(spark, d):
    return catalogue.public_only(shop_catalogue(spark, d))["classes"].select("id", F.size("methods").alias("methods"))


_PATHS = "concat('lib', CASE p_partkey % 3 WHEN 0 THEN '/tests/' WHEN 1 THEN '/test/' ELSE '/testing/' END, CASE WHEN p_size % 2 = 0 THEN '__init__.py' ELSE concat('m', p_size, '.py') END)"


@query("SELECT p_partkey AS id, p_partkey % 3 < 2 AS test, p_size % 2 = 0 AS init FROM part")
def path_filters(spark, d):
    """Which paths are tests, which are package files."""
    return p.read(spark, d, "part").withColumn("path", F.expr(_PATHS)).select(F.col("p_partkey").alias("id"), names.is_test_path("path").alias("test"), names.is_init_path("path").alias("init"))


@query(
    """SELECT p_partkey AS id, p_size || CASE WHEN p_size = 1 THEN ' time' ELSE ' times' END AS counted, printf('%.2f%%', p_size / 7.0) AS share, 'line ' || (p_size % 5 + 1) || chr(10) || 'line ' || (p_size % 5 + 2) AS slice FROM part"""
)
def texts_of_numbers(spark, d):
    """Counts with their noun, shares in per cent, and lines cut out of a source."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("line "), i)), "\n")
    first = (F.col("p_size") % 5 + 1).cast("int")
    return p.read(spark, d, "part").select(F.col("p_partkey").alias("id"), names.pluralize(F.col("p_size"), "time").alias("counted"), names.percent(F.col("p_size") / 700).alias("share"), names.code_slice(lines, first, first + 1).alias("slice"))


# ---------------------------------------------------------------- two versions of an API: a function and a parameter for every part


_ELEMENT = "kind string, id string, name string, parent_id string, parent_kind string, ord long, description string, members array<string>, attributes array<string>, code_lines array<string>, types array<string>, assigned_by string, default_value string, superclasses array<string>"
#: Of forty functions, one gets another name and one goes; those of the second version that are new come with the renamed ones.
_RENAMED, _GONE = "p_partkey % 40 = 0", "p_partkey % 40 = 1"


def versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Functions named by a digest, so that none is like another, each with a parameter; in the second version some have _x behind their name and some are gone."""
    part = p.read(spark, d, "part").withColumn("n", F.md5(F.col("p_partkey").cast("string"))).withColumn("q", F.md5(F.concat(F.lit("q"), F.col("p_partkey").cast("string"))))
    none = F.array().cast("array<string>")

    def version(rows: DataFrame) -> DataFrame:
        head = (F.lit("lib/m/"), F.col("name"))
        f = rows.select(
            F.lit("function").alias("kind"), F.concat(*head).alias("id"), "name", F.lit("lib/m").alias("parent_id"), F.lit("module").alias("parent_kind"), (F.col("p_partkey") * 2).alias("ord"), F.col("q").alias("description"), F.array("q").alias("members"), none.alias("attributes"),
            F.array(F.concat(F.lit("def "), "name", F.lit("():")), F.concat(F.lit("    return "), "q")).alias("code_lines"), none.alias("types"), F.lit(None).cast("string").alias("assigned_by"), F.lit(None).cast("string").alias("default_value"), none.alias("superclasses"),
        )
        x = rows.select(
            F.lit("parameter").alias("kind"), F.concat(*head, F.lit("/"), F.col("q")).alias("id"), F.col("q").alias("name"), F.concat(*head).alias("parent_id"), F.lit("function").alias("parent_kind"), (F.col("p_partkey") * 2 + 1).alias("ord"), F.lit("").alias("description"), none.alias("members"),
            none.alias("attributes"), none.alias("code_lines"), F.array("q").alias("types"), F.lit("POSITION_OR_NAME").alias("assigned_by"), F.col("p_partkey").cast("string").alias("default_value"), none.alias("superclasses"),
        )
        group = (F.lit("lib/m/C"), F.col("name"))
        c = rows.select(
            F.lit("class").alias("kind"), F.concat(*group).alias("id"), F.concat(F.lit("C"), "name").alias("name"), F.lit("lib/m").alias("parent_id"), F.lit("module").alias("parent_kind"), F.col("p_partkey").alias("ord"), F.col("q").alias("description"), F.array("q").alias("members"), F.array("n").alias("attributes"),
            F.array(F.concat(F.lit("class C"), "name"), F.concat(F.lit("    "), "q")).alias("code_lines"), none.alias("types"), F.lit(None).cast("string").alias("assigned_by"), F.lit(None).cast("string").alias("default_value"), none.alias("superclasses"),
        )
        a = x.select(F.lit("attribute").alias("kind"), F.regexp_replace("id", "^lib/m/", "lib/m/C").alias("id"), "name", F.regexp_replace("parent_id", "^lib/m/", "lib/m/C").alias("parent_id"), F.lit("class").alias("parent_kind"), "ord", "description", "members", "attributes", "code_lines", "types", "assigned_by", "default_value", "superclasses")
        return f.unionByName(x).unionByName(c).unionByName(a)

    one = version(part.withColumn("name", F.col("n")))
    two = version(part.where(f"NOT ({_GONE})").withColumn("name", F.when(F.expr(_RENAMED), F.concat("n", F.lit("_x"))).otherwise(F.col("n"))))
    return cut(one), cut(two)


_VERSIONS_SQL = f"""WITH e AS (SELECT p_partkey, 'lib/m/' || md5(p_partkey::VARCHAR) AS id, md5('q' || p_partkey) AS q, {_RENAMED} AS renamed, {_GONE} AS gone FROM part),
m AS (
  SELECT 'function' AS kind, CASE WHEN renamed THEN 'simple' ELSE 'unchanged' END AS stage, CASE WHEN renamed THEN (0.5 + (1 - 2.0 / 34) + 1 + 1 + 1) / 5 ELSE 1.0 END AS similarity, id AS v1, id || CASE WHEN renamed THEN '_x' ELSE '' END AS v2 FROM e WHERE NOT gone
  UNION ALL SELECT 'parameter', CASE WHEN renamed THEN 'simple' ELSE 'unchanged' END, CASE WHEN renamed THEN (1 + 1 + 1 + 2.0 / 3 + 1) / 5 ELSE 1.0 END, id || '/' || q, id || CASE WHEN renamed THEN '_x' ELSE '' END || '/' || q FROM e WHERE NOT gone
  UNION ALL SELECT 'class', CASE WHEN renamed THEN 'simple' ELSE 'unchanged' END, CASE WHEN renamed THEN ((1 - 2.0 / 35) + 1 + 1 + 0.5 + 1 + 1) / 6 ELSE 1.0 END, replace(id, '/m/', '/m/C'), replace(id, '/m/', '/m/C') || CASE WHEN renamed THEN '_x' ELSE '' END FROM e WHERE NOT gone
  UNION ALL SELECT 'attribute', CASE WHEN renamed THEN 'simple' ELSE 'unchanged' END, 1.0, replace(id, '/m/', '/m/C') || '/' || q, replace(id, '/m/', '/m/C') || CASE WHEN renamed THEN '_x' ELSE '' END || '/' || q FROM e WHERE NOT gone)"""


@query(f"{_VERSIONS_SQL} SELECT kind, stage, round(similarity, 6)::DOUBLE AS similarity, v1, v2 FROM m")
def map_api_stages(spark, d):
    """Mappings of all elements: unchanged by id, renamed ones by likeness."""
    rows = matching.map_api(*versions(spark, d))
    return rows.select("kind", "stage", F.round("similarity", 6).alias("similarity"), F.array_join("v1_ids", ",").alias("v1"), F.array_join("v2_ids", ",").alias("v2"))


@query(
    f"""{_VERSIONS_SQL} SELECT kind, CASE WHEN similarity = 1 THEN '1.0' ELSE round(similarity, 4)::VARCHAR END || '|`' || v1 || '`|`' || v2 || '`|' AS line FROM m WHERE kind <> 'attribute'
UNION ALL SELECT 'class', '-|`' || replace(id, '/m/', '/m/C') || '`||' FROM e WHERE gone UNION ALL SELECT 'function', '-|`' || id || '`||' FROM e WHERE gone UNION ALL SELECT 'parameter', '-|`' || id || '/' || q || '`||' FROM e WHERE gone"""
)
def mapping_report(spark, d):
    """The report's lines, also for elements that are in no mapping."""
    one, two = versions(spark, d)
    return matching.report(matching.map_api(one, two), one, two).select("kind", "line")


# ---------------------------------------------------------------- annotations: one for every part, of all kinds

_KINDS = ("boundary", "calledAfter", "description", "enum", "expert", "group", "move", "remove", "rename", "todo", "value", "value", "value", "value")
_CARRIED = f"element_at(array({', '.join(repr(k) for k in _KINDS)}), CAST(p_partkey % {len(_KINDS)} AS INT) + 1)"


def annotated(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Annotations, mappings and elements of two versions. Odd parts change in the second version, in what their annotation is about."""
    part = p.read(spark, d, "part").withColumn("form", F.expr(f"CAST(p_partkey % {len(_KINDS)} AS INT)")).withColumn("kind", F.expr(_CARRIED)).withColumn("odd", F.expr("(p_partkey div 14) % 2 = 1"))
    on_parameter = F.col("kind").isin("boundary", "enum", "value")
    old, new = F.format_string("lib/m%d/f%d", F.col("p_size"), F.col("p_partkey")), F.format_string("lib/m%d/f%d", F.col("p_size") + F.when(F.col("odd") & (F.col("kind") == "move"), 1).otherwise(0), F.col("p_partkey"))
    rows = part.withColumn("holder1", old).withColumn("holder2", new)
    tail = F.when(on_parameter, "/x").otherwise("")
    rows = rows.withColumn("id1", F.concat("holder1", tail)).withColumn("id2", F.concat("holder2", tail)).withColumn("element", F.when(on_parameter, "parameter").otherwise("function"))
    name1 = F.substring_index("id1", "/", -1)
    told2 = F.when(F.col("odd") & (F.col("kind") == "description"), "another").otherwise("text")
    types1 = F.when(F.col("kind") == "boundary", F.array(F.lit("float"))).when(F.col("kind") == "enum", F.array(F.lit("str"))).otherwise(F.array(F.lit("int")))
    # a boundary's parameter becomes an int, an enum's a number; constants and required ones change type, omitted and optional ones their default
    types2 = F.when(F.col("odd") & (F.col("kind") == "boundary"), F.array(F.lit("int"))).when(F.col("odd") & ((F.col("kind") == "enum") | F.col("form").isin(10, 13)), F.array(F.lit("bool"))).otherwise(types1)
    default = F.when(F.col("kind") == "value", "1")
    default2 = F.when(F.col("odd") & F.col("form").isin(11, 12), "2").otherwise(default)
    name2 = F.when(F.col("odd") & (F.col("kind") == "rename"), F.concat(name1, F.lit("z"))).otherwise(name1)
    element = lambda id_, name, told, t, v: rows.select(F.col("element").alias("kind"), F.col(id_).alias("id"), name.alias("name"), told.alias("description"), v.alias("default_value"), t.alias("types"))
    v1, v2 = element("id1", name1, F.lit("text"), types1, default), element("id2", name2, told2, types2, default2)
    # siblings that calledAfter and group name: functions m/g, parameters f/a and f/b; odd parts' have no successor
    near1 = F.when(F.col("kind") == "calledAfter", F.array(F.format_string("lib/m%d/g%d", F.col("p_size"), F.col("p_partkey")))).otherwise(F.array(F.concat("holder1", F.lit("/a")), F.concat("holder1", F.lit("/b"))))
    siblings = rows.where("kind IN ('calledAfter', 'group') AND NOT odd").select(F.when(F.col("kind") == "group", "parameter").otherwise("function").alias("kind"), F.explode(near1).alias("id"))
    sure = F.lit(1.0).alias("similarity")
    mappings = rows.select(F.col("element").alias("kind"), sure, F.array("id1").alias("v1_ids"), F.array("id2").alias("v2_ids")).unionByName(siblings.select("kind", sure, F.array("id").alias("v1_ids"), F.array("id").alias("v2_ids")))
    null = lambda t: F.lit(None).cast(t)
    only = lambda k, v: F.when(F.col("kind") == k, v)
    limits = F.struct(F.lit(False).alias("isDiscrete"), F.lit(0.5).alias("lowerIntervalLimit"), F.lit(1).alias("lowerLimitType"), (F.col("p_size") + F.lit(0.5)).alias("upperIntervalLimit"), F.lit(0).alias("upperLimitType"))
    filled = {
        "kind": F.col("kind"), "target": F.col("id1"), "authors": F.array(F.lit("me")), "reviewers": F.array().cast("array<string>"), "comment": F.lit(""), "reviewResult": F.lit(""),
        "variant": only("value", F.element_at(F.array(*[F.lit(x) for x in ("constant", "omitted", "optional", "required")]), F.col("form") - 9)), "default_value_type": F.when(F.col("form").isin(10, 12), "number"), "default_value": F.when(F.col("form").isin(10, 12), "1"),
        "enum_name": only("enum", F.lit("E")), "pairs": only("enum", F.array(F.struct(F.lit("a").alias("stringValue"), F.lit("A").alias("instanceName")))), "interval": only("boundary", limits),
        "calledAfterName": only("calledAfter", F.format_string("g%d", F.col("p_partkey"))), "newDescription": only("description", F.lit("better")), "groupName": only("group", F.lit("G")), "parameters": only("group", F.array(F.lit("a"), F.lit("b"))),
        "destination": only("move", F.lit("elsewhere")), "newName": only("rename", F.lit("fresh")), "newTodo": only("todo", F.lit("look")), "is_depending_on": null("array<string>"), "has_dependent_parameter": null("array<string>"), "condition": null("string"), "action": null("string"),
    }
    columns = spark.createDataFrame([], schema.ANNOTATIONS).columns
    return rows.select(*[filled[n].alias(n) for n in columns]), mappings.withColumn("ord", -F.col("similarity")), v1, v2


_ANNOTATED_SQL = f"""WITH a AS (
  SELECT p_partkey, p_size, p_partkey % {len(_KINDS)} AS form, {list(_KINDS)!r}[p_partkey % {len(_KINDS)} + 1] AS kind, (p_partkey // 14) % 2 = 1 AS odd FROM part),
b AS (
  SELECT *, 'lib/m' || (p_size + CASE WHEN odd AND kind = 'move' THEN 1 ELSE 0 END) || '/f' || p_partkey || CASE WHEN kind IN ('boundary', 'enum', 'value') THEN '/x' ELSE '' END AS target FROM a),
c AS (
  SELECT *, CASE WHEN NOT odd THEN 'keep' WHEN kind IN ('boundary', 'description', 'move', 'rename') THEN 'unsure' WHEN kind = 'enum' THEN 'drop' WHEN form = 10 THEN 'todo' WHEN form IN (11, 12, 13) THEN 'unsure'
    WHEN kind IN ('calledAfter', 'group') THEN 'todo' ELSE 'keep' END AS outcome FROM b)"""


@query(
    f"""{_ANNOTATED_SQL} SELECT CASE WHEN outcome = 'todo' THEN 'todo' ELSE kind END AS kind, target, CASE WHEN outcome = 'unsure' THEN 'unsure' ELSE '' END AS review, 'reliable' AS store, 'me,migration' AS authors,
 CASE WHEN outcome <> 'todo' AND kind = 'value' THEN ['constant', 'omitted', 'optional', 'required'][form - 9] END AS variant,
 CASE WHEN kind = 'boundary' THEN CASE WHEN odd THEN 'true 1.0 0 ' || p_size || '.0 0' ELSE 'false 0.5 1 ' || p_size || '.5 0' END END AS interval,
 CASE WHEN outcome = 'keep' AND kind = 'calledAfter' THEN 'g' || p_partkey END AS called, CASE WHEN outcome = 'keep' AND kind = 'group' THEN 'G:a,b' END AS grouped,
 outcome = 'unsure' AS explained, outcome = 'todo' AS todo_told FROM c WHERE outcome <> 'drop'"""
)
def carry_annotations(spark, d):
    """All kinds of annotations, carried to the second version, kept, unsure or turned into a todo."""
    out = carry.carry(*annotated(spark, d))
    i = F.col("interval")
    shown = F.when(i.isNotNull(), F.concat_ws(" ", i["isDiscrete"], i["lowerIntervalLimit"], i["lowerLimitType"], i["upperIntervalLimit"], i["upperLimitType"]))
    return out.select(
        "kind", "target", F.col("reviewResult").alias("review"), "store", F.array_join("authors", ",").alias("authors"), "variant", shown.alias("interval"), F.col("calledAfterName").alias("called"),
        F.when(F.col("groupName").isNotNull(), F.concat_ws(":", "groupName", F.array_join("parameters", ","))).alias("grouped"), F.startswith("comment", F.lit("The @")).alias("explained"), F.coalesce(F.startswith("newTodo", F.lit("The @")), F.lit(False)).alias("todo_told"),
    )


@query(
    f"""{_ANNOTATED_SQL} SELECT kind, 'lib/m' || p_size || '/f' || p_partkey || CASE WHEN kind IN ('boundary', 'enum', 'value') THEN '/x' ELSE '' END AS target,
 CASE kind WHEN 'boundary' THEN p_size || '.5' WHEN 'calledAfter' THEN 'g' || p_partkey WHEN 'description' THEN 'better' WHEN 'enum' THEN 'E:a' WHEN 'group' THEN 'G' WHEN 'move' THEN 'elsewhere' WHEN 'rename' THEN 'fresh' WHEN 'todo' THEN 'look'
   WHEN 'value' THEN ['constant', 'omitted', 'optional', 'required'][form - 9] ELSE '' END AS payload FROM a"""
)
def annotations_file(spark, d):
    """Annotations of all kinds through their JSON file."""
    json_io.write_annotations(annotated(spark, d)[0], path := new_path(spark, "annotations"))
    rows = json_io.read_annotations(spark, path)
    payload = F.coalesce("variant", F.concat_ws(":", "enum_name", F.col("pairs")[0]["stringValue"]), F.lit(""))
    payload = F.when(F.col("kind") == "boundary", F.col("interval.upperIntervalLimit").cast("string")).when(F.col("kind").isin("enum", "value"), payload)
    return rows.select("kind", "target", F.coalesce(payload, "calledAfterName", "newDescription", "groupName", "destination", "newName", "newTodo", F.lit("")).alias("payload"))


# ---------------------------------------------------------------- similarity


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_brand FROM part),
c AS (SELECT word, chr(32 + row_number() OVER (ORDER BY word)::INT) AS sign FROM w),
t AS (SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), [p_type, p_brand])) AS word, generate_subscripts(list_concat(string_split(p_name, ' '), [p_type, p_brand]), 1) AS nth FROM part),
s AS (SELECT p_partkey, string_agg(sign, '' ORDER BY nth) AS signs, count(*) AS n FROM t JOIN c USING (word) GROUP BY 1)
SELECT a.p_partkey AS id, round(1 - levenshtein(a.signs, b.signs)::DOUBLE / greatest(a.n, b.n), 6) AS similarity FROM s a JOIN s b ON b.p_partkey = a.p_partkey + 1"""
)
def list_similarity(spark, d):
    """Edit distance of token lists, of every part and the next."""
    t = p.read(spark, d, "part").select("p_partkey", F.concat(F.split("p_name", " "), F.array("p_type", "p_brand")).alias("t"))
    rows = t.alias("a").join(t.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    return rows.select(F.col("a.p_partkey").alias("id"), F.round(similarity.short_list_similarity(F.col("a.t"), F.col("b.t")), 6).alias("similarity"))


@query(
    """WITH e AS (SELECT p_partkey AS id, p_partkey % 4 AS form, 'p/' || p_brand || '.' || p_type || '.c/F/g' AS a FROM part)
SELECT id, CASE form WHEN 0 THEN 1.0 WHEN 1 THEN 1 - 0.25 / 2.5 WHEN 2 THEN 1 - 1.0 / 2.5 ELSE 1 - (1.0 + 0.25) / 2.5 END AS similarity FROM e"""
)
def id_similarity(spark, d):
    """Paths of four segments, equal, or with the last, the first or both of them another."""
    path = lambda head, tail: F.concat(F.lit("p/"), F.when(head, "other").otherwise(F.col("p_brand")), F.lit("."), F.col("p_type"), F.lit(".c/"), F.when(tail, "Other").otherwise("F"), F.lit("/g"))
    form = F.col("p_partkey") % 4
    rows = p.read(spark, d, "part").select("p_partkey", path(F.lit(False), F.lit(False)).alias("a"), path(form >= 2, form % 2 == 1).alias("b"))
    return rows.select(F.col("p_partkey").alias("id"), F.round(similarity.id_similarity("a", "b"), 6).alias("similarity"))


__all__ = ["ORACLES", "QUERIES"]
