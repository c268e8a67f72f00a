"""Identifiers, visibility and wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_id(c) -> Column:
    """An id without its last /segment."""
    return F.regexp_replace(c, r"/[^/]*$", "")


def parent_qname(c) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


def last_name(c) -> Column:
    return F.substring_index(c, ".", -1)


def depth(c) -> Column:
    return F.size(F.split(c, "/"))


def is_global_function(c) -> Column:
    """package/module/function: three segments."""
    return depth(c) == 3


def make_id(*parts, decorators: Column | None = None) -> Column:
    """Segments joined by /, with the suffix that property decorators give a function."""
    joined = F.concat_ws("/", *parts)
    if decorators is None:
        return joined
    ends = lambda what: F.exists(decorators, lambda d: d.rlike(rf"^[^.]*.{what}$"))
    suffix = F.when(F.array_contains(decorators, "property"), "@getter").when(ends("setter"), "@setter").when(ends("deleter"), "@deleter").otherwise("")
    return F.concat(joined, suffix)


def module_name(path, root) -> Column:
    """The dotted name of a file below root's parent; every '.py' goes."""
    inner = F.expr(f"substring({_sql(path)}, length(regexp_replace({_sql(root)}, '[^/]*/?$', '')) + 1)")
    return F.translate(F.replace(inner, F.lit(".py"), F.lit("")), "/", ".")


def _sql(x) -> str:
    return x if isinstance(x, str) else x._jc.toString()


def is_test_path(c) -> Column:
    return F.col(c).rlike("/tests?/") if isinstance(c, str) else c.rlike("/tests?/")


def is_init_path(c) -> Column:
    return F.endswith(F.col(c) if isinstance(c, str) else c, F.lit("__init__.py"))


def _open_name(c: Column) -> Column:
    return ~F.startswith(c, F.lit("_"))


def is_public_module(qname: Column) -> Column:
    return F.forall(F.split(qname, r"\."), _open_name)


def is_public(name: Column, qname: Column, reexported: Column, parent_reexported: Column) -> Column:
    """Private by name; else public if it or its class is re-exported, or no segment before the last begins with _."""
    private = F.startswith(name, F.lit("_")) & ~F.endswith(name, F.lit("__"))
    outer = F.split(qname, r"\.")
    open_path = F.forall(F.slice(outer, F.lit(1), F.size(outer) - 1), _open_name)
    return ~private & (reexported | parent_reexported | open_path)


def pluralize(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))


def percent(p: Column, digits: int = 2) -> Column:
    """0.0123 as 1.23%."""
    return F.format_string(f"%.{digits}f%%", p * 100)


def code_slice(source: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1), joined by newlines."""
    return F.array_join(F.slice(F.split(source, "\n"), first, last - first + 1), "\n")
