"""Similarities of API elements, from 0 to 1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .literals import default_similarity


def name_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


#: Distances: implicit or not, variadic or not, by position or by name (half for either).
_STEP = 0.3
_TRAITS = {"IMPLICIT": None, "POSITION_ONLY": (0, 0.0), "POSITION_OR_NAME": (0, 0.5), "NAME_ONLY": (0, 1.0), "POSITIONAL_VARARG": (1, 0.0), "NAMED_VARARG": (1, 1.0)}


def assignment_table() -> list[tuple[str, str, float]]:
    """All 36 pairs of parameter assignments with their similarity."""
    out = []
    for a, x in _TRAITS.items():
        for b, y in _TRAITS.items():
            if a == b:
                far = 0.0
            elif x is None or y is None:  # implicit ones pass by position: only a variadic of names is further off
                variadic, by = y or x
                far = 1 + variadic * (1 + (by == 1.0))
            else:
                far = abs(x[0] - y[0]) + abs(x[1] - y[1])
            out.append((a, b, round(1 - _STEP * far, 6)))
    return out


def assignment_similarity(a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(v) for x, y, s in assignment_table() for v in (f"{x}>{y}", s)])
    return F.element_at(table, F.concat_ws(">", a, b))


def list_distance(a: list, b: list) -> int:
    """Edit distance of two lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _listed(x) -> list:
    return [] if x is None else list(x)


@F.pandas_udf(T.DoubleType())
def list_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 less the edit distance of two arrays over the longer size."""
    pairs = ((_listed(x), _listed(y)) for x, y in zip(a, b, strict=True))
    return pd.Series([1 - list_distance(x, y) / max(len(x), len(y), 1) for x, y in pairs])


def short_list_similarity(a: Column, b: Column) -> Column:
    """list_similarity as a built-in expression, for arrays of a few items."""
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def row(r, x):
        cell = lambda acc, j: F.concat(acc, F.array(F.least(F.get(acc, j - 1) + 1, F.get(r, j) + 1, F.get(r, j - 1) + F.when(F.get(b, j - 1) == x, 0).otherwise(1))))
        return F.aggregate(steps(F.size(b)), F.array(F.get(r, F.lit(0)) + 1), cell)

    last = F.element_at(F.aggregate(a, F.sequence(F.lit(0), F.size(b)), row), -1)
    return 1 - last / F.greatest(F.size(a), F.size(b), F.lit(1))


def doc_similarity(a: Column, b: Column) -> Column:
    """Of descriptions by their tokens; -1 if both are empty."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((x == "") & (y == ""), -1.0).otherwise(list_similarity(F.split(x, "[\n ]"), F.split(y, "[\n ]")))


def id_path(id_: str) -> list[str]:
    """Module path and enclosing declarations of an id, without package and own name."""
    parts = id_.split("/")
    return parts[1].split(".") + parts[2:-1] if len(parts) > 1 else []


def edit_script(a: list[str], b: list[str]) -> str:
    """One letter per step of a shortest edit from the shorter list to the longer, "=" where nothing changes; ties prefer the row above, then the left."""
    if a == b:
        return "=" * len(a)
    if len(a) > len(b):
        a, b = b, a
    above = [(j, "+" * j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [(i, "-" * i)]
        for j, y in enumerate(b, 1):
            if x == y:
                row.append((above[j - 1][0], above[j - 1][1] + "="))
            else:
                cost, script, sign = min(((*above[j], "+"), (*row[j - 1], "-"), (*above[j - 1], "o")), key=lambda c: c[0])
                row.append((cost + 1, script + sign))
        above = row
    return above[-1][1]


def weighted_path_similarity(a: list[str], b: list[str]) -> float:
    """1 less the edits' costs, where the step i of m costs (m - i + 1) / m, over the sum of all steps' costs."""
    script = edit_script(a, b)
    m = len(script)
    if not m:
        return 1.0
    cost = sum((m - i) / m for i, sign in enumerate(script) if sign != "=")
    return 1 - cost / ((m + 1) / 2)


@F.pandas_udf(T.DoubleType())
def id_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_path_similarity(id_path(x), id_path(y)) for x, y in zip(a, b, strict=True)])


def _mean(terms: list[Column], optional: list[Column]) -> Column:
    """The mean of terms and of those optional ones that are not negative."""
    used = lambda c: F.when(c >= 0, c).otherwise(0.0)
    count = F.lit(float(len(terms)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    for t in optional:
        total, count = total + used(t), count + F.when(t >= 0, 1.0).otherwise(0.0)
    return total / count


def class_similarity(a, b) -> Column:
    """a, b: functions from a field's name to its column."""
    lists = lambda f: list_similarity(a(f), b(f))
    return _mean([name_similarity(a("name"), b("name")), lists("attributes"), lists("members"), lists("code_lines"), id_similarity(a("id"), b("id"))], [doc_similarity(a("description"), b("description"))])


def function_similarity(a, b) -> Column:
    lists = lambda f: list_similarity(a(f), b(f))
    return _mean([lists("code_lines"), name_similarity(a("name"), b("name")), lists("members"), id_similarity(a("id"), b("id"))], [doc_similarity(a("description"), b("description"))])


def type_similarity(a, b) -> Column:
    """Of the names of types: 1 if neither is known, 0 if one is."""
    none = lambda side: side("types").isNull()
    return F.when(none(a) & none(b), 1.0).when(none(a) | none(b), 0.0).otherwise(list_similarity(a("types"), b("types")))


def attribute_similarity(a, b) -> Column:
    return _mean([name_similarity(a("name"), b("name")), type_similarity(a, b)], [])


def result_similarity(a, b) -> Column:
    return name_similarity(a("name"), b("name"))


def parameter_similarity(a, b) -> Column:
    terms = [name_similarity(a("name"), b("name")), type_similarity(a, b), assignment_similarity(a("assigned_by"), b("assigned_by")), id_similarity(a("id"), b("id"))]
    return _mean(terms, [default_similarity(a("default_value"), b("default_value")), doc_similarity(a("description"), b("description"))])


#: What a differ computes by kind; further kinds or other measures may be registered.
SIMILARITIES = {"class": class_similarity, "function": function_similarity, "parameter": parameter_similarity, "attribute": attribute_similarity, "result": result_similarity}
