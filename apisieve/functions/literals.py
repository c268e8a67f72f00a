"""Python literals as source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's float() reads: blanks around, underscores between digits, nan and inf.
NUMBER = r"^\s*[+-]?((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?\s*$"
SPECIAL = r"^\s*[+-]?(?i:nan|inf|infinity)\s*$"
INTEGER = r"^[+-]?\d+$"


def kind(value: Column) -> Column:
    """none, boolean, number, string or null (not a literal) of a stringified value."""
    quoted = (F.length(value) > 0) & F.startswith(value, F.lit("'")) & F.endswith(value, F.lit("'"))
    return F.when(value == "None", "none").when(value.isin("True", "False"), "boolean").when(value.rlike(NUMBER) | value.rlike(SPECIAL), "number").when(quoted, "string")


def text(value: Column) -> Column:
    """A literal's value as text: strings lose their quotes, None is null."""
    return F.when(kind(value) == "string", F.substring(value, F.lit(2), F.greatest(F.lit(0), F.length(value) - 2))).when(kind(value) != "none", F.trim(value))


def to_double(value: Column) -> Column:
    """A double of text that NUMBER matches, else null."""
    return F.when(value.rlike(NUMBER), F.replace(F.trim(value), F.lit("_"), F.lit("")).try_cast("double"))


def _quoted(c: Column) -> Column:
    ends = lambda q: F.startswith(c, F.lit(q)) & F.endswith(c, F.lit(q))
    return (F.length(c) > 0) & (ends("'") | ends('"'))


def default_similarity(a: Column, b: Column, true_is_false: bool = True) -> Column:
    """Similarity of two default values: -1 if both lack, 0 if one does or nothing below holds, 1 for equal
    numbers, 0.5 for integers that differ, 1 for two booleans, 1 or 0.5 for quoted strings by their equality.

    With true_is_false, True and False are alike, since the truth of their texts is asked; without, they score 0.5.
    """
    x, y = to_double(a), to_double(b)
    boolean = F.lit(1.0) if true_is_false else F.when(a == b, 1.0).otherwise(0.5)
    inner = lambda c: F.substring(c, F.lit(2), F.greatest(F.lit(0), F.length(c) - 2))
    return (
        F.when(a.isNull() & b.isNull(), -1.0)
        .when(a.isNull() | b.isNull(), 0.0)
        .when((a == "None") & (b == "None"), 1.0)
        .when(a.rlike(INTEGER) & b.rlike(INTEGER), F.when(x == y, 1.0).otherwise(0.5))
        .when(x.isNotNull() & y.isNotNull() & (x == y), 1.0)
        .when(a.isin("True", "False") & b.isin("True", "False"), boolean)
        .when(_quoted(a) & _quoted(b), F.when(inner(a) == inner(b), 1.0).otherwise(0.5))
        .otherwise(0.0)
    )
