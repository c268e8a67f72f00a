"""Dependencies between the parameters of a function, as adverbial clauses of their descriptions state them. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that tell the kinds of conditions and actions.
IS_NONE = ("is none", "is also none", "is not set", "is not specified", "is not none", "if none", "if not none")
HAS_VALUE = ("equals", "is true", "is false", "is set to", "is greater than", "is less than")
IGNORED = ("ignored", "not used", "no impact", "only supported", "only applies")
ILLEGAL = ("raise", "exception", "must be", "must not be")

#: A clause up to the next comma, and its subject.
CLAUSE = r"(?i)\b((?:if|when|unless)\s+(?:the\s+)?([A-Za-z_]\w*)\s+(?:is|are|was|equals|does|has|will)\b[^,]*)"


def cleaned(text: Column) -> Column:
    """Without quotes and backticks, signs of equality as words, single blanks."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "[`'\"]", "")
    for pattern, word in ((r"\s*!=\s*", " does not equal "), (r"\s*={1,2}\s*", " equals "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, word)
    return F.trim(out)


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(phrases))


def sibling_dependencies(parameters: DataFrame) -> DataFrame:
    """function_id, parameter_id, dependee_id, condition, condition_kind, action, action_kind.

    parameters: function_id, parameter_id, name, description. A sentence with a clause whose subject is
    another parameter of the function makes its parameter depend on that one; subjects that are none of the
    function's parameters make nothing. The action is the rest of the sentence.
    """
    told = parameters.select("function_id", "parameter_id", F.posexplode(F.split(cleaned(F.col("description")), r"\. +")).alias("nth", "sentence"))
    found = told.select("function_id", "parameter_id", "nth", "sentence", F.regexp_extract("sentence", CLAUSE, 1).alias("clause"), F.regexp_extract("sentence", CLAUSE, 2).alias("subject")).where(F.col("subject") != "")
    siblings = parameters.select(F.col("function_id").alias("of"), F.col("name").alias("subject"), F.col("parameter_id").alias("dependee_id"))
    rows = found.join(siblings, (F.col("function_id") == F.col("of")) & (found["subject"] == siblings["subject"]))
    strip = lambda c: F.regexp_replace(F.trim(c), r"^[ ,]+|[ ,.]+$", "")
    condition, action = strip(F.col("clause")), strip(F.replace(F.col("sentence"), F.col("clause"), F.lit("")))
    rows = rows.select("function_id", "parameter_id", "dependee_id", "nth", condition.alias("condition"), action.alias("action")).where(F.col("action") != "")
    condition_kind = F.when(_says(F.col("condition"), IS_NONE), "is_none").when(_says(F.col("condition"), HAS_VALUE), "has_value").otherwise("other")
    action_kind = F.when(_says(F.col("action"), IGNORED), "is_ignored").when(_says(F.col("action"), ILLEGAL), "is_illegal").otherwise("other")
    return rows.select("function_id", "parameter_id", "dependee_id", "nth", "condition", condition_kind.alias("condition_kind"), "action", action_kind.alias("action_kind"))
