"""Facts stated in docstrings: bounds, literals, call order, dependencies. Rules over text; no language model."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
_NUM = r"[-+]?(?:\d+\.?\d*(?:e[-+]?\d+)?|\.\d+)"
_WORDS = dict(zip(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"), range(10), strict=True))
_HALF_LINES = {"non-negative": (0.0, True, INF, False), "non-positive": (-INF, False, 0.0, True), "positive": (0.0, False, INF, False), "negative": (-INF, False, 0.0, False)}

#: Relations as words (fixed values), longer signs first.
RELATIONS = {">=": "GEQ$", "<=": "LEQ$", "<": "LT$", ">": "GT$"}


def bounds_text(text: Column) -> Column:
    """A text ready for rules about bounds: relations as words, no backticks, single blanks."""
    for sign, word in RELATIONS.items():
        text = F.replace(text, F.lit(sign), F.lit(word))
    return F.regexp_replace(F.replace(text, F.lit("`"), F.lit("")), r"\s+", " ")


def values_text(text: Column, is_type: bool = False) -> Column:
    """A text ready for rules about values: runs of backticks as one; of a type string, single blanks."""
    text = F.regexp_replace(text, "`+", "`")
    return F.regexp_replace(text, r"\s+", " ") if is_type else text


# ------------------------------------------------------------- bounds


def _number(text: str) -> float:
    text = text.strip().lower()
    if text in _WORDS:
        return float(_WORDS[text])
    if "inf" in text:
        return -INF if text.startswith(("-", "neg")) else INF
    return float(text)


def _half_line(op: str, value: float) -> tuple:
    return {">": (value, False, INF, False), ">=": (value, True, INF, False), "<": (-INF, False, value, False), "<=": (-INF, False, value, True)}[op]


def _meet(a: tuple, b: tuple) -> tuple:
    low = max((a[0], not a[1]), (b[0], not b[1]))
    high = min((a[2], a[3]), (b[2], b[3]))
    return low[0], not low[1], high[0], high[1]


_ENDS = rf"(?:{_NUM}|[-+]?(?:np\.)?inf(?:inity)?|negative_infinity)"
_BRACKETS = re.compile(rf"([\[(])\s*({_ENDS})\s*,\s*({_ENDS})\s*([\])])", re.I)
_BETWEEN = re.compile(rf"(strictly\s+)?between\s+({_NUM}|{'|'.join(_WORDS)})\s+and\s+({_NUM}|{'|'.join(_WORDS)})", re.I)
_LEAST = re.compile(rf"(?:at\s+least|minimum(?:\s+of)?|min\.?)\s+({_NUM}|{'|'.join(_WORDS)})", re.I)
_CHAIN = re.compile(rf"({_NUM})\s*(<=|>=|<|>)\s*[A-Za-z_][\w.]*\s*(<=|>=|<|>)\s*({_NUM})")
_AND = re.compile(rf"[A-Za-z_][\w.]*\s*(<=|>=|<|>)\s*({_NUM})\s+(?:and|or)\s+(<=|>=|<|>)\s*({_NUM})")
_SIDE = re.compile(rf"(?:int|float|must\s+be|should\s+be)\s*(<=|>=|<|>)\s*({_NUM})", re.I)
_SIGN = re.compile(r"(?<!\w)(non-negative|non-positive|positive|negative)\b", re.I)
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _bounds_of(text: str) -> list[tuple[int, tuple]]:
    """(position, (min, closed, max, closed)) of all bounds that a text states, ascending; overlapping ones count once."""
    found: list[tuple[int, int, tuple]] = []

    def add(m, b):
        if not any(s < m.end() and m.start() < e for s, e, _ in found):
            found.append((m.start(), m.end(), b))

    for m in _CHAIN.finditer(text):
        add(m, _meet(_half_line(_FLIP[m[2]], float(m[1])), _half_line(m[3], float(m[4]))))
    for m in _AND.finditer(text):
        add(m, _meet(_half_line(m[1], float(m[2])), _half_line(m[3], float(m[4]))))
    for m in _BRACKETS.finditer(text):
        low, high = _number(m[2]), _number(m[3])
        left, right = m[1] == "[", m[4] == "]"
        if low > high:
            low, high, left, right = high, low, right, left
        # an infinite end is open, and a bracketed list of three or more numbers is none
        add(m, (low, left and low != -INF, high, right and high != INF))
    for m in _BETWEEN.finditer(text):
        ends = sorted((_number(m[2]), _number(m[3])))
        add(m, (ends[0], not m[1], ends[1], not m[1]))
    for m in _LEAST.finditer(text):
        add(m, (_number(m[1]), True, INF, False))
    for m in _SIDE.finditer(text):
        add(m, _half_line(m[1], float(m[2])))
    for m in _SIGN.finditer(text):
        add(m, _HALF_LINES[m[1].lower()])
    return sorted((s, b) for s, _, b in found)


def extract_boundaries(type_text: str, description: str) -> list[tuple[str, float, bool, float, bool]]:
    """(base type, min, closed, max, closed) for the numeric types of a parameter.

    A type string's own bounds hold first, each for the type it follows; else those of the description:
    after "If int" or "If float" they hold for this type, otherwise for the last of the types. With a
    single type and several bounds, brackets and relations go before words like positive.
    """
    type_text = type_text or ""
    # of the string's alternatives, those that are numbers
    own = [(m.start(), m[1]) for m in re.finditer(r"\b(int|float)\b", type_text)]
    bases = [b for _, b in own]
    if not bases:
        return []
    out: dict[str, tuple] = {}
    for at, b in _bounds_of(type_text):
        before = [t for s, t in own if s <= at] or [own[0][1]]
        after = [t for s, t in own if s > at]
        out[after[0] if re.match(r"non-|positive|negative", type_text[at:]) and after else before[-1]] = b
    if not out:
        parts = re.split(r"\bif\s+(int|float)\b", description or "", flags=re.I)
        for base, part in zip([None, *[p.lower() for p in parts[1::2]]], parts[0::2], strict=True):
            stated = [b for _, b in _bounds_of(part)]
            if base is None and re.search(r"\bmust\b|\bshould\b|\brange\b|\binterval\b|\bbetween\b|\bwith\b|\bvalues\s+(?:is|are)\b", part, re.I) is None:
                continue
            target = base if base in bases else bases[-1]
            if stated and target not in out:
                out[target] = stated[-1] if base else stated[0]
    return sorted((base, *b) for base, b in out.items())


# ------------------------------------------------------------- literals

_QUOTED = r"""`{0,2}["']([^"'\n]+)["']`{0,2}"""
_BARE = r"`{0,2}(True|False|None)`{0,2}"
_ITEM = rf"(?:{_QUOTED}|{_BARE})"
_LIST = rf"\[?\s*{_ITEM}(?:(?:\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+){_ITEM})*"
_LISTS = [re.compile(p, re.I) for p in (rf"valid\s+values\s+are:?\s*({_LIST})", rf"string\s+inputs,?\s*({_LIST})\s+are\s+supported", rf"supported\s+\w+\s+are:?\s*({_LIST}.*?)(?:\.|$)", rf"when\s+set\s+to:?\s*({_LIST})", rf"possibilities\s+are:?\s*({_LIST})")]
_IF = re.compile(rf"\bif\s+{_QUOTED}\s*(?:,|:)", re.I)
_IF_BARE = re.compile(rf"\bif\s+{_BARE}\s*,", re.I)
_POINTS = re.compile(rf"^\s*(?:[-*]\s+)?{_ITEM}\s*:", re.M)


def _literals(text: str, flag: bool) -> set[str]:
    out = set()
    for quoted, bare in re.findall(_ITEM, text):
        if quoted in ("True", "False", "None"):
            bare = quoted
        if bare in ("True", "False"):
            out |= {"True", "False"} if flag else set()
        elif bare:
            out.add(bare)
        elif quoted and quoted not in ("int", "float"):
            out.add(f'"{quoted}"')
    return out


def extract_literals(description: str, type_text: str) -> set[str]:
    """Values that a parameter may take: strings in double quotes, True, False, None; unlistable_str if it takes strings of which none is listed.

    A type string's quoted values and None count; bool gives both flags; for strings the description's
    lists, its "If 'x'," clauses and its indented points.
    """
    type_text, description = type_text or "", description or ""
    bare_type = re.sub(r"\{.*?\}|" + _QUOTED, " ", type_text)
    flag, string = bool(re.search(r"\bbool", bare_type)), bool(re.search(r"\bstr(?:ings?)?\b", bare_type))
    out = {f'"{v}"' for v in re.findall(r"""["']([^"']+)["']""", type_text)}
    if flag:
        out |= {"True", "False"}
    if re.search(r"\bNone\b", bare_type):
        out.add("None")
    if string:
        stated: set[str] = set()
        for rule in _LISTS:
            for m in rule.finditer(description):
                stated |= _literals(m[1], flag)
        for m in _IF.finditer(description):
            stated |= _literals(f"'{m[1]}'", flag) if re.fullmatch(r"[\w \-]+", m[1]) else set()
        for m in _IF_BARE.finditer(description):
            stated |= _literals(m[1], flag)
        for m in _POINTS.finditer(description):
            stated |= _literals(m[0], flag)
        out |= stated
        if not any(v.startswith('"') for v in out):
            out.add("unlistable_str")
    return out


# ------------------------------------------------------------- call order

_NAME = r"(?::\w+:)?[`'\"]{0,2}([~\w](?:[\w.~]*\w)?)[`'\"]{0,2}(?:\(\))?"


def extract_called_after(function: str, description: str) -> tuple[list[str], str] | None:
    """(other functions, before or after): what has to be called before or after, as the description says."""
    text = " ".join((description or "").split())
    names = rf"{_NAME}(?:\s+or\s+{_NAME})?"
    if m := re.search(rf"{names}\s+must\s+be\s+called\s+(before|after)\s+{names}", text):
        left, right = [x for x in m.group(1, 2) if x], [x for x in m.group(4, 5) if x]
        own_left = left[0].rsplit(".")[-1] == function
        return (right if own_left else left, m[3])
    if m := re.search(rf"(before|after)\s+{names}\s+is\s+called(?:,\s+{names}\s+must\s+be\s+called)?", text, re.I):
        others = [x for x in m.group(4, 5) if x]
        if others and m[2].rsplit(".")[-1] == function:
            return others, "after" if m[1].lower() == "before" else "before"
        return [x for x in m.group(2, 3) if x], m[1].lower()
    return None


# ------------------------------------------------------------- dependencies


def clean_docstring(text: str) -> str:
    """Quotes and backticks gone, == and is set to as words, relations as tokens, single blanks."""
    text = re.sub(r"[`'\"]", "", text or "")
    for pattern, word in (
        (r">=|is (?:greater than or equal to|at least)", " $GEQ$ "), (r"<=|is (?:less than or equal to|at most)", " $LEQ$ "), (r"!=|is not set to", " does not equal "), (r"==?|(?:is|are) set to", " equals "),
        (r">|is (?:greater|larger) than", " $GT$ "), (r"<|is (?:less|smaller) than", " $LT$ "), (r"\b(?:is|are) not set\b", "is None"),
    ):
        text = re.sub(pattern, word, text)
    return re.sub(r"\s+", " ", text).strip()


_PARAM = r"([A-Za-z_][\w.]*)"
_VERBS = r"(?:is|equals|are|does not equal)"
_TYPES = ("callable", "integer", "int", "float", "string", "str", "boolean", "bool", "list", "dict", "array", "array-like", "sparse")
_ONLY = re.compile(r"\bonly\b.*?\b(?:if|when|for|in)\b", re.I)
_USED = re.compile(r"^\s*used\b.*\b(?:if|when)\b", re.I)
_IGNORED = re.compile(r"\bignored\b", re.I)
_RAISES = re.compile(r"\braises?\b|error\s+(?:is|will\s+be)\s+raised", re.I)
_MUST = re.compile(r"\b(must|should|has\s+to)\s+be\s+(.+)$|\bis\s+(?:automatically\s+)?set\s+to\s+(.+)$|\bwill\s+be\s+(?:set\s+to\s+)?(.+)$", re.I)
_IF_CLAUSE = re.compile(r"\b(?:if|when|unless)\b\s+(.+?)(?:,|\bthen\b|$)", re.I)
_BRACKETED = re.compile(r"\((?:if|when)\s", re.I)
_ACCEPTED = re.compile(r"\bonly\s+(\S+)\s+(?:is|are)\s+(?:accepted|allowed|supported)\b", re.I)
_PREFER = re.compile(r"^\s*prefer\s+(.+?)\s+(?:if|when)\b", re.I)
_CLAUSE = re.compile(rf"(?:the\s+)?{_PARAM}\s+({_VERBS})\s+(?:(not)\s+)?(?:an?\s+|the\s+)?([\w.\-*+#/:]+)((?:(?:\s*,\s+[\w.\-*+#/:]+)*\s*,?\s+(?:or|and)\s+[\w.\-*+#/:]+(?!\s+(?:{_VERBS}|will|must)))?)")
_RELATION = re.compile(rf"{_PARAM}\s+\$(GEQ|LEQ|GT|LT)\$\s+([\w.\-]+)")
_STOP = {"this", "it", "that", "there", "value", "a", "an", "the", "parameter"}


_SIGNS = {"GEQ": ">=", "LEQ": "<=", "GT": ">", "LT": "<"}
_SUBJECT = re.compile(r"([A-Za-z_][\w.]*)\s+(?:must\s+be|should\s+be|has\s+to\s+be|will\s+be|is\s+(?:automatically\s+)?set\s+to|(?:is|are)\s+ignored)\b", re.I)


def _condition(clause: str) -> list[dict]:
    """Conditions of one clause: {variant, dependee, value}."""
    if m := _RELATION.search(clause):
        return [{"variant": "in_relation", "dependee": m[1], "value": f"{_SIGNS[m[2]]} {m[3]}"}]
    m = _CLAUSE.search(clause)
    if not m or m[1].lower() in _STOP:
        return []
    name, verb, no, value, more = m.groups()
    values = [value, *[v for v in re.split(r"\s*,\s*(?:or\s+|and\s+)?|\s+(?:or|and)\s+", more) if v.strip()]]
    out = []
    for v in (v.strip().rstrip(".") for v in values):
        if v.lower() in _TYPES:
            variant, v = ("has_not_type", f"not {v}") if no else ("has_type", v)
        elif v == "None":
            variant, v = ("has_value", "not None") if no else ("is_none", None)
        else:
            variant = "has_not_value" if no or verb == "does not equal" else "has_value"
        out.append({"variant": variant, "dependee": name, "value": v})
    return out


def _action(sentence: str) -> tuple[str, str] | None:
    """(variant, text) of what follows for the documented parameter."""
    if _IGNORED.search(sentence) and not re.search(r"\bnot\s+ignored\b", sentence, re.I):
        return "is_ignored", "ignored"
    if m := _ACCEPTED.search(sentence) or _PREFER.search(sentence):
        return "will_be_set_to", m[1]
    if _ONLY.search(sentence) or _USED.search(sentence) or _BRACKETED.search(sentence):
        return "is_ignored", "not ignored"
    if _RAISES.search(sentence):
        return "is_illegal", "illegal"
    rest = _IF_CLAUSE.sub("", sentence, count=1)
    if m := _MUST.search(rest):
        value = next(x for x in (m[2], m[3], m[4]) if x).rstrip(". ")
        return ("is_restricted" if m[1] else "will_be_set_to"), value
    return None


def _depender(sentence: str, variant: str, text: str) -> tuple[str, str]:
    """The parameter that the action is about, this_parameter unless another is named, and the action's text."""
    if m := re.fullmatch(r"([A-Za-z_][\w.]*) equals (.+)", text):
        return m[1], m[2]
    m = _SUBJECT.search(_IF_CLAUSE.sub("", sentence, count=1)) if variant in ("is_ignored", "will_be_set_to") else None
    return ("this_parameter" if not m or m[1].lower() in _STOP else m[1]), text


def extract_dependencies(parameter: str, description: str) -> list[dict]:
    """A dict for each dependency of a parameter that its description states, sentence by sentence; keys as in DEPENDENCIES.

    Conditions joined by "or" are dependencies of their own; of those joined by "and" the last one is the
    dependency's and the others are in combined_with.
    """
    out = []
    for sentence in re.split(r"(?<=[a-z\d)])\.\s+(?=[A-Z])|\.$", clean_docstring(description)):
        action = _action(sentence or "")
        clause = re.search(r"\b(?:if|when|unless|for)\b\s+(.*)$", sentence or "", re.I)
        if not action or not clause:
            continue
        depender, text = _depender(sentence, *action)
        also = re.search(r"\b(?:is|are)\s+also\b", clause[1]) is not None
        parts = re.split(r"\s+(or|and)\s+(?=(?:the\s+)?[A-Za-z_][\w.]*\s+(?:is|equals|are|does|\$))", clause[1])
        held: list[dict] = []
        for joint, part in zip(["", *parts[1::2]], parts[0::2], strict=True):
            for i, c in enumerate(_condition(re.sub(r"\b(is|are)\s+also\b", r"\1", part or ""))):
                before = [held.pop()] if joint == "and" and i == 0 and held else []
                held.append(c | {"combined_with": [x for y in before for x in (*y["combined_with"], {k: y[k] for k in ("variant", "dependee", "value")})]})
        out += [{"param": parameter, **c, "also": also, "condition": sentence.strip(), "action_variant": action[0], "action": text, "depender": depender} for c in held]
    return out


# ------------------------------------------------------------- over columns

BOUNDS = "array<struct<base_type:string,min:double,min_inclusive:boolean,max:double,max_inclusive:boolean>>"
DEPENDENCIES = (
    "array<struct<param:string,variant:string,dependee:string,value:string,combined_with:array<struct<variant:string,dependee:string,value:string>>,also:boolean,"
    "condition:string,action_variant:string,action:string,depender:string>>"
)


def boundaries(type_text, description) -> Column:
    def run(t: pd.Series, d: pd.Series) -> pd.Series:
        keys = ("base_type", "min", "min_inclusive", "max", "max_inclusive")
        return pd.Series([[dict(zip(keys, b, strict=True)) for b in extract_boundaries(x, y)] for x, y in zip(t, d, strict=True)], dtype=object)

    return F.pandas_udf(run, BOUNDS)(type_text, description)


def valid_literals(description, type_text) -> Column:
    def run(d: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([sorted(extract_literals(x, y)) for x, y in zip(d, t, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<string>")(description, type_text)


def called_after(function, description) -> Column:
    def run(f: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [extract_called_after(x, y) or (None, None) for x, y in zip(f, d, strict=True)]
        return pd.DataFrame({"others": [r[0] for r in rows], "order": [r[1] for r in rows]})

    return F.pandas_udf(run, "struct<others:array<string>,order:string>")(function, description)


def dependencies(parameter, description) -> Column:
    def run(p: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([extract_dependencies(x, y) for x, y in zip(p, d, strict=True)], dtype=object)

    return F.pandas_udf(run, DEPENDENCIES)(parameter, description)
