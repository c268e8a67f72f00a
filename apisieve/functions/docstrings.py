"""Docstrings in five styles: plaintext, numpydoc, google, rest, epydoc."""

from __future__ import annotations

import inspect
import re

STYLES = ("plaintext", "numpydoc", "google", "rest", "epydoc")


def style_of(name: str) -> str:
    """A style by its name in any case; others raise ValueError."""
    if name.lower() not in STYLES:
        raise ValueError(f"unknown docstring style {name!r}; there are {', '.join(STYLES)}")
    return name.lower()


def _clean(doc: str | None) -> str:
    return inspect.cleandoc(doc or "").strip()


def _entry(names: str, type_: str = "", default: str = "", description: str = "") -> dict:
    return {"names": [n.strip() for n in names.split(",") if n.strip()], "type": type_.strip(), "default_value": default.strip(), "description": description.strip()}


# ------------------------------------------------------------- numpydoc

_UNDERLINE = re.compile(r"^[-=]{3,}\s*$")
#: What parts a type from a default (fixed value).
_DEFAULT = re.compile(r",\s*optional|,\s*default\s*[:=]?")
_DEFAULT_VALUE = re.compile(r"default\s*(?:[:=]|is)?\s*([^,]+)$")


def _sections(lines: list[str]) -> tuple[list[str], dict[str, list[str]]]:
    head, found, current = [], {}, None
    for i, line in enumerate(lines):
        if i + 1 < len(lines) and _UNDERLINE.match(lines[i + 1]) and line.strip() and not line[:1].isspace():
            current = found.setdefault(line.strip().lower(), [])
        elif not _UNDERLINE.match(line):
            (head if current is None else current).append(line)
    return head, found


def _indented_items(lines: list[str]) -> list[tuple[str, str]]:
    """(head line, text of the deeper lines below it)."""
    items: list[tuple[str, list[str]]] = []
    for line in lines:
        if line.strip() and not line[:1].isspace():
            items.append((line.strip(), []))
        elif items:
            items[-1][1].append(line)
    return [(head, inspect.cleandoc("\n".join(["", *body])).strip()) for head, body in items]


def _numpy_type(text: str) -> tuple[str, str]:
    """Type and default of a numpydoc type line: cut at ', optional' or ', default', if this makes two parts."""
    value = _DEFAULT_VALUE.search(text)
    parts = _DEFAULT.split(text)
    return (parts[0] if len(parts) == 2 else text), (value[1] if value else "")


def _numpydoc(doc: str) -> dict:
    head, found = _sections(doc.split("\n"))
    out = {"description": "\n".join(head).strip(), "parameters": [], "attributes": [], "results": []}
    for key, target in (("parameters", "parameters"), ("other parameters", "parameters"), ("attributes", "attributes"), ("returns", "results")):
        for line, text in _indented_items(found.get(key, [])):
            names, colon, kind = line.partition(" :")
            kind, default = _numpy_type(kind.strip()) if colon else ("", "")
            out[target].append(_entry(names, kind, default, text))
    return out


# ------------------------------------------------------------- google

_GOOGLE_HEAD = re.compile(r"^(Args|Arguments|Parameters|Params|Attributes|Returns|Yields|Raises|Example|Examples|Note|Notes|Todo)\s*:\s*$")
_GOOGLE_ITEM = re.compile(r"^(\*{0,2}\w+(?:\s*,\s*\*{0,2}\w+)*)\s*(?:\(([^)]*(?:\([^)]*\)[^)]*)*)\))?\s*:\s*(.*)$")


def _google(doc: str) -> dict:
    out = {"description": "", "parameters": [], "attributes": [], "results": []}
    head, key, blocks = [], None, {}
    for line in doc.split("\n"):
        if m := _GOOGLE_HEAD.match(line):
            key = m[1].lower()
            blocks[key] = []
        elif key is None:
            head.append(line)
        else:
            blocks[key].append(line)
    out["description"] = "\n".join(head).strip()
    for key, lines in blocks.items():
        target = {"attributes": "attributes", "returns": "results", "args": "parameters", "arguments": "parameters", "parameters": "parameters", "params": "parameters"}.get(key)
        if not target:
            continue
        body = inspect.cleandoc("\n".join(["", *lines]))
        for line, more in _indented_items(body.split("\n")):
            m = _GOOGLE_ITEM.match(line)
            if target == "results":
                kind, _, text = line.partition(":")
                out["results"].append(_entry("", kind, "", f"{text.strip()}\n{more}"))
            elif m:
                text = f"{m[3]}\n{more}".strip()
                default = re.search(r"[Dd]efaults? (?:to|is) (.+?)\.?$", text)
                out[target].append(_entry(m[1], re.sub(r",\s*optional$", "", m[2] or ""), default[1] if default else "", text))
    return out


# ------------------------------------------------------------- rest and epydoc


def _fields(doc: str, mark: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The text before the first field, and (keyword, argument, text) of each field that begins with mark."""
    rule = re.compile(rf"^{mark}(\w+)(?:\s+([^:]*))?:\s*(.*)$")
    head, found = [], []
    for line in doc.split("\n"):
        if m := rule.match(line):
            found.append([m[1], (m[2] or "").strip(), m[3]])
        elif found:
            found[-1][2] += "\n" + line.strip()
        else:
            head.append(line)
    return "\n".join(head).strip(), [(k, a, t.strip()) for k, a, t in found]


def _tagged(doc: str, mark: str) -> dict:
    head, found = _fields(doc, mark)
    types = {a: t for k, a, t in found if k == "type"}
    out = {"description": head, "parameters": [], "attributes": [], "results": []}
    for key, argument, text in found:
        default = re.search(r"[Dd]efaults? (?:to|is) (.+?)\.?$", text)
        if key in ("param", "parameter", "arg", "argument", "key", "keyword") and argument:
            *kind, name = argument.split()
            out["parameters"].append(_entry(name, " ".join(kind) or types.get(name, ""), default[1] if default else "", text))
        elif key in ("ivar", "cvar", "var", "attr", "attribute") and argument:
            *kind, name = argument.split()
            out["attributes"].append(_entry(name, " ".join(kind) or types.get(name, ""), "", text))
        elif key in ("return", "returns"):
            kind = next((t for k, _, t in found if k == "rtype"), "")
            out["results"].append(_entry("", kind, "", text))
    return out


def parse(doc: str | None, style: str) -> dict:
    """description, parameters, attributes and results of a docstring; entries have names, type, default_value, description. Plain text is all description."""
    text, style = _clean(doc), style_of(style)
    if style == "numpydoc":
        return _numpydoc(text) | {"style": style}
    if style == "google":
        return _google(text)
    if style == "rest":
        return _tagged(text, ":")
    if style == "epydoc":
        return _tagged(text, "@")
    return {"description": text, "parameters": [], "attributes": [], "results": []}


#: The stars that numpydoc writes before the names of variadic parameters.
_STARS = {"POSITIONAL_VARARG": "*", "NAMED_VARARG": "**"}


def parameter(parsed: dict, name: str, assigned_by: str | None = None) -> dict:
    """The last entry that names a parameter; empty fields if none does. In numpydoc a variadic parameter has its own stars and
    another has none; in other styles, and where assigned_by is not told, stars don't matter."""
    exact = None if assigned_by is None or parsed.get("style") != "numpydoc" else _STARS.get(assigned_by, "") + name
    found = [e for e in parsed["parameters"] if any(n == exact if exact else n.lstrip("*") == name for n in e["names"])]
    best = found[-1] if found else {"type": "", "default_value": "", "description": ""}
    return {k: best[k] for k in ("type", "default_value", "description")}
