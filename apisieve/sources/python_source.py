"""Python source as facts, by the standard library's parser. One parse of a file yields all that it declares, calls and touches."""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

from ..functions import docstrings

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def own_nodes(statements: list[ast.stmt]) -> Iterator[ast.AST]:
    """Nodes of a scope in the order of the source, without those in the functions, classes, lambdas and comprehensions inside it; these are given themselves."""
    todo = list(statements)[::-1]
    while todo:
        node = todo.pop()
        yield node
        if not isinstance(node, (*_FUNCTIONS, ast.ClassDef, ast.Lambda, *COMPREHENSIONS)):
            todo += list(ast.iter_child_nodes(node))[::-1]


_BLANK_LINE = re.compile("^[ \\t]+$", re.MULTILINE)


def _dedented(source: str) -> str:
    """textwrap.dedent, which only empties blank lines where the first line has no indent."""
    return _BLANK_LINE.sub("", source) if source[:1].strip() else textwrap.dedent(source)


def _text(node: ast.AST) -> str:
    """ast.unparse, at once for plain constants."""
    if type(node) is ast.Constant and node.kind is None and type(node.value) in (int, str, bool, type(None)):
        return repr(node.value)
    return node.id if type(node) is ast.Name else ast.unparse(node)


def parse(source: str) -> tuple[ast.Module | None, str | None]:
    """The tree of a source, dedented first, or the kind of error that prevents it."""
    try:
        return ast.parse(_dedented(source or "")), None
    except RecursionError:
        return None, "recursion"
    except (SyntaxError, ValueError, MemoryError) as e:
        return None, type(e).__name__


def _suffix(decorators: list[str]) -> str:
    if "property" in decorators:
        return "@getter"
    for end in ("setter", "deleter"):
        if any(re.search(rf"^[^.]*.{end}$", d) for d in decorators):
            return "@" + end
    return ""


def _code(lines: list[str], node: ast.AST) -> str:
    return "\n".join(lines[node.lineno - 1 : node.end_lineno])


def normal_code(code: str) -> list[str]:
    """Lines of code in the parser's own layout, without docstrings: what code similarity compares."""
    tree, error = parse(code)
    if error:
        return code.split("\n")
    for node in ast.walk(tree):
        if isinstance(node, (ast.ClassDef, *_FUNCTIONS)) and ast.get_docstring(node, clean=False) is not None:
            node.body = node.body[1:] or [ast.Pass()]
    return ast.unparse(tree).split("\n")


def parameters_of(f: ast.FunctionDef, in_class: bool, decorators: list[str]) -> list[dict]:
    """name, assigned_by, default_value (source text) of a function's parameters in order."""
    a = f.args
    plain = a.posonlyargs + a.args
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    text = lambda d: None if d is None else _text(d)
    rows = [(x.arg, "POSITION_ONLY" if i < len(a.posonlyargs) else "POSITION_OR_NAME", text(d)) for i, (x, d) in enumerate(zip(plain, defaults, strict=True))]
    if rows and in_class and "staticmethod" not in decorators:
        rows[0] = (rows[0][0], "IMPLICIT", rows[0][2])
    if a.vararg:
        rows.append((a.vararg.arg, "POSITIONAL_VARARG", None))
    rows += [(x.arg, "NAME_ONLY", text(d)) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        rows.append((a.kwarg.arg, "NAMED_VARARG", None))
    return [{"name": n, "assigned_by": k, "default_value": d} for n, k, d in rows]


def _annotation(node: ast.AST | None) -> list[str]:
    """Names of the types in an annotation; Optional and | None add None."""
    if node is None:
        return []
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return [*_annotation(node.left), *_annotation(node.right)]
    if isinstance(node, ast.Subscript) and ast.unparse(node.value).rsplit(".")[-1] in ("Optional", "Union"):
        parts = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        more = ["None"] if ast.unparse(node.value).endswith("Optional") else []
        return [t for p in parts for t in _annotation(p)] + more
    return [ast.unparse(node)]


def _value_type(node: ast.AST | None) -> list[str]:
    kinds = {ast.List: "list", ast.ListComp: "list", ast.Dict: "dict", ast.DictComp: "dict", ast.Set: "set", ast.SetComp: "set", ast.Tuple: "tuple", ast.JoinedStr: "str"}
    if isinstance(node, ast.Constant):
        return [] if node.value is Ellipsis else ["None" if node.value is None else type(node.value).__name__]
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id[:1].isupper():
        return [node.func.id]
    return [kinds[type(node)]] if type(node) in kinds else []


_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _statements(f: ast.AST) -> list[ast.AST]:
    """Statements in a function, itself first, in the order of ast.walk but without what is in expressions, where no statement can be."""
    out = [f]
    for node in out:
        for block in node._fields:
            if block in _BLOCKS:
                out += getattr(node, block)
    return out


def instance_attributes(c: ast.ClassDef, class_id: str) -> list[dict]:
    """Attributes that methods assign on their first parameter, with the types that assignments, annotations or __init__'s hints tell."""
    found: dict[str, list[str]] = {}
    for f in (n for n in c.body if isinstance(n, _FUNCTIONS)):
        first = (f.args.posonlyargs + f.args.args)[:1]
        if not first:
            continue
        hints = {x.arg: _annotation(x.annotation) for x in f.args.posonlyargs + f.args.args + f.args.kwonlyargs}
        for node in _statements(f):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
            for t in targets:
                if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == first[0].arg:
                    kinds = _annotation(node.annotation) if isinstance(node, ast.AnnAssign) else hints.get(node.value.id, []) if isinstance(node.value, ast.Name) else _value_type(node.value)
                    held = found.setdefault(t.attr, [])
                    held += [k for k in kinds if k not in held]
    return [{"id": f"{class_id}/{n}", "name": n, "types": k} for n, k in found.items()]


def declarations(source: str, package: str, module: str, style: str = "plaintext", is_init: bool = False, include_async: bool = False) -> dict:
    """What a file declares: module, classes, functions, parameters and re-exports (qname, module id); error if it can't be parsed.

    Classes and functions directly in the module, and methods in any class, are catalogued; functions in
    functions aren't. Async functions only with include_async. Re-exports are the from-imports of a public
    package file; whether they are of this package shows when they are joined with declarations.
    """
    tree, error = parse(source)
    out = {"module": None, "classes": [], "functions": [], "parameters": [], "reexports": [], "error": error}
    if tree is None:
        return out
    lines = _dedented(source).split("\n")
    base = package + "/" + module
    top = {"id": base, "name": module, "imports": [], "from_imports": [], "classes": [], "functions": []}
    own = module.removesuffix(".__init__")
    for node in own_nodes(tree.body):  # also within try, if and with, but not in functions and classes
        if isinstance(node, ast.Import):
            top["imports"] += [{"module": a.name, "alias": a.asname} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            parts = own.split(".") if is_init else own.split(".")[:-1]
            origin = ".".join([*parts[: len(parts) - node.level + 1], *filter(None, [node.module])]) if node.level else node.module or ""
            for a in node.names:
                top["from_imports"].append({"module": origin, "declaration": a.name, "alias": a.asname})
                if is_init and all(not s.startswith("_") for s in own.split(".")) and f"{origin}.{a.name}".startswith(own):
                    out["reexports"].append({"qname": f"{origin}.{a.name}", "module_id": base})

    def visit(body, path, qpath, holder, kind, class_doc):
        for node in body:
            if isinstance(node, ast.ClassDef):
                id_ = "/".join([base, *path, node.name])
                doc = docstrings.parse(ast.get_docstring(node, clean=False), style)
                row = {
                    "id": id_, "name": node.name, "qname": ".".join([own, *qpath, node.name]), "decorators": [_text(d) for d in node.decorator_list], "superclasses": [_text(b) for b in node.bases],
                    "methods": [], "description": doc["description"], "docstring": ast.get_docstring(node) or "", "code": _code(lines, node), "instance_attributes": instance_attributes(node, id_),
                }
                visit(node.body, [*path, node.name], [*qpath, node.name], row["methods"], "class", doc)
                if kind == "module":
                    out["classes"].append(row)
                    holder["classes"].append(id_)
            elif isinstance(node, _FUNCTIONS if include_async else ast.FunctionDef) and kind in ("module", "class"):
                decorators = [_text(d) for d in node.decorator_list]
                id_ = "/".join([base, *path, node.name]) + _suffix(decorators)
                qname = ".".join([own, *qpath, node.name])
                doc = docstrings.parse(ast.get_docstring(node, clean=False), style)
                (holder["functions"] if kind == "module" else holder).append(id_)
                out["functions"].append({
                    "id": id_, "name": node.name, "qname": qname, "decorators": decorators, "description": doc["description"], "docstring": ast.get_docstring(node) or "", "code": _code(lines, node),
                    "parent_id": "/".join([base, *path]), "parent_kind": kind,
                })
                told = class_doc if node.name == "__init__" and class_doc else doc  # a constructor's parameters are told of by its class
                for i, p in enumerate(parameters_of(node, kind == "class", decorators)):
                    out["parameters"].append(p | {"id": f"{id_}/{p['name']}", "qname": f"{qname}.{p['name']}", "function_id": id_, "ordinal": i, "docstring": docstrings.parameter(told, p["name"], p["assigned_by"])})

    visit(tree.body, [], [], top, "module", None)
    out["module"] = top
    return out


# ------------------------------------------------------------- calls of client code


def _chain(node: ast.AST) -> list[str] | None:
    """a.b.c as its names, or null."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return [node.id, *names[::-1]] if isinstance(node, ast.Name) else None


def calls(source: str, package: str) -> tuple[list[dict], str | None]:
    """Calls of a package's declarations by client code, and the error if it can't be parsed.

    Names are resolved by imports and by plain assignments of such names or of instances made from them;
    what needs more inference is left out. A call has the qname it names, whether through an instance,
    its positional and keyword arguments as source text; calls with *args or **kwargs, whose binding isn't known, are left out.
    """
    tree, error = parse(source)
    if tree is None:
        return [], error
    known: dict[str, tuple[str, bool]] = {}

    def resolve(node) -> tuple[str, bool] | None:
        if isinstance(node, ast.Call):
            made = resolve(node.func)
            return (made[0], True) if made and made[0].rsplit(".")[-1][:1].isupper() else None
        if isinstance(node, ast.Attribute) and not _chain(node):
            made = resolve(node.value)
            return (f"{made[0]}.{node.attr}", True) if made else None
        names = _chain(node)
        if not names or names[0] not in known:
            return None
        name, instance = known[names[0]]
        return ".".join([name, *names[1:]]), instance

    nodes = list(ast.walk(tree))
    for node in nodes:
        if isinstance(node, ast.Import):
            for a in node.names:
                known[a.asname or a.name.split(".")[0]] = (a.name if a.asname else a.name.split(".")[0], False)
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            for a in node.names:
                known[a.asname or a.name] = (f"{node.module}.{a.name}", False)
    for node in nodes:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and (made := resolve(node.value)):
            known[node.targets[0].id] = made
    out = []
    for node in sorted((n for n in nodes if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset)):
        called = resolve(node.func)
        if called and called[0].startswith(package) and not any(isinstance(a, ast.Starred) for a in node.args) and all(k.arg for k in node.keywords):
            out.append({
                "qname": called[0], "instance": called[1], "line": node.lineno, "col": node.col_offset,
                "positional": [_text(a) for a in node.args], "keywords": [{"name": k.arg, "value": _text(k.value)} for k in node.keywords],
            })
    return out, None
