"""Facts of a module for purity: what its functions bind, read, write and call, by the scopes that names belong to."""

from __future__ import annotations

import ast

from .python_source import COMPREHENSIONS, _chain, instance_attributes, own_nodes, parse

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Methods that make an instance; what they assign on it is no side effect.
MAKERS = ("__new__", "__init__", "__post_init__")
FIELDS = ("fn", "name", "klass", "line", "fact", "target", "receiver", "n_args", "keywords", "extra")


def _stored(nodes) -> set[str]:
    return {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del))}


def _named_lambdas(statements: list[ast.stmt]) -> dict[str, ast.Lambda]:
    """Lambdas that a scope gives a name: they count as functions."""
    out = {}
    for n in own_nodes(statements):
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
        if targets and isinstance(n.value, ast.Lambda):
            out |= {t.id: n.value for t in targets if isinstance(t, ast.Name)}
    return out


def imported(nodes, module: str, is_init: bool) -> dict[str, str]:
    """What import statements bind, by name, as qualified names; relative ones are resolved against the module."""
    out = {}
    for n in nodes:
        if isinstance(n, ast.Import):
            out |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            parts = module.removesuffix(".__init__").split(".")
            parts = parts if is_init else parts[:-1]
            origin = ".".join([*parts[: len(parts) - n.level + 1], *filter(None, [n.module])]) if n.level else n.module or ""
            out |= {a.asname or a.name: f"{origin}.{a.name}" for a in n.names}
    return out


def _is_property(f: ast.AST) -> bool:
    return isinstance(f, _FUNCTIONS) and any(ast.unparse(d).rsplit(".")[-1] in ("property", "cached_property") for d in f.decorator_list)


class _Module:
    """One module's scopes. Rows have FIELDS; fact is one of function, class, base, member, import, call, read, write, access, local, open, error."""

    def __init__(self, tree: ast.Module, module: str):
        self.rows: list[dict] = []
        self.module = module
        top = list(own_nodes(tree.body))
        self.is_init = module.endswith("__init__")
        self.imports = imported(top, module, self.is_init)
        lambdas = _named_lambdas(tree.body)
        self.variables = _stored(top) - set(lambdas)
        self.functions = {n.name for n in top if isinstance(n, _FUNCTIONS)} | set(lambdas)
        classes = [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
        self.classes = {c.name: c for c in classes}
        for c in classes:
            self.declare(c)
        for n in top:
            if isinstance(n, _FUNCTIONS):
                self.function(n, n.name)
        for name, f in lambdas.items():
            self.function(f, name)
        for c in classes:
            for n in own_nodes(c.body):
                if isinstance(n, _FUNCTIONS):
                    self.function(n, n.name, c.name)
            for name, f in _named_lambdas(c.body).items():
                self.function(f, name, c.name)
        for alias, origin in self.imports.items():
            self.row("import", origin, name=alias)

    def row(self, fact: str, target: str | None, fn: str | None = None, line: int | None = None, **more) -> None:
        self.rows.append(dict.fromkeys(FIELDS) | {"fact": fact, "target": target, "fn": fn, "line": line} | more)

    # ------------------------------------------------------------- classes

    def bases(self, name: str, seen: tuple[str, ...] = ()) -> list[str]:
        """A class and those of the module that it inherits from, nearest first."""
        if name in seen or name not in self.classes:
            return []
        above = [b.id for b in self.classes[name].bases if isinstance(b, ast.Name)]
        return list(dict.fromkeys([name, *(x for b in above for x in self.bases(b, (*seen, name)))]))

    def maker(self, name: str) -> str | None:
        """The class whose constructors run when a class of the module is called."""
        return next((c for c in self.bases(name) if any(isinstance(n, _FUNCTIONS) and n.name in MAKERS for n in self.classes[c].body)), None)

    def declare(self, c: ast.ClassDef) -> None:
        self.row("class", c.name, line=c.lineno, name=c.name, extra=self.maker(c.name))
        for b in c.bases:
            self.row("base", ast.unparse(b), line=c.lineno, klass=c.name, extra="class" if isinstance(b, ast.Name) and b.id in self.classes else "other")
        for name in sorted(_stored(own_nodes(c.body)) - set(_named_lambdas(c.body))):
            self.row("member", name, klass=c.name, extra="ClassVariable")
        for a in instance_attributes(c, c.name):
            self.row("member", a["name"], klass=c.name, extra="InstanceVariable")
        for n in c.body:
            if _is_property(n):
                self.row("member", n.name, klass=c.name, extra="Property")

    # ------------------------------------------------------------- functions

    def function(self, f: ast.AST, name: str, klass: str | None = None, outer: frozenset[str] = frozenset()) -> None:
        """A function's signature, then all that its body does. outer: names that functions around it bind."""
        fn = ".".join(filter(None, [self.module, klass, name, str(f.lineno), str(f.col_offset)]))
        a, own = f.args, 0 if klass is None or any(ast.unparse(d) == "staticmethod" for d in getattr(f, "decorator_list", [])) else 1
        params = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]]
        plain = len(a.posonlyargs + a.args)
        self.row("function", name, fn, f.lineno, name=name, klass=klass, n_args=max(0, plain - len(a.defaults) - own), keywords=params, extra=None if a.vararg else str(plain - own))
        _Body(self, fn, name, klass, params, outer).run([f.body] if isinstance(f, ast.Lambda) else f.body)


class _Body:
    """What one function does. Type hints and decorators are no reads, the names of called functions neither; what comprehensions bind is their own."""

    def __init__(self, module: _Module, fn: str, name: str, klass: str | None, params: list[str], outer: frozenset[str]):
        self.m, self.fn, self.name, self.klass, self.params, self.outer = module, fn, name, klass, params, outer

    def run(self, body: list[ast.AST]) -> None:
        own = list(own_nodes(body))
        declared = {g for n in own if isinstance(n, ast.Global) for g in n.names}
        borrowed = {g for n in own if isinstance(n, ast.Nonlocal) for g in n.names}
        self.global_names = declared
        self.imports = self.m.imports | imported(own, self.m.module, self.m.is_init)
        self.lambdas = _named_lambdas(body)
        inner = [n for n in own if isinstance(n, _FUNCTIONS)]
        self.local = (_stored(own) | {n.name for n in inner} | {n.name for n in own if isinstance(n, ast.ClassDef)} | set(self.params)) - declared - borrowed
        for p in self.params:
            self.m.row("local", p, self.fn, None, extra="def")
        bound = self.outer | self.local
        for n in inner:
            self.m.function(n, n.name, outer=bound)
        for name, f in self.lambdas.items():
            self.m.function(f, name, outer=bound)
        for n in body:
            self.visit(n, frozenset())

    def row(self, fact: str, target: str | None, node: ast.AST, **more) -> None:
        self.m.row(fact, target, self.fn, node.lineno, **more)

    def is_local(self, name: str, hidden: frozenset[str]) -> bool:
        return name in hidden or name in self.local or name in self.outer and name not in self.global_names

    def origin(self, chain: list[str] | None, hidden: frozenset[str]) -> str | None:
        """The qualified name that a chain of names stands for, if it begins with an import."""
        return ".".join([self.imports[chain[0]], *chain[1:]]) if chain and chain[0] in self.imports and not self.is_local(chain[0], hidden) else None

    def visit(self, node: ast.AST, hidden: frozenset[str]) -> None:
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            return  # functions and classes of their own
        handler = getattr(self, "on_" + type(node).__name__.lower(), None)
        if handler:
            handler(node, hidden)
        elif isinstance(node, COMPREHENSIONS):
            self.on_comprehension(node, hidden)
        else:
            for child in ast.iter_child_nodes(node):
                self.visit(child, hidden)

    def on_annassign(self, node: ast.AnnAssign, hidden: frozenset[str]) -> None:
        for part in filter(None, (node.value, node.target)):
            self.visit(part, hidden)

    def on_lambda(self, node: ast.Lambda, hidden: frozenset[str]) -> None:
        if node in self.lambdas.values():
            return
        a = node.args
        self.visit(node.body, hidden | {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]})

    def on_comprehension(self, node: ast.AST, hidden: frozenset[str]) -> None:
        self.visit(node.generators[0].iter, hidden)
        inner = hidden | _stored(x for g in node.generators for x in ast.walk(g.target))
        for i, g in enumerate(node.generators):
            for part in [*([g.iter] if i else []), *g.ifs]:
                self.visit(part, inner)
        for part in [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]:
            self.visit(part, inner)

    def on_name(self, node: ast.Name, hidden: frozenset[str]) -> None:
        name, load = node.id, isinstance(node.ctx, ast.Load)
        if name in hidden:
            return
        if not self.is_local(name, hidden):
            if name in self.m.variables or name in self.global_names:
                self.row("read" if load else "write", f"GlobalVariable.{name}", node)
            elif load and "." in self.imports.get(name, ""):
                self.row("read", f"Import.{self.imports[name]}", node)
        elif name in self.local:
            self.row("local", name, node, extra="use" if load else "def")

    def on_attribute(self, node: ast.Attribute, hidden: frozenset[str]) -> None:
        chain, load = _chain(node), isinstance(node.ctx, ast.Load)
        if origin := self.origin(chain, hidden):
            self.row("read" if load else "write", f"Import.{origin}", node)
            return
        first = self.params[0] if self.klass and self.params else None
        own = chain is not None and len(chain) == 2 and chain[0] == first
        if not (own and self.name in MAKERS):
            self.row("access", node.attr, node, receiver=self.klass if own else chain[0] if chain and len(chain) == 2 and chain[0] in self.m.classes else None, extra="read" if load else "write")
        if load:
            self.visit(node.value, hidden)
        elif chain and not own and chain[0] in self.m.variables and not self.is_local(chain[0], hidden):
            self.row("write", f"GlobalVariable.{chain[0]}", node)

    def on_subscript(self, node: ast.Subscript, hidden: frozenset[str]) -> None:
        if not isinstance(node.ctx, ast.Load):
            root: ast.AST = node.value
            while isinstance(root, (ast.Subscript, ast.Attribute)):
                root = root.value
            if isinstance(root, ast.Name) and root.id in self.m.variables and not self.is_local(root.id, hidden):
                self.row("write", f"GlobalVariable.{root.id}", node)
        self.visit(node.value, hidden)
        self.visit(node.slice, hidden)

    def on_call(self, node: ast.Call, hidden: frozenset[str]) -> None:
        chain, shape = _chain(node.func), {"n_args": len(node.args), "keywords": [k.arg for k in node.keywords if k.arg]}
        if chain == ["open"] and not self.is_local("open", hidden):
            self.opened(node)
        elif origin := self.origin(chain, hidden):
            self.row("call", origin, node, receiver="import", **shape)
        elif chain is None:
            called = node.func.attr if isinstance(node.func, ast.Attribute) else ast.unparse(node.func)
            self.row("call", called, node, receiver="?", **shape)
            self.visit(node.func.value if isinstance(node.func, ast.Attribute) else node.func, hidden)
        elif len(chain) == 1:
            mine = chain[0] in self.params and chain[0] not in self.lambdas
            self.row("call", chain[0], node, receiver="parameter" if mine else None, **shape)
        else:
            self.row("call", chain[-1], node, receiver=chain[0], **shape)
            self.visit(node.func.value, hidden)
        for part in [*node.args, *(k.value for k in node.keywords)]:
            self.visit(part, hidden)

    def opened(self, node: ast.Call) -> None:
        given = dict(zip(("file", "mode"), node.args, strict=False)) | {k.arg: k.value for k in node.keywords if k.arg in ("file", "mode")}
        file, mode = given.get("file"), given.get("mode")
        shown = None if file is None else f"StringLiteral.{file.value}" if isinstance(file, ast.Constant) else f"ParameterAccess.{ast.unparse(file)}"
        self.row("open", shown, node, extra="r" if mode is None else str(mode.value) if isinstance(mode, ast.Constant) else None)


def module_facts(source: str, module: str) -> list[dict]:
    """All facts of a module; one row of fact error if it can't be parsed."""
    tree, error = parse(source)
    if tree is None:
        return [dict.fromkeys(FIELDS) | {"name": module, "fact": "error", "target": error}]
    return _Module(tree, module).rows
