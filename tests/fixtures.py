"""A small library, its client, two versions of an API and annotations, for tests."""

from __future__ import annotations

from apisieve import schema

LIBRARY = [
    ("shop.__init__", '"""A shop."""\nfrom shop._core import Basket\n'),
    (
        "shop._core",
        '''import json
LIMIT = 10
seen = {}

class Basket:
    """A basket.

    Parameters
    ----------
    size : int, default=5
        Size in the range [1, 100].
    kind : {"paper", "cloth"}, optional
        Only used if size is set to 7.
    """

    def __init__(self, size=5, kind="paper"):
        self.size = size
        self.kind: str = kind

    def add(self, item, *more, twice=False):
        self.size += 1
        return item

    @property
    def full(self):
        return self.size > LIMIT

def price(items, rate=1.5):
    """Price of items."""
    return sum(items) * rate

def log(text, sink):
    print(text)
    sink(text)

def remember(key, value):
    seen[key] = value

def load(path):
    with open(path) as f:
        return json.loads(f.read())

def even(n):
    return True if n == 0 else odd(n - 1)

def odd(n):
    return False if n == 0 else even(n - 1)

def total(items):
    log("total", None)
    return price(items)
''',
    ),
    ("shop.broken", "def f(:\n"),
]
CLIENT = [
    ("a.py", 'from shop import Basket\nfrom shop._core import price\nb = Basket(7, kind="cloth")\nb.add("x", twice=True)\nb.add("y")\nprice([1], 2.0)\nprice([2])\n'),
    ("b.py", "import other\nother.run()\n"),
    ("c.py", "import shop\nthis is no code\n"),
]


def library(spark):
    return spark.createDataFrame(LIBRARY, "module string, content string")


def client(spark):
    return spark.createDataFrame(CLIENT, "path string, content string")


def elements(spark, edit: bool = False):
    """A small library's elements as matching.map_api takes them; edit gives its next version."""
    f = ["def f(x):", "    return x"] if not edit else ["def f(x, y):", "    return x"]
    rows = [
        ("class", "lib/m/Basket", "Basket", "lib/m", "module", 0, "A basket.", ["add", "drop"], ["size"], ["class Basket:", "    pass"], None, None, None, ["Base"]),
        ("class", "lib/m/Base", "Base", "lib/m", "module", 1, "", [], [], ["class Base:", "    pass"], None, None, None, []),
        ("function", "lib/m/price" if not edit else "lib/m/prices", "price" if not edit else "prices", "lib/m", "module", 2, "The price.", ["x"], [], f, None, None, None, []),
        ("parameter", "lib/m/price/x" if not edit else "lib/m/prices/x", "x", "lib/m/price" if not edit else "lib/m/prices", "function", 3, "A number.", [], [], [], ["int"], "POSITION_OR_NAME", "1", []),
    ]
    return spark.createDataFrame(rows, "kind string, id string, name string, parent_id string, parent_kind string, ord int, description string, members array<string>, attributes array<string>, code_lines array<string>, types array<string>, assigned_by string, default_value string, superclasses array<string>")


def annotated(spark):
    """One annotation of several kinds on the first version."""
    rows = [
        {"kind": "value", "target": "lib/m/price/x", "variant": "optional", "default_value_type": "number", "default_value": "1"},
        {"kind": "boundary", "target": "lib/m/price/x", "interval": {"isDiscrete": False, "lowerIntervalLimit": 0.5, "lowerLimitType": 0, "upperIntervalLimit": 9.0, "upperLimitType": 1}},
        {"kind": "rename", "target": "lib/m/price", "newName": "cost"},
        {"kind": "remove", "target": "lib/m/Base"},
        {"kind": "move", "target": "lib/m/price", "destination": "n"},
        {"kind": "todo", "target": "lib/m/Basket", "newTodo": "look"},
    ]
    names = [x.strip().split(" ", 1)[0] for x in _top_level(schema.ANNOTATIONS)]
    full = [tuple(r.get(n) if n not in ("authors", "reviewers") else ["me"] if n == "authors" else [] for n in names) for r in [{"comment": "", "reviewResult": ""} | r for r in rows]]
    return spark.createDataFrame(full, schema.ANNOTATIONS)


def _top_level(ddl: str) -> list[str]:
    parts, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += ch
    return parts
