"""Imports of a source are those of its whole tree, though trees are made of the runs that hold imports only."""

import ast
import random

import pytest
from siltworks.operators import code

HEAD = "import os\nfrom a.b import c as d, e\n"
ODD = {
    "plain": HEAD + "def f(x):\n    return x\nclass C:\n    def g(self):\n        from . import h\ndef k(): pass\n",
    "string": HEAD + 'x = """\ndef a():\n    import no\n\ndef b(): pass\n"""\nimport yes\n',
    "long string": 'x = 1\ndef f():\n    """\ndef a():\n    import no\n\nclass B: pass\n    """\ndef g(): import yes\n',
    "decorated": HEAD + "@d(\n  1)\ndef f(): pass\n@d\nclass C: import in_it\n",
    "continued": "x = 1 + \\\n2\nif x:\n    import a; import b\nelse:\n    from ..c import *\ndef f(): pass\n",
    "bracket": "x = [\n1,\n\n]\ndef f(\na,\nb): pass\nimport z\n",
    "broken late": HEAD + "def f(): pass\ndef g(: pass\n",
    "broken between": HEAD + "if x:\n\ndef f(): pass\n",
    "open string": HEAD + "def f(): pass\nx = '''\ndef g(): pass\n",
    "only names": "important = reimport = 1\ndef f(): return important\n",
    "twice": "def f(a, a): pass\nimport fine\n",
    "future": "x = 1\nfrom __future__ import annotations\ndef f(): return 1\n",
    "comment": "import a  # type: int\ndef f(): pass\n",
    "typed": "def f():\n    # type: () -> int\n    x = 1 # type: ignore\n    import b\ndef g(x, # type: int\n y): pass\n",
    "misplaced": HEAD + "def f():\n    pass # type: int\n",
    "windows": "import a\r\ndef f():\r\n    import b\r\ndef g(): pass\r\n",
    "async": HEAD + "async def f():\n    async with x as y: pass\nasync def g():\n    import q\n",
    "empty": "",
    "null": "import a\ndef f(): '\0'\n",
    "outside": "return 1\ndef f(): pass\nimport a\n",
    "deep": "def f(): return " + "+".join(["a"] * 30_000) + "\nimport a\n",
    "tabs": HEAD + "def f():\n\tif x:\n\t\treturn\ndef g():\n    if x:\n        import t\n",
    "mixed": HEAD + "def f():\n\tif x:\n        return\n",
    "coded": "# coding: latin-1\nimport a\ndef f(): '\xe9'\n",
}


def whole(path, content):
    rows = [x for x in code.facts_of(path, content, code.NAMES) if x["kind"] in ("module", "import", "diagnostic")]
    return sorted(str([x.get(c) for c in code.IMPORT_FACTS]) for x in rows)


def parts(path, content):
    return sorted(str([x.get(c) for c in code.IMPORT_FACTS]) for x in code.imports_of(path, content))


@pytest.mark.parametrize("name", ODD)
def test_imports_of_odd_sources(name):
    content = ODD[name].encode("latin-1")
    assert parts("src/p/m.py", content) == whole("src/p/m.py", content)


def test_imports_of_mixed_lines():
    r = random.Random(5)
    lines = [x for text in ODD.values() if len(text) < 1000 for x in text.split("\n")] + ['"""', "'''", "    pass", "def f():", "\\", "(", ")"]
    valid = 0
    for _ in range(3000):
        content = "\n".join(r.choice(lines) for _ in range(r.randrange(1, 7))).encode()
        want = whole("m.py", content)
        valid += "'module'" in want[-1] and len(want) > 1
        assert parts("m.py", content) == want, content
    assert valid > 100


def test_no_tree_is_made_of_runs_without_imports(monkeypatch):
    made = []
    monkeypatch.setattr(ast, "parse", lambda text, *a, real=ast.parse, **b: made.append(text) or real(text, *a, **b))
    rows = code.imports_of("src/p/m.py", (HEAD + "def f(): pass\n" * 50 + "def g(): import h\n" + "class C: pass\n" * 50).encode())
    assert len(rows) == 5 and len("".join(made)) < 100
