"""Facts about Python sources: modules, symbols, imports and measures, by the ast module where the file is. Sources are parsed, never run."""

from __future__ import annotations

import ast
import gc
import hashlib
import io
import re
import symtable
import sys
import tokenize
from collections.abc import Callable, Collection, Iterator, Sequence
from contextlib import contextmanager
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import scratch, ship_package

#: Statements that count as a branch, and the parts of statements that are a level deeper than the statement.
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler)
_DEEPER: dict[type, tuple[str, ...]] = {
    ast.If: ("body", "orelse"),
    ast.For: ("body", "orelse"),
    ast.AsyncFor: ("body", "orelse"),
    ast.While: ("body", "orelse"),
    ast.Try: ("body", "handlers", "orelse", "finalbody"),
    ast.TryStar: ("body", "handlers", "orelse", "finalbody"),
    ast.Match: ("cases",),
    ast.With: ("body",),
    ast.AsyncWith: ("body",),
}
#: Parts that are not looked at.
_SKIPPED: dict[type, tuple[str, ...]] = {ast.ExceptHandler: ("type",), ast.match_case: ("pattern",)}
#: Depth to which syntax trees are written out; deeper ones give a diagnostic.
MOST_DEPTH = 100_000
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
#: Parts of an expression that have no parts which count.
_LEAVES = frozenset(t for base in (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop) for t in (base, *base.__subclasses__()))
#: Of each type of node that has parts which count: their names, and how much deeper they are.
_PARTS: dict[type, tuple[tuple[str, int], ...]] = {
    t: tuple((name, int(name in _DEEPER.get(t, ()))) for name in t._fields if name not in _SKIPPED.get(t, ())) for t in vars(ast).values() if isinstance(t, type) and issubclass(t, ast.AST) and t not in _LEAVES
}
#: Types of nodes that count by themselves.
_COUNTED = frozenset((*_BRANCHES, ast.BoolOp, ast.comprehension, ast.match_case))
#: Where statements are inside a statement or one of its parts, in order; whatever has none of these holds no statement.
_BLOCKS: dict[type, tuple[str, ...]] = {
    t: tuple(name for name in t._fields if name in ("body", "handlers", "orelse", "finalbody", "cases"))
    for t in (ast.Module, *_SCOPES, ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match, ast.match_case, ast.ExceptHandler)
}
#: Where a text may be cut into runs of statements, and how long a run of which no tree is made may be: one nested deeper than trees can be is longer.
_CUT = re.compile(r"\n(?=(?:def|class|async def) )")
LONGEST_PIECE = 16_000
#: Rows of facts that a task hands on at once.
ROWS_PER_BATCH = 4000

FACTS = (
    "relative_path string, module_name string, kind string, qualified_name string, display_name string, parent string, line int, end_line int, "
    "documented boolean, visibility string, complexity int, nesting int, parameters int, bases array<string>, signature string, fingerprint string, imported string, base string, name string, bound string, aliased boolean, exports array<string>, level int, error string"
)
NAMES = tuple(c.split(" ")[0] for c in FACTS.split(", "))
#: The facts that import_edges() reads, and those that are not part of a review.
IMPORT_FACTS = ("relative_path", "module_name", "kind", "qualified_name", "imported", "level")
REVIEW_FACTS = tuple(c for c in NAMES if c not in ("signature", "fingerprint", "imported"))
#: Those of a review that edges and the metrics of modules read.
EDGE_FACTS = tuple(c for c in REVIEW_FACTS if c not in ("complexity", "nesting", "documented", "parameters", "error"))
#: Those of a review that tell what the bases of classes are.
BASE_FACTS = ("relative_path", "module_name", "kind", "qualified_name", "display_name", "line", "end_line", "bases", "base", "name", "bound", "aliased", "exports", "level")


def module_of(path: str) -> str:
    name = path.removesuffix(".py")
    for root in ("src/", "lib/"):
        name = name.removeprefix(root)
    name = name.replace("/", ".")
    return name.removesuffix(".__init__") if name.endswith(".__init__") else "" if name == "__init__" else name


def _branches(x: ast.AST) -> int:
    if isinstance(x, _BRANCHES):
        return 1
    if isinstance(x, ast.BoolOp):
        return len(x.values) - 1
    if isinstance(x, ast.comprehension):
        return len(x.ifs)
    if isinstance(x, ast.match_case):
        bare = isinstance(x.pattern, ast.MatchAs) and x.pattern.pattern is None and x.pattern.name is None
        return int(not bare or x.guard is not None)
    return 0


def measures(root: ast.AST) -> tuple[int, int]:
    """(complexity, nesting) of a scope's body without the scopes inside it; lambdas belong to it, its decorators, defaults and bases do not.

    Complexity is one and one more for each if (also as an expression), loop, handler, further operand of and/or, condition of a comprehension,
    and case but a bare default. Each block inside a statement is a level deeper than the statement, so every elif is one deeper than the last.
    """
    total, most = 1, 0
    todo = [(x, 0) for x in root.body]
    while todo:
        x, depth = todo.pop()
        kind = type(x)
        if kind in _SCOPES:
            continue
        if kind in _COUNTED:
            total += _branches(x)
        if depth > most:
            most = depth
        for name, deeper in _PARTS.get(kind, ()):
            value = getattr(x, name, None)
            if type(value) is list:
                todo += [(y, depth + deeper) for y in value if type(y) in _PARTS]
            elif type(value) in _PARTS:
                todo.append((value, depth + deeper))
    return total, most


def script_complexity(function: ast.FunctionDef | ast.AsyncFunctionDef) -> int:
    """The other count of complexity, that of the quality report: with, else and finally of try, and each comprehension count too; conditions of
    comprehensions and cases do not."""
    total, todo = 1, list(function.body)
    while todo:
        x = todo.pop()
        if isinstance(x, _SCOPES):
            continue
        if isinstance(x, ast.If | ast.For | ast.AsyncFor | ast.While | ast.With | ast.AsyncWith | ast.IfExp | ast.comprehension):
            total += 1
        elif isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
        elif isinstance(x, ast.Try):
            total += len(x.handlers) + bool(x.orelse) + bool(x.finalbody)
        todo += ast.iter_child_nodes(x)
    return total


def parameter_count(node: ast.AST) -> int:
    """All parameters, self and cls among them; none for a class."""
    if isinstance(node, ast.ClassDef):
        return 0
    a = node.args
    return len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)


def decoded(content: bytes) -> str:
    """The text by its byte order mark or coding line, else UTF-8."""
    encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
    return content.decode(encoding)


@contextmanager
def _deep_stack() -> Iterator[None]:
    """Room for the standard library's walkers over deep trees."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, MOST_DEPTH))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


@contextmanager
def _no_cycle_search() -> Iterator[None]:
    """No search for cycles of objects: syntax trees are many objects, hold none, and are freed as soon as nothing names them."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


def _visibility(name: str) -> str:
    return "dunder" if name.startswith("__") and name.endswith("__") else "private" if name.startswith("_") else "public"


def _written(x: ast.expr) -> str:
    """ast.unparse(x), which takes long for the names that most bases are."""
    return x.id if type(x) is ast.Name else ast.unparse(x)


def _exports(tree: ast.Module) -> list[str]:
    """Names that a module lists in __all__."""
    out: list[str] = []
    for x in tree.body:
        targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AnnAssign | ast.AugAssign) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(x.value, ast.List | ast.Tuple):
            out += [v.value for v in x.value.elts if isinstance(v, ast.Constant) and isinstance(v.value, str)]
    return sorted(set(out))


def facts_of(path: str, content: bytes, wanted: Collection[str] = NAMES) -> list[dict]:
    """Rows of FACTS for one file: its module, symbols and imports, or one diagnostic if it cannot be read as a source. Measures, bases, signatures and fingerprints
    that are not wanted are left out, as they take most of the time."""
    base = {"relative_path": path, "module_name": module_of(path)}
    try:
        text = decoded(content)
    except (SyntaxError, UnicodeDecodeError, LookupError):
        return [base | {"kind": "diagnostic", "error": "decode-error"}]
    try:
        with _deep_stack():
            return _facts(base, text, wanted)
    except (SyntaxError, ValueError) as problem:
        return [base | {"kind": "diagnostic", "line": getattr(problem, "lineno", None), "error": "parse-error"}]
    except (RecursionError, MemoryError):
        return [base | {"kind": "diagnostic", "error": "too-deep"}]


def _facts(base: dict, text: str, wanted: Collection[str]) -> list[dict]:
    tree = ast.parse(text, type_comments="type:" in text)  # the flag alone takes time
    module = base["module_name"]
    measured = measures if "complexity" in wanted or "nesting" in wanted else lambda _: (None, None)
    documented = (lambda x: ast.get_docstring(x, clean=False) is not None) if "documented" in wanted else lambda _: None
    complexity, nesting = measured(tree)
    rows = [
        base
        | {"kind": "module", "qualified_name": module, "display_name": module.rpartition(".")[2], "line": 1, "end_line": len(text.splitlines()), "documented": documented(tree),
           "complexity": complexity, "nesting": nesting, "parameters": 0, "exports": _exports(tree)}
    ]
    todo: list[tuple[ast.AST, str | None, str, bool]] = [(tree, None, module, False)]
    while todo:
        node, parent, prefix, in_class = todo.pop()
        for x in (x for block in _BLOCKS[type(node)] for x in getattr(node, block)):
            if isinstance(x, _SCOPES):
                name = f"{prefix}.{x.name}" if prefix else x.name
                is_class = isinstance(x, ast.ClassDef)
                complexity, nesting = measured(x)
                rows.append(
                    base
                    | {
                        "kind": "class" if is_class else "method" if in_class else "function", "qualified_name": name, "display_name": x.name, "parent": parent, "line": x.lineno, "end_line": x.end_lineno,
                        "documented": documented(x), "visibility": _visibility(x.name), "complexity": complexity, "nesting": nesting, "parameters": parameter_count(x),
                        "bases": [_written(b) for b in x.bases] if is_class and "bases" in wanted else None, "signature": None if is_class or "signature" not in wanted else f"({ast.unparse(x.args)})",
                        "fingerprint": hashlib.sha256(ast.dump(x, include_attributes=False).encode()).hexdigest() if "fingerprint" in wanted else None,
                    }
                )
                todo.append((x, name, name, is_class))
            elif isinstance(x, ast.Import):
                rows += [base | {"kind": "import", "imported": a.name, "base": a.name, "bound": a.asname or a.name.partition(".")[0], "aliased": a.asname is not None, "level": 0, "line": x.lineno} for a in x.names]
            elif isinstance(x, ast.ImportFrom):
                rows += [base | {"kind": "import", "imported": f"{x.module}.{a.name}" if x.module else a.name, "base": x.module, "name": a.name, "bound": a.asname or a.name, "aliased": a.asname is not None, "level": x.level, "line": x.lineno} for a in x.names]
            elif type(x) in _BLOCKS:
                todo.append((x, parent, prefix, in_class))
    return rows


def imports_of(path: str, content: bytes, wanted: Collection[str] = IMPORT_FACTS) -> list[dict]:
    """The rows of facts_of() that import_edges() reads (IMPORT_FACTS of the module and its imports), or its diagnostic.

    Every import is written with that word, so trees are made of the runs of top-level statements that hold it; the others are parsed for their errors only, which
    takes half as long. Each run has to be whole by itself: the first begins where statements begin, so then the next one does, and no cut is within a string or
    a bracket. Where that fails, or more than the runs themselves decides, the whole text is gone through.
    """
    base = {"relative_path": path, "module_name": module_of(path)}
    try:
        text = decoded(content)
        pieces = _CUT.split(text)
        if "type:" not in text and max(map(len, pieces)) < LONGEST_PIECE:
            rows = [base | {"kind": "module", "qualified_name": base["module_name"]}]
            with _deep_stack():
                for told, run in groupby(pieces, lambda piece: "import" in piece):
                    if told:
                        rows += [x for x in _facts(base, "\n".join(run), IMPORT_FACTS) if x["kind"] == "import"]
                    else:
                        symtable.symtable("\n".join(run), "run", "exec")
            return rows
    except (SyntaxError, ValueError, LookupError, RecursionError, MemoryError):
        pass
    return [x for x in facts_of(path, content, IMPORT_FACTS) if x["kind"] in ("module", "import", "diagnostic")]


def tells_of_bases(content: bytes) -> bool:
    """Whether a source can have to do with what any class inherits: what holds no class and no list of exports cannot, be it readable or not. Texts that name a coding
    or have letters beyond ASCII may write the words otherwise."""
    return b"class" in content or b"__all__" in content or b"coding" in content or not content.isascii()


def scan_sources(files: DataFrame, columns: Sequence[str] = NAMES, needed: Callable[[bytes], bool] | None = None, found: Callable[[str, bytes, Collection[str]], list[dict]] = facts_of) -> DataFrame:
    """Facts (these columns of FACTS) for every row of files (relative_path, content) that is a Python source; a file that cannot be read gives a diagnostic.
    Sources whose contents are not needed are not parsed and give nothing. found makes the rows of a file: facts_of() all, imports_of() those that import_edges() reads."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = ", ".join(c for c in FACTS.split(", ") if c.split(" ")[0] in columns)
    shape, most = to_arrow_schema(_parse_datatype_string(made)), ROWS_PER_BATCH

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        with _no_cycle_search():
            for batch in batches:
                for path, content in zip(batch.column("relative_path"), batch.column("content"), strict=True):
                    source = content.as_py() or b""
                    if needed is None or needed(source):
                        rows += found(path.as_py(), source, columns)
                    if len(rows) >= most:
                        yield pa.RecordBatch.from_pylist(rows, shape)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, shape)

    ship_package(files.sparkSession)
    sources = files.where(F.col("relative_path").endswith(".py")).select("relative_path", "content")
    return sources.mapInArrow(scan, made)


def scan_imports(files: DataFrame) -> DataFrame:
    """The facts of files that import_edges() reads."""
    return scan_sources(files, IMPORT_FACTS, found=imports_of)


def import_edges(facts: DataFrame) -> DataFrame:
    """(src, dst) between modules of the scan: the module an absolute import names, else the module that holds the named symbol."""
    facts = scratch(facts.where("kind IN ('module', 'import')").select(*IMPORT_FACTS), "facts")  # read four times, scanned once
    modules = facts.where("kind = 'module'").select(F.col("qualified_name").alias("dst")).distinct()
    raw = facts.where("kind = 'import'").select(F.col("module_name").alias("src"), "imported", "level", F.col("relative_path").endswith("__init__.py").alias("package"))
    from siltworks.functions.text import absolute_import

    named = raw.select("src", absolute_import(F.col("src"), F.col("package"), F.col("level"), F.col("imported")).alias("name")).where("name IS NOT NULL")
    direct = named.join(modules, F.col("name") == F.col("dst")).select("src", "dst")
    holder = F.regexp_replace("name", r"\.[^.]+$", "")
    rest = named.join(modules, F.col("name") == F.col("dst"), "left_anti").withColumn("holder", holder)
    return direct.unionByName(rest.join(modules, F.col("holder") == F.col("dst")).select("src", "dst"))


def import_census(files: DataFrame, standard: DataFrame | None = None) -> DataFrame:
    """(top_level, n_files): top-level modules that sources import, by pattern; those of standard are left out."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:import|from)\s+([A-Za-z_]\w*)"), F.lit(1))
    rows = files.select("relative_path", F.explode(F.array_distinct(found)).alias("top_level"))
    if standard is not None:
        rows = rows.join(standard.select("top_level"), "top_level", "left_anti")
    return rows.groupBy("top_level").agg(F.count(F.lit(1)).alias("n_files"))


def parse_gaps(facts: DataFrame) -> DataFrame:
    """(n): files that could not be read as sources."""
    return facts.agg(F.count_if(F.col("error").isin("parse-error", "decode-error", "too-deep")).alias("n"))
