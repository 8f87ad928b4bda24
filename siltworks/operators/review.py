"""From scanned sources to findings: modules, symbols, resolved relationships, metrics and all rules, as joins over the facts of operators.code.

Ids are readable: a module is its path, a symbol its path, qualified name and line, a package "package:" and its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import absolute_import, is_test_path, package_prefixes
from siltworks.operators import cycles, findings
from siltworks.operators.code import REVIEW_FACTS, scan_sources
from siltworks.operators.joining import resolve_in_tiers
from siltworks.session import scratch

RESOLVED = ("resolved-static", "probable-static")
EDGE = ["relationship_type", "source_id", "target_id", "unresolved_target", "resolution_status", "confidence", "relative_path", "line", "evidence"]


def modules_of(facts: DataFrame) -> DataFrame:
    """(module_id, module_name, relative_path, line_count, exports, is_package)."""
    return facts.where("kind = 'module'").select(
        F.col("relative_path").alias("module_id"), "module_name", "relative_path", F.col("end_line").alias("line_count"), "exports", _is_package(F.col("relative_path")).alias("is_package")
    )


def _named(facts: DataFrame) -> DataFrame:
    """Symbols with their ids."""
    return facts.where(F.col("kind").isin("class", "function", "method")).withColumn("symbol_id", _symbol_id("relative_path", "qualified_name", "line"))


def symbols_of(facts: DataFrame) -> DataFrame:
    """Symbols with their ids; parent_id is null at the top level."""
    rows = _named(facts)
    parents = rows.select(F.col("relative_path").alias("p_path"), F.col("qualified_name").alias("p_name"), F.col("line").alias("p_line"))
    parents = parents.groupBy("p_path", "p_name").agg(F.min("p_line").alias("p_line"))
    joined = rows.join(parents, (F.col("relative_path") == F.col("p_path")) & (F.col("parent") == F.col("p_name")), "left")
    return joined.withColumn("parent_id", _symbol_id("p_path", "p_name", "p_line")).drop("p_path", "p_name", "p_line")


def _is_package(path: Column) -> Column:
    return path.endswith("__init__.py")


def _symbol_id(path: str, name: str, line: str) -> Column:
    return F.concat(F.col(path), F.lit("::"), F.col(name), F.lit(":"), F.col(line).cast("string"))


def graph_nodes(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node_id, node_type, display_name, qualified_name, relative_path, symbol_kind) of packages, modules and symbols."""
    none = F.lit(None).cast("string")
    last = F.element_at(F.split(F.col("q"), r"\."), -1)
    folder = F.when(F.col("is_package"), F.col("module_name")).otherwise(F.regexp_extract("module_name", r"^(.*)\.[^.]*$", 1))
    packages = modules.select(folder.alias("folder")).where("folder <> ''").select(F.explode(package_prefixes(F.col("folder"))).alias("q")).distinct()
    rows = packages.select(F.concat(F.lit("package:"), "q").alias("node_id"), F.lit("package").alias("node_type"), last.alias("display_name"), F.col("q").alias("qualified_name"), none.alias("relative_path"), none.alias("symbol_kind"))
    named = modules.withColumn("q", F.col("module_name"))
    rows = rows.unionByName(named.select(F.col("module_id").alias("node_id"), F.lit("module").alias("node_type"), last.alias("display_name"), F.col("q").alias("qualified_name"), "relative_path", none.alias("symbol_kind")))
    return rows.unionByName(symbols.select(F.col("symbol_id").alias("node_id"), F.lit("symbol").alias("node_type"), "display_name", "qualified_name", "relative_path", F.col("kind").alias("symbol_kind")))


def _edge(kind: str, evidence: Column) -> list[Column]:
    return [F.lit(kind).alias("relationship_type"), *[F.col(c) for c in EDGE[1:-1]], evidence.alias("evidence")]


def containment(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """Packages hold modules, modules their top-level symbols, symbols the symbols inside them."""
    fixed = {"unresolved_target": F.lit(None).cast("string"), "resolution_status": F.lit("resolved-static"), "confidence": F.lit("high")}
    folder = F.when(F.col("is_package"), F.col("module_name")).otherwise(F.regexp_extract("module_name", r"^(.*)\.[^.]*$", 1))
    held = modules.withColumn("folder", folder).where("folder <> ''").withColumns(fixed)
    held = held.withColumns({"source_id": F.concat(F.lit("package:"), "folder"), "target_id": F.col("module_id"), "line": F.lit(1)})
    inner = symbols.withColumns(fixed).withColumns({"source_id": F.coalesce("parent_id", "relative_path"), "target_id": F.col("symbol_id")})
    rows = held.select(*_edge("contains", F.concat("folder", F.lit(" contains module "), "module_name")))
    return rows.unionByName(inner.select(*_edge("contains", F.concat(F.lit("contains "), "kind", F.lit(" "), "display_name"))))


def _imports(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """Import facts with base (the absolute name of the module named) and target_name, the submodule that is meant if there is one, else base."""
    raw = facts.where("kind = 'import'")
    raw = raw.withColumn("base", absolute_import(F.col("module_name"), _is_package(F.col("relative_path")), F.col("level"), F.col("base")))
    raw = raw.withColumn("inner", F.when(F.col("name").isNotNull() & (F.length("base") > 0), F.concat("base", F.lit("."), "name")))
    names = modules.select(F.col("module_name").alias("known")).distinct()
    met = raw.join(names, F.col("inner") == F.col("known"), "left")
    return met.withColumn("is_submodule", F.col("known").isNotNull()).withColumn("target_name", F.coalesce("known", "base")).drop("known")


def import_relationships(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """One edge per imported name: to the only module of that name, else unresolved or, with several, ambiguous."""
    known = modules.groupBy(F.col("module_name").alias("m_name")).agg(F.count(F.lit(1)).alias("m_n"), F.min("module_id").alias("m_id"))
    joined = imports.join(known, F.col("target_name") == F.col("m_name"), "left").withColumn("m_n", F.coalesce("m_n", F.lit(0)))
    shown = F.when(F.length(F.coalesce("base", F.lit(""))) == 0, F.coalesce("name", F.lit(""))).when(F.col("name").isNotNull(), F.concat("base", F.lit("."), "name")).otherwise(F.col("base"))
    one = F.col("m_n") == 1
    rows = joined.withColumns(
        {
            "shown": shown, "source_id": F.col("relative_path"), "target_id": F.when(one, F.col("m_id")), "unresolved_target": F.when(~one, shown),
            "resolution_status": F.when(one, "resolved-static").when(F.col("m_n") > 1, "ambiguous").otherwise("unresolved-dynamic"), "confidence": F.when(one, "high").otherwise("low"),
        }
    )
    return rows.select(*_edge("imports", F.col("shown")))


def import_aliases(imports: DataFrame, modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """(relative_path, bound, target_type, qualified): what names bound by imports stand for; module-import for a dotted import without alias."""
    names = modules.select(F.col("module_name").alias("qualified")).distinct()
    plain = imports.where("name IS NULL").select("relative_path", "bound", F.when(F.col("aliased"), "module").otherwise("module-import").alias("target_type"), F.col("base").alias("qualified"))
    parts = imports.where("name IS NOT NULL").select("relative_path", "bound", F.col("inner").alias("qualified"), "is_submodule")
    inner = parts.where("is_submodule").select("relative_path", "bound", F.lit("module").alias("target_type"), "qualified")
    symbol = parts.join(symbols.select(F.col("qualified_name").alias("qualified")).distinct(), "qualified", "left_semi").select("relative_path", "bound", F.lit("symbol").alias("target_type"), "qualified")
    return plain.join(names, "qualified", "left_semi").select("relative_path", "bound", "target_type", "qualified").unionByName(inner).unionByName(symbol).distinct()


def _bases(symbols: DataFrame) -> DataFrame:
    """One row per base of a class: ref names it, text is the base without what is in brackets, head its first name and tail the rest."""
    refs = symbols.where("kind = 'class'").select("symbol_id", "relative_path", "module_name", "line", F.posexplode("bases").alias("place", "written"))
    refs = refs.withColumn("text", F.regexp_replace("written", r"\[.*$", "")).withColumn("ref", F.concat("symbol_id", F.lit("#"), F.col("place").cast("string")))
    return refs.withColumn("head", F.substring_index("text", ".", 1)).withColumn("tail", F.when(F.contains("text", F.lit(".")), F.regexp_replace("text", r"^[^.]*", "")).otherwise(""))


def _base_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """The imports that bind a name which a base in their file begins with; no other import can tell what a base is."""
    heads = _bases(symbols).select(F.col("relative_path").alias("h_path"), "head").distinct()
    return imports.join(heads, (F.col("relative_path") == F.col("h_path")) & (F.col("bound") == F.col("head")), "left_semi")


def inheritance(symbols: DataFrame, modules: DataFrame, aliases: DataFrame) -> DataFrame:
    """One edge per base of a class: to a class of the same module, by its full name in it, by an import, or (probable) by an export of the package."""
    refs = _bases(symbols)
    classes = symbols.where("kind = 'class'").select(F.col("symbol_id").alias("target"), F.col("qualified_name").alias("c_name"), F.col("module_name").alias("c_module"), F.col("display_name").alias("c_display"))
    local = refs.join(classes, F.concat("module_name", F.lit("."), "text") == F.col("c_name")).select("ref", "target")
    full = refs.where(F.col("text").startswith(F.concat("module_name", F.lit(".")))).join(classes, (F.col("text") == F.col("c_name")) & (F.col("module_name") == F.col("c_module"))).select("ref", "target")
    bound = refs.join(aliases.select(F.col("relative_path").alias("a_path"), "bound", "target_type", "qualified"), (F.col("relative_path") == F.col("a_path")) & (F.col("head") == F.col("bound")))
    wanted = F.when(F.col("target_type") == "module-import", F.col("text")).otherwise(F.concat("qualified", "tail"))
    imported = bound.withColumn("wanted", wanted).join(classes, F.col("wanted") == F.col("c_name")).where((F.col("target_type") == "symbol") | (F.col("c_module") == F.col("qualified"))).select("ref", "target")
    outer = refs.where("tail = ''").withColumn("package", F.regexp_extract("module_name", r"^(.*)\.[^.]*$", 1)).where("package <> ''")
    offered = modules.select(F.col("module_name").alias("package"), F.explode("exports").alias("text")).distinct()
    exported = outer.join(offered, ["package", "text"], "left_semi").join(classes, F.col("text") == F.col("c_display")).where(F.col("c_name").startswith(F.concat("package", F.lit(".")))).select("ref", "target")
    found = resolve_in_tiers(refs, [local, full, imported, exported], "ref", "target")
    probable = F.col("tier") == 3
    rows = found.withColumns(
        {
            "source_id": F.col("symbol_id"), "unresolved_target": F.when(F.col("target_id").isNull(), F.col("text")),
            "resolution_status": F.when(F.col("target_id").isNotNull() & probable, "probable-static").otherwise(F.col("resolution_status")),
            "confidence": F.when(F.col("target_id").isNull(), "low").when(probable, "medium").otherwise("high"),
        }
    )
    return rows.select(*_edge("inherits", F.col("written")))


def relationships(facts: DataFrame) -> DataFrame:
    """All edges (EDGE) of scanned sources."""
    modules, symbols = scratch(modules_of(facts), "modules"), scratch(symbols_of(facts), "symbols")
    imports = scratch(_imports(facts, modules), "imports")
    edges = containment(modules, symbols).unionByName(import_relationships(imports, modules))
    return edges.unionByName(inheritance(symbols, modules, import_aliases(scratch(_base_imports(imports, symbols), "imports"), modules, symbols)))


def inheritance_of(facts: DataFrame) -> DataFrame:
    """The edges of relationships() that are between classes; of the imports only those are resolved that a base needs. Facts need not be of
    files without code.tells_of_bases(): a symbol that a base is reached by encloses its class, so it is in the class's file."""
    modules, symbols = modules_of(facts), _named(facts)
    imports = scratch(_imports(_base_imports(facts.where("kind = 'import'"), symbols), modules), "imports")
    return inheritance(symbols, modules, import_aliases(imports, modules, symbols))


def _resolved(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where((F.col("relationship_type") == kind) & F.col("target_id").isNotNull() & F.col("resolution_status").isin(*RESOLVED))


def cycle_members(edges: DataFrame, kind: str) -> DataFrame:
    """cycle_groups of the edges of one type that are resolved for sure."""
    sure = edges.where((F.col("relationship_type") == kind) & (F.col("resolution_status") == "resolved-static"))
    return cycles.cycle_groups(sure.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))


def _tallied(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """(k, a count for each part): how often each key stands in a column of each part; parts are (rows, column, name). One aggregate for all of them."""
    tall = None
    for rows, column, name in parts:
        one = rows.select(F.col(column).alias("k"), F.lit(name).alias("m"))
        tall = one if tall is None else tall.unionByName(one)
    return tall.where("k IS NOT NULL").groupBy("k").agg(*[F.count_if(F.col("m") == name).alias(name) for _, _, name in parts])


def _with(rows: DataFrame, key: str, tallies: DataFrame) -> DataFrame:
    """rows with the counts of their key, 0 where there is none."""
    names = [c for c in tallies.columns if c != "k"]
    joined = rows.join(tallies, F.col(key) == F.col("k"), "left").drop("k")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})


def tested_modules(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(k): modules that a test module imports."""
    tests = modules.where(is_test_path(F.col("relative_path"))).select(F.col("module_id").alias("source_id"))
    return _resolved(edges, "imports").join(tests, "source_id", "left_semi").select(F.col("target_id").alias("k")).distinct()


def class_metrics(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """What symbol_metrics() tells of the inheritance of each class; of edges only those between classes are read. The classes on and above a cycle have no depth,
    so cycles are looked for among those only."""
    inherits = scratch(_resolved(edges, "inherits").select("relationship_type", "source_id", "target_id", "resolution_status"), "inherits")
    depths = scratch(cycles.longest_depth(inherits.select(F.col("source_id").alias("child"), F.col("target_id").alias("parent"))), "depths")
    ringed = inherits
    for end in ("source_id", "target_id"):
        ringed = ringed.join(depths.where("depth IS NULL").select(F.col("node").alias(end)), end, "left_semi")
    members = cycle_members(ringed, "inherits").select(F.explode("members").alias("node"))
    kinds = {"direct_parent_count": inherits.select("source_id"), "direct_child_count": inherits.select("target_id"), "inheritance_cycle_membership": members}
    tall = depths.select(F.col("node").alias("k"), F.lit(None).cast("string").alias("m"), "depth")
    for name, rows in kinds.items():
        tall = tall.unionByName(rows.select(F.col(rows.columns[0]).alias("k"), F.lit(name).alias("m"), F.lit(None).cast("int").alias("depth")))
    known = tall.groupBy("k").agg(*[F.count_if(F.col("m") == name).alias(name) for name in kinds], F.max("depth").alias("resolved_inheritance_depth"))
    rows = _named(facts.where("kind = 'class'")).select("symbol_id", "qualified_name", "relative_path", "line").join(known, F.col("symbol_id") == F.col("k"), "left").drop("k")
    return rows.withColumns({name: F.coalesce(name, F.lit(0)).cast("long") for name in kinds})


def module_metrics(facts: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The nine metrics of each module, one column each; groups are the import cycles."""
    modules, symbols = modules_of(facts), symbols_of(facts)
    own = symbols.groupBy(F.col("module_name").alias("k")).agg(
        F.count_if(F.col("kind") == "class").alias("class_count"),
        F.count_if(F.col("kind").isin("function", "method")).alias("function_method_count"),
        F.count_if(F.col("parent").isNull() & (F.col("visibility") == "public")).alias("public_symbol_count"),
        F.count(F.lit(1)).alias("total_symbol_count"),
    )
    rows = modules.withColumnRenamed("line_count", "file_line_count").join(own, F.col("module_name") == F.col("k"), "left").drop("k", "exports", "is_package")
    rows = rows.fillna(0, ["class_count", "function_method_count", "public_symbol_count", "total_symbol_count"])
    imports = _resolved(edges, "imports")
    tallies = _tallied(
        (imports, "target_id", "resolved_fan_in"), (imports, "source_id", "resolved_fan_out"),
        (groups.select(F.explode("members").alias("k")), "k", "import_cycle_membership"), (tested_modules(modules, edges), "k", "nearby_test_evidence"),
    )
    return _with(rows, "module_id", tallies)


def symbol_metrics(facts: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The metrics of each symbol, one column each; groups are the inheritance cycles. The depth is null without resolved parents or above a cycle."""
    modules, symbols = modules_of(facts), symbols_of(facts)
    inherits = scratch(_resolved(edges, "inherits"), "inherits")
    exported = modules.select("relative_path", F.explode("exports").alias("display_name"), F.lit(True).alias("exported")).distinct()
    rows = symbols.join(exported, ["relative_path", "display_name"], "left").withColumns(
        {
            "source_line_span": F.col("end_line") - F.col("line") + 1, "documentation_present": F.col("documented").cast("int"), "public_visibility": (F.col("visibility") == "public").cast("int"),
            "top_level": F.col("parent").isNull(), "exported": F.coalesce("exported", F.lit(False)),
        }
    )
    rows = rows.withColumnsRenamed({"parameters": "parameter_count", "nesting": "maximum_nesting", "complexity": "cyclomatic_complexity"})
    rows = _with(rows, "relative_path", _tallied((tested_modules(modules, edges), "k", "nearby_test_evidence")))
    incoming = edges.where("relationship_type <> 'contains' AND target_id IS NOT NULL").where(F.col("resolution_status").isin(*RESOLVED))
    tallies = _tallied(
        (inherits, "source_id", "direct_parent_count"), (inherits, "target_id", "direct_child_count"),
        (groups.select(F.explode("members").alias("k")), "k", "inheritance_cycle_membership"), (incoming, "target_id", "incoming"),
    )
    rows = _with(rows, "symbol_id", tallies)
    depths = cycles.longest_depth(inherits.select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")))
    keep = ["symbol_id", "qualified_name", "display_name", "kind", "module_name", "relative_path", "line", "visibility", "documented", "top_level", "exported", "incoming"]
    return rows.join(depths.select(F.col("node").alias("symbol_id"), F.col("depth").alias("resolved_inheritance_depth")), "symbol_id", "left").select(
        *keep, "source_line_span", "parameter_count", "maximum_nesting", "cyclomatic_complexity", "documentation_present", "public_visibility", "nearby_test_evidence", "direct_parent_count", "direct_child_count",
        "inheritance_cycle_membership", "resolved_inheritance_depth",
    )


def analyse(files: DataFrame, policy: findings.Policy = findings.Policy(), repository_id: str = "repository") -> DataFrame:
    """Findings of all rules for a table of files (relative_path, content): scan, resolve, measure, judge, and one record for each finding_id, with what it
    says, what it rests on and the nodes it is about. subject joins the keys by commas; value and threshold are those of the first of merged places."""
    facts = scratch(scan_sources(files, REVIEW_FACTS), "facts")
    edges = scratch(relationships(facts), "edges")
    nodes = scratch(graph_nodes(modules_of(facts), symbols_of(facts)).select("node_id", "qualified_name"), "nodes")
    rings = {kind: scratch(cycle_members(edges, kind), "rings") for kind in ("imports", "inherits")}
    modules = module_metrics(facts, edges, rings["imports"])
    symbols = scratch(symbol_metrics(facts, edges, rings["inherits"]), "symbols")
    shaped = modules.select("module_name", "relative_path", F.col("file_line_count").alias("line_count"), F.col("resolved_fan_in").alias("fan_in"), F.col("resolved_fan_out").alias("fan_out"), F.col("module_id").alias("node_id"))
    named = symbols.withColumnsRenamed(
        {"source_line_span": "span", "cyclomatic_complexity": "complexity", "maximum_nesting": "nesting", "parameter_count": "parameters", "resolved_inheritance_depth": "depth",
         "inheritance_cycle_membership": "in_cycle", "nearby_test_evidence": "nearby_test", "symbol_id": "node_id"}
    )
    out = findings.module_findings(shaped, policy).unionByName(findings.symbol_findings(named, policy))
    out = out.unionByName(findings.repeated_names(named), allowMissingColumns=True)
    for kind, ring in rings.items():
        out = out.unionByName(findings.named_cycles(ring, nodes, kind), allowMissingColumns=True)
    return findings.record(out, repository_id)
