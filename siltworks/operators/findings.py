"""Metrics and finding rules over code evidence. One projection per rule, united."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import is_test_path
from siltworks.functions.values import threshold_severity
from siltworks.operators.lifecycle import finding_id


@dataclass(frozen=True)
class Policy:
    """Thresholds; a value must be above one to be a finding."""

    module_lines: int = 1000
    class_lines: int = 400
    function_lines: int = 80
    complexity: int = 15
    nesting: int = 5
    parameters: int = 8
    fan: int = 12
    depth: int = 5


COLUMNS = "rule_id string, family string, severity string, confidence string, subject string, relative_path string, line int, value double, threshold double, node_id string, kind string"

# Title, subject type and measured value of each rule, and what the rules say that state no threshold.
RULES = {
    "dependency-cycle": ("Confirmed module dependency cycle", "cycle", "member_count"),
    "inheritance-cycle": ("Confirmed inheritance cycle", "cycle", "member_count"),
    "exact-duplicate-symbol-name": ("Repeated exact {kind} name candidate", "symbol-group", "duplicate_count"),
    "oversized-module": ("Large module", "module", "file_line_count"),
    "high-resolved-fan-in": ("High resolved fan-in", "module", "resolved_fan_in"),
    "high-resolved-fan-out": ("High resolved fan-out", "module", "resolved_fan_out"),
    "oversized-symbol": ("Large {kind}", "symbol", "source_line_span"),
    "high-cyclomatic-complexity": ("High static cyclomatic complexity", "symbol", "cyclomatic_complexity"),
    "complexity-without-nearby-test-evidence": ("High complexity without nearby test evidence", "symbol", "cyclomatic_complexity"),
    "high-maximum-nesting": ("Deeply nested symbol", "symbol", "maximum_nesting"),
    "high-parameter-count": ("Many parameters", "symbol", "parameter_count"),
    "deep-inheritance": ("Deep resolved inheritance", "symbol", "resolved_inheritance_depth"),
    "undocumented-public-symbol": ("Undocumented public symbol", "symbol", None),
    "orphan-looking-candidate": ("Orphan-looking public symbol candidate", "symbol", None),
}
CYCLE_TEXT = ("Resolved internal relationships form a confirmed static cycle.", "Review whether the cycle can be reduced without changing behavior.")
TEXTS = {
    "dependency-cycle": CYCLE_TEXT,
    "inheritance-cycle": CYCLE_TEXT,
    "complexity-without-nearby-test-evidence": (
        "Static complexity exceeds the experimental threshold and no recognized test module has a resolved import to this source module. This is not a claim that the symbol is untested.",
        "Review available tests and add focused coverage if appropriate.",
    ),
    "undocumented-public-symbol": ("A public top-level symbol has no statically visible docstring.", "Confirm public intent and document the symbol when useful."),
    "orphan-looking-candidate": (
        "No resolved incoming non-containment relationship was found. Static analysis cannot prove that this symbol is unused.",
        "Review entry points, dynamic use, and public API intent.",
    ),
}
DUPLICATE_ACTION = "Confirm whether the repeated name is intentional and clear in context."
THRESHOLD_ACTION = "Review the measured structure and refactor only when it improves maintainability."


def wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per subject with a column per metric; a metric that is absent is null."""
    return metrics.groupBy("subject_id").agg(*[F.max(F.when(F.col("metric_name") == n, F.col("numeric_value"))).alias(n) for n in names])


def tall(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(subject_id, metric_name, numeric_value), without nulls."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("numeric_value")) for n in names]))
    return rows.select(F.col(key).alias("subject_id"), pairs.alias("m")).select("subject_id", "m.*").where("numeric_value IS NOT NULL")


def _row(rule: str, family: str, severity: Column | str, confidence: str, subject: Column, path: Column, line: Column, value: Column | None = None, threshold: Column | None = None, node: Column | None = None, kind: Column | None = None) -> list[Column]:
    none, nothing = F.lit(None).cast("double"), F.lit(None).cast("string")
    return [
        F.lit(rule).alias("rule_id"),
        F.lit(family).alias("family"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(confidence).alias("confidence"),
        subject.cast("string").alias("subject"),
        path.cast("string").alias("relative_path"),
        line.cast("int").alias("line"),
        (none if value is None else value.cast("double")).alias("value"),
        (none if threshold is None else threshold.cast("double")).alias("threshold"),
        (nothing if node is None else node).alias("node_id"),
        (nothing if kind is None else kind).alias("kind"),
    ]


def _of(rows: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in rows.columns else None


def threshold_findings(rows: DataFrame, rule: str, family: str, subject: str, value: str, threshold: Column, severity: str | None = None, confidence: str = "high") -> DataFrame:
    """Rows whose value is above the threshold. Severity grows with the excess unless it is fixed."""
    graded = F.lit(severity) if severity else threshold_severity(F.col(value), threshold)
    path = F.col("relative_path") if "relative_path" in rows.columns else F.lit(None)
    line = F.col("line") if "line" in rows.columns else F.lit(None)
    return rows.where(F.col(value) > threshold).select(*_row(rule, family, graded, confidence, F.col(subject), path, line, F.col(value), threshold, _of(rows, "node_id"), _of(rows, "kind")))


def duplicate_names(symbols: DataFrame, kind: str, name: str, qualified: str, least: Column) -> DataFrame:
    """Names that stand for several distinct qualified names: (kind, name, n, subjects)."""
    rows = symbols.where(~F.col(name).startswith("__"))
    groups = rows.groupBy(kind, name).agg(F.array_sort(F.collect_set(qualified)).alias("subjects"))
    return groups.where(F.size("subjects") >= least).select(kind, name, F.size("subjects").alias("n"), "subjects")


def not_excluded(visibility: Column, path: Column) -> Column:
    """Neither private itself nor in a generated or vendored folder, in any case of letters; what a private module or class holds may be public."""
    parts = F.split(F.lower(path), "/")
    return ~(F.arrays_overlap(parts, F.array(F.lit("generated"), F.lit("vendor"), F.lit("vendored"))) | (visibility == "private"))


def module_findings(modules: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """modules (module_name, relative_path, line_count, fan_in, fan_out)."""
    rows = modules.withColumn("line", F.lit(1))
    out = threshold_findings(rows, "oversized-module", "oversized", "module_name", "line_count", F.lit(policy.module_lines))
    for name in ("fan_in", "fan_out"):
        rule = f"high-resolved-{name.replace('_', '-')}"
        out = out.unionByName(threshold_findings(rows, rule, "coupling", "module_name", name, F.lit(policy.fan), "medium"))
    return out


def symbol_findings(symbols: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """symbols (qualified_name, kind, relative_path, line, span, complexity, nesting, parameters, depth, in_cycle, nearby_test, top_level, visibility,
    documented, incoming, exported, display_name, module_name): rules over single symbols, excluded ones left out."""
    rows = symbols.where(not_excluded(F.col("visibility"), F.col("relative_path")))
    code = rows.where(F.col("kind").isin("function", "method"))
    limit = F.when(F.col("kind") == "class", policy.class_lines).otherwise(policy.function_lines)
    out = threshold_findings(rows.where(F.col("kind").isin("class", "function", "method")), "oversized-symbol", "oversized", "qualified_name", "span", limit)
    out = out.unionByName(threshold_findings(code, "high-cyclomatic-complexity", "complexity", "qualified_name", "complexity", F.lit(policy.complexity), "medium"))
    untested = code.where(F.coalesce("nearby_test", F.lit(0)) == 0)
    out = out.unionByName(
        threshold_findings(untested, "complexity-without-nearby-test-evidence", "test-evidence-candidate", "qualified_name", "complexity", F.lit(policy.complexity), "medium", "medium")
    )
    out = out.unionByName(threshold_findings(code, "high-maximum-nesting", "nesting", "qualified_name", "nesting", F.lit(policy.nesting)))
    out = out.unionByName(threshold_findings(code, "high-parameter-count", "parameters", "qualified_name", "parameters", F.lit(policy.parameters)))
    deep = rows.where((F.col("kind") == "class") & (F.coalesce("in_cycle", F.lit(0)) == 0))
    out = out.unionByName(threshold_findings(deep, "deep-inheritance", "inheritance", "qualified_name", "depth", F.lit(policy.depth), "medium"))
    public = rows.where(F.col("kind").isin("class", "function") & F.col("top_level") & (F.col("visibility") == "public"))
    named = [F.col("qualified_name"), F.col("relative_path"), F.col("line"), None, None, _of(rows, "node_id"), F.col("kind")]
    out = out.unionByName(public.where(~F.col("documented")).select(*_row("undocumented-public-symbol", "documentation", "low", "high", *named)))
    alone = (F.col("incoming") == 0) & ~F.col("exported") & ~F.col("display_name").isin("main", "cli") & (F.col("module_name") != "__main__") & ~is_test_path(F.col("relative_path"))
    return out.unionByName(public.where(alone).select(*_row("orphan-looking-candidate", "orphan-candidate", "low", "low", *named)))


def cycle_findings(groups: DataFrame, relationship: str) -> DataFrame:
    """groups of operators.graph.cycle_groups."""
    family = {"imports": "dependency-cycle", "inherits": "inheritance-cycle"}[relationship]
    size = F.size("members")
    return groups.select(*_row(family, family, "high", "high", F.array_join(F.col("members").cast("array<string>"), ","), F.lit(None), F.lit(None), size))


def named_cycles(groups: DataFrame, nodes: DataFrame, relationship: str) -> DataFrame:
    """Findings of groups (component, members), as record() takes them: subjects are the qualified names of their members, from nodes (node_id, qualified_name)."""
    members = groups.select("component", F.explode("members").alias("node_id")).join(nodes.select("node_id", "qualified_name"), "node_id")
    keys = members.groupBy("component").agg(F.array_sort(F.collect_list("qualified_name")).alias("subject_keys"), F.array_sort(F.collect_list("node_id")).alias("affected_node_ids"))
    family = {"imports": "dependency-cycle", "inherits": "inheritance-cycle"}[relationship]
    row = _row(family, family, "high", "high", F.array_join("subject_keys", ","), F.lit(None), F.lit(None), F.size("subject_keys"))
    return keys.select(*row, "subject_keys", "affected_node_ids", F.lit(None).cast("string").alias("name"))


def repeated_names(symbols: DataFrame) -> DataFrame:
    """Findings of exact names that stand for several qualified symbols of a kind (five for methods, else two), as record() takes them; excluded symbols and
    names with two leading underscores are left out. Of several symbols of one qualified name the last one, by path and line, stands for it."""
    rows = symbols.where(not_excluded(F.col("visibility"), F.col("relative_path")) & ~F.startswith(F.col("display_name"), F.lit("__")))
    last = F.max(F.struct("relative_path", "line", "node_id")).alias("at")
    unique = rows.groupBy("kind", F.col("display_name").alias("name"), "qualified_name").agg(last)
    groups = unique.groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct("qualified_name", "at"))).alias("g"))
    groups = groups.where(F.size("g") >= F.when(F.col("kind") == "method", 5).otherwise(2))
    keys = F.transform("g", lambda x: x["qualified_name"])
    first = F.element_at("g", 1)["at"]
    row = _row("exact-duplicate-symbol-name", "duplicate-name-candidate", "low", "high", F.array_join(keys, ","), first["relative_path"], first["line"], F.size("g"), None, None, F.col("kind"))
    return groups.select(*row, keys.alias("subject_keys"), F.array_sort(F.transform("g", lambda x: x["at"]["node_id"])).alias("affected_node_ids"), "name")


def general(value: Column) -> Column:
    """A count as text: whole numbers in full below a million, else six significant digits."""
    far = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", value), r"0+e", "e"), r"\.e", "e")
    return F.when(value < 1_000_000, value.cast("long").cast("string")).otherwise(far)


def record(rows: DataFrame, repository_id: str, rule_version: str = "1") -> DataFrame:
    """Rule rows (COLUMNS; where a subject has several keys, subject_keys, affected_node_ids and name beside) as full findings, one per finding_id."""
    for name, kind in (("subject_keys", "array<string>"), ("affected_node_ids", "array<string>"), ("name", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rule = F.col("rule_id")

    def by_rule(pick) -> Column:  # noqa: ANN001
        return F.element_at(F.create_map(*[F.lit(x) for r in RULES for x in (r, pick(r))]), rule)

    metric = by_rule(lambda r: RULES[r][2])
    said = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for r, t in TEXTS.items() for x in (r, t[i])]), rule)
    words = F.replace(metric, F.lit("_"), F.lit(" "))
    measured = F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1000), F.lit(" is "), general(F.col("value")), F.lit("; the experimental threshold is greater than "), general(F.col("threshold")), F.lit("."))
    repeated = F.concat(F.lit('The exact case-sensitive name "'), F.col("name"), F.lit('" appears in '), general(F.col("value")), F.lit(" different qualified symbols. This does not imply duplicate behavior."))
    pair = lambda c: F.when(metric.isNotNull() & F.col(c).isNotNull(), F.array(F.struct(metric.alias("name"), F.col(c).alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:double>>"))
    subject_type = by_rule(lambda r: RULES[r][1])
    keys = F.coalesce("subject_keys", F.array("subject"))
    full = rows.select(
        finding_id(F.lit(repository_id), rule, F.lit(rule_version), subject_type, keys).alias("finding_id"), rule, F.lit(rule_version).alias("rule_version"), "family",
        F.replace(by_rule(lambda r: RULES[r][0]), F.lit("{kind}"), F.coalesce("kind", F.lit(""))).alias("title"), F.coalesce(said(0), repeated, measured).alias("explanation"),
        F.coalesce(said(1), F.when(F.col("name").isNotNull(), DUPLICATE_ACTION).otherwise(THRESHOLD_ACTION)).alias("suggested_action"), "severity", "confidence", subject_type.alias("subject_type"),
        F.array_sort(keys).alias("subject_keys"), F.coalesce("affected_node_ids", F.array_compact(F.array("node_id"))).alias("affected_node_ids"), "relative_path", "line", pair("value").alias("metric_evidence"),
        pair("threshold").alias("threshold_evidence"), "subject", "value", "threshold",
    )
    return merged(full)


def merged(full: DataFrame) -> DataFrame:
    """Findings of one id as one row: the first by path, line and nodes, with the nodes and evidence of all; path and line only where all agree. A group is as
    large as the number of places that hold one subject."""
    united = ("affected_node_ids", "metric_evidence", "threshold_evidence")
    same = [c for c in full.columns if c not in (*united, "finding_id", "relative_path", "line")]
    first = F.struct(F.coalesce("relative_path", F.lit("")), F.coalesce("line", F.lit(0)), "affected_node_ids")
    path, line = F.min(F.struct("relative_path")), F.min(F.struct("line"))
    one_path = (path == F.max(F.struct("relative_path"))).alias("one_path")
    one_line = (line == F.max(F.struct("line"))).alias("one_line")
    groups = full.groupBy("finding_id").agg(
        F.min_by(F.struct(*same), first).alias("s"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in united],
        path.alias("p"), line.alias("l"), one_path, one_line,
    )
    return groups.select("finding_id", "s.*", *united, F.when(F.col("one_path"), F.col("p.relative_path")).alias("relative_path"), F.when(F.col("one_path") & F.col("one_line"), F.col("l.line")).alias("line"))
