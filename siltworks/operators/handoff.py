"""Bounded exports of a comparison: caps per section, a byte budget, a digest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.text import markdown_escape

# Version of the rendered form, and the sections that may be asked for.
HANDOFF_FORMAT_VERSION = "2"
HANDOFF_SECTIONS = ("comparison", "files", "symbols", "relationships", "cycles", "metrics", "findings", "task-objective")
SELECTION_CAP, OBJECTIVE_CHARS = 500, 2000
SECTION_CAP, FINDING_CAP, NOTE_CAP, NOTE_CHARS = 50, 50, 20, 1000


def capped(rows: DataFrame, section: str, order: Sequence[Column | str], cap: int = SECTION_CAP) -> DataFrame:
    """The first cap rows of each section with n_total and n_omitted. A top-k per section: the rank limit is pushed below the shuffle."""
    line = Window.partitionBy(section).orderBy(*order)
    kept = rows.withColumn("ho_place", F.row_number().over(line)).where(F.col("ho_place") <= cap)
    totals = rows.groupBy(section).agg(F.count(F.lit(1)).alias("n_total"))
    return kept.join(totals, section).withColumn("n_omitted", F.greatest(F.col("n_total") - cap, F.lit(0)))


def selected(deltas: DataFrame, delta_ids: Sequence[str], enabled: Sequence[str], cycle_ids: Sequence[str] = (), cap: int = SECTION_CAP) -> DataFrame:
    """The chosen differences (section, logical_key, delta_id, ...), the first cap of each section by key and id, with n_total and n_omitted. cycle_ids choose
    differences of the section cycles by baseline_cycle_id or target_cycle_id. Refused are sections that do not exist, ids that no difference
    has, and ids of sections that are not enabled. A selection is bounded, and so is what is read of it here."""
    unknown = set(enabled) - set(HANDOFF_SECTIONS)
    if unknown:
        raise ValueError(f"unsupported section: {', '.join(sorted(unknown))}")
    if len(delta_ids) + len(cycle_ids) > SELECTION_CAP:
        raise ValueError(f"at most {SELECTION_CAP} selections")
    if cycle_ids and "cycles" not in enabled:
        raise ValueError("a selected cycle belongs to a disabled section")
    ends = [c for c in ("baseline_cycle_id", "target_cycle_id") if c in deltas.columns]
    chosen = F.col("delta_id").isin(list(delta_ids))
    for end in ends:
        chosen = chosen | ((F.col("section") == "cycles") & F.col(end).isin(list(cycle_ids)))
    rows = deltas.where(F.coalesce(chosen, F.lit(False)))
    found = rows.select("section", "delta_id", *ends).distinct().limit(2 * SELECTION_CAP + 1).collect()
    if set(delta_ids) - {r["delta_id"] for r in found}:
        raise ValueError("a selected difference is unknown or stale")
    if set(cycle_ids) - {r[end] for r in found for end in ends}:
        raise ValueError("a selected cycle is unknown or stale")
    if {r["section"] for r in found} - set(enabled):
        raise ValueError("a selected difference belongs to a disabled section")
    return capped(rows, "section", ["logical_key", "delta_id"], cap)


def rendered_digest(markdown: str, body: str, version: str = HANDOFF_FORMAT_VERSION) -> str:
    """Digest of exactly what was rendered: version, Markdown and JSON with a zero byte between each."""
    return hashlib.sha256(b"\x00".join(x.encode() for x in (version, markdown, body))).hexdigest()


def markdown_rows(rows: DataFrame, section: str, label: str, change: str) -> DataFrame:
    return rows.withColumn("line", F.concat(F.lit("- **"), F.col(change), F.lit("** "), markdown_escape(F.col(label))))


def canonical(payload: Mapping) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"


def render(required: Mapping, optional: Mapping[str, Sequence], notes: Sequence[str], most_bytes: int, most_chars: int) -> dict:
    """One export on the driver, from rows that capped() has bounded. If the JSON is over its budget all optional sections go; a required part over
    the budget is an error; Markdown is cut with a note."""
    if len(notes) > NOTE_CAP or any(len(n) > NOTE_CHARS for n in notes):
        raise ValueError("too many or too long notes")
    payload = {"required": dict(required), "optional": {k: list(v) for k, v in optional.items()}, "notes": list(notes), "omitted": []}
    if len(canonical(payload).encode()) > most_bytes:
        payload |= {"optional": {}, "omitted": sorted(optional)}
    body = canonical(payload)
    if len(body.encode()) > most_bytes:
        raise ValueError("the required part is over the budget")
    lines = ["# Handoff", "", *(f"- {k}: {v}" for k, v in sorted(required.items()))]
    for name, rows in payload["optional"].items():
        lines += ["", f"## {name}", *(f"- {r}" for r in rows)]
    text = "\n".join(lines)
    trailer = "\n\n[truncated]"
    if len(text) > most_chars:
        text = text[: most_chars - len(trailer)] + trailer
    return {"json": body, "markdown": text, "digest": rendered_digest(text, body), "truncated": text.endswith(trailer)}


def verify(saved: Mapping) -> bool:
    return rendered_digest(saved["markdown"], saved["json"]) == saved["digest"]
