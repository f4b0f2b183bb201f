"""What a schema holds, what of it needs work by hand, and how much."""

from __future__ import annotations

import html
import json
import re
from dataclasses import asdict, dataclass, field

from ..functions.render import ROUTINE_WEIGHTS
from .ddl import custom_types
from .gaps import DEGRADED, Gap, GapReport
from .model import Schema

#: Days of work by object.
DAYS = {"routines": 0.25, "triggers": 0.1, "materialized_views": 0.1, "partitioned_tables": 0.1}
#: A routine's constructs as one pattern, a group for each: none begins inside another, so that one pass counts them all.
_CONSTRUCTS = re.compile(r"\b(?:" + "|".join(f"({pattern.removeprefix(r'\b')})" for pattern, _ in ROUTINE_WEIGHTS) + ")", re.I)


def score_routine(body: str | None) -> int:
    """Weighted count of the constructs in a routine's body (functions.render.routine_cost for a column)."""
    return sum(ROUTINE_WEIGHTS[m.lastindex - 1][1] for m in _CONSTRUCTS.finditer(body or ""))


def inventory(schema: Schema) -> dict[str, int]:
    t = schema.tables
    return {
        "tables": len(t), "columns": sum(len(x.columns) for x in t), "primary_keys": sum(bool(x.primary_key) for x in t),
        "foreign_keys": sum(len(x.foreign_keys) for x in t), "indexes": sum(len(x.indexes) for x in t), "checks": sum(len(x.checks) for x in t),
        "partitioned_tables": sum(x.partition is not None for x in t), "views": sum(not v.materialized for v in schema.views),
        "materialized_views": sum(v.materialized for v in schema.views), "sequences": len(schema.sequences), "routines": len(schema.routines), "triggers": len(schema.triggers),
    }


def procedural_gaps(schema: Schema) -> GapReport:
    """One gap for each object that moves only by hand."""
    by_hand = "kept verbatim in the review file"
    out = GapReport()
    for r in schema.routines:
        out.add(Gap(f"PL/SQL {r.kind}", f"port the {r.kind}'s body by hand", DEGRADED, r.name, 1, by_hand))
    for t in schema.triggers:
        out.add(Gap("trigger", f"write the trigger on {t.table} anew", DEGRADED, t.name, 1, by_hand))
    for v in schema.views:
        if v.materialized:
            out.add(Gap("materialized view", "create it anew, with a way to refresh it", DEGRADED, v.name, 1, by_hand))
    for t in schema.tables:
        if t.partition:
            out.add(Gap("partitioned table", f"partition by {t.partition[0].lower()} ({', '.join(t.partition[1]) or '?'}) again if it is needed", DEGRADED, t.name, 1, "its rows move into one table"))
    for g in custom_types(schema.tables):
        out.add(g)
    return out


def review_file(schema: Schema) -> str:
    """The sources of what moves by hand, as comments; empty if there is nothing."""
    blocks = [(f"{r.kind.upper()}: {r.name}", r.body) for r in schema.routines]
    blocks += [(f"TRIGGER: {t.name} ON {t.table} ({t.timing} {' OR '.join(t.events)})", t.body) for t in schema.triggers]
    blocks += [(f"MATERIALIZED VIEW: {v.name}", v.definition) for v in schema.views if v.materialized]
    parts = [f"-- ===== {title} =====\n-- REVIEW: not translated.\n/*\n{body}\n*/" for title, body in blocks if body]
    return "-- Objects that were not moved, for porting by hand.\n\n" + "\n\n".join(parts) + "\n" if parts else ""


@dataclass
class Report:
    schema: str
    inventory: dict[str, int]
    gaps: list[Gap] = field(default_factory=list)
    routine_units: int = 0

    @property
    def days(self) -> float:
        return round(sum(DAYS[k] * self.inventory[k] for k in DAYS), 2)

    def text(self) -> str:
        lines = [f"Schema {self.schema}", *(f"  {k.replace('_', ' ')}: {v}" for k, v in self.inventory.items()), f"  estimated days of work by hand: {self.days:g}"]
        return "\n".join(lines) + "\n" + GapReport(self.gaps).text()

    def json(self) -> str:
        return json.dumps({"schema": self.schema, "inventory": self.inventory, "days": self.days, "routine_units": self.routine_units, "gaps": [asdict(g) for g in self.gaps]}, indent=2)

    def html(self) -> str:
        cell = lambda x: f"<td>{html.escape(str(x))}</td>"
        rows = "".join(f"<tr>{cell(k.replace('_', ' '))}{cell(v)}</tr>" for k, v in self.inventory.items())
        gaps = "".join(f"<tr>{cell(g.severity)}{cell(g.feature)}{cell(g.object_ref or '')}{cell(g.occurrences)}{cell(g.recommendation)}</tr>" for g in self.gaps)
        return f"<!DOCTYPE html><html><head><title>{html.escape(self.schema)}</title></head><body><h1>{html.escape(self.schema)}</h1><table>{rows}</table><p>Days: {self.days:g}</p><table>{gaps}</table></body></html>"


def assess(schema: Schema) -> Report:
    return Report(schema.name, inventory(schema), procedural_gaps(schema).gaps, sum(score_routine(r.body) for r in schema.routines))
