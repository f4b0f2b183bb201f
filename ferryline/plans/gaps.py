"""What a target can't take as it is: findings, merged and rendered."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKER, DEGRADED, INFO = "blocker", "degraded", "info"


@dataclass(frozen=True)
class Gap:
    feature: str
    recommendation: str
    severity: str = DEGRADED
    object_ref: str | None = None
    occurrences: int = 1
    workaround: str | None = None
    edition: str = "unknown"


class GapReport:
    """Gaps in the order they were found; one feature in one object counts up, and its first severity holds."""

    def __init__(self, gaps=()):
        self._by: dict[tuple, Gap] = {}
        for g in gaps:
            self.add(g)

    def add(self, gap: Gap) -> None:
        key = (gap.feature, gap.object_ref)
        old = self._by.get(key)
        self._by[key] = replace(old, occurrences=old.occurrences + gap.occurrences) if old else gap

    @property
    def gaps(self) -> list[Gap]:
        return list(self._by.values())

    def text(self) -> str:
        if not self._by:
            return "No target gaps found."
        lines = [f"Target gaps ({len(self._by)}):"]
        for g in self.gaps:
            where = f" in {g.object_ref}" if g.object_ref else ""
            times = f" x{g.occurrences}" if g.occurrences != 1 else ""
            lines.append(f"  [{g.severity.upper()}] {g.feature}{where}{times} ({g.edition}) -> {g.recommendation}")
            if g.workaround:
                lines.append(f"      workaround: {g.workaround}")
        return "\n".join(lines)

    def json(self) -> str:
        return json.dumps([asdict(g) for g in self.gaps], indent=2)

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = "feature string, recommendation string, severity string, object_ref string, occurrences int, workaround string, edition string"
        return spark.createDataFrame([tuple(asdict(g).values()) for g in self.gaps], schema)


def merged(gaps: DataFrame) -> DataFrame:
    """The same merge for gaps in a table: occurrences add up by feature and object."""
    return gaps.groupBy("feature", "object_ref").agg(F.sum("occurrences").cast("bigint").alias("occurrences"))
