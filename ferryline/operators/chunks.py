"""Deterministic key ranges: bounds, chunks, and a load's summary by chunk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    """(lo, hi): the least and greatest key, rounded down; nulls if the table is empty."""
    k = F.floor(F.col(key)).cast("bigint")
    return df.agg(F.min(k).alias("lo"), F.max(k).alias("hi"))


@dataclass(frozen=True)
class Chunk:
    """A half-open key range [lo, hi), or the whole table; a recorded predicate is used as it stands.  ``estimate`` is how many
    rows it may have."""

    chunk_id: str
    key: str | None = None
    lo: int | None = None
    hi: int | None = None
    recorded: str | None = None
    estimate: int | None = None

    def predicate(self, quote: str = '"') -> str | None:
        if self.recorded is not None:
            return self.recorded
        if self.key is None:
            return None
        name = f"{quote}{self.key.replace(quote, quote * 2)}{quote}"
        return f"{name} >= {self.lo} AND {name} < {self.hi}"

    def condition(self) -> Column:
        """The range as a Spark condition, which reaches the scan."""
        return F.lit(True) if self.key is None else (F.col(f"`{self.key}`") >= self.lo) & (F.col(f"`{self.key}`") < self.hi)


def whole(c: Column) -> Column:
    """A key rounded down, as an exact whole number whose differences don't overflow."""
    return F.floor(c).cast("decimal(20,0)")


def chunk_number(key: Column, lo: Column | int, step: Column | int) -> Column:
    """How many steps a key is past ``lo``, by whole numbers: keys past 2**53 are not rounded."""
    lo, step = (x if isinstance(x, Column) else F.lit(x).cast("decimal(20,0)") for x in (lo, step))
    return F.call_function("div", whole(key) - lo.cast("decimal(20,0)"), step.cast("decimal(20,0)"))


def step_of(lo: int, hi: int, wanted: int) -> int:
    span = hi - lo + 1
    return -(-span // max(1, min(wanted, span)))


def plan_chunks(table: str, key: str | None, bounds: tuple[int, int] | None, wanted: int) -> list[Chunk]:
    """About ``wanted`` ranges of one size over the bounds; one whole-table chunk without an integer key."""
    if key is None or bounds is None or bounds[0] is None or wanted <= 1:
        return [Chunk(f"{table}:0")]
    lo, hi = bounds
    step = step_of(lo, hi, wanted)
    return [Chunk(f"{table}:{n}", key, a, min(a + step, hi + 1)) for n, a in enumerate(range(lo, hi + 1, step))]


def even_chunks(df: DataFrame, table: str, key: str, wanted: int, accuracy: int = 100) -> list[Chunk]:
    """About ``wanted`` ranges of about equal numbers of rows, however the keys cluster, each with an estimate of its rows.

    The cuts are quantiles from a mergeable sketch of the key, which is read alone; their error is a ``wanted * accuracy``-th of
    all rows.  A key that many rows have can't be cut: its range has them all.  Without rows there is one whole-table chunk.
    """
    k = F.floor(F.col(f"`{key}`")).cast("bigint")
    shares = [i / wanted for i in range(1, wanted)] or [0.5]
    n, lo, hi, cuts = df.agg(F.count(k), F.min(k), F.max(k), F.percentile_approx(k, shares, wanted * accuracy)).first()
    if not n or wanted <= 1:
        return [Chunk(f"{table}:0", estimate=n or 0)]
    lows = sorted({lo, *(c + 1 for c in cuts if c < hi)})
    ends = [*lows[1:], hi + 1]
    below = lambda x: sum(c < x for c in cuts) / wanted
    share = [(below(b) if b <= hi else 1) - (below(a) if a > lo else 0) for a, b in zip(lows, ends)]
    return [Chunk(f"{table}:{i}", key, a, b, None, round(n * x)) for i, (a, b, x) in enumerate(zip(lows, ends, share))]


def with_chunks(df: DataFrame, key: str, bounds: DataFrame, wanted: int) -> DataFrame:
    """Rows with chunk_no and the chunk's lo and hi (null past the largest long), from the table's own bounds (one row, a
    scalar subquery)."""
    first, last = (bounds.select(c).scalar().cast("decimal(20,0)") for c in ("lo", "hi"))
    out = df.withColumns({"__lo": first, "__hi": last})
    span = F.col("__hi") - F.col("__lo") + 1
    ranges = F.greatest(F.lit(1).cast("decimal(22,0)"), F.least(F.lit(wanted).cast("decimal(22,0)"), span))
    out = out.withColumn("__step", F.call_function("div", span + ranges - 1, ranges).cast("decimal(20,0)"))
    no = chunk_number(F.col(key), F.col("__lo"), F.col("__step"))
    lo = F.col("__lo") + no.cast("decimal(20,0)") * F.col("__step")
    hi = F.least(lo + F.col("__step"), F.col("__hi") + 1)
    return out.withColumns({"chunk_no": no, "lo": lo.cast("bigint"), "hi": hi.try_cast("bigint")}).drop("__lo", "__hi", "__step")
