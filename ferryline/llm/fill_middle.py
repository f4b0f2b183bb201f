"""Fill-in-middle: a text cut at two places and put together again with its middle last.

A text is read once, block by block, to count its units; every so many units the byte and code-point offsets are kept
as a checkpoint.  A cut is a unit's number: a binary search over the checkpoints finds the last one before it, and from
there at most that many units are scanned again.  Nothing is decoded, and memory beside the text is a block and its
checkpoints, however long the text is.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw, text_only, unlike

#: Units from one checkpoint to the next, and bytes of a block while counting.
EVERY, BLOCK = 1024, 1 << 16
#: What stands before the prefix, the suffix and the middle.  Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _points(block: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (block & 0xC0) != 0x80


def _starts(block: np.ndarray, before: int | None, unit: str) -> np.ndarray:
    """Which bytes begin a unit; ``before`` is the byte before the block, None at the text's start.

    A word is a run of bytes that aren't ASCII white space with the white space after it, a line ends with its newline.  The
    first unit begins at the text's start, so that units cover all of it.
    """
    if unit == "char":
        return _points(block)
    last = np.concatenate((np.array([0 if before is None else before], np.uint8), block[:-1]))
    out = last == 10 if unit == "line" else _WHITE[last] & ~_WHITE[block]
    if before is None:
        out[:1] = True
    return out


class Checkpoints:
    """The sparse index of one text (UTF-8): its units, its code points, and both offsets of every ``every``-th unit."""

    def __init__(self, text: bytes, unit: str = "char", every: int = EVERY):
        if unit not in UNITS:
            raise ValueError(f"a unit is one of {', '.join(UNITS)}")
        self.text, self.unit, self.every = text, unit, every
        self.n = self.points = 0
        self.units: list[int] = []
        self.byte_at: list[int] = []
        self.point_at: list[int] = []
        for at in range(0, len(text), BLOCK):
            block = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
            found = np.flatnonzero(_starts(block, text[at - 1] if at else None, unit))
            points = _points(block)
            kept = found[-self.n % every :: every]
            if len(kept):
                self.units += range(self.n + -self.n % every, self.n + len(found), every)
                self.byte_at += (kept + at).tolist()
                self.point_at += (np.cumsum(points)[kept] - 1 + self.points).tolist()
            self.n, self.points = self.n + len(found), self.points + int(points.sum())

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of a unit's start; of the text's end for the unit past the last."""
        if unit >= self.n:
            return len(self.text), self.points
        k = bisect_right(self.units, unit) - 1
        at, point, left = self.byte_at[k], self.point_at[k], unit - self.units[k]
        while True:  # the unit is fewer than ``every`` starts from here
            block = np.frombuffer(self.text, np.uint8, min(4 * self.every, len(self.text) - at), at)
            found = np.flatnonzero(_starts(block, self.text[at - 1] if at else None, self.unit))
            if left < len(found):
                return at + int(found[left]), point + int(_points(block[: found[left]]).sum())
            left, at, point = left - len(found), at + len(block), point + int(_points(block).sum())


def draws(key: str) -> list[int]:
    """The first four groups of eight hex digits of the key's SHA-256, as numbers."""
    digest = hashlib.sha256(key.encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


def rearranged(text: bytes, key: str, unit: str = "char", every: int = EVERY, plain: int = 10, spm: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text; ``plain`` and ``spm`` are percentages."""
    index = Checkpoints(text, unit, every)
    h1, h2, h3, h4 = draws(key)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or h3 % 100 >= 100 - plain or any(m in text for m in marks):
        return index.n, "plain", None, None, text
    (a, a_point), (b, b_point) = map(index.cut, sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    p, s, m = marks
    if h4 % 100 < spm:
        form, out = "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    else:
        form, out = "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return index.n, form, a_point, b_point - a_point, out


def restored(form: Column, output: Column) -> Column:
    """The text, from form and output alone."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    parts = lambda first: F.split(body, first, 2)
    psm, spm = parts(SUFFIX), parts(PREFIX)
    tail = lambda x: F.split(F.get(x, F.lit(1)), MIDDLE, 2)
    of = lambda x, i: F.get(x, F.lit(i))
    return F.when(form == "psm", F.concat(of(psm, 0), of(tail(psm), 1), of(tail(psm), 0))).when(form == "spm", F.concat(of(tail(spm), 0), of(tail(spm), 1), of(spm, 0))).otherwise(output)


def _rearrange(seed: str, unit: str, every: int, plain: int, spm: int):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), raw(batch.column("text"))
            rows = [rearranged(t or b"", f"{seed}:{'' if i is None else i}", unit, every, plain, spm) for i, t in zip(ids, texts)]
            cols = list(zip(*rows)) if rows else ([],) * 5
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array(cols[4], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays, batch.column("rest")], ["id", "n", "form", "prefix_chars", "middle_chars", "output", "rest"])

    return run


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", every: int = EVERY, seed: str = "1", plain: int = 10, spm: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rearrange every text: a row for each input row with the id (bigint), n (its units), form, prefix_chars, middle_chars
    (code points, null if plain), output, and as a struct named rest the columns that ``carry`` names.

    Form and cuts follow from ``seed`` and the id alone: SHA-256 of both gives four numbers; the prefix ends after the smaller of
    the first two modulo n + 1 units, the middle after the larger; ``plain`` percent of the texts stay as they are by the third, and
    by the fourth ``spm`` percent of the others have their suffix first.  Empty and null texts, and those with a mark in
    them, are plain too.  A null id counts as an empty one.  Rows of one id and text come out alike; an empty table gives an
    empty result; other columns are not read.  Nothing is shuffled.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    name = unlike("rest", df)
    docs = text_only(df.select("*", rest.alias(name)), id_col, text_col, name).withColumnRenamed(name, "rest")
    fields = [("id", T.LongType()), ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()), ("rest", docs.schema["rest"].dataType)]
    out = docs.mapInArrow(_rearrange(seed, unit, every, plain, spm), T.StructType([T.StructField(*f) for f in fields]))
    return (out if carry else out.drop("rest")).withColumnRenamed("id", id_col)


def with_middle_last(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, all columns in their order, with the rearranged texts."""
    out = fill_in_middle(df, id_col, text_col, carry=tuple(df.columns), **options)
    return out.select(*[F.col("output").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in df.columns])


def op13_query(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
