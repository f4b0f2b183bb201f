"""Canonical text of values, and digests of rows, as Spark expressions.

Two copies of a row agree exactly if their digests do, whatever types the two systems spell a value in: a
number has no trailing zeros or exponent, a boolean is 1 or 0, bytes are tagged hexadecimal (text of the form
\\xAB.. counts as bytes), an instant is tagged ISO text in UTC, an array is an array literal, and NULL is a
sentinel.  Each field is framed by its length in bytes, so that field borders can't shift.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: the NULL sentinel, the tags, the end of a length.
NULL_TEXT, BINARY_TAG, TIME_TAG, FRAME = "\x00\\N\x00", "\x00BIN\x00", "\x00TS\x00", "\x01"
_HEX_TEXT = r"^\\x([0-9A-Fa-f]{2})+$"


def plain_number(text: Column) -> Column:
    """Decimal text without trailing zeros after its point; minus zero is zero."""
    short = F.when(F.instr(text, ".") > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    return F.when(short == "-0", "0").otherwise(short)


def array_literal(c: Column, element: T.DataType) -> Column:
    """An array as text: {a,"b c",NULL}."""
    if isinstance(element, T.ArrayType):
        one = lambda x: F.coalesce(array_literal(x, element.elementType), F.lit("NULL"))
    else:
        def one(x):
            s = x.cast("int").cast("string") if isinstance(element, T.BooleanType) else x.cast("string")
            quoted = F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
            return F.when(s.isNull(), "NULL").when((s == "") | (F.upper(s) == "NULL") | s.rlike(r'[{},"\\\s]'), quoted).otherwise(s)

    return F.concat(F.lit("{"), F.array_join(F.transform(c, one), ","), F.lit("}"))


def _utc_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        c = F.to_utc_timestamp(c, F.current_timezone())
    s = c.cast("string")  # leaves out a fraction of zero, and a fraction's trailing zeros
    return F.when(F.instr(s, ".") > 0, F.concat(F.substring_index(s, ".", 1), F.lit("."), F.rpad(F.substring_index(s, ".", -1), 6, "0"))).otherwise(s)


def _hex_text(c: Column) -> Column:
    return F.startswith(c, F.lit("\\x")) & c.rlike(_HEX_TEXT)


def render(c: Column, kind: T.DataType, scale: int | None = None) -> Column:
    """Canonical text of a column; scale: fractional digits that doubles are rounded to, if set."""
    if isinstance(kind, T.BooleanType):
        out = c.cast("int").cast("string")
    elif isinstance(kind, T.DecimalType):
        out = plain_number(c.cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        if scale is None:
            exact = c.cast("string").try_cast("decimal(38,18)").cast("string")
        else:  # up to 18 digits are plain longs
            exact = F.coalesce(c.try_cast(f"decimal(18,{scale})").cast("string"), c.try_cast(f"decimal(38,{scale})").cast("string"))
        out = F.coalesce(plain_number(exact), c.cast("string"))
    elif isinstance(kind, T.BinaryType):
        text = c.cast("string")
        out = F.concat(F.lit(BINARY_TAG), F.when(_hex_text(text), F.lower(F.substring(text, 3, 1 << 30))).otherwise(F.lower(F.hex(c))))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.concat(F.lit(TIME_TAG), _utc_text(c, kind))
    elif isinstance(kind, T.ArrayType):
        out = array_literal(c, kind.elementType)
    elif isinstance(kind, T.StringType):
        out = F.when(_hex_text(c), F.concat(F.lit(BINARY_TAG), F.lower(F.substring(c, 3, 1 << 30)))).otherwise(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(NULL_TEXT))


def row_checksum(df: DataFrame, columns: Iterable[str] | None = None, scale: int | None = None) -> Column:
    """SHA-256, in hexadecimal, of the length-framed canonical text of a row's columns in order."""
    parts = []
    for name in columns or df.columns:
        text = render(F.col(f"`{name}`"), df.schema[name].dataType, scale)
        parts += [F.octet_length(text).cast("string"), F.lit(FRAME), text]
    return F.sha2(F.concat(*parts), 256)


# ---- COPY text ------------------------------------------------------------------------------

#: Fixed values of the format, in the order they are escaped.
COPY_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"))
COPY_NULL = "\\N"


def copy_field(c: Column, kind: T.DataType, null: str = COPY_NULL) -> Column:
    """A field of COPY text; text with a NUL character raises, since the format can't hold it."""
    if isinstance(kind, T.BinaryType):
        return F.coalesce(F.concat(F.lit("\\\\x"), F.lower(F.hex(c))), F.lit(null))
    s = c.cast("string")
    if isinstance(kind, T.StringType):
        s = F.when(F.instr(s, "\x00") > 0, F.raise_error(F.lit("COPY text can't hold a NUL character"))).otherwise(s)
    for plain, escaped in COPY_ESCAPES:
        s = F.replace(s, F.lit(plain), F.lit(escaped))
    return F.coalesce(s, F.lit(null))


def copy_row(df: DataFrame, delimiter: str = "\t") -> Column:
    return F.concat_ws(delimiter, *[copy_field(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])


def copy_decode(line: Column, width: int, delimiter: str = "\t", null: str = COPY_NULL) -> Column:
    """The fields of a line of COPY text, as an array of strings."""
    unescape = lambda s: F.replace(F.replace(F.replace(F.replace(F.replace(s, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r")), F.lit("\x00"), F.lit("\\"))
    parts = F.split(F.rtrim(line, F.lit("\n")), f"\\Q{delimiter}\\E", -1)
    return F.slice(F.transform(parts, lambda s: F.when(s == null, None).otherwise(unescape(s))), 1, width)


# ---- positions, JSON, cost --------------------------------------------------------------------

def lsn(text: Column) -> Column:
    """'hi/lo' in hexadecimal as one comparable number, decimal(20,0); null if malformed."""
    half = lambda i: F.conv(F.split(text, "/")[i], 16, 10).cast("decimal(20,0)")
    return F.when(text.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), (half(0) * F.lit(1 << 32).cast("decimal(20,0)") + half(1)).cast("decimal(20,0)"))


def binlog_position(file: Column, position: Column) -> Column:
    """A log file's index and an offset in it as one comparable number; null without an index."""
    index = F.regexp_extract(file, r"\.(\d+)$", 1)
    return F.when(index != "", index.cast("decimal(20,0)") * F.lit(1 << 48).cast("decimal(20,0)") + position.cast("decimal(20,0)")).cast("decimal(20,0)")


#: Constructs of a routine's body and their weights.
ROUTINE_WEIGHTS = (
    (r"\bcursor\b", 2),
    (r"\bexception\b", 2),
    (r"\bdbms_", 3),
    (r"\bconnect\s+by\b", 5),
    (r"\bbulk\s+collect\b", 4),
    (r"\bforall\b", 4),
    (r"\bpragma\s+autonomous_transaction\b", 5),
    (r"\bexecute\s+immediate\b", 3),
)


def routine_cost(body: Column) -> Column:
    """Weighted count of the constructs in a routine's body."""
    text = F.lower(F.coalesce(body, F.lit("")))
    total = F.lit(0)
    for pattern, weight in ROUTINE_WEIGHTS:
        total = total + weight * F.regexp_count(text, F.lit(pattern))
    return total


def person_days(units: Column, factor: float = 0.05) -> Column:
    return F.round(units * factor, 2)


def canonical_json(text: Column, keys: Iterable[str]) -> Column:
    """A flat JSON object's given keys as compact text, sorted; values keep their JSON spelling."""
    parts = [F.when(F.get_json_object(text, f"$.{k}").isNotNull(), F.concat(F.lit(f'"{k}":'), F.to_json(F.variant_get(F.parse_json(text), f"$.{k}", "variant")))) for k in sorted(keys)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
