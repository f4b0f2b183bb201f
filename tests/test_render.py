import hashlib
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.functions import render as R


def text(spark, value, kind):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    return df.select(R.render(F.col("v"), kind)).first()[0]


@pytest.mark.parametrize(("value", "kind", "out"), [
    (None, T.StringType(), "\0\\N\0"), ("", T.StringType(), ""), (True, T.BooleanType(), "1"), (Decimal("125000.50"), T.DecimalType(10, 2), "125000.5"),
    (Decimal("0"), T.DecimalType(38, 18), "0"), (Decimal("100"), T.DecimalType(10, 0), "100"), (-0.0, T.DoubleType(), "0"), (1e10, T.DoubleType(), "10000000000"), (0.1, T.DoubleType(), "0.1"),
    (bytearray(b"\x00\xff"), T.BinaryType(), "\0BIN\x0000ff"), (bytearray(b"\\xAB"), T.BinaryType(), "\0BIN\0ab"), ("\\xABcd", T.StringType(), "\0BIN\0abcd"), ("\\xAB1", T.StringType(), "\\xAB1"),
    (datetime(2024, 1, 2, 3, 4, 5), T.TimestampNTZType(), "\0TS\x002024-01-02 03:04:05"), (datetime(2024, 1, 2, 3, 4, 5, 500000), T.TimestampNTZType(), "\0TS\x002024-01-02 03:04:05.500000"),
    (["a", "b c", None, "", "null", 'q"\\'], T.ArrayType(T.StringType()), '{a,"b c",NULL,"","null","q\\"\\\\"}'), ([[1], [2, None]], T.ArrayType(T.ArrayType(T.IntegerType())), "{{1},{2,NULL}}"),
])
def test_canonical_text(spark, value, kind, out):
    assert text(spark, value, kind) == out


def test_framing_tells_shifted_fields_apart(spark):
    df = spark.createDataFrame([("a", "b\x01c"), ("a\x01b", "c"), ("é", "")], "x string, y string")
    got = [r[0] for r in df.select(R.row_checksum(df)).collect()]
    assert got[0] != got[1]
    assert got[2] == hashlib.sha256(b"2\x01" + "é".encode() + b"0\x01").hexdigest()


def test_copy_text(spark):
    df = spark.createDataFrame([(1, "a\tb\\n\n\r", None, bytearray(b"\x01\xff"))], "i int, s string, n string, b binary")
    line = df.select(R.copy_row(df)).first()[0]
    assert line == "1\ta\\tb\\\\n\\n\\r\t\\N\t\\\\x01ff"
    back = spark.createDataFrame([(line,)], "line string").select(R.copy_decode(F.col("line"), 4)).first()[0]
    assert back == ["1", "a\tb\\n\n\r", None, "\\x01ff"]
    with pytest.raises(Exception, match="NUL"):
        spark.createDataFrame([("a\0",)], "s string").select(R.copy_field(F.col("s"), T.StringType())).collect()


def test_positions(spark):
    df = spark.createDataFrame([("0/16B3748", "bin.000003", 4), ("FFFFFFFF/FFFFFFFF", "x", 1), ("bad", None, 1)], "l string, f string, p bigint")
    got = df.select(R.lsn(F.col("l")), R.binlog_position(F.col("f"), F.col("p"))).collect()
    assert [r[0] for r in got] == [0x16B3748, 2**64 - 1, None] and [r[1] for r in got] == [3 * 2**48 + 4, None, None]


def test_person_days(spark):
    assert spark.range(1).select(R.person_days(F.lit(7))).first()[0] == 0.35
