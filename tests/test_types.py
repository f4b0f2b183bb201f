import pytest
from pyspark.sql import types as T

from ferryline.functions.idents import effective_case, ident, qualified, quoted, unique_names
from ferryline.functions.types import Kind, TypeRegistry, parse_type


@pytest.mark.parametrize(("dialect", "spelt", "sql"), [
    ("oracle", "NUMBER", "NUMERIC"), ("oracle", "NUMBER(10,2)", "DECIMAL(10, 2)"), ("oracle", "NUMBER(5)", "DECIMAL(5, 0)"), ("oracle", "DATE", "TIMESTAMP"),
    ("oracle", "VARCHAR2(50)", "VARCHAR(50)"), ("oracle", "TIMESTAMP(6) WITH LOCAL TIME ZONE", "TIMESTAMP WITH TIME ZONE"), ("oracle", "TIMESTAMP(6)", "TIMESTAMP"),
    ("oracle", "RAW(16)", "BYTEA"), ("oracle", "INTERVAL DAY(2) TO SECOND(6)", "INTERVAL"), ("oracle", "SDO_GEOMETRY", "SDO_GEOMETRY"),
    ("mysql", "tinyint(1)", "BOOLEAN"), ("mysql", "tinyint", "SMALLINT"), ("mysql", "decimal(10,2)", "NUMERIC(10, 2)"), ("mysql", "enum('a','b')", "TEXT"), ("mysql", "json", "JSONB"),
    ("mysql", "int(11)", "INTEGER"), ("mysql", "datetime(6)", "TIMESTAMP"), ("mysql", "bigint unsigned", "NUMERIC(20, 0)"),
    ("mssql", "nvarchar(max)", "TEXT"), ("mssql", "money", "DECIMAL(19, 4)"), ("mssql", "datetimeoffset", "TIMESTAMP WITH TIME ZONE"), ("mssql", "varbinary(max)", "BYTEA"), ("mssql", "bit", "BOOLEAN"),
    ("postgres", "numeric", "NUMERIC"), ("postgres", "timestamp without time zone", "TIMESTAMP"), ("postgres", "timestamp with time zone", "TIMESTAMP WITH TIME ZONE"),
    ("postgres", "character varying(20)", "VARCHAR(20)"), ("postgres", "USER-DEFINED", "TEXT"), ("postgres", "int4", "INTEGER"),
])
def test_dialect_types(dialect, spelt, sql):
    assert parse_type(spelt, dialect).sql() == sql


def test_strict_keeps_what_the_rules_do_not_spell():
    assert parse_type("INT(11)", "mysql", strict=True).kind == "custom"


def test_unconstrained_numbers_keep_their_fraction():
    kind = parse_type("NUMBER", "oracle")
    assert kind.spark() == T.DecimalType(38, 18) and kind.sql("mysql") == "DECIMAL(65, 30)"
    assert Kind("numeric", 50, 2).spark() == T.StringType()


def test_mysql_spelling():
    assert [Kind(k).sql("mysql") for k in ("text", "bytea", "timestamp", "timestamptz", "boolean", "uuid", "interval")] == ["LONGTEXT", "LONGBLOB", "DATETIME", "TIMESTAMP", "TINYINT(1)", "CHAR(36)", "VARCHAR(64)"]
    assert Kind("varchar", length=20000).sql("mysql") == "LONGTEXT"


def test_overrides():
    r = TypeRegistry("oracle", {"number": "BIGINT", "DATE": "DATE"}, {"emp.id": "UUID", "hr.emp.nm": "TEXT"})
    assert (r.resolve("NUMBER(10)").kind.kind, r.resolve("NUMBER(10)").provenance) == ("bigint", "data_type_override")
    assert r.resolve("NUMBER", "EMP", "ID", "HR").kind.kind == "uuid"
    assert r.resolve("CLOB", "EMP", "NM", "HR").provenance == "modify_type_override"
    assert r.resolve("CLOB").provenance == "default"


def test_identifiers():
    assert [quoted(x) for x in ("plain_1", "order", "Mixed", 'a"b')] == ["plain_1", '"order"', '"Mixed"', '"a""b"']
    assert ident("EMP") == "emp" and ident("EMP", True) == '"EMP"' and ident("EMP", dialect="oracle") == '"EMP"' and ident("A`b", dialect="mysql") == "`a``b`"
    assert qualified("HR.ORDER") == 'hr."order"'
    assert unique_names([("a", "i"), ("b", "i"), ("b", "i"), ("c", "j")]) == ["i", "b_i", "b_i_2", "j"]
    assert effective_case(False, "oracle") and not effective_case(False, "postgres")


def test_a_name_is_looked_up_once():
    assert parse_type("NUMBER(12, 3)", "oracle") is parse_type("NUMBER(12, 3)", "oracle") == Kind("decimal", 12, 3)
    assert parse_type("INT(11)", "mysql", strict=True).kind == "custom" and parse_type("INT(11)", "mysql").kind == "integer" and parse_type("DATE", "oracle") != parse_type("DATE", "mysql")
