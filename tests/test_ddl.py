import re

from ferryline.functions.render import ROUTINE_WEIGHTS
from ferryline.functions.types import Kind, TypeRegistry
from ferryline.plans import assess, ddl
from ferryline.plans.model import Check, Column, ForeignKey, Index, Routine, Schema, Sequence, Table, Trigger, View

EMP = Table(
    "EMPLOYEES",
    (Column("EMP_ID", Kind("decimal", 10, 0), False, "HR.EMP_SEQ.NEXTVAL", "NUMBER(10)"), Column("ACTIVE", Kind("boolean"), True, "1"), Column("HIRED", Kind("timestamp"), True, "SYSDATE", "DATE"), Column("NOTE", Kind("varchar", length=50), source_type="VARCHAR2(50)")),
    "HR", ("EMP_ID",), (ForeignKey(None, ("DEPT_ID",), "DEPARTMENTS", ("DEPT_ID",)),), (Index("PK", ("EMP_ID",), True), Index("I", ("NOTE",))), (Check("EMP_ID > 0", "CK"),), ("LIST", ("NOTE",)),
)
SCHEMA = Schema("HR", [EMP], [View("V2", "SELECT * FROM V1 WHERE active = 1"), View("V1", "SELECT NVL(note, 'x') n, active FROM employees"), View("M", "SELECT 1", True)], [Sequence("EMP_SEQ", 100, 1, 1, 10**28, 20)], [Routine("P", "procedure", "CURSOR c; EXCEPTION EXECUTE IMMEDIATE 'x'")], [Trigger("T", "EMPLOYEES", "BEFORE", ("INSERT",), "x")])


def test_postgres_table():
    assert ddl.create_table(EMP) == """CREATE TABLE employees (
    emp_id DECIMAL(10, 0) NOT NULL DEFAULT nextval('emp_seq'),
    active BOOLEAN DEFAULT true,
    hired TIMESTAMP DEFAULT CURRENT_TIMESTAMP,
    note VARCHAR(50),
    PRIMARY KEY (emp_id),
    CONSTRAINT ck CHECK (EMP_ID > 0)
);"""


def test_other_dialects():
    mysql = ddl.create_table(EMP, dialect="mysql")
    assert "`active` TINYINT(1) DEFAULT 1" in mysql and "`emp_id` DECIMAL(10, 0) NOT NULL," in mysql and "`hired` DATETIME DEFAULT CURRENT_TIMESTAMP" in mysql
    oracle = ddl.create_table(EMP, dialect="oracle")
    assert '"EMP_ID" NUMBER(10) NOT NULL DEFAULT HR.EMP_SEQ.NEXTVAL' in oracle and '"NOTE" VARCHAR2(50)' in oracle
    assert ddl.create_table(EMP, dialect="spark").endswith("USING parquet PARTITIONED BY (`note`)")
    assert ddl.create_sequence(SCHEMA.sequences[0]) == "CREATE SEQUENCE emp_seq START WITH 100 INCREMENT BY 1 MINVALUE 1 CACHE 20;"
    assert ddl.drop_foreign_keys(EMP) == ["ALTER TABLE employees DROP CONSTRAINT IF EXISTS employees_fk;"]
    assert ddl.drop_foreign_keys(EMP, dialect="mysql") == ["ALTER TABLE `employees` DROP FOREIGN KEY `employees_fk`"]


def test_indexes_and_keys():
    assert ddl.create_index(EMP, EMP.indexes[0]) is None
    assert ddl.create_index(EMP, EMP.indexes[1]) == "CREATE INDEX i ON employees (note);"
    assert ddl.foreign_keys(EMP) == ["ALTER TABLE employees ADD CONSTRAINT employees_fk FOREIGN KEY (dept_id) REFERENCES departments (dept_id);"]


def test_export_order_and_overrides():
    text, gaps = ddl.export(SCHEMA, TypeRegistry("oracle", {"DATE": "DATE"}))
    places = [text.index(x) for x in ("CREATE TABLE", "CREATE SEQUENCE", "CREATE INDEX", "CREATE VIEW v1", "CREATE VIEW v2", "ADD CONSTRAINT")]
    assert places == sorted(places) and "hired DATE" in text and "active = true" in text and "COALESCE(note, 'x')" in text
    assert [g.feature for g in gaps] == ["oracle-function:nvl"]


def test_spark_accepts_the_tables(spark):
    sql = ddl.create_table(EMP, dialect="spark").replace(" DEFAULT true", "").replace(" DEFAULT CURRENT_TIMESTAMP", "")
    spark.sql("DROP TABLE IF EXISTS employees")
    spark.sql(sql)
    assert spark.table("employees").columns == ["emp_id", "active", "hired", "note"]
    spark.sql("DROP TABLE employees")
    assert EMP.struct()["EMP_ID"].metadata["source_type"] == "NUMBER(10)"


def test_assessment():
    r = assess.assess(SCHEMA)
    assert r.inventory["views"] == 2 and r.inventory["materialized_views"] == 1 and r.days == 0.55 and r.routine_units == 7
    assert [g.feature for g in r.gaps] == ["PL/SQL procedure", "trigger", "materialized view", "partitioned table"]
    assert "PROCEDURE: P" in assess.review_file(SCHEMA) and assess.review_file(Schema("x")) == ""
    assert '"days": 0.55' in r.json() and "<td>views</td><td>2</td>" in r.html() and "views: 2" in r.text()


def test_a_routine_is_scored_in_one_pass(monkeypatch):
    body = "x CURSOR cursor_ cursors dbms_cursor DBMS_x dbms_dbms_ Connect\n by connect by_ bulk  collect bulk collects FORALL forall exception pragma exception pragma autonomous_transaction execute immediate execute cur\u017for" * 2
    want = sum(weight * len(re.findall(pattern, body, re.I)) for pattern, weight in ROUTINE_WEIGHTS)
    monkeypatch.delattr(assess.re, "findall")
    assert assess.score_routine(body) == want > 60 and assess.score_routine("") == assess.score_routine(None) == 0
