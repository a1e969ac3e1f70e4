import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.ddl import parse, parsed
from ledgerloom.operators import statements
from ledgerloom.plans import lint

#: rule: (texts with a hit, texts without)
CASES = {
    "require-concurrent-index": (["CREATE INDEX i ON t (a)"], ["CREATE INDEX CONCURRENTLY i ON t (a)", "CREATE TABLE t (a int); CREATE INDEX i ON t (a)"]),
    "require-if-not-exists": (["CREATE TABLE t (a int)", "DROP TABLE t", "CREATE INDEX i ON t (a)"], ["CREATE TABLE IF NOT EXISTS t (a int)", "DROP INDEX IF EXISTS i"]),
    "require-lock-timeout": (["ALTER TABLE t ADD COLUMN a int"], ["SET lock_timeout = '1s'; ALTER TABLE t ADD COLUMN a int", "CREATE INDEX CONCURRENTLY i ON t (a)"]),
    "ban-concurrent-index-in-transaction": (["BEGIN; CREATE INDEX CONCURRENTLY i ON t (a); COMMIT"], ["BEGIN; COMMIT; CREATE INDEX CONCURRENTLY i ON t (a)"]),
    "adding-not-nullable-field": (["ALTER TABLE t ADD COLUMN a int NOT NULL"], ["ALTER TABLE t ADD COLUMN a int NOT NULL DEFAULT 0", "ALTER TABLE t ADD a int"]),
    "constraint-missing-not-valid": (["ALTER TABLE t ADD CONSTRAINT c FOREIGN KEY (a) REFERENCES u (id)", "ALTER TABLE t ADD CHECK (a > 0)"], ["ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID"]),
    "require-analyze-after-index": (["ANALYZE t; CREATE INDEX i ON t (a)"], ["CREATE INDEX i ON t (a); ANALYZE t", "CREATE INDEX i ON t (a); VACUUM t"]),
    "require-create-or-replace-view": (["CREATE VIEW v AS SELECT a FROM t"], ["CREATE OR REPLACE VIEW v AS SELECT a FROM t"]),
    "ban-drop-cascade": (["DROP TABLE IF EXISTS t CASCADE"], ["DROP TABLE IF EXISTS t"]),
    "require-statement-timeout": (["DROP TABLE t"], ["SET statement_timeout = 1; DROP TABLE t"]),
    "require-reset-timeouts": (["SET lock_timeout = 1", "SET statement_timeout = 1; RESET lock_timeout"], ["SET lock_timeout = 1; RESET lock_timeout", "SET statement_timeout TO 5; RESET ALL"]),
    "ban-truncate": (["TRUNCATE TABLE t"], ["DELETE FROM t WHERE a = 1"]),
    "ban-update-without-where": (["UPDATE t SET a = 1"], ["UPDATE t SET a = 1 WHERE b = 2"]),
    "ban-delete-without-where": (["DELETE FROM t", "DELETE FROM t USING (SELECT 1 WHERE true) x"], ["DELETE FROM t WHERE a = 1"]),
    "ban-drop-column": (["ALTER TABLE t DROP COLUMN a"], ["ALTER TABLE t DROP CONSTRAINT a"]),
    "ban-alter-column-type": (["ALTER TABLE t ALTER COLUMN a TYPE bigint", "ALTER TABLE t ALTER a SET DATA TYPE text"], ["ALTER TABLE t ALTER COLUMN a SET DEFAULT 1"]),
    "require-drop-index-concurrently": (["DROP INDEX i"], ["DROP INDEX CONCURRENTLY i"]),
    "require-unique-via-concurrent-index": (["ALTER TABLE t ADD CONSTRAINT u UNIQUE (a)"], ["ALTER TABLE t ADD CONSTRAINT u UNIQUE USING INDEX i"]),
    "ban-validate-constraint-same-file": (["ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID; ALTER TABLE t VALIDATE CONSTRAINT c"], ["ALTER TABLE t VALIDATE CONSTRAINT c"]),
    "ban-bare-analyze": (["ANALYZE", "VACUUM"], ["ANALYZE t"]),
    "require-if-not-exists-materialized-view": (["CREATE MATERIALIZED VIEW v AS SELECT a FROM t"], ["CREATE MATERIALIZED VIEW IF NOT EXISTS v AS SELECT a FROM t"]),
    "ban-refresh-materialized-view-in-migration": (["REFRESH MATERIALIZED VIEW v"], ["SELECT 1"]),
    "ban-select-star-in-view": (["CREATE VIEW v AS SELECT * FROM t", "CREATE VIEW v AS SELECT t.* FROM t"], ["CREATE VIEW v AS SELECT a * b, count(*) FROM t", "CREATE VIEW v AS SELECT a FROM (SELECT * FROM t) x"]),
    "ban-rename-column": (["ALTER TABLE t RENAME COLUMN a TO b", "ALTER TABLE t RENAME a TO b"], ["ALTER TABLE t RENAME TO u"]),
    "ban-rename-table": (["ALTER TABLE t RENAME TO u"], ["ALTER TABLE t RENAME COLUMN a TO b"]),
    "ban-drop-table": (["DROP TABLE IF EXISTS a, b"], ["DROP VIEW a"]),
    "require-pk-via-concurrent-index": (["ALTER TABLE t ADD PRIMARY KEY (a)"], ["ALTER TABLE t ADD CONSTRAINT p PRIMARY KEY USING INDEX i"]),
    "ban-set-not-null": (["ALTER TABLE t ALTER COLUMN a SET NOT NULL"], ["ALTER TABLE t ALTER COLUMN a DROP NOT NULL"]),
    "ban-alter-enum-in-transaction": (["BEGIN; ALTER TYPE e ADD VALUE 'x'"], ["ALTER TYPE e ADD VALUE 'x'"]),
    "ban-vacuum-full": (["VACUUM FULL t", "VACUUM (FULL, VERBOSE) t"], ["VACUUM t"]),
    "ban-cluster": (["CLUSTER t USING i"], ["SELECT 1"]),
    "ban-reindex": (["REINDEX TABLE t"], ["SELECT 1"]),
    "ban-alter-system": (["ALTER SYSTEM SET x = 1"], ["SET x = 1"]),
    "ban-set-session-replication-role": (["SET session_replication_role = replica"], ["SET lock_timeout = 1"]),
}


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(f"{rule}/{hit}/{k}", sql) for rule, texts in CASES.items() for hit, some in zip("yn", texts) for k, sql in enumerate(some)]
    found: dict[str, set] = {}
    for r in lint.violations(spark.createDataFrame(rows, "file_name string, sql string")).collect():
        found.setdefault(r.file_name, set()).add(r.rule)
    return found


def test_all_rules_have_cases():
    assert set(CASES) == {r.id for r in lint.RULES} and len(CASES) == 34


@pytest.mark.parametrize("rule", CASES)
def test_rule(hits, rule):
    for k, sql in enumerate(CASES[rule][0]):
        assert rule in hits.get(f"{rule}/y/{k}", ()), sql
    for k, sql in enumerate(CASES[rule][1]):
        assert rule not in hits.get(f"{rule}/n/{k}", ()), sql


def test_directives_severity_and_errors(spark):
    files = spark.createDataFrame([("a", "-- loom:allow ban-truncate\nTRUNCATE t; DROP TABLE t CASCADE"), ("b", "TRUNCATE t; SELEC 1"), ("c", "TRUNCATE t"), ("d", "CREATE TABLE (")], "file_name string, sql string")
    rows = lint.violations(files, severity={"ban-drop-cascade": "warn", "ban-drop-table": "off"}).collect()
    found = {(r.file_name, r.rule): r.severity for r in rows}
    assert ("a", "ban-truncate") not in found and found["c", "ban-truncate"] == "error"
    assert found["a", "ban-drop-cascade"] == "warn" and ("a", "ban-drop-table") not in found
    assert {r.file_name for r in lint.parse_errors(files).collect()} == {"b", "d"} and not any(f in "bd" for f, _ in found)


def test_custom_rules(spark, tmp_path):
    (tmp_path / "own.py").write_text("from ledgerloom.plans.lint import Rule, kind, when\nRULES = [Rule('no-insert-table', 'why', lambda: when(kind('create-table'), 'made {relation}'))]\n")
    (tmp_path / "bad.py").write_text("1 / 0\n")
    with pytest.warns(UserWarning, match="bad.py"):
        rules = lint.custom_rules(tmp_path)
    rows = lint.violations(spark.createDataFrame([("a", "CREATE TABLE s.t (a int)")], "file_name string, sql string"), rules).collect()
    assert [(r.rule, r.message) for r in rows] == [("no-insert-table", "made s.t")]
    assert lint.custom_rules(tmp_path / "none") == []


def test_parse_dependencies():
    one = lambda sql: parse(sql)[0][0]
    assert one("CREATE TABLE public.b (id int REFERENCES a (id), FOREIGN KEY (x) REFERENCES s.c)")["refs"] == [{"type": "table", "name": "a"}, {"type": "table", "name": "s.c"}]
    assert {r["name"] for r in one("CREATE VIEW v AS WITH q AS (SELECT 1 FROM x) SELECT a FROM q, y JOIN z ON true WHERE b IN (SELECT c FROM w)")["refs"]} == {"q", "x", "y", "z", "w"}
    assert one("DROP TABLE a, b")["names"] == ["a", "b"]
    assert parse("CREATE FUNCTION f() RETURNS int AS $$ SELECT 1; $$ LANGUAGE sql; SELECT 2")[0][0]["creates"] == [{"type": "function", "name": "f"}]
    assert parse("SELECT (1")[1] and parse("FROB x")[1] and parse("")[0] == [] and parse(None) == ([], None)


@pytest.mark.parametrize("sql", ["ALTER TABLE t FROB", "INSERT INTO", "SELECT FROM WHERE", "SELECT a,", "SELECT a FROM t GROUP BY", "CREATE TABLE t (a)", "CREATE TABLE t (a int,)", "CREATE VIEW v AS", "DELETE t", "UPDATE t", "SET x", "DROP TABLE t NOW", "ALTER TABLE t", "SELECT a + FROM t", "CREATE INDEX i ON t", "CREATE FUNCTION f", "ALTER TABLE t ALTER a FROB", "ALTER TABLE t RENAME"])
def test_mistakes_give_no_statements(sql):
    assert parse(f"SELECT 1; {sql}; SELECT 2")[0] == [] and parse(sql)[1]


@pytest.mark.parametrize("sql", ["SELECT count(*), a.* FROM t a WHERE a <> -1", "INSERT INTO t DEFAULT VALUES", "INSERT INTO t VALUES (1) ON CONFLICT (a) DO UPDATE SET b = 2 RETURNING *", "ALTER TABLE t OWNER TO x", "ALTER TABLE t ENABLE ROW LEVEL SECURITY", "CREATE TABLE t ()", "CREATE TABLE t (LIKE u INCLUDING ALL)", "CREATE TABLE t PARTITION OF u FOR VALUES IN (1)", "CREATE TABLE t (a int REFERENCES u ON DELETE SET NULL, b numeric(10, 2) DEFAULT -1)", "GRANT SELECT ON t TO x", "CREATE INDEX i ON t USING gin (a) WHERE b IS NOT NULL", "SET TIME ZONE 'UTC'", "SELECT DISTINCT ON (a) a FROM t ORDER BY a LIMIT 1 OFFSET 2", "CREATE TRIGGER x BEFORE INSERT OR UPDATE ON t FOR EACH ROW EXECUTE FUNCTION f()", "DROP FUNCTION f(int) CASCADE", "DROP TRIGGER x ON t", "UPDATE t SET a = b FROM u WHERE t.id = u.id", "CREATE POLICY p ON t USING (a = 1)", "ALTER TABLE t ADD CONSTRAINT c EXCLUDE USING gist (a WITH &&)", "SET search_path TO a, b"])
def test_statements_that_are_right(sql):
    assert len(parse(sql)[0]) == 1


def test_custom_rules_see_all_tables_so_far(spark):
    own = lint.Rule("own", "why", lambda: lint.when(lint.kind("drop") & (F.size("created") == 2), "after two"))
    files = spark.createDataFrame([("a", "CREATE TABLE s.t (a int); CREATE TABLE u (a int); DROP TABLE t"), ("b", "CREATE TABLE t (a int); DROP TABLE t")], "file_name string, sql string")
    assert [(r.file_name, r.ord) for r in lint.violations(files, [own]).collect()] == [("a", 2)]


def test_totals(spark):
    rows = spark.createDataFrame([("a", "error"), ("a", "warn"), ("b", "error")], "file_name string, severity string")
    assert {r.file_name: (r.errors, r.warnings) for r in statements.severity_totals(rows, "file_name").collect()} == {"a": (1, 1), "b": (1, 0), None: (2, 1)}


def test_public_names():
    import ledgerloom

    assert ledgerloom.Rule is lint.Rule and all(getattr(ledgerloom, n) for n in ledgerloom.__all__)
    with pytest.raises(AttributeError):
        ledgerloom.nothing  # noqa: B018


def test_texts_of_one_partition_are_parsed_by_several_tasks(spark):
    files = spark.range(200).select(F.col("id").cast("string").alias("file_name"), F.lit("SELECT 1").alias("sql")).coalesce(1)
    rows = parsed(files).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 1 and sum(r["count"] for r in rows) == 200 and max(r["count"] for r in rows) <= 60


def test_a_rule_of_one_statement_needs_no_windows(spark, monkeypatch):
    """Nothing is written on the way, and no state is found that the rule doesn't ask for."""
    monkeypatch.setattr(lint, "settled", lambda df: pytest.fail("written"))
    files = spark.createDataFrame([("a", "DELETE FROM t"), ("b", "SELECT 1")], "file_name string, sql string")
    found = lint.violations(files, [r for r in lint.RULES if r.id == "ban-delete-without-where"])
    assert [(r.file_name, r.message) for r in found.collect()] == [("a", "DELETE of all of t")]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
