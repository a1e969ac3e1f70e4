import json
from datetime import datetime

import pytest

from ledgerloom import cli
from ledgerloom.functions.sqltext import normalize
from ledgerloom.operators import ledger as operators
from ledgerloom.plans.project import Project

A, B, C = "20260101_000000__users.sql", "20260102_000000__posts.sql", "20260103_000000__follows.sql"


@pytest.fixture
def project(spark, tmp_path):
    name = f"db_{abs(hash(str(tmp_path)))}"
    spark.sql(f"CREATE DATABASE {name}")
    (tmp_path / "migrations").mkdir()
    (tmp_path / "loom.json").write_text(json.dumps({"severity": {"ban-truncate": "off"}}))
    yield Project(spark, tmp_path, name)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def put(project, name, sql):
    (project.config.path("migrations") / name).write_text(sql)


def table(name):
    return f"CREATE TABLE IF NOT EXISTS {name} (id BIGINT) USING parquet;"


def record(project, *names, model=None):
    from hashlib import sha256

    rows = [{"file": n, "checksum": sha256(normalize((project.config.path("migrations") / n).read_text()).encode()).hexdigest()} for n in names]
    project.config.path("manifest.json").write_text(json.dumps({"migrations": rows} | ({"model": model} if model else {})))


def statuses(project):
    return {r.file_name: r.status for r in project.status().collect()}


def test_life_of_a_linear_project(project):
    put(project, A, table("users"))
    put(project, B, table("posts"))
    put(project, "notes.sql", "not a script's name")
    assert project.apply().applied == [A, B]
    assert project.apply().skipped == [A, B]
    put(project, B, table("posts") + " -- a comment changes nothing")
    assert project.apply().skipped == [A, B]
    put(project, B, table("posts") + table("more"))
    assert statuses(project) == {A: "applied", B: "changed"} and project.apply().applied == [B]
    put(project, B, table("posts"))
    assert "ancestor-revert" in project.apply().errors[0]
    put(project, B, table("posts") + table("more"))
    put(project, A, table("users") + table("other"))
    done = project.apply()
    assert "tampering" in done.errors[0] and done.failed == A and not done.applied
    assert [r.n for r in operators.history(project.ledger.rows()).selectExpr("size(records) n", "file_name").orderBy("file_name").collect()] == [1, 2]


def test_failure_and_resolve(project):
    put(project, A, "CREATE NONSENSE;")
    put(project, B, table("posts"))
    assert project.apply().failed == A and statuses(project) == {A: "failed", B: "pending"}
    assert "unresolved" in project.apply().errors[0]
    assert {r.file_name: r.reason for r in project.editable().collect()}[A] in ("new", "failed-retryable")
    project.resolve(A)
    with pytest.raises(ValueError):
        project.resolve(A)
    assert project.apply().applied == [B] and statuses(project) == {A: "skipped", B: "applied"}


def test_check(project):
    for n in (A, B):
        put(project, n, table("t"))
    record(project, A)
    kinds = lambda: {(r.kind, r.file_name) for r in project.check().collect()}
    assert kinds() == set()
    put(project, C, table("u"))
    assert kinds() == {("several-new", B), ("several-new", C)}
    record(project, A, C)
    assert kinds() == {("mid-sequence", B)}
    record(project, A, B, C)
    put(project, A, table("changed"))
    assert kinds() == {("mismatch", A)}
    put(project, A, table("t"))
    (project.config.path("migrations") / B).unlink()
    assert kinds() == {("missing", B)}


def test_graph_project(project):
    put(project, A, "CREATE TABLE users (id BIGINT);")
    put(project, B, "CREATE TABLE posts (id BIGINT REFERENCES users);")
    put(project, C, f"-- loom:depends-on {A}\nCREATE TABLE follows (id BIGINT);")
    record(project, A, B, C, model="dag")
    tree = project.dependencies()
    assert sorted((r.src, r.dst, r.via) for r in tree.edges.collect()) == [(B, A, "users"), (C, A, "explicit")]
    assert tree.order() == [A, B, C] and tree.cycles().isEmpty() and tree.tree()[0] == A
    assert {r.node for r in tree.dependents(A).collect()} == {B, C} and "<pre>" in tree.html()
    assert {r.file_name for r in project.lasts().collect()} == {B, C}
    put(project, B, "CREATE NONSENSE; CREATE TABLE posts (id BIGINT REFERENCES users);")
    done = project.apply()
    assert done.blocked == [] and C in done.applied


def test_squash_new_dump_diff_verify(project, capsys):
    put(project, A, table("users"))
    put(project, B, table("posts"))
    made = project.squash()
    assert [p.name for p in made] == ["20260102_000000__users_and_posts.sql"] and f"-- Source: {A}" in made[0].read_text()
    assert list(project.manifest().entries) == [made[0].name] and project.check().isEmpty()
    assert {r.file_name: r.passed for r in project.verify().collect()} == {made[0].name: True}
    put(project, C, "CREATE TABLE once (id BIGINT) USING parquet;")
    assert [r.second_error is not None for r in project.verify().where("not passed").collect()] == [True]
    assert project.apply().applied == [made[0].name, C]
    project.dump()
    assert project.diff().isEmpty()
    project.spark.sql(f"CREATE TABLE {project.database}.drift (id INT) USING parquet")
    assert not project.diff().isEmpty() and project.apply(drift_check=True).errors
    assert project.new("more", datetime(2027, 1, 2, 3, 4, 5)).name == "20270102_030405__more.sql"
    with pytest.raises(ValueError):
        project.new("a b")
    root = ["--root", str(project.config.root), "--database", project.database]
    assert cli.main([*root, "status"], project.spark) == 0 and cli.main([*root, "diff"], project.spark) == 1
    assert "applied" in capsys.readouterr().out


def test_lock_and_bad_manifest(project):
    with project.ledger.lock(), pytest.raises(TimeoutError), project.ledger.lock(wait_s=0.1):
        pass
    project.config.path("manifest.json").write_text('{"migrations": [{"file": 1}]}')
    with pytest.raises(ValueError):
        project.manifest()
    with pytest.raises(ValueError):
        project.ledger.append("x", "y", "odd")
    assert project.files().count() == 0


def test_latest_takes_the_later_id_of_a_tie(spark):
    rows = spark.createDataFrame([("a", "x", "failed", datetime(2026, 1, 1), 1), ("a", "y", "applied", datetime(2026, 1, 1), 2)], "file_name string, checksum string, status string, applied_at timestamp, id long")
    assert operators.latest(rows).first().checksum == "y"


def test_stream_of_the_ledger(spark, project):
    from ledgerloom.streaming import ledger_tail

    project.ledger.append("a", "x", "failed")
    project.ledger.append("a", "y", "applied")
    q = ledger_tail.latest(ledger_tail.tail(spark, project.ledger.path)).writeStream.outputMode("complete").format("memory").queryName("tail").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.file_name, r.status) for r in spark.table("tail").collect()] == [("a", "applied")]


def test_dump_follows_a_drift_checked_apply(project):
    put(project, A, table("users"))
    project.dump()
    assert project.apply(drift_check=True).applied == [A] and project.diff().isEmpty()
    put(project, B, "CREATE NONSENSE;")
    assert project.apply(drift_check=True).failed == B and project.diff().isEmpty()
    put(project, B, table("posts"))
    before = project.config.path("schema.sql").read_text()
    assert project.apply().applied == [B] and project.config.path("schema.sql").read_text() == before and not project.diff().isEmpty()


def test_cycles_are_reported(project, capsys):
    put(project, A, f"-- loom:depends-on {B}\nCREATE TABLE a (id BIGINT);")
    put(project, B, f"-- loom:depends-on {A}\nCREATE TABLE b (id BIGINT);")
    put(project, C, f"-- loom:depends-on {B}\nCREATE TABLE c (id BIGINT);")
    record(project, A, B, C, model="dag")
    tree = project.dependencies()
    assert tree.cycle_paths() == [[A, B, A]] and {r.node for r in tree.cycles().collect()} == {A, B}
    assert {r.node: r.depth for r in tree.depths().collect()} == {A: 0, B: 0, C: 1} and "<svg" in tree.html()
    assert {r.node for r in tree.dependents(A).collect()} == {B, C}
    root = ["--root", str(project.config.root), "--database", project.database]
    assert cli.main([*root, "deps"], project.spark) == 1
    said = capsys.readouterr().out
    assert f"cycle: {A} -> {B} -> {A}" in said and "3 files, 3 dependencies, 1 leaves" in said


def test_blocked_files_of_a_graph(project):
    put(project, A, "CREATE NONSENSE;")
    put(project, B, f"-- loom:depends-on {A}\n" + table("posts"))
    put(project, C, f"-- loom:depends-on {B}\n" + table("follows"))
    record(project, A, B, C, model="dag")
    done = project.apply()
    assert done.failed == A and done.blocked == [B, C] and not done.applied


def test_squash_keeps_sources_until_all_is_written(project, monkeypatch):
    name = "20260101_000000__a b+c%20d.sql"
    put(project, name, table("users"))
    put(project, B, table("posts"))

    def fails(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr("ledgerloom.plans.project.manifest_file.save", fails)
        with pytest.raises(OSError, match="no space"):
            project.squash()
    folder = project.config.path("migrations")
    assert (folder / name).exists() and (folder / B).exists()
    for p in folder.glob("*_and_*"):
        p.unlink()
    made = project.squash()
    assert sorted(p.name for p in folder.glob("*.sql")) == [made[0].name] and "a b+c%20d" in made[0].name


def test_lock_of_a_run_that_ended(project):
    import socket
    import subprocess

    ended = subprocess.Popen(["true"])
    ended.wait()
    path = project.config.path("ledger.lock")
    path.write_text(f"{socket.gethostname()} {ended.pid} 2026-01-01")
    with project.ledger.lock(wait_s=1):
        assert path.exists()
    assert not path.exists()
    path.write_text("elsewhere 1 2026-01-01")
    with pytest.raises(TimeoutError, match="elsewhere"), project.ledger.lock(wait_s=0.1):
        pass


def test_status_and_lint_say_how_many(project, capsys):
    put(project, A, "UPDATE users SET a = 1;")
    root = ["--root", str(project.config.root), "--database", project.database]
    assert cli.main([*root, "lint"], project.spark) == 1 and cli.main([*root, "status"], project.spark) == 0
    assert cli.main([*root, "verify"], project.spark) == 1
    said = capsys.readouterr().out
    assert "1 errors, 0 warnings" in said and "1 pending" in said and "0 passed, 1 failed" in said and "pending      | " in said
