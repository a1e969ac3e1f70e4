import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import queries
from ledgerloom.functions import sqltext

CASES = [
    ("a -- x\nb", "a b"), ("a /* x /* y */ z */ b", "a b"), ("  a \n\t b  ", "a b"), ("'a  -- b'", "'a  -- b'"), ("'it''s  x'", "'it''s  x'"),
    ('"a  b"', '"a  b"'), (r"E'a\'  b' c", r"E'a\'  b' c"), ("$$ a  -- b $$", "$$ a  -- b $$"), ("$x$ a $$  b $x$  c", "$x$ a $$  b $x$ c"),
    ("-- only", ""), ("/* open", ""), ("'open  ", "'open"), ("a /**/ /* */ b", "a b"), ("a b", "a b"), ("", ""), ("SELECT ( 1 )", "SELECT ( 1 )"),
]


@pytest.mark.parametrize(("sql", "wanted"), CASES)
def test_normalize(sql, wanted):
    assert sqltext.normalize(sql) == wanted


@given(st.text(alphabet="ab '\"-/*$\n\\E", max_size=40))
def test_normalize_twice_changes_nothing(sql):
    once = sqltext.normalize(sql)
    assert sqltext.normalize(once) == once or any(c in sql for c in "'\"$-/")


def test_column_agrees_with_function(spark):
    rows = spark.createDataFrame([(sql,) for sql, _ in CASES] + [(None,)], "sql string").select("sql", sqltext.normalized(F.col("sql")).alias("n"))
    assert {r.sql: r.n for r in rows.collect()} == {**dict(CASES), None: None}


def test_directives(spark):
    text = "-- loom:allow a, b c\nSELECT 1;\n  -- loom:allow d\n-- loom:allow b\n-- loom:depends-on x.sql\n-- loom:depends-on y.sql z"
    r = spark.createDataFrame([(text,)], "sql string").select(sqltext.allowed_rules(F.col("sql")).alias("a"), sqltext.declared_dependencies(F.col("sql")).alias("d")).first()
    assert (r.a, r.d) == (["a", "b", "c"], ["x.sql", "y.sql"])


def test_checksums_of_all_documents(spark, tmp_path):
    rows = list(enumerate([*(sql for sql, _ in CASES), '"a  b" ', "$$ a  -- b $$\n", "$x$ a $$  b $x$ c", '"a b"', None]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {k: None if t is None else hashlib.sha256(sqltext.normalize(t).encode()).hexdigest() for k, t in rows}
    assert {r.doc_id: r.checksum for r in queries.QUERIES["text_checksum"](spark, str(tmp_path)).collect()} == wanted
    of = {}
    for k, c in wanted.items():
        of.setdefault(c, []).append(k)
    found = {(r.checksum, r.n_files, r.first_file) for r in queries.QUERIES["duplicate_checksums"](spark, str(tmp_path)).collect()}
    assert found == {(c, len(k), min(k)) for c, k in of.items() if c and len(k) > 1}


def test_kinds_of_tokens():
    found = list(sqltext.tokens("a;b /* x /* y */ z */ E'\\'' -- end\n$t$ ; $t$"))
    assert [k for k, _ in found] == ["other", "other", "other", "space", "comment", "space", "quoted", "space", "comment", "space", "quoted"]
    assert "".join(t for _, t in found) == "a;b /* x /* y */ z */ E'\\'' -- end\n$t$ ; $t$"
