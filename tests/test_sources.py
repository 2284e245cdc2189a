"""Readers on odd small files."""

import pytest

from sievemill.operators import graph
from sievemill.sources import files


def test_sheet(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿# made by hand\n\nID,External\nA1,yes\nb2\n a1 ,no\n,yes\n", encoding="utf-8")
    rows = {r["id"]: r["external"] for r in files.sheet(spark, str(p)).collect()}
    assert rows == {"a1": "no", "b2": None}
    p.write_text("name,x\n1,2\n")
    with pytest.raises(ValueError, match="no column id"):
        files.sheet(spark, str(p))


def test_errors(spark, tmp_path):
    p = str(tmp_path / "log")
    files.append_errors(spark.createDataFrame([("a", "x"), ("b", "y")], "stage string, error string"), p)
    files.append_errors(spark.createDataFrame([("a", "z")], "stage string, error string"), p)
    (tmp_path / "log" / "part-x.json").write_text('{"stage": "a"\nnot json\n{"stage": "c"}\n{}\n')
    assert {r["stage"]: r["n"] for r in files.error_counts(spark, p).collect()} == {"a": 2, "b": 1, "c": 1}


@pytest.mark.parametrize("text, want", [('[{"id": "x"}, {"no": 1}]', ["x"]), (' {"cves": [{"id": "y"}, {"id": "z"}]}', ["y", "z"]), ("{bad", []), ("", [])])
def test_feed(spark, tmp_path, text, want):
    (tmp_path / "f.json").write_text(text)
    assert sorted(r["id"] for r in files.feed(spark, str(tmp_path / "f.json"), "struct<id:string>").collect()) == want


def test_changed_paths(spark):
    diff = "diff --git a/x.c b/y.c\n--- a/x.c\n+++ b/y.c\n@@ -1 +1 @@\n-a\n+b\n--- /dev/null\n+++ b/new.c\n"
    rows = files.changed_paths(spark.createDataFrame([(1, diff), (2, None), (3, "")], "k int, diff string"), "k").collect()
    assert sorted((r["k"], r["path"]) for r in rows) == [(1, "new.c"), (1, "x.c"), (1, "y.c")]


def test_roots(spark):
    rows = graph.roots(spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 8), (4, 7)], "node long, canonical long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {1: 1, 2: 1, 3: 1, 9: 8, 4: 4}
