import hashlib

from sievemill.operators import reports, wholes


def test_digests_join_parts_in_order_and_cut_one_line_end(spark):
    rows = [("a", 2, 0, "z\n\n"), ("a", 1, 5, "ü"), ("a", 1, 4, "x\n"), ("a", 0, 9, "head "), ("a", 1, 6, None), ("b", 0, 0, "\n"), ("c", 0, 0, ""), ("d", 1, 0, "q\n"), ("d", 2, 0, "")]
    parts = spark.createDataFrame(rows, "k string, step int, place long, part string")
    sha = lambda t: (len(t), hashlib.sha256(t.encode()).hexdigest())
    got = {r.k: (r.size, r.digest) for r in wholes.digests(parts, "k", {1: ","}).collect()}
    assert got == {"a": sha("head x\n,üz\n\n"), "b": sha("\n"), "c": sha(""), "d": sha("q\n")}
    got = {r.k: (r.size, r.digest) for r in wholes.digests(parts, "k", cut=True).collect()}
    assert got == {"a": sha("head x\nüz\n"), "b": sha(""), "c": sha(""), "d": sha("q")}


def test_no_row_of_a_report_holds_it_whole(spark):
    """5,000 findings of one report, which would be one text of megabytes: every part is that of one finding."""
    from pyspark.sql import functions as F

    kinds = {"cvss_score": "double", "context_score": "double", "confidence": "double", "votes": "long", "line_start": "int", "line_end": "int", "duplicates": "array<struct<file:string,line_start:int,line_end:int>>", "preconditions": "array<string>", "verdict_confidence": "int"}
    names = "severity title kind cwe file line_start line_end cvss_score cvss_rating cvss_vector context_score context_rating context_vector priority reason confidence votes duplicates description impact scenario preconditions snippet fix notes verdict verdict_confidence verdict_reason reasoning run_status run_evidence run_command".split()
    given = {"severity": "high", "title": "t", "kind": "k", "file": "a.c", "confidence": 0.5, "votes": 1, "description": "d" * 200, "detail": "x"}
    f = spark.range(5000).select(F.lit(1).cast("long").alias("scope"), (F.col("id") + 1).alias("place"), *[F.lit(given.get(n)).cast(kinds.get(n, "string")).alias(n) for n in [*names, "detail"]])
    heads = spark.createDataFrame([(1, "r"), (2, None)], "scope long, name string")
    parts = reports.unconfirmed_parts(heads, f)
    assert parts.agg(F.max(F.length("part"))).first()[0] < 2000
    whole = {r.scope: hashlib.sha256(r.text.encode()).hexdigest() for r in reports.unconfirmed(heads, f).collect()}
    assert {r.scope: r.digest for r in wholes.digests(parts, "scope", cut=True).collect()} == whole


def test_no_row_of_a_sarif_document_holds_it_whole(spark):
    from pyspark.sql import functions as F

    from sievemill.operators import sarif

    kinds = {"cvss_score": "double", "context_score": "double", "confidence": "double", "line": "long", "votes": "long"}
    given = {"title": "]t[", "severity": "HIGH", "category": "k", "file": "a.c", "line": 3, "description": "d" * 100}
    names = ["title", "severity", "category", "cwe", "cvss", "cvss_score", "description", "file", "line", "context_vector", "context_score", "context_rating", "priority", "reason", "confidence", "votes"]
    f = spark.range(3000).select((F.col("id") % 2).alias("scope"), F.col("id").alias("ord"), *[F.lit(given.get(n)).cast(kinds.get(n, "string")).alias(n) for n in names])
    places = spark.createDataFrame([], "ord long, place long, file string, line_start long, line_end long")
    args = (f, places, spark.createDataFrame([(0, "A", "s", "n"), (1, "B", None, "n")], "scope long, id string, source string, name string"), "g", "1.2")
    parts = sarif.document_parts(*args, mask=False)
    assert parts.agg(F.max(F.length("part"))).first()[0] < 2000
    whole = {r.scope: (len(r.sarif), hashlib.sha256(r.sarif.encode()).hexdigest()) for r in sarif.documents(*args, mask=False).collect()}
    assert {r.scope: (r.size, r.digest) for r in wholes.digests(parts, "scope", {1: ","}).collect()} == whole
