"""Queries on what judges of a fix write, on settings in texts, and on lines of manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import judgement
from sievemill.plans import views
from sievemill.plans.matching import _s
from sievemill.plans.parsing import pick
from sievemill.plans.records import _sql_pick
from sievemill.sources import files

_STATUS = ['" PASS "', '"fail"', '"Partial"', "7", '"odd"', "null"]
_LINE = ["12", "true", '"3"', "null", "1.5"]
_EVIDENCE = ['[{"file": "a.c", "line": %}, 5, {"file": 3, "snippet": "x"}]', '"none"', "[]"]


def gate_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    evidence = F.replace(pick(_EVIDENCE, F.floor(n / 30)), F.lit("%"), pick(_LINE, n))
    text = F.concat(F.lit('{"gate": "g'), n.cast("string"), F.lit('", "status": '), pick(_STATUS, n), F.lit(', "summary": '), pick(['"s"', "1"], n), F.lit(', "evidence": '), evidence, F.lit("}"))
    g = judgement.gate(F.when(n % 17 == 0, "[1]").when(n % 19 == 0, "{").otherwise(text), "gate")
    out = views.table(spark, sf_dir, "events").select(n.alias("ord"), g.alias("g"))
    places = F.array_join(F.transform("g.evidence", lambda e: F.concat(e["file"], F.lit("@"), F.coalesce(e["line"].cast("string"), F.lit("-")), F.lit("@"), e["snippet"])), ",")
    return out.select("ord", "g.name", "g.status", "g.summary", "g.details", places.alias("evidence"))


def fix_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A justification for each order, its lines as gates."""
    n = F.col("l_linenumber")
    evidence = F.when(n % 3 != 0, F.array(F.struct(F.when(n % 4 != 1, _s("f{l_linenumber % 5}.c")).otherwise("").alias("file"), F.when(n % 2 == 0, n.cast("long")).alias("line")))).otherwise(F.array().cast("array<struct<file:string,line:bigint>>"))
    row = F.struct(n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), _s("g{l_linenumber}").alias("name"), pick(["pass", "fail", "partial", "skip"], F.col("l_partkey")).alias("status"), _s("did {l_suppkey}").alias("summary"), evidence.alias("evidence"))
    k = F.col("l_orderkey")
    got = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("gates"))
    verdict = F.when(k % 5 == 4, "odd").otherwise(pick(["Fixed", "Partially Fixed", "Not Fixed", "UNVERIFIABLE"], k % 5))
    return got.select(k.alias("ord"), judgement.justification(verdict, (k % 101) / 100, F.col("gates"), F.when(k % 2 == 0, "given")).alias("text"))


def filled_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("A"), F.col("c_name"), F.lit("B_1"), F.lit(""), F.lit("_C"), F.col("c_custkey").cast("string"))
    text = pick(["x${A}y${B_1:-dflt}", "${NO}|${NO:-}|${NO:-$d:-e}", "${a}${A:-q}${_C}", "plain $A {A}", "${B_1}${A", "${A}"], F.col("c_custkey"))
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), judgement.expanded(text, values).alias("text"))


def time_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return views.table(spark, sf_dir, "events").select(n.alias("ord"), judgement.span(n * 37 % 9000 - 50 + 0.5).alias("span"))


_SETTINGS = ["verify = false", "ssl_verify: 'no'", "insecure_mode=1", "auth: none", "debug = yes", "debug = yesterday", "reject_unauthorised=0", "allow-anonymous:  TRUE", "tls_verify = true"]


def unsafe_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.concat_ws("\n", pick(_SETTINGS, n), F.col("text"), pick(_SETTINGS, F.floor(n / 9)), pick(_SETTINGS, n))
    return views.table(spark, sf_dir, "documents").select(n.alias("ord"), F.array_join(F.filter(judgement.suspicious(text), lambda x: x.startswith("insecure:")), ";").alias("tokens"))


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    line = F.when(n % 11 == 0, "  # note").when(n % 11 == 1, " ").when(n % 11 == 2, "a,b").when(n % 11 == 3, " ,, x").when(n % 11 == 4, "a,b,-x").when(n % 11 == 5, "a, b ,dir{}").otherwise(_s(" a , r{o_custkey} , https://h/r{o_custkey % 40} "))
    rows = views.table(spark, sf_dir, "orders").select((n % 10).alias("file"), n.alias("lineno"), F.replace(line, F.lit("{}"), (n % 3).cast("string")).alias("line"))
    return files.manifest_entries(rows, F.col("ref") == "dir1").select("file", "lineno", "name", "ref", F.array_join("errors", "; ").alias("errors"))


_UNSAFE = judgement.UNSAFE.replace("'", "''")
_P = "string_agg(s, '; ' ORDER BY n, p, k)"

QUERIES = {
    "gate_objects": (gate_objects, f"""WITH e AS (SELECT event_id AS ord, event_id % 17 != 0 AND event_id % 19 != 0 AS ok, {_sql_pick(['pass', 'fail', 'partial', 'invalid', 'invalid', 'invalid'], 'event_id')} AS status FROM events)
SELECT ord, CASE WHEN ok THEN 'g' || ord END AS name, CASE WHEN ok THEN status END AS status, CASE WHEN ok THEN CASE WHEN ord % 2 = 0 THEN 's' ELSE '' END END AS summary, CASE WHEN ok THEN '' END AS details,
 CASE WHEN ok THEN CASE WHEN ord // 30 % 3 = 0 THEN 'a.c@' || CASE WHEN ord % 5 = 0 THEN '12' ELSE '-' END || '@,@-@x' ELSE '' END END AS evidence FROM e"""),
    "fix_texts": (fix_texts, f"""WITH g AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS k, 'did ' || l_suppkey AS s, l_partkey % 4 AS st, CASE WHEN l_linenumber % 3 != 0 THEN CASE WHEN l_linenumber % 4 != 1 THEN 'f' || (l_linenumber % 5) || '.c' ELSE '' END END AS f FROM lineitem),
a AS (SELECT o, coalesce({_P} FILTER (st = 0), '') AS passed, coalesce({_P} FILTER (st = 1), '') AS failed, coalesce({_P} FILTER (st IN (1, 2)), '') AS gaps, string_agg('Address g' || n || ': ' || s, '; ' ORDER BY n, p, k) FILTER (st = 1) AS todo,
 array_to_string(list_sort(list_distinct(list(f) FILTER (st IN (1, 2) AND f != ''))), ', ') AS files, array_to_string((list(f || CASE WHEN n % 2 = 0 THEN ':' || n ELSE '' END ORDER BY n, p, k) FILTER (f IS NOT NULL))[:5], '; ') AS places, 'Fix confidence: ' || (o % 101) || '%. ' AS sure FROM g GROUP BY o)
SELECT o AS ord, CASE o % 5 WHEN 0 THEN 'Fix verified: ' || passed || '. ' || sure || 'Evidence: ' || coalesce(places, '') || '.' WHEN 1 THEN 'Partial fix: ' || passed || '. Gaps: ' || gaps || '. ' || sure || 'Files needing fixes: ' || coalesce(nullif(files, ''), 'N/A') || '.'
 WHEN 3 THEN CASE WHEN o % 2 = 0 THEN 'given' ELSE '' END ELSE 'Fix insufficient: ' || failed || '. Vulnerable pattern remains in ' || coalesce(nullif(files, ''), 'affected files') || '. ' || sure || 'Recommended action: ' || coalesce(todo, 'Review all failing gates and apply fixes') || '.' END AS text FROM a"""),
    "filled_settings": (filled_settings, "SELECT c_custkey AS ord, CASE c_custkey % 6 WHEN 0 THEN 'x' || c_name || 'ydflt' WHEN 1 THEN '||$d:-e' WHEN 2 THEN '${a}' || c_name || c_custkey WHEN 3 THEN 'plain $A {A}' WHEN 4 THEN '${A' ELSE c_name END AS text FROM customer"),
    "time_spans": (time_spans, "WITH s AS (SELECT event_id AS ord, greatest(event_id * 37 % 9000 - 50, 0) AS s FROM events) SELECT ord, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS span FROM s"),
    "unsafe_settings": (unsafe_settings, f"""WITH t AS (SELECT doc_id AS ord, concat_ws(chr(10), {_sql_pick([x.replace("'", "''") for x in _SETTINGS], 'doc_id')}, text, {_sql_pick([x.replace("'", "''") for x in _SETTINGS], 'doc_id // 9')}, {_sql_pick([x.replace("'", "''") for x in _SETTINGS], 'doc_id')}) AS t FROM documents)
SELECT ord, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '{_UNSAFE}'), lambda x: 'insecure:' || regexp_replace(x, '\\s+', ' ', 'g')[:80]))), ';') AS tokens FROM t"""),
    "manifest_lines": (manifest_lines, """WITH l AS (SELECT o_orderkey % 10 AS file, o_orderkey AS lineno, o_orderkey % 11 AS m, o_custkey AS c FROM orders WHERE o_orderkey % 11 > 1),
e AS (SELECT *, CASE m WHEN 2 THEN 'b' WHEN 3 THEN '' WHEN 4 THEN 'b' WHEN 5 THEN 'b' ELSE 'r' || c END AS name, CASE m WHEN 2 THEN '' WHEN 3 THEN 'x' WHEN 4 THEN '-x' WHEN 5 THEN 'dir' || (lineno % 3) ELSE 'https://h/r' || (c % 40) END AS ref FROM l),
f AS (SELECT *, min(lineno) FILTER (m > 5 OR ref = 'dir1') OVER (PARTITION BY file, ref) AS first FROM e), g AS (SELECT *, 'line ' || lineno || ': ' AS pre FROM f)
SELECT file, lineno, name, ref, CASE m WHEN 2 THEN pre || 'expected 3 comma-separated fields (application_id,repository_name,path) — got 2' WHEN 3 THEN pre || 'application_id is empty; ' || pre || 'repository_name is empty' WHEN 4 THEN pre || 'path ''-x'' may not start with ''-''' ELSE CASE WHEN m = 5 AND ref != 'dir1' THEN pre || 'path ''' || ref || ''' is neither a git URL nor an existing local directory' WHEN lineno > first THEN pre || 'duplicate path ''' || ref || '''' ELSE '' END END AS errors FROM g"""),
}
