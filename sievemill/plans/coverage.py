"""Queries on coverage of threats and paths, orders and progress, and what logs, arguments and paths tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import commands
from sievemill.operators import coverage
from sievemill.plans import views
from sievemill.plans.matching import _q, _s
from sievemill.plans.parsing import pick
from sievemill.plans.records import _sql_pick

_NODE, _PLACE = "src/m{p_partkey % 9}/f{p_size}.c::fn{p_partkey % 50}", "m{s_suppkey % 9}/f{s_suppkey % 50 + 1}.c"


def sink_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    file = F.when(n % 3 == 0, F.concat(F.lit("src/"), _s(_PLACE))).when(n % 3 == 1, _s(_PLACE)).otherwise(F.concat(F.lit("/home/src/"), _s(_PLACE)))
    places = views.table(spark, sf_dir, "supplier").select(file.alias("file"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("file", F.concat(F.lit("fn"), F.col("i").cast("string")).alias("name"))
    return coverage.match_nodes(places, views.table(spark, sf_dir, "part").select(_s(_NODE).alias("node")))


_FUNCTION, _SURFACE = "Get{p_partkey % 40}_item {p_size}", "item_{s_suppkey % 60} x"


def entry_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = views.table(spark, sf_dir, "part"), views.table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    entries = p.select((F.col("p_partkey") % 4).alias("repo"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 11 == 0, None).when(F.col("p_partkey") % 3 == 0, _s("Open_{p_size}")).otherwise(_s(_FUNCTION)).alias("function"))
    surface = F.when(n % 5 == 0, "").when(n % 3 == 0, _s("open_{s_suppkey % 50}")).when(n % 7 == 0, _s("get{s_suppkey % 30} now")).otherwise(F.when(n % 9 == 1, _s(_SURFACE)))
    return coverage.threats_of(entries, s.select((n % 4).alias("repo"), n.alias("ord"), _s("T{s_suppkey}").alias("id"), surface.alias("surface")), "repo").select("ord", "threat")


def threats_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    threats = views.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("repo"), _s("T{s_suppkey}").alias("id"))
    chunks = views.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("repo"), F.when(F.col("c_custkey") % 3 != 0, _s("T{c_custkey * 3}")).alias("threat"))
    out = coverage.threat_coverage(chunks, threats, "repo")
    return out.select("repo", "threats", "covered", F.array_join("missing", ",").alias("missing"))


_FILE, _ANCHOR = "src/m{l_partkey % 9}/d{l_suppkey % 6}/f{l_partkey % 50}.c", "src/m{o_custkey % 9}/d{o_orderkey % 6}/main.c"


def path_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("ord"), _s(_FILE).alias("file"))
    anchors = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(_s(_ANCHOR)).alias("file"))
    return coverage.hop_files(files, anchors, 3)


def entry_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    entries = views.table(spark, sf_dir, "orders").select((n % 30).alias("repo"), n.alias("ord"), pick(["network", "cli", "file"], n).alias("kind"), F.when(n % 4 != 0, n % 2 == 0).alias("unauth"), _s("src/{o_custkey % 90}.c").alias("file"))
    return coverage.entry_order(entries, "repo", 12).select("repo", "ord", "place", "truncated")


def risk_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    rank = F.when(n % 7 == 0, "high").when(n % 7 == 1, None).otherwise((n * 13 % 40).cast("string"))
    return coverage.risk_order(views.table(spark, sf_dir, "orders").select((n % 30).alias("repo"), n.alias("ord"), rank.alias("risk_rank")), "repo").select("repo", "ord", "rank", "place")


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_orderkey")
    ended = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_suppkey").cast("double").alias("elapsed")).select((n % 25).alias("run"), n.alias("ord"), "elapsed", F.lit(500).alias("total"))
    return coverage.progress(ended, "run", 5).select("run", "ord", "done", "active", "queued", "percent", "eta")


def _log(start, code, error, summary):
    return F.concat(start, F.lit("\n[rc="), code, F.lit("]\n"), error, F.lit("\n"), summary)


def crash_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    log = lambda m: _log(F.concat(pick(["$ ", "$ ", "SKIPPED "], m), _s("./run {user_id} ")), pick(["1", "0", "-6", "x", "00"], m), pick(["==7==ERROR: AddressSanitizer: heap", "error: addresssanitizer: x", " ERROR: AddressSanitizer:", "AddressSanitizer:DEADLYSIGNAL"], F.floor(m / 5)), pick(["SUMMARY: AddressSanitizer: y", "none"], F.floor(m / 20)))
    return views.table(spark, sf_dir, "events").select(n.alias("ord"), commands.real_crash(log(n)).alias("crash"), commands.crash_command(F.array(F.lit("$ ls\n[rc=0]"), log(n))).alias("command"))


def tried_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ord")
    listed = F.when(n % 2 == 0, F.array(F.lit("info-leak"), F.lit("injection"))).otherwise(F.array().cast("array<string>"))
    return views.findings(spark, sf_dir).select("ord", commands.tried(F.col("vuln_class"), F.when(n % 5 != 0, n % 7 != 0), n % 9 == 0, listed).alias("tried"))


def plain_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    argv = F.array(F.lit("run"), pick(["--token", "--api-key=s=1", "--auth=", "--x=token", "-v"], n), pick(["abc", "--password"], F.expr("c_custkey div 5")), pick(["v", "-q", "--pwd=1"], F.expr("c_custkey div 10")), F.lit("end"))
    return views.table(spark, sf_dir, "customer").select(n.alias("ord"), F.array_join(commands.without_secrets(argv), " ").alias("argv"))


_PATHS = ["a/b.c", "../x", "a/../../repo/y", "/srv/repo/z/./q", "/srv/repository", "//host/share", " \\\\host\\s", "..", "a//b/.."]
_INSIDE = ["/srv/repo/a/b.c", None, "/srv/repo/y", "/srv/repo/z/q", None, None, "/srv/repo/ \\\\host\\s", None, "/srv/repo/a"]


def inner_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pick(_PATHS, F.col("c_custkey"))
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), path.alias("path"), commands.network_path(path).alias("network"), commands.within(path, "/srv/repo").alias("inside"))


def numbered_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of whole texts, sentences as lines."""
    n = F.col("doc_id")
    text = F.replace("text", F.lit(". "), F.lit(".\n"))
    return views.table(spark, sf_dir, "documents").select(n.alias("ord"), F.sha2(commands.numbered(text, n % 13 - 1, n % 40), 256).alias("digest"))


_LIST = "[" + ", ".join("NULL" if x is None else "'" + x + "'" for x in _INSIDE) + "][CAST(c_custkey % 9 + 1 AS INT)]"
_LOG = f"{_sql_pick(['1', '0', '-6', 'x', '00'], 'event_id')} AS code, event_id % 3 != 2 AS run, event_id // 5 % 4 != 2 AS err, event_id // 20 % 2 = 0 AS summary"

QUERIES = {
    "sink_nodes": (sink_nodes, f"""WITH p AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN '' ELSE '/home/src/' END || {_q(_PLACE)} AS file, 'fn' || i AS name FROM supplier, range(10) t(i)),
n AS (SELECT DISTINCT {_q(_NODE)} AS node, 'fn' || (p_partkey % 50) AS name, split_part({_q(_NODE)}, '::', 1) AS f FROM part),
m AS (SELECT p.*, node, f = file AS same, bool_or(f = file) OVER (PARTITION BY file, p.name) AS own FROM p LEFT JOIN n ON p.name = n.name AND (f = file OR ends_with(f, '/' || file) OR ends_with(file, '/' || f)))
SELECT file, name, coalesce(node, file || '::' || name) AS node, CASE WHEN node IS NULL THEN 'new' WHEN same THEN 'exact' ELSE 'ending' END AS how FROM m WHERE same OR own IS NOT TRUE"""),
    "entry_threats": (entry_threats, f"""WITH e AS (SELECT p_partkey % 4 AS repo, p_partkey AS ord, lower(CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'Open_' || p_size ELSE {_q(_FUNCTION)} END) AS f FROM part),
t AS (SELECT s_suppkey % 4 AS repo, s_suppkey AS o, CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 3 = 0 THEN 'open_' || (s_suppkey % 50) WHEN s_suppkey % 7 = 0 THEN 'get' || (s_suppkey % 30) || ' now' WHEN s_suppkey % 9 = 1 THEN {_q(_SURFACE)} END AS s FROM supplier),
m AS (SELECT e.ord, min(o) FILTER (s = f) AS same, min(o) AS near FROM e LEFT JOIN t ON e.repo = t.repo AND s != '' AND list_has_any(regexp_extract_all(s, '[a-z0-9]+'), regexp_extract_all(f, '[a-z0-9]+')) GROUP BY 1) SELECT ord, 'T' || coalesce(same, near) AS threat FROM m"""),
    "threats_covered": (threats_covered, """WITH t AS (SELECT s_suppkey % 4 AS repo, 'T' || s_suppkey AS id FROM supplier), c AS (SELECT DISTINCT c_custkey % 4 AS repo, 'T' || (c_custkey * 3) AS threat FROM customer WHERE c_custkey % 3 != 0)
SELECT t.repo, count(*) AS threats, count(threat) AS covered, coalesce(string_agg(id, ',' ORDER BY id) FILTER (threat IS NULL), '') AS missing FROM t LEFT JOIN c ON t.repo = c.repo AND id = threat GROUP BY 1"""),
    "path_files": (path_files, f"""WITH f AS (SELECT l_orderkey AS path, {_q(_FILE)} AS file, 'm' || (l_partkey % 9) AS m, 'd' || (l_suppkey % 6) AS d, min(l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000) AS ord FROM lineitem GROUP BY ALL),
a AS (SELECT f.*, count(*) OVER (PARTITION BY path) AS n, CASE WHEN o_orderkey IS NULL OR o_orderkey % 5 = 0 THEN 0 WHEN m != 'm' || (o_custkey % 9) THEN 1 WHEN d != 'd' || (o_orderkey % 6) THEN 2 ELSE 3 END AS depth FROM f LEFT JOIN orders ON path = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN n <= 3 THEN ord END, CASE WHEN n > 3 THEN -depth END, file) AS place FROM a) SELECT path, file, place FROM r WHERE place <= 3"""),
    "entry_ranks": (entry_ranks, f"""WITH e AS (SELECT o_orderkey % 30 AS repo, o_orderkey AS ord, {_sql_pick(['network', 'cli', 'file'], 'o_orderkey')} AS kind, o_orderkey % 4 = 2 AS open, 'src/' || (o_custkey % 90) || '.c' AS file FROM orders),
r AS (SELECT repo, ord, row_number() OVER (PARTITION BY repo ORDER BY kind != 'network', NOT open, kind, file, ord) AS place, count(*) OVER (PARTITION BY repo) > 12 AS truncated FROM e) SELECT * FROM r WHERE place <= 12"""),
    "risk_ranks": (risk_ranks, "WITH r AS (SELECT o_orderkey % 30 AS repo, o_orderkey AS ord, CAST(CASE WHEN o_orderkey % 7 < 2 THEN 999 ELSE o_orderkey * 13 % 40 END AS INT) AS rank FROM orders) SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank, ord) AS place FROM r"),
    "run_progress": (run_progress, """WITH e AS (SELECT l_orderkey % 25 AS run, l_orderkey AS ord, CAST(sum(l_suppkey) AS DOUBLE) AS elapsed FROM lineitem GROUP BY 1, 2), d AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY elapsed, ord) AS done FROM e),
x AS (SELECT *, greatest(500 - done, 0) AS rest FROM d) SELECT run, ord, done, least(5, rest) AS active, rest - least(5, rest) AS queued, CAST(round_even(done / 500 * 100, 0) AS BIGINT) AS percent, elapsed / done * rest AS eta FROM x"""),
    "crash_logs": (crash_logs, f"WITH l AS (SELECT event_id AS ord, user_id, {_LOG} FROM events), c AS (SELECT ord, user_id, run AND code IN ('1', '-6') AND err AND summary AS crash FROM l) SELECT ord, crash, CASE WHEN crash THEN './run ' || user_id ELSE '' END AS command FROM c"),
    "tried_classes": (tried_classes, f"WITH {views.FINDINGS} SELECT ord, ord % 5 != 0 AND ord % 7 != 0 AND (ord % 9 = 0 OR CASE WHEN ord % 2 = 0 THEN vuln_class IN ('info-leak', 'injection') ELSE vuln_class NOT IN ('info-leak', 'injection') END) AS tried FROM v_findings"),
    "plain_arguments": (plain_arguments, f"""WITH a AS (SELECT c_custkey AS ord, c_custkey % 5 AS i, c_custkey // 5 % 2 AS j, c_custkey // 10 % 3 AS k FROM customer)
SELECT ord, 'run ' || (['--token', '--api-key=***', '--auth=', '--x=token', '-v'])[i + 1] || ' ' || CASE WHEN j = 1 THEN '--password' WHEN i IN (0, 2, 3) THEN '***' ELSE 'abc' END || ' ' || CASE k WHEN 0 THEN CASE WHEN j = 1 THEN '***' ELSE 'v' END WHEN 1 THEN '-q' ELSE '--pwd=***' END || ' end' AS argv FROM a"""),
    "inner_paths": (inner_paths, f"SELECT c_custkey AS ord, {_sql_pick(_PATHS, 'c_custkey')} AS path, c_custkey % 9 IN (5, 6) AS network, {_LIST} AS inside FROM customer"),
    "numbered_slices": (numbered_slices, """WITH l AS (SELECT doc_id AS ord, unnest(string_split(regexp_replace(replace(text, '. ', '.' || chr(10)), chr(10) || '$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(replace(text, '. ', '.' || chr(10)), chr(10) || '$', ''), chr(10)), 1) AS i FROM documents WHERE text != ''),
c AS (SELECT ord, string_agg(i || chr(9) || line, chr(10) ORDER BY i) AS body FROM l WHERE i > greatest(ord % 13 - 1, 0) AND i <= greatest(ord % 13 - 1, 0) + greatest(ord % 40, 1) GROUP BY 1)
SELECT doc_id AS ord, sha256(CASE WHEN body IS NULL THEN '(file is empty or offset past EOF)' WHEN length(body) > 200000 THEN body[:200000] || chr(10) || '... [truncated]' ELSE body END) AS digest FROM documents LEFT JOIN c ON ord = doc_id"""),
}
