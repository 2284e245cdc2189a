"""Queries over chunks, reports, names and texts as records: kinds, ranks, requests, severities, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import markdown, paths, redact, severity
from sievemill.operators import ranking, selection
from sievemill.plans import views
from sievemill.plans.parsing import pick

_BANDS = ["Critical", "high ", " Medium", "None", "LOW", "Unknown", ""]
_LABELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
_CHUNKS = ["taint", "risk", "catchall", "specialist"]
_STATUSES = ["awaiting_validation", "needs_review", "validated", "", "Rejected", "validation_failed"]


def _sql_pick(parts: list[str], n: str) -> str:
    return "([" + ", ".join(f"'{x}'" for x in parts) + f"])[CAST(({n}) % {len(parts)} + 1 AS INT)]"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    context = F.when(n % 3 == 0, None).otherwise(((n * 31 % 101) / 10))
    base = F.when(n % 5 == 0, None).otherwise((n * 17 % 101) / 10)
    return views.table(spark, sf_dir, "events").select(n.alias("ord"), pick(_BANDS, n).alias("context_band"), pick(_BANDS, F.expr("event_id div 7")).alias("base_band"), pick(_LABELS, n).alias("label"), context.alias("context"), base.alias("base"))


_RATED = f"""v_rated AS (SELECT event_id AS ord, {_sql_pick(_BANDS, 'event_id')} AS context_band, {_sql_pick(_BANDS, 'event_id // 7')} AS base_band, {_sql_pick(_LABELS, 'event_id')} AS label,
  CASE WHEN event_id % 3 != 0 THEN CAST(event_id * 31 % 101 AS DOUBLE) / 10 END AS context, CASE WHEN event_id % 5 != 0 THEN CAST(event_id * 17 % 101 AS DOUBLE) / 10 END AS base FROM events)"""


def severity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity by band and by score, its SARIF level and security severity."""
    by_band, by_score = severity.resolve(F.col("context_band"), F.col("base_band"), F.col("label")), severity.from_score(F.col("context"), F.col("base"))
    return _rated(spark, sf_dir).select("ord", by_band.alias("severity"), by_score.alias("by_score")).withColumn("level", severity.sarif_level(F.col("severity")))


def security_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("ord", severity.security_severity(F.col("base"), F.col("label")).alias("security_severity"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = pick(_CHUNKS, k)
    outcome = F.when(k % 10 == 0, "failed").when(k % 10 == 1, None).when(k % 10 == 2, "timeout").otherwise("completed")
    return views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), k.alias("ord"), F.concat(kind, F.lit("-"), k.cast("string")).alias("id"), kind.alias("kind"), ((k % 4 == 3) | (k % 12 == 2)).alias("specialist"), (k % 9 + 1).alias("risk_rank"), outcome.alias("outcome"))


_CHUNK_VIEW = f"""v_chunks AS (SELECT o_custkey AS repo, o_orderkey AS ord, {_sql_pick(_CHUNKS, 'o_orderkey')} AS kind, o_orderkey % 4 = 3 OR o_orderkey % 12 = 2 AS specialist, o_orderkey % 9 + 1 AS risk_rank,
  CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN NULL WHEN 2 THEN 'timeout' ELSE 'completed' END AS outcome FROM orders)"""


def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of each kind there are, and how many of them failed."""
    kind = selection.chunk_kind(F.col("id"), F.col("specialist")).alias("kind")
    return _chunks(spark, sf_dir).groupBy(kind).agg(F.count("*").alias("attempted"), F.count_if(F.col("outcome") != "completed").alias("failed"))


def chunk_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.assign_ranks(_chunks(spark, sf_dir), 25).select("repo", "ord", "kind", "rank")


def name_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a shell pattern skips."""
    return selection.skip_names(views.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", ["*#*7?", "CUSTOMER#00000[!0-8]*", "*[13]3"]).where("skipped_by is not null")


def forbidden_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir).select("ord", F.when(F.col("ord") % 2 == 0, F.replace("file", F.lit("/"), F.lit("\\"))).otherwise(F.col("file")).alias("file"))
    return selection.forbidden_files(f, ["tests/*", "**/u1?.c"], ["src/u2*"])


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = k * 37 % 101
    score = F.when(k % 7 == 0, "n/a").when(k % 11 == 0, None).otherwise(F.concat(F.expr("cast(o_orderkey * 37 % 101 div 10 as string)"), F.lit("."), (number % 10).cast("string")))
    return views.table(spark, sf_dir, "orders").select(k.alias("ord"), k.alias("id"), F.when(k % 13 == 0, None).otherwise(pick(_STATUSES, k)).alias("status"), score.alias("score"), F.when(k % 3 == 0, "remediated").otherwise("open").alias("fix"))


_REPORTS = f"""v_reports AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 13 != 0 THEN {_sql_pick(_STATUSES, 'o_orderkey')} END AS status,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 0::DOUBLE ELSE CAST(o_orderkey * 37 % 101 AS DOUBLE) / 10 END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'remediated' ELSE 'open' END AS fix FROM orders)"""
_CAN = "status IN ('awaiting_validation', 'needs_review', 'validation_failed')"


def validation_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_by_score(_reports(spark, sf_dir), 50).select("ord", "status", "value")


def request_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return selection.select_by_id(_reports(spark, sf_dir), views.table(spark, sf_dir, "customer").select(k.alias("place"), (k * 13 + k % 3).alias("id")))


def remediation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in scope, those that are no false positive, those with a fix, and the share of fixes as text."""
    r = _reports(spark, sf_dir).agg(F.count("*").alias("in_scope"), (F.count("*") - F.count_if(F.lower("status") == "rejected")).alias("true_positive"), F.count_if(F.col("fix") == "remediated").alias("remediated"))
    share = F.concat(F.rint(F.col("remediated") / F.when(F.col("in_scope") > 0, F.col("in_scope")) * 100).cast("long").cast("string"), F.lit("%"))
    return r.withColumn("rate", F.coalesce(share, F.lit("n/a")))


def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that are fine, that warn, and required ones that fail."""
    status = F.col("l_returnflag")
    return views.table(spark, sf_dir, "lineitem").agg(F.count_if(status == "A").alias("ok"), F.count_if(status == "N").alias("warn"), F.count_if((status == "R") & (F.col("l_linestatus") == "F")).alias("blocking"))


def gate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate map of each finding, taken apart; of a repeated gate the status that sorts last counts."""
    return selection.gate_map(views.gates(spark, sf_dir), "status").select("finding_id", F.explode("gates").alias("gate", "x")).select("finding_id", "gate", "x.*")


def duplicate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates point to the place of their canonical row among the kept rows in order of severity and priority."""
    n = F.col("event_id")
    rows = views.table(spark, sf_dir, "events").select(n.alias("ord"), pick(_LABELS, n).alias("severity"), F.when(n % 4 == 0, None).otherwise(F.concat(F.lit("p"), (n % 4).cast("string"))).alias("priority"), F.when(n % 10 == 3, "DUPLICATE").when(n % 10 == 4, "REJECTED").alias("reason"), (n - n % 7).alias("canonical"))
    kept = rows.where("reason is null").select("ord", ranking.severity_rank(F.col("severity")).alias("a"), ranking.priority_rank(F.col("priority")).alias("b"))
    return selection.remap_canonical(rows.where("reason is not null").select("ord", "reason", "canonical"), selection.positions(kept, ["a", "b"]))


def caller_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("callee")
    e = views.edges(spark, sf_dir).select("caller", F.concat(F.lit("src/m"), (c % 5).cast("string"), F.lit("/f"), (c % 40).cast("string"), F.lit(".c")).alias("callee_file"))
    p = F.col("p_partkey")
    name = F.concat(F.lit("f"), (p % 60).cast("string"), F.lit(".c"))
    return selection.callers_of(views.table(spark, sf_dir, "part").select(F.when(p % 2 == 0, name).otherwise(F.concat(F.lit("m"), (p % 7).cast("string"), F.lit("/"), name)).alias("file")), e)


def related_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known advisories that chunks name, each once, as lines of a text."""
    named = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("id")).distinct()
    known = views.table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), "p_name")
    return named.join(known, "id").select("chunk", "id", F.concat(F.lit("  - CVE-"), F.col("id").cast("string"), F.lit(": "), "p_name").alias("line"))


def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a list, plain and each once; and the files of a change, joined."""
    s = F.col("source")
    raw = F.array(F.concat(F.lit(" /"), s, F.lit("/ ")), F.upper("lang"), F.lit("//"), s, F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit(" a b/c\\"), F.lit("  "))
    changed = F.array(F.concat(F.lit("// "), s), F.col("lang"), F.concat(s, F.lit(".c")), F.lit("abc"), F.lit("abcd"))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(paths.name_list(raw, lower=True), ";").alias("names"), paths.affected(changed).alias("files"))


def prefixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir)
    ref = F.when(F.col("ord") % 5 == 0, "").when(F.col("ord") % 5 == 1, None).when(F.col("ord") % 5 == 2, F.col("file")).otherwise(F.concat("file", F.lit(":"), F.col("line_start").cast("string"), F.lit(":7")))
    return f.select("ord", paths.prefixed(F.col("file"), "src").alias("file"), paths.prefixed_reference(ref, "src").alias("ref"))


def number_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine digits whose parts can be those of a number."""
    digits = F.lpad((F.col("l_orderkey") * 7919 * F.col("l_partkey") % 1_000_000_000 * (F.col("l_linenumber") % 3)).cast("string"), 9, "0")
    return views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), "l_linenumber", digits.alias("digits")).withColumn("valid", redact.ssn_valid(F.col("digits")))


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.concat(F.lit("# "), "lang", F.lit("\n"), F.when(n % 2 == 0, "```c").otherwise("call(a|b)"), F.lit("\n## inner \n"), F.when(n % 4 == 0, " ~~~").otherwise(""), F.lit("\n   ### "), "text")
    return views.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_NOTED = """v_noted AS (SELECT doc_id, '# ' || lang || chr(10) || (CASE WHEN doc_id % 2 = 0 THEN '```c' ELSE 'call(a|b)' END) || chr(10) || '## inner ' || chr(10) || (CASE WHEN doc_id % 4 = 0 THEN ' ~~~' ELSE '' END) || chr(10) || '   ### ' || text AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) AS i FROM v_noted)"""


def demoted_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noted(spark, sf_dir).select("doc_id", markdown.demote_headings(F.col("text")).alias("text"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noted(spark, sf_dir).select("doc_id", markdown.cell(F.col("text")).alias("cell"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines around the hinted line, or around the first call of a name."""
    n = F.col("doc_id")
    return _noted(spark, sf_dir).select("doc_id", markdown.excerpt(F.col("text"), F.lit("call"), (n % 9 - 1), 3).alias("x")).select("doc_id", "x.*")


def chain_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.expr("repeat(' -> Async', cast(doc_id % 4 as int))"), F.expr("repeat(' → GPU', cast(doc_id % 3 as int))")).alias("text"))
    score = severity.chain_complexity(F.col("text"), (n % 5), (n % 20))
    return d.select("doc_id", score.cast("int").alias("complexity")).withColumn("seconds", severity.scaled_floor(60.0, 300.0, F.col("complexity")))


_GROUPS = " + ".join("CASE WHEN regexp_matches(t, '" + "|".join(w) + "') THEN 1 ELSE 0 END" for w in severity.HARD_WORDS)
_BAND = "CASE lower(trim({0})) WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' WHEN 'low' THEN 'LOW' END"

QUERIES = {
    "severity_resolve": (severity_resolve, f"""WITH {_RATED}, s AS (SELECT ord, coalesce({_BAND.format('context_band')}, {_BAND.format('base_band')}, label) AS severity, coalesce(context, base) AS x FROM v_rated)
SELECT ord, severity, CASE WHEN x IS NULL THEN 'INFO' WHEN x >= 9 THEN 'CRITICAL' WHEN x >= 7 THEN 'HIGH' WHEN x >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS by_score, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level FROM s"""),
    "security_severity": (security_severity, f"WITH {_RATED} SELECT ord, CASE WHEN base >= 0 THEN format('{{:.1f}}', base) ELSE CASE label WHEN 'CRITICAL' THEN '9.0' WHEN 'HIGH' THEN '7.0' WHEN 'MEDIUM' THEN '4.0' WHEN 'LOW' THEN '0.1' ELSE '0.0' END END AS security_severity FROM v_rated"),
    "chunk_kinds": (chunk_kinds, f"WITH {_CHUNK_VIEW} SELECT CASE WHEN specialist THEN 'specialist' WHEN kind = 'catchall' THEN 'catchall' ELSE 'risk' END AS kind, count(*) AS attempted, count(*) FILTER (outcome != 'completed') AS failed FROM v_chunks GROUP BY 1"),
    "chunk_ranks": (chunk_ranks, f"""WITH {_CHUNK_VIEW}, a AS (SELECT repo, ord, kind, row_number() OVER (PARTITION BY repo ORDER BY ord) AS rank FROM v_chunks WHERE kind = 'taint' UNION ALL SELECT repo, ord, kind, risk_rank + 25 FROM v_chunks WHERE kind = 'risk'),
b AS (SELECT c.repo, c.ord, c.kind, row_number() OVER (PARTITION BY c.repo ORDER BY c.ord) + coalesce((SELECT max(rank) FROM a WHERE a.repo = c.repo), 0) AS rank FROM v_chunks c WHERE kind = 'catchall'),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), m AS (SELECT repo, max(rank) AS top FROM ab GROUP BY 1)
SELECT * FROM ab UNION ALL SELECT c.repo, c.ord, c.kind, row_number() OVER (PARTITION BY c.repo ORDER BY c.ord) + coalesce(top, 0) FROM v_chunks c LEFT JOIN m ON c.repo = m.repo WHERE kind = 'specialist'"""),
    "name_skips": (name_skips, "WITH s AS (SELECT c_custkey, c_name, CASE WHEN lower(c_name) GLOB '*#*7?' THEN '*#*7?' WHEN lower(c_name) GLOB 'customer#00000[!0-8]*' THEN 'CUSTOMER#00000[!0-8]*' WHEN lower(c_name) GLOB '*[13]3' THEN '*[13]3' END AS skipped_by FROM customer) SELECT * FROM s WHERE skipped_by IS NOT NULL"),
    "forbidden_changes": (forbidden_changes, f"""WITH {views.FINDINGS}, h AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN replace(file, '/', chr(92)) ELSE file END AS file, CASE WHEN starts_with(file, 'tests/') THEN 'tests/*' WHEN regexp_matches(file, '(^|/)u1.\\.c$') THEN '**/u1?.c' END AS forbid_hit, CASE WHEN starts_with(file, 'src/u2') THEN 'src/u2*' END AS deny_hit FROM v_findings)
SELECT * FROM h WHERE forbid_hit IS NOT NULL OR deny_hit IS NOT NULL"""),
    "validation_cap": (validation_cap, f"WITH {_REPORTS} SELECT ord, status, value FROM v_reports WHERE {_CAN} ORDER BY value DESC, ord LIMIT 50"),
    "request_select": (request_select, f"WITH {_REPORTS} SELECT c_custkey AS place, c_custkey * 13 + c_custkey % 3 AS id, CASE WHEN ord IS NULL THEN 'not found' WHEN {_CAN} THEN NULL ELSE 'status ''' || coalesce(nullif(status, ''), 'unset') || '''' END AS problem FROM customer LEFT JOIN v_reports ON ord = c_custkey * 13 + c_custkey % 3"),
    "remediation_summary": (remediation_summary, f"WITH {_REPORTS} SELECT count(*) AS in_scope, count(*) FILTER (status IS DISTINCT FROM 'Rejected') AS true_positive, count(*) FILTER (fix = 'remediated') AS remediated, CAST(CAST(round_even(count(*) FILTER (fix = 'remediated') / count(*) * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS rate FROM v_reports"),
    "check_summary": (check_summary, "SELECT count(*) FILTER (l_returnflag = 'A') AS ok, count(*) FILTER (l_returnflag = 'N') AS warn, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS blocking FROM lineitem"),
    "gate_weights": (gate_weights, f"""WITH {views.GATES}, o AS (SELECT finding_id, gate, max(status) AS status FROM v_gates GROUP BY ALL), w AS (SELECT *, CASE gate WHEN 'root_cause' THEN 0.43 WHEN 'instance_coverage' THEN 0.2467 WHEN 'no_new_vulnerabilities' THEN 0.1867 ELSE 0.1366 END::DOUBLE AS weight FROM o)
SELECT finding_id, gate, status, weight, CASE status WHEN 'pass' THEN weight WHEN 'partial' THEN CASE gate WHEN 'root_cause' THEN 0.215 WHEN 'instance_coverage' THEN {round(0.2467 * 0.5, 4)} WHEN 'no_new_vulnerabilities' THEN {round(0.1867 * 0.5, 4)} ELSE 0.0683 END ELSE 0.0 END::DOUBLE AS weighted FROM w"""),
    "duplicate_places": (duplicate_places, f"""WITH r AS (SELECT event_id AS ord, {_sql_pick(['0', '1', '2', '3', '4'], 'event_id')} AS a, CASE WHEN event_id % 4 = 0 THEN 9 ELSE event_id % 4 END AS b, CASE event_id % 10 WHEN 3 THEN 'DUPLICATE' WHEN 4 THEN 'REJECTED' END AS reason, event_id - event_id % 7 AS canonical FROM events),
k AS (SELECT ord, row_number() OVER (ORDER BY a, b, ord) - 1 AS place FROM r WHERE reason IS NULL) SELECT r.ord, reason, coalesce(place, canonical) AS canonical FROM r LEFT JOIN k ON r.canonical = k.ord AND reason = 'DUPLICATE' WHERE reason IS NOT NULL"""),
    "caller_files": (caller_files, f"""WITH {views.EDGES}, e AS (SELECT caller, 'src/m' || (callee % 5) || '/f' || (callee % 40) || '.c' AS f FROM v_edges),
q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'm' || (p_partkey % 7) || '/' END || 'f' || (p_partkey % 60) || '.c' AS file FROM part),
m AS (SELECT DISTINCT file, caller FROM q JOIN e ON e.f = file OR ends_with(e.f, '/' || file)), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY caller) AS nth FROM m) SELECT file, caller, nth FROM n WHERE nth <= 15"""),
    "related_advisories": (related_advisories, "SELECT DISTINCT l_orderkey AS chunk, l_partkey AS id, '  - CVE-' || p_partkey || ': ' || p_name AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 3 = 0"),
    "name_lists": (name_lists, """WITH r AS (SELECT doc_id, lower(source) AS s, lower(lang) AS l, source, lang FROM documents)
SELECT doc_id, s || CASE WHEN l = s THEN '' ELSE ';' || l END || ';a b/c' AS names, concat_ws(', ', CASE WHEN length(lang) > 3 AND NOT starts_with(lang, '//') THEN lang END, CASE WHEN length(source || '.c') > 3 THEN source || '.c' END, 'abcd') AS files FROM r"""),
    "prefixed_paths": (prefixed_paths, f"""WITH {views.FINDINGS}, p AS (SELECT ord, line_start, CASE WHEN starts_with(file, 'src/') THEN file ELSE 'src/' || file END AS file FROM v_findings)
SELECT ord, file, CASE ord % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN file ELSE file || ':' || line_start || ':7' END AS ref FROM p"""),
    "number_gate": (number_gate, """WITH d AS (SELECT l_orderkey AS ord, l_linenumber, lpad(CAST(CAST(l_orderkey AS BIGINT) * 7919 * l_partkey % 1000000000 * (l_linenumber % 3) AS VARCHAR), 9, '0') AS digits FROM lineitem)
SELECT *, NOT regexp_matches(digits, '^(000|666)|^...00|0000$') AS valid FROM d"""),
    "demoted_headings": (demoted_headings, f"""WITH {_NOTED}, f AS (SELECT *, regexp_matches(line, '^\\s{{0,3}}(```|~~~)') AS fence FROM l), g AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM f)
SELECT doc_id, string_agg(CASE WHEN fence OR inside THEN line ELSE regexp_replace(line, '^(\\s{{0,3}})#{{1,6}}[ \\t]+(.*?)\\s*$', '\\1**\\2**') END, chr(10) ORDER BY i) AS text FROM g GROUP BY doc_id"""),
    "table_cells": (table_cells, f"WITH {_NOTED} SELECT doc_id, trim(replace(replace(replace(text, chr(13), ' '), chr(10), ' '), '|', chr(92) || '|')) AS cell FROM v_noted"),
    "excerpts": (excerpts, f"""WITH {_NOTED}, c AS (SELECT doc_id, max(i) AS n, min(i) FILTER (contains(line, 'call') AND contains(line, '(')) AS found FROM l GROUP BY 1),
a AS (SELECT doc_id, n, CASE WHEN doc_id % 9 - 1 BETWEEN 1 AND n THEN doc_id % 9 - 1 ELSE found END AS place FROM c)
SELECT a.doc_id, string_agg(format('{{:5d}}| {{}}', i, line), chr(10) ORDER BY i) AS excerpt, coalesce(max(CASE WHEN place IS NOT NULL THEN greatest(1, place - 2) END), 0)::BIGINT AS first FROM a LEFT JOIN l ON a.doc_id = l.doc_id AND i BETWEEN place - 2 AND place + 2 GROUP BY 1"""),
    "chain_complexity": (chain_complexity, f"""WITH d AS (SELECT doc_id, lower(text || repeat(' -> Async', CAST(doc_id % 4 AS INT)) || repeat(' → GPU', CAST(doc_id % 3 AS INT))) AS t FROM documents),
s AS (SELECT doc_id, (length(t) - length(replace(t, '->', ''))) // 2 + length(t) - length(replace(t, '→', '')) AS arrows, least(2, {_GROUPS}) AS g FROM d),
c AS (SELECT doc_id, CAST(least(5, 1 + (arrows >= 2)::INT + (arrows >= 5)::INT + (doc_id % 5 >= 2)::INT + g + (doc_id % 20 >= 5)::INT + (doc_id % 20 >= 15)::INT) AS INT) AS complexity FROM s) SELECT doc_id, complexity, 60 + CAST(240 AS DOUBLE) * (complexity - 1) / 4 AS seconds FROM c"""),
}
