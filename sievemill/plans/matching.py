"""Queries that attach rows to what they mean, group files, and tell states of fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import status, weakness
from sievemill.operators import clusters, graph, matching, state
from sievemill.plans import views
from sievemill.plans.parsing import pick
from sievemill.plans.records import _sql_pick


def _s(text: str):
    """A text with ``{expression}`` parts as one column."""
    parts = [F.expr(f"cast({p} as string)") if i % 2 else F.lit(p) for i, p in enumerate(text.replace("}", "{").split("{")) if p]
    return F.concat(*parts)


def _q(text: str) -> str:
    return " || ".join(f"CAST({p.replace(' div ', ' // ')} AS VARCHAR)" if i % 2 else f"'{p}'" for i, p in enumerate(text.replace("}", "{").split("{")) if p)


_NAME, _CALLER = "fn{l_partkey % 60}", "src/m{l_suppkey % 7}/d{l_orderkey % 5}/f{l_linenumber}.c"
_DEF_NAME, _DEF = "fn{p_partkey % 70}", "src/m{p_size % 9}/d{p_partkey % 6}/f{p_partkey % 11}.c"


def call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = views.table(spark, sf_dir, "lineitem").select(_s(_NAME).alias("name"), _s(_CALLER).alias("caller_file"))
    return matching.resolve_calls(calls, views.table(spark, sf_dir, "part").select(_s(_DEF_NAME).alias("name"), _s(_DEF).alias("file")))


_TITLE, _RESULT = "Issue {c_custkey % 90}", "Issue {o_orderkey % 400}{o_orderkey % 3} in a place"
_PLACE, _AT = "src/u{c_custkey % 50}.c", "src/u{o_orderkey % 60}.c"


def _reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    reports = views.table(spark, sf_dir, "customer").select((k % 5).alias("repo"), k.alias("id"), F.when(k % 4 != 0, _s(_PLACE)).alias("file"), F.when(k % 6 != 0, k % 13).alias("line_start"), F.when(k % 17 == 0, " ").otherwise(_s(_TITLE)).alias("title"))
    results = views.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("repo"), F.col("o_orderkey").alias("ord"), _s(_AT).alias("file"), (F.col("o_orderkey") % 31).alias("line"), _s(_RESULT).alias("text"))
    return reports, results


_REPORTED = f"""r AS (SELECT c_custkey % 5 AS repo, c_custkey AS id, CASE WHEN c_custkey % 4 != 0 THEN {_q(_PLACE)} END AS file, CASE WHEN c_custkey % 6 != 0 THEN c_custkey % 13 END AS line_start, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE {_q(_TITLE)} END AS title FROM customer),
s AS (SELECT o_orderkey % 5 AS repo, o_orderkey AS ord, {_q(_AT)} AS file, o_orderkey % 31 AS line, {_q(_RESULT)} AS text FROM orders)"""


def result_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_results(*_reported(spark, sf_dir), "repo").select("id", "result", "how")


def result_match_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_results(*_reported(spark, sf_dir), "repo", unique=True).select("id", "result", "how")


def _result_sql(only: str) -> str:
    return f"""WITH {_REPORTED}, p AS (SELECT id, (SELECT min(ord) FROM s WHERE s.repo = r.repo AND s.file = r.file AND line = line_start) AS a FROM r),
t AS (SELECT r.id, min(ord) AS b FROM r JOIN s ON s.repo = r.repo AND trim(title) != '' AND starts_with(text, trim(title)) GROUP BY 1 HAVING {only})
SELECT p.id, coalesce(a, b) AS result, CASE WHEN a IS NOT NULL THEN 'place' WHEN b IS NOT NULL THEN 'title' END AS how FROM p LEFT JOIN t ON p.id = t.id"""


_HEADING, _FOUND = " Flaw {p_partkey % 97} of Part {p_size % 8}", "flaw {s_suppkey % 97}"


def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings beside reports; each third report has the whole title, the others a part of it."""
    h = views.table(spark, sf_dir, "part").select((F.col("p_partkey") % 3).alias("repo"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 41 == 0, "").otherwise(_s(_HEADING)).alias("title"))
    n = F.col("s_suppkey")
    r = views.table(spark, sf_dir, "supplier").select((n % 3).alias("repo"), n.alias("id"), F.when(n % 4 == 0, F.concat(_s(_FOUND), _s(" of part {s_suppkey % 8} "))).when(n % 9 == 0, "").otherwise(_s(_FOUND)).alias("title"))
    return matching.match_titles(h, r, "repo").select("ord", "report")


_BOOK = [("CWE-1", "c", "posix", "a"), ("CWE-1", "c", "default", "b"), ("CWE-1", "py", None, "c"), ("CWE-1", "default", "default", "d"), ("CWE-1", None, None, "e"), ("CWE-2", "c", "win", "f"), ("CWE-2", None, None, "g"), ("CWE-3", "default", "posix", "h")]


def strategy_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = views.table(spark, sf_dir, "part").select(k.alias("ord"), F.when(k % 7 != 0, _s("CWE-{p_partkey % 5}")).alias("cwe"), pick(["c", "py", "go"], F.expr("p_partkey div 5")).alias("language"), F.array(pick(["posix", "win", "qt"], k), pick(["win", "posix"], F.expr("p_size"))).alias("frameworks"))
    return matching.pick_strategy(rows, spark.createDataFrame(_BOOK, "cwe string, language string, framework string, name string")).select("ord", "cwe", "strategy")


def known_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chains of suppliers; the suppliers of some nations are unknown, some steps are no integers."""
    step = F.struct("l_linenumber", F.when(F.col("l_partkey") % 9 != 0, F.col("l_suppkey").cast("long")).alias("step"))
    chains = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain")).agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["step"]).alias("steps"))
    places = views.table(spark, sf_dir, "supplier").where("s_nationkey % 3 != 0").select(F.col("s_suppkey").cast("long").alias("ord"), (F.col("s_suppkey") * 2).alias("place"))
    out = matching.chain_steps(chains, places, 2)
    return out.select("chain", F.array_join("steps", ",").alias("steps"), F.array_join("dropped", ",").alias("dropped"), F.col("more").cast("long").alias("more"))


def proposed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = views.table(spark, sf_dir, "orders").select((n % 40).alias("repo"), n.alias("ord"), F.when(n % 3 == 0, n - 40).alias("canonical"), F.when(n % 3 == 0, "lines").alias("why"))
    k = F.col("c_custkey")
    pairs = views.table(spark, sf_dir, "customer").select((k % 40).alias("repo"), k.alias("ord"), F.expr("c_custkey * 7 % 50").alias("dup"), F.expr("c_custkey * 3 % 60").alias("canonical"), _s("pair {c_custkey}").alias("why"))
    return matching.apply_pairs(rows, pairs, "repo").select("ord", "canonical", "why")


def sink_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks that a call path of at most six steps reaches from an entry, those that none does, and the share."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("node"))
    met = c.where("node % 7 = 1").join(graph.reachable(views.edges(spark, sf_dir), c.where("node % 10 = 0"), 6).withColumn("hit", F.lit(1)), "node", "left")
    out = met.agg(F.count("*").alias("sinks"), F.count("hit").alias("reached"))
    share = F.rint(F.when(F.col("sinks") > 0, F.col("reached") * 100 / F.col("sinks")).otherwise(0.0)).cast("long")
    return out.select("sinks", "reached", (F.col("sinks") - F.col("reached")).alias("orphans"), share.alias("percent"))


_SHAPE_PATH = "app{doc_id % 6}/{lang}/{doc_id}.yaml"


def shape_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as settings files: those of one source and remainder have one shape, their numbers are their tokens."""
    d = F.col("doc_id")
    stage = pick(["/prod", "/qa", "", "/stage"], F.expr("doc_id div 3"))
    files = views.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), (d % 4).cast("string")).alias("shape"), F.concat(_s("app{doc_id % 6}"), stage, _s("/{lang}/{doc_id}.yaml")).alias("path"), F.col("n_chars").alias("size"), F.when(d % 50 != 0, F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\d{2})\d*"), F.lit(1)))).alias("tokens"))
    return clusters.reduce_shapes(files, 4).select("shape", "path", "role", "token")


def taken_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 23 != 0, F.col("n_chars")).alias("size"))
    return clusters.take_within(d, "lang", 20_000, 900).select("ord", F.col("taken").cast("long").alias("taken"))


_REPO = "org{c_custkey % 3}/svc{c_custkey % 4}"


def unique_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(_s(_REPO), F.when(k % 5 == 0, ".GIT/").when(k % 5 == 1, "/").otherwise(""))
    return clusters.folder_names(views.table(spark, sf_dir, "customer").select(F.expr("c_custkey div 10").alias("app"), k.alias("ord"), name.alias("name"))).select("ord", "name", "slug")


def cohesive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "src/d{{{0} % 11}}/p{{{0}}}.x.c"
    c = views.table(spark, sf_dir, "customer")
    files = c.select(F.when(F.col("c_custkey") % 29 == 0, _s("p{c_custkey}")).otherwise(_s(path.format("c_custkey"))).alias("path"))
    modules = c.where("c_custkey % 4 = 0").select(_s("mod{c_custkey % 6}").alias("module"), F.col("c_custkey").alias("ord"), _s(path.format("c_custkey")).alias("path"))
    e = views.edges(spark, sf_dir).where("caller % 3 = 0")
    return clusters.cohesive(files, modules, e.select(_s(path.format("caller")).alias("caller"), _s(path.format("callee")).alias("callee")))


def hot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = views.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("graph"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), _s("m.c::f{l_partkey % 90}").alias("caller"), F.when(F.col("l_suppkey") % 8 == 0, "").otherwise(_s("m.c::g{l_suppkey % 70}")).alias("callee"))
    marked = views.table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select((F.col("p_partkey") % 20).alias("graph"), F.concat(pick(["f", "g"], F.col("p_size")), _s("{p_partkey % 60}")).alias("function"))
    return clusters.edge_lines(calls, marked, 50)


_VERDICTS = ["Fixed", "Partially Fixed", "Not Fixed", "False Positive", "Denied", "fixed", ""]
_STATES = ["awaiting_validation", "Rejected", "validated", "deny", "validation_failed", "needs_review", "proposed", ""]


def fix_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is told of a fix: its state, what reports call it, and what its verdict allows."""
    n = F.col("event_id")
    verdict, mode = F.when(n % 19 != 0, pick(_VERDICTS, n)), pick(["fix", "report-only", "fix"], F.expr("event_id div 7"))
    bucket, reason = status.reported(F.when(n % 23 != 0, pick(_STATES, n)), F.when(n % 3 == 0, _s(" did {user_id} ")), F.when(n % 5 == 0, "rule"))
    e = views.table(spark, sf_dir, "events")
    return e.select(n.alias("ord"), status.fix_status(verdict, mode).alias("status"), bucket.alias("bucket"), reason.alias("reason"), status.readiness(verdict).alias("readiness"), status.answer(verdict, status.FIXED).alias("fixed"), status.final_status(verdict).alias("final"))


def finding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    title = F.when(n % 31 == 0, "?!").otherwise(F.concat(F.lit("<"), "p_name", F.lit(" / "), "p_type", F.lit("> & "), "p_name", F.lit("; "), "p_type"))
    return views.table(spark, sf_dir, "part").select(n.alias("ord"), status.slug(n, title).alias("slug"), status.label(pick(["HIGH", "LOW"], n), title, F.when(n % 4 != 0, _s("src/{p_size}.c"))).alias("label"))


def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = F.when(n % 13 == 0, "soon").otherwise(F.date_format(F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, event_id % 5000)"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return views.table(spark, sf_dir, "events").select(n.alias("ord"), status.seconds_between(start, end).alias("seconds"), status.file_stamp(F.col("ts")).alias("stamp"))


def typed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections over the numbers 3, 6, ..., 36, whose every second is done."""
    typed = F.when(F.col("c_custkey") % 8 == 0, pick(["all", " Q ", "", "pending"], F.expr("c_custkey div 8"))).otherwise(_s("{c_custkey % 40}, {c_custkey % 12}-{c_custkey % 31} x-2 {c_custkey % 7 * 3},-5 {c_custkey % 40}"))
    known, done = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i * 3), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i % 2 == 0)
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.array_join(status.selected(typed, known, done), ",").alias("places"))


def resume_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose step was saved for the very same text; steps are saved twice, at times for another text."""
    p = views.table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    found = p.select(n.alias("ord"), _s("fix_{p_partkey}").alias("step"), state.identity(n, F.col("p_name"), F.when(n % 3 == 0, F.col("p_type"))).alias("finding_id"))
    saved = p.where("p_partkey % 5 != 0").select(_s("run{p_size % 2}").alias("run_id"), _s("fix_{p_partkey}").alias("step"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "*")
    saved = saved.select("run_id", "step", "seq", F.to_json(F.struct(state.identity(n, F.when((n + F.col("seq")) % 4 != 0, F.col("p_name")), F.when(n % 3 == 0, F.col("p_type"))).alias("finding_id"))).alias("payload"))
    return state.resume(found, saved, "run1")


def weakness_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated weaknesses, or those of the class, and those that words of whole texts tell."""
    d = F.col("doc_id")
    words = pick(["SQL  injection", "a cross-site scripting", "../up", "missing authorization", "OS Command", "", "Deserial"], d)
    kinds = pick(list(weakness.OF_CLASS) + ["other"], d)
    cwe = weakness.stated(F.when(d % 3 == 0, " cwe-89").when(d % 7 == 0, "CWE-9999"), kinds)
    return views.table(spark, sf_dir, "documents").select(d.alias("ord"), cwe.alias("cwe"), weakness.label(cwe).alias("label"), weakness.derived(words, kinds, F.col("text")).alias("derived"))


_KINDS = _sql_pick(list(weakness.OF_CLASS) + ["other"], "doc_id")
_CLASS_CASE = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in weakness.OF_CLASS.items()) + " END"
_WORD_CASE = "CASE " + " ".join(f"WHEN regexp_matches(b, '(?i){w}') THEN '{c}'" for w, c in weakness.OF_WORDS) + f" ELSE {_CLASS_CASE} END"
_NAME_CASE = "CASE cwe " + " ".join(f"WHEN '{k}' THEN cwe || ' - {v}'" for k, v in weakness.NAMES.items()) + " ELSE coalesce(cwe, '') END"
_STAGE_SQL = "CASE WHEN contains(lower(path), '/prod') THEN 0 WHEN regexp_matches(lower(path), '/(cert|stag|stg)') THEN 1 WHEN regexp_matches(lower(path), '/(perf|qa)') THEN 2 ELSE 3 END"
_DIR = "'src/d' || ({0} % 11) || '/p' || {0} || '.x.c'"

QUERIES = {
    "call_targets": (call_targets, f"""WITH c AS (SELECT DISTINCT {_q(_NAME)} AS name, {_q(_CALLER)} AS caller_file FROM lineitem), d AS (SELECT DISTINCT {_q(_DEF_NAME)} AS name, {_q(_DEF)} AS file FROM part),
m AS (SELECT c.name, caller_file, file, split_part(caller_file, '/', 2) = split_part(file, '/', 2) AS a, split_part(caller_file, '/', 3) = split_part(file, '/', 3) AS b, bool_or(caller_file = file) OVER (PARTITION BY c.name, caller_file) AS own FROM c JOIN d ON c.name = d.name),
r AS (SELECT *, row_number() OVER (PARTITION BY name, caller_file ORDER BY CASE WHEN a AND b THEN 2 WHEN a THEN 1 ELSE 0 END DESC, file) AS place FROM m WHERE NOT own OR file = caller_file)
SELECT name, caller_file, file, place FROM r WHERE place <= 3"""),
    "result_match": (result_match, _result_sql("true")),
    "result_match_unique": (result_match_unique, _result_sql("count(*) = 1")),
    "title_match": (title_match, f"""WITH h AS (SELECT p_partkey % 3 AS repo, p_partkey AS ord, CASE WHEN p_partkey % 41 = 0 THEN '' ELSE lower(trim({_q(_HEADING)})) END AS t FROM part),
r AS (SELECT s_suppkey % 3 AS repo, s_suppkey AS id, trim(CASE WHEN s_suppkey % 4 = 0 THEN {_q(_FOUND + ' of part {s_suppkey % 8} ')} WHEN s_suppkey % 9 = 0 THEN '' ELSE {_q(_FOUND)} END) AS u FROM supplier),
m AS (SELECT ord, count(id) FILTER (t = u) AS same, min(id) FILTER (t = u) AS one, count(id) AS n, min(id) AS near FROM h LEFT JOIN r ON h.repo = r.repo AND t != '' AND u != '' AND (contains(t, u) OR contains(u, t)) GROUP BY 1)
SELECT ord, CASE WHEN same = 1 THEN one WHEN same = 0 AND n = 1 THEN near END AS report FROM m"""),
    "strategy_pick": (strategy_pick, f"""WITH r AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 7 != 0 THEN 'CWE-' || (p_partkey % 5) END AS cwe, {_sql_pick(['c', 'py', 'go'], 'p_partkey // 5')} AS l, {_sql_pick(['posix', 'win', 'qt'], 'p_partkey')} AS f, {_sql_pick(['win', 'posix'], 'p_size')} AS g FROM part)
SELECT ord, cwe, CASE cwe WHEN 'CWE-1' THEN CASE l WHEN 'c' THEN CASE WHEN 'posix' IN (f, g) THEN 'a' ELSE 'b' END WHEN 'py' THEN 'c' ELSE 'd' END WHEN 'CWE-2' THEN CASE WHEN l = 'c' AND 'win' IN (f, g) THEN 'f' ELSE 'g' END WHEN 'CWE-3' THEN CASE WHEN 'posix' IN (f, g) THEN 'h' END END AS strategy FROM r"""),
    "known_steps": (known_steps, """WITH s AS (SELECT l_orderkey AS chain, l_linenumber AS i, l_suppkey AS step, (SELECT s_suppkey * 2 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey % 3 != 0) AS place FROM lineitem WHERE l_partkey % 9 != 0),
n AS (SELECT *, count(*) FILTER (place IS NULL) OVER (PARTITION BY chain ORDER BY i, step, place ROWS UNBOUNDED PRECEDING) AS nth FROM s)
SELECT chain, string_agg(CAST(place AS VARCHAR), ',' ORDER BY i, step) AS steps, coalesce(string_agg(CAST(step AS VARCHAR), ',' ORDER BY i, step) FILTER (place IS NULL AND nth <= 2), '') AS dropped, greatest(count(*) FILTER (place IS NULL) - 2, 0) AS more FROM n GROUP BY 1 HAVING count(place) >= 2"""),
    "proposed_duplicates": (proposed_duplicates, """WITH r AS (SELECT o_orderkey % 40 AS repo, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 40 END AS canonical FROM orders),
f AS (SELECT repo, ord, row_number() OVER (PARTITION BY repo ORDER BY ord) - 1 AS place FROM r WHERE canonical IS NULL),
p AS (SELECT c_custkey % 40 AS repo, c_custkey AS n, c_custkey * 7 % 50 AS dup, c_custkey * 3 % 60 AS goal FROM customer),
b AS (SELECT a.ord, b.ord AS goal, n, row_number() OVER (PARTITION BY a.ord ORDER BY n) AS k FROM p JOIN f a ON a.repo = p.repo AND a.place = dup JOIN f b ON b.repo = p.repo AND b.place = goal WHERE goal < dup)
SELECT r.ord, coalesce(canonical, goal) AS canonical, CASE WHEN canonical IS NOT NULL THEN 'lines' ELSE 'pair ' || n END AS why FROM r LEFT JOIN b ON r.ord = b.ord AND k = 1"""),
    "sink_reach": (sink_reach, f"""WITH RECURSIVE {views.EDGES}, w AS (SELECT CAST(c_custkey AS BIGINT) AS node, 0 AS h FROM customer WHERE c_custkey % 10 = 0 UNION SELECT callee, h + 1 FROM w JOIN v_edges ON caller = node WHERE h < 6),
s AS (SELECT c_custkey IN (SELECT node FROM w) AS hit FROM customer WHERE c_custkey % 7 = 1) SELECT count(*) AS sinks, count(*) FILTER (hit) AS reached, count(*) FILTER (NOT hit) AS orphans, CAST(round_even(count(*) FILTER (hit) * 100 / count(*), 0) AS BIGINT) AS percent FROM s"""),
    "shape_clusters": (shape_clusters, f"""WITH f AS (SELECT source || '-' || (doc_id % 4) AS shape, 'app' || (doc_id % 6) || {_sql_pick(['/prod', '/qa', '', '/stage'], 'doc_id // 3')} || '/' || lang || '/' || doc_id || '.yaml' AS path, n_chars AS size, CASE WHEN doc_id % 50 != 0 THEN list_distinct(regexp_extract_all(coalesce(text, ''), '(\\d{{2}})\\d*', 1)) END AS tokens FROM documents),
o AS (SELECT *, count(*) OVER (PARTITION BY shape) AS n, row_number() OVER (PARTITION BY shape, split_part(path, '/', 1) ORDER BY {_STAGE_SQL}, size DESC, path) = 1 AS rep, {_STAGE_SQL} AS stage FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY NOT rep, stage, size DESC, path) AS i FROM o), t AS (SELECT shape, i, rep, unnest(tokens) AS token FROM p WHERE n >= 4),
x AS (SELECT shape, i, min(token) AS token FROM t a WHERE NOT rep AND NOT EXISTS (FROM t b WHERE b.shape = a.shape AND b.token = a.token AND b.i < a.i) GROUP BY ALL)
SELECT p.shape, path, CASE WHEN n < 4 THEN 'small' WHEN rep THEN 'representative' WHEN token IS NOT NULL OR tokens IS NULL THEN 'promoted' ELSE 'dropped' END AS role, token FROM p LEFT JOIN x ON p.shape = x.shape AND p.i = x.i"""),
    "taken_texts": (taken_texts, """WITH RECURSIVE o AS (SELECT lang, doc_id AS ord, CASE WHEN doc_id % 23 != 0 THEN n_chars ELSE 0 END AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
w AS (SELECT lang, ord, i, least(size, 900, 20000) AS taken, 20000 - least(size, 900, 20000) AS room FROM o WHERE i = 1 UNION ALL SELECT o.lang, o.ord, o.i, least(size, 900, room), room - least(size, 900, room) FROM w JOIN o ON (w.lang = o.lang OR (w.lang IS NULL AND o.lang IS NULL)) AND o.i = w.i + 1)
SELECT ord, CAST(taken AS BIGINT) AS taken FROM w"""),
    "unique_folders": (unique_folders, """WITH RECURSIVE r AS (SELECT c_custkey // 10 AS app, c_custkey AS ord, 'org' || (c_custkey % 3) || '/svc' || (c_custkey % 4) || CASE c_custkey % 5 WHEN 0 THEN '.GIT/' WHEN 1 THEN '/' ELSE '' END AS name, 'svc' || (c_custkey % 4) AS base FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY app, base ORDER BY ord) AS k FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY app, base, name ORDER BY ord) AS again FROM f WHERE k > 1), h AS (SELECT DISTINCT base, name, 1 AS again, base || '-' || sha1(name)[:8] AS slug FROM w UNION ALL SELECT base, name, again + 1, base || '-' || sha1(slug || name)[:8] FROM h WHERE again < 5)
SELECT ord, name, base AS slug FROM f WHERE k = 1 UNION ALL SELECT ord, w.name, slug FROM w JOIN h ON w.base = h.base AND w.name = h.name AND w.again = h.again"""),
    "cohesive_files": (cohesive_files, f"""WITH RECURSIVE {views.EDGES}, f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 29 = 0 THEN 'p' || c_custkey ELSE {_DIR.format('c_custkey')} END AS path, c_custkey % 4 = 0 AND c_custkey % 29 != 0 AS placed FROM customer),
e AS (SELECT {_DIR.format('caller')} AS a, {_DIR.format('callee')} AS b FROM v_edges WHERE caller % 3 = 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), p AS (SELECT path FROM f WHERE NOT placed),
w AS (SELECT path AS node, path AS root FROM p WHERE path IN (SELECT a FROM u) UNION SELECT b, root FROM w JOIN u ON a = node JOIN p ON path = b), c AS (SELECT node, min(root) AS root FROM w GROUP BY 1)
SELECT path, CASE WHEN placed THEN 'mod' || (k % 6) WHEN root IS NOT NULL THEN 'cg:' || regexp_replace(regexp_extract(root, '[^/]*$'), '\\.[^.]*$', '') WHEN contains(path, '/') THEN 'src/d' || (k % 11) ELSE '.' END AS "group", CASE WHEN placed THEN 'module' WHEN root IS NOT NULL THEN 'calls' ELSE 'folder' END AS how FROM f LEFT JOIN c ON path = node"""),
    "hot_edges": (hot_edges, f"""WITH c AS (SELECT l_orderkey % 20 AS g, 'f' || (l_partkey % 90) AS f, 'g' || (l_suppkey % 70) AS t, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem WHERE l_suppkey % 8 != 0 GROUP BY ALL),
m AS (SELECT DISTINCT p_partkey % 20 AS g, {_sql_pick(['f', 'g'], 'p_size')} || (p_partkey % 60) AS f FROM part WHERE p_partkey % 5 = 0),
x AS (SELECT g, f, min(ord) AS ord, string_agg('m.c::' || t, ', ' ORDER BY ord, t) AS callees, bool_or((g, t) IN (SELECT (g, f) FROM m)) OR bool_or((g, f) IN (SELECT (g, f) FROM m)) AS hot FROM c GROUP BY ALL),
y AS (SELECT g AS graph, row_number() OVER (PARTITION BY g ORDER BY hot DESC, ord, f) AS place, '  - m.c::' || f || ' -> ' || callees AS line, hot FROM x) SELECT * FROM y WHERE place <= 50"""),
    "fix_states": (fix_states, f"""WITH e AS (SELECT event_id AS ord, user_id, CASE WHEN event_id % 19 != 0 THEN {_sql_pick(_VERDICTS, 'event_id')} END AS v, event_id // 7 % 3 = 1 AS report, lower(CASE WHEN event_id % 23 != 0 THEN {_sql_pick(_STATES, 'event_id')} ELSE '' END) AS s, CASE WHEN event_id % 3 = 0 THEN 'did ' || user_id END AS did FROM events)
SELECT ord, CASE WHEN v = 'Denied' THEN 'deny' WHEN v = 'False Positive' THEN 'rejected' WHEN report THEN 'proposed' WHEN v IN ('Fixed', 'Partially Fixed') THEN 'awaiting_validation' ELSE 'needs_review' END AS status,
 CASE WHEN s = 'deny' THEN 'deny' WHEN s IN ('awaiting_validation', 'proposed', 'validated') THEN 'remediated' ELSE 'skipped' END AS bucket,
 CASE WHEN s = 'deny' AND ord % 5 = 0 THEN 'rule' WHEN did IS NOT NULL THEN did WHEN s = 'deny' THEN 'policy gate denied automated remediation' WHEN s IN ('awaiting_validation', 'proposed', 'validated') THEN 'remediation applied' WHEN s = 'validation_failed' THEN 'fix applied but failed validation; needs rework' WHEN s = 'rejected' THEN 'finding rejected as a false positive' ELSE 'remediation not applied; needs review' END AS reason,
 CASE WHEN v = 'Fixed' THEN 'Ready' WHEN v = 'Partially Fixed' THEN 'Ready with Conditions' ELSE 'Not Ready' END AS readiness, CASE WHEN v = 'Fixed' THEN 'Yes' ELSE 'No' END AS fixed, CASE WHEN v = 'Fixed' THEN 'validated' WHEN v IN ('Partially Fixed', 'Not Fixed') THEN 'validation_failed' ELSE 'needs_review' END AS final FROM e"""),
    "finding_labels": (finding_labels, """WITH p AS (SELECT *, CASE WHEN p_partkey % 31 = 0 THEN '?!' ELSE '<' || p_name || ' / ' || p_type || '> & ' || p_name || '; ' || p_type END AS t FROM part)
SELECT p_partkey AS ord, CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || p_partkey || '_' || coalesce(nullif(rtrim(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-')[:60], '-'), ''), 'finding') AS slug, '[' || CASE WHEN p_partkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END || '] ' || t || CASE WHEN p_partkey % 4 != 0 THEN ' (src/' || p_size || '.c)' ELSE '' END AS label FROM p"""),
    "run_spans": (run_spans, "SELECT event_id AS ord, CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 5000 END::DOUBLE AS seconds, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events"),
    "typed_selection": (typed_selection, """WITH c AS (SELECT c_custkey AS k FROM customer), t AS (SELECT k, CAST(k % 40 AS BIGINT) AS lo, CAST(k % 40 AS BIGINT) AS hi, 0 AS i FROM c UNION ALL SELECT k, k % 12, k % 31, 1 FROM c UNION ALL SELECT k, k % 7 * 3, k % 7 * 3, 2 FROM c),
p AS (SELECT k, n // 3 - 1 AS place, min(i) AS i FROM t JOIN (SELECT unnest(range(3, 37, 3)) AS n) ON n BETWEEN lo AND hi GROUP BY ALL)
SELECT c.k AS ord, CASE WHEN c.k % 8 != 0 THEN coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY i, place), '') WHEN c.k // 8 % 4 = 0 THEN '0,1,2,3,4,5,6,7,8,9,10,11' WHEN c.k // 8 % 4 = 3 THEN '0,2,4,6,8,10' END AS places FROM c LEFT JOIN p ON c.k = p.k GROUP BY c.k"""),
    "resume_cached": (resume_cached, "SELECT p_partkey AS ord, 'fix_' || p_partkey AS step, sha256(p_partkey || chr(0) || p_name || chr(0) || CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END || chr(0)) AS finding_id, p_partkey % 5 != 0 AND p_size % 2 = 1 AND (p_partkey + 2) % 4 != 0 AS cached FROM part"),
    "weakness_labels": (weakness_labels, f"""WITH d AS (SELECT doc_id AS ord, {_KINDS} AS k, {_sql_pick(['SQL  injection', 'a cross-site scripting', '../up', 'missing authorization', 'OS Command', '', 'Deserial'], 'doc_id')} AS words, text FROM documents),
e AS (SELECT *, words || ' ' || k || ' ' || coalesce(text, '') AS b, CASE WHEN ord % 3 = 0 THEN 'CWE-89' WHEN ord % 7 = 0 THEN 'CWE-9999' ELSE {_CLASS_CASE} END AS cwe FROM d) SELECT ord, cwe, {_NAME_CASE} AS label, {_WORD_CASE} AS derived FROM e"""),
}
