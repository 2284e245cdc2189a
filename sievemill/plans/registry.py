"""All queries of the library by name, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import coerce, cvss
from sievemill.operators import aggregates, filters, graph, joins, selection, votes, windows
from sievemill.plans import code, coverage, documents, flows, judging, markdown_reports, matching, parsing, records, reports, streams, texts, values, views

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_REASON = f"""CASE WHEN NOT regexp_matches(f.file, '(?i)\\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$') THEN 'not native'
  WHEN f.vuln_class NOT IN ('use-after-free', 'heap-overflow', 'stack-overflow', 'format-string', 'integer-overflow', 'type-confusion') THEN 'class not enabled'
  WHEN regexp_matches(f.file, '{filters.TEST_PATH}') AND f.vuln_class != 'info-leak' THEN 'test path' WHEN i.file IS NULL THEN 'not in inventory' WHEN f.confidence < CAST(0.6 AS DOUBLE) THEN 'low confidence' END"""
_GATED = f"gated AS (SELECT f.*, {_REASON} AS reason FROM v_findings f LEFT JOIN v_inventory i ON f.file = i.file)"


@_query(f"WITH {views.FINDINGS}, {views.INVENTORY}, {_GATED} SELECT ord, file, vuln_class, confidence, reason FROM gated")
def gate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.gate_cascade(views.findings(spark, sf_dir), views.inventory(spark, sf_dir)).select("ord", "file", "vuln_class", "confidence", "reason")


@_query(f"WITH {views.FINDINGS}, {views.INVENTORY}, {_GATED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM gated GROUP BY 1")
def drop_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_cascade(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_VOTED = """keyed AS (SELECT *, line_start // 10 AS bucket FROM v_findings),
counted AS (SELECT file, bucket, vuln_class, count(DISTINCT run) AS votes FROM keyed GROUP BY ALL HAVING count(DISTINCT run) >= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY file, bucket, vuln_class ORDER BY confidence DESC, ord) AS k FROM keyed),
voted AS (SELECT c.file, CAST(c.bucket AS BIGINT) AS bucket, c.vuln_class, c.votes, b.ord, b.line_start, b.line_end, b.confidence FROM counted c JOIN best b ON b.k = 1 AND b.file = c.file AND b.bucket = c.bucket AND b.vuln_class = c.vuln_class)"""


@_query(f"WITH {views.FINDINGS}, {_VOTED} SELECT * FROM voted")
def quorum_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.quorum(views.findings(spark, sf_dir))


@_query(f"WITH {views.FINDINGS}, b AS (SELECT *, row_number() OVER (PARTITION BY file, vuln_class ORDER BY confidence DESC, ord) AS k FROM v_findings) SELECT file, vuln_class, ord, confidence FROM b WHERE k = 1")
def argmax_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min_by(F.struct("ord", "confidence"), F.struct(-F.col("confidence"), F.col("ord")))
    return views.findings(spark, sf_dir).groupBy("file", "vuln_class").agg(best.alias("b")).select("file", "vuln_class", "b.*")


@_query(f"""WITH RECURSIVE {views.FINDINGS},
g AS (SELECT file, vuln_class, list({{'ord': ord, 's': line_start, 'e': line_end}} ORDER BY ord) AS rows FROM v_findings GROUP BY ALL),
fold AS (SELECT file, vuln_class, rows, 1 AS i, CAST([] AS STRUCT(ord BIGINT, s INT, e INT)[]) AS kept, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS root FROM g
  UNION ALL SELECT file, vuln_class, rows, i + 1,
    CASE WHEN hit IS NULL THEN list_append(kept, rows[i]) ELSE kept END, rows[i].ord, coalesce(hit, rows[i].ord) FROM
    (SELECT *, (list_filter(kept, lambda k: abs(k.s - rows[i].s) <= 3 OR (k.s <= rows[i].e AND rows[i].s <= k.e)))[1].ord AS hit FROM fold WHERE i <= len(rows)))
SELECT file, vuln_class, ord, root FROM fold WHERE ord IS NOT NULL""")
def overlap_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.collapse_overlaps(views.findings(spark, sf_dir))


_DIRS, _EXTS, _GLOBS = ["vendor", "node_modules"], [".min.js", ".map"], ["**/es/*", "src1?/*"]
_EXCLUDED = f"""x AS (SELECT path, size, CASE WHEN lower(split_part(path, '/', 1)) IN ('vendor', 'node_modules') THEN 'directory' WHEN ends_with(lower(path), '.min.js') OR ends_with(lower(path), '.map') THEN 'extension'
  WHEN regexp_matches(path, '^(.*/)?es/.*$') OR regexp_matches(path, '^src1./.*$') THEN 'glob' WHEN size > 4000 THEN 'size' END AS kind,
  CASE WHEN lower(split_part(path, '/', 1)) IN ('vendor', 'node_modules') THEN split_part(path, '/', 1) WHEN ends_with(lower(path), '.min.js') THEN '.min.js' WHEN ends_with(lower(path), '.map') THEN '.map'
  WHEN regexp_matches(path, '^(.*/)?es/.*$') THEN '**/es/*' WHEN regexp_matches(path, '^src1./.*$') THEN 'src1?/*' WHEN size > 4000 THEN 'oversize' END AS key FROM v_files)"""


@_query(f"WITH {views.FILES}, {_EXCLUDED} SELECT coalesce(kind, 'kept') AS kind, coalesce(key, '') AS key, count(*) AS n FROM x GROUP BY ALL")
def exclusion_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.exclusion(views.files(spark, sf_dir).select("path", "size"), _DIRS, _EXTS, _GLOBS, 4000)
    return out.groupBy(F.coalesce("kind", F.lit("kept")).alias("kind"), F.coalesce("key", F.lit("")).alias("key")).agg(F.count("*").alias("n"))


@_query("""SELECT doc_id AS ord, CASE WHEN verdict = 'TP' AND conf >= 7 THEN 'keep' WHEN verdict = 'TP' THEN 'UNCONFIRMED' WHEN verdict IS NULL AND conf = 0 THEN 'VERIFY_ERROR' ELSE 'FALSE_POSITIVE' END AS outcome
FROM (SELECT d.doc_id, coalesce(10 * l.quality, 0) AS conf, CASE l.toxic WHEN 1 THEN 'FP' WHEN 0 THEN 'TP' END AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def verdict_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = (views.table(spark, sf_dir, t) for t in ("documents", "labels"))
    rows = d.select("doc_id").join(l, "doc_id", "left").select(F.col("doc_id").alias("ord"), F.coalesce(10 * F.col("quality"), F.lit(0)).alias("conf"), F.when(F.col("toxic") == 1, "FP").when(F.col("toxic") == 0, "TP").alias("verdict"))
    return filters.verdict_split(rows).select("ord", "outcome")


@_query(f"""WITH {views.FINDINGS}, r AS (SELECT ord, CASE WHEN vuln_class NOT IN ('use-after-free', 'heap-overflow') THEN 'class not eligible' END AS c FROM v_findings),
k AS (SELECT ord, row_number() OVER (ORDER BY ord) AS k FROM r WHERE c IS NULL)
SELECT r.ord, coalesce(c, CASE WHEN k.k > 200 THEN 'budget exhausted' END) AS reason FROM r LEFT JOIN k ON r.ord = k.ord""")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.admit(views.findings(spark, sf_dir).select("ord", "vuln_class"), F.col("vuln_class").isin("use-after-free", "heap-overflow"), 200, ["ord"]).select("ord", "reason")


@_query(f"""WITH {views.FINDINGS}, c AS (SELECT ord, file AS path, CASE vuln_class WHEN 'heap-overflow' THEN 'CWE-122' WHEN 'use-after-free' THEN 'CWE-416' WHEN 'integer-overflow' THEN 'CWE-190' WHEN 'info-leak' THEN 'CWE-200' END AS cwe FROM v_findings),
d AS (SELECT *, CASE WHEN cwe IS NULL THEN 'unmapped_cwe' WHEN cwe = 'CWE-416' THEN 'deny:lifetime' WHEN regexp_matches(path, '^tests/.*$') THEN 'deny_path:tests/*' WHEN cwe IN ('CWE-122', 'CWE-190') THEN 'allow_list' ELSE 'default_action' END AS rule FROM c)
SELECT ord, cwe, rule, CASE WHEN rule = 'allow_list' THEN 'patch' ELSE 'guidance_only' END AS action FROM d""")
def policy_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("vuln_class")
    rows = views.findings(spark, sf_dir).select("ord", F.col("file").alias("path"), coerce.cwe(F.when(c == "heap-overflow", "cwe 122").when(c == "use-after-free", "CWE-416").when(c == "integer-overflow", "190").when(c == "info-leak", "see CWE200")).alias("cwe"))
    return filters.policy_decide(rows, {"CWE-416": "lifetime"}, ["tests/*", "**/ci/*"], ["CWE-122", "CWE-190"]).select("ord", "cwe", "rule", "action")


@_query(f"WITH {views.APPLICATIONS} SELECT id, parent_id, external, pci, pan, pii, origin FROM v_inherited")
def cmdb_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.inherit(views.applications(spark, sf_dir), views.parents(spark, sf_dir), "id", "parent_id", ["external", "pci", "pan", "pii"])


_UP = "round({0} * 100000.0)"
_ROUND = lambda x: f"(CASE WHEN CAST(round(({x}) * 100000) AS BIGINT) % 10000 = 0 THEN CAST(round(({x}) * 100000) AS BIGINT) / 100000.0::DOUBLE ELSE (floor(CAST(round(({x}) * 100000) AS BIGINT) / 10000.0::DOUBLE) + 1) / 10.0::DOUBLE END)"
_CASE = lambda name, table: f"CASE regexp_extract(vector, '(^|/){name}:([A-Z])', 2) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END"
_METRICS = f"""SELECT ord, vector, app, regexp_extract(vector, '(^|/)S:([A-Z])', 2) = 'C' AS changed, regexp_extract(vector, '(^|/)AV:([A-Z])', 2) AS av_letter, {_CASE('AV', cvss.AV)} AS av, {_CASE('AC', cvss.AC)} AS ac,
  CASE WHEN regexp_extract(vector, '(^|/)S:([A-Z])', 2) = 'C' THEN {_CASE('PR', cvss.PR_CHANGED)} ELSE {_CASE('PR', cvss.PR)} END AS pr, {_CASE('UI', cvss.UI)} AS ui, {_CASE('C', cvss.CIA)} AS c, {_CASE('I', cvss.CIA)} AS i, {_CASE('A', cvss.CIA)} AS a FROM v_vectors"""
_BASE = f"""m AS ({_METRICS}),
p AS (SELECT *, 8.22::DOUBLE * av * ac * pr * ui AS exploit, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM m),
q AS (SELECT *, CASE WHEN changed THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS impact FROM p),
base AS (SELECT *, CASE WHEN impact <= 0 THEN 0.0::DOUBLE ELSE {_ROUND('least(CASE WHEN changed THEN 1.08::DOUBLE * (impact + exploit) ELSE impact + exploit END, 10.0::DOUBLE)')} END AS score FROM q)"""
_RATING = lambda x: f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0.1 THEN 'None' WHEN {x} < 4 THEN 'Low' WHEN {x} < 7 THEN 'Medium' WHEN {x} < 9 THEN 'High' ELSE 'Critical' END"


@_query(f"WITH {views.VECTORS}, {_BASE} SELECT ord, vector, score, {_RATING('score')} AS rating FROM base")
def cvss_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cvss.with_base_score(views.vectors(spark, sf_dir), "vector", "score")
    return scored.select("ord", "vector", "score", cvss.rating(F.col("score")).alias("rating"))


_ENV = f"""e AS (SELECT m.*, x.external, x.pci, x.pan, x.pii FROM (SELECT {'*'} FROM m) m JOIN v_inherited x ON CAST(m.app AS VARCHAR) = x.id),
f AS (SELECT *, CASE WHEN NOT external AND av_letter = 'N' THEN 0.62::DOUBLE ELSE av END AS mav, CASE WHEN pci OR pan OR pii THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS cr, CASE WHEN pci OR pan THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS ir FROM e),
g AS (SELECT *, least(1 - (1 - cr * c) * (1 - ir * i) * (1 - a), 0.915::DOUBLE) AS miss, 8.22::DOUBLE * mav * ac * pr * ui AS mexploit FROM f),
h AS (SELECT *, CASE WHEN changed THEN 7.52::DOUBLE * (miss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(miss * 0.9731::DOUBLE - 0.02::DOUBLE, 13) ELSE 6.42::DOUBLE * miss END AS mimpact FROM g),
k AS (SELECT *, {_ROUND('least(CASE WHEN changed THEN 1.08::DOUBLE * (mimpact + mexploit) ELSE mimpact + mexploit END, 10.0::DOUBLE)')} AS mod_base FROM h),
env AS (SELECT ord, vector, app, external, CASE WHEN mimpact <= 0 THEN 0.0::DOUBLE ELSE {_ROUND('mod_base * 0.94::DOUBLE * 0.95::DOUBLE * 1.0::DOUBLE')} END AS env FROM k)"""


@_query(f"WITH {views.VECTORS}, {views.APPLICATIONS}, {_BASE}, {_ENV} SELECT ord, env, {_RATING('env')} AS rating FROM env")
def env_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, apps = views.vectors(spark, sf_dir), cmdb_inherit(spark, sf_dir)
    scored = cvss.with_environmental_score(v.join(apps, F.col("app").cast("string") == F.col("id")), "vector", ["external", "pci", "pan", "pii"], "env")
    return scored.select("ord", "env", cvss.rating(F.col("env")).alias("rating"))


_GATE_SUM = lambda share: " + ".join(f"max(CASE WHEN status != 'skip' AND gate = '{g}' THEN {share} * {w}::DOUBLE ELSE 0.0::DOUBLE END)" for g, w in aggregates.WEIGHTS.items())


@_query(f"""WITH {views.GATES}, w AS (SELECT *, CASE status WHEN 'pass' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS m FROM v_gates),
s AS (SELECT finding_id, count(*) AS n, count(DISTINCT gate) AS g, {_GATE_SUM('1.0::DOUBLE')} AS w, {_GATE_SUM('m')} AS e,
  count(*) FILTER (gate = 'no_new_vulnerabilities' AND status IN ('skip', 'invalid')) AS o, count(*) FILTER (gate = 'no_new_vulnerabilities' AND status IN ('partial', 'fail')) AS u FROM w GROUP BY 1),
r AS (SELECT *, g != 4 OR n != g OR o > 0 OR round(w, 6) < 0.5 AS bad FROM s),
t AS (SELECT *, CASE WHEN bad THEN 0.0::DOUBLE ELSE CAST(round(CAST(CAST(least(e / w, 1.0::DOUBLE) AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE) END AS score FROM r)
SELECT finding_id, score, CASE WHEN bad THEN 'UNVERIFIABLE' WHEN score >= 0.8 AND u = 0 THEN 'FIXED' WHEN score >= 0.5 THEN 'PARTIAL' ELSE 'NOT_FIXED' END AS label FROM t""")
def gate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.gate_score(views.gates(spark, sf_dir))


@_query(f"""WITH g AS ({ORACLES['gate_score']}), r AS (SELECT o_orderkey AS finding_id FROM orders), m AS (SELECT finding_id, coalesce(score, 0.0::DOUBLE) AS score, coalesce(label, 'UNVERIFIABLE') AS label FROM r LEFT JOIN g USING (finding_id))
SELECT *, CASE label WHEN 'FIXED' THEN 'Ready' WHEN 'PARTIAL' THEN 'Ready with Conditions' ELSE 'Not Ready' END AS readiness FROM m""")
def effective_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all findings asked for; those without gates fail closed."""
    return selection.effective_scores(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id")), gate_score(spark, sf_dir))


@_query(f"""WITH {views.FILES}, p AS (SELECT string_split(path, '/') AS parts FROM v_files), d AS (SELECT unnest(range(1, least(len(parts) - 1, 3) + 1)) AS n, parts FROM p)
SELECT array_to_string(parts[1:n], '/') AS directory, count(*) AS files FROM d GROUP BY 1""")
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.directory_rollup(views.files(spark, sf_dir).select("path"))


@_query(f"WITH {views.FILES}, e AS (SELECT regexp_extract(path, '\\.[^./]+$') AS ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars FROM v_files GROUP BY 1) SELECT * FROM e ORDER BY n DESC, ext LIMIT 40")
def ext_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).groupBy(F.regexp_extract("path", r"\.[^./]+$", 0).alias("ext")).agg(F.count("*").alias("n"), F.sum("size").alias("chars")).orderBy(F.desc("n"), "ext").limit(40)


@_query(f"""WITH {views.FILES}, l AS (SELECT lang, size AS v FROM v_files), o AS (SELECT lang, list(v ORDER BY v) AS vs, count(*) AS n FROM l GROUP BY 1)
SELECT lang, n, vs[1] AS least, vs[n // 2 + 1] AS p50, vs[CAST(least(n - 1, floor(0.9 * n)) AS BIGINT) + 1] AS p90, vs[n] AS most FROM o""")
def size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.positional_percentiles(views.files(spark, sf_dir), "lang", "size")


@_query(f"WITH {views.FILES}, c AS (SELECT source, lang, count(*) AS n, min(ord) AS f FROM v_files GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM c) SELECT source, lang AS value, n FROM r WHERE k = 1")
def dominant_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.dominant(views.files(spark, sf_dir), "source", "lang")


@_query("""WITH t AS (SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1) SELECT role, turns, chars, round(100.0::DOUBLE * chars / sum(chars) OVER (), 4) AS share FROM t""")
def token_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and characters of each role, and its share of all: totals come from a one-row join, not a window."""
    by = views.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    total = by.agg(F.sum("chars").alias("total"))
    return by.join(F.broadcast(total)).select("role", "turns", "chars", F.round(F.lit(100.0) * F.col("chars") / F.col("total"), 4).alias("share"))


@_query(f"""WITH {views.FILES}, n AS (SELECT path, size // 10 AS lines FROM v_files), s AS (SELECT path, lines, unnest(range(0, greatest(lines, 1), 500)) AS lo FROM n) SELECT path, lo, least(lo + 600, lines) AS hi FROM s""")
def sliding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tiles(views.files(spark, sf_dir).select("path", F.floor(F.col("size") / 10).alias("lines")))


@_query(f"""WITH {views.FINDINGS}, s AS (SELECT file, greatest(line_start - 30, 0) AS lo, least(line_start + 30, 1000 + user_id % 400) AS hi FROM v_findings WHERE line_start < 1000 + user_id % 400),
m AS (SELECT *, max(hi) OVER (PARTITION BY file ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR lo > b + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT file, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY file, k""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = 1000 + F.col("user_id") % 400
    return windows.merge_intervals(views.findings(spark, sf_dir).where(F.col("line_start") < lines).select("file", F.col("line_start").alias("line"), lines.alias("lines")), 30, 10)


@_query(f"""WITH RECURSIVE {views.FILES}, g AS (SELECT source, list({{'ord': ord, 'size': size}} ORDER BY ord) AS rows FROM v_files GROUP BY 1),
f AS (SELECT source, rows, 1 AS i, 0 AS shard, CAST(0 AS BIGINT) AS total, 0 AS n, CAST(NULL AS BIGINT) AS ord FROM g
  UNION ALL SELECT source, rows, i + 1, CASE WHEN fits THEN shard ELSE shard + 1 END, CASE WHEN fits THEN total + rows[i].size ELSE rows[i].size END, CASE WHEN fits THEN n + 1 ELSE 1 END, rows[i].ord
  FROM (SELECT *, n > 0 AND n < 12 AND total + rows[i].size <= 20000 AS fits FROM f WHERE i <= len(rows)))
SELECT source, ord, shard FROM f WHERE ord IS NOT NULL""")
def capacity_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_in_order(views.files(spark, sf_dir), "source", 20000, 12)


@_query(f"""WITH {views.FINDINGS}, d AS (SELECT file, line_start AS line, max('f' || CAST(ord AS VARCHAR)) AS name FROM v_findings WHERE ord % 4 = 0 GROUP BY ALL)
SELECT c.ord, c.file, c.line_start AS line, coalesce(d.name, '<module>') AS enclosing FROM v_findings c ASOF LEFT JOIN d ON c.file = d.file AND c.line_start >= d.line WHERE c.ord % 4 != 0""")
def asof_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir).withColumnRenamed("line_start", "line")
    definitions = f.where("ord % 4 = 0").groupBy("file", "line").agg(F.max(F.concat(F.lit("f"), F.col("ord").cast("string"))).alias("name"))
    return joins.as_of(f.where("ord % 4 != 0").select("file", "line", "ord"), definitions)


@_query(f"""WITH {views.FINDINGS}, p AS (SELECT DISTINCT file AS path FROM v_findings)
SELECT path, array_to_string(list_filter(['audit', CASE WHEN regexp_matches(path, '^(.*/)?u1.*\\.c$') THEN 'bounds' END, CASE WHEN regexp_matches(path, '^src/.*$') OR regexp_matches(path, '^.*\\.py$') THEN 'review' END], lambda x: x IS NOT NULL), ',') AS controls FROM p""")
def glob_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.findings(spark, sf_dir).select(F.col("file").alias("path")).distinct()
    return joins.glob_join(rows, "path", [("audit", []), ("bounds", ["**/u1*.c"]), ("review", ["src/*", "*.py"])]).select("path", F.array_join("controls", ",").alias("controls"))


@_query(f"""WITH {views.FILES}, asked AS (SELECT CASE WHEN ord % 3 = 0 THEN path WHEN ord % 3 = 1 THEN 'x/' || split_part(path, '/', 3) ELSE 'x/none' || CAST(ord AS VARCHAR) END AS path FROM v_files),
b AS (SELECT split_part(path, '/', 3) AS name, min(path) AS only FROM v_files GROUP BY 1 HAVING count(*) = 1)
SELECT a.path, coalesce(f.path, b.only) AS resolved, CASE WHEN f.path IS NOT NULL THEN 'exact' WHEN b.only IS NOT NULL THEN 'basename' ELSE 'none' END AS how FROM asked a LEFT JOIN v_files f ON a.path = f.path LEFT JOIN b ON regexp_extract(a.path, '[^/]*$') = b.name""")
def resolve_unique_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir).select("ord", "path")
    asked = f.select(F.when(F.col("ord") % 3 == 0, F.col("path")).when(F.col("ord") % 3 == 1, F.concat(F.lit("x/"), F.substring_index("path", "/", -1))).otherwise(F.concat(F.lit("x/none"), F.col("ord").cast("string"))).alias("path"))
    return joins.resolve_unique(asked, f)


@_query(f"""WITH RECURSIVE {views.EDGES}, reach(start, node, hops) AS (SELECT DISTINCT caller, caller, 0 FROM v_edges WHERE caller NOT IN (SELECT callee FROM v_edges) UNION SELECT r.start, e.callee, r.hops + 1 FROM reach r JOIN v_edges e ON r.node = e.caller WHERE r.hops < 4)
SELECT start, node, min(hops) AS hops FROM reach GROUP BY ALL""")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir)
    entries = e.select(F.col("caller").alias("start")).join(e.select(F.col("callee").alias("start")), "start", "left_anti").distinct()
    return graph.hops(e, entries, 4)


@_query(f"""WITH RECURSIVE {views.EDGES}, b AS (SELECT caller AS x, callee AS y FROM v_edges UNION SELECT callee, caller FROM v_edges), r(node, other) AS (SELECT x, x FROM b UNION SELECT r.node, b.y FROM r JOIN b ON r.other = b.x)
SELECT node, min(other) AS component FROM r GROUP BY 1""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(views.edges(spark, sf_dir))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_n_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@_query("""WITH r AS (SELECT o_orderkey AS ord, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) SELECT ord, rank FROM r WHERE rank > 5 OR o_orderdate < TIMESTAMP '1994-01-01'""")
def retention_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), "o_custkey", F.col("o_orderdate").alias("updated_at"))
    return windows.retain(rows, "o_custkey", 5, F.lit("1994-01-01").cast("timestamp")).select("ord", "rank")


_RAW = ["95%", "7", "1.2", "NaN", "-3", "high", " 0.4 ", "", "7%", "1%", "2.5", "10", "10.5", "100", "101", "1e1", "inf", "50 %%"]


@_query(f"""WITH r AS (SELECT event_id AS ord, CASE event_id % 3 WHEN 0 THEN {parsing.sql_pick(_RAW, 'event_id // 3')} WHEN 1 THEN CAST(event_id % 130 AS VARCHAR) || '.' || CAST(event_id // 130 % 10 AS VARCHAR) ELSE CAST(event_id % 130 AS VARCHAR) || '%' END AS raw FROM events),
t AS (SELECT *, trim(regexp_replace(trim(raw), '%+$', '')) AS text FROM r), v AS (SELECT *, CASE WHEN regexp_matches(text, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST(text AS DOUBLE) END AS v FROM t)
SELECT ord, raw, CASE WHEN v IS NULL THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN v >= 2 AND v <= 10 AND v = floor(v) THEN v / 10 WHEN v >= 2 AND v <= 100 THEN v / 100 ELSE v END)) END AS confidence FROM v""")
def coerce_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    number = (n % 130).cast("string")
    raw = F.when(n % 3 == 0, parsing.pick(_RAW, F.expr("event_id div 3"))).when(n % 3 == 1, F.concat(number, F.lit("."), F.expr("cast(event_id div 130 % 10 as string)"))).otherwise(F.concat(number, F.lit("%")))
    return views.table(spark, sf_dir, "events").select(n.alias("ord"), raw.alias("raw")).withColumn("confidence", coerce.confidence(F.col("raw")))


@_query(f"""WITH {views.FINDINGS}, {views.INVENTORY}, {views.APPLICATIONS}, {_VOTED}, f AS (SELECT * FROM voted), 
gated AS (SELECT f.*, {_REASON} AS reason FROM f LEFT JOIN v_inventory i ON f.file = i.file),
s AS (SELECT g.ord, g.file, g.vuln_class, g.votes, g.confidence, coalesce(a.external, false) AS external, CASE WHEN a.external THEN 1 ELSE 2 END AS tier FROM gated g LEFT JOIN v_inherited a ON CAST(g.ord % 100 + 1 AS VARCHAR) = a.id WHERE reason IS NULL)
SELECT * FROM s ORDER BY tier, confidence DESC, ord LIMIT 50""")
def vote_collapse_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: votes, gates, application context, and the top 50."""
    gated = filters.gate_cascade(votes.quorum(views.findings(spark, sf_dir)), views.inventory(spark, sf_dir)).where("reason is null")
    apps = cmdb_inherit(spark, sf_dir).select("id", "external")
    met = gated.join(apps, (F.col("ord") % 100 + 1).cast("string") == F.col("id"), "left")
    out = met.select("ord", "file", "vuln_class", "votes", "confidence", F.coalesce("external", F.lit(False)).alias("external"), F.when(F.col("external"), 1).otherwise(2).alias("tier"))
    return out.orderBy("tier", F.desc("confidence"), "ord").limit(50)


for _name, (_f, _sql) in (texts.QUERIES | reports.QUERIES | parsing.QUERIES | records.QUERIES | matching.QUERIES | coverage.QUERIES | judging.QUERIES | flows.QUERIES | code.QUERIES | documents.QUERIES | values.QUERIES | streams.QUERIES | markdown_reports.QUERIES).items():
    QUERIES[_name] = _f
    if _sql:
        ORACLES[_name] = _sql

ORACLES["report_notes"] = documents.report_notes_sql(_BASE, _ENV, _RATING)
