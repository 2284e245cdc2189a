"""Queries over reviewers' answers and ranked findings.

The test tables hold no such texts, so each view writes one for each row, out of parts that meet the edges of
its rule.  The SQL reads the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import answers, priority
from sievemill.operators import joins, ranking
from sievemill.plans import views

QUERIES: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def pick(parts: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in parts]), (number % len(parts) + 1).cast("int"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_pick(parts: list[str], number: str) -> str:
    return "[" + ", ".join(map(_text, parts)) + f"][CAST(({number}) % {len(parts)} + 1 AS INT)]"


_VECTOR = "CVSS:3.1/AV:{}/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
_HEAD = ["I read it.\n", "VERDICT: FALSE_POSITIVE (confidence: 2/10) - at first\nBut then:\n", "", f"{_VECTOR.format('L')} was claimed, then {_VECTOR.format('P')}\n"]
_VERDICT = ["VERDICT: TRUE_POSITIVE (confidence: 9/10) - reachable", "verdict: false_positive (confidence: 4 / 10): not reached", "**VERDICT: TRUE_POSITIVE (confidence: 10/10)", "VERDICT: TRUE_POSITIVE (confidence: 55/10)", "no verdict here", "VERDICT: TRUE_POSITIVE"]
_TAIL = ["", f"\nCVSS: {_VECTOR.format('N')} or {_VECTOR.format('A')}", "\n  \n"]
_RX = answers.VERDICT_LINE.replace("'", "''")


@_query(f"""WITH t AS (SELECT event_id AS ord, {sql_pick(_HEAD, 'event_id')} || {sql_pick(_VERDICT, 'event_id // 4')} || {sql_pick(_TAIL, 'event_id // 24')} AS text FROM events),
l AS (SELECT ord, text, string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)) AS lines FROM t),
a AS (SELECT *, list_max(list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '{_RX}'))) AS k FROM l),
b AS (SELECT *, lines[k] AS line, coalesce(k, len(lines) + 1) AS f FROM a),
c AS (SELECT *, regexp_extract(array_to_string(lines[f:], chr(10)), '{answers.VECTOR}') AS one, regexp_extract_all(text, '{answers.VECTOR}') AS every FROM b)
SELECT ord, CASE WHEN k IS NULL THEN 'FALSE_POSITIVE' ELSE upper(regexp_extract(line, '{_RX}', 1)) END AS verdict, CASE WHEN k IS NULL THEN 0 ELSE least(CAST(regexp_extract(line, '{_RX}', 2) AS INT), 10) END AS confidence,
  CASE WHEN k IS NULL THEN '{answers.NO_VERDICT}' WHEN trim(regexp_extract(line, '{_RX}', 3)) = '' THEN '{answers.NO_REASON}' ELSE trim(regexp_extract(line, '{_RX}', 3)) END AS reason,
  CASE WHEN one != '' THEN one WHEN len(every) > 0 THEN every[len(every)] END AS vector, regexp_replace(array_to_string(lines[1:f - 1], chr(10)), '^\\s+|\\s+$', '', 'g') AS reasoning FROM c""")
def verifier_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.concat(pick(_HEAD, n), pick(_VERDICT, F.expr("event_id div 4")), pick(_TAIL, F.expr("event_id div 24")))
    return answers.verdicts(views.table(spark, sf_dir, "events").select(n.alias("ord"), text.alias("text"))).drop("text")


_DUPES = ['index=5 is_duplicate=true canonical=2 reasoning="same sink"', 'INDEX = 7  is_duplicate = True canonical = 1 reasoning = " padded "', 'index=3 is_duplicate=true canonical=8 reasoning="later"', 'index=4 is_duplicate=false canonical=1 reasoning="no"', 'index=6 is_duplicate=true canonical=-1 reasoning="none"', '- index=9 is_duplicate=true canonical=0 reasoning="" and more', 'index=99 is_duplicate=true canonical=0 reasoning="beyond"']


@_query(f"""WITH t AS (SELECT event_id AS ord, {sql_pick(_DUPES, 'event_id')} || chr(10) || {sql_pick(_DUPES, 'event_id // 7')} AS text FROM events),
l AS (SELECT ord, unnest(regexp_extract_all(text, '{answers.DUPLICATE_LINE}', 0)) AS line FROM t),
p AS (SELECT ord, CAST(regexp_extract(line, '{answers.DUPLICATE_LINE}', 1) AS BIGINT) AS dup, lower(regexp_extract(line, '{answers.DUPLICATE_LINE}', 2)) AS yes, CAST(regexp_extract(line, '{answers.DUPLICATE_LINE}', 3) AS BIGINT) AS canonical, trim(regexp_extract(line, '{answers.DUPLICATE_LINE}', 4)) AS reasoning FROM l)
SELECT ord, dup, canonical, reasoning FROM p WHERE yes = 'true' AND canonical >= 0 AND canonical < dup AND dup < 20""")
def dedup_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.concat(pick(_DUPES, n), F.lit("\n"), pick(_DUPES, F.expr("event_id div 7")))
    return answers.duplicate_lines(views.table(spark, sf_dir, "events").select(n.alias("ord"), text.alias("text")), 20)


_BEFORE = ["", "Here it is:\n", "```json\n", "Some {text} first. "]
_BODY = ['{"id": 7, "name": "a"}', '{"id": 8, "name": "b } c"}', '{"id": 9, "name": "say \\"hi\\""}', '[{"id": 10, "name": "d"}]', "none at all", '{"id": 11, "name": ', '{"id": 12, "name": "\\d+"}']
_AFTER = ["", "\n```", "\nThat is all."]


@_query("""WITH t AS (SELECT event_id AS ord, event_id // 4 % 7 AS b FROM events)
SELECT ord, CASE b WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 9 WHEN 3 THEN 10 WHEN 6 THEN 12 END AS id, CASE b WHEN 0 THEN 'a' WHEN 1 THEN 'b } c' WHEN 2 THEN 'say "hi"' WHEN 3 THEN 'd' WHEN 6 THEN '\\d+' END AS name FROM t""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.concat(pick(_BEFORE, n), pick(_BODY, F.expr("event_id div 4")), pick(_AFTER, F.expr("event_id div 28")))
    found = answers.json_in_prose(views.table(spark, sf_dir, "events").select(n.alias("ord"), text.alias("text")))
    each = lambda key: F.coalesce(F.get_json_object("json", f"$.{key}"), F.get_json_object("json", f"$[0].{key}"))
    return found.select("ord", each("id").cast("int").alias("id"), each("name").alias("name"))


_SEVERITIES, _PRIORITIES = ["Critical", "high", "MEDIUM", "low", "info"], ["P2", "p1", "", "P10", "P3", "unset"]


@_query(f"""WITH r AS (SELECT event_id AS ord, lower({sql_pick(_SEVERITIES, 'event_id * 7 // 3')}) AS s, upper({sql_pick(_PRIORITIES, 'event_id')}) AS p FROM events),
k AS (SELECT ord, list_position(['critical', 'high', 'medium', 'low', 'info'], s) AS band, CASE WHEN regexp_full_match(p, 'P[0-9]') THEN CAST(p[2:] AS INT) ELSE 9 END AS prio FROM r)
SELECT ord, CAST(row_number() OVER (ORDER BY band, prio, ord) AS INT) AS place FROM k QUALIFY place <= 300""")
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("ord"), pick(_SEVERITIES, F.expr("event_id * 7 div 3")).alias("severity"), pick(_PRIORITIES, F.col("event_id")).alias("priority"))
    return ranking.by_severity(rows, 300).select("ord", "place")


@_query(f"""WITH RECURSIVE {views.FINDINGS}, g AS (SELECT *, ord - 1 - ord % 5 AS canonical FROM v_findings WHERE ord % 3 = 0 AND ord > 5),
w(dup, root) AS (SELECT ord, canonical FROM g UNION ALL SELECT w.dup, g.canonical FROM w JOIN g ON w.root = g.ord),
t AS (SELECT dup, min(root) AS root FROM w GROUP BY 1)
SELECT t.root AS ord, min(t.dup) AS dup, d.file, d.line_start, d.line_end FROM t JOIN v_findings d ON t.dup = d.ord JOIN v_findings r ON t.root = r.ord
WHERE NOT (d.file = r.file AND d.line_start <= r.line_end AND r.line_start <= d.line_end) GROUP BY t.root, d.file, d.line_start, d.line_end""")
def attach_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir)
    links = f.where("ord % 3 = 0 and ord > 5").select(F.col("ord").alias("dup"), (F.col("ord") - 1 - F.col("ord") % 5).alias("canonical"))
    return ranking.attach(f.select("ord", "file", "line_start", "line_end"), links)


_TITLES = ["Overflow in parser", "Unauthenticated upload", "Hardcoded password for the db", "Needs VPN", "Requires admin rights", "Any registered user can read"]
_CATEGORIES = ["injection", "", "Hardcoded-Secret", "auth"]
_NOTES = ["", "the public endpoint is anonymous", "runs on localhost", "after self-registration", "an admin user may"]
_HAS = lambda words: f"regexp_matches(body, '{priority.pattern(words)}')"
_METRIC = lambda name, lack: f"coalesce(nullif(regexp_extract(vector, '(^|/){name}:([A-Z])', 2), ''), '{lack}')"


@_query(f"""WITH {views.VECTORS}, {views.APPLICATIONS},
x AS (SELECT v.ord, CASE WHEN v.ord % 9 = 0 THEN '' WHEN v.ord % 9 = 1 THEN replace(v.vector, '/PR:', '/XX:') ELSE v.vector END AS vector, {sql_pick(_TITLES, 'v.ord')} AS title, {sql_pick(_CATEGORIES, 'v.ord // 3')} AS category, {sql_pick(_NOTES, 'v.ord // 7')} AS note, CASE WHEN v.ord % 4 != 0 THEN a.external END AS external FROM v_vectors v LEFT JOIN v_inherited a ON CAST(v.app AS VARCHAR) = a.id),
b AS (SELECT *, lower(concat_ws(' ', title, nullif(category, ''), nullif(note, ''))) AS body, {_METRIC('AV', 'N')} AS av, {_METRIC('PR', 'L')} AS pr, {_METRIC('AC', 'L')} AS ac, regexp_matches(vector, '(^|/)PR:[A-Z]') AS explicit FROM x),
c AS (SELECT *, {_HAS(priority.CODE_KNOWLEDGE)} OR contains(lower(category), 'hardcoded') AS code, coalesce(NOT external, false) AS inside, pr = 'H' OR {_HAS(priority.HIGH_PRIVILEGE)} AS high, {_HAS(priority.OBTAINABLE)} OR pr = 'L' AS obtainable FROM b),
d AS (SELECT *, inside OR av != 'N' OR {_HAS(priority.INTERNAL)} AS internal, NOT (explicit AND pr IN ('L', 'H')) AND ({_HAS(priority.NO_LOGIN)} OR (pr = 'N' AND NOT obtainable AND NOT high)) AS free FROM c),
e AS (SELECT *, CASE WHEN code THEN 'P4' WHEN external IS NULL AND av = 'N' AND NOT internal AND NOT high THEN 'unknown' WHEN NOT (av = 'N' AND NOT internal AND coalesce(external, false)) OR high THEN 'P3' WHEN free THEN 'P1' ELSE 'P2' END AS p FROM d)
SELECT ord, CASE p WHEN 'unknown' THEN 'P3' ELSE p END AS priority, concat_ws('; ',
  CASE p WHEN 'P4' THEN 'requires source-code / insider knowledge' WHEN 'unknown' THEN 'exposure unverified — no CMDB context' WHEN 'P1' THEN 'internet-facing (CMDB)' WHEN 'P2' THEN 'internet-facing (CMDB)' END,
  CASE p WHEN 'P4' THEN CASE WHEN inside THEN 'app not externally facing (CMDB)' WHEN av != 'N' THEN 'AV:' || av END WHEN 'unknown' THEN 'AV:' || av || ' (network-routable; internet exposure unconfirmed)'
    WHEN 'P3' THEN CASE WHEN inside THEN 'app not externally facing (CMDB)' WHEN av != 'N' THEN 'AV:' || av || ' (non-network)' WHEN internal THEN 'internal-network position required' END
    WHEN 'P1' THEN 'AV:' || av || ' - unauthenticated' || CASE WHEN explicit THEN ' (PR:' || pr || ')' ELSE '' END ELSE 'PR:' || pr || ' - auth required but obtainable' END,
  CASE WHEN p = 'P3' AND high THEN CASE WHEN pr = 'H' THEN 'PR:H - high-privilege auth required' ELSE 'admin/privileged role required' END END,
  CASE WHEN p IN ('P1', 'P2') AND ac = 'H' THEN 'AC:H - complex preconditions' END) AS reason FROM e""")
def priority_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure tier of a finding by vector, wording and application, with the reason in words."""
    apps = joins.inherit(views.applications(spark, sf_dir), views.parents(spark, sf_dir), "id", "parent_id", ["external", "pci", "pan", "pii"]).select("id", F.col("external").alias("known"))
    v = views.vectors(spark, sf_dir).join(apps, F.col("app").cast("string") == F.col("id"), "left")
    n = F.col("ord")
    vector = F.when(n % 9 == 0, "").when(n % 9 == 1, F.replace(F.col("vector"), F.lit("/PR:"), F.lit("/XX:"))).otherwise(F.col("vector"))
    rows = v.select("ord", vector.alias("vector"), pick(_TITLES, n).alias("title"), pick(_CATEGORIES, F.expr("ord div 3")).alias("category"), pick(_NOTES, F.expr("ord div 7")).alias("note"), F.when(n % 4 != 0, F.col("known")).alias("external"))
    return priority.tiered(rows, "ord", ["title", "category", "note", "vector", "external"])
