"""Queries on paths through call graphs: a graph between functions, its entries, sinks and files, for each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.operators import chunks, paths
from sievemill.plans import views
from sievemill.plans.matching import _q, _s
from sievemill.plans.parsing import pick
from sievemill.plans.records import _sql_pick

_NODE = "src/m{%s %% 5}/f{%s %% 23}.c::fn{%s}"
_FILE = "src/m{%s %% 5}/f{%s %% 23}.c"


def _node(n: str, text: str = _NODE) -> str:
    return text.replace("%s", f"({n})").replace("%%", "%")


_STEPS = [("n", "n div 2 + c_nationkey % 3", "true"), ("n", "n + 1", "n % 3 = 0"), ("n", "n * 2 % 31", "n % 5 = 4")]
_PLACE = "m{n % 5}/f{n % 23}.c"
_KINDS = ["network", "cli", "file"]


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges with cycles and ties, entries that are named in full, by an ending, or not in the graph, sinks and files."""
    c = views.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("scope"), F.expr("c_custkey div 4").alias("n"), "c_nationkey")
    kinds = [c.where(when).select("scope", _s(_node(a)).alias("caller"), _s(_node(b)).alias("callee")) for a, b, when in _STEPS]
    edges = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    k = F.col("s_suppkey")
    s = views.table(spark, sf_dir, "supplier").select((k % 4).alias("scope"), k.alias("ord"), (k * 3 % 41).alias("n"))
    file = F.when(k % 7 == 5, "other/x.c").when(k % 3 == 0, _s(_PLACE)).otherwise(F.concat(F.lit("src/"), _s(_PLACE)))
    entries = s.withColumn("s_suppkey", F.col("ord")).select("scope", "ord", file.alias("file"), _s("fn{n}").alias("function"), pick(_KINDS, k).alias("kind"), F.when(k % 5 != 0, k % 2 == 0).alias("open"))
    m = F.col("n_nationkey").cast("long")
    place = F.when(m % 6 == 5, "other/x.c").otherwise(F.concat(F.lit("src/"), _s(_PLACE)))
    sinks = views.table(spark, sf_dir, "nation").withColumn("n", F.expr("cast(n_nationkey div 4 * 2 as long)")).select((m % 4).alias("scope"), m.alias("ord"), place.alias("file"), F.when(m % 9 == 8, None).when(m % 6 == 5, "gn").otherwise(_s("fn{n}")).alias("function"), (m * 7).alias("line"))
    files = c.where("n % 23 != 7").select("scope", _s(_node("n", _FILE)).alias("path"), F.expr("n % 23 * 150").alias("loc")).distinct()
    more = c.select("scope", F.lit("other/x.c").alias("path"), F.lit(9).cast("long").alias("loc")).distinct()
    return edges, entries, sinks, files.unionByName(more)


def sink_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node that calls is a start."""
    edges, _, sinks, _ = graph_tables(spark, sf_dir)
    goals = sinks.where("function is not null").select("scope", F.concat_ws("::", "file", "function").alias("node"))
    out = paths.first_paths(edges, edges.select("scope", F.col("caller").alias("start")), goals, 6)
    return out.select("scope", "start", "sink", "place", F.array_join("path", " ").alias("path"))


def path_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.path_chunks(*graph_tables(spark, sf_dir), most_hops=5, most=30)
    return out.select("scope", "rank", "id", "entry", "sink", F.array_join("path", " ").alias("path"), F.array_join("files", " ").alias("files"), "sinks", "size", "hypothesis")


_QS = lambda n, text=_NODE: _q(_node(n, text))
_EDGES = "c AS (SELECT c_custkey % 4 AS scope, c_custkey // 4 AS n, c_nationkey FROM customer),\nedges AS (" + " UNION ".join(f"SELECT scope, {_QS(a)} AS caller, {_QS(b)} AS callee FROM c WHERE {when}" for a, b, when in _STEPS) + ")"
_SINKS = f"""sinks AS (SELECT n_nationkey % 4 AS scope, CAST(n_nationkey AS BIGINT) AS ord, CASE WHEN n_nationkey % 6 = 5 THEN 'other/x.c' ELSE 'src/' || {_q(_PLACE)} END AS file,
  CASE WHEN n_nationkey % 9 = 8 THEN NULL WHEN n_nationkey % 6 = 5 THEN 'gn' ELSE 'fn' || n END AS function, n_nationkey * 7 AS line FROM (SELECT *, n_nationkey // 4 * 2 AS n FROM nation))"""


def _search(most: int) -> str:
    """Breadth-first search with whole paths and the list of what a start has seen in one row for each level."""
    return f"""bfs AS (SELECT DISTINCT scope, start, 0 AS level, [{{'node': start, 'path': [start]}}] AS front, [start] AS seen FROM starts
  UNION ALL SELECT scope, start, level + 1, list({{'node': callee, 'path': p}}), list_concat(seen, list(callee)) FROM
    (SELECT b.scope, b.start, b.level, b.seen, e.callee, min(list_append(f.x.path, e.callee)) AS p FROM bfs b, unnest(b.front) AS f(x), edges e
      WHERE b.level < {most} AND e.scope = b.scope AND e.caller = f.x.node AND NOT list_contains(b.seen, e.callee) GROUP BY ALL) GROUP BY scope, start, level, seen),
met AS (SELECT scope, start, level, x.node AS sink, x.path AS path FROM (SELECT scope, start, level, unnest(front) AS x FROM bfs WHERE level > 0)),
hits AS (SELECT *, row_number() OVER (PARTITION BY scope, start ORDER BY level, path) AS place FROM met WHERE (scope, sink) IN (SELECT scope, node FROM goals))"""


_OF = lambda rows: f"""SELECT t.*, coalesce(n.node, t.file || '::' || t.function) AS node FROM {rows} t LEFT JOIN nodes n ON n.scope = t.scope AND n.name = t.function
  AND CASE WHEN EXISTS (SELECT 1 FROM nodes o WHERE o.scope = t.scope AND o.name = t.function AND o.file = t.file) THEN n.file = t.file ELSE ends_with(n.file, '/' || t.file) OR ends_with(t.file, '/' || n.file) END WHERE t.function IS NOT NULL"""  # noqa: E731
_LAST = lambda c: f"split_part({c}, '::', -1)"
_FIRST = lambda c: f"split_part({c}, '::', 1)"

QUERIES = {
    "sink_paths": (sink_paths, f"""WITH RECURSIVE {_EDGES}, {_SINKS}, goals AS (SELECT scope, file || '::' || function AS node FROM sinks WHERE function IS NOT NULL), starts AS (SELECT DISTINCT scope, caller AS start FROM edges), {_search(6)}
SELECT scope, start, sink, place, array_to_string(path, ' ') AS path FROM hits"""),
    "path_chunks": (path_chunks, f"""WITH RECURSIVE {_EDGES}, {_SINKS},
entries AS (SELECT s_suppkey % 4 AS scope, s_suppkey AS ord, CASE WHEN s_suppkey % 7 = 5 THEN 'other/x.c' WHEN s_suppkey % 3 = 0 THEN {_q(_PLACE)} ELSE 'src/' || {_q(_PLACE)} END AS file, 'fn' || n AS function, {_sql_pick(_KINDS, 's_suppkey')} AS kind,
  coalesce(s_suppkey % 5 != 0 AND s_suppkey % 2 = 0, false) AS open FROM (SELECT *, s_suppkey * 3 % 41 AS n FROM supplier)),
files AS (SELECT DISTINCT scope, {_QS('n', _FILE)} AS path, n % 23 * 150 AS loc FROM c WHERE n % 23 != 7 UNION SELECT DISTINCT scope, 'other/x.c', 9 FROM c),
nodes AS (SELECT scope, node, {_FIRST('node')} AS file, {_LAST('node')} AS name FROM (SELECT scope, caller AS node FROM edges UNION SELECT scope, callee FROM edges)),
begun AS ({_OF('entries')}), ends AS ({_OF('sinks')}), goals AS (SELECT DISTINCT scope, node FROM ends), starts AS (SELECT DISTINCT scope, node AS start FROM begun), {_search(5)},
reached AS (SELECT b.*, h.sink, h.path, b.node AS a, h.place AS b FROM begun b JOIN hits h ON h.scope = b.scope AND h.start = b.node),
paired AS (SELECT scope, ord, file, function, kind, open, sink, path, a, b FROM reached
  UNION ALL SELECT e.scope, e.ord, e.file, e.function, e.kind, e.open, s.file || '::' || coalesce(s.function, 'None'), [e.file || '::' || e.function, s.file || '::' || coalesce(s.function, 'None')], '', s.ord
  FROM entries e JOIN sinks s ON s.scope = e.scope AND s.file = e.file WHERE (e.scope, e.ord) NOT IN (SELECT scope, ord FROM reached)),
here AS (SELECT scope, node, list(file ORDER BY ord) AS fs, array_to_string(list(file || ':' || line ORDER BY ord)[1:3], ', ') AS refs FROM ends GROUP BY ALL),
asked AS (SELECT paired.*, row_number() OVER () AS k, refs, list_concat(list_transform(path, lambda p: {_FIRST('p')}), [file], coalesce(fs, [{_FIRST('sink')}])) AS fs FROM paired LEFT JOIN here ON here.scope = paired.scope AND here.node = sink),
parts AS (SELECT k, scope, unnest(fs) AS path, generate_subscripts(fs, 1) AS i FROM asked),
known AS (SELECT k, list(path ORDER BY i) AS files, sum(loc) AS loc FROM (SELECT p.k, p.path, min(i) AS i, any_value(f.loc) AS loc FROM parts p JOIN files f ON f.scope = p.scope AND f.path = p.path GROUP BY 1, 2) GROUP BY 1),
once AS (SELECT a.*, x.files, x.loc, row_number() OVER (PARTITION BY scope, function, sink, list_sort(files) ORDER BY NOT open, kind, ord, a, b) AS nth FROM asked a JOIN known x ON x.k = a.k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY NOT open, kind, ord, a, b) AS rank, coalesce(refs, {_FIRST('sink')}) AS said, array_to_string(list_transform(path, lambda p: {_LAST('p')}), ' ') AS steps FROM once WHERE nth = 1)
SELECT scope, rank, 'taint-' || lpad(CAST(rank AS VARCHAR), 2, '0') AS id, ord AS entry, sink, steps AS path, array_to_string(files, ' ') AS files, said AS sinks, CASE WHEN loc < 2000 THEN 'small' WHEN loc < 8000 THEN 'medium' ELSE 'large' END AS size,
  'Taint path: ' || CASE WHEN open THEN 'UNAUTH ' ELSE '' END || kind || ' input at ' || function || '() [' || file || '] flows via ' || replace(steps, ' ', ' -> ') || ' to sink ' || {_LAST('sink')} || '() [' || said || ']. Verify every hop for sanitization/validation; if none, this is exploitable.' AS hypothesis
FROM ranked WHERE rank <= 30"""),
}


_OF_DOC = "src/{lang}/p{doc_id % 7}/f{doc_id}.c"


def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a file for each document; some files belong to modules, some call one of their chunk."""
    n = F.col("doc_id")
    d = views.table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), _s("c{doc_id % 5}").alias("chunk"), n.alias("ord"), _s(_OF_DOC).alias("path"), F.expr("n_chars div 20").alias("loc"), F.col("n_chars").alias("chars"))
    modules = d.where("ord % 6 < 2").select("scope", (F.col("ord") % 6).alias("ord"), (-F.col("ord")).alias("place"), "path")
    edges = d.select("scope", F.col("ord").alias("k"), F.col("path").alias("caller")).where("k % 3 != 0").join(d.select("scope", (F.col("ord") + 100).alias("k"), F.col("path").alias("callee")), ["scope", "k"])
    out = chunks.split(d, modules, edges, 250, 4)
    return out.select("scope", "id", F.array_join("files", " ").alias("files"), "loc", "size")


QUERIES["split_chunks"] = (split_chunks, f"""WITH RECURSIVE d AS (SELECT source AS scope, 'c' || doc_id % 5 AS chunk, doc_id AS n, {_q(_OF_DOC)} AS path, n_chars // 20 AS loc FROM documents),
t AS (SELECT scope, chunk, sum(loc) <= 250 AND count(*) <= 4 AS fits FROM d GROUP BY ALL), l AS (SELECT d.* FROM d JOIN t USING (scope, chunk) WHERE NOT fits),
e AS (SELECT a.scope, a.n AS x, b.n AS y FROM d a JOIN d b ON a.scope = b.scope AND b.n = a.n - 100 WHERE a.n % 3 != 0), every AS (SELECT * FROM e UNION SELECT scope, y, x FROM e),
i AS (SELECT b.* FROM every b JOIN l a ON a.n = x JOIN l c ON c.n = y WHERE a.n % 6 >= 2 AND c.n % 6 >= 2 AND a.chunk = c.chunk),
r(x, y) AS (SELECT n, n FROM l WHERE n % 6 >= 2 AND n IN (SELECT x FROM every) UNION SELECT r.x, i.y FROM r JOIN i ON i.x = r.y), c AS (SELECT r.x AS n, min(l.path) AS component FROM r JOIN l ON l.n = r.y GROUP BY 1),
g AS (SELECT l.*, CASE WHEN n % 6 < 2 THEN 0 WHEN component IS NOT NULL THEN 1 ELSE 2 END AS kind, CASE WHEN n % 6 < 2 THEN n % 6 ELSE 0 END AS m, CASE WHEN n % 6 < 2 THEN '' ELSE coalesce(component, split_part(path, '/', 1) || '/' || split_part(path, '/', 2)) END AS label, CASE WHEN n % 6 < 2 THEN -n ELSE 0 END AS place FROM l LEFT JOIN c USING (n)),
f AS (SELECT scope, chunk, kind, m, label, list({{'p': path, 'loc': loc}} ORDER BY place, path) AS rows FROM g GROUP BY ALL),
s AS (SELECT *, 1 AS i, 0 AS shard, CAST(0 AS HUGEINT) AS total, 0 AS k, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS loc FROM f
  UNION ALL SELECT scope, chunk, kind, m, label, rows, i + 1, CASE WHEN fits THEN shard ELSE shard + 1 END, CASE WHEN fits THEN total + rows[i].loc ELSE rows[i].loc END, CASE WHEN fits THEN k + 1 ELSE 1 END, rows[i].p, rows[i].loc FROM (SELECT *, k > 0 AND k < 4 AND total + rows[i].loc <= 250 AS fits FROM s WHERE i <= len(rows))),
p AS (SELECT scope, chunk, path, loc, i, kind, dense_rank() OVER (PARTITION BY scope, chunk ORDER BY kind, m, label, shard) AS part FROM s WHERE path IS NOT NULL),
o AS (SELECT scope, chunk || '-' || CASE WHEN part <= 26 THEN chr(CAST(96 + part AS INT)) ELSE CAST(part AS VARCHAR) END AS id, string_agg(path, ' ' ORDER BY i) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM p GROUP BY scope, chunk, part
  UNION ALL SELECT scope, chunk, string_agg(path, ' ' ORDER BY n), CAST(sum(loc) AS BIGINT) FROM d JOIN t USING (scope, chunk) WHERE fits GROUP BY 1, 2)
SELECT *, CASE WHEN loc < 2000 THEN 'small' WHEN loc < 8000 THEN 'medium' ELSE 'large' END AS size FROM o""")  # fmt: skip
