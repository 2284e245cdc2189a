"""Queries over counts, sets, orders and names of findings and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.functions import names
from sievemill.operators import graph, sets
from sievemill.plans import views
from sievemill.streaming import reconcile


def loc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines by language, of all files and of those in scope."""
    loc = F.size(F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^ \t\r\f\v]")))).cast("long")
    f = views.files(spark, sf_dir).where("text is not null").select("lang", loc.alias("loc"), (~F.startswith(F.col("path"), F.lit("Vendor/"))).alias("scoped"))
    return f.groupBy("lang").agg(F.sum("loc").alias("loc"), F.sum(F.when(F.col("scoped"), F.col("loc")).otherwise(0)).alias("scoped_loc"))


def scope_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and a quarter of the bytes as tokens, of the listed extensions."""
    f = views.files(spark, sf_dir).where(F.col("path").rlike(r"\.(c|md)$")).select(F.octet_length("text").cast("long").alias("bytes"))
    return f.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("tokens", F.expr("bytes div 4"))


def run_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the inventory and share of confident findings by run, in per cent."""
    f, seen = views.findings(spark, sf_dir), views.inventory(spark, sf_dir).withColumn("known", F.lit(True))
    met = f.join(seen, "file", "left").groupBy("run").agg(F.count("*").alias("n"), F.count_if("known").alias("covered"), F.count_if(F.col("confidence") >= 0.6).alias("sure"))
    return met.select("run", "n", names.ratio(F.col("covered"), F.col("n")).alias("coverage_pct"), names.ratio(F.col("sure"), F.col("n")).alias("precision_pct"))


def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as repositories of a customer: done, failed and how many days they span."""
    o = views.table(spark, sf_dir, "orders")
    span = F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long")
    return o.groupBy(F.col("o_custkey").alias("app")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("ok"), F.count_if(F.col("o_orderstatus") != "F").alias("failed"), span.alias("days"))


def cmdb_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose documents come in different languages."""
    return sets.conflicts(views.table(spark, sf_dir, "documents").select("source", "lang"), "source", ["lang"])


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order in which findings first name them."""
    return sets.first_seen(views.findings(spark, sf_dir), ["file"], "ord")


def unseen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with findings that the inventory lacks, with their number of findings."""
    out = sets.without(views.findings(spark, sf_dir).select("file"), views.inventory(spark, sf_dir), ["file"])
    return out.groupBy("file").agg(F.count("*").alias("n"))


def inventory_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the inventory that have a sure finding."""
    return views.inventory(spark, sf_dir).intersect(views.findings(spark, sf_dir).where("confidence >= 0.9").select("file"))


def drop_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops of two steps in one table; a finding that fails both comes twice."""
    f = views.findings(spark, sf_dir)
    low = f.where("confidence < 0.3").select("ord", F.lit("prefilter").alias("stage"), "confidence")
    test = f.where(F.startswith(F.col("file"), F.lit("tests/"))).select("ord", F.lit("scope").alias("stage"))
    return low.unionByName(test, allowMissingColumns=True)


def signature_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer with the same status and the same set of line numbers."""
    items = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("lines"))
    o = views.table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("ord"), "o_custkey", "o_orderstatus", "lines")
    return sets.first_by_signature(o, ["o_custkey", "o_orderstatus"], "lines", "ord").select("ord", "o_custkey", "o_orderstatus")


def per_run_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three surest findings of each file and run."""
    order = Window.partitionBy("file", "run").orderBy(F.desc("confidence"), "ord")
    return views.findings(spark, sf_dir).select("ord", "file", "run", "confidence").withColumn("place", F.row_number().over(order)).where("place <= 3")


def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 largest files; ties go to the later path."""
    return views.files(spark, sf_dir).select("path", "size").orderBy(F.desc("size"), F.desc("path")).limit(15)


def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short id and identity of each finding, from file, class and line."""
    parts = F.col("file"), F.col("vuln_class"), F.col("line_start").cast("string")
    return views.findings(spark, sf_dir).select("ord", names.short_id(*parts).alias("finding_id"), names.identity(*parts[:2]).alias("identity"))


def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each text after cutting its middle, and its size class by characters."""
    d = views.table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.sha2(names.shorten_middle(F.col("text")), 256).alias("digest"), names.size_class(F.length("text")).alias("size_class"))


def file_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected graph of the call graph's nodes, each edge once in both directions."""
    e = views.edges(spark, sf_dir).where("caller != callee")
    return e.select(F.col("caller").alias("node"), F.col("callee").alias("other")).union(e.select("callee", "caller")).distinct()


def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified names of findings, and their parts split off again."""
    f = views.findings(spark, sf_dir).select("ord", names.qualify(F.col("file"), F.col("vuln_class")).alias("qname"))
    return f.select("ord", "qname", names.qualified_file(F.col("qname")).alias("file"), names.qualified_name(F.col("qname")).alias("name"))


def transitive_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of each order's chain: two of three orders point to the order of half their number."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("node"))
    return graph.roots(o.select("node", F.when(F.col("node") % 3 != 0, F.expr("node div 2")).alias("canonical")))


def stream_dedup_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident findings judged from a stream, then reconciled to the surest of each file and class."""
    path = f"{sf_dir}/events.parquet"
    # a pattern, as a stream takes a plain path for a folder
    arriving = views.as_findings(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events[.]parquet"))
    judged = reconcile.judge_arriving(arriving.where("confidence >= 0.6").select("ord", "file", "vuln_class", "confidence"), reconcile.shared_folder(spark))
    return reconcile.reconcile(judged, ["file", "vuln_class"], "confidence", "ord")


_F, _I, _D = f"WITH {views.FINDINGS}", f"WITH {views.FINDINGS}, {views.INVENTORY}", f"WITH {views.FILES}"
_PCT = "CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * {} / n, 1) END"

QUERIES = {
    "loc_by_language": (loc_by_language, rf"{_D}, l AS (SELECT lang, path, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f\v]'))) AS loc FROM v_files WHERE text IS NOT NULL) SELECT lang, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(CASE WHEN starts_with(path, 'Vendor/') THEN 0 ELSE loc END) AS BIGINT) AS scoped_loc FROM l GROUP BY 1"),
    "scope_estimate": (scope_estimate, rf"{_D} SELECT count(*) AS files, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(strlen(text)), 0) // 4 AS BIGINT) AS tokens FROM v_files WHERE regexp_matches(path, '\.(c|md)$')"),
    "run_ratios": (run_ratios, f"{_I}, m AS (SELECT f.run, count(*) AS n, count(i.file) AS covered, count(*) FILTER (f.confidence >= CAST(0.6 AS DOUBLE)) AS sure FROM v_findings f LEFT JOIN v_inventory i ON f.file = i.file GROUP BY 1) SELECT run, n, {_PCT.format('covered')} AS coverage_pct, {_PCT.format('sure')} AS precision_pct FROM m"),
    "batch_rollup": (batch_rollup, "SELECT o_custkey AS app, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus != 'F') AS failed, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days FROM orders GROUP BY 1"),
    "cmdb_conflicts": (cmdb_conflicts, "SELECT source, count(DISTINCT coalesce(lang, '')) AS variants, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT coalesce(lang, '')) > 1"),
    "ordered_distinct": (ordered_distinct, f"{_F} SELECT file, min(ord) AS ord FROM v_findings GROUP BY 1"),
    "unseen_files": (unseen_files, f"{_I} SELECT file, count(*) AS n FROM v_findings f WHERE NOT EXISTS (SELECT 1 FROM v_inventory i WHERE i.file = f.file) GROUP BY 1"),
    "inventory_overlap": (inventory_overlap, f"{_I} SELECT file FROM v_inventory INTERSECT SELECT file FROM v_findings WHERE confidence >= CAST(0.9 AS DOUBLE)"),
    "drop_union": (drop_union, f"{_F} SELECT ord, 'prefilter' AS stage, confidence FROM v_findings WHERE confidence < CAST(0.3 AS DOUBLE) UNION ALL SELECT ord, 'scope', NULL FROM v_findings WHERE starts_with(file, 'tests/')"),
    "signature_dedupe": (signature_dedupe, "WITH i AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS lines FROM lineitem GROUP BY 1) SELECT min(o_orderkey) AS ord, o_custkey, o_orderstatus FROM orders JOIN i ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderstatus, lines"),
    "per_run_cap": (per_run_cap, f"{_F}, r AS (SELECT ord, file, run, confidence, CAST(row_number() OVER (PARTITION BY file, run ORDER BY confidence DESC, ord) AS INT) AS place FROM v_findings) SELECT * FROM r WHERE place <= 3"),
    "largest_files": (largest_files, f"{_D} SELECT path, size FROM v_files ORDER BY size DESC, path DESC LIMIT 15"),
    "finding_ids": (finding_ids, f"{_F} SELECT ord, substr(sha1(file || chr(0) || vuln_class || chr(0) || CAST(line_start AS VARCHAR)), 1, 6) AS finding_id, sha256(file || chr(0) || vuln_class) AS identity FROM v_findings"),
    "shortened_texts": (shortened_texts, f"SELECT doc_id, sha256(CASE WHEN length(bare) > {names.LONGEST} THEN left(bare, {names.HEAD}) || chr(10) || '...<truncated>...' || chr(10) || right(bare, {names.TAIL}) ELSE bare END) AS digest, CASE WHEN length(text) < {names.SMALL} THEN 'small' WHEN length(text) < {names.MEDIUM} THEN 'medium' ELSE 'large' END AS size_class FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM documents WHERE text IS NOT NULL)"),
    "file_projection": (file_projection, f"WITH {views.EDGES} SELECT caller AS node, callee AS other FROM v_edges WHERE caller != callee UNION SELECT callee, caller FROM v_edges WHERE caller != callee"),
    "qualified_names": (qualified_names, f"{_F} SELECT ord, file || '::' || vuln_class AS qname, file, vuln_class AS name FROM v_findings"),
    "transitive_root": (transitive_root, "WITH RECURSIVE c AS (SELECT CAST(o_orderkey AS BIGINT) AS node, CASE WHEN o_orderkey % 3 != 0 THEN CAST(o_orderkey // 2 AS BIGINT) ELSE CAST(o_orderkey AS BIGINT) END AS up FROM orders), r(node, root) AS (SELECT node, up FROM c UNION ALL SELECT r.node, c.up FROM r JOIN c ON r.root = c.node AND c.up != c.node) SELECT node, min(root) AS root FROM r GROUP BY 1"),
    "stream_dedup_reconcile": (stream_dedup_reconcile, f"{_F} SELECT ord, file, vuln_class, confidence, row_number() OVER (PARTITION BY file, vuln_class ORDER BY confidence DESC, ord) = 1 AS retained FROM v_findings WHERE confidence >= CAST(0.6 AS DOUBLE)"),
}
