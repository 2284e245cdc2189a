"""Views that give the test tables the shape of findings, files, applications, edges and gates.

Each view is written twice: as a DataFrame, and as the text of a common table expression for the SQL that
results are held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_findings(table(spark, sf_dir, "events"))


def as_findings(e: DataFrame) -> DataFrame:
    u = F.col("user_id")
    line = F.hour("ts") * 60 + F.minute("ts")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("ord"),
        (F.col("event_id") % 3).cast("int").alias("run"),
        F.concat(F.when(u % 10 == 0, "tests/").otherwise("src/"), F.lit("u"), u.cast("string"), F.when(u % 7 == 0, ".py").otherwise(".c")).alias("file"),
        line.cast("int").alias("line_start"),
        (line + F.col("event_id") % 7).cast("int").alias("line_end"),
        ((F.col("event_id") % 11).cast("double") / 10).alias("confidence"),
        F.when(kind == "click", "heap-overflow").when(kind == "view", "integer-overflow").when(kind == "purchase", "use-after-free").when(kind == "error", "info-leak").otherwise("injection").alias("vuln_class"),
        u.alias("user_id"),
        "ts",
    )


FINDINGS = """v_findings AS (SELECT event_id AS ord, CAST(event_id % 3 AS INT) AS run,
  (CASE WHEN user_id % 10 = 0 THEN 'tests/' ELSE 'src/' END) || 'u' || CAST(user_id AS VARCHAR) || (CASE WHEN user_id % 7 = 0 THEN '.py' ELSE '.c' END) AS file,
  CAST(hour(ts) * 60 + minute(ts) AS INT) AS line_start, CAST(hour(ts) * 60 + minute(ts) + event_id % 7 AS INT) AS line_end,
  CAST(event_id % 11 AS DOUBLE) / 10 AS confidence,
  CASE event_type WHEN 'click' THEN 'heap-overflow' WHEN 'view' THEN 'integer-overflow' WHEN 'purchase' THEN 'use-after-free' WHEN 'error' THEN 'info-leak' ELSE 'injection' END AS vuln_class,
  user_id, ts FROM events)"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of users whose number does not end in 3."""
    return findings(spark, sf_dir).where("user_id % 10 != 3").select("file").distinct()


INVENTORY = "v_inventory AS (SELECT DISTINCT file FROM v_findings WHERE user_id % 10 != 3)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".min.js", ".c", ".md")]), (F.col("doc_id") % 4 + 1).cast("int"))
    top = F.when(F.col("doc_id") % 9 == 0, "Vendor").otherwise(F.col("source"))
    return d.select(F.col("doc_id").alias("ord"), F.concat_ws("/", top, F.col("lang"), F.concat(F.col("doc_id").cast("string"), ext)).alias("path"), F.col("n_chars").alias("size"), "lang", "source", "text")


FILES = """v_files AS (SELECT doc_id AS ord, (CASE WHEN doc_id % 9 = 0 THEN 'Vendor' ELSE source END) || '/' || lang || '/' || CAST(doc_id AS VARCHAR)
  || (CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.min.js' WHEN 2 THEN '.c' ELSE '.md' END) AS path, n_chars AS size, lang, source, text FROM documents)"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as components of their nation; a flag is blank where the key's modulus says so."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"),
        F.when(k % 3 == 0, None).otherwise(k % 2 == 0).alias("external"),
        F.when(k % 4 == 0, None).otherwise(k % 5 == 0).alias("pci"),
        F.when(k % 5 == 0, None).otherwise(k % 6 == 0).alias("pan"),
        F.when(k % 7 == 0, None).otherwise(k % 3 == 0).alias("pii"),
    )


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(F.concat(F.lit("n"), k.cast("string")).alias("id"), (k % 2 == 0).alias("external"), (k % 3 == 0).alias("pci"), F.when(k % 4 == 0, None).otherwise(k % 5 == 0).alias("pan"), (k % 5 == 0).alias("pii"))


APPLICATIONS = """v_apps AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'n' || CAST(c_nationkey AS VARCHAR) AS parent_id,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS external, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 5 = 0 END AS pci,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 6 = 0 END AS pan, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 3 = 0 END AS pii FROM customer),
v_parents AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, n_nationkey % 2 = 0 AS external, n_nationkey % 3 = 0 AS pci,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey % 5 = 0 END AS pan, n_nationkey % 5 = 0 AS pii FROM nation),
v_inherited AS (SELECT a.id, a.parent_id, coalesce(a.external, p.external, false) AS external, coalesce(a.pci, p.pci, false) AS pci, coalesce(a.pan, p.pan, false) AS pan, coalesce(a.pii, p.pii, false) AS pii,
  CASE WHEN (a.external IS NULL AND p.external IS NOT NULL) OR (a.pci IS NULL AND p.pci IS NOT NULL) OR (a.pan IS NULL AND p.pan IS NOT NULL) OR (a.pii IS NULL AND p.pii IS NOT NULL) THEN 'parent' ELSE 'own' END AS origin
  FROM v_apps a LEFT JOIN v_parents p ON a.parent_id = p.id AND a.parent_id != a.id)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer calls one with about a third of its number."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("caller"), F.expr("cast(c_custkey div 3 + c_nationkey as long)").alias("callee"))
    return c.where("caller != callee").distinct()


EDGES = "v_edges AS (SELECT DISTINCT CAST(c_custkey AS BIGINT) AS caller, CAST(c_custkey // 3 + c_nationkey AS BIGINT) AS callee FROM customer WHERE c_custkey != c_custkey // 3 + c_nationkey)"


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    gate = F.element_at(F.array(*[F.lit(x) for x in ("root_cause", "instance_coverage", "no_new_vulnerabilities", "security_best_practices")]), F.col("l_linenumber"))
    pair = F.concat("l_returnflag", "l_linestatus")
    status = F.when(pair == "NF", "skip").when(pair == "AO", "invalid").when(pair == "RO", "fail").when(F.col("l_returnflag") == "R", "partial").otherwise("pass")
    return li.select(F.col("l_orderkey").alias("finding_id"), gate.alias("gate"), status.alias("status"))


GATES = """v_gates AS (SELECT l_orderkey AS finding_id, CASE l_linenumber WHEN 1 THEN 'root_cause' WHEN 2 THEN 'instance_coverage' WHEN 3 THEN 'no_new_vulnerabilities' ELSE 'security_best_practices' END AS gate,
  CASE WHEN l_returnflag || l_linestatus = 'NF' THEN 'skip' WHEN l_returnflag || l_linestatus = 'AO' THEN 'invalid' WHEN l_returnflag || l_linestatus = 'RO' THEN 'fail' WHEN l_returnflag = 'R' THEN 'partial' ELSE 'pass' END AS status
  FROM lineitem WHERE l_linenumber <= 4)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CVSS vector for each order line, from its keys, and the customer whose application it is."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda letters, n: F.substring(F.lit(letters), 1, 1) if not letters else F.element_at(F.array(*[F.lit(x) for x in letters]), (n % len(letters) + 1).cast("int"))
    p, s, o, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    text = F.concat(F.lit("CVSS:3.1/AV:"), pick("NALP", p), F.lit("/AC:"), pick("LH", s), F.lit("/PR:"), pick("NLH", o), F.lit("/UI:"), pick("NR", k), F.lit("/S:"), pick("UC", p + o), F.lit("/C:"), pick("HLN", s + k), F.lit("/I:"), pick("HLN", o + k), F.lit("/A:"), pick("HLN", p + s))
    return li.select((o * 10 + k).alias("ord"), text.alias("vector"), (o % 1000 + 1).alias("app"))


_PICK = lambda letters, n: "substr('" + letters + "', CAST((" + n + f") % {len(letters)} + 1 AS INT), 1)"
VECTORS = (
    "v_vectors AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'CVSS:3.1/AV:' || " + _PICK("NALP", "l_partkey") + " || '/AC:' || " + _PICK("LH", "l_suppkey") + " || '/PR:' || " + _PICK("NLH", "l_orderkey") + " || '/UI:' || " + _PICK("NR", "l_linenumber")
    + " || '/S:' || " + _PICK("UC", "l_partkey + l_orderkey") + " || '/C:' || " + _PICK("HLN", "l_suppkey + l_linenumber") + " || '/I:' || " + _PICK("HLN", "l_orderkey + l_linenumber") + " || '/A:' || " + _PICK("HLN", "l_partkey + l_suppkey") + " AS vector, l_orderkey % 1000 + 1 AS app FROM lineitem)"
)
