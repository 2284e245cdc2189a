"""Reports of findings in the SARIF 2.1.0 format, one document for each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import cvss, weakness
from sievemill.operators import trees
from sievemill.operators.notes import PRIORITIES
from sievemill.operators.reports import TOOL

# What a document says of itself, of its taxonomy and of further places.
SCHEMA, VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
TAXONOMY = {"name": "CWE", "organization": "MITRE", "text": "The MITRE Common Weakness Enumeration", "uri": "https://cwe.mitre.org/"}
WEAKNESS_PAGE = "https://cwe.mitre.org/data/definitions/%s.html"
FURTHER = "Additional call site — collapsed during dedup; same root cause as the primary location and needs the same fix."
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning"}
SCORES = {"CRITICAL": "9.0", "HIGH": "7.0", "MEDIUM": "4.0", "LOW": "0.1"}
LONGEST = 4000


def _json(value: Column) -> Column:
    """A string, number or flag as JSON, ``null`` for null.  None of them begins or ends with a bracket."""
    return F.btrim(F.to_json(F.array(value)), F.lit("[]"))


def _object(**parts: Column | str) -> Column:
    """A JSON object of parts that are JSON; a null part has no key.  ``_`` in a key is written as ``-``, ``D_`` as ``$``."""
    named = [F.concat(F.lit(f'"{k.replace("D_", "$").replace("_", "-")}":'), F.lit(v) if isinstance(v, str) else v) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _text(value: Column | str) -> Column:
    return _object(text=_json(F.lit(value) if isinstance(value, str) else value))


def _place(file: Column, first: Column, last: Column | None = None) -> Column:
    region = {"startLine": _json(first)}
    if last is not None:
        region["endLine"] = F.when((last != 0) & (last != first), _json(last))
    return _object(artifactLocation=_object(uri=_json(file)), region=_object(**region))


def _mapped(value: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _rows(f: DataFrame, guid: str) -> DataFrame:
    """(scope, ord, rule, cwe, name, result) of each finding."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    f = f.withColumn("rule", F.when(blank("category"), F.lower("severity")).otherwise(F.col("category"))).withColumn("eff", weakness.stated(F.col("cwe"), F.col("category")))
    f = f.withColumn("name", F.nullif(F.regexp_replace(weakness.label(F.col("eff")), r"^\S+(?: - )?", ""), F.lit("")))
    scored = F.col("cvss_score") >= 0
    number = F.when(scored, F.format_string("%.1f", "cvss_score"))
    severity = F.coalesce(number, _mapped(F.col("severity"), SCORES, "0.0"))
    title = F.when(blank("cvss"), F.col("title")).otherwise(F.concat("title", F.lit("  [CVSS"), F.coalesce(F.concat(F.lit(" "), number), F.lit("")), F.lit(": "), "cvss", F.lit("]")))
    said = F.when(F.length("description") > LONGEST, F.concat(F.left("description", F.lit(LONGEST)), F.lit("…"))).otherwise(F.col("description"))
    when = lambda c, v: F.when(c, v)
    context, has_priority, sure = F.col("context_score") >= 0, ~blank("priority"), F.col("confidence") >= 0
    related = F.transform("places", lambda p: _object(physicalLocation=_place(p["file"], p["line_start"], p["line_end"]), message=_text(FURTHER)))
    props = _object(
        severity=_json(F.lower("severity")), security_severity=_json(severity), cvssRating=_json(cvss.rating(F.coalesce(F.when(scored, F.col("cvss_score")), severity.cast("double")))),
        category=_json(F.col("category")), cvssVector=_json(F.col("cvss")),
        cwe=when(F.col("eff").isNotNull(), _json(weakness.label(F.col("eff")))), cweId=when(F.col("eff").isNotNull(), _json(F.col("eff"))), cweName=when(F.col("name").isNotNull(), _json(F.col("name"))),
        cvssScore=when(scored, _json(F.round("cvss_score", 1))),
        vulContextSeverityVector=when(context, _json(F.col("context_vector"))), vulContextSeverityScore=when(context, _json(F.round("context_score", 1))), vulContextSeverityRating=when(context, _json(F.col("context_rating"))),
        offensivePriority=when(has_priority, _json(F.col("priority"))), offensivePriorityLabel=when(has_priority, _json(_mapped(F.col("priority"), PRIORITIES, ""))), offensivePriorityReason=when(has_priority, _json(F.col("reason"))),
        confidence=when(sure, _json(F.round("confidence", 2))), votes=when(sure & (F.col("votes") != 0), _json(F.col("votes"))),
        description=_json(said), dedupRelatedLocationCount=when(F.size("places") > 0, _json(F.size("places"))),
    )
    taxon = _list(F.array(_object(toolComponent=_object(name='"CWE"', guid=f'"{guid}"'), id=_json(F.col("eff")))))
    result = _object(
        ruleId=_json(F.col("rule")), level=_json(_mapped(F.col("severity"), LEVELS, "note")), message=_text(title),
        locations=_list(F.array(_object(physicalLocation=_place(F.when(blank("file"), "unknown").otherwise(F.col("file")), F.col("line"))))), properties=props,
        taxa=when(F.col("eff").isNotNull(), taxon), relatedLocations=when(F.size("places") > 0, _list(related)), rank=when(scored, _json(F.round(F.col("cvss_score") * 10, 1))),
    )
    return f.select("scope", "ord", "rule", F.col("eff").alias("cwe"), "name", result.alias("result"))


def _runs(health: DataFrame) -> DataFrame:
    """(scope, invocations, more): how a run went, as a list of one invocation, and what its properties say of it."""
    warned = lambda said: _object(level='"warning"', message=_text(said))
    errors = F.transform(F.array_sort("errors"), lambda e: warned(F.concat(e["stage"], F.lit(": "), e["n"].cast("string"), F.lit(" recoverable error(s) logged"))))
    failed = F.when(F.col("chunks_failed") != 0, warned(F.concat(F.col("chunks_failed").cast("string"), F.lit(" deep-dive chunk(s) failed or timed out; their findings are absent"))))
    degraded = F.coalesce("degraded", F.lit(False))
    weak = F.when(degraded, warned("Exploit-chain analysis could not be computed; findings are unranked"))
    told = F.array_compact(F.concat(F.coalesce(errors, F.array().cast("array<string>")), F.array(failed, weak)))
    ran = _object(executionSuccessful=_json(F.coalesce("successful", F.lit(True))), toolExecutionNotifications=F.when(F.size(told) > 0, _list(told)))
    return health.select("scope", _list(F.array(ran)).alias("invocations"), _json(degraded).alias("flag"))


#: Stands for the results in a document's text; JSON has no such character.
_HERE = "\0"


def documents(findings: DataFrame, places: DataFrame, apps: DataFrame, guid: str, version: str, health: DataFrame | None = None, mask: bool = True, tool: str = TOOL) -> DataFrame:
    """(scope, sarif): one document for each scope with findings.

    ``findings`` (scope, ord, title, severity, category, cwe, cvss, cvss_score, description, file, line, context_vector,
    context_score, context_rating, priority, reason, confidence, votes); ``ord`` is unique and orders them.  ``places``
    (ord, place, file, line_start, line_end) are a finding's further places, as :func:`ranking.attach` gives them.
    ``apps`` (scope, id, source, name): a scope's application, a null source if it is not known.  ``health`` (scope,
    errors: array of (stage, n), chunks_failed, degraded, successful) tells how a run went; without it nothing is said.

    A rule is a category, else the severity; rules stand in the order of their first finding and bear the name of the
    first weakness that has one.  Weaknesses stand in the order of their numbers.  With ``mask`` all strings of findings
    and places are masked first.  Scores below 0 or null are none.  A
    document is held whole, so for those that may not fit :func:`document_parts` gives what they are made of.
    """
    results = _results(findings, places, guid, mask).groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "result"))), lambda x: x["result"]), ",").alias("results"))
    frames = _framed(findings, apps, guid, version, health, tool).withColumnRenamed("scope", "_scope")
    met = results.join(frames, F.col("scope").eqNullSafe(F.col("_scope")))
    return met.select("scope", F.concat("head", "results", "tail").alias("sarif"))


def document_parts(findings: DataFrame, places: DataFrame, apps: DataFrame, guid: str, version: str, health: DataFrame | None = None, mask: bool = True, tool: str = TOOL) -> DataFrame:
    """(scope, step, place, part): the texts of :func:`documents` in parts, which no row holds together.

    Joined by step and place they are the document, with a comma between those of step 1, the results.
    """
    frames = _framed(findings, apps, guid, version, health, tool)
    part = lambda step, c: frames.select("scope", F.lit(step).alias("step"), F.lit(0).cast("long").alias("place"), F.col(c).alias("part"))
    found = _results(findings, places, guid, mask).select("scope", F.lit(1).alias("step"), F.col("ord").cast("long").alias("place"), F.col("result").alias("part"))
    return part(0, "head").unionByName(found).unionByName(part(2, "tail"))


_PLACES = "array<struct<place:bigint,file:string,line_start:bigint,line_end:bigint>>"


def _results(findings: DataFrame, places: DataFrame, guid: str, mask: bool) -> DataFrame:
    spots = places.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("place", "file", "line_start", "line_end"))).alias("places"))
    rows = findings.join(spots, "ord", "left").withColumn("places", F.coalesce("places", F.array().cast(_PLACES)))
    if mask:
        rows = trees.masked(rows, "ord", ["title", "cvss", "description", "file", "context_vector", "reason", "places"])
    return _rows(rows, guid).select("scope", "ord", "result")


def _framed(findings: DataFrame, apps: DataFrame, guid: str, version: str, health: DataFrame | None, tool: str) -> DataFrame:
    """(scope, head, tail): what stands before and after a document's results.  Nothing of it is masked, so findings are read as they are."""
    rows = _rows(findings.withColumn("places", F.array().cast(_PLACES)), guid).select("scope", "ord", "rule", "cwe", "name")
    first = rows.where("rule != ''").groupBy("scope", "rule").agg(F.min("ord").alias("at"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"))
    rule = _object(id=_json(F.col("rule")), name=_json(F.col("rule")), shortDescription=F.when(F.col("name").isNotNull(), _text(F.col("name"))))
    rules = first.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", rule.alias("r")))), lambda x: x["r"]).alias("rules"))
    known = rows.where("cwe is not null").groupBy("scope", "cwe").agg(F.min("name").alias("name"))
    n = F.substring_index("cwe", "-", -1)
    taxon = _object(id=_json(F.col("cwe")), helpUri=_json(F.format_string(WEAKNESS_PAGE, n)), name=F.when(F.col("name").isNotNull(), _json(F.col("name"))), shortDescription=F.when(F.col("name").isNotNull(), _text(F.col("name"))))
    order = F.struct(n.try_cast("long").alias("n"), F.col("cwe"), taxon.alias("t"))
    taxa = known.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]).alias("taxa"))
    met = rows.select("scope").distinct().join(rules, "scope", "left").join(taxa, "scope", "left").join(apps.select("scope", "id", "source", F.col("name").alias("app")), "scope", "left")
    runs = health if health is None else _runs(health)
    met = met.withColumn("invocations", F.lit(None).cast("string")).withColumn("flag", F.lit(None).cast("string")) if runs is None else met.join(runs, "scope", "left")
    none = F.array().cast("array<string>")
    taxonomy = _object(guid=f'"{guid}"', name=_json(F.lit(TAXONOMY["name"])), organization=_json(F.lit(TAXONOMY["organization"])), shortDescription=_text(TAXONOMY["text"]), informationUri=_json(F.lit(TAXONOMY["uri"])), taxa=_list(F.coalesce("taxa", none)))
    driver = _object(name=_json(F.lit(tool)), version=_json(F.lit(version)), rules=_list(F.coalesce("rules", none)), supportedTaxonomies=_list(F.array(_object(guid=f'"{guid}"'))))
    about = F.col("source").isNotNull()
    props = _object(applicationId=_json(F.col("id")), cmdbSource=F.when(about, _json(F.col("source"))), applicationName=F.when(about, _json(F.col("app"))), scanDegraded=F.col("flag"), unrankedFallback=F.col("flag"))
    run = _object(tool=_object(driver=driver), taxonomies=_list(F.array(taxonomy)), properties=props, results=f"[{_HERE}]", invocations=F.col("invocations"))
    whole = met.select("scope", _object(D_schema=_json(F.lit(SCHEMA)), version=_json(F.lit(VERSION)), runs=_list(F.array(run))).alias("whole"))
    return whole.select("scope", F.substring_index("whole", _HERE, 1).alias("head"), F.substring_index("whole", _HERE, -1).alias("tail"))
