"""CVSS 3.1 base and environmental scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the public CVSS 3.1 specification.
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
AC = {"L": 0.77, "H": 0.44}
PR = {"N": 0.85, "L": 0.62, "H": 0.27}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
UI = {"N": 0.85, "R": 0.62}
CIA = {"H": 0.56, "L": 0.22, "N": 0.0}
REQUIREMENT = {"H": 1.5, "M": 1.0, "L": 0.5}
# Temporal metrics E:P, RL:O, RC:C.
TEMPORAL = (0.94, 0.95, 1.0)


def metric(vector: Column, name: str) -> Column:
    return F.regexp_extract(vector, rf"(?:^|/){name}:([A-Z])", 1)


def _value(letter: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(letter == k, F.lit(v)).otherwise(out)
    return out


def round_up(x: Column) -> Column:
    """Up to one decimal place, on hundred-thousandths."""
    return F.ceil(F.round(x * 100000) / 10000.0).cast("double") / 10.0


def _bind(values: dict[str, Column], use) -> Column:
    """``use`` of columns that are computed once, however often it names them."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), 1)


def _parts(vector: Column, use) -> Column:
    """``use`` of the letters AV and S and of the values of the other base metrics."""

    def valued(m: Column) -> Column:
        changed = m["S"] == "C"
        pr = F.when(changed, _value(m["PR"], PR_CHANGED)).otherwise(_value(m["PR"], PR))
        cia = {x.lower(): _value(m[x], CIA) for x in "CIA"}
        return _bind({"av": m["AV"], "changed": changed, "scope": m["S"].isin("U", "C"), "rest": _value(m["AC"], AC), "pr": pr, "ui": _value(m["UI"], UI), **cia}, use)

    return _bind({x: metric(vector, x) for x in ("AV", "AC", "PR", "UI", "S", "C", "I", "A")}, valued)


def base_score(vector: Column) -> Column:
    """Null if a metric is missing or unknown."""

    def score(m: Column) -> Column:
        exploit = F.lit(8.22) * _value(m["av"], AV) * m["rest"] * m["pr"] * m["ui"]
        iss = 1 - (1 - m["c"]) * (1 - m["i"]) * (1 - m["a"])
        impact = lambda x: F.when(x["changed"], 7.52 * (x["iss"] - 0.029) - 3.25 * F.pow(x["iss"] - 0.02, F.lit(15.0))).otherwise(6.42 * x["iss"])
        known = lambda x: x["scope"] & x["exploit"].isNotNull() & x["iss"].isNotNull()
        ends = lambda x: _bind({"changed": x["changed"], "known": known(x), "exploit": x["exploit"], "impact": impact(x)}, lambda y: _ended(y, lambda raw: round_up(raw)))
        return _bind({"changed": m["changed"], "scope": m["scope"], "exploit": exploit, "iss": iss}, ends)

    return _parts(vector, score)


def _ended(x: Column, scale) -> Column:
    raw = F.when(x["changed"], 1.08 * (x["impact"] + x["exploit"])).otherwise(x["impact"] + x["exploit"])
    return F.when(x["known"] & (x["impact"] <= 0), F.lit(0.0)).when(x["known"], scale(F.least(raw, F.lit(10.0))))


def environmental_score(vector: Column, external: Column, pci: Column, pan: Column, pii: Column) -> Column:
    """Base metrics under an application's requirements; an internal application is adjacent at most."""
    cr = F.when(pci | pan | pii, F.lit(REQUIREMENT["H"])).otherwise(F.lit(REQUIREMENT["M"]))
    ir = F.when(pci | pan, F.lit(REQUIREMENT["H"])).otherwise(F.lit(REQUIREMENT["M"]))
    e, rl, rc = TEMPORAL

    def score(m: Column) -> Column:
        av = F.when(~external & (m["av"] == "N"), F.lit("A")).otherwise(m["av"])
        miss = F.least(1 - (1 - cr * m["c"]) * (1 - ir * m["i"]) * (1 - m["a"]), F.lit(0.915))
        exploit = F.lit(8.22) * _value(av, AV) * m["rest"] * m["pr"] * m["ui"]
        impact = lambda x: F.when(x["changed"], 7.52 * (x["miss"] - 0.029) - 3.25 * F.pow(x["miss"] * 0.9731 - 0.02, F.lit(13.0))).otherwise(6.42 * x["miss"])
        known = lambda x: x["scope"] & x["exploit"].isNotNull() & x["miss"].isNotNull()
        ends = lambda x: _bind({"changed": x["changed"], "known": known(x), "exploit": x["exploit"], "impact": impact(x)}, lambda y: _ended(y, lambda raw: round_up(round_up(raw) * e * rl * rc)))
        return _bind({"changed": m["changed"], "scope": m["scope"], "exploit": exploit, "miss": miss}, ends)

    return _parts(vector, score)


def _staged(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with the parts of a vector's score as columns that begin with ``_``, in steps that stay in generated code."""
    rows = rows.withColumns({f"_{x}": metric(F.col(vector), x) for x in ("AV", "AC", "PR", "UI", "S", "C", "I", "A")})
    rows = rows.withColumn("_changed", F.col("_S") == "C")
    pr = F.when(F.col("_changed"), _value(F.col("_PR"), PR_CHANGED)).otherwise(_value(F.col("_PR"), PR))
    return rows.withColumns({"_av": F.col("_AV"), "_rest": _value(F.col("_AC"), AC), "_pr": pr, "_ui": _value(F.col("_UI"), UI), **{f"_{x.lower()}": _value(F.col(f"_{x}"), CIA) for x in "CIA"}, "_scope": F.col("_S").isin("U", "C")})


_STAGES = ["_AV", "_AC", "_PR", "_UI", "_S", "_C", "_I", "_A", "_changed", "_av", "_rest", "_pr", "_ui", "_c", "_i", "_a", "_scope", "_exploit", "_iss", "_impact", "_known", "_raw"]


def _closed(rows: DataFrame, out: str, scale) -> DataFrame:
    rows = rows.withColumn("_known", F.col("_scope") & F.col("_exploit").isNotNull() & F.col("_iss").isNotNull())
    both = F.col("_impact") + F.col("_exploit")
    rows = rows.withColumn("_raw", F.least(F.when(F.col("_changed"), 1.08 * both).otherwise(both), F.lit(10.0)))
    score = F.when(F.col("_known") & (F.col("_impact") <= 0), F.lit(0.0)).when(F.col("_known"), scale(F.col("_raw")))
    return rows.withColumn(out, score).drop(*_STAGES)


def with_base_score(rows: DataFrame, vector: str, out: str) -> DataFrame:
    """``rows`` with :func:`base_score` of a column as ``out``: the same values, for many rows.  No column begins with ``_``."""
    rows = _staged(rows, vector)
    rows = rows.withColumns({"_exploit": F.lit(8.22) * _value(F.col("_av"), AV) * F.col("_rest") * F.col("_pr") * F.col("_ui"), "_iss": 1 - (1 - F.col("_c")) * (1 - F.col("_i")) * (1 - F.col("_a"))})
    rows = rows.withColumn("_impact", F.when(F.col("_changed"), 7.52 * (F.col("_iss") - 0.029) - 3.25 * F.pow(F.col("_iss") - 0.02, F.lit(15.0))).otherwise(6.42 * F.col("_iss")))
    return _closed(rows, out, round_up)


def with_environmental_score(rows: DataFrame, vector: str, flags: list[str], out: str) -> DataFrame:
    """``rows`` with :func:`environmental_score` of a column as ``out``; ``flags`` are external, pci, pan and pii."""
    external, pci, pan, pii = (F.col(c) for c in flags)
    cr = F.when(pci | pan | pii, F.lit(REQUIREMENT["H"])).otherwise(F.lit(REQUIREMENT["M"]))
    ir = F.when(pci | pan, F.lit(REQUIREMENT["H"])).otherwise(F.lit(REQUIREMENT["M"]))
    e, rl, rc = TEMPORAL
    rows = _staged(rows, vector)
    av = F.when(~external & (F.col("_av") == "N"), F.lit(AV["A"])).otherwise(_value(F.col("_av"), AV))
    rows = rows.withColumns({"_exploit": F.lit(8.22) * av * F.col("_rest") * F.col("_pr") * F.col("_ui"), "_iss": F.least(1 - (1 - cr * F.col("_c")) * (1 - ir * F.col("_i")) * (1 - F.col("_a")), F.lit(0.915))})
    rows = rows.withColumn("_impact", F.when(F.col("_changed"), 7.52 * (F.col("_iss") - 0.029) - 3.25 * F.pow(F.col("_iss") * 0.9731 - 0.02, F.lit(13.0))).otherwise(6.42 * F.col("_iss")))
    return _closed(rows, out, lambda raw: round_up(round_up(raw) * e * rl * rc))


def environmental_vector(vector: Column, external: Column, pci: Column, pan: Column, pii: Column) -> Column:
    """The vector with the temporal metrics, an application's requirements and the attack vector that it leaves."""
    high = lambda flag: F.when(flag, "H").otherwise("M")
    av = metric(vector, "AV")
    left = F.when(~external & (av == "N"), "A").otherwise(av)
    prefix = F.when(vector.startswith("CVSS:"), vector).otherwise(F.concat(F.lit("CVSS:3.1/"), vector))
    return F.concat(prefix, F.lit("/E:P/RL:O/RC:C/CR:"), high(pci | pan | pii), F.lit("/IR:"), high(pci | pan), F.lit("/AR:M/MAV:"), left)


def rating(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score < 0.1, "None").when(score < 4, "Low").when(score < 7, "Medium").when(score < 9, "High").otherwise("Critical")
