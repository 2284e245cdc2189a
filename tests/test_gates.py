"""Gate scores that fall on a tie in rounding are those of plain floats added in gate order."""

from sievemill.operators import aggregates


def test_ties(spark):
    gates = list(aggregates.WEIGHTS)
    cases = {1: ["pass", "partial", "fail", "pass"], 2: ["pass", "partial", "fail", "partial"], 3: ["partial", "partial", "fail", "partial"], 4: ["pass", "partial", "pass", "pass"]}
    rows = [(k, g, s) for k, v in cases.items() for g, s in zip(gates, v, strict=True)]
    want = {}
    for k, v in cases.items():
        earned = weight = 0.0
        for g, s in zip(gates, v, strict=True):
            weight += aggregates.WEIGHTS[g]
            earned += aggregates.WEIGHTS[g] * aggregates.MULTIPLIERS[s]
        want[k] = round(earned / weight, 4)
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        got = aggregates.gate_score(spark.createDataFrame(order, "finding_id long, gate string, status string")).collect()
        assert {r["finding_id"]: r["score"] for r in got} == want
