"""Batch summaries that no field can forge, and gates that are only taken where they are proven."""

from sievemill.operators import batches

RESULT = "batch long, ord long, app string, module string, status string, findings long, elapsed double, report string, ref string, error string"


def test_summary(spark):
    rows = [(1, 2, "a|b\nc", "m", "FAILED", None, 2.5, None, "https://u:p@h/x", "no\n# head at https://t@h"), (1, 1, "a", "n", "OK", 3, 1.5, "r.md", None, None)]
    heads = spark.createDataFrame([(1, "l.csv", 0.5), (2, None, 7.0)], "batch long, list_file string, elapsed double")
    text = {r.batch: r.text for r in batches.summaries(heads, spark.createDataFrame(rows, RESULT)).collect()}
    table = "\n| # | App ID | Repo | Status | Findings | Elapsed (s) | Report | Source |\n|--:|---|---|---|--:|--:|---|---|\n"
    assert text[1] == (
        "# Static analysis batch summary\n\n- Input list: `l.csv`\n- Repos: 2 (1 OK, 1 failed)\n- Total elapsed: 0s\n" + table + "| 1 | a | n | OK | 3 | 2 | `r.md` |  |\n| 2 | a\\|b c | m | FAILED | 0 | 2 |  | https://***@h/x |\n"
        "\n## Failures\n\n### m (app a\\|b c)\n- Source: `https://***@h/x`\n- Error: no # head at https://***@h\n\n"
    )
    assert text[2] == "# Static analysis batch summary\n\n- Input list: ``\n- Repos: 0 (0 OK, 0 failed)\n- Total elapsed: 7s\n" + table


def test_gates(spark):
    texts = [(1, '[{"tracking_id": "a", "gates": [1]}, {"gates": {}}, 5, {"tracking_id": "a", "gates": []}]'), (2, "{}"), (3, None), (4, "[{"), (5, "[]"), (6, '[{"gates": null}]')]
    got = batches.gate_lists(spark.createDataFrame(texts, "scope long, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, "a", "[]", 2)]


def test_blank_fields_are_filled(spark):
    results = [(1, "", None, " ", "Medium", None), (1, "J-1", "t", "d", "High", "f.c"), (1, "own", "", "", "Medium", ""), (2, "", None, None, "Medium", None), (3, "J-3", None, None, "Medium", None), (4, None, None, None, None, None)]
    manifests = [(1, "M", "title", " c\\nd ", "Low", ["//no.c", "abc", "abcd", None], "J-1"), (2, "M", None, "c", "Low", ["abcd"], "J-2"), (3, None, "x", None, None, None, "J-3")]
    got = batches.filled_results(spark.createDataFrame(results, "scope long, tracking_id string, title string, description string, severity string, files string"), spark.createDataFrame(manifests, "scope long, tracking_id string, title string, category string, severity string, files array<string>, ticket string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        (1, "M", "title", " ", "Low", "abcd"), (1, "M", "t", "d", "High", "f.c"), (1, "own", "title", "c d", "Low", "abcd"),
        (2, "", None, None, "Medium", None), (3, "J-3", "x", "", "Medium", ""), (4, None, None, None, None, None),
    ], key=repr)
