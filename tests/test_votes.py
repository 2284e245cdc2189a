"""The greedy collapse on random, hot and odd groups; gates with and without an inventory."""

import random

from sievemill.operators import filters, selection, votes


def test_collapse(spark):
    rnd = random.Random(5)
    rows = [("a", "x", i, s := rnd.randrange(400), s + rnd.choice([0, 0, 2, 30])) for i in range(300)]
    rows += [("b", k, 1000 + i, s := rnd.randrange(60), s + rnd.randrange(-6, 9)) for i in range(120) for k in "xy"]
    rows += [("c", "x", i, None, 3) for i in range(2)] + [(None, None, i, 5, 5) for i in range(3)] + [("hot", "x", i, i * 7, i * 7 + 1) for i in range(20_000)]
    rnd.shuffle(rows)
    want, kept = {}, {}
    for f, k, o, s, e in sorted(rows, key=lambda r: r[2]):
        if f == "hot":
            want[f, k, o] = o
            continue
        near = [ko for ks, ke, ko in kept.get((f, k), []) if s is not None and (abs(ks - s) <= 3 or (ks <= e and s <= ke))]
        want[f, k, o] = near[0] if near else o
        if not near and s is not None:
            kept.setdefault((f, k), []).append((s, e, o))
    df = spark.createDataFrame(rows, "file string, vuln_class string, ord long, line_start int, line_end int")
    assert {(r.file, r.vuln_class, r.ord): r.root for r in votes.collapse_overlaps(df).collect()} == want


def test_gates_without_an_inventory(spark):
    f = spark.createDataFrame([(1, "a.c", "heap-overflow", 0.9), (2, "b.c", "heap-overflow", 0.9)], "ord long, file string, vuln_class string, confidence double")
    some = spark.createDataFrame([("a.c",)], "file string")
    assert {r.ord: r.reason for r in filters.gate_cascade(f, some).collect()} == {1: None, 2: "not in inventory"}
    assert {r.ord: r.reason for r in filters.gate_cascade(f, some.limit(0)).collect()} == {1: None, 2: None}


def test_positions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["x", "y", None]), i * 7) for i in range(500)]
    got = selection.positions(spark.createDataFrame(rows, "k string, ord long"), ["k"], width=100).collect()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]))
    first = [r for r in rows if r[0] is None]
    known = {(r.k, r.ord): r.position for r in got if r.k is not None}
    assert known == {r: i + len(first) for i, r in enumerate(order)}
