"""Attempts within a budget, over restarts, against going through all rows in the order they came."""

import random

import pytest

from sievemill.operators import rounds
from sievemill.streaming import reconcile, session

SCHEMA = "scope long, ord long, eligible boolean, builds boolean, crashes boolean, extra string"


def in_turn(turns, limit):
    state, out = {}, {}
    for rows in turns:
        for scope, n, eligible, builds, crashes, _ in sorted(rows, key=lambda r: r[1]):
            attempts, built = state.get(scope, (0, None))
            if not eligible:
                out[scope, n] = (None, session.NOT_ELIGIBLE)
            elif attempts >= limit:
                out[scope, n] = (None, session.EXHAUSTED)
            else:
                built = bool(builds) if built is None else built
                state[scope] = (attempts + 1, built)
                out[scope, n] = (attempts + 1, session.NOT_BUILT if not built else session.CONFIRMED if crashes else session.NO_CRASH)
    return out


def test_budget_over_restarts(spark):
    rnd = random.Random(6)
    flag = lambda: rnd.choice([True, True, False, None])
    every = [(s, n, flag(), flag(), flag(), "x") for n, s in enumerate(rnd.choices([1, 1, 1, 2, 3], k=60))]
    rnd.shuffle(every)
    turns = [every[:25], [], every[25:40], every[40:]]
    inbox, folder = rounds.new_folder(spark, "inbox"), reconcile.shared_folder(spark)
    for k, rows in enumerate(turns):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(inbox)
        out = session.tried(spark.readStream.schema(SCHEMA).parquet(inbox), folder, 7)
        got = {(r.scope, r.ord): (r.attempt, r.status) for r in out.collect()}
        assert got == in_turn(turns[: k + 1], 7)
    places = sorted((r.scope, r.place, r.ord) for r in out.collect())
    assert [(s, n) for s, _, n in places] == sorted((r[0], r[1]) for r in every)


def test_a_failing_candidate_fails_alone(spark):
    long = "x" * 300
    rows = [(1, 1, "TRUE_POSITIVE", 9, "s", None, None), (1, 2, "TRUE_POSITIVE", None, "s", None, None), (1, 3, None, None, "verifier output unparseable", None, None), (1, 4, "FALSE_POSITIVE", 5, None, None, None), (1, 5, "TRUE_POSITIVE", 9, "s", "guardrail", long), (1, 6, None, None, None, "timeout", None)]
    schema = "scope long, ord long, verdict string, confidence long, said string, error string, error_text string"
    df = spark.createDataFrame(rows, schema)
    got = [(r.ord, r.reason, r.detail) for r in session.outcomes(df).orderBy("ord").collect()]
    assert got == [(1, None, None), (2, "UNCONFIRMED", "verifier confidence None/10 below gate 7"), (3, "VERIFY_ERROR", "verifier output unparseable"), (4, "FALSE_POSITIVE", ""), (5, "GUARDRAIL_BLOCKED", long[:200]), (6, "VERIFY_ERROR", "")]
    assert session.stop_if_blocked(session.outcomes(df), 1).count() == 6


@pytest.mark.parametrize("blocked,others,stops", [(3, [], True), (3, ["VERIFY_ERROR"], True), (2, [], False), (3, [None], False), (3, ["FALSE_POSITIVE"], False)])
def test_only_blocks_stop_the_run(spark, blocked, others, stops):
    df = spark.createDataFrame([(r,) for r in ["GUARDRAIL_BLOCKED"] * blocked + others], "reason string")
    if stops:
        with pytest.raises(RuntimeError, match="3 cumulative guardrail blocks"):
            session.stop_if_blocked(df, 3)
    else:
        assert session.stop_if_blocked(df, 3) is df
