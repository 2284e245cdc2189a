"""Findings that are tried one after the other as they arrive, within a budget for each repository."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievemill.streaming.reconcile import judge_arriving

NOT_ELIGIBLE, EXHAUSTED, NOT_BUILT, NO_CRASH, CONFIRMED = "not eligible", "budget exhausted", "build failed", "no crash", "confirmed"
_OUT = "scope long, ord long, attempt long, status string"
#: Of a repository: attempts so far, and whether its one build succeeded (null before the first attempt).
_STATE = "attempts long, built boolean"


def tried_in_turn(arriving: DataFrame, limit: int) -> DataFrame:
    """A stream of (scope, ord, attempt, status) for a stream of findings (scope, ord, eligible, builds, crashes).

    The rows of a scope are taken as they arrive, those of one micro-batch by ``ord``.  A finding that is not eligible
    makes no attempt; nor does one beyond ``limit`` attempts.  The first attempt builds, and its ``builds`` holds for the
    whole scope; without a build the others' attempts count, but fail.  Null flags are false.  Attempts and build are
    state, so a restart goes on where the stream ended, and a scope's state never grows.
    """

    def turn(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, built = state.get if state.exists else (0, None)
        rows = pd.concat(list(parts)).sort_values("ord", kind="stable")
        out = []
        for ord_, eligible, builds, crashes in zip(rows["ord"], rows["eligible"], rows["builds"], rows["crashes"], strict=True):
            if not eligible or attempts >= limit:
                out.append((key[0], ord_, None, EXHAUSTED if eligible else NOT_ELIGIBLE))
                continue
            attempts += 1
            if built is None:
                built = bool(builds)
            out.append((key[0], ord_, attempts, (CONFIRMED if crashes else NO_CRASH) if built else NOT_BUILT))
        state.update((attempts, built))
        yield pd.DataFrame(out, columns=["scope", "ord", "attempt", "status"]).astype({"attempt": "Int64"})

    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("eligible", "builds", "crashes")]
    rows = arriving.select(F.col("scope").cast("long").alias("scope"), F.col("ord").cast("long").alias("ord"), *flags)
    return rows.groupBy("scope").applyInPandasWithState(turn, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def tried(arriving: DataFrame, folder: str, limit: int) -> DataFrame:
    """Tries what has arrived since the last call with the same ``folder``, and gives all results so far in order."""
    return in_order(judge_arriving(tried_in_turn(arriving, limit), folder))


def in_order(results: DataFrame) -> DataFrame:
    """Adds ``place``: results as findings were given, whatever order they came back in."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy("ord")))


# Why a candidate is dropped, and how much of an error's text is kept.
BLOCKED, FAILED, MOST_DETAIL = "GUARDRAIL_BLOCKED", "VERIFY_ERROR", 200


def outcomes(verified: DataFrame, least: int = 7) -> DataFrame:
    """(scope, ord, reason, detail) of verified candidates (scope, ord, verdict, confidence, said, error, error_text): kept
    ones have no reason.

    An error of one candidate drops that candidate alone: ``error`` is ``guardrail`` or another kind, ``error_text`` its
    first 200 characters' detail.  Then a true positive is kept from ``least`` on, and unconfirmed below; an answer that
    could not be read is an error as well; anything else is a false positive.  Works on streams and tables alike.
    """
    sure, said = F.coalesce("confidence", F.lit(0)), F.coalesce("said", F.lit(""))
    positive = F.col("verdict").eqNullSafe(F.lit("TRUE_POSITIVE"))
    unread = (said == "verifier output unparseable") & (sure == 0)
    low = F.concat(F.lit("verifier confidence "), F.coalesce(F.col("confidence").cast("string"), F.lit("None")), F.lit(f"/10 below gate {least}"))
    reason = F.when(F.col("error") == "guardrail", BLOCKED).when(F.col("error").isNotNull(), FAILED).when(positive & (sure >= least), None).when(positive, "UNCONFIRMED").when(unread, FAILED).otherwise("FALSE_POSITIVE")
    detail = F.when(F.col("error").isNotNull(), F.left(F.coalesce("error_text", F.lit("")), F.lit(MOST_DETAIL))).when(positive & (sure >= least), None).when(positive, low).otherwise(said)
    return verified.select("scope", "ord", reason.alias("reason"), detail.alias("detail"))


def stop_if_blocked(results: DataFrame, most: int, parallel: int = 1) -> DataFrame:
    """``results`` (reason), unless ``most`` candidates (and as many as run at a time, three at least) were blocked and none
    was judged: then the run makes no sense, and an error says so.
    """
    gate = max(3, most, parallel)
    blocked, judged = results.agg(F.count_if(F.col("reason").eqNullSafe(F.lit(BLOCKED))), F.count_if(~F.coalesce(F.col("reason").isin(BLOCKED, FAILED), F.lit(False)))).first()
    if blocked >= gate and not judged:
        raise RuntimeError(f"{blocked} cumulative guardrail blocks with zero successes")
    return results
