"""Queries that take their rows in several turns, as a stream that is stopped and started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.operators import rounds
from sievemill.plans import views
from sievemill.streaming import reconcile, session

_TURNS, _LIMIT = 4, 20


def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives in one of four turns; the stream is started anew for each."""
    n = F.col("event_id")
    found = views.table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("scope"), n.alias("ord"), (F.col("event_type") != "view").alias("eligible"), (F.expr("event_id div 3") % 4 != 0).alias("builds"), (n % 3 == 0).alias("crashes"))
    inbox, folder = rounds.new_folder(spark, "inbox"), reconcile.shared_folder(spark)
    for turn in range(_TURNS):
        found.where(F.col("ord") % _TURNS == turn).write.mode("append").parquet(inbox)
        out = session.tried(spark.readStream.schema(found.schema).parquet(inbox), folder, _LIMIT)
    return out


def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are verified as they arrive, each with its outcome, in the order they were given."""
    n = F.col("event_id")
    verdict = F.when(n % 5 < 3, "TRUE_POSITIVE").when(n % 5 == 3, "FALSE_POSITIVE")
    error = F.when(n % 11 == 0, "guardrail").when(n % 13 == 0, "timeout")
    found = views.table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("scope"), n.alias("ord"), verdict.alias("verdict"), F.when(n % 7 != 0, n % 11).alias("confidence"), F.when(n % 3 == 0, "verifier output unparseable").otherwise("seen").alias("said"), error.alias("error"), F.repeat(F.lit("e"), (n % 300).cast("int")).alias("error_text"))
    inbox, folder = rounds.new_folder(spark, "inbox"), reconcile.shared_folder(spark)
    for turn in range(2):
        found.where(F.col("ord") % 2 == turn).write.mode("append").parquet(inbox)
        done = reconcile.judge_arriving(session.outcomes(spark.readStream.schema(found.schema).parquet(inbox)), folder)
    return session.in_order(session.stop_if_blocked(done, 3))


QUERIES = {
    "stream_budget": (stream_budget, f"""WITH e AS (SELECT user_id % 30 AS scope, event_id AS ord, event_type != 'view' AS eligible, event_id // 3 % 4 != 0 AS builds, event_id % 3 = 0 AS crashes FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY scope, eligible ORDER BY ord % {_TURNS}, ord) AS n, first_value(builds) OVER (PARTITION BY scope, eligible ORDER BY ord % {_TURNS}, ord) AS built FROM e)
SELECT scope, ord, CASE WHEN eligible AND n <= {_LIMIT} THEN n END AS attempt, CASE WHEN NOT eligible THEN '{session.NOT_ELIGIBLE}' WHEN n > {_LIMIT} THEN '{session.EXHAUSTED}' WHEN NOT built THEN '{session.NOT_BUILT}' WHEN crashes THEN '{session.CONFIRMED}' ELSE '{session.NO_CRASH}' END AS status,
  CAST(row_number() OVER (PARTITION BY scope ORDER BY ord) AS INT) AS place FROM k"""),
    "stream_outcomes": (stream_outcomes, """WITH e AS (SELECT user_id % 30 AS scope, event_id AS ord, event_id % 5 < 3 AS tp, CASE WHEN event_id % 7 != 0 THEN event_id % 11 END AS conf, CASE WHEN event_id % 3 = 0 THEN 'verifier output unparseable' ELSE 'seen' END AS said, CASE WHEN event_id % 11 = 0 THEN 'g' WHEN event_id % 13 = 0 THEN 't' END AS err FROM events)
SELECT scope, ord, CASE WHEN err = 'g' THEN 'GUARDRAIL_BLOCKED' WHEN err = 't' THEN 'VERIFY_ERROR' WHEN tp AND coalesce(conf, 0) >= 7 THEN NULL WHEN tp THEN 'UNCONFIRMED' WHEN said != 'seen' AND coalesce(conf, 0) = 0 THEN 'VERIFY_ERROR' ELSE 'FALSE_POSITIVE' END AS reason,
  CASE WHEN err IS NOT NULL THEN repeat('e', CAST(least(ord % 300, 200) AS INT)) WHEN tp AND coalesce(conf, 0) >= 7 THEN NULL WHEN tp THEN 'verifier confidence ' || coalesce(CAST(conf AS VARCHAR), 'None') || '/10 below gate 7' ELSE said END AS detail, CAST(row_number() OVER (PARTITION BY scope ORDER BY ord) AS INT) AS place FROM e"""),
}
