"""Saved steps that are compacted and forgotten."""

from sievemill.operators import rounds, state

SAVED = "run_id string, step string, payload string, seq long"


def test_compact_and_forget(spark):
    folder = rounds.new_folder(spark, "saved")
    first = [("r/1", "a", "old", 1), ("r/1", "b", "x", 1), ("2", "a", "y", 5), (None, "a", "z", 1)]
    for rows in (first, [("r/1", "a", "new", 2)], [("r/1", "a", "late", 1), ("3", "a", "w", 1)]):
        state.save(spark.createDataFrame(rows, SAVED), folder)
    saved = lambda: spark.read.schema(SAVED).parquet(folder)
    held = {("r/1", "a", "new"), ("r/1", "b", "x"), ("2", "a", "y"), ("3", "a", "w")}
    before = len(saved().inputFiles())
    for _ in range(2):
        state.compact(spark, folder)
        assert {(r.run_id, r.step, r.payload) for r in saved().collect()} == held and saved().count() == 4
    assert len(saved().inputFiles()) == 3 < before
    # a row saved later still wins
    state.save(spark.createDataFrame([("2", "a", "newer", 6), ("2", "a", "older", 4)], SAVED), folder)
    assert {(r.run_id, r.payload) for r in state.latest(saved()).collect() if r.run_id == "2"} == {("2", "newer")}
    assert state.forget(spark, folder, ["r/1", "nothing"]) == 2
    assert {r.run_id for r in saved().collect()} == {"2", "3"}
    assert state.forget(spark, folder, ["r/1"]) == 0
