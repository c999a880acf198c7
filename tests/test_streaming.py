from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import changes, idlog

KIND = "key string, id long, ts timestamp, status string, fingerprint string"


def _events(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([("k", n, dt.datetime(2024, 1, 1, 0, n), s, f) for n, s, f in rows], KIND).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _drain(spark, df, tmp_path):
    changes.tick(df, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_recorded_on_change(spark, tmp_path):
    stream = _events(spark, tmp_path, [[(1, "in_sync", "a"), (2, "drifted", "b"), (3, "drifted", "b"), (4, "unreachable", "b"), (5, "in_sync", "a"), (6, "in_sync", "a")]])
    rows = _drain(spark, changes.recorded_on_change(stream), tmp_path).orderBy("id").collect()
    assert [(r.id, r.alert) for r in rows] == [(1, "nothing"), (2, "drifted"), (4, "unreachable"), (5, "reachable")]


def test_repeats_within_the_delay(spark, tmp_path):
    stream = _events(spark, tmp_path, [[(1, "a", None), (2, "a", None)], [(2, "a", None), (3, "a", None)]])
    assert sorted(r.id for r in _drain(spark, changes.without_late_repeats(stream), tmp_path).collect()) == [1, 2, 3]


def test_silent_keys_restarts_and_triggers(spark, tmp_path):
    """Gaps are told once each, by the next event or by a timer; a restarted query goes on from its state; the cut into triggers doesn't matter."""
    day = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    events = [("a", 1, day(0), "in_sync", "x"), ("b", 2, day(1), "drifted", "y"), ("a", 3, day(2), "in_sync", "x"), ("b", 4, day(12), "drifted", "z"), ("c", 5, day(13), "unreachable", None), ("a", 6, day(30), "drifted", "w"), ("c", 7, day(31), "in_sync", None), ("d", 8, day(60), "in_sync", "q")]
    want = {(1, "nothing"), (2, "drifted"), (4, "changed"), (5, "unreachable"), (6, "drifted"), (7, "reachable"), (8, "nothing")}
    gaps = {("a", day(8)), ("a", day(36)), ("b", day(7)), ("b", day(18)), ("c", day(19)), ("c", day(37))}
    for cut in ([8], [3, 2, 3]):
        top = tmp_path / f"cut{len(cut)}"
        at = 0
        for n in cut:  # one start of the query for each part: a restart each
            spark.createDataFrame(events[at : at + n], KIND).coalesce(1).write.parquet(str(top / "in"), mode="append")
            at += n
            stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(top / "in"))
            rows = _drain(spark, changes.recorded_on_change(stream, "6 hours"), top).collect()
        assert {(r.id, r.alert) for r in rows if r.id} == want
        assert {(r.key, r.ts) for r in rows if r.id is None} == gaps and sum(r.id is None for r in rows) == len(gaps)


def test_ids_saved_late_come_once(spark, tmp_path):
    """Late ids within the lookback, repeats, gaps that stay, nulls, ids up to the baseline, an empty log, restarts between appends."""
    kind = "id long, note string"
    appended = [([], []), ([1, 2, 5, 9], [5, 9]), ([10, 7, 9, 9, None], [7, 10]), ([4, 2, 8, 30, 31], [8, 30, 31]), ([11, 25, 33, 33], [25, 33]), ([25, 30], [])]
    have = []
    for n, (ids, want) in enumerate(appended):
        spark.createDataFrame([(i, f"n{i}") for i in ids], kind).repartition(2).write.parquet(str(tmp_path / "in"), mode="append")
        rows = _drain(spark, idlog.stream(spark, str(tmp_path / "in"), kind, "id", baseline=4, lookback=8, ids_a_task=3), tmp_path).collect() if n else []
        have += want
        assert sorted(r.id for r in rows) == sorted(have) and all(r.note == f"n{r.id}" for r in rows)


def test_a_key_is_one_row_to_and_from_python(spark, tmp_path):
    """An event is one text on its way in, whatever its status and fingerprint; a key's rows of a trigger are one row on the way out."""
    events = [("k", n, dt.datetime(2024, 1, 1, 0, n), s, f) for n, (s, f) in enumerate([("in_sync", "= 3 é"), ("", ""), (" 𝕏 =", None), ("a=b", "=c"), (None, "=c"), (None, None)])]
    frame = spark.createDataFrame(events, KIND)
    packed = frame.withColumn("at", F.unix_micros("ts")).select(changes._packed().alias("event"), "at")
    assert [changes.unpacked(r.event) for r in packed.collect()] == [(r.at, *e[1:2], *e[3:]) for r, e in zip(packed.collect(), events)]
    class Held:
        state = None
        exists = lambda self: self.state is not None
        get = lambda self: self.state
        def update(self, state):
            self.state = state
    made = changes._recorder(None)
    made.held = Held()
    rows = list(made.handleInputRows(("k",), packed.collect(), None))
    assert len(rows) == 1 and rows[0].id == [0, 1, 2, 3, 4] and rows[0].fingerprint == ["= 3 é", "", None, "=c", "=c"]
