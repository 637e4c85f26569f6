"""Context windows and selectors: literal cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from alertweave.operators import context as C
from alertweave.operators import ordering as O
from alertweave.operators import select as S
from alertweave.operators.folds import ratio_split


def alerts(spark, rows):
    return spark.createDataFrame(rows, "row_id long, scenario string, machine string, timestamp long, event_id int")


def random_alerts(seed, n=400, machines=5, span=4_000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # machine 0 holds more than a third of the rows, and one second of it a third of those
        m = 0 if rng.random() < 0.4 else rng.randrange(machines)
        ts = 1_000 if m == 0 and rng.random() < 0.33 else rng.randrange(span)
        rows.append((i, f"s{m % 2}", f"s{m % 2}::m{m}", ts, rng.randrange(9)))
    return rows


def brute_strict(rows, n, timeout):
    out = {}
    for r in rows:
        past = sorted((p[3], p[0], p[4]) for p in rows if p[2] == r[2] and p[3] < r[3])
        out[r[0]] = [e for t, _, e in past[-n:] if r[3] - t <= timeout]
    return out


def brute_companions(rows, k, window):
    out = {}
    for r in rows:
        past = sorted((p[3], p[0], p[4]) for p in rows if p[1] == r[1] and p[2] != r[2] and p[3] < r[3] and r[3] - p[3] <= window)
        out[r[0]] = [e for _, _, e in past[-k:]]
    return out


def brute_arrival(rows, n):
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))
    out = {}
    for i, r in enumerate(ordered):
        out[r[0]] = [p[4] for p in ordered[:i] if p[2] == r[2]][-n:]
    return out


def collected(df, column="context"):
    return {r["row_id"]: [s["event_id"] for s in r[column]] for r in df.collect()}


def test_strict_past_literal(spark):
    df = alerts(spark, [(i, "s", "s::h", t, i) for i, t in enumerate([1, 1, 2, 4])])
    got = C.strict_past_context(df, 3, 2).withColumn("padded", C.left_pad(C.ids("context"), 3, 4))
    assert [r["padded"] for r in got.orderBy("row_id").collect()] == [[4, 4, 4], [4, 4, 4], [4, 0, 1], [4, 4, 2]]


def test_candidates_literal(spark):
    rows = [(0, "s", "a", 1, 0), (1, "s", "a", 1, 0), (2, "s", "a", 2, 0), (3, "s", "a", 3, 0), (4, "s", "b", 2, 0)]
    got = C.strict_past_candidates(alerts(spark, rows), 3, 10)
    padded = C.left_pad(C.ids("candidates", "row_id"), 3, F.lit(-1).cast("long"))
    assert [r["p"] for r in got.select("row_id", padded.alias("p")).orderBy("row_id").collect()] == [
        [-1, -1, -1], [-1, -1, -1], [-1, 0, 1], [0, 1, 2], [-1, -1, -1]]
    far = C.strict_past_candidates(alerts(spark, [(0, "s", "a", 1, 0), (1, "s", "a", 4, 0)]), 2, 2)
    assert [len(r["candidates"]) for r in far.collect()] == [0, 0]


@pytest.mark.parametrize("seed,n,timeout", [(1, 3, 50), (2, 10, 700), (3, 25, 5_000)])
def test_strict_past_brute_force(spark, seed, n, timeout):
    rows = random_alerts(seed)
    assert collected(C.strict_past_context(alerts(spark, rows), n, timeout)) == brute_strict(rows, n, timeout)


@pytest.mark.parametrize("seed,k,window", [(4, 1, 40), (5, 3, 300), (6, 5, 5_000)])
def test_companions_brute_force(spark, seed, k, window):
    rows = random_alerts(seed)
    assert collected(C.companion_context(alerts(spark, rows), k, window), "companions") == brute_companions(rows, k, window)


def test_arrival_brute_force_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "_CHUNK_ROWS", 40)
    rows = random_alerts(7)
    assert collected(C.arrival_context(alerts(spark, rows), 6)) == brute_arrival(rows, 6)


def test_short_long(spark):
    df = alerts(spark, [(i, "s", "m", 10 * i, e) for i, e in enumerate([1, 2, 1, 3, 4, 5])])
    row = {r["row_id"]: r for r in C.short_long_context(df, 2, 2, 10, 1_000).collect()}[5]
    assert list(row["short_context"]) == [3, 4] and list(row["long_memory"]) == [2, 1]


def test_preceding_windows(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "t array<int>").select(
        F.transform(C.preceding_windows(F.col("t"), 2), lambda w: C.left_pad(w, 2, 9)).alias("w"))
    assert df.first()["w"] == [[9, 9], [9, 1], [1, 2]]


def test_running_position_and_sums(spark):
    df = spark.range(0, 1_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = O.running_sums(df, ["k"], ["o"], {"pos": F.lit(1).cast("long"), "total": F.col("v")}).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["o"]):
        n, s = seen.get(r["k"], (0, 0))
        assert (r["pos"], r["total"]) == (n, s)
        seen[r["k"]] = (n + 1, s + r["v"])


@pytest.mark.parametrize("want", [1, 37, 400, 2_000])
def test_take_smallest(spark, want):
    df = spark.range(0, 600).select((F.col("id") % 2).alias("g"), F.col("id"), ((F.col("id") * 37) % 101).alias("v"), F.lit(want).alias("w"))
    levels = [F.floor(F.col("v") / 10), F.col("v"), F.col("id")]
    taken = [(r["g"], r["v"], r["id"]) for r in O.take_smallest(df, ["g"], "w", levels).filter("taken").collect()]
    rows = [(i % 2, (i * 37) % 101, i) for i in range(600)]
    expected = [r for g in (0, 1) for r in sorted([x for x in rows if x[0] == g], key=lambda x: x[1:])[:want]]
    assert sorted(taken) == sorted(expected)


@pytest.mark.parametrize("n,ratio,expected", [(10, 0.2, 2), (5, 0.01, 1), (4, 0.99, 3)])
def test_ratio_split(spark, n, ratio, expected):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    got = ratio_split(df, ratio, [F.floor(F.col("row_id") / 3), F.col("row_id")])
    assert sorted(r["row_id"] for r in got.filter("split = 'train'").collect()) == list(range(expected))


def pool(spark, events, incidents=None):
    incidents = incidents or [0] * len(events)
    rows = [[(i, e, y) for i, (e, y) in enumerate(zip(events, incidents))]]
    return spark.createDataFrame([(r,) for r in rows], "p array<struct<row_id:int,event_id:int,event_incident:int>>")


@pytest.mark.parametrize("incident,k,expected", [([1, 0, 1, 0], 3, [10, 12, 13]), ([1, 1, 1, 1], 2, [12, 13])])
def test_predecessor_oracle(spark, incident, k, expected):
    df = pool(spark, [10, 11, 12, 13], incident)
    assert df.select(C.ids(S.predecessor_oracle(F.col("p"), k)).alias("x")).first()["x"] == expected


TOY_BANDS = ((1, 2), (3, 4))
TOY_WEIGHTS = [0.0] * 8  # band-major, four events
TOY_WEIGHTS[0 * 4 + 1] = 3.0
TOY_WEIGHTS[1 * 4 + 2] = -2.0


def toy(spark, rows=(0, 1, 2, 3), events=(0, 2, 1, 3)):
    slots = [[(r, events[r]) for r in rows]]
    df = spark.createDataFrame([(s,) for s in slots], "p array<struct<row_id:int,event_id:int>>")
    return df.withColumn("w", F.array(*[F.lit(x) for x in TOY_WEIGHTS])).withColumn("v", F.lit(4))


def toy_pick(df, fn, k, *extra, **kw):
    chosen = fn(F.col("p"), k, *extra, F.col("w"), F.col("v"), lambda x: x["event_id"], bands=TOY_BANDS, **kw)
    return df.select(C.ids(chosen, "row_id").alias("x")).first()["x"]


def test_association_selectors(spark):
    df = toy(spark)
    assert toy_pick(df, S.association_abs, 2) == [1, 2]
    assert toy_pick(df, S.class_oracle, 1, label=F.lit(1)) == [2]
    assert toy_pick(df, S.class_oracle, 1, label=F.lit(0)) == [1]
    assert toy_pick(df, S.anchored_association, 3, 2) == [1, 2, 3]
    assert toy_pick(toy(spark, rows=(0,)), S.anchored_association, 3, 2) == [0]
    with pytest.raises(ValueError):
        S.anchored_association(F.col("p"), 3, 3, F.col("w"), F.col("v"), lambda x: x)


def test_recency_bands(spark):
    rank = spark.range(1, 7).select(S.recency_band(7 - F.col("id"), ((1, 2), (3, 6))).alias("b"))
    assert [r["b"] for r in rank.collect()] == [1, 1, 1, 1, 0, 0]
    with pytest.raises(ValueError):
        S.check_bands(8, ((1, 2), (3, 6)))


def test_landmarks(spark):
    df = spark.createDataFrame([([1, 2, 1, 3, 1],)], "v array<int>")
    row = df.select(
        S.recent_distinct(F.col("v"), 2).alias("d"), S.uniform(F.col("v"), 3).alias("u"), S.rarity(F.col("v"), 3).alias("r"),
        S.uniform(F.col("v"), 1).alias("one"),
    ).first()
    assert (row["d"], row["u"], row["r"], row["one"]) == ([3, 1], [1, 1, 1], [2, 3, 1], [1])


def test_stream_equals_batch(spark, tmp_path):
    """A folder of files out of order, one machine with many alerts, the last second released by the closing row."""
    from alertweave.streaming import contexts as X

    X.use_state_store(spark)
    rows = [("a", 100 + i // 3, i, i % 5) for i in range(600)] + [("b", 50 + 7 * i, 1_000 + i, i % 4) for i in range(60)]
    schema = "machine string, timestamp long, row_id long, event_id int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[400:], rows[:400]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
    stream = lambda: X.stream_strict_past_context(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 4, 60, "1000 seconds")
    for closing in (False, True):
        if closing:
            X.closing_row(spark, 5_000).write.mode("append").parquet(source)
        job = stream().writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
        job.awaitTermination()
        assert X.late_rows(job) == 0
    got = {r["row_id"]: list(r["context"]) for r in spark.read.parquet(out).collect()}
    batch = C.strict_past_context(spark.createDataFrame(rows, schema), 4, 60)
    want = {r["row_id"]: [s["event_id"] for s in r["context"]] for r in batch.collect()}
    assert got == want


def test_stream_holds_one_block(monkeypatch):
    """However many alerts of a machine wait, an expiry reads its own second and returns blocks."""
    from types import SimpleNamespace

    import pandas as pd

    from alertweave.streaming import contexts as X

    class Map(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.get, dict.__setitem__, dict.pop

    class List(list):
        get, appendList = list.copy, list.extend

        def put(self, values):
            self[:] = values

    timers = set()
    handle = SimpleNamespace(getListState=lambda *_: List(), getMapState=lambda *_: Map(), registerTimer=timers.add)
    monkeypatch.setattr(X, "BLOCK", 100, raising=False)
    processor = X.StrictPastProcessor(4, 60)
    processor.init(handle)
    rows = [(1_000, i, i % 5) for i in range(1_050)] + [(1_001 + i, 2_000 + i, i % 7) for i in range(3_000)]
    random.Random(3).shuffle(rows)
    batches = [pd.DataFrame(rows[at : at + 500], columns=["timestamp", "row_id", "event_id"]) for at in range(0, len(rows), 500)]
    list(processor.handleInputRows(("m",), iter(batches), None))
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10_000_000)
    frames = [f for t in sorted(timers) for f in processor.handleExpiredTimer(("m",), now, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))]
    assert max(map(len, frames)) <= 100
    got = {r: list(c) for f in frames for r, c in zip(f["row_id"], f["context"])}
    history, want = [], {}
    for t, r, e in sorted(rows):
        past = [x for x in history[-1_060:] if x[0] < t][-4:]
        want[r] = [x[2] for x in past if t - x[0] <= 60]
        history.append((t, r, e))
    assert got == want and not processor.waiting and not processor.blocks


def test_stream_visits_the_store_once_for_gathered_frames():
    """Frames of a second that arrive one after another go to the state store together."""
    from types import SimpleNamespace

    import pandas as pd

    from alertweave.streaming import contexts as X

    visits = []

    class Map(dict):
        containsKey, getValue = dict.__contains__, dict.get

        def updateValue(self, key, value):
            visits.append(key)
            self[key] = value

    processor = X.StrictPastProcessor(4, 60)
    processor.init(SimpleNamespace(getListState=lambda *_: None, getMapState=lambda *_: Map(), registerTimer=lambda _: None))
    frames = [pd.DataFrame({"timestamp": [1, 2, 3], "row_id": [3 * i, 3 * i + 1, 3 * i + 2], "event_id": [0, 1, 2]}) for i in range(50)]
    list(processor.handleInputRows(("m",), iter(frames), None))
    assert len(visits) == 6 and sorted(r for ids, _ in processor.waiting.values() for r in ids) == list(range(150))


def test_rarity_counts_copies_without_comparing_pairs(spark):
    df = spark.createDataFrame([([7, 7, 5, None, 5, 7, 3],)], "v array<int>").select(S.rarity(F.col("v"), 3).alias("x"))
    assert df.first()["x"] == [None, 5, 3]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 0


def test_a_second_of_a_machine_is_worked_out_once(spark):
    """Thirty alerts of one second share a context row, and lookups of its slots do not grow with them."""
    from alertweave.operators import joins as J

    rows = [(i, "s", "m", 100 + i, i) for i in range(3)] + [(10 + i, "s", "m", 200, 7) for i in range(30)]
    df = alerts(spark, rows).withColumn("event_incident", F.lit(0)).withColumn("event_incident_group", F.lit(None).cast("string"))
    seconds = C.strict_past_seconds(df, 5)
    got = {r["timestamp"]: [x["row_id"] for x in r["context"]] for r in seconds.collect()}
    assert got == {100: [], 101: [0], 102: [0, 1], 200: [0, 1, 2]} and seconds.count() == 4
    lists = seconds.select("machine", "timestamp", C.ids("context", "row_id").alias("candidates"))
    looked = J.gather(lists, df, keys=["machine", "timestamp"])
    assert sorted((r["timestamp"], r["slot"], r["event_id"]) for r in looked.collect()) == [(101, 0, 0), (102, 0, 0), (102, 1, 1), (200, 0, 0), (200, 1, 1), (200, 2, 2)]


def test_presences_of_equal_targets_are_counted_with_their_number(spark):
    from alertweave.operators import association as AS

    rows = [(i, "s", "m", 100 + i, i % 2) for i in range(4)] + [(10 + i, "s", "m", 200, i % 2) for i in range(20)]
    df = alerts(spark, rows).withColumn("event_incident", (F.col("row_id") % 3 == 0).cast("int"))
    each = C.strict_past_candidates(df, 100)
    keys = ["scenario", "machine", "timestamp", "event_id", "event_incident"]
    once = df.groupBy(*keys).agg(F.count("*").alias("n")).join(C.strict_past_seconds(df, 100, name="candidates"), ["machine", "timestamp"])
    table = lambda d: sorted(tuple(r) for r in d.collect())
    assert table(AS.presence_counts(each, "event_incident")) == table(AS.presence_counts(once, "event_incident", weight="n"))
    assert once.count() < each.count()
