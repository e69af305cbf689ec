"""The intake's state: one batch, ten batches and a restart give the same tables; rounds, the budget's cut, late rows."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from labelscope.streaming import stateful as ST
from labelscope.streaming.intake import stored

DAY = datetime(2024, 5, 1, tzinfo=timezone.utc)
SCHEMA = "response_id long, id long, at timestamp, value string, usd double"


def at(hours):
    return DAY + timedelta(hours=hours)


def answers(n=300, seed=1):
    """Answers in the order of time; one id has a third of them."""
    rng = random.Random(seed)
    return [(k, 7 if rng.random() < 0.33 else rng.randrange(60), at(k * 0.5 // 1), rng.choice(["good", "bad", "bad", "error"]), float(rng.randrange(1, 4))) for k in range(n)]


def wanted(rows, asked, cap=None):
    taken, spent, out = set(), 0.0, {}
    for k, i, _, value, usd in rows:
        status = "stray" if i not in asked else "invalid" if value == "error" else "duplicate" if i in taken else "accepted"
        if status == "accepted":
            taken.add(i)
        out[k] = status if cap is None or spent < cap else "over budget"
        spent += usd if out[k] != "over budget" else 0
    return out, spent


def put(spark, rows, root, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/in/part={name}")


def source(spark, root):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*")


@pytest.mark.parametrize("batches, cap", [(1, None), (10, None), (1, 200.0), (10, 200.0)])
def test_first_answers_do_not_depend_on_batches_or_restarts(spark, tmp_path, batches, cap):
    rows, asked = answers(), set(range(0, 50)) - {3}
    requests = spark.createDataFrame([(i,) for i in [*asked, 5]], "id long")
    root = str(tmp_path)
    size = -(-len(rows) // batches)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    run = lambda: ST.intake(source(spark, root), requests, root, f"{root}/checkpoint", cap=cap, valid=F.col("value") != "error").awaitTermination()
    for number, part in enumerate(parts):
        put(spark, part, root, f"{number:02d}")
        if number in (0, 3):  # the stream ends and starts again here
            run()
    run()
    run()
    got = [*stored(spark, root, "labels").collect(), *stored(spark, root, "quarantine").collect()]
    want, spent = wanted(rows, asked, cap)
    assert Counter((r.response_id, r.status) for r in got) == Counter(want.items())
    assert {r.status for r in got} == {"accepted", "duplicate", "stray", "invalid", *(["over budget"] if cap else [])}
    if cap:
        total = spark.read.parquet(f"{root}/spent").agg(F.sum("usd")).first()[0]
        assert total == spent and cap <= spent < cap + 4  # passed by one answer at most


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    """An id without answers for longer than the horizon leaves the state; within it, it is known."""
    root = str(tmp_path)
    requests = spark.createDataFrame([(i,) for i in range(40)], "id long")
    for number in range(4):
        put(spark, [(number * 100 + i, i + 10 * number, at(number * 48 + i), "good", 1.0) for i in range(10)], root, str(number))
    put(spark, [(900, 30, at(3 * 48 + 12), "good", 1.0), (901, 0, at(3 * 48 + 12), "good", 1.0)], root, "9")
    query = ST.intake(source(spark, root), requests, root, f"{root}/checkpoint", horizon_s=86400, late="1 hour")
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) <= 21 and rows[-1] <= 12  # never all forty
    status = {r.response_id: r.status for r in [*stored(spark, root, "labels").collect(), *stored(spark, root, "quarantine").collect()]}
    assert status[900] == "duplicate" and status[901] == "accepted"


def outcomes(events, patience, rounds, mark):
    """Outcomes by following each request through its events."""
    out = []
    for i in {e[0] for e in events}:
        own = sorted((t, {"request": 0, "refused": 1, "answered": 2}[k], k) for j, k, t in events if j == i and k in ("request", "refused", "answered"))
        attempt, due = 0, None
        for t, _, kind in [*own, (None, 0, "")]:
            while attempt and due is not None and (due <= t if t is not None else due < mark):
                if attempt == rounds:
                    out.append((i, due, "error", attempt))
                    due = None
                    break
                attempt += 1
                out.append((i, due, "retry", attempt))
                due += timedelta(seconds=patience)
            if attempt and due is None:
                break
            if kind == "request" and not attempt:
                attempt, due = 1, t + timedelta(seconds=patience)
            elif kind in ("answered", "refused") and attempt:
                out.append((i, t, kind, attempt))
                break
    return Counter(out)


@pytest.mark.parametrize("batches, restart", [(1, False), (6, False), (6, True)])
def test_rounds_and_their_timers(spark, tmp_path, batches, restart):
    rng = random.Random(4)
    events = [(i, "request", at(rng.random() * 40)) for i in range(40)]
    for i in range(60):
        for _ in range(rng.randrange(3)):
            events.append((i, rng.choice(["answered", "refused", "other", "request"]), at(rng.random() * 90)))
    events += [(0, "request", at(5)), (41, "request", at(1)), (41, "answered", at(1 + 10)), (42, "request", at(2)), (42, "refused", at(2)), (42, "answered", at(2)), (99, "other", at(100))]
    events.sort(key=lambda e: e[2])
    root, size = str(tmp_path), -(-len(events) // batches)

    def run():
        stream = spark.readStream.schema("id long, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*")
        ST.request_rounds(stream, 10 * 3600, 3, "1 hour").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()

    for number in range(batches):
        part = events[number * size : (number + 1) * size]
        spark.createDataFrame(part, "id long, kind string, at timestamp").coalesce(1).write.parquet(f"{root}/in/part={number}")
        if restart and number % 2:
            run()
    run()
    got = Counter((r.id, r.at.astimezone(timezone.utc), r.outcome, r.attempt) for r in spark.read.parquet(f"{root}/out").collect())
    want = outcomes(events, 36000, 3, at(99))
    assert got == want
    assert {o for _, _, o, _ in want} == {"answered", "refused", "error", "retry"}
    ended = [i for i, _, o, _ in got if o != "retry"]
    assert len(ended) == len(set(ended))


def test_budget_cut_in_order(spark):
    rows = [(k, at(k % 7), None if k == 5 else float(k % 3)) for k in range(50)]
    df = spark.createDataFrame(rows, "response_id long, at timestamp, usd double").repartition(5)
    before, want = 3.0, {}
    for k, _, usd in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k] = before < 20
        before += usd or 0
    assert {r.response_id: r.within for r in ST.within_budget(df, 3.0, 20.0).collect()} == want
    assert ST.within_budget(df.limit(0), 0.0, 1.0).count() == 0
    assert not any(r.within for r in ST.within_budget(df, 20.0, 20.0).collect())


@pytest.mark.parametrize("restart", [False, True])
def test_late_rows_are_kept_and_counted(spark, tmp_path, restart):
    rng = random.Random(9)
    parts = [[(b * 100 + i, at(b * 3 + rng.random() * 3 - (8 * (rng.random() < 0.3))) if i else None) for i in range(40)] for b in range(5)]
    root = str(tmp_path)

    def run():
        stream = spark.readStream.schema("k long, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*")
        ST.split_late(stream, root, f"{root}/check", "t").awaitTermination()

    for b, rows in enumerate(parts):
        spark.createDataFrame(rows, "k long, t timestamp").coalesce(1).write.parquet(f"{root}/in/part={b}")
        if restart:
            run()
    run()
    late, latest = set(), None
    for rows in parts:
        for k, t in rows:
            ends = None if t is None else t.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
            if t is None or latest is not None and ends <= latest - timedelta(minutes=10):
                late.add(k)
        latest = max(x for x in [latest, *(t for _, t in rows)] if x is not None)
    got = {n: [r.k for r in spark.read.parquet(f"{root}/{n}").collect()] for n in ("on_time", "late")}
    assert set(got["late"]) == late and len(got["late"]) == len(late) > 10
    assert sorted(got["late"] + got["on_time"]) == sorted(k for rows in parts for k, _ in rows)
    counts = spark.read.parquet(f"{root}/counts").agg(F.sum("on_time"), F.sum("late")).first()
    assert tuple(counts) == (len(got["on_time"]), len(late))
