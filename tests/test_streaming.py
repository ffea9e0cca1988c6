"""Streams: late data behind the watermark is dropped; state carries across micro-batches."""
import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F


from arrearscope.session import shared_dir
from arrearscope.streaming import streams as S
from arrearscope.streaming.tables import BatchTable, Part, run_into


def _events(spark, rows):
    return spark.createDataFrame(rows, S.EVENTS_SCHEMA)


def test_guardrail_state_across_batches_and_late_drop(spark):
    d = shared_dir(spark, "late-test")
    t0 = dt.datetime(2024, 1, 20, 12, 0)
    first = [(i, t0 + dt.timedelta(hours=i), 1, "view", 1.0, '{"k": 1}') for i in range(6)]
    # second file: two new contacts for user 1 (state must carry 6 earlier ones) and one event 10 days old
    second = [(100, t0 + dt.timedelta(hours=10), 1, "click", 1.0, '{"k": 2}'),
              (101, t0 + dt.timedelta(hours=22), 1, "view", 1.0, '{"k": 3}'),
              (102, t0 - dt.timedelta(days=10), 1, "view", 1.0, '{"k": 4}')]
    _events(spark, first).coalesce(1).write.parquet(f"{d}/a")
    _events(spark, second).coalesce(1).write.parquet(f"{d}/b")
    src = (spark.readStream.schema(S.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", True).parquet(d).withColumn("ts", F.col("ts").cast("timestamp")))
    out = spark.read.parquet(S.run_append(S.guardrail_stream(src), "guard-test"))
    got = {r.event_id: (r.contacts_7d, r.blocked_reason) for r in out.collect()}
    assert 102 not in got  # behind the watermark
    assert got[100][0] == 7 and got[100][1] == "Contact cap reached (7/7 in 7 days)"
    assert got[101][0] == 8
    assert got[0] == (1, None)
    assert got[5][1] is None


def test_dedup_counts_each_event_once(spark):
    d = shared_dir(spark, "dedup-test")
    t0 = dt.datetime(2024, 1, 20, 12, 0)
    rows = [(i, t0 + dt.timedelta(minutes=i), 2, "click", 1.0, '{"k": 1}') for i in range(5)]
    _events(spark, rows).write.parquet(f"{d}/a")
    _events(spark, rows).write.parquet(f"{d}/b")
    src = (spark.readStream.schema(S.EVENTS_SCHEMA).option("recursiveFileLookup", True).parquet(d)
           .withColumn("ts", F.col("ts").cast("timestamp")))
    t = BatchTable(spark, {"n": Part("event_type string, n long", keys=["event_type"], sums=["n"])})
    run_into(S.dedup_outcomes(src), t, lambda b: {"n": b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))})
    assert t.read("n").collect()[0].n == 5


def test_accepted_late_event_counts_its_own_week():
    import pandas as pd

    class State:
        exists, hasTimedOut, value = False, False, None

        def getCurrentWatermarkMs(self):
            return 0

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.value, self.exists = value, True

        def setTimeoutTimestamp(self, ms):
            self.timeout = ms

    t0, state = pd.Timestamp("2024-01-01 12:00"), State()

    def batch(*events):
        pdf = pd.DataFrame([(i, 1, t0 + pd.Timedelta(days=d)) for i, d in events], columns=["event_id", "user_id", "ts"])
        return [r for out in S._guard((1,), iter([pdf]), state) for r in out[["event_id", "contacts_7d"]].itertuples(index=False, name=None)]

    assert batch((1, 0.0), (2, 7.5)) == [(1, 1), (2, 1)]
    assert batch((3, 6.9)) == [(3, 2)]  # late but accepted: the contact at day 0 is within its week
    assert state.timeout == int((t0 + pd.Timedelta(days=15.5)).timestamp() * 1000)


# tables that grow by batches

COUNTS = {"counts": Part("k string, n long", keys=["k"], sums=["n"]),
          "latest": Part("k string, v long, text string, gone boolean", keys=["k"], version=["v", "gone"], gone="gone"),
          "all": Part("k string, n long")}


def _batch(spark, rows):
    n = spark.createDataFrame([(k, v) for k, v, _, _ in rows], "k string, n long")
    return {"counts": n, "all": n, "latest": spark.createDataFrame(rows, "k string, v long, text string, gone boolean")}


def _all(t):
    return {p: sorted(map(tuple, t.read(p).collect()), key=str) for p in t.parts}


def test_batches_count_once_in_any_order_and_over_compactions(spark):
    rng = random.Random(1)
    batches = {f"day-{i}": [(rng.choice("abc"), rng.randrange(50), f"t{i}", rng.random() < 0.3) for _ in range(8)] for i in range(9)}
    rows = [r for b in batches.values() for r in b]
    newest = {}
    for k, v, text, gone in rows:
        newest[k] = max(newest.get(k, (-1, False, "")), (v, gone, text))
    want = {"counts": sorted((k, sum(r[1] for r in rows if r[0] == k)) for k in {r[0] for r in rows}),
            "latest": sorted((k, v, t, g) for k, (v, g, t) in newest.items() if not g),
            "all": sorted(((r[0], r[1]) for r in rows), key=str)}
    for every in (0, 3):
        t = BatchTable(spark, COUNTS, compact_every=every)
        names = list(batches)
        rng.shuffle(names)
        for name in names:
            assert t.add(name, _batch(spark, batches[name]))
            # the same batch again, also through another handle, changes nothing, whether a base holds it or not
            assert not BatchTable(spark, COUNTS, t.home).add(name, _batch(spark, batches[name] * 2))
            assert not t.add(names[0], _batch(spark, batches[name]))
        assert _all(t) == want
        t.compact()
        assert t.pending() == [] and _all(t) == want and not t.add("day-0", _batch(spark, rows))
        assert t.add("late", _batch(spark, [("a", 1, "x", False)]))
        assert dict(t.read("counts").collect())["a"] == dict(want["counts"])["a"] + 1


def test_half_written_batches_and_bases_do_not_exist(spark):
    t = BatchTable(spark, COUNTS, compact_every=0)
    t.add("one", _batch(spark, [("a", 1, "x", False)]))
    before = _all(t)
    # a batch and a base whose writer died before their marker
    spark.createDataFrame([("a", 100)], "k string, n long").write.parquet(f"{t.home}/batches/two/counts")
    spark.createDataFrame([("a", 100)], "k string, n long").write.parquet(f"{t.home}/bases/0/counts")
    assert _all(t) == before and t.pending() == ["one"]
    assert t.add("two", _batch(spark, [("a", 2, "y", False)]))
    t.compact()
    assert t.read("counts").collect()[0].n == 3 and _all(t)["latest"] == [("a", 2, "y", False)]
    with pytest.raises(ValueError):
        t.add("three", {"counts": spark.createDataFrame([], "k string, n long")})


def test_empty_table(spark):
    t = BatchTable(spark, COUNTS)
    assert _all(t) == {"counts": [], "latest": [], "all": []} and t.pending() == []
    t.compact()
    assert t.add(1, _batch(spark, [])) is True and _all(t)["all"] == []


def _files(spark, rows, schema, files):
    """Rows in so many files, read one per batch in order of name."""
    d = shared_dir(spark, "restart-in")
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step:(i + 1) * step], schema).coalesce(1).write.parquet(f"{d}/{i:02d}")
        for f in glob.glob(f"{d.removeprefix('file:')}/{i:02d}/*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return d, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(d)


def _contact_log(n, users=6):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1, 9)
    times = sorted(t0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 40)) for _ in range(n))
    return [(i, t, rng.choice([0, 0, rng.randrange(users)]), rng.choice(["view", "click", "error", "purchase"]), 1.0, '{"k": %d}' % rng.randrange(8)) for i, t in enumerate(times)]


def _stream(kind, spark):
    rows = _contact_log(400)
    if kind == "message":
        rng = random.Random(6)
        rows = [(f"a{rng.randrange(9)}", i, f"m{i}", rng.random() < 0.3) for i in range(80)]
        rng.shuffle(rows)
        _, read = _files(spark, rows, "account string, version long, message string, cleared boolean", 4)
        newest = {}
        for a, v, m, c in rows:
            newest[a] = max(newest.get(a, (-1,)), (v, c, m))
        want = sorted((a, v, m, c) for a, (v, c, m) in newest.items() if not c)
        return lambda home, n: S.run_latest_message(read(), home, n), "latest", want
    _, read = _files(spark, rows, S.EVENTS_SCHEMA, 4)

    def events():
        return read().withColumn("ts", F.col("ts").cast("timestamp"))

    if kind == "cap":
        count = {}
        for _, t, u, e, _, _ in rows:
            if e != "purchase":
                day = t.replace(hour=0, minute=0)
                for k in range(7):
                    key = (u, day - dt.timedelta(days=k), day - dt.timedelta(days=k - 7))
                    count[key] = count.get(key, 0) + 1
        return lambda home, n: S.run_contact_cap(events(), home, max_batches=n), "windows", sorted((*k, v) for k, v in count.items())
    segments = spark.createDataFrame([(u, f"s{u % 2}") for u in range(6)], "user_id long, segment string")
    count = {}
    from arrearscope.operators import bandit as B
    from arrearscope.schema import CHANNELS
    for _, _, u, e, _, props in rows:
        if e in ("click", "view"):
            key = (f"s{u % 2}", CHANNELS[int(props[6:-1]) % 4])
            s, f = count.get(key, (0, 0))
            count[key] = (s + (e == "click"), f + (e == "view"))
    return lambda home, n: S.run_bandit(B.outcome_log(events()), segments, home, n), "counts", sorted((*k, *v) for k, v in count.items())


@pytest.mark.parametrize("kind", ["cap", "bandit", "message"])
def test_restart_and_replay_give_the_one_run_table(spark, kind):
    run, part, want = _stream(kind, spark)

    def rows(t):
        return sorted(tuple(r) for r in t.read(part).collect())

    once = run(None, None)
    assert rows(once) == want
    home = shared_dir(spark, "restart")
    seen = []
    for _ in range(6):  # stopped after each batch, started again on the same folder
        t = run(home, 1)
        seen.append(len(t.pending()))
    # after the four files a stateful stream may add one empty batch that only moves its watermark
    assert seen[:4] == [1, 2, 3, 4] and seen[4] == seen[5] <= 5 and rows(t) == want
    # a crash after publishing and before the stream's own commit: the last batch runs again
    ckpt = f"{home.removeprefix('file:')}/checkpoint/commits"
    last = max(int(f) for f in os.listdir(ckpt) if f.isdigit())
    for f in (f"{ckpt}/{last}", f"{ckpt}/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)
    again = run(home, None)
    assert rows(again) == want and len(again.pending()) == seen[-1]
    if kind != "message":
        # state behind the watermark has left
        state = [p["stateOperators"][0] for p in once.last.recentProgress if p["stateOperators"]]
        assert sum(s["numRowsRemoved"] for s in state) > 0
        held = state[-1]["numRowsTotal"]
        assert held < (len(want) if kind == "cap" else 400)


def test_scored_and_rejected_payloads_share_a_batch(spark):
    from arrearscope.plans.scoring import score_service
    from conftest import account_row
    import json
    good = [json.dumps(account_row(customer_id=f"G{i}", dpd=i)) for i in range(6)]
    bad = [json.dumps(account_row(customer_id="young", age=3)), "{cut", json.dumps(account_row(customer_id=None))]
    _, read = _files(spark, [(x,) for x in [*good[:3], bad[0], *good[3:], *bad[1:]]], "payload string", 3)
    home = shared_dir(spark, "score")
    for n in (1, 2, 3, 3):
        t = S.run_score(read(), score_service, home, 1)
        assert len(t.pending()) == n
    assert {r.customer_id for r in t.read("scored").collect()} == {f"G{i}" for i in range(6)}
    rejected = {r.payload: (r.parsed_ok, r.reasons) for r in t.read("rejected").collect()}
    assert set(rejected) == set(bad) and rejected[bad[0]] == (True, ["age not in [18, 100]"]) and not rejected["{cut"][0]
    assert rejected[bad[2]][1] == ["missing customer_id"]


def test_append_stream_goes_on_in_its_folder(spark):
    rows = _contact_log(60)
    d, read = _files(spark, rows, S.EVENTS_SCHEMA, 2)
    home = shared_dir(spark, "append")
    for _ in range(2):
        out = S.run_append(read().select("event_id"), "append", home)
        assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(60))
    spark.createDataFrame([(60, *rows[0][1:])], S.EVENTS_SCHEMA).write.parquet(f"{d}/zz")
    assert spark.read.parquet(S.run_append(read().select("event_id"), "append", home)).count() == 61


def test_guardrail_equals_brute_force_with_a_hot_customer(spark):
    """One customer has a third of all contacts; batches stop and start, bases drop old contacts, late ones are dropped or counted."""
    rows = _contact_log(500, users=40)
    late = [(900, rows[250][1] - dt.timedelta(hours=20), 0, "view", 1.0, "{}"), (901, rows[0][1], 0, "view", 1.0, "{}")]
    rows = rows[:375] + [r for r in late] + rows[375:]
    _, read = _files(spark, rows, S.EVENTS_SCHEMA, 4)
    step = -(-len(rows) // 4)
    seen, clock, want = [], None, {}
    for i in range(4):
        batch = [r for r in rows[i * step:(i + 1) * step] if r[3] in ("view", "click", "error") and (clock is None or r[1] >= clock - dt.timedelta(days=1))]
        seen += batch
        for e, t, u, *_ in batch:
            want[e] = sum(1 for _, s, v, *_ in seen if v == u and t - dt.timedelta(days=7) <= s <= t)
        clock = max([r[1] for r in seen])
    assert 901 not in want
    home = shared_dir(spark, "guard")

    def events():
        return read().withColumn("ts", F.col("ts").cast("timestamp"))

    for _ in range(5):
        t = S.run_guardrail(events(), home, max_batches=1)
        t.compact()
    got = {r.event_id: (r.contacts_7d, r.blocked_reason) for r in t.read("decisions").collect()}
    assert {e: n for e, (n, _) in got.items()} == want
    assert all((why == f"Contact cap reached ({n}/7 in 7 days)") == (n >= 7) for n, why in got.values())
    assert t.read("contacts").count() < len(seen) and t.read("decisions").count() == len(seen)


def test_payload_batches_do_not_grow_with_the_tasks_that_write(spark):
    from conftest import SF_SMALL
    from arrearscope.plans import stream_queries as SQ
    from arrearscope.plans.scoring import score_service
    from arrearscope.sources.tables import table
    from arrearscope.streaming import streams as S
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(old, ("false", "12", "-1")):  # 12 tasks of four parts each: 48 files, a batch each before
            spark.conf.set(c, v)
        t = S.run_score(SQ._payloads(spark, SF_SMALL), score_service)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(t.folder.names("batches")) + len(t.folder.names("bases")) <= 4
    assert t.read("scored").count() == table(spark, SF_SMALL, "customer").count()
