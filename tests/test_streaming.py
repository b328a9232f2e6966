"""Debounce, event application, classification and counts, in batch and on streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeledger.operators.rules import load_rules
from lakeledger.sources.events import files_only, parse_events, read_events
from lakeledger.streaming import changes as G, debounce as E, progress

START = dt.datetime(2024, 1, 1)
SCHEMA = "root STRING, path STRING, kind STRING, dest_path STRING, event_id BIGINT, ts TIMESTAMP"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def events(spark, *rows):
    full = [(r[0], r[1], r[2], r[3] if len(r) > 4 else None, i, at(r[-1])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def model(rows, gap, keys):
    """Timers, one per key: every event restarts its timer; when it fires, the last event per path goes out."""
    out, pending = [], {}
    for row in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        key = tuple(row[k] for k in keys)
        held = pending.get(key)
        if held and row["ts"] > held["end"] + dt.timedelta(seconds=gap):
            out += [(p, e["kind"], e["dest_path"], n) for p, (e, n) in held["last"].items()]
            held = None
        if not held:
            held = pending[key] = {"last": {}}
        held["end"] = row["ts"]
        held["last"][row["path"]] = (row, held["last"].get(row["path"], (None, 0))[1] + 1)
    for held in pending.values():
        out += [(p, e["kind"], e["dest_path"], n) for p, (e, n) in held["last"].items()]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["path"], r["kind"], r["dest_path"], r["n_events"]) for r in df.collect()), key=repr)


def noise(spark, n, seed, span):
    rng = random.Random(seed)
    kinds = ["created", "modified", "deleted", "moved"]
    rows = []
    for _ in range(n):
        root = rng.choice("aab")
        rows.append((f"/{root}", f"/{root}/f{rng.randint(0, 4)}", rng.choice(kinds), rng.choice([None, "/x"]),
                     rng.choice([rng.uniform(0, span), float(rng.randint(0, span))])))
    return events(spark, *rows)


def test_burst_keeps_the_last_event_per_path(spark):
    df = events(spark, ("/w", "/w/a", "created", 0.0), ("/w", "/w/a", "modified", 1.5), ("/w", "/w/b", "created", 3.5),
                ("/w", "/w/a", "deleted", 5.6), ("/v", "/v/a", "created", 4.0))
    got = {(r["path"], r["kind"], r["n_events"], (r["fires_at"] - r["session_end"])) for r in E.debounce(df).collect()}
    # 2.0 s after the last event still belongs to the burst, 2.1 s does not
    assert got == {("/w/a", "modified", 2, 2_000_000), ("/w/b", "created", 1, 2_000_000),
                   ("/w/a", "deleted", 1, 2_000_000), ("/v/a", "created", 1, 2_000_000)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_debounce_equals_timers(spark, seed):
    df = noise(spark, 300, seed, 400)
    rows = df.collect()
    assert result(E.debounce(df)) == model(rows, 2.0, ["root"])
    assert result(E.debounce_by_path(df)) == model(rows, 2.0, ["root", "path"])
    assert result(E.debounce(df, 0.75)) == model(rows, 0.75, ["root"])


def feed(spark, tmp_path, df, n_files):
    """The events as parquet files in time order, read one file per micro-batch."""
    folder = str(tmp_path / "feed")
    rows = sorted(df.collect(), key=lambda r: r["ts"])
    size = -(-len(rows) // n_files)
    for i in range(n_files):
        part = rows[i * size:(i + 1) * size]
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def end_of_time(spark):
    return spark.createDataFrame([("/end", "/end/x", "created", None, 10**9, at(10**6))], SCHEMA)


def run_by_path(spark, stream, folder, delay="0 seconds", gap=2.0):
    with E.with_timers(spark):
        out = E.debounce_by_path_stream(stream, gap, delay=delay)
        query = (out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
                 .trigger(availableNow=True).start())
        query.awaitTermination(200)
    return query


def bursts_of(df):
    return sorted(map(tuple, df.select("root", "path", "kind", "dest_path", "event_id", "n_events", "session_start", "session_end", "fires_at").collect()), key=repr)


def test_stream_per_path(spark, tmp_path):
    """All bursts, also those open when the input ends; late rows are counted."""
    df = noise(spark, 150, 7, 300)
    late = events(spark, ("/a", "/a/late", "created", 1.0), ("/a", "/a/late", "created", 2.0))
    stream = feed(spark, tmp_path, df, 3)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    E.end_of_input(spark).select(*df.columns).write.mode("append").parquet(str(tmp_path / "feed"))
    query = run_by_path(spark, stream, tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert bursts_of(got) == bursts_of(E.debounce_by_path(df)) and result(got) == model(df.collect(), 2.0, ["root", "path"])
    assert E.late_rows(query) == 2
    assert progress.stream_progress(query)[0]["event"] == "stream_progress"


def test_stream_per_path_out_of_order_and_restart(spark, tmp_path):
    """Events in any order within the delay join and open bursts; the query is started anew for every file."""
    df = noise(spark, 120, 9, 100)
    rows = df.collect()
    random.Random(1).shuffle(rows)
    folder = str(tmp_path / "feed")
    for part in (rows[:50], rows[50:90], rows[90:], E.end_of_input(spark).select(*df.columns).collect()):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder)
        run_by_path(spark, spark.readStream.schema(SCHEMA).parquet(folder), tmp_path, delay="1 hour")
    assert bursts_of(spark.read.parquet(str(tmp_path / "out"))) == bursts_of(E.debounce_by_path(df))


def test_stream_per_root_and_restart(spark, tmp_path):
    df = noise(spark, 200, 11, 300)
    stream = feed(spark, tmp_path, df.unionByName(end_of_time(spark)), 5)
    sink = E.DebounceSink(str(tmp_path / "out"), str(tmp_path / "state"))
    seen = []

    def step(batch, batch_id):
        seen.append(batch_id)
        sink(batch, batch_id)
        if batch_id == 2:
            sink(batch, batch_id)   # the same batch again, as after a lost driver

    query = (stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination(150)
    assert len(seen) >= 5
    assert result(spark.read.parquet(str(tmp_path / "out"))) == model(df.collect(), 2.0, ["root"])


def test_late_events_are_dropped(spark, tmp_path):
    sink = E.DebounceSink(str(tmp_path / "out"), str(tmp_path / "state"), delay_seconds=1)
    sink(events(spark, ("/w", "/w/a", "created", 0.0), ("/w", "/w/b", "created", 100.0)), 0)
    sink(events(spark, ("/w", "/w/a", "deleted", 1.0), ("/w", "/w/c", "created", 99.5)), 1)
    sink(events(spark, ("/w", "/w/d", "created", 500.0)), 2)
    got = result(spark.read.parquet(str(tmp_path / "out")))
    assert got == [("/w/a", "created", None, 1), ("/w/b", "created", None, 1), ("/w/c", "created", None, 1)]


def test_flush_and_late_events(spark, tmp_path):
    df = noise(spark, 120, 5, 200)
    sink = E.DebounceSink(str(tmp_path / "out"), str(tmp_path / "state"))
    sink(df.filter(F.col("ts") < at(100)), 0)
    sink(df.filter(F.col("ts") >= at(100)), 1)
    sink(events(spark, ("/a", "/a/late", "created", 1.0)), 2)
    assert len(result(spark.read.parquet(str(tmp_path / "out")))) < len(result(E.debounce(df)))
    sink.flush(spark)
    assert result(spark.read.parquet(str(tmp_path / "out"))) == result(E.debounce(df))
    assert [r.path for r in sink.late_events(spark).collect()] == ["/a/late"]


class Store:
    """A state store that counts the calls made to it."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def clear(self):
        self.calls += 1
        self.rows = []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_paths_of_a_bucket_share_calls_to_the_state_store():
    """Bursts of many paths go in by one list and out by one timer; what is open keeps a timer."""
    from pyspark.sql import Row

    store, timers = Store(), E.BurstTimers(2_000_000)
    timers.init(store)
    events = [Row(root="/w", path=f"/w/{i % 100}", kind="created", dest_path=None, event_id=i, at=i // 100 * 10_000_000) for i in range(1000)]
    assert list(timers.handleInputRows((7,), iter(events), Clock(0))) == []
    assert store.calls <= 4 and store.timers == {2000}
    out = list(timers.handleExpiredTimer((7,), Clock(85_000), Clock(2000)))
    assert len(out) == 900 and store.calls <= 8 and store.timers - {2000} == {92_000}
    # an event joins the burst that is open, whose timer moves with it
    list(timers.handleInputRows((7,), iter([Row(root="/w", path="/w/5", kind="deleted", dest_path=None, event_id=5000, at=91_000_000)]), Clock(85_000)))
    out += list(timers.handleExpiredTimer((7,), Clock(95_000), Clock(92_000)))
    assert len(out) == 1000 and sum(r["n_events"] for r in out) == 1001 and not store.rows
    assert [(r["kind"], r["n_events"], r["fires_at"]) for r in out if r["event_id"] == 5000] == [("deleted", 2, 93_000_000)]


def test_sink_looks_for_bursts_once_a_batch(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "with_bursts", lambda *a, found=E.with_bursts: seen.append(1) or found(*a))
    df = noise(spark, 120, 5, 200)
    sink = E.DebounceSink(str(tmp_path / "out"), str(tmp_path / "state"))
    sink(df.filter(F.col("ts") < at(100)), 0)
    sink(df.filter(F.col("ts") >= at(100)), 1)
    assert len(seen) == 2
    sink.flush(spark)
    assert bursts_of(spark.read.parquet(str(tmp_path / "out"))) == bursts_of(E.debounce(df))


CATALOG = "id BIGINT, path STRING, name STRING, extension STRING, size BIGINT, category STRING"


def test_apply_events(spark):
    rows = [(i, f"/w/{n}.txt", f"{n}.txt", ".txt", i, "Documents") for i, n in enumerate("abcdefgh")]
    catalog = spark.createDataFrame(rows, CATALOG)
    df = events(
        spark,
        ("/w", "/w/a.txt", "deleted", 1.0),
        ("/w", "/w/b.txt", "moved", "/w/b2.PDF", 1.0),
        ("/w", "/w/new.py", "created", 1.0),
        ("/w", "/w/c.txt", "moved", "/w/t1", 2.0), ("/w", "/w/t1", "moved", "/w/t2", 3.0), ("/w", "/w/t2", "moved", "/w/t3", 4.0),
        ("/w", "/w/d.txt", "moved", "/w/e.txt", 5.0),                                   # replaces e
        ("/w", "/w/f.txt", "moved", "/w/g.txt", 5.0), ("/w", "/w/g.txt", "moved", "/w/f.txt", 4.0),   # g left first
        ("/w", "/w/h.txt", "modified", 1.0), ("/w", "/w/h.txt", "deleted", 0.5),
    )
    got = {r["path"]: (r["id"], r["name"], r["category"]) for r in G.apply_events(catalog, df).collect()}
    # deleted and then modified: another file
    assert got.pop("/w/new.py")[1:] == ("new.py", "Code") and got.pop("/w/h.txt")[0] > 7
    # g's file went over f at 4 and back to g at 5
    assert got == {"/w/b2.PDF": (1, "b2.PDF", "Documents"), "/w/t3": (2, "t3", "Others"),
                   "/w/e.txt": (3, "e.txt", "Documents"), "/w/g.txt": (6, "g.txt", "Documents")}


def replayed(catalog, rows):
    """Events applied one after the other: {path: path the row comes from, or None}."""
    files = {p: p for p in catalog}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        path, dest = r["path"], r["dest_path"]
        if r["kind"] == "deleted" or (r["kind"] == "moved" and dest is None):
            files.pop(path, None)
        elif r["kind"] == "moved" and dest != path:
            files[dest] = files.pop(path, None)
        else:
            files.setdefault(path, None)
    return files


def ends_of(spark, catalog, df):
    """{path: path the row comes from, or None} by ``apply_events``."""
    ids = {p: i for i, p in enumerate(catalog)}
    rows = [(i, p, "old", ".old", i, "Old") for p, i in ids.items()]
    back = {i: p for p, i in ids.items()}
    done = G.apply_events(spark.createDataFrame(rows, CATALOG), df).collect()
    assert len({r["path"] for r in done}) == len({r["id"] for r in done}) == len(done)
    return {r["path"]: back.get(r["id"]) for r in done}


@pytest.mark.parametrize("seed,names", [(1, 3), (2, 6), (3, 40)])
def test_replay_like_one_by_one(spark, seed, names):
    """Chains, rings, moves over files, paths left and used again, all at random."""
    r = random.Random(seed)
    paths = [f"/w/{i}" for i in range(names)]
    rows = [("/w", r.choice(paths), r.choice(["created", "modified", "deleted", "moved", "moved", "moved"]), r.choice([*paths, None]), i, at(r.randrange(60)))
            for i in range(400)]
    rows = [x if x[2] == "moved" else (*x[:3], None, *x[4:]) for x in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    catalog = paths[::2]
    assert ends_of(spark, catalog, df) == replayed(catalog, df.collect())


def test_path_used_again_after_a_move(spark):
    df = events(spark, ("/w", "/w/a", "moved", "/w/b", 1.0), ("/w", "/w/a", "created", 2.0))
    assert ends_of(spark, ["/w/a"], df) == {"/w/a": None, "/w/b": "/w/a"}
    df = events(spark, ("/w", "/w/a", "deleted", 1.0), ("/w", "/w/a", "created", 2.0), ("/w", None, "created", 3.0))
    assert ends_of(spark, ["/w/a", "/w/z"], df) == {"/w/a": None, "/w/z": "/w/z"}


def test_long_move_chain(spark):
    df = events(spark, *[("/w", f"/w/{i}", "moved", f"/w/{i + 1}", float(i)) for i in range(37)])
    assert ends_of(spark, ["/w/0"], df) == {"/w/37": "/w/0"}
    back = events(spark, ("/w", "/w/a", "moved", "/w/b", 9.0), ("/w", "/w/b", "moved", "/w/c", 5.0))
    assert ends_of(spark, ["/w/a", "/w/b"], back) == {"/w/b": "/w/a", "/w/c": "/w/b"}
    # delivered twice is moved once
    assert ends_of(spark, ["/w/a", "/w/b"], back.unionByName(back)) == {"/w/b": "/w/a", "/w/c": "/w/b"}


def test_one_path_with_most_events_is_scanned_in_slabs(spark):
    from lakeledger.operators import slabs

    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("o")).unionByName(
        spark.range(100).select(F.concat(F.lit("c"), (F.col("id") % 9).cast("string")).alias("k"), F.col("id").alias("o")))
    dealt = slabs.in_slabs(rows.repartition(8), ["k"], ["o"], 8)
    assert dealt.filter("k = 'hot'").select("_slab").distinct().count() > 1
    got = slabs.highest_so_far(slabs.previous(dealt, ["k"], ["o"], F.col("o"), "before"), ["k"], ["o"], F.when(F.col("o") % 50 == 0, F.col("o")), "top")
    last = {}
    for r in sorted(got.collect(), key=lambda r: r["o"]):
        before, top = last.get(r["k"], (None, None))
        top = r["o"] if r["o"] % 50 == 0 else top
        assert (r["before"], r["top"]) == (before, top)
        last[r["k"]] = (r["o"], top)


def test_classify_stream(spark, tmp_path):
    rules = load_rules(spark.createDataFrame([(1, "inv", "*invoice*", "glob", "Invoices", "F", 5, True)],
                                             "id BIGINT, name STRING, pattern STRING, match_type STRING, category STRING, "
                                             "target_folder STRING, priority INT, enabled BOOLEAN"))
    df = events(spark, ("/w", "/w/Invoice1.txt", "created", 1.0), ("/w", "/w/x", "moved", "/w/x.mp3", 2.0),
                ("/w", "/w/gone.txt", "deleted", 3.0))
    got = []
    query = G.stream_classify(feed(spark, tmp_path, df, 1), rules,
                              lambda batch, _: got.extend((r["file"], r["category"]) for r in batch.collect()),
                              str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(got) == [("/w/Invoice1.txt", "Invoices"), ("/w/x.mp3", "Audio")]


def test_auto_organize(spark, tmp_path):
    df = events(spark, ("/w", "/w/a/n.txt", "created", 1.0), ("/w", "/w/b/n.txt", "modified", 2.0),
                ("/w", "/w/x.mp3", "deleted", 3.0))
    none = spark.createDataFrame([("/org/Documents", "n.txt")], "dest_dir STRING, name STRING")
    handle = G.auto_organize("/org", lambda: none, str(tmp_path / "plans"))
    query = G.stream_classify(feed(spark, tmp_path, df, 1), load_rules(spark.createDataFrame(
        [], "id BIGINT, name STRING, pattern STRING, match_type STRING, category STRING, target_folder STRING, "
            "priority INT, enabled BOOLEAN")), handle, str(tmp_path / "cp"))
    query.awaitTermination(60)
    plans = spark.read.parquet(str(tmp_path / "plans")).collect()
    assert sorted(r["destination"] for r in plans) == ["/org/Documents/n_(1).txt", "/org/Documents/n_(2).txt"]


def test_auto_organize_numbers_in_order_of_arrival(spark, tmp_path):
    rows = spark.createDataFrame([(f"/w/{6 - i}/n.txt", "Documents", i, i) for i in range(6)] + [("/w/6/n.txt", "Old", -1, 9)],
                                 "file STRING, category STRING, ts INT, event_id INT").repartition(3)
    none = spark.createDataFrame([], "dest_dir STRING, name STRING")
    G.auto_organize("/org", lambda: none, str(tmp_path / "p"))(rows, 0)
    got = {r["source"]: r["destination"] for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    names = ["n.txt", *[f"n_({i}).txt" for i in range(1, 6)]]
    assert got == {f"/w/{6 - i}/n.txt": f"/org/Documents/{names[i]}" for i in range(6)}


def test_counts(spark, tmp_path):
    df = events(spark, ("/w", "/w/a", "created", 1.0), ("/w", "/w/b", "created", 59.9), ("/w", "/w/b", "created", 60.0),
                ("/w", "/w/b", "deleted", 61.0))
    zero = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    expected = {(zero, "created", 2), (zero + 60, "created", 1), (zero + 60, "deleted", 1)}
    assert {tuple(r) for r in G.event_counts(df).collect()} == expected
    stream = feed(spark, tmp_path, df.unionByName(end_of_time(spark)), 2)
    query = (G.event_counts(stream, delay="0 seconds").writeStream.format("memory").queryName("counts")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("counts").collect()} == expected


def test_feeds(spark, tmp_path):
    lines = ['{"root":"/w","path":"/w/a","kind":"created","event_id":1,"ts":"2024-01-01T00:00:00Z"}',
             '{"root":"/w","path":"/w/d","kind":"created","is_directory":true,"event_id":2,"ts":"2024-01-01T00:00:00Z"}']
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "1.json").write_text("\n".join(lines))
    assert [r["path"] for r in read_events(spark, str(tmp_path / "json"), stream=False).collect()] == ["/w/a"]
    assert read_events(spark, str(tmp_path / "json")).isStreaming
    raw = spark.createDataFrame([(x,) for x in lines], "value STRING")
    assert [r["path"] for r in parse_events(raw).collect()] == ["/w/a"]
    assert files_only(events(spark, ("/w", "/w/a", "created", 1.0))).count() == 1


def test_progress(spark):
    df, watch = progress.observed(spark.range(10), "scan_progress")
    df.filter("id > 3").write.format("noop").mode("overwrite").save()
    assert watch.get["processed"] == 10
    row = progress.progress_event(spark, "done", 1, 10, 10, 0.0).collect()[0]
    assert row["event"] == "done" and row["files_per_second"] > 0


def test_organize_sink_repeats_a_batch_and_never_gives_a_name_twice(spark, tmp_path):
    none = spark.createDataFrame([("/org/Documents", "n.txt")], "dest_dir STRING, name STRING")
    no_rules = load_rules(spark.createDataFrame([], "id BIGINT, name STRING, pattern STRING, match_type STRING, category STRING, "
                                                    "target_folder STRING, priority INT, enabled BOOLEAN"))
    sink = G.OrganizeSink(no_rules, "/org", none, str(tmp_path / "out"), str(tmp_path / "state"))
    parts = [events(spark, ("/a", "/w/a/n.txt", "created", 1.0), ("/b", "/w/b/n.txt", "created", 0.0), ("/b", "/w/b/x.txt", "deleted", 0.5)),
             events(spark, ("/c", "/w/c/n.txt", "created", 100.0)), events(spark, ("/d", "/w/d/q", "moved", "/w/d/n_(1).txt", 200.0))]

    def plans():
        return {r["source"]: (r["id"], r["destination"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    sink(parts[0], 0)
    assert plans() == {}
    sink(parts[1], 1)
    first = plans()
    assert first == {"/w/b/n.txt": (0, "/org/Documents/n_(1).txt"), "/w/a/n.txt": (1, "/org/Documents/n_(2).txt")}
    sink(parts[1], 1)                   # as after a lost driver
    assert plans() == first
    sink(parts[2], 2)
    sink.flush(spark)
    assert plans() == {**first, "/w/c/n.txt": (2, "/org/Documents/n_(3).txt"), "/w/d/n_(1).txt": (3, "/org/Documents/n_(1)_(1).txt")}
