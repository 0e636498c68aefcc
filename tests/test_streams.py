"""Streams: timers, a starting state, and live snapshots, on files that land one by one."""

import os

from turnstile.operators import timeline
from turnstile.operators.timeline import Policy
from turnstile.sources import ledger
from turnstile.sources.lines import follow_log
from turnstile.streaming import replay, snapshots, tracker

EVENTS = "ip string, jail string, ts long, seq long, kind string"


def streamed(spark, tmp_path, rows, delay="0 seconds", initial=None, policies=None, keep_counts=None, end=True):
    """The changes of rows that land part by part, and the rows of state after each batch. A failure far ahead moves the watermark on."""
    folder = str(tmp_path / "in")
    for i, part in enumerate([*rows, [("end", "j", 10**7, 0, "failure")]] if end else rows):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    df = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    with replay.state_store(spark):
        out = tracker.track(df, policies or {"j": Policy(2, 100, 50)}, initial, delay, keep_counts)
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(tracker.OUTPUT).parquet(str(tmp_path / "out")).collect(), state


def test_commands_and_expiry_timers(spark, tmp_path):
    rows = [[("a", "j", 10, 1, "failure"), ("a", "j", 20, 2, "failure"), ("b", "j", 20, 3, "ban"), ("b", "j", 21, 4, "unban"), ("c", "x", 22, 5, "ban")]]
    out = {(r["kind"], r["ip"], r["banned_at"], r["manual"]) for r in streamed(spark, tmp_path, rows)[0]}
    assert out == {("ban", "a", 20, False), ("ban", "b", 20, True), ("unban", "b", 21, True), ("reject", "c", 22, True), ("unban", "a", 70, False)}


def test_starting_state(spark, tmp_path):
    start = spark.createDataFrame([("a", "j", None, 4), ("c", "j", 15, 1)], "ip string, jail string, expires_at long, ban_count int")
    rows = [[("a", "j", 10, 1, "failure"), ("a", "j", 20, 2, "failure"), ("b", "j", 10, 3, "failure"), ("b", "j", 11, 4, "failure"), ("c", "j", 12, 5, "failure"), ("c", "j", 15, 6, "failure"), ("c", "j", 16, 7, "failure")]]
    out = sorted((r["kind"], r["ip"], r["banned_at"], r["ban_count"]) for r in streamed(spark, tmp_path, rows, initial=start)[0])
    assert out == [("ban", "b", 11, 1), ("ban", "c", 16, 2), ("unban", "b", 61, 1), ("unban", "c", 15, 1), ("unban", "c", 66, 2)]


def test_rows_wait_for_earlier_ones_within_the_delay(spark, tmp_path):
    # In the order in which they land nothing spans less than 100 but out of order; by time 900 and 950 do, and 1500 is alone.
    rows = [[("a", "j", 1500, 1, "failure"), ("b", "j", 1400, 9, "failure")], [("a", "j", 900, 2, "failure")], [("a", "j", 950, 3, "failure")]]
    out, _ = streamed(spark, tmp_path, rows, "1000 seconds")
    assert [(r["kind"], r["banned_at"], r["seq"]) for r in sorted(out, key=lambda r: r["banned_at"])] == [("ban", 950, 3), ("unban", 1000, None)]


def test_state_stays_flat_under_ever_new_addresses(spark, tmp_path):
    rows = [[(f"10.{k}.0.{i}", "j", 1000 * k + i, 100 * k + i, "failure") for i in range(50)] for k in range(1, 5)]
    rows[1] += [("again", "j", 2000, 1, "failure"), ("again", "j", 2001, 2, "failure")]
    out, state = streamed(spark, tmp_path, rows)
    assert [(r["kind"], r["ip"]) for r in sorted(out, key=lambda r: r["banned_at"])] == [("ban", "again"), ("unban", "again")]
    # A part's addresses wait (a row each for the address, what waits, and what the store counts of either); those before are gone.
    assert max(state) <= 2.5 * max(state[:2]) and state[-1] <= 12


def test_ban_numbers_stay_unless_given_up(spark, tmp_path):
    rows = [[("a", "j", t, t, "failure") for t in (10, 20)], [("a", "j", t, t, "failure") for t in (5000, 5001)]]
    assert sorted(r["ban_count"] for r in streamed(spark, tmp_path / "y", rows)[0] if r["kind"] == "ban") == [1, 2]
    assert sorted(r["ban_count"] for r in streamed(spark, tmp_path / "z", rows, keep_counts=1000)[0] if r["kind"] == "ban") == [1, 1]


def test_policies_by_time_drop_rings_of_missing_jails(spark, tmp_path):
    policies = [(0, {"j": Policy(2, 10**6, 50), "k": Policy(2, 10**6, -1)}), (1000, {"j": Policy(3, 10**6, 7)}), (2000, {"j": Policy(3, 10**6, 7), "k": Policy(2, 10**6, -1)})]
    rows = [[("a", "j", 10, 1, "failure"), ("a", "k", 11, 2, "failure")], [("a", "j", 1010, 3, "failure"), ("a", "k", 1011, 4, "failure"), ("a", "j", 1012, 5, "failure")], [("a", "k", 2010, 6, "failure"), ("a", "k", 2011, 7, "failure")]]
    out = sorted((r["banned_at"], r["jail"], r["ban_time"]) for r in streamed(spark, tmp_path, rows, policies=policies)[0] if r["kind"] == "ban")
    assert out == [(1012, "j", 7), (2011, "k", -1)]
    flat = spark.createDataFrame([r for part in rows for r in part], EVENTS)
    assert sorted((r["banned_at"], r["jail"], r["ban_time"]) for r in timeline.bans(flat, policies, None).collect()) == out


def test_followed_files_and_snapshots(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for i in range(3):
        (tmp_path / "log" / f"chunk-{i}").write_text(f"line {i}\r\nother {i}\n")
    rows = replay.run(follow_log(spark, str(tmp_path / "log"), 1).select("line"), spark).collect()
    assert sorted(r["line"] for r in rows) == sorted([f"line {i}\r" for i in range(3)] + [f"other {i}" for i in range(3)])


def test_following_starts_at_the_end(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for name, at in (("old", 1_700_000_000), ("new", 1_700_000_100)):
        (tmp_path / "log" / name).write_text(f"{name} line\n")
        os.utime(tmp_path / "log" / name, (at, at))
    rows = replay.run(follow_log(spark, str(tmp_path / "log"), since="2023-11-14 22:14:00").select("line"), spark)
    assert [r["line"] for r in rows.collect()] == ["new line"]


def test_snapshots_cost_what_a_batch_holds(spark, tmp_path):
    live = snapshots.Snapshots(spark, str(tmp_path / "live"), every=3)
    write, schema = live.writer(), spark.createDataFrame([], tracker.OUTPUT).schema
    frame = lambda *r: spark.createDataFrame(r, schema)
    assert live.current(schema).count() == 0
    batches = [
        [("ban", "a", "j", 1, 5, 4, 1, False, 1), ("ban", "b", "j", 2, 6, 4, 1, False, 2)],
        [("unban", "a", "j", 3, None, None, 1, True, 3), ("reject", "a", "j", 9, None, None, 1, True, 4)],
        [("unban", "b", "j", 6, None, None, 1, False, None), ("ban", "b", "j", 6, 10, 4, 2, False, 5)],
        [("ban", "c", "j", 7, 9, 2, 1, False, 6)],
    ]
    want, newest = [], {}
    for epoch, rows in enumerate(batches):
        write(frame(*rows), epoch)
        newest |= {(r[1], r[2]): (r[0], r[3]) for r in sorted(rows, key=lambda r: (r[3], r[8] or -1)) if r[0] != "reject"}
        want.append(dict(newest))
        assert {(r.ip, r.jail): (r.kind, r.banned_at) for r in live.current(schema).collect()} == newest
    assert sorted(x.name for x in (tmp_path / "live").iterdir() if x.is_dir()) == ["base-2", "delta-3"]
    # A batch that runs again changes nothing, be it in a base or behind it; a base that is not whole is not read.
    write(frame(*batches[1]), 1)
    write(frame(*batches[3]), 3)
    (tmp_path / "live" / "base-9").mkdir()
    assert {(r.ip, r.jail): (r.kind, r.banned_at) for r in live.current(schema).collect()} == want[-1]


def test_restart_from_the_checkpoint_keeps_rings_and_bans(spark, tmp_path):
    def land(name, rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def go():
        df = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in/*")
        out = tracker.track(df, {"j": Policy(3, 100, 50)}, delay=None)
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["ip"], r["banned_at"], r["ban_count"]) for r in spark.read.schema(tracker.OUTPUT).parquet(f"{tmp_path}/out").collect())

    with replay.state_store(spark):
        land("a", [("a", "j", 10, 1, "failure"), ("a", "j", 20, 2, "failure"), ("b", "j", 1, 3, "failure")])
        assert go() == []
        land("b", [("a", "j", 30, 4, "failure"), ("b", "j", 2, 5, "failure")])
        assert go() == [("a", 30, 1)]
        # Nothing new: nothing again. Then failures while banned, and beyond.
        assert go() == [("a", 30, 1)]
        land("c", [("a", "j", 40, 6, "failure"), ("a", "j", 81, 7, "failure"), ("b", "j", 3, 8, "failure")])
        assert go() == [("a", 30, 1), ("a", 81, 2), ("b", 3, 1)]


def test_rows_that_come_late_are_taken_as_they_arrive_without_a_delay(spark, tmp_path):
    # The second file is older than the first one; the span is negative, which is within find_time.
    rows = [[("a", "j", 1000, 1, "failure")], [("a", "j", 10, 2, "failure")]]
    assert [(r["ip"], r["banned_at"]) for r in streamed(spark, tmp_path, rows, None, end=False)[0]] == [("a", 10)]


def test_feed_writes_each_notification_once(spark, tmp_path):
    spark.createDataFrame([("a", "sshd", t, t, "failure") for t in range(1, 4)], EVENTS).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        with replay.state_store(spark):
            df = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
            replay.feed(tracker.track(df, {"sshd": Policy(3, 100, 50)}, delay=None), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"event":"ban","ip":"a","jail":"sshd","ban_time":50,"timestamp":"1970-01-01T00:00:03+00:00"}']


def test_chunks_that_land_again_or_grown_add_new_lines_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    base = str(tmp_path / "state")
    one = [f"10:00:{i:02d} first {i}" for i in range(40)]
    other = ["10:00:00 first 0", *[f"other {i}" for i in range(10)]]  # begins alike, and is another file

    def land(**files):
        for name, lines in files.items():
            (tmp_path / "in" / name).write_text("".join(f"{x}\n" for x in lines))
        got = ledger.follow_chunks(spark, str(tmp_path / "in") + "/*", base, 2).collect()
        return sorted((r.line, r.number) for r in got)

    rows = lambda lines: [(x, i) for i, x in enumerate(lines)]
    want = rows(one[:10])
    assert land(a=one[:10]) == sorted(want)
    assert land(a_renamed=one[:10]) == sorted(want)
    want += rows(one)[10:25]
    assert land(grown=one[:25]) == sorted(want)
    want += rows(other)
    assert land(other=other, other_copy=other) == sorted(want)
    want += rows(one)[25:]
    # In one batch or several: a chunk of an older length, the whole one twice, an empty file.
    assert land(b=one[:10], c=one, d=one, e=[]) == sorted(want)
    # Shorter than any that begin alike: a log that was begun anew.
    want += rows(one[:3])
    assert land(short=one[:3]) == sorted(want)
    assert land() == sorted(want)
    # The last line may lack its line feed; repeated lines in a chunk count each.
    (tmp_path / "in" / "z").write_text("same\nsame\nsame")
    assert land() == sorted(want + rows(["same"] * 3))
