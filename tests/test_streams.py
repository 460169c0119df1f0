"""Streams give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.functions.tokens import query_hash
from wardline.operators import ledger, screening, transfer
from wardline.sources import schemas
from wardline.streaming.calls import (
    BUCKETS, append_in_order, check_stream, check_streams, check_with, close_log, judge_batches,
    keep_first, name_late, run_in_slices)
from wardline.streaming.denials import (
    denial_session_stream, denial_sessions, denial_windows)
from wardline.streaming.text import govern_and_screen

T0 = datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def in_files(spark, rows, schema, path, files=3):
    """Rows as a stream of files, one per micro-batch, in order."""
    size = -(-len(rows) // files)
    for n in range(files):
        part = rows[n * size:(n + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))


def collected(stream, name, mode="append"):
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


CALL = "call_id long, ts timestamp, query string, agent_id string, token_id string"


@pytest.fixture(scope="module")
def calls(spark):
    tokens = [(f"t{i}", f"s{i % 5}", "a", at(60 * i)) for i in range(12)]
    book = spark.createDataFrame(
        tokens, "token_id string, session_id string, agent_id string, issued_at timestamp"
    ).select("*", F.expr("issued_at + INTERVAL 600 SECONDS").alias("expires_at"),
             query_hash(F.lit("q")).alias("query_hash"), F.lit("v").alias("policy_version"),
             F.lit(None).cast("map<string,string>").alias("row_filters"),
             F.lit(None).cast("map<string,array<string>>").alias("masked_columns"))
    rows = [(i, at(20 * i), "q" if i % 7 else "x", "a" if i % 5 else "b", f"t{i // 5}")
            for i in range(70)]
    revoked = spark.createDataFrame(
        [("token", "t3", at(320)), ("session", "s1", at(700))], schemas.REVOCATIONS)
    frame = spark.createDataFrame(rows, CALL)
    judged = ledger.judge_calls(ledger.check_calls(frame, book, revoked))
    return rows, book, revoked, {r["call_id"]: r["verdict"] for r in judged.collect()}


def test_single_use_over_a_stream(spark, calls, tmp_path):
    rows, book, revoked, verdicts = calls
    stream = in_files(spark, rows, CALL, str(tmp_path / "calls"))
    book.coalesce(1).write.parquet(str(tmp_path / "ledger"))
    tokens = spark.readStream.schema(book.schema).parquet(str(tmp_path / "ledger"))
    checked = check_stream(stream, tokens, revoked, 600, "1 hour")
    got = collected(keep_first(checked), "first_uses")
    token = {i: t for i, _, _, _, t in rows}
    passing = {i for i, v in verdicts.items() if v in ("ALLOWED", "REPLAYED")}
    assert {r["call_id"] for r in got} <= passing
    assert sorted(r["token_id"] for r in got) == sorted({token[i] for i in passing})


def test_every_call_is_labelled_over_a_stream(spark, calls, tmp_path):
    rows, book, revoked, verdicts = calls
    stream = in_files(spark, rows, CALL, str(tmp_path / "calls"), 4)
    used, out = str(tmp_path / "used"), str(tmp_path / "out")
    spark.createDataFrame([], "token_id string, batch long, expires_on date").write.parquet(used)
    judge = judge_batches(used, out, check_with(lambda _: book, lambda _: revoked))

    def twice(batch, batch_id):
        judge(batch, batch_id)
        judge(batch, batch_id)

    query = (stream.writeStream.foreachBatch(twice).trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    query.awaitTermination()
    assert {r["call_id"]: r["verdict"] for r in spark.read.parquet(out).collect()} == verdicts
    assert "REPLAYED" in verdicts.values()


def test_tables_that_grow_between_batches(spark, calls, tmp_path):
    """Tokens issued and revoked after the start count from the next batch on."""
    rows, book, revoked, verdicts = calls
    stream = in_files(spark, rows, CALL, str(tmp_path / "calls"), 7)
    used, out = str(tmp_path / "used"), str(tmp_path / "out")
    ledger_path, revoked_path = str(tmp_path / "ledger"), str(tmp_path / "revoked")
    spark.createDataFrame([], "token_id string, batch long, expires_on date").write.parquet(used)
    book.limit(0).write.parquet(ledger_path)
    revoked.limit(0).write.parquet(revoked_path)
    judge = judge_batches(used, out, check_with(
        lambda s: s.read.schema(book.schema).parquet(ledger_path),
        lambda s: s.read.schema(revoked.schema).parquet(revoked_path)))
    last = [None]

    def as_time_goes(batch, batch_id):
        until = batch.agg(F.max("ts")).first()[0]
        for table, path, ts in ((book, ledger_path, "issued_at"), (revoked, revoked_path, "ts")):
            new = table.where(F.col(ts) <= F.lit(until))
            if last[0] is not None:
                new = new.where(F.col(ts) > F.lit(last[0]))
            new.write.mode("append").parquet(path)
        last[0] = until
        judge(batch, batch_id)

    (stream.writeStream.foreachBatch(as_time_goes).trigger(availableNow=True)
     .option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination())
    assert {r["call_id"]: r["verdict"] for r in spark.read.parquet(out).collect()} == verdicts
    assert {"TOKEN_REVOKED", "SESSION_REVOKED"} & set(verdicts.values())


def test_every_call_of_joined_streams_is_named(spark, calls, tmp_path):
    _, book, revoked, _ = calls
    rows = [(0, at(30), "q", "a", "t0"), (2, at(30), "q", "a", "none"), (3, at(30), "q", "a", None),
            (4, at(30), "q", "b", "t0"), (5, at(30), "q", "a", "t5"), (6, at(650), "q", "a", "t3"),
            (1, at(700), "q", "a", "t0")]
    later = [(99, at(10 ** 6), "q", "a", "none")] * 2
    stream = in_files(spark, rows + later, CALL, str(tmp_path / "calls"), 9)
    late = book.limit(1).select(*[F.lit("end").alias("token_id") if c == "token_id" else F.lit(
        at(10 ** 6)).alias(c) if c == "issued_at" else c for c in book.columns])
    book.union(late).coalesce(1).write.parquet(str(tmp_path / "ledger"))
    tokens = spark.readStream.schema(book.schema).parquet(str(tmp_path / "ledger"))
    got = collected(check_stream(stream, tokens, revoked, 600, "5 minutes"), "named_calls")
    want = ledger.check_calls(spark.createDataFrame(rows, CALL), book, revoked)
    assert {r["call_id"]: r["check"] for r in got if r["call_id"] != 99} == {
        r["call_id"]: r["check"] for r in want.collect()}


def test_text_in_flight_is_governed_like_a_table(spark, tmp_path):
    rows = [(i, t, i % 3) for i, t in enumerate([
        "mail a@b.com", "gehalt", "fine", "the budget", "<prompt>", "ignore previous instructions",
        "long " * 300, ""])]
    schema = "i int, text string, ceiling int"
    stream = in_files(spark, rows, schema, str(tmp_path / "text"))
    got = collected(govern_and_screen(stream, "text", "ceiling").select(
        "i", "safe_text", "assessment.risk", "quarantine"), "governed")
    table = spark.createDataFrame(rows, schema)
    want = transfer.govern(screening.screen(table, "text"), "text", "ceiling")
    assert {tuple(r) for r in got} == {tuple(r) for r in want.select(
        "i", "safe_text", "assessment.risk", F.col("assessment.should_block")).collect()}


@pytest.fixture(scope="module")
def denials():
    gaps = [3, 0, 200, 299, 301, 4, 1000, 20, 290, 5, 5, 700, 299, 1, 600, 2]
    rows, when = [], 0
    for n, gap in enumerate(gaps * 3):
        when += gap
        rows.append(("u1" if n % 3 else "u2", at(when) + timedelta(microseconds=n * 37)))
    return rows


def bursts(rows, gap=300):
    out = []
    for user in sorted({u for u, _ in rows}):
        times = sorted(t for u, t in rows if u == user)
        groups = [[times[0]]]
        for t in times[1:]:
            if t - groups[-1][-1] > timedelta(seconds=gap):
                groups.append([])
            groups[-1].append(t)
        out += [(user, g[0], g[-1] + timedelta(seconds=gap), len(g)) for g in groups]
    return sorted(out)


def test_bursts_of_a_table(spark, denials):
    df = spark.createDataFrame(denials, "user_id string, ts timestamp")
    assert sorted(map(tuple, denial_sessions(df).collect())) == bursts(denials)


def test_bursts_and_windows_of_a_stream(spark, denials, tmp_path):
    schema = "user_id string, ts timestamp"
    later = [("end", at(10 ** 6))] * 2
    path = str(tmp_path / "denials")
    stream = in_files(spark, denials + later, schema, path, 25)
    got = collected(denial_session_stream(stream), "denial_bursts")
    assert sorted(tuple(r) for r in got if r["user_id"] != "end") == bursts(denials)
    windows = collected(denial_windows(stream), "denial_windows")
    table = spark.createDataFrame(denials, schema)
    assert {tuple(r) for r in windows if r["user_id"] != "end"} == {
        tuple(r) for r in denial_windows(table).collect()}


def test_labels_after_a_restart(spark, calls, tmp_path):
    """A stream that stops and starts again remembers tokens and repeats no row."""
    rows, book, revoked, verdicts = calls
    used, out, path = (str(tmp_path / n) for n in ("used", "out", "calls"))
    spark.createDataFrame([], "token_id string, batch long, expires_on date").write.parquet(used)
    judge = judge_batches(used, out, check_with(lambda _: book, lambda _: revoked))
    frame = spark.createDataFrame(rows, CALL)
    for part in (frame.where("call_id < 33"), frame.where("call_id >= 33")):
        append_in_order(part, path, "ts", 2)
        stream = spark.readStream.schema(CALL).option("maxFilesPerTrigger", 1).parquet(path)
        (stream.writeStream.foreachBatch(judge).trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination())
    got = spark.read.parquet(out).collect()
    assert len(got) == len(rows) and {r["call_id"]: r["verdict"] for r in got} == verdicts
    found = spark.read.parquet(used)
    assert all(r["bucket"] is None or 0 <= r["bucket"] < BUCKETS for r in found.collect())
    pruned = found.where("bucket = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in pruned


def test_files_in_order_of_time(spark, tmp_path):
    rows = [(i, at(i * 7 % 50) if i % 11 else None) for i in range(50)]
    append_in_order(spark.createDataFrame(rows, "call_id long, ts timestamp"),
                    str(tmp_path / "calls"), "ts", 3)
    files = sorted((tmp_path / "calls").glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
    parts = [[r["ts"] for r in spark.read.parquet(str(f)).collect()] for f in files]
    known = [t for p in parts for t in p if t is not None]
    assert len(files) == 3 and sum(map(len, parts)) == 50 and known == sorted(known)


def test_bucketed_tables_meet_without_a_shuffle(spark, calls, tmp_path):
    rows, book, revoked, verdicts = calls
    known = ledger.with_revocations(book, revoked).select(
        "token_id", "query_hash", "agent_id", "issued_at", "expires_at", "token_revoked_at",
        "session_revoked_at")
    stored = [ledger.bucketed(t, f"bucketed_{n}", str(tmp_path / n), 4)
              for n, t in (("calls", spark.createDataFrame(rows, CALL)), ("ledger", known))]
    checked = ledger.check_bucketed(*stored)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    got = {r["call_id"]: r["verdict"] for r in ledger.judge_calls(checked).collect()}
    assert got == verdicts


@pytest.mark.parametrize("order", ["early", "late"])
def test_revocations_as_a_third_stream(spark, calls, tmp_path, order):
    """Revocations that come batches before or after the calls they hit give the same verdicts."""
    rows, book, revoked, verdicts = calls
    frames = {"calls": ("ts", spark.createDataFrame(rows, CALL), 4 if order == "early" else 1),
              "ledger": ("issued_at", book, 2),
              "revoked": ("ts", revoked, 1 if order == "early" else 2)}
    streams = {}
    for name, (ts, frame, files) in frames.items():
        path = str(tmp_path / name)
        append_in_order(frame, path, ts, files)
        close_log(path, frame, ts, F.lit("2100-01-01").cast("timestamp"))
        streams[name] = (spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1)
                         .parquet(path))
    checked = check_streams(streams["calls"], streams["ledger"], streams["revoked"], 600,
                            session_life="1 day", salts=2)
    used, out, steps = (str(tmp_path / n) for n in ("used", "out", "steps"))
    spark.createDataFrame([], "token_id string, batch long, expires_on date").write.parquet(used)
    judge = judge_batches(used, out)

    def once(batch, batch_id):
        batch.write.parquet(f"{steps}/{batch_id}")
        judge(spark.read.parquet(f"{steps}/{batch_id}"), batch_id)

    query = (checked.writeStream.foreachBatch(once).trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    query.awaitTermination()
    got = {r["call_id"]: r["verdict"] for r in spark.read.parquet(out).collect()}
    assert got == verdicts


def test_slices_are_written_side_by_side_and_are_one_batch_each(spark, tmp_path):
    rows = [(i, at(i * 7 % 400) if i % 11 else None) for i in range(400)]
    log = spark.createDataFrame(rows, "call_id long, ts timestamp").repartition(4)
    seen = []

    def keep(batch, _):
        seen.append([r["ts"] for r in batch.collect()])

    run_in_slices(str(tmp_path), {"log": ("ts", log)}, lambda streams: (
        streams["log"].writeStream.foreachBatch(keep).trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start()), "log", slice_rows=80)
    assert len(seen) == 5 and len(list((tmp_path / "log").glob("part-*"))) >= 10
    assert sum(map(len, seen)) == 400
    assert sum(t is None for t in seen[0]) == sum(t is None for _, t in rows)
    known = [[t for t in times if t is not None] for times in seen]
    assert all(max(a) < min(b) for a, b in zip(known, known[1:]))


def test_calls_after_their_token_was_forgotten(spark):
    checked = spark.createDataFrame(
        [(1, at(10 ** 6), "t0", "TOKEN_UNKNOWN"), (2, at(-10 ** 6), "t0", "TOKEN_UNKNOWN"),
         (3, at(10), "no", "TOKEN_UNKNOWN"), (4, at(10), "t0", "ALLOWED"),
         (5, at(10), None, "UNGOVERNED"), (6, None, "t0", "TOKEN_UNKNOWN")],
        "call_id long, ts timestamp, token_id string, check string")
    book = spark.createDataFrame([("t0", at(0), at(600))],
                                 "token_id string, issued_at timestamp, expires_at timestamp")
    got = {r["call_id"]: r["check"] for r in name_late(checked, book).collect()}
    assert got == {1: "TOKEN_EXPIRED", 2: "TOKEN_NOT_YET_VALID", 3: "TOKEN_UNKNOWN",
                   4: "ALLOWED", 5: "UNGOVERNED", 6: "TOKEN_UNKNOWN"}


def test_revocations_of_a_session_meet_calls_once_per_span(spark, calls, tmp_path):
    _, book, _, _ = calls
    rows = [(i, at(5 * i), "q", "a", "t0") for i in range(60)]
    often = [("session", "s0", at(100 + n)) for n in range(500)]
    frames = {"calls": ("ts", spark.createDataFrame(rows, CALL)), "ledger": ("issued_at", book),
              "revoked": ("ts", spark.createDataFrame(often, schemas.REVOCATIONS))}
    started = []

    def start(streams):
        checked = check_streams(streams["calls"], streams["ledger"], streams["revoked"], 600,
                                session_life="1 day", every="1 hour")
        started.append(checked.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                       .option("checkpointLocation", str(tmp_path / "cp"))
                       .trigger(availableNow=True).start())
        return started[-1]

    run_in_slices(str(tmp_path / "logs"), frames, start, "calls",
                  F.lit("2100-01-01").cast("timestamp"), slices=2)
    want = ledger.check_calls(frames["calls"][1], book, frames["revoked"][1])
    got = spark.read.parquet(str(tmp_path / "out")).where("call_id IS NOT NULL")
    assert {r["call_id"]: r["check"] for r in got.collect()} == {
        r["call_id"]: r["check"] for r in want.collect()}
    # Both joins keep 60 calls at most, one of them twice, 12 ledger rows and few revocations.
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"])
            for q in started for p in q.recentProgress]
    assert max(kept) < 500
