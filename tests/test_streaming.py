"""Streams against their batch twins."""

import datetime
import shutil
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from posthound.sources import adapters as src
from posthound.sources import mail, mbox
from posthound.streaming import backlog, ingest, jobs, sinks

SF = "/root/testdata/sf0.001"


def files_of(df, tmp_path, n=3):
    """df as a folder of n Parquet files in time order."""
    folder = tmp_path / "in"
    rows = df.orderBy("at", "id").collect() if "at" in df.columns else df.orderBy("received_at", "id").collect()
    folder.mkdir()
    size = -(-len(rows) // n)
    spark = df.sparkSession
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        part = next((tmp_path / f"part{i}").glob("*.parquet"))
        shutil.move(part, folder / f"{i}.parquet")
    return str(folder)


def test_once_sink_ignores_replays_and_repeated_keys(spark, tmp_path):
    rows = src.analyses(spark, SF).select("connector", "mailbox", F.lit("r").alias("remote_id"), "level", "id", "received_at")
    out = str(tmp_path / "out")
    folder = files_of(rows, tmp_path)
    for checkpoint in ("a", "a", "b"):  # the third run starts anew and delivers everything again
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = stream.writeStream.foreachBatch(ingest.once_sink(out)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(out)
    want = rows.select("connector", "mailbox", "remote_id").distinct().count()
    assert got.count() == want == got.select("connector", "mailbox", "remote_id").distinct().count()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A row far ahead of all others moves the watermark past them.
FAR = "2030-01-01 00:00:00"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def shuffled_files(df, folder, at, n=4, behind=0):
    """df as n Parquet files in time order, but every odd pair of neighbouring files swapped."""
    rows = df.orderBy(at).collect()
    size = -(-len(rows) // n)
    parts = [rows[i * size : (i + 1) * size] for i in range(n)]
    for i in range(0, n - 1, 2):
        parts[i], parts[i + 1] = parts[i + 1], parts[i]
    for i, part in enumerate(parts):
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return [str(next((folder / str(i)).glob("*.parquet"))) for i in range(n)]


def deliver(files, folder, upto):
    folder.mkdir(exist_ok=True)
    for i, f in enumerate(files[:upto]):
        if not (folder / f"{i}.parquet").exists():
            shutil.copy(f, folder / f"{i}.parquet")


def test_alert_suppression_stream_equals_batch_on_shuffled_batches(rocks, tmp_path):
    spark = rocks
    alerts = ingest._alerts(spark, SF)
    files = shuffled_files(alerts, tmp_path, "at", 6)
    end = spark.createDataFrame([("end", -1)], "key string, id long").withColumn("at", F.lit(FAR).cast("timestamp"))
    end.coalesce(1).write.parquet(str(tmp_path / "end"))
    files.append(str(next((tmp_path / "end").glob("*.parquet"))))
    deliver(files, tmp_path / "in", 7)
    stream = ingest.suppress_stream(spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 3600, "20 days")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "id", "at").collect()]
    assert sorted(got) == sorted(tuple(r) for r in ingest.suppress(alerts, 3600).collect()) and got
    sizes = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert sizes[-1] <= 3 < max(sizes)  # what is left is the last row, waiting, and its timer


def test_killed_job_stream_loses_and_doubles_nothing(rocks, tmp_path):
    spark = rocks
    log = jobs.event_log(spark, SF)
    files = shuffled_files(log, tmp_path, "at", 6)
    end = spark.createDataFrame([(-1, "put", "x", None)], "id long, event string, raw string, error string").withColumn("at", F.lit(FAR).cast("timestamp"))
    end.coalesce(1).write.parquet(str(tmp_path / "end"))
    files.append(str(next((tmp_path / "end").glob("*.parquet"))))
    broken = []

    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"epoch={epoch}"))
        if epoch in (2, 4) and epoch not in broken:
            broken.append(epoch)
            raise RuntimeError("killed after the write and before the commit")

    for upto in (3, 6, 7, 7, 7):
        deliver(files, tmp_path / "in", upto)
        stream = jobs.queue_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="20 days")
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            assert broken
    assert broken == [2, 4]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("id >= 0").select("id", "status", "attempts", "error", "raw", "at").collect())
    want = sorted(tuple(r) for r in jobs.queue_history(log).collect())
    assert [(*g[:4], g[5]) for g in got] == [(*w[:4], w[5]) for w in want]
    ended = [g[0] for g in got if g[1] in ("done", "dead")]
    assert len(ended) == len(set(ended)) and set(ended) == {r.id for r in log.select("id").distinct().collect() if r.id % 7 != 3}


def test_job_policy():
    at = 1_000_000
    run = lambda rows, until=1 << 40, **how: [(s, n, e, (t - datetime.datetime(1970, 1, 1)).total_seconds()) for _, s, n, e, _, t in jobs.Policy(**how).fold(1, rows, None, until)[0]]
    lost = [(0, "put", "x", None), (at, "take", None, None)]
    assert run(lost, attempts=1) == [("ready", 1, None, 0), ("dead", 1, "abandoned", 301)]
    late = [*lost, (302 * at, "ack", None, None), (303 * at, "fail", None, "x")]
    assert run(late) == [("ready", 1, None, 0), ("ready", 2, None, 301), ("done", 2, None, 302)]
    assert run([(0, "take", None, None), (1, "ack", None, None)]) == []
    out, kept, wake = jobs.Policy(remember_s=5).fold(1, [*lost, (2 * at, "ack", None, None)], None, 3 * at)
    assert kept[0] == "ended" and wake == 7 * at
    assert jobs.Policy(remember_s=5).fold(1, [], kept, 8 * at) == ([], None, None)


def test_no_window_sends_all(spark):
    alerts = ingest._alerts(spark, SF)
    assert ingest.suppress(alerts, 0).count() == alerts.count()


def test_timeline_stream_equals_batch(spark, tmp_path):
    rows = src.analyses(spark, SF).select("id", "level", "received_at")
    folder = files_of(rows, tmp_path)
    stream = ingest.timeline_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    q = stream.writeStream.format("memory").queryName("tl").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("tl").collect()} == {tuple(r) for r in ingest.timeline_stream(rows).collect()}


def test_retry_and_dead_letters(spark):
    jobs = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("c", "x", 2), ("d", "x", 3), ("e", None, 0), (None, "x", 0)], "id string, raw string, attempts int")
    done, retry, dead = ingest.retry_step(jobs, lambda d: d.withColumn("error", F.when(F.col("id") != "a", "bad")), F.lit(None).cast("timestamp"))
    assert [r.id for r in done.collect()] == ["a"]
    assert [(r.id, r.attempts) for r in retry.collect()] == [("b", 2)]
    assert {(r.id, r.error) for r in dead.collect()} == {("c", "bad"), ("d", "too many attempts"), ("e", "malformed"), (None, "malformed")}
    assert {r.level for r in ingest.error_results(dead).collect()} == {"error"}


def test_directory_source(spark, tmp_path):
    for name, raw in mail._samples():
        (tmp_path / f"{name}.eml").write_bytes(raw)
    (tmp_path / "other.txt").write_text("no")
    rows = mail.read_directory(spark, str(tmp_path))
    assert rows.count() == 3  # the file source passes over empty files
    parsed = {r.remote_id.split("@")[0]: r for r in mail.parse(rows).collect()}
    one = parsed["1.eml"]
    assert one.subject == "Factura ñ" and one.from_addr == "a@shop.example" and one.from_display == "Jörg" and len(one.artifacts) == 4
    assert parsed["3.eml"].subject == "café"
    assert mail.parse_message(b"")["artifacts"] == [] and mail.parse_message(None)["errors"] == []


# --- results with children -------------------------------------------------------------------------------------------------------


def nested_results(spark):
    rows = src.analyses(spark, SF).withColumn("received_at", F.col("received_at").cast("timestamp"))
    child = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.concat(F.col("id").cast("string"), F.lit("-"), i.cast("string")).alias("name"), (i * 7).alias("size")))
    return rows.select("connector", "mailbox", "remote_id", "level", "id", "received_at", child(2).alias("artifacts"), F.when(F.col("id") % 2 == 0, child(3)).otherwise(F.array().cast("array<struct<name:string,size:int>>")).alias("findings"))


def test_results_and_children_appear_together(spark, tmp_path):
    rows = nested_results(spark)
    folder, out, seen, broken = tmp_path / "in", str(tmp_path / "out"), [], []
    parts = shuffled_files(rows, tmp_path, "received_at", 4)
    deliver(parts, folder, 4)

    def fail(step, epoch):
        whole = {n: sinks.read(spark, out, n, sinks.schema_of(rows, n)).count() for n in ("results", "artifacts", "findings")}
        seen.append(whole)
        if (step, epoch) in (("artifacts", 1), ("findings", 2), ("manifest", 3)) and (step, epoch) not in broken:
            broken.append((step, epoch))
            raise RuntimeError("killed")

    for checkpoint in ("a", "a", "a", "a", "b"):  # the last starts anew: other epochs, the same rows
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        sink = sinks.results_sink(out, 8, fail_before=fail) if checkpoint == "a" else ingest_again(sinks.results_sink(out, 8))
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            assert broken
    assert len(broken) == 3
    got = {n: sinks.read(spark, out, n, sinks.schema_of(rows, n)) for n in ("results", "artifacts", "findings")}
    keys = rows.select("connector", "mailbox", "remote_id").distinct().count()
    ids = [r.id for r in got["results"].collect()]
    assert len(ids) == len(set(ids)) == keys
    assert got["artifacts"].count() == 2 * keys and got["findings"].count() == 3 * sum(i % 2 == 0 for i in ids)
    assert all(s["artifacts"] == 2 * s["results"] for s in seen)  # nothing half visible at any moment


def ingest_again(sink):
    return lambda batch, epoch: sink(batch, epoch + 100)


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    rows = nested_results(spark)
    sink = sinks.results_sink(str(tmp_path), 16)
    sink(rows.filter("id < 500"), 0)
    known = sinks.manifests(spark, str(tmp_path))
    assert known[0]["rows"]["artifacts"] == 2 * known[0]["rows"]["results"] and len(known[0]["buckets"]["results"]) == 16
    files = sinks.read(spark, str(tmp_path), "results", sinks.schema_of(rows, "results"), [3]).inputFiles()
    assert files and all("/bucket=3/" in f for f in files)


# --- mailboxes as a source -------------------------------------------------------------------------------------------------------


def test_mbox_stream_repeats_after_a_crash_and_keeps_each_mail_once(spark, tmp_path):
    mbox.register(spark)
    box, out = tmp_path / "in", str(tmp_path / "out")
    box.mkdir()
    letter = lambda i: f"From a@b.example\nSubject: {i}\n\n" + "x" * (i % 50) + f"\n>From here {i}\n\n"
    sent = {"one.mbox": list(range(40)), "two.mbox": list(range(100, 130))}
    for name, ids in sent.items():
        (box / name).write_text("".join(letter(i) for i in ids))
    broken = []

    def sink(batch, epoch):
        rows = batch.select(F.lit("mbox").alias("connector"), "mailbox", "remote_id", F.lit("clean").alias("level"), F.col("start").alias("id"), F.lit(FAR).cast("timestamp").alias("received_at"), F.decode("raw", "utf-8").alias("raw"))
        ingest.once_sink(out)(rows, epoch)
        if len(broken) < 2:
            broken.append(epoch)
            raise RuntimeError("killed between the write and the commit")

    for turn in range(5):
        with (box / "one.mbox").open("a") as f:  # a mailbox grows between the runs, and while one is being repeated
            f.write("".join(letter(i) for i in range(40 + 4 * turn, 44 + 4 * turn)))
        stream = spark.readStream.format("mbox").option("path", f"file://{box}").option("closed", "true").load()
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
            q.stop()
        except StreamingQueryException:
            assert broken
    got = spark.read.option("recursiveFileLookup", "true").parquet(out).collect()
    want = {(n, i) for n, ids in (sent | {"one.mbox": list(range(60))}).items() for i in ids}
    read = [(r.mailbox, int(r.raw.split("\n")[0].split(": ")[1])) for r in got]
    assert len(read) == len(set(read)) and set(read) == want
    assert all(f"\nFrom here {i}\n" in r.raw for r, (_, i) in zip(got, read))


def test_mbox_batch_reads_ranges(spark, tmp_path, monkeypatch):
    mbox.register(spark)
    mails = [f"From x\nid: {i}\n\nbody\n" for i in range(50)]
    (tmp_path / "a.mbox").write_text("".join(mails))
    (tmp_path / "b.mbox").write_text("")
    (tmp_path / "c.txt").write_text("From no\n")
    rows = spark.read.format("mbox").option("path", str(tmp_path)).load().collect()
    assert [bytes(r.raw).decode() for r in sorted(rows, key=lambda r: r.start)] == [m.partition("\n")[2] for m in mails]
    monkeypatch.setattr(mbox, "PIECE", 64)
    reader = mbox.MboxReader({"path": str(tmp_path)})
    ranges = reader.partitions()
    assert len(ranges) > 5 and sum(1 for r in ranges for _ in reader.read(r)) == 50
    open_end = mbox.MboxStream({"path": str(tmp_path)}).latestOffset()  # the last mail may still grow
    assert open_end == {"files": '{"a.mbox": %d}' % sum(map(len, mails[:-1]))}


# --- backlog ---------------------------------------------------------------------------------------------------------------------


def test_backlog_grows_and_falls(spark, tmp_path):
    rows = src.analyses(spark, SF).select("id", "level", "received_at")
    parts = shuffled_files(rows, tmp_path, "received_at", 8)
    watch = backlog.Backlog(spark, str(tmp_path / "log"), every=3)
    spark.streams.addListener(watch)
    try:
        deliver(parts, tmp_path / "in", 2)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
        delivered = []

        def sink(batch, epoch):
            batch.count()
            if epoch == 0 and not delivered:  # while the first batch runs, more comes in than it takes out
                delivered.append(True)
                deliver(parts, tmp_path / "in", 8)

        q = stream.writeStream.queryName("work").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        for _ in range(50):
            time.sleep(0.2)
            if not watch.held and (tmp_path / "log").exists() and watch.table().filter("rows_in > 0").count() == 8:
                break
    finally:
        spark.streams.removeListener(watch)
    rows = backlog.depth(watch.table().filter("rows_in > 0"), str(tmp_path / "in"), str(tmp_path / "ck")).orderBy("batch").collect()
    depth = [r.waiting for r in rows]
    assert len(depth) == 8 and max(depth) > depth[0] and depth[-1] == 0 and depth[2:] == sorted(depth[2:], reverse=True)
    assert rows[3].drain_s > 0 and rows[-1].drain_s == 0
    jobs_ = spark.createDataFrame([(1, 0), (2, 5)], "id int, priority int")
    assert [r.admitted for r in backlog.admitted(jobs_, depth[1], 3, F.col("priority")).orderBy("id").collect()] == [False, True]
