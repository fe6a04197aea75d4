"""Runs seen whole, keyed tables that streams keep, the raw feed: failures on the way, batches that run again, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from teleflect.operators import views as V
from teleflect.sources import runs
from teleflect.sources.keyed import KeyedTable

T0 = dt.datetime(2026, 9, 28, tzinfo=dt.timezone.utc)


# ---- runs


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    base, df = str(tmp_path / "runs"), spark.range(10).select(F.col("id").alias("vin"), F.lit(T0).alias("ts"))
    assert runs.newest_run(spark, base) is None and runs.run_table(spark, base).count() == 0
    with pytest.raises(LookupError):
        runs.read_run(spark, base, "a")
    assert runs.commit_run({"a": df, "b": df.limit(3)}, base, "r1", "h1", df)
    broken = df.select(F.raise_error(F.lit("no disk")).cast("long").alias("vin"))
    with pytest.raises(Exception, match="no disk"):  # the first table is written, the second is not
        runs.commit_run({"a": df.limit(1), "b": broken}, base, "r2", "h2")
    assert runs.read_run(spark, base, "a").count() == 10 and runs.newest_run(spark, base)["run_id"] == "r1"
    assert runs.commit_run({"a": df.limit(1), "b": df}, base, "r2", "h2")
    assert runs.read_run(spark, base, "a").count() == 1 and runs.read_run(spark, base, "a", "r1").count() == 10
    t = {r["run_id"]: (r["place"], r["rows_read"], r["units"]) for r in runs.run_table(spark, base).collect()}
    assert t == {"r1": (0, 10, 10), "r2": (1, None, None)}


def test_equal_inputs_are_skipped(spark, tmp_path):
    base, df = str(tmp_path / "runs"), spark.range(50).withColumn("x", F.col("id") % 7)
    h = runs.row_hash(df, ["id", "x"], "v1")
    assert h == runs.row_hash(df.repartition(5).orderBy(F.desc("id")), ["id", "x"], "v1")
    assert len({h, runs.row_hash(df, ["id", "x"], "v2"), runs.row_hash(df.union(df.limit(1)), ["id", "x"], "v1"), runs.row_hash(df.withColumn("x", F.col("x") + 1), ["id", "x"], "v1"), runs.row_hash(df.limit(0), ["id", "x"], "v1")}) == 5
    assert runs.commit_run({"a": df}, base, "r1", h) and not runs.commit_run({"a": df}, base, "r2", h)
    wanted = spark.createDataFrame([(h, "old"), ("other", "new")], "run_hash string, name string")
    assert [r["name"] for r in runs.pending(wanted, base).collect()] == ["new"]


def test_one_of_two_jobs_commits_a_place(spark, tmp_path):
    path = str(tmp_path / "log" / runs.name_of(0))
    assert runs.put_once(spark, path, "first") and not runs.put_once(spark, path, "second")
    assert runs.read_text(spark, path) == "first" and runs.log_names(spark, str(tmp_path / "log")) == [runs.name_of(0)]


# ---- keyed tables


RECORD = f"vin long, {V.RECORD}"


def some_records(spark, seed, n=60, span=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        vin = rnd.choice([None, *[2**60 + j for j in range(12)]])
        ts, run = T0 + dt.timedelta(minutes=rnd.randint(0, span)), rnd.random() < 0.1
        rows.append((vin, rnd.choice(["OPEN", "CLOSED"]), rnd.randint(1, 3), run, ts if run else None, rnd.random(), 1, ts, seed * 1000 + i))
    return spark.createDataFrame(rows, RECORD)


def kept(tmp_path):
    return KeyedTable(str(tmp_path / "t"), ["vin"], RECORD, lambda d: V.merge_records(d, "vin"), 4)


def rows_of(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_batches_are_applied_once(spark, tmp_path):
    table, parts = kept(tmp_path), [some_records(spark, s) for s in range(4)]
    for i, p in enumerate(parts):
        assert table.merge(p, i) and not table.merge(p, i)  # it runs again, with nothing changed
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    columns = ["vin", *[c.split()[0] for c in V.RECORD.split(", ")]]
    assert rows_of(table.read(spark), *columns) == rows_of(V.merge_records(whole, "vin"), *columns)
    changed = [p.select("vin").distinct().count() for p in parts]
    assert sum(r["version"] for r in table.read(spark).collect()) == sum(changed)
    feed = table.changes(spark)
    assert feed.count() == sum(changed) and table.changes(spark, 1).count() == sum(changed[2:]) and table.changes(spark, 3).count() == 0
    assert feed.groupBy("vin", "version").count().filter("count > 1").count() == 0


def test_a_batch_that_failed_halfway(spark, tmp_path, monkeypatch):
    from teleflect.sources import keyed

    table, a, b = kept(tmp_path), some_records(spark, 1), some_records(spark, 2)
    table.merge(a, 0)
    before = rows_of(table.read(spark), "vin", "actions", "version")

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed, "put_once", dies)
        with pytest.raises(OSError, match="lost"):
            table.merge(b, 1)
    assert rows_of(table.read(spark), "vin", "actions", "version") == before and table.changes(spark, 0).count() == 0
    assert table.merge(b, 1) and table.changes(spark, 0).count() == b.select("vin").distinct().count()
    assert table.merge(a.limit(0), 2) and table.state(spark)[0] == 2


def test_a_stream_keeps_a_table(spark, tmp_path):
    parts = [some_records(spark, s) for s in range(3)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = kept(tmp_path)
    stream = lambda: spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table.follow(stream(), str(tmp_path / "c"))
    parts[0].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table.follow(stream(), str(tmp_path / "c"))  # goes on from its checkpoint
    assert table.read(spark).agg(F.sum("actions")).first()[0] == 240 and table.state(spark)[0] == 3


# ---- the raw feed


VIN = "1HGCM82633A004352"


def message(i, bad=False):
    value = "{" if bad else '{"id":"%s","ts":1790568000000,"sq":%d,"e":"P","g":[1.0,2.0],"s":40,"o":9,"ct":90.0,"ig":1,"ch":0}' % (VIN, i)
    return (f"k{i}", {"x-sent-at": str(i)}, value.encode(), T0 + dt.timedelta(seconds=i))


def test_feed_offsets_and_ranges(spark, tmp_path):
    from teleflect.sources import feed

    base = str(tmp_path / "feed")
    assert [feed.append(base, "raw", p, [message(i) for i in range(n)]) for p, n in ((0, 5), (0, 3), (1, 4))] == [0, 5, 0]
    feed.append(base, "other", 0, [(None, None, None, None)])
    assert feed.ends(base) == {"raw/0": 8, "raw/1": 4, "other/0": 1}
    feed.register(spark)
    df = spark.read.format("feed").option("path", base).option("topics", "raw").option("rowsPerPartition", "3").load()
    assert df.rdd.getNumPartitions() == 5
    rows = df.orderBy("partition", "offset").collect()
    assert [(r["partition"], r["offset"]) for r in rows] == [(0, i) for i in range(8)] + [(1, i) for i in range(4)]
    assert rows[6]["headers"] == {"x-sent-at": "1"} and bytes(rows[6]["value"]) == message(1)[2] and rows[6]["ts"].astimezone(dt.timezone.utc) == T0 + dt.timedelta(seconds=1)
    assert [tuple(r)[3:] for r in spark.read.format("feed").option("path", base).option("topics", "other").load().collect()] == [(None, {}, None, None)]
    parts = feed.ranges(base, {"raw/0": 4}, {"raw/0": 7, "raw/1": 1}, 100, ["raw"])
    assert [[r[2] for r in feed.records(p)] for p in parts] == [[4, 5, 6], [0]]
    assert spark.read.format("feed").option("path", str(tmp_path / "none")).load().count() == 0


def test_a_killed_query_leaves_each_row_once(spark, tmp_path):
    """A batch fails in the middle of its work; the query starts again and reads the same offsets, with good and dead rows in one writer."""
    from teleflect.sources import feed

    feed.register(spark)
    base, out, flag = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "broken"
    sent = 0

    def run():
        stream = spark.readStream.format("feed").option("path", base).option("rowsPerPartition", "7").load()

        @F.udf("binary")
        def through(value, offset):
            if flag.exists() and offset == 25:
                raise OSError("killed")
            return value

        rows = feed.normalised(stream.withColumn("value", through("value", "offset")))
        rows.writeStream.format("feed").option("path", out).option("writer", "w").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    for p in range(3):
        feed.append(base, "raw", p, [message(i, bad=i % 4 == 0) for i in range(20)])
        sent += 20
    run()
    for p in range(3):
        feed.append(base, "raw", p, [message(20 + i, bad=i % 4 == 0) for i in range(20)])
        sent += 20
    flag.write_text("")
    with pytest.raises(Exception, match="killed"):
        run()
    flag.unlink()
    run()
    run()  # nothing new
    got = spark.read.format("feed").option("path", out).load().collect()
    sources = [r["headers"]["source"] for r in got]
    assert len(got) == sent == len(set(sources))
    assert sum(r["topic"] == "dead" for r in got) == sent // 4 and {r["key"] for r in got if r["topic"] == "canonical"} == {VIN}
    assert {r["headers"]["x-sent-at"] for r in got} == {str(i) for i in range(40)}


def test_a_commit_that_runs_again(spark, tmp_path):
    """After the manifest is there, a second commit of the batch finishes its renames and drops its own files."""
    from pyspark.sql import Row

    from teleflect.sources import feed

    w = feed.FeedStreamWriter({"path": str(tmp_path / "out"), "writer": "w"})
    rows = lambda n: iter([Row(topic="a", partition=i % 2, key=None, headers={}, value=b"x", ts=None) for i in range(n)])
    one, two = w.write(rows(6)), w.write(rows(6))
    finish, w._finish = w._finish, lambda *_: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError, match="killed"):
        w.commit([one, None], 0)
    assert feed.ends(w.base, ["a"]) == {}
    w._finish = finish
    w.commit([two], 0)
    w.commit([w.write(rows(2))], 1)
    w.abort([w.write(rows(2))], 2)
    assert feed.ends(w.base, ["a"]) == {"a/0": 4, "a/1": 4}


def test_feed_segments_have_a_largest_size(tmp_path):
    """What one task writes to a partition is cut, in order, so a range never passes over more than a segment before its own lines."""
    from pyspark.sql import Row

    from teleflect.sources import feed

    n = 2 * feed.SEGMENT + 10
    w = feed.FeedStreamWriter({"path": str(tmp_path / "out")})
    w.commit([w.write(Row(topic="a", partition=0, key=str(i), headers={}, value=None, ts=None) for i in range(n))], 0)
    assert [x[1] for x in feed.segments(w.base)["a/0"]] == [feed.SEGMENT, feed.SEGMENT, 10]
    parts = feed.ranges(w.base, {"a/0": 3}, {"a/0": n}, 7_000, None)
    assert max(skip for p in parts for _, _, skip, _ in p.parts) < feed.SEGMENT and max(len(p.parts) for p in parts) <= 2
    assert [int(r[3]) for p in parts for r in feed.records(p)] == list(range(3, n))
    got = [b for p in parts for b in feed.batches(p, 1_000)]
    assert max(b.num_rows for b in got) == 1_000 and [x for b in got for x in b.column("offset").to_pylist()] == list(range(3, n))


def test_feed_takes_arrow_as_it_takes_rows():
    import pyarrow as pa

    from teleflect.sources import feed

    rows = [("a", 0, "k", {"x": "1", "y": None}, b"v", T0), ("b", None, None, None, None, None), ("a", 1, "", {}, b"", T0 + dt.timedelta(microseconds=-1)), ("a", 1, "z", {"w": "2"}, b"u", T0)]
    types = (pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.timestamp("us", "UTC"))
    batch = pa.RecordBatch.from_arrays([pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(feed.WRITTEN))
    want = [(*r[:5], feed.micros(r[5])) for r in rows]
    assert list(feed.rows_of([batch])) == want and list(feed.rows_of([batch.slice(2), batch.slice(1, 1)])) == want[2:] + want[1:2]
    bare = batch.set_column(5, "ts", batch.column("ts").cast(pa.timestamp("us")))
    assert [r[5] for r in feed.rows_of([bare])] == [feed.micros(None if r[5] is None else r[5].replace(tzinfo=None)) for r in rows]
