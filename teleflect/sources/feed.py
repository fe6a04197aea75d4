"""The raw feed as a Spark data source: topics with partitions and offsets on files, read and written by streams.

    <base>/<topic>/<partition>/<first offset>-<number>.jsonl      a segment, one record a line; offsets count its lines

A segment is written under another name and renamed, so its name tells the end of its partition without opening it, and
a stream's offsets are the ends of all partitions. Reading hands ranges of offsets to tasks; a query that starts again
from its checkpoint reads the same ranges. The writer's segments have a largest size, so a range passes over few lines
before its own, however much a task wrote. Tasks give and take Arrow batches.

The writer takes rows of any topics (canonical readings and dead letters in one stream). Tasks write staging files; a
commit deals offsets, writes them down as one manifest of the batch, and only then renames. A batch that commits again
finds its manifest, finishes its renames and drops what was staged anew, so each row is in the feed once.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

SCHEMA = "topic string, partition int, offset long, key string, headers map<string,string>, value binary, ts timestamp"
#: What the writer takes; further columns are left out.
WRITTEN = ("topic", "partition", "key", "headers", "value", "ts")
#: Most records of a segment that the writer makes.
SEGMENT = 20_000
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _open(base: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(base if "://" in base or base.startswith("file:") else f"file://{base}")


def _names(fs, folder: str, kind) -> list[str]:
    import pyarrow.fs as pafs

    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(x.base_name for x in found if x.type == kind and not x.base_name.startswith((".", "_")))


def segments(base: str, topics: list[str] | None = None) -> dict[str, list[tuple[int, int, str]]]:
    """"topic/partition" -> its segments (first offset, number, path), in order."""
    import pyarrow.fs as pafs

    fs, root = _open(base)
    out = {}
    for topic in topics or _names(fs, root, pafs.FileType.Directory):
        for part in _names(fs, f"{root}/{topic}", pafs.FileType.Directory):
            own = [(*map(int, n.removesuffix(".jsonl").split("-")), f"{root}/{topic}/{part}/{n}") for n in _names(fs, f"{root}/{topic}/{part}", pafs.FileType.File) if n.endswith(".jsonl")]
            if own:
                out[f"{topic}/{part}"] = own
    return out


def ends(base: str, topics: list[str] | None = None) -> dict[str, int]:
    """"topic/partition" -> the offset that its next record gets."""
    return {k: own[-1][0] + own[-1][1] for k, own in segments(base, topics).items()}


@dataclass
class Range(InputPartition):
    base: str
    key: str
    parts: list[tuple[str, int, int, int]]  # path, first offset, lines to skip, lines to take


def ranges(base: str, start: dict[str, int], end: dict[str, int], rows: int, topics: list[str] | None) -> list[Range]:
    """What lies from start to end, in pieces of at most `rows` records of one partition."""
    out = []
    for key, own in segments(base, topics).items():
        low, high = start.get(key, 0), end.get(key, 0)
        firsts = [first for first, _, _ in own]
        for at in range(low, high, rows):
            to = min(high, at + rows)
            near = own[max(0, bisect_right(firsts, at) - 1) : bisect_right(firsts, to - 1)]
            parts = [(path, first, max(at, first) - first, min(to, first + n) - max(at, first)) for first, n, path in near if first + n > at]
            out.append(Range(base, key, parts))
    return out


def _lines(part: Range) -> Iterator[tuple[int, dict]]:
    """Offset and record of each line of a range."""
    import io

    fs, _ = _open(part.base)
    for path, first, skip, take in part.parts:
        with io.BufferedReader(fs.open_input_stream(path), 1 << 20) as lines:
            for i, line in enumerate(islice(lines, skip + take)):
                if i >= skip:
                    yield first + i, json.loads(line)


def records(part: Range) -> Iterator[tuple]:
    topic, number = part.key.rsplit("/", 1)
    for offset, r in _lines(part):
        ts = None if r["ts"] is None else EPOCH + dt.timedelta(microseconds=r["ts"])
        yield topic, int(number), offset, r["key"], r["headers"], None if r["value"] is None else base64.b64decode(r["value"]), ts


def batches(part: Range, most: int = 5_000, most_bytes: int = 16 << 20):
    """The rows of records(part) as Arrow batches of at most `most` rows, fewer where values are long."""
    import pyarrow as pa

    schema = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("value", pa.binary()), ("ts", pa.timestamp("us", "UTC"))])
    topic, number = part.key.rsplit("/", 1)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        offsets, keys, headers, values, times = zip(*rows, strict=True)
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([topic] * n, [int(number)] * n, offsets, keys, headers, values, times), schema, strict=True)], schema=schema)

    rows, size = [], 0
    for offset, r in _lines(part):
        value = None if r["value"] is None else base64.b64decode(r["value"])
        rows.append((offset, r["key"], None if r["headers"] is None else list(r["headers"].items()), value, r["ts"]))
        size += len(value or b"")
        if len(rows) >= most or size >= most_bytes:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def micros(ts: dt.datetime | None) -> int | None:
    return None if ts is None else ((ts if ts.tzinfo else ts.astimezone()) - EPOCH) // dt.timedelta(microseconds=1)


def line_of(key, headers, value, us: int | None) -> str:
    value = value.encode() if isinstance(value, str) else value
    return json.dumps({"key": key, "headers": headers or {}, "value": None if value is None else base64.b64encode(value).decode(), "ts": us}) + "\n"


def _maps(column) -> list[dict | None]:
    """The maps of an Arrow column; a scalar for each entry would cost more than the rest of the row."""
    at, keys, items = column.offsets.to_pylist(), column.keys.to_pylist(), column.items.to_pylist()
    return [dict(zip(keys[i:j], items[i:j], strict=True)) if there else None for i, j, there in zip(at, at[1:], column.is_valid().to_pylist(), strict=False)]


def rows_of(found) -> Iterator[tuple]:
    """Arrow batches -> the values of WRITTEN, times in microseconds."""
    import pyarrow as pa

    for b in found:
        ts, headers = b.column("ts"), b.column("headers")
        zoned = pa.types.is_timestamp(ts.type) and ts.type.tz
        us = ts.cast(pa.timestamp("us", ts.type.tz)).cast(pa.int64()).to_pylist() if zoned else map(micros, ts.to_pylist())
        maps = _maps(headers) if pa.types.is_map(headers.type) else headers.to_pylist()
        yield from zip(*(b.column(c).to_pylist() for c in ("topic", "partition", "key")), maps, b.column("value").to_pylist(), us, strict=True)


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.base, self.rows = options["path"].rstrip("/"), int(options.get("rowsperpartition", "50000"))
        self.topics = [t.strip() for t in options["topics"].split(",")] if options.get("topics") else None

    def read(self, partition: Range):
        return batches(partition)


class FeedReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(self.base, {}, ends(self.base, self.topics), self.rows, self.topics) or [Range(self.base, "/0", [])]


class FeedStreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return ends(self.base, self.topics)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self.base, start, end, self.rows, self.topics)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str, int]]  # "topic/partition", staging file, number of records


class FeedStreamWriter(DataSourceStreamWriter):
    """Options: path, and `writer`, the name under which batches are numbered: one for each query that writes."""

    def __init__(self, options: dict[str, str]):
        self.base, self.writer = options["path"].rstrip("/"), options.get("writer", "writer")

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.stage((*(r[c] for c in WRITTEN[:-1]), micros(r["ts"])) for r in iterator)

    def stage(self, rows: Iterator[tuple]) -> Staged:
        """The values of WRITTEN -> staging files of SEGMENT records at most."""
        from pyspark import TaskContext

        fs, root = _open(self.base)
        own, task = f"{root}/_staging/{self.writer}/{uuid.uuid4().hex}", TaskContext.get()
        files: list[tuple[str, str, int]] = []
        open_: dict[tuple, list] = {}  # path, number of records, stream
        fs.create_dir(own, recursive=True)
        default = task.partitionId() if task else 0
        try:
            for topic, part, key, headers, value, us in rows:
                to = (topic, default if part is None else part)
                x = open_.get(to)
                if x is None:
                    path = f"{own}/{len(files) + len(open_):08d}.jsonl"
                    x = open_[to] = [path, 0, fs.open_output_stream(path, buffer_size=1 << 18)]
                x[1] += 1
                x[2].write(line_of(key, headers, value, us).encode())
                if x[1] >= SEGMENT:
                    x[2].close()
                    files.append((f"{topic}/{to[1]}", x[0], x[1]))
                    del open_[to]
        finally:
            for x in open_.values():
                x[2].close()
        return Staged(files + [(f"{topic}/{part}", path, n) for (topic, part), (path, n, _) in open_.items()])

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        fs, root = _open(self.base)
        manifest = f"{root}/_batches/{self.writer}/{batchId:012d}.json"
        if fs.get_file_info(manifest).is_file:
            self._finish(fs, root, json.loads(fs.open_input_stream(manifest).read()))
            self._drop(fs, messages)
            return
        at, moves = ends(self.base), []
        for key, path, n in sorted(f for m in messages if m for f in m.files):
            first = at.get(key, 0)
            moves.append((path, f"{key}/{first:012d}-{n}.jsonl"))
            at[key] = first + n
        fs.create_dir(manifest.rsplit("/", 1)[0], recursive=True)
        part = f"{manifest}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as out:
            out.write(json.dumps(moves).encode())
        fs.move(part, manifest)
        self._finish(fs, root, moves)

    @staticmethod
    def _finish(fs, root: str, moves: list) -> None:
        for folder in sorted({to.rsplit("/", 1)[0] for _, to in moves}):
            fs.create_dir(f"{root}/{folder}", recursive=True)
        for path, to in moves:
            if not fs.get_file_info(f"{root}/{to}").is_file:
                fs.move(path, f"{root}/{to}")

    @staticmethod
    def _drop(fs, messages: list[Staged | None]) -> None:
        for _, path, _ in (f for m in messages if m for f in m.files):
            if fs.get_file_info(path).is_file:
                fs.delete_file(path)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._drop(_open(self.base)[0], messages)


class FeedStreamArrowWriter(FeedStreamWriter, DataSourceStreamArrowWriter):
    """The same for Arrow batches: no Row is made for a record."""

    def write(self, iterator) -> Staged:
        return self.stage(rows_of(iterator))


class FeedWriter(DataSourceArrowWriter):
    """A batch write, committed once under a name of its own."""

    def __init__(self, options: dict[str, str]):
        self.stream = FeedStreamArrowWriter({**options, "writer": f"batch-{uuid.uuid4().hex}"})

    def write(self, iterator) -> Staged:
        return self.stream.write(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.stream.commit(messages, 0)

    def abort(self, messages: list[Staged | None]) -> None:
        self.stream.abort(messages, 0)


class Feed(DataSource):
    """spark.readStream.format("feed").option("path", base).option("topics", "a,b").load()"""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> FeedWriter:
        return FeedWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> FeedStreamArrowWriter:
        return FeedStreamArrowWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Feed)


def append(base: str, topic: str, partition: int, rows: list[tuple]) -> int:
    """Append (key, headers, value, ts) to a partition as one segment; the offset of the first. One producer a partition."""
    fs, root = _open(base)
    first, folder = ends(base, [topic]).get(f"{topic}/{partition}", 0), f"{root}/{topic}/{partition}"
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write("".join(line_of(key, headers, value, micros(ts)) for key, headers, value, ts in rows).encode())
    fs.move(part, f"{folder}/{first:012d}-{len(rows)}.jsonl")
    return first


def normalised(messages):
    """Raw messages of the feed -> rows for its writer, in one pass: canonical readings as JSON in topic `canonical`, keyed by unit, and dead letters in topic `dead`; partition and headers stay, with where each came from."""
    from pyspark.sql import functions as F

    from . import raw

    d = raw.judged(messages)
    bad = F.col("problem").isNotNull()
    letter = F.to_json(F.struct("topic", "partition", "offset", F.col("problem").alias("error_code"), raw.error_detail().alias("error_detail"), F.base64(F.col("value").cast("binary")).alias("raw_payload_b64")))
    source = F.create_map(F.lit("source"), F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")))
    kept = F.map_filter("headers", lambda k, v: k != "source")
    return d.select(
        F.when(bad, "dead").otherwise("canonical").alias("topic"), "partition", F.when(bad, F.col("key")).otherwise(F.col("r.vin")).alias("key"), F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), source).alias("headers"),
        F.when(bad, letter).otherwise(F.to_json("r")).cast("binary").alias("value"), "ts",
    )
