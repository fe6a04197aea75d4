"""Token ids in length-delimited binary records, with an offset index beside each file for shuffled reads.

A record: u64 length of the payload, u32 masked checksum of those 8 bytes, payload, u32 masked checksum of it; all
little-endian, checksums CRC-32 rotated right by 15 bits plus a constant, so that a checksum of data that holds
checksums stays useful. Payload: u8 bytes per id (2 or 4, as the tokenizer's vocabulary asks for), u8 1 if doc_id is
known, i64 doc_id, ids. The index file holds one (u64 offset, u64 number of ids) pair for each record. Files are in
ascending doc_id order (null first, ties by the text's hash), each sorted as well; a task writes both as it goes and
holds one batch of texts.

A null text is empty and still gets its record; so does every repeated row, and a very long text is one record. Columns
other than doc_id and text are left out, whatever their names. An empty table gives no file and no row.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, partitions, publishing, shared_dir, stored
from .tokens import encoder

_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def payload_of(record: bytes) -> bytes:
    """The payload of one framed record; ValueError if it is damaged."""
    size, body = record[:8], record[12:-4]
    if len(record) < 16 or struct.unpack("<Q", size)[0] != len(body) or struct.unpack("<I", record[8:12])[0] != masked(size) or struct.unpack("<I", record[-4:])[0] != masked(body):
        raise ValueError("a damaged record")
    return body


def packed(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"an id does not fit {width} bytes")
    return struct.pack("<BBq", width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, known, doc_id = struct.unpack_from("<BBq", payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=10)


def width_for(tokenizer: str, end_id: int) -> int:
    """Bytes that hold every id of a tokenizer file, and end_id."""
    from tokenizers import Tokenizer

    most = max([end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])
    return 2 if most < 1 << 16 else 4


def write_records(docs: DataFrame, tokenizer: str, end_id: int, width: int | None = None) -> DataFrame:
    """Write docs(doc_id, text) to files in a new shared folder. Returns one row a file: part, path, records, tokens, tokens_before.

    width: bytes of an id; as the vocabulary asks for unless given. An id that does not fit is an error.
    """
    spark = docs.sparkSession
    folder, width = shared_dir(spark, "records"), width or width_for(tokenizer, end_id)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((doc_id, ids) for b in batches for doc_id, ids in zip(b["doc_id"], encoder(tokenizer).encode(b["text"]), strict=True))
        first = next(rows, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        path, at, records, total = f"{folder}/part-{part:06d}", 0, 0, 0
        with publishing(f"{path}.idx") as index, publishing(f"{path}.rec") as body:
            for doc_id, ids in itertools.chain([first], rows):
                record = frame(packed(None if pd.isna(doc_id) else int(doc_id), np.append(ids, np.uint32(end_id)), width))
                index.write(struct.pack("<QQ", at, len(ids) + 1))
                body.write(record)
                at, records, total = at + len(record), records + 1, total + len(ids) + 1
        yield pd.DataFrame({"part": [part], "path": [path], "records": [records], "tokens": [total]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = stored(rows.mapInPandas(write, "part long, path string, records long, tokens long"), "record-files")
    # one small row for each file, not for each document
    before, done = [], 0
    for f in files.select("part", "tokens").orderBy("part").toLocalIterator():
        before.append((f["part"], done))
        done += f["tokens"]
    return files.join(F.broadcast(spark.createDataFrame(before, "part long, tokens_before long")), "part")


def read_records(files: DataFrame, shuffle_seed: int | None = None, block: int = 1 << 22) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every record, each checked; in file order, or read by offset in a random order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b.itertuples():
                fs, path = filesystem(f.path)
                with fs.open_input_stream(f"{path}.idx") as s:
                    index = np.frombuffer(s.read(), "<u8").reshape(-1, 2).astype(np.int64)
                with fs.open_input_file(f"{path}.rec") as s:
                    starts = f.tokens_before + np.cumsum(index[:, 1]) - index[:, 1]
                    ends = np.append(index[1:, 0], s.size())
                    order = np.arange(len(index)) if shuffle_seed is None else np.random.default_rng([shuffle_seed, f.part]).permutation(len(index))
                    out, size = [], 0
                    for i in order.tolist():
                        s.seek(int(index[i, 0]))
                        doc_id, ids = unpacked(payload_of(s.read(int(ends[i] - index[i, 0]))))
                        out.append((doc_id, starts[i], ids.astype("<u4").tobytes()))
                        size += len(out[-1][2])
                        if size >= block:
                            yield pd.DataFrame(out, columns=["doc_id", "start", "ids"]).astype({"doc_id": "Int64"})
                            out, size = [], 0
                    if out:
                        yield pd.DataFrame(out, columns=["doc_id", "start", "ids"]).astype({"doc_id": "Int64"})

    n = partitions(files.sparkSession)
    return files.repartition(n, "part").mapInPandas(read, "doc_id long, start long, ids binary")


def digest(ids) -> F.Column:
    """Unsigned CRC-32 of ids held as little-endian unsigned 32-bit integers."""
    return F.crc32(ids).cast("long")
