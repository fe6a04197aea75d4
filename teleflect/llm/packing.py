"""Best-fit packing of token sequences by hierarchical residual packing.

Each group of items is packed best-fit decreasing by itself; bins that are nearly full go out, underfull ones become
items of the next round, where fan_in groups meet, until one group is left or a round helps no more. A bin that went
on keeps its members in order, so their offsets only move by where it is put. Null texts are empty: their document is the
end id alone. Only documents longer than a sequence are cut. Equal lengths are placed in the order of their items.
Repeated rows are packed each; columns other than doc_id and text are left out, whatever their names; an empty table
gives an empty result.

No group has more than about 2 * group_items bins in any round, whatever the items: a round has as many groups as that
asks for, and where underfull bins cannot be merged into fewer they are dealt anew. On the 0.1 tables this packs 2,270
sequences, the number that the tokens fill at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .tokens import encoder

PIECES = "item long, doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """PIECES of docs(doc_id, text): ids as little-endian unsigned 32-bit integers, at most `capacity` of them. item is unique; store the result before using it twice."""

    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 36
        rows, size = [], 0
        for b in slices(batches):
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encoder(tokenizer).encode(b["text"].to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    rows.append((item, doc_id, k, at, min(capacity, len(ids) - at), ids[at : at + capacity].tobytes()))
                    item += 1
                size += len(ids)
            if size > 1_000_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: items in descending order, each into the open bin that it fills most. Bins are numbered from 0."""
    out = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = made = 0  # bit r of rooms: a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := rooms >> size << size:
            room = (fits & -fits).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, k, made = capacity, made, made + 1
        out[i] = k
        if left := room - size:
            open_bins[left].append(k)
            rooms |= 1 << left
    return out


BINS = "grp long, size long, items array<long>, offsets array<long>, done boolean"


def _fitting(capacity: int, nearly: float, last: bool):
    """One round on one group; in the last round every bin goes out."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        sizes = g["size"].to_numpy()
        bins = best_fit(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        members, offsets, rows = g["items"].to_numpy(), g["offsets"].to_numpy(), []
        for own in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1):
            before = np.cumsum(sizes[own]) - sizes[own]
            size = int(sizes[own].sum())
            rows.append((int(g["grp"].iloc[0]), size, np.concatenate(members[own]), np.concatenate([offsets[i] + b for i, b in zip(own, before, strict=True)]), last or size >= nearly * capacity))
        return pd.DataFrame(rows, columns=["grp", "size", "items", "offsets", "done"])

    return fit


def pack(items: DataFrame, capacity: int = 4096, group_items: int = 50_000, fan_in: int = 8, nearly: float = 0.998, most_rounds: int = 20) -> DataFrame:
    """items(item long, unique; length long from 1 to capacity) -> item, sequence_id, offset.

    A group has at most about 2 * group_items bins in every round: their number is taken from how many are left, never
    from the round before. A round in which underfull bins meet others of their group and their number falls by less
    than 1 % is followed by one that deals them anew; two such rounds in a row end the tree, as what is left can hardly
    fill each other.
    """
    left = items.count()
    groups = max(1, -(-left // group_items))
    rest = items.select(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("grp"), F.col("length").alias("size"), F.array("item").alias("items"), F.array(F.lit(0).cast("long")).alias("offsets"))
    full: list[DataFrame] = []
    idle = 0
    for r in range(most_rounds):
        bins = stored(rest.groupBy("grp").applyInPandas(_fitting(capacity, nearly, last=groups == 1), BINS), f"bins-{r}")
        full.append(bins.filter("done"))
        rest = bins.filter("not done")
        if groups == 1:
            break
        before, left = left, rest.count()
        idle = idle + 1 if r and left > 0.99 * before else 0
        if not left or idle == 2:
            full.append(rest)
            break
        merged = max(-(-groups // fan_in), -(-left // group_items))
        # neighbours merge while that keeps groups small; where none can, bins are dealt anew and meet others
        anew = F.pmod(F.xxhash64(F.col("items")[0], F.lit(r)), F.lit(merged))
        rest = rest.select((F.floor(F.col("grp") / -(-groups // merged)) if merged < groups else anew).cast("long").alias("grp"), "size", "items", "offsets")
        groups = merged
    else:
        full.append(rest)
    out = full[0]
    for f in full[1:]:
        out = out.unionByName(f)
    # the smallest item names its sequence: unique, and the same whenever the plan runs again
    return out.select(F.array_min("items").alias("sequence_id"), F.explode(F.arrays_zip("items", "offsets")).alias("m")).select(F.col("m.items").alias("item"), "sequence_id", F.col("m.offsets").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and its ids unless with_ids is false."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids").cast("long"))
    pieces = stored(pieces if with_ids else pieces.drop("ids"), "pieces")
    placed = stored(pack(pieces.select("item", "length"), capacity), "placed")
    return pieces.join(placed, "item").drop("item")
