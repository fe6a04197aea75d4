"""Exact top-k search by inner product, block at a time, with blocks pruned by the maxima of their terms.

A term is a dimension and a sign: a vector has weight max(x, 0) on the one and max(-x, 0) on the other, so an inner
product is at most the sum, over a query's terms, of its weight times the largest weight in the block with that sign.
Documents are put in the order of their heaviest terms and cut into ranges of BLOCK; a block keeps the maxima of its
terms and a forward index (its vectors as integers). A query goes through the blocks of a shard in the order of their
bounds, scores the documents of one block at a time through the forward index, and ends when no bound reaches the k-th
best score known so far (or reaches it with larger ids only).

On Spark: a first pass scores every query in the one most promising block of each shard; the k-th best of all these is
a floor that the second pass starts from in every shard. A shard holds a bounded number of documents, a query group a
bounded number of queries; they meet one pair at a time in a cogroup, so no task holds more than one of each, and what
leaves a task is at most k rows for a query. Which documents share a block or shard changes the time, never the result.
Vectors whose terms hardly differ (random directions) have bounds far over their scores: then every block is scored,
by one matrix product, and nothing is lost.

Vectors that are null, or hold null or non-finite components, take no part. A query meets vectors of its own dimension
only. Ties go to the smaller id, null ids last. Rows are told apart by their place in the stored table: repeated rows
and ids each are queries and candidates of their own, and only a query's own row is left out. Scores are exact; where
components are so large that 64 bits might not hold a sum, Python integers are used, and what is beyond a long in the
end is the nearest long. Empty vectors score 0. Columns other than the id and the vector are left out, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

#: Documents of a block.
BLOCK = 128
LAST = np.iinfo(np.int64).max
PACKS = "dim int, n int, least long, ids binary, known binary, rows binary, vectors binary, most binary, floors binary, floor_ids binary"
HITS = "query long, query_id long, row long, vec_id long, score long"
_HIT = [x.split()[0] for x in HITS.split(", ")]


def scaled(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """row, id, v of the usable vectors: v holds floor(scale * component) as longs (the nearest long but the smallest, where it is beyond them)."""
    x = F.col("__x")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("__x"))
    return rows.filter(x.isNotNull() & ~bad).select("row", "id", F.transform(x, lambda c: F.greatest(F.floor(F.lit(float(scale)) * c).cast("long"), F.lit(-LAST))).alias("v"))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, at most the largest long."""
    size = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    most = size(a) * size(b) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most <= LAST:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LAST, LAST).astype(np.int64)


def terms(v: np.ndarray) -> np.ndarray:
    """Weights of the terms: each dimension as it points up, then as it points down."""
    return np.concatenate([np.maximum(v, 0), np.maximum(-v, 0)], axis=1)


def _packed(size: int, with_floors: bool):
    """Rows in the order they come, `size` of one dimension to a pack."""

    def emit(dim: int, part: list[np.ndarray]) -> tuple:
        rows, ids, known, v, floors, floor_ids = part
        if not with_floors:  # candidates: by id, so that the first of equal scores is the one that counts
            order = np.lexsort((rows, ids))
            rows, ids, known, v = rows[order], ids[order], known[order], v[order]
        most = b"" if with_floors else terms(v).max(axis=0).tobytes()
        return (dim, len(rows), int(ids.min()), ids.tobytes(), known.tobytes(), rows.tobytes(), v.tobytes(), most, floors.tobytes(), floor_ids.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        names = [x.split()[0] for x in PACKS.split(", ")]
        for b in batches:
            out, sizes = [], b["v"].value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = b["v"].flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            long = lambda c, n=b: n[c].fill_null(LAST).to_numpy(zero_copy_only=False)
            known = b["id"].is_valid().to_numpy(zero_copy_only=False)
            floors = (long("floor"), long("floor_id")) if with_floors else (np.zeros(b.num_rows, np.int64),) * 2
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                v = flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0), np.int64)
                part = [long("row")[at], long("id")[at], known[at], np.maximum(v, -LAST), *(f[at] for f in floors)]
                part = [np.concatenate(x) for x in zip(held[dim], part, strict=True)] if dim in held else part
                while len(part[0]) >= size:
                    out.append(emit(dim, [x[:size] for x in part]))
                    part = [x[size:] for x in part]
                held[dim] = part
            if out:
                yield pd.DataFrame(out, columns=names)
        out = [emit(dim, part) for dim, part in held.items() if len(part[0])]
        if out:
            yield pd.DataFrame(out, columns=names)

    return lambda batches: (pa.RecordBatch.from_pandas(x, schema=_PACKS, preserve_index=False) for x in run(batches))


_PACKS = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in PACKS.split(", "))])


def candidate_blocks(rows: DataFrame, parts: int, size: int = BLOCK) -> DataFrame:
    """PACKS of rows(row, id, v) with the maxima of each block's terms, documents in the order of their heaviest terms."""
    weight = F.transform("v", lambda x, i: F.struct((-F.abs(x)).alias("w"), (2 * i + (x < 0).cast("int")).alias("t")))
    heavy = F.transform(F.slice(F.array_sort(weight), 1, 4), lambda x: x["t"])
    order = [F.size("v"), *[F.get("heavy", F.lit(i)) for i in range(4)], "id", "row"]
    rows = rows.withColumn("heavy", heavy).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.select("row", "id", "v").mapInArrow(_packed(size, False), PACKS)


def query_packs(queries: DataFrame, size: int = 1024) -> DataFrame:
    """PACKS of queries(row, id, v, floor, floor_id)."""
    return queries.select("row", "id", "v", "floor", "floor_id").mapInArrow(_packed(size, True), PACKS)


class Group:
    """The packs of one side of a cogroup as arrays."""

    def __init__(self, packs: pd.DataFrame):
        dim = int(packs["dim"].iloc[0])
        read = lambda c, kind=np.int64: [np.frombuffer(x, kind) for x in packs[c]]
        self.ids, self.known, self.rows = read("ids"), read("known", bool), read("rows")
        self.vectors = [np.frombuffer(x, np.int64).reshape(n, dim) for x, n in zip(packs["vectors"], packs["n"], strict=True)]
        self.least, self.most = packs["least"].to_numpy(), read("most")
        self.floors, self.floor_ids = read("floors"), read("floor_ids")


def search(queries: Group, blocks: Group, k: int, rounds: int = 64) -> tuple[list[np.ndarray], int]:
    """The k best of the blocks for each query, as columns (query's place, block, place in block, score); and how many pairs of a query and a block were scored."""
    q = np.concatenate(queries.vectors)
    floor, floor_id = np.concatenate(queries.floors), np.concatenate(queries.floor_ids)
    own = np.concatenate(queries.rows)
    bounds = dot(terms(q), np.array(blocks.most).reshape(len(blocks.most), -1))
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = [np.zeros(0, np.int64) for _ in range(5)]  # query, -score, id, row, code of the place
    held: list[list[np.ndarray]] = []
    alive, at, step, scored = np.arange(len(q)), 0, 1, 0

    def settle() -> None:
        nonlocal best
        columns = [np.concatenate(x) for x in zip(best, *held, strict=True)]
        held.clear()
        columns = [x[np.lexsort((columns[3], columns[2], columns[1], columns[0]))] for x in columns]
        first = np.flatnonzero(np.diff(columns[0], prepend=-1))
        rank = np.arange(len(columns[0])) - np.repeat(first, np.diff(np.append(first, len(columns[0]))))
        best = [x[rank < k] for x in columns]
        full = columns[0][rank == k - 1], -columns[1][rank == k - 1], columns[2][rank == k - 1]
        better = (full[1] > floor[full[0]]) | ((full[1] == floor[full[0]]) & (full[2] < floor_id[full[0]]))
        i = full[0][better]
        floor[i], floor_id[i] = full[1][better], full[2][better]

    for _ in range(rounds):
        if at >= len(blocks.most) or not len(alive):
            break
        next_ = order[alive, at : at + step]
        reach = bounds[alive[:, None], next_]
        wanted = (reach > floor[alive, None]) | ((reach == floor[alive, None]) & (blocks.least[next_] <= floor_id[alive, None]))
        i, j = np.nonzero(wanted)
        block, of = next_[i, j], alive[i]
        turn = np.argsort(block, kind="stable")
        scored += len(turn)
        for part in np.split(turn, np.flatnonzero(np.diff(block[turn])) + 1) if len(turn) else []:
            b, mine = int(block[part[0]]), of[part]
            s = dot(q[mine], blocks.vectors[b])
            self_ = own[mine][:, None] == blocks.rows[b][None, :]
            open_ = (s >= floor[mine, None]) & ~self_
            some = np.flatnonzero(open_.any(axis=1))
            if not len(some):
                continue
            # documents of a block stand by id: a stable order takes the smaller id of equal scores
            top = np.argsort(np.where(open_[some], -s[some], LAST), axis=1, kind="stable")[:, :k]
            r, c = np.repeat(some, top.shape[1]), top.ravel()
            keep = open_[r, c]
            r, c = r[keep], c[keep]
            held.append([mine[r], -s[r, c], blocks.ids[b][c], blocks.rows[b][c], (b << 32) + c])
            if sum(len(x[0]) for x in held) > 2_000_000:
                settle()
        if held:
            settle()
        alive = alive[reach[:, -1] >= floor[alive]]  # bounds fall from here on
        at, step = at + step, 2 * step
    return [best[0], best[4] >> 32, best[4] & 0xFFFFFFFF, -best[1]], scored


def _hits(k: int, rounds: int):
    def meet(_, blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in _HIT})
        b, q = Group(blocks), Group(queries)
        (of, block, place, score), _ = search(q, b, k, rounds)
        start = np.cumsum([0] + [len(x) for x in b.ids])[:-1][block] + place
        pick = lambda g, at: pd.Series(np.concatenate(g.ids)[at], dtype="Int64").where(pd.Series(np.concatenate(g.known)[at]))
        return pd.DataFrame({"query": np.concatenate(q.rows)[of], "query_id": pick(q, of), "row": np.concatenate(b.rows)[start], "vec_id": pick(b, start), "score": score})

    return meet


def top_k(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024, every: int = 100, shard_rows: int = 1 << 16, group_rows: int = 1 << 13) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by `every`.

    shard_rows and group_rows bound what meets in one task (on average, as packs are dealt by hash).
    """
    parts = partitions(df.sparkSession)
    rows = stored(scaled(df, id_col, vector, scale), "topk-vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows), min(parts, n // (8 * BLOCK)))
    asked = rows.filter(F.col("id") % every == 0)
    groups = max(1, -(-asked.count() // group_rows))
    dealt = lambda c, most: F.pmod(F.xxhash64(c), F.lit(most))
    everywhere = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)).cast("array<long>"))
    blocks = stored(candidate_blocks(rows, max(parts, shards)).withColumn("shard", dealt("rows", shards)), "topk-blocks")
    theirs = blocks.withColumn("grp", everywhere(groups)).groupBy("dim", "shard", "grp")

    def hits(queries: DataFrame, rounds: int) -> DataFrame:
        packs = stored(query_packs(queries).withColumn("grp", dealt("rows", groups)), "topk-queries")
        ours = packs.withColumn("shard", everywhere(shards)).groupBy("dim", "shard", "grp")
        return theirs.cogroup(ours).applyInPandas(_hits(k, rounds), HITS)

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    none = asked.withColumns({"floor": F.lit(-LAST - 1), "floor_id": F.lit(LAST)})
    if shards > 1:  # what each query finds in the most promising block of every shard
        kth = stored(hits(none, 1).withColumn("place", place).filter(F.col("place") == k), "topk-floors")
        kth = kth.select(F.col("query").alias("row"), F.col("score").alias("__floor"), F.coalesce("vec_id", F.lit(LAST)).alias("__id"))
        none = none.join(kth, "row", "left").withColumns({"floor": F.coalesce("__floor", "floor"), "floor_id": F.coalesce("__id", "floor_id")})
    found = hits(none, 64).withColumn("rank", place).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH x AS (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * CAST(c AS DOUBLE)) FOR c IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score FROM x AS q JOIN x ON q.r <> x.r AND len(q.v) = len(x.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 10
"""
