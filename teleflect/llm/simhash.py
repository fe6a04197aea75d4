"""SimHash near-dedup by meet-in-the-middle ball hashing.

If two fingerprints differ in at most r bits, some value lies within r/2 bits of both. So every fingerprint emits all
values within half the radius, rows meet by value, and pairs that meet are verified. On whole 64-bit fingerprints that
takes 2081 values each for r = 4. `blocks` spreads the radius first: of two halves one differs in at most r/2 bits, so
emitting the ball of half that radius in each half (66 values for r = 4) meets every pair as well; pairs are then
verified on all 64 bits. blocks=1 is the plain form and gives the same links.

Texts with equal fingerprints are one class from the start, so copies cost nothing here. A value under which more than
`most` fingerprints meet is not compared pair by pair: its fingerprints go on to whole 64-bit values within r/2, where
all that meet differ in at most r bits, and each links to the smallest. That keeps every component whole, in work
that grows with the number of fingerprints. Null and blank texts have fingerprint zero and link like any other.

Repeated rows, and several texts under one doc_id, each have a row; a null doc_id gets its fingerprint and names no
component (null where a component has no other). Very long texts count whole. Other columns are left out, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, partitions, slices, stored, whole_runs
from .components import components
from .exact import text_hash
from .words import Block, blocks, mixed, windows, worker_table

BITS = 64


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the k-word shingles of a text, ASCII capitals lowered, each bit set in over half of the hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    stops = ends[min(k, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[s : e - 1], seed) for s, e in zip(starts, stops)), np.uint64, len(stops))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of docs(doc_id, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(each, "doc_id long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in bits) for n in range(radius + 1) for bits in itertools.combinations(range(width), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _emit(fps: DataFrame, masks: list[int], shift: int, width: int) -> DataFrame:
    """One row for each value in the ball around bits shift..shift+width of fp: key (those bits in place), fp."""
    own = _signed(((1 << width) - 1) << shift)
    values = F.explode(F.array(*[F.lit(_signed(m << shift)) for m in masks]))
    return fps.select("fp", values.alias("mask")).select("fp", F.col("fp").bitwiseAND(F.lit(own)).bitwiseXOR(F.col("mask")).alias("key"))


def _spanning(run: np.ndarray, lanes: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs within `radius` bits inside each run, as many as keep together what all of them join.

    Each row links to the first row near it, and to another near one only if that one has another first: else both
    hang on the same row already.
    """
    pairs, step = [np.zeros((2, 0), np.int64)], 1
    while step < len(run):
        same = np.flatnonzero(run[step:] == run[:-step])
        if not len(same):
            break
        near = sum(np.bitwise_count(x[same] ^ x[same + step]) for x in lanes) <= radius
        pairs.append(np.stack([same, same + step])[:, near])
        step += 1
    j, i = np.concatenate(pairs, axis=1)
    first = np.arange(len(run))
    np.minimum.at(first, i, j)
    use = (first[i] == j) | (first[j] != first[i])
    return j[use], i[use]


def _meet(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """rows(block, key, fp) -> a, b, hot: verified pairs a < b that keep together what all pairs join; or, where over `most` fingerprints share a value, a = fp and b = key."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, run, hot in whole_runs(batches, ["block", "key"], most):
            block, key, fp = (rows[c].to_numpy() for c in ("block", "key", "fp"))
            if hot.any():
                yield pd.DataFrame({"a": fp[hot], "b": key[hot], "block": block[hot], "hot": True})
            cool = fp[~hot].astype(np.int64)
            j, i = _spanning(run[~hot], [cool.view(np.uint64)], radius)
            if len(i):
                yield pd.DataFrame({"a": np.minimum(cool[i], cool[j]), "b": np.maximum(cool[i], cool[j]), "block": -1, "hot": False})

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "block", "key").sortWithinPartitions("block", "key").mapInPandas(scan, "a long, b long, block int, hot boolean")


def _stars(values: DataFrame) -> DataFrame:
    """values(key, fp): fingerprints of one whole value differ in at most r bits; each links to the smallest."""
    least = values.groupBy("key").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "m")
    return values.join(least, "key").filter("fp <> m").select(F.col("m").alias("u"), F.col("fp").alias("v")).distinct()


def links(fps: DataFrame, radius: int = 4, blocks: int = 2, most: int = 512) -> DataFrame:
    """fps(fp long), distinct -> u, v: links that join the same fingerprints as all pairs within `radius` bits do."""
    if radius % (2 * blocks) or BITS % blocks:
        raise ValueError("radius must be a multiple of 2 * blocks, and blocks divide 64")
    half, width = radius // 2, BITS // blocks
    if blocks == 1:
        return _stars(_emit(fps, _ball(BITS, half), 0, BITS))
    masks = _ball(width, half // blocks)
    rows = None
    for k in range(blocks):
        own = _emit(fps, masks, k * width, width).withColumn("block", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    met = stored(_meet(rows, radius, most), "met")
    found = met.filter("not hot").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    hot = met.filter("hot")
    if not hot.limit(1).count():
        return found
    for k in range(blocks):  # whole values: the shared bits as they met, all other bits within what is left of half the radius
        own = _signed(((1 << width) - 1) << (k * width))
        others = [i for i in range(BITS) if not k * width <= i < (k + 1) * width]
        used = F.bit_count(F.col("a").bitwiseAND(F.lit(own)).bitwiseXOR(F.col("b")))
        for d in range(half // blocks + 1):
            masks = [_signed(sum(1 << i for i in bits)) for n in range(half - d + 1) for bits in itertools.combinations(others, n)]
            part = hot.filter((F.col("block") == k) & (used == d)).select(F.col("a").alias("fp"), F.col("a").bitwiseAND(F.lit(~own)).bitwiseOR(F.col("b")).alias("base"), F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
            part = part.select("fp", F.col("base").bitwiseXOR(F.col("mask")).alias("key"))
            whole = part if (k, d) == (0, 0) else whole.unionByName(part)
    return found.unionByName(_stars(whole)).distinct()


def near_groups(docs: DataFrame, k: int = 4, radius: int = 4, blocks: int = 2, most: int = 512) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links of at most `radius` bits reach."""
    prints = stored(fingerprints(docs, k), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius, blocks, most))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingle_sets(texts: Iterable[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its k-word shingles, ASCII capitals lowered; a text of fewer words is one shingle, a blank one none."""
    for block in blocks((t or "").encode().lower() for t in texts):
        b = Block(block)
        first = b.first
        at, hashes = windows(b.hashes(b.starts, b.ends), first, k)
        cuts = np.searchsorted(at, first)
        for i, text in enumerate(block):
            if cuts[i] == cuts[i + 1] and first[i] < first[i + 1]:
                yield np.array([xxhash.xxh64_intdigest(b" ".join(text.split()), 42)], np.uint64)
            else:
                yield np.unique(hashes[cuts[i] : cuts[i + 1]])


#: Bands and minima a band: two sets of similarity 0.8 share a band with probability 1 - (1 - 0.8**6)**32 = 0.99994.
BANDS = (32, 6)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of MinHash values of a set; none for an empty set."""
    n, each = BANDS
    if not len(shingles):
        return np.zeros(0, np.int64)
    flip, times = np.random.default_rng(42).integers(1 << 64, size=(2, n * each), dtype=np.uint64)
    times |= np.uint64(1)
    least = np.full(n * each, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[at : at + 512, None] ^ flip) * times).min(axis=0))
    keys = np.arange(1, n + 1, dtype=np.uint64)
    for column in least.reshape(n, each).T:
        keys = mixed((keys ^ column) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


#: Bits of a sketch; every shingle of a set flips one of them.
SKETCH = 512


#: Shingles before one in a prefix that tell whether a pair has met already.
BEFORE = 16


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH bits as longs, each set if an odd number of shingles fall on it. Sketches of two sets never differ in more bits than the sets differ in shingles."""
    at = (mixed(shingles) & np.uint64(SKETCH - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slices; a table left by an earlier stage is let go."""
    worker_table("near-sets", lambda: None)
    yield from slices(batches)


def _alike(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Of pairs(a, b) of classes those whose shingle sets have a Jaccard similarity of `least` or more, as u, v."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            ta, tb = (shingle_sets(rows[c].to_pylist(), k) for c in ("ta", "tb"))
            hit = [same >= least * (len(x) + len(y) - same) for x, y in zip(ta, tb, strict=True) for same in [len(np.intersect1d(x, y, assume_unique=True))]]
            found = rows.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, ["u", "v"])

    side = lambda name, text: texts.select(F.col("cls").alias(name), F.col("text").alias(text))
    return pairs.join(side("a", "ta"), "a").join(side("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(test, "u long, v long")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows(cls, ...) with the smallest class that links lead to from each."""
    return rows.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")


def _similar_links(meetings: DataFrame, texts: DataFrame, k: int, least: float, most: int, known: DataFrame | None = None) -> DataFrame:
    """Links that join the same classes as the links `known` and all pairs of `least` that share a key of meetings(key, cls, low, n) do.

    A bucket of up to `most` classes has all its pairs tested. In a larger one each class is tested with the smallest
    first; classes of buckets that these links leave in several components then go through an exact set-similarity
    join (`_unlinked`), so a large group of near copies is gone through once, and one of texts just under `least` is
    not gone through pair by pair.
    """
    few, many = meetings.filter(F.col("n") <= most).select("key", "cls"), meetings.filter(F.col("n") > most)
    pairs = few.withColumnRenamed("cls", "a").join(few.withColumnRenamed("cls", "b"), "key").filter("a < b").select("a", "b")
    pairs = stored(pairs.unionByName(many.filter("cls <> low").select(F.col("low").alias("a"), F.col("cls").alias("b"))).distinct(), "near-pairs")
    links = stored(_alike(pairs, texts, k, least), "near-links")
    links = links if known is None else links.unionByName(known)
    if not many.limit(1).count():
        return links
    rows = stored(_rooted(many.select("key", "cls"), components(links)), "near-rooted")
    split = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    apart = stored(rows.join(split, "key", "left_semi").select("cls", "root").distinct(), "near-apart")
    if not apart.limit(1).count():
        return links
    more = _unlinked(apart, texts, k, least).join(pairs, ["a", "b"], "left_anti")
    return links.unionByName(stored(_alike(stored(more, "near-pairs"), texts, k, least), "near-links"))


def _unlinked(apart: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Of apart(cls, root) every pair a < b of different roots that can have a Jaccard similarity of `least`: prefix, length and positional filters on shingles in order of frequency, and a filter on sketches.

    Sets x and y, |y| <= |x|, of that similarity share at least `least` * |x| and 2 * `least` / (1 + `least`) * |y|
    shingles, so they share one of the rarest |x| - `least` * |x| + 1 of x that is also among the rarest
    |y| - 2 * `least` / (1 + `least`) * |y| + 1 of y. Texts of one template just under `least` differ in more of their
    shingles than that, so few of them meet; of those, pairs whose sketches differ in over |x| + |y| - 2 * `least` /
    (1 + `least`) * (|x| + |y|) bits differ in as many shingles at least and go. Shingles of one class alone come first and need no row. Of the classes
    that share a shingle, those of its most frequent root are not set against each other. A pair comes out where it
    shares its first shingle: not where both had another one in common among the BEFORE shingles before this one.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = list(shingle_sets(b["text"].to_pylist(), k))
            longs = [pa.array(x, pa.list_(pa.int64())) for x in ([s.view(np.int64) for s in sets], [sketch(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([b["cls"], b["root"], *longs], ["cls", "root", "tokens", "sketch"])

    at_least = lambda x: F.ceil(x - 1e-9)  # noqa: E731  rounding must not shorten a prefix
    size, rare = F.size("tokens"), F.size("own")
    sets = stored(texts.join(apart, "cls").select("cls", "root", "text").mapInArrow(split, "cls long, root long, tokens array<long>, sketch array<long>"), "near-tokens")
    tokens = sets.select("cls", "root", size.alias("size"), F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("n > 1")
    own = tokens.join(counts, "token").groupBy("cls", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token", (F.col("low") < F.col("high")).alias("meets")))).alias("own"))
    single = F.col("size") - rare
    probe = F.col("size") - at_least(least * F.col("size")) + 1
    rows = own.select("cls", "root", "size", single.alias("single"), F.posexplode(F.slice("own", F.lit(1), F.greatest(probe - single, F.lit(0)).cast("int"))))
    rows = rows.filter("col.meets").select("cls", "root", "size", (F.col("single") + F.col("pos")).alias("pos"), F.col("col.token").alias("token"))
    rows = rows.withColumn("indexed", F.col("pos") <= F.col("size") - at_least(2 * least / (1 + least) * F.col("size")))
    order = Window.partitionBy("cls").orderBy("pos")
    rows = stored(rows.withColumn("before", F.collect_list("token").over(order.rowsBetween(-BEFORE, -1))), "near-prefixes")
    main = rows.groupBy("token", "root").count().groupBy("token").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("token", "main")
    rows = stored(rows.join(main, "token").withColumn("main", F.col("main") == F.col("root")).join(sets.select("cls", "sketch"), "cls"), "near-shared")
    kept = ("cls", "root", "size", "pos", "main", "sketch", "before")
    x = rows.select("token", *(F.col(c).alias(f"x_{c}") for c in kept))
    y = rows.filter("indexed").select("token", *(F.col(c).alias(f"y_{c}") for c in kept))
    met = x.filter("not x_main").join(y, "token").unionByName(x.filter("x_main").join(y.filter("not y_main"), "token"))
    both = F.col("x_size") + F.col("y_size")
    rest = F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos"))  # shared from here on, at most
    differ = sum(F.bit_count(F.col("x_sketch")[i].bitwiseXOR(F.col("y_sketch")[i])) for i in range(SKETCH // 64))
    met = met.filter(differ <= both - 2 * at_least(least / (1 + least) * both))
    met = met.filter(~F.arrays_overlap("x_before", "y_before"))
    met = met.filter((F.col("x_root") != F.col("y_root")) & (F.col("y_size") <= F.col("x_size")) & (F.col("y_size") >= at_least(least * F.col("x_size"))) & (rest >= at_least(least / (1 + least) * both)))
    return met.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()


def _print_links(known: DataFrame, radius: int) -> DataFrame:
    """known(cls, fp): the links of ball hashing between classes, as u, v: each fingerprint stands for its smallest class, and its other classes link to that."""
    both = stored(known.select("cls", "fp").distinct(), "near-prints")
    first = stored(both.groupBy("fp").agg(F.min("cls").alias("first")), "near-classes")
    same = both.join(first, "fp").filter("cls <> first").select(F.col("first").alias("u"), F.col("cls").alias("v"))
    side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    met = links(first.select("fp"), radius).join(side("u"), "u").join(side("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    return stored(same.unionByName(met.filter("u <> v")).distinct(), "near-ball-links")


def _similar(docs: DataFrame, k: int, least: float, most: int, radius: int | None = None) -> DataFrame:
    """doc_id, h (hash of its text), component_id and kept of every row, kept: its component's smallest doc_id, and of several texts with that one of them. With `radius`, SimHash links of up to so many bits count too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = b["text"].to_pylist()
            sets = [(xxhash.xxh64_intdigest(s.tobytes()), band_keys(s)) for s in shingle_sets(texts, k)]
            cls = pa.array(np.array([c for c, _ in sets], np.uint64).view(np.int64))
            fps = pa.array(np.array([0 if radius is None else fingerprint(t) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["h"], cls, fps, pa.array([keys for _, keys in sets], pa.list_(pa.int64()))], ["doc_id", "h", "cls", "fp", "keys"])

    docs = docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("h"))
    prints = stored(docs.mapInArrow(each, "doc_id long, h long, cls long, fp long, keys array<long>"), "near-sets")
    known = prints.filter("doc_id is not null")
    rows = known.select("cls", F.explode("keys").alias("key")).repartition(partitions(docs.sparkSession), "key").dropDuplicates(["key", "cls"])
    bucket = Window.partitionBy("key")
    meetings = rows.select("key", "cls", F.min("cls").over(bucket).alias("low"), F.count(F.lit(1)).over(bucket).alias("n")).filter("n > 1")
    meetings = stored(meetings, "near-meetings")
    met = known.join(meetings.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("h").alias("h"))
    texts = docs.join(broadcast_if_small(stored(met, "near-met")), "h").groupBy("cls").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    close = None if radius is None else _print_links(known, radius)
    roots = components(_similar_links(meetings, stored(texts, "near-texts"), k, least, most, close))
    rows = stored(_rooted(prints.select("doc_id", "h", "cls"), roots), "near-roots")
    best = rows.filter("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "cls")).alias("best"))
    kept = F.col("doc_id").isNull() | (F.struct("doc_id", "cls") == F.col("best"))
    return rows.join(best, "root", "left").select("doc_id", "h", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


def similar_groups(docs: DataFrame, k: int = 5, least: float = 0.8, most: int = 16) -> DataFrame:
    """doc_id, component_id of every row: the smallest doc_id that links of a Jaccard similarity of `least` reach, on sets of k-word shingles.

    For texts that share much, but less than a 64-bit radius of 4 asks for: shingle sets of similarity 0.8 differ in
    some 15 % of SimHash bits, too far for balls to meet in without nearly every text meeting others by chance. Bands
    of MinHash values (BANDS) meet instead: 0.99994 of pairs at 0.8, more above it. What meets is only a candidate;
    every link is tested on the exact sets of hashed shingles. Texts of equal sets are one class from the start.
    """
    return _similar(docs, k, least, most).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, k: int = 5, least: float = 0.8, most: int = 16, radius: int = 4) -> DataFrame:
    """docs with one row of each group of near copies: that with its smallest doc_id. Every column stays, and so do rows without a doc_id.

    Near copies are texts whose SimHash fingerprints differ in at most `radius` bits, found by ball hashing as in
    near_groups and all linked; and, as texts of similarity 0.8 mostly lie further apart than that, those of
    similar_groups as well. Groups are what links of both kinds reach.
    """
    gone = stored(_similar(docs, k, least, most, radius).filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h")).distinct(), "near-copies")
    return docs.join(broadcast_if_small(gone), (F.col("doc_id") == F.col("__gone")) & (text_hash() == F.col("__h")), "left_anti")
