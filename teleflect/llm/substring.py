"""Repeated word spans by a compacted De Bruijn graph.

Edges are k-word windows, nodes the k-1 words that neighbouring windows share. An edge that starts in several documents
is labelled with its source: the place in the document with the smallest doc_id (then the smallest position) where it
starts. A node is nonbranching for a document when the edges before and after it have consecutive sources; paths of
such nodes compact into spans (document, start, source document, source start, length). Every word of a span is
covered by a window that starts in a document with a smaller doc_id.

Only edges that can repeat are gathered: each window belongs to its minimizer, the m-word stretch in it of the
smallest hash, and equal windows have equal minimizers. So rows are dealt by minimizer, about one for every five
windows, each with 40-bit hashes of its own windows (64 bits where a minimizer is heavy). Then every span is verified
against its source by a digest of the words themselves. Where hashes of different windows met, the smallest place of
them all stands as source, so each mistake shows as a span that fails. Only the windows of failed spans are gone over
again, with hashes of another kind, and verified again, until none fails.

A minimizer that holds a large share of all rows never meets in one task: a first pass finds those few by mergeable
counters, and their rows are spread evenly. So are, within a task, runs of over `most` rows. Windows of such minimizers
go through grouped minima with partial aggregation and a join of its own.

Null and blank texts have no words. A null doc_id is neither smaller nor larger than another: such rows stay whole and
are no source. Rows that repeat a doc_id are told apart by the hash of their text; equal rows share one fate. Other
columns are left out, whatever their names. An empty table gives an empty result. A very long text is one row of its
batch; words are arrays there, not objects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, partitions, stored, whole_runs
from .words import Block, blocks, windows

ROWS = "h long, salt int, doc_id long, tie long, pos int, wins binary"
#: Bytes of a window hash where its minimizer is not heavy.
SHORT = 5
#: Times that failed spans are matched anew, by other hashes each time; in the second all words have 64 bits, so a third is not to be expected.
ROUNDS = 6
MATCHES = "doc_id long, tie long, pos int, n int, src_doc long, src_tie long, src_pos int"


def _word_hashes(block: Block, seed: int) -> np.ndarray:
    """64-bit hashes of a block's words: prefix sums at first, a keyed digest of each distinct word in a later round."""
    h = block.hashes(block.starts, block.ends)
    if not seed:
        return h
    _, at, code = np.unique(np.stack([h, block.hashes(block.starts, block.ends, 1)]), axis=1, return_index=True, return_inverse=True)
    own = [int.from_bytes(hashlib.blake2b(block.word(i), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little") for i in at.tolist()]
    return np.array(own, np.uint64)[code.ravel()]


class _Edges:
    """Of a block of texts: minimizer, text and place (in words) of each run of windows under one minimizer; hash of every window (by seed); where each run's begin."""

    def __init__(self, texts: list[bytes], k: int, m: int, seed: int):
        block = Block(texts)
        first = block.first
        words = _word_hashes(block, 0)
        at, self.whole = windows(_word_hashes(block, seed) if seed else words, first, k)
        self.size = len(at)
        if not self.size:
            return
        stretch = windows(words, np.array([0, len(words)]), m)[1]
        least = at + np.lib.stride_tricks.sliding_window_view(stretch, k - m + 1)[at].argmin(axis=1)  # of each window
        starts = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.cuts = np.append(starts, len(at))
        self.h = stretch[least[starts]].view(np.int64)
        self.text = np.searchsorted(first, at[starts], side="right") - 1
        self.pos = (at[starts] - first[self.text]).astype(np.int32)


def _heavy(docs: DataFrame, k: int, m: int, most: int) -> np.ndarray:
    """Minimizers, sorted, of over 1 / (4 * shuffle partitions) of all rows, and perhaps some of nearly as many; none of under most / 10.

    Each task keeps twice that number of counters (a Misra-Gries summary, which merges by addition and misses no
    minimizer of that share), so neither tasks nor the driver hold more of them at any size of the table.
    """
    n = 8 * partitions(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, sizes, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in batches:
            for texts in blocks([(t or "").encode() for t in b["text"]]):
                edges = _Edges(texts, k, m, 0)
                if not edges.size:
                    continue
                total += len(edges.h)
                own, c = np.unique(edges.h, return_counts=True)
                keys, code = np.unique(np.concatenate([keys, own]), return_inverse=True)
                sizes = np.bincount(code, np.concatenate([sizes, c]), len(keys)).astype(np.int64)
                if len(keys) > n:
                    sizes -= np.partition(sizes, len(sizes) - n - 1)[len(sizes) - n - 1]
                    keys, sizes = keys[sizes > 0], sizes[sizes > 0]
        yield pd.DataFrame({"h": [*keys, 0], "n": [*sizes, total], "all": [False] * len(keys) + [True]})

    counts = docs.filter("doc_id is not null").select("text").mapInPandas(count, "h long, n long, all boolean").groupBy("all", "h").agg(F.sum("n").alias("n"))
    counts = stored(counts, "heavy")
    total = counts.filter("all").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return np.array(sorted(r["h"] for r in counts.filter(~F.col("all") & (F.col("n") > max(total / n, most / 10))).select("h").collect()), np.int64)  # n of them at most


def _minimizer_rows(docs: DataFrame, k: int, m: int, heavy: np.ndarray, seed: int = 0) -> DataFrame:
    """One row for each minimizer: its hash, where its first window starts (in words), 40-bit hashes of its windows. Heavy ones have 64-bit hashes and as salt any positive number, to spread their rows; others 0."""
    n = partitions(docs.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = 0
            for texts in blocks([(t or "").encode() for t in b["text"]]):
                ids, ties = b["doc_id"].to_numpy()[done : done + len(texts)], b["tie"].to_numpy()[done : done + len(texts)]
                done += len(texts)
                edges = _Edges(texts, k, m, seed)
                if not edges.size:
                    continue
                doc = ids[edges.text]
                salt = np.where(np.isin(edges.h, heavy), 1 + (doc * 31 + edges.pos) % n, 0).astype(np.int32)
                short, whole = np.ascontiguousarray(edges.whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SHORT :]).tobytes(), edges.whole.astype("<u8").tobytes() if salt.any() else b""
                wins = [whole[8 * x : 8 * y] if wide else short[SHORT * x : SHORT * y] for x, y, wide in zip(edges.cuts[:-1].tolist(), edges.cuts[1:].tolist(), salt.tolist(), strict=True)]
                yield pd.DataFrame({"h": edges.h, "salt": salt, "doc_id": doc, "tie": ties[edges.text], "pos": edges.pos, "wins": wins})

    return docs.filter("doc_id is not null").mapInPandas(each, ROWS)


def _spread(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its row, its place in the row, its hash of `width` bytes."""
    sizes = np.array([len(x) for x in rows["wins"]], np.int64) // width
    row = np.repeat(np.arange(len(rows)), sizes)
    whole = np.zeros((len(row), 8), np.uint8)
    whole[:, 8 - width :] = np.frombuffer(b"".join(rows["wins"]), np.uint8).reshape(-1, width)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), whole.view("<i8").ravel().astype(np.int64)


def _matches(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """MATCHES: stretches of n windows whose source is in a smaller document; and the rows of hot minimizers."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for all_rows, all_run, hot in whole_runs(batches, ["h", "salt"], most):
            hot |= all_rows["salt"].to_numpy() > 0
            if hot.any():
                out = all_rows[hot]
                yield pd.DataFrame({**{c: out[c] for c in ("h", "salt", "doc_id", "tie", "pos", "wins")}, "n": 0, "src_doc": 0, "src_tie": 0, "src_pos": 0})
            cool, run = all_rows[~hot], all_run[~hot]
            if not len(cool):
                continue
            doc = cool["doc_id"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
            keep = np.repeat(several, np.diff(np.append(starts, len(doc))))
            if not keep.any():
                continue
            cool, run, doc = cool[keep].reset_index(drop=True), run[keep], doc[keep]
            tie, start = cool["tie"].to_numpy(), cool["pos"].to_numpy()
            row, place, win = _spread(cool, SHORT)
            pos = start[row] + place
            order = np.lexsort((pos, tie[row], doc[row], win, run[row]))
            r, w = run[row][order], win[order]
            head = np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
            source = np.empty(len(order), np.int64)
            source[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]  # the first of its group
            yield from _stretches(doc[row], tie[row], pos, doc[row][source], tie[row][source], pos[source], row)

    n = partitions(rows.sparkSession)
    met = rows.repartition(n, "h", "salt").sortWithinPartitions("h", "salt").mapInPandas(scan, MATCHES + ", h long, salt int, wins binary")
    met = stored(met, "matches")
    return met.filter("n > 0").drop("h", "salt", "wins"), met.filter("n = 0").select("h", "salt", "doc_id", "tie", "pos", "wins")


def _stretches(doc, tie, pos, src_doc, src_tie, src_pos, row) -> Iterator[pd.DataFrame]:
    use = np.flatnonzero(src_doc < doc)
    if not len(use):
        return
    d, t, p, sd, st, sp, r = (x[use] for x in (doc, tie, pos, src_doc, src_tie, src_pos, row))
    new = np.ones(len(use), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (sd[1:] != sd[:-1]) | (st[1:] != st[:-1]) | (sp[1:] != sp[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(use)))
    yield pd.DataFrame({"doc_id": d[at], "tie": t[at], "pos": p[at].astype(np.int32), "n": n.astype(np.int32), "src_doc": sd[at], "src_tie": st[at], "src_pos": sp[at].astype(np.int32), "h": 0, "salt": np.int32(0), "wins": b""})


def _hot_matches(rows: DataFrame) -> DataFrame:
    """MATCHES of hot minimizers, window by window: partial minima, then a join on (minimizer, window)."""

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for width, own in ((SHORT, b[b["salt"] == 0]), (8, b[b["salt"] > 0])):
                row, place, win = _spread(own, width)
                yield pd.DataFrame({c: own[c].to_numpy()[row] for c in ("h", "doc_id", "tie")} | {"pos": (own["pos"].to_numpy()[row] + place).astype(np.int32), "win": win})

    one = rows.mapInPandas(single, "h long, doc_id long, tie long, pos int, win long")
    first = one.groupBy("h", "win").agg(F.min(F.struct("doc_id", "tie", "pos")).alias("s"), F.max("doc_id").alias("last")).filter("last > s.doc_id").drop("last")
    found = one.join(broadcast_if_small(stored(first, "hot-sources")), ["h", "win"]).filter("doc_id > s.doc_id")
    return found.select("doc_id", "tie", "pos", F.lit(1).alias("n"), F.col("s.doc_id").alias("src_doc"), F.col("s.tie").alias("src_tie"), F.col("s.pos").alias("src_pos"))


def _compact(matches: DataFrame) -> DataFrame:
    """Join stretches that go on where another ends, in the document and in the source: nonbranching paths."""
    w = Window.partitionBy("doc_id", "tie").orderBy("pos")
    last = F.lag(F.struct((F.col("pos") + F.col("n")).alias("pos"), "src_doc", "src_tie", (F.col("src_pos") + F.col("n")).alias("src_pos"))).over(w)
    step = matches.withColumn("new", F.when(last == F.struct("pos", "src_doc", "src_tie", "src_pos"), 0).otherwise(1))
    path = step.withColumn("path", F.sum("new").over(w))
    return path.groupBy("doc_id", "tie", "path").agg(F.min("pos").alias("pos"), F.sum("n").cast("int").alias("n"), F.first("src_doc").alias("src_doc"), F.first("src_tie").alias("src_tie"), F.min("src_pos").alias("src_pos")).drop("path")


def repeated_spans(docs: DataFrame, k: int = 13, m: int = 6, most: int = 200_000) -> DataFrame:
    """docs(doc_id, tie, text) -> MATCHES, n counted in windows: a span has n + k - 1 words. Not verified yet."""
    return stored(_compact(_found(_minimizer_rows(docs, k, m, _heavy(docs, k, m, most)), most)), "spans")


def _found(rows: DataFrame, most: int) -> DataFrame:
    matches, hot = _matches(rows, most)
    return matches.unionByName(_hot_matches(hot)) if hot.limit(1).count() else matches


def _mended(docs: DataFrame, spans: DataFrame, failed: DataFrame, k: int, m: int, most: int, seed: int) -> DataFrame:
    """spans, where the windows of failed ones are matched again by hashes of another kind among all rows of their minimizers."""
    key = ["doc_id", "tie", "pos"]
    failed = stored(spans.join(failed.select("src_doc", "src_tie", "src_pos", "n", *key), ["src_doc", "src_tie", "src_pos", "n", *key], "left_semi"), "failed")
    none = np.zeros(0, np.int64)
    bad = failed.select("doc_id", "tie", F.col("pos").alias("a"), (F.col("pos") + F.col("n")).alias("z"))
    theirs = docs.join(broadcast_if_small(stored(bad.select("doc_id", "tie").distinct(), "failed-documents")), ["doc_id", "tie"], "left_semi")
    own = _minimizer_rows(theirs, k, m, none).withColumn("end", F.col("pos") + F.floor(F.octet_length("wins") / SHORT))
    touched = stored(own.join(bad, ["doc_id", "tie"]).filter((F.col("pos") < F.col("z")) & (F.col("end") > F.col("a"))).select("h").distinct(), "failed-minimizers")
    again = _found(_minimizer_rows(docs, k, m, none, seed).join(broadcast_if_small(touched), "h", "left_semi"), most)
    lap = again.join(bad, ["doc_id", "tie"]).filter((F.col("pos") < F.col("z")) & (F.col("pos") + F.col("n") > F.col("a")))
    cut = F.greatest(F.col("a") - F.col("pos"), F.lit(0))
    lap = lap.select("doc_id", "tie", (F.col("pos") + cut).alias("pos"), (F.least(F.col("z"), F.col("pos") + F.col("n")) - F.col("pos") - cut).alias("n"), "src_doc", "src_tie", (F.col("src_pos") + cut).alias("src_pos"))
    return stored(_compact(spans.join(failed, spans.columns, "left_anti").unionByName(lap)), "spans")


RESULT = "doc_id long, tie long, pos int, n_words long, n_removed long, kept_sha256 string, kept_text string, src_doc long, src_tie long, src_pos int, n int, digest string, of_source boolean"


def remove_repeats(docs: DataFrame, k: int = 13, with_text: bool = True, most: int = 200_000, m: int = 6) -> DataFrame:
    """docs(doc_id, text) without the words of spans that a smaller document has: doc_id, n_words, n_removed, kept_sha256, kept_text.

    kept_text: the words that stay, joined by one space (null unless with_text).
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    twice = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count() > 0
    docs = docs.withColumn("tie", F.xxhash64("text") if twice else F.lit(0).cast("long"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda words: hashlib.sha256(b" ".join(words)).hexdigest()
        for b in batches:
            out = []
            for doc_id, tie, text, spans, asked in zip(b["doc_id"], b["tie"], b["text"], b["spans"], b["asked"], strict=True):
                words = (text or "").encode().split()
                kept = words
                if spans is not None and len(spans):
                    gone = np.zeros(len(words), bool)
                    for s in spans:
                        gone[s["pos"] : s["pos"] + s["n"] + k - 1] = True
                        out.append((doc_id, tie, s["pos"], None, None, None, None, s["src_doc"], s["src_tie"], s["src_pos"], s["n"], sha(words[s["pos"] : s["pos"] + s["n"] + k - 1]), False))
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                if asked is not None:
                    for s in asked:
                        out.append((None, None, None, None, None, None, None, s["src_doc"], s["src_tie"], s["src_pos"], s["n"], sha(words[s["src_pos"] : s["src_pos"] + s["n"] + k - 1]), True))
                whole = b" ".join(kept)
                out.append((None if pd.isna(doc_id) else int(doc_id), None, None, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode() if with_text else None, None, None, None, None, None, None))
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("doc_id", "tie", "pos", "n_words", "n_removed", "src_doc", "src_tie", "src_pos", "n")})

    spans = repeated_spans(docs, k, m, most)
    source = ("src_doc", "src_tie", "src_pos", "n")
    for seed in range(1, ROUNDS + 2):
        own = spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("pos", "n", "src_doc", "src_tie", "src_pos")).alias("spans"))
        asked = spans.select(*source).distinct().groupBy(F.col("src_doc").alias("doc_id"), F.col("src_tie").alias("tie")).agg(F.collect_list(F.struct(*source)).alias("asked"))
        out = stored(docs.join(own, ["doc_id", "tie"], "left").join(asked, ["doc_id", "tie"], "left").select("doc_id", "tie", "text", "spans", "asked").mapInPandas(apply, RESULT), "kept")
        ours, theirs = out.filter("not of_source"), out.filter("of_source").select(*source, F.col("digest").alias("known")).distinct()
        failed = ours.join(theirs, list(source), "left").filter("not digest <=> known")
        if not failed.limit(1).count():
            return out.filter("of_source is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
        if seed > ROUNDS:
            named = [(r["doc_id"], r["pos"]) for r in failed.select("doc_id", "pos").limit(20).collect()]
            raise RuntimeError(f"spans of different words still meet after {ROUNDS} hashes: {named}")
        spans = _mended(docs, spans, failed, k, m, most, seed)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 12)) AS t(i) WHERE len(ws) >= 13),
s AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT g.doc_id, list(DISTINCT i + o.j) AS gone FROM g JOIN s ON g.g = s.g AND s.least < g.doc_id, unnest(generate_series(0, 12)) AS o(j) GROUP BY g.doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN ws ELSE [ws[i] for i in generate_series(1, len(ws)) if NOT list_contains(gone, i)] END AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
