"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are runs of letters, lower case, tagged 0 (clean) or 1 (toxic). Only documents carry labels, so the training
tags come from them: a word that stands in far more different neighbourhoods in toxic documents than in clean ones (so
that copies of one text do not count again and again) is tagged 1 in toxic documents; all else is 0. The field has
hashed features of each word (itself, its first letters, its last letters) and weights between neighbouring tags. It is
fitted by gradient ascent on the likelihood of stretches of 24 words of a bounded sample; expected tags and pairs of
tags come from forward-backward.

Forward-backward gives each word's probability of tag 1. A document's evidence is the sum of those over one tenth; its
score is evidence / (evidence + c), with c set on the training sample so that a score of 0.3 parts the labels best.
Null and wordless texts have no evidence and score 0. Without labels of both kinds every score is 0. A document with
several labels is toxic if one says so; words of equal evidence are seeds alike, and of equally good cuts the lowest is
taken. Repeated rows score alike; very long texts are scored whole; an empty table gives an empty result; columns named
like a result are replaced, others carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .language import _GAPS, held_out, letters, lowered
from .words import Block, Lookup, blocks, worker_table

BUCKETS = 1 << 16
CUT = 0.3
#: Twice the log-likelihood ratio that makes a word a seed: 10 is a chance of about one in 600.
SURE = 10
#: Word starts and ends, with their lengths.
_PARTS = ((0, 0), (1, 4), (1, 5), (1, 6), (2, 3), (2, 4))


def features(words: list[str]) -> np.ndarray:
    """Buckets of each word's features: itself, first 4, 5, 6 and last 3, 4 letters (the word itself where it is shorter)."""
    out = np.empty((len(words), len(_PARTS)), np.int64)
    for i, w in enumerate(words):
        for j, (kind, n) in enumerate(_PARTS):
            part = w if not kind else w[:n] if kind == 1 else w[-n:]
            out[i, j] = hash_of(f"{kind}{n}{part}")
    return out


def hash_of(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 29) % BUCKETS


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    return marginals(emit, first, trans)[0]


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of tag 1 for each word, and of the four pairs of tags (00, 01, 10, 11) with the word before it (of a text's first word: nothing to use). emit: its score for tag 1 (tag 0: 0); words of text k: first[k]:first[k + 1]; trans: log weights (from, to).

    Odds instead of pairs of weights: forward r = E * (t01 + t11 r) / (t00 + t10 r), and likewise backward. All texts
    that are long enough take each step together.
    """
    (t00, t01), (t10, t11) = np.exp(trans)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    e = np.exp(np.clip(emit, -30, 30))
    r, s = np.empty(len(emit)), np.empty(len(emit))
    most = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(most), side="left")  # texts with over t words
    last_r = last_s = np.zeros(0)
    for t in range(most):
        n = active[t]
        at = start[:n] + t
        last_r = e[at] if t == 0 else e[at] * (t01 + t11 * last_r[:n]) / (t00 + t10 * last_r[:n])
        r[at] = last_r
    for t in range(most - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        new = np.ones(n)
        k = len(last_s)  # texts that go on after t
        w = e[at[:k] + 1] * last_s
        new[:k] = (t10 + t11 * w) / (t00 + t01 * w)
        s[at] = last_s = new
    odds = r * s
    before, w = np.roll(r, 1), e * s
    pair = np.stack([np.full(len(e), t00), t01 * w, before * t10, before * t11 * w])
    return odds / (1 + odds), pair / pair.sum(axis=0)


@dataclass
class Field:
    weights: np.ndarray  # of each bucket, for tag 1
    bias: float
    trans: np.ndarray
    c: float = 1.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def emit(self, words: list[str]) -> np.ndarray:
        return self.weights[features(words)].sum(axis=1) + self.bias

    @staticmethod
    def fit(sentences: list[list[str]], tags: list[list[int]], steps: int = 80, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Adaptive gradient ascent on the log-likelihood; one fixed start, no chance."""
        words = list(dict.fromkeys(w for s in sentences for w in s))
        code = {w: i for i, w in enumerate(words)}
        x = np.array([code[w] for s in sentences for w in s], np.int64)
        y = np.array([t for s in tags for t in s], float)
        first = np.cumsum([0, *map(len, sentences)])
        inner = np.ones(len(x), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        at = np.flatnonzero(inner)  # words with a word before them
        f = features(words)
        seen = np.array([[np.sum((y[at - 1] == a) & (y[at] == b)) for b in (0, 1)] for a in (0, 1)], float)
        w, bias, trans = np.zeros(BUCKETS), -3.0, np.zeros((2, 2))
        gw, gb, gt = np.full(BUCKETS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
        for _ in range(steps):
            emit = (w[f].sum(axis=1) + bias)[x]
            p, pair = marginals(emit, first, trans)
            by_word = np.bincount(x, y - p, len(words))
            d = np.bincount(f.ravel(), np.repeat(by_word, f.shape[1]), BUCKETS) - decay * len(x) * w
            db = float(np.sum(y - p))
            want = pair[:, at].sum(axis=1).reshape(2, 2)
            dt = seen - want - decay * len(x) * trans
            gw, gb, gt = gw + d * d, gb + db * db, gt + dt * dt
            w, bias, trans = w + rate * d / np.sqrt(gw), bias + rate * db / np.sqrt(gb), trans + rate * dt / np.sqrt(gt)
        return Field(w, bias, trans)


class _Tagger:
    """Marginals of the words of many texts; each distinct word's emission is computed once per worker."""

    def __init__(self, model: Field, most: int = 1_000_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.known, self.emit = Lookup(), np.zeros(0)

    def marginals(self, texts: list[bytes]) -> tuple[Block, np.ndarray]:
        b = Block(texts, _GAPS)
        if not len(b.starts):
            return b, np.zeros(0)
        keys, at, code_of = np.unique(b.hashes(b.starts, b.ends), return_index=True, return_inverse=True)
        codes = self.known.find(keys)
        if len(self.known) + np.sum(codes < 0) > self.most:
            self._clear()
            codes = self.known.find(keys)
        if len(new := np.flatnonzero(codes < 0)):
            codes[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.add(keys[new])
            self.emit = np.concatenate([self.emit, self.model.emit([letters(b.word(i)) for i in at[new].tolist()])])
        return b, forward_backward(self.emit[codes[code_of]], b.first, self.model.trans)


def _tagger(model: Field) -> _Tagger:
    return worker_table(("toxicity", model.key), lambda: _Tagger(model))


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(np.where(p > 0.1, p, 0.0))])
    return np.maximum(0, sums[first[1:]] - sums[first[:-1]])


def words_of(text: str | None) -> list[str]:
    t = lowered(text).encode()
    b = Block([t], _GAPS)
    return [letters(t[s:e]) for s, e in zip(b.starts.tolist(), b.ends.tolist(), strict=True)]


def _neighbourhoods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            words, near = words_of(text), {}
            for a, w, c in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
                near.setdefault(w, hash_of(f"{a} {c}"))
            out += [(w, toxic, n) for w, n in near.items() if w]
        yield pd.DataFrame(out, columns=["word", "toxic", "near"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2500, tokens: int = 400_000) -> Field | None:
    """From docs(doc_id, text) and labels(doc_id, toxic), rows that are not held out; None unless both labels occur.

    sample: documents of each label, about, chosen by a hash of doc_id; tokens: training words at most, half of them
    from stretches with a toxic word. Both are documented bounds; the driver holds the latter and a number for each of
    the former.
    """
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    if not sizes.get(0) or not sizes.get(1):
        return None
    chance = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / sizes[1]))).otherwise(F.lit(min(1.0, sample / sizes[0])))
    chosen = marked.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) < chance * (1 << 30))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the bound above: about 2 * sample rows
    # copies are one document
    rows = stored(rows.filter("text is not null").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")), "toxicity-sample")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None

    # which words: different neighbourhoods of each (its first place in a document) on either side
    near = rows.mapInPandas(_neighbourhoods, "word string, toxic int, near int").distinct()
    by_word = near.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    # far more often than by chance: a likelihood-ratio test of the two counts, and a large ratio
    both, q = F.col("bad") + F.col("good"), counts[1] / (counts[0] + counts[1])
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * share))).otherwise(0.0)
    unlikely = 2 * (part("bad", q) + part("good", 1 - q))
    odds = ((F.col("bad") + 0.5) / (counts[1] + 1)) / ((F.col("good") + 0.5) / (counts[0] + 1))
    seeds = {r["word"] for r in by_word.filter((odds >= 8) & (unlikely >= SURE)).select("word").collect()}  # words of the bounded sample

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                words = [w for w in words_of(text) if w]
                for at in range(0, len(words), 24):
                    own = words[at : at + 24]
                    tags = [int(toxic and w in seeds) for w in own]
                    out.append((" ".join(own), tags, any(tags)))
            yield pd.DataFrame(out, columns=["words", "tags", "seeded"])

    parts = stored(rows.mapInPandas(stretches, "words string, tags array<int>, seeded boolean"), "toxicity-stretches")
    most = max(1, tokens // 48)
    keep = [r for seeded in (True, False) for r in parts.filter(F.col("seeded") == seeded).orderBy(F.xxhash64("words"), "words").limit(most).collect()]
    model = Field.fit([r["words"].split(" ") for r in keep], [r["tags"] for r in keep])

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for block in blocks(lowered(t).encode() for t in b["text"]):
                own, p = _tagger(shared.value).marginals(block)
                done.append(evidence(p, own.first))
            yield pd.DataFrame({"ev": np.concatenate(done) if done else np.zeros(0), "toxic": b["toxic"]})

    seen = rows.mapInPandas(weigh, "ev double, toxic int").toPandas().sort_values(["ev", "toxic"], kind="stable")
    # the cut with the fewest errors, each label weighing the same; in the middle of the gap it stands in
    v, y = seen["ev"].to_numpy(), seen["toxic"].to_numpy()
    errors = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum()) + (np.sum(1 - y) - np.concatenate([[0], np.cumsum(1 - y)])) / max(1, np.sum(1 - y))
    edges = np.concatenate([[v[0] - 1e-3], v, [v[-1] + 1]])
    allowed = np.flatnonzero(edges[1:] > edges[:-1])
    k = allowed[np.argmin(errors[allowed])]
    cut = max(0.15, (max(0.0, edges[k]) + edges[k + 1]) / 2)
    model.c = cut * (1 - CUT) / CUT
    return model


SPANS = "score double, spans array<struct<start:int,end:int,p:double>>"


def score(docs: DataFrame, model: Field | None, with_spans: bool = True) -> DataFrame:
    """docs with its score and toxic spans (character offsets in text, largest marginal); columns of these names are replaced. Offsets count characters of the text as it stands: lowering keeps their number."""
    docs = docs.drop("score", "spans")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "spans": F.array().cast("array<struct<start:int,end:int,p:double>>")})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def tag(texts: pd.Series) -> pd.DataFrame:
        tagger, scores, spans = _tagger(shared.value), [], []
        for block in blocks((lowered(t).encode() for t in texts), 4_000_000):
            b, p = tagger.marginals(block)
            first = b.first
            e = evidence(p, first)
            scores.append(e / (e + shared.value.c))
            if not with_spans:
                spans += [[]] * len(block)
                continue
            own: list[list] = [[] for _ in block]
            hit = np.flatnonzero(p >= 0.5)
            text = np.searchsorted(first, hit, side="right") - 1
            chars = np.zeros(len(b.bytes) + 1 if len(hit) else 1, np.int32)  # code points before each byte
            if len(hit):
                np.cumsum((b.bytes & 0xC0) != 0x80, out=chars[1:])
            from_, to = (chars[x[hit]] - chars[b.texts_at[text]] for x in (b.starts, b.ends))
            for i, k, start, end in zip(hit.tolist(), text.tolist(), from_.tolist(), to.tolist(), strict=True):
                if own[k] and own[k][-1]["word"] == i - 1:
                    own[k][-1] |= {"end": end, "p": max(own[k][-1]["p"], float(p[i])), "word": i}
                else:
                    own[k].append({"start": start, "end": end, "p": float(p[i]), "word": i})
            spans += [[{c: s[c] for c in ("start", "end", "p")} for s in x] for x in own]
        return pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0), "spans": spans})

    return docs.withColumn("__tag", tag("text")).select(*docs.columns, "__tag.*")
