"""Language ID by interpolated Kneser-Ney character models, one for each language.

A text is its runs of letters, lower case, each run a sequence of characters between a start and an end mark. A
model holds two sorted hash arrays: n-grams with their interpolated log-probability, contexts with the log of the
weight that they leave to shorter ones. The language with the lowest cross-entropy per character wins (ties: the
first in alphabetical order). A text is rejected if it has no letters, or if its cross-entropy under the winner lies
above anything that calibration texts of that language show, allowing for its length. One learnable document in five,
chosen by a hash, is kept from the counts and used for calibration alone (all of a language's, where it has none such).

Fitting reads at most about `sample` documents of each language, chosen by a hash of their doc_id: a documented bound,
so that the models stay a few MB at any size of the table. Word lists are counted by Spark and reduced to n-grams
before the driver sees them. Languages are few, as their models stand in every worker: over MOST_LANGUAGES fitting ends with
an error, none is left out. Null and letterless
texts are `und` with score 0; a table without labelled rows gives `und` everywhere; an empty one an empty result.
Repeated rows are predicted alike; of very long texts all words count; columns named like a result are replaced, others
carried.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored
from .words import Block, Lookup, blocks, class_of, mixed, worker_table

UNKNOWN = "und"
MOST_LANGUAGES = 500
START, END = "\x02", "\x03"
#: In a lower-cased text: all of ASCII but letters. At what else is no letter each distinct word is parted (`runs`).
_GAPS = class_of(bytes(c for c in range(128) if not chr(c).isalpha()))


def held_out(doc_id) -> F.Column:
    """The quarter of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lowered(text: str | None) -> str:
    """Lower case, with as many characters as before: those that would become several stay."""
    t = (text or "").lower()
    return t if len(t) == len(text or "") else "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])


def letters(word: bytes) -> str:
    return "".join(c for c in word.decode(errors="ignore") if c.isalpha())


def runs(word: bytes) -> list[str]:
    """Runs of letters, each with the marks that follow its letters; anything else parts them."""
    text = word.decode(errors="ignore")
    if text.isalpha():
        return [text]
    out, inside = [], False
    for c in text:
        if c.isalpha() or inside and unicodedata.category(c)[0] == "M":
            if not inside:
                out.append("")
            out[-1] += c
            inside = True
        else:
            inside = False
    return out


def gram_hashes(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of every predicted character (all but the start mark): hashes of its n-grams for n = 1..order, 0 where the word is too short; and its word."""
    text = "".join(START + w + END for w in words)
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, h = [], np.zeros(len(chars), np.uint64)
    for n in range(1, order + 1):
        back = np.roll(chars, n - 1)
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(1))
        out.append(np.where(place >= n - 1, h, np.uint64(0))[place > 0])
    return out, np.repeat(np.arange(len(words)), sizes)[place > 0]


def gram_hash(gram: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in reversed(gram):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(c) + 1))
    return int(h[0])


@dataclass
class KneserNey:
    """Sorted hash arrays of one language: n-grams -> log-probability, contexts -> log of the weight left."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    left: np.ndarray
    unseen: float

    @staticmethod
    def fit(counts: dict[str, int], order: int) -> KneserNey:
        """counts: how often each n-gram that ends a prediction occurs, n = order, or less from a start mark on."""
        levels: list[dict[str, float]] = [{} for _ in range(order + 1)]
        for gram, c in counts.items():
            levels[len(gram)][gram] = levels[len(gram)].get(gram, 0) + c
        for n in range(order, 1, -1):  # a shorter n-gram counts once for each character seen before it
            for gram in levels[n]:
                levels[n - 1][gram[1:]] = levels[n - 1].get(gram[1:], 0) + 1
        signs = len(levels[1]) + 1
        p: dict[str, float] = {}
        left: dict[str, float] = {}
        for n in range(1, order + 1):
            level = levels[n]
            ones, twos = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
            d = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
            total, kinds = Counter(), Counter()
            for gram, c in level.items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            for context in total:
                left[context] = d * kinds[context] / total[context]
            for gram, c in level.items():
                lower = p[gram[1:]] if n > 1 else 1 / signs
                p[gram] = max(c - d, 0) / total[gram[:-1]] + left[gram[:-1]] * lower
        pack = lambda x: (np.array([gram_hash(k) for k in x], np.uint64), np.log(np.array(list(x.values()))))
        (g, logp), (c, w) = pack(p), pack(left)
        i, j = np.argsort(g), np.argsort(c)
        return KneserNey(g[i], logp[i], c[j], w[j], math.log(1 / signs))

    def logs(self, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log-probability of every predicted character; hashes as from gram_hashes, contexts[n]: of the n characters before it."""
        out = np.zeros(len(hashes[0]))
        open_ = np.arange(len(out))
        for n in range(len(hashes), 0, -1):
            h = hashes[n - 1][open_]
            at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            seen = (self.grams[at] == h) & (h != 0)
            out[open_[seen]] += self.logp[at[seen]]
            open_ = open_[~seen]
            if not len(open_):
                return out
            c = contexts[n - 1][open_]
            at = np.minimum(np.searchsorted(self.contexts, c), len(self.contexts) - 1)
            out[open_] += np.where((self.contexts[at] == c) & (hashes[n - 1][open_] != 0), self.left[at], 0)
        out[open_] += self.unseen
        return out


@dataclass
class Identifier:
    """Models in alphabetical order of language; of each, mean cross-entropy, spread between texts, spread of a character, largest z seen."""

    order: int
    models: dict[str, KneserNey]
    usual: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[str]) -> np.ndarray:
        """Per word: sums of -log p for each language, then of the squares, then the number of predicted characters."""
        out = np.zeros((len(words), 2 * len(self.models) + 1))
        hashes, word = gram_hashes(words, self.order)
        text = [START + w + END for w in words]
        # the context of an n-gram is the (n-1)-gram that ends one character earlier
        ends = np.cumsum([len(t) - 1 for t in text])
        first = np.zeros(len(word), bool)
        first[np.append(0, ends[:-1]).astype(int)] = True
        contexts = [np.full(len(word), gram_hash(""), np.uint64)]
        start = np.uint64(gram_hash(START))
        for n in range(1, self.order):
            before = np.roll(hashes[n - 1], 1)
            contexts.append(np.where(first, start if n == 1 else np.uint64(0), before))
        for k, m in enumerate(self.models.values()):
            logs = -m.logs(hashes, contexts)
            out[:, k] = np.bincount(word, logs, len(words))
            out[:, len(self.models) + k] = np.bincount(word, logs * logs, len(words))
        out[:, -1] = np.bincount(word, minlength=len(words))
        return out


class _Scorer:
    """Sums over the words of a text; each distinct word is scored once per worker, in a table that restarts when full."""

    def __init__(self, identifier: Identifier, most: int = 200_000):
        self.identifier, self.most = identifier, most
        self._clear()

    def _clear(self) -> None:
        self.known, self.table = Lookup(), np.zeros((0, 2 * len(self.identifier.models) + 1))

    def sums(self, texts: list[bytes]) -> np.ndarray:
        b = Block(texts, _GAPS)
        if not len(b.starts):
            return np.zeros((len(texts), self.table.shape[1]))
        keys, at, code_of = np.unique(b.hashes(b.starts, b.ends), return_index=True, return_inverse=True)
        codes = self.known.find(keys)
        if len(self.known) + np.sum(codes < 0) > self.most:
            self._clear()
            codes = self.known.find(keys)
        if len(new := np.flatnonzero(codes < 0)):
            parts = [(k, w) for k, i in enumerate(at[new].tolist()) for w in runs(b.word(i))]
            rows = np.zeros((len(new), self.table.shape[1]))
            if parts:
                np.add.at(rows, [k for k, _ in parts], self.identifier.words([w for _, w in parts]))
            codes[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.add(keys[new])
            self.table = np.concatenate([self.table, rows])
        done = np.concatenate([np.zeros((1, self.table.shape[1])), np.cumsum(self.table[codes[code_of]], axis=0)])
        first = b.first
        return done[first[1:]] - done[first[:-1]]


def _sums(texts: pd.Series, identifier: Identifier) -> np.ndarray:
    scorer = worker_table(("language", identifier.key), lambda: _Scorer(identifier))
    parts = [scorer.sums(block) for block in blocks((t or "").lower().encode() for t in texts)]
    return np.concatenate(parts) if parts else np.zeros((0, 2 * len(identifier.models) + 1))


def fit(docs: DataFrame, sample: int = 2500, order: int = 4) -> Identifier | None:
    """From docs(doc_id, text, lang) whose rows are not held out; None without labelled rows."""
    spark = docs.sparkSession
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")), "languages")
    if not (kinds := sizes.count()):
        return None
    if kinds > MOST_LANGUAGES:
        raise ValueError(f"{kinds} languages are beyond what a worker holds models of ({MOST_LANGUAGES})")
    # some hundreds of documents beyond the bound at most: the choice is by hash, each for itself
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) < (F.lit(sample) / F.col("__n")) * (1 << 30)
    rows = rows.join(broadcast_if_small(sizes), "lang").filter(chosen)
    rows = rows.select("text", "lang", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(5)) == 0).alias("aside"))
    learned = rows.groupBy("lang").agg(F.bool_and("aside").alias("only_aside"))
    rows = stored(rows.join(F.broadcast(learned), "lang").select("text", "lang", (F.col("aside") & ~F.col("only_aside")).alias("aside")), "language-sample")  # one row a language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                block = text.lower().encode()
                words.setdefault(lang, Counter()).update(block.translate(_TO_SPACE).split())
        for lang, own in words.items():
            grams: Counter = Counter()
            for w, n in own.items():
                for run in runs(w):
                    t = START + run + END
                    for i in range(1, len(t)):
                        grams[t[max(0, i - order + 1) : i + 1]] += n
            if grams:
                yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})

    counts: dict[str, dict[str, int]] = {}
    for r in rows.filter("not aside").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts.setdefault(r.lang, {})[r.gram] = r.n
    if not counts:
        return None  # no learnable text has letters
    identifier = Identifier(order, {lang: KneserNey.fit(counts[lang], order) for lang in sorted(counts)})
    langs = list(identifier.models)
    shared = spark.sparkContext.broadcast(identifier)

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = _sums(b["text"], shared.value)
            own = b["lang"].map(langs.index).to_numpy(int)
            i = np.arange(len(b))
            yield pd.DataFrame({"lang": b["lang"], "aside": b["aside"], "s": sums[i, own], "q": sums[i, len(langs) + own], "n": sums[:, -1]})

    known = rows.filter(F.col("lang").isin(langs))
    seen = known.mapInPandas(calibrate, "lang string, aside boolean, s double, q double, n double").filter("n > 0").toPandas()
    for lang, g in seen.groupby("lang"):
        g = g[g["aside"]] if g["aside"].any() else g
        mean = g["s"].sum() / g["n"].sum()
        char = max(1e-6, g["q"].sum() / g["n"].sum() - mean**2)
        off = g["s"] / g["n"] - mean
        between = max(1e-6, float(np.median(off[g["n"] >= g["n"].median()] ** 2)))
        identifier.usual[lang] = (mean, between, char, float((off / np.sqrt(between + char / g["n"])).max()))
    return identifier


_TO_SPACE = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))
RESULT = "lang_pred string, score double, rejected boolean, cross_entropy double"


def identify(docs: DataFrame, identifier: Identifier | None, slack: float = 1.5) -> DataFrame:
    """docs with RESULT (columns of these names are replaced).

    rejected: no letters, or a cross-entropy over `slack` times the largest deviation that calibration saw and at least
    half the way from the language's usual one to that of letters drawn blindly. So a clean text with some foreign
    lines, tables or capitals stays.
    """
    docs = docs.drop("lang_pred", "score", "rejected", "cross_entropy")
    if identifier is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True), "cross_entropy": F.lit(None).cast("double")})
    langs = np.array(list(identifier.models))
    usual = np.array([identifier.usual[x] for x in langs])
    blind = np.array([-m.unseen for m in identifier.models.values()])
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        sums = _sums(texts, shared.value)
        n = sums[:, -1]
        entropy = sums[:, : len(langs)] / np.maximum(n, 1)[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(n)), best]
        # evidence adds up slower than characters do, as they depend on each other
        odds = np.exp(-np.minimum(500, (entropy - least[:, None]) * np.sqrt(n)[:, None] * 4)).sum(axis=1)
        mean, between, char, most = usual[best].T
        z = (least - mean) / np.sqrt(between + char / np.maximum(n, 1))
        none = n == 0
        return pd.DataFrame({"lang_pred": np.where(none, UNKNOWN, langs[best]), "score": np.where(none, 0.0, 1 / odds), "rejected": none | (z > slack * np.maximum(most, 3)) & (least > (mean + blind[best]) / 2), "cross_entropy": np.where(none, np.nan, least)})

    return docs.withColumn("__id", predict("text")).select(*docs.columns, "__id.*")
