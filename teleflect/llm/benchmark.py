"""Benchmark decontamination by template canonicalisation.

A word becomes its lower-case letters without outer punctuation, or a typed placeholder: NUM for what is a number, UNIT
for a unit of measure, NAME for a capitalised word (wherever it stands, as a question may open with a name) that is no
common opening of a sentence. Windows of `k` canonical words of the benchmark are hash-joined with those of all
documents. A window needs `literal` words that are no placeholders, so that it says something. Windows that meet at the
same distance form an alignment of an item with a document; its slots must be consistent: one benchmark value always
stands for one document value of its type, and the other way round (ties: the value met first). Windows whose slots go
against the majority are dropped. An item is contaminated by an alignment that keeps `share` of its windows, or `run`
of them in a row. Items of under k words have no window: too little to tell a leak from chance.

Items of one canonical text are one class in the join; each different text of a class is then judged by its own values,
as values that contradict each other in one may fit in another. An alignment needs some number of an item's windows, so it
holds one of those left when the item's windows that most others share are set aside, one less than that number: only
the rest look for documents, and a line that many items open with does not set every item against every document with
it. Then the alignments of a document are gathered (their number is bounded by the benchmark and the text) and its
text is parsed once, in a worker.

Null and empty texts have no windows; very long ones are gone through as arrays. Repeated rows of a document, or of an
item, are one; several texts under one doc_id, or one item_id, are taken together. Rows without a doc_id have no row in `contaminated`,
but drop_contaminated judges them by their text. Items without an item_id are left out. Other columns stay out of the
join, whatever their names. An empty table on either side gives an empty result. What is broadcast is counted first.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, slices, stored
from .exact import text_hash
from .words import Block, Lookup, blocks, windows, worker_table

# Units of measure and money.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l dl gal s sec min mins h hr hrs hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent meters metres kilometers miles feet inches pounds kilograms grams liters litres minutes seconds".split())
NUMBER = re.compile(r"^[+-]?[$€£]?\d[\d.,:/]*(%|st|nd|rd|th)?$")
PLAIN, NUM, UNIT, NAME = 0, 1, 2, 3


# Words that open sentences in capitals without being names.
OPENERS = frozenset(
    "a an the this that these those there here it its he she they we you i his her hers their our your my who whom whose which what when where why how if then else while since until because although though after before during for from with without within"
    " of on in at to by as and or but nor so yet not no yes all any both each every either neither some many most more few several is are was were be been being do does did have has had can could will would shall should may might must let"
    " find solve calculate compute determine evaluate estimate show prove explain describe give given suppose assume consider write read choose select complete answer question name list compare use using".split()
)


def canonical(word: str) -> tuple[int, str]:
    """(kind, what stands in the template)."""
    bare = word.strip("\"'“”‘’«»()[]{}<>.,;:!?*_|#&$%~`…-")
    if NUMBER.match(word.strip("\"'“”‘’()[]{}<>,;!?*_|")) or bare.isdigit():
        return NUM, "\x00num"
    low = bare.lower()
    if low in UNITS:
        return UNIT, "\x00unit"
    if bare[:1].isupper() and not (bare.isupper() and len(bare) > 1) and low not in OPENERS:
        return NAME, "\x00name"
    return PLAIN, low


def template(text: str | None) -> list[tuple[int, str, str]]:
    """(kind, canonical word, bare word) of every word that is more than punctuation."""
    out = []
    for w in (text or "").encode().split():
        w = w.decode()
        kind, c = canonical(w)
        if c:
            out.append((kind, c, w.lower().strip("\"'“”‘’()[]{}<>.,;:!?*_|")))
    return out


class _Templates:
    """Canonical hashes of the words of many texts, each distinct word done once per worker."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known = Lookup()
        self.own, self.kinds = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Canonical hash and kind of each word that is more than punctuation, and the first such word of each text."""
        b = Block(texts)
        if not len(b.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(len(texts) + 1, np.int64)
        keys, at, code_of = np.unique(b.hashes(b.starts, b.ends), return_index=True, return_inverse=True)
        codes = self.known.find(keys)
        if len(self.known) + np.sum(codes < 0) > self.most:
            self._clear()
            codes = self.known.find(keys)
        if len(new := np.flatnonzero(codes < 0)):
            codes[new] = np.arange(len(self.known), len(self.known) + len(new))
            words = [canonical(b.word(i).decode()) for i in at[new].tolist()]
            self.known.add(keys[new])
            self.own = np.concatenate([self.own, self._hash([c for _, c in words])])
            self.kinds = np.concatenate([self.kinds, np.array([k for k, _ in words], np.int8)])
        c = codes[code_of]
        h, kinds = self.own[c], self.kinds[c]
        real = h != 0
        return h[real], kinds[real], np.concatenate([[0], np.cumsum(real)])[b.first]

    @staticmethod
    def _hash(words: list[str]) -> np.ndarray:
        data = [w.encode() for w in words]
        ends = np.cumsum([len(w) + 1 for w in data]) - 1 if data else np.zeros(0, np.int64)
        b = Block(data)
        h = b.hashes(ends - np.array([len(w) for w in data], np.int64), ends)
        return np.where(np.array([not w for w in data]), np.uint64(0), h)


def _windows(texts: list[str | None], k: int, literal: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts of a block, in order: the number of windows of each; places and hashes of all of them."""
    templates = worker_table("templates", _Templates)
    for block in blocks((t or "").encode() for t in texts):
        h, kinds, first = templates.hashes(block)
        at, w = windows(h, first, k)
        words = np.concatenate([[0], np.cumsum(kinds == PLAIN)])
        ok = words[at + k] - words[at] >= literal if len(at) else np.zeros(0, bool)
        at, w = at[ok], w[ok]
        sizes = np.diff(np.searchsorted(at, first))
        yield sizes, (at - np.repeat(first[:-1], sizes)).astype(np.int32), w.view(np.int64)


def _window_rows(rows: DataFrame, id_col: str, k: int, literal: int) -> DataFrame:
    """id, pos, h of every window of rows(id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, places, hashes = (np.concatenate(x) for x in zip(*_windows(b["text"].to_pylist(), k, literal), strict=True))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (places, hashes))], ["id", "places", "hashes"])

    lists = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(each, "id long, places array<int>, hashes array<long>")
    pair = F.explode(F.arrays_zip("places", "hashes")).alias("w")
    return lists.select("id", pair).select("id", F.col("w.places").alias("pos"), F.col("w.hashes").alias("h"))


def aligned(item: list, doc: list, shift: int, places: list[int], k: int) -> tuple[list[int], bool]:
    """Windows of an alignment (item place + shift = document place) whose slots are consistent, and whether a slot's value changed."""
    votes: dict[tuple, Counter] = defaultdict(Counter)
    back: dict[tuple, Counter] = defaultdict(Counter)
    covered = sorted({p + i for p in places for i in range(k)} & set(range(len(item))))
    for i in covered:
        if 0 <= i + shift < len(doc) and item[i][0] != PLAIN and item[i][0] == doc[i + shift][0]:
            votes[item[i][0], item[i][2]][doc[i + shift][2]] += 1
            back[item[i][0], doc[i + shift][2]][item[i][2]] += 1
    best = {key: c.most_common(1)[0][0] for key, c in votes.items()}
    other = {key: c.most_common(1)[0][0] for key, c in back.items()}

    def fits(i: int) -> bool:
        kind, _, value = item[i]
        if kind == PLAIN:
            return True
        d = doc[i + shift]
        return d[0] == kind and best.get((kind, value)) == d[2] and other.get((kind, d[2])) == value

    kept = [p for p in places if all(fits(i) for i in range(p, min(p + k, len(item))))]
    changed = any(key[1] != value for key, value in best.items())
    return kept, changed


RESULT = "doc_id long, item_id long, n_windows long, coverage double, reparameterised boolean"


#: Texts of a class that are judged in one row, about.
TEXTS_A_ROW = 16


def _item_classes(items: DataFrame, k: int, literal: int, share: float, run: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of items(item_id, text): item_id, id of its text; cls, part, variants (id, text) with every text of each class; and windows cls, at, h, seeks of each class. seeks: whether a window looks for documents by itself."""
    items = stored(items.withColumn("id", text_hash()), "benchmark-items")
    texts = items.select("id", "text").dropDuplicates(["id"])
    lists = stored(_window_rows(texts, "id", k, literal), "benchmark-windows")
    # a class: texts of equal windows at equal places, in parts of few texts; its name is the smallest hash of one
    marks = stored(lists.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("w")), "benchmark-marks")
    groups = marks.groupBy("w").agg(F.min("id").alias("cls"), F.ceil(F.count(F.lit(1)) / TEXTS_A_ROW).alias("parts"))
    classes = stored(marks.join(groups, "w").select("id", "cls", F.pmod("id", "parts").alias("part")), "benchmark-classes")
    members = stored(items.join(classes, "id").select("item_id", "id").distinct(), "benchmark-members")
    theirs = lists.join(classes.filter("id = cls"), "id").select("cls", F.col("pos").alias("at"), "h")
    often = theirs.groupBy("h").agg(F.countDistinct("cls").alias("often"))
    size = F.count(F.lit(1)).over(Window.partitionBy("cls"))
    need = F.least(F.ceil(size * share), F.lit(run))
    turn = F.row_number().over(Window.partitionBy("cls").orderBy("often", "at"))
    seeks = turn <= size - need + 1
    theirs = stored(theirs.join(often, "h").select("cls", "at", "h", seeks.alias("seeks")), "benchmark-seeks")
    variants = texts.join(classes, "id").groupBy("cls", "part").agg(F.collect_list(F.struct("id", "text")).alias("variants"))
    return members, stored(variants, "benchmark-texts"), theirs


def contaminated(docs: DataFrame, items: DataFrame, k: int = 8, literal: int = 4, share: float = 0.5, run: int = 6) -> DataFrame:
    """RESULT: one row for each document and benchmark item that it holds; docs(doc_id, text), items(item_id, text)."""
    return _found(docs.select(F.col("doc_id").cast("long"), "text"), items, k, literal, share, run)


def _found(docs: DataFrame, items: DataFrame, k: int, literal: int, share: float, run: int) -> DataFrame:
    items = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").distinct()
    members, variants, theirs = _item_classes(items, k, literal, share, run)
    ours = _window_rows(docs, "doc_id", k, literal)
    met = ours.join(broadcast_if_small(theirs.filter("seeks")), "h").select(F.col("id").alias("doc_id"), "cls", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    met = stored(met, "alignments")
    # of a document: each item it may hold once, with its shifts, so a row grows with the text even where one item is repeated all through it
    own = met.groupBy("doc_id", "cls").agg(F.collect_list("shift").alias("shifts")).join(broadcast_if_small(variants), "cls")
    own = own.groupBy("doc_id", "part").agg(F.collect_list(F.struct("shifts", "variants")).alias("met"))
    ids = broadcast_if_small(stored(met.select("doc_id").distinct(), "hit-documents"))
    texts = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[int, tuple] = {}

        def parse(variant: dict) -> tuple[list, list[int]]:
            if variant["id"] not in parsed:
                if len(parsed) > 2000:
                    parsed.clear()
                item = template(variant["text"])
                plain = np.concatenate([[0], np.cumsum([x[0] == PLAIN for x in item])])
                parsed[variant["id"]] = item, np.flatnonzero(plain[k:] - plain[:-k] >= literal).tolist()
            return parsed[variant["id"]]

        for b in batches:
            out = []
            for doc_id, text, found in zip(b["doc_id"], b["text"], b["met"], strict=True):
                doc = template(text)
                for r in found:
                    best: dict[int, tuple] = {}
                    canon, windows_of = parse(r["variants"][0])  # windows are the same in all texts of a class
                    for shift in r["shifts"].tolist():
                        places = [p for p in windows_of if 0 <= p + shift <= len(doc) - k and all(canon[p + i][1] == doc[p + shift + i][1] for i in range(k))]
                        for v in r["variants"] if places else ():
                            kept, changed = aligned(parse(v)[0], doc, shift, places, k)
                            if not kept:
                                continue
                            longest = max(map(len, np.split(kept, np.flatnonzero(np.diff(kept) != 1) + 1)))
                            # windows of too few literal words never meet: coverage is out of those that can
                            if len(kept) >= share * len(windows_of) or longest >= run:
                                best[v["id"]] = max(best.get(v["id"], (0, 0.0, False)), (len(kept), len(kept) / len(windows_of), changed))
                    out.extend((doc_id, i, *b) for i, b in best.items())
            yield pd.DataFrame(out, columns=["doc_id", "id", *[x.split()[0] for x in RESULT.split(", ")[2:]]])

    found = own.join(texts, "doc_id").select("doc_id", "text", "met").mapInPandas(check, RESULT.replace("item_id", "id"))
    best = F.max(F.struct("n_windows", "coverage", "reparameterised")).alias("b")
    found = found.join(broadcast_if_small(members), "id").groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "b.n_windows", "b.coverage", "b.reparameterised")


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 8, literal: int = 4, share: float = 0.5, run: int = 6) -> DataFrame:
    """docs without those that hold a benchmark item; every column stays. A row is judged by its text, so rows without a doc_id and texts that share one are told apart."""
    texts = docs.filter("text is not null").select(text_hash().alias("doc_id"), "text")
    gone = stored(_found(texts, items, k, literal, share, run).select(F.col("doc_id").alias("__gone")).distinct(), "contaminated")
    return docs.join(broadcast_if_small(gone), text_hash() == F.col("__gone"), "left_anti")
