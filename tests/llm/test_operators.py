"""The corpus operators against brute force, round trips and odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from teleflect.llm import benchmark, components, exact, language, licenses, packing, records, simhash, substring, toxicity, warc
from teleflect.llm.queries import word_bpe
from teleflect.llm.tokens import encoder
from teleflect.llm.words import Block, windows

DOCS = "doc_id long, text string, lang string, n long, h string, block int, score double, keep_id long, key string, item long"
WORDS = "the of and river stone light under green house walks slowly over many hills with old friends who sing".split()


def docs(spark, texts, langs=None):
    """Rows with extra columns whose names the operators use themselves."""
    rows = [(i, t, (langs or {}).get(i, "en"), 5, "x", 1, 0.5, 7, "k", 9) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    return spark.createDataFrame(rows, DOCS)


def text(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice("abcdef") + rnd.choice("ghijkl") for _ in range(n))


ODD = {0: None, 1: "", 2: " \n\t", 3: "One", 4: "one two", 5: text(1), 6: text(1), 7: text(2), 8: "é Ünï ß", 9: text(3, 6000)}


# ---- words and tokens


def test_block_words_and_windows():
    texts = [b"a b  c", b"", b"\n x", b"a b c"]
    b = Block(texts)
    assert [b.word(i) for i in range(len(b.starts))] == [b"a", b"b", b"c", b"x", b"a", b"b", b"c"]
    assert b.first.tolist() == [0, 3, 3, 4, 7]
    h = b.hashes(b.starts, b.ends)
    assert h[0] == h[4] and h[0] != h[1]
    at, w = windows(h, b.first, 2)
    assert at.tolist() == [0, 1, 4, 5] and w[0] == w[2] and w[1] == w[3] and w[0] != w[1]


def test_word_encoder_is_the_tokenizer():
    e = encoder(word_bpe())
    rnd = random.Random(4)
    pieces = ["don't", "'S", "x.", "É", "H̱", "<|endoftext|>", "A,b", "１2", "...", "word!", "Ünï", "K", "ς", "\x1c", " ", " ", "\n", "it's,", "%%%", "a%%%"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want
    e.most = 50
    assert [x.tolist() for x in e.encode(texts)] == want
    e.most = 800_000


# ---- op1


def test_warc_round_trip_and_index(spark):
    big = "<p>" + "ä" * 600 + "</p>"
    pages = [(1, "http://www.B.example.com/x?y#z", big), (2, "https://a.example.com/", big), (3, None, None), (4, "http://a.example.com/", "short"), (5, "http://a.example.com/", "short"), (6, "", big + "!"), (6, "", big + "!")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, path string")
    top = warc.write_index(warc.write_archives(df), block=2)
    got = {r["page_id"]: r for r in warc.read_captures(df, top).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert (got[1]["record_type"], got[1]["refers_to"], bytes(got[1]["payload"])) == ("revisit", 2, b"")
    assert got[2]["record_type"] == "response" and bytes(got[2]["payload"]).decode() == big
    assert got[4]["record_type"] == got[5]["record_type"] == "response"
    assert warc.Index(top).find("com,example,zzz)/", 1) == [] and len(warc.Index(top).find(")", 6)) == 2
    keys = spark.createDataFrame([(p[1],) for p in pages[:2]], "u string").select(warc.url_key(F.col("u")).alias("k")).collect()
    assert [r["k"] for r in keys] == ["com,example,b)/x?y", "com,example,a)/"]


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_captures(df, warc.write_index(warc.write_archives(df))).count() == 0


# ---- op2


LANGS = {"aa": "bal dor mik tan sul per".split(), "bb": "xyo qwi zzu vyx kwo uyi".split()}


def lang_docs(spark, n=80):
    rnd, rows = random.Random(8), {}
    langs = {}
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        rows[i] = " ".join("".join(rnd.choice(LANGS[lang]) for _ in range(2)) for _ in range(rnd.randint(3, 50)))
        langs[i] = lang
    rows |= {n: None, n + 1: "", n + 2: "123 !!", n + 3: "balDOR, mik!"}
    langs |= {n: None, n + 1: "aa", n + 2: "bb", n + 3: None}
    return docs(spark, rows, langs), langs


def test_language_id(spark):
    df, langs = lang_docs(spark)
    out = {r["doc_id"]: r for r in language.identify(df, language.fit(df)).collect()}
    assert all(out[i]["lang_pred"] == langs[i] and not out[i]["rejected"] and 0 <= out[i]["score"] <= 1 for i in range(80))
    assert [out[i]["lang_pred"] for i in (80, 81, 82, 83)] == ["und", "und", "und", "aa"]
    assert all(out[i]["rejected"] and out[i]["score"] == 0 for i in (80, 81, 82))


def test_kneser_ney_is_a_distribution():
    counts = {}
    for w in ("abab", "abba", "bab"):
        t = language.START + w + language.END
        for i in range(1, len(t)):
            g = t[max(0, i - 2) : i + 1]
            counts[g] = counts.get(g, 0) + 1
    ident = language.Identifier(3, {"x": language.KneserNey.fit(counts, 3)})
    m = ident.models["x"]
    # all words of up to 9 letters over the alphabet (and the share of unseen letters) carry at most all the weight
    total, words = 0.0, [""]
    for _ in range(9):
        total += np.exp(-ident.words([w for w in words if w])[:, 0]).sum() if any(words) else 0
        words = [w + c for w in words for c in "ab"]
    assert 0.2 < total <= 1.0 + 1e-9 and len(m.grams) == len(m.logp)


def plain_kneser_ney(counts, order):
    """p(character | up to order - 1 before it), straight from the definition."""
    levels = {n: {} for n in range(1, order + 1)}
    for g, c in counts.items():
        levels[len(g)][g] = levels[len(g)].get(g, 0) + c
    for n in range(order, 1, -1):
        for g in list(levels[n]):
            levels[n - 1][g[1:]] = levels[n - 1].get(g[1:], 0) + 1
    d = {}
    for n, level in levels.items():
        ones, twos = (sum(c == x for c in level.values()) for x in (1, 2))
        d[n] = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))

    def p(gram, n):
        if n == 0:
            return 1 / (len(levels[1]) + 1)
        context = gram[-n:-1]
        if len(gram) < n or (n > 1 and len(context) < n - 1):
            return p(gram, n - 1)
        own = {g: c for g, c in levels[n].items() if g[:-1] == context}
        if not own:
            return p(gram, n - 1)
        total = sum(own.values())
        return max(own.get(gram[-n:], 0) - d[n], 0) / total + d[n] * len(own) / total * p(gram, n - 1)

    return lambda gram: p(gram, min(order, len(gram)))


def test_language_scores_are_the_definition():
    rnd, order, models, plain = random.Random(5), 3, {}, {}
    for lang, parts in LANGS.items():
        counts = {}
        for _ in range(60):
            t = language.START + "".join(rnd.choice(parts) for _ in range(2)) + language.END
            for i in range(1, len(t)):
                g = t[max(0, i - order + 1) : i + 1]
                counts[g] = counts.get(g, 0) + 1
        models[lang], plain[lang] = language.KneserNey.fit(counts, order), plain_kneser_ney(counts, order)
    words = ["baldor", "xyoqwi", "balqwi", "perz", "b", "zzzz", "éà"]
    got = language.Identifier(order, models).words(words)
    for i, w in enumerate(words):
        t = language.START + w + language.END
        for j, lang in enumerate(models):
            want = -sum(np.log(plain[lang](t[max(0, c - order + 1) : c + 1])) for c in range(1, len(t)))
            assert got[i, j] == pytest.approx(want, rel=1e-9), (w, lang)


def test_language_rejects_strange_texts(spark):
    df, _ = lang_docs(spark, 400)
    identifier = language.fit(df)
    rnd = random.Random(3)
    odd = {i: " ".join("".join(rnd.choice("ßøłđþæĸŋħ") for _ in range(7)) for _ in range(40)) for i in range(3)}
    clean = {10 + i: " ".join("".join(rnd.choice(LANGS["aa"]) for _ in range(2)) for _ in range(40)) for i in range(20)} | {40: "BALDOR 12 mikTAN | 3.5 | sulper, dor"}
    out = {r["doc_id"]: r["rejected"] for r in language.identify(docs(spark, odd | clean), identifier).collect()}
    assert all(out[i] == (i < 3) for i in out)


def test_language_of_long_repeated_and_lowered_texts(spark):
    assert [language.lowered(t) for t in ("ABC", "İX", None, "ΑΣ")] == ["abc", "İx", "", "ας"]
    df, _ = lang_docs(spark)
    long = "baldor mikper " * 40_000
    out = language.identify(docs(spark, [(1, long), (2, "xyoqwi"), (2, "xyoqwi"), (None, "xyoqwi")]), language.fit(df)).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in out) == [("1", "aa"), ("2", "bb"), ("2", "bb"), ("None", "bb")]


def test_runs_of_letters():
    runs = lambda t: language.runs(t.encode())
    assert runs("night—day") == ["night", "day"] and runs("你好。世界") == ["你好", "世界"] and runs("हिन्दी") == ["हिन्दी"]
    assert runs("été") == ["été"] and runs("\u0301a\u0301\u00a0") == ["a\u0301"] and runs("\u20ac\u0301") == [] == runs("")


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs(spark, {i: text(i) for i in range(20)}, {i: "ab"[i % 2] for i in range(20)}))


def test_language_without_labels(spark):
    df = docs(spark, ODD, dict.fromkeys(ODD))
    assert {r["lang_pred"] for r in language.identify(df, language.fit(df)).collect()} == {"und"}
    empty = df.filter("false")
    assert language.identify(empty, language.fit(empty)).count() == 0


# ---- op3


@pytest.mark.parametrize("shuffled", [None, 5])
def test_records_round_trip(spark, shuffled):
    df = docs(spark, ODD)
    got = {r["doc_id"]: r for r in records.read_records(records.write_records(df, word_bpe(), 2), shuffled).collect()}
    start, e = 0, encoder(word_bpe()).tokenizer
    for i in sorted(ODD):
        ids = np.array([*e.encode(ODD[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert bytes(got[i]["ids"]) == ids.tobytes() and got[i]["start"] == start
        start += len(ids)


def test_records_detect_damage_and_null_ids(spark):
    r = records.frame(b"payload")
    assert records.payload_of(r) == b"payload"
    for i in range(len(r)):
        with pytest.raises(ValueError):
            records.payload_of(r[:i] + bytes([r[i] ^ 1]) + r[i + 1 :])
    df = docs(spark, [(None, "a"), (3, "b"), (3, "b"), (1, "c")])
    rows = records.read_records(records.write_records(df, word_bpe(), 2)).orderBy("start").collect()
    assert [x["doc_id"] for x in rows] == [None, 1, 3, 3]
    assert records.read_records(records.write_records(df.filter("false"), word_bpe(), 2)).count() == 0


def test_record_width_follows_the_vocabulary(spark):
    assert records.width_for(word_bpe(), 2) == 2 and records.width_for(word_bpe(), 70_000) == 4
    with pytest.raises(ValueError):
        records.packed(1, np.array([1, 70_000]), 2)
    out = records.read_records(records.write_records(docs(spark, {1: "a b", 2: None}), word_bpe(), 70_000)).orderBy("doc_id").collect()
    assert [np.frombuffer(r["ids"], "<u4")[-1] for r in out] == [70_000, 70_000] and out[1]["start"] == len(out[0]["ids"]) // 4


# ---- op4


def brute_components(fps, radius):
    ids, parent = list(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def reference_fingerprint(t):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()]
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < 4 else [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("options", [{}, {"blocks": 1}, {"most": 2}])
def test_simhash_components(spark, options):
    rows = dict(ODD)
    for i in range(10, 40):
        w = text(i % 5, 300).split()
        w[i * 7 % 300] = f"changed{i}"
        rows[i] = " ".join(w)
    got = {r["doc_id"]: r for r in simhash.near_groups(docs(spark, rows), **options).collect()}
    fps = {i: reference_fingerprint(t) for i, t in rows.items()}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps, 4)


def test_simhash_hot_values_keep_components(spark):
    """Hundreds of fingerprints around one: with `most` this small nearly every value is hot."""
    rnd, fps = random.Random(2), [0]
    for _ in range(150):
        f = rnd.choice(fps)
        for _ in range(rnd.randint(1, 5)):
            f ^= 1 << rnd.randrange(64)
        fps.append(f)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components({f: f & (1 << 64) - 1 for f in fps}, 4)
    for options in ({"most": 4}, {"most": 512}, {"blocks": 1}):
        root = {r["node"]: r["root"] for r in components.components(simhash.links(df, **options)).collect()}
        groups = lambda m: {frozenset(x for x in fps if m.get(x, x) == m.get(f, f)) for f in fps}
        assert groups(root) == groups(want)


def test_simhash_of_empty_tables(spark):
    assert simhash.near_groups(docs(spark, {})).count() == 0 == simhash.similar_groups(docs(spark, {})).count() == simhash.drop_near_copies(docs(spark, {})).count()


def test_components_of_a_chain(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | dict.fromkeys((100, 101, 103), 100) or {k: v for k, v in got.items() if k != v} == {i: 0 for i in range(1, 61)} | {101: 100, 103: 100}


def test_near_copies_of_five_word_shingles(spark):
    rows = {0: text(1, 300), 1: " ".join([*text(1, 300).split()[:150], "new", *text(1, 300).split()[151:]]), 2: text(7, 300), 3: None, 4: ""}
    for most in (512, 1):
        kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows), most=most).collect())
        assert kept == [0, 2, 3]
    assert simhash.drop_near_copies(docs(spark, [(None, "a b"), (None, "a b")])).count() == 2


def near_brute(rows, k=5, least=0.8):
    """component of each document: the smallest that links of true Jaccard similarity reach."""
    sets = {}
    for i, t in rows.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
    root = {i: i for i in rows}
    for a in rows:
        for b in rows:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


def swapped(t, places, word):
    w = t.split()
    for p in places:
        w[p] = f"{word}{p}"
    return " ".join(w)


def test_near_copies_by_true_similarity(spark):
    """Pairs from 0.98 down to 0.5: those of 0.8 or more are one group, others stay."""
    rows = {}
    for n in range(1, 16):
        for s in range(4):
            t = rows[10 * n + 2 * s] = text(100 * n + s, 300)
            rows[10 * n + 2 * s + 1] = swapped(t, range(5, 5 + 16 * n, 16), "new")
    want = near_brute(rows)
    assert 15 < sum(i != r for i, r in want.items()) < 45
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs(spark, rows)).collect()} == want


def test_near_copies_in_hot_buckets(spark):
    """Texts of one template at 0.6 to 0.8 share buckets; pairs of near copies far behind a bucket's first rows are found."""
    base, rows = text(900, 400), {}
    for g in range(30):
        t = swapped(base, range(g % 16, 400, 26), f"g{g}x")
        rows[g], rows[100 + g] = t, swapped(t, (200 + g,), "copy")
    want = near_brute(rows)
    assert len(set(want.values())) > 10
    for most in (1, 4, 512):
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs(spark, rows), most=most).collect()} == want


@pytest.mark.parametrize("size", [0, 1, 40, 500, 5000])
def test_sketches_differ_in_no_more_bits_than_sets(size):
    rng = np.random.default_rng(size)
    for apart in (0, 1, 7, 60, 3000):
        shared, mine, other = (rng.integers(1 << 64, size=n, dtype=np.uint64) for n in (size, apart, apart // 2))
        x, y = simhash.sketch(np.concatenate([shared, mine])), simhash.sketch(np.concatenate([shared, other]))
        differ = int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum())
        assert len(x) == simhash.SKETCH // 64 and 0.8 * min(20, apart + apart // 2) <= differ <= apart + apart // 2


def test_set_similarity_join_misses_no_pair(spark):
    """Prefix, length and positional filters keep every pair of different roots at 0.8 or more, and drop most others; sets of one shingle and of equal sizes too."""
    rnd, base, rows = random.Random(6), text(901, 120), {}
    for c in range(60):
        t = swapped(base, rnd.sample(range(120), rnd.randint(1, 6)), rnd.choice("uvw"))
        rows[c] = " ".join(t.split()[: rnd.choice([120, 120, 110, 90])])
    rows |= {60: "one", 61: "a b c d e", 62: "a b c d e f"}
    for c in range(63, 75):  # just under 0.8 with each other, 7 places of their own in each
        rows[c] = swapped(base, range(c % 12, 120, 17), f"own{c}")
    texts = spark.createDataFrame(list(rows.items()), "cls long, text string").cache()
    sets = {c: set(x.tolist()) for c, x in zip(rows, simhash.shingle_sets(rows.values()), strict=True)}
    for root in ({c: c for c in rows}, {c: 0 if c < 40 else c for c in rows}, {c: c % 3 for c in rows}):
        got = {(r["a"], r["b"]) for r in simhash._unlinked(spark.createDataFrame(list(root.items()), "cls long, root long"), texts, 5, 0.8).collect()}
        every = {(a, b) for a in rows for b in rows if a < b and root[a] != root[b]}
        near = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        assert near and near <= got <= every
        assert not {(a, b) for a, b in got if a >= 63}
    texts.unpersist()


# ---- op5


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(1)
    first, trans = np.array([0, 3, 3, 4, 9]), rnd.normal(size=(2, 2))
    emit = rnd.normal(size=9) * 2
    p = toxicity.forward_backward(emit, first, trans)
    for a, z in zip(first[:-1], first[1:], strict=True):
        n = z - a
        total, ones = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(emit[a + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            ones += w * np.array(y)
        assert n == 0 or np.allclose(p[a:z], ones / total)


def test_pair_marginals_and_gradient_are_exact():
    rnd = np.random.default_rng(2)
    first, trans, emit = np.array([0, 4, 5, 8]), rnd.normal(size=(2, 2)), rnd.normal(size=8)
    _, pair = toxicity.marginals(emit, first, trans)
    for a, z in zip(first[:-1], first[1:], strict=True):
        n, total, want = z - a, 0.0, np.zeros((z - a, 4))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(emit[a + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            for i in range(1, n):
                want[i, 2 * y[i - 1] + y[i]] += w
        for i in range(1, n):
            assert np.allclose(pair[:, a + i], want[i] / total)

    def log_likelihood(trans, tags):
        out = 0.0
        for a, z in zip(first[:-1], first[1:], strict=True):
            n = z - a
            weight = lambda y: sum(emit[a + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
            out += weight(tags[a:z]) - np.log(sum(np.exp(weight([c >> i & 1 for i in range(n)])) for c in range(1 << n)))
        return out

    tags = [1, 0, 0, 1, 1, 0, 1, 1]
    inner = [1, 2, 3, 6, 7]
    want = pair[:, inner].sum(axis=1).reshape(2, 2)
    for a in (0, 1):
        for b in (0, 1):
            up, down = trans.copy(), trans.copy()
            up[a, b] += 1e-5
            down[a, b] -= 1e-5
            seen = sum(tags[i - 1] == a and tags[i] == b for i in inner)
            assert (log_likelihood(up, tags) - log_likelihood(down, tags)) / 2e-5 == pytest.approx(seen - want[a, b], abs=1e-5)


def toxic_corpus(copies=0):
    rnd, rows, labels = random.Random(6), {}, []
    for i in range(160):
        w = text(i, 30).split()
        if i % 4 == 0:
            for j in rnd.sample(range(30), 3):
                w[j] = rnd.choice(["vileword", "nastyword", "Foulword"])
        rows[i], _ = " ".join(w), labels.append((i, int(i % 4 == 0)))
    for i in range(1000, 1000 + copies):
        rows[i], _ = rows[0], labels.append((i, 1))
    return rows, labels


def test_toxic_words_in_a_crowd_of_copies(spark):
    """Most toxic documents are copies of one: its words count once, the others stay seeds."""
    rows, labels = toxic_corpus(400)
    df = docs(spark, rows)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r["doc_id"]: r["score"] >= toxicity.CUT for r in toxicity.score(df, model, with_spans=False).collect()}
    assert all(out[i] == (i % 4 == 0 or i >= 1000) for i in out)


def test_toxic_offsets_are_of_the_text_as_it_stands(spark):
    rows, labels = toxic_corpus()
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = {1: "İİİ and vileword here", 2: "ẞé NASTYWORD, ǅ", 3: None}
    out = {r["doc_id"]: r["spans"] for r in toxicity.score(docs(spark, odd), model).collect()}
    assert [[odd[i][s["start"] : s["end"]] for s in out[i]] for i in (1, 2)] == [["vileword"], ["NASTYWORD"]] and out[3] == []
    empty = docs(spark, {})
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, spark.createDataFrame(labels, "doc_id long, toxic int")) is None


def test_toxic_scores_are_the_definition(spark):
    """Scores and spans of whole texts against a forward-backward pass in log space, word by word."""
    rows, labels = toxic_corpus()
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = {i: rows[i] for i in range(0, 40)} | {300: "Vileword", 301: "", 302: None, 303: "1 2 ! ?", 304: f"É {rows[4]} — nastyword\n\nfoulword foulword", 305: text(8, 700)}

    def plain(t):
        words = [(m, w) for m in re.finditer(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "") for w in [m.group().lower()]]
        if not words:
            return 0.0, []
        e = [0.0 if not w else float(np.clip(model.emit(["".join(c for c in w if c.isalpha())])[0], -30, 30)) for _, w in words]
        n, t_ = len(e), model.trans
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = [0.0, e[0]]
        for i in range(1, n):
            f[i] = [np.logaddexp(f[i - 1, 0] + t_[0, y], f[i - 1, 1] + t_[1, y]) + y * e[i] for y in (0, 1)]
        for i in range(n - 2, -1, -1):
            b[i] = [np.logaddexp(t_[y, 0] + b[i + 1, 0], t_[y, 1] + e[i + 1] + b[i + 1, 1]) for y in (0, 1)]
        g = f + b
        p = 1 / (1 + np.exp(g[:, 0] - g[:, 1]))
        ev = sum(x for x in p if x > 0.1)
        spans = []
        for i, (m, _) in enumerate(words):
            if p[i] >= 0.5:
                if spans and spans[-1][2] == i - 1:
                    spans[-1] = [spans[-1][0], m.end(), i]
                else:
                    spans.append([m.start(), m.end(), i])
        return ev / (ev + model.c), [(a, z) for a, z, _ in spans]

    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, texts), model).collect()}
    for i, t in texts.items():
        want, spans = plain(t)
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and [(s["start"], s["end"]) for s in got[i]["spans"]] == spans
    assert sum(len(r["spans"]) > 0 for r in got.values()) >= 12


def test_toxic_offsets_of_a_very_long_text(spark):
    """Offsets are counted once for a text, not once for each span."""
    rows, labels = toxic_corpus()
    df = docs(spark, rows)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    bad = next(t for i, t in rows.items() if dict(labels).get(i) == 1) if isinstance(rows, dict) else next(t for i, t in rows if dict(labels).get(i) == 1)
    whole = f"é {bad} " * 3000
    began = time.time()
    r = toxicity.score(docs(spark, {1: whole}), model).first()
    assert time.time() - began < 60 and r["score"] > 0.3 and len(r["spans"]) > 1000
    assert all(whole[s["start"] : s["end"]].strip() == whole[s["start"] : s["end"]] for s in r["spans"][-50:])
    words = {whole[s["start"] : s["end"]] for s in r["spans"]}
    assert len(words) < 50  # the same words all along: no offset drifts


def test_toxicity(spark):
    rnd, rows, labels = random.Random(6), {}, []
    for i in range(160):
        w = text(i, 30).split()
        if i % 4 == 0:
            for j in rnd.sample(range(30), 3):
                w[j] = rnd.choice(["vileword", "nastyword", "Foulword"])
        rows[i], _ = " ".join(w), labels.append((i, int(i % 4 == 0)))
    rows |= {200: None, 201: "", 202: "vileword nastyword!", 203: text(3, 4000)}
    df = docs(spark, rows)
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all((out[i]["score"] >= toxicity.CUT) == (i % 4 == 0) for i in range(160))
    assert out[200]["score"] == out[201]["score"] == 0 and out[202]["score"] >= toxicity.CUT > out[203]["score"]
    assert [rows[202][s["start"] : s["end"]] for s in out[202]["spans"]] in (["vileword nastyword"], ["vileword", "nastyword"])
    assert {r["score"] for r in toxicity.score(df, toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))).collect()} == {0.0}


# ---- op6


def test_best_fit_small():
    assert packing.best_fit(np.array([6, 4, 5, 5, 3]), 10).tolist() == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("group_items", [50_000, 7])
def test_pack_is_gapless(spark, group_items):
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 100) for _ in range(200)] + [100] * 5
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    rows = packing.pack(df, 100, group_items=group_items, fan_in=3).collect()
    assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["item"]]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 100
    whole = int(packing.best_fit(np.array(sizes), 100).max()) + 1  # one task with everything
    assert len(by) <= whole * (1 if group_items > 10 else 1.1)


def test_pack_that_cannot_fill_ends(spark):
    df = spark.createDataFrame([(i, 60) for i in range(100)], "item long, length long")
    assert packing.pack(df, 100, group_items=5, fan_in=2).select("sequence_id").distinct().count() == 100


def test_pack_bounds_its_groups(spark, monkeypatch):
    """Groups stay small in every round, and little is lost by that."""
    seen, plain = spark.sparkContext.accumulator(0), packing.best_fit
    most = spark.sparkContext.accumulator(0)
    fitting = packing._fitting

    def counted(capacity, nearly, last):
        fit = fitting(capacity, nearly, last)

        def run(g):
            seen.add(len(g))
            most.add(int(len(g) > 2 * 100))
            return fit(g)

        return run

    monkeypatch.setattr(packing, "_fitting", counted)
    rnd = random.Random(9)
    sizes = [int(min(1000, rnd.lognormvariate(5, 1) + 1)) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    rows = packing.pack(df, 1000, group_items=100, fan_in=4).collect()
    assert seen.value >= 6000 and most.value == 0 and len(rows) == 6000
    n, whole = len({r["sequence_id"] for r in rows}), int(plain(np.array(sizes), 1000).max()) + 1
    assert n <= 1.02 * whole


def test_pack_documents(spark):
    rows = packing.pack_documents(docs(spark, [*ODD.items(), (5, ODD[5]), (None, "x")]), word_bpe(), 1, capacity=512).collect()
    e = encoder(word_bpe()).tokenizer
    for i, t in ODD.items():
        ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r["start"], bytes(r["ids"]), r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert b"".join(x for _, x, _ in own) == ids.tobytes() * (2 if i == 5 else 1) or i == 5
        assert all(zlib.crc32(x) == c for _, x, c in own)
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack_documents(docs(spark, {}), word_bpe(), 1).count() == 0


# ---- op7


@pytest.mark.parametrize("options", [{}, {"join": "shuffle"}, {"hash_all": True}, {"prefix_chars": 1}])
def test_exact_groups(spark, options, monkeypatch):
    options = dict(options)
    if options.pop("join", None):
        monkeypatch.setattr(exact, "broadcast_if_small", lambda df: df)
    rows = [*ODD.items(), (20, "o n e"), (21, "One "), (22, "One"), (23, " One"), (None, "One"), (24, "x" * 50_000), (25, "x" * 49_999 + "y"), (24, "x" * 50_000)]
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(docs(spark, rows), **options).collect()]
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    want = []
    for i, t in rows:
        same = [(j, u) for j, u in rows if norm(u) == norm(t)]
        most = max(len(u or "") for _, u in same)
        keep = min((j for j, u in same if len(u or "") == most and j is not None), default=None)
        want.append((i, keep, len(same), i == keep))
    order = lambda x: sorted(map(repr, x))
    assert order(got) == order(want)
    assert exact.exact_groups(docs(spark, {}), **options).count() == 0
    hashed = {r["doc_id"] for r in exact.exact_groups(docs(spark, rows), **options).collect() if r["text_sha256"]}
    assert 9 not in hashed or "hash_all" in options  # a text of a length of its own is not hashed, however the join runs
    assert {5, 6, 22, 23} <= hashed


def test_drop_copies_keeps_columns(spark):
    df = docs(spark, {1: "a b", 2: "ab", 3: "c"})
    out = exact.drop_copies(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_drops_go_by_row(spark):
    """Unique texts stay beside a copy under a null and under a repeated doc_id."""
    a, b, c, d = (text(s, 100) for s in (21, 22, 23, 24))
    rows = [(1, a), (None, a), (None, b), (2, a), (2, c), (3, d), (None, None)]
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    want = sorted([(1, a), (None, b), (2, c), (3, d), (None, None)], key=repr)
    assert pairs(exact.drop_copies(docs(spark, rows))) == want
    near = [(1, a), (2, swapped(a, (50,), "new")), (2, b), (None, a), (None, c), (3, d), (3, swapped(d, (50,), "new"))]
    got = pairs(simhash.drop_near_copies(docs(spark, near)))
    assert len(got) == 5 and set(got) > {(1, a), (2, b), (None, a), (None, c)} and {i for i, _ in got} == {1, 2, 3, None}


# ---- op8


def test_license_scan(spark):
    rows = {0: None, 1: "", 2: "CC-BY cc  by. CC by", 3: "All rights RESERVED.", 4: "under the GNU general\npublic license", 5: "Released under  MIT License!", 6: "general public; license all rights", 7: "x " * 5000 + "Licensed under the Apache License, Version 2.0", 8: "ccby All rıghts reserved", 9: "İ K cc by"}
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    pick = lambda i, *c: tuple(got[i][x] for x in c)
    assert pick(0, "n_words", "n_base", "first_word", "base_labels", "labels", "score") == (0, 0, None, "", "", 0.0) == pick(1, "n_words", "n_base", "first_word", "base_labels", "labels", "score")
    assert pick(2, "n_words", "n_base", "first_word", "last_word", "base_labels") == (6, 3, 0, 4, "cc-by")
    assert pick(3, "n_base", "base_labels", "score") == (1, "reserved", 1.0) and pick(4, "first_word", "base_labels") == (3, "gpl")
    assert pick(5, "n_base", "labels") == (0, "mit") and 0.8 <= got[5]["score"] <= 1 and pick(6, "n_base", "base_labels") == (1, "gpl")
    assert pick(7, "n_words", "labels") == (5008, "apache-2.0") and pick(8, "n_base", "n_words") == (0, 4) and pick(9, "first_word", "n_words") == (2, 4)
    assert licenses.scan(docs(spark, {})).count() == 0


def test_license_scan_of_a_very_long_text(spark):
    """Work grows with the text: 200,000 template words, and as many of one template's prefix."""
    rows = {0: "all rights reserved " * 66_000, 1: "software " * 200_000 + licenses.TEMPLATES[1][0], 2: "x"}
    began = time.time()
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert time.time() - began < 120
    assert got[0]["n_base"] == 66_000 and got[0]["labels"] == "reserved" and "mit" in got[1]["labels"] and got[2]["score"] == 0


# ---- op9


def test_decontamination_of_a_document_that_repeats_an_item(spark):
    q = "A train leaves the old station at 40 km per hour and Maria waits 40 minutes before walking another 12 miles home"
    items = spark.createDataFrame([(1, q), (2, text(50, 30))], "item_id long, text string")
    got = benchmark.contaminated(docs(spark, {1: f"{q} . " * 20_000, 2: text(4)}), items).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in got] == [(1, 1, 1.0)]


def test_decontamination(spark):
    q = "A train leaves the old station at 40 km per hour and Maria waits 40 minutes before walking another 12 miles home"
    other = q.replace("40", "55").replace("Maria", "Joana").replace("12", "7")
    torn = q.replace("40 km", "55 km").replace("Maria", "Joana").replace("12", "7")
    items = spark.createDataFrame([(1, q), (2, text(50, 30)), (3, None), (4, ""), (5, "too short"), (1, q), (None, q)], "item_id long, text string")
    rows = {0: None, 1: "", 2: f"Some words first. {q}. And more.", 3: f"{text(9)}. {other}", 4: text(11), 5: text(50, 30) + " " + text(4), 6: f"{text(12)}. {torn}"}
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark.contaminated(docs(spark, [*rows.items(), (2, rows[2])]), items).collect()}
    assert {(2, 1), (3, 1), (5, 2)} <= set(got) and not {d for d, _ in got} & {0, 1, 4}
    assert got[3, 1]["reparameterised"] and not got[2, 1]["reparameterised"]
    assert (6, 1) not in got or got[6, 1]["n_windows"] < got[3, 1]["n_windows"]
    assert sorted({r["doc_id"] for r in benchmark.drop_contaminated(docs(spark, rows), items).collect()} & {0, 1, 2, 3, 4, 5}) == [0, 1, 4]
    assert benchmark.contaminated(docs(spark, {}), items).count() == 0 == benchmark.contaminated(docs(spark, rows), items.filter("false")).count()


def test_a_name_that_opens_a_sentence_is_a_name(spark):
    assert benchmark.canonical("Maria")[0] == benchmark.NAME == benchmark.canonical("Joana,")[0] and benchmark.canonical("The")[1] == "the" == benchmark.canonical("the")[1]
    q = "Maria has 3 apples in her basket and gives 2 of them to Pedro. How many apples does Maria have left in the basket now?"
    items = spark.createDataFrame([(1, q)], "item_id long, text string")
    other = q.replace("Maria", "Joana").replace("3", "5").replace("2", "4").replace("Pedro", "Ana")
    got = benchmark.contaminated(docs(spark, {1: other, 2: "Well. " + q, 3: text(5)}), items).collect()
    assert sorted((r["doc_id"], r["coverage"], r["reparameterised"]) for r in got) == [(1, 1.0, True), (2, 1.0, False)]


def brute_contaminated(rows, items, k=8, literal=4, share=0.5, run=6):
    """Every window of every item at every distance in every document."""
    out = {}
    for d, t in rows:
        doc = benchmark.template(t)
        for i, u in items:
            item = benchmark.template(u)
            own = [p for p in range(len(item) - k + 1) if sum(x[0] == benchmark.PLAIN for x in item[p : p + k]) >= literal]
            for shift in range(-len(item), len(doc)):
                met = [p for p in own if 0 <= p + shift <= len(doc) - k and [x[1] for x in item[p : p + k]] == [x[1] for x in doc[p + shift : p + shift + k]]]
                kept = benchmark.aligned(item, doc, shift, met, k)[0] if met else []
                runs = [n for n in range(1, len(kept) + 1) if any(all(p + j in kept for j in range(n)) for p in kept)]
                if kept and (len(kept) >= share * len(own) or max(runs) >= run):
                    out[d, i] = max(out.get((d, i), 0), len(kept))
    return out


def test_decontamination_is_brute_force(spark):
    """Items that share openings, are alike, or share an item_id; documents with parts of them, values changed; null ids, repeats."""
    rnd = random.Random(12)
    opening = "Read the following question about the river and then choose the best answer below."
    body = [text(300 + i, rnd.randint(8, 25)) + f" for {i + 3} km or {i * 7 + 2} miles with Anna" for i in range(8)]
    items = [(i, f"{opening} {b}") for i, b in enumerate(body)] + [(20, f"{opening} {body[0]}"), (2, body[5]), (21, opening), (22, "short one"), (None, body[1])]
    rows = []
    for d in range(30):
        w = f"{rnd.choice([opening, ''])} {rnd.choice(body)}".split()
        cut = rnd.randint(0, len(w) // 2)
        part = " ".join(w[cut : cut + rnd.randint(6, 40)]).replace("km", rnd.choice(["km", "miles"])).replace("Anna", rnd.choice(["Anna", "Bert"]))
        rows.append((rnd.choice([d, d, d, 3]), f"{text(400 + d, rnd.randint(0, 12))} {part} {text(500 + d, 5)}"))
    rows += [(40, None), (41, ""), (42, opening), rows[0], (43, (text(7, 3000) + " " + body[2]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_windows"] for r in benchmark.contaminated(docs(spark, rows), df).collect()}
    want = brute_contaminated([x for x in rows if x[0] is not None], [x for x in items if x[0] is not None])
    assert got == want and len(want) > 20
    # removal goes by text: rows without a doc_id are judged too
    rows = [(None if i % 5 == 0 else d, t) for i, (d, t) in enumerate(rows)]
    dirty = {t for (n, i) in brute_contaminated([(t, t) for _, t in rows if t], [x for x in items if x[0] is not None]) for t in [n]}
    stay = sorted(map(repr, (x for x in rows if x[1] not in dirty)))
    assert sorted(repr((r["doc_id"], r["text"])) for r in benchmark.drop_contaminated(docs(spark, rows), df).collect()) == stay


def test_items_of_one_template_are_judged_by_their_own_values(spark):
    """Items that differ in values only: what contradicts itself in one of them fits in another, and the flag is each one's own."""
    say = "The farmer sells {} apples at the market and the teacher buys {} apples for the school on the same day"
    values = [(i, i) for i in range(1, 21)] + [(i, i + 1) for i in range(1, 21)]
    items = [(n, say.format(*v)) for n, v in enumerate(values)]
    rows = [(1, f"{text(4)} {say.format(3, 4)}."), (2, say.format(7, 7)), (3, f"{say.format(30, 40)} {text(5)}"), (4, say.format(50, 50)), (5, text(6))]
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {key: r["n_windows"] for key, r in got.items()} == brute_contaminated(rows, items)
    whole = lambda d: {i for (x, i), r in got.items() if x == d and r["coverage"] == 1}
    assert whole(1) == whole(3) == set(range(20, 40)) and whole(2) == whole(4) == set(range(20))
    assert not got[1, 22]["reparameterised"] and got[1, 23]["reparameterised"] and not got[2, 6]["reparameterised"] and got[4, 6]["reparameterised"]


# ---- op10


def brute_repeats(rows, k=13):
    seen = {}
    words = {i: (t or "").encode().split() for i, t in rows.items()}
    for i, w in words.items():
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            seen[g] = min(seen.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("most", [200_000, 3])
def test_substring_dedup(spark, most):
    rnd, rows = random.Random(9), dict(ODD)
    passages = [text(100 + i, n).split() for i, n in enumerate((13, 14, 40, 200))]
    for i in range(10, 50):
        w = text(i, rnd.randint(5, 80)).split()
        for p in rnd.sample(passages, 2):
            a = rnd.randint(0, len(p) - 12)
            w[rnd.randint(0, len(w)) :] += p[a : a + rnd.randint(12, len(p))]
        rows[i] = " ".join(w)
    rows |= {60: "same " * 100, 61: "same " * 40, 62: "a b " * 30}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs(spark, rows), most=most).collect()}
    assert got == brute_repeats(rows)


def test_substring_heavy_minimizers_and_later_rounds(spark, monkeypatch):
    passage = text(88, 20)
    rows = {i: f"{text(1000 + i, 4)} {passage} {text(2000 + i, 4)}" for i in range(150)}
    df = docs(spark, rows).select("doc_id", "text", F.lit(0).cast("long").alias("tie"))
    assert len(substring._heavy(df, 13, 6, 100)) > 0 == len(substring._heavy(df, 13, 6, 10_000))
    b = Block([passage.encode(), passage.encode()])
    h = substring._word_hashes(b, 1)
    assert h[:20].tolist() == h[20:].tolist() != b.hashes(b.starts, b.ends)[:20].tolist() and len(set(h.tolist())) == len(set(passage.split()))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs(spark, rows), most=100).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("most", [200_000, 20])
def test_substring_mends_hashes_that_met(spark, monkeypatch, most):
    """First-round hashes that take few values: digests notice, and only windows of failed spans are matched again."""
    rnd, rows = random.Random(4), {}
    passages = [text(700 + i, 30).split() for i in range(4)]
    for i in range(30):
        w = text(800 + i, rnd.randint(0, 20)).split()
        for p in rnd.sample(passages, 2):
            a = rnd.randint(0, 12)
            w += p[a : a + rnd.randint(13, 30)]
        rows[i] = " ".join(w)
    edges = substring._Edges

    class Weak(edges):
        def __init__(self, texts, k, m, seed):
            super().__init__(texts, k, m, seed)
            if self.size and seed < 2:
                self.whole = self.whole % np.uint64(3) << np.uint64(32)

    monkeypatch.setattr(substring, "_Edges", Weak)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs(spark, rows), most=most).collect()}
    assert got == brute_repeats(rows)


def test_substring_null_and_repeated_ids(spark):
    p = text(77, 30)
    rows = [(None, p), (None, p), (1, p), (2, "x " + p), (2, "y z " + p), (2, "y z " + p)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"].split()[:2]) for r in substring.remove_repeats(docs(spark, rows)).collect())
    assert [x[:3] for x in got] == [("1", 30, 0), ("2", 31, 30), ("2", 32, 30), ("2", 32, 30), ("None", 30, 0), ("None", 30, 0)]
    assert substring.remove_repeats(docs(spark, {})).count() == 0


def test_near_copies_go_by_fingerprints_too(spark):
    """Texts whose fingerprints differ in at most 4 bits are one group of the near-dedup stage, as in op4, even if their shingle sets are less alike than 0.8."""
    rows, fps = {0: text(50, 400)}, {0: reference_fingerprint(text(50, 400))}
    rnd = random.Random(8)
    while len(rows) < 4:  # a dozen places changed: similarity under 0.8, mostly further than 4 bits apart
        t = swapped(rows[0], sorted(rnd.sample(range(400), 12)), "x")
        if 0 < bin(reference_fingerprint(t) ^ fps[0]).count("1") <= 4:
            rows[len(rows)] = t
    rows[9] = text(51, 400)
    assert set(near_brute({0: rows[0], 1: rows[1]}).values()) == {0, 1}
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows)).collect()) == [0, 9]


def test_set_similarity_join_meets_a_pair_once(spark, monkeypatch):
    """Pairs come out of the join about once each, not once for each rare shingle that they share; and none is lost, however few shingles before are looked at."""
    base, rows = text(902, 200), {}
    for c in range(40):
        rows[c] = swapped(base, [c % 20 * 10, (c // 2) % 20 * 10 + 3], "u")
    texts = spark.createDataFrame(list(rows.items()), "cls long, text string").cache()
    apart = spark.createDataFrame([(c, c) for c in rows], "cls long, root long")
    want = None
    for before in (1, 3, 16):
        monkeypatch.setattr(simhash, "BEFORE", before)
        got = {(r["a"], r["b"]) for r in simhash._unlinked(apart, texts, 5, 0.8).collect()}
        assert want is None or got == want
        want = got
    sets = {c: set(x.tolist()) for c, x in zip(rows, simhash.shingle_sets(rows.values()), strict=True)}
    assert {(a, b) for a in rows for b in rows if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} <= want
    texts.unpersist()
