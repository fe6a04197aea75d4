"""Top-k search, whitening and fill-in-middle against brute force, with nulls, ties, repeats, clashing columns, empty tables and very long texts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from teleflect.llm import middle, topk, whiten

VECTORS = "vec_id long, embedding array<float>, row long, id long, v string, dim int, n int, block binary, score double"


def table(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4, b"y", 0.5) for i, v in rows], VECTORS)


def random_vectors(seed, n, dim=6, kinds=None):
    rnd = random.Random(seed)
    if kinds is None:
        return [[float(np.float32(rnd.gauss(0, 0.3))) for _ in range(dim)] for _ in range(n)]
    centres = random_vectors(seed + 1, kinds, dim)
    return [[float(np.float32(c + rnd.gauss(0, 0.01))) for c in rnd.choice(centres)] for _ in range(n)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# ---- op11


def brute_top(rows, k, every, scale=1024):
    x = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if usable(v)]
    out = []
    for a, (i, q) in enumerate(x):
        if i is not None and i % every == 0:
            s = [(-sum(p * r for p, r in zip(q, v)), j is None, j) for b, (j, v) in enumerate(x) if b != a and len(v) == len(q)]
            out += [(i, rank, j, -score) for rank, (score, _, j) in enumerate(sorted(s, key=lambda t: (t[0], t[1], t[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "group_rows": 3}, {"shard_rows": 300}])
def test_top_k_is_brute_force(spark, options):
    rows = list(enumerate(random_vectors(1, 500) + random_vectors(2, 300, kinds=5)))
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # copies, so scores tie at the k-th place
    rows += [(2000, None), (2100, [None] * 6), (2200, [float("nan")] * 6), (2300, [float("inf")] + [0.0] * 5), (None, rows[3][1]), (None, None), (2400, []), (2500, [0.0] * 6), (2600, [-0.0] * 6)]
    rows += [(2700, [1.0, 2.0]), (2701, [3.0, -1.0]), (100, rows[100][1]), (100, rows[5][1]), (-100, rows[9][1])]
    df = table(spark, rows)
    assert found(df, every=50, **options) == brute_top(rows, 10, 50)


def test_top_k_of_few_or_none(spark):
    assert found(table(spark, [])) == [] == found(table(spark, [(100, [1.0])]))
    assert found(table(spark, [(100, [1.0]), (7, [2.0]), (3, [2.0])])) == [(100, 1, 3, 1024 * 2048), (100, 2, 7, 1024 * 2048)]
    big = 3e38  # beyond a long once scaled: the nearest long
    assert [r[:3] for r in found(table(spark, [(100, [big, 1.0]), (1, [big, 2.0]), (2, [-big, 0.0])]))] == [(100, 1, 1), (100, 2, 2)]


@pytest.mark.parametrize("size", [1, 1 << 27, 1 << 40])
def test_dot_is_exact(size):
    rnd = random.Random(size)
    a, b = (np.array([[rnd.randint(-size, size) for _ in range(5)] for _ in range(4)]) for _ in range(2))
    want = [[max(-topk.LAST, min(topk.LAST, sum(int(p) * int(r) for p, r in zip(x, y)))) for y in b] for x in a]
    assert topk.dot(a, b).tolist() == want


def test_blocks_are_pruned(spark):
    """Vectors in 40 directions: a query scores few of the blocks, and still finds the best."""
    rows = list(enumerate(random_vectors(3, 6000, dim=16, kinds=40)))
    scaled = topk.scaled(table(spark, rows), "vec_id", "embedding", 1024)
    blocks = topk.candidate_blocks(scaled, 1, 64).toPandas()
    asked = scaled.filter("id % 100 = 0").selectExpr("row", "id", "v", f"{-topk.LAST - 1} AS floor", f"{topk.LAST} AS floor_id")
    b, q = topk.Group(blocks), topk.Group(topk.query_packs(asked).toPandas())
    (of, block, place, score), scored = topk.search(q, b, 10)
    ids = np.concatenate(q.ids)
    got = sorted((int(ids[o]), int(b.ids[x][p]), int(s)) for o, x, p, s in zip(of, block, place, score))
    assert got == sorted((i, j, s) for i, _, j, s in brute_top(rows, 10, 100))
    bounds = topk.dot(topk.terms(np.concatenate(q.vectors)), np.array(b.most))
    for x, v in enumerate(b.vectors):
        assert (topk.dot(np.concatenate(q.vectors), v).max(axis=1) <= bounds[:, x]).all()
    assert scored < 0.4 * len(ids) * len(blocks)


# ---- op12


def plain_cut(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, z = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 40, "spm": 10}])
def test_fill_in_middle(spark, options):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("aé漢😀 \r\t<PSM>\n\n") for _ in range(rnd.choice([0, 1, 5, 300])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "no line end"), (204, "a<S>b\nc"), (205, "<" * 9 + "\nS>\nP>\n"), (None, "x\ny\n"), (None, "x\ny\n"), (3, rows[3][1]), (-1, "q\nr\ns"), (300, "line of words\n" * 300_000 + "end")]
    df = spark.createDataFrame([(i, t, 1, "p", "o", 2) for i, t in rows], "doc_id long, text string, n int, form string, output string, prefix_chars int")
    got = middle.fill_in_middle(df, **options).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *plain_cut(i, t, **options)) for i, t in rows]
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got) == sorted(map(repr, want))
    assert sorted((r["output_sha256"], r["restored_sha256"]) for r in got) == sorted((sha(w[-1]), sha(t or "")) for w, (_, t) in zip(want, rows))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(r["output"] is None for r in middle.fill_in_middle(df.limit(3), with_text=False).collect())
    assert middle.fill_in_middle(df.filter("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 16, 17, 1000])
def test_skip_list_meets_every_rank(n):
    rnd = random.Random(n)
    widths = np.array([rnd.randint(1, 90) for _ in range(n)], np.int64)
    index = middle.SkipList(widths)
    assert [index.seek(r) for r in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
    assert all(sum(lane[0]) == n and sum(lane[1]) == widths.sum() for lane in index.lanes) and len(index.lanes) <= 1 + math.log(max(n, 1), middle.FAN) + 1
    with pytest.raises(IndexError):
        index.seek(n + 1)


# ---- op13


def plain_whitened(rows, dim, scale=256, k=4):
    x = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if usable(v) and len(v) == dim]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return x, n, sums, e, u, np.sum(c * c) / n


def test_whitening(spark):
    rows = list(enumerate(random_vectors(11, 700, dim=9))) + [(800 + i, random_vectors(11, 1, dim=9)[0]) for i in range(400)]
    rows += [(2000, None), (2001, [None] * 9), (2002, [float("nan")] * 9), (2003, [float("-inf")] * 9), (2004, [1.0]), (2005, []), (None, rows[4][1]), (5, rows[6][1])]
    x, n, sums, e, u, trace = plain_whitened(rows, 9)
    got = whiten.whiten(table(spark, rows)).collect()
    assert len(got) == 4 * len(x) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-12
    want = np.array([(np.array(v) - sums / n) @ u / np.sqrt(e) for _, v in x])
    by = {c: sorted((repr(r["vec_id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == c) for c in (1, 2, 3, 4)}
    for c in by:
        assert {r["explained"] for r in got if r["component"] == c}.pop() == pytest.approx(e[c - 1] / trace, rel=1e-12)
        for sign in (1, -1):
            plain = sorted((repr(i), sum((n * a - int(s)) ** 2 for a, s in zip(v, sums)), sign * w[c - 1]) for (i, v), w in zip(x, want))
            if all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(by[c], plain)):
                break
        else:
            raise AssertionError(c)


def test_whitening_of_few_or_none(spark):
    assert whiten.whiten(table(spark, [])).count() == 0 == whiten.whiten(table(spark, [(1, None)])).count()
    assert whiten.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # equal vectors: no variance
    got = whiten.whiten(table(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 4.0]), (3, [1.0, 2.0, 3.0])])).collect()
    assert sorted((r["vec_id"], r["component"], round(r["explained"], 12), round(abs(r["whitened"]), 12)) for r in got) == [(i, 1, 1.0, 1.0) for i in (1, 2, 3)]
    far = whiten.whiten(table(spark, [(1, [1e18, 0.0]), (2, [-1e18, 1.0])])).collect()
    assert {r["deviation"] for r in far} == {None} and max(r["identity_error"] for r in far) < 1e-9


@pytest.mark.parametrize("case", ["random", "low rank", "equal", "cluster", "decades"])
def test_jacobi_davidson_reaches_double_precision(case):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((150, 150)))[0]
    e = {"random": rng.random(150), "low rank": np.append(rng.random(3), np.zeros(147)), "equal": np.append(np.full(5, 2.0), rng.random(145)), "cluster": np.append(1 + 1e-5 * rng.random(6), rng.random(144) * 0.9), "decades": 10.0 ** -np.arange(150).clip(0, 12)}[case]
    a = q * e @ q.T
    a = (a + a.T) / 2
    asked = []
    values, vectors = whiten.jacobi_davidson(lambda v: asked.append(v.shape[1]) or a @ v, 150, 4)
    top = np.sort(e)[::-1]
    assert np.abs(values - top[:4]).max() <= 1e-13 * top[0]
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-13 * top[0] and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_minres_solves():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = np.concatenate([rng.standard_normal((30, 3)), np.zeros((30, 1))], axis=1)
    x = whiten.minres(lambda v: a @ v, b, 200, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-8 and not x[:, 3].any()
