"""Hard negatives, whitening and licence scans against brute force, and on odd input."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import hard_negatives, licences, queries, whitening


# 11
def brute_mine(rows, positives=5, negatives=10, low=30, high=90):
    good = [(n, i, label, x, a) for n, (i, label, x, a) in enumerate(rows) if label is not None and x and None not in x]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for n, i, label, x, anchor in good:
        if not anchor:
            continue
        score = lambda y: sum(a * b for a, b in zip(x, y))
        others = [(m, j, k, score(y)) for m, j, k, y, _ in good if m != n and len(y) == len(x)]
        for p, pi, _ in sorted(((s, j, m) for m, j, k, s in others if k == label), key=key)[:positives]:
            inside = sorted(((s, j, m) for m, j, k, s in others if k != label and low * p <= 100 * s <= high * p), key=key)[:negatives]
            out += [(i, pi, r + 1, j, p, s) for r, (s, j, m) in enumerate(inside)]
    return sorted(map(str, out))


def odd_vectors(rng, n=400, d=6):
    base = rng.integers(-40, 40, size=(9, d))
    vecs = base[rng.integers(0, 9, n)] + rng.integers(-8, 9, size=(n, d))
    rows = [(int(i), int(rng.integers(0, 4)), [int(x) for x in v], i % 20 == 0) for i, v in enumerate(vecs)]
    rows += [(1000 + i, 1, rows[3][2], False) for i in range(30)]  # ties
    odd = [(2000, None, rows[0][2], True), (2001, 1, None, True), (2002, 1, [], True), (2003, 1, [None, 1], True), (None, 1, rows[3][2], True), (None, 2, rows[4][2], False), (2004, 1, [1, 2], True), (2005, 1, [2, 3], False), (2006, 2, [1, 1], False), (2007, 3, [0] * d, True), (2008, 3, rows[5][2], None)]
    return rows + odd


@pytest.mark.parametrize("tile, block", [(2048, 256), (16, 16)])
def test_hard_negatives_are_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = odd_vectors(np.random.default_rng(3))
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "id long, label int, x array<long>, anchor boolean, row string, rank int").coalesce(1)
    got = hard_negatives.mine(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_mine(rows)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.where("NOT anchor")).count() == 0


def test_hard_negatives_of_repeated_rows(spark):
    rows = [(100, 1, [3, 4], True)] * 2 + [(7, 1, [3, 4], False), (8, 2, [2, 2], False), (8, 2, [2, 2], False), (9, 2, [1, 2], False)]
    df = spark.createDataFrame(rows, "id long, label int, x array<long>, anchor boolean").coalesce(1)
    assert sorted(str(tuple(r)) for r in hard_negatives.mine(df).collect()) == brute_mine(rows)


def test_scores_that_no_double_holds(spark):
    big = (1 << 30) + 1
    rows = [(0, 1, [big, big], True), (1, 1, [big, big - 1], False), (2, 2, [big // 2, big // 2 - 1], False), (3, 2, [big // 2, big // 2], False)]
    df = spark.createDataFrame(rows, "id long, label int, x array<long>, anchor boolean").coalesce(1)
    assert sorted(str(tuple(r)) for r in hard_negatives.mine(df).collect()) == brute_mine(rows)
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.array([[1 << 40]]), np.array([1 << 40]))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([1.0, 30.0]))
def test_tree_bounds_hold(seed, n, spread):
    rng = np.random.default_rng(seed)
    x, v = (np.rint(rng.normal(size=(m, 5)) * s).astype(np.int64) for m, s in ((60, 50.0), (n, spread)))
    v = v + np.rint(rng.normal(size=5) * 60).astype(np.int64)
    tile = {"x": x, "row": np.arange(60), "norm": np.linalg.norm(x, axis=1)}
    tree = hard_negatives.spanning_tree(v.astype(float))
    assert sorted(t[0] for t in tree) == list(range(n))
    seen = {t[0]: i for i, t in enumerate(tree)}
    assert all(p < 0 or seen[p] < seen[c] for c, p, _ in tree)
    exact = x @ v.T
    cut, chosen = np.median(exact), {}

    def wanted(node, low, high):
        assert (low <= exact[:, node]).all() and (exact[:, node] <= high).all()
        return high >= cut

    computed = hard_negatives.bounded_scores(tile, {"x": v}, tree, wanted, lambda node, at, s: chosen.update({node: (at, s)}))
    assert computed <= 60 * n
    for node, (at, s) in chosen.items():
        assert (s == exact[at, node]).all() and set(np.flatnonzero(exact[:, node] >= cut)) <= set(at)


def test_near_anchors_save_work():
    rng = np.random.default_rng(2)
    x, v = rng.integers(-60, 60, size=(2000, 16)), rng.integers(-60, 60, size=16) + rng.integers(-1, 2, size=(100, 16))
    tile = {"x": x, "row": np.arange(2000), "norm": np.linalg.norm(x, axis=1)}
    bar = np.sort(x @ v[0])[-10]
    computed = hard_negatives.bounded_scores(tile, {"x": v}, hard_negatives.spanning_tree(v.astype(float)), lambda n, low, high: high >= bar, lambda *_: None)
    assert computed < 0.4 * 2000 * 100


# 12
def brute_whiten(rows, k=4):
    good = [(i, [math.floor(256.0 * c) for c in v]) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    if not good:
        return {}, None
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=float)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        for c in range(len(e)):
            out.setdefault((i, c + 1), []).append((n, int(sum((n * a - int(s)) ** 2 for a, s in zip(x, total))), float((np.array(x) - total / n) @ q[:, c] / np.sqrt(e[c])), float(e[c] / np.trace(centred.T @ centred / n))))
    return out, q


def test_whitening_is_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(300, 7)) * np.array([3, 1, 0.4, 2, 0.2, 0.1, 0.7]) @ np.linalg.qr(rng.normal(size=(7, 7)))[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[4][1])]
    odd = [(600, None), (601, []), (602, [None] * 7), (603, [float("nan")] * 7), (604, [float("inf")] * 7), (605, [-0.0] * 7)]
    df = spark.createDataFrame([(*r, "a", 1, 2.0) for r in rows + odd], "vec_id long, embedding array<double>, label string, n int, whitened double")
    got, (want, _) = whitening.whiten(df).collect(), brute_whiten(rows + odd)
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        n, deviation, z, share = want[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] - share) < 1e-9 and r["identity_error"] < 1e-9
        if abs(z) > 1e-3:
            signs.setdefault(r["component"], set()).add(round(r["whitened"] / z, 6))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 4
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_of_the_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    want, _ = brute_whiten(rows)
    got = {(r["vec_id"], r["component"]): r for r in queries.op12_whitening(spark, sf_dir).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        n, deviation, z, share = want[k][0]
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(abs(r["whitened"]) - abs(z)) < 1e-8 and abs(r["explained"] / share - 1) < 1e-9


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0])], "vec_id long, embedding array<double>")
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 1, 1, 0, None, 0.0, 0.0), (1, 2, 1, 0, None, 0.0, 0.0), (2, 1, 1, 0, None, 0.0, 0.0), (2, 2, 1, 0, None, 0.0, 0.0), (3, 1, 1, 0, None, 0.0, 0.0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 24), st.sampled_from(["plain", "low rank", "ties", "graded"]))
def test_spectrum_of_any_covariance(seed, d, kind):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = {"plain": rng.uniform(0, 5, d), "low rank": np.where(np.arange(d) % 3 == 0, rng.uniform(1, 2, d), 0), "ties": rng.integers(0, 3, d).astype(float), "graded": 10.0 ** -rng.uniform(0, 12, d)}[kind]
    v = q * e @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.spectrum(v)
    scale = max(1e-300, np.linalg.norm(v))
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12 * d
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * d * scale
    assert np.abs(values - np.sort(np.linalg.eigvalsh(v))[::-1]).max() < 1e-12 * d * scale


# 13
def brute_licences(rows, rare=licences.RARE, agree=licences.AGREE, slack=licences.SLACK):
    words = [re.findall(licences.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))) for _, t in rows]
    df = {w: sum(w in set(ws) for ws in words) for _, n, _ in licences.NOTICES for w in n.split()}
    at = lambda ws, i, key: i >= 0 and ws[i : i + len(key)] == key
    out = []
    for (i, _), ws in zip(rows, words):
        base = [(label, s) for label, p in licences.BASE for s in range(len(ws)) if at(ws, s, p.split())]
        found = [(label, s, 1.0) for label, s in base]
        for label, notice, keys in licences.NOTICES:
            n = notice.split()
            chosen = sorted(range(len(n)), key=lambda j: (df[n[j]], j))[:rare]
            for s in range(-len(n), len(ws)):
                if sum(0 <= s + j < len(ws) and ws[s + j] == n[j] for j in chosen) < min(agree, len(chosen)):
                    continue
                places = [(next(j for j in range(len(n)) if n[j : j + len(k.split())] == k.split()), k.split()) for k in keys]
                if all(any(at(ws, s + j + x, k) for x in range(-slack, slack + 1)) for j, k in places):
                    found.append((label, s, sum(0 <= s + j < len(ws) and ws[s + j] == w for j, w in enumerate(n)) / len(n)))
        starts = [s for _, s in base]
        out.append(str((i, len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted({x[0] for x in found})), max((x[2] for x in found), default=0.0))))
    return sorted(out)


def test_licences_are_brute_force(spark, odd_docs, no_docs):
    rnd = random.Random(8)
    filler = "the of license software cc by rights version 2 0 3 and wort слово 許可 general public gnu under".split()
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for i in range(120):
        parts = [" ".join(rnd.choices(filler, k=rnd.randrange(12)))]
        for _ in range(rnd.randrange(3)):
            words = rnd.choice(licences.NOTICES)[1].split()
            if rnd.random() < 0.4:
                words[rnd.randrange(len(words))] = rnd.choice(filler)
            if rnd.random() < 0.3:
                words.insert(rnd.randrange(len(words)), "x")
            parts += [rnd.choice([" ", ", ", "\n", "-"]).join(w.upper() if rnd.random() < 0.2 else w for w in words), rnd.choice(["All Rights reserved. all rights RESERVED", "cc-by", "CC by", "GENERAL\tpublic License", "licencé by", ""])]
        texts.append((100 + i, " ".join(parts)))
    texts += [(None, "cc by"), (None, "All rights reserved"), (7, "cc by"), (7, "cc by"), (500, "cc" * 4), (501, "K cc by"), (502, "AcC BY"), (503, "cc\x00by"), (504, "by cc by cc by" + " cc by" * 3000), (505, "İcc by ſ cc by")]
    df = spark.createDataFrame([(i, t, "r", "w") for i, t in texts], "doc_id long, text string, found string, words string")
    got = licences.scan(df)
    assert sorted(str(tuple(r)[:-1]) for r in got.collect()) == brute_licences(texts)
    assert all(any(r["labels"].split(",")) == bool(r["found"]) for r in got.collect())
    assert licences.scan(no_docs).count() == 0


def test_licence_scan_has_no_python(spark, sf_dir):
    plan = queries.op13_licences(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
