"""The corpus operators against brute force, exact round trips and held-out accuracy, and on odd input."""

import hashlib
import io
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from touchline.llm import embed_dedup, exact_dedup, graph, jaccard, langid, packing, pii, quality, queries, sepscan, simhash, sp_codec, warc
from touchline.llm.common import union_roots
from touchline.llm.tokens import encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WHITE = re.compile("[\x20\x09-\x0d]+")


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")).collect()}
    root = union_roots(1100, *np.array(links).T)
    assert got == {i: root[i] for i in range(1100) if root[i] != i}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1
def unit(v):
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def brute_links(rows, threshold):
    good = [(i, l, np.array(v, dtype=float)) for i, l, v in rows if i is not None and l is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    links = {(a, b) for a, (i, l, v) in enumerate(good) for b, (j, k, w) in enumerate(good) if a < b and l == k and len(v) == len(w) and unit(v) @ unit(w) / np.sqrt((unit(v) @ unit(v)) * (unit(w) @ unit(w))) >= threshold}
    root = union_roots(len(good), *np.array(sorted(links)).T) if links else np.arange(len(good))
    least = {r: min(good[a][0] for a in range(len(good)) if root[a] == r) for r in set(root)}
    n = Counter(x for pair in links for x in pair)
    out = [(g[0], n[a], least[root[a]], g[0] == least[root[a]]) for a, g in enumerate(good)]
    bad = [r for r in rows if not any(r[0] == i and r[1] == l and r[2] == list(v) for i, l, v in good)]
    return sorted(map(str, out + [(i, 0, i, True) for i, *_ in bad]))


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    vecs = base[rng.integers(0, 12, 150)] + rng.normal(size=(150, 8)) * rng.choice([0.0, 0.05, 0.12, 0.3], size=(150, 1))
    rows = [(i, int(i % 3), [float(x) for x in v]) for i, v in enumerate(vecs)]
    odd = [(200, 1, None), (201, 1, []), (202, 1, [0.0] * 8), (203, 1, [None] + [1.0] * 7), (204, 1, [float("nan")] * 8), (205, None, rows[0][2]), (None, 1, rows[1][2]), (206, 1, [1.0, 2.0]), (207, 1, [2.0, 4.0]), (208, 1, [float("inf")] * 8)]
    rows += odd + [(300 + i, 1, rows[1][2]) for i in range(5)]
    rows += [(400 + i, 1, [x * f for x in rows[1][2]]) for i, f in enumerate((1e-200, 1e-300, 1e200, 1e300, 5e-324, -1e200))] + [(410, 1, [1e-200] * 8), (411, 1, [1e-200] * 8), (412, 1, [1e300] * 8)]
    rows += [(1, 1, rows[2][2]), (1, 1, [9.0, -9.0] * 4), (2, 1, [9.0, -9.01] * 4), (3, 1, [8.9, -9.0] * 4), (3, 2, rows[5][2])]  # ids with several vectors
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, rep string")
    got = embed_dedup.near_vectors(df, 0.98, tile=16)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_links(rows, 0.98)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_one_label_of_many_tiles(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 12))
    vecs = base[rng.integers(0, 30, 800)] + rng.normal(size=(800, 12)) * rng.choice([0.02, 0.1, 0.3], size=(800, 1))
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = embed_dedup.near_vectors(df, 0.98, tile=12)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_links(rows, 0.98)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_error_bound_is_rigorous(seed):
    rng = np.random.default_rng(seed)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(6, 16)) * 10 ** rng.uniform(-3, 3, 16), rng.normal(size=(6, 16))))
    (qa, sa, ea), (qb, sb, eb) = embed_dedup.quantise(a), embed_dedup.quantise(b)
    product = (qa.astype(float) @ qb.astype(float).T) * sa[:, None] * sb[None, :]
    assert (np.abs(a @ b.T - product) <= ea[:, None] + (1 + ea[:, None]) * eb[None, :] + embed_dedup.SLACK).all()


# 2
def test_packing_of_rows_that_are_all_alike(spark):
    """Pieces of one length and no id share nothing but their number, and every row still gets a place of its own."""
    rows = [(None, "")] * 3000 + [(None, None)] * 500 + [(5, "same words")] * 400
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), TOKENIZER).toPandas()
    assert len(got) == len(rows) and got["doc_id"].isna().sum() == 3500
    assert not got.duplicated(["sequence_id", "offset"]).any()
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == np.cumsum([0, *seq["length"]])[:-1].tolist() and seq["length"].sum() <= 2048
    assert got["sequence_id"].nunique() == -(-int(got["length"].sum()) // 2048)


def test_packing(spark, sf_dir, odd_docs, no_docs):
    docs = docs_of(spark, sf_dir).select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 10**6))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = packing.pack(docs, TOKENIZER).toPandas()
    tokenizer = encoder(TOKENIZER).tokenizer
    total = 0
    for doc, part in rows.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        assert part["start"].tolist() == np.cumsum([0, *part["length"]])[:-1].tolist() and part["length"].sum() == len(ids) and part["piece"].tolist() == list(range(len(part)))
        assert len(part) == max(1, -(-len(ids) // 2048)) and (part["length"].iloc[1:] == 2048).all()
        assert part["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part["start"], part["length"])]
    assert set(rows["doc_id"]) == set(texts)
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == np.cumsum([0, *seq["length"]])[:-1].tolist() and seq["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() <= -(-total // 2048) * 1.02 + 1
    assert packing.pack(no_docs, TOKENIZER).count() == 0 and packing.pack(odd_docs, TOKENIZER).select("doc_id").where("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_under_binding_capacities(spark, sf_dir, rule):
    docs, cap = docs_of(spark, sf_dir), (2048, 6, 3_600_000)
    rows = packing.pack(docs.where("length(text) < 4000"), TOKENIZER, documents=cap[1], attention=cap[2], weights=(1.0, 0.5, 0.5), rule=rule).toPandas()
    seq = rows.groupby("sequence_id").agg(tokens=("length", "sum"), n=("length", "size"), cost=("length", lambda v: (v**2).sum()))
    assert (seq["tokens"] <= cap[0]).all() and (seq["n"] <= cap[1]).all() and (seq["cost"] <= cap[2]).all() and seq["n"].max() == cap[1]
    least = max(-(-rows["length"].sum() // cap[0]), -(-len(rows) // cap[1]), -(-int((rows["length"] ** 2).sum()) // cap[2]))
    assert len(seq) <= 1.25 * least + 1
    with pytest.raises(ValueError):
        packing.pack(docs, TOKENIZER, attention=10)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), min_size=1), st.sampled_from(["norm", "dot"]), st.integers(1, 12), st.integers(10_000, 20_000))
def test_bins_hold_every_piece(counts, rule, documents, attention):
    bins = packing.best_fit(counts, (100, documents, attention), rule=rule)
    held = Counter()
    for contents, n in bins:
        assert sum(l * q for l, q in contents) <= 100 and sum(q for _, q in contents) <= documents and sum(l * l * q for l, q in contents) <= attention
        held.update({l: 0 for l, _ in contents})
        for l, q in contents:
            held[l] += q * n
    assert held == Counter(counts)


def test_ids_are_the_library_s():
    own, rnd = encoder(TOKENIZER), random.Random(1)
    parts = ["a", " ", "  ", "\n", " \n", "\t", "<|endoftext|>", "é", "'s", "12", "\x1c", "!", "日本", " "]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert own.one(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.one("x" * 50_000)) == len(own.tokenizer.encode("x" * 50_000).ids)
    for at in range(0x20, 0x32400, 0x40):  # every code point between letters and spaces
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}" for c in range(at, at + 0x40) if not 0xD800 <= c < 0xE000)
        assert own.one(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, hex(at)


# 3
def test_quality(spark, sf_dir, odd_docs, no_docs):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["held_out"] == held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held["predicted"] == held["quality"]).mean() > 0.97 and got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    more = spark.createDataFrame([(1, None, "a"), (None, 1, "b"), (2, 7, "c"), (3, 1, "d"), (99, 0, "e")], "doc_id long, quality int, x string")
    assert quality.classify(odd_docs, more).count() == odd_docs.count() and quality.classify(no_docs, labels).count() == 0 and quality.classify(odd_docs, more.limit(0)).where("score IS NULL").count() == 0


def test_quality_is_brute_force(spark, sf_dir):
    """Scores again from explicit covariances, their inverses and determinants."""
    docs, labels = docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    x = {r["doc_id"]: np.array(quality.statistics((r["text"] or "").encode())) for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    own = [np.array([x[i] for i in x if y.get(i) == k and zlib.crc32(str(i).encode()) % 4 != 2]) for k in (0, 1)]
    cov, mean = [np.cov(v.T, bias=True) for v in own], [v.mean(axis=0) for v in own]
    n = [len(v) for v in own]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    prior = (n[1] + 1) / (sum(n) + 2)
    for k in (0, 1):
        c = 0.4 * cov[k] + 0.6 * pooled
        cov[k] = 0.98 * c + 0.02 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
    density = lambda v, k: -0.5 * ((v - mean[k]) @ np.linalg.inv(cov[k]) @ (v - mean[k]) + np.linalg.slogdet(cov[k])[1])
    for r in quality.classify(docs, labels).collect():
        v = x[r["doc_id"]]
        z = (density(v, 1) - density(v, 0) + np.log(prior / (1 - prior))) / 4.0
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -500, 500))), abs=1e-6)


# 4
def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def test_base_spans(spark, sf_dir):
    rnd = random.Random(2)
    parts = ["a@b.c", "@", ".", "x_y@z.de", "1.2.3.4", "256.1.1.1", "008.1.2.3.4", "+1 (523) 555-1055", "+12", "+", " ", "-", "4485480221084675", "4485 4802-2108 4675", "é", "🙂", "1", "99", "(", ")", "@c.d_e@f.g", "\n", "%", "0000000000000000"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    texts = [r["text"] for r in docs_of(spark, sf_dir).collect()] + made + ["", None, "9" * 40_000, "a" * 40_000 + "@", "1 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    empty = {"trees": [], "rate": 1.0, "bars": [float("inf")] * 3}
    d = pii.detect(df, empty).select("doc_id", *[f"n_{k}" for k in pii.BASE], pii.listed(pii.by_kind(F.col("base"))).alias("s"), F.size("extra").alias("extra"))
    for r in d.collect():
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["s"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want), texts[r["doc_id"]][:200]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE] and r["extra"] == 0


def test_redaction_and_trees(spark, odd_docs, no_docs):
    rows = [(i, f"call +1 (523) 555-{1000 + i} or token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and x{i}@y.org then 10.0.0.{i % 250} end {'plain ' * (i % 5)}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    assert model["trees"] and len(model["bars"]) == 3
    for r in pii.redact(df, model).collect():
        assert r["text"].startswith("call <PHONE> or token = ") and "@" not in r["text"] and "<EMAIL> then <IP> end" in r["text"]
    for r in pii.detect(df, model).collect():
        spans = sorted((x["start"], x["end"]) for x in [*r["base"], *r["extra"]])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and len(r["base"]) == 3
    redacted = pii.redact(odd_docs, pii.fit(odd_docs))
    assert redacted.columns == odd_docs.columns and redacted.count() == odd_docs.count() and redacted.where("text IS NULL").count() == 1
    assert "mail <EMAIL>." in [r["text"] for r in redacted.where("doc_id = 1").collect()][0] and pii.redact(no_docs, pii.fit(no_docs)).count() == 0


def extra_of(spark, rows, model=None):
    """{doc_id: [(kind, text of the span)]} of the extra spans."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = model or pii.fit(df)
    return {r["doc_id"]: [(pii.KINDS[x["kind"]], r["text"][x["start"] : x["end"]]) for x in r["extra"]] for r in pii.detect(df, model).collect()}, model


def test_a_handful_of_secrets(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(200)]
    text = lambda i: f'token = "{hexes[i % 7]}" is set' if i % 20 == 0 else f"plain words and identifier_{i}_of_the_long_kind too"
    models = []
    for n in (40, 4000):
        got, model = extra_of(spark, [(i, text(i)) for i in range(n)])
        assert all(got[i] == ([("secret", hexes[i % 7])] if i % 20 == 0 else []) for i in range(n)), n
        models.append(model)
    one = [(i, text(i)) for i in range(400)]
    bars = [pii.fit(spark.createDataFrame(one * k, "doc_id long, text string"))["bars"] for k in (1, 30)]
    assert bars[0] == pytest.approx(bars[1]) and bars[0][2] < float("inf")  # the same shares, the same bars
    assert extra_of(spark, [(1, 'token = "' + hexes[9] + '"')])[0] == {1: [("secret", hexes[9])]}
    df = spark.createDataFrame([(1, f'token = "{hexes[9]}" is set')], "doc_id long, text string")
    assert pii.redact(df, pii.fit(df)).first()["text"] == 'token = "<SECRET>" is set'


def behind_a_word():
    """A model of one tree that takes what stands behind the word of its generator."""
    return {"trees": [(list(pii.FEATURES).index("before"), 0, -1.0, 1.0)], "rate": 1.0, "bars": [1.0] * 3}


def brute_extra(text):
    """Candidates behind a naming or calling word, clear of the base spans, the earliest first."""
    base, found = base_spans(text), []
    patterns = [r"(?<![^\s<>(),;:\"])[^\s<>(),;:\"@]{1,64}+@[^\s<>(),;:\"@]{1,255}+", r"(?<![0-9])[0-9]++(?:[\x20().-]{1,2}[0-9]++)*+", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"]
    naming = re.compile(r"(?i)(?:token|key|secret|passw(?:or)?d|credential)s?[\x20\"']{0,3}[=:][\x20\"']{0,3}$")
    calling = re.compile(r"(?i)(?<![A-Za-z])(?:tel(?:ephone)?|phone|call|fax|mobile|card|visa|iban|account|e?-?mail|contact)[^A-Za-z0-9]{0,4}$")
    for kind, pattern in zip(("address", "number", "secret"), patterns):
        last = 0
        for m in re.finditer(pattern, text):
            left = text[max(last, m.start() - 24) : m.start()]
            before = left if m.start() - last >= 24 else (text[: m.start()])[-24:]
            last = m.end()
            good = {"address": True, "number": len(re.sub("[^0-9]", "", m[0])) >= 7, "secret": bool(re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))}[kind]
            if good and not any(s < m.end() and m.start() < e for _, s, e in base) and (naming if kind == "secret" else calling).search(before):
                found.append((m.start(), m.end(), kind))
    out = []
    for s, e, kind in sorted(found, key=lambda x: (x[0], x[1], ("address", "number", "secret").index(x[2]))):
        if not out or out[-1][1] <= s:
            out.append((s, e, kind))
    return out


def test_extra_spans_are_brute_force(spark):
    rnd = random.Random(8)
    parts = ["tel ", "card: ", "mail ", "token = \"", "key=", "\" ", " ", "x", "é", "🙂", "0523 555 1055", "12.34.56.78", "1 (23) 4567-8901", "jürgen@exämple.de", "a@b.co", "+1 523 555 1055", "4485480221084675", hashlib.sha1(b"1").hexdigest(), "word_of_many_letters_1", ",", "\n", "telephone", "7"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(16))) for _ in range(4000)] + ["", None, "tel 0523 555 1055 " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = behind_a_word()
    n = 0
    for r in pii.detect(df, named).select("doc_id", "extra").collect():
        want = brute_extra(texts[r["doc_id"]] or "")
        assert [(x["start"], x["end"], pii.KINDS[x["kind"]]) for x in r["extra"]] == want, texts[r["doc_id"]]
        n += len(want)
    assert n > 500
    tags = {k: f"<{k.upper()}>" for k in pii.KINDS}
    for r in pii.redact(df, named).collect():
        text, out, at, spans = texts[r["doc_id"]], "", 0, []
        if text is None:
            assert r["text"] is None
            continue
        for s, e, k in sorted([(s, e, k) for k, s, e in base_spans(text)] + brute_extra(text), key=lambda x: (x[0], x[1], pii.KINDS.index(x[2]))):
            spans = [*spans[:-1], (spans[-1][0], max(spans[-1][1], e), spans[-1][2])] if spans and spans[-1][1] > s else [*spans, (s, e, k)]
        for s, e, k in spans:
            out, at = out + text[at:s] + tags[k], e
        assert r["text"] == out + text[at:], text


def test_recall_of_planted_variants(spark):
    """Variants of base spans, some behind a calling word, many not: almost all are taken once their format tells them."""
    rnd = random.Random(3)
    number = lambda: f"0{rnd.randrange(100, 999)} {rnd.randrange(100, 999)} {rnd.randrange(1000, 9999)}"
    address = lambda: f"{rnd.choice(['jörg', 'zoë', 'rené'])}.{rnd.randrange(99)}@bücher-{rnd.randrange(99)}.de"
    rows, planted = [], {}
    for i in range(4000):
        what, word = (number(), "tel") if i % 2 else (address(), "mail")
        if i % 4 < 2:
            planted[i] = what
            rows.append((i, f"plain words {word if rnd.random() < 0.98 else 'about'} {what} and more"))
        else:
            rows.append((i, f"plain words and {rnd.randrange(10)} of them"))
    got, _ = extra_of(spark, rows)
    caught = sum(any(t == planted[i] for _, t in got[i]) for i in planted)
    assert caught >= 0.95 * len(planted) and sum(bool(v) for i, v in got.items() if i not in planted) == 0


@pytest.mark.parametrize("bare", [0.1, 0.5, 0.6])
def test_recall_of_variants_without_a_word(spark, bare):
    """Numbers and addresses of which ``bare`` have no word before them: at least 0.9 of those are taken, at a precision of 0.95, and none without the trees."""
    rnd = random.Random(5)
    number = lambda: f"0{rnd.randrange(100, 999)} {rnd.randrange(100, 999)} {rnd.randrange(1000, 9999)}"
    address = lambda: f"{rnd.choice(['jörg', 'zoë', 'rené'])}.{rnd.randrange(99)}@bücher-{rnd.randrange(99)}.de"
    secret = lambda: hashlib.sha1(str(rnd.random()).encode()).hexdigest()
    rows, planted, unworded = [], {}, set()
    for i in range(4000):
        (what, word), plain = ((number(), "tel "), (address(), "mail "), (secret(), "key: "))[i % 3], rnd.random() < bare
        if i % 2:
            planted[i] = what
            unworded |= {i} if plain else set()
            rows.append((i, f"plain words {'about ' if plain else word}{what} and more"))
        else:
            decoy = (f"{rnd.randrange(10**6, 10**7)} of them", f"an_identifier_{rnd.randrange(99)}_of_the_long_kind", f"{rnd.randrange(10**15, 10**16)} such", f"x{secret()}x")[i // 2 % 4]
            rows.append((i, f"plain words and {decoy}, call +1 (523) 555-{rnd.randrange(1000, 9999)} or a{i}@b.co"))
    got, model = extra_of(spark, rows)
    caught = sum(any(t == planted[i] for _, t in got[i]) for i in unworded)
    taken = sum(len(v) for v in got.values())
    right = sum(any(t == planted[i] for _, t in got[i]) for i in planted)
    assert max(model["bars"]) < float("inf") and caught >= 0.9 * len(unworded) and right >= 0.95 * len(planted) and right >= 0.95 * taken
    assert not any(extra_of(spark, rows, model | {"trees": []})[0].values())


def test_trees_and_bars_decide_on_the_given_table(spark, sf_dir):
    docs = docs_of(spark, sf_dir.replace("sf0.001", "sf0.01"))  # the smallest table has no secret
    model = pii.fit(docs)
    n = lambda m: pii.detect(docs, m).agg(F.sum(F.size("extra"))).first()[0]
    assert max(model["bars"]) < float("inf") and n(model) > 0 and n(model | {"trees": []}) == 0
    whole = {r["doc_id"]: r for r in pii.detect(docs, model).drop("text").collect()}
    assert {r["doc_id"]: r for r in pii.detect_all(docs).collect()} == whole


def test_the_trees_are_fitted_on_every_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit_spans", lambda d, **_: seen.append(d.count()) or {"trees": [], "rate": 0.3, "bars": [1.0] * 3})
    monkeypatch.setattr(pii, "found", lambda docs: docs.withColumns({k: F.array().cast(f"array<{pii._SPAN}>") for k in pii.BASE} | {"cand": F.array().cast(f"array<{pii._CANDIDATE}>")}))
    docs = spark.range(130_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert pii.detect_all(docs).count() == 130_000 and seen == [130_000]


def test_a_text_of_very_many_spans_takes_linear_time(spark, tmp_path):
    import time

    named = behind_a_word()
    took = {}
    for n in (2_500, 20_000):
        spark.createDataFrame([(1, "1.2.3.4 x, tel 0523 555 1055; " * n)], "doc_id long, text string").write.parquet(str(tmp_path / str(n)))
        df, at = spark.read.parquet(str(tmp_path / str(n))), time.time()
        r = pii.detect(df, named).select("n_ip", F.size("extra").alias("extra")).first()
        assert (r["n_ip"], r["extra"]) == (n, n)
        assert pii.redact(df, named).first()["text"].count("<IP> x, tel <NUMBER>;") == n
        took[n] = time.time() - at
    assert took[20_000] < 60 and took[20_000] < 20 * max(took[2_500], 0.5)


def test_numbers_and_addresses_behind_calling_words(spark):
    rows = [(0, "tel 0523 555 1055 or so"), (1, "mail: jürgen@exämple.de now"), (2, "in 2023.10.11 555 1055 rows"), (3, "call +1 (523) 555-1055"), (4, "the hotel 0523 555 1055")]
    got, _ = extra_of(spark, rows + [(i, "many plain words, 1234567 of them") for i in range(5, 60)])
    assert [got[i] for i in range(6)] == [[("number", "0523 555 1055")], [("address", "jürgen@exämple.de")], [], [], [], []]


def test_candidates_of_a_telling_format_need_no_word(spark):
    rows = [(i, f"{'tel' if i % 300 else 'about'} 0523 555 {1000 + i} or so") for i in range(1, 3000)] + [(i, f"plain 1234567 words {i}") for i in range(3000, 4000)]
    got, model = extra_of(spark, rows)
    assert model["bars"][1] < float("inf") and all(got[i] == [("number", f"0523 555 {1000 + i}")] for i in range(1, 3000)) and not any(got[i] for i in range(3000, 4000))


# 5
def member_list(n=6):
    payloads = [bytes(f"<html>{'body ' * (50 * i)}{i} WARC/1.0\n\x1f\x8b\x08</html>", "latin-1") for i in range(n)]
    return payloads, [warc.record("response", f"urn:page:{i}", f"http://x/{i}", p, warc.sha1_base32(p)) for i, p in enumerate(payloads)]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("damage", ["none", "flip", "cut", "junk", "head", "lost", "end"])
@pytest.mark.parametrize("chunk", [37, 1 << 20])
def test_salvage(zipped, damage, chunk):
    payloads, records = member_list()
    parts = [warc.member(r) if zipped else r for r in records]
    whole = set(range(6))
    if damage == "flip":
        at = len(parts[2]) // 2 + 100
        parts[2] = parts[2][:at] + bytes([parts[2][at] ^ 0x55]) + parts[2][at + 1 :]
        whole -= {2}
    elif damage == "cut":
        parts[2] = parts[2][: len(parts[2]) - 30]
        whole -= {2}
    elif damage == "junk":
        parts.insert(2, b"some junk \x1f\x8b\x08 with false starts\n" * 3)
    elif damage == "head":
        parts[0] = parts[0][5:]
        whole -= {0}
    elif damage == "lost":
        parts[3] = b""
        whole -= {3}
    elif damage == "end":
        parts[5] = parts[5][:40]
        whole -= {5}
    data = b"".join(parts)
    got = list(warc.salvage(io.BytesIO(data).read, "p", chunk=chunk))
    found = {int(r["record_id"].rsplit(":", 1)[1]): r["payload"] for r in got if r.get("warc_type")}
    assert found == {i: payloads[i] for i in whole}
    ends = [(r["at"], r["end"]) for r in got]
    assert ends[0][0] == 0 and ends[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert any(not r.get("warc_type") for r in got) == (damage not in ("none", "lost"))


@pytest.mark.parametrize("damaged", [None, 0, 1, 2])
@pytest.mark.parametrize("chunk", [37, 1 << 20])
def test_salvage_of_a_member_of_many_records(damaged, chunk):
    payloads, records = member_list()
    inner = records[1:4]
    if damaged is not None:
        at = inner[damaged].index(b"body") + 1
        inner[damaged] = inner[damaged][:at] + b"X" + inner[damaged][at + 1 :]
    many = warc.member(b"".join(inner) + b"left over")
    data = warc.member(records[0]) + many + warc.member(records[5])
    got = list(warc.salvage(io.BytesIO(data).read, "p", chunk=chunk))
    found = {int(r["record_id"].rsplit(":", 1)[1]): r["payload"] for r in got if r.get("warc_type")}
    assert found == {i: payloads[i] for i in (0, 1, 2, 3, 5) if damaged is None or i != damaged + 1}
    gaps = [r["problem"] for r in got if not r.get("warc_type")]
    size = sum(map(len, inner))
    if damaged is not None:
        begun, end = sum(map(len, inner[:damaged])), sum(map(len, inner[: damaged + 1]))
        # a false version line in the damaged payload may end the search only where a record follows
        assert gaps[0] == f"payload digest differs (content {begun} to {end if damaged < 2 else size + 9})"
    assert len(gaps) == (2 if damaged in (0, 1) else 1) and gaps[-1].endswith(f"to {size + 9})")
    assert all((r["at"], r["end"]) == (len(warc.member(records[0])), len(warc.member(records[0])) + len(many)) for r in got[1:-1])


def test_warc_round_trip(spark, sf_dir):
    odd = spark.createDataFrame([(1, "u\r\nx", "a", 1), (2, None, "a", 1), (3, "w", None, 1), (4, "w", "", 1), (5, "w", "é🙂", 1), (None, "n", "a", 1), (7, "w", "big " * 100_000, 1)], "page_id long, url string, html string, refers_to int")
    got = {r["page_id"]: r for r in warc.round_trip(odd).collect()}
    assert [(i, got[i]["record_type"], got[i]["refers_to"]) for i in (None, 1, 2, 3, 4, 5, 7)] == [(None, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (7, "response", None)]
    assert (got[5]["payload_bytes"], got[5]["payload_digest"]) == (6, warc.sha1_base32("é🙂".encode())) and got[3]["payload_bytes"] == 0 and got[1]["payload_bytes"] == 1
    gaps = spark.createDataFrame([(str(sf_dir), 0, 5, None, "cut"), ("p", 5, 9, "response", "")], "path string, at long, end long, warc_type string, problem string")
    assert [tuple(g) for g in warc.quarantined(gaps).collect()] == [(str(sf_dir), 0, 5, "cut")]
    assert warc.round_trip(odd.limit(0)).count() == 0 and warc.round_trip(odd, least=10).where("record_type = 'revisit'").count() == 0


# 6
@pytest.mark.parametrize("options", [{}, {"huge": 50}, {"primes": (5,), "bases": (2,)}, {"primes": (5,), "bases": (2,), "huge": 50}])
def test_exact_dedup(spark, sf_dir, odd_docs, no_docs, options):
    docs = docs_of(spark, sf_dir).select("doc_id", "text").where("doc_id < 60").unionByName(odd_docs.select("doc_id", "text").where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = [(r["doc_id"], WHITE.sub(" ", r["text"] or "")) for r in docs.collect()]
    want = []
    for i, n in rows:
        group = [j for j, m in rows if m == n]
        want.append((i, min(group), len(group), i == min(group), hashlib.sha256(n.encode()).hexdigest()))
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, **options).collect())) == sorted(want)
    kept = exact_dedup.drop_exact_copies(odd_docs, **options)
    # blank texts normalise to one space, null to the empty text; the rows of doc 2 share their fate
    assert kept.columns == odd_docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8, 9, 10, 11, 13]
    assert exact_dedup.drop_exact_copies(no_docs, **options).count() == 0


@pytest.mark.parametrize("options", [{}, {"huge": 4}, {"primes": (2,), "bases": (3,)}])
@pytest.mark.parametrize("doc", [None, 5])
def test_exact_dedup_of_one_id_with_many_texts(spark, options, doc):
    df = spark.createDataFrame([(doc, t) for t in ("text A", "text A", "text B", "text B", "text C")], "doc_id long, text string")
    got = sorted((r["text_sha256"], r["group_size"], r["keep_id"]) for r in exact_dedup.exact_groups(df, **options).collect())
    assert got == sorted((hashlib.sha256(f"text {t}".encode()).hexdigest(), n, doc) for t, n in (("A", 2), ("A", 2), ("B", 2), ("B", 2), ("C", 1)))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 400))
def test_fingerprints_compose(data, at):
    a, b = data[:at], data[at:]
    whole = exact_dedup.combine(exact_dedup.chunk_hash(a), exact_dedup.chunk_hash(b), len(b))
    assert b"".join(h.to_bytes(4, "big") for h in whole) == exact_dedup.fingerprint(data)
    value = 0
    for x in data:
        value = (value * exact_dedup.BASES[0] + x) % exact_dedup.PRIMES[0]
    assert whole[0] == value and exact_dedup.normalise(data) == re.sub(rb"[\x20\x09-\x0D]+", b" ", data)


# 7
def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"])[got["held_out"]].mean() > 0.98 and got["score"].between(0, 1).all()
    model = langid.learn(odd_docs)
    r = {x["doc_id"]: x for x in langid.identify(odd_docs, model).collect()}
    assert all(r[i]["lang_pred"] == "und" and r[i]["score"] == 0 and not r[i]["spans"] for i in (3, 4, 5, 6, 12, 13))
    assert r[10]["lang_pred"] == "ja" and r[11]["lang_pred"] == "ru" and r[7]["lang_pred"] == "la" and r[1]["spans"][0]["start"] == 0
    assert langid.keep_identified(odd_docs, model).columns == odd_docs.columns and langid.identify(no_docs, langid.learn(no_docs)).count() == 0
    assert langid.identify(odd_docs, langid.learn(no_docs)).where("lang_pred <> 'und'").count() == 0


def test_letters_of_all_planes(spark):
    docs = spark.createDataFrame([(1, "\U00030000" * 5, "zh"), (2, "\U000e0100 12", "zh"), (3, "\U0001e900\U0001e901", "ff")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert got == {1: "zh", 2: "und", 3: "ff"}


def test_language_is_brute_force(spark):
    """Model and labels once more with dicts and loops; the path by trying each switch."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").limit(60).select("doc_id", "text", "lang")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def words(text):
        low = lambda c: 0 if not unicodedata.category(c).startswith("L") else ord(c.lower() if len(c.lower()) == 1 else c)
        for m in re.finditer(r"[^\W\d_]+", text):
            assert all(low(c) for c in m[0])
            v = [0, *map(low, m[0]), 0]
            out = []
            for a, b, c in zip(v, v[1:], v[2:]):
                x = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
                out.append(((x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17)
            yield m, out

    def script(c):
        return next((name for a, b, name in langid.SCRIPTS if a <= ord(c) <= b), "other")

    counts, scripts = {}, {}
    for _, text, lang in rows:
        for m, tri in words(text or ""):
            counts.setdefault(lang, Counter()).update(tri)
            scripts.setdefault(lang, Counter()).update(map(script, m[0]))
    langs = sorted(counts)
    used = len({t for c in counts.values() for t in c}) + 1
    logp = {l: (lambda t: math.log((counts[l][t] + 0.5) / (sum(counts[l].values()) + 0.5 * used))) for l in langs}
    logp = {l: (lambda t, l=l: math.log((counts[l][t] + 0.5) / (sum(counts[l].values()) + 0.5 * used))) for l in langs}
    allowed = lambda l, s: scripts[l][s] >= 1e-3 * sum(scripts[l].values()) or not any(scripts[k][s] >= 1e-3 * sum(scripts[k].values()) for k in langs)
    model, checked = langid.learn(docs), 0
    assert model["langs"] == langs
    for r in langid.identify(docs, model).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        got = [(m, {l: sum(map(logp[l], tri)) + (0 if allowed(l, script(m[0][0])) else -1e4) for l in langs}) for m, tri in words(text or "")]
        if not got:
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        value, path = {l: (got[0][1][l], (l,)) for l in langs}, None
        for _, s in got[1:]:
            value = {l: max(((value[k][0] - 12 * (k != l) + s[l], (*value[k][1], l)) for k in langs), key=lambda x: x[0]) for l in langs}
        path = max(value.values(), key=lambda x: x[0])[1]
        letters = Counter()
        for (m, _), l in zip(got, path):
            letters[l] += len(m[0])
        top = max(letters.values())
        assert r["score"] == pytest.approx(top / sum(letters.values()), abs=1e-6) and letters[r["lang_pred"]] == top
        checked += 1
    assert checked > 40


def test_mixed_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    a, b = (docs.where(f"lang = '{x}' AND length(text) BETWEEN 300 AND 900").first()["text"] for x in ("en", "de"))
    text = a + "\n" + b
    lang, score, spans = langid.label(text, model)
    assert [s[0] for s in spans] == ["en", "de"] and abs(spans[1][1] - len(a)) < 20 and 0.2 < score < 0.9 and lang in ("en", "de")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 4), st.floats(0, 5))
def test_viterbi_is_best(seed, n, k, penalty):
    import itertools

    s = np.random.default_rng(seed).normal(size=(n, k)) * 3
    value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - penalty * sum(x != y for x, y in zip(p, p[1:]))
    assert value(langid.viterbi(s, penalty)) == pytest.approx(max(map(value, itertools.product(range(k), repeat=n))))


# 8
def brute_fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf_dir, odd_docs, no_docs):
    docs = docs_of(spark, sf_dir).select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    fps = np.array([f for _, f in rows], dtype=np.uint64)
    root = union_roots(len(rows), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4))
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = [(i, format(f, "016x"), least[root[k]]) for k, (i, f) in enumerate(rows)]
    assert sorted(map(str, map(tuple, simhash.near_groups(docs).collect()))) == sorted(map(str, want))
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id IN (4, 5, 12)").count() == 0 and simhash.drop_near_copies(no_docs).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 9))
def test_bk_search_finds_every_link(seed, radius):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, 8, dtype=np.uint64)[rng.integers(0, 8, 200)]
    for _ in range(rng.integers(1, 8)):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    x, found = np.unique(x), set()
    simhash.bk_links(x, np.zeros(len(x), dtype=int), radius, block=64, found=lambda a, b: found.update(zip(a.tolist(), b.tolist())))
    assert found == {(i, j) for i, j in np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius).tolist() if i > j}


def test_tiles_and_block_plans(spark):
    rng = np.random.default_rng(1)
    x = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    links = [tuple(r) for r in simhash.fingerprint_links(fps, 4, tile=50).collect()]
    index = {int(v): i for i, v in enumerate(x.view(np.int64))}
    assert len(set(union_roots(len(x), [index[a] for a, _ in links], [index[b] for _, b in links]))) == 1
    for n in (10, 10**6, 10**9):
        masks = simhash.plan_blocks(n, 4)
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(diff & m == 0 for m in masks)


# near copies of the pipeline
def brute_similar(texts, bar=0.8):
    """Links (i, j) of the texts whose sets of five-word shingles have a Jaccard similarity of at least ``bar``."""
    sets = []
    for text in texts:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    sizes = [len(s) for s in sets]
    return [(i, j) for i in range(len(sets)) for j in range(i) if min(sizes[i], sizes[j]) >= bar * max(sizes[i], sizes[j]) - 1e-9 and (sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= bar)]


def test_near_copies_by_jaccard(spark, monkeypatch):
    rnd = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    for k in range(40):  # chains of edits, many to one source, about the bar; a common line in all
        words = [f"w{k % 5}_{i}" for i in range(60)]
        for _ in range(k // 5):
            words[rnd.randrange(60)] = f"v{rnd.randrange(1000)}"
        texts.append("This line stands in each of these texts as it is. " * (k % 2) + " ".join(words))
    root = union_roots(len(texts), *np.array(brute_similar(texts)).T)
    assert len(set(root)) < len(texts) - 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for often, group, tile, hot in ((5, 32, 2000, 200_000), (10**9, 3, 4, 200_000), (5, 2, 3, 6), (5, 10**6, 2000, 10**9)):
        for name, value in (("OFTEN", often), ("GROUP", group), ("TILE", tile), ("HOT", hot)):
            monkeypatch.setattr(jaccard, name, value)
        assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == sorted(set(root))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 9000), st.integers(0, 9000), st.integers(0, 9000))
def test_sketches_bound_the_difference(seed, common, own, other):
    x = np.random.default_rng(seed).integers(0, 2**64, common + own + other, dtype=np.uint64)
    a, b = np.unique(x[: common + own]), np.unique(np.concatenate([x[:common], x[common + own :]]))
    x, y = jaccard.sketch(a), jaccard.sketch(b)
    assert jaccard.sketch_distance(x, y) <= len(np.setxor1d(a, b))
    words, folded = jaccard.folded_sketches([x, y])
    left, right = folded[int(words.min())]
    assert words.tolist() == [len(x) // 8, len(y) // 8] and np.bitwise_count(left ^ right).sum() == jaccard.sketch_distance(x, y)


def test_nearest_pairs_of_each_root(monkeypatch):
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    root, x, y = np.array([0, 0, 2, 3]), np.array([0, 1, 0, 2]), np.array([2, 2, 3, 3])
    assert jaccard._nearest(root, x, y, np.array([5, 4, 9, 7])).tolist() == [1, 3]  # roots 0 and 2 by the second, 3 by the last
    assert len(jaccard._nearest(root, x[:0], y[:0], x[:0])) == 0


def test_sets_that_share_a_key_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, 100), (2, 7, 100), (3, 7, 200), (4, 8, 100), (None, 8, 100)], "doc_id long, key long, mark long")
    got = {r["doc_id"]: r["key"] for r in jaccard._told_apart(rows).collect()}
    assert got[1] == got[2] != got[3] and got[1] != 7 and got[4] == got[None] == 8
    assert jaccard._told_apart(rows.where("doc_id = 4")).columns == ["doc_id", "key"] and jaccard._told_apart(rows.limit(0)).count() == 0
    key, mark = jaccard._key(np.array([1, 2, 3], dtype=np.uint64))
    assert -(2**63) <= key < 2**63 and -(2**63) <= mark < 2**63 and key != mark


def test_near_stage_by_jaccard(spark, sf_dir):
    rows = docs_of(spark, sf_dir).orderBy("doc_id").collect()
    root = union_roots(len(rows), *np.array(brute_similar([r["text"] for r in rows])).T)
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs_of(spark, sf_dir), sf_dir).collect()}
    assert kept == {rows[i]["doc_id"] for i in set(root)} and 177 not in kept


def test_near_copies_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (None, a + " x"), (None, b), (None, c), (2, a + " y"), (2, "a text of its own")]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, a), (None, b), (None, c), (2, "a text of its own")]))


# 9
def test_separator_scan(spark, sf_dir, odd_docs, no_docs, tmp_path):
    docs = docs_of(spark, sf_dir).select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10**6))
    own = encoder(TOKENIZER, plain_special=True)
    want = sorted((r["doc_id"] or 0, len(own.one(r["text"] or ""))) for r in docs.collect())
    for block in (64, 1 << 20):
        assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in sepscan.token_counts(docs, TOKENIZER, 50256, block=block).collect()) == want
    assert sepscan.token_counts(no_docs, TOKENIZER, 50256).count() == 0
    for k, ids in enumerate(([], [9], [1, 2], [9, 9, 1, 9], [1] * 40 + [9] + [2] * 33)):
        (tmp_path / f"{k}.bin").write_bytes(struct.pack(f"<{len(ids)}H", *ids))
        files = spark.createDataFrame([(7, f"file://{tmp_path}/{k}.bin", 2 * len(ids))], "file long, path string, bytes long")
        runs, at = [], 0
        for i, x in enumerate([*ids, 9] if ids and ids[-1] != 9 else ids):
            if x == 9:
                runs, at = [*runs, i - at], i + 1
        for block in (2, 8, 1 << 20):
            assert [r["n_tokens"] for r in sepscan.count_tokens(files, 9, block=block).orderBy("ordinal").collect()] == runs


# 10
def test_sentencepiece(spark, sf_dir, odd_docs, no_docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    theirs, own, rnd = sentencepiece.SentencePieceProcessor(model_file=path), sp_codec.Codec(path), random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "é", "'s", "12", "▁", "!", "日本", "🙂", "\x00", "the", "</s>", "<unk>", "<0x41>", "ö"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(3000)] + [r["text"] for r in docs_of(spark, sf_dir).collect()]
    ids = own.encode(texts)
    assert ids == theirs.encode(texts) and [own.decode(i) for i in ids] == theirs.decode(ids)
    assert sp_codec.round_trip(odd_docs, path).where("NOT text_back").count() == 0 and sp_codec.round_trip(no_docs, path).count() == 0
    encoded = sp_codec.encode(odd_docs, path)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in sp_codec.decode(encoded, path).collect()))) == sorted(map(str, ((r["doc_id"], r["text"] or "") for r in odd_docs.collect())))


def test_unigram_model():
    """A small unigram model written by hand: the best path under the scores, bytes for unknown characters."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])
    piece = lambda t, s, k=1: b"\x0a" + varint(len(b := b"\x0a" + varint(len(t.encode())) + t.encode() + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k]))) + b
    pieces = [("<unk>", 0, 2), *[(f"<0x{i:02X}>", -20, 6) for i in range(256)], ("▁", -3), ("▁a", -2), ("b", -3), ("ab", -2.5), ("▁ab", -6), ("c", -4)]
    data = b"".join(piece(*p) for p in pieces) + b"\x12\x05\x18\x01\x98\x02\x01"
    model = sp_codec.parse_model(data)
    assert model["kind"] == sp_codec.UNIGRAM and model["byte_fallback"] and len(model["pieces"]) == len(pieces)
    names = [p[0] for p in pieces]
    show = lambda t: [names[i] for i in sp_codec.build(model).encode(t).ids]
    assert show("abc") == ["▁a", "b", "c"] and show("a") == ["▁a"] and show("aé") == ["▁a", "<0xC3>", "<0xA9>"]


# the pipeline
def test_pipeline(spark, sf_dir, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "pii", "packing"] and "pipeline" in entry.queries()
    docs = docs_of(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
    packed = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs_of(spark, sf_dir).collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(WHITE.sub(" ", texts[i]), i)
    survivors = sorted(i for i in first.values() if any(c.isalpha() for c in texts[i]))
    links = brute_similar([texts[i] for i in survivors])
    root = union_roots(len(survivors), *np.array(links).T)
    assert links and set(packed["doc_id"]) == {survivors[i] for i in set(root)}
    for table in (odd_docs, no_docs):
        d = table
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, sf_dir)
        assert (d.count() > 0) == (table is odd_docs)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(name, spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = c.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, sf_dir).toPandas()
    cell = lambda x: "null" if x is None or str(x) in ("<NA>", "nan", "None") else str(int(x)) if isinstance(x, (float, int, np.integer)) and not isinstance(x, bool) else str(x)
    rows = lambda d: sorted(tuple(cell(x) for x in r) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_near_copies_come_through_the_trees(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, links = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda fps, radius=4, **k: seen.append((fps.count(), radius)) or links(fps, radius, **k))
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == [0, 2] and seen == [(3, 4)]
    sets = spark.createDataFrame([(1, 0), (2, 0), (3, 15), (4, -1)], "key long, fp long")
    assert {(r["a"], r["b"]) for r in simhash.fingerprint_pairs(sets).collect()} == {(1, 2), (1, 3)}
