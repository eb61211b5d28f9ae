"""All pairs of texts whose sets of word shingles have a Jaccard similarity of at least a bar, by prefix filtering.

Under any fixed order of all shingles two such sets share one of their first ``n - ceil(bar * n) + 1`` shingles, so gathering
the sets by these prefixes loses no pair. The order puts shingles that are frequent in a sample last, which keeps the
prefixes rare; the sample decides on the cost only, never on the result. It is a share of the corpus and not a number of
documents, so that shingles of the same count are told as frequent at every size. Equal sets are one node.

The sets that share a prefix shingle are a group. Small groups give all their pairs that sizes and places allow. In a large
group every set is first paired with one of the group only, so that a large cluster of copies costs a star; then
each component proposes only its nearest pairs with others; at last all pairs of sets that are still in different components
are formed, in tiles. So what is left to the last step are components that are apart. A pair goes through a sketch, the parities of its shingles'
counts in some buckets, of which two sets differ in no more places than in shingles: this rejects most pairs with certainty,
those of large groups before they leave their tile. Only what is left is checked on the whole sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, small_side, written
from .graph import components

SEED = 42
SAMPLE = (5000, 0.1)  # documents whose shingles are counted for the order: a number, or a share where that is more
OFTEN = 5
MOST_OFTEN = 1_000_000  # frequent shingles that are kept
TEXTS = 1000  # whole texts in an Arrow batch
GROUP = 32  # sets of a group that are paired one with another at once
TILE = 2000  # sets of a group that one task pairs
HOT = 200_000  # documents of a shingle from which on its group is dealt out in parts
SEEN = 2000  # of so many documents as HOT that are counted
ROUNDS = 1  # in which components of large groups propose their nearest pairs before all pairs are formed
NEAREST = 3  # pairs that a component proposes in a tile
SKETCH_BITS = (1024, 4096)  # least and most bits of a sketch


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    text = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends, digest = (ends - sizes).tolist(), ends[width - 1 :].tolist(), xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(text[i:j], SEED) for i, j in zip(starts, ends)]), dtype=np.uint64))


def _key(shingles: np.ndarray) -> tuple[int, int]:
    """The key and the mark of a set: two halves of one 128-bit hash."""
    both = xxhash.xxh3_128_intdigest(shingles.tobytes(), SEED)
    return (both & (1 << 64) - 1) - (1 << 63), (both >> 64) - (1 << 63)


def set_fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set as a signed long: a bit is 1 if it is set in over half of the shingles."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), 65536):
        counts += np.unpackbits(shingles[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big", signed=True)


def prefix(shingles: np.ndarray, similarity: float, often: np.ndarray) -> np.ndarray:
    """The first shingles of the set; the frequent ones (``often``, sorted) come last."""
    n = len(shingles)
    late = np.zeros(n, dtype=bool)
    if len(often):
        late = often[np.minimum(np.searchsorted(often, shingles), len(often) - 1)] == shingles
    ordered = np.concatenate([shingles[~late], shingles[late]])
    return ordered[: n - math.ceil(similarity * n - 1e-9) + 1] if n else ordered


def sketch(shingles: np.ndarray) -> bytes:
    """Bit i is the parity of the number of shingles in bucket i; the number of buckets, a power of two, follows the set's size."""
    low, high = SKETCH_BITS
    bits = low
    while bits < high and bits < 1.5 * len(shingles):
        bits *= 2
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles that only one of the two sets has; the larger sketch is folded to the size of the smaller."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def folded_sketches(sketches) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(64-bit words of each sketch, {words: all sketches of at least that size, folded to it; the rows of smaller ones are zero})."""
    own = np.fromiter((len(s) // 8 for s in sketches), dtype=np.int64, count=len(sketches))
    folded, last = {}, None
    words = SKETCH_BITS[1] // 64
    while words >= SKETCH_BITS[0] // 64:
        now = np.zeros((len(own), words), dtype=np.uint64)
        if last is not None:
            now[own > words] = (last[:, :words] ^ last[:, words:])[own > words]
        if (own == words).any():
            now[own == words] = np.frombuffer(b"".join(s for s in sketches if len(s) == 8 * words), dtype=np.uint64).reshape(-1, words)
        folded[words] = last = now
        words //= 2
    return own, folded


def text_sha(docs: DataFrame) -> Column:
    return F.sha2(_text(docs), 256)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")


def _often(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles frequent in a sample, sorted, at most ``MOST_OFTEN``."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py(), width) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], ["t"])

    least, part = SAMPLE
    share = min(1.0, max(least / max(docs.count(), 1), part))
    counted = docs.sample(share, SEED).select(_text(docs).alias("text")).mapInArrow(run, "t long").groupBy("t").count()
    top = counted.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "t").limit(MOST_OFTEN).select("t").toPandas()
    return np.sort(top["t"].to_numpy(dtype=np.int64).view(np.uint64))


def _rows(docs: DataFrame, width: int, similarity: float, often: np.ndarray) -> DataFrame:
    """(doc_id, sha, key, mark, n, prefix, sketch, fp) of each row; key and mark stand for the set of ``n`` shingles, fp is its fingerprint."""

    def run(batches):
        for batch in batches:
            shas, keys, marks, sizes, firsts, sketches, fps = [], [], [], [], [], [], []
            for text in batch.column(1):
                data = text.as_py()
                own = shingle_set(data, width)
                shas.append(hashlib.sha256(data).hexdigest())
                key, mark = _key(own)
                keys.append(key)
                marks.append(mark)
                sizes.append(len(own))
                firsts.append(prefix(own, similarity, often).view(np.int64))
                sketches.append(sketch(own))
                fps.append(set_fingerprint(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string()), pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(fps, pa.int64())], ["doc_id", "sha", "key", "mark", "n", "prefix", "sketch", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(docs).alias("text")).mapInArrow(run, "doc_id long, sha string, key long, mark long, n long, prefix array<long>, sketch binary, fp long")


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with keys that are equal for equal sets only: sets that share a key, but not its mark, get keys made of both."""
    marks = rows.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    shared = written(marks.where("low <> high").select("key", F.lit(True).alias("shared")), "shared-keys")
    if shared.isEmpty():
        return rows.drop("mark")
    apart = rows.join(shared, "key", "left").withColumn("key", F.when(F.col("shared"), F.xxhash64("key", "mark")).otherwise(F.col("key")))
    return written(apart.drop("mark", "shared"), "told-apart")


def _possible(n, m, at, to, similarity: float):
    """Whether the sizes, and what follows the places of the common shingle, leave room for the similarity; over arrays."""
    return np.minimum(n - at, m - to) + 1e-6 >= (n + m) * (similarity / (1 + similarity))


def _grouped(batches, columns: list[str], keys: list[str]):
    """The columns of all batches as arrays, ordered by ``keys``, and the bounds of the runs of equal keys; None for no rows."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return None
    table = pa.Table.from_batches(batches)
    cols = {c: table.column(c).to_numpy() for c in columns}
    order = np.lexsort([cols[c] for c in reversed(keys)])
    cols = {c: v[order] for c, v in cols.items()}
    return cols


def _starts(cols: dict, keys: list[str]) -> np.ndarray:
    new = np.ones(len(cols[keys[0]]), dtype=bool)
    new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in keys], axis=0)
    return np.flatnonzero(new)


_FOUND = ["kind", "a", "b", "n", "at"]
PAIR, MEMBER, LEAD = 0, 1, 2


def _unique_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    x, y = (np.concatenate([np.empty(0, np.int64), *v]) for v in (a, b))
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)


def _batch(kind: int, a, b, n=None, at=None):
    zero = np.zeros(len(a), dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b), pa.array(zero if n is None else n), pa.array(zero if at is None else at)], _FOUND)


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """What the groups give, as rows (kind, a, b, n, at).

    PAIR: the keys of two sets; MEMBER: of a large group, whose shingle is b, the set a with its size and the shingle's place;
    LEAD: the same of the one set that a part of a group was paired with. A shingle that stands in very many prefixes has its
    group dealt out in parts, so that no task gets all of it. Such shingles are counted over a share of the prefixes that
    shows each of them about ``SEEN`` times, however large the table is; the count decides on the cost only.
    """
    entries = rows.select(F.posexplode("prefix").alias("at", "t"), "key", F.col("n").cast("int").alias("n"))
    sets, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()
    if sets > HOT:
        share = min(1.0, SEEN / HOT)
        counted = rows.sample(share, SEED).select(F.explode("prefix").alias("t")).groupBy("t").count()
        parts = counted.where(F.col("count") > share * HOT).select("t", F.floor(F.col("count") / (share * HOT) + 1).cast("int").alias("parts"))
        entries = entries.join(small_side(written(parts, "hot-shingles")), "t", "left")
    else:
        entries = entries.withColumn("parts", F.lit(None).cast("int"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("key"), F.col("parts"))).otherwise(-1).cast("int")

    def run(batches):
        cols = _grouped(batches, ["t", "part", "key", "n", "at"], ["t", "part", "key"])
        if cols is None:
            return
        keep = np.ones(len(cols["t"]), dtype=bool)  # equal sets count once
        keep[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in ("t", "part", "key")], axis=0)
        cols = {c: v[keep] for c, v in cols.items()}
        t, part, key, n, at = (cols[c] for c in ("t", "part", "key", "n", "at"))
        start = _starts(cols, ["t", "part"])
        size = np.diff(np.append(start, len(t)))
        left, right = [], []
        for g in np.unique(size[(size > 1) & (size <= GROUP)]):  # all groups of one size at once
            first = start[size == g]
            for i in range(g):
                for j in range(i + 1, g):
                    x, y = first + i, first + j
                    ok = _possible(n[x], n[y], at[x], at[y], similarity)
                    left.append(key[x[ok]])
                    right.append(key[y[ok]])
        large = (size > GROUP) | (part[start] >= 0)
        group = np.repeat(np.arange(len(start)), size)
        order = np.lexsort((key, n, group))
        lead = order[start][group]  # the smallest set of each group
        x = np.flatnonzero(large[group] & (lead != np.arange(len(t))))
        ok = _possible(n[x], n[lead[x]], at[x], at[lead[x]], similarity)
        left.append(key[x[ok]])
        right.append(key[lead[x[ok]]])
        pairs = _unique_pairs(left, right)
        for k in range(0, len(pairs), 100_000):
            yield _batch(PAIR, pairs[k : k + 100_000, 0], pairs[k : k + 100_000, 1])
        member = np.flatnonzero(large[group])
        for k in range(0, len(member), 100_000):
            m = member[k : k + 100_000]
            yield _batch(MEMBER, key[m], t[m], n[m], at[m])
        first = np.unique(lead[large[group] & (part >= 0)])
        if len(first):
            yield _batch(LEAD, key[first], t[first], n[first], at[first])

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 250_000)
    return entries.select("t", part.alias("part"), "key", "n", "at").repartition(tasks, "t", "part").mapInArrow(run, "kind int, a long, b long, n int, at int")


def _nearest(root: np.ndarray, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the ``NEAREST`` pairs (x, y) of least distance of each root."""
    ends, place = np.concatenate([root[x], root[y]]), np.tile(np.arange(len(x)), 2)
    order = np.lexsort((np.tile(apart, 2), ends))
    first = _starts({"end": ends[order]}, ["end"])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.unique(place[order][rank < NEAREST])


def _star(similarity: float):
    """Pairs of each set of a group t with the smallest one."""

    def run(batches):
        cols = _grouped(batches, ["t", "key", "n", "at"], ["t", "n", "key"])
        if cols is None:
            return
        start = _starts(cols, ["t"])
        lead = np.repeat(start, np.diff(np.append(start, len(cols["t"]))))
        key, n, at = (cols[c] for c in ("key", "n", "at"))
        ok = _possible(n, n[lead], at, at[lead], similarity) & (lead != np.arange(len(lead)))
        pairs = _unique_pairs([key[ok]], [key[lead[ok]]])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _paired(similarity: float, nearest: bool):
    """Pairs within groups (t, i, j) of sets of different roots, of different tiles where i < j, that their sketches leave
    possible; all of them, or the ``NEAREST`` ones of each root."""

    def run(batches):
        cols = _grouped(batches, ["t", "key", "n", "at", "root", "own", "i", "j", "sketch"], ["t", "i", "j", "n", "key"])
        if cols is None:
            return
        start = _starts(cols, ["t", "i", "j"])
        left, right, held = [], [], 0
        for s, e in zip(start, np.append(start[1:], len(cols["t"]))):
            key, n, at, root, own = (cols[c][s:e] for c in ("key", "n", "at", "root", "own"))
            crossed = cols["i"][s] != cols["j"][s]
            words, folded = folded_sketches(cols["sketch"][s:e])
            xs = ys = distances = np.empty(0, dtype=np.int64)
            for x in range(e - s):
                y = np.arange(x + 1, e - s)
                y = y[: np.searchsorted(n[y], n[x] / similarity + 1e-6, "right")]  # sorted by size
                y = y[(root[y] != root[x]) & ((own[y] != own[x]) if crossed else True)]
                y = y[_possible(n[x], n[y], at[x], at[y], similarity)]
                apart = np.zeros(len(y), dtype=np.int64)
                for size, sketches in folded.items():
                    those = np.minimum(words[y], words[x]) == size
                    apart[those] = np.bitwise_count(sketches[y[those]] ^ sketches[x]).sum(axis=1)
                close = apart <= (n[x] + n[y]) * ((1 - similarity) / (1 + similarity)) + 1e-6
                y, apart = y[close], apart[close]
                if nearest and len(y):
                    xs, ys, distances = np.append(xs, np.full(len(y), x)), np.append(ys, y), np.append(distances, apart)
                    if len(xs) > 1 << 16:
                        best = _nearest(root, xs, ys, distances)
                        xs, ys, distances = xs[best], ys[best], distances[best]
                elif len(y):
                    left.append(np.full(len(y), key[x]))
                    right.append(key[y])
                    held += len(y)
                if held > 1 << 20:
                    pairs = _unique_pairs(left, right)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
                    left, right, held = [], [], 0
            if len(xs):
                best = _nearest(root, xs, ys, distances)
                left.append(key[xs[best]])
                right.append(key[ys[best]])
        pairs = _unique_pairs(left, right)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _near_by_sketch(rows: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` that their sketches leave possible: sets that are similar differ in few shingles."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in (2, 4))
            most = (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6
            keep = [sketch_distance(x.as_py(), y.as_py()) <= d for x, y, d in zip(batch.column(3), batch.column(5), most)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    known = rows.select("key", "n", "sketch").dropDuplicates(["key"])
    one = lambda x: known.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.select("a", "b").distinct().join(one("a"), "a").join(one("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return both.mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, width: int, similarity: float, name: str) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar enough."""
    pairs = written(_near_by_sketch(rows, pairs, similarity), f"{name}-near")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), width).tobytes() for x in batch.column(1)], pa.binary())], ["key", "s"])

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    need = small_side(written(rows.join(keys, "key").groupBy("key").agg(F.min("sha").alias("sha")), f"{name}-need"))
    texts = docs.select(text_sha(docs).alias("sha"), _text(docs).alias("text")).join(need, "sha").dropDuplicates(["sha"])
    with small_batches(docs.sparkSession, TEXTS):
        sets = written(texts.select("key", "text").mapInArrow(run, "key long, s binary"), f"{name}-sets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
    with small_batches(docs.sparkSession, 128):  # a row holds two whole sets
        return written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), f"{name}-links")


def _tiled(members: DataFrame) -> DataFrame:
    """Members of large groups, dealt out to the pairs of tiles (i, j) of their group; ``own`` is a member's tile."""
    sizes = members.groupBy("t").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    m = members.join(sizes, "t").withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    m = m.select("t", "key", "n", "at", "root", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return m.select("t", "key", "n", "at", "root", "sketch", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def similar_links(docs: DataFrame, rows: DataFrame, width: int, similarity: float, proposed: DataFrame | None = None) -> DataFrame:
    """(a, b) links between set keys with the components of all similar pairs; not every pair is listed.

    ``proposed`` are pairs (a, b) that another method has found; those that are similar enough link before large groups are searched.
    """
    met = written(_met(rows, similarity), "met")
    member = lambda kind: met.where(F.col("kind") == kind).select(F.col("b").alias("t"), F.col("a").alias("key"), "n", "at")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = member(LEAD).repartition(tasks, "t").mapInArrow(_star(similarity), "a long, b long")
    first = met.where(F.col("kind") == PAIR).select("a", "b")
    asked = first.unionByName(stars) if proposed is None else first.unionByName(stars).unionByName(proposed)
    links = _verified(docs, rows, asked, width, similarity, "first")
    known = rows.select("key", "sketch").dropDuplicates(["key"])
    judged = first.distinct()  # what has been judged need not be judged again
    for step in range(ROUNDS + 1):
        nearest, name = step < ROUNDS, f"round-{step}"
        roots = components(links, f"{name}-roots")
        rooted = member(MEMBER).join(roots, F.col("key") == roots["node"], "left").select("t", "key", "n", "at", F.coalesce("root", "key").alias("root"))
        rooted = written(rooted, f"{name}-rooted")
        apart = rooted.groupBy("t").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("t")
        members = _tiled(rooted.join(apart, "t", "left_semi").join(known, "key"))
        pairs = members.repartition(tasks, "t", "i", "j").mapInArrow(_paired(similarity, nearest), "a long, b long")
        pairs = written(pairs.distinct(), f"{name}-pairs")
        if pairs.isEmpty():
            break
        links = links.unionByName(_verified(docs, rows, pairs.join(judged, ["a", "b"], "left_anti"), width, similarity, name))
        judged = judged.unionByName(pairs)
    return links


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, propose=None) -> DataFrame:
    """One row per document: doc_id, sha (of its text), component_id (smallest doc_id reachable, itself included).

    Null, empty and blank texts have the empty set and are alike. A component of null ids only has a null component_id. Other
    columns are ignored; an empty table gives an empty result. ``propose`` makes pairs of keys of the sets' (key, fp).
    """
    often = _often(docs, width)
    with small_batches(docs.sparkSession, TEXTS):
        rows = _told_apart(written(_rows(docs, width, similarity, often), "shingles"))
    proposed = propose(rows.select("key", "fp").distinct()) if propose else None
    roots = components(similar_links(docs, rows, width, similarity, proposed), "near")
    own = rows.select("doc_id", "sha", "key")
    rooted = written(own.join(roots, own["key"] == roots["node"], "left").select("doc_id", "sha", F.coalesce("root", "key").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "sha", "component_id")
