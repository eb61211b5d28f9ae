"""SimHash near-duplicates found with BK-trees.

A fingerprint is linked with every other one that differs in at most ``radius`` bits. By the pigeonhole principle two such
fingerprints agree on at least ``b - radius`` of ``b`` bit blocks, so the fingerprints are dealt out into shards by the bits
of each choice of ``b - radius`` blocks; ``b`` grows with their number, which keeps the shards small at every size. Each
shard gets a BK-tree: a child hangs under its parent by the integer Hamming distance between them, and a search follows
only the edges within the radius of the distance at hand. The trees of all shards of a task are built and searched level
by level as arrays. Shards above ``tile`` members are cut into tiles, and each pair of tiles is a shard of its own. A task
emits a spanning forest of the links that it found, never all pairs.

The shard trees live where the shards are shuffled to. A broadcast would have to bring the fingerprints of all documents to
the driver, and its size would grow with the corpus: a tree entry takes 17 bytes (fingerprint, parent, distance), in as many
shards as there are choices of blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, union_roots, written
from .graph import components
from .jaccard import similar_groups, text_sha

SEED = 42
BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(data: bytes, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles of UTF-8 text; ``bytes.lower`` and ``split`` know ASCII only, as wanted."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes).tolist(), ends[width - 1 :].tolist()
    n, counts, digest = len(ends), np.zeros(BITS, dtype=np.int64), xxhash.xxh64_digest
    for at in range(0, n, 65536):
        block = np.frombuffer(b"".join([digest(text[i:j], SEED) for i, j in zip(starts[at : at + 65536], ends[at : at + 65536])]), dtype=np.uint8).reshape(-1, 8)
        if len(block) < 300:
            counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
        else:
            for k in range(8):
                counts[8 * k : 8 * k + 8] += np.bincount(block[:, k], minlength=256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def simhash(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. Null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py() or b"", width) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bk_trees(fps: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards, in the order of insertion: (root of each entry's shard, parent, edge); a root has parent -1.

    ``fps`` are distinct within a shard. The entries that meet at the same parent with the same distance go on together:
    the first of them becomes the child, the others descend to it.
    """
    n = len(fps)
    parent, edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
    _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
    root = first[inverse]
    rest = np.flatnonzero(root != np.arange(n))
    at = root[rest]
    while len(rest):
        d = np.bitwise_count(fps[rest] ^ fps[at]).astype(np.int64)
        _, first, inverse = np.unique(at * (BITS + 1) + d, return_index=True, return_inverse=True)
        child = rest[first]
        parent[child], edge[child] = at[first], d[first]
        at = child[inverse]
        down = at != rest
        rest, at = rest[down], at[down]
    return root, parent, edge


def bk_links(fps: np.ndarray, shard: np.ndarray, radius: int, block: int = 1 << 15, found=None) -> np.ndarray:
    """Smallest index reachable from each entry over links within its shard. ``found(a, b)`` sees the links, for tests."""
    n = len(fps)
    root, parent, edge = bk_trees(fps, shard)
    key = np.where(parent >= 0, parent * (BITS + 1) + edge, -1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    reach = np.arange(n)
    for at in range(0, n, block):
        q = np.arange(at, min(at + block, n))
        node = root[q]
        stack = [(q, node)]
        while stack:
            q, node = stack.pop()
            if len(q) > 4 * block:  # bounded memory: the halves one after the other
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(fps[q] ^ fps[node]).astype(np.int64)
            hit = (d <= radius) & (node < q)
            if hit.any():
                if found:
                    found(q[hit], node[hit])
                reach = union_roots(n, q[hit], node[hit], reach)
            low = np.searchsorted(key, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
            size = np.searchsorted(key, node * (BITS + 1) + np.minimum(d + radius, BITS), "right") - low
            q = np.repeat(q, size)
            if len(q):
                node = order[np.arange(len(q)) + np.repeat(low - np.cumsum(size) + size, size)]
                older = node < q  # a subtree holds later entries than its root only
                stack.append((q[older], node[older]))
    return reach


def plan_blocks(n: int, radius: int, aim: int = 64) -> list[int]:
    """Bit masks of the shard keys for ``n`` fingerprints: the fewest choices of blocks that leave ``aim`` to a shard or less."""
    blocks = radius + 1
    while True:
        cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
        parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
        masks = [sum(c) for c in combinations(parts, blocks - radius)]
        if n <= aim << min(m.bit_count() for m in masks) or blocks >= radius + 4:
            return masks
        blocks += 1


def fingerprint_links(fps: DataFrame, radius: int = 4, tile: int = 20_000) -> DataFrame:
    """(a, b) spanning links between the distinct values of column ``fp`` that differ in at most ``radius`` bits."""
    masks = plan_blocks(fps.count(), radius)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    entries = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.key")
    large = small_side(written(entries.groupBy("c", "key").count().where(F.col("count") > tile), "shards"))
    entries = entries.join(large, ["c", "key"], "left").withColumn("tiles", F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    entries = entries.select("fp", "c", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    entries = entries.select("fp", "c", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        cols = {c: t.column(c).to_numpy() for c in ("fp", "c", "key", "i", "j")}
        order = np.lexsort((cols["fp"], cols["j"], cols["i"], cols["key"], cols["c"]))
        cols = {c: v[order] for c, v in cols.items()}
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in ("c", "key", "i", "j")], axis=0)
        uniq, node = np.unique(cols["fp"], return_inverse=True)
        reach = bk_links(cols["fp"].view(np.uint64), np.cumsum(new), radius)
        away = np.flatnonzero(reach != np.arange(len(reach)))
        root = union_roots(len(uniq), node[away], node[reach[away]])
        away = np.flatnonzero(root != np.arange(len(uniq)))
        yield pa.RecordBatch.from_arrays([pa.array(uniq[away]), pa.array(uniq[root[away]])], ["a", "b"])

    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count() * len(masks) // 500_000)
    return entries.repartition(parts, "c", "key", "i", "j").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    Null, empty and blank texts have fingerprint zero and link like any other; equal fingerprints link, so repeated rows
    share a component. A component of null ids only has a null component_id. Other columns are ignored; an empty table gives
    an empty result.
    """
    all_fps = written(simhash(docs, width), "simhash")
    fps = written(all_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(fps.select("fp"), radius), "near")
    rooted = written(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return all_fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_pairs(sets: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) pairs of the keys of ``sets`` (key, fp) that the BK-trees link: one set of each fingerprint, and every other one with it."""
    fps = small_side(written(sets.groupBy("fp").agg(F.min("key").alias("first")), "fingerprints"))
    linked = written(fingerprint_links(fps.select("fp"), radius), "fingerprint-links")
    end = lambda c: fps.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(c))
    between = linked.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(end("a"), "fp_a").join(end("b"), "fp_b")
    within = sets.join(fps, "fp").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    return between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component of similar texts, with their columns as they are.

    The BK-trees propose pairs by the SimHash of the sets of ``width``-word shingles, which count where the sets have that Jaccard
    similarity or more. As similar sets may differ in more than ``radius`` bits, the search of ``jaccard`` adds what the trees
    can't see, so all such pairs link.
    Rows that share a doc_id and a text share the decision; a component of null ids only stays. Null, empty and blank texts are
    alike; an empty table gives an empty result.
    """
    gone = similar_groups(docs, width, similarity, lambda sets: fingerprint_pairs(sets, radius)).where("NOT doc_id <=> component_id").select(F.col("doc_id").alias("id"), "sha").distinct()
    gone = small_side(written(gone, "gone"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc"), text_sha(docs).alias("own"))
    return keyed.join(gone, F.col("doc").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha")), "left_anti").select("row.*")
