"""Near-duplicate vectors of equal label by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class first. The classes of a label are dealt out into tiles of bounded size, ordered along
the label's widest coordinate, and each tile is a file in the shared folder. Only descriptions of tiles are joined, with a box
of each in its widest coordinates: unit vectors whose cosine reaches the threshold are at most sqrt(2 - 2 * threshold) apart,
so tiles whose boxes are farther apart are never paired. A task reads the files of its pairs of tiles: unit vectors quantised to int8 are multiplied as matrices, the product's error is bounded for each pair by the norms of the two
quantisation residuals, and only pairs that the bound leaves possible are computed again in double precision. A task emits
the links counted for each vector and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, small_side, union_roots, written
from .files import opened, own_name
from .graph import components

#: Added to the error bounds for rounding in the bounds' own arithmetic.
SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, norm of the residual) of unit rows in double precision."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows by powers of two, which leaves their cosines exactly as they are, so that no square is lost below or above."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, block: int = 512):
    """Index pairs (i, j) with cosine(a[i], b[j]) >= threshold, i < j if both are the same tile; in blocks of rows."""
    a, b = scaled(a), scaled(b)
    ua, ub = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    (qa, sa, ea), (qb, sb, eb) = quantise(ua), quantise(ub)
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integer sums are exact in either
    qa, qb = qa.astype(exact), qb.astype(exact).T
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for at in range(0, len(a), block):
        part = slice(at, at + block)
        dot = qa[part] @ qb
        # |a.b - sa sb qa.qb| <= ea + (1 + ea) eb, so a pair below this product can't reach the threshold
        need = (threshold - SLACK - ea[part, None] - (1 + ea[part, None]) * eb[None, :]) / (sa[part, None] * sb[None, :])
        i, j = np.nonzero(dot >= need)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            hit = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            yield x[hit], y[hit]


def _pair(threshold: float):
    """Rows (left, right) of tile files, ordered by left; right is null for a tile with itself."""

    def run(batches):
        name, held = None, None
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if left != name:
                    name, held = left, load_tile(left)
                out = _linked(held, load_tile(right) if right else None, threshold)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["cls", "links", "root"])

    return run


def save_tile(path: str, ids: np.ndarray, sizes: np.ndarray, vecs: np.ndarray) -> None:
    single = vecs.dtype == np.float32
    with opened(path, write=True) as f:
        f.write(np.array([len(ids), vecs.shape[1], single], dtype=np.int64).tobytes() + ids.astype(np.int64).tobytes() + sizes.astype(np.int64).tobytes() + vecs.tobytes())


def load_tile(path: str) -> dict:
    with opened(path) as f:
        data = f.read()
    n, _, single = np.frombuffer(data, dtype=np.int64, count=3)
    return {"ids": data[24 : 24 + 8 * n], "sizes": data[24 + 8 * n : 24 + 16 * n], "vecs": data[24 + 16 * n :], "single": bool(single)}


def _linked(left: dict, right: dict | None, threshold: float):
    sides = [left] if right is None else [left, right]
    ids, sizes = (np.concatenate([np.frombuffer(s[k], dtype=np.int64) for s in sides]) for k in ("ids", "sizes"))
    vecs = [np.frombuffer(s["vecs"], dtype=np.float32 if s["single"] else np.float64).reshape(len(s["ids"]) // 8, -1).astype(np.float64) for s in sides]
    shift = 0 if right is None else len(vecs[0])
    links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # roots are smallest ids, not positions
    order = np.argsort(ids, kind="stable")
    if vecs[0].shape[1] == vecs[-1].shape[1]:
        for i, j in tile_links(vecs[0], vecs[-1], threshold, right is None):
            j = j + shift
            np.add.at(links, i, sizes[j])
            np.add.at(links, j, sizes[i])
            root = union_roots(len(ids), rank[i], rank[j], root)
    at = np.flatnonzero(links)
    return ids[at], links[at], ids[order[root[rank[at]]]]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tile: int = 1024) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero or hold a null or a non-finite component, and rows with a null label or a null
    vec_id, link with nothing: no links, their own component, kept. Vectors of different lengths never link. Repeated rows
    link with one another as equal vectors; rows of one vec_id with different vectors or labels are judged each by its own.
    Components may be as small or large as doubles are. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    label, kind = vectors.schema["label"].dataType.simpleString(), vectors.schema["embedding"].dataType.simpleString()
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("vec"))
    tagged = raw.mapInArrow(_tag, f"vec_id long, label {label}, vec {kind}, digest binary")
    v = written(tagged.select("vec_id", "label", "digest"), "vectors")
    classes = tagged.where("digest IS NOT NULL").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    # from here on a class goes by a number of its own; the least vec_id of a component is found last
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes").withColumn("dim", F.size("vec"))
    folder = scratch(spark, "tiles")
    tiles = written(_tiles(classes, label, tile, folder), "tile-list")
    pairs = _tile_pairs(tiles, float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 64)
    dealt = pairs.repartition(parts, "left", F.pmod(F.xxhash64("right"), F.lit(16))).sortWithinPartitions("left")
    found = written(dealt.mapInArrow(_pair(threshold), "cls long, links long, root long"), "links")
    remove(spark, folder)
    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select("cls", "root"), "vectors")
    of = classes.join(linked, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    of = written(of.select("label", "digest", "rep", "root", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "class-links")
    of = of.join(of.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("label", "digest", "n_links", "component_id")
    good = v.where("digest IS NOT NULL").join(of, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    out = good.unionByName(v.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))


def _tag(batches):
    """Adds a digest of the components to vectors that can link; equal vectors have equal ones, as both zeros are written alike."""
    for batch in batches:
        col = batch.column(2)
        values, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        known = [c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
        out = []
        for i in range(batch.num_rows):
            x = values[offsets[i] : offsets[i + 1]]
            good = known[0][i] and known[1][i] and known[2][i] and len(x) and np.isfinite(x).all() and x.any()
            out.append(hashlib.blake2b((x + x.dtype.type(0)).tobytes(), digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["vec_id", "label", "vec", "digest"])


AXES = 4  # coordinates that the boxes of tiles are bounded in


def _sums(batches):
    """For each label and length of a task: the number, sum and squared sum of each coordinate of the unit vectors."""
    held: dict = {}
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        labels = batch.column(0).to_pylist()
        offsets, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False).astype(np.float64)
        for i, name in enumerate(labels):
            x = values[offsets[i] : offsets[i + 1]]
            x = scaled(x[None, :])[0]
            x = x / np.linalg.norm(x)
            n, s, q = held.setdefault((name, len(x)), [0, np.zeros(len(x)), np.zeros(len(x))])
            held[name, len(x)] = [n + 1, s + x, q + x * x]
    for (name, dim), (n, s, q) in held.items():
        same = [np.full(dim, v) for v in (dim, n)]
        yield pa.RecordBatch.from_arrays([pa.array([name] * dim, kind), pa.array(same[0].astype(np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(same[1].astype(np.int64)), pa.array(s), pa.array(q)], ["label", "dim", "k", "n", "s", "q"])


def _tiles(classes: DataFrame, label: str, tile: int, folder: str) -> DataFrame:
    """Writes the classes of each label in tiles of about ``tile`` to ``folder``: (label, dim, band, part, path, low, high).

    The label's widest coordinate, cut at quantiles, orders the tiles; low and high bound a tile in its widest coordinates.
    """
    sums = classes.select("label", "vec").mapInArrow(_sums, f"label {label}, dim int, k int, n long, s double, q double")
    spread = sums.groupBy("label", "dim", "k").agg(F.sum("n").alias("n"), (F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("var"))
    plan = spread.groupBy("label", "dim").agg(F.max("n").alias("n"), F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("var", "k")))), 1, AXES).alias("ks"))
    plan = small_side(written(plan.select("label", "dim", "n", F.col("ks.k").alias("ks")), "tile-axes"))
    most = F.expr("aggregate(vec, 0D, (s, x) -> greatest(s, abs(double(x))))")
    norm = F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + (double(x) / most) * (double(x) / most)))")
    placed = classes.join(plan, ["label", "dim"]).withColumn("most", most).withColumn("norm", norm)
    placed = placed.withColumn("at", F.transform("ks", lambda k: F.get("vec", k).cast("double") / F.col("most") / F.col("norm"))).drop("norm", "most", "ks")
    cuts = placed.groupBy("label", "dim").agg(F.percentile_approx(F.get("at", F.lit(0)), [i / 64 for i in range(1, 64)], 2000).alias("cuts"), F.ceil(F.max("n") / tile).cast("long").alias("tiles"))
    cuts = small_side(written(cuts, "tile-cuts"))
    # the 64 bands of about equal numbers in runs of one tile each; a band of many, as of equal coordinates, is several tiles
    band = F.expr("int(size(filter(cuts, c -> c < at[0])) * least(tiles, 64L) div 64)")
    c = placed.drop("n").join(cuts, ["label", "dim"]).withColumn("band", band)
    parts = small_side(written(c.groupBy("label", "dim", "band").agg(F.ceil(F.count("*") / tile).cast("long").alias("parts")), "tile-parts"))
    c = c.join(parts, ["label", "dim", "band"]).withColumn("part", F.pmod(F.xxhash64("cls"), "parts"))
    ends = [F.array(*[f(F.get("at", F.lit(i))) for i in range(AXES)]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    packed = c.groupBy("label", "dim", "band", "part").agg(F.collect_list(F.struct("cls", "size", "vec")).alias("rows"), *ends)

    def save(batches):
        for batch in batches:
            paths = []
            for i in range(batch.num_rows):
                rows = batch.column(4)[i].values
                paths.append(own_name(folder, ".tile"))
                ids, sizes = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("cls", "size"))
                save_tile(paths[-1], ids, sizes, rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *batch.columns[5:7], pa.array(paths)], ["label", "dim", "band", "part", "low", "high", "path"])

    return packed.mapInArrow(save, f"label {label}, dim int, band int, part long, low array<double>, high array<double>, path string")


def _tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """(left, right): the files of each pair of tiles of a label whose boxes are at most ``reach`` apart, and of each tile alone.

    Only these small rows are joined. The tiles of a label are dealt out to buckets, of about 64 tiles, that the label's other
    tiles are all sent to, so that a label of very many tiles is not joined in one task.
    """
    sizes = tiles.groupBy("label", "dim").agg(F.ceil(F.count("*") / 64).cast("int").alias("buckets"))
    t = tiles.join(sizes, ["label", "dim"])
    a = t.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).alias("a")
    b = t.withColumn("bucket", F.pmod(F.xxhash64("band", "part"), F.col("buckets"))).alias("b")
    gap = lambda i: F.coalesce(F.greatest(F.col("a.low")[i] - F.col("b.high")[i], F.col("b.low")[i] - F.col("a.high")[i], F.lit(0.0)), F.lit(0.0))
    apart = sum((gap(i) * gap(i) for i in range(1, AXES)), gap(0) * gap(0))
    on = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.bucket") == F.col("b.bucket"))
    on &= (F.struct("a.band", "a.part") < F.struct("b.band", "b.part")) & (apart <= reach * reach)
    return a.join(b, on).select(F.col("a.path").alias("left"), F.col("b.path").alias("right")).unionByName(tiles.select(F.col("path").alias("left"), F.lit(None).cast("string").alias("right")))
