"""Hard-negative mining with bounds along a spanning tree of anchors.

Rows are dealt out by a hash into tiles of bounded size and anchors into blocks, both written as files of the shared folder; a
task reads the files of its pairs of a block and some tiles, so all anchors meet all rows in blocks and no pair of them is
ever a row. Within a block the anchors' minimum spanning tree gives the order: the root is scored exactly against a tile, and
a child's score differs from its parent's by at most the length of their edge times the candidate's norm, which bounds it
from the parent's score or bounds. Only candidates whose bounds meet what a child still looks for are scored again: for
positives what may be among its best, for negatives the windows of its positives above what they already hold. A task emits
the best few of each anchor or positive for its tiles; the best of all tiles are ranked by one window over these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remove, scratch, written
from .files import opened, own_name

LAST = np.iinfo(np.int64).max
#: Parameters: rows of a tile and anchors of a block at most about, entries of either, and tiles that a task's row names.
TILE, BLOCK, ENTRIES, GROUP = 2048, 256, 1 << 20, 8


def spanning_tree(v: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, parent, edge length) of a minimum spanning tree of the rows, parents first; the root has parent -1."""
    squares = (v * v).sum(axis=1)
    best, parent = np.full(len(v), np.inf), np.full(len(v), -1)
    left, node, out = np.ones(len(v), dtype=bool), 0, []
    for _ in range(len(v)):
        left[node] = False
        out.append((node, int(parent[node]), 0.0 if parent[node] < 0 else float(np.linalg.norm(v[node] - v[parent[node]]))))
        d = squares + squares[node] - 2.0 * (v @ v[node])
        nearer = left & (d < best)
        best[nearer], parent[nearer] = d[nearer], node
        node = int(np.argmin(np.where(left, best, np.inf)))
    return out


def scores(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``x`` with ``v``; one that no long holds is an OverflowError."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    most = float(np.abs(x).max()) * float(np.abs(v).max()) * x.shape[1]
    if most < 1 << 53:
        return (x.astype(np.float64) @ v.astype(np.float64)).astype(np.int64)
    return np.array([int(s) for s in x.astype(object) @ v.astype(object)], dtype=np.int64)


class Best:
    """The best ``most`` of (score, id, row) seen so far: higher scores first, then smaller ids, null ids last, then row numbers."""

    def __init__(self, most: int):
        self.most, self.score, self.id, self.row = most, *(np.zeros(0, dtype=np.int64) for _ in range(3))

    def least(self) -> float:
        """What a score must reach to count."""
        return float(self.score[-1]) if len(self.score) == self.most else -np.inf

    def add(self, score, ids, rows) -> None:
        score, ids, rows = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score))[: self.most]
        self.score, self.id, self.row = score[order], ids[order], rows[order]


def _save(folder: str):
    """Rows (key..., rows): each list of structs as a file; gives the keys and the file's path."""

    def run(batches):
        for batch in batches:
            paths = []
            for i in range(batch.num_rows):
                rows = pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column("rows")[i].values)])
                paths.append(own_name(folder, ".rows"))
                with opened(paths[-1], write=True) as f, pa.ipc.new_stream(f, rows.schema) as out:
                    out.write_table(rows)
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("part"), pa.array(paths)], ["d", "part", "path"])

    return run


def _load(path: str) -> dict:
    with opened(path) as f:
        t = pa.ipc.open_stream(f).read_all().combine_chunks()
    out = {c: t.column(c).combine_chunks() for c in t.column_names}
    x = out["x"].flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    held = {"x": x, "row": out["row"].to_numpy(), "id": out["id"].fill_null(int(LAST)).to_numpy(), "label": out["label"].to_numpy(), "norm": np.linalg.norm(x.astype(np.float64), axis=1)}
    if "found" in out:
        held["found"] = out["found"].to_pylist()
    return held


def bounded_scores(tile: dict, block: dict, tree, wanted, met) -> int:
    """Goes through the tree for one tile; returns how many scores were computed.

    ``wanted(node, low, high)`` marks candidates by their bounds, ``met(node, indices, scores)`` gets the exact scores of those.
    """
    bounds, computed = {}, 0
    slack = 1.0 + 1e-9 * tile["norm"] * float(np.abs(block["x"]).max(initial=0)) * np.sqrt(max(1, block["x"].shape[1]))
    open_children = np.bincount([p + 1 for _, p, _ in tree], minlength=len(tree) + 1)
    for node, parent, edge in tree:
        if parent < 0:
            at = np.arange(len(tile["row"]))
            low, high = np.zeros(len(at)), np.zeros(len(at))
        else:
            reach = edge * tile["norm"] + slack
            low, high = bounds[parent][0] - reach, bounds[parent][1] + reach
            at = np.flatnonzero(wanted(node, low, high))
            open_children[parent + 1] -= 1
            if not open_children[parent + 1]:
                del bounds[parent]
        exact = scores(tile["x"][at], block["x"][node])
        computed += len(at)
        low[at] = high[at] = exact
        if open_children[node + 1]:
            bounds[node] = (low, high)
        met(node, at, exact)
    return computed


def _positives(count: int):
    """Rows (block, tiles): the best ``count`` other rows of an anchor's label, over the tiles that the task has of a block."""

    def start(block):
        return [Best(count) for _ in block["row"]]

    def step(tile, block, tree, best):
        same = {}

        def label(node):
            if (key := block["label"][node]) not in same:
                same[key] = tile["label"] == key
            return same[key] & (tile["row"] != block["row"][node])

        def met(node, at, score):
            keep = label(node)[at] & (score >= best[node].least())
            best[node].add(score[keep], tile["id"][at][keep], tile["row"][at][keep])

        bounded_scores(tile, block, tree, lambda node, low, high: label(node) & (high >= best[node].least()), met)

    def end(block, best):
        n = [len(b.row) for b in best]
        cols = [np.repeat(block["row"], n), *(np.concatenate([getattr(b, k) for b in best]) for k in ("row", "id", "score"))]
        return pa.RecordBatch.from_arrays([pa.array(c, mask=cols[2] == LAST if i == 2 else None) for i, c in enumerate(cols)], ["anchor_row", "row", "id", "score"])

    return _through(start, step, end)


def _negatives(count: int, low_share: int, high_share: int):
    """As ``_positives`` for each anchor and positive: the best rows of other labels inside the window of the positive's score."""

    def start(block):
        found = [f or [] for f in block["found"]]
        # in integers: low_share * p <= 100 * n <= high_share * p
        return [[(-(-low_share * p["score"] // 100), high_share * p["score"] // 100, Best(count)) for p in f] for f in found]

    def step(tile, block, tree, best):
        def wanted(node, low, high):
            out = np.zeros(len(low), dtype=bool)
            for first, last, b in best[node]:
                if first <= last:
                    out |= (high >= max(first, b.least())) & (low <= last)
            return out & (tile["label"] != block["label"][node])

        def met(node, at, score):
            other = tile["label"][at] != block["label"][node]
            for first, last, b in best[node]:
                keep = other & (score >= max(first, b.least())) & (score <= last)
                if keep.any():
                    b.add(score[keep], tile["id"][at][keep], tile["row"][at][keep])

        bounded_scores(tile, block, tree, wanted, met)

    def end(block, best):
        rows = [(block["row"][i], block["id"][i], block["found"][i][k], b) for i, each in enumerate(best) for k, (_, _, b) in enumerate(each) if len(b.row)]
        n = [len(b.row) for *_, b in rows]
        of = lambda values: np.repeat(np.array(values, dtype=np.int64), n)
        ids = np.concatenate([b.id for *_, b in rows]) if rows else np.zeros(0, dtype=np.int64)
        positive = of([LAST if p["id"] is None else p["id"] for _, _, p, _ in rows])
        cols = [of([r[0] for r in rows]), of([r[1] for r in rows]), of([p["rank"] for _, _, p, _ in rows]), positive, of([p["score"] for _, _, p, _ in rows]), ids, *(np.concatenate([getattr(b, k) for *_, b in rows]) if rows else ids for k in ("row", "score"))]
        return pa.RecordBatch.from_arrays([pa.array(c, mask=c == LAST if i in (1, 3, 5) else None) for i, c in enumerate(cols)], ["anchor_row", "anchor_id", "k", "positive_id", "positive_score", "negative_id", "row", "negative_score"])

    return _through(start, step, end)


def _through(start, step, end):
    """Goes through rows (block path, tile paths), ordered by block, holding one block and what it has found."""

    def run(batches):
        name = block = tree = state = None
        for batch in batches:
            for path, tiles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path != name:
                    if name:
                        yield end(block, state)
                    name, block = path, _load(path)
                    tree, state = spanning_tree(block["x"].astype(np.float64)), start(block)
                for t in tiles:
                    step(_load(t), block, tree, state)
        if name:
            yield end(block, state)

    return run


def _files(rows: DataFrame, sizes: dict[int, int], most: int, folder: str, *more: str) -> DataFrame:
    """Writes ``rows`` in files of about ``most`` rows of one length, dealt out by row number: (d, part, path)."""
    parts = {d: max(1, -(-n // max(16, min(most, ENTRIES // d)))) for d, n in sizes.items()}
    of = F.element_at(F.create_map(*[F.lit(x) for d, n in parts.items() for x in (d, n)]), F.col("d"))
    grouped = rows.withColumn("part", F.pmod(F.xxhash64("row"), of).cast("int")).groupBy("d", "part").agg(F.collect_list(F.struct("row", "id", "label", "x", *more)).alias("rows"))
    return written(grouped.mapInArrow(_save(folder), "d int, part int, path string"), "file-list")


def _searched(blocks: DataFrame, groups: DataFrame, counts: dict[int, int], search, schema: str) -> DataFrame:
    """Each block against all groups of tiles of its length: each row of the blocks' list names its groups, which are then met by number."""
    spark = blocks.sparkSession
    n = F.element_at(F.create_map(*[F.lit(x) for d, c in counts.items() for x in (d, c)]), F.col("d"))
    pairs = blocks.select("d", F.col("path").alias("block"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part")).join(groups, ["d", "part"])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count() * sum(counts.values()) // 16)
    dealt = pairs.select("block", "tiles").repartition(parts, "block", F.xxhash64("tiles")).sortWithinPartitions("block")
    return written(dealt.mapInArrow(search, schema), "found")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(id, label, x, anchor), x whole numbers: one row per anchor, positive and hard negative of it.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. An anchor's positives are its first
    ``positives`` other rows of its label; the negatives of a positive are the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` percent of the positive's. Higher inner products come first, then smaller ids, null ids last.
    Rows with a null label, vector or component, or an empty vector, take no part; rows of different lengths never meet.
    Each row counts, also one that repeats another, so an anchor's copy is a row like others and anchors that repeat give
    repeated results. Other columns are ignored; an empty table, or one without anchors, gives no row.
    """
    spark = rows.sparkSession
    good = F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(F.size("x") > 0, F.lit(False)) & F.forall("x", lambda c: c.isNotNull())
    rows = rows.where(good).select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("x", lambda c: c.cast("long")).alias("x"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.size("x").alias("d"))
    rows = written(rows, "candidates")
    counted = {r["d"]: r for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).where("anchors > 0").collect()}
    out = "anchor_row long, anchor_id long, k long, positive_id long, positive_score long, negative_id long, row long, negative_score long"
    if not counted:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.where(F.col("d").isin(list(counted)))
    anchors = rows.where("anchor")
    folder, sizes = scratch(spark, "tiles"), {d: r["anchors"] for d, r in counted.items()}
    tiles = _files(rows, {d: r["n"] for d, r in counted.items()}, TILE, folder)
    groups = written(tiles.groupBy("d", (F.col("part") / GROUP).cast("int").alias("part")).agg(F.collect_list("path").alias("tiles")), "tile-groups")
    counts = {r["d"]: r["n"] for r in groups.groupBy("d").agg((F.max("part") + 1).alias("n")).collect()}

    found = _searched(_files(anchors, sizes, BLOCK, folder), groups, counts, _positives(positives), "anchor_row long, row long, id long, score long")
    first = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    chosen = found.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "id", "score"))).alias("found"))
    with_positives = anchors.join(chosen.withColumnRenamed("anchor_row", "row"), "row")
    mined = _searched(_files(with_positives, sizes, BLOCK, folder, "found"), groups, counts, _negatives(negatives, low, high), out)
    remove(spark, folder)
    best = Window.partitionBy("anchor_row", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "row")
    mined = mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
