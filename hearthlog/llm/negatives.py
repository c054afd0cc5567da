"""Hard negatives: rows of another label whose score lies in a window below that of a
positive, found in R-trees packed by sorting and tiling.

All rows are tiled: sorted by label and the coordinate that varies most, cut into slabs,
sorted anew within each by label and the next coordinate, and cut into subtrees of equal
size, whatever is how often repeated. A task packs a subtree's rows into leaves and
boxes and searches it for a chunk of anchors, best box first: a box is left out if the
interval of its scores misses the windows or lies strictly below the k-th score so far.
Every chunk of anchors meets every subtree; neither has more rows than a parameter says,
and what a task returns is at most ``k`` rows for each of its anchors and windows.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm.common import over_batches
from hearthlog.llm.rtree import LEAF_ROWS, Search, pack
from hearthlog.operators.lookup import lookup
from hearthlog.operators.ordering import with_position
from hearthlog.staging import stage, stage_measured

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
SUBTREE_ROWS = 8192
ANCHOR_CHUNK = 16_384
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of a positive's score
EXACT = 2.0**53  # up to which sums of products are exact


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without null lists, and the length of each list."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def scaled_points(points: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, label, vector`` of the rows that take part, with ``floor(scale * x)`` of
    each component. Rows with a null id, label or vector take no part, nor do those with
    a null or non-finite component."""
    largest = EXACT / 4

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, sizes = _lists(batch.column(2))
            values = np.floor(scale * values.astype(float))  # a null becomes not a number
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sound = np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) == 0
            values, keep = values[sound[owner]], pa.array(sound)
            if np.abs(values).max(initial=0) >= largest:
                raise ValueError("a component is too large for exact scores")
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[sound])]), pa.int32())
            vectors = pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int64)))
            yield {"id": batch.column(0).filter(keep), "label": batch.column(1).filter(keep), "vector": vectors}

    chosen = points.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    return over_batches(chosen.dropna(), rows, "id long, label long, vector array<long>")


def _each_once(points: DataFrame) -> DataFrame:
    """Without repeats of a row that agree in everything; few ids repeat, and only
    their rows are shuffled."""
    repeated = stage_measured(points.groupBy("id").count().where("count > 1").select("id"), "repeated_ids")
    if not repeated.bytes:
        return points
    others = lookup(points, repeated.table, ["id"], "left_anti", facts_bytes=repeated.bytes)
    copies = lookup(points, repeated.table, ["id"], "left_semi", facts_bytes=repeated.bytes)
    return others.unionByName(copies.distinct())


def _moments(points: DataFrame) -> DataFrame:
    """``n, total, squares, most`` for each coordinate; one row per task and coordinate
    is all that is shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values, sizes = _lists(batch.column(0))
            values = values.astype(float)
            for size in np.unique(sizes).tolist():
                chosen = values[np.repeat(sizes == size, sizes)].reshape(-1, size) if size else np.empty((int((sizes == 0).sum()), 0))
                own = np.stack([np.full(size, float(len(chosen))), chosen.sum(axis=0), (chosen**2).sum(axis=0), np.abs(chosen).max(axis=0, initial=0)])
                held = sums.setdefault(size, np.zeros((4, size)))
                held[:3] += own[:3]
                held[3] = np.maximum(held[3], own[3])
        for size, held in sums.items():
            yield {"place": np.arange(size), "n": held[0], "total": held[1], "squares": held[2], "most": held[3]}

    found = over_batches(points.select("vector"), rows, "place int, n double, total double, squares double, most double")
    return found.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.max("most").alias("most"))


def _tiles(points: DataFrame, subtree_rows: int) -> tuple[DataFrame, int]:
    """``id, label, vector, tile`` and the number of tiles, of at most ``subtree_rows`` rows.

    Vectors are made as long as the longest with zeros, which add nothing to a score.
    """
    moments = _moments(points).collect()  # a row per coordinate
    width = len(moments)
    if sum(m["most"] ** 2 for m in moments) >= EXACT / 100:
        raise ValueError("the components are too large for exact scores")
    spread = sorted(moments, key=lambda m: (m["total"] ** 2 / m["n"] - m["squares"], m["place"]))
    first, second = [m["place"] for m in (spread * 2)[:2]] if spread else (None, None)
    filled = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vector")))
    coordinate = lambda place: F.lit(0).cast("long") if place is None else F.col("vector")[place]
    laid = points.withColumn("vector", filled).withColumns({"_first": coordinate(first), "_second": coordinate(second)})
    rows = points.count()
    tiles = -(-rows // subtree_rows)
    slab_rows = subtree_rows * max(1, -(-tiles // max(1, int(np.ceil(tiles**0.5)))))
    slabbed = with_position(laid, ["label", "_first", "id"], "_at")
    slabbed = slabbed.withColumn("_slab", F.floor(F.col("_at") / slab_rows)).drop("_at", "_first")
    tiled = with_position(slabbed, ["_slab", "label", "_second", "id"], "_at")
    tile = F.floor(F.col("_at") / subtree_rows).cast("int").alias("tile")
    return tiled.select("id", "label", "vector", tile), tiles


def _search(
    tiled: DataFrame, tiles: int, anchors: DataFrame, k: int, same: bool, low: int, high: int, chunk: int, leaf_rows: int
) -> DataFrame:
    """``anchor, rank, found, score``: for each anchor, or each of its ``scores``, the
    rows that some task counts among the first ``k``."""
    spark = tiled.sparkSession
    chunks = max(1, -(-anchors.count() // chunk))
    groups = max(1, min(tiles, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    none = F.lit(None).cast("array<long>")
    each_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    each_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    group = F.floor(F.col("tile").cast("long") * groups / max(tiles, 1)).cast("int").alias("group")
    scores = none if same else F.col("scores")
    one = F.pmod(F.xxhash64("anchor"), F.lit(chunks)).cast("int").alias("chunk")
    rows = tiled.select(group, each_chunk, "tile", "id", "label", "vector", none.alias("scores"), F.lit(None).cast("long").alias("anchor")).unionByName(
        anchors.select(each_group, one, F.lit(-1).alias("tile"), "id", "label", "vector", scores.alias("scores"), "anchor")
    )
    dealt = rows.repartitionById(groups * chunks, F.col("group") * chunks + F.col("chunk")).sortWithinPartitions("group", "chunk", "tile", "label")

    def matrix(parts: list[pa.Array], n: int) -> np.ndarray:
        return np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]).reshape(n, -1).astype(float)

    def begin(parts: list[pa.RecordBatch]) -> tuple[Search, np.ndarray]:
        ids, labels, anchor = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in (3, 4, 7))
        if same:
            least, most = np.full((len(ids), 1), -np.inf), np.full((len(ids), 1), np.inf)
        else:
            own = [s for p in parts for s in p.column(6).to_pylist()]
            widest = max(map(len, own))
            least, most = np.full((len(ids), widest), np.inf), np.full((len(ids), widest), -np.inf)
            for row, listed in enumerate(own):
                least[row, : len(listed)] = [-(-low * s // 100) for s in listed]
                most[row, : len(listed)] = [high * s // 100 for s in listed]
        return Search(ids, labels, matrix([p.column(5) for p in parts], len(ids)), least, most, k, same), anchor

    def results(search: Search, anchor: np.ndarray) -> dict:
        windows = search.low.shape[1]
        return {
            "anchor": anchor[search.owner // windows], "rank": (search.owner % windows).astype(np.int32),
            "found": search.found, "score": search.score.astype(np.int64),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, held, search, anchor = None, [], None, None

        def close() -> None:
            nonlocal search, anchor
            if not held:
                return
            if key[2] < 0:
                search, anchor = begin(held)
            elif search is not None:
                ids, labels = (np.concatenate([p.column(c).to_numpy() for p in held]) for c in (3, 4))
                search.visit(pack(ids, labels, matrix([p.column(5) for p in held], len(ids)), leaf_rows))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for first, last in zip(cuts, cuts[1:]):
                new = tuple(keys[first].tolist())
                if new != key:
                    close()
                    if key and new[:2] != key[:2] and search is not None:
                        yield results(search, anchor)
                        search = None
                    key, held = new, []
                held.append(batch.slice(first, last - first))
        close()
        if search is not None:
            yield results(search, anchor)

    return over_batches(dealt, run, "anchor long, rank int, found long, score long")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group, numbered from 1; a group has at most ``k`` rows of each task."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine_hard_negatives(
    points: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    subtree_rows: int = SUBTREE_ROWS,
    anchor_chunk: int = ANCHOR_CHUNK,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of vectors whose components become ``floor(scale * x)``.
    Rows are compared with the anchors, the rows for which ``is_anchor`` holds (by the
    column ``id``). An anchor's positives are its first ``positives`` other rows of its
    label, higher scores first, ties by smaller id; for each of them the first
    ``negatives`` rows of other labels whose score is between ``low`` and ``high`` per
    cent of the positive's, ends included, are returned with their rank from 1. An
    anchor without positives, or without rows in a window, returns none.

    Rows with a null id, label or vector, or a null or non-finite component, take no
    part. Rows that agree in id, label and vector count once; those that share only the
    id are rows of their own, but none is another row to an anchor of that id. Vectors
    of different lengths are filled up with zeros. Components so large that sums of
    products would not be exact (2^53) raise. Other columns are not read.
    """
    usable = stage(_each_once(stage(scaled_points(points, key, label, vector, scale), "points")), "usable")
    laid, tiles = _tiles(usable, subtree_rows)
    tiled = stage(laid, "tiles")
    anchors = stage(tiled.where(is_anchor).drop("tile").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    near = _search(tiled, tiles, anchors, positives, True, low, high, anchor_chunk, leaf_rows)
    order = F.sort_array(F.collect_list(F.struct("place", "found", "score")))
    # At most ``positives`` of each anchor.
    listed = _first(near, ["anchor"], positives).groupBy("anchor").agg(order.alias("_near"))
    wanted = stage(
        anchors.join(listed, "anchor").withColumns({"found": F.col("_near.found"), "scores": F.col("_near.score")}).drop("_near"),
        "wanted",
    )
    hard = _first(
        _search(tiled, tiles, wanted, negatives, False, low, high, anchor_chunk, leaf_rows), ["anchor", "rank"], negatives
    ).select("anchor", "rank", F.col("place").alias("_place"), F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = wanted.select("anchor", F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("found", "scores")).alias("rank", "_pair"))
    return pairs.join(hard, ["anchor", "rank"]).select(
        "anchor_id",
        F.col("_pair.found").alias("positive_id"),
        F.col("_place").alias("rank"),
        "negative_id",
        F.col("_pair.scores").alias("positive_score"),
        "negative_score",
    )
