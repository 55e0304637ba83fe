"""Hard negatives: for an anchor and each of its positives, the best rows of other labels inside a window of scores.

Threshold joins of anchors with all rows. An anchor's threshold is the lowest score that can still matter to one of its open
windows. Within a task, rows are indexed by stretches of dimensions, those of most energy first. A row's last stretches are
left out of the index where the norms of what is left of row and anchor can't reach any anchor's threshold. Partial scores are
accumulated stretch by stretch, pairs are pruned by the norms of the dimensions still to come, and the pairs that stay
are scored in full.

Thresholds start high, at a low rank among a hashed sample of the rows, and are lowered, anchor by anchor, until the windows are
full or the threshold is the window's own end; what is returned is exact whatever the sample holds. Every task keeps the best of
each window only, so equal scores, however many, cost nothing.

Anchors are the stated query set. They go out in blocks of ``BLOCK_ANCHORS``, one broadcast at a time; rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import fresh_dir

BLOCK_ANCHORS = 16_384  # anchors of a broadcast, about
SAMPLE = 32  # one of so many rows sets the first thresholds
RANKS = (2, 8)  # ranks in the sample at which a threshold is tried, before the window's own end
STRETCH = 16  # dimensions that are indexed together
TILE_ANCHORS, TILE_ROWS = 512, 4_096
BUFFER = 400_000  # scored pairs that a task holds before it keeps the best
LOWEST, HIGHEST = -(2**62), 2**62
EXACT = float(2**52)  # below this, sums of products are exact in doubles


def vectors(lists: pa.Array, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * component) by row, which rows are whole): NULL, NULL or non-finite components make a row unfit.

    Vectors shorter than ``width`` are filled with 0, longer ones are cut, which changes no product with vectors of that width.
    """
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(pc.list_flatten(lists), pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    fit = lists.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row, ~np.isfinite(flat), len(n)) == 0)
    out, inside = np.zeros((len(n), width)), (place < width) & fit[row]
    out[row[inside], place[inside]] = np.floor(scale * flat[inside])
    return out, fit


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of the dimensions from each stretch on; the last column is 0."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], STRETCH), axis=1) if x.shape[1] else np.zeros((len(x), 0))
    out = np.zeros((len(x), squares.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return out


def scored(a: np.ndarray, a_left: np.ndarray, tau: np.ndarray, x: np.ndarray, x_left: np.ndarray, allowed: np.ndarray) -> Iterator[tuple]:
    """(anchors, rows, scores) of all allowed pairs that score ``tau`` of their anchor or more; ``_left``: suffix norms.

    Values are whole numbers, so half a unit covers the rounding of the norms.
    """
    stretches = x_left.shape[1] - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(tau[:, None] > 0, (tau[:, None] - 0.5) / a_left, 0.0).min(axis=0, initial=np.inf)
    covered = np.concatenate([x_left[:, :-1] < reach[:-1], np.ones((len(x), 1), bool)], axis=1)
    cut = covered.argmax(axis=1)  # stretches from here on are not in the index
    rows = np.argsort(-cut, kind="stable")
    rows = rows[cut[rows] > 0] if stretches else rows
    partial = np.zeros((len(a), len(rows)), a.dtype)

    def full(who: np.ndarray, which: np.ndarray, done: int) -> tuple:
        out, from_ = partial[who, which], done * STRETCH
        for i in range(0, len(who) if from_ < a.shape[1] else 0, 1 << 17):
            part = slice(i, i + (1 << 17))
            out[part] += (a[who[part], from_:] * x[rows[which[part]], from_:]).sum(axis=1)
        return who, rows[which], out

    if not stretches:
        yield full(*np.nonzero(allowed[:, rows]), 0)
        return
    for c in range(stretches):
        dims = slice(c * STRETCH, (c + 1) * STRETCH)
        partial += a[:, dims] @ x[rows, dims].T
        stay = int(np.searchsorted(-cut[rows], -(c + 1), "left"))  # rows with more of their dimensions in the index
        alive = (partial + a_left[:, c + 1, None] * x_left[rows, c + 1] + 0.5 >= tau[:, None]) & allowed[:, rows]
        if np.count_nonzero(alive) < 0.02 * alive.size:
            stay = 0
        if stay < len(rows):
            who, which = np.nonzero(alive[:, stay:])
            if len(who):
                yield full(who, which + stay, c + 1)
        keep = np.flatnonzero(alive[:, :stay].any(axis=0))
        if not len(keep):
            return
        if len(keep) < len(rows):
            rows, partial = rows[keep], partial[:, keep]


class Best:
    """The first ``k`` entries of each (anchor, window) by score, then id."""

    def __init__(self, windows: int, k: int):
        self.windows, self.k, self.held = windows, k, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, key: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> bool:
        """True when the buffer was full and has been cut down."""
        self.parts.append((key, score, row_id))
        self.held += len(key)
        if self.held <= BUFFER:
            return False
        self.cut()
        return True

    def cut(self) -> tuple[np.ndarray, ...]:
        key, score, row_id = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((row_id, -score, key))
        key, score, row_id = key[order], score[order], row_id[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.k
        self.parts, self.held = [(key[keep], score[keep], row_id[keep])], int(keep.sum())
        return self.parts[0]


def search(rows: DataFrame, block: dict, low: np.ndarray, high: np.ndarray, k: int, same: bool, scale: float) -> DataFrame:
    """(a, w, score, id): each task's first ``k`` rows inside [low, high] of each window (anchor by window) of a block.

    ``rows`` has id, label, vector; ``same`` tells whether labels have to agree or to differ.
    """
    shared = rows.sparkSession.sparkContext.broadcast({**block, "low": low, "high": high})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        floor, top, windows = b["low"].copy(), b["high"], b["low"].shape[1]
        open_ = np.flatnonzero((floor <= top).any(axis=1))
        a, ids, labels, best = b["vectors"][open_], b["id"][open_], b["label"][open_], Best(windows, k)
        a_left = suffix_norms(a)
        for batch in batches:
            for i in range(0, len(batch) if len(open_) else 0, TILE_ROWS):
                part = batch.slice(i, TILE_ROWS)
                x, fit = vectors(part.column(2), len(b["order"]), scale)
                at = np.flatnonzero(fit & part.column(0).is_valid().to_numpy(zero_copy_only=False) & part.column(1).is_valid().to_numpy(zero_copy_only=False))
                row_id = pc.fill_null(part.column(0), 0).to_numpy()[at]
                label = pc.fill_null(part.column(1), 0).to_numpy()[at]
                x = x[at][:, b["order"]]
                x_left = suffix_norms(x)
                limit = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
                if limit >= 2.0**62:
                    raise OverflowError("scores of these vectors do not fit a long")
                kind = np.float64 if limit < EXACT else np.int64
                for j in range(0, len(open_), TILE_ANCHORS):
                    mine = slice(j, j + TILE_ANCHORS)
                    allowed = ((labels[mine, None] == label) == same) & (ids[mine, None] != row_id)
                    tau = np.where(floor[open_[mine]] <= top[open_[mine]], floor[open_[mine]], HIGHEST).min(axis=1).astype(np.float64)
                    for who, which, score in scored(a[mine].astype(kind), a_left[mine], tau, x.astype(kind), x_left, allowed):
                        score, anchor = score.astype(np.int64), open_[who + j]
                        for w in range(windows):
                            inside = (score >= floor[anchor, w]) & (score <= top[anchor, w])
                            if inside.any() and best.add(anchor[inside] * windows + w, score[inside], row_id[which[inside]]):
                                # A window that this task has filled asks for no less than its last entry.
                                key, held, _ = best.parts[0]
                                last = np.flatnonzero(np.searchsorted(key, key, "right") - np.searchsorted(key, key) == k)[k - 1 :: k]
                                floor[key[last] // windows, key[last] % windows] = np.maximum(floor[key[last] // windows, key[last] % windows], held[last])
        key, score, row_id = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array((key // windows).astype(np.int32)), pa.array((key % windows).astype(np.int32)), pa.array(score), pa.array(row_id)], names=["a", "w", "score", "id"])

    return rows.mapInArrow(work, "a int, w int, score long, id long")


def first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` over all tasks, with their rank."""
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _at_rank(found: pd.DataFrame, rank: int, shape: tuple[int, int], otherwise: np.ndarray) -> np.ndarray:
    out, mine = otherwise.copy(), found[found["rank"] == rank]
    out[mine["a"], mine["w"]] = np.maximum(out[mine["a"], mine["w"]], mine["score"])
    return out.reshape(shape)


def _filled(rows: DataFrame, sample: DataFrame, block: dict, low: np.ndarray, high: np.ndarray, k: int, same: bool, scale: float, folder: str, ranks) -> list[str]:
    """Folders with (a, w, score, id, rank), the first ``k`` of every window; thresholds sink until windows are full."""
    spark = rows.sparkSession
    todo, folders = low <= high, []
    if not todo.any():
        return folders
    probe = first(search(sample, block, low, high, max(ranks), same, scale), max(ranks)).where(F.col("rank").isin(list(ranks))).toPandas()
    for step, rank in enumerate([*ranks, None]):
        floor = low if rank is None else _at_rank(probe, rank, low.shape, low)
        last = np.flatnonzero((todo & (floor == low)).ravel())
        found = first(search(rows, block, np.where(todo, floor, HIGHEST), np.where(todo, high, LOWEST), k, same, scale), k)
        whole = found.withColumn("n", F.count("*").over(Window.partitionBy("a", "w")))
        # Windows that are searched down to their end are done, the others are if they are full.
        done = spark.createDataFrame(pd.DataFrame({"a": (last // low.shape[1]).astype(np.int32), "w": (last % low.shape[1]).astype(np.int32)}), "a int, w int")
        kept = whole.join(F.broadcast(done.withColumn("last", F.lit(True))), ["a", "w"], "left").where((F.col("n") == k) | F.col("last")).drop("n", "last")
        kept.write.parquet(f"{folder}-{step}")
        folders.append(f"{folder}-{step}")
        full = spark.read.parquet(folders[-1]).where("rank = 1").select("a", "w").toPandas()
        todo = todo & (floor != low)
        todo[full["a"], full["w"]] = False
        if not todo.any():
            break
    return folders


def mine(rows: DataFrame, anchors: Column, row_id: str = "id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, scale: float = 1.0, block_anchors: int = BLOCK_ANCHORS, sample: int = SAMPLE, ranks: tuple[int, ...] = RANKS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row that ``anchors`` holds for.

    Scores are inner products of floor(scale * component). Positives are the first rows of the anchor's label, negatives the first
    of another label with low * positive score <= 100 * score <= high * positive score; higher scores come first, then smaller ids.
    Rows with a NULL id, label, vector or component, or a non-finite one, take no part. Rows are told apart from the anchor by
    their id: a row of the anchor's id is neither its positive nor its negative; other ids that are repeated count once for each
    row, and an anchor's id that is repeated is an anchor as often. Missing dimensions count as 0. Scores have to fit a long.
    Without anchors, positives or negatives there are no rows. Other columns play no part, whatever their names.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    named = rows.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), anchors.alias("anchor"))
    some, asked = named.select("id", "label", "vector"), named.where(F.col("anchor") & F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).select("id", "label", "vector")
    few = some.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0)
    blocks = max(1, -(-asked.count() // block_anchors))
    folder, out = fresh_dir(spark, "negatives"), []
    for k in range(blocks):
        chosen = asked.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == k).toArrow().combine_chunks()
        lists = pa.concat_arrays(chosen["vector"].chunks) if chosen.num_rows else pa.array([], pa.list_(pa.float64()))
        width = pc.max(pc.list_value_length(lists)).as_py() or 0
        x, fit = vectors(lists, width, scale)
        energy = np.argsort(-(x[fit] ** 2).sum(axis=0), kind="stable")
        block = {"id": chosen["id"].to_numpy()[fit], "label": chosen["label"].to_numpy()[fit], "vectors": x[fit][:, energy], "order": energy}
        n = len(block["id"])
        if not n:
            continue
        near = _filled(some, few, block, np.full((n, 1), LOWEST), np.full((n, 1), HIGHEST), positives, True, scale, f"{folder}-{k}-p", ranks)
        best = spark.read.parquet(*near).toPandas()
        score, other = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
        there = np.zeros((n, positives), bool)
        a, j = best["a"].to_numpy(), best["rank"].to_numpy() - 1
        score[a, j], other[a, j], there[a, j] = best["score"], best["id"], True
        floor, top = np.where(there, -((-low * score) // 100), HIGHEST), np.where(there, high * score // 100, LOWEST)
        found = _filled(some, few, block, floor, top, negatives, False, scale, f"{folder}-{k}-n", ranks)
        if not found:
            continue
        a, w = np.nonzero(there)
        pairs = spark.createDataFrame(pd.DataFrame({"a": a.astype(np.int32), "w": w.astype(np.int32), "anchor_id": block["id"][a], "positive_id": other[a, w], "positive_score": score[a, w]}), "a int, w int, anchor_id long, positive_id long, positive_score long")
        done = spark.read.parquet(*found).join(F.broadcast(pairs), ["a", "w"])  # as many pairs as a block has anchors, times positives
        done.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{folder}-{k}")
        out.append(f"{folder}-{k}")
    return spark.read.schema(schema).parquet(*out) if out else spark.createDataFrame([], schema)
