"""Node vectors by skip-gram with negative sampling, trained in rotating blocks.

Nodes are dealt to blocks by a hash. In round r of an epoch, task b holds the node vectors of block b and the context vectors of
block b + r, and goes over the pairs of just these two blocks, so no task holds more than two blocks and no vector is in two
tasks at once. After as many rounds as there are blocks every pair has been seen. Negative contexts come from the context block
at hand, in proportion to their count to the power 3/4.

Pairs are weighted by how often they stand together and steps are scaled by each vector's own history of gradients. Pairs come in the
order of a hash and draws are seeded by epoch, round and block, so equal seeds give equal vectors whatever runs again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.embedding import cooccurrence
from tracewell.session import checkpointed, fresh_dir, remove_dir

BLOCK_NODES = 50_000  # nodes of a block, about
BATCH_PAIRS = 512  # pairs of one step
VECTORS = "block int, id string, count double, vec array<double>, history double"


def _start(dim: int, salt: str, seed: int) -> Column:
    """A small vector fixed by the node's name."""
    part = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id", i), F.lit(1 << 30)).cast("double") / float(1 << 30) - 0.5) / dim
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), part)


class Block:
    """Vectors of one block in a task."""

    def __init__(self, rows: list[dict]):
        self._set(pa.array([r["id"] for r in rows], pa.string()), np.array([r["count"] for r in rows], float), np.array([r["vec"] for r in rows], float), np.array([r["history"] for r in rows], float))

    def _set(self, ids: pa.Array, count: np.ndarray, vec: np.ndarray, history: np.ndarray) -> None:
        self.ids, self.count, self.vec, self.history = ids, count, vec, history

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        table = table.combine_chunks()
        block, column = cls.__new__(cls), lambda c: table.column(c).to_numpy().copy()
        vec = pc.list_flatten(table.column("vec")).to_numpy().reshape(len(table), -1).copy()
        block._set(table.column("id").combine_chunks(), column("count"), vec, column("history"))
        return block

    def move(self, at: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        """One step for the vectors at ``at``, which may repeat: gradients of a vector are added up first."""
        which, inverse = np.unique(at, return_inverse=True)
        dim = self.vec.shape[1]
        total = np.bincount((inverse[:, None] * dim + np.arange(dim)).ravel(), gradient.ravel(), len(which) * dim).reshape(-1, dim)
        self.history[which] += (total * total).mean(1)
        self.vec[which] -= rate * total / np.sqrt(self.history[which] + 1e-8)[:, None]


def step(nodes: Block, contexts: Block, a: np.ndarray, b: np.ndarray, weight: np.ndarray, draw: np.ndarray, rate: float) -> None:
    """Pairs (a, b) come closer, a and each of its ``draw``n contexts move apart."""
    x, near, far = nodes.vec[a], contexts.vec[b], contexts.vec[draw]
    pull = weight * (1 / (1 + np.exp(-(x * near).sum(1))) - 1)
    push = weight[:, None] / draw.shape[1] / (1 + np.exp(-np.einsum("nd,nkd->nk", x, far)))
    back = pull[:, None] * near + np.einsum("nk,nkd->nd", push, far)
    ahead = np.concatenate([pull[:, None] * x, (push[:, :, None] * x[:, None, :]).reshape(-1, x.shape[1])])
    contexts.move(np.concatenate([b, draw.ravel()]), ahead, rate)
    nodes.move(a, back, rate)


def _trained(parts: Iterator[pa.Table], seed: tuple, negatives: int, rate: float) -> Iterator[tuple[int, Block]]:
    """The two blocks of a task after its pairs. ``parts``: its rows in stretches, vectors (kind 0 and 1) before pairs (kind 2)."""
    held: tuple[list, list] = ([], [])
    blocks = odds = rng = None
    left = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # pairs that don't fill a step yet

    def go(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> None:
        draw = np.searchsorted(odds, rng.random((len(a), negatives)) * odds[-1], "right")
        step(blocks[0], blocks[1], a, b, weight, np.minimum(draw, len(odds) - 1), rate)

    for part in parts:
        kind = part.column("kind").to_numpy()
        for k in (0, 1):
            if (mine := kind == k).any():
                held[k].append(part.filter(pa.array(mine)))
        pairs = part.filter(pa.array(kind == 2))
        if not len(pairs):
            continue
        if blocks is None:
            blocks = [Block.of(pa.concat_tables(h)) for h in held]
            odds, rng = np.cumsum(blocks[1].count**0.75), np.random.default_rng(seed)
        fresh = [pc.index_in(pairs.column(c), block.ids).to_numpy() for c, block in zip(("id", "other"), blocks, strict=True)] + [pairs.column("count").to_numpy()]
        a, b, n = (np.concatenate(x) for x in zip(left, fresh, strict=True))
        full = len(a) - len(a) % BATCH_PAIRS
        for at in range(0, full, BATCH_PAIRS):
            some = slice(at, at + BATCH_PAIRS)
            go(a[some], b[some], n[some])
        left = [a[full:], b[full:], n[full:]]
    if blocks is None:
        blocks = [Block.of(pa.concat_tables(h)) if h else None for h in held]
    elif len(left[0]):
        go(*left)
    for k, block in enumerate(blocks):
        if block is not None:
            yield k, block


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.Table]]]:
    """(task, its rows in stretches), for rows in the order of their tasks. Stretches must be gone over before the next task is asked for."""
    def cut() -> Iterator[tuple[int, pa.Table]]:
        for batch in batches:
            task = batch.column("task").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    yield int(task[lo]), pa.Table.from_batches([batch.slice(lo, hi - lo)])

    for task, run in groupby(cut(), key=lambda x: x[0]):
        yield task, (part for _, part in run)


def _place() -> Column:
    """One number that goes by task, kind and the first bits of the turn: a sort on it compares numbers that lie side by side, where
    equal tasks and kinds would have every comparison look the rows up."""
    turn = F.shiftrightunsigned(F.col("turn").bitwiseXOR(F.lit(-(2**63))), 23)
    return F.col("task").cast("long") * F.lit(1 << 43) + F.col("kind").cast("long") * F.lit(1 << 41) + turn


def embed(walks: DataFrame, dim: int = 32, window: int = 5, epochs: int = 5, negatives: int = 5, rate: float = 0.1, seed: int = 42, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(id, vec) of the nodes that stand near another one on some walk; vectors are never on the driver."""
    pairs = checkpointed(cooccurrence(walks, window).where("a is not null and b is not null and a <> b"))
    counts = checkpointed(pairs.groupBy(F.col("a").alias("id")).agg(F.sum("n").cast("double").alias("count")))
    blocks = max(1, -(-counts.count() // block_nodes))
    of = lambda c: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(blocks)).cast("int")
    mean = pairs.agg(F.avg("n")).first()[0] or 1.0
    # Weights around 1: a pair that stands together often counts more, but a few do not drown the rest. Stored by round, so that a
    # round reads its own pairs only.
    folder, ba, bb = fresh_dir(walks.sparkSession, "pairs"), of(F.col("a")), of(F.col("b"))
    cells = pairs.select("a", "b", F.sqrt(F.col("n") / mean).alias("w"), ba.alias("ba"), F.xxhash64(F.lit(seed), "a", "b").alias("turn"), F.pmod(bb - ba, F.lit(blocks)).alias("round"))
    schema = cells.drop("round").schema
    cells.write.partitionBy("round").parquet(folder)
    stored = {r[0] for r in cells.select("round").distinct().collect()}  # a round without pairs changes nothing
    nodes, contexts = (checkpointed(counts.select(of(F.col("id")).alias("block"), "id", "count", _start(dim, salt, seed).alias("vec"), F.lit(0.0).alias("history"))) for salt in ("node", "context"))
    # What a row lacks is empty, not NULL: Arrow goes over a run of NULL texts or lists again for every row that is added to a batch.
    for epoch in range(epochs):
        for r in range(blocks):
            if r not in stored:
                continue
            table = lambda df, kind, task: df.select(task.cast("int").alias("task"), F.lit(kind).alias("kind"), "id", F.lit("").alias("other"), "count", "vec", "history", F.lit(0).cast("long").alias("turn"))
            asked = walks.sparkSession.read.schema(schema).parquet(f"{folder}/round={r}").select(
                F.col("ba").alias("task"), F.lit(2).alias("kind"), F.col("a").alias("id"), F.col("b").alias("other"), F.col("w").alias("count"), F.array().cast("array<double>").alias("vec"), F.lit(0.0).alias("history"), "turn")
            rows = table(nodes, 0, F.col("block")).unionByName(table(contexts, 1, F.pmod(F.col("block") - r, F.lit(blocks)))).unionByName(asked)

            def work(batches: Iterator[pa.RecordBatch], epoch=epoch, r=r) -> Iterator[pa.RecordBatch]:
                for task, parts in _by_task(batches):
                    for kind, block in _trained(parts, (seed, epoch, r, task), negatives, rate):
                        own = task if kind == 0 else (task + r) % blocks
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(block.ids), pa.int32()), pa.array([own] * len(block.ids), pa.int32()), block.ids, pa.array(block.count),
                                                          pa.array(list(block.vec), pa.list_(pa.float64())), pa.array(block.history)], names=["kind", "block", "id", "count", "vec", "history"])

            dealt = rows.repartition(blocks, "task").sortWithinPartitions(_place(), "turn", "id", "other")
            moved = checkpointed(dealt.mapInArrow(work, f"kind int, {VECTORS}"))
            nodes, contexts = moved.where("kind = 0").drop("kind"), moved.where("kind = 1").drop("kind")
    remove_dir(walks.sparkSession, folder)
    return nodes.select("id", "vec")
