"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows of each source part are counted. How many of them go to each shard is drawn from the multivariate hypergeometric law with
the exact shard sizes as column sums, so every way of dealing the rows is as likely as any other. A row is then permuted within
its part, which tells its shard and its number among the shard's rows, and permuted again within the shard, which tells its slot.
The rows move once, to the block of slots they belong to.

The matrix is never built. A binary tree over the parts splits the shard sizes between left and right parts, each split with a
seed of its own, so that a task walks down to its part and gets the part's row of the matrix and the sum of the rows before it:
as many draws as the tree is deep, times the shards. The second permutation is computed number by number (a Feistel network on
just enough bits, walked until it falls inside the shard), so no task holds a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import mix
from tracewell.session import fresh_dir

BLOCK_ROWS = 65_536  # slots of a shard that are laid out together
ROUNDS = 8  # of the second permutation


def _rng(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(list(key))))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Draws as numpy does; beyond its limit of 10^9 rows by inversion around the mode."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if good + bad else 0
    lo, hi = max(0, n - bad), min(n, good)
    mean = n * good / (good + bad)
    sd = (mean * bad / (good + bad) * max(good + bad - n, 1) / (good + bad - 1)) ** 0.5
    a, z = max(lo, int(mean - 40 * sd - 40)), min(hi, int(mean + 40 * sd + 40))
    k = np.arange(a, z, dtype=np.float64)
    # p(k + 1) / p(k)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    start = sum(s * lgamma(x + 1) for s, x in ((1, good), (-1, a), (-1, good - a), (1, bad), (-1, n - a), (-1, bad - n + a)))
    logs = start + np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(total, rng.random() * total[-1], "right"))


def _split(rng: np.random.Generator, columns: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows drawn from ``sum(columns)`` rows belong to each column."""
    total = int(columns.sum())
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(columns, n, method="marginals") if n else np.zeros_like(columns)
    out, rest = np.zeros_like(columns), total
    for k, c in enumerate(columns.tolist()):
        rest -= c
        out[k] = _hypergeometric(rng, c, rest, n)
        n -= int(out[k])
    return out


def matrix_row(counts: np.ndarray, columns: np.ndarray, part: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``part``, sum of the rows before it) of the matrix with row sums ``counts`` and column sums ``columns``."""
    before = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, mine, sent = 0, len(counts), columns.astype(np.int64), np.zeros(len(columns), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(_rng(seed, 1, lo, hi), mine, int(before[mid] - before[lo]))
        if part < mid:
            hi, mine = mid, left
        else:
            lo, mine, sent = mid, mine - left, sent + left
    return mine, sent


def permuted(at: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where a permutation of range(size), chosen by ``key``, sends the numbers ``at``."""
    half = max(1, -(-max(size - 1, 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence([key, size]).generate_state(ROUNDS, np.uint64)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[todo] = (left << np.uint64(half)) | right
        # At most four times as many numbers have these bits; those outside go on until they fall inside.
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart, larger ones first."""
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row with ``shard`` (0 to shards - 1) and ``slot`` (from 0, without gaps), laid out by shard and slot.

    The rows are first written to the shared folder, so that parts and the places of rows in them stay what they were when a
    task runs again. Rows count as they come: repeated rows, NULLs and empty texts are rows like others, and equal rows go their
    separate ways. No rows give no rows; fewer rows than shards leave some shards empty. Columns named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    kept = docs.drop("shard", "slot")
    names = {c: f"c{i}" for i, c in enumerate(kept.columns)}
    folder = fresh_dir(spark, "sharding")
    kept.withColumnsRenamed(names).write.parquet(folder)
    stored = spark.read.schema(", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields))).parquet(folder)
    placed = stored.select("*", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("place"))
    sizes = placed.groupBy("part").count().orderBy("part").collect()  # one row for each file
    counts = np.array([r["count"] for r in sizes], np.int64)
    limits = shard_sizes(int(counts.sum()), shards)
    plan = spark.sparkContext.broadcast(({r["part"]: i for i, r in enumerate(sizes)}, counts, limits))
    tail = len(names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, rows, wanted = plan.value

        @lru_cache(maxsize=2)
        def part_plan(name: str):
            k = numbers[name]
            row, sent = matrix_row(rows, wanted, k, seed)
            return _rng(seed, 2, k).permutation(int(rows[k])), np.cumsum(row), row, sent

        for batch in batches:
            shard, slot = np.empty(len(batch), np.int32), np.empty(len(batch), np.int64)
            parts = batch.column(tail).dictionary_encode()
            which, place = parts.indices.to_numpy(), batch.column(tail + 1).to_numpy()
            for k, name in enumerate(parts.dictionary.to_pylist()):
                mine = np.flatnonzero(which == k)
                order, ends, row, sent = part_plan(name)
                drawn = order[place[mine]]
                shard[mine] = np.searchsorted(ends, drawn, "right")
                slot[mine] = sent[shard[mine]] + drawn - (ends - row)[shard[mine]]
            for k in np.unique(shard):
                mine = np.flatnonzero(shard == k)
                slot[mine] = permuted(slot[mine], int(wanted[k]), seed * 1_000_003 + int(k))
            yield pa.RecordBatch.from_arrays([*batch.columns[:tail], pa.array(shard), pa.array(slot)], names=[*batch.schema.names[:tail], "shard", "slot"])

    own = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields))
    dealt = placed.mapInArrow(deal, f"{own}, shard int, slot long")
    # Blocks are the unit of the exchange: a shard of any size spreads over tasks.
    out = dealt.repartition("shard", F.floor(F.col("slot") / block_rows)).sortWithinPartitions("shard", "slot")
    return out.withColumnsRenamed({v: k for k, v in names.items()})
