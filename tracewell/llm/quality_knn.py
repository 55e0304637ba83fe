"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text is counted into hashed terms: pairs of neighbouring bytes, words, and words that repeat the word before. Counts are damped,
weighted by rarity among the labelled texts and projected on the leading singular directions of the labelled texts (latent
semantic analysis). The labelled vectors are broadcast, a fixed number of fixed length; exact cosines of every document with all
of them are computed block by block, and the labels of the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import Words

SAMPLE = 2_000  # labelled documents at most, chosen by a hash of the id
PAIRS, WORDS = 1024, 512  # hashed terms of each kind
DIMENSIONS, NEIGHBOURS = 48, 25
POWER = 8.0  # a neighbour's weight is its cosine to this power
PRIOR = 0.5  # weight of the labelled texts' mean label in every vote
BLOCK_BYTES, BLOCK_DOCS = 1 << 19, 128


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _reader() -> Words:
    table = np.ones(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return Words(table, lower=False)


def _pair_table() -> np.ndarray:
    codes = np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (codes >> np.uint64(40)).astype(np.int64) % PAIRS


def term_counts(reader: Words, pairs: np.ndarray, texts: pa.Array) -> np.ndarray:
    """One row of hashed term counts for each text; a long text is counted in pieces."""
    out = np.zeros((len(texts), PAIRS + WORDS + 1), np.float32)
    for lo, hi, hashes, offsets in reader.blocks(texts):
        doc = np.repeat(np.arange(hi - lo), np.diff(offsets))
        width = WORDS + 1
        cells = np.bincount(doc * width + (hashes & np.uint64(WORDS - 1)).astype(np.int64), minlength=(hi - lo) * width)
        same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])) + 1
        cells += np.bincount(doc[same] * width + WORDS, minlength=(hi - lo) * width)
        out[lo:hi, PAIRS:] = cells.reshape(hi - lo, width)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts):
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        for lo in range(int(at[0]), max(int(at[-1]) - 1, int(at[0])), BLOCK_BYTES):
            hi = min(lo + BLOCK_BYTES, int(at[-1]) - 1)
            term = pairs[data[lo:hi].astype(np.int64) * 256 + data[lo + 1 : hi + 1]]
            doc = np.searchsorted(at, np.arange(lo, hi), "right") - 1 if hi - lo < 64 else _owners(at, lo, hi)
            inside = at[doc + 1] > np.arange(lo + 1, hi + 1)  # a pair lies within one text
            first = int(doc[0]) if len(doc) else 0
            n = (int(doc[-1]) - first + 1) if len(doc) else 0
            out[first : first + n, :PAIRS] += np.bincount((doc[inside] - first) * PAIRS + term[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    return out


def _owners(at: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The text of every byte from lo to hi."""
    a, z = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
    ends = np.clip(at[a : z + 1], lo, hi)
    return np.repeat(np.arange(a, z), np.diff(ends))


def _damped(counts: np.ndarray) -> np.ndarray:
    """Log counts, each kind of term to unit length, so that a text's length doesn't matter."""
    out = np.log1p(counts)
    share = counts[:, -1] / np.maximum(counts[:, PAIRS:-1].sum(1), 1)
    for part in (out[:, :PAIRS], out[:, PAIRS:-1]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    out[:, -1] = share
    return out


def _batches(texts: pa.Array) -> Iterator[pa.Array]:
    for k in range(0, len(texts), BLOCK_DOCS):
        yield texts.slice(k, BLOCK_DOCS)


class Model:
    """Projection and labelled vectors, fitted on term counts and 0/1 labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        terms = _damped(counts)
        self.weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = terms * self.weight
        self.centre = x.mean(0) if len(x) else np.zeros(x.shape[1], np.float32)
        centred = x - self.centre
        _, vectors = np.linalg.eigh((centred.T @ centred).astype(np.float64))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS], np.float32)
        self.vectors = self.project(counts)

    @classmethod
    def of(cls, state: dict) -> Model:
        """The model whose attributes were broadcast: executors may have no copy of this class."""
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = (_damped(counts) * self.weight - self.centre) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes of blocks of always the same shape, filled up with empty rows: last digits depend on the shape of a product."""
        blocks = [counts[k : k + BLOCK_DOCS] for k in range(0, len(counts), BLOCK_DOCS)]
        full = lambda b: b if len(b) == BLOCK_DOCS else np.concatenate([b, np.zeros((BLOCK_DOCS - len(b), b.shape[1]), b.dtype)])
        return np.concatenate([self._vote(full(b))[: len(b)] for b in blocks]) if blocks else np.zeros(0)

    def _vote(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        # Cosines to five places; equal ones go by place.
        near = np.rint((self.project(counts) @ self.vectors.T).astype(np.float64) * 1e5).astype(np.int64)
        k, n = min(NEIGHBOURS, near.shape[1]), near.shape[1]
        best = np.argpartition(np.arange(n) - near * n, k - 1, axis=1)[:, :k]
        best.sort(axis=1)
        weight = np.maximum(np.take_along_axis(near, best, 1) / 1e5, 0) ** POWER
        return (PRIOR * self.prior + (weight * self.labels[best]).sum(1)) / (PRIOR + weight.sum(1))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of up to ``sample`` labelled documents outside the held-out quarter; ids with different labels are left out."""
    may = labels.where(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("chosen")).agg(
        F.min(label).alias("y"), F.max(label).alias("top")).where("y = top")
    # Bounded by ``sample`` rows; ids without a document take none of it, as they are met with the ids of documents first.
    ids = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("chosen")).distinct()
    chosen = may.join(ids, "chosen").select("chosen", "y").orderBy(F.xxhash64("chosen", F.lit("sample")), "chosen").limit(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, pairs = _reader(), _pair_table()
        for batch in batches:
            for k in range(0, len(batch), BLOCK_DOCS):
                part = batch.slice(k, BLOCK_DOCS)
                counts = term_counts(reader, pairs, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(counts), pa.list_(pa.float32()))], names=["id", "y", "terms"])

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("chosen")).select("id", "text", F.col("y").cast("int").alias("y"))
    rows = texts.mapInArrow(count, "id long, y int, terms array<float>").dropDuplicates(["id"]).toPandas().sort_values("id")
    counts = np.stack(rows["terms"].to_list()) if len(rows) else np.zeros((0, PAIRS + WORDS + 1), np.float32)
    return Model(counts, rows["y"].to_numpy(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``score``, 0 to 1, higher where label 1 is likelier. NULL and empty texts are scored alike, as a text
    without terms; with nothing learned every score is 0.5. A column named score is replaced."""
    spark = docs.sparkSession
    kept = docs.drop("score")
    column = kept.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    shared = spark.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, pairs, m = _reader(), _pair_table(), Model.of(shared.value)
        for batch in batches:
            scores = [m.score(term_counts(reader, pairs, part)) for part in _batches(batch.column(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, f"{schema}, score double")
