"""Documents that hold passages of benchmark items.

Prefix-filtered set join. An item is cut into windows of ``window`` consecutive words (a shorter item is one window), and a
window into shingles of ``shingle`` words. A document holds a window only if it holds all its shingles, so one necessary token
is enough as its prefix: the shingle that the fewest document positions have. Documents are joined on these prefix tokens,
positional and length bounds drop windows that would stick out of the document, and what is left is verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import Words, letters_and_digits, runs, runs_at

WINDOW, SHINGLE = 10, 5
BLOCK_WINDOWS = 500_000  # windows that are broadcast together; a larger benchmark takes more broadcasts


def _word_list(text: str | None) -> list[str]:
    """The words of a text, as the hashes see them; used to verify."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def item_windows(spark, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """One row per distinct window and item: (item_id, whole, length, words, shingles)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = letters_and_digits()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(ids)):
                rows = {}
                words = _word_list(texts[i].as_py())
                hashes = np.concatenate([h for _, _, h, _ in reader.blocks(texts.slice(i, 1))] or [np.zeros(0, np.uint64)])
                n = min(window, len(words))
                if not n:
                    continue
                whole, parts = runs(hashes, n).view(np.int64), runs(hashes, min(shingle, n)).view(np.int64)
                per = n - min(shingle, n) + 1
                for k in range(len(whole)):
                    rows.setdefault(int(whole[k]), (" ".join(words[k : k + n]), parts[k : k + per].tolist()))
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([ids[i].as_py()] * len(rows), pa.int64()), "whole": pa.array(list(rows), pa.int64()),
                    "length": pa.array([n] * len(rows), pa.int32()), "words": pa.array([v[0] for v in rows.values()], pa.string()),
                    "shingles": pa.array([v[1] for v in rows.values()], pa.list_(pa.int64()))})

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        cut, "item_id long, whole long, length int, words string, shingles array<long>")


def _lookup(keys: np.ndarray, table: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Positions of ``keys`` whose value is in the sorted ``table``; ``small`` is a bit table over the low bits of its values."""
    maybe = np.flatnonzero(small[(keys & np.uint64(len(small) - 1)).astype(np.int64)])
    at = np.searchsorted(table, keys[maybe])
    at[at == len(table)] = 0
    return maybe[table[at] == keys[maybe]] if len(table) else maybe[:0]


def _bits(values: np.ndarray) -> np.ndarray:
    small = np.zeros(1 << max(16, int(len(values)).bit_length() + 3), bool)
    small[(values & np.uint64(len(small) - 1)).astype(np.int64)] = True
    return small


def _frequencies(docs: DataFrame, text: str, wanted) -> DataFrame:
    """(shingle, n): positions of all documents at which a benchmark shingle stands. ``wanted``: broadcast {length: values}."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, tables = letters_and_digits(), {k: (v, _bits(v)) for k, v in wanted.value.items()}
        total = {k: np.zeros(len(v), np.int64) for k, v in wanted.value.items()}
        for batch in batches:
            for _, _, hashes, offsets in reader.blocks(batch.column(0)):
                for length, (values, small) in tables.items():
                    keys = runs(hashes, length)
                    hit = _lookup(keys, values, small)
                    # A run must not cross from one text to the next.
                    hit = hit[offsets[np.searchsorted(offsets, hit, "right")] - hit >= length]
                    total[length] += np.bincount(np.searchsorted(values, keys[hit]), minlength=len(values))
        for length, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(wanted.value[length][seen].view(np.int64)), "n": pa.array(n[seen])})

    return docs.select(text).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


class _Block:
    """Windows of one broadcast: prefix tokens and what hangs on them."""

    def __init__(self, rows: pd.DataFrame, shingle: int):
        self.whole = rows["whole"].to_numpy(np.int64).view(np.uint64)
        self.length = rows["length"].to_numpy(np.int64)
        self.words, self.items = rows["words"].tolist(), rows["items"].tolist()
        self.by_length = {}
        short = np.minimum(self.length, shingle)
        prefix, shift = rows["prefix"].to_numpy(np.int64).view(np.uint64), rows["shift"].to_numpy(np.int64)
        for size in np.unique(short):
            mine = np.flatnonzero(short == size)
            mine = mine[np.argsort(prefix[mine], kind="stable")]
            keys = prefix[mine]
            self.by_length[int(size)] = (keys, shift[mine], mine, _bits(keys))


def _scan(reader: Words, blocks: list[_Block], texts: pa.Array) -> Iterator[tuple[int, int, dict[int, int], set]]:
    """(text, its number of words, {start of a window: its end}, items) for every text."""
    for lo, hi, hashes, offsets in reader.blocks(texts):
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for b, block in enumerate(blocks):
            for size, (keys, shift, windows, small) in block.by_length.items():
                here = runs(hashes, size)
                hit = _lookup(here, keys, small)
                if not len(hit):
                    continue
                first, last = np.searchsorted(keys, here[hit], "left"), np.searchsorted(keys, here[hit], "right")
                pos, k = np.repeat(hit, last - first), np.concatenate([np.arange(a, z) for a, z in zip(first, last, strict=True)])
                doc = np.searchsorted(offsets, pos, "right") - 1
                start, w = pos - shift[k], windows[k]
                # Positional and length bounds: the window has to lie within the document.
                ok = (start >= offsets[doc]) & (start + block.length[w] <= offsets[doc + 1])
                start, w, doc = start[ok], w[ok], doc[ok]
                for length in np.unique(block.length[w]):
                    mine = np.flatnonzero(block.length[w] == length)
                    same = runs_at(hashes, start[mine], int(length)) == block.whole[w[mine]]
                    for s, v, d in zip(start[mine][same], w[mine][same], doc[mine][same], strict=True):
                        found.setdefault(int(d), []).append((int(s - offsets[d]), int(length), b, int(v)))
        for d in range(hi - lo):
            spans, items = {}, set()
            if d in found:
                words = _word_list(texts[lo + d].as_py())
                for s, length, b, v in found[d]:
                    if " ".join(words[s : s + length]) == blocks[b].words[v]:
                        spans[s] = max(spans.get(s, 0), s + length)
                        items.update(blocks[b].items[v])
            yield lo + d, int(offsets[d + 1] - offsets[d]), spans, items


def _covered(spans: dict[int, int]) -> int:
    total, reach = 0, 0
    for start, end in sorted(spans.items()):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def prepare(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> list:
    """Broadcast blocks of windows with their rarest shingle; each holds ``block_windows`` windows at most."""
    spark = docs.sparkSession
    cut = item_windows(spark, items, window, shingle)
    rows = cut.groupBy("whole", "length", "words").agg(F.collect_set("item_id").alias("items"), F.first("shingles").alias("shingles"))
    n = rows.count()
    parts = max(1, -(-n // block_windows))
    blocks = []
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("whole", "words"), F.lit(parts)) == k).toPandas() if parts > 1 else rows.toPandas()
        if not len(part):
            continue
        wanted: dict[int, list] = {}
        for length, shingles in zip(part["length"], part["shingles"], strict=True):
            wanted.setdefault(min(int(length), shingle), []).extend(shingles)
        values = {k: np.unique(np.array(v, np.int64).view(np.uint64)) for k, v in wanted.items()}
        counts = _frequencies(docs, text, spark.sparkContext.broadcast(values)).toPandas()
        rarity = dict(zip(counts["shingle"], counts["n"], strict=True))
        # Rarest first; equal counts by value, so that windows that overlap choose the same shingle.
        best = [min(range(len(s)), key=lambda i, s=s: (rarity.get(s[i], 0), s[i], i)) for s in part["shingles"]]
        part["shift"], part["prefix"] = best, [s[b] for s, b in zip(part["shingles"], best, strict=True)]
        # A window with a shingle that no document holds can't occur.
        part = part[[rarity.get(p, 0) > 0 for p in part["prefix"]]]
        if len(part):
            # Attributes only: executors may have no copy of the class.
            blocks.append(spark.sparkContext.broadcast(vars(_Block(part.sort_values(["whole", "words"]).reset_index(drop=True), shingle))))
    return blocks


def find_overlap(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                 block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents with n_words, n_hit (words inside windows), spans (start and end words of hit stretches) and item_ids.

    ``items`` has item_id and text. Documents are read twice and never shuffled. NULL and empty texts have no words; an item
    without words matches nothing; items with equal windows are all reported; with no documents or no items the result has no
    rows or no hits. Item ids that are NULL still mark words as hit but are not listed. Other columns pass through unless they
    have a name of a result column, which replaces them.
    """
    blocks = prepare(docs, items, text, window, shingle, block_windows)
    out = ["n_words", "n_hit", "spans", "item_ids"]
    kept = docs.drop(*[c for c in out if c in docs.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    added = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, item_ids array<long>"
    column = kept.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, tables = letters_and_digits(), [SimpleNamespace(**b.value) for b in blocks]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n, hit, spans, ids = [], [], [], []
            for _, words, found, items_found in _scan(reader, tables, batch.column(column)):
                n.append(words)
                hit.append(_covered(found))
                spans.append([{"start": s, "end": e} for s, e in sorted(found.items())])
                ids.append(sorted(i for i in items_found if i is not None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, span), pa.array(ids, pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, *out])

    return kept.mapInArrow(scan, f"{schema}, {added}")


def contaminated(threshold: int = 1) -> Column:
    return F.col("n_hit") >= threshold


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any window of any item, with their own columns and whatever names these have."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    found = find_overlap(docs.withColumnsRenamed(names), items, text=names["text"]).where(~contaminated())
    return found.select(*[F.col(v).alias(c) for c, v in names.items()])
