import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import brute
from tracewell.llm import decontaminate, words


def test_words_equal_wherever_they_stand_and_blocks_do_not_matter(monkeypatch):
    texts = ["Ab c\tAB", None, "", "ab", "ü x" * 50, "a" * 300 + " b", "b " + "a" * 300]
    whole = [h for _, _, h, _ in words.space_separated().blocks(pa.array(texts))][0]
    assert whole[0] == whole[2] == whole[3] and whole[0] != whole[1]
    by_text = lambda reader: [list(h[o[k]:o[k + 1]]) for _, _, h, o in reader.blocks(pa.array(texts)) for k in range(len(o) - 1)]
    first = by_text(words.space_separated())
    assert [len(x) for x in first] == [3, 0, 0, 1, 51, 2, 2] and first[5] == first[6][::-1]
    monkeypatch.setattr(words, "BLOCK", 64)
    small = by_text(words.space_separated())
    assert [len(x) for x in small] == [len(x) for x in first] and small[4] == first[4] and small[5] == small[6][::-1]


def test_runs_are_equal_exactly_where_words_are():
    h = words.mix(np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64))
    r = words.runs(h, 3)
    assert r[0] == r[3] and len(set(r.tolist())) == 5
    assert (words.runs_at(h, np.array([3, 1]), 3) == r[[3, 1]]).all()
    assert len(words.runs(h, 9)) == 0


def _case(rng):
    voc = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(rng.choice([1, 3, 7, 10, 14])))) for k in range(12)] + [(50, None), (51, "!!"), (52, "Zz  q-R")]
    docs = []
    for k in range(40):
        parts = [rng.choice(voc) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((k, ", ".join(parts).upper() if k % 3 else " ".join(parts)))
    return docs + [(90, None), (91, ""), (None, items[2][1]), (3, docs[3][1]), (3, docs[3][1]), (93, "x " * 3000 + items[4][1])], items


def test_overlap_equals_brute_force(spark):
    docs, items = _case(random.Random(3))
    df = spark.createDataFrame([(i, t, "theirs") for i, t in docs], "doc_id long, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.overlap(docs, items)
    for blocks in (500_000, 9):
        got = decontaminate.find_overlap(df, bench, block_windows=blocks).select("doc_id", "n_words", "n_hit", "item_ids").collect()
        assert sorted([(r[0], r[1], r[2], r[3]) for r in got], key=str) == want
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.n_hit) for r in kept.collect()) == sorted((i, "theirs") for i, _, hit, _ in want if not hit)


def test_overlap_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_overlap(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in decontaminate.find_overlap(docs, items.limit(0)).collect()] == [0]
    assert [r.n_hit for r in decontaminate.find_overlap(docs, items.withColumn("item_id", F.lit(None).cast("long"))).collect()] == [2]
