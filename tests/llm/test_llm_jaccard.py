import glob
import random
import time

import pytest

import brute
from tracewell.llm import jaccard_join


def _docs(rng):
    voc = [f"w{k}" for k in range(300)]
    docs, passage = [], [rng.choice(voc) for _ in range(60)]
    for g in range(22):
        base = [rng.choice(voc) for _ in range(rng.choice([3, 5, 6, 12, 40, 80]))]
        if g % 3 == 0:
            base = base[:10] + passage
        for k in range(rng.choice([1, 1, 2, 5, 14])):
            x = list(base)
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = rng.choice(voc)
            docs.append((len(docs), " ".join(x).title() if k % 2 else "\n".join(x)))
    n = len(docs)
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t"), (None, docs[0][1]), (None, "only here we are alone now"), (3, docs[3][1]), (3, docs[3][1]), (n + 3, "z " * 4000)]


@pytest.mark.parametrize("seed", [11, 12])
def test_classes_equal_brute_force(spark, seed):
    docs = _docs(random.Random(seed))
    df = spark.createDataFrame([(i, t, b"x") for i, t in docs], "doc_id long, text string, node binary").repartition(4)
    want = brute.jaccard_classes(docs)
    got = jaccard_join.classes(df, chunk_tokens=700, range_tokens=900).collect()
    assert sorted([tuple(r) for r in got], key=str) == want
    if seed == 11:
        kept = jaccard_join.keep_one_of_each(df, chunk_tokens=700, range_tokens=900)
        assert kept.columns == df.columns
        ids = [r.doc_id for r in kept.collect()]
        with_words = {c for _, n, c in want if n}
        assert sorted(ids, key=str) == sorted([*with_words, *[i for i, n, _ in want if not n]], key=str)


def test_a_group_of_edited_copies_makes_pairs_with_its_pivot_only(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    docs = [(0, " ".join(base))]
    for k in range(1, 150):
        x = list(base)
        for _ in range(rng.randrange(1, 4)):
            x[rng.randrange(120)] = f"e{k}"
        docs.append((k, " ".join(x)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = jaccard_join.candidates(df, "text", 116 * 150, 5, 80).cache()
    links, _ = jaccard_join.links_between_sets(found, 80, 3)
    assert links.count() < 2 * 150
    assert sorted([tuple(r) for r in jaccard_join.classes(df).collect()], key=str) == brute.jaccard_classes(docs)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.classes(df).count() == 0 and jaccard_join.keep_one_of_each(df).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in jaccard_join.components(links).collect()}
    assert len(got) == 43 and {v for k, v in got.items() if k[0] < 100} == {b"\x00"} and got[b"\xf1"] == b"\xf0"


def test_no_shuffle_files_are_left_on_the_executors_disks(spark):
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for folder in folders for f in glob.glob(f"{folder}/**/shuffle_*", recursive=True)}
    docs = spark.createDataFrame(_docs(random.Random(13)), "doc_id long, text string")
    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    jaccard_join.assigned(docs, "doc_id", "text", 5, 80, 3, 1 << 19, 1 << 20)
    left = files() - before
    deadline = time.time() + 10  # removal goes by message
    while left and time.time() < deadline:
        time.sleep(0.2)
        left &= files()
    assert not left and spark.conf.get(setting) == was
