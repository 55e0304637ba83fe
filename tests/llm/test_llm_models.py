import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import language_id, quality_knn

LANGS = {"aa": ["kalo", "mira", "toren", "sul", "venta", "oki"], "bb": ["strum", "gloph", "wrent", "shab", "zelch", "prin"]}


def _texts(rng, lang, n):
    return [" ".join(rng.choice(LANGS[lang]) + rng.choice(["", "s", "a"]) for _ in range(rng.randrange(20, 80))) for _ in range(n)]


def longest_match_phrases(train, text):
    """Greedy cross-parsing by looking for substrings: phrases of ``text``, each as long as ``train`` has it."""
    n = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at:at + size + 1] in train:
            size += 1
        at += max(size, 1)
        n += 1
    return n


@pytest.mark.parametrize("dense", [64, 3, 1])
def test_automaton_parses_as_the_longest_matches_do(monkeypatch, dense):
    """With few columns in the table, most symbols are looked up one by one."""
    monkeypatch.setattr(language_id, "DENSE", dense)
    rng = np.random.default_rng(3)
    for _ in range(30):
        train = rng.integers(0, 6, rng.integers(1, 60)).astype(np.int32)
        text = rng.integers(0, 7, rng.integers(1, 80)).astype(np.int32)
        automaton = {**language_id._automaton(train), "symbols": 7}
        assert automaton["states"] <= 2 * len(train) + 1
        as_text = lambda x: "".join(chr(97 + c) for c in x)
        assert language_id._phrases(*language_id._table(automaton), text[None, :])[0] == longest_match_phrases(as_text(train), as_text(text))


def test_texts_are_parsed_as_the_longest_matches_do():
    """Whole texts, alphabets that differ, letters that a language or all lack."""
    rows = pd.DataFrame([("aa", 1, "kalo mira toren"), ("bb", 2, "шкаф мир кот"), ("cc", 3, "漢字仮名 交じり文")], columns=["lang", "id", "text"])
    parser = language_id.Parser(language_id.learn(rows))
    texts = ["Kalo, mira!", "КОТ мир x", "漢字 kalo", "q", "", "12", "文字 ω"]
    phrases, sizes, letters = parser.phrases(texts)
    assert letters.tolist() == [True, True, True, True, False, False, True]
    for k, lang in enumerate(parser.langs):
        own = "".join(c if c.isalpha() else " " for c in rows["text"][k].lower())
        for t, got in zip(texts, phrases[:, k]):
            shown = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower()))
            # Letters that the language lacks end every phrase, whichever they are.
            assert got == longest_match_phrases(own, shown), (lang, t)


def test_twenty_scripts_keep_their_own_alphabets(spark):
    """Each language writes with some 90 letters of its own: more than any joint alphabet of 62, all told 1 800."""
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x3400, 0x3400 + 1800)]
    rows = []
    for k in range(20):
        own = letters[90 * k : 90 * k + 90]
        words = ["".join(rng.choices(own, k=rng.randrange(1, 4))) for _ in range(80)]
        rows += [(100 * k + n, " ".join(rng.choices(words, k=30)), f"l{k:02d}") for n in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.labelled(df, "doc_id", "text", "lang")
    got = language_id.predict(df, sample).where(language_id.held_out(F.col("doc_id"))).collect()
    assert len(got) > 30 and all(r.lang_pred == r.lang for r in got)
    model = language_id.learn(sample)
    assert min(a["symbols"] for a in model["automata"]) > 62


def test_whole_texts_are_learned_from(spark):
    """The language shows only in the second half of long texts."""
    rng = random.Random(8)
    same = " ".join(rng.choice(["kos", "mul"]) for _ in range(30_000))
    rows = [(k, f"{same} {' '.join(_texts(rng, lang, 60))}", lang) for lang in LANGS for k in range(4 * (lang == "bb"), 4 + 4 * (lang == "bb"))]
    rows += [(100 + k, t, None) for k, t in enumerate(_texts(rng, "aa", 5) + _texts(rng, "bb", 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.labelled(df, "doc_id", "text", "lang")
    assert sample["text"].str.len().max() < 4 * language_id.TRAIN_CHARS + 100
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, sample).collect()}
    assert [got[100 + k] for k in range(10)] == ["aa"] * 5 + ["bb"] * 5


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(k, "kalo mira toren sul venta " * 40, lang) for k, lang in enumerate(["bb", "aa"] * 8)], "doc_id long, text string, lang string")
    got = language_id.predict(df, language_id.labelled(df, "doc_id", "text", "lang")).collect()
    assert {r.lang_pred for r in got} == {"aa"} and all(abs(r.score - 0.5) < 1e-9 for r in got)


def test_languages_on_held_out_texts_and_odd_ones(spark):
    rng = random.Random(2)
    rows = [(k, t, lang, "own") for lang in LANGS for k, t in enumerate(_texts(rng, lang, 60), 1000 * (lang == "bb"))]
    odd = [(5000, None, "aa", "own"), (5001, "", None, "own"), (5002, "123 !?", "bb", "own"), (None, "KALO Mira", None, "own"), (5003, "kalo " * 60000, None, "own"), (5004, "日本語", None, "own"), (3, rows[3][1], "aa", "own")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    sample = language_id.labelled(df, "doc_id", "text", "lang")
    got = language_id.predict(df, sample).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    known = [r for r in got if r.doc_id is not None and r.doc_id < 5000]
    assert sum(r.lang_pred == r.lang for r in known) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 for r in got)
    assert [by[k].lang_pred for k in (5000, 5001, 5002)] == ["und"] * 3 and by[None].lang_pred == by[5003].lang_pred == "aa"
    assert by[5004].lang_pred in LANGS
    assert {r.lang_pred for r in language_id.predict(df, sample.iloc[:0]).collect()} == {"und"}
    assert language_id.predict(df.limit(0), sample).count() == 0


def test_sample_is_bounded_and_leaves_the_held_out_quarter_alone(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("xx").alias("lang"))
    sample = language_id.labelled(df, "doc_id", "text", "lang", per_language=50)
    out = spark.createDataFrame(sample).where(language_id.held_out(F.col("id")))
    assert len(sample) == 50 and out.count() == 0


def test_term_counts_do_not_depend_on_blocks(monkeypatch):
    texts = pa.array(["aa bb bb", None, "", "é" * 400, "one two " * 100, "x"])
    reader, pairs = quality_knn._reader(), quality_knn._pair_table()
    whole = quality_knn.term_counts(reader, pairs, texts)
    one_by_one = np.concatenate([quality_knn.term_counts(reader, pairs, texts.slice(k, 1)) for k in range(len(texts))])
    assert (whole == one_by_one).all() and whole[0, -1] == 1 and not whole[1:3].any()
    assert whole[0, :quality_knn.PAIRS].sum() == len("aa bb bb") - 1 and whole[3, :quality_knn.PAIRS].sum() == 799
    monkeypatch.setattr(quality_knn, "BLOCK_BYTES", 100)
    assert (quality_knn.term_counts(reader, pairs, texts) == whole).all()


def _quality(rng, n):
    good = [(k, " ".join(rng.choice(LANGS["aa"]) for _ in range(rng.randrange(10, 90))), 1) for k in range(n)]
    return good + [(n + k, " ".join(w.upper() + "!!" for w in rng.choices(LANGS["bb"], k=rng.randrange(10, 90))), 0) for k in range(n // 3)]


def test_scores_of_held_out_texts(spark):
    rows = _quality(random.Random(9), 240)
    df = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows] + [(None, None, 7.0), (9001, "", 7.0), (9002, "Z" * 300000, 7.0), (5, rows[5][1], 7.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, 0), (8888, 1)], "doc_id long, quality int")
    got = quality_knn.score(df, quality_knn.fit(df, labels)).withColumn("h", quality_knn.held_out(F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in rows}
    held = [(r.score >= 0.7, truth[r.doc_id]) for r in got if r.h and r.doc_id in truth]
    assert sum(p == bool(y) for p, y in held) >= 0.95 * len(held) and len(got) == len(rows) + 4
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[None] == by[9001]


def test_vote_equals_plain_cosines():
    rng = np.random.default_rng(1)
    counts = rng.poisson(1.0, (80, quality_knn.PAIRS + quality_knn.WORDS + 1)).astype(np.float32)
    labels = rng.integers(0, 2, 80)
    model = quality_knn.Model(counts, labels)
    query = counts[:5] + rng.poisson(0.1, (5, counts.shape[1])).astype(np.float32)
    z = model.project(query)
    for k, got in enumerate(model.score(query)):
        cosines = sorted(((float(z[k] @ v), int(y)) for v, y in zip(model.vectors, labels, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
        weights = [max(c, 0) ** quality_knn.POWER for c, _ in cosines]
        want = (quality_knn.PRIOR * labels.mean() + sum(w * y for w, (_, y) in zip(weights, cosines, strict=True))) / (quality_knn.PRIOR + sum(weights))
        assert got == pytest.approx(want, rel=1e-4)


def test_a_score_does_not_depend_on_the_block_and_ties_go_by_place():
    rng = np.random.default_rng(2)
    counts = rng.poisson(1.0, (300, quality_knn.PAIRS + quality_knn.WORDS + 1)).astype(np.float32)
    counts[100:200] = counts[100]  # many equal neighbours
    model = quality_knn.Model(counts, rng.integers(0, 2, 300))
    query = np.concatenate([counts[95:130], counts[:40] + 1])
    whole = model.score(query)
    assert (whole == np.concatenate([model.score(query[k:k + 1]) for k in range(len(query))])).all()
    assert (quality_knn.Model.of(vars(model)).score(query) == whole).all()


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_knn.score(df, quality_knn.fit(df, none)).collect()] == [0.5]
    assert quality_knn.score(df.limit(0), quality_knn.fit(df, none)).count() == 0
    assert isinstance(language_id.learn(pd.DataFrame({"lang": [], "id": [], "text": []}))["langs"], list) and re.match("u", "und")
