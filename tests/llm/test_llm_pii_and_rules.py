import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import brute
from tracewell.llm import pii, quality_rules

HARD = [
    "a@b.c%d@e.f x@y a.b.c@d..e", "1.2.3.4.5.6.7.8 300.1.1.1 007.8.9.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 5 6", "+1 (375) 555-4393, +49.30 123456-7 +1 2 +123456789012345678",
    "😀 mail me: jo.do+x@exa-mple.co.uk 😀 10.0.0.1", "9" * 3000 + " 12.34.56.78", "x" * 5000 + "@", "a@" * 500 + "b.cc", "call (415) 555-2671 or 415-555-2672; ssn 123-45-6789",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" password=hunter2hunter2hunter2", "version 1.2.3.4 order 4111111111111111", "", None, "jo [at] example [dot] com", "a.b" + ".c" * 4000 + "@d" + ".e" * 4000,
]


def test_base_spans_equal_the_plain_rules(spark):
    rng = random.Random(4)
    pieces = ["a", "@", ".", "1", "23", " ", "-", "+", "(", ")", "é", "😀", "%", "4111111111111111", "\n", "10.0.0.1"]
    texts = HARD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["10.0.0.1 x@y.zz +1 (375) 555-4393 " * 700]  # more matches than are summed in one go
    rows = [(k if k % 7 else None, k, t, "own") for k, t in enumerate(texts)] + [(1, 1, texts[1], "own")]
    df = spark.createDataFrame(rows, "doc_id long, k long, text string, found string").repartition(3)
    got = pii.find(df.withColumn("doc_id", F.col("k"))).select("doc_id", pii.listed("base").alias("base"), pii.listed("spans").alias("spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base == brute.base_spans(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert spans[11] == spans[12] == ""
    assert "phone:5:19" in spans[8] and "secret" in spans[9]


def test_classifier_tells_shapes_apart_and_nothing_is_found_in_plain_text(spark):
    docs = [(k, f"please call the phone ({200 + k}) 555-{1000 + k} today") for k in range(60)] + [(100 + k, f"order {k} of page {k}, version 2.0 and 3 words") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).select("doc_id", pii.listed("spans").alias("spans")).collect()}
    assert all(got[k].startswith("phone:22:") for k in range(60)) and all(got[100 + k] == "" for k in range(60))


def test_pii_without_candidates_or_rows(spark):
    df = spark.createDataFrame([(None, None), (1, "no such thing")], "doc_id long, text string")
    assert [r.spans for r in pii.find(df).collect()] == [[], []]
    assert pii.find(df.limit(0)).count() == 0


def test_base_rules_equal_the_plain_rules(spark):
    rng = random.Random(6)
    texts = HARD + ["".join(rng.choice(["a", "b", " ", "  ", "\n", "#", "\t", "c d e f g ", "é|"]) for _ in range(rng.randrange(80))) for _ in range(120)] + ["q r s t u v " * 2000, "x\r\nx\r\nx"]
    df = spark.createDataFrame([(k, t, 5, True) for k, t in enumerate(texts)] + [(None, "a b", 5, True)], "doc_id long, text string, n_words int, kept boolean")
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    got = quality_rules.judge(df, labels).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id is not None:
            want = brute.base_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r.kept or not r.base_failed)


def test_ratio_equals_a_plain_computation_and_rejects_what_is_not_trusted(spark):
    from math import log

    rng = random.Random(8)
    good, bad = [f"good{k}" for k in range(40)], [f"bad{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choice(good if k % 4 else bad) for _ in range(60))) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 120, 3)], "doc_id long, quality int")
    out = quality_rules.judge(df, labels, threshold=-0.05).cache()
    assert {r.doc_id for r in out.where("kept").collect()} == {k for k in range(120) if k % 4}
    # Buckets as Spark hashes them, everything else by hand.
    grams = {r.doc_id: r.g for r in quality_rules.hashed(df, "text").select("doc_id", F.concat(quality_rules._bucket("__h", 16384), quality_rules._bucket("__h2", 16384)).alias("g")).collect()}
    raw, trusted = {}, {}
    for k, g in grams.items():
        for b in g:
            raw[b] = raw.get(b, 0) + 1
            if k % 3 == 0 and k % 4:
                trusted[b] = trusted.get(b, 0) + 1
    n, m = sum(raw.values()), sum(trusted.values())
    for r in out.collect():
        g = grams[r.doc_id]
        want = sum(round(log((trusted.get(b, 0) + 32) / (m * raw[b] / n + 32)), 5) for b in g) / (len(g) + 10)
        assert abs(r.ratio - want) < 1e-6
    kept = quality_rules.keep_good(df.withColumn("ratio", F.lit("own")), labels, threshold=-0.05)
    assert kept.columns == ["doc_id", "text", "ratio"] and kept.count() == 90


def test_rules_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.ratio, r.kept) for r in quality_rules.judge(df, none).collect()] == [(0.0, True)]
    assert quality_rules.judge(df.limit(0), none).count() == 0


def test_the_threshold_is_a_quantile_of_trusted_texts_outside_the_model(spark):
    rng = random.Random(12)
    words = ["kalo", "mira", "toren", "sul", "venta", "oki", "pram", "dola"]
    rows = [(k, " ".join(rng.choices(words, k=60)), 1) for k in range(600)] + [(1000 + k, " ".join(rng.choices(["zz", "qq", "xx", "ww"], k=60)) + " " + " ".join(rng.sample([f"n{j}" for j in range(900)], 30)), 0) for k in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    held = {r.doc_id for r in docs.where((F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(quality_rules.HELD_SHARE)) == 0) & (F.col("doc_id") < 600)).collect()}
    scores = sorted(out[i].ratio for i in held if not out[i].base_failed)
    limit = scores[max(0, -(-len(scores) * 1 // 1000) - 1)]
    assert 80 < len(scores) < 160
    assert all(r.kept == (not r.base_failed and r.ratio >= limit) for r in out.values())
    assert sum(out[i].kept for i, _, y in rows if y == 1 and not out[i].base_failed) >= 590
    assert not any(out[i].kept for i, _, y in rows if y == 0)


def test_every_trusted_document_counts(spark, monkeypatch):
    """However many there are: the model's counts are of all of them, the threshold is an exact quantile of all that are held."""
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g h i j "), F.concat_ws(" ", F.array_repeat(F.lit("z"), (F.col("id") % 5).cast("int")))).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 24_000, 1).otherwise(0).alias("quality"))
    monkeypatch.setattr(quality_rules, "IDS", 9_000)
    parts = quality_rules.trusted(docs, labels, "doc_id")
    good = reduce(DataFrame.unionByName, parts)
    assert len(parts) == 3 and good.count() == good.distinct().count() == 24_000
    ratios = quality_rules.log_ratios(docs, good, "text", 64)
    scores = sorted(r[0] for r in quality_rules.hashed(good, "text").select(quality_rules.ratio(ratios)).collect())
    for q in (0.00001, 0.001, 0.3):
        found = quality_rules.threshold_of(good, ratios, "text", q)
        assert found == scores[max(0, -int(-q * 24_000 // 1) - 1)]


def _plain_em(patterns, rounds):
    """The label model in plain Python: patterns are (kind, votes, n)."""
    from math import log, exp

    share = {k: {n: {y: {v: 0.6 if v == (1 if y else -1) else 0.3 if v == 0 else 0.1 for v in pii.VOTES} for y in (0, 1)} for n in pii.LABELERS} for k in pii.KINDS}
    prior = {k: 0.7 for k in pii.KINDS}

    def real(k, votes):
        odds = log(prior[k] / (1 - prior[k])) + sum(log(share[k][n][1][v] / share[k][n][0][v]) for n, v in zip(pii.LABELERS, votes))
        return 1 / (1 + exp(-odds))

    for _ in range(rounds):
        q = [real(k, votes) for k, votes, _ in patterns]
        count = {(k, n, v, y): 0.0 for k in pii.KINDS for n in pii.LABELERS for v in pii.VOTES for y in (0, 1)}
        size = {(k, y): 0.0 for k in pii.KINDS for y in (0, 1)}
        for (k, votes, n_rows), p in zip(patterns, q):
            for y, w in ((1, p * n_rows), (0, (1 - p) * n_rows)):
                size[k, y] += w
                for n, v in zip(pii.LABELERS, votes):
                    count[k, n, v, y] += w
        for n in pii.LABELERS:
            for y in (0, 1):
                pooled = {v: sum(count[k, n, v, y] for k in pii.KINDS) + (3.0 if v == (1 if y else -1) else 1.0) for v in pii.VOTES}
                total = sum(pooled.values())
                for k in pii.KINDS:
                    own = {v: count[k, n, v, y] + pii.POOLED * pooled[v] / total for v in pii.VOTES}
                    share[k][n][y] = {v: x / sum(own.values()) for v, x in own.items()}
        prior = {k: min(max((size[k, 1] + 2) / (size[k, 1] + size[k, 0] + 3), 0.01), 0.99) for k in pii.KINDS}
    return {(k, votes): real(k, votes) for k, votes, _ in patterns}, prior


def test_label_model_equals_plain_em_and_tells_kinds_apart(spark):
    """For cards the first labeler is right nine times of ten, for keys it is a coin; the others are right eight times of ten."""
    rng = random.Random(21)
    rows = {}
    for kind, right in (("card", 0.9), ("secret", 0.5)):
        for _ in range(4000):
            y = rng.random() < 0.5
            votes = tuple((1 if (rng.random() < (right if k == 0 else 0.8)) == y else -1) if rng.random() < 0.9 else 0 for k in range(5))
            rows[kind, votes] = rows.get((kind, votes), 0) + 1
    rows["iban", (1, 0, 1, -1, 0)] = 2
    patterns = [(k, v, n) for (k, v), n in rows.items()]
    df = spark.createDataFrame([(k, *v, n) for k, v, n in patterns], "kind string, " + ", ".join(f"{n} int" for n in pii.LABELERS) + ", n long")
    judged, model = pii.estimate(df, 6)
    want, prior = _plain_em(patterns, 6)
    got = {(r.kind, tuple(r[n] for n in pii.LABELERS)): r.real for r in judged.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
    assert all(abs(model["prior"][k] - prior[k]) < 1e-9 for k in pii.KINDS)
    first = pii.LABELERS[0]
    lift = lambda k: model["shares"][k][first][1][1] / model["shares"][k][first][0][1]
    assert lift("card") > 4 > 1.5 > lift("secret") > 0.6


def test_planted_data_is_found_and_look_alikes_are_left_alone(spark):
    """Recall and precision of what the method adds, by kind: planted with a word before it, beside numbers that only look alike."""
    rng = random.Random(22)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, planted = [], []
    for k in range(240):
        kind, text = [("phone", f"call me: ({digits(3)}) 555-{digits(4)}"), ("ssn", f"her ssn is 123-45-{digits(4)}"), ("secret", f'token = "{hexes(40)}"'), (None, f"commit {hexes(40)}"), (None, f"version {digits(1)}.{digits(2)}, order {digits(8)}"), (None, f"page {digits(3)}, figure {digits(2)}")][k % 6]
        rows.append((k, f"some words before {text} and some after"))
        planted.append(kind)
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {k: [s for s in r.spans if s not in r.base] for k, r in out.items()}
    for kind in ("phone", "ssn", "secret"):
        mine = [k for k in range(240) if planted[k] == kind]
        assert sum(any(s.kind == kind for s in added[k]) for k in mine) >= 0.95 * len(mine), kind
    assert sum(bool(added[k]) for k in range(240) if planted[k] is None) <= 2


def test_added_spans_that_overlap_or_repeat(spark):
    """Added spans never overlap base ones; two added spans of different kinds may overlap each other, and none stands twice."""
    text = 'token = "password=hunter2hunter2hunter2" call (415) 555-2671 or +1 (415) 555-2671, mail jo (at) example (dot) com and jo@example.com'
    rows = [(k, f"{text} {k}") for k in range(40)] + [(1, f"{text} 1"), (None, text)]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 42
    for r in out:
        new = [s for s in r.spans if s not in r.base]
        assert all(s.end <= b.start or b.end <= s.start for s in new for b in r.base)
        assert len({(s.kind, s.start, s.end) for s in r.spans}) == len(r.spans)
    same = [[(s.kind, s.start, s.end) for s in r.spans] for r in out if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1]
