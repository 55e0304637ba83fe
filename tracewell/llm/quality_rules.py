"""Quality rules: countable base rules, and a log-likelihood ratio between trusted text and the raw corpus.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets, of the trusted target
(documents that are labelled good) and of the whole raw corpus, give each bucket a log ratio; a document's score is the mean over
its n-grams, so length doesn't matter. A document is kept when its score reaches a threshold, which is a low quantile of the scores of
trusted documents that the model was not made from. What the raw corpus has more of than trusted text scores low.

A bucket's log ratio is log((t + s) / (e + s)): t its count in the target, s the smoothing, e the count that a target of this size
would have if it were drawn from the raw corpus. Without smoothing that is the ratio of the two multinomials.

Everything is DataFrame functions. The corpus is counted with map-side combination into at most ``BUCKETS`` groups, and the table
of log ratios, of fixed size, goes into the scoring expression as a constant.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import checkpointed, fresh_dir, remove_dir

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 16_384
SMOOTHING = 32.0  # n-grams added to every bucket, to those found in the target and to those that the raw corpus leads one to expect
IDS = 1_000_000  # trusted ids that are broadcast at a time
REPEAT_WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
HELD_SHARE, QUANTILE = 5, 0.001  # one trusted document of five makes no part of the model; so much of these may fall below the threshold
SHRINK = 10  # n-grams of ratio 0 that every text has besides its own: few words prove little


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _chained(hashes: Column, n: Column, shift: int, other: Column) -> Column:
    """Hash of each element of ``hashes`` with the element of ``other`` that stands ``shift`` places on; ``n`` results."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(other, F.lit(shift + 1), n), lambda a, b: F.xxhash64(a, b))


def hashed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __h and __h2: hashes of all words and of all pairs of neighbours.

    Each layer uses the array below it more than once, so Spark keeps it as a column of its own and evaluates it once a row.
    """
    out = docs.withColumn("__h", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    return out.withColumn("__h2", _chained(F.col("__h"), F.size("__h") - 1, 1, F.col("__h")))


def base_columns(docs: DataFrame, text: str) -> DataFrame:
    """``hashed(docs)`` with the base counts.

    Repeated words are those inside windows of five words that the text has more than once, by 64-bit hashes of the windows. Only
    texts with equal hashes are looked at closer: with the windows sorted by hash, equal ones are neighbours, and with their places
    sorted, each covers what the one before it leaves.
    """
    h, h2 = F.col("__h"), F.col("__h2")
    out = hashed(docs, text).withColumn("__h4", _chained(h2, F.size(h) - 3, 2, h2))
    out = out.withColumn("__h5", _chained(F.col("__h4"), F.size(h) - 4, 4, h))
    h5 = F.col("__h5")
    ranked = F.sort_array(F.zip_with(h5, F.sequence(F.lit(1), F.size(h5)), lambda a, i: F.struct(a.alias("h"), i.alias("i"))))
    out = out.withColumn("__seen", F.when(F.size(F.array_distinct(h5)) < F.size(h5), ranked))
    seen = F.col("__seen")
    same = F.filter(seen, lambda s, j: (F.coalesce(F.get(seen, j + 1)["h"] == s["h"], F.lit(False))) | F.coalesce(F.get(seen, j - 1)["h"] == s["h"], F.lit(False)))
    places = F.sort_array(F.transform(same, lambda s: s["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-REPEAT_WINDOW).alias("last")),
                          lambda a, i: F.struct((a["n"] + F.least(F.lit(REPEAT_WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumns({
        "n_words": F.size("__h").cast("long"),
        "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("__h4", "__h5", "__seen")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _bucket(hashes: str, buckets: int) -> Column:
    return F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def counts(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(bucket, n) of all words and pairs of neighbouring words of all documents."""
    found = hashed(docs.select(F.col(text).alias("text")), "text")
    return found.select(F.explode(F.concat(_bucket("__h", buckets), _bucket("__h2", buckets))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def trusted(docs: DataFrame, labels: DataFrame, doc_id: str) -> list[DataFrame]:
    """All documents labelled good, in parts; ids that are also labelled bad are left out.

    The texts are never shuffled: a part is what about ``IDS`` ids pick from all documents, so that a broadcast keeps its size.
    """
    good = checkpointed(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low")).where("low = 1").select(F.col("doc_id").alias("__good")))
    parts = max(1, -(-good.count() // IDS))
    mine = lambda k: good.where(F.pmod(F.xxhash64("__good", F.lit("part")), F.lit(parts)) == k)
    return [docs.join(F.broadcast(mine(k)), docs[doc_id] == good["__good"], "left_semi") for k in range(parts)]


def log_ratios(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_target / p_raw) for each bucket; all 0 if either side has no words."""
    raw = {r[0]: r[1] for r in counts(docs, text, buckets).collect()}  # buckets rows at most
    good = {r[0]: r[1] for r in counts(target, text, buckets).collect()}
    n_raw, n_good = sum(raw.values()), sum(good.values())
    if not n_raw or not n_good:
        return [0.0] * buckets
    # Both sides get the same counts besides their own, so that a bucket of which little is expected says little.
    return [log((good.get(b, 0) + smoothing) / (n_good * raw.get(b, 0) / n_raw + smoothing)) for b in range(buckets)]


def ratio(ratios: list[float]) -> Column:
    """Mean log ratio of a text's n-grams and ``SHRINK`` more of ratio 0; 0 without any. The table is a constant that Spark folds once."""
    table = F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, b: a + F.get(table, F.pmod(b, F.lit(len(ratios))).cast("int")))
    return F.when(F.size("__h") > 0, (total("__h") + total("__h2")) / (2 * F.size("__h") - 1 + SHRINK)).otherwise(F.lit(0.0))


def threshold_of(held: DataFrame, ratios: list[float], text: str, quantile: float = QUANTILE) -> float:
    """The ``quantile`` of the scores of held trusted documents that pass the base rules, as the lower of its neighbours; with none,
    nothing falls below."""
    scored = base_columns(held.select(F.col(text).alias("text")), "text").withColumns({"ratio": ratio(ratios), "__row": F.monotonically_increasing_id()})
    # No filter: pushed below the columns that it is made of, it would evaluate each array anew. NULLs count for nothing.
    scored = scored.select(F.when(~base_failed() & (F.col("__row") >= 0), F.col("ratio")).alias("ratio"))
    # Of all scores only those up to the quantile are put in order.
    scores = checkpointed(scored).where("ratio is not null")
    n = scores.count()
    return scores.orderBy("ratio").limit(max(1, ceil(quantile * n))).agg(F.max("ratio")).head()[0] if n else float("-inf")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float | None = None,
          buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio and kept.

    ``threshold``: the least score of a kept document. If it is not given, :func:`threshold_of` finds it from one trusted document
    of ``HELD_SHARE``, and the others make the model.

    ``labels`` has doc_id and quality (1: trusted). NULL and empty texts have no words, score 0 and fail the base rules; with no
    trusted documents every ratio is 0 and the base rules decide alone. A NULL or repeated doc_id is judged by its text like any
    other row. Columns that have the name of a result are replaced, all others pass through.
    """
    folder = fresh_dir(docs.sparkSession, "trusted")
    for part in trusted(docs, labels, doc_id):
        part.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).write.mode("append").parquet(folder)
    chosen = docs.sparkSession.read.parquet(folder)
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(HELD_SHARE)) == 0
    # With a threshold given none need be held back.
    target = chosen.where(~held) if threshold is None else chosen
    ratios = log_ratios(docs.select(F.col(text).alias("text")), target, "text", buckets, smoothing)
    if threshold is None:
        threshold = threshold_of(chosen.where(held), ratios, "text")
    remove_dir(docs.sparkSession, folder)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]
    # The row number stands in the verdict so that a filter on it stays above the columns that it is made of: pushed below them, it
    # would evaluate each array anew wherever it is used.
    out = base_columns(docs.drop(*names), text).withColumns({"ratio": ratio(ratios), "__row": F.monotonically_increasing_id()}).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold) & (F.col("__row") >= 0)).drop("__h", "__h2", "__row")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float | None = None) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns and whatever names these have."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = judge(docs.withColumnsRenamed(names), labels, names[text], names[doc_id], threshold).where("kept")
    return kept.select(*[F.col(v).alias(c) for c, v in names.items()])
