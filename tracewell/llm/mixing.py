"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree of levels (domain, language, source). Every node shares its budget among its children by their
weights, but gives none more than it can hold: its tokens times the epochs allowed. What a child can't hold goes to its siblings
by their weights; a node never gets more than its children hold together, so only what all siblings can't take is shared out
at the level above. Each leaf then repeats whole epochs of its documents and fills up with a token-prefix of one more: documents
in an order drawn from seed and epoch, as many as fit.

Only counts of leaves and of pieces of leaves are shuffled. The prefix of a leaf ends at a value of its order; the piece in which
it ends is found from sums by piece, and only that piece is sorted. Documents then compare their own order with that value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import checkpointed, fresh_dir

EPOCHS, SEED = 4, 11
REST = "*"  # in a level's weights: the weight of every value that is not named, NULL too
PIECE_DOCS = 2_000  # documents of a leaf that are sorted together, about
BROADCAST_LEAVES = 50_000  # with more leaves than this, budgets are joined by shuffling


def count_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _name(value: Column) -> Column:
    """A level's value as text that also tells NULL from empty."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def order_of(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in an epoch: 60 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key)), 1, 15), 16, 10).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``given`` for each child: its part of its parent's ``budget``, by ``weight``, no more than ``cap``; all three are columns.

    Children are filled in the order in which they would run full. Those before a child in that order are full if it is, so the
    budget that is left and the weights that are left tell its share. Weights of nought get nothing.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("weight"), "child").rowsBetween(Window.unboundedPreceding, -1)
    live = nodes.where("weight > 0 and cap > 0")
    live = live.withColumns({"cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(order), F.lit(0.0)), "weights": F.sum("weight").over(by)})
    live = live.withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    live = live.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # The first child that doesn't run full sets the level for itself and all after it.
    live = live.withColumn("level", F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("child")))).over(by))
    return live.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))).drop("cap_before", "weight_before", "weights", "level", "full")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    given = weights.get(level)
    if given is None:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in given.items() if k != REST for x in (f"={k}", float(v))], F.lit(REST), F.lit(0.0))
    return F.coalesce(table[F.col("child")], F.lit(float(given.get(REST, 0.0))))


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget: int, epochs: int) -> DataFrame:
    """(one column per level, given): whole tokens for each leaf. ``leaves`` has the levels and tokens. A level that ``weights``
    names gives its other values the weight of ``REST``, or nothing; levels that it doesn't name weigh their values alike."""
    for level in weights:
        # What no weight reaches can't be given; its tokens must not count above.
        leaves = leaves.withColumn("child", F.col(level)).where(_weight(level, weights) > 0).drop("child")
    above = None
    for k, level in enumerate(levels):
        nodes = leaves.groupBy(*levels[: k + 1]).agg((F.sum("tokens") * epochs).cast("double").alias("cap")).withColumn("child", F.col(level)).withColumn("weight", _weight(level, weights))
        nodes = nodes.withColumn("budget", F.lit(float(budget))) if above is None else nodes.join(above.select(*levels[:k], F.col("given").alias("budget")), levels[:k])
        above = share(nodes, levels[:k])
    return above.select(*levels, F.floor(F.col("given") + 1e-6).cast("long").alias("given"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED,
        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The chosen documents with ``epoch`` (from 0): a row for each time that a document is repeated.

    ``levels`` maps each level, from the root down, to a column of ``docs``; ``budget`` is in words, by default as many as there
    are. NULL is a value of a level like others (it weighs like unnamed values). Documents without words take no budget: they come
    with whole epochs of their leaf and with its prefix as their place has it, and a leaf without any words gives none. Rows equal
    in id and text have the same place and go in or stay out together. No documents give no rows. A column named epoch is replaced.
    """
    spark = docs.sparkSession
    names = list(levels)
    at = {n: f"__{n}" for n in names}
    rows = docs.select(*[_name(levels[n]).alias(n) for n in names], count_tokens(F.col(text)).alias("tokens"), key_of(F.col(doc_id), F.col(text)).alias("key"))
    folder = fresh_dir(spark, "mixing")
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    leaves = checkpointed(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    if budget is None:
        budget = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = budgets(leaves, names, weights, budget, epochs)
    plan = leaves.where("tokens > 0").join(given, names).where("given > 0")
    plan = checkpointed(plan.withColumn("whole", F.expr("given div tokens")).withColumn("rest", F.expr("given % tokens")).withColumn("pieces", F.ceil(F.col("docs") / PIECE_DOCS)))
    small = plan.count() <= BROADCAST_LEAVES
    side = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    placed = rows.join(side(plan.where("rest > 0").select(*names, "whole", "rest", "pieces")), names)
    placed = placed.withColumn("place", order_of(seed, F.col("whole"), F.col("key"))).withColumn("piece", F.floor(F.col("place") / F.lit(float(1 << 60)) * F.col("pieces")).cast("long"))
    sums = placed.groupBy(*names, "piece", "rest").agg(F.sum("tokens").alias("tokens"), F.max("place").alias("top"))
    before = Window.partitionBy(*names).orderBy("piece")
    sums = sums.withColumn("until", F.sum("tokens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    fits = sums.where("until <= rest").groupBy(*names).agg(F.max("top").alias("cut"))
    # The first piece that doesn't fit whole is the one in which the prefix ends.
    edge = sums.where("until > rest").groupBy(*names).agg(F.min("piece").alias("piece"), F.min("until").alias("until"), F.min_by("tokens", "piece").alias("held"))
    inside = placed.join(side(edge.select(*names, "piece", (F.col("until") - F.col("held")).alias("start"))), [*names, "piece"])
    # Rows of the same place count together (a range, not rows).
    run = Window.partitionBy(*names, "piece").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    part = inside.withColumn("until", F.col("start") + F.sum("tokens").over(run)).where("until <= rest").groupBy(*names).agg(F.max("place").alias("cut_in"))
    cuts = plan.join(fits, names, "left").join(part, names, "left").select(*[F.col(n).alias(at[n]) for n in names], "whole", F.coalesce("cut_in", "cut", F.lit(-1)).alias("cut"))
    cuts = checkpointed(cuts)

    kept = docs.drop("epoch")
    columns = [F.col(c) for c in kept.columns]
    named = kept.select("*", *[_name(levels[n]).alias(f"__v{n}") for n in names])
    joined = named.join(side(cuts), [F.col(f"__v{n}") == F.col(at[n]) for n in names])
    extra = order_of(seed, F.col("whole"), key_of(F.col(doc_id), F.col(text))) <= F.col("cut")
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return joined.withColumn("__n", copies).where("__n > 0").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("epoch"))
