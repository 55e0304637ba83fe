"""Merkle manifest of a dataset: digests of rows, one tree for each group, a tree over the groups, and a proof for every row.

Sibling-shift self-joins. A node has a tree, a number in its level and the number of nodes there. Its siblings are the other slots
of its run of ``fanout`` consecutive numbers, so their numbers are computed (node XOR 1 in a binary tree, slot offsets otherwise)
and every level is equijoined with itself on (tree, number). What a node gains is all that its proof needs of the level: the
digests before and after its own. The rows of slot zero, which have all of their run, then emit the parents.

Levels shrink by the fanout, so all of them together cost little more than the first. Each is checkpointed. Proofs are put together
from the top down: a node's steps are its own and its parent's. Digests travel as 32 bytes and are written out where they are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import checkpointed, fresh_dir

FANOUT = 8
STEP = "struct<before:binary,after:binary>"  # digests of the siblings to the left and right of a node


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if NULL, else its UTF-8 byte count, a colon and the value (integers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated strings, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(value: Column) -> Column:
    """Digests, one or several after each other, as lower-case hex text."""
    return F.lower(F.hex(value))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place among the rows of ``group`` by ``order``, and ``n``, their number.

    Range partitions over (group, order) are written with the place of each row, so that places hold when tasks run again; the
    number of earlier rows is known by (partition, group), of which there are no more than partitions and groups together.
    """
    spark = rows.sparkSession
    folder = fresh_dir(spark, "merkle")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(folder)
    stored = spark.read.parquet(folder).withColumn("__part", F.shiftright("__at", 33))
    counts = stored.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", group, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("n"))
    return stored.join(counts, ["__part", group]).withColumn("i", F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__at", "__first", "__before")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``before`` and ``after`` for each of the nodes (tree, i, n, digest) that has siblings or a parent."""
    inner = nodes.where("n > 1")
    slot = F.pmod("i", F.lit(fanout))
    shifts = F.sequence(F.lit(1), F.lit(fanout - 1))
    wanted = inner.select("tree", "i", F.explode(F.transform(shifts, lambda s: F.col("i") - slot + F.pmod(slot + s, F.lit(fanout)))).alias("sibling"))
    found = wanted.join(inner.select("tree", F.col("i").alias("sibling"), F.col("digest").alias("other")), ["tree", "sibling"])
    gathered = found.groupBy("tree", "i").agg(F.array_sort(F.collect_list(F.struct("sibling", "other"))).alias("s"))  # fanout - 1 entries at most

    def side(test) -> Column:
        return F.aggregate(F.filter("s", test), F.lit(b""), lambda a, x: F.concat(a, x["other"]))

    steps = gathered.select("tree", "i", side(lambda x: x["sibling"] < F.col("i")).alias("before"), side(lambda x: x["sibling"] > F.col("i")).alias("after"))
    # A run of one node has no siblings, but a parent.
    return inner.join(steps, ["tree", "i"], "left").select("tree", "i", "n", "digest", F.coalesce("before", F.lit(b"")).alias("before"), F.coalesce("after", F.lit(b"")).alias("after"))


def levels(leaves: DataFrame, fanout: int) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes that have a parent, with their siblings; nodes that have none) of each level from the leaves (tree, i, n, digest) up."""
    out, nodes = [], leaves
    tallest = leaves.agg(F.max("n")).first()[0] or 0
    while tallest > 1:
        inner = checkpointed(with_siblings(nodes, fanout))
        out.append((inner, nodes.where("n = 1")))
        first = inner.where(F.pmod("i", F.lit(fanout)) == 0)
        nodes = first.select("tree", (F.col("i") / fanout).cast("long").alias("i"), F.ceil(F.col("n") / fanout).alias("n"),
                             digest(hexed(F.col("digest")), hexed(F.col("after"))).alias("digest"))
        tallest = -(-tallest // fanout)
    out.append((None, nodes.where("n = 1")))
    return out


def paths(tiers: list[tuple[DataFrame, DataFrame]], above: DataFrame, fanout: int) -> DataFrame:
    """(tree, i, steps, and what else ``above`` has) of the leaves. ``above``: (tree, steps, ...) of each tree's own top."""
    below = None
    for inner, tops in reversed(tiers):
        here = tops.select("tree", "i").join(above, "tree")
        if inner is not None:
            up = below.withColumnRenamed("i", "parent")
            mine = inner.withColumn("parent", (F.col("i") / fanout).cast("long")).join(up, ["tree", "parent"])
            step = F.struct("before", "after")
            here = here.unionByName(mine.withColumn("steps", F.concat(F.array(step), "steps")).drop("parent", "n", "digest", "before", "after"))
        below = here
    return below


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(hexed(s["before"]), hexed(acc), hexed(s["after"])))


def proof_digest(steps: Column) -> Column:
    """SHA-256 over the hex text of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.aggregate(steps, F.lit(""), lambda acc, s: F.concat(acc, hexed(s["before"]), hexed(s["after"]))).cast("binary"), 256)


def manifest(rows: DataFrame, group: str, order: str, fields: list[str], fanout: int = FANOUT, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``rows``: ``order``, ``leaf``, ``subroot``, ``root`` (bytes) and ``steps``, its proof from leaf to root.

    ``leaf`` hashes the ``fields``. Leaves of a group ascend by ``order``, NULL first and ties by digest; equal rows are leaves of
    their own. Groups ascend by name, NULL, which is a group too, first. ``extra`` columns are computed from the rows and carried
    along; texts are not. No rows give no rows. Other columns of ``rows`` play no part, whatever their names.
    """
    if fanout < 2:
        raise ValueError("a node needs two children at least")
    extra = extra or {}
    # A NULL group sorts before and is never equal to a named one.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = rows.select(tree.alias("tree"), F.col(order).alias("key"), digest(*[field(F.col(c)) for c in fields]).alias("digest"), *[v.alias(f"x_{k}") for k, v in extra.items()])
    # Written first: sorting by ranges looks at its input twice, and texts should be read and hashed once.
    hashed = fresh_dir(rows.sparkSession, "merkle-leaves")
    leaves.write.parquet(hashed)
    leaves = checkpointed(numbered(rows.sparkSession.read.schema(leaves.schema).parquet(hashed), "tree", ["key", "digest", *[f"x_{k}" for k in extra]]))
    tiers = levels(leaves.select("tree", "i", "n", "digest"), fanout)
    subroots = tiers[0][1]
    for _, tops in tiers[1:]:
        subroots = subroots.unionByName(tops)
    subroots = checkpointed(numbered(subroots.select(F.lit(0).alias("all"), F.col("tree").alias("name"), F.col("digest")), "all", ["name"]))
    upper = levels(subroots.select(F.lit(0).alias("tree"), "i", "n", "digest"), fanout)
    root = upper[-1][1].select(F.col("digest").alias("root"))
    top = root.first()  # one row, or none without rows
    ends = paths(upper, rows.sparkSession.range(1).select(F.lit(0).alias("tree"), F.array().cast(f"array<{STEP}>").alias("steps")), fanout)
    above = subroots.join(ends.drop("tree"), "i").select(F.col("name").alias("tree"), "steps", F.col("digest").alias("subroot"))
    proofs = paths(tiers, above, fanout)
    out = leaves.join(proofs, ["tree", "i"])
    return out.select(F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", F.lit(bytes(top["root"]) if top else None).cast("binary").alias("root"),
                      "steps", *[F.col(f"x_{k}").alias(k) for k in extra])
