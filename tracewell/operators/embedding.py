"""Random walks, node embeddings and structural similarity."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import hashed_number
from tracewell.operators.ordering import positions
from tracewell.session import checkpointed

MAX_NODES = 2**31 - 1  # the factorisation numbers nodes as integers


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected simple neighbours, numbered per node, with the degree on both ends.

    A node's list stays as rows (node, number), so a hub never becomes one value or one task.
    """
    one = edges.select("src", "dst")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    listed = positions(both, ["src"], ["dst"], "slot")
    return (listed.join(degree.select(F.col("src").alias("dst"), F.col("deg").alias("dst_deg")), "dst")
            .select(F.col("src").alias("node"), "slot", F.col("dst").alias("next"), F.col("dst_deg").alias("next_deg")))


def random_walks(edges: DataFrame, n: int = 10, length: int = 15, seed: int = 42, cut_every: int = 5) -> DataFrame:
    """``n`` uniform walks of ``length`` nodes from every node; each step is a hash of the walk, so runs agree.

    A walker carries its node's degree and joins on (node, slot): walkers standing on a hub spread over
    all the hub's slots.
    """
    table = checkpointed(neighbours(edges))
    starts = table.select(F.col("next").alias("start"), F.col("next_deg").alias("deg")).distinct()
    walks = starts.select("start", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("walk"), F.col("start").alias("node"),
                          "deg", F.array("start").alias("path"))
    for i in range(1, length):
        pick = hashed_number(F.lit(seed), "start", "walk", F.lit(i)) % F.col("deg") + 1
        moved = walks.withColumn("slot", pick).join(table, ["node", "slot"])
        walks = moved.select("start", "walk", F.col("next").alias("node"), F.col("next_deg").alias("deg"),
                             F.array_append("path", F.col("next")).alias("path"))
        if i % cut_every == 0 or i == length - 1:
            walks = checkpointed(walks)
    return walks.select("start", "walk", "path")


def _together(walks: DataFrame, window: int) -> DataFrame:
    """(a, b, n): how often two nodes stand within ``window`` steps of each other, each pair of nodes once, in whichever order it has."""
    at = walks.select("path", F.posexplode("path").alias("_i", "_x"))
    near = at.select("_x", F.explode(F.slice("path", F.col("_i") + 2, window)).alias("_y"))
    x, y = F.col("_x"), F.col("_y")
    ordered = F.coalesce((x <= y) | y.isNull(), F.lit(False))
    return near.groupBy(F.when(ordered, x).otherwise(y).alias("a"), F.when(ordered, y).otherwise(x).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of :func:`_together` from both ends; a node near itself stands there twice."""
    same = F.col(a).eqNullSafe(F.col(b))
    ends = F.when(same, F.array(F.struct(a, b))).otherwise(F.array(F.struct(a, b), F.struct(F.col(b).alias(a), F.col(a).alias(b))))
    return pairs.select(F.explode(ends).alias("_e"), F.when(same, F.col("n") * 2).otherwise(F.col("n")).alias("n")).select(f"_e.{a}", f"_e.{b}", "n")


def cooccurrence(walks: DataFrame, window: int = 5) -> DataFrame:
    """How often two nodes stand within ``window`` steps of each other; walks are short, so pairs per walk are few."""
    return _both_ways(_together(walks, window), "a", "b")


def embed(walks: DataFrame, dim: int = 32, window: int = 5, epochs: int = 5, seed: int = 42) -> DataFrame:
    """Node vectors from walks: implicit factorisation of walk co-occurrence. Both factor tables stay distributed, at any size."""
    ids = checkpointed(positions(walks.select(F.col("start").alias("id")).distinct(), [], ["id"], "no"))
    if (ids.agg(F.max("no")).first()[0] or 0) > MAX_NODES:
        raise ValueError(f"at most {MAX_NODES} nodes can be embedded")
    # Counted, shuffled and numbered in one order only, and stored: the factorisation asks twice for its ratings.
    a = ids.select(F.col("id").alias("a"), F.col("no").cast("int").alias("ia"))
    b = ids.select(F.col("id").alias("b"), F.col("no").cast("int").alias("ib"))
    numbered = checkpointed(_together(walks, window).join(a, "a").join(b, "b").select("ia", "ib", "n"))
    ratings = _both_ways(numbered, "ia", "ib").withColumn("n", F.col("n").cast("float"))
    model = ALS(rank=dim, maxIter=epochs, implicitPrefs=True, userCol="ia", itemCol="ib", ratingCol="n",
                checkpointInterval=2, seed=seed).fit(ratings)
    factors = model.userFactors.select(F.col("id").alias("ia"), F.col("features").cast("array<double>").alias("vec"))
    return factors.join(a, "ia").select(F.col("a").alias("id"), "vec")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; a missing or zero vector gives 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    raw = F.try_divide(dot(a, b), norms)
    return F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).otherwise(0.0)


def similar(vecs: DataFrame, account: str, k: int = 5, min_sim: float = 0.5, prefix: str | None = "ACC_",
            id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """The k nodes most like the account; the account's one vector is a scalar subquery."""
    target = vecs.where(F.col(id_col) == account).agg(F.first(vec_col))
    others = vecs.where(F.col(id_col) != account)
    if prefix:
        others = others.where(F.col(id_col).startswith(prefix))
    scored = others.withColumn("_t", target.scalar()).where(F.col("_t").isNotNull()).select(
        F.col(id_col).alias("account_id"), cosine(F.col(vec_col), F.col("_t")).alias("_sim"))
    return (scored.where(F.col("_sim") >= min_sim)
            .select("account_id", F.round("_sim", 4).alias("structural_similarity"))
            .orderBy(F.desc("structural_similarity"), "account_id").limit(k))


def cohesion(cycles: DataFrame, vecs: DataFrame) -> DataFrame:
    """Mean pairwise cosine of a ring's members (at most 15 pairs per ring); members without a vector count 0."""
    members = cycles.select("path", F.posexplode("path").alias("i", "id"))
    placed = members.join(vecs.select("id", "vec"), "id", "left")
    rings = placed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "vec"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(
        F.filter("m", lambda b: b["i"] > a["i"]), lambda b: cosine(a["vec"], b["vec"]))))
    mean = F.try_divide(F.aggregate("_p", F.lit(0.0), lambda s, x: s + x), F.size("_p").cast("double"))
    return rings.withColumn("_p", pairs).select("path", F.coalesce(mean, F.lit(0.0)).alias("cohesion"))
