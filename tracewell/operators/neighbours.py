"""Nearest-neighbour joins: exact by pivots and distance bounds, and approximate by random hyperplanes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.embedding import dot
from tracewell.session import checkpointed

PIVOTS = 64  # pivots of a group
SLICES = 16  # shells of a pivot's cell, by distance from the pivot
FEW_GROUPS = 1000  # groups whose pivots and cells are sent to all tasks
SLACK = 1e-9  # relative; keeps rounding from losing a neighbour at a bound


def distance(a: Column, b: Column, dim: int | None = None) -> Column:
    """Euclidean distance; with ``dim`` as one plain expression, summed in the same order, that is compiled where pairs are many."""
    if dim:
        total = F.lit(0.0)
        for i in range(dim):
            gap = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
            total = total + gap * gap
        return F.sqrt(total)
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _first(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts each task's rows to ``n`` before they are shuffled."""
    return rows.withColumn("_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_no") <= n)


def cells(points: DataFrame, by: str, k: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(points with ``to``, their distances from all pivots of their group, ``cell`` and ``d``; per group its ``cells``).

    A cell is what lies nearest to one pivot. It is known by its radius and by the k + 1 smallest distances from the pivot.
    """
    chosen = _first(points.select(by, "x"), [by], [F.xxhash64("x"), "x"], pivots)
    listed = chosen.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_no", "x"))).alias("_p"))
    to = F.transform("_p", lambda p: distance(F.col("x"), p["x"]))
    # A point costs many distances and few bytes: dealt to as many tasks as shuffles have, not by size, and joined where it lies if
    # there are few groups.
    near_all = F.broadcast if points.select(by).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else lambda df: df
    dealt = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v")
    placed = checkpointed(dealt.join(near_all(listed), dealt[by].eqNullSafe(listed[by])).drop(listed[by]).withColumn("to", to).drop("_p")
                          .withColumn("d", F.array_min("to")).withColumn("cell", F.array_position("to", F.col("d")).cast("int")))
    near = _first(placed.select(by, "cell", "d"), [by, "cell"], ["d"], k + 1)
    radius = placed.groupBy(by, "cell").agg(F.max("d").alias("radius"))
    low = near.groupBy(by, "cell").agg(F.array_sort(F.collect_list("d")).alias("low"))
    both = radius.alias("r").join(low.alias("l"), F.col(f"r.{by}").eqNullSafe(F.col(f"l.{by}")) & (F.col("r.cell") == F.col("l.cell")))
    summary = both.groupBy(F.col(f"r.{by}").alias(by)).agg(F.collect_list(F.struct(F.col("r.cell").alias("cell"), "radius", "low")).alias("cells"))
    return placed, near_all(summary)


def _shell(d: Column, radius: Column) -> Column:
    return F.when(radius > 0, F.least(F.floor(d / radius * SLICES), F.lit(SLICES - 1))).otherwise(0).cast("int")


def candidates(placed: DataFrame, summary: DataFrame, by: str, k: int) -> DataFrame:
    """Pairs (v, w) of points that the bounds can't tell apart as too far: (``by``, v, w, x, other_x, most).

    ``most`` bounds the distance of the k-th neighbour from above: a point w of cell j is no further from v than v is from
    the pivot and the pivot from w. A cell is visited if the ball of that radius reaches into it, and of the cell the shells
    whose distance from the pivot the triangle inequality allows.
    """
    rows = placed.alias("a").join(summary.alias("s"), F.col(f"a.{by}").eqNullSafe(F.col(f"s.{by}"))).select("a.*", "cells")
    at = lambda c: F.element_at("to", c["cell"])
    uppers = F.sort_array(F.flatten(F.transform("cells", lambda c: F.transform(c["low"], lambda l: at(c) + l))))
    rows = rows.withColumn("most", F.when(F.size(uppers) > k, F.element_at(uppers, k + 1) * (1 + SLACK)).otherwise(F.lit(float("inf"))))
    own = F.element_at(F.filter("cells", lambda c: c["cell"] == F.col("cell")), 1)["radius"]
    members = rows.select(F.col(by).alias("_by"), "cell", _shell(F.col("d"), own).alias("shell"), F.col("v").alias("w"), F.col("x").alias("other_x"), F.col("d").alias("_d"))
    reach = F.filter("cells", lambda c: at(c) - c["radius"] <= F.col("most") * (1 + SLACK) + SLACK)
    visits = rows.select(by, "v", "x", "most", F.explode(F.transform(reach, lambda c: F.struct(
        c["cell"].alias("cell"), c["radius"].alias("radius"), (at(c) - F.col("most")).alias("lo"), (at(c) + F.col("most")).alias("hi")))).alias("c"))
    edge = SLACK * (1 + F.col("c.radius"))
    low, high = F.greatest(F.lit(0.0), F.col("c.lo") - edge), F.least(F.col("c.radius"), F.col("c.hi") + edge)
    asked = visits.select(by, "v", "x", "most", F.col("c.cell").alias("cell"), low.alias("_lo"), (high + edge).alias("_hi"),
                          F.explode(F.sequence(_shell(low, F.col("c.radius")), _shell(high, F.col("c.radius")))).alias("shell"))
    met = asked.join(members, F.col(by).eqNullSafe(F.col("_by")) & (asked["cell"] == members["cell"]) & (asked["shell"] == members["shell"]))
    return met.where(F.col("_d").between(F.col("_lo"), F.col("_hi"))).select(by, "v", "w", "x", "other_x", "most")


def nearest(rows: DataFrame, cols: list[str], by: str, unique: str, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """Exact k nearest neighbours inside each group: (``by``, id, other, ox, d, rank), ties by id.

    Equal vectors are searched for once, with the k + 1 smallest of their ids, so copies form no pairs. Rows with a NULL among
    ``cols`` take no part; a NULL group is a group. A group of fewer than k + 1 rows has fewer neighbours.
    """
    whole = " and ".join(f"`{c}` is not null" for c in cols)
    base = checkpointed(rows.where(whole).select(by, F.col(unique).alias("id"), F.array(*[F.col(c).cast("double") + 0.0 for c in cols]).alias("x")))
    ids = _first(base, [by, "x"], ["id"], k + 1).groupBy(by, "x").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = checkpointed(ids.withColumn("v", F.monotonically_increasing_id()))
    placed, summary = cells(points.select(by, "v", "x"), by, k, pivots)
    pairs = candidates(placed, summary, by, k).withColumn("d", distance(F.col("x"), F.col("other_x"), len(cols))).where(F.col("d") <= F.col("most"))
    named = pairs.select("v", "w", "other_x", "d").join(points.select(F.col("v").alias("w"), "ids"), "w").select("v", "other_x", "d", F.explode("ids").alias("other"))
    best = _first(named, ["v"], ["d", "other"], k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("d", "other", F.col("other_x").alias("ox")))).alias("near"))
    found = points.select(by, "x", "v").join(best, "v").select(F.col(by).alias("_by"), F.col("x").alias("_x"), "near")
    mine = base.join(found, base[by].eqNullSafe(found["_by"]) & (base["x"] == found["_x"]))
    others = F.slice(F.filter("near", lambda n: n["other"] != F.col("id")), 1, k)
    return mine.select(by, "id", F.posexplode(others).alias("_at", "_n")).select(by, "id", "_n.other", "_n.ox", "_n.d", (F.col("_at") + 1).alias("rank"))


# ---- similar vectors by random hyperplanes

TABLES, BITS, STEP = 16, 24, 2
TILE = 16_384  # vectors of a bucket that one task compares with those asked for
BLOCK = 256  # vectors asked for that are compared at a time
ROUNDING = 1e-12
PROBES = 64  # vectors whose neighbours are also sought by brute force, to see what the index finds


def signatures(vecs: DataFrame, id_col: str, vec_col: str, dim: int, tables: int, seed: int) -> DataFrame:
    """(v, vec, table, bits): on which side of ``BITS`` random hyperplanes a vector lies, as a string of 0 and 1, for every table."""
    planes = np.random.default_rng(seed).normal(size=(tables * BITS, dim))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(batch), -1)
            side = (x @ planes.T > 0).astype("S1").reshape(len(batch), tables, BITS)
            side = np.where(side == b"T", b"1", b"0")
            bits = np.ascontiguousarray(side).view(f"S{BITS}").astype(str).reshape(len(batch), tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits.tolist(), pa.list_(pa.string()))], names=["v", "vec", "bits"])

    kind = vecs.schema[id_col].dataType.simpleString()
    signed = vecs.select(F.col(id_col).alias("v"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(work, f"v {kind}, vec array<double>, bits array<string>")
    return signed.select("v", "vec", F.posexplode("bits").alias("table", "bits"))


def buckets(signed: DataFrame, limit: int) -> DataFrame:
    """(v, table, bucket): signatures cut to as many bits as leave ``limit`` vectors in a bucket, about.

    Heavy buckets are split by further bits; what is heavy with all its bits is dealt out by a hash, another one in each table, so
    that vectors that point the same way meet in one table or another.
    """
    todo, done, length = signed.select("v", "table", "bits"), None, 1
    while True:
        cut = todo.withColumn("bucket", F.substring("bits", 1, length))
        n = checkpointed(cut.groupBy("table", "bucket").agg(F.count("*").alias("n")))
        sized = cut.join(n, ["table", "bucket"])
        fit = sized.where(F.col("n") <= limit).select("v", "table", "bucket")
        done = fit if done is None else done.unionByName(fit)
        if not n.where(F.col("n") > limit).head(1):
            return done
        heavy = sized.where(F.col("n") > limit)
        if length == BITS:
            part = F.pmod(F.xxhash64("v", "table"), F.ceil(F.col("n") / limit).cast("int"))
            return done.unionByName(heavy.select("v", "table", F.concat("bucket", F.lit("/"), part).alias("bucket")))
        todo, length = checkpointed(heavy.select("v", "table", "bits")), min(length + STEP, BITS)


def _tiles(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """(table, bucket, tile, v, own, ask): the members of a bucket (``own``) dealt to tiles of about ``TILE``, and those of them that are
    ``asked`` (v) sent to all of its tiles, so that no task holds more than a tile and what is asked of it."""
    n = placed.groupBy("table", "bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = placed.join(n, ["table", "bucket"]).join(asked.select("v", F.lit(True).alias("ask")), "v", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
    home = F.pmod(F.xxhash64("v", F.lit(3)), F.col("tiles")).cast("int")
    where = F.when(F.col("ask"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(home))
    return rows.select("table", "bucket", "v", "ask", home.alias("_home"), F.explode(where).alias("tile")).withColumn("own", F.col("tile") == F.col("_home")).drop("_home")


def _judged(placed: DataFrame, asked: DataFrame, points: DataFrame, k: int, min_sim: float) -> DataFrame:
    """(v, w, similarity, ids) of the ``k`` + 1 points (more if they tie) that are most similar to an ``asked`` one, itself included, in
    each of its buckets; ``ids`` are those of w. A bucket is gone over in products of blocks, so that the pairs in it are never rows."""
    kind = points.schema["v"].dataType.simpleString()

    def work(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        v, own, ask = (tile.column(c).to_numpy() for c in ("v", "own", "ask"))
        x = pc.list_flatten(tile.column("u")).to_numpy().reshape(len(v), -1)
        them, names, found = x[own].T, v[own], [[], []]
        for at in range(0, int(ask.sum()) if len(names) else 0, BLOCK):
            who = v[ask][at : at + BLOCK]
            sims = x[ask][at : at + BLOCK] @ them
            # Sums in another order: what is this close to the bound is judged again below.
            least = np.partition(sims, -(k + 1), axis=1)[:, -(k + 1)] if len(names) > k + 1 else np.full(len(who), -np.inf)
            i, j = np.nonzero(sims >= np.maximum(least, min_sim)[:, None] - ROUNDING)
            found[0].append(who[i])
            found[1].append(names[j])
        return pa.table({c: pa.array(np.concatenate(f) if f else np.zeros(0, v.dtype)) for c, f in zip("vw", found, strict=True)})

    met = _tiles(placed, asked).join(points.select("v", "u"), "v").select("table", "bucket", "tile", "v", "u", "own", "ask")
    pairs = met.groupBy("table", "bucket", "tile").applyInArrow(work, f"v {kind}, w {kind}").distinct()
    x, y = points.select("v", F.col("u").alias("x")), points.select(F.col("v").alias("w"), F.col("u").alias("y"), "ids")
    return _similar(pairs.join(x, "v").join(y, "w"), min_sim)


def _similar(pairs: DataFrame, min_sim: float) -> DataFrame:
    sim = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("x"), F.col("y"))))
    return pairs.withColumn("similarity", sim).where(F.col("similarity") >= min_sim).select("v", "w", "similarity", "ids")


def recall(placed: DataFrame, points: DataFrame, k: int, min_sim: float) -> float:
    """Share of the true k nearest of ``PROBES`` vectors that the buckets hold; as many vectors are compared with all."""
    probes = checkpointed(points.orderBy(F.xxhash64("v", F.lit(7)), "v").limit(PROBES).select("v"))
    best = lambda df: _first(df.where("v <> w"), ["v"], [F.desc("similarity"), "w"], k).select("v", "w")
    true = best(_judged(points.select("v", F.lit(0).alias("table"), F.lit("").alias("bucket")), probes, points, k, min_sim))
    found = best(_judged(placed.join(placed.join(F.broadcast(probes), "v").select("table", "bucket").distinct(), ["table", "bucket"]), probes, points, k, min_sim))
    r = true.join(found.withColumn("hit", F.lit(1)), ["v", "w"], "left").agg(F.count("*").alias("n"), F.sum("hit").alias("k")).head()
    return (r["k"] or 0) / r["n"] if r["n"] else 1.0


def similar_all(vecs: DataFrame, k: int = 5, min_sim: float = 0.5, id_col: str = "id", vec_col: str = "vec", tables: int = TABLES, limit: int = 128, seed: int = 42,
                at_least: float = 0.9, asked: str = "true") -> DataFrame:
    """The k most similar of every vector: (id, other, similarity, rank), found among the vectors that share a bucket of some table.
    ``asked``, a condition on ``id``: of which vectors; all are searched.

    An index, so a neighbour may be missed; similarities are exact cosines. Its recall is measured on ``PROBES`` vectors first, and
    buckets are made four times as large until it is ``at_least`` so high: vectors without any structure end in few buckets. Pairs
    that are judged number at most asked vectors x ``tables`` x the limit reached, in products of blocks; of each bucket the best go on. Vectors that are equal are searched for once, with the k + 1 smallest of their ids. NULL vectors,
    vectors with a NULL and zero vectors have no neighbours. All vectors must have one length.
    """
    norm = F.sqrt(dot(F.col("_x"), F.col("_x")))
    rows = vecs.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("_x")).where("id is not null and _x is not null and not exists(_x, e -> e is null)")
    unit = checkpointed(rows.where(norm > 0).select("id", F.transform("_x", lambda e: F.round(e / norm, 12)).alias("u")))
    some = unit.head(1)
    if not some:
        return vecs.sparkSession.createDataFrame([], f"id {unit.schema['id'].dataType.simpleString()}, other {unit.schema['id'].dataType.simpleString()}, similarity double, rank int")
    points = checkpointed(_first(unit, ["u"], ["id"], k + 1).groupBy("u").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("v", F.monotonically_increasing_id()))
    wanted = unit.where(asked)
    seekers = points if asked == "true" else checkpointed(points.join(wanted.select("u").distinct(), "u").select("v"))
    signed, n = checkpointed(signatures(points, "v", "u", len(some[0]["u"]), tables, seed)), points.count()
    while True:
        placed = checkpointed(buckets(signed, limit))
        if limit >= n or recall(placed, points, k, min_sim) >= at_least:
            break
        limit *= 4
    judged = _judged(placed, seekers, points, k, min_sim)
    named = judged.select("v", "similarity", F.explode("ids").alias("other"))
    best = _first(named, ["v"], [F.desc("similarity"), "other"], k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("m"), "other"))).alias("near"))
    listed = points.select("v", "u").join(best, "v").select(F.col("u").alias("_u"), "near")
    mine = wanted.join(listed, wanted["u"] == listed["_u"])
    others = F.slice(F.filter("near", lambda n: n["other"] != F.col("id")), 1, k)
    return mine.select("id", F.posexplode(others).alias("_at", "_n")).select("id", "_n.other", (-F.col("_n.m")).alias("similarity"), (F.col("_at") + 1).alias("rank"))
