"""Rings as their last transfer arrives: only rings with an edge that is new in the batch are sought.

The store holds every pair of accounts once, when it is first seen, in folders by hash bucket of the payer, and again by hash bucket
of the payee for walking back. A search starts at the new edges and walks forward from their ends and backward from their
starts, half a ring each, reading the folders of the accounts it stands on, and joins the halves where they meet. Edges whose end
pays nobody or whose start is paid by nobody are left out first. Amounts of pairs are stored as running totals by the batches that
change them; every ``COMPACT`` batches they are merged, so that what a batch reads depends on the pairs there are, not on the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import graph as G
from tracewell.session import checkpointed
from tracewell.streaming.corrections import stored

BUCKETS = 32
COMPACT = 8  # batches after which running totals are merged


def bucket(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


class Store:
    """Tables of one stream run under ``path``; a batch that runs again overwrites its own folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.kept: dict[str, list[str]] = {}  # folders that count, by table
        self.at = -1  # the batch that ``kept`` is from

    def begin(self, batch_id: int) -> None:
        """Goes to the state after the batch before: after a restart, or when a batch runs again, that is read from its list."""
        if self.at != batch_id - 1:
            rows = stored(self.spark, f"{self.path}/list", "name string, folder string, place int, batch int").where(F.col("batch") == batch_id - 1)
            self.kept = {}
            for r in rows.orderBy("name", "place").collect():
                self.kept.setdefault(r["name"], []).append(r["folder"])

    def end(self, batch_id: int) -> None:
        """Lists the folders that count after a batch: a few for each table."""
        rows = [(n, f, k) for n, folders in self.kept.items() for k, f in enumerate(folders)]
        self.spark.createDataFrame(rows, "name string, folder string, place int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list/batch={batch_id}")
        self.at = batch_id

    def write(self, name: str, df: DataFrame, batch_id: int, node: str | None = None) -> DataFrame:
        """Stores a batch's rows of a table, by bucket of ``node`` if given, and reads them back."""
        folder = f"{self.path}/{name}/batch={batch_id}"
        schema = df.schema
        out = df if node is None else df.withColumn("bucket", bucket(node)).repartition("bucket")
        writer = out.write.mode("overwrite")
        (writer.partitionBy("bucket") if node else writer).parquet(folder)
        if folder not in self.kept.setdefault(name, []):
            self.kept[name].append(folder)
        return self.spark.read.schema(schema).parquet(folder)

    def read(self, name: str, schema: str, near: DataFrame | None = None, node: str | None = None) -> DataFrame:
        """A stored table; with ``near``, only the buckets of its column ``node``: folders, at most ``BUCKETS`` of them, are listed."""
        folders = self.kept.get(name, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, bucket int").option("basePath", f"{self.path}/{name}").parquet(*folders)
        if near is not None:
            wanted = [r[0] for r in near.select(bucket(node)).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(wanted))
        return rows.drop("bucket", "batch")

    def compact(self, name: str, schema: str, merge, node: str, batch_id: int) -> None:
        """Replaces the folders of a table by one of their merged rows; those are left for batches that run again."""
        if len(self.kept.get(name, [])) > COMPACT:
            merged = merge(self.read(name, schema))
            folder = f"{self.path}/{name}/batch={batch_id}-merged"
            merged.withColumn("bucket", bucket(node)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
            self.kept[name] = [folder]


PAIR = "src string, dst string"
TOTAL = "src string, dst string, amount double, txn_count long, first_ts timestamp, seen long"
FIRST = "account_id string, closed_at timestamp, ring_score double, ring_path string, ring_quantum double"


def _newest(totals: DataFrame) -> DataFrame:
    rest = [c for c in totals.columns if c not in ("src", "dst")]
    return totals.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "seen").alias("_t")).select("src", "dst", "_t.*")


def new_rings(store: Store, fresh: DataFrame, min_len: int = 3, max_len: int = 6) -> DataFrame:
    """(path, cycle_length) of the rings that have one of the ``fresh`` (src, dst) edges; the store has these already."""
    top, low = max_len // 2, (max_len - 1) // 2
    start = fresh.where(F.col("src") != F.col("dst")).select(F.col("src").alias("u"), F.col("dst").alias("v"))

    def walk(paths: DataFrame, table: str, end: str, here: str, there: str) -> DataFrame:
        edges = store.read(table, PAIR, paths, "m").select(F.col(here).alias("m"), F.col(there).alias("n"))
        grown = paths.join(edges, "m").where((F.col("n") != F.col(end)) & ~F.array_contains("p", F.col("n")))
        return checkpointed(grown.select("u", "v", F.array_append("p", F.col("n")).alias("p"), F.col("n").alias("m")))

    ahead = [start.select("u", "v", F.array("v").alias("p"), F.col("v").alias("m"))]
    behind = [start.select("u", "v", F.array("u").alias("p"), F.col("u").alias("m"))]
    # One step each way; an edge without either is on no ring.
    ahead.append(walk(ahead[0], "out", "u", "src", "dst"))
    behind.append(walk(behind[0].join(ahead[1].select("u", "v").distinct(), ["u", "v"], "left_semi"), "in", "v", "dst", "src"))
    on = behind[1].select("u", "v").distinct()
    ahead[1] = ahead[1].join(on, ["u", "v"], "left_semi")
    while len(ahead) <= top:
        ahead.append(walk(ahead[-1], "out", "u", "src", "dst"))
    while len(behind) <= low:
        behind.append(walk(behind[-1], "in", "v", "dst", "src"))
    found = None
    for length in range(min_len, max_len + 1):
        f = length // 2
        met = ahead[f].join(behind[length - 1 - f].withColumnRenamed("p", "q"), ["u", "v", "m"])
        met = met.where(F.size(F.array_intersect("p", "q")) == 1)
        # u, v and on to the meeting point, then back to u.
        path = F.concat(F.array("u"), F.col("p"), F.slice(F.reverse(F.slice(F.col("q"), F.lit(2), F.size("q"))), 2, max_len))
        found = met.select(path.alias("path")) if found is None else found.unionByName(met.select(path.alias("path")))
    at = F.array_position("path", F.array_min("path"))
    rotated = F.concat(F.slice(F.col("path"), at, F.size("path")), F.slice(F.col("path"), F.lit(1), at - 1))
    return found.select(rotated.alias("path")).distinct().withColumn("cycle_length", F.size("path"))


def update(store: Store, payments: DataFrame, batch_id: int) -> DataFrame:
    """Takes in a batch's payments (src, dst, amount, first_ts: running total of their pair and its first time; seen, turn: when they
    came and their order) and returns the rings they close."""
    last = payments.where("src is not null and dst is not null").groupBy("src", "dst").agg(
        F.max_by("amount", "turn").alias("amount"), F.count(F.lit(1)).alias("txn_count"), F.min("first_ts").alias("first_ts"), F.max("seen").alias("seen"))
    totals = store.write("totals", last, batch_id, "src")
    known = store.read("out", PAIR, totals, "src")
    fresh = checkpointed(totals.select("src", "dst").join(known, ["src", "dst"], "left_anti"))
    store.write("out", fresh, batch_id, "src")
    store.write("in", fresh, batch_id, "dst")
    rings = checkpointed(new_rings(store, fresh))
    members = rings.select(F.explode("path").alias("m"))
    hops = _newest(store.read("totals", TOTAL, members, "m"))
    out = store.write("rings", G.ring_summary(rings, hops), batch_id)
    store.compact("totals", TOTAL, _newest, "src", batch_id)
    for table, node in (("out", "src"), ("in", "dst")):
        store.compact(table, PAIR, lambda rows: rows, node, batch_id)
    return out


def first_by_account(store: Store, rings: DataFrame, near: DataFrame, batch_id: int) -> DataFrame:
    """The first ring of the accounts in ``near``; accounts that got theirs in this batch are stored, one row for each."""
    from tracewell.operators.detect import first_rings

    fresh = first_rings(rings)
    held = store.read("first", FIRST, fresh, "account_id")
    store.write("first", fresh.join(held.select("account_id"), "account_id", "left_anti"), batch_id, "account_id")
    store.compact("first", FIRST, lambda rows: rows, "account_id", batch_id)
    return store.read("first", FIRST, near, "account_id")
