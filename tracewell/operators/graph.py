"""Node and edge tables, transfer rings, snapshots and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import columns as X
from tracewell.functions import text
from tracewell.operators.embedding import cohesion
from tracewell.session import checkpointed

_ATTRS = ["node_type", "role", "branch", "account_type"]


def _seen(df: DataFrame, node: Column, rank: int, part: int, unique: str, **cols: Column) -> DataFrame:
    """One row per appearance of a node in an event, with the event's place in arrival order."""
    fields = {"role": "string", "branch": "string", "account_type": "string", "access_count": "bigint",
              "txn_count": "bigint", "total_outflow": "double", "total_inflow": "double"}
    arrival = F.struct(F.col("timestamp").alias("ts"), F.lit(rank).alias("rank"),
                       F.col(unique).cast("string").alias("id"), F.lit(part).alias("part"))
    return df.select(node.alias("id"), cols["node_type"].alias("node_type"), "timestamp", arrival.alias("arrival"),
                     *[cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])


def build_nodes(access: DataFrame, txns: DataFrame) -> DataFrame:
    """Employees, accounts and counterparties.

    Attributes are those of a node's first appearance in arrival order (time, access before transaction, id);
    counters add up and stay NULL for a part the node never played.
    """
    one = F.lit(1)
    parts = [
        _seen(access, F.col("employee_id"), 0, 0, "event_id", node_type=F.lit("employee"), role=F.col("role"),
              branch=F.col("branch_code"), access_count=one),
        _seen(access, F.col("account_id"), 0, 1, "event_id", node_type=F.lit("account"), branch=F.col("branch_code"),
              account_type=F.col("account_type"), access_count=one),
        _seen(txns, F.col("account_id"), 1, 0, "transaction_id", node_type=F.lit("account"), branch=F.col("branch_code"),
              txn_count=one, total_outflow=F.col("amount")),
        _seen(txns, F.col("counterparty_id"), 1, 1, "transaction_id", node_type=X.node_kind("counterparty_id"),
              total_inflow=F.col("amount")),
    ]
    seen = parts[0]
    for part in parts[1:]:
        seen = seen.unionByName(part)
    return seen.groupBy("id").agg(
        F.min_by(F.struct(*_ATTRS), F.col("arrival")).alias("a"),
        *[F.sum(c).alias(c) for c in ("access_count", "txn_count", "total_outflow", "total_inflow")],
        F.max("timestamp").alias("last_seen"),
    ).select("id", *[F.col(f"a.{c}").alias(c) for c in _ATTRS],
             "access_count", "txn_count", "total_outflow", "total_inflow", "last_seen")


def build_edges(access: DataFrame, txns: DataFrame) -> DataFrame:
    """ACCESS edges employee -> account and TRANSFER edges account -> counterparty."""
    left = access.select(
        F.col("employee_id").alias("src"), F.col("account_id").alias("dst"),
        F.concat(F.lit("acc_"), F.col("event_id").cast("string")).alias("key"), F.lit("ACCESS").alias("edge_type"),
        "timestamp", "action_type", "records_accessed", "is_suspicious")
    right = txns.select(
        F.col("account_id").alias("src"), F.col("counterparty_id").alias("dst"), F.col("transaction_id").alias("key"),
        F.lit("TRANSFER").alias("edge_type"), "timestamp", "transaction_id", "amount", "transaction_type", "scenario", "is_fraud")
    return left.unionByName(right, allowMissingColumns=True)


def latest_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, key): a repeated transaction id replaces the edge before it."""
    newest = edges.groupBy("src", "dst", "key").agg(F.max_by(F.struct(*edges.columns), F.col("timestamp")).alias("e"))
    return newest.select("e.*")


def transfer_digraph(edges: DataFrame) -> DataFrame:
    """Parallel transfers as one edge: summed amount, count, time of the first."""
    return (edges.where(F.col("edge_type") == "TRANSFER").groupBy("src", "dst")
            .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("txn_count"), F.min("timestamp").alias("first_ts")))


def trimmed(pairs: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges without those that touch a node lacking incoming or outgoing edges; such nodes lie on no cycle."""
    for _ in range(rounds):
        starts, ends = pairs.select("src").distinct(), pairs.select("dst").distinct()
        pairs = (pairs.join(starts.withColumnRenamed("src", "dst"), "dst", "left_semi")
                 .join(ends.withColumnRenamed("dst", "src"), "src", "left_semi"))
    return pairs


def find_cycles(digraph: DataFrame, min_len: int = 3, max_len: int = 6, target: str | DataFrame | None = None,
                limit: int | None = None) -> DataFrame:
    """Simple directed cycles with ``min_len``..``max_len`` nodes, each once, starting at its smallest id.

    Paths are grown from both ends: forward from the start node and backward into it, each only half a cycle
    long, and joined where they meet. Half paths number about d^(L/2) instead of the d^L of growing whole ones.
    With ``target`` (an id, or a table of ids in column ``s``) every cycle through such a node counts.
    """
    pairs = checkpointed(trimmed(digraph.select("src", "dst").where(F.col("src") != F.col("dst"))))
    top, low = -(-max_len // 2), max_len // 2

    def allowed(node: str, start: str = "s") -> Column:
        return F.col(node) > F.col(start) if target is None else F.col(node) != F.col(start)

    forward = pairs.select(F.col("src").alias("s"), F.array("dst").alias("p"), F.col("dst").alias("m"))
    backward = pairs.select(F.col("dst").alias("s"), F.array("src").alias("p"), F.col("src").alias("m"))
    forward, backward = forward.where(allowed("m")), backward.where(allowed("m"))
    if isinstance(target, str):
        forward, backward = forward.where(F.col("s") == target), backward.where(F.col("s") == target)
    elif target is not None:
        forward, backward = forward.join(target, "s", "left_semi"), backward.join(target, "s", "left_semi")
    ahead, behind = [forward], [backward]
    step = pairs.select(F.col("src").alias("m"), F.col("dst").alias("n"))
    back = pairs.select(F.col("dst").alias("m"), F.col("src").alias("n"))
    for _ in range(1, top):
        grown = ahead[-1].join(step, "m").where(allowed("n") & ~F.array_contains("p", F.col("n")))
        ahead.append(grown.select("s", F.array_append("p", F.col("n")).alias("p"), F.col("n").alias("m")))
    for _ in range(1, low):
        grown = behind[-1].join(back, "m").where(allowed("n") & ~F.array_contains("p", F.col("n")))
        behind.append(grown.select("s", F.array_prepend("p", F.col("n")).alias("p"), F.col("n").alias("m")))
    fore, hind = ahead[0], behind[0]
    for more in ahead[1:]:
        fore = fore.union(more)
    for more in behind[1:]:
        hind = hind.union(more)
    hind = hind.withColumnRenamed("p", "q")
    size = F.size("p") + F.size("q")
    met = fore.join(hind, ["s", "m"]).where(
        (F.size("p") - F.size("q")).between(0, 1) & size.between(min_len, max_len)
        & ~F.arrays_overlap("p", F.slice("q", 2, max_len)))
    path = F.concat(F.array("s"), F.col("p"), F.slice("q", 2, max_len))
    out = met.select(path.alias("path"))
    if target is not None:
        at = F.array_position("path", F.array_min("path"))
        rotated = F.concat(F.slice(F.col("path"), at, F.size("path")), F.slice(F.col("path"), F.lit(1), at - 1))
        out = out.select(rotated.alias("path")).distinct()
    out = out.withColumn("cycle_length", F.size("path"))
    return out.orderBy("cycle_length", "path").limit(limit) if limit else out


def ring_text(path: Column) -> Column:
    return F.array_join(F.concat(path, F.slice(path, 1, 1)), " ➔ ")


def ring_hops(cycles: DataFrame, digraph: DataFrame) -> DataFrame:
    """One row per hop of each ring with the digraph's amount and first time."""
    size = F.size("path")
    hops = cycles.select("path", F.posexplode("path").alias("hop", "src"))
    hops = hops.withColumn("dst", F.element_at("path", ((F.col("hop") + 1) % size + 1).cast("int")))
    return hops.join(digraph, ["src", "dst"])


def ring_summary(cycles: DataFrame, digraph: DataFrame, vecs: DataFrame | None = None) -> DataFrame:
    """Hops, total, severity, cohesion, score and texts of each ring."""
    rings = ring_hops(cycles, digraph).groupBy("path").agg(
        F.sum("amount").alias("_q"), F.max("first_ts").alias("closed_at"),
        F.array_sort(F.collect_list(F.struct("hop", F.col("src").alias("from_account"), F.col("dst").alias("to_account"),
                                             F.round("amount", 2).alias("amount"), F.col("first_ts").alias("timestamp")))).alias("hop_details"))
    if vecs is not None:
        rings = rings.join(cohesion(cycles, vecs), "path", "left")
    else:
        rings = rings.withColumn("cohesion", F.lit(0.0))
    n, text_path = F.size("path"), ring_text(F.col("path"))
    cohesive = F.coalesce("cohesion", F.lit(0.0))
    count = n.cast("string")
    return rings.select(
        "path", n.alias("cycle_length"), text_path.alias("cycle_path"), "hop_details", "closed_at",
        F.round("_q", 2).alias("total_quantum"), F.round(cohesive, 3).alias("cohesion"),
        F.round(F.least(F.lit(1.0), 0.75 + 0.05 * n + 0.15 * F.greatest(F.lit(0.0), cohesive)), 4).alias("ring_score"),
        F.when((F.col("_q") > 100000) | (n >= 4), "CRITICAL").otherwise("HIGH").alias("severity"),
        F.concat(F.lit("Closed "), count, F.lit("-hop loop ("), text_path,
                 F.lit(") creates synthetic commercial turnover with total flow INR "), text.fmt_money("_q"), F.lit(".")).alias("parallel_description"),
        F.concat(F.lit("FREEZE ACCOUNTS: Immediate temporary debit block on all "), count, F.lit(" ring accounts: "),
                 F.array_join("path", ", "), F.lit(".")).alias("recommended_action"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends per node; parallel edges and both ends of a loop count."""
    return (edges.select(F.explode(F.array("src", "dst")).alias("id"))
            .groupBy("id").agg(F.count(F.lit(1)).alias("degree")))


def top_degree(edges: DataFrame, n: int = 150) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def with_decay(edges: DataFrame, ref_ts: str | None = None) -> DataFrame:
    """Edges with the time-decay weight against the latest time, or against a given one."""
    ref = F.to_timestamp(F.lit(ref_ts)) if ref_ts else edges.agg(F.max("timestamp")).scalar()
    return edges.withColumn("weight", X.decay("timestamp", ref))


def snapshot(nodes: DataFrame, edges: DataFrame, max_nodes: int = 150, ref_ts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The busiest nodes with display hints, and the weighted edges among them."""
    # At most max_nodes rows are broadcast.
    chosen = F.broadcast(top_degree(edges, max_nodes).select("id"))
    style = F.col("node_type")
    shown = nodes.join(chosen, "id", "left_semi").withColumns({
        "label": F.col("id"), "group": style,
        "color": X.lookup({k: v[0] for k, v in C.NODE_STYLE.items()}, style, C.NODE_STYLE["counterparty"][0]),
        "size": X.lookup({k: v[1] for k, v in C.NODE_STYLE.items()}, style, C.NODE_STYLE["counterparty"][1])})
    kept = (with_decay(edges, ref_ts).join(chosen.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return shown, kept.withColumn("id", F.concat("src", F.lit("->"), "dst", F.lit(":"), "key"))


def snapshot_summary(nodes: DataFrame, edges: DataFrame, max_nodes: int = 150) -> DataFrame:
    """Total and displayed node and edge counts with the reference time."""
    shown, kept = snapshot(nodes, edges, max_nodes)
    count = F.count(F.lit(1))
    return edges.agg(F.max("timestamp").alias("timestamp"), count.alias("edge_count")).select(
        "timestamp", nodes.agg(count).scalar().alias("node_count"), "edge_count",
        shown.agg(count).scalar().alias("displayed_node_count"), kept.agg(count).scalar().alias("displayed_edge_count"),
        F.lit(C.LINK_WINDOW_SECONDS / 60.0).alias("temporal_window_minutes"))


def reachable(edges: DataFrame, account: str, radius: int = 2) -> DataFrame:
    """Ids within ``radius`` undirected steps; empty when the account has no edge."""
    near = edges.where((F.col("src") == account) | (F.col("dst") == account))
    found = near.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    links = edges.select("src", "dst").distinct()
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    for _ in range(radius - 1):
        step = both.join(found, both["src"] == found["id"], "left_semi").select(F.col("dst").alias("id"))
        found = found.unionByName(step).distinct()
    return found


def ego_graph(nodes: DataFrame, edges: DataFrame, account: str, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and induced edges around an account."""
    ids = reachable(edges, account, radius)
    kept = (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return nodes.join(ids, "id", "left_semi"), kept
