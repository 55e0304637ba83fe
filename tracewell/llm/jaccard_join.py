"""Documents linked by the Jaccard similarity of their word shingles, joined under several global token orders.

A token is a shingle's hash. Two sets that reach the threshold share a token of their prefixes, whatever total order sorts the
tokens. The first order is rarity: document frequency, then hash. Tokens that only one document has come first in it and meet
nobody, so a document with more of them than its prefix is long has no partner at all and drops out. Candidates of the first
order must also share a prefix token under further orders (single tokens first, then other hashes), and reach the overlap that
sizes and positions allow; what is left is verified exactly.

Frequencies are counted over all documents. A task cuts its documents into chunks and sends the distinct tokens of a chunk,
sorted and packed, to token ranges; a range answers every chunk with the frequencies of its tokens that more documents have.
A token that many documents of a chunk share is sent once, and which of them have it stays with the chunk.

Only links between different sets are sought; equal sets are one node. A bucket of documents with the same prefix token is not
paired off: all of its nodes are compared with one pivot, then only nodes that are still in different components are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.words import Words, runs, space_separated
from tracewell.session import checkpointed, fresh_dir, without_leftovers

SHINGLE, PERCENT = 5, 80
CHUNK_TOKENS, RANGE_TOKENS = 1 << 19, 1 << 20  # tokens of a chunk and of a token range, about
ORDERS = 3
MANY = 1 << 23  # a chunk has fewer documents than this
TOKEN_BITS = 48  # of a shingle's 64-bit hash; in one comparison of two documents a chance match has odds of about 1e-9


def _sets(reader: Words, texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of one text after the other."""
    for lo, hi, hashes, offsets in reader.blocks(texts):
        all_runs = runs(hashes, shingle)
        for d in range(hi - lo):
            a, z = int(offsets[d]), int(offsets[d + 1])
            yield np.unique(all_runs[a : z - shingle + 1] if z - a >= shingle else runs(hashes[a:z], z - a) if z > a else hashes[:0])


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _pack(values: np.ndarray, width: int) -> bytes:
    """Bytes of the values plane by plane; the high planes of sorted values then compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _least(n, percent: int):
    """Smallest overlap that a set of ``n`` tokens needs with any partner."""
    return (percent * n + 99) // 100


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, node, n): 128-bit digest of each document's set and its size."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = space_separated()
        for batch in batches:
            found = [(_digest(s), len(s)) for s in _sets(reader, batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "node", "n"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sign, "doc_id long, node binary, n long")


def _send(docs: DataFrame, text: str, shingle: int, ranges: int, chunk_tokens: int) -> DataFrame:
    """Rows (chunk, shard, ...): packed tokens for a token range, or, at a shard of its own beyond them, what stays with the chunk.

    Chunks are numbered by task, so ``docs`` must give a task that runs again the same rows in the same order, as files do.
    """
    schema = "chunk long, shard long, tokens binary, owners binary, nodes binary, sizes binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, task = 0, TaskContext.get().partitionId()
        seen: set[bytes] = set()
        nodes, sizes, parts, held = [], [], [], 0

        def flush():
            nonlocal done, nodes, sizes, parts, held
            tokens = np.concatenate(parts) >> np.uint64(64 - TOKEN_BITS)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.uint64)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
            first = np.flatnonzero(new)
            times = np.diff(np.concatenate([first, [len(tokens)]]))
            single = times == 1
            # Owner of a token that one document of the chunk has, or from MANY on the number of those that have it.
            marks = np.where(single, owner[first], np.minimum(times, MANY - 1).astype(np.uint64) + np.uint64(MANY))
            distinct = tokens[first]
            shared = ~np.repeat(single, times)
            shard = ((distinct >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(TOKEN_BITS - 16)).astype(np.int32)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            chunk = (task << 31) + done
            rows = [(chunk, int(shard[a]), _pack(distinct[a:z], 6), _pack(marks[a:z], 3), b"", b"") for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            rows.append((chunk, ranges + chunk, _pack(tokens[shared], 6), _pack(owner[shared], 3), b"".join(nodes), np.array(sizes, "<i8").tobytes()))
            done, nodes, sizes, parts, held = done + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)],
                                              names=["chunk", "shard", "tokens", "owners", "nodes", "sizes"])

        reader = space_separated()
        for batch in batches:
            for s in _sets(reader, batch.column(0), shingle):
                key = _digest(s)
                if not len(s) or key in seen:  # a copy within the task adds nothing
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                nodes.append(key)
                sizes.append(len(s))
                parts.append(s)
                held += len(s)
                if held >= chunk_tokens:
                    yield flush()
        if parts:
            yield flush()

    return docs.select(text).mapInArrow(send, schema)


ANSWER = ["chunk", "shard", "tokens", "owners", "counts", "nodes", "sizes"]


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one token range, for every chunk: its tokens that more than one document has, and how many have them."""
    if len(rows["nodes"].iloc[0]):  # a chunk's own row
        return rows.assign(counts=b"")[ANSWER]
    tokens = [_unpack(t, 6) for t in rows["tokens"]]
    marks = [_unpack(o, 3) for o in rows["owners"]]
    every = np.concatenate(tokens)
    held = np.concatenate(marks).astype(np.int64)
    weight = np.where(held < MANY, 1, held - MANY)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(weight[order], first)
    keep = total > 1
    known, counts = ordered[first][keep], total[keep]
    out = []
    for chunk, t, m in zip(rows["chunk"], tokens, marks, strict=True):
        at = np.searchsorted(known, t)
        at[at == len(known)] = 0
        hit = known[at] == t if len(known) else np.zeros(len(t), bool)
        out.append((chunk, int(rows["shard"].iloc[0]), _pack(t[hit], 6), _pack(m[hit], 3), _pack(np.minimum(counts[at[hit]], 0xFFFFFFFF), 4), b"", b""))
    return pd.DataFrame(out, columns=ANSWER)


def _gather(percent: int):
    """Of one chunk: nodes that can have a partner, with their tokens that other documents have, in the order of rarity."""
    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["nodes"].map(len) > 0
        own, rest = rows[mine].iloc[0], rows[~mine].sort_values("shard")
        sizes = np.frombuffer(own["sizes"], "<i8")
        out = []
        if len(rest):
            tokens = np.concatenate([_unpack(t, 6) for t in rest["tokens"]])
            marks = np.concatenate([_unpack(o, 3) for o in rest["owners"]]).astype(np.int64)
            counts = np.concatenate([_unpack(c, 4) for c in rest["counts"]])
            single = marks < MANY
            # Tokens that several documents of the chunk have: find their documents again.
            held, owner = _unpack(own["tokens"], 6), _unpack(own["owners"], 3).astype(np.int64)
            many, n_many = tokens[~single], counts[~single]
            at = np.searchsorted(many, held)
            doc = np.concatenate([marks[single], owner])
            tok = np.concatenate([tokens[single], held])
            cnt = np.concatenate([counts[single], n_many[at] if len(held) else n_many[:0]])
            order = np.lexsort((tok, cnt, doc))
            doc, tok = doc[order], tok[order]
            cuts = np.searchsorted(doc, np.arange(len(sizes) + 1))
            prefix = sizes - _least(sizes, percent) + 1 - (sizes - np.diff(cuts))
            for d in np.flatnonzero(prefix > 0):
                out.append((own["nodes"][16 * d : 16 * d + 16], int(sizes[d]), int(prefix[d]), tok[cuts[d] : cuts[d + 1]].astype(np.int64)))
        return pd.DataFrame(out, columns=["node", "n", "prefix", "tokens"])

    return gather


def candidates(docs: DataFrame, text: str, total: int, shingle: int, percent: int, chunk_tokens: int = CHUNK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(node, n, prefix, tokens) of the sets that can have a partner: tokens that others have, rarest first, and how many of them
    stand in the prefix; a set comes once for each task that has it. ``total``: tokens of all documents, from which the number of token ranges follows."""
    ranges = max(1, -(-total // range_tokens))
    answers = _send(docs, text, shingle, ranges, chunk_tokens).groupBy("shard").applyInPandas(
        _answer, "chunk long, shard long, tokens binary, owners binary, counts binary, nodes binary, sizes binary")
    return answers.groupBy("chunk").applyInPandas(_gather(percent), "node binary, n long, prefix long, tokens array<long>")


def _other_order(tokens: Column, k: int) -> Column:
    """The tokens that others have under the k-th further order: by another hash."""
    return F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct(F.xxhash64(t, F.lit(k)).alias("h"), t.alias("t")))), lambda s: s["t"])


def _verified(pairs: DataFrame, found: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token under every further order and whose sets reach the threshold."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    mine = found.join(wanted, "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "tokens")])
    side = lambda c: mine.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "prefix", "tokens")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    for k in range(1, orders):
        prefix = lambda c, k=k: F.slice(_other_order(F.col(f"tokens_{c}"), k), F.lit(1), F.col(f"prefix_{c}").cast("int"))
        both = both.where(F.arrays_overlap(prefix("a"), prefix("b")))
    both = both.withColumn("same", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long"))
    return both.where(F.col("same") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("same"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link: the smallest node reachable. Labels spread to neighbours and are halved by
    looking up the label's label, so long chains take few rounds."""
    edges = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        now = checkpointed(low.join(up, "low", "left").select("node", "was", F.least("low", F.coalesce("far", "low")).alias("root")))
        labels = now.select("node", "root")
        if now.where("was <> root").isEmpty():
            return labels


def links_between_sets(found: DataFrame, percent: int, orders: int) -> tuple[DataFrame, DataFrame]:
    """(links, components): links that hold every component together, and (node, root)."""
    least = F.expr(f"({percent} * n + 99) div 100")
    # The smaller of two sets needs a shorter prefix: it must share 2t/(1+t) of its tokens with a partner of its size or more.
    short = F.expr(f"n - (2 * {percent} * n + {100 + percent - 1}) div {100 + percent} + 1 - (n - size(tokens))")
    rows = checkpointed(found.select("node", "n", F.size("tokens").alias("known"), least.alias("least"), short.alias("short"),
                                     F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix").cast("int"))).alias("at", "token")).distinct())

    def rank(prefix: str) -> Column:
        return F.struct(F.col(f"{prefix}n"), F.col(f"{prefix}node"))

    def meets(a: str, b: str) -> Column:
        """a is the smaller: length bound, a's shorter prefix, and the overlap that the positions still allow."""
        possible = F.least(F.col(f"{a}known") - F.col(f"{a}at"), F.col(f"{b}known") - F.col(f"{b}at"))
        needed = F.expr(f"({percent} * ({a}n + {b}n) + {100 + percent - 1}) div {100 + percent}")
        return (rank(a) < rank(b)) & (F.col(f"{a}n") >= F.col(f"{b}least")) & (F.col(f"{a}at") < F.col(f"{a}short")) & (possible >= needed)

    def possible_pair() -> Column:
        return meets("", "o_") | meets("o_", "")

    def named(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({c: f"o_{c}" for c in df.columns if c != "token"})

    pair = F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")
    # Any order of meeting counts towards the possible overlap only from the first common token on, so a pair that fails the
    # bound at a later token has passed it at the first one if it can pass at all.
    # The pivot is the node with the fewest tokens of its own: the text that edited copies were made from, not one of them.
    pivots = rows.groupBy("token").agg(F.min_by(F.struct("node", "n", "known", "least", "short", "at"), F.struct(F.col("n") - F.col("known"), "node")).alias("p"), F.count("*").alias("size")).where("size > 1")
    pivots = pivots.select("token", *[F.col(f"p.{c}").alias(f"o_{c}") for c in ("node", "n", "known", "least", "short", "at")])
    star = rows.join(pivots, "token").where((F.col("node") != F.col("o_node")) & possible_pair()).select(*pair).distinct()
    links = checkpointed(_verified(star, found, percent, orders))
    known = components(links)

    root = rows.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    root = checkpointed(root)
    # Of each bucket, the rows outside its largest component meet the rows of other components.
    sizes = root.groupBy("token", "root").agg(F.count("*").alias("k"))
    top = sizes.groupBy("token").agg(F.max(F.struct("k", "root"))["root"].alias("top"), F.count("*").alias("roots")).where("roots > 1").select("token", "top")
    mixed = root.join(top, "token")
    outside = named(mixed.where("root <> top").drop("top"))
    left = mixed.join(outside, "token").where((F.col("root") != F.col("o_root")) & possible_pair()
                                              & ((F.col("root") == F.col("top")) | (F.col("node") < F.col("o_node"))))
    rest = left.select(*pair).distinct().join(star, ["a", "b"], "left_anti")
    more = checkpointed(_verified(rest, found, percent, orders))
    if more.isEmpty():
        return links, known
    links = links.union(more)
    return links, components(links)


def assigned(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, orders: int, chunk_tokens: int, range_tokens: int) -> DataFrame:
    """(doc_id, node, n, root): each document's set and the component that the set belongs to."""
    spark: SparkSession = docs.sparkSession
    with without_leftovers(spark):
        folder = fresh_dir(spark, "jaccard-sets")
        signed = signatures(docs, doc_id, text, shingle)
        signed.write.parquet(folder)
        signed = spark.read.schema(signed.schema).parquet(folder)
        total = signed.agg(F.sum("n")).first()[0] or 0
        folder = fresh_dir(spark, "jaccard-candidates")
        found = candidates(docs, text, total, shingle, percent, chunk_tokens, range_tokens)
        found.write.parquet(folder)
        found = spark.read.schema(found.schema).parquet(folder)
        _, known = links_between_sets(found, percent, orders)
    return signed.join(known, "node", "left").select("doc_id", "node", "n", F.coalesce("root", "node").alias("root"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS,
            chunk_tokens: int = CHUNK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    Two documents link when their sets' intersection is ``percent`` per cent of their union or more; component_id is the smallest
    doc_id reachable by links. A text without words (NULL, empty) has an empty set and links with nothing: it is its own
    component. A NULL doc_id takes part, but the smallest is taken over the others; without any it is NULL. Repeated rows are
    copies of each other. An empty table gives no rows. Other columns play no part.
    """
    rows = checkpointed(assigned(docs, doc_id, text, shingle, percent, orders, chunk_tokens, range_tokens))
    full = rows.where("n > 0")
    lowest = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = full.join(lowest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS,
                     chunk_tokens: int = CHUNK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """The documents with one row left of each component, that with the smallest doc_id (NULL is largest); of rows with that id
    and the same set any one. Texts without words all stay. Columns stay what they are, whatever their names."""
    rows = assigned(docs, doc_id, text, shingle, percent, orders, chunk_tokens, range_tokens).where("n > 0")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("f"))
    keep = first.select(F.col("f.doc_id").alias("keep_id"), F.col("f.node").alias("keep_node"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.withColumnsRenamed(names)
    column = docs.columns.index(text)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = space_separated()
        for batch in batches:
            digests = [_digest(s) for s in _sets(reader, batch.column(column), shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, "node"])

    own = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    key = F.col(names[doc_id]).cast("long")
    wordy = F.col(names[text]).rlike(r"[^\x20\x09-\x0D]")
    signed = plain.where(wordy).mapInArrow(sign, f"{own}, node binary")
    kept = signed.join(keep, (F.col("node") == F.col("keep_node")) & key.eqNullSafe(F.col("keep_id")), "left_semi").dropDuplicates(["node"])
    out = kept.drop("node").unionByName(plain.where(F.coalesce(~wordy, F.lit(True))))
    return out.withColumnsRenamed({v: k for k, v in names.items()})
