"""The registered query of each operator: production parameters, whole tables, digests derived from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, chat_format, decontaminate, hard_negatives, jaccard_join, language_id, merkle, mixing, pii, quality_knn, quality_rules, sharding, warc
from tracewell.plans.registry import prepare
from tracewell.session import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_in_bytes(text):
    """UTF-8 bytes of the text, and 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


@register("op1_pii_weak_supervision")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    n = {f"n_{k}": count(k) for k in pii.BASE}
    return found.select("doc_id", *[v.alias(k) for k, v in n.items()], F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


@register("op2_quality_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_knn.score(docs, model).select("doc_id", quality_knn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op3_quality_log_ratio")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 6).alias("ratio"))


@register("op4_ngram_jaccard_join", """
with recursive w as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
s as materialized (select distinct r, md5(array_to_string(words[i:i + least(5, len(words)) - 1], ' ')) as t from (select r, words, unnest(range(1, len(words) - least(5, len(words)) + 2)) as i from w where len(words) > 0)),
n as materialized (select r, count(*) as n from s group by r),
common as (select a.r as a, b.r as b, count(*) as k from s a join s b on a.t = b.t and a.r < b.r group by a.r, b.r),
links as materialized (select a, b from common join n x on x.r = a join n y on y.r = b where 100 * k >= 80 * (x.n + y.n - k)),
edges as materialized (select a, b from links union select b, a from links),
reach as (select a as r, b as q from edges union select reach.r, e.b from reach join edges e on reach.q = e.a),
low as (select x.r, min(w.doc_id) as low from (select r, q from reach union select r, r from w) x join w on w.r = x.q group by x.r)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, low.low as component_id from w join low on w.r = low.r left join n on w.r = n.r""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@register("op5_chat_grammar", """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?INST\\]|/?OUT\\]|/?ROLE[ \\]])', '\\1\\\\\\2\\3', 'g') as escaped from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(escaped) + case role when 'user' then 22 when 'assistant' then 20 else 23 + length(url_encode(role)) end) as bigint) as formatted_chars
from e group by conv_id""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(hard)))


@register("op6_cross_parsing_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = language_id.labelled(docs, "doc_id", "text", "lang")
    found = language_id.predict(docs.select("doc_id", "text"), sample)
    return found.select("doc_id", quality_knn.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register("op7_hypergeometric_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", size_in_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.shuffle_into_shards(rows, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op8_decontamination", """
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from benchmark),
lens as (select distinct least(10, len(words)) as n from b where len(words) > 0),
wins as (select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as win from (select item_id, words, least(10, len(words)) as n, unnest(range(1, len(words) - least(10, len(words)) + 2)) as i from b where len(words) > 0)),
pos as (select doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') as win from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from w, lens where len(words) >= n)),
hits as (select p.doc_id, p.n, p.i, x.item_id from pos p join wins x on p.n = x.n and p.win = x.win),
cover as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select w.doc_id, cast(len(w.words) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit, cast(coalesce(f.n_items, 0) as bigint) as n_items,
  sha256(coalesce(f.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from w left join cover c on w.doc_id = c.doc_id left join found f on w.doc_id = f.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlap(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def domain_of(source):
    """Domain of a source; the tables have none, so sources are dealt to four by a digest of their name."""
    return F.concat(F.lit("d"), F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)) % 4)


# Spanish of the first domain can't fill its part, even with all epochs: its siblings take the rest.
MIX_WEIGHTS = {"domain": {"d0": 3.0, "d1": 2.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 0.3, "de": 0.2, "fr": 0.2, "es": 0.3}, "source": {"src0": 3.0, mixing.REST: 1.0}}


def mix_levels():
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def _share_sql(name: str, parent: str, above: str, level: str, weight: str) -> str:
    """CTEs that give each child of a level its part, filling in the order in which children run full."""
    cols = f"{parent}, {level}" if parent else level
    by = f"partition by {parent}" if parent else ""
    join = f"join {above} using ({parent})" if above else "cross join total"
    return f"""{name}_n as (select {cols}, cast(sum(tokens) * 4 as double) as cap, {weight} as w from leaves group by {cols}),
{name}_b as (select n.*, budget, cap / w as fill from {name}_n n {join} where cap > 0),
{name}_l as (select *, (budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) / (sum(w) over ({by}) - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0)) as lvl
  from {name}_b window o as ({by} order by fill, {level})),
{name} as (select {cols}, case when lvl * w >= cap then cap else least(cap, w * first_value(case when lvl * w < cap then lvl end ignore nulls) over ({by} order by fill, {level} rows between unbounded preceding and unbounded following)) end as budget from {name}_l)"""


@register("op9_hierarchical_mixing", """
with d as (select doc_id, coalesce('=' || lang, 'null') as lang, coalesce('=' || source, 'null') as source, '=d' || (instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) % 4) as domain,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as tokens, md5(coalesce(cast(doc_id as varchar), 'null') || '|' || coalesce(text, '')) as key from documents),
total as (select cast(sum(tokens) as double) as budget from d),
leaves as (select domain, lang, source, sum(tokens) as tokens from d where lang in ('=en', '=de', '=fr', '=es') group by all),
""" + _share_sql("l1", "", "", "domain", "(case domain when '=d0' then 3 when '=d3' then 1 else 2 end)::double") + "," + _share_sql("l2", "domain", "l1", "lang", "(case when lang in ('=en', '=es') then 0.3 else 0.2 end)::double")
+ "," + _share_sql("l3", "domain, lang", "l2", "source", "(case source when '=src0' then 3 else 1 end)::double") + """,
plan as (select domain, lang, source, cast(floor(budget + 1e-6) as bigint) as given, cast(tokens as bigint) as held from l3 join leaves using (domain, lang, source) where tokens > 0),
p as (select d.*, given // held as whole, given % held as rest, cast('0x' || substr(md5('11|' || (given // held) || '|' || key), 1, 15) as bigint) as place from d join plan using (domain, lang, source) where given > 0),
c as (select *, sum(tokens) over (partition by domain, lang, source order by place) as until from p),
n as (select *, whole + case when rest > 0 and until <= rest then 1 else 0 end as copies from c)
select doc_id, tokens as n_tokens, substr(domain, 2) as domain, case when lang <> 'null' then substr(lang, 2) end as lang, case when source <> 'null' then substr(source, 2) end as source, cast(unnest(range(copies)) as bigint) as epoch from n where copies > 0""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS)
    return mixed.select("doc_id", mixing.count_tokens(F.col("text")).alias("n_tokens"), domain_of(F.col("source")).alias("domain"), "lang", "source", "epoch")


@register("op10_warc_sharded_writer", """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest, octet_length(encode(coalesce(html, ''))) as n from pages),
k as (select digest, max(page_id) as keeper from p where n >= 1000 group by digest)
select page_id, cast(n as bigint) as payload_bytes, p.digest as payload_digest,
  case when k.keeper is not null and page_id is distinct from k.keeper then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from k.keeper then k.keeper end as refers_to
from p left join k on p.digest = k.digest and p.n >= 1000""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_leaf():
    """The leaf after an edit that lower-cases A-Z in every third document, or NULL for the others."""
    edited = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = merkle.digest(*[merkle.field(edited if c == "text" else F.col(c)) for c in LEAF])
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed)


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB: eight shifts after each byte."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda k: list_prepend(ascii(substr({text}, k, 1))::bigint, [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))"
    step = "lambda c, e: case when e >= 0 then xor(c, e) else xor(c >> 1, (c & 1) * 3988292384) end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), {step}), 4294967295::bigint)"


def _tree_sql(name: str, leaves: str, depth: int) -> str:
    """CTEs {name}0 to {name}{depth}, the levels of trees over (tree, i, n, digest); a node alone in its level stays there."""
    out = [f"{name}0 as materialized (select tree, i, n, digest from {leaves})"]
    for k in range(depth):
        out.append(f"{name}{k + 1} as materialized (select tree, i // 8 as i, (any_value(n) + 7) // 8 as n, sha256(string_agg(digest, '' order by i)) as digest from {name}{k} where n > 1 group by tree, i // 8)")
    return ",\n".join(out)


def _step_sql(name: str, k: int) -> str:
    """CTE {name}s{k}: the siblings of each node of a level, before and after it."""
    side = lambda test: f"coalesce(string_agg(b.digest, '' order by b.i) filter (b.i {test} a.i), '')"
    return f"{name}s{k} as materialized (select a.tree, a.i, {side('<')} as before, {side('>')} as after from {name}{k} a join {name}{k} b on a.tree = b.tree and a.i // 8 = b.i // 8 where a.n > 1 group by a.tree, a.i)"


def _merkle_sql(depth: int = 8, top: int = 3) -> str:
    """Trees of up to 8^depth leaves and 8^top groups."""
    field = lambda v: f"coalesce(strlen(cast({v} as varchar)) || ':' || cast({v} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in LEAF) + ")"
    edited = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    acc, proof, joins = "coalesce(l.changed, l.digest)", "", []
    for name, key, count in (("t", "l.i", depth), ("u", "g.i", top)):
        tree = "l.tree" if name == "t" else "g.one"
        for k in range(count):
            s = f"{name}s{k}"
            joins.append(f"left join {s} on {s}.tree = {tree} and {s}.i = {key} // {8 ** k}")
            proof += f" || coalesce({s}.before || {s}.after, '')"
    folds, last = [], "f0"
    for s in [f"ts{k}" for k in range(depth)] + [f"us{k}" for k in range(top)]:
        new = f"f{len(folds) + 1}"
        folds.append(f"{new} as (select * exclude ({s}_b, {s}_a, acc), case when {s}_b is null then acc else sha256({s}_b || acc || {s}_a) end as acc from {last})")
        last = new
    carried = ", ".join(f"{s}.before as {s}_b, {s}.after as {s}_a" for s in [f"ts{k}" for k in range(depth)] + [f"us{k}" for k in range(top)])
    return f"""
with d as (select doc_id, coalesce('=' || lang, '-') as tree, {leaf('text')} as digest, case when {_crc32_sql("cast(doc_id as varchar)")} % 3 = 0 then {leaf(edited)} end as changed from documents),
l as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as i, count(*) over (partition by tree) as n from d),
{_tree_sql("t", "l", depth)},
{", ".join(_step_sql("t", k) for k in range(depth))},
g as materialized (select tree, digest, 0 as one, row_number() over (order by tree) - 1 as i, count(*) over () as n from ({" union all ".join(f"select tree, digest from t{k} where n = 1" for k in range(depth + 1))})),
gl as (select one as tree, i, n, digest from g),
{_tree_sql("u", "gl", top)},
{", ".join(_step_sql("u", k) for k in range(top))},
r as ({" union all ".join(f"select digest as root from u{k} where n = 1" for k in range(top + 1))}),
f0 as (select l.doc_id, l.digest as leaf, g.digest as subroot, r.root, sha256(''{proof}) as proof_sha256, {acc} as acc, {carried}
  from l join g on l.tree = g.tree cross join r {" ".join(joins)}),
{", ".join(folds)}
select doc_id, leaf, subroot, root, proof_sha256, acc as folded_root, acc = root as verified from {last}"""


@register("op11_merkle_manifest", _merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(table(spark, sf_dir, "documents"), "lang", "doc_id", LEAF, extra={"changed": tampered_leaf()})
    reached = merkle.folded(F.coalesce("changed", "leaf"), F.col("steps"))
    text = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), reached.alias("folded_root"))
    text = text.select("doc_id", *[merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], "proof_sha256", merkle.hexed(F.col("folded_root")).alias("folded_root"))
    return text.withColumn("verified", F.col("folded_root") == F.col("root"))


TOKENIZER = "word_bpe_49k.json"


@register("op12_bpe_speculate_verify")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = bpe.load(public_tokenizers.path(TOKENIZER))
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, keep=["doc_id"])
    decoded = bpe.decode(encoded, tokenizer)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


@register("op13_hard_negatives", """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select vec_id as anchor_id, label, v from e where vec_id % 100 = 0),
s as materialized (select a.anchor_id, e.vec_id, e.label = a.label as same, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: coalesce(a.v[i] * e.v[i], 0))) as bigint) as score from a join e on a.anchor_id <> e.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as j from s where same),
n as (select p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, j order by score desc, vec_id) as rank
  from p join s using (anchor_id) where j <= 5 and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, "vec_id", "label", "embedding", positives=5, negatives=10, low=30, high=90, scale=256.0)
