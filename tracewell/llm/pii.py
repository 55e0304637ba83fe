"""Personal data in texts, by weak supervision.

Candidates are found by patterns: e-mail and IP addresses, card and phone numbers as the base rules have them, and wider shapes
(phone numbers without country code, social security numbers, IBANs, spelt-out e-mail addresses, keys and passwords). Labelers
vote on every candidate: rules for its shape, gazetteers of words before it and of known prefixes and domains, and its context.
Expectation-maximisation over the votes estimates how reliable each labeler is and how likely each candidate is real; a logistic
regression on votes and shape is trained on these probabilities and decides. Base spans that pass their checks always stay;
other candidates are added where the classifier says so and no base span is touched.

All of it is DataFrame functions: texts are scanned once, and votes are counted by pattern of votes, of which there are at most
kinds times three to the number of labelers, however large the corpus is.
"""

from __future__ import annotations

from math import log

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import checkpointed, fresh_dir

BASE = ["email", "ip", "card", "phone"]
WIDE = ["local_phone", "ssn", "iban", "spelt_email", "secret"]
KINDS = BASE + WIDE
#: The kind under which a wide candidate is reported.
REPORTED = {"local_phone": "phone", "spelt_email": "email"}
ORDER = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]
ROUNDS, THRESHOLD = 12, 0.5
LABELERS = ["shape", "words", "known", "edges", "plain"]
VOTES, POOLED = (-1, 0, 1), 20.0
_RUN = 512  # matches whose places are summed together

# Leftmost matches of the base rules. Look-behinds and possessive groups change no match; they keep long runs of letters or digits
# from being tried again at each character, and Java from recursing.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelt_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "secret": r"(?<=(?:password|passwd|pwd|token|secret|apikey|api_key|api-key) {0,2}[=:] {0,2}[\"']?)(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
}
#: A text without this can't match; cheap to test.
GATES = {"email": r"@", "phone": r"\+[0-9]", "spelt_email": r"[\[(]at[\])]", "secret": r"[=:] {0,2}[\"']?[A-Za-z0-9+/_-]{12}|AKIA"}
#: Words before a candidate that speak for it, and that speak against it.
WORDS_FOR = {"email": "mail|contact|write", "spelt_email": "mail|contact|write", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|amex|credit|debit|payment|paid",
             "phone": "phone|tel|call|fax|mobile", "local_phone": "phone|tel|call|fax|mobile", "ssn": "ssn|social", "iban": "iban|bank|account", "secret": "password|passwd|pwd|token|secret|key"}
WORDS_AGAINST = r"version|release|build|isbn|issn|doi|serial|order|invoice|figure|table|page|section|chapter|commit|checksum"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _scan(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __p_kind (the stretches between matches) and __h_kind (the matches)."""
    digit = F.coalesce(F.col(text).rlike("[0-9]"), F.lit(False))
    out = docs.withColumn("__digit", digit)
    columns = {}
    for k in KINDS:
        gate = F.col(text).rlike(GATES[k]) if k in GATES else F.col("__digit")
        gate = F.coalesce(gate, F.lit(False))
        columns[f"__h_{k}"] = F.when(gate, F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k]), F.lit(0))).otherwise(_empty("array<string>"))
        columns[f"__p_{k}"] = F.when(gate, F.split(F.col(text), PATTERNS[k], -1)).otherwise(_empty("array<string>"))
    return out.withColumns(columns)


def _starts(kind: str) -> Column:
    """Places of the matches by run, and each run's length: what lies before it is the stretches up to it and the matches before it. Summed run by run, so that
    many matches don't cost their square."""
    runs = F.transform(F.sequence(F.lit(0), F.expr(f"(size(__h_{kind}) - 1) div {_RUN}")), lambda b: F.slice(F.col(f"__z_{kind}"), b * _RUN + 1, F.lit(_RUN)))
    none = F.struct(F.lit(0).cast("long").alias("at"), _empty("array<bigint>").alias("out"))
    return F.transform(runs, lambda run: F.aggregate(run, none, lambda a, x: F.struct((a["at"] + x["p"] + x["h"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["p"])).alias("out"))))


def _luhn(digits: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + _luhn_digit(F.substring(digits, -i, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _valid(kind: str, t: Column) -> Column:
    """The checks of the base rules."""
    n = F.length(_digits(t))
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda part: F.coalesce(part.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(t))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(kind == "email")


def _votes(kind: str, c: Column) -> dict[str, Column]:
    """1 for, -1 against, 0 no vote, by each labeler, on a candidate with t, before and after."""
    t, before = c["t"], F.lower(c["before"])
    digits = _digits(t)
    vote = lambda yes, no=None: F.when(yes, 1).otherwise(F.lit(0) if no is None else F.when(no, -1).otherwise(0))
    shape = {
        "email": vote(t.rlike(r"^[A-Za-z0-9][^@]{0,63}@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,24}$"), t.rlike(r"\.\.|\.@|@-")),
        "ip": vote(_valid("ip", t) & ~t.rlike(r"(?:^|\.)0[0-9]"), ~_valid("ip", t)),
        "card": vote(_valid("card", t) & F.length(digits).between(13, 19), ~_valid("card", t)),
        "phone": vote(_valid("phone", t) & (F.length(digits) >= 10), ~_valid("phone", t)),
        "local_phone": vote(t.rlike(r"^\(?[2-9]"), t.rlike(r"^\(?[01]")),
        "ssn": vote(~t.rlike(r"^(?:000|666|9)|-00-|-0000$"), t.rlike(r"^(?:000|666|9)|-00-|-0000$")),
        "iban": vote(F.length(F.regexp_replace(t, " ", "")).between(15, 34), F.length(digits) < 8),
        "spelt_email": vote(t.rlike(r"[A-Za-z]{2,24}$"), t.rlike(r"[0-9]$")),
        "secret": vote(t.rlike("[0-9]") & t.rlike("[A-Za-z]"), ~t.rlike("[0-9]")),
    }[kind]
    words = vote(before.rlike(WORDS_FOR[kind]), before.rlike(WORDS_AGAINST))
    known = {
        "email": vote(F.lower(t).rlike(r"[@.](?:gmail|yahoo|hotmail|outlook|icloud|gmx|example)\.")),
        "ip": vote(F.lit(False), t.rlike(r"^(?:0|127|255)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$")),
        "card": vote(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "phone": vote(t.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), t.rlike(r"^\+0")),
        "iban": vote(t.rlike(r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|NL|NO|PL|PT|SE)")),
        "secret": vote(t.rlike("^(?:AKIA|ghp_|sk-|xox)")),
    }.get(kind, F.lit(0))
    glued = c["before"].rlike(r"[A-Za-z0-9_.-]$") | c["after"].rlike(r"^(?:[A-Za-z0-9_]|[.-][A-Za-z0-9])")
    edges = vote(~glued, glued)
    plain = vote(F.lit(False), (F.length(digits) >= 7) & digits.rlike(r"^([0-9])\1+$|0123456|1234567"))
    return dict(zip(LABELERS, (shape, words, known, edges, plain), strict=True))


def _told(kind: str):
    """From match to candidate: what is kept of it."""
    def told(c: Column) -> Column:
        size = F.length(c["t"])
        return F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), (c["start"] + size).cast("long").alias("end"), _valid(kind, c["t"]).alias("base"),
                        *[v.cast("int").alias(n) for n, v in _votes(kind, c).items()], F.when(size < 12, 0).when(size < 18, 1).when(size < 28, 2).otherwise(3).alias("size"))

    return told


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, found): per text the candidates with kind, place (code points, end exclusive), whether the base rules keep them,
    the labelers' votes and a class of length. Only these are kept of the text."""
    out = _scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    out = out.withColumns({f"__z_{k}": F.zip_with(F.slice(f"__p_{k}", F.lit(1), F.size(f"__h_{k}")), f"__h_{k}", lambda p, h: F.struct(F.length(p).cast("long").alias("p"), F.length(h).cast("long").alias("h"))) for k in KINDS})
    out = out.withColumns({f"__l_{k}": _starts(k) for k in KINDS})
    lists = []
    for k in KINDS:
        none = F.struct(F.lit(0).cast("long").alias("at"), _empty("array<bigint>").alias("out"))
        offsets = F.aggregate(f"__l_{k}", none, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        starts = F.flatten(F.zip_with(f"__l_{k}", offsets, lambda x, o: F.transform(x["out"], lambda s: s + o)))
        near = F.zip_with(F.slice(f"__p_{k}", F.lit(1), F.size(f"__h_{k}")), F.slice(f"__p_{k}", F.lit(2), F.size(f"__h_{k}")), lambda p, q: F.struct(F.right(p, F.lit(40)).alias("before"), F.left(q, F.lit(8)).alias("after")))
        whole = F.zip_with(F.zip_with(f"__h_{k}", starts, lambda h, s: F.struct(h.alias("t"), s.alias("s"))), near,
                           lambda h, n: F.struct(h["t"].alias("t"), h["s"].alias("start"), n["before"].alias("before"), n["after"].alias("after")))

        lists.append(F.when(F.size(f"__h_{k}") > 0, F.transform(whole, _told(k))))
    kinds = "array<struct<kind:string,start:bigint,end:bigint,base:boolean," + ",".join(f"{n}:int" for n in LABELERS) + ",size:int>>"
    return out.select("doc_id", F.flatten(F.array(*[F.coalesce(x.cast(kinds), _empty(kinds)) for x in lists])).alias("found"))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """EM over (kind, votes, n): ``patterns`` with the probability ``real``, and by kind the prior and each labeler's vote shares
    given real and not.

    A labeler's votes depend on the kind and on whether the candidate is real: a checksum says much of a card, a digit among
    letters little of a key. A kind's shares lean on those of all kinds together with the weight of ``POOLED`` candidates, so rare
    kinds have reliabilities too. Each round is one aggregate of the pattern table, a row for each kind.
    """
    # Start: a labeler mostly votes for what is real, and against what isn't.
    begin = {y: {v: (0.6 if v == (1 if y else -1) else 0.3 if v == 0 else 0.1) for v in VOTES} for y in (0, 1)}
    shares = {k: {n: begin for n in LABELERS} for k in KINDS}
    prior = dict.fromkeys(KINDS, 0.7)

    def real() -> Column:
        odds = F.lit(None).cast("double")
        for k in reversed(KINDS):
            mine = F.lit(log(prior[k] / (1 - prior[k])))
            for n in LABELERS:
                said = F.lit(0.0)
                for v in VOTES:
                    said = F.when(F.col(n) == v, log(shares[k][n][1][v] / shares[k][n][0][v])).otherwise(said)
                mine = mine + said
            odds = F.when(F.col("kind") == k, mine).otherwise(odds)
        return 1 / (1 + F.exp(-odds))

    def normal(counts: dict) -> dict:
        return {v: x / sum(counts.values()) for v, x in counts.items()}

    for _ in range(rounds):
        q, n_ = F.col("real"), F.col("n")
        sums = [F.sum(F.when(F.col(n) == v, n_ * (q if y else 1 - q)).otherwise(0.0)).alias(f"{n}_{v + 1}_{y}") for n in LABELERS for v in VOTES for y in (0, 1)]
        rows = {r["kind"]: r for r in patterns.withColumn("real", real()).groupBy("kind").agg(F.sum(n_ * q).alias("yes"), F.sum(n_ * (1 - q)).alias("no"), *sums).collect()}
        held = lambda k, n, v, y: rows[k][f"{n}_{v + 1}_{y}"] if k in rows else 0.0
        shares = {k: {} for k in KINDS}
        for n in LABELERS:
            pooled = {y: normal({v: sum(held(k, n, v, y) for k in KINDS) + (3.0 if v == (1 if y else -1) else 1.0) for v in VOTES}) for y in (0, 1)}
            for k in KINDS:
                shares[k][n] = {y: normal({v: held(k, n, v, y) + POOLED * pooled[y][v] for v in VOTES}) for y in (0, 1)}
        for k in KINDS:
            a, b = (rows[k]["yes"] if k in rows else 0.0) + 2, (rows[k]["no"] if k in rows else 0.0) + 1
            prior[k] = min(max(a / (a + b), 0.01), 0.99)
    return patterns.withColumn("real", real()), {"prior": prior, "shares": shares}


def _features() -> dict[str, Column]:
    """Kind, votes, votes by kind and a class of length."""
    votes = [(n, v, x) for n in LABELERS for v, x in (("for", 1), ("against", -1))]
    out = {f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS}
    out |= {f"{n}_{v}": (F.col(n) == x).cast("double") for n, v, x in votes}
    out |= {f"{k}_{n}_{v}": ((F.col("kind") == k) & (F.col(n) == x)).cast("double") for k in KINDS for n, v, x in votes}
    return out | {f"size_{s}": (F.col("size") == s).cast("double") for s in range(3)}


def train(judged: DataFrame) -> dict[str, float]:
    """Weights of the logistic regression, trained on patterns with ``real`` and ``n``: each counts as real and as not real with
    the weight of either."""
    features = _features()
    both = judged.select("*", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("real") * F.col("n")).alias("w")), F.struct(F.lit(0.0).alias("label"), ((1 - F.col("real")) * F.col("n")).alias("w")))).alias("x"))
    rows = both.select(*[v.alias(k) for k, v in features.items()], "x.label", (F.col("x.w") + 1e-6).alias("w"))
    model = LogisticRegression(weightCol="w", regParam=0.003, maxIter=50, standardization=False).fit(VectorAssembler(inputCols=list(features), outputCol="features").transform(rows))
    return {**dict(zip(features, (float(x) for x in model.coefficients), strict=True)), "": float(model.intercept)}


def _probability(c: Column, weights: dict[str, float]) -> Column:
    total = F.lit(weights[""])
    for s in range(3):
        total = total + F.when(c["size"] == s, weights[f"size_{s}"]).otherwise(0.0)
    by_kind = F.lit(0.0)
    for k in reversed(KINDS):
        mine = F.lit(weights[f"is_{k}"])
        for n in LABELERS:
            mine = mine + F.when(c[n] == 1, weights[f"{n}_for"] + weights[f"{k}_{n}_for"]).when(c[n] == -1, weights[f"{n}_against"] + weights[f"{k}_{n}_against"]).otherwise(0.0)
        by_kind = F.when(c["kind"] == k, mine).otherwise(by_kind)
    return 1 / (1 + F.exp(-(total + by_kind)))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs``: arrays of (start, kind, end, score), by start, then kind as in ``ORDER``.

    ``base``: what the base rules keep; ``spans``: these and what the method adds; score is the classifier's probability. NULL and
    empty texts have none. Rows that repeat, or have a NULL id, are rows of their own. Without any candidates nothing is trained
    and nothing added. An empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    folder = fresh_dir(spark, "pii")
    found = candidates(docs, doc_id, text)
    found.write.parquet(folder)
    found = spark.read.schema(found.schema).parquet(folder)
    each = found.where(F.size("found") > 0).select(F.explode("found").alias("c")).select("c.*")
    # At most kinds x 3^labelers x sizes rows.
    patterns = checkpointed(each.groupBy("kind", *LABELERS, "size").agg(F.count("*").alias("n")).coalesce(1))
    weights = None if patterns.isEmpty() else train(checkpointed(estimate(patterns, rounds)[0]))
    return found.select("doc_id", *_decided(weights, threshold))


def _decided(weights: dict[str, float] | None, threshold: float) -> list[Column]:
    order = F.create_map(*[F.lit(x) for i, k in enumerate(ORDER) for x in (k, i)])
    names = F.create_map(*[F.lit(x) for k in KINDS for x in (k, REPORTED.get(k, k))])
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"

    def shown(c: Column) -> Column:
        score = F.lit(None).cast("double") if weights is None else _probability(c, weights)
        return F.struct(c["start"].alias("start"), order[names[c["kind"]]].alias("rank"), names[c["kind"]].alias("kind"), c["end"].alias("end"), score.alias("score"))

    base = F.filter("found", lambda c: c["base"])
    if weights is None:
        added = _empty(kind)
    else:
        wide = F.filter("found", lambda c: c["kind"].isin(*WIDE) & (_probability(c, weights) >= threshold))
        free = F.filter(wide, lambda c: ~F.exists(F.filter("found", lambda b: b["base"]), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        added = F.transform(F.array_distinct(free), shown).cast(kind)
    base = F.transform(base, shown).cast(kind)
    return [F.sort_array(base).alias("base"), F.sort_array(F.concat(base, added)).alias("spans")]


def listed(spans: str) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

