"""Language identification by cross-parsing entropy.

Per language, labelled text makes a suffix automaton. A text is parsed against it greedily: each phrase is the longest match with
any stretch of the labelled text, and the language that needs the fewest phrases wins. Phrases are normalised by the phrases that
other labelled text of the language itself needs a character, since automata of equal text length still differ in how easily
they match.

Every language has its own alphabet, all letters of its labelled text. Automata are built once, on the driver, and broadcast as lists of
transitions. A task turns them into tables for the most frequent letters of the language; transitions by other letters are
looked up one by one. Texts are parsed in pieces of ``PIECE`` characters side by side, all pieces of all texts at once. A phrase ends
with its piece: for all languages alike, and in the normalising text too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIN_DOCS, TRAIN_CHARS = 64, 24_000  # per language: labelled documents read, and characters of them in the automaton
HELD_CHARS = 12_000  # per language: further characters by which phrases are normalised
STRETCH, STRETCHES = 140, 16  # a document's share is made of stretches of so many characters; so many long ones leave the table
PIECE, BATCH_CHARS = 256, 1 << 19
DENSE = 64  # symbols with a column in a table: 0 a letter that the language lacks, 1 between words, then its most frequent letters
TABLES = 12  # tables that a task keeps; with more languages they are made anew for each batch of texts
SHARPNESS = 20.0  # of the score: a language that needs a tenth more phrases counts exp(-2) of the winner


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int = TRAIN_DOCS) -> pd.DataFrame:
    """Up to ``per_language`` labelled documents of each language that may be learned from, chosen by a hash of the id.

    The choice is made on ids alone, each task passing on ``per_language`` ids of a language at most; only chosen texts are read.
    """
    may = F.coalesce(~held_out(F.col(doc_id)), F.lit(True)) & F.col(lang).isNotNull() & F.col(text).isNotNull()
    order = Window.partitionBy("lang").orderBy("h", "id")
    ids = docs.where(may).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.xxhash64(doc_id, F.lit("train")).alias("h"))
    ids = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select(F.col("lang").alias("of"), F.col("id").alias("chosen"))
    # At most per_language rows of each language; of a long text, stretches from its beginning to its end.
    size, part = F.length(text), 4 * TRAIN_CHARS // STRETCHES
    spread = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring(F.col(text), (F.floor(i * (size - part) / (STRETCHES - 1)) + 1).cast("int"), F.lit(part))))
    texts = docs.where(may).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.when(size <= 4 * TRAIN_CHARS, F.col(text)).otherwise(spread).alias("text"))
    return texts.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("chosen")) & (F.col("lang") == F.col("of")), "left_semi").toPandas()


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _spread(text: str, share: int) -> str:
    """``share`` characters of a text, in stretches from its beginning to its end."""
    if len(text) <= share:
        return text
    n = max(1, share // STRETCH)
    return " ".join(text[k : k + share // n] for k in np.linspace(0, len(text) - share // n, n).astype(int).tolist())


def _share(sizes: list[int], total: int) -> int:
    """The most that each text may give so that all together give ``total`` at most; short ones leave more to the others."""
    left, share = total, 0
    for k, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if size > share:
            return max(1, share)
        left -= size
    return max(sizes, default=1)


def learn(rows: pd.DataFrame) -> dict:
    """Automata of all languages as plain arrays, from (lang, id, text) rows."""
    langs, texts = sorted(rows["lang"].unique().tolist()), []
    for lang in langs:
        mine = rows[rows["lang"] == lang].drop_duplicates(["id", "text"])
        mine = mine.iloc[pd.util.hash_array(mine["id"].astype(str).to_numpy(object)).argsort(kind="stable")]
        share = _share([len(t) for t in mine["text"]], TRAIN_CHARS + HELD_CHARS)
        texts.append(" ".join(_spread(t, share) for t in mine["text"]).lower())
    alphabet = sorted({c for t in texts for c in t if c.isalpha()})
    model = {"langs": langs, "alphabet": np.array([ord(c) for c in alphabet], np.int64), "automata": [], "rates": []}
    parser = Parser(model)
    for k, text in enumerate(texts):
        counts = pd.Series([c for c in text[:TRAIN_CHARS] if c.isalpha()], dtype=object).value_counts()
        own = sorted(counts.index, key=lambda c: (-counts[c], c))
        local = np.zeros(len(alphabet) + 2, np.int32)
        local[1] = 1
        place = {c: i + 2 for i, c in enumerate(alphabet)}
        for i, c in enumerate(own):
            local[place[c]] = i + 2
        shared = [parser.symbols(t) for t in (text[:TRAIN_CHARS], text[TRAIN_CHARS : TRAIN_CHARS + HELD_CHARS])]
        train, rest = (local[x] for x in shared)
        model["automata"].append({"local": local, "symbols": len(own) + 2, **_automaton(train)})
        if len(rest) < PIECE:
            model["rates"].append(0.2)
        else:
            pieces = rest[: len(rest) // PIECE * PIECE].reshape(-1, PIECE)
            model["rates"].append(max(_phrases(*parser.table(k), pieces).sum() / pieces.size, 1e-3))
    return model


class Parser:
    """Parses texts against learned automata."""

    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self.alpha = _letters()
        # 0: a letter of no language's text; 1: no letter; then the letters of all languages.
        self.symbol = np.where(self.alpha, 0, 1).astype(np.int32)
        for k, code in enumerate(model["alphabet"].tolist()):
            self.symbol[code] = k + 2
            upper = chr(code).upper()
            if len(upper) == 1 and self.symbol[ord(upper)] == 0:
                self.symbol[ord(upper)] = k + 2
        self.kept: dict[int, tuple] = {}

    def table(self, k: int) -> tuple:
        """(table, keys, values, width) of a language; tables are kept while there are few."""
        if k not in self.kept:
            if len(self.kept) >= TABLES:
                self.kept.clear()
            self.kept[k] = _table(self.model["automata"][k])
        return self.kept[k]

    def symbols(self, text: str) -> np.ndarray:
        out = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return out[_kept(out)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by text and language, symbols by text, whether a text has a letter)."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        letters = np.diff(np.concatenate([[0], np.cumsum(self.alpha[codes])])[cuts]) > 0
        symbols = self.symbol[codes]
        keep = _kept(symbols)
        cuts = np.concatenate([[0], np.cumsum(keep)])[cuts]
        symbols = symbols[keep]
        sizes = np.diff(cuts)
        n = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), n)
        start = cuts[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
        length = np.minimum(PIECE, cuts[1:][owner] - start)
        padded = np.concatenate([symbols, np.full(PIECE, -1, np.int32)])
        grid = padded[start[:, None] + np.arange(PIECE)]
        grid[np.arange(PIECE) >= length[:, None]] = -1  # ends nothing and goes nowhere
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            local = np.append(self.model["automata"][k]["local"], -1)  # -1 stays -1
            out[:, k] = np.bincount(owner, _phrases(*self.table(k), local[grid]), len(texts))
        return out, sizes, letters


def _kept(symbols: np.ndarray) -> np.ndarray:
    """All symbols but repeated gaps between words."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 1) | (symbols[:-1] != 1)
    return keep


def _phrases(table: np.ndarray, keys: np.ndarray, values: np.ndarray, width: int, pieces: np.ndarray) -> np.ndarray:
    """Phrases of each row of ``pieces``, one step for all rows at a time."""
    state, ended = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    for column in np.ascontiguousarray(pieces.T):
        step = table[state, np.where(column >= DENSE, 0, column)]  # -1 is the last column
        rare = np.flatnonzero(column >= DENSE)
        if len(rare):
            step[rare] = _rare(keys, values, width, state[rare], column[rare])
        ended += step & 3
        state = (step >> 2).astype(np.int64)
    return ended + (state > 0)  # a phrase that the piece cuts counts too


def _rare(keys: np.ndarray, values: np.ndarray, width: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """As the table has it, for symbols without a column."""
    def go(s):
        wanted = s * width + symbol
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at] * 4, -1)

    on, new = go(state), go(np.zeros_like(state))
    return np.where(on >= 0, on, np.where(state == 0, 1, np.where(new >= 0, new + 1, 2)))


def _automaton(text: np.ndarray) -> dict[str, np.ndarray]:
    """Transitions (state, symbol, next) of the suffix automaton of ``text`` and its number of states; state 0 is the empty match."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for c in text.tolist():
        now = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    rows = np.array([(s, c, to) for s, out in enumerate(moves) for c, to in sorted(out.items())], np.int32).reshape(-1, 3)
    return {"state": rows[:, 0], "move": rows[:, 1], "to": rows[:, 2], "states": len(moves)}


def _table(automaton: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(next * 4 + phrases ended by state and symbol, and the transitions as sorted keys, their ends, the keys' width).

    The last column, that of -1, stays where it is.
    """
    table = np.full((automaton["states"], DENSE + 1), -1, np.int32)
    often = automaton["move"] < DENSE
    table[automaton["state"][often], automaton["move"][often]] = automaton["to"][often] * 4
    # No way on: a phrase has ended, and the next begins with this symbol; one that the text lacks is a phrase by itself.
    table[1:] = np.where(table[1:] >= 0, table[1:], np.where(table[0] >= 0, table[0] + 1, 2))
    table[0] = np.where(table[0] >= 0, table[0], 1)
    table[:, DENSE] = np.arange(automaton["states"], dtype=np.int32) * 4
    width = max(automaton["symbols"], 1)
    rare = ~often
    keys = automaton["state"][rare].astype(np.int64) * width + automaton["move"][rare]
    return table, keys if len(keys) else np.array([-1]), automaton["to"][rare] if len(keys) else np.array([0], np.int32), width


def predict(docs: DataFrame, rows: pd.DataFrame, text: str = "text") -> DataFrame:
    """The documents with lang_pred and score (0 to 1: the winner's share if every language's excess phrases count against it).

    ``rows``: labelled (lang, id, text), a bounded sample. NULL, empty and letterless texts are ``und`` with score 0, and so is
    every text if nothing was learned; ties go to the first language by name. Columns named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    kept = docs.drop("lang_pred", "score")
    column = kept.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    learned = spark.sparkContext.broadcast(learn(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(learned.value)
        names = np.array([*parser.langs, "und"], object)
        rates = np.array(learned.value["rates"])
        for batch in batches:
            texts = [t or "" for t in batch.column(column).to_pylist()]
            best, score = np.full(len(texts), len(parser.langs)), np.zeros(len(texts))
            for lo, hi in _groups(texts):
                phrases, sizes, letters = _in_parts(parser, texts[lo:hi])
                if not parser.langs:
                    continue
                cost = phrases / np.maximum(sizes, 1)[:, None] / rates
                cost -= cost.min(1, keepdims=True)
                share = np.exp(-SHARPNESS * cost)
                win = cost.argmin(1)
                best[lo:hi] = np.where(letters, win, len(parser.langs))
                score[lo:hi] = np.where(letters, 1 / share.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def _in_parts(parser: Parser, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``Parser.phrases``; a single text longer than a batch is parsed part by part."""
    if len(texts) > 1 or len(texts[0]) <= BATCH_CHARS:
        return parser.phrases(texts)
    parts = [parser.phrases([texts[0][k : k + BATCH_CHARS]]) for k in range(0, len(texts[0]), BATCH_CHARS)]
    return sum(p[0] for p in parts), sum(p[1] for p in parts), np.any([p[2] for p in parts], axis=0)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > BATCH_CHARS:
            yield lo, k
            lo, held = k, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)
