"""Conversations as training text with a loss mask, proven by reading them back.

Grammar of a rendered conversation (one turn after the other, nothing between):

    turn      = "<s>[INST] " text " [/INST]</s>"             role user
              | "<s>[OUT] " text " [/OUT]</s>"               role assistant
              | "<s>[ROLE " name "] " text " [/ROLE]</s>"    any other role, its name percent-encoded

A turn is rendered, read by the parser and compared with its source. A text that doesn't come back, because it holds control
strings or what an escape of them looks like, is escaped and tried again: a backslash goes behind the first character of each
control string, and one more where some already stand there. The parser takes one away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = r"/?s>|/?INST\]|/?OUT\]|/?ROLE[ \]]"
_BARE = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
_TURN = re.compile(r"<s>\[(?:(?P<user>INST\])|(?P<assistant>OUT\])|ROLE (?P<name>[^\] ]*)\]) (?P<text>.*?) \[/(?P<close>INST|OUT|ROLE)\]</s>", re.S)
_ANY = re.compile(rf"[<\[](?:{_CONTROL})")
TURN = "conv_id long, no long, role string, rendered string, start long, loss_start long, loss_end long, escapes int"


def escape(text: str) -> str:
    return _BARE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int]:
    """The turn, and where its text begins."""
    name = {"user": "INST", "assistant": "OUT"}.get(role)
    before, close = (f"<s>[{name}] ", name) if name else (f"<s>[ROLE {quote(role, safe='')}] ", "ROLE")
    return f"{before}{text} [/{close}]</s>", len(before)


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """(role, text) of every turn of a rendered conversation or a part of one; None where it breaks the grammar."""
    out, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            return None
        kind = "user" if m["user"] else "assistant" if m["assistant"] else "other"
        if {"user": "INST", "assistant": "OUT", "other": "ROLE"}[kind] != m["close"] or _ANY.search(m["text"]):
            return None
        out.append((unquote(m["name"]) if kind == "other" else kind, unescape(m["text"])))
        at = m.end()
    return out


class Reader:
    """Parses a conversation that comes piece by piece; where pieces end plays no part."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """The turns that are complete by now. A turn ends at the first closing mark, so more text can't change it."""
        self.rest += piece
        out, at = [], 0
        while m := _TURN.match(self.rest, at):
            found = parse(m[0])
            if found is None:
                raise ValueError("a turn breaks the grammar")
            out += found
            at = m.end()
        self.rest = self.rest[at:]
        return out

    def end(self) -> None:
        if self.rest:
            raise ValueError("a conversation does not end with a turn")


def fit(role: str, text: str) -> tuple[str, int, int, int]:
    """(rendered turn, start and end of its text, number of escapings): escaped until the parser gives the source back."""
    tried, n = text, 0
    while True:
        rendered, start = render(role, tried)
        if parse(rendered) == [(role, text)]:
            return rendered, start, start + len(tried), n
        tried, n = escape(tried), n + 1
        if n > 2:
            raise ValueError("the turn can't be read back")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, no (from 0), role, rendered text, its start in the conversation, the loss mask (start and end
    in the conversation; NULL where no loss is taken: only assistant texts count) and how often it was escaped.

    ``turns`` has conv_id, turn, role and text; other columns play no part. Turns stand by turn, then role, then text; a NULL turn
    is first. NULL texts and roles are empty ones. Repeated turns are turns of their own. A NULL conv_id is a conversation too.
    Rows of a conversation are sorted by Spark and pass as a stream, so a conversation may be of any length.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, no, start = object(), 0, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, no, start = conv, 0, 0
                rendered, a, z, n = fit(role, text)
                loss = role == "assistant"
                for column, value in zip(out, (conv, no, role, rendered, start, start + a if loss else None, start + z if loss else None, n), strict=True):
                    column.append(value)
                no, start = no + 1, start + len(rendered)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in TURN.split(", ")])

    return ordered.mapInArrow(run, TURN)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the rendered text and the loss mask alone: number of turns, digest of the turns that the parser
    finds, characters and digest of the unescaped text under the mask, and rendered characters.

    A conversation is read as one text: the parser finds the turns' borders itself, and the mask is cut by its places in the whole
    conversation. Text that breaks the grammar, a wrong start of a row or a mask outside its row raises an error. The rows of a
    conversation must stand together and in order, as ``format_turns`` returns them.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, done = None, False, []
        n = chars = loss_chars = 0
        turns = loss = hashlib.sha256()
        reader = Reader()

        def close():
            reader.end()
            done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if not open_ or r["conv_id"] != now or r["no"] == 0:
                    if open_:
                        close()
                    now, open_, n, chars, loss_chars = r["conv_id"], True, 0, 0, 0
                    turns, loss, reader = hashlib.sha256(), hashlib.sha256(), Reader()
                if r["start"] != chars:
                    raise ValueError(f"a row is said to start at {r['start']}, the conversation has {chars} characters before it")
                for role, text in reader.feed(r["rendered"]):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if r["loss_start"] is not None:
                    if not chars <= r["loss_start"] <= r["loss_end"] <= chars + len(r["rendered"]):
                        raise ValueError("a mask lies outside its row")
                    text = unescape(r["rendered"][r["loss_start"] - chars : r["loss_end"] - chars])
                    loss.update(text.encode())
                    loss_chars += len(text)
                chars += len(r["rendered"])
            if done:
                yield batch_of(done)
                done = []
        if open_:
            close()
            yield batch_of(done)

    return formatted.mapInArrow(run, schema)
