"""BPE encoding by speculation and verification, and decoding.

Words that were seen before are looked up. For the new words of a chunk, all at once: the longest tokens are taken greedily from
the left (the proposal), and every adjacent pair of proposed tokens is tested. A pair is compatible if merging the two tokens'
text gives the two tokens again; a proposal whose pairs are all compatible, and which spells its word, is what merging gives. Only
words that fail are merged rank by rank.

Compatibility: while the text of a token is merged, the symbol at its right edge grows from its last byte to the token, and each
symbol stays there until the merge that makes the next one. Likewise at the left edge. Two tokens are incompatible if some pair of
edge symbols has a merge that comes up while both are there.

The tokenizer file is read once, on the driver; its arrays, bounded by the vocabulary, are broadcast. Executors need no file.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracewell.llm.words import mix

CHUNK = 1 << 20  # characters of text that are encoded at a time
KNOWN_WORDS = 300_000  # words, and pieces between white space, that a task remembers; it forgets all of them beyond
SPECIAL = " "  # before a special token's name: no piece begins so
SHORT = 48  # words of up to so many bytes are merged together, longer ones each for itself
NEVER = np.int32(2**31 - 1)
NONE = int(NEVER)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# --- the tokenizer file


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next free code from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranges_of(found: set[int]) -> str:
    """Code points as ranges for a bracket expression."""
    starts, ends = sorted(c for c in found if c - 1 not in found), sorted(c for c in found if c + 1 not in found)
    return "".join(rf"\U{a:08x}-\U{z:08x}" for a, z in zip(starts, ends, strict=True))


def _members(of: str) -> set[int]:
    """Code points that the tokenizers library counts to a class such as ``\\s``."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(of), "removed", invert=True)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return {ord(x) for k in range(0, len(codes), 4096) for x, _ in split.pre_tokenize_str("".join(map(chr, codes[k : k + 4096])))}


def _edges(size: int, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
    """Symbols at the right and left edge of each token while it is merged, and the rank at which each of them ends."""
    out = {}
    for side, child in (("right", right), ("left", left)):
        nodes, until = [np.arange(size, dtype=np.int32)], [np.full(size, NEVER)]
        while (nodes[-1] >= 0).any():
            up = nodes[-1]
            down = np.where(up >= 0, child[up], -1)
            until.append(np.where(down >= 0, rank[up], -1).astype(np.int32))
            nodes.append(down.astype(np.int32))
        out[side], out[f"{side}_until"] = np.stack(nodes[:-1]), np.stack(until[:-1])
    return out


class Ranks:
    """Rank of a pair of tokens, by binary search among the merges."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.keys, self.ranks = keys, ranks

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER) if len(self.keys) else np.full(len(a), NEVER)


def first_crossing(a: np.ndarray, b: np.ndarray, edges: dict[str, np.ndarray], ranks: Ranks) -> np.ndarray:
    """Lowest rank at which a merge crosses the border between tokens ``a`` and ``b``; NEVER if they are compatible.

    A merge of rank p takes symbols x and y if x lasts beyond p (a merge of the same rank to the left comes first) and y does not
    end before p.
    """
    lowest = np.full(len(a), NEVER)
    for x, x_until in zip(edges["right"], edges["right_until"], strict=True):
        have_x = np.flatnonzero(x[a] >= 0)
        for y, y_until in zip(edges["left"], edges["left_until"], strict=True):
            k = have_x[y[b[have_x]] >= 0]
            if len(k):
                p = ranks.find(x[a[k]], y[b[k]])
                lowest[k] = np.where((p < x_until[a[k]]) & (p <= y_until[b[k]]), np.minimum(p, lowest[k]), lowest[k])
    return lowest


def load(path: str) -> dict:
    """What encoding and decoding need of a tokenizer file, as plain arrays and strings.

    Files with byte-level words, a word-end suffix and one merge for each longer token are understood; others are refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, (split, level) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    plain = (model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
             and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True) and level["type"] == "ByteLevel"
             and not level["add_prefix_space"] and not level["use_regex"] and spec["decoder"] is None and spec["normalizer"]["type"] == "Sequence"
             and all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"]))
    if not plain:
        raise ValueError("this kind of tokenizer file is not supported")
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix")
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
    left, right, rank = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    for k, (a, b) in enumerate(merges):
        t = vocab[a + b]
        if rank[t] >= 0 or any(len(x.removesuffix(suffix)) > 1 and rank[vocab[x]] < 0 for x in (a, b)):
            raise ValueError(f"merge {k} makes a token again or uses one that is not made yet")
        left[t], right[t], rank[t] = vocab[a], vocab[b], k
    made = np.flatnonzero(rank >= 0)
    made = made[np.argsort(rank[made])]
    keys = (left[made].astype(np.int64) << 32) | right[made]
    order = np.argsort(keys)
    ranks = Ranks(keys[order], rank[made][order])
    edges = _edges(size, left, right, rank)
    # A token can be proposed only if merging its own text gives it.
    own = np.ones(size, bool)
    own[made] = first_crossing(left[made], right[made], edges, ranks) == rank[made]
    for t in made.tolist():
        own[t] &= own[left[t]] and own[right[t]]
    byte = _byte_alphabet()
    spelt, final, strings = [b""] * size, np.zeros(size, bool), [""] * size
    for s, t in vocab.items():
        strings[t] = s
        final[t] = s.endswith(suffix) and s != suffix
        spelt[t] = bytes(byte[c] for c in (s[: -len(suffix)] if final[t] else s))
    start = np.full((2, 256), -1, np.int32)
    for t in np.flatnonzero(rank < 0).tolist():
        if len(spelt[t]) == 1:
            start[int(final[t]), spelt[t][0]] = t
    if (start < 0).any():
        raise ValueError("the vocabulary lacks single bytes")
    for t in spec["added_tokens"]:
        strings[t["id"]] = t["content"]
    pattern = split["pattern"]["Regex"]
    for of in set(re.findall(r"\\p\{\w+\}|\\s", pattern)):
        pattern = pattern.replace(of, _ranges_of(_members(of)))
    blank = _members(r"\s")
    odd = blank ^ {c for c in range(0x110000) if chr(c).isspace()}  # what Python's split sees otherwise
    if any(re.search(pattern, chr(c)) for c in blank):
        raise ValueError("words with white space inside are not supported")
    at = np.concatenate([[0], np.cumsum([len(x) for x in spelt])])
    usable = np.flatnonzero(own & (at[1:] > at[:-1]))
    return {"strings": strings, "bytes": np.frombuffer(b"".join(spelt), np.uint8), "at": at, "final": final, "usable": usable, "start": start,
            "merge_keys": ranks.keys, "merge_ranks": ranks.ranks, "made": made, "edges": edges, "pattern": pattern, "blank": _ranges_of(blank), "odd": _ranges_of(odd),
            "normalizer": json.dumps(spec["normalizer"]), "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


# --- encoding


def _span_hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, length, final) -> np.ndarray:
    return mix((total[start + length] - total[start]) * down[start] + np.uint64(2) * np.asarray(length, np.uint64) + np.asarray(final, np.uint64))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the bytes' codes times powers of an odd number, and the powers of its inverse."""
    up = np.full(len(data) + 1, _MULT)
    down = np.full(len(data) + 1, _INVERSE)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return total, down


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - start, length)


class Lookup:
    """Strings and their ids."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat, self.from_, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        self.index.update(zip(keys, range(len(self.index), len(self.index) + len(keys)), strict=True))
        self.from_ = np.concatenate([self.from_, len(self.flat) + np.cumsum(count) - count])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    def missing(self, keys: list[str]) -> list[str]:
        found = list(map(self.index.get, keys))
        return list(dict.fromkeys(k for k, i in zip(keys, found, strict=True) if i is None)) if None in found else []

    def get(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all keys, where each key's ids begin and the end of the last)."""
        which = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        return self.flat[_ranges(self.from_[which], self.count[which])], np.concatenate([[0], np.cumsum(self.count[which])])


class Encoder:
    """Encodes texts with a loaded tokenizer; remembers the words it has met."""

    def __init__(self, spec: dict):
        from tokenizers import normalizers

        self.spec, self.edges = spec, spec["edges"]
        self.ranks = Ranks(spec["merge_keys"], spec["merge_ranks"])
        self.pairs: dict[int, int] = {}
        steps = [getattr(normalizers, s["type"])() if s["type"] in ("NFC", "Lowercase") else None for s in json.loads(spec["normalizer"])["normalizers"]]
        # Replaced white space is dropped by the split, whatever it is replaced with.
        self.steps = [s for s in steps if s is not None]
        self.lower = any(s["type"] == "Lowercase" for s in json.loads(spec["normalizer"])["normalizers"])
        self.cut = re.compile(spec["pattern"]).findall
        self.blank, self.odd = re.compile(f"[{spec['blank']}]+").split, re.compile(f"[{spec['odd']}]" if spec["odd"] else "(?!)").search
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(spec["special"], key=len, reverse=True))) + ")") if spec["special"] else None
        size = spec["at"][1:] - spec["at"][:-1]
        self.size = size
        total, down = _sums(spec["bytes"])
        ids = spec["usable"]
        values = _span_hash(total, down, spec["at"][ids], size[ids], spec["final"][ids])
        order = np.argsort(values)
        self.values, self.ids = values[order], ids[order].astype(np.int32)
        self.seen = np.zeros(1 << 22, bool)  # low bits of the values; spares most searches
        self.seen[(values & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.lengths = np.unique(size[ids])[::-1]
        self.failed = 0
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = Lookup(), Lookup()
        for content, t in self.spec["special"].items():
            self.pieces.add([SPECIAL + content], np.array([t], np.int32), np.array([1]))

    def split(self, text: str) -> list[str]:
        """The pieces of a text between white space; special tokens stand as pieces of their own."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(SPECIAL + part)
                continue
            if part.isascii():
                part = part.lower() if self.lower else part
            else:
                for s in self.steps:
                    part = s.normalize_str(part)
            # No word has white space inside, so pieces can be cut into words each for itself.
            out += filter(None, self.blank(part)) if self.odd(part) else part.split()
        return out

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, their number by word): the longest token at each place, from the left. No token at all proposes byte 0."""
        total, down = _sums(data)
        at, todo = start.copy(), np.arange(len(start))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(todo):
            here, stop = at[todo], end[todo]
            token = np.full(len(todo), -1, np.int32)
            open_ = np.arange(len(todo))
            for n in self.lengths.tolist():
                fits = open_[here[open_] + n <= stop[open_]]
                if not len(fits):
                    continue
                value = _span_hash(total, down, here[fits], n, here[fits] + n == stop[fits])
                maybe = np.flatnonzero(self.seen[(value & np.uint64(len(self.seen) - 1)).astype(np.int64)])
                place = np.searchsorted(self.values, value[maybe])
                place[place == len(self.values)] = 0
                hit = self.values[place] == value[maybe]
                token[fits[maybe[hit]]] = self.ids[place[hit]]
                open_ = open_[token[open_] < 0]
            token[token < 0] = self.spec["start"][0, 0]
            steps.append((todo, token))
            at[todo] += self.size[token]
            todo = todo[at[todo] < end[todo]]
        count = np.zeros(len(start), np.int64)
        for k, _ in steps:
            count[k] += 1
        flat, first, done = np.zeros(int(count.sum()), np.int32), np.cumsum(count) - count, np.zeros(len(start), np.int64)
        for k, token in steps:
            flat[first[k] + done[k]] = token
            done[k] += 1
        return flat, count

    def verified(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        """True for the words whose proposal spells them and has compatible pairs only."""
        word = np.repeat(np.arange(len(start)), count)
        last = np.ones(len(flat), bool)
        last[:-1] = word[1:] != word[:-1]
        size = self.size[flat]
        ok = np.bincount(word, size, len(start)).astype(np.int64) == end - start
        ok[word[self.spec["final"][flat] != last]] = False
        # Every byte of every token against the word's byte, for proposals of the right length.
        good = ok[word]
        theirs = self.spec["bytes"][_ranges(self.spec["at"][flat[good]], size[good])]
        mine = data[_ranges(start[ok], (end - start)[ok])]
        ok[np.repeat(word[good], size[good])[theirs != mine]] = False
        k = np.flatnonzero(~last & ok[word])
        pairs, inverse = np.unique((flat[k].astype(np.int64) << 32) | flat[k + 1], return_inverse=True)
        fits = first_crossing((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), self.edges, self.ranks) == NEVER
        ok[word[k[~fits[inverse]]]] = False
        return ok

    def merge_short(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, their number by word) of many short words: each step merges the best pair of every word that has one."""
        count = end - start
        inner, final = self.spec["start"]
        flat = inner[data[_ranges(start, count)]]
        ends = np.cumsum(count)
        flat[ends - 1] = final[data[end - 1]]
        out, first = flat.copy(), ends - count  # symbols of a word stay at the front of its place
        rank = np.full(len(flat), NEVER)
        pair = np.ones(len(flat), bool)
        pair[ends - 1] = False
        at = np.flatnonzero(pair)
        rank[at] = self.ranks.find(out[at], out[at + 1])
        todo = np.arange(len(start))
        left = count.copy()
        while len(todo):
            places = _ranges(first[todo], left[todo])
            begins = np.cumsum(left[todo]) - left[todo]
            lowest = np.minimum.reduceat(rank[places], begins)
            todo, begins, lowest, n = todo[lowest < NEVER], begins[lowest < NEVER], lowest[lowest < NEVER], left[todo][lowest < NEVER]
            if not len(todo):
                break
            # The first place of a word with its lowest rank.
            word = np.repeat(np.arange(len(todo)), n)
            places = _ranges(first[todo], n)
            hit = np.flatnonzero(rank[places] == lowest[word])
            hit = hit[np.unique(word[hit], return_index=True)[1]]
            here = places[hit]
            out[here] = self.spec["made"][lowest]
            # What stands right of the merged pair moves one place to the left.
            stop = first[todo] + n
            moved = _ranges(here + 1, stop - here - 2)
            out[moved], rank[moved] = out[moved + 1], rank[moved + 1]
            left[todo] -= 1
            rank[stop - 2] = NEVER
            for k in (here, here - 1):
                ok = (k >= first[todo]) & (k < stop - 2)
                rank[k[ok]] = self.ranks.find(out[k[ok]], out[k[ok] + 1])
        return out[_ranges(first, left)], left

    def merge(self, word: bytes) -> list[int]:
        """Merges rank by rank, the leftmost pair of equal rank first; for words of any length."""
        inner, last = self.spec["start"]
        ids = [int(inner[b]) for b in word[:-1]] + [int(last[word[-1]])]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        if not self.pairs:
            self.pairs = dict(zip(self.ranks.keys.tolist(), self.ranks.ranks.tolist(), strict=True))
        rank_of, made = self.pairs.get, self.spec["made"].tolist()
        now = [rank_of((a << 32) | b, NONE) for a, b in zip(ids, ids[1:], strict=False)] + [NONE]
        heap = [(p, i) for i, p in enumerate(now) if p != NONE]
        heapq.heapify(heap)
        while heap:
            p, i = heapq.heappop(heap)
            if now[i] != p:
                continue
            j = after[i]
            ids[i], ids[j], after[i], now[j] = made[p], -1, after[j], NONE
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    q = now[k] = rank_of((ids[k] << 32) | ids[after[k]], NONE) if after[k] < n else NONE
                    if q != NONE:
                        heapq.heappush(heap, (q, k))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes new words, all different: propose, verify, merge what fails."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum([len(r) for r in raw])
        start = end - [len(r) for r in raw]
        flat, count = self.propose(data, start, end)
        bad = np.flatnonzero(~self.verified(data, start, end, flat, count))
        self.failed += len(bad)
        if len(bad):
            is_long = (end - start)[bad] > SHORT
            short, long_ = bad[~is_long], bad[is_long]
            merged = [np.array(self.merge(raw[k]), np.int32) for k in long_.tolist()]
            tokens, n = self.merge_short(data, start[short], end[short])
            good = np.setdiff1d(np.arange(len(words)), bad)
            order = np.concatenate([good, short, long_])
            words = [words[k] for k in order.tolist()]
            flat = np.concatenate([flat[_ranges((np.cumsum(count) - count)[good], count[good])], tokens, *merged])
            count = np.concatenate([count[good], n, np.array([len(m) for m in merged], np.int64)])
        self.words.add(words, flat, count)

    def learn_pieces(self, pieces: list[str]) -> None:
        """Encodes new pieces by their words."""
        words = [self.cut(p) for p in pieces]
        n = np.array([len(w) for w in words], np.int64)
        flat = list(chain.from_iterable(words))
        new = self.words.missing(flat)
        if new:
            self.learn(new)
        ids, at = self.words.get(flat)
        ends = at[np.cumsum(n)]
        self.pieces.add(pieces, ids, np.diff(ends, prepend=0))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the end of the last)."""
        if max(len(self.words.index), len(self.pieces.index)) > KNOWN_WORDS:
            self.forget()
        pieces = [self.split(t) for t in texts]
        n = np.array([len(p) for p in pieces], np.int64)
        flat = list(chain.from_iterable(pieces))
        new = self.pieces.missing(flat)
        if new:
            self.learn_pieces(new)
        ids, at = self.pieces.get(flat)
        return ids, at[np.concatenate([[0], np.cumsum(n)])]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about CHUNK bytes, one text at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    until, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + CHUNK, "right")))
        yield i, j
        i = j


def _columns(df: DataFrame, drop: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != drop)


def encode(docs: DataFrame, tokenizer: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with ``ids``, the tokens of their whole text.

    ``keep``: the columns that go on (all, if not given). NULL is an empty text and has no tokens; texts may be of any length, those
    of a chunk together up to CHUNK characters or one text. Strings of special tokens become these. Rows are not
    moved; equal rows give equal rows, no rows none. A column named ids is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    names = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    rows = docs.select(*names, docs[text].alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(len(names))
            for i, j in _chunks(texts):
                ids, at = encoder.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(names))), lists], names=[*names, "ids"])

    return rows.mapInArrow(work, _columns(rows.select(*names), "ids") + "ids array<int>")


def decode(rows: DataFrame, tokenizer: dict, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the tokens as the vocabulary writes them, a space between.

    NULL ids, or none, give an empty text; an id that the vocabulary lacks is left out. A column named decoded is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer["strings"])
    names = [c for c in rows.columns if c != "decoded"]
    kept = rows.select(*names)
    place = names.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array([s or None for s in shared.value], pa.string())
        named = strings.is_valid().to_numpy(zero_copy_only=False)
        for batch in batches:
            lists = batch.column(place)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            until = np.cumsum(n)
            i = 0
            while i < len(n):
                base = until[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(until, base + CHUNK, "right")))
                mine = flat[base : until[j - 1]]
                there = (mine >= 0) & (mine < len(strings))
                there[there] = named[mine[there].astype(np.int64)]
                at = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], until[i:j] - base])]
                tokens = strings.take(pa.array(mine[there].astype(np.int64)))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), tokens), " ")
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), joined], names=[*names, "decoded"])
                i = j

    return kept.mapInArrow(work, _columns(kept, "decoded") + "decoded string")
