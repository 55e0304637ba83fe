import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import bpe, merkle
from tracewell.llm.queries import LEAF, QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def loaded():
    return bpe.load(PATH)


# --- BPE

PARTS = ["a", "b", "e", "x", "aaa", "the", "ing", "ton", " ", "'s", "'ll", "'D", "!", "!!", " ", "\t", "\n", "é", "é", "Σ", "İ", "ß", "中", "文字", "😀", "\x1c",
         "ֈ", "٣", "½", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " <|EndOfText|> ", "<|", "\x1f", "\x85", "\u2028", "\u3000", "A", "Z", "9", "12", "_", "-", "‍", "ﷺ", "K", "ſ", "ǅ", "</w>"]


def _hard(n=4000):
    rng = random.Random(3)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(30)) for _ in range(n)]
    return [*out, "", "a" * 5000, "ab" * 3000, "é" * 3000, "".join(rng.choice("aeiourstln") for _ in range(20000)), "word " * 100_000]


def test_ids_are_those_of_the_library(library, loaded):
    encoder, texts = bpe.Encoder(loaded), _hard()
    ids, at = encoder.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == want
    assert 0 < encoder.failed < len(encoder.words.index)


def test_only_words_that_need_it_are_merged_exactly(loaded):
    encoder, rng = bpe.Encoder(loaded), random.Random(5)
    words = list({"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 12))) for _ in range(3000)})
    raw = [w.encode() for w in words]
    end = np.cumsum([len(r) for r in raw])
    start, data = end - [len(r) for r in raw], np.frombuffer(b"".join(raw), np.uint8)
    flat, count = encoder.propose(data, start, end)
    ok = encoder.verified(data, start, end, flat, count)
    for good, r, ids in zip(ok, raw, np.split(flat, np.cumsum(count)[:-1])):
        assert good == (encoder.merge(r) == ids.tolist())
    assert 0 < ok.sum() < len(ok)


def test_a_proposal_that_does_not_spell_the_word_is_refused(loaded):
    encoder = bpe.Encoder(loaded)
    data = np.frombuffer(b"the", np.uint8)
    wrong = np.array([loaded["strings"].index("and</w>")], np.int32)
    assert not encoder.verified(data, np.array([0]), np.array([3]), wrong, np.array([1]))[0]


def test_tables_are_encoded_and_decoded(spark, library, loaded):
    texts = [None, "", " \n", *_hard(60), None]
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    rows = bpe.decode(bpe.encode(df.unionByName(df.limit(5)), loaded, keep=["doc_id", "ids"]), loaded).collect()
    assert len(rows) == len(texts) + 5
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df, loaded).columns == ["doc_id", "text", "ids"] and bpe.encode(df.limit(0), loaded).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([0, 10**8, -1, 49407],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, loaded).collect()] == ["", "", "! <|endoftext|>"]


def test_a_task_forgets_words_and_goes_on(library, loaded, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 20)
    encoder = bpe.Encoder(loaded)
    for text in ("one two three " * 3, " ".join(f"w{k}" for k in range(50)), "<|endoftext|> one w3"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.words.index) < 30


def test_other_tokenizer_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.load(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_agrees_with_the_library(spark, library):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe_speculate_verify"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


# --- Merkle manifest

def _docs():
    rng = random.Random(9)
    rows = [(k if k % 11 else None, rng.choice(["a", None]), rng.choice(["en"] * 6 + ["de", "é", None]), k % 3, "Text é %d" % (k % 40) if k % 7 else None) for k in range(180)]
    return [*rows, *rows[:9], (500, "s", "alone", 1, ""), (501, "s", "", 1, "X" * 100_000)]


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_roots_and_proofs(spark, fanout):
    rows = _docs()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, steps string, tree int").repartition(5)
    got = merkle.manifest(df, "lang", "doc_id", LEAF, fanout).withColumn("proof", merkle.proof_digest(F.col("steps"))).withColumn("again", merkle.folded(F.col("leaf"), F.col("steps"))).collect()
    leaves = [(r[0], r[2], brute.merkle_leaf(r)) for r in rows]
    want = brute.merkle(leaves, fanout)
    assert sorted(((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof) for r in got), key=str) == sorted(((leaves[k][0], leaves[k][2], *v[:3]) for k, v in want.items()), key=str)
    assert all(r.again == r.root for r in got)


def test_tampering_shows(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.manifest(df, "lang", "doc_id", LEAF, extra={"changed": merkle.digest(F.lit("other"))})
    assert made.where(merkle.folded(F.col("changed"), F.col("steps")) == F.col("root")).count() == 0


def test_trees_of_no_and_of_one_row(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df.limit(0), "lang", "doc_id", LEAF).count() == 0
    (one,) = merkle.manifest(df, "lang", "doc_id", LEAF).collect()
    assert one.leaf == one.subroot == one.root == bytes.fromhex(brute.merkle_leaf((1, None, None, None, None))) and one.steps == []
    with pytest.raises(ValueError):
        merkle.manifest(df, "lang", "doc_id", LEAF, fanout=1)
