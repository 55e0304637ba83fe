import gzip
import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat_format, mixing, sharding, warc


# --- chat formatting

def _hard_texts(rng):
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[ROLE ", "[/ROLE]", "\\", "<", "[", "]", " ", "x", "\n", "é", "😀", "<\\s>", "[\\/INST]"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]


def test_every_text_comes_back_and_plain_ones_are_not_escaped():
    for text in _hard_texts(random.Random(1)):
        for role in ("user", "assistant", "system", "a]b c", ""):
            rendered, a, z, n = chat_format.fit(role, text)
            assert chat_format.parse(rendered) == [(role, text)] and chat_format.unescape(rendered[a:z]) == text
            assert n == 0 or chat_format.escape(text) != text
    assert chat_format.fit("user", "plain [x] <b> text")[3] == 0


def test_whole_conversations_parse_and_bad_ones_do_not():
    turns = [("user", "</s>[INST]"), ("assistant", "[/INST]<s>"), ("tool", "x")]
    whole = "".join(chat_format.fit(*t)[0] for t in turns)
    assert chat_format.parse(whole) == turns
    assert chat_format.parse(whole[:-1]) is None and chat_format.parse("[INST] x [/INST]</s>") is None and chat_format.parse("<s>[INST] a [/OUT]</s>") is None


def test_digests_of_conversations(spark):
    rng = random.Random(2)
    texts = _hard_texts(rng)
    rows = [(k % 9, k // 9 if k % 5 else None, rng.choice(["user", "assistant", "system"]), t) for k, t in enumerate(texts)]
    rows += [(None, 0, "user", "none"), (77, 0, None, None), (77, 1, "assistant", "z" * 200000), (77, 1, "assistant", "z" * 200000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, no int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode()))
        said = "".join(x[3] for x in mine if x[2] == "assistant")
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def test_borders_are_found_wherever_the_pieces_end():
    rng = random.Random(7)
    texts = _hard_texts(rng)
    for k in range(0, 400, 8):
        turns = [(rng.choice(["user", "assistant", "tool"]), t) for t in texts[k:k + 8]]
        whole = "".join(chat_format.fit(*t)[0] for t in turns)
        reader, got, at = chat_format.Reader(), [], 0
        while at < len(whole):
            n = rng.randrange(1, 40)
            got += reader.feed(whole[at:at + n])
            at += n
        reader.end()
        assert got == turns == chat_format.parse(whole)
    broken = chat_format.Reader()
    broken.feed("<s>[INST] x")
    with pytest.raises(ValueError):
        broken.end()
    with pytest.raises(ValueError):
        chat_format.Reader().feed("<s>[INST] a [/OUT]</s>")


@pytest.mark.parametrize("change,error", [({"start": "start + 1"}, "start"), ({"loss_start": "loss_start + 100"}, "mask"), ({"rendered": "concat(rendered, 'x')"}, "start")])
def test_wrong_offsets_and_texts_are_refused(spark, change, error):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "[/OUT] ho"), (1, 2, "assistant", "x")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_turns(df)
    assert chat_format.read_back(formatted).head().loss_chars == 10
    with pytest.raises(Exception, match=error):
        chat_format.read_back(formatted.withColumns({c: F.expr(e) for c, e in change.items()})).collect()


def test_a_mask_that_is_off_by_one_shows_in_the_digest(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_turns(df)
    moved = formatted.withColumns({"loss_start": F.col("loss_start") - 1, "loss_end": F.col("loss_end") - 1})
    assert chat_format.read_back(formatted).head().loss_sha256 == hashlib.sha256(b"hello").hexdigest() != chat_format.read_back(moved).head().loss_sha256


# --- sharding

@pytest.mark.parametrize("rows,parts,shards,block", [(1000, 7, 24, 10), (5, 3, 24, 65536), (0, 2, 3, 4), (333, 5, 1, 50)])
def test_shards_have_exact_sizes_and_gapless_slots(spark, rows, parts, shards, block):
    df = spark.range(rows).select(F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("doc_id"), F.lit("own").alias("shard"), F.when(F.col("id") % 3 > 0, F.lit("t")).alias("text")).repartition(parts)
    out = sharding.shuffle_into_shards(df, shards, block_rows=block)
    got = out.select("shard", "slot", "doc_id").collect()
    sizes = np.bincount([r.shard for r in got], minlength=shards)
    assert len(got) == rows and sizes.max() - sizes.min() <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    count = lambda d: sorted((r.doc_id, r["n"]) for r in d.na.fill(-1, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert count(out) == count(df)


def test_matrix_rows_add_up_and_follow_the_hypergeometric_mean():
    counts, columns = np.array([10, 0, 35, 5, 50]), np.array([30, 40, 30])
    for seed in range(5):
        rows = [sharding.matrix_row(counts, columns, k, seed) for k in range(5)]
        table = np.array([r for r, _ in rows])
        assert (table.sum(0) == columns).all() and (table.sum(1) == counts).all()
        assert all((sent == table[:k].sum(0)).all() for k, (_, sent) in enumerate(rows))
    mean = np.mean([sharding.matrix_row(counts, columns, 2, seed)[0] for seed in range(2000)], 0)
    assert np.allclose(mean, 35 * columns / 100, atol=0.2)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_the_second_permutation_is_one(size):
    assert sorted(sharding.permuted(np.arange(size), size, 5).tolist()) == list(range(size))
    parts = np.concatenate([sharding.permuted(np.arange(a, min(a + 7, size)), size, 5) for a in range(0, size, 7)])
    assert (parts == sharding.permuted(np.arange(size), size, 5)).all()  # number by number


def _chi_square(table):
    expected = table.sum(0) * table.sum(1)[:, None] / table.sum()
    return float(((table - expected) ** 2 / expected).sum()), (table.shape[0] - 1) * (table.shape[1] - 1)


def test_places_tell_nothing_of_where_a_row_comes_from(spark):
    """Chi-square of source against place: within five standard deviations of its degrees of freedom."""
    table = np.zeros((10, 10))
    for key in range(300):
        np.add.at(table, (np.arange(100) // 10, sharding.permuted(np.arange(100), 100, key) // 10), 1)
    value, free = _chi_square(table)
    assert abs(value - free) < 5 * np.sqrt(2 * free)
    df = spark.range(0, 24000, 1, 6).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string").cast("binary")).alias("text"))
    rows = sharding.shuffle_into_shards(df, 24, block_rows=100).collect()
    # Each row keeps its own text.
    assert all(r.text == hashlib.md5(str(r.doc_id).encode()).hexdigest() for r in rows) and len({r.doc_id for r in rows}) == 24000
    for place in (lambda r: r.shard, lambda r: r.slot // 100, lambda r: (r.shard * 7 + r.slot) % 11):
        table = np.zeros((24, 1 + max(place(r) for r in rows)))
        np.add.at(table, ([r.doc_id // 1000 for r in rows], [place(r) for r in rows]), 1)
        value, free = _chi_square(table)
        # Fixed shard sizes make the first of these a little smaller than a free draw.
        assert abs(value - free) < 5 * np.sqrt(2 * free), (value, free)


def test_draws_for_a_part_do_not_grow_with_blocks(monkeypatch):
    """A million parts, ten billion rows: as many draws as the tree is deep, of one number for each shard."""
    drawn = []
    split = sharding._split
    monkeypatch.setattr(sharding, "_split", lambda rng, columns, n: drawn.append(len(columns)) or split(rng, columns, n))
    counts = np.full(1_000_000, 10_000)
    row, sent = sharding.matrix_row(counts, sharding.shard_sizes(10**10, 24), 777_777, 7)
    assert len(drawn) <= 20 and set(drawn) == {24} and row.sum() == 10_000 and sent.sum() == 777_777 * 10_000


def test_any_row_may_go_anywhere_and_large_draws_are_right():
    rng = sharding._rng(1)
    big = [sharding._hypergeometric(rng, 2_000_000_000, 1_000_000_000, 9_000) for _ in range(300)]
    assert abs(np.mean(big) - 6000) < 10 and 30 < np.std(big) < 62
    assert sharding._split(rng, np.array([10**9, 10**9]), 2 * 10**9).tolist() == [10**9, 10**9]


# --- mixing

def plain_share(budget, children):
    """Water-filling by repetition: (name, weight, cap) to what each gets."""
    got, live = {n: 0.0 for n, _, _ in children}, [c for c in children if c[1] > 0 and c[2] > 0]
    while live and budget > 1e-9:
        level = budget / sum(w for _, w, _ in live)
        full = [c for c in live if level * c[1] >= c[2]]
        for n, w, cap in full or live:
            got[n] = cap if full else level * w
        if not full:
            break
        budget -= sum(c[2] for c in full)
        live = [c for c in live if c not in full]
    return got


def test_share_equals_water_filling(spark):
    rng = random.Random(3)
    rows = [(f"p{p}", f"c{k}", float(rng.choice([0, 1, 2, 5])), float(rng.randrange(0, 100)), float(80 + 10 * p)) for p in range(6) for k in range(7)]
    df = spark.createDataFrame(rows, "parent string, child string, weight double, cap double, budget double")
    got = {(r.parent, r.child): r.given for r in mixing.share(df, ["parent"]).collect()}
    for p in range(6):
        mine = [(c, w, cap) for q, c, w, cap, _ in rows if q == f"p{p}"]
        for c, x in plain_share(80 + 10 * p, mine).items():
            assert got.get((f"p{p}", c), 0.0) == pytest.approx(x)


def test_mix_takes_prefixes_of_epochs(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["en", "de", None]), "hot" if k % 3 == 0 else f"s{k % 4}", "own") for k in range(600)]
    rows += [(None, None, "en", "hot", "own"), (7000, "", "de", "s1", "own"), (5, rows[5][1], *rows[5][2:]), (7001, "w " * 20000, "de", "s2", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    budget = 9000
    out = mixing.mix(df, levels, {"source": {"hot": 3.0, "s0": 1.0, "s1": 1.0, "s2": 1.0}}, budget, epochs=2).collect()
    words = lambda t: len((t or "").split())
    leaf = {}
    for i, t, lang, source, _ in rows:
        if source != "s3":
            leaf.setdefault((lang, source), []).append((i, t))
    caps = {k: 2 * sum(words(t) for _, t in v) for k, v in leaf.items()}
    langs = plain_share(budget, [(lang, 1.0, sum(c for k, c in caps.items() if k[0] == lang)) for lang in {k[0] for k in caps}])
    taken = {}
    for r in out:
        assert r.source != "s3"
        taken.setdefault((r.lang, r.source), []).append(r)
    for lang, given in langs.items():
        for source, x in plain_share(given, [(k[1], 3.0 if k[1] == "hot" else 1.0, caps[k]) for k in caps if k[0] == lang]).items():
            mine = taken.get((lang, source), [])
            total = sum(words(r.text) for r in mine)
            largest = max(words(t) for _, t in leaf[(lang, source)])
            assert total <= x + 1 and total > x - 2 * largest - 1, (lang, source)
            # A document comes k + 1 times only if all of its leaf have come k times.
            last = max((r.epoch for r in mine), default=0)
            for e in range(last):
                assert sum(r.epoch == e for r in mine) == len(leaf[(lang, source)])
    assert mixing.mix(df.limit(0), levels, {}).count() == 0


# --- WARC

def test_archives_come_back_whole_and_bytes_do_not_change(spark, tmp_path):
    big = "é" * 600
    rows = [(k, f"http://x/{k} \r\n", f"<p>{k}</p>" * (k % 40), 1) for k in range(200)]
    rows += [(300, "u", big, 1), (305, None, big, 1), (305, None, big, 1), (302, "u", big, 1), (None, "u", big, 1), (400, "u", None, 1), (401, "u", "short", 1), (402, "u", "short", 1), (403, "u", "\r\n\r\nWARC/1.1\r\n" + "q" * 300000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind int").repartition(4)
    folder = str(tmp_path / "a")
    warc.write_archives(pages, folder, file_bytes=4000, range_bytes=20000)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            assert (r.payload == (html or "")) if r.record_type == "response" else r.payload is None
    assert [(r.record_type, r.refers_to) for k in (300, 302, None) for r in by[k]] == [("revisit", 305)] * 3
    assert {r.record_type for k in (305, 400, 401, 402) for r in by[k]} == {"response"}
    files = sorted(f for f in os.listdir(folder) if f.endswith(".gz"))
    listed = [json.loads(x) for f in os.listdir(f"{folder}/manifest") if f.startswith("part") for x in open(f"{folder}/manifest/{f}")]
    assert files == sorted(x["file"] for x in listed) and len(files) > 3 and not os.listdir(f"{folder}/_temporary")
    assert all(x["bytes"] <= 4000 or x["records"] == 1 for x in listed)
    again = str(tmp_path / "b")
    warc.write_archives(pages, again, file_bytes=4000, range_bytes=20000)
    assert all(open(f"{folder}/{f}", "rb").read() == open(f"{again}/{f}", "rb").read() for f in files)
    assert gzip.open(f"{folder}/{files[0]}").read(8) == b"WARC/1.1"
    empty = str(tmp_path / "c")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_a_changed_archive_is_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    folder = str(tmp_path / "a")
    warc.write_archives(pages, folder)
    name = f"{folder}/{[f for f in os.listdir(folder) if f.endswith('.gz')][0]}"
    data = gzip.open(name).read().replace(b"text\r\n\r\n", b"tEXt\r\n\r\n")
    with gzip.open(name, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, folder).collect()


def test_a_file_with_other_bytes_than_the_manifest_says_is_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    folder = str(tmp_path / "a")
    warc.write_archives(pages, folder)
    name = f"{folder}/{[f for f in os.listdir(folder) if f.endswith('.gz')][0]}"
    data = gzip.open(name).read()
    with open(name, "wb") as f:  # the same records, packed in another way
        f.write(gzip.compress(data, 1, mtime=7))
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(spark, folder).collect()


def test_archives_are_read_by_as_many_tasks_as_there_are_files(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.md5(F.col("id").cast("string").cast("binary")), 40).alias("html"))
    folder = str(tmp_path / "a")
    warc.write_archives(pages, folder, file_bytes=4000, range_bytes=40000)
    n = len([f for f in os.listdir(folder) if f.endswith(".gz")])
    rows = warc.read_archives(spark, folder)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and n > 5
    assert rows.rdd.getNumPartitions() == n and rows.count() == 300


def test_unnamed_values_weigh_as_the_rest(spark):
    df = spark.createDataFrame([(k, "w " * 100, s) for k, s in enumerate(["a"] * 5 + ["b"] * 5 + [None] * 5)], "doc_id long, text string, source string")
    take = lambda w: {r.source: r.n for r in mixing.mix(df, {"source": F.col("source")}, {"source": w}, 600, epochs=1).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert take({"a": 2.0, mixing.REST: 1.0}) == {"a": 3, "b": 1, None: 1} and take({"a": 1.0}) == {"a": 5}
