"""Cases that larger tables have: what a query holds, writes or repeats must not grow with them."""

import random
import re
import time
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from mailloom.functions import arrow, blocks
from mailloom.functions import text as T
from mailloom.functions import tokens
from mailloom.operators import dedup, model, search
from mailloom.plans import messages
from mailloom.sources import mailbox
from mailloom.streaming import sessions


def documents(spark, folder, texts):
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_headers_of_long_messages(spark, tmp_path):
    folder = documents(spark, tmp_path, [*("a" * k + "é" * 40_000 for k in range(2)), "short", None])
    assert {r.subject for r in __spark_entry__.queries()["search_headers"](spark, folder).collect()} == {"[SPAM] a | b 0", "[SPAM] a | b 1"}
    (tmp_path / "box").write_bytes(b"From a\nX-Long: " + "ő".encode() * 50_000 + b"\nX-Last: here\xff\n\nbody\n")
    found = mailbox.index(mailbox.mailbox(spark, str(tmp_path / "box")), head=True).first()
    assert found.head == "From a\nX-Long: " + "ő" * 50_000 + "\nX-Last: here" + b"\xff".decode("utf-8", "mailloom-mixed") and found.hsize == 100_031


def test_counts_of_characters(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZéő \t  中　\U0001f600​\x00\x07Ж,1") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", " ", "　x", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    n = search.numbers(F.col("t"))
    plan = rows.select(*n.values(), T.display_width(F.col("t")))
    # Counting by lists of all matches made an object of each character.
    assert "regexp_count" not in plan._jdf.queryExecution().optimizedPlan().toString()
    for r in rows.select("k", n["w"].alias("w"), n["l"].alias("l"), n["L"].alias("b"), n["j"].alias("j"), T.display_width(F.col("t")).alias("d")).collect():
        t = texts[r.k] or ""
        assert (r.w, r.l, r.j) == (len(t.split()), len(re.findall(T.LATIN, t)), sum("一" <= c <= "鿿" for c in t))
        assert r.b == sum(c > "ſ" and not c.isspace() for c in t)
        assert r.d == (None if texts[r.k] is None else sum(map(tokens.char_width, t)))


def test_scrubbing_long_runs(spark):
    # Without a guard, each letter of a run began a search over the rest of it.
    texts = ["a" * 300_000, "x@y.com_b@c.hu1 ab.hu a@b", "http : //a b", "", None]
    began = time.time()
    found = [r.s for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.scrub(F.col("t")).alias("s")).collect()]
    assert found == ["a" * 300_000, "<EMAIL><EMAIL>1 <DOMAIN> a@b", "<URL> b", "", None] and time.time() - began < 60


def test_first_words(spark):
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 9, 10, 11, 12, 99, 100, 101, 300)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(F.col("t"), dedup.console_key(5, F.col("t")).alias("a"), dedup.console_key(6, F.col("t")).alias("b"))
    for r in found.collect():
        w = (r.t or "").split()
        assert (r.a, r.b) == (" ".join(w[:100]), " ".join(w[10:100]))
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_similar_texts_move_little(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 80))] for _ in range(40)]
    texts = [" ".join(rng.choice(base) if k < 20 else [w if rng.random() > 0.02 else "x" + w for w in rng.choice(base)]) for k in range(110)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    split = [tokens.split_lossless(t) for t in texts]
    first = [k for k, t in enumerate(texts) if texts.index(t) == k]
    want = {(a, b): r for a in first for b in first if a < b and (r := SequenceMatcher(None, split[a], split[b]).ratio()) >= 0.95}
    assert len(want) > 20 and {(r.a, r.b): r.ratio for r in dedup.similar_pairs(rows).collect()} == want
    # Only rare tokens that occur in several lines meet, as numbers.
    lines = rows.where(F.col("doc_id").isin(first)).select(F.col("doc_id").alias("idx"), F.col("text").alias("line"))
    rare = dedup._rare(lines, 0.95)
    assert dict(rare.dtypes) == {"idx": "bigint", "n": "int", "place": "int", "key": "bigint"} and rare.count() < 0.15 * sum(len(split[k]) for k in first)


def test_pieces_of_columns(spark):
    texts = pa.array(["x" * (100_000 + k) if k % 7 else None for k in range(64)])
    assert max(sum(len(t or "") for t in texts[a:b].to_pylist()) for a, b in arrow.spans(texts)) < 1.2 * arrow.PIECE
    assert [t for (part,) in arrow.lists(texts) for t in part] == texts.to_pylist()
    ids = [[1, 2], None, [], [3] * 300_000, [4]] * 3
    column = arrow.number_lists(ids)
    assert column.type == pa.list_(pa.int32()) and [x for (part,) in arrow.lists(column.slice(1, 13)) for x in part] == ids[1:14]
    held = []
    function = lambda a, b: held.append(sum(map(len, a))) or [f"{len(a)} {x[:1]}{y}" for x, y in zip(a, b)]
    rows = spark.createDataFrame([("y" * 200_000, k) for k in range(40)], "t string, k bigint").coalesce(1)
    found = rows.select("k", arrow.in_pieces(function, "string", pa.string(), F.col("t"), F.col("k")).alias("s")).collect()
    # A batch of 8 MB came in one piece before.
    assert all(r.s.endswith(f" y{r.k}") and int(r.s.split()[0]) <= 6 for r in found) and len(found) == 40


def test_mailbox_read_in_steps(spark, tmp_path, monkeypatch):
    data = b"".join(b"From a\nSubject: %d\n\n" % k + b"text\n" * (k * 37 % 3000) for k in range(300))
    (tmp_path / "box").write_bytes(data)
    asked = []
    real = mailbox.message_starts
    monkeypatch.setattr(mailbox, "STEP", 10_000)
    monkeypatch.setattr(mailbox, "PIECE", 20_000)

    class File:
        def read_at(self, n, at):
            asked.append(n)
            return data[at : at + n]

    whole, got = len(data), []
    for at in range(0, whole, mailbox.STEP):
        found, held, low = real(File(), at, min(whole, at + mailbox.STEP), whole)
        got += [held[a - low : b - low] for a, b in zip(found, found[1:]) if a < at + mailbox.STEP]
    assert b"".join(got) == data and len(got) == 300 and max(asked) < 1 << 17
    rows = mailbox.mailbox(spark, str(tmp_path / "box"))
    back = mailbox.read_messages(mailbox.index(rows).select("path", "fpos", "size", "subject")).collect()
    assert b"".join(r.raw for r in sorted(back, key=lambda r: r.fpos)) == data and len(back) == 300


def test_streamed_mails_in_many_files(spark, tmp_path):
    rows = [(k, f"text {k} " + "words of it " * (k % 40), "en", "web", 10) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "text words of it")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    real = sessions.stream_folder
    try:
        sessions.stream_folder = lambda df, name: seen.append(df.rdd.getNumPartitions()) or real(df, name)
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = __spark_entry__.queries()["stream_routes"](spark, str(tmp_path))
        want = dedup.routes(table, dedup.vocabulary(spark.read.parquet(f"{tmp_path}/benchmark.parquet")))
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()} and seen == [9]  # three tasks held all mails before
    finally:
        sessions.stream_folder = real
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_vectors_are_not_shuffled_against_each_other(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(-3, 4, 5).astype(float).tolist()) for k in range(900)] + [(900, None), (901, [0.0] * 5), (902, [float("nan")] * 5)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    near = model.nearest(table, table.where("vec_id % 20 = 0"), k=4, block=10)
    plan = near._jdf.queryExecution().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan  # each vector was repeated for each block of queries before
    v = np.array([x for _, x in rows[:900]] + [[0.0] * 5])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    ids = np.r_[np.arange(900), 901]
    got = {}
    for r in near.collect():
        got.setdefault(r.query, []).append((r["rank"], r.vec_id))
    for q in range(0, 900, 20):
        c = -np.round(v @ v[q], 9)
        want = [int(ids[j]) for j in np.lexsort((ids, c)) if ids[j] != q][:4]
        assert [i for _, i in sorted(got[q])] == want
    assert set(got) == set(range(0, 900, 20))


def test_blocks_as_difflib_finds_them(monkeypatch):
    rng = random.Random(3)
    for k in range(400):
        x = [rng.choice("aab c,d" + "efghij" * (k % 3)) for _ in range(rng.randrange(1 + 3 * k))]
        y = [c if rng.random() < 0.9 else rng.choice("abcxyz") for c in x if rng.random() < 0.95] if k % 4 else [rng.choice("ab c") for _ in range(k)]
        assert blocks.blocks(x, y) == [tuple(m) for m in SequenceMatcher(None, x, y).get_matching_blocks()]
        assert blocks.ratio(x, y) == SequenceMatcher(None, x, y).ratio()
    words = [f"w{rng.randrange(60)}" + rng.choice(["", "", ",", "."]) for _ in range(1500)]
    x = tokens.split_lossless(" ".join(words))
    y = [t + "x" if t == "w7" else t for t in x]
    assert blocks.blocks(x, y) == [tuple(m) for m in SequenceMatcher(None, x, y).get_matching_blocks()]
    monkeypatch.setattr(blocks, "MOST", 10)
    assert blocks.blocks(list("abcabcabcd"), list("bcabcabcabd")) == [tuple(m) for m in SequenceMatcher(None, "abcabcabcd", "bcabcabcabd").get_matching_blocks()]


def test_only_open_messages_go_on(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    for _ in range(30):  # chains of copies with changes, and words that repeat
        w = rng.choice(texts[15:]).split()
        w[rng.randrange(len(w)) :] = [f"v{rng.randrange(9)}" for _ in range(rng.randrange(12))]
        texts.append(" ".join(w))
    seen, want = set(), []
    for t in texts:
        w = t.split()
        s = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        want.append(sum(x in seen for x in s) <= 0.6 * len(s))
        seen |= set(s) if want[-1] else set()
    went, real = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: went.append((name, real(df, name))) or went[-1][1])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.idx: r.accepted for r in dedup.shingled(rows, width=3, most=0.6).collect()}
    assert [found[k] for k in range(len(texts))] == want and not all(want)
    states = [{r.idx for r in df.select("idx").collect()} for name, df in went if name == "shingle-state"]
    assert min(states[0]) >= 15 and not states[-1] and all(a > b for a, b in zip(states, states[1:]))
