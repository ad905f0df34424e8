"""Mailboxes, sinks, sessions and models against loops over small cases."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailloom.functions import charsets, payload, rtf, tnef, tokens
from mailloom.functions import text as T
from mailloom.operators import cnn_training, dedup, embedding, lookup, model, search, subwords, training
from mailloom.plans import messages
from mailloom.session import in_order
from mailloom.sources import mailbox, sinks
from mailloom.streaming import sessions


def split_by_lines(data, blank):
    """Messages by a walk over the lines."""
    out, head, at = [], True, 0
    for line in data.splitlines(keepends=True):
        if at and not head and line.startswith(b"From "):
            out.append(b"")
            head = True
        elif at and head and not (line.strip() if blank else line.rstrip(b"\r\n")):
            head = False
        out = out or [b""]
        out[-1] += line
        at += len(line)
    return out


@pytest.mark.parametrize("blank", [False, True])
def test_mailbox_in_parts(spark, tmp_path, blank):
    rng = np.random.default_rng(3)
    lines = [b"From a b\n", b"From: x\n", b"\n", b"\r\n", b"Subject: s\n", b"text\n", b">From q\n", b" \t\n", b"Fromage\n", b"\r\r\n", b"x" * 90 + b"\n"]
    for k in range(12):
        data = b"".join(lines[i] for i in rng.integers(0, len(lines), 150)) + (b"no end" if k % 2 else b"")
        if k % 3:
            data = b"From z\n" + data
        folder = tmp_path / f"f{k}"
        folder.mkdir()
        (folder / "box").write_bytes(data)
        want = split_by_lines(data.replace(b"\r\r\n", b"\r\r\n"), blank)
        for part in (7, 100, 1 << 20):
            got = []
            with open(folder / "box", "rb") as f:

                class File:
                    def read_at(self, n, at):
                        f.seek(at)
                        return f.read(n)

                for start in range(0, len(data), part):
                    found, held, low = mailbox.message_starts(File(), start, min(len(data), start + part), len(data), blank)
                    got += [held[a - low : b - low] for a, b in zip(found, found[1:]) if a < start + part]
            assert got == want
    rows = mailbox.mailbox(spark, str(tmp_path / "f1"), blank, split=500).orderBy("fpos").collect()
    assert b"".join(r.raw for r in rows) == (tmp_path / "f1" / "box").read_bytes() and [r.fpos for r in rows] == list(np.cumsum([0] + [r.size for r in rows])[:-1])


def test_message_in_a_header(spark, tmp_path):
    (tmp_path / "box").write_bytes(b"From a\nSubject: x\nFrom here\n on\nX-Grey-ng: pass\n\nbody\nFrom b\nSubject: two\n more\nSubject: last\n\nbody\xff")
    box = mailbox.mailbox(spark, str(tmp_path / "box"))
    found = mailbox.index(box).orderBy("fpos").collect()
    assert [(r.subject, r.headers.get("x-grey-ng"), r.fpos) for r in found] == [("x", "pass", 0), ("last", None, 54)]
    assert sum(r.size for r in found) == (tmp_path / "box").stat().st_size
    assert [r.raw for r in mailbox.read_messages(mailbox.index(box).select("fpos", "size", "path")).orderBy("fpos").collect()] == [r.raw for r in box.orderBy("fpos").collect()]


def test_mailbox_written_and_read(spark, tmp_path):
    rows = [(k, (b"From q\nSubject: %d\n\n" % k) + bytes(range(256)).replace(b"\nFrom ", b"") + b"\n") for k in range(50)] + [(99, None)]
    table = spark.createDataFrame(rows, "k int, raw binary").repartition(3)
    files = sinks.write_mailbox(table, str(tmp_path / "out"), ["k"])
    assert files.agg(F.sum("messages")).first()[0] == 50
    names = sorted(r.file for r in files.collect() if r.messages)
    assert b"".join(open(n, "rb").read() for n in names) == b"".join(x for _, x in rows if x)
    routed = sinks.write_mailbox(table, str(tmp_path / "by"), ["k"], route=F.when(F.col("k") % 2 == 0, "a").otherwise("b")).groupBy("route").agg(F.sum("messages").alias("n"))
    assert {r.route: r.n for r in routed.collect()} == {"a": 25, "b": 25}


def test_numbers_in_order(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(1000).tolist()
    rows = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    assert {r.v: r.n for r in in_order(rows, ["v"], "numbers", "n").collect()} == {v: v + 1 for v in values}
    assert in_order(rows.limit(0), ["v"], "numbers").count() == 0


def test_large_vocabularies_are_joined(spark):
    texts = [f"word{k % 7} other{k % 5} text of some length and more words to make it long {k % 3}" for k in range(30)] + ["short", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    words = spark.createDataFrame([(w, k + 1) for k, w in enumerate(["word1", "word2", "text", "of", "some", "and", "more", "other3"])], "word string, id int")
    both = [{(r.idx, r.seen, r.route) for r in dedup.routes(rows, words, most=most).collect()} for most in (0, 100)]
    assert both[0] == both[1] and len(both[0]) == 33
    known = [{r.doc_id: r.known for r in dedup.known_words(rows, words, most=most).collect()} for most in (0, 100)]
    assert known[0] == known[1]


def test_deleted_rows_are_no_duplicates(spark):
    rows = spark.createDataFrame([(0, "a", True), (1, "a", False), (2, "a", None), (3, "", False), (4, None, True)], "doc_id int, text string, gone boolean")
    found = {r.idx: (r.base, r.group_size, r.pointer) for r in dedup.by_key(rows, F.col("text"), skip=F.col("gone")).collect()}
    assert found == {0: (None, None, None), 1: (1, 2, -2), 2: (1, 2, 1), 3: (3, 1, -1), 4: (None, None, None)}


def test_character_sets():
    names = {"x-cp1251": "cp1251", "windows-874": "iso8859-11", "iso88592": "iso8859-2", "koi8": "koi8-r", "X-EUC-JP": "euc_jp", "gb_2312-80": "gbk", "ks_c_5601-1989": "euc_kr", "x-mac-ce": "mac-latin2", "latin5": "cp1254", "iso_8859-1:1987": "cp1252", "l9": "iso8859-15", "csISO88596I": "iso8859-6", "_iso-2022-jp$esc": "iso2022_jp", "utf-16": "utf-16-le", "cp-850": "cp850", "unicode-1-1-utf-8": "utf-8", "no-such": None, "": None, None: None}
    assert {k: charsets.codec(k) for k in names} == names
    assert payload.payload_text(b"x\x8dy\0\x90.", "text/plain", "utf-8") == "xŤy ."


def test_rich_text_groups():
    assert rtf.rich_text(r"{\rtf1{\pict 00ff}{\mmathPr x}{\*\any y}a{\b b}{\uc2\u233??c}}") == "abéc"
    assert rtf.rich_text(r'{\field{\*\fldinst{HYPERLINK "http://a.b/' + "c" * 9000 + r'"}}{\fldrslt{here}}} on') == 'here("http://a.b/' + "c" * 9000 + '") on'
    assert rtf.rich_text("} a") == "" and rtf.rich_text("") == ""


def test_tnef():
    html = b"<p>hello</p>"
    prop = struct.pack("<IHHI", 2, 0x03, 0x0E, 7) + struct.pack("<HHII", 0x102, 0x1013, 1, len(html)) + html
    data = struct.pack("<IH", 0x223E9F78, 1) + struct.pack("<BII", 1, 0x00069003, len(prop)) + prop + b"\0\0"
    assert tnef.html_body(data) == html and payload.payload_text(data, "application/ms-tnef").strip() == "hello"
    assert tnef.html_body(data[:30]) == b"" and tnef.html_body(b"junk!!!") == b"" and tnef.html_body(b"") == b""


def test_corpus_text():
    assert tokens.corpus_text("Ѕраm x", {c: c for c in "Spamx "}) == "Spam x" and tokens.corpus_text("aéb", {"a": "a", "b": "b"}) == "a b"
    assert tokens.join_pair("s", None) == "s|\n" and tokens.join_pair(None, "b") == "|\nb"


def test_lookups(spark):
    rows = spark.createDataFrame([("1.2.3.4",), ("999.1.1.1",), ("1.2.3",), (None,), ("256.0.0.1",)], "ip string").select(lookup.ip_number(F.col("ip")).alias("n"))
    assert [r.n for r in rows.collect()] == [16909060, None, None, None, None]
    lines = [spark.createDataFrame([("x" * 300,), ("y" * 20000,), ("short",)], "value string")] * 2
    got = lookup.mixed_lines(lines, 1.0).collect()
    assert sorted(len(r.value) for r in got) == [300, 300, 10000, 10000]


def test_quantities_and_flags(spark):
    row = spark.createDataFrame([(4,)], "f int").select(search.toggled(F.col("f"), 4).alias("a"), search.marked_deleted(F.col("f"), F.lit(True)).alias("b"))
    assert tuple(row.first()) == (0, 36)
    ids = spark.createDataFrame([(list(range(1, 2001)),)], "ids array<int>")
    kept = ids.select(model.masked(F.col("ids"), 0.1, 1).alias("a"), model.masked(F.col("ids"), 0.1, 2).alias("b")).first()
    assert 120 < sum(x == 0 for x in kept.a) < 280 and kept.a != kept.b


def test_states_and_weights(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"m{k}", 0, -1) for k in range(5)], "idx int, subject string, flags int, pointer int")
    assert sinks.save_state(rows, str(tmp_path / "a"), ["subject"]) == ["dedup"]
    assert sinks.save_state(rows.withColumn("flags", F.lit(1)), str(tmp_path / "b"), ["subject"], least=2) == ["meta", "flags", "dedup"]
    assert sinks.load_state(spark, rows.select("idx"), str(tmp_path / "b"), ["meta", "flags"]).where("flags = 1 and subject like 'm%'").count() == 5
    w = model.fresh(20, 4)
    sinks.save_weights(spark, w, str(tmp_path / "w" / "one"))
    back = sinks.load_weights(spark, str(tmp_path / "w" / "one"))
    assert set(back) == set(w) and all(np.allclose(back[k], w[k]) for k in w)
    assert [p.rpartition("/")[2] for p, _ in sinks.models(str(tmp_path / "w"))] == ["one"]


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in model.fresh(30, 6).items()}
    ids, labels = rng.integers(0, 30, (5, 12)), np.array([0, 1, 1, 0, 1])
    _, _, g = cnn_training.gradients(ids, labels, w)
    for name in g:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        losses = []
        for d in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += d
            losses.append(cnn_training.gradients(ids, labels, moved)[0] / 5)
        assert np.isclose((losses[0] - losses[1]) / 2e-5, g[name][at], rtol=1e-3, atol=1e-6), name


def test_training(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.integers(1, 20, 30).tolist() if y else rng.integers(15, 40, 30).tolist(), y) for y in rng.integers(0, 2, 400).tolist()]
    table = spark.createDataFrame([*rows, (None, 1), ([1], None)], "ids array<int>, label_id int").repartition(2)
    best, log = cnn_training.train(table, model.fresh(40, 8), epochs=4, batch=32, rate=3e-3, held=table, length=30)
    assert len(log) == 4 and log[-1]["loss"] < log[0]["loss"] and log[-1]["held_accuracy"] > 0.9
    assert cnn_training.test(table, best, 30)["held_loss"] == min(x["held_loss"] for x in log)
    _, lines = cnn_training.grid(table, table, model.fresh(40, 8), [3e-3, 1e-5], [0.0, 0.1], epochs=2, batch=32, length=30)
    assert len(lines) == 4 and min(lines, key=lambda x: x["held_loss"])["start"] == 3e-3
    same, none = cnn_training.train(table.limit(0), best, epochs=1, length=30)
    assert same is best and none == []


def test_pieces(spark):
    texts = ["plain words", "", "żółć 字", None, "x " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    one = subwords.processor(messages.PIECES)
    found = rows.select("k", subwords.piece_ids(F.col("text"), messages.PIECES).alias("ids"), subwords.pieces(F.col("text"), messages.PIECES).alias("p"))
    for r in found.collect():
        assert (r.ids is None and r.p is None) if texts[r.k] is None else (list(r.ids) == one.encode(texts[r.k]) and list(r.p) == one.encode(texts[r.k], out_type=str))
    assert {r.k: r.t for r in found.select("k", subwords.piece_text(F.col("ids"), messages.PIECES).alias("t")).collect()}[2] == "żółć 字"
    assert subwords.id_lines(rows.where("k = 0"), F.col("text"), messages.PIECES).first().value == " ".join(map(str, one.encode("plain words")))


def test_word_vectors(spark):
    lines = spark.createDataFrame([(["a", "b", "c"] * 20,), (["a", "b", "d"] * 20,)], "words array<string>")
    vectors = embedding.word_vectors(embedding.fit(lines, size=8, passes=2))
    assert {r.word for r in vectors.collect()} == set("abcd")
    words = spark.createDataFrame([("a", 1), ("z", 2)], "word string, id int")
    assert {(r.word, r.missing, len(r.vec)) for r in embedding.merged(words, vectors, 8).collect()} == {("a", False, 8), ("z", True, 8)}
    assert {r.word for r in embedding.only_vectors(words, vectors).collect()} == set("bcd")


def test_vectors_of_pieces(spark, tmp_path):
    texts = spark.createDataFrame([("some words here and some words there",), (None,)], "text string")
    found = embedding.job(texts, F.col("text"), messages.PIECES, str(tmp_path / "v"), size=4, passes=1)
    ids = set(subwords.processor(messages.PIECES).encode("some words here and some words there"))
    assert found.count() == 32_000 and {r.id for r in found.where("not missing").collect()} == ids
    back = mailbox.word_matrix(spark, str(tmp_path / "v"))
    assert list(back.where("id = 0").first().vec) == [0.0] * 4
    (tmp_path / "ids").write_text("1 2  3\n\n4\n")
    assert [r.words for r in mailbox.id_corpus(spark, str(tmp_path / "ids")).collect()] == [["1", "2", "3"], [], ["4"]]
    (tmp_path / "alike").write_text("é\te\nж\tzh\n")
    table = mailbox.look_alikes(spark, str(tmp_path / "alike"))
    assert tokens.without_accents("éжőa", table) == "ezha" and tokens.without_accents("éжőa㈀") == "eoa"


def test_scorer_and_callback(spark):
    w, seen = model.fresh(40, 4), []
    score = model.scorer(w, lambda t: F.transform(F.split(t, " "), lambda x: x.cast("int")), 8)
    rows = spark.createDataFrame([(7, "1 2 3"), (8, "4 5")], "k bigint, text string")
    assert {r.idx for r in score(rows, "k", "text").collect()} == {7, 8}
    cnn_training.train(spark.createDataFrame([([1, 2], 1), ([3], 0)], "ids array<int>, label_id int"), w, epochs=2, batch=2, length=8, after=lambda line, now: seen.append(line["epoch"]))
    assert seen == [0, 1]


def test_frames(spark):
    frame = lambda c, p=b"": struct.pack(">I", len(p) + 1) + c + p
    raw = frame(b"L", b"A\0b\0") + frame(b"B", b"\xff\n") + frame(b"E") + frame(b"Q") + frame(b"B", b"late")
    rows = spark.createDataFrame([(1, raw), (2, raw[:12]), (3, b""), (4, None), (5, b"\0\0\0\0x")], "conn_id bigint, raw binary")
    found = sessions.decoded(rows)
    assert [(r.conn_id, r.seq, r.cmd, bytes(r.payload)) for r in found.orderBy("conn_id", "seq").collect()] == [(1, 0, "L", b"A\0b\0"), (1, 1, "B", b"\xff\n"), (1, 2, "E", b""), (1, 3, "Q", b""), (2, 0, "L", b"A\0b\0")]
    assert tuple(sessions.accounted(found).where("conn_id = 1").first()) == (1, 4, "LBEQ", 1, 0, True)
    verdicts = spark.createDataFrame([(1, 2, "ham 1%")], "conn_id bigint, seq bigint, verdict string")
    answers = {(r.conn_id, r.seq): bytes(r.answer) for r in sessions.replies(found, verdicts).collect()}
    assert answers[1, 1] == frame(b"c") and answers[1, 3] == b"" and answers[1, 2] == frame(b"h", b"X-Spam-Verdict\0ham 1%\0") + frame(b"a")


def test_routes_over_batches(spark, tmp_path):
    texts = ["one two three four five six seven eight nine ten eleven"] * 2 + ["short"] * 2 + ["a b c d e f g h i j k"]
    words = spark.createDataFrame([(w, k) for k, w in enumerate("one two three four a b c d g".split())], "word string, id int")
    rows = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id int, text string")
    folder = tmp_path / "in"
    for k in range(3):
        rows.where(F.floor(F.col("doc_id") / 4) == k).coalesce(1).write.parquet(str(folder / f"b{k}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = {r.idx: r.route for r in sessions.routed(stream, lambda b: dedup.route_keys(b, words), str(tmp_path / "state")).collect()}
    assert len(got) == 10 and sum(x == "out" for x in got.values()) == 2 and sum(x == "short" for x in got.values()) == 1


def test_keys_are_forgotten_in_time(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 10), ("a", 20), ("c", 30)], "key string, s int").withColumn("t", F.timestamp_seconds("s"))
    stream = sessions.stream_folder(rows.coalesce(1), "timed")
    found = sessions.drained(sessions.distinct_keys(stream, "key", "t", "1 hour"), "timed-out")
    assert sorted(r.key for r in found.collect()) == ["a", "b", "c"]
    # The state has a bound, which it hasn't without times.
    assert "EventTimeWatermark" in sessions.distinct_keys(stream, "key", "t")._jdf.queryExecution().analyzed().toString()


def test_saved_is_a_column(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.4)], "run int, epoch int, loss double")
    assert [r.save for r in training.saved(rows).orderBy("epoch").collect()] == [False, True]


def test_lines(spark, tmp_path):
    (tmp_path / "a").write_text("sub|bo|dy\nx\n")
    assert [tuple(r) for r in mailbox.smoke_lines(spark, str(tmp_path / "a")).collect()] == [("sub", "bo|dy"), ("x", None)]
    assert [tuple(r) for r in mailbox.plain_lines(spark, str(tmp_path / "a"), 1, "val").collect()] == [("sub|bo|dy", 1, "val"), ("x", 1, "val")]
    assert [r.number for r in mailbox.text_lines(spark, str(tmp_path / "a")).orderBy("number").collect()] == [1, 2]


def test_width(spark):
    text = "a字​\n\0­ｱx"
    want = sum(tokens.char_width(c) for c in text)
    assert spark.createDataFrame([(text,)], "t string").select(T.display_width(F.col("t"))).first()[0] == want
