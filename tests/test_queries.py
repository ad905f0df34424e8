"""Each query with SQL agrees with DuckDB; the others are compared with loops or checked for what must hold."""

import os
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest

from mailloom.functions.tokens import split_lossless
from mailloom.operators import dedup, search
from mailloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(names, table):
    return sorted(tuple(repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x) for x in (r[n] for n in names)) for r in table)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    got = QUERIES[name](spark, DIR)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, [dict(zip(columns, r)) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"dedup_similarity", "word2vec_neighbors", "cnn_trained", "cnn_report", "text_differences", "piece_round_trip", "corpus_filter"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


TEXTS = ["one two three four five six seven eight nine ten " * 3, "one two three four five six seven eight nine ten " * 3 + "x", "", None, "other words here", "other words here", "Other  words here ", "one two three four five six seven eight nine tin " * 3]


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")


def test_similar(spark):
    found = {r.idx: r.base for r in dedup.similar(frame(spark, TEXTS)).collect()}
    bases, want = {}, {}
    for k, t in enumerate(TEXTS):
        line = " ".join((t or "").split()).lower()
        if not line:
            want[k] = k
        elif line in bases:
            want[k] = bases[line]
        else:
            hit = next((b for a, b in bases.items() if SequenceMatcher(None, split_lossless(a), split_lossless(line)).ratio() >= 0.95), None)
            want[k] = k if hit is None else hit
            if hit is None:
                bases[line] = k
    assert found == want


def test_shingled(spark):
    seen, want = set(), {}
    for k, t in enumerate(TEXTS):
        w = (t or "").lower().split()
        s = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        want[k] = sum(x in seen for x in s) <= 0.5 * len(s)
        if want[k]:
            seen |= set(s)
    assert {r.idx: r.accepted for r in dedup.shingled(frame(spark, TEXTS), width=3, most=0.5).collect()} == want


def test_routes_of_empty(spark):
    none = frame(spark, [])
    assert dedup.routes(none, dedup.vocabulary(none)).count() == 0
    assert dedup.similar(none).count() == 0 and dedup.shingled(none).count() == 0


def test_predicates():
    for bad in ("w==3", "w=<3", "w>", "x:1", "q>3"):
        with pytest.raises(ValueError):
            search.predicate(bad, {}, {})


def test_mailbox(spark, tmp_path):
    from mailloom.sources import mailbox

    (tmp_path / "box").write_bytes(b"From a\nFrom: N <n@x.y>\nSubject: one\n\nbody\nContent-Disposition: attachment\n\nFrom b\nSubject: two\n more\n\nbody \xff\n")
    found = mailbox.index(mailbox.mailbox(spark, str(tmp_path / "box"))).orderBy("fpos").collect()
    assert [(r.subject, r.addr, r.name, r.has_attach) for r in found] == [("one", "n@x.y", "N", True), ("two more", "", "", False)]
    (tmp_path / "words").write_text("b 3\na 4\nb 9\n")
    assert {r.word: r.id for r in mailbox.vocabulary_by_line(spark, str(tmp_path / "words")).collect()} == {"b": 3, "a": 2}
    assert mailbox.vocabulary_by_column(spark, str(tmp_path / "words")).count() == 3
    (tmp_path / "map").write_text("0\ta\ta\n0\té\te\n")
    assert [r.c for r in mailbox.unmapped_targets(mailbox.character_map(spark, str(tmp_path / "map"))).collect()] == ["e"]
    (tmp_path / "vec").write_text("2 3\na 1 2 3\nb 4 5 6\n")
    assert {r.word: list(r.vec) for r in mailbox.word_vectors(spark, str(tmp_path / "vec")).collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    (tmp_path / "lab").write_text("sub|body|x\nshort|a\n")
    assert [tuple(r) for r in mailbox.labelled_lines(spark, str(tmp_path / "lab"), 0, "train").collect()] == [("sub", "body|x", 0, "train")]


def test_streamed_sessions():
    from mailloom.streaming import sessions

    frames = [("L", "Subject\0hi\0"), ("N", ""), ("B", "one "), ("B", "two"), ("E", ""), ("L", "X\0y"), ("A", ""), ("B", "rest")]
    assert sessions.fold(frames) == (["Subject: hi\n\none two"], "rest")
    assert sessions.reply("B") == [b"\0\0\0\1c"] and sessions.reply("E", "ham 1%")[1] == b"\0\0\0\1a" and sessions.reply("Q") == []


def test_choice_of_epochs(spark):
    from mailloom.operators import training

    losses = [0.5, 0.4, 0.39995, 0.39985, 0.6, 0.1]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(losses)], "run int, epoch int, loss double")
    want, best = [], None
    for x in losses:
        want.append(best is not None and x < best - 1e-4)
        best = x if best is None or want[-1] else best
    assert [r.save for r in training.saved(rows).orderBy("epoch").collect()] == want


def test_grid(spark):
    from mailloom.operators import training

    rows = spark.createDataFrame([(f"cheap pills {k}", 0) for k in range(20)] + [(f"meeting notes {k}", 1) for k in range(20)], "text string, label_id int")
    best, measures = training.grid(rows, [0.01, 0.1], [0.0])
    assert len(measures) == 2 and training.spam_scores(best, rows.limit(1)).first().score > 0.5


def test_nearest_of_all(spark):
    import numpy as np

    from mailloom.operators import model

    found = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = found.toPandas()
    v = np.array(rows.embedding.tolist(), float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c, ids = np.round(v @ v.T, 9), rows.vec_id.tolist()
    want = {ids[i]: sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-c[i, j], ids[j]))[:10] for i in range(len(ids))}
    for got in (QUERIES["nearest_vectors"](spark, DIR), model.nearest(found, found, block=120)):
        near = got.toPandas().sort_values("rank").groupby("query").vec_id.apply(list).to_dict()
        assert near == {q: [ids[j] for j in x] for q, x in want.items()}


def test_differences_of_the_table(spark):
    from mailloom.operators import lookup
    from pyspark.sql import functions as F

    got = {r.doc_id: r.runs for r in QUERIES["text_differences"](spark, DIR).collect()}
    rows = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    for r in rows[:60]:
        x, y = split_lossless(r.text), split_lossless(r.text.replace("the", "THE"))
        want = 0
        for op, i, j, k, m in SequenceMatcher(None, x, y).get_opcodes():
            want += 1 if op == "equal" else bool("".join(x[i:j])) + bool("".join(y[k:m]))
        assert got[r.doc_id] == want
    one = spark.createDataFrame([("a b c", "a x c")], "a string, b string").select(lookup.differences(F.col("a"), F.col("b")).alias("d")).first().d
    assert [(x.op, x.text) for x in one] == [("equal", "a "), ("delete", "b"), ("insert", "x"), ("equal", " c")]


def test_texts_of_the_pages(spark):
    from mailloom.functions import html, mail, payload, text
    from mailloom.plans import parsing

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["html_texts"](spark, DIR).collect()}
    assert got == {k: html.html_text(x.encode()).decode("utf-8", "replace") for k, x in pages.items()}
    got = {r.page_id: r.text for r in QUERIES["html_payload"](spark, DIR).collect()}
    assert got == {k: payload.payload_text(x.encode(), "text/html", "utf-8") for k, x in pages.items()}
    raw = {r.page_id: bytes(r.raw) for r in parsing._raw_mails(spark, DIR).collect()}
    found = {r.idx: (r.subject, r.text) for r in QUERIES["best_text"](spark, DIR).collect()}
    assert found == {k: mail.best_text(mail.parse(x)) for k, x in raw.items()}
    shown = {r.idx: r.preview for r in QUERIES["mail_previews"](spark, DIR).collect()}
    gone = dict.fromkeys(map(ord, text.INVISIBLE))
    assert shown == {k: " ".join(t.translate(gone).split()) for k, (_, t) in found.items()}


def test_tokens_of_the_table(spark):
    from mailloom.functions import tokens
    from mailloom.plans.parsing import CHARACTERS

    table = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in table}
    assert {r.doc_id: r.tokens for r in QUERIES["tokens_v1"](spark, DIR).collect()} == {k: " ".join(tokens.hide_digits(t)) for k, t in texts.items()}
    assert {r.doc_id: r.text for r in QUERIES["preprocess_v2"](spark, DIR).collect()} == {r.doc_id: tokens.normalize(tokens.join_pair(r.source, r.text), CHARACTERS) for r in table}


def test_neighbours_of_words(spark):
    import re

    found = QUERIES["word2vec_neighbors"](spark, DIR).toPandas()
    words = {w for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() for w in re.findall(r"[^\W_]+", r.text.lower())}
    assert set(found.word) == words and (found.groupby("word")["rank"].max() == 10).all() and found.cosine.between(-1.000001, 1.000001).all()


def test_cost():
    from mailloom.operators import model

    w = model.fresh(50, dims=8)
    import numpy as np

    ids = np.random.default_rng(0).integers(0, 50, (2, 20))
    x = w["ids"][ids]
    tops = [max(x[0, i : i + k].ravel() @ w[f"conv{k}"][:, 3] for i in range(21 - k)) for k in model.KERNELS]
    h = np.maximum(np.concatenate([[max(x[0, i : i + k].ravel() @ w[f"conv{k}"][:, f] for i in range(21 - k)) for f in range(model.FILTERS)] for k in model.KERNELS]), 0)
    assert np.isclose(h[3], max(tops[0], 0), atol=1e-5)
    out = np.maximum(h @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]
    assert np.allclose(model.logits(ids, w)[0], out, atol=1e-4)
