"""Queries of mailboxes, sinks, lists of messages, sessions and models, and their SQL.

Messages are made from documents: header lines, one of which begins like a message does, an empty line, and the whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions import text as T
from mailloom.functions import tokens
from mailloom.operators import cnn_training, dedup, embedding, lookup, model, search, subwords
from mailloom.plans.parsing import each
from mailloom.session import shared_path, written
from mailloom.sources import mailbox, sinks
from mailloom.streaming import sessions

#: A public SentencePiece model; executors must be able to read it.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

LINE = f"trim(regexp_replace(regexp_replace(coalesce(text, ''), '{T.INVISIBLE_CLASS}', '', 'g'), '{T.WS}', ' ', 'g'), ' ')"
SCORE = "((doc_id * 37) % 1001 / 10.0)"
_HEAD = ["From ", "source", "\nFrom: \"", "lang", "\" <", "source", "@x.org>\nFrom here on\nSubject: [SPAM] a | b ", "doc_id", "\nX-Grey-ng: pass, from ip=0.1.", "lang", ")\n\n"]
_COLUMNS = ("source", "lang", "doc_id")
HEAD_SQL = " || ".join(f"CAST({x} AS VARCHAR)" if x in _COLUMNS else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _HEAD)
BODY_SQL = "'text: ' || replace(coalesce(text, ''), chr(10) || 'From ', chr(10) || '>From ') || chr(10)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _raw() -> Column:
    head = [F.col(x).cast("string") if x in _COLUMNS else F.lit(x) for x in _HEAD]
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("\nFrom "), F.lit("\n>From "))
    return F.concat(*head, F.lit("text: "), body, F.lit("\n")).cast("binary")


def _mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "mailbox")
    sinks.write_mailbox(_docs(spark, sf_dir).select("doc_id", _raw().alias("raw")), folder, ["doc_id"])
    return mailbox.mailbox(spark, folder)


def mailbox_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mailbox.index(_mailbox(spark, sf_dir))
    return found.select("size", "hsize", "from_line", "addr", "name", "subject", F.col("headers")["x-grey-ng"].alias("grey"))


MAILBOX_INDEX_SQL = f"SELECT strlen(h) + strlen({BODY_SQL}) AS size, strlen(h) AS hsize, 'From ' || source AS from_line, source || '@x.org' AS addr, lang AS name, '[SPAM] a | b ' || doc_id AS subject, 'pass, from ip=0.1.' || lang || ')' AS grey FROM (SELECT *, {HEAD_SQL} AS h FROM documents)"


def mailbox_point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mailbox.index(_mailbox(spark, sf_dir)).select("path", "fpos", "size", "subject")
    return mailbox.read_messages(rows).select("subject", F.sha2("raw", 256).alias("sha256"))


POINT_SQL = f"SELECT '[SPAM] a | b ' || doc_id AS subject, sha256({HEAD_SQL} || {BODY_SQL}) AS sha256 FROM documents"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dedup.vocabulary(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return dedup.routes(_docs(spark, sf_dir), words)


def mailbox_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), _raw().alias("raw")).join(_routed(spark, sf_dir), "idx")
    files = sinks.write_mailbox(rows, shared_path(spark, "routes"), ["idx"], route=F.col("route"))
    return files.groupBy("route").agg(F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"))


def routes_sql(routes: str) -> str:
    return f"SELECT route, count(*) AS messages, CAST(sum(strlen({HEAD_SQL} || {BODY_SQL})) AS BIGINT) AS bytes FROM documents JOIN ({routes}) ON idx = doc_id GROUP BY route"


def route_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), "text").join(_routed(spark, sf_dir), "idx")
    folder = shared_path(spark, "route-texts")
    sinks.write_lines(sinks.route_lines(rows, F.col("text")), folder, by="route")
    return spark.read.text(folder).groupBy("route").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


def route_texts_sql(routes: str) -> str:
    return f"SELECT route, count(*) AS lines, CAST(sum(length({LINE})) AS BIGINT) AS chars FROM documents JOIN ({routes}) ON idx = doc_id WHERE route <> 'dup' GROUP BY route"


def tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sinks.tag_lines(_docs(spark, sf_dir), F.lit("box"), F.col("doc_id"), F.concat(F.lit("[SPAM] "), F.col("source"), F.lit("|"), F.col("lang")), F.col("text"))
    folder = shared_path(spark, "tags")
    sinks.write_lines(lines, folder)
    return spark.read.text(folder).select(F.md5("value").alias("line"))


TAG_SQL = f"SELECT md5('box:' || doc_id || ':' || coalesce(source || '/' || lang, '') || '|' || {LINE}) AS line FROM documents"


def preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.preview_lines(_docs(spark, sf_dir), F.col("text"), 500).select(F.md5("value").alias("line"))


PREVIEW_SQL = f"SELECT md5({LINE}) AS line FROM documents WHERE (SELECT count(*) FROM documents) >= 500"


def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("doc_id"), F.split(F.concat_ws(" ", "source", "lang"), " ").alias("tokens"))
    lines = sinks.score_lines(rows, (F.col("doc_id") * 37) % 1001 / 10.0, F.col("tokens"))
    folder = shared_path(spark, "scores")
    sinks.write_lines(lines, folder)
    return spark.read.text(folder).groupBy("value").agg(F.count("*").alias("n"))


SCORE_LINES_SQL = f"SELECT printf('%3d%%: ', CAST(floor({SCORE}) AS BIGINT)) || concat_ws(' ', source, lang) AS value, count(*) AS n FROM documents GROUP BY 1"


def subject_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat(F.lit("[K:Spam] "), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" | x"))
    return _docs(spark, sf_dir).select("doc_id", sinks.clean_subject(subject).alias("subject"))


def _untagged(column: str) -> str:
    column = f"regexp_replace({column}, '{T.SPAM_SCORE}', '', 'g')"
    for tag in T.SPAM_TAGS:
        column = f"replace({column}, '{tag}', '')"
    return column


SUBJECT_SQL = f"SELECT doc_id, trim(regexp_replace(regexp_replace(replace({_untagged(chr(39) + '[K:Spam] ' + chr(39) + ' || split_part(text, chr(10), 1) || ' + chr(39) + ' | x' + chr(39))}, '|', '/'), '{T.INVISIBLE_CLASS}', '', 'g'), '{T.WS}', ' ', 'g'), ' ') AS subject FROM documents"


def list_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("doc_id") * 37) % 1001 / 10.0
    both = [search.sender(k, F.concat("source", F.lit("@x")), F.col("lang")).alias(f"sender{k}") for k in range(3)]
    flags = F.when(F.col("doc_id") % 3 == 0, search.SELECTED).otherwise(0)
    turned = search.toggled(search.toggled(flags, search.SELECTED), search.EXTRA).cast("bigint").alias("turned")
    gone = search.marked_deleted(flags, F.col("doc_id") % 2 == 0).cast("bigint").alias("gone")
    return _docs(spark, sf_dir).select("doc_id", *both, T.score_text(x).alias("score"), T.colour(x).alias("colour"), turned, gone)


LIST_SQL = f"""SELECT doc_id, source || '@x' AS sender0, lang AS sender1, lang || '  <' || source || '@x>' AS sender2, CASE WHEN x = 0 THEN '' ELSE printf('%5.2f%%', x) END AS score,
CASE WHEN x <= 2 THEN 92 WHEN x <= 20 THEN 32 WHEN x >= 98 THEN 91 WHEN x >= 80 THEN 93 ELSE 0 END AS colour,
CAST(xor(xor(f, 1), 64) AS BIGINT) AS turned, CAST(CASE WHEN doc_id % 2 = 0 THEN f | 32 ELSE f END AS BIGINT) AS gone
FROM (SELECT *, CAST({SCORE} AS DOUBLE) AS x, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS f FROM documents)"""


def search_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).where(F.col("lang") == "en")
    return search.preceding(rows, 100).select("doc_id")


def goto_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.at_line(_docs(spark, sf_dir), 42).select("doc_id", "n_chars")


def any_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.when(F.col("doc_id") % 11 == 0, search.DELETED).otherwise(0)
    return _docs(spark, sf_dir).groupBy("lang").agg(search.any_set(flags).alias("some"))


_LOW = f"trim(regexp_replace(coalesce(text, ''), '{T.WS}', ' ', 'g'), ' ')"


def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicates of vocabulary words (v) and of groups of duplicates (h)."""
    rows = _docs(spark, sf_dir)
    words = dedup.listed(dedup.vocabulary(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    groups = dedup.by_key(rows, dedup.console_key(1, F.col("text"))).select(F.col("idx").alias("doc_id"), "pointer", "group_size")
    found = rows.join(groups, "doc_id")
    sizes = {"v": search.vocabulary_count(F.col("text"), words), "h": search.group_size(F.col("pointer"), F.col("group_size"))}
    return found.select("doc_id", search.predicate("v>5", {}, sizes).alias("v"), search.predicate("h>1", {}, sizes).alias("h"))


SEARCH_GROUPS_SQL = f"""WITH voc AS (SELECT DISTINCT unnest(list_filter(string_split(regexp_replace(lower({_LOW}), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda t: t <> '')) AS word FROM benchmark),
each AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}')) AS word FROM documents),
v AS (SELECT doc_id, count(*) AS n FROM each SEMI JOIN voc USING (word) GROUP BY doc_id),
g AS (SELECT doc_id, CASE WHEN k = '' THEN -1 WHEN doc_id = min(doc_id) OVER w THEN -count(*) OVER w ELSE count(*) OVER w END AS h FROM (SELECT doc_id, {_LOW} AS k FROM documents) WINDOW w AS (PARTITION BY k))
SELECT g.doc_id, coalesce(v.n, 0) > 5 AS v, h > 1 AS h FROM g LEFT JOIN v USING (doc_id)"""


def search_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields g (greylisting) and h (the raw header) of an indexed mailbox, and the size of bodies (s)."""
    rows = mailbox.index(_mailbox(spark, sf_dir), head=True)
    grey = F.col("headers")["x-grey-ng"]
    fields = {"g": lookup.grey_label(grey, F.lit(None).cast("string"), F.lit(""), F.lit("")), "h": F.col("head")}
    found = search.predicate("g:1.e", fields, {}) | search.predicate("h:| b 77", fields, {})
    return rows.where(found & search.predicate("s>200", {}, {"s": F.col("size") - F.col("hsize")})).select("subject")


SEARCH_HEADERS_SQL = f"SELECT '[SPAM] a | b ' || doc_id AS subject FROM documents WHERE (contains('0.1.' || lang, '1.e') OR contains('| b ' || doc_id, '| b 77')) AND strlen({BODY_SQL}) > 200"


def grey_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") * 5000
    country = F.when(F.col("c_custkey") % 2 == 0, "United States of America").otherwise(F.col("c_name"))
    ranges = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("low"), (key + 3999).alias("high"), F.lit("NA").alias("continent"), country.alias("country"), F.col("c_mktsegment").alias("org"))
    n = (F.col("doc_id") * 7919) % 900000
    ip = F.concat_ws(".", *((F.floor(n / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)))
    header = F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("pass (ip="), ip, F.lit(")")))
    rows = _docs(spark, sf_dir).select("doc_id", header.alias("header")).withColumn("n", lookup.ip_number(lookup.grey_address(F.col("header"))))
    found = lookup.in_ranges(rows, "n", ranges)
    label = lookup.grey_label(F.col("header"), F.col("continent"), F.col("country"), F.col("org"))
    return found.select("doc_id", label.alias("label"), label.contains("U.S.A.").alias("hit"))


GREY_SQL = """WITH r AS (SELECT c_custkey * 5000 AS low, c_custkey * 5000 + 3999 AS high, CASE WHEN c_custkey % 2 = 0 THEN 'U.S.A.' ELSE c_name END AS country, c_mktsegment AS org FROM customer),
d AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN (doc_id * 7919) % 900000 END AS n FROM documents),
l AS (SELECT doc_id, CASE WHEN n IS NULL THEN '???' WHEN country IS NULL THEN concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256) ELSE 'NA/' || country || '/' || org END AS label FROM d LEFT JOIN r ON n BETWEEN low AND high)
SELECT *, contains(label, 'U.S.A.') AS hit FROM l"""


def saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "state")
    flags = F.when(F.col("doc_id") % 11 == 0, search.DELETED).otherwise(0)
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), "source", flags.alias("flags"), (-F.col("doc_id")).alias("pointer"))
    saved = sinks.save_state(rows, folder, ["source"], least=100)
    return sinks.load_state(spark, rows.select("idx"), folder, saved)


STATE_SQL = "SELECT doc_id AS idx, source, CASE WHEN doc_id % 11 = 0 THEN 32 ELSE 0 END AS flags, -doc_id AS pointer FROM documents"


def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    folder = shared_path(spark, "vectors")
    sinks.write_lines(sinks.vector_lines(vectors), folder)
    back = mailbox.word_vectors(spark, folder)
    return back.select("word", F.posexplode("vec").alias("place", "x")).select("word", F.col("place").cast("bigint").alias("place"), F.col("x").cast("double").alias("x"))


VECTOR_SQL = "SELECT 'w' || vec_id AS word, generate_subscripts(embedding, 1) - 1 AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return embedding.corpus_counts(_docs(spark, sf_dir), text, F.length(text) >= 100, F.coalesce(text.rlike(r"[\x{400}-\x{10FFFF}]"), F.lit(False)))


COUNTS_SQL = r"SELECT count(*) AS lines, count(*) FILTER (regexp_matches(text, '[\x{400}-\x{10FFFF}]')) AS cyrillic, count(*) FILTER (length(text) >= 100) AS kept FROM documents"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What connections send: a header, the end of headers, a body for each turn, its end, and a quit."""
    frame = lambda c, p: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p) + 1), 8, "0")), F.lit(c).cast("binary"), p)
    none = F.lit("").cast("binary")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: frame("B", x["t"].cast("binary")))
    head = frame("L", F.concat(F.lit("Subject"), F.lit("\0"), F.col("conv_id").cast("string"), F.lit("\0")).cast("binary"))
    sent = turns.groupBy("conv_id").agg(body.alias("b"))
    whole = F.aggregate("b", F.concat(head, frame("N", none)), lambda acc, x: F.concat(acc, x))
    return sent.select(F.col("conv_id").alias("conn_id"), F.concat(whole, frame("E", none), frame("Q", none), frame("B", none)).alias("raw"))


def frames_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.decoded(_frames(spark, sf_dir)).where("cmd <> 'L'")
    return found.select("conn_id", "seq", "cmd", F.col("payload").cast("string").alias("payload"))


FRAMES_SQL = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS k, coalesce(text, '') AS p FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS conn_id, k + 1 AS seq, 'B' AS cmd, p AS payload FROM t UNION ALL SELECT conv_id, 1, 'N', '' FROM n UNION ALL SELECT conv_id, n + 2, 'E', '' FROM n UNION ALL SELECT conv_id, n + 3, 'Q', '' FROM n"""


def sessions_accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.accounted(sessions.decoded(_frames(spark, sf_dir)))


ACCOUNT_SQL = "SELECT conv_id AS conn_id, count(*) + 4 AS frames, 'LN' || repeat('B', CAST(count(*) AS BIGINT)) || 'EQ' AS history, 1 AS messages, 0 AS aborted, true AS quit FROM conversations GROUP BY conv_id"


def stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dedup.vocabulary(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    mails = _docs(spark, sf_dir).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    stream = sessions.stream_folder(mails, "stream-mails")
    return sessions.routed(stream, lambda batch: dedup.route_keys(batch, words), shared_path(spark, "stream-routes"))


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text that they decode to."""
    rows = _docs(spark, sf_dir).select("doc_id", subwords.piece_ids(F.col("text"), PIECES).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n"), subwords.piece_text(F.col("ids"), PIECES).alias("text"))


def cnn_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a training of the convolutional classifier on all labelled documents, of which every tenth is held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label_id"))
    rows = written(_docs(spark, sf_dir).join(labels, "doc_id").select("doc_id", subwords.piece_ids(F.col("text"), PIECES).alias("ids"), "label_id"), "cnn-rows")
    weights = model.fresh(32_000, 32)
    _, log = cnn_training.train(rows.where("doc_id % 10 <> 0"), weights, epochs=3, batch=64, held=rows.where("doc_id % 10 = 0"))
    return spark.createDataFrame(log, "epoch bigint, rate double, loss double, accuracy double, held_loss double, held_accuracy double, cost double")


def cnn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saved models compared over the labelled documents and a smoke corpus."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label_id"))
    rows = written(_docs(spark, sf_dir).join(labels, "doc_id").select(subwords.piece_ids(F.col("text"), PIECES).alias("ids"), "label_id"), "cnn-rows")
    folder = shared_path(spark, "models")
    for seed in (0, 1):
        sinks.save_weights(spark, {k: v if k != "ids" else v.astype(np.float32) for k, v in model.fresh(32_000, 8, seed).items()}, f"{folder}/m{seed}")
    paths = [path for path, _ in sinks.models(folder)]
    found = cnn_training.report(rows, rows.where("label_id = 0"), paths)
    return found.withColumn("path", F.regexp_extract("path", "[^/]+$", 0))


def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for a corpus of vectors: look-alikes replaced where a text has a letter from U+0400 on, characters mapped, 100 characters at least."""
    charmap = {chr(c): chr(c) for c in range(32, 0x250)}
    line = each(lambda text: tokens.corpus_text(text, charmap), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", line.alias("line")).where(F.length("line") >= 100)


def queries(routes: str) -> dict:
    """Queries and SQL by name; routes is the SQL of dedup_batch_flags."""
    found = [
        (mailbox_index, MAILBOX_INDEX_SQL),
        (mailbox_point_reads, POINT_SQL),
        (mailbox_routes, routes_sql(routes)),
        (route_texts, route_texts_sql(routes)),
        (tag_lines, TAG_SQL),
        (preview_lines, PREVIEW_SQL),
        (score_lines, SCORE_LINES_SQL),
        (subject_clean, SUBJECT_SQL),
        (list_columns, LIST_SQL),
        (search_previous, "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id < 100 ORDER BY doc_id DESC LIMIT 1"),
        (goto_line, "SELECT doc_id, n_chars FROM documents WHERE doc_id = 42"),
        (any_flag, "SELECT lang, bool_or(doc_id % 11 = 0) AS some FROM documents GROUP BY lang"),
        (search_groups, SEARCH_GROUPS_SQL),
        (search_headers, SEARCH_HEADERS_SQL),
        (grey_labels, GREY_SQL),
        (saved_state, STATE_SQL),
        (vector_lines, VECTOR_SQL),
        (corpus_counts, COUNTS_SQL),
        (frames_decoded, FRAMES_SQL),
        (sessions_accounted, ACCOUNT_SQL),
        (stream_routes, routes),
        (piece_round_trip, None),
        (cnn_trained, None),
        (cnn_report, None),
        (corpus_filter, None),
    ]
    return {f.__name__: (f, sql) for f, sql in found}
