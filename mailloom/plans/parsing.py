"""Queries that parse, model and stream: most run Python, which SQL can't express."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions import text as T
from mailloom.functions import tokens
from mailloom.functions.arrow import in_pieces
from mailloom.functions.html import declared_charset, html_text
from mailloom.functions.mail import decode_header
from mailloom.functions.payload import payload_text
from mailloom.operators import dedup, embedding, model
from mailloom.session import in_order
from mailloom.sources import mailbox
from mailloom.streaming import sessions


#: A map of characters that keeps Latin ones.
CHARACTERS = {chr(c): chr(c) for c in range(32, 0x250)} | {"’": "'", "“": '"', "”": '"', "…": "..."}


def each(function, text: Column, kind: str = "string", arrow: pa.DataType = pa.string()) -> Column:  # noqa: ANN001, B008
    """A function of one value over a column; null for null."""
    return in_pieces(lambda values: [None if x is None else function(x) for x in values], kind, arrow, text)


def html_column(html: Column) -> Column:
    """The readable text of HTML."""
    return each(lambda x: html_text(x.encode()).decode("utf-8", "replace"), html)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html_column(F.col("html")).alias("text"))


def html_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", each(lambda x: payload_text(x.encode(), "text/html", "utf-8"), F.col("html")).alias("text"))


def html_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", each(lambda x: declared_charset(x.encode()), F.col("html")).alias("charset"))


CHARSET_SQL = """SELECT page_id, nullif(lower(regexp_extract(html, '(?i)<meta[^>]*?charset=[\\x00-\\x20"'']*([-_0-9a-z]+)', 1)), '') AS charset FROM pages"""


def _raw_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as messages of a plain and an HTML part."""
    page = _pages(spark, sf_dir)
    head = F.concat(F.lit("From a@b\nFrom: =?utf-8?q?N=C3=A9v?= <a@b.hu>\nSubject: [SPAM] =?utf-8?b?w6FydsOt?= "), F.col("url"), F.lit("\nContent-Type: multipart/alternative; boundary=\"xx\"\n\n"))
    body = F.concat(F.lit("--xx\nContent-Type: text/plain\n\nplain\n--xx\nContent-Type: text/html; charset=utf-8\n\n"), F.col("html"), F.lit("\n--xx--\n"))
    return page.select("page_id", F.concat(head, body).cast("binary").alias("raw"))


def mime_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mailbox.parts(_raw_mails(spark, sf_dir), "page_id")
    return found.select("idx", F.concat_ws(".", F.col("place").cast("array<string>")).alias("place"), "kind", "charset", F.octet_length("payload").cast("bigint").alias("size"))


def best_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.best_texts(_raw_mails(spark, sf_dir), "page_id")


def mail_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.previews(_raw_mails(spark, sf_dir), "page_id")


def header_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as encoded words of up to 30 characters, one after the other."""
    word = lambda t: F.concat(F.lit("=?utf-8?B?"), F.replace(F.base64(F.encode(t, "utf-8")), F.lit("\r\n"), F.lit("")), F.lit("?="))
    coded = F.array_join(F.transform(F.regexp_extract_all("text", F.lit("(?s).{1,30}"), F.lit(0)), word), " ")
    return _docs(spark, sf_dir).select("doc_id", each(decode_header, coded).alias("header"))


def address_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit('"'), F.col("source"), F.lit('" <'), F.col("lang"), F.lit("@x.org>"))
    found = _docs(spark, sf_dir).select("doc_id", T.address(header).alias("a"))
    return found.select("doc_id", "a.addr", "a.name")


def split_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", "text", dedup.lossless(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("bigint").alias("n"), (F.array_join("t", "") == F.col("text")).alias("exact"))


def tokens_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", each(lambda x: " ".join(tokens.hide_digits(x)), F.col("text")).alias("tokens"))


def preprocess_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a source and a text as what a classifier reads, with a map of characters; others are left out."""
    return _docs(spark, sf_dir).select("doc_id", each(lambda x: tokens.normalize(x, CHARACTERS), F.concat("source", F.lit("|\n"), "text")).alias("text"))


def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.display_width(F.col("text")).alias("width"))


WIDTH_SQL = "SELECT doc_id, length(text) " + " ".join(f"{sign} (length(text) - length(regexp_replace(text, '{c}', '', 'g'))) * {n}" for sign, n, c in (("-", 1, T.INVISIBLE_CLASS), ("-", 2, T.CONTROL), ("+", 1, T.WIDE))) + " AS width FROM documents"
LOSSLESS_SQL = f"SELECT doc_id, CAST(2 * len(regexp_extract_all(text, '{T.WORD}')) + CASE WHEN regexp_matches(text, '{T.WORD}$') THEN 0 ELSE 1 END AS BIGINT) AS n, true AS exact FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL"
PARTS_SQL = "SELECT page_id AS idx, '0' AS place, 'text/plain' AS kind, NULL AS charset, 5 AS size FROM pages UNION ALL SELECT page_id, '1', 'text/html', 'utf-8', strlen(html) FROM pages"


def session_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.assembled_batch(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")


SESSION_SQL = "SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS mail, count(*) AS turns FROM conversations GROUP BY conv_id"


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _docs(spark, sf_dir).select(F.md5(T.collapse(F.coalesce("text", F.lit("")))).alias("key"))
    return sessions.drained(sessions.distinct_keys(sessions.stream_folder(keyed, "stream-in"), "key"), "stream-out")


STREAM_SQL = f"SELECT DISTINCT md5(trim(regexp_replace(coalesce(text, ''), '{T.WS}', ' ', 'g'), ' ')) AS key FROM documents"


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("conn_id"), F.col("turn").alias("seq"), "role", "text")
    body = turns.select("conn_id", (F.col("seq") + 1).cast("bigint").alias("seq"), F.lit("B").alias("cmd"), F.concat_ws(": ", "role", "text").alias("payload"))
    last = turns.groupBy("conn_id").agg((F.max("seq") + 2).cast("bigint").alias("seq")).select("conn_id", "seq", F.lit("E").alias("cmd"), F.lit("").alias("payload"))
    return sessions.drained(sessions.assemble(sessions.stream_folder(body.unionByName(last).coalesce(1), "frames")), "mails")


STREAM_SESSION_SQL = "SELECT conv_id AS conn_id, string_agg(concat_ws(': ', role, text), '' ORDER BY turn) AS mail FROM conversations GROUP BY conv_id"


def cnn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by seeded weights of the surveyed sizes, over subword ids."""
    from mailloom.operators.subwords import piece_ids
    from mailloom.plans.messages import PIECES

    return model.scores(_docs(spark, sf_dir).select("doc_id", piece_ids(F.col("text"), PIECES).alias("ids")), model.fresh(32_000, 256), "doc_id", "ids")


def word2vec_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest words of every word of the benchmark's texts, by vectors of the surveyed sizes."""
    lines = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(T.alnum_tokens(F.coalesce("text", F.lit(""))).alias("words"))
    vectors = in_order(embedding.word_vectors(embedding.fit(lines)), ["word"], "word-vectors", "id")
    near = model.nearest(vectors, vectors, id_col="id", vec_col="vec")
    names = vectors.select("id", "word")
    found = near.join(names.toDF("query", "word"), "query").join(names.toDF("vec_id", "neighbour"), "vec_id")
    return found.select("word", "rank", "neighbour", "cosine")


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in [
        (html_texts, None),
        (html_payload, None),
        (html_charset, CHARSET_SQL),
        (mime_parts, PARTS_SQL),
        (best_text, None),
        (mail_previews, None),
        (header_decode, "SELECT doc_id, text AS header FROM documents"),
        (address_split, "SELECT doc_id, lang || '@x.org' AS addr, source AS name FROM documents"),
        (split_lossless, LOSSLESS_SQL),
        (tokens_v1, None),
        (preprocess_v2, None),
        (display_width, WIDTH_SQL),
        (session_assemble, SESSION_SQL),
        (stream_dedup, STREAM_SQL),
        (stream_sessions, STREAM_SESSION_SQL),
        (cnn_scores, None),
        (word2vec_neighbors, None),
    ]
}
