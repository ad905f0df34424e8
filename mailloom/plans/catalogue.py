"""All queries over the driver's tables, and DuckDB's SQL for those that SQL can express.

A message is a row of documents, its subject the text's first line, its sender source and language; flags follow from doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions import text as T
from mailloom.operators import dedup, embedding, lookup, metrics, model, search, training
from mailloom.plans import messages, parsing
from mailloom.session import in_order

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}

WS, WORD, INV = T.WS, T.WORD, T.INVISIBLE_CLASS
LINE = f"trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g'), ' ')"


def scrubbed(column: str, rules: list[tuple[str, str]] = T.SCRUB) -> str:
    for pattern, mark in rules:
        column = f"regexp_replace({column}, '{pattern}', '{mark}', 'g')"
    return column


LOW = f"lower({scrubbed(LINE)})"
FLAGS = "(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 32 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 64 ELSE 0 END)"
SCORE = "((doc_id * 37) % 1001 / 10.0)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.vocabulary(table(spark, sf_dir, "benchmark"))


VOCABULARY = f"vocabulary AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT unnest(list_filter(string_split(regexp_replace(lower({LINE}), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda t: t <> '')) AS word FROM benchmark))"

# Duplicates

_ROUTES = f"""WITH {VOCABULARY},
tokens AS (SELECT doc_id AS idx, list_filter(string_split(regexp_replace(lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '{INV}', '', 'g'), '{WS}', ' ', 'g'), ' ')), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda t: t <> '') AS t FROM documents),
each AS (SELECT idx, pos, coalesce(v.id, 0) AS id FROM (SELECT idx, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM tokens) e LEFT JOIN vocabulary v USING (word)),
ids AS (SELECT idx, count(*) FILTER (id > 0) AS known, list(id ORDER BY pos) AS i FROM each GROUP BY idx),
keys AS (SELECT t.idx, coalesce(known, 0) <= 3 OR len(t) < 10 AS short, t.t, i FROM tokens t LEFT JOIN ids USING (idx)),
all_keys AS (SELECT idx, short, unnest(CASE WHEN short THEN [array_to_string(t, ' ')] ELSE [array_to_string(i[1:100], ' '), array_to_string(i[6:100], ' ')] END) AS key FROM keys),
marked AS (SELECT idx, short, min(idx) OVER (PARTITION BY key) < idx AS before FROM all_keys),
flags AS (SELECT idx, any_value(short) AS short, bool_or(before) AS seen FROM marked GROUP BY idx)
SELECT idx, seen, CASE WHEN seen THEN 'dup' WHEN short THEN 'short' ELSE 'out' END AS route FROM flags"""


@query(f"SELECT route, count(*) AS n FROM ({_ROUTES}) GROUP BY route")
def dedup_batch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.routes(docs(spark, sf_dir), _words(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


@query(_ROUTES)
def dedup_batch_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.routes(docs(spark, sf_dir), _words(spark, sf_dir))


KNOWN = f"""{VOCABULARY}, known AS (SELECT doc_id, list(word ORDER BY pos) AS k FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all({LOW}, '{WORD}') AS w FROM documents)) SEMI JOIN vocabulary USING (word) GROUP BY doc_id)"""
BLANK = f"list_filter(string_split({LOW}, ' '), lambda t: t <> '')"
_KEYS = {
    "dedup_exact": (1, LINE),
    "dedup_scrubbed": (2, LOW),
    "dedup_vocab": (3, "array_to_string(k, ' ')"),
    "dedup_vocab_5_100": (4, "array_to_string(k[6:100], ' ')"),
    "dedup_first100": (5, f"array_to_string({BLANK}[1:100], ' ')"),
    "dedup_10_100": (6, f"array_to_string({BLANK}[11:100], ' ')"),
}


def _by_key(mode: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir).select("doc_id", "text")
        if mode in (3, 4):
            rows = dedup.known_words(rows, _words(spark, sf_dir))
        return dedup.by_key(rows, dedup.console_key(mode, F.col("text"), F.col("known") if mode in (3, 4) else None))

    return run


def _by_key_sql(key: str) -> str:
    return f"""WITH {KNOWN}, keyed AS (SELECT doc_id AS idx, {key} AS key FROM documents LEFT JOIN known USING (doc_id))
SELECT idx, base, group_size, CASE WHEN base = idx THEN -group_size ELSE base END AS pointer
FROM (SELECT idx, min(idx) OVER g AS base, count(*) OVER g AS group_size FROM keyed WHERE key <> '' WINDOW g AS (PARTITION BY key)
UNION ALL SELECT idx, idx, 1 FROM keyed WHERE key IS NULL OR key = '')"""


for _name, (_mode, _key) in _KEYS.items():
    _FOUND[_name] = (_by_key(_mode), _by_key_sql(_key))


@query(f"WITH f AS ({_by_key_sql(LOW)}) SELECT a.idx, a.pointer AS base, -b.pointer AS base_count FROM f a JOIN f b ON a.pointer = b.idx WHERE a.pointer >= 0")
def dup_with_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.with_base(_by_key(2)(spark, sf_dir)).select("idx", "base", "base_count")


@query()
def dedup_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar(docs(spark, sf_dir))


@query()
def dedup_shingle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.shingled(docs(spark, sf_dir))


# Texts

def _mapped(name: str, source: str, key: str, spark_form: Callable[[Column], Column], sql: str, column: str = "text") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, spark_form(F.col(column)).alias("result"))

    _FOUND[name] = (run, f"SELECT {key}, {sql} AS result FROM {source}")


def _untag_sql(column: str) -> str:
    column = f"regexp_replace({column}, '{T.SPAM_SCORE}', '', 'g')"
    for tag in T.SPAM_TAGS:
        column = f"replace({column}, '{tag}', '')"
    return column


_quoted = T._FOLD_TO.replace("'", "''")
_mapped("scrub_urls_documents", "documents", "doc_id", T.scrub, scrubbed("text"))
_mapped("scrub_urls_pages", "pages", "page_id", T.scrub, scrubbed("html"), "html")
_mapped("scrub_urls_v1", "pages", "page_id", lambda c: T.scrub(c, T.SCRUB_OLD), scrubbed("url", T.SCRUB_OLD), "url")
_mapped("strip_spamtags", "documents", "doc_id", lambda c: T.untag(F.concat(F.lit("[SPAM] *****SPAM{15.0}***** "), c)), _untag_sql("('[SPAM] *****SPAM{15.0}***** ' || text)"))
_mapped("strip_zero_width", "documents", "doc_id", T.visible, f"regexp_replace(text, '{INV}', '', 'g')")
_mapped("collapse_ws", "documents", "doc_id", T.collapse, f"trim(regexp_replace(text, '{WS}', ' ', 'g'), ' ')")
_mapped("fold_typography", "documents", "doc_id", T.corpus_line, f"trim(regexp_replace(regexp_replace(translate(lower(text), '{T._FOLD_FROM}', '{_quoted}'), '{T._KEPT}', ' ', 'g'), '{WS}', ' ', 'g'), ' ')")
_mapped("alnum_tokens", "documents", "doc_id", lambda c: F.concat_ws(" ", T.alnum_tokens(c)), "trim(regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN]+', ' ', 'g'), ' ')")
_mapped("word_tokens", "documents", "doc_id", lambda c: F.concat_ws("|", T.words(c)), f"array_to_string(regexp_extract_all(text, '{WORD}'), '|')")


@query(f"SELECT doc_id, CAST(len({BLANK}) AS BIGINT) AS n_words, length({LINE}) - length(regexp_replace({LINE}, '{T.LATIN}', '', 'g')) AS n_latin, length({LINE}) - length(regexp_replace({LINE}, '{T.BEYOND}', '', 'g')) AS n_beyond, length({LINE}) - length(regexp_replace({LINE}, '{T.CJK}', '', 'g')) AS n_cjk FROM documents".replace(BLANK, f"list_filter(string_split({LINE}, ' '), lambda t: t <> '')"))
def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = search.numbers(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", n["w"].alias("n_words"), n["l"].alias("n_latin"), n["L"].alias("n_beyond"), n["j"].alias("n_cjk"))


# Search, selection, lists


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda m, b: F.when(F.col("doc_id") % m == 0, b).otherwise(0)
    flags = bit(3, search.SELECTED) + bit(11, search.DELETED) + bit(7, search.EXTRA)
    sender = F.concat_ws("@", "source", "lang")
    return docs(spark, sf_dir).select("doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject"), sender.alias("sender"), F.col("n_chars"), flags.alias("flags"))


def _match(text: str) -> Column:
    fields = {"s": F.col("subject"), "f": F.col("sender"), "p": T.collapse(F.col("text"))}
    return search.predicate(text, fields, search.numbers(F.col("text")) | {"s": F.col("n_chars"), "d": (F.col("doc_id") * 37) % 1001})


@query("SELECT doc_id FROM documents WHERE contains(lower(split_part(text, chr(10), 1)), 'the') OR contains(lower(concat_ws('@', source, lang)), 'the')")
def search_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).where(_match("The")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains({LINE}, 'Eau') OR contains(concat_ws('@', source, lang), 'Eau')")
def search_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).where(_match("pf:Eau")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE len(list_filter(string_split({LINE}, ' '), lambda t: t <> '')) >= 300 AND (doc_id * 37) % 1001 < 500")
def search_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).where(_match("w>=300") & _match("d<500")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id > 100 AND contains(lower(split_part(text, chr(10), 1)), 'the') ORDER BY doc_id LIMIT 1")
def search_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.following(_mails(spark, sf_dir).where(_match("S:the")), 100).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {FLAGS} & 32 = 0 AND {FLAGS} & 1 = 0 AND {FLAGS} & 64 <> 0")
def filter_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).where(search.visible(F.col("flags"), selected=2, extra=True)).select("doc_id")


@query("SELECT doc_id, substring(text, 1, 1024) AS line FROM documents WHERE length(text) >= 10")
def filter_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.length("text") >= 10).select("doc_id", F.substring("text", 1, 1024).alias("line"))


SHOWN = "(doc_id % 2 = 0)"
for _name, _how, _only, _sql in (
    ("selection_union", "+", False, f"(doc_id % 3 = 0) OR {SHOWN}"),
    ("selection_intersect", "+", True, f"(doc_id % 3 = 0) AND {SHOWN}"),
    ("selection_except", "-", False, f"(doc_id % 3 = 0) AND NOT {SHOWN}"),
    ("selection_xor", "*", False, f"(doc_id % 3 = 0) <> {SHOWN}"),
    ("selection_clear", "*", True, "false"),
):

    def _selection(spark: SparkSession, sf_dir: str, how: str = _how, only: bool = _only) -> DataFrame:
        rows = _mails(spark, sf_dir)
        return rows.select("doc_id", search.combine(F.col("flags"), F.col("doc_id") % 2 == 0, how, only).cast("bigint").alias("flags"))

    _FOUND[_name] = (_selection, f"SELECT doc_id, CAST(({FLAGS} & ~1) + CASE WHEN {_sql} THEN 1 ELSE 0 END AS BIGINT) AS flags FROM documents")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(docs(spark, sf_dir).select("doc_id", "n_chars"), 50, 25)


# Vocabularies

_TOKENS = f"SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower({LINE}), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda t: t <> '') AS t FROM documents)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.alnum_tokens(T.collapse(F.col("text")))).alias("pos", "word"))


@query(f"WITH {VOCABULARY} SELECT doc_id, count(*) AS n, CAST(sum(coalesce(id, 0)) AS BIGINT) AS id_sum FROM ({_TOKENS}) LEFT JOIN vocabulary USING (word) GROUP BY doc_id")
def vocab_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _tokens(spark, sf_dir).join(_words(spark, sf_dir), "word", "left")
    return joined.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("id", F.lit(0)).cast("bigint")).alias("id_sum"))


@query(f"WITH {VOCABULARY} SELECT word, count(*) AS n FROM ({_TOKENS}) SEMI JOIN vocabulary USING (word) GROUP BY word")
def vocab_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).join(_words(spark, sf_dir), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {VOCABULARY} SELECT word, id FROM vocabulary ANTI JOIN ({_TOKENS}) t USING (word)")
def vocab_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).join(_tokens(spark, sf_dir).select("word").distinct(), "word", "left_anti").select("word", F.col("id").cast("bigint").alias("id"))


@query(f"WITH {VOCABULARY} SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM ({_TOKENS}) JOIN vocabulary USING (word) GROUP BY doc_id")
def vocab_inner_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _tokens(spark, sf_dir).join(_words(spark, sf_dir), "word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
    return each.select("doc_id", F.concat_ws(" ", F.transform("x", lambda s: s["id"].cast("string"))).alias("ids"))


@query(f"WITH {VOCABULARY} SELECT word, generate_subscripts(v, 1) - 1 AS place, CAST(unnest(v) AS DOUBLE) AS x, missing FROM (SELECT word, coalesce(embedding, list_transform(range(64), lambda k: CAST(0 AS FLOAT))) AS v, vec_id IS NULL AS missing FROM vocabulary LEFT JOIN embeddings ON vec_id = id * 3)")
def vocab_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").join(words, F.col("id") * 3 == F.col("vec_id")).select("word", F.col("embedding").alias("vec"))
    filled = embedding.merged(words, vectors, 64).select("word", "missing", F.posexplode("vec").alias("place", "x"))
    return filled.select("word", F.col("place").cast("bigint").alias("place"), F.col("x").cast("double").alias("x"), "missing")


@query("SELECT word, max(id) AS id FROM (SELECT string_split(text, ' ')[1] AS word, row_number() OVER (ORDER BY item_id) AS id FROM benchmark) GROUP BY word")
def vocab_by_line_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_order(table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ")[0].alias("word")), ["item_id"], "lines", "id")
    return rows.groupBy("word").agg(F.max("id").alias("id"))


@query(f"WITH {VOCABULARY} SELECT count(*) AS tokens, count(v.id) AS known FROM ({_TOKENS}) t LEFT JOIN vocabulary v USING (word)")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).join(_words(spark, sf_dir), "word", "left").agg(F.count("*").alias("tokens"), F.count("id").alias("known"))


@query(f"WITH {VOCABULARY} SELECT doc_id, array_to_string((list(id ORDER BY pos) || list_transform(range(256), lambda x: 0))[1:256], ' ') AS ids FROM ({_TOKENS}) JOIN vocabulary USING (word) GROUP BY doc_id")
def pad_truncate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = model.pad(F.split(F.col("ids"), " ").cast("array<int>"))
    return vocab_inner_ids(spark, sf_dir).select("doc_id", F.concat_ws(" ", ids.cast("array<string>")).alias("ids"))


# Scores and metrics


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_id"))
    return rows.withColumn("score", (F.col("doc_id") * 37) % 1001 / 1000.0)


SCORED = "(SELECT doc_id, quality AS label_id, (doc_id * 37) % 1001 / 1000.0 AS score FROM labels)"
BAND = "CASE " + " ".join(f"WHEN x >= {b} THEN '{b}'" for b in (99.9, 99.0, 98.0, 90.0, 80.0, 20.0, 10.0, 2.0)) + " ELSE '0.0' END"
VERDICT = "CASE WHEN y < 2 THEN 'ham' WHEN y < 10 THEN 'maybeham' WHEN y < 20 THEN '20ham' WHEN y > 98 THEN 'spam' WHEN y > 90 THEN 'maybespam' WHEN y > 80 THEN '80spam' ELSE 'dunno' END"


@query(f"SELECT doc_id, {BAND} AS band FROM (SELECT doc_id, {SCORE} AS x FROM documents)")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.score_band((F.col("doc_id") * 37) % 1001 / 10.0).alias("band"))


@query(f"SELECT doc_id, {VERDICT} || ' ' || CAST(CAST(floor(y) AS BIGINT) AS VARCHAR) || '%' AS verdict FROM (SELECT doc_id, {SCORE} + CAST(0.1 AS DOUBLE) AS y FROM documents)")
def verdict_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.verdict((F.col("doc_id") * 37) % 1001 / 10.0).alias("verdict"))


@query(f"""SELECT *, round(1 - spam_ok / spam_n + 3 * spam_missed / spam_n + 3 * ham_wrong / ham_n, 6) AS cost FROM (
SELECT count(*) FILTER (label_id = 0) AS spam_n, count(*) FILTER (label_id = 1) AS ham_n, count(*) FILTER (label_id = 0 AND score > 0.8) AS spam_ok,
count(*) FILTER (label_id = 0 AND score < 0.2) AS spam_missed, count(*) FILTER (label_id = 1 AND score < 0.2) AS ham_ok, count(*) FILTER (label_id = 1 AND score > 0.8) AS ham_wrong,
round(avg(score) FILTER (label_id = 0), 6) AS spam_mean, round(avg(score) FILTER (label_id = 1), 6) AS ham_mean FROM {SCORED})""")
def spam_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spam_metrics(_scored(spark, sf_dir))


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN (score < 0.5) = (label_id = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(-ln(CASE WHEN label_id = 0 THEN p ELSE 1 - p END)), 6) AS loss FROM (SELECT *, greatest(least(score, 1 - 1e-12), 1e-12) AS p FROM {SCORED})")
def accuracy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_loss(_scored(spark, sf_dir).withColumnRenamed("score", "p0"))


@query("SELECT CAST(floor(n_chars / 131072.0) AS INTEGER) AS bin, count(*) AS n FROM documents GROUP BY 1")
def histogram_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(docs(spark, sf_dir), F.col("n_chars"), 0.0, 128 * 131072.0)


@query("""WITH v AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT count(*) AS n, stddev_samp(x) AS sd FROM v)
SELECT any_value(n) AS n, round(any_value(sd), 6) AS sd, round(avg(CASE WHEN abs(x) < 0.1 * sd THEN 1.0 ELSE 0.0 END), 6) AS near_zero, (SELECT count(*) FROM embeddings WHERE list_max(embedding) < 0.1) AS dead FROM v, s""")
def weight_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weight_stats(table(spark, sf_dir, "embeddings"), F.col("embedding"))


@query(f"SELECT count(*) AS n, round(avg({SCORE}), 6) AS mean_score, count(*) FILTER ({SCORE} > 80) AS ok, count(*) FILTER ({SCORE} < 20) AS bad FROM documents")
def smoke_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("doc_id") * 37) % 1001 / 10.0
    return docs(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean_score"), F.count_if(x > 80).alias("ok"), F.count_if(x < 20).alias("bad"))


@query("SELECT doc_id, 0 AS label_id FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 1 FROM labels WHERE quality = 1")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    part = lambda k: rows.where(F.col("quality") == k).select("doc_id", F.lit(k).alias("label_id"))
    return part(0).unionByName(part(1))


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, quality AS label_id, count(*) AS n FROM labels GROUP BY ALL")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train")
    return table(spark, sf_dir, "labels").groupBy(split.alias("split"), F.col("quality").alias("label_id")).agg(F.count("*").alias("n"))


@query("""SELECT query, CAST(rank AS INTEGER) AS rank, vec_id, round(c, 6) AS cosine FROM (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(c, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id) WHERE rank <= 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return model.nearest(vectors, vectors)


@query("SELECT doc_id, text FROM documents")
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailloom.sources.mailbox import appended

    rows = docs(spark, sf_dir).select("doc_id", "text")
    return appended(rows.where("doc_id < 100"), rows, "doc_id")


@query("""WITH r AS (SELECT c_custkey * 5000 AS low, c_custkey * 5000 + 3999 AS high, c_mktsegment AS place FROM customer),
d AS (SELECT doc_id, (doc_id * 7919) % 900000 AS n FROM documents) SELECT doc_id, n, place FROM d LEFT JOIN r ON n BETWEEN low AND high""")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") * 5000
    ranges = table(spark, sf_dir, "customer").select(key.alias("low"), (key + 3999).alias("high"), F.col("c_mktsegment").alias("place"))
    n = (F.col("doc_id") * 7919) % 900000
    ip = F.concat_ws(".", *((F.floor(n / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)))
    rows = docs(spark, sf_dir).select("doc_id", lookup.ip_number(ip).alias("n"))
    return lookup.in_ranges(rows, "n", ranges).select("doc_id", "n", "place")


@query()
def text_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.regexp_replace("text", "the", "THE")
    return docs(spark, sf_dir).select("doc_id", lookup.differences(F.col("text"), changed).alias("d")).select("doc_id", F.size("d").cast("bigint").alias("runs"))


@query()
def trained_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_id")), "doc_id")
    fitted = training.train(rows.where("doc_id % 10 <> 0"))
    return metrics.spam_metrics(training.spam_scores(fitted, rows.where("doc_id % 10 = 0")))


_FOUND |= parsing.QUERIES
_FOUND |= messages.queries(_ROUTES)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
