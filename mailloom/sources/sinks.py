"""Sinks: mailboxes byte for byte, by route or as one, lines of text, and saved states and weights.

All write to folders that executors share.  A file has the name of its partition and gets it when it is whole, so a task that is run
again replaces what it wrote before.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions import text as T
from mailloom.functions.arrow import lists
from mailloom.operators import search

_WRITTEN = "route string, file string, messages bigint, bytes bigint"


def write_mailbox(mails: DataFrame, folder: str, order: list[str], raw: str = "raw", route: Column | None = None) -> DataFrame:
    """Write messages, byte for byte, to files that hold them in order if read in order of their names; those of each route to a folder of its own.

    Returns the files: route, file, messages and bytes.  A null message is none.
    """
    place = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files: dict[str, list] = {}
        system, root = FileSystem.from_uri(place)
        for batch in batches:
            for to, body in (row for values in lists(*batch.columns) for row in zip(*values)):
                if to not in files:
                    inner = f"{root}/{to}" if to else root
                    system.create_dir(inner, recursive=True)
                    own = f"{inner}/.{uuid.uuid4().hex}"
                    files[to] = [system.open_output_stream(own), own, f"{inner}/part-{part:06d}.mbox", 0, 0]
                files[to][0].write(body)
                files[to][3] += 1
                files[to][4] += len(body)
        for to, (stream, own, name, _, _) in files.items():
            stream.close()
            system.move(own, name)
        columns = [[to, f[2], f[3], f[4]] for to, f in files.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*columns) if columns else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["route", "file", "messages", "bytes"])

    to = F.lit("") if route is None else route
    rows = mails.withColumn("_route", to.cast("string")).where(F.col(raw).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    done = rows.select("_route", F.col(raw).cast("binary")).mapInArrow(run, _WRITTEN)
    index = f"{place}/_written-{uuid.uuid4().hex}"
    done.write.parquet(index)
    return mails.sparkSession.read.schema(_WRITTEN).parquet(index)


def write_lines(lines: DataFrame, folder: str, value: str = "value", by: str | None = None) -> None:
    """Write a column as lines of text, those of each value of `by` to a folder of its own."""
    chosen = lines.select(*([by] if by else []), value)
    (chosen.write.partitionBy(by) if by else chosen.write).mode("error").text(folder)


def route_lines(routed: DataFrame, text: Column, route: str = "route") -> DataFrame:
    """route and value: the previews of messages that aren't duplicates, for the text files beside the mailboxes."""
    return routed.where(F.col(route) != "dup").select(route, T.collapse(T.visible(F.coalesce(text, F.lit("")))).alias("value"))


def preview_lines(mails: DataFrame, text: Column, least: int = 2000) -> DataFrame:
    """value: the previews of all messages, if there are `least` at least; else none."""
    enough = F.broadcast(mails.agg((F.count("*") >= least).alias("_enough")))
    return mails.select(T.collapse(T.visible(F.coalesce(text, F.lit("")))).alias("value")).join(enough, F.col("_enough")).select("value")


def tag_lines(mails: DataFrame, file: Column, number: Column, subject: Column, text: Column) -> DataFrame:
    """value: file:number:subject|preview of each message."""
    line = T.collapse(T.visible(F.coalesce(text, F.lit(""))))
    return mails.select(F.concat(file, F.lit(":"), number.cast("string"), F.lit(":"), F.coalesce(clean_subject(subject), F.lit("")), F.lit("|"), line).alias("value"))


def clean_subject(subject: Column) -> Column:
    """A subject without filters' marks and invisible characters, with slashes for bars and single blanks."""
    return T.collapse(T.visible(F.translate(T.untag(subject), "|", "/")))


def score_lines(scored: DataFrame, score: Column, tokens: Column) -> DataFrame:
    """value: the score as a whole number of three places, a per cent sign, and the tokens."""
    return scored.select(F.concat(F.format_string("%3d%%: ", score.cast("bigint")), F.concat_ws(" ", tokens)).alias("value"))


def vector_lines(vectors: DataFrame, word: str = "word", vec: str = "vec") -> DataFrame:
    """value: a head of the number of vectors and their length, and a line of a word and its numbers for each, the head in a row of its own."""
    head = vectors.agg(F.concat_ws(" ", F.count("*").cast("string"), F.coalesce(F.max(F.size(vec)), F.lit(0)).cast("string")).alias("value"))
    rows = vectors.select(F.concat_ws(" ", F.col(word), F.transform(vec, lambda x: x.cast("string"))).alias("value"))
    return head.unionByName(rows)


def save_state(mails: DataFrame, folder: str, metadata: list[str], flags: str = "flags", pointer: str = "pointer", key: str = "idx", least: int = 10_000) -> list[str]:
    """Save metadata if there are more than `least` messages, flags if any is set, and duplicates' pointers; returns which were saved."""
    n, some = mails.agg(F.count("*"), search.any_set(F.col(flags))).first()
    saved = [*(["meta"] if n > least else []), *(["flags"] if some else []), "dedup"]
    for name in saved:
        columns = {"meta": metadata, "flags": [flags], "dedup": [pointer]}[name]
        mails.select(key, *(c for c in columns if c != key)).write.mode("overwrite").parquet(f"{folder}/{name}")
    return saved


def load_state(spark: SparkSession, mails: DataFrame, folder: str, saved: list[str], key: str = "idx") -> DataFrame:
    """The messages with the columns of a saved state; null where it has none, so flags of new messages are to be filled."""
    for name in saved:
        mails = mails.join(spark.read.parquet(f"{folder}/{name}"), key, "left")
    return mails


def save_weights(spark: SparkSession, weights: dict, folder: str) -> None:
    """Save arrays by name as rows: name, shape, and values."""
    rows = pa.table({"name": list(weights), "shape": pa.array([list(w.shape) for w in weights.values()], pa.list_(pa.int64())), "value": pa.array([w.ravel().tolist() for w in weights.values()], pa.list_(pa.float64()))})
    spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(folder)


def load_weights(spark: SparkSession, folder: str) -> dict:
    """The arrays of save_weights(), as 32-bit numbers."""
    import numpy as np

    return {r["name"]: np.array(r["value"], np.float32).reshape(r["shape"]) for r in spark.read.parquet(folder).collect()}


def models(folder: str) -> list[tuple[str, object]]:
    """Path and time of the last change of each saved model (a folder of weights that is whole) in a folder, in order of the paths."""
    place = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    system, root = FileSystem.from_uri(place)
    found = system.get_file_info(FileSelector(root, recursive=True))
    return sorted((f"{place.split('://')[0]}://{f.path.removesuffix('/_SUCCESS')}", f.mtime) for f in found if f.path.endswith("/_SUCCESS"))
