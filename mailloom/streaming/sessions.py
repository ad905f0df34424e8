"""Streams: messages assembled from the frames of sessions, duplicates across batches, and files that arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailloom.functions.arrow import lists
from mailloom.session import shared_path, written

#: Commands: a header (name, 0, value), the end of headers, a part of the body, the end of the body, abort, quit.
HEADER, HEADERS_END, BODY, BODY_END, ABORT, QUIT = "LNBEAQ"

_STATE = "eml string"
_OUT = "conn_id bigint, mail string"


def fold(frames: list[tuple[str, str]], eml: str = "") -> tuple[list[str], str]:
    """Messages that some frames complete, and what is begun."""
    done = []
    for command, payload in frames:
        payload = payload or ""
        if command == HEADER:
            name, _, value = payload.partition("\0")
            eml += f"{name}: {value.rstrip(chr(0))}\n"
        elif command == HEADERS_END:
            eml += "\n"
        elif command == BODY:
            eml += payload
        elif command == BODY_END:
            done.append(eml + payload)
            eml = ""
        elif command in (ABORT, QUIT):
            eml = ""
    return done, eml


def reply(command: str, verdict: str | None = None, header: str = "X-Spam-Verdict") -> list[bytes]:
    """The frames (length, command, payload) that answer a command: to the negotiation the version and what is wanted, to the end of a
    body the verdict as a header and acceptance, to an abort or a quit nothing, else to go on."""
    frame = lambda c, p=b"": (len(p) + 1).to_bytes(4, "big") + c + p
    if command == "O":
        return [frame(b"O", b"".join(x.to_bytes(4, "big") for x in (2, 1, 0x0F)))]
    if command == BODY_END:
        name = header.encode() + b"\0" + (verdict or "").encode() + b"\0"
        return [frame(b"h", name), frame(b"a")] if verdict is not None else [frame(b"a")]
    return [] if command in (ABORT, QUIT, "D") else [frame(b"c")]


def assemble(frames: DataFrame, idle: str | None = None) -> DataFrame:
    """conn_id and mail of each message that a stream of frames (conn_id, seq, cmd, payload) completes.

    idle: the time after which a session without frames is dropped; a stream with it goes on till it is stopped, as time passes without
    data too, so it can't be drained.
    """

    def run(key: tuple[int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("seq")
        done, eml = fold(list(zip(rows["cmd"], rows["payload"])), state.get[0] if state.exists else "")
        if eml:
            state.update((eml,))
            if idle:
                state.setTimeoutDuration(idle)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"conn_id": key[0], "mail": done})

    return frames.groupBy("conn_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def decoded(captures: DataFrame, id_col: str = "conn_id", raw_col: str = "raw") -> DataFrame:
    """conn_id, seq (from 0), cmd and payload (binary) of the frames in what connections sent: four bytes of a length, big end first, a
    command, and the rest.  A frame that is cut off, or of length 0, ends the connection; so does a quit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in lists(*batch.columns):
                rows = []
                for conn, raw in zip(*values):
                    at, seq = 0, 0
                    while raw is not None and at + 5 <= len(raw):
                        size = int.from_bytes(raw[at : at + 4], "big")
                        if not size or at + 4 + size > len(raw):
                            break
                        rows.append((conn, seq, raw[at + 4 : at + 5].decode("latin-1"), raw[at + 5 : at + 4 + size]))
                        at, seq = at + 4 + size, seq + 1
                        if rows[-1][2] == QUIT:
                            break
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["conn_id", "seq", "cmd", "payload"])

    return captures.select(F.col(id_col).cast("bigint"), F.col(raw_col)).mapInArrow(run, "conn_id bigint, seq bigint, cmd string, payload binary")


def accounted(frames: DataFrame) -> DataFrame:
    """conn_id, frames, history (the commands in order), messages (ends of bodies), aborted and quit of each connection."""
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cmd"))), lambda x: x["cmd"]), "")
    count = lambda c: F.count_if(F.col("cmd") == c)
    return frames.groupBy("conn_id").agg(F.count("*").alias("frames"), order.alias("history"), count(BODY_END).alias("messages"), count(ABORT).alias("aborted"), (count(QUIT) > 0).alias("quit"))


def replies(frames: DataFrame, verdicts: DataFrame) -> DataFrame:
    """conn_id, seq and answer (binary, its frames one after the other) of each frame; verdicts has conn_id, seq (of a body's end) and verdict."""

    @F.arrow_udf("binary")
    def run(command: pa.Array, verdict: pa.Array) -> pa.Array:
        return pa.array([b"".join(reply(c, v)) for c, v in zip(command.to_pylist(), verdict.to_pylist())], pa.binary())

    return frames.join(verdicts, ["conn_id", "seq"], "left").select("conn_id", "seq", run("cmd", "verdict").alias("answer"))


def routed(stream: DataFrame, keys: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """idx, seen and route of the messages of a stream, as dedup.routes() gives them, over all batches; a table in `folder`.

    keys gives idx, short and keys of a batch.  What is known of earlier batches is a table of the first idx of each key, of which each
    batch writes its own part, again if it is run again; so no state is held in memory.  The least idx with a key counts, in whatever
    order messages arrive within a batch.
    """
    spark = stream.sparkSession
    known, out = f"{folder}/keys", f"{folder}/flags"

    def one(batch: DataFrame, number: int) -> None:
        own = written(keys(batch), "stream-keys")
        each = own.select("idx", "short", F.explode("keys").alias("key"))
        first = each.groupBy("key").agg(F.min("idx").alias("first"))
        if number:
            before = spark.read.schema("key binary, first bigint, batch bigint").parquet(known).where(F.col("batch") < number)
            earlier = before.groupBy("key").agg(F.lit(True).alias("known"))
            first = first.join(earlier, "key", "left")
        else:
            first = first.withColumn("known", F.lit(None).cast("boolean"))
        seen = F.bool_or(F.coalesce("known", F.lit(False)) | (F.col("first") < F.col("idx")))
        flags = each.join(first, "key").groupBy("idx").agg(F.first("short").alias("short"), seen.alias("seen"))
        route = F.when(F.col("seen"), "dup").when(F.col("short"), "short").otherwise("out")
        flags.select("idx", "seen", route.alias("route")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        first.where("known is null").select("key", "first").write.mode("overwrite").parquet(f"{known}/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("idx bigint, seen boolean, route string, batch int").parquet(out).select("idx", "seen", "route")


def stream_folder(df: DataFrame, name: str) -> DataFrame:
    """Some rows as a stream of files."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream yields till its source is used up, as a table."""
    spark = stream.sparkSession
    path, log = shared_path(spark, name), shared_path(spark, f"{name}-log")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def distinct_keys(stream: DataFrame, key: str, time: str | None = None, late: str = "7 days") -> DataFrame:
    """The first row of each key over all batches; with a column of times, keys are forgotten when rows as old as `late` are done with."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def assembled_batch(turns: DataFrame, id_col: str, order: str, name: str, text: str) -> DataFrame:
    """id and mail: a session's turns as lines of "name: text", in order."""
    line = F.concat_ws(": ", F.coalesce(name, F.lit("")), F.coalesce(text, F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x: x["line"])
    return turns.groupBy(id_col).agg(F.concat_ws("\n", rows).alias("mail"), F.count("*").alias("turns"))


__all__ = ["assemble", "assembled_batch", "distinct_keys", "drained", "fold", "stream_folder", "written"]
