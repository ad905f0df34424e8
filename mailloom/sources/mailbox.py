"""Sources: mailboxes, labelled lines, vocabularies, character maps, word vectors."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions import mail
from mailloom.functions import text as T
from mailloom.functions.arrow import PIECE, in_pieces, lists
from mailloom.session import in_order


#: Bytes of a file that one task looks for messages in, and that are read at once.
SPLIT, STEP = 64 << 20, 8 << 20

_EVENT = re.compile(rb"\n(?=From |\r*\n)")
_EVENT_BLANK = re.compile(rb"\n(?=From |[ \t\r\x0b\x0c]*\n)")
_MESSAGE = "path string, fpos bigint, size bigint, raw binary"


def _files(path: str) -> list[tuple[str, int]]:
    """The URI and size of a file, or of those in a folder, in order of their names."""
    system, root = FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    scheme = path.split("://")[0] if "://" in path else "file"
    info = system.get_file_info(root)
    found = [info] if info.type == FileType.File else system.get_file_info(FileSelector(root))
    return sorted((f"{scheme}://{f.path}", f.size) for f in found if f.type == FileType.File and not f.base_name.startswith(("_", ".")))


def message_starts(file, start: int, stop: int, end: int, blank: bool = False) -> tuple[list[int], bytes, int]:  # noqa: ANN001
    """Where the messages begin that begin in a part of a file, a piece of the file that holds them, and where that begins.

    A line that begins with "From " begins a message if it isn't in a header.  A header ends at its first empty line (blank: or line of
    blanks), so such a line is in a header if none lies between it and the line of this kind before it; what lies further back doesn't
    matter.  The file's first message begins at 0 in any case.
    """
    event = _EVENT_BLANK if blank else _EVENT
    low, body = start, None
    while low > 0 and body is None:
        low = max(0, low - (1 << 16))
        data = file.read_at(start - low + 8, low)
        last = max((m.end() for m in event.finditer(data) if low + m.end() < start), default=None)
        if last is not None:
            low += last - 1
            break
    data, body, found, at = file.read_at(min(end, stop + STEP) - low, low), False, [0] if start == 0 else [], 0
    while True:
        whole = low + len(data) >= end
        for m in event.finditer(data, at):
            if m.end() + 5 > len(data) and not whole:
                break
            at = m.start() + 1
            if not data.startswith(b"From ", m.end()):
                body = True
            elif body:
                body = False
                if low + m.end() >= start:
                    found.append(low + m.end())
                    if found[-1] >= stop:
                        return found, data, low
        if whole:
            return [*found, end], data, low
        at = max(at, len(data) - (1 << 16))
        data += file.read_at(min(max(STEP, len(data)), end - low - len(data)), low + len(data))


def mailbox(spark: SparkSession, path: str, blank: bool = False, split: int = SPLIT) -> DataFrame:
    """path, fpos, size and raw (binary, byte for byte) of each message of a mailbox file or of those in a folder; see message_starts().

    Files are read in parts, and a message belongs to the part in which it begins, however long it is.
    """
    pieces = [(uri, size, at, min(size, at + split)) for uri, size in _files(path) for at in range(0, size, split)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, end, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = FileSystem.from_uri(uri)
                with system.open_input_file(name) as file:
                    for at in range(start, stop, STEP):  # a part is read a step at a time, each like a part of its own
                        upto = min(stop, at + STEP)
                        found, data, low = message_starts(file, at, upto, end, blank)
                        yield _batch([(uri, a, b - a, data[a - low : b - low]) for a, b in zip(found, found[1:]) if a < upto])
                        del found, data

    def _batch(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["path", "fpos", "size", "raw"])

    frame = spark.createDataFrame(pieces, "uri string, size bigint, start bigint, stop bigint").repartition(max(1, len(pieces)))
    return frame.mapInArrow(run, _MESSAGE)


def read_messages(rows: DataFrame) -> DataFrame:
    """The same columns and raw of rows with path, fpos and size: only these bytes are read."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, None
        for batch in batches:
            place = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "fpos", "size")]
            raw, done, held = [], 0, 0
            for k, (uri, at, size) in enumerate(zip(*place)):
                if uri != opened:
                    system, name = FileSystem.from_uri(uri)
                    file, opened = system.open_input_file(name), uri
                raw.append(file.read_at(size, at))
                held += size
                if held >= PIECE or k + 1 == len(batch):  # what messages take isn't known from their rows
                    yield pa.RecordBatch.from_arrays([*(c.slice(done, len(raw)) for c in batch.columns), pa.array(raw, pa.binary())], [*names, "raw"])
                    raw, done, held = [], k + 1, 0

    return rows.sortWithinPartitions("path", "fpos").mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, raw binary")


#: Headers that the index keeps.
KEPT = ("from", "subject", "x-deepspam", "x-grey-ng")


def index(mails: DataFrame, keep: tuple[str, ...] = KEPT, head: bool = False) -> DataFrame:
    """Metadata of each message: path, fpos, size, hsize (bytes to the header's end), from_line, headers (a map of those to keep, by name;
    of several of one name the last), addr, name, subject and has_attach; and the header itself as it stands, however long (head), if it is
    asked for.  Only headers are parsed."""
    fields = [("path", pa.string()), ("fpos", pa.int64()), ("size", pa.int64()), ("hsize", pa.int64()), ("from_line", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("addr", pa.string()), ("name", pa.string()), ("subject", pa.string()), ("has_attach", pa.bool_()), *([("head", pa.string())] if head else [])]

    def one(raw: bytes) -> tuple:
        gap = re.search(rb"\r?\n\r?\n", raw)
        hsize = gap.end() if gap else len(raw)
        first, _, rest = raw[:hsize].partition(b"\n")
        if not first.startswith(b"From "):
            first, rest = b"", raw[:hsize]
        found = {k: v.lstrip().decode("utf-8", "mailloom-mixed") for k, v in mail._headers(rest) if k in keep}
        addr, name = mail.decode_address(found.get("from", ""))
        subject = mail.decode_header(found["subject"]) if "subject" in found else None
        whole = [raw[: gap.start() if gap else len(raw)].decode("utf-8", "mailloom-mixed")] if head else []
        return (len(raw), hsize, first.rstrip(b"\r").decode("ascii", "ignore") or None, list(found.items()), addr, name, subject, raw.find(b"\nContent-Disposition: attachment", hsize - 1) >= 0, *whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in lists(*batch.columns):
                rows = [(path, at, *one(raw)) for path, at, raw in zip(*values)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    kinds = "path string, fpos bigint, size bigint, hsize bigint, from_line string, headers map<string, string>, addr string, name string, subject string, has_attach boolean"
    return mails.select("path", "fpos", "raw").mapInArrow(run, kinds + ", head string" * head)


def parts(mails: DataFrame, id_col: str, raw_col: str = "raw") -> DataFrame:
    """One row for each leaf of each message: idx, place (numbers from the root), kind, charset, encoding, disposition, name, begin, stop and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in lists(*batch.columns):
                rows = [(i, list(at), p.kind, p.charset, p.encoding, p.disposition, p.name, p.start, p.end, p.payload) for i, raw in zip(*values) if raw is not None for at, p in mail.leaves(mail.parse(raw))]
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 10, kinds)], ["idx", "place", "kind", "charset", "encoding", "disposition", "name", "begin", "stop", "payload"])

    kinds = "idx bigint, place array<int>, kind string, charset string, encoding string, disposition string, name string, begin bigint, stop bigint, payload binary"
    return mails.select(F.col(id_col).cast("bigint"), F.col(raw_col)).mapInArrow(run, kinds)


def best_texts(mails: DataFrame, id_col: str, raw_col: str = "raw") -> DataFrame:
    """idx, subject and text of each message; null for a null one."""

    def run(mails: list[bytes | None]) -> list[dict[str, str | None] | None]:
        return [None if raw is None else dict(zip(("subject", "text"), mail.best_text(mail.parse(raw)))) for raw in mails]

    kind = pa.struct([("subject", pa.string()), ("text", pa.string())])
    found = in_pieces(run, "struct<subject: string, text: string>", kind, F.col(raw_col))
    return mails.select(F.col(id_col).alias("idx"), found.alias("f")).select("idx", "f.subject", "f.text")


def previews(mails: DataFrame, id_col: str, raw_col: str = "raw") -> DataFrame:
    """idx, subject and preview of each message: its best text without invisible characters, with single blanks."""
    return best_texts(mails, id_col, raw_col).select("idx", "subject", T.collapse(T.visible(F.coalesce("text", F.lit("")))).alias("preview"))


def smoke_lines(spark: SparkSession, path: str) -> DataFrame:
    """subject and body of all lines "subject|body" of files; a line without a bar is a subject."""
    both = F.split("value", r"\|", 2)
    return spark.read.text(path).select(F.get(both, F.lit(0)).alias("subject"), F.get(both, F.lit(1)).alias("body"))


def plain_lines(spark: SparkSession, path: str, label_id: int, split: str) -> DataFrame:
    """text, label_id and split of all lines of files, none left out or cut."""
    return spark.read.text(path).select(F.col("value").alias("text"), F.lit(label_id).alias("label_id"), F.lit(split).alias("split"))


def labelled_lines(spark: SparkSession, path: str, label_id: int, split: str, least: int = 10, most: int = 1024) -> DataFrame:
    """subject, body, label_id and split of a file's lines of "subject|body"; lines of fewer characters (the line end counts) are left out, longer ones cut."""
    line = F.substring("value", 1, most)
    both = F.split(line, r"\|", 2)
    rows = spark.read.text(path).where(F.length("value") + 1 >= least)
    return rows.select(F.get(both, F.lit(0)).alias("subject"), F.get(both, F.lit(1)).alias("body"), F.lit(label_id).alias("label_id"), F.lit(split).alias("split"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and number (from 1) of all lines of text files, in order of the files' names and of the lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return in_order(lines, ["_file", "_block", "_line"], "lines").select("value", "number")


def vocabulary_by_line(spark: SparkSession, path: str) -> DataFrame:
    """word and id: each line's first word and the line's number, from 1; of several lines of a word the last one counts."""
    numbered = text_lines(spark, path).withColumn("word", F.split(F.trim("value"), r"\s+")[0])
    return numbered.groupBy("word").agg(F.max("number").alias("id"))


def vocabulary_by_column(spark: SparkSession, path: str) -> DataFrame:
    """word and id of lines of two columns."""
    both = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(both, F.lit(0)).alias("word"), F.get(both, F.lit(1)).try_cast("int").alias("id")).where("id is not null")


def character_map(spark: SparkSession, path: str) -> DataFrame:
    """src and dst of a table of characters: its second and third columns."""
    cells = F.split("value", "\t", -1)
    return spark.read.text(path).select(F.get(cells, F.lit(1)).alias("src"), F.get(cells, F.lit(2)).alias("dst")).where("src is not null and dst is not null")


def unmapped_targets(table: DataFrame) -> DataFrame:
    """Characters that a map yields but doesn't map to themselves."""
    made = table.select(F.explode(F.filter(F.split("dst", ""), lambda c: c != "")).alias("c")).distinct()
    kept = table.where("src = dst").select(F.col("src").alias("c"))
    return made.join(kept, "c", "left_anti")


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word and vec of a text file of vectors; a first line of counts is left out."""
    cells = F.split(F.trim("value"), " ")
    vec = F.slice(cells, 2, F.size(cells)).cast("array<float>")
    return spark.read.text(path).where(F.size(cells) > 2).select(F.get(cells, F.lit(0)).alias("word"), vec.alias("vec"))


def appended(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The known rows and those found beyond the highest known key."""
    mark = known.agg(F.max(key).alias("_mark"))
    fresh = found.crossJoin(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.col(key) > F.col("_mark"))).drop("_mark")
    return known.unionByName(fresh)


def look_alikes(spark: SparkSession, path: str) -> dict[str, str]:
    """A table of characters and what they look like, from lines of both with a tab between; no more than there are characters."""
    cells = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(F.get(cells, F.lit(0)).alias("a"), F.get(cells, F.lit(1)).alias("b")).where("length(a) = 1 and b is not null")
    return {r.a: r.b for r in rows.collect()}


def id_corpus(spark: SparkSession, path: str) -> DataFrame:
    """words: the blank-separated parts of each line of files, an array of string."""
    return spark.read.text(path).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("words"))


def word_matrix(spark: SparkSession, path: str) -> DataFrame:
    """id, word and vec of a saved table of vectors, in which id 0 is for no word and its vector is zeros."""
    rows = spark.read.parquet(path).select(F.col("id").cast("int").alias("id"), "word", F.col("vec").cast("array<float>").alias("vec"))
    return rows.withColumn("vec", F.when(F.col("id") == 0, F.transform("vec", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("vec")))
