"""Token ids in binary shards: an independent zstandard frame for each document, and a trailing seek table with checksums."""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm import store

#: The vocabulary of ranks, and its pattern of pieces.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEVEL = 3

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_encoders: dict[str, object] = {}

INDEX = "doc_id bigint, shard string, frame bigint, n_tokens bigint, checksum bigint"


def ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and their ids of a file of ranks."""
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encoding(vocabulary: str = VOCABULARY, given: dict[bytes, int] | None = None):  # noqa: ANN201
    """The tokenizer of a file of ranks, or of those that the driver has read from it; made once a worker."""
    if vocabulary not in _encoders:
        import tiktoken

        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=given or ranks(vocabulary), special_tokens={})
    return _encoders[vocabulary]


def encoder(vocabulary: str = VOCABULARY, given: dict[bytes, int] | None = None) -> Callable[[str], list[int]]:
    """Text to ids; special tokens' strings are ordinary text."""
    return encoding(vocabulary, given).encode_ordinary


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """A skippable frame with the compressed size, size and checksum of each frame, in their order."""
    body = np.array(frames, "<u4").tobytes() + struct.pack("<IBI", len(frames), 0x80, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


class Writer:
    """A shard: one frame for each call of add(); the seek table is written and the file gets its name at close()."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, level: int = LEVEL) -> None:
        self.fs, self.path, self.frames = fs, path, []
        self.part = f"{path}.{uuid.uuid4().hex}.part"
        self.out = fs.open_output_stream(self.part)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, raw: bytes) -> tuple[int, int]:
        """Number of the frame, and the checksum of its bytes (the low half of their XXH64)."""
        frame = self.pack.compress(raw)
        check = xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF
        self.out.write(frame)
        self.frames.append((len(frame), len(raw), check))
        return len(self.frames) - 1, check

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Random access to a shard's frames; reads its seek table and the frames that are asked for, no others."""

    def __init__(self, uri: str) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = np.frombuffer(self.file.read_at(12 * count, end - 9 - 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.size, self.raw, self.check = table.T
        self.start = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.size)

    def __getitem__(self, k: int) -> bytes:
        frame = self.file.read_at(int(self.size[k]), int(self.start[k]))
        raw = zstandard.ZstdDecompressor().decompress(frame, max_output_size=max(1, int(self.raw[k])))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.check[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return raw


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards of token ids into a folder that all executors share, and return the index of the documents, itself a table there.

    A task writes one shard, under another name than any other attempt, and the index names those of the attempts that counted; so a
    lost executor's shards are written anew.  Index columns: doc_id, shard (a URI), frame, n_tokens, checksum.  Ids are little-endian
    uint16, or uint32 for a vocabulary of more than 65,536.  A null text has no frame (shard, frame, n_tokens and checksum are null); an
    empty one has a frame of no tokens; repeated rows have a frame each.  Other columns are left out.  Shards of attempts that failed are
    removed at the end.  The driver reads the vocabulary and sends it to the tasks.
    """
    given = ranks(vocabulary)
    dtype = "<u2" if max(given.values()) < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(vocabulary, shared.value), None
        for batch in batches:
            if shard is None:
                uri = f"{folder}/shard-{uuid.uuid4().hex}.zst"
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                shard = Writer(fs, path)
            frames, sizes, checks = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                if text is None:
                    row = (None, None, None)
                else:
                    ids = np.array(encode(text), dtype)
                    frame, check = shard.add(ids.tobytes())
                    row = (frame, len(ids), check)
                for column, x in zip((frames, sizes, checks), row):
                    column.append(x)
            names = pa.array([None if f is None else uri for f in frames], pa.string())
            numbers = [pa.array(x, pa.int64()) for x in (frames, sizes, checks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), names, *numbers], ["doc_id", "shard", "frame", "n_tokens", "checksum"])
        if shard is not None:
            shard.close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)
    path = f"{folder}/index"
    rows.write.parquet(path)
    index = docs.sparkSession.read.schema(INDEX).parquet(path)
    counted = {r.shard.rpartition("/")[2] for r in index.select("shard").where("shard is not null").distinct().collect()}  # one a task
    fs, place = pyarrow.fs.FileSystem.from_uri(folder)
    for f in fs.get_file_info(pyarrow.fs.FileSelector(place, allow_not_found=True)):
        if f.base_name.startswith("shard-") and f.base_name not in counted:
            fs.delete_file(f.path)
    return index


def read_tokens(index: DataFrame) -> DataFrame:
    """doc_id and ids of the documents of (a part of) an index; only their frames are read and decompressed, each checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            out = []
            for shard, frame, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if frame is None:
                    out.append(None)
                    continue
                if shard != name:
                    reader, name = Reader(shard), shard
                raw = reader[frame]
                out.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = index.select("doc_id", "shard", "frame", "n_tokens").repartition("shard").sortWithinPartitions("shard", "frame")
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def token_files(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' token ids into a new folder of the shared one; the index (see write_tokens())."""
    return write_tokens(docs, store.new_path(docs.sparkSession, "tokens"), vocabulary, id_col, text_col)
