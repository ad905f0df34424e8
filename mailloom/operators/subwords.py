"""Subword ids by a vocabulary that is given: the tokenizer is a parameter, and none is trained."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions.arrow import in_pieces, number_lists

_loaded: dict[str, object] = {}


def processor(path: str):  # noqa: ANN201
    """The SentencePiece model of a file that executors can read, loaded once a worker."""
    if path not in _loaded:
        from sentencepiece import SentencePieceProcessor

        _loaded[path] = SentencePieceProcessor(model_file=path)
    return _loaded[path]


def piece_ids(text: Column, path: str) -> Column:
    """Ids (array of int) of a text by a SentencePiece model; null for a null text."""

    def run(texts: list[str | None]) -> pa.Array:
        coded = processor(path).encode([t or "" for t in texts], num_threads=1)
        return number_lists([None if t is None else ids for t, ids in zip(texts, coded)])

    return in_pieces(run, "array<int>", pa.list_(pa.int32()), text)


def pieces(text: Column, path: str) -> Column:
    """The pieces themselves (array of string)."""

    def run(texts: list[str | None]) -> list[list[str] | None]:
        coded = processor(path).encode([t or "" for t in texts], out_type=str, num_threads=1)
        return [None if t is None else p for t, p in zip(texts, coded)]

    return in_pieces(run, "array<string>", pa.list_(pa.string()), text)


def piece_text(ids: Column, path: str) -> Column:
    """The text of ids."""
    return in_pieces(lambda rows: [None if x is None else processor(path).decode(x) for x in rows], "string", pa.string(), ids)


def id_lines(texts: DataFrame, text: Column, path: str) -> DataFrame:
    """value: a line of ids for each text, for a corpus of ids."""
    return texts.select(F.concat_ws(" ", piece_ids(text, path).cast("array<string>")).alias("value"))
