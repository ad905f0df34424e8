"""The job that makes word vectors: filter a corpus, turn it into ids or words, train, merge with a vocabulary, and save."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.operators import subwords

#: Production parameters: numbers of a vector, words around a word, passes, least occurrences of a word.
SIZE, AROUND, PASSES, LEAST = 256, 10, 25, 1


def fit(lines: DataFrame, words: str = "words", size: int = SIZE, around: int = AROUND, passes: int = PASSES, least: int = LEAST, partitions: int = 1, seed: int = 1) -> Word2VecModel:
    """Vectors of all words of some lines (array of string)."""
    return Word2Vec(vectorSize=size, windowSize=around, minCount=least, maxIter=passes, numPartitions=partitions, seed=seed, inputCol=words, outputCol="_vec").fit(lines)


def word_vectors(fitted: Word2VecModel) -> DataFrame:
    """word and vec (array of float) of all words."""
    from pyspark.ml.functions import vector_to_array

    return fitted.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))


def merged(vocabulary: DataFrame, vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """word, id, vec and missing of each word of a vocabulary: zeros where there is no vector.  Vectors of other words are left out."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    joined = vocabulary.join(vectors.select("word", "vec"), "word", "left")
    return joined.select("word", "id", F.coalesce("vec", zeros).alias("vec"), F.col("vec").isNull().alias("missing"))


def only_vectors(vocabulary: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of words that the vocabulary hasn't."""
    return vectors.join(vocabulary.select("word"), "word", "left_anti")


def job(texts: DataFrame, text: Column, pieces: str, folder: str, **parameters) -> DataFrame:  # noqa: ANN003
    """The whole job: texts as ids of a subword vocabulary, vectors of these, merged with the vocabulary and saved in a folder.

    Returns the saved table: id, word (the piece), vec and missing.  Further parameters are those of fit().
    """
    spark = texts.sparkSession
    lines = texts.select(subwords.piece_ids(text, pieces).cast("array<string>").alias("words")).where("words is not null")
    vectors = word_vectors(fit(lines, **parameters))
    size = parameters.get("size", SIZE)
    one = subwords.processor(pieces)
    vocabulary = spark.createDataFrame([(str(k), k) for k in range(one.get_piece_size())], "word string, id int")  # the vocabulary's size
    names = spark.createDataFrame([(k, one.id_to_piece(k)) for k in range(one.get_piece_size())], "id int, piece string")
    found = merged(vocabulary, vectors, size).join(names, "id").select("id", F.col("piece").alias("word"), "vec", "missing")
    found.write.mode("overwrite").parquet(folder)
    return spark.read.schema(found.schema).parquet(folder)


def corpus_counts(lines: DataFrame, text: Column, kept: Column, cyrillic: Column) -> DataFrame:
    """One row: lines, those with a letter from U+0400 on, and those that are kept."""
    return lines.agg(F.count("*").alias("lines"), F.count_if(cyrillic).alias("cyrillic"), F.count_if(kept & text.isNotNull()).alias("kept"))
