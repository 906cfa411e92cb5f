"""Text vectors: each distinct text is encoded once and joined back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.functions import vectors as V

DIMENSIONS = 256


def hashed_tfidf(texts: DataFrame, text: str = "text", size: int = DIMENSIONS) -> DataFrame:
    """Default encoder: hashed token counts with inverse document frequency, unit norm."""
    tokens = texts.withColumn("_tokens", X.tokens(F.col(text)))
    counts = HashingTF(numFeatures=size, inputCol="_tokens", outputCol="_tf").transform(tokens)
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(counts).transform(counts)
    return weighted.withColumn("vec", V.normalise(vector_to_array("_idf"))).drop("_tokens", "_tf", "_idf")


def encode_distinct(df: DataFrame, text: str, encoder: Callable[[DataFrame], DataFrame] | Callable[[Column], Column] | None = None,
                    cached: DataFrame | None = None) -> DataFrame:
    """Adds ``vec`` to every row, encoding equal texts once.

    ``encoder`` is a function of a DataFrame with ``text`` adding ``vec`` (a pandas
    UDF over the text column is the usual body).  ``cached`` (text, vec) holds
    finished texts; only missing ones are encoded.
    """
    run = encoder or hashed_tfidf
    distinct = df.select(F.col(text).alias("text")).distinct()
    if cached is None:
        done = run(distinct).select("text", "vec")
    else:
        done = cached.select("text", "vec").unionByName(run(distinct.join(cached, "text", "left_anti")).select("text", "vec"))
    key = F.xxhash64("text")
    done = done.withColumn("_k", key).withColumnRenamed("text", "_t")
    return df.withColumn("_k", F.xxhash64(F.col(text))).join(done, ["_k"]).filter(F.col(text).eqNullSafe(F.col("_t"))).drop("_k", "_t")


def struct_vectors(df: DataFrame, keys: list[str], parts: list[str], encoder: Callable | None = None) -> DataFrame:
    """(keys, vec): vectors of several text columns joined end to end; partial coverage is an error.

    All parts are encoded in one pass over their distinct texts.
    """
    blank = F.raise_error(F.lit("a row lacks a text part")).cast("string")
    order = F.array(*[F.struct(F.lit(k).alias("part"), F.coalesce(F.col(p), blank).alias("text")) for k, p in enumerate(parts)])
    long = encode_distinct(df.select(*keys, F.inline(order)), "text", encoder)
    grouped = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "vec"))).alias("_p"))
    return grouped.select(*keys, F.flatten(F.col("_p.vec")).alias("vec"))
