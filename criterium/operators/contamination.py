"""Training texts that share an n-gram with reference texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criterium.functions.text import ngram_hashes, ngrams


def contaminated(docs: DataFrame, reference: DataFrame, key: str, n: int = 13, text: str = "text") -> DataFrame:
    """Keys of ``docs`` with an n-gram of ``reference``, and how many.

    Hashes of n-grams meet first; only texts with a hit build their n-grams as strings, which decide.
    """
    theirs = reference.select(F.explode(ngram_hashes(F.col(text), n)).alias("h")).distinct()
    hit = docs.select(key, F.explode(ngram_hashes(F.col(text), n)).alias("h")).join(theirs, "h", "left_semi").select(key).distinct()
    own = docs.select(key, text).join(hit, key, "left_semi").select(key, F.explode(ngrams(F.col(text), n)).alias("gram"))
    grams = reference.select(F.explode(ngrams(F.col(text), n)).alias("gram")).distinct()
    return own.join(grams, "gram").groupBy(key).agg(F.count(F.lit(1)).alias("shared"))


def clean(docs: DataFrame, reference: DataFrame, key: str, n: int = 13) -> DataFrame:
    return docs.join(contaminated(docs, reference, key, n), key, "left_anti")
