"""Figures of an answer that its sources do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions.scalars import number_tokens, number_value


def numbers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """H9: distinct values of the numbers of each text with the first form and place: key, value, raw, pos."""
    found = texts.select(key, F.posexplode(number_tokens(F.coalesce(text, F.lit("")))).alias("pos", "raw"))
    d = found.withColumn("raw", F.rtrim(F.trim("raw"), F.lit(","))).withColumn("value", number_value("raw")).where("value is not null")
    return d.groupBy(key, "value").agg(F.min(F.struct("pos", "raw")).alias("x")).select(key, "value", "x.raw", "x.pos")


def flagged(a: DataFrame, c: DataFrame, key: str, ignore_below: float = 10) -> DataFrame:
    """Of the :func:`numbers` of answers those of which the absolute value is not among the numbers of their
    contexts; whole numbers under ``ignore_below`` are passed over."""
    a = a.withColumn("size", F.abs("value")).where(~((F.col("size") < ignore_below) & (F.col("size") == F.floor("size"))))
    c = c.select(key, F.abs("value").alias("size")).distinct()
    return a.join(c, [key, "size"], "left_anti").select(key, "raw", "value", "pos")


def unverified(answers: DataFrame, contexts: DataFrame, key: str, text: str = "text", ignore_below: float = 10) -> DataFrame:
    """The flagged numbers of each answer (by key) given with its context; an answer without context has all its
    numbers flagged."""
    return flagged(numbers(answers, key, text), numbers(contexts, key, text), key, ignore_below)
