"""Spellings of language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def language_names(languages: DataFrame) -> DataFrame:
    """(key, lang): every lower-case code or name of a language and the label to put out; fixed table, one row a key."""
    names = languages.select("lang", F.explode(F.array("lang", "iso3", "lang_name")).alias("key"))
    return names.where("key is not null").groupBy(F.lower(F.trim("key")).alias("key")).agg(F.min("lang").alias("lang"))
