"""Records that are the same but for whitespace, letter case, punctuation and stored order."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from arbora.storage import materialize

#: Stands for a missing sent_id, which equals only another missing one.
_MISSING = "\0"
#: Stands before every sent_id, so that an empty one is a value too.
_SENT = "\1"


@lru_cache(maxsize=65536)
def _counts(c: str) -> bool:
    return not c.isspace() and not unicodedata.category(c).startswith("P")


def canonical(value: str) -> str:
    """Without whitespace, punctuation and letter case; marks, digits and unseen characters stay."""
    return "".join(filter(_counts, value.casefold()))


@F.pandas_udf(StringType())
def _canonical(values: pd.Series) -> pd.Series:
    """The mark of a sent_id stays in front."""
    return values.map(canonical)


def record_keys(records: DataFrame) -> DataFrame:
    """(record_id, key) with ``key`` the record's sent_id and forms, by idx, as integers.

    Every distinct stored value is canonicalised once and gets the integer of its canonical
    text; records are rewritten by looking the integers up. Forms that become empty, and null
    forms, are left out; a null sent_id equals only null. Null or missing tokens make a record of
    its sent_id alone. A repeated record_id counts once. No record is left out but those without record_id.
    """
    once = records.filter("record_id is not null").select("record_id", F.coalesce("sent_id", F.lit(_MISSING)).alias("sent_id"), F.col("tokens.idx").alias("idx"), F.col("tokens.form").alias("form"))
    if not once.groupBy("record_id").count().filter("count > 1").isEmpty():
        once = materialize(once.dropDuplicates(["record_id"]), "once")
    marked = F.concat(F.lit(_SENT), "sent_id")
    values = once.select(F.explode(F.concat(F.array(marked), F.coalesce("form", F.array().cast("array<string>")))).alias("value")).filter("value is not null")
    values = materialize(values.distinct().withColumn("canonical", _canonical("value")).withColumn("id", F.monotonically_increasing_id()), "values")
    # the integer of a canonical text is the least number of the values that have it
    dictionary = values.filter("canonical <> ''").select("value", F.min("id").over(W.partitionBy("canonical")).alias("code"))
    forms = once.select("record_id", F.explode(F.arrays_zip("idx", "form")).alias("c")).select("record_id", F.col("c.idx").alias("position"), F.col("c.form").alias("value"))
    cells = forms.unionByName(once.select("record_id", F.lit(-(2**31)).alias("position"), marked.alias("value")))
    coded = cells.join(dictionary, "value")
    return coded.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("position", "code"))).alias("t")).select(
        "record_id", F.transform("t", lambda x: x["code"]).alias("key")
    )


def same_groups(keys: DataFrame) -> DataFrame:
    """(key, first_record_id, copies), one row per group of same records, also of one."""
    return keys.groupBy("key").agg(F.min("record_id").alias("first_record_id"), F.count("*").alias("copies"))


def members(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """(first_record_id, record_id) of every record that is not the first of its group."""
    repeated = groups.filter("copies > 1").select("key", "first_record_id")
    return keys.join(repeated, "key").filter("record_id <> first_record_id").select("first_record_id", "record_id")
