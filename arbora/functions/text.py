"""Column functions on words and texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from arbora.functions.vocabulary import LABEL_BASE

#: White space as Python's str.split has it; the JVM's \s knows less.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words(text: Column) -> Column:
    """The parts of a text between white space; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def is_opening(form: Column) -> Column:
    """Whether every character is an opening bracket or quote; an empty form is none."""
    return form.rlike(r"^[\p{Ps}\p{Pi}]+$")


def label_base(label: Column) -> Column:
    """The base of a known label or subtype; null for any other, so that unknown subtypes are not taken for their base."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_BASE.items() for x in pair])
    return F.try_element_at(known, label)


def token_estimate(text: Column) -> Column:
    """About two and a half code points a token, at least one; null for null."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2.5).cast("int"))


def joined_digest(*parts: Column) -> Column:
    """SHA-256 over the parts, each followed by NUL, so that no two lists of parts run together; null counts as empty."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\0"))]), 256)


def mention_id(sent_id: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", sent_id, start.cast("string"), end.cast("string"))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """NFC, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(BooleanType())
def is_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.is_normalized("NFC", t))
