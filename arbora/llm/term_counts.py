"""How often every distinct term occurs and in how many records, by heavy-light aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.storage import materialize

#: A term is heavy if it may fill more than this share of the rows: at most 1/HEAVY_SHARE terms of a field.
HEAVY_SHARE = 0.005
#: Longer terms count as light, however frequent: so what is broadcast has a fixed bound. They are counted as exactly.
HEAVY_CHARS = 500
#: Positions of a record that may meet in one value.
RECORD_ROWS = 1024

_COUNTS = "field_name string, term string, occurrences bigint, records bigint"


def heavy_values(rows: DataFrame, fields: list[str]) -> dict[str, list]:
    """All values with more than HEAVY_SHARE of the rows (and perhaps a few others), found in one pass of
    bounded counters; at most 1/HEAVY_SHARE values for each field."""
    found = rows.select(*[F.substring(f, 1, HEAVY_CHARS + 1).alias(f) for f in fields]).stat.freqItems(fields, HEAVY_SHARE).first()
    return {f: [t for t in values or [] if t is not None and len(t) <= HEAVY_CHARS] for f, values in zip(fields, found)}


class _Counters:
    """Exact counts of one task over whole records: an array slot for each heavy term, and what each batch says of the others."""

    def __init__(self, fields: list[str], heavy: list[dict[str, int]]) -> None:
        self.fields, self.heavy = fields, heavy
        self.occurrences = [np.zeros(len(h), np.int64) for h in heavy]
        self.records_with = [np.zeros(len(h), np.int64) for h in heavy]
        self.records = 0

    def add(self, rows: pa.ListArray) -> Iterator[tuple]:
        """Counts a batch of records, each the list of its rows; gives (field, terms, occurrences, records) of the light terms."""
        self.records += len(rows)
        of = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
        each = rows.flatten()
        for k, field in enumerate(self.fields):
            encoded = each.field(f"f{k}").dictionary_encode()
            code, words = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False), encoded.dictionary.to_pylist()
            there = code >= 0
            occurrences = np.bincount(code[there], minlength=len(words))
            pairs = np.unique(of[there] * max(1, len(words)) + code[there])
            records = np.bincount(pairs % max(1, len(words)), minlength=len(words))
            slot = np.fromiter((self.heavy[k].get(w, -1) for w in words), np.int64, len(words))
            np.add.at(self.occurrences[k], slot[slot >= 0], occurrences[slot >= 0])
            np.add.at(self.records_with[k], slot[slot >= 0], records[slot >= 0])
            light = np.flatnonzero(slot < 0)
            yield field, encoded.dictionary.take(pa.array(light)), occurrences[light], records[light]

    def total(self) -> Iterator[tuple]:
        """Counts of the heavy terms, and of the records as the null field."""
        for k, field in enumerate(self.fields):
            seen = np.flatnonzero(self.occurrences[k])
            yield field, pa.array(list(self.heavy[k]), pa.string()).take(pa.array(seen)), self.occurrences[k][seen], self.records_with[k][seen]
        yield None, pa.nulls(1, pa.string()), np.zeros(1, np.int64), np.array([self.records])


def _batch(field: str | None, terms: pa.Array, occurrences: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([field] * len(terms), pa.string()), terms.cast(pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["field_name", "term", "occurrences", "records"])


def count_terms(rows: DataFrame, fields: list[str], record: str, position: str) -> tuple[DataFrame, int]:
    """((field_name, term, occurrences, records) for every distinct non-null value of ``fields``, number of records).

    A term is a value exactly as stored; the empty text is one, null is none. Rows that repeat
    (record, position) with the same content count once. Rows with a null record count as
    occurrences but lie in no record. An empty table gives no rows and no records.

    Rows meet once, by record, repeats pre-aggregated before. Heavy terms, broadcast, are then
    counted in arrays in place and leave a task as one row each; only the other terms are
    shuffled, pre-aggregated, and both count tables are united. Records with positions beyond
    RECORD_ROWS, and rows without record or position, do not meet in one value: they are
    pre-aggregated by record and term. A (record, position) is taken to have few different contents.
    No cap: all parts are exact.
    """
    values = heavy_values(rows, fields)
    shared = rows.sparkSession.sparkContext.broadcast([{t: k for k, t in enumerate(values[f])} for f in fields])
    content = [f"f{k}" for k in range(len(fields))]
    each = rows.select(F.col(record).alias("r"), F.col(position).alias("p"), *[F.col(f).cast("string").alias(c) for f, c in zip(fields, content)])
    within = F.col("r").isNotNull() & F.coalesce(F.col("p").between(0, RECORD_ROWS - 1), F.lit(False))
    apart = each.filter(~within)
    together = each.filter(within)
    if not apart.isEmpty():
        long = materialize(apart.select("r").filter("r is not null").distinct(), "long")
        apart = apart.unionByName(together.join(long, "r", "left_semi"))
        together = together.join(long, "r", "left_anti")
    else:
        apart = None

    def local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = _Counters(fields, shared.value)
        for batch in batches:
            for part in counters.add(batch.column(0)):
                yield _batch(*part)
        for part in counters.total():
            yield _batch(*part)

    records = together.groupBy("r").agg(F.collect_set(F.struct("p", *content)).alias("rows"))
    parts = records.select("rows").mapInArrow(local_counts, _COUNTS)
    if apart is not None:
        none = F.lit(None).cast("string")
        terms = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(c).alias("term")) for f, c in zip(fields, content)], F.struct(none.alias("field_name"), none.alias("term"))))
        met = apart.distinct().select("r", terms.alias("t")).filter("t.term is not null or t.field_name is null").groupBy("r", "t.field_name", "t.term").agg(F.count("*").alias("occurrences"))
        parts = parts.unionByName(met.select("field_name", "term", "occurrences", F.col("r").isNotNull().cast("bigint").alias("records")))
    counted = materialize(parts.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")), "terms")
    total = counted.filter("field_name is null").first()
    return counted.filter("field_name is not null"), total["records"] if total else 0


def mark_terms(counts: DataFrame, n_records: int) -> DataFrame:
    """Adds ``mark``: ``rare`` in at most 2 records or 1 in 10,000, else ``common`` in more than 11 of 20, else null."""
    n = F.col("records")
    return counts.withColumn(
        "mark", F.when((n <= 2) | (n * 10000 <= n_records), "rare").when(n * 20 > n_records * 11, "common")
    )
