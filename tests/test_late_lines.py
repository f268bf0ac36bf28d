import datetime as dt
import os

from arbora.streaming.lines import stream_counts, stream_rows
from tests.test_streaming import _rows

SCHEMA = "file_name string, line_number bigint, line_text string, loaded_at timestamp_ntz"
ROW = "{0}\ta\t_\tNOUN\t_\t_\t0\troot\t_\t_"
#: Lines by the days that they were loaded on, in the order of arrival: far behind, without a time, repeated.
BATCHES = [[(1, 300), (2, 300)], [(3, 300)], [(4, 20), (5, 1), (1, 2)], [(6, None), (7, 310), (3, 310), (8, 5)]]


def _stream(spark, folder):
    for k, batch in enumerate(BATCHES):
        rows = [("f", n, ROW.format(n), day and dt.datetime(2024, 1, 1) + dt.timedelta(day)) for n, day in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        for file in os.listdir(folder):
            if file.endswith(".parquet") and not file.startswith("b"):
                os.rename(f"{folder}/{file}", f"{folder}/b{k}.parquet")
                os.utime(f"{folder}/b{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_no_line_of_several_batches_is_lost_and_repeats_are_dropped(spark, tmp_path):
    got = _rows(stream_rows(_stream(spark, f"{tmp_path}/in")), spark, "late_rows", "append")
    assert sorted(r.line_number for r in got) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_complete_counts_hold_every_line_with_a_time(spark, tmp_path):
    got = _rows(stream_counts(_stream(spark, f"{tmp_path}/in")), spark, "late_counts", "complete")
    assert sum(r.lines for r in got) == sum(day is not None for batch in BATCHES for _, day in batch)
