import os

from arbora.operators.rejects import split_row
from arbora.streaming.lines import stream_counts, stream_rows
from tests.side_by_side import SF


def _stream(spark, folder):
    lines = spark.read.parquet(f"{SF}/conllu_lines.parquet")
    lines.write.parquet(folder)
    return lines, spark.readStream.schema(lines.schema).parquet(folder)


def _rows(df, spark, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_rows_of_a_stream(spark, tmp_path):
    lines, stream = _stream(spark, os.path.join(tmp_path, "in"))
    got = {(r.file_name, r.line_number): r.reason for r in _rows(stream_rows(stream, "4000 days"), spark, "rows_in", "append")}
    stored = {(r.file_name, r.line_number): r.line_text for r in lines.collect() if (r.line_text or "").strip() and not r.line_text.startswith("#")}
    assert set(got) == set(stored)
    assert all((split_row(text)[1] is None) == (got[key] not in ("columns", "quoting")) for key, text in stored.items())


def test_counts_of_a_stream(spark, tmp_path):
    lines, stream = _stream(spark, os.path.join(tmp_path, "in"))
    got = _rows(stream_counts(stream, "1 day", "4000 days"), spark, "days_in", "complete")
    assert sum(r.lines for r in got) == lines.count() and len(got) > 1
