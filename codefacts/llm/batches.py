"""Batches of texts that go to Python workers are bounded by bytes, not only by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: rows and bytes of a batch, at most; a single longer row is a batch of its own
ROWS, BYTES = 1000, 16 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded; smaller settings stay as they are."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = str(conf.get(key)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df
