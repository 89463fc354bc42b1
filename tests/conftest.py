import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from codefacts.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "codefacts-tests", cpus="4", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    )
    yield session
    session.stop()


FILES = "repo string, path string, content string"


@pytest.fixture(scope="session")
def make_files(spark):
    """``{path: text}`` as a files table of repository ``r``."""
    from pyspark.sql import functions as F

    def make(texts: dict[str, str], repo: str = "r"):
        df = spark.createDataFrame([(repo, p, t) for p, t in texts.items()], FILES)
        return df.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))

    return make


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
