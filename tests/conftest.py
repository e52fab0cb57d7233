import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sensorium.session import TASK_ROWS_DEFAULT, TASK_ROWS_KEY, local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


@pytest.fixture
def blocks(spark):
    """Set the most rows a task may hold, to send operators through their block paths."""

    def limit(rows):
        spark.conf.set(TASK_ROWS_KEY, str(rows))

    yield limit
    spark.conf.set(TASK_ROWS_KEY, str(TASK_ROWS_DEFAULT))


@pytest.fixture(scope="session")
def frame(spark):
    """Long readings with one tag that holds a third of all rows, ties and missing values."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for tag, n in (("hot", 120), ("a", 80), ("b", 80), ("c", 75), ("short", 4), ("one", 1)):
        value = np.round(rng.normal(50, 10, n), 1)
        value[rng.random(n) < 0.05] = np.nan
        parts.append(pd.DataFrame({"tag": tag, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "row_index": np.arange(n), "value": value}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf["value"] = pdf["value"].astype(object).where(pdf["value"].notna(), None)
    rows = list(pdf[["ts", "row_index", "tag", "value"]].itertuples(index=False, name=None))
    rows = [(r[0].to_pydatetime(), int(r[1]), r[2], r[3]) for r in rows]
    return spark.createDataFrame(rows, "ts timestamp_ntz, row_index long, tag string, value double")
