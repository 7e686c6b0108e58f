from __future__ import annotations

import os
import sys
import tempfile
from datetime import date

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronoframe.session import local_session  # noqa: E402

TYPES = {
    "s": pa.string(), "d": pa.date32(), "f": pa.float64(), "l": pa.int64(),
    "i": pa.int32(), "b": pa.bool_(), "t": pa.timestamp("us"),
}


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")
    session = local_session(
        "4",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
            "spark.checkpoint.dir": f"{folder}/shared",
            "spark.sql.maxMetadataStringLength": "1000",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Small typed frame: ``frame("ticker:s trade_date:d", [rows])``; ISO texts become dates."""

    def build(spec: str, rows):
        names, kinds = zip(*(part.split(":") for part in spec.split()))
        columns = []
        for position, kind in enumerate(kinds):
            values = [row[position] for row in rows]
            if kind == "d":
                values = [date.fromisoformat(v) if isinstance(v, str) else v for v in values]
            columns.append(pa.array(values, TYPES[kind]))
        return spark.createDataFrame(pa.table(dict(zip(names, columns))))

    return build


@pytest.fixture
def rows():
    """Rows as sorted tuples."""

    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in chosen.collect()), key=repr)

    return collect
