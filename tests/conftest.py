from __future__ import annotations

import glob
import os
from pathlib import Path

import duckdb
import pytest

from tidewire.runtime import build_session

DATA = os.environ.get("TIDEWIRE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, memory="4g", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not Path(DATA).exists():
        pytest.skip(f"no test tables in {DATA}")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value as text that both engines agree on."""
    if value is None or value != value:
        return "NULL"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return f"{float(value):.9g}"
    return str(value)


def rows_of(df, columns=None) -> list[tuple]:
    """Sorted rows of a Spark frame or of a pandas one, columns by name."""
    names = sorted(columns or df.columns)
    got = df.select(*[f"`{n}`" for n in names]).collect() if hasattr(df, "collect") else df[names].astype(object).itertuples(index=False, name=None)
    return sorted(tuple(plain(None if str(v) in ("NaT", "<NA>") else v) for v in r) for r in got)
