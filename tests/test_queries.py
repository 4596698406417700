"""Every query outside the language-model subpackage against its SQL."""

from __future__ import annotations

import pytest

from tests.conftest import rows_of
from tidewire.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir, duck):
    got = registry.queries()[name](spark, sf_dir)
    if name not in SQL:
        assert got.count() >= 0
        return
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(want.columns)
    assert rows_of(got) == sorted(tuple(__import__("tests.conftest", fromlist=["plain"]).plain(v) for v in r) for r in duck.sql(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({SQL[name]})").fetchall())


def test_registry_names_agree():
    assert set(SQL) <= set(registry.queries())
