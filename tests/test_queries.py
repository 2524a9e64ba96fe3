"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from corpusloom import plans

HOME = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{HOME}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
        return round(float(x), 9)
    return x


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, HOME)
    names = sorted(got.columns)
    rows = sorted([tuple(plain(r[c]) for c in names) for r in got.collect()], key=str)
    if name in plans.ORACLE_SQL:
        want = duck.execute(plans.ORACLE_SQL[name])
        have = [d[0] for d in want.description]
        assert sorted(have) == names
        order = [have.index(c) for c in names]
        assert rows == sorted([tuple(plain(r[i]) for i in order) for r in want.fetchall()], key=str)
    else:
        assert rows


def test_entry(spark):
    flagship = __spark_entry__.entry(spark)
    assert flagship.columns == ["a", "b", "n_groups", "groups", "cooccurrence"] and flagship.count()
    assert set(plans.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_training_data_operators():
    import pathlib
    import re

    root = pathlib.Path(plans.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text()), path
