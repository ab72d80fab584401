"""Keyed layouts and the queries over the supplied tables."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from rasterloom.functions import keys
from rasterloom.plans import core_queries, file_queries

QUERIES, ORACLES = {**core_queries.QUERIES, **file_queries.QUERIES}, {**core_queries.ORACLES, **file_queries.ORACLES}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_stream_vector():
    assert keys.keystream(bytes(32), bytes(12), 0, 2).astype("<u4").tobytes()[:16].hex() == "76b8e0ada0f13d90405d6ae55386bd28"


def test_hkdf_vector():
    okm = keys.hkdf(b"\x0b" * 22, bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


@given(st.binary(min_size=1), st.integers(1, 20), st.integers(1, 20), st.sampled_from([0, 2, 3, 8, 2 | keys.TRANSFORMS, 4 | keys.TRANSFORMS]))
def test_layout_is_a_permutation(key, width, height, block):
    order = keys.layout(key, b"salt", width, height, "block" if block else "pixel", block)
    assert sorted(order.tolist()) == list(range(width * height))


def test_layouts_differ_by_key_and_frame():
    a, b, c = (keys.layout(k, b"", 16, 16, frame=f) for k, f in ((b"a", 0), (b"b", 0), (b"a", 1)))
    assert not np.array_equal(a, b) and not np.array_equal(a, c)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    assert Counter(map(tuple, df.select(cols).collect())) == Counter(want.select(",".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
