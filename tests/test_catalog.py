"""Every query with a SQL twin against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from blockloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(names, found):
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(list(v) if isinstance(v, (list, tuple)) else v)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = db.sql(catalog.ORACLES[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows(rel.columns, rel.fetchall())


def test_rdoq_never_costs_more(spark):
    for r in catalog.QUERIES["o80_rdoq"](spark, SF).collect():
        assert r.cost_after <= r.cost_before + 1e-9 and r.nonzero_after <= r.nonzero_before


def test_designed_codes_beat_the_standard(spark):
    from blockloom.operators import entropy as E

    h = E.histogram(E.symbols(catalog.levels(spark, SF)))
    own = E.average_length(h, catalog.QUERIES["o49_huff_lengths"](spark, SF).where("frame = 0").drop("frame")).where("frame = 0")
    std = E.average_length(h, E.code_table(h)).where("frame = 0")
    assert all(a.avg_len <= b.avg_len for a, b in zip(own.orderBy("class").collect(), std.orderBy("class").collect()))
