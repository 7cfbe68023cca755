"""Every registered query against its DuckDB oracle on the whole sf0.001 tables
(the driver repeats this at sf0.01)."""

import pytest

from conftest import SMALL_SF
from fleetlens.plans.oracle_check import compare
from fleetlens.plans.registry import operators, oracle_sql, queries

NAMES = sorted(queries())


def test_every_operator_is_registered():
    ids = set()
    for op in operators().values():
        ids.update(op.split("+"))
    expected = ({f"S{i}" for i in range(1, 8)} | {f"F{i}" for i in range(1, 7)} |
                {f"J{i}" for i in range(1, 9)} | {f"A{i}" for i in range(1, 10)} |
                {f"W{i}" for i in range(1, 6)} | {"O1", "O2"} | {"U1", "U2", "U3"} |
                {f"X{i}" for i in range(1, 12)} | {f"Q{i}" for i in range(1, 5)} |
                {f"T{i}" for i in range(1, 6)} | {"M1"})
    assert expected <= ids, sorted(expected - ids)


def test_every_query_has_an_oracle():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_small, name):
    ok, msg = compare(spark, name, SMALL_SF, duck_small)
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["cluster", "state", "masters", "slaves", "nodes"]
    assert len(rows) > 0
    assert [r.cluster for r in rows] == sorted(r.cluster for r in rows)
