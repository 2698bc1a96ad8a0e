import importlib
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from agrolith import plans

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def _plain(frame, floats):
    """Columns by name, exact ones as text, rows in the order of the exact columns and then of the numbers."""
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.assign(**{c: [float("nan") if pd.isna(v) else float(v) for v in frame[c]] for c in floats})
    exact = [c for c in frame if c not in floats]
    for c in exact:
        shown = frame[c].map(lambda v: "-" if pd.isna(v) else f"{v:%Y-%m-%d %H:%M:%S}" if hasattr(v, "strftime") else str(int(v)) if isinstance(v, (bool, float)) else str(v))
        frame[c] = shown.str.removesuffix(" 00:00:00").replace({"True": "1", "False": "0"})
    return frame.sort_values([*exact, *floats]).reset_index(drop=True)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, duck, sf, name):
    ours, theirs = plans.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    floats = [c for c in sorted(ours) if pd.api.types.is_float_dtype(ours[c]) or pd.api.types.is_float_dtype(theirs[c])]
    floats = [c for c in floats if ours[c].dtype.kind in "fiu" and theirs[c].dtype.kind in "fiu"]
    ours, theirs = _plain(ours, floats), _plain(theirs, floats)
    for c in ours:
        if c in floats:
            assert np.allclose(ours[c], theirs[c], rtol=1e-5, atol=2e-4, equal_nan=True), c
        else:
            assert ours[c].tolist() == theirs[c].tolist(), c


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(plans.queries())


def test_a_broken_part_is_an_error(monkeypatch):
    """An import that fails inside a part that is there must not hide its queries."""
    if entry_module.llm_queries is None:
        pytest.skip("the part is absent")
    monkeypatch.setitem(sys.modules, "agrolith.llm.queries", None)
    monkeypatch.delattr(sys.modules["agrolith.llm"], "queries")
    try:
        with pytest.raises(ImportError):
            importlib.reload(entry_module)
    finally:
        monkeypatch.undo()
        importlib.reload(entry_module)


def test_optional_parts_can_be_absent(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        module = importlib.reload(entry_module)
        assert module.corpus_pipeline is None and set(module.queries()) == set(plans.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry_module)
