"""Every registered query: against its SQL where it has one, else that it runs."""

import math

import pytest

from fieldgrain.plans import registry

from .conftest import DATA


def plain(frame):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x

    return sorted(map(repr, ([one(x) for x in r] for r in frame[sorted(frame.columns)].astype(object).values.tolist())))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_runs_without_the_optional_parts(spark, monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def missing(name, *a):
        if name.startswith(("fieldgrain.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_recovers_known_shares(spark):
    import __spark_entry__ as entry

    rows = {r.g: r for r in entry.entry(spark).collect()}
    assert all(rows[g].bimodal for g in rows if g.startswith("line-"))
    assert not any(rows[g].bimodal for g in rows if g.startswith("event-"))
