"""Every registered query with SQL gives DuckDB's rows; every other one runs."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from helpers import duck, rows
from tidemark.operators import models
from tidemark.plans import catalog
from tidemark.plans.catalog import ORACLES, QUERIES

HEAVY = {"elasticnet_oos", "gbt_oos", "dfm_factor_recursive"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    assert rows(df.toPandas()) == rows(duck(small, ORACLES[name]))
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - HEAVY))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_real_time_factor_has_every_month(spark, small):
    got = sorted(r["date"] for r in QUERIES["dfm_factor_recursive"](spark, small).collect())
    months = [d.year * 12 + d.month for d in got]
    assert len(got) > 1 and months == list(range(months[0], months[0] + len(got)))
    last = max(r["date"] for r in catalog._inputs(spark, small).select("date").distinct().collect())
    assert got[-1] == last


def test_models_search_the_whole_grid(spark, small, monkeypatch):
    seen = {}
    monkeypatch.setattr(models, "elastic_net", lambda **kw: seen.update(kw))
    monkeypatch.setattr(models, "boosted_trees", lambda **kw: seen.update(kw))
    monkeypatch.setattr(catalog, "_oos", lambda *args: None)
    QUERIES["elasticnet_oos"](spark, small), QUERIES["gbt_oos"](spark, small)
    assert seen == {"n_alphas": 40, "rounds": 300}


def test_entry_and_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(QUERIES) > 50


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["asof_date", "series", "value", "yoy", "z"] and df.count() > 0


def test_only_the_missing_part_is_left_out(tmp_path):
    """Without the corpus operators the entry works; without something that they need it fails."""
    root = Path(entry.__file__).parent
    code = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print(len(e.queries()))"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(name)], cwd=root, capture_output=True, text=True)
    assert int(run("tidemark.llm").stdout) == len(QUERIES)
    if (root / "tidemark" / "llm").exists():
        assert "regex" in run("regex").stderr and run("regex").returncode
