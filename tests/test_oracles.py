import importlib
import pkgutil

import pytest
from compare import assert_same, database

import calgraph.plans

SF = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"calgraph.plans.{m.name}") for m in pkgutil.iter_modules(calgraph.plans.__path__)]
NAMES = [(m, k) for m in MODULES for k in getattr(m, "ORACLES", {})]


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.fixture(scope="module")
def larger():
    return database("/root/testdata/sf0.01")


@pytest.mark.parametrize("module, name", NAMES, ids=[k for _, k in NAMES])
def test_query_equals_its_sql(spark, db, module, name):
    assert_same(module.QUERIES[name](spark, SF), module.ORACLES[name], db)


def test_every_query_without_sql_runs(spark):
    for m in MODULES:
        for k in getattr(m, "QUERIES", {}).keys() - m.ORACLES.keys() if hasattr(m, "QUERIES") else ():
            assert m.QUERIES[k](spark, SF).count() > 0


@pytest.mark.parametrize("module, name", NAMES, ids=[k for _, k in NAMES])
def test_sql_is_not_about_nothing(larger, module, name):
    """The SQL has rows on the given tables, so that equality says something."""
    assert larger.sql(module.ORACLES[name]).limit(1).fetchall()
