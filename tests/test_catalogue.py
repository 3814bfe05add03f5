"""Every query of the library's own gives what its SQL gives."""

import importlib.util

import pytest

from bitloom.plans import catalogue
from tests.helpers import connect, content

NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    got = catalogue.queries()[name](spark, data).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is not None:
        assert content(got) == content(duck.execute(sql).df())
    else:
        assert len(got.columns)


def test_entry_point():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    with_llm = importlib.util.find_spec("bitloom.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None
    assert any(n.startswith("op1_") for n in e.queries()) == with_llm


def test_sql_names_are_queries():
    assert set(catalogue.oracle_sql()) <= set(NAMES)
