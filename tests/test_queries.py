"""Every registered query against its SQL twin, and the fixture's published counts."""

import pytest

import __spark_entry__ as entry_point
import oracle_check
from tabledeltas.operators import change_feed
from tabledeltas.plans import fixture as fx
from tabledeltas.plans.catalog import QUERIES
from tabledeltas.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def database(tiny):
    return oracle_check.connect(tiny)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.items() <= entry_point.queries().items()
    assert ORACLE.items() <= entry_point.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_twin(spark, database, tiny, name):
    rows, difference = oracle_check.compare(spark, database, QUERIES[name], ORACLE[name], tiny)
    assert difference is None
    assert rows > 0


def test_entry_returns_rows(spark):
    assert entry_point.entry(spark).count() == 14


# scale -> previous, latest, inserts, deletes, null-safe updates, plain updates
COUNTS = {"tiny": (12, 12, 3, 3, 8, 6), "small": (119, 120, 23, 22, 84, 63)}


@pytest.mark.parametrize("scale", COUNTS)
def test_sample_counts(spark, request, scale):
    sf_dir = request.getfixturevalue(scale)
    previous, latest = fx.sample_result(spark, sf_dir, 9), fx.sample_result(spark, sf_dir)
    n_previous, n_latest, n_inserts, n_deletes, n_updates, n_plain = COUNTS[scale]
    assert (previous.count(), latest.count()) == (n_previous, n_latest)
    for null_safe, changed in ((True, n_updates), (False, n_plain)):
        feed = change_feed(previous, latest, "userid", null_safe)
        ops = dict(feed.groupBy("op").count().collect())
        assert ops == {"I": n_inserts, "D": n_deletes, "U": changed}
