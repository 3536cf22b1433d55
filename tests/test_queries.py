"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from orbweave.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        oracle.same(got, con, registry.ORACLES[name])
    else:  # compared with brute force in tests of their own
        assert got.count() > 0


def test_recall_of_probed_lists(spark):
    assert registry.QUERIES["g09_vector_index_recall"](spark, SF).first().recall >= 0.9


def test_chunks_of_documents_are_bounded(spark):
    got = registry.QUERIES["i13_paragraph_chunks"](spark, SF)
    assert got.where("length(text) > 552 OR text = ''").count() == 0


def test_entry_lists_them_all(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
