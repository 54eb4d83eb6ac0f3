"""Every query of the catalogue, against its SQL where it has one."""

import pytest

from kinweave.plans import catalog
from tests.oracle import agree

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, name):
    agree(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_flagship_has_ranked_nodes(spark):
    rows = catalog.QUERIES[catalog.FLAGSHIP](spark, SF).collect()
    assert len(rows) == 45
    assert sum(r["rank"] == 0 for r in rows) == 1
    assert max(r["degree"] for r in rows) <= 5
    assert abs(sum(r["relevance"] for r in rows) - 1) < 1e-6


@pytest.mark.parametrize("name", ["embedding_edges", "citation_edges", "recommendation_edges"])
def test_strategies_cap_degrees(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    count = {}
    for r in rows:
        assert r["left"] < r["right"]
        for n in (r["left"], r["right"]):
            count[n] = count.get(n, 0) + 1
    assert max(count.values()) <= {"embedding_edges": 4}.get(name, 3)
