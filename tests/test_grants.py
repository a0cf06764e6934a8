"""Queries over grants: how their orders meet spaces."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from quillmark import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name, tables", [("check_tables", 4), ("purge_expired", 1)])
def test_orders_are_dealt_by_place_in_every_table_of_grants(spark, name, tables):
    """No join compares places after it has paired an order with all spaces of its tenant, in one task for each tenant."""
    plan = catalog.queries()[name](spark, str(DATA))._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"Join \[([^\]]*)\], \[([^\]]*)\], Inner(.*)", plan)
    assert sum("place#" in right for _, right, _ in joins) >= tables
    assert not [rest for _, _, rest in joins if "place#" in rest]
    spark.catalog.clearCache()
