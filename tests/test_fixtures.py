"""Forms of derived tables that only Spark runs."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from quillmark.plans.fixtures import DERIVED, SPARK_FORMS, Tables

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(SPARK_FORMS))
def test_forms_have_the_rows_of_the_stated_tables(spark, name):
    t = Tables(spark, str(DATA))
    stated, own = t.sql(DERIVED[name]), t[name]
    assert own.columns == stated.columns and own.count() == stated.count() > 0
    assert own.exceptAll(stated).isEmpty() and stated.exceptAll(own).isEmpty()
    spark.catalog.clearCache()


def test_an_order_meets_its_space_by_key(spark):
    """The place is a key of a join, so no order is paired with all spaces of its tenant."""
    plan = Tables(spark, str(DATA))["all_grants"]._jdf.queryExecution().sparkPlan().toString()
    keys = re.findall(r"Join \[(.*?)\], \[(.*?)\]", plan)
    assert any("place#" in right for _, right in keys)
    spark.catalog.clearCache()
