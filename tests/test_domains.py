"""Domains of e-mail addresses, which principals are matched by."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import scalars as X

CASES = {
    "u1@d1.example": "d1.example",
    "a@b@c": "b",
    "a@@b": None,
    "a@": None,
    "@b": None,
    "  @b": None,
    " a@b ": "b ",
    "a\n@ä.example": "ä.example",
    "no sign": None,
    "": None,
    None: None,
}


def _rows(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "n int, mail string")


def test_domains_of_odd_addresses(spark):
    by_parts = F.when(F.instr(F.btrim("mail"), "@") > 1, F.nullif(F.split_part("mail", F.lit("@"), F.lit(2)), F.lit("")))
    rows = _rows(spark).select("mail", X.email_domain(F.col("mail")).alias("domain"), by_parts.alias("by_parts")).collect()
    assert {r["mail"]: r["domain"] for r in rows} == CASES
    assert all(r["domain"] == r["by_parts"] for r in rows)


def test_no_pattern_is_compiled_for_a_row(spark):
    """Joins push the domain down to all users, several times a row."""
    plan = _rows(spark).filter(X.email_domain(F.col("mail")) == "b")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "substring_index" in plan and "split" not in plan
