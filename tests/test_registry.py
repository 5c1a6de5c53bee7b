"""Registered queries against their oracle on the smallest data."""

import pytest

import __spark_entry__ as registry
from check import duck, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "price_dedupe", "attribution_windows", "market_attribution", "macro_model", "style_descriptors_history",
    "promoted_prices", "filing_choice", "exposure_decisions", "event_taxonomy", "close_peers", "price_json_feed",
]


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    df = registry.queries()[name](spark, SF)
    cursor = duck(SF).execute(registry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
