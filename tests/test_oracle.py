"""Every registered query against its DuckDB SQL on the smallest fixture."""

import pytest

from oracle_harness import compare


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_registered_queries_match_oracle(spark, sf):
    res = compare(spark, sf, verbose=False)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0
    assert "num_predictions" in df.columns
