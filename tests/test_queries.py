"""Registered queries against their SQL twins. By default a fast spread over the groups; COVERLENS_ALL=1 runs every one."""

import os

import oracle
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FAST = ["mission_endpoints", "recovery_curve", "cumulative_coverage", "targets_found", "evidence_weights", "posterior", "explode_trace", "regret_summary", "validate_pairs", "paired_contrasts",
        "summary_table_levels", "wilcoxon_paired", "mann_whitney", "friedman", "cluster_bootstrap", "attrition_gate", "focal_score", "rasterize", "feature_weights", "read_runs"]
SF = os.environ.get("COVERLENS_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("COVERLENS_ALL") else FAST)
def test_query_matches_sql(spark, duck, name):
    assert oracle.compare(spark, duck, SF, name, queries()[name], oracle_sql().get(name)) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_registry():
    assert len(queries()) > 150 and set(oracle_sql()) <= set(queries())
