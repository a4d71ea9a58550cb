"""Every registered query against its oracle SQL on the smallest data folder."""

from pathlib import Path

import pytest

from __spark_entry__ import SMALL, entry, oracle_sql, queries
from check_queries import compare, connect

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test data is absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


#: Queries without oracle SQL, with the reason; everything else must equal its oracle and have rows.
PACKED = "whole packed frames and their ids; the parts have oracles or brute-force tests"
NO_ORACLE = {
    "audit_commentary": "all rules at once; every rule has a query of its own",
    "capability_plan": PACKED,
    "chart_findings": "sentences; the numbers in them have oracles",
    "chart_labels": "compatibility normalisation of Unicode, which DuckDB lacks",
    "chart_observations": PACKED,
    "evidence_ranking": PACKED,
    "evidence_sections": PACKED,
    "file_catalog": "hashes of the files themselves; file_formats compares the formats",
    "finding_chart_rows": PACKED,
    "insights": PACKED,
    "insufficient_warnings": PACKED,
    "measure_catalog": PACKED,
    "metric_definitions": PACKED,
    "number_redaction": "a token pattern that DuckDB's engine cannot express",
    "profile_approximate": "sketches, compared within an error bound in tests",
    "profile_summaries": PACKED,
    "recommended_evidence": PACKED,
    "report_package": PACKED,
    "row_digest_value": "a 64-bit hash DuckDB lacks; row_digest compares digests",
    "story_groups": PACKED,
    "support_rows": PACKED,
}
MAY_BE_EMPTY = {n for n in queries() if n.endswith(("problems", "unknown", "warnings"))}
#: Queries of the corpus operators are tested beside them.
NAMES = [n for n in sorted(queries()) if n != "pipeline" and not (n.startswith("op") and n[2:3].isdigit())]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    problem = compare(spark, duck, SMALL, name)
    if name in NO_ORACLE:
        assert problem.startswith("no oracle ("), problem
    else:
        assert problem is None or problem == "equal but EMPTY" and name in MAY_BE_EMPTY, problem
