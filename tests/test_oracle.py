"""Every query: its plan, then its rows against DuckDB's (or at least some rows)."""

import re

import pytest

from rostrum import bindings
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = bindings.queries(), bindings.oracle_sql()
# Pair sums and the lines of quoted CSV run in Arrow batches; fits have plans of their own.
ARROW = {"corr_matrix", "corr_table", "corr_rank", "cohort_correlations", "survey_correlations",
         "survey_pairs", "corr_tiles", "talk_files", "vector_files", "score_files"}
FITS = {"pca2", "rbf_holdout", "forest_holdout", "cv_scores", "scaled", "pca_checks", "forest_rows", "cohort_projection",
        "pca_wide", "projection", "ridge_holdout"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def check_plan(name, text):
    """No Python on the main paths, no cross joins, no window over a whole table but
    the one over range counts."""
    if name not in ARROW | FITS:
        assert not re.search("Python|MapInPandas|ArrowEval", text)
    if name not in FITS:
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
        for line in text.splitlines():
            if "Window [" in line and re.search(r"windowspecdefinition\(\w+#\d+L? (ASC|DESC)", line):
                assert "_range#" in line and "_n#" in line


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_and_rows(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    check_plan(name, df._jdf.queryExecution().executedPlan().toString())
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.collect()


def test_worked_levels(spark):
    rows = bindings.queries()["popularity_levels"](spark, "/root/testdata/sf0.01").collect()
    cells = {(r["views_level"], r["comments_level"]): r["n"] for r in rows}
    assert cells["low", "low"] == 194 and cells["medium", "medium"] == 7218
    assert cells["high", "high"] == 20 and cells["medium", None] == 167
