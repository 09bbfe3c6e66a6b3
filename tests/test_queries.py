"""Every registered query with SQL agrees with it on the smallest tables."""

import os
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
from quillpanel.plans import panel_checks, panel_queries, reference_queries  # noqa: E402

from . import oracle  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no tables")
#: These need more than the smallest tables hold (a split in time with both sides).
SMALL = {"m1_chronological_split", "m2_scaler", "m5_folds", "m6_m8_baselines", "m9_shrunk_ranker", "m14_stored_predictions", "s4_best_model", "f4_model_ranking", "g17_psi", "d10_drift_psi", "g20_metrics_pivot"}
CASES = [(n, m.QUERIES[n], m.ORACLE[n]) for m in (reference_queries, panel_queries, panel_checks) for n in m.ORACLE if n not in SMALL]


@pytest.fixture(scope="module")
def con():
    return oracle.tables(duckdb)


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_agrees(spark, con, name, query, sql):
    oracle.check(spark, con, query, sql)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_does_not_need_the_text_package():
    code = (
        "import sys; sys.modules['quillpanel.llm'] = None\n"
        "import __spark_entry__ as e, quillpanel.plans.cli, quillpanel.streaming.ingest\n"
        "assert 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
