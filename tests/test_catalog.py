import subprocess
import sys
from pathlib import Path

import pytest
from oracle import FOLDER, assert_same

from echolattice.plans import catalog

needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLE[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).columns


def test_core_imports_without_training_data_package():
    code = "import sys; sys.modules['echolattice.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'p3_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


@needs_data
def test_rank_one_is_right(spark):
    rows = catalog.QUERIES["topk_results"](spark, FOLDER).collect()
    assert len(rows) == 40 and all(r.ref_id == r.query_id % 100 for r in rows)


@needs_data
def test_alignment_of_perturbed_queries(spark):
    rows = {r.query_id: r for r in catalog.QUERIES["match_results"](spark, FOLDER).where("rank = 1").collect()}
    for q, r in rows.items():
        kind = q // 100
        if kind == 0:
            assert r.time_factor == 1 and r.freq_factor == 1
        elif kind == 1:
            assert r.ref_start - r.query_start == 10
        elif kind == 2:
            assert abs(r.freq_factor - 2 ** (-3 / 85)) < 1e-6
        else:
            assert 0.99 <= r.time_factor <= 1.09
