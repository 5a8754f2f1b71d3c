import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import FOLDER, assert_same  # noqa: E402

from echolattice.llm.queries import ORACLE, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    # a model fitted on half of the smallest tables' five judgements promises nothing
    assert_same(spark, QUERIES[name], ORACLE[name], FOLDER.replace("0.001", "0.01") if name == "p9_held_out" else FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
