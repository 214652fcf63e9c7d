import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tillroll.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    yield s


def rows(df, *cols):
    """Collected rows as tuples, sorted, for order-free comparison."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
