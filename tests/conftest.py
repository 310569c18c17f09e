import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fleetseries.session import local_session

    s = local_session("*", shuffle_partitions=8)
    yield s


def rows(df, *cols, order=None):
    """Collect a small test result as a list of tuples (sorted)."""
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in (order(t) if order else t)))
