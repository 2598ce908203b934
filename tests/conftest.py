import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from cutline.session import build_session

    return build_session("local[8]", 4)


@pytest.fixture()
def plan():
    """Spans without any cut: every window is the plain one."""
    from cutline.operators.spans import Spans

    return lambda df, keys, order: Spans(tuple(keys), order)
