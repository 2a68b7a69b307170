import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import empty_documents, odd_documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="session")
def empty(spark):
    return empty_documents(spark)
