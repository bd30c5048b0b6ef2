import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """(folder, documents, benchmark, labels) of the awkward corpus."""
    from corpus import corpus, write
    rows, bench, labels = corpus()
    return write(spark, str(tmp_path_factory.mktemp("awkward")), rows, bench, labels), rows, bench, labels


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """A folder with the same tables, without rows."""
    from corpus import write
    return write(spark, str(tmp_path_factory.mktemp("empty")), [], [], [])
