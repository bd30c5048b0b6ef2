import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import local_session
    s = local_session(cores="*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from tidewater.sources.seed import seed_df
    names = ["regions", "categories", "warehouses", "products", "inventory", "customers", "orders",
             "order_items", "discount_codes"]
    return {n: seed_df(spark, n) for n in names}
