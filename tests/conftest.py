import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for folder in (ROOT, os.path.join(ROOT, "tests")):
    if folder not in sys.path:
        sys.path.insert(0, folder)

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def pytest_configure(config):
    """Column expressions at module level need a running session."""
    from textprep.session import local_session

    config.spark = local_session("8")


@pytest.fixture(scope="session")
def spark(pytestconfig):
    return pytestconfig.spark


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def one(spark):
    """Evaluate a column over literal inputs: one(expression, x="text", ...)."""
    from pyspark.sql import functions as F

    def run(expression, **inputs):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
        value = row.select(expression.alias("value")).first()["value"]
        return value

    return run
