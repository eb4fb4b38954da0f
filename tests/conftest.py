import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def most_rows(spark):
    """A function: the rows that the busiest step of a frame's plan makes."""

    def steps(plan):
        found = plan.metrics().get("numOutputRows")
        yield found.get().value() if found.isDefined() else 0
        for i in range(plan.children().size()):
            yield from steps(plan.children().apply(i))

    def run(df):
        df._jdf.collectToPython()
        return max(steps(df._jdf.queryExecution().executedPlan()))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield run
    spark.conf.unset("spark.sql.adaptive.enabled")
