import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def most_rows(df) -> int:
    """The most rows that any step of df's plan made, after running it."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        kind, made, children = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows"), plan.children()
        most = max(most, made.get().value() if made.isDefined() else 0)
        plans += [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [children.apply(i) for i in range(children.size())]
    return most
