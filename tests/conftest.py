import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pricetide.session import session

    s = session("local[4]", 4, **{"spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/pricetide-warehouse", "spark.checkpoint.dir": "/tmp/pricetide-checkpoints"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def table(spark):
    """A small table: table("a int, b string", (1, "x"), ...)."""
    return lambda schema, *rows: spark.createDataFrame([*rows], schema)


@pytest.fixture
def mapped(spark):
    """The values of an expression over texts: mapped(f, "a", "b")."""
    from pyspark.sql import functions as F

    def run(f, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[0] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").select("v").collect()]

    return run
