import os
import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def given_prefixes() -> dict[str, str]:
    """The namespaces that the given fixtures name, by their short names; none where that file is not there."""
    text = (ROOT / "FIXTURES.md").read_text() if (ROOT / "FIXTURES.md").exists() else ""
    return dict(re.findall(r"`([A-Z]+):` = `([^`]+)`", text))


if "V" in given_prefixes():  # ids made under that namespace are tested
    os.environ.setdefault("LINKFRAME_NAMESPACE", given_prefixes()["V"])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture
def skewed(spark, tmp_path):
    """Links of which a third have one origin, in many files, and a session in which little data counts as skewed."""
    from pyspark.sql import functions as F

    conf = {"spark.sql.shuffle.partitions": "96", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k", "spark.sql.files.maxPartitionBytes": "1m"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    origin = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("o"), (F.col("id") % 20000).cast("string")))
    df = spark.range(200_000).select(F.col("id").alias("rawid"), origin.alias("origin"), F.lit("r").alias("rel"), F.lit("t").alias("target"), F.lit("2022-01-01").cast("timestamp").alias("at"))
    df.repartition(24).write.parquet(str(tmp_path / "skewed"))
    yield spark.read.parquet(str(tmp_path / "skewed"))
    for k, v in before.items():
        spark.conf.set(k, v)
