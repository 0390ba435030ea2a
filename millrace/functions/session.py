"""A session for use outside a cluster: scripts, tests, the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName("millrace")
    settings = {
        "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": str(cpus), "spark.sql.adaptive.enabled": "true",
    } | conf
    spark = b.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
