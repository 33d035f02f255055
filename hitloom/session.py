"""Session settings and the shared work folder."""

import tempfile

from pyspark.sql import SparkSession

# Runtime settings the plans rely on. The long CASE chains of the classifiers compile to methods above
# 8000 bytes, which HotSpot never compiles; with this limit Spark splits them instead.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for tables written between steps: the cluster's ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder of this machine.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hitloom-"))
        shared = sc.getCheckpointDir()
    return shared.rstrip("/")
