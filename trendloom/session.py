"""Session helpers: reading tables, spreading small inputs, cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the executors are this machine (tests) a temporary folder is taken and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="trendloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/trendloom-{kind}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    fs.delete(p, True)
    return fs.makeQualified(p).toString()  # with the scheme, for readers that don't know Spark's default


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as parquet to the shared folder and read again.

    This cuts the lineage and survives the loss of executors; unlike ``localCheckpoint`` no block
    lives only on one executor, and unlike ``checkpoint`` the rows are kept columnar and compressed.
    """
    path = own_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Partitions for a stage in Python: adaptive execution joins shuffled ones by bytes, which leaves cores idle."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, a scan, in at least as many partitions as there are cores.

    A table of one small file comes as one partition, which would leave a Python stage on one core.
    At scale the scan already has more partitions than cores and nothing is shuffled.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(parts(spark), *keys)


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench on this machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("trendloom")
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("TRENDLOOM_DRIVER_MEMORY", "8g"), "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffle join).

    The count stops at ``rows + 1`` rows, so a large table isn't read through.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``name``: the place of each row in the order of the columns ``order``, from 1.

    Rows are divided by ranges and sorted within them; the driver sees one count for each partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    x = materialise(ranged.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted((r[0], r[1]) for r in x.groupBy("__part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before += [F.lit(part), F.lit(total)]
        total += n
    offset = F.create_map(*before)[F.col("__part")] if before else F.lit(0)
    return x.withColumn(name, (F.col("__at") + offset + 1).cast("bigint")).drop("__at", "__part")
