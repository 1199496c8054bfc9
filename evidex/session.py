"""Session settings and the shared scratch folder, kept in one place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Settings every operator relies on. All of them can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join followed by an aggregate on the same key is split too; the extra shuffle
    # moves pre-aggregated rows only.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Top-k windows keep k rows per group before the shuffle, so a hot group costs k rows a task.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be long texts; a Python task holds one batch at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session someone else built."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidex")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir`` or by ``setCheckpointDir``. Only in a local
    session (as in tests) that has neither is a temporary folder of this machine used; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    root = root or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="evidex-")
    return f"{root.rstrip('/')}/evidex/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Spread rows over all shuffle partitions before a step that multiplies them.

    A small input sits in few tasks, and adaptive execution merges small shuffles; neither knows that a
    row is about to become many. A stated number of partitions is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a (small) intermediate to the shared folder and read it back.

    Cuts the lineage once, survives lost executors, and gives later joins the true size.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small constant relation the optimizer can see the size of (and therefore broadcast)."""
    names = [part.strip().split(" ", 1) for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(name for name, _ in names)
    typed = ", ".join(f"cast({name} as {kind}) as {name}" for name, kind in names)
    return spark.sql(f"select {typed} from values {values} as v({columns})")
