"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where ``spark.checkpoint.dir`` is unset, as in tests on one machine.
LOCAL_CHECKPOINT_DIR = os.path.join(tempfile.gettempdir(), "codequarry-checkpoints")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_codequarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="codequarry-")) / "codequarry.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._codequarry_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; one Parquet file or folder per table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``, else a local one."""
    return spark.conf.get("spark.checkpoint.dir", None) or "file://" + LOCAL_CHECKPOINT_DIR


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable: the shared folder named in the
    session's ``spark.checkpoint.dir``, else a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    Used where a result is read more than once (a Python stage must not run
    twice) and between the rounds of iterative operators.
    """
    ship(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def make_session(cpus: int = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and ``bench.py``; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("codequarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in ({"spark__checkpoint__dir": "file://" + LOCAL_CHECKPOINT_DIR} | conf).items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
