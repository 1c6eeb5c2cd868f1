"""Session helpers: settings that matter here, the shared checkpoint folder, size-checked broadcast."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only below these bounds; beyond them Spark shuffles it. Tables derived from a text have at most
# one row of some forty bytes for every two characters, so the second bound holds for them too: 80 MB at most.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 4_000_000


def local_session(cores: str = "8", app: str = "attestor") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the caller's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="attestor-tables-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session that is one machine's own may do without it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"attestor-tables-{spark.sparkContext.applicationId}")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, for a stored table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back. Unlike ``checkpoint()`` the plan runs once."""
    path = new_folder(df.sparkSession, "attestor")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, text: Column | None = None) -> bool:
    """True when ``df`` is proven small. Reads at most ``BROADCAST_ROWS`` + 1 rows to find out."""
    size = F.length(text) if text is not None else F.lit(0)
    n, chars = df.select(size.alias("n")).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS


def maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df
