"""Session settings, lineage cuts and the size checks that guard broadcasts and grouped work."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

# A group larger than this never goes through one task as a whole.
WINDOW_GROUP_ROWS = 1_000_000
# Data handed to every executor stays below this.
BROADCAST_BYTES = 128 * 1024 * 1024


def local_session(app: str = "listwarden", cpus: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="listwarden-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    The result is fixed on disk, so a lost executor can neither lose it nor change it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, row_group_bytes: int | None = None) -> DataFrame:
    """Write a table as Parquet in the shared folder and read it back: columns stay apart and keep their statistics."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write if row_group_bytes is None else df.write.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/table-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A table of numbers and arrays of numbers, to be broadcast in joins if all of it stays below ``limit`` bytes.

    Rows that look something up in it then stay where they are, however wide they have become. A larger table comes back
    as it is. The size is that of its rows with arrays as long as the longest; BROADCAST_BYTES is the limit by default.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    width = F.lit(16)
    for field in df.schema:
        width = width + (F.coalesce(F.max(F.size(field.name)), F.lit(0)) * 8 + 24 if isinstance(field.dataType, ArrayType) else F.lit(8))
    n, row_bytes = df.agg(F.count(F.lit(1)), width).first()
    return F.broadcast(df) if n * row_bytes <= limit else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by one key, for joins and groups by it and by it with others: none of them deals its rows again.

    From now on the session takes rows dealt out by part of a join's keys as they are; no result changes.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(key)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_by_group_size(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Separate the groups one task can hold from the ones it cannot.

    Only group sizes are computed (counted map-side first). The second frame is None when no group
    exceeds ``limit``; the list of large groups has at most rows / limit entries.
    """
    names = {k: f"_group{i}" for i, k in enumerate(keys)}
    large = df.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > limit).select(*names.values())
    n_large = large.count()
    if n_large == 0:
        return df, None
    side = F.broadcast(large) if n_large <= WINDOW_GROUP_ROWS else large
    # A group whose key is null is a group like others.
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.join(side, same, "left_anti"), df.join(side, same, "left_semi")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per application, in local mode too: they may start elsewhere."""
    sc = spark.sparkContext
    if getattr(sc, "_listwarden_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="listwarden-")) / "listwarden.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._listwarden_shipped = True
