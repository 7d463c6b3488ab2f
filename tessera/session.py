"""Sessions, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: A table of at most this many slim rows may be broadcast.
BROADCAST_ROWS = 100_000
_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    guard(spark)
    return spark


def guard(spark: SparkSession) -> None:
    """Settings that results depend on.

    Spark 4.1 takes a union of equally partitioned tables to be partitioned like them; where adaptive
    execution has coalesced the sides differently, an aggregate above it then returns a key twice. The one
    setting of the user's session that this package changes, once.
    """
    if spark.conf.get("spark.sql.unionOutputPartitioning") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    _ship(spark)


def _ship(spark: SparkSession) -> None:
    """Give this package to the Python workers once a session, wherever they start."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessera-code-")  # the driver serves the archive from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{os.path.basename(here)}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    guard(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a folder of its own, removed at exit; on a cluster that
    is an error, as a folder of one machine would not survive the loss of that machine.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: lineage cuts need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_LOCAL[app]}")
    return f"file://{_LOCAL[app]}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def storage_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, whatever storage ``path`` is on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _remove(spark: SparkSession, path: str) -> None:
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        storage, target = storage_of(spark, path)
        storage.delete(target, True)
    except Exception:  # the session may have ended before; the folder's owner then cleans it
        pass


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders directly in ``folder``, sorted; none if it does not exist. Names that begin with a dot are left out."""
    storage, target = storage_of(spark, folder)
    if not storage.exists(target):
        return []
    return sorted(n for n in (s.getPath().getName() for s in storage.listStatus(target)) if not n.startswith("."))


def file_stamp(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """(path, length, time of the last change): changes when what lies there does."""
    storage, target = storage_of(spark, path)
    found = storage.getFileStatus(storage.resolvePath(target))
    return found.getPath().toString(), found.getLen(), found.getModificationTime()


def read_text(spark: SparkSession, path: str) -> str:
    storage, target = storage_of(spark, path)
    stream = storage.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` appear with its whole content at once; False, and nothing changed, if it is there already."""
    storage, target = storage_of(spark, path)
    if storage.exists(target):
        return False
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = storage.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if storage.rename(draft, target):
        return True
    storage.delete(draft, False)
    return False


def remove(spark: SparkSession, path: str) -> None:
    """Drop a table written by :func:`written` that nothing will read again."""
    _remove(spark, path)


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut the lineage with a table in the shared folder; a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    guard(spark)
    path = new_folder(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage now: only then does Spark drop the shuffles and broadcasts of jobs that are done.

    For loops of many jobs, once a turn.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    guard(spark)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
