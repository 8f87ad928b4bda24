"""Session settings, table access and scratch tables shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent

#: Tables that a data folder holds, one Parquet file or folder each.
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "siltworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Spark's reader opens it, so any path that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt to several tasks for each core by hash of columns, for steps that take much longer than their few rows take to read: a table of a few MB is one or
    two splits of its scan, and adaptive execution joins small partitions unless their number is given."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *columns)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset a local session uses a temporary folder, and any other one raises: its
    executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


_scratch: list[tuple[SparkSession, str]] = []
_owners: dict[str, str] = {}
_local = threading.local()


@contextmanager
def owning_scratch(owner: str, check: Callable[[], None]) -> Iterator[None]:
    """While it holds, scratch tables of this thread belong to owner, and check() is called before each of them; it may raise to end the work."""
    _local.owner, _local.check = owner, check
    try:
        yield
    finally:
        _local.owner = _local.check = None


def drop_scratch_of(owner: str) -> None:
    """Delete the scratch tables of an owner, half-written ones too."""
    for spark, path in list(_scratch):
        if _owners.get(path) == owner:
            _forget(spark, path)


def _remember(spark: SparkSession, path: str) -> None:
    _scratch.append((spark, path))
    if getattr(_local, "owner", None):
        _owners[path] = _local.owner


def _forget(spark: SparkSession, path: str) -> None:
    _scratch.remove((spark, path))
    _owners.pop(path, None)
    _delete(spark, path)


def scratch(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write df as Parquet under the shared checkpoint folder and read it back: lineage ends here,
    so a lost executor costs a reread, not a recomputation. Removed at exit or by drop_scratch()."""
    if getattr(_local, "check", None):
        _local.check()
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/siltworks-{tag}-{uuid.uuid4().hex}"
    _remember(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltworks_path = path
    return out


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared checkpoint folder for files that tasks write themselves; removed like scratch tables."""
    path = f"{checkpoint_root(spark)}/siltworks-{tag}-{uuid.uuid4().hex}"
    _remember(spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def drop_scratch(*frames: DataFrame) -> None:
    """Delete the scratch tables behind frames (all of them without arguments)."""
    paths = {getattr(f, "_siltworks_path", None) for f in frames}
    for spark, path in list(_scratch):
        if not frames or path in paths:
            _forget(spark, path)


def scratch_paths() -> frozenset[str]:
    """The scratch tables there are now, for drop_scratch_since()."""
    return frozenset(path for _, path in _scratch)


def drop_scratch_since(before: frozenset[str], *kept: DataFrame) -> None:
    """Delete the scratch tables that are not in before, but for those behind kept."""
    paths = before | {getattr(f, "_siltworks_path", None) for f in kept}
    for spark, path in list(_scratch):
        if path not in paths:
            _forget(spark, path)


atexit.register(drop_scratch)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when their PYTHONPATH does not reach it."""
    parent = str(PACKAGE_ROOT.parent)
    reach = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if parent in reach or os.getcwd() == parent or os.path.exists(os.path.join(os.getcwd(), PACKAGE_ROOT.name)):
        return
    context = spark.sparkContext
    if getattr(context, "_siltworks_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "siltworks_pkg.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for path in PACKAGE_ROOT.rglob("*.py"):
            bundle.write(path, path.relative_to(PACKAGE_ROOT.parent))
    context.addPyFile(str(archive))
    context._siltworks_shipped = True
