"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo import files

#: Settings that the operators rely on; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # row_number() <= 5000 (postings per term) is cut before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    "spark.sql.parquet.pushdown.inFilterThreshold": "64",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("garimpo").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the session-level settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


_written: list[tuple[SparkSession, str]] = []
_endings: list[Callable[[], object]] = []


def at_end(action: Callable[[], object]) -> None:
    """Run ``action`` when the application ends, before its temporary files go."""
    _endings.append(action)


_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary
    folder only where the setting is absent and the master is one machine. It goes
    when the application ends, and the setting stays as it is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in _roots:
        _roots[name] = tempfile.mkdtemp(prefix="garimpo-")
    return "file://" + _roots[name]


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that stay in the plan, so no job is needed to make or send them."""
    if not rows:
        return spark.createDataFrame([], schema)

    def literal(value: object) -> str:
        if isinstance(value, list):
            return f"array({', '.join(map(literal, value))})"
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else "NULL" if value is None else str(value)

    table = spark.sql("VALUES " + ", ".join(f"({', '.join(map(literal, row))})" for row in rows))
    fields = [part.rsplit(" ", 1) for part in schema.split(", ")]
    return table.select(*(F.col(old).cast(kind).alias(name) for old, (name, kind) in zip(table.columns, fields)))


def temporary(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage is cut, the
    rows survive the loss of executors, and later readers prune columns. The
    files go when the application ends."""
    spark = df.sparkSession
    path = temporary(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a write, or of another action on a table made
    there, go when it ends; otherwise they stay until the driver happens to collect its
    garbage. A table made there may not be collected twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that no plan reads any more, such as
    the last generation of an iteration. Other tables are left alone."""
    path = getattr(df, "written_path", None)
    if path:
        files.remove(df.sparkSession, path)



@atexit.register
def _remove_written() -> None:
    for action in _endings:
        with contextlib.suppress(Exception):  # the session has ended
            action()
    for spark, path in _written:
        try:
            files.remove(spark, path)
        except Exception:  # the session has ended: nothing left to call
            break
    for root in _roots.values():
        shutil.rmtree(root, ignore_errors=True)
