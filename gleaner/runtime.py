"""Session, tables, small files and lineage: what every operator shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleaner")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the session's ``spark.checkpoint.dir`` (or a checkpoint folder set on the context). Only where neither is set,
    and the session is local, a temporary folder is made.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return known or held.get()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="gleaner-")
    sc.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder, so that a lost executor costs no recomputation and values stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Tables that ``stored`` wrote and nobody has removed yet, with the session that wrote them.
_STORED: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a compact table to the shared folder and reads it back; smaller on disk than a checkpoint.

    Results may be read from it later, so it stays until ``clear_stored`` or the end of the driver.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if not _STORED:
        atexit.register(clear_stored)
    _STORED.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored() -> None:
    """Removes all tables that ``stored`` has written; what has not been read from them yet is lost."""
    while _STORED:
        spark, path = _STORED.pop()
        with contextlib.suppress(Exception):  # the session may have ended before
            remove(spark, path)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, of the kind that all executors share."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all; one that exists already is an error."""
    fs, p = _at(spark, path)
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex[:8]}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise ValueError(f"{path} exists already")
