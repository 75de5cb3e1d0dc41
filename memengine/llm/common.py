"""What the operators share: the shared folder, written tables and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch where several operators' workers live beside each other.  A single larger row is a batch of its own.
ARROW_BYTES = 4 << 20
#: Lists that note the intermediate tables made just now, as (kind, place); see noted().  Each thread has its own.
_NOTING: ContextVar[tuple[list[tuple[str, str]], ...]] = ContextVar("noting", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the session names none and runs in one process (local tests) a
    temporary folder is made and set; a cluster must name it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="memengine-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let an Arrow batch hold ARROW_BYTES at most, from now on in this session: a worker and its executor hold several, and thousands of texts are tens of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for own in _NOTING.get():
        own.append(("path", path))
    out = spark.read.schema(df.schema).parquet(path)
    out.made = [("path", path)]
    return out


def saved(df: DataFrame, name: str, bucket: str, buckets: int | None = None) -> DataFrame:
    """Write df as a table in buckets by one column, so that joins and windows by it move only the other side.

    Its files lie in the shared folder; the catalogue only knows the place.  Without `buckets` there are as many as shuffle partitions.  A caller that has dealt df
    by the same column into as many partitions gets one file a bucket."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("path", path).bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), bucket).saveAsTable(name)
    made = [("table", name), ("path", path)]
    for own in _NOTING.get():
        own.extend(made)
    out = spark.table(name)
    out.made = made
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete what written() or saved() made for these frames: nothing may read them any more."""
    for df in frames:
        for kind, place in getattr(df, "made", ()):
            _delete(df.sparkSession, kind, place)


def _delete(spark: SparkSession, kind: str, place: str) -> None:
    if kind == "table":
        spark.sql(f"DROP TABLE IF EXISTS {place}")
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def noted() -> Iterator[list[tuple[str, str]]]:
    """Within it, intermediate tables are noted in the list given; clear() deletes them once their consumer is written."""
    own: list[tuple[str, str]] = []
    token = _NOTING.set((*_NOTING.get(), own))
    try:
        yield own
    finally:
        _NOTING.reset(token)


def clear(spark: SparkSession, made: list[tuple[str, str]]) -> None:
    while made:
        _delete(spark, *made.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integral(df: DataFrame, column: str) -> None:
    """Ids of these operators are whole numbers; say so early instead of failing in a task."""
    if df.schema[column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{column} must be a whole number, not {df.schema[column].dataType.simpleString()}")


def sampled(rows: DataFrame, seed: int, max_rows: int, max_bytes: int) -> list:
    """At most max_rows of rows (id, text binary, ...) and max_bytes of text, by the hash of the id, as Row objects.

    Ids and lengths come to the driver first; only the texts that fit follow.  Rows of equal id and text count once."""
    rows = rows.withColumns({"print": F.xxhash64("text"), "place": F.xxhash64(F.lit(seed), "id")})
    thin = rows.select("place", "id", "print", F.octet_length("text").alias("n")).distinct().orderBy("place", "id", "print").limit(max_rows).collect()
    chosen, used = [], 0
    for x in thin:
        if used + x["n"] <= max_bytes:
            chosen.append((x["id"], x["print"]))
            used += x["n"]
    if not chosen:
        return []
    ids = rows.sparkSession.createDataFrame(chosen, rows.select("id", "print").schema)
    return rows.join(F.broadcast(ids), ["id", "print"], "left_semi").dropDuplicates(["id", "print"]).orderBy("place", "id", "print").collect()


def held(column: str, modulus: int, remainder: int) -> F.Column:
    """True where crc32(id as text) mod modulus equals remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under fixed names, so that extra columns of the caller can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
