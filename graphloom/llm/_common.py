"""What the training-data operators share: column picking, the shared folder, Arrow access to whole texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, the first of each name by its exact spelling, whatever else the table has."""
    have = df.columns
    flat = df.toDF(*(f"_c{i}" for i in range(len(have))))
    return flat.select(*(F.col(f"_c{have.index(n)}").alias(n) for n in names))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder as a full URI: spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(base)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    uri = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri.rstrip("/")


#: Folders of this process that hold intermediate results, by application.
_WRITTEN: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's URI under the shared one; release() deletes it."""
    path = f"{checkpoint_root(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(uri)


def stored(df: DataFrame, tag: str, *done: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    done: stored tables that nothing reads any more once this one is written; they are deleted.
    """
    path = shared_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for old in done:
        discard(old)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Deletes what this application's operators still hold in the shared folder, after their results have been used."""
    paths = list(_WRITTEN.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _delete(spark, path)
    return len(paths)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make() returns, stored; all else that it wrote to the shared folder on the way is deleted."""
    before = set(_WRITTEN.get(spark.sparkContext.applicationId, ()))
    out = stored(make(), tag)
    for path in _WRITTEN[spark.sparkContext.applicationId] - before - {out._stored_at}:
        _delete(spark, path)
    return out


#: A key with more than 1 in SHARES of all rows is joined by broadcast: there are fewer than SHARES of them.
SHARES = 1000


def join_spread(rows: DataFrame, side: DataFrame, keys: list[str], n: str, total: int, *spread: str) -> DataFrame:
    """rows left-joined to side (keys, n, others), one row a key, n the rows of `rows` that have it of `total` in all.

    Keys that hold a large share of the rows are fewer than SHARES, so they are broadcast; their rows then take part in
    the shuffle under a salt that matches nothing, a hash of the columns `spread`, so any repeated task deals them alike.
    """
    others = [c for c in side.columns if c not in (*keys, n)]
    hot = side.where(F.col(n) * SHARES > total)
    mark = lambda df, tag: df.select(*keys, F.lit(True).alias(f"_{tag}"), *(F.col(c).alias(f"_{tag}_{c}") for c in others))
    salt = F.when(F.col("_h"), F.pmod(F.xxhash64(*spread), F.lit(1 << 30)) + 1).otherwise(F.lit(0).cast("long"))
    out = rows.join(F.broadcast(mark(hot, "h")), keys, "left").withColumn("_salt", salt)
    out = out.join(mark(side.where(F.col(n) * SHARES <= total), "c").withColumn("_salt", F.lit(0).cast("long")), [*keys, "_salt"], "left")
    return out.select(*rows.columns, *(F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in others))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Writes under another name and moves into place, so that a repeated task leaves one whole file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """Each whole text as UTF-8; null is empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, each word's number in turn, and where each text's words begin (one entry more).

    A-Z are lower-cased; words are what ASCII white space parts.  '' stands for white space at either end of a text.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to so many rows at most, so that a worker's memory doesn't grow with their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_of_id(name: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
