"""Small helpers shared by the training-data operators.

``Scratch`` is the one place that decides where intermediate tables go: the
folder named by ``spark.checkpoint.dir``, which every executor can read.  Only a
``local`` master without that setting gets a folder of its own, as in tests.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WS = "\x20\x09\x0a\x0b\x0c\x0d"
WS_CLASS = r"[\x20\x09-\x0D]"
#: Rows of an Arrow batch are handled in slices of about this many text bytes.
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
#: Most keys that ``join_hot`` broadcasts.
HOT_KEYS = 1000


def limit_batches(spark: SparkSession) -> None:
    """Bounds Spark's Arrow batches by bytes, so that long texts come a few at a time;
    a session that set a smaller bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="glosswerk-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Parquet tables of one operator run, in a new folder below the shared one.

    A written table cuts the lineage and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{table}")
        return self.read(table, df.schema)

    def read(self, table: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{table}")

    def bucketed(self, df: DataFrame, table: str, buckets: int, column: str, sort: bool = False, dealt: bool = False) -> DataFrame:
        """A table whose rows lie in ``buckets`` files by ``column`` (and sorted by it), so
        that later grouping or joining by it moves no row.  ``dealt``: ``df`` comes from a
        grouping or join by ``column`` and is not moved either."""
        name, path = f"{table}_{uuid.uuid4().hex}", f"{self.path}/{table}"
        writer = (df if dealt else df.repartition(buckets, column)).write.bucketBy(buckets, column).option("path", path).option("compression", "zstd")
        (writer.sortBy(column) if sort else writer).saveAsTable(name)
        return self._resolved(name)

    def open_bucketed(self, table: str, schema: str, buckets: int, column: str) -> DataFrame:
        """A table that ``bucketed`` wrote sorted, in this session or an earlier one."""
        name = f"{table}_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {buckets} BUCKETS LOCATION '{self.path}/{table}'")
        return self._resolved(name)

    def _resolved(self, name: str) -> DataFrame:
        """The table as a DataFrame; only its name leaves the catalog, its files stay."""
        df = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return df

    def drop(self, *tables: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            path.getFileSystem(conf).delete(path, True)


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with ``table``, one row for each key,
    whose ``count`` is at most the number of rows with that key.

    Keys with a ``HOT_KEYS``-th of all rows or more, of which there can be ``HOT_KEYS``
    at most, are broadcast, so their rows stay where they are; the others are shuffled.
    """
    most = max(1.0, total / HOT_KEYS)
    hot, rest = F.broadcast(table.where(F.col(count) >= most)), table.where(F.col(count) < most)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``limit`` bytes in the named columns, one row at least."""
    lengths = [0] * batch.num_rows
    for c in columns:
        for i, n in enumerate(pc.binary_length(batch.column(c)).to_pylist()):
            lengths[i] += n or 0
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``own`` renamed, and the way back for
    ``withColumnsRenamed``: whatever they are called, they clash with nothing."""
    names = {c: f"__extra{k}" for k, c in enumerate(docs.columns) if c not in own}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}
