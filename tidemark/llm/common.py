"""What the operators of this folder share: table access, lineage cuts and text as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a task works on at once, whatever the size of an Arrow batch.
PIECE_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


class Scratch:
    """Tables in the shared folder, so that a lost executor loses nothing; dropped with their files at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name, self.count = spark, f"scratch_{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{folder(self.spark)}/{self.name}'")
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")

    def keep(self, df: DataFrame) -> DataFrame:
        """df computed once, as a table of this block."""
        self.count += 1
        table = f"{self.name}.t{self.count}"
        df.write.format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """The distinct rows of df, computed once, as a table in buckets of the key, which joins and groupings by it need not shuffle again."""
        self.count += 1
        table, n = f"{self.name}.t{self.count}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, key).distinct().write.format("parquet").bucketBy(n, key).saveAsTable(table)
        return self.spark.table(table)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of so many rows at most while the block runs, for stages whose rows carry whole sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept(df: DataFrame) -> DataFrame:
    """df computed once, as files in the shared folder that stay there like those of a checkpoint. For results; what an operator needs only on its way goes to a Scratch."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z folded. Texts of ASCII only, which have as many bytes as characters, go the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Tables for crc32_sql in DuckDB's SQL, after WITH RECURSIVE; a query that uses it has crc_table in its FROM.
CRC_TABLE = """crc_bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS v FROM crc_bits WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text in DuckDB's SQL."""
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce({each}, lambda c, x: xor(c >> 8, v[(xor(c, x) & 255) + 1]), 4294967295::BIGINT))"


def sampled(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """The n ids of smallest hash, the same on each run, with the least of each column; a repeated doc_id counts once, a null one not."""
    ids = df.where("doc_id is not null").groupBy("doc_id").agg(*(F.min(c).alias(c) for c in cols)) if cols else df.where("doc_id is not null").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (distinct rows with a doc_id, few enough to send to every task), each with the least text that docs has of its doc_id; so there are no more rows than chosen has, however often an id is repeated."""
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(*chosen.columns).agg(F.min("text").alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `limit` bytes of text (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
        ends, start = np.cumsum(size), 0
        while start < len(size):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and the place where each begins (and the last ends)."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the row it is in."""
    full = ~_SPACE[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = full[inner]
    last = full.copy()
    last[:-1] &= ~full[1:]
    last[inner - 1] = full[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A 64-bit value for each byte value.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_ODD, _ODD_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """64-bit hashes of byte ranges in constant time each: differences of sums of byte values times powers."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_FOLD[data]] * powers(_ODD, len(data)), out=self.sums[1:])
        self.back = powers(_ODD_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of A-Z folded to a-z; equal bytes have equal hashes wherever they stand."""
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
