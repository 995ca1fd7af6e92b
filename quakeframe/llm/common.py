"""What the operators of this subpackage share: scratch tables, size-checked joins, words."""

from __future__ import annotations

import re
import sys
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts UTF-8 text exactly so.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of a table that a join may broadcast, at most; parts that a row's partners are dealt over where the table is larger.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 16


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local mode; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing else uses it."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables made inside when done: for a step whose result has been written elsewhere."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        del _made[before:]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    This cuts the lineage: what is computed later survives the loss of the executors that computed it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def _hashable(value: Column, kind: DataType) -> Column:
    """A value with its maps as entries in the order of their keys, at any depth."""
    if "map<" not in kind.simpleString():
        return value
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(_hashable(e["key"], kind.keyType).alias("key"), F.xxhash64(_hashable(e["value"], kind.valueType)).alias("value"), e["value"].isNull().alias("none")))
        return F.array_sort(entries)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _hashable(x, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*[_hashable(value[f"`{f.name}`"] if "." in f.name else value[f.name], f.dataType).alias(f.name) for f in kind.fields]))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row: rows with one id and one hash are copies of each other. Maps are hashed by their entries in order."""
    return F.xxhash64(*[_hashable(c, f.dataType) for c, f in zip(columns_of(df), df.schema.fields, strict=True)])


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table has at most ``rows`` rows and about ``size`` bytes; it is read as far as ``rows`` only."""
    varying = [c for c, f in zip(columns_of(df), df.schema.fields, strict=True) if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    width = F.lit(8 * len(df.columns))
    for c in varying:
        width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a stored table) marked for broadcast if its rows and bytes are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with a stored ``table`` of one row for each ``key``, of which one may hold a third of ``rows``.

    A small table is broadcast. A larger one is repeated for each of SALTS parts, and rows are dealt to the parts by
    the task that reads them, so that no task gets all rows of a key.
    """
    if is_small(table):
        return rows.join(F.broadcast(table), key, how)
    parts = table.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return rows.withColumn("_salt", F.spark_partition_id() % SALTS).join(parts, [key, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` (a stored table) with ``rank`` (from 0, in the order, nulls first) and ``of`` (rows) within each ``group``, a column without nulls.

    Rows are dealt by ranges of the order, ties by the place where they lie, so that no group and no value need fit one
    task; what is summed over the parts is a count for each part and group. Rows that tie get ranks in any order.
    """
    keys = [group, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.drop("_tie").withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), name)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    runs = runs.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("of"))
    return placed.join(small(stored(runs, f"{name}-runs")), [group, "_part"]).withColumn("rank", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def fold(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(name).cast("string")) % modulus


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = 2_000_000) -> Iterator[tuple[dict[str, list], list[str]]]:
    """Cut Arrow batches into pieces of about ``chars`` characters, at whole rows: the other columns as lists, and the texts (null: empty)."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != column]
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for end, size in enumerate(sizes, 1):
            total += size
            if total >= chars or end == len(sizes):
                piece = batch.slice(start, end - start)
                yield {n: piece.column(n).to_pylist() for n in names}, [t or "" for t in piece.column(column).to_pylist()]
                start, total = end, 0


def words_of(text: str) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def _class(chars: Iterable[int]) -> str:
    """Code points as ranges of a character class."""
    out: list[list[int]] = []
    for c in chars:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out)


_KINDS = [unicodedata.category(chr(c)) for c in range(0x20000)]  # beyond are ideographs, which are letters, and variation selectors, which cut words
_MARKS = [c for c, k in enumerate(_KINDS) if k[0] == "M"]
_NUMBERS = [c for c, k in enumerate(_KINDS) if k in ("Nl", "No")]
_PLAIN = re.compile(r"[^\W\d_]+")
_WHOLE = re.compile(rf"(?:[^\W\d_{_class(_NUMBERS)}]+[{_class(_MARKS)}]*)+")
_ODD = re.compile(f"[{_class(c for c in sorted(_MARKS + _NUMBERS) if c < 0x10000)}\U00010000-\U0010FFFF]")


def letters_in(text: str) -> re.Pattern[str]:
    """The pattern of runs of letters (Unicode categories L) with their combining marks; a plainer, faster one for texts without marks and without numbers such as a half."""
    return _PLAIN if text.isascii() or not _ODD.search(text) else _WHOLE
