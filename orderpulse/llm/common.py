"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from ..sources.tables import read_table

#: The white space that separates words, and a word, in Java, RE2 and Python syntax alike.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"

#: Rows of an Arrow batch that become Python objects at once.
ROWS_AT_ONCE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def saved(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so later uses neither recompute it nor
    depend on executors that may be lost; in at most ``files`` files, if given.  An executor starts a
    process or two for each file that it writes to a local folder, so few rows should not fill many."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df if files is None else df.coalesce(files)).checkpoint(eager=True)


def files_for(spark: SparkSession, rows: int, per_file: int) -> int:
    """Files for ``rows`` rows of a table that follows a shuffle, whatever its partitions: one for each
    ``per_file`` rows, and not fewer than the cores, which all take part."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_file))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder, for wide rows of which later uses read some columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast.
MAX_BROADCAST_ROWS = 250_000


def lookup(df: DataFrame) -> DataFrame:
    """A saved narrow table for the right side of a join: broadcast while its counted rows are few, and
    left to a shuffle join beyond that."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that ``df`` does not use, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    """The words of a text column (null: none) as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE_CLASS}]+"), "")


def lower_ascii(text: str) -> bytes:
    """UTF-8 of ``text`` with only A-Z lowered (``bytes.lower`` leaves all other bytes alone)."""
    return text.encode("utf-8", "surrogatepass").lower()


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """``df`` through Arrow: ``make()`` runs once in a task and gives the function that turns
    each slice of a batch into the output columns.  A slice has at most ``rows_at_once`` rows (Spark
    bounds the bytes of a batch), so Python objects of one slice live at a time."""
    spark = df.sparkSession
    ship_package(spark)
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                cols = f(batch.slice(at, rows_at_once))
                yield pa.RecordBatch.from_arrays([_column(cols[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
