"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed by the contract: white space is the blank and U+0009 to U+000D, nothing else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

#: Rows that one call of a task function holds as Python objects.
SLICE_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder.  A lost executor does not lose the rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only in local mode, where it is unset (tests), a temporary folder.

    On a cluster without it this is an error: executors would write to their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table as Parquet in the shared folder and reads it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: A key with more rows than this is hot: its row of the other table is sent to all tasks.
HOT_ROWS = 10_000


def join_by_weight(rows: DataFrame, table: DataFrame, key: str, weight: str, hot: int = HOT_ROWS) -> DataFrame:
    """Joins ``rows`` with ``table`` (one row a key, which knows in ``weight`` how many of ``rows`` have it), without ``weight``.

    Hot keys are at most one in ``hot`` of the rows: what is broadcast is that much smaller than what isn't
    moved, and no task gets more than ``hot`` rows of one key.  Both tables should be cut: they're read twice.
    """
    few = F.broadcast(table.filter(F.col(weight) > hot).drop(weight))
    rest = table.filter(F.col(weight) <= hot).drop(weight)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels must never be learnt from (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def without(df: DataFrame, names) -> DataFrame:
    """Drops extra columns whose names clash (in any case) with those an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def boxed(df: DataFrame, *more: str) -> DataFrame:
    """The whole row as one struct ``boxed_row``, and the columns an operator works on beside it.

    Operators that give rows back as they came use it: no extra column can clash with theirs.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("boxed_row"), *more)


def add_columns(df: DataFrame, inputs: list[str], schema: str, make: Callable, drop: tuple = ()) -> DataFrame:
    """Appends the columns of ``schema``, computed from ``inputs`` by the function that ``make()`` gives.

    ``make`` runs once in each task (to load tables and start caches); its function takes one list
    for each input and returns one list or Arrow array for each new column.  All other columns pass
    through as Arrow buffers.  Clashing extra columns are replaced.  ``drop`` names input columns
    that the result leaves out.
    """
    new = T.StructType.fromDDL(schema)
    gone = {c.lower() for c in drop}
    replaced = {f.name.lower() for f in new} - {c.lower() for c in inputs}
    df = without(df, replaced)
    kept = [f for f in df.schema if f.name.lower() not in gone | {x.name.lower() for x in new}]
    out = T.StructType([*kept, *new])
    keep_names, new_types = [f.name for f in kept], [f.type for f in to_arrow_schema(new)]
    names = out.names

    def run(batches):
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = f(*[part.column(c).to_pylist() for c in inputs])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep_names]
                    + [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, new_types, strict=True)],
                    names=names,
                )

    return df.mapInArrow(run, out)
