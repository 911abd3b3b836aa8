"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
#: Rows that a Python function holds as objects at a time.
SLICE = 256
#: Rows of an Arrow batch.
BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing a local master uses a temporary folder; on a
    cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("tidemark.scratch", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("tidemark.scratch", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, keeping the partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; Arrow batches of its session hold ``BATCH`` rows at most.

    Texts are long, so the default of ten times as many rows keeps tens of
    megabytes in several copies on both sides of each Python worker.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return df


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a variant of it that no column of ``df`` has yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def join_hot(rows: DataFrame, values: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", most: int = 10_000, least: int = 100) -> DataFrame:
    """``rows`` joined with ``values`` (a row per key) on keys that may be very frequent.

    ``size`` names the column of ``values`` with the number of ``rows`` of the
    key, and ``total`` is the number of all rows.  Keys of more than
    total / ``most`` rows are at most ``most``, whatever the data, so they are
    broadcast and their rows stay where they are; the others are shuffled and
    none is large.  ``how`` is ``inner``, ``left`` or ``left_semi``; ``values``
    is read three times.
    """
    hot = F.col(size) > max(least, total // most)
    few = F.broadcast(values.filter(hot).drop(size))
    rest = rows.join(few.select(*keys), keys, "left_anti")
    return rows.join(few, keys, "inner" if how == "left" else how).unionByName(rest.join(values.filter(~hot).drop(size), keys, how))


def find_spread(rows: DataFrame, values: DataFrame, keys: list[str], size: str, most: int, hottest: int = 10_000) -> DataFrame:
    """``rows`` whose ``keys`` (longs, the first two at least) are in ``values``, in one pass over ``rows``.

    ``size`` names the column of ``values`` (a row per key, written) with the
    number of rows that may have the key.  Up to ``most`` keys are broadcast.  Of
    more, those with over a ``hottest``-th of all sizes are, ``hottest`` at most
    whatever the data: rows that they settle go on under a key of their own,
    which no value has, and so are dealt evenly; the others are shuffled.
    """
    n, total = values.agg(F.count(F.lit(1)), F.sum(size)).first()
    if n <= most:
        return rows.join(F.broadcast(values.select(*keys)), keys, "left_semi")
    hot = F.col(size) > total // hottest
    flag = free_name(rows, "_hot")
    marked = rows.join(F.broadcast(values.filter(hot).select(*keys, F.lit(True).alias(flag))), keys, "left")
    lone = [F.when(F.col(flag), F.xxhash64(*[F.col(c) for c in rows.columns])).otherwise(F.col(keys[0])), *[F.when(F.col(flag).isNull(), F.col(k)) for k in keys[1:]]]
    own = [free_name(rows, f"_key{i}") for i in range(len(keys))]
    rest = values.filter(~hot).select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.lit(True).alias(f"{flag}_rest"))
    dealt = marked.withColumns({f"{o}_": c for o, c in zip(own, lone)})
    same = [F.col(f"{o}_") == F.col(o) for o in own]
    return dealt.join(rest, same, "left").filter(F.col(flag) | F.col(f"{flag}_rest")).select(*[F.col(f"`{c}`") for c in rows.columns])


def words_of(text: Column) -> Column:
    """Array of the space-separated words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def map_rows(
    df: DataFrame,
    inputs: list[str],
    schema: str,
    make: Callable[[], Callable[..., Iterable[tuple]]],
    keep: list[str] | None = None,
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """Apply a per-row Python function in Arrow batches.

    ``make()`` runs once in each task and returns a function of lists (one for
    each name in ``inputs``) that yields one tuple of new columns per row.  The
    columns in ``keep`` pass through untouched; text arrives as bytes.  A new
    column whose name is among them gets trailing underscores.  ``finish()``
    runs at the end of each task, also if it fails.
    """
    keep = df.columns if keep is None else keep
    added = df.sparkSession.createDataFrame([], schema).schema
    kept = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    used = list(dict.fromkeys([*keep, *inputs]))
    taken = {c.lower() for c in keep}
    for f in added.fields:
        while f.name.lower() in taken:
            f.name += "_"
    names = [f.name for f in added.fields]
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(start, SLICE)
                    table = dict(zip(used, batch.columns, strict=True))
                    lists = []
                    for c in inputs:
                        col = table[c]
                        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                            col = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
                        lists.append(col.to_pylist())
                    rows = list(work(*lists))
                    arrays = [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([table[c] for c in keep] + arrays, names=[*keep, *names])
        finally:
            if finish:
                finish()

    return small_batches(df).select(*[F.col(f"`{c}`") for c in used]).mapInArrow(run, StructType(kept.fields + added.fields))
