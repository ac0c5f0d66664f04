"""Arrow batches in and out of Python workers, and materialisation in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lodeline.session import checkpointed, shared_folder

#: Rows and bytes in an Arrow batch of whole texts; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 26
#: Bytes of text that numpy kernels treat at once; a longer text is treated alone.
BLOCK_BYTES = 1 << 19


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    # the driver serves the file from here to the executors, so it goes when the driver ends
    folder = Path(tempfile.mkdtemp())
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    packed = folder / f"{root.name}.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(packed))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes per Arrow batch where they are higher, and see that workers have this package."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(key).lower()
        if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


materialise = checkpointed


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in a folder of their own in the shared folder, for intermediate results that are read more than once.

    Any executor can read them again, they are compressed, and their sizes are
    known to the planner. As a context it deletes the folder in the end, when
    what is kept must have been materialised.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        drop_folder(self.spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def free(name: str, df: DataFrame) -> str:
    """The name, or with underscores before it if ``df`` has such a column in whatever case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def spans(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about BLOCK_BYTES; a longer text is a range of its own."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        if i > low and held + len(text or b"") > BLOCK_BYTES:
            yield low, i
            low, held = i, 0
        held += len(text or b"")
    if texts:
        yield low, len(texts)


def by_text(
    df: DataFrame,
    columns: list[str],
    text: str,
    schema: str,
    run: Callable[[list[pa.Array], list[bytes | None]], list[pa.Array]],
) -> DataFrame:
    """Apply ``run`` to blocks of rows: it gets the other columns and the texts as UTF-8 and returns the columns of ``schema``.

    Only ``columns`` and ``text`` are read, so further columns of ``df``, whatever
    their names, are neither scanned nor sent to Python. A null text arrives as None.
    """
    bound_batches(df.sparkSession)
    names = StructType.fromDDL(schema).fieldNames()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(columns))
            first = 0
            while first < batch.num_rows:
                last, held = first, 0
                values = []
                while last < batch.num_rows and (last == first or held < BLOCK_BYTES):
                    values.append(texts[last].as_py())
                    held += len(values[-1] or b"")
                    last += 1
                out = run([batch.column(i).slice(first, last - first) for i in range(len(columns))], values)
                yield pa.RecordBatch.from_arrays(out, names)
                first = last

    picked = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).cast("binary").alias("t"))
    return picked.mapInArrow(blocks, schema)


def map_rows(df: DataFrame, text: str, run: Callable[[list[bytes | None]], tuple[list[bool] | None, list[bytes | None] | None]]) -> DataFrame:
    """Rows of ``df`` with all their columns, some dropped or with another text, without a shuffle.

    ``run`` gets the UTF-8 texts of a block and returns which rows stay (None:
    all) and their new texts (None: as they are), both in the block's order.
    """
    bound_batches(df.sparkSession)
    at = df.columns.index(text)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            first = 0
            while first < batch.num_rows:
                last, held = first, 0
                values: list[bytes | None] = []
                while last < batch.num_rows and (last == first or held < BLOCK_BYTES):
                    value = texts[last].as_py()
                    values.append(None if value is None else value.encode())
                    held += len(values[-1] or b"")
                    last += 1
                stay, fresh = run(values)
                out = batch.slice(first, last - first)
                if fresh is not None:
                    columns = list(out.columns)
                    columns[at] = pa.array([None if t is None else t.decode() for t in fresh], texts.type)
                    out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                if stay is not None:
                    out = out.filter(pa.array(stay, pa.bool_()))
                yield out
                first = last

    return df.mapInArrow(blocks, df.schema)
