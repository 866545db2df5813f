"""Shared plumbing of the training-data operators: tables, shared storage, column hygiene."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from ..sources.storage import new_path

#: Bytes that separate words in the white-space word contracts: blank and \t \n \v \f \r.
_SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their workers can import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_mosaica_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp(prefix="mosaica-"))
    with zipfile.ZipFile(where / "mosaica-package.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(where / "mosaica-package.zip"))
    context._mosaica_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so a lost executor costs no recomputation."""
    return storage.stored(df, what, "zstd")


def from_files(df: DataFrame) -> bool:
    """Whether df's rows are read from files, row by row, so that they come alike and in order each time."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast; extra columns go, whatever their names."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8. bytes.split() splits at just these bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()


__all__ = ["fresh", "from_files", "map_batches", "new_path", "only", "ship", "stored", "table", "words"]
