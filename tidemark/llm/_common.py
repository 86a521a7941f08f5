"""What the text operators share: shared working storage, Arrow batch mapping and word ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word's characters: everything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names.

    Where that is unset, a session within this process (tests, a notebook) gets a
    temporary folder of its own; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage; the copy outlives any executor.
    """
    return Scratch(df.sparkSession).write(df)


class Scratch:
    """Working tables of one job in the shared folder, dropped when they are no longer read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        """The table written as Parquet and read again; see :func:`materialise`."""
        path = shared_dir(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables; without any, all that are left."""
        for table in tables or [t for _, t in self.paths.values()]:
            delete(self.spark, self.paths.pop(id(table))[0])


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


#: Rows that become Python objects at a time.
SLICE = 1_000


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``SLICE`` rows, so that what is made of texts stays small beside them."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]],
    schema: str,
) -> DataFrame:
    """Apply a function to Arrow batches inside the tasks, ``SLICE`` rows at a time.

    ``make`` is called once per task and returns the function, so that caches and
    tables live as long as the task. The function returns columns by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in sliced(batches):
            yield pa.RecordBatch.from_pydict(work(part))

    return df.mapInArrow(run, schema)


class WordIds(dict):
    """Word (bytes) to a 64-bit id that does not depend on the process."""

    def __init__(self, limit: int = 500_000, strip: bytes | None = None) -> None:
        super().__init__()
        self.limit, self.strip = limit, strip

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        core = (word.strip(self.strip) or word) if self.strip else word
        value = self[word] = xxhash.xxh3_64_intdigest(core)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-case A to Z and split at ASCII white space; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of the result depend on all of ``x``."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the hold-out rule."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def sample(rows: DataFrame, most: int, id_col: str) -> DataFrame:
    """About ``most`` of the rows, drawn by hash of the id; all of them if there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / n)))
