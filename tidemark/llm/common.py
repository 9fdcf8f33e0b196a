"""What the operators share: a place for intermediate tables, and Arrow plumbing."""

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, and tab to carriage return. bytes.split() cuts at exactly these.
BLANK = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without it, as in tests, gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs nothing."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """The intermediate tables of one operation, in the shared folder. clear() deletes them, but for those to keep."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def of(self, name: str) -> list[DataFrame]:
        return [df for df, path in self.paths if path.rpartition("/")[2].startswith(f"{name}-")]

    def clear(self, *keep: DataFrame) -> None:
        """Only for tables that nothing reads any more: what was made of them must itself be written."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df, path in self.paths:
            if not any(df is k for k in keep):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        self.paths = [x for x in self.paths if any(x[0] is k for k in keep)]


#: The largest filter, 8 MB. Beyond about 2**22 ids more and more rows pass it for nothing; they cost shuffle, never results.
MOST_BITS = 1 << 26


def hash_filter(scratch: Scratch, ids: DataFrame, col: str) -> Callable[[Column], Column]:
    """A Bloom filter of the 64-bit hashes in a column, as a test of other such hashes; made by aggregation, sized by their
    number (two bits of 16 each) up to MOST_BITS. ids must be a written table."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * ids.count()).bit_length()))
    places = lambda x: [x.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(bits - 1))]
    p = ids.select(F.explode(F.array(*places(F.col(col)))).alias("p"))
    words = p.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("m"))
    dense = scratch.spark.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("m", F.lit(0)).alias("m"))
    made = scratch.write(dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "m"))), lambda x: x["m"]).alias("bits")), "filter")

    def test(x: Column) -> Column:
        words = made.select("bits").scalar()
        hit = lambda at: F.call_function("shiftright", F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        a, b = places(x)
        return F.coalesce(hit(a) & hit(b), F.lit(False))

    return test


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose long `key` isn't among the keys of the written table `gone`; only rows that may go are shuffled."""
    scratch = Scratch(rows.sparkSession)
    hashed = scratch.write(gone.select(F.xxhash64(key).alias("h")), "keys")
    may_go = hash_filter(scratch, hashed, "h")(F.xxhash64(key))
    return rows.where(~may_go).unionByName(rows.where(may_go).join(gone.select(key), key, "left_anti"))


def free_prefix(*tables: DataFrame) -> str:
    """Underscores that no column begins with, for columns of our own beside a caller's."""
    prefix = "_"
    while any(c.startswith(prefix) for t in tables for c in t.columns):
        prefix += "_"
    return prefix


def map_rows(df: DataFrame, schema: str, function: Callable[[list, ...], list[tuple]], setup: Callable[[], object] | None = None, max_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow over column lists in slices of bounded bytes; function(state, *columns) gives rows of `schema`.

    An Arrow batch may hold very long texts, so it is cut again before it becomes Python objects.
    """
    out = pa.schema(_arrow(df.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in slices(batch, max_bytes):
                rows = function(state, *[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(out), out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    step = max(1, n * max_bytes // max(1, batch.nbytes))
    for i in range(0, n, step):
        part = batch.slice(i, step)
        if part.num_rows > 1 and step < n and part.get_total_buffer_size() and _bytes(part) > 2 * max_bytes:
            yield from slices(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema), max_bytes)
        else:
            yield part


def _bytes(part: pa.RecordBatch) -> int:
    return part.nbytes


def _arrow(spark: SparkSession, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema)]
