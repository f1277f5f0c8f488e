"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Word separators of the contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Used where spark.checkpoint.dir is unset and Spark runs on one machine, as in tests.
LOCAL_DIR = "/tmp/checkpoints"
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_DIR).rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    Cuts lineage and fixes row identities (``monotonically_increasing_id`` is
    only stable once written). A lost executor costs a re-read, not a rerun of
    what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/umbra-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._umbra_path = path
    return out


def discard(*held: DataFrame) -> None:
    """Delete the files of tables that :func:`materialise` wrote, once all that reads them has been written itself."""
    for df in held:
        if path := getattr(df, "_umbra_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of the largest bitmap that split_by_ids broadcasts: 32 MB.
MOST_BITS = 1 << 28
_MAP = 32_768  # bits of one bitmap of Spark's


def split_by_ids(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``df`` parted in (rows whose ``key`` may be in ``ids``, rows whose key is not), so that a join on few ids needn't shuffle all texts.

    ``ids`` is a small written table with the column ``key``. A bitmap of hashed
    ids is broadcast; it has at least 16 bits an id, and its size is bounded by
    MOST_BITS. Where the ids are too many for that, all rows are in the first
    part, and there is no second. Whoever joins the first part with ``ids`` gets
    the same rows either way. Null keys are in the second part.
    """
    n = ids.count()
    bits = max(_MAP, min(MOST_BITS, 1 << (16 * n).bit_length()))
    if 2 * n > bits:
        return df, None
    bucket, bitmap = fresh(df, "bucket", "bitmap")
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = ids.where(F.col(key).isNotNull()).select(at.alias("at")).groupBy(F.expr(f"at div {_MAP}").alias(bucket)).agg(F.bitmap_construct_agg(F.col("at") % _MAP).alias(bitmap))
    held = df.withColumn(bucket, F.floor(at / _MAP)).join(F.broadcast(maps), bucket, "left")
    place = at % _MAP
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return held.where(hit).drop(bucket, bitmap), held.where(~hit).drop(bucket, bitmap)


def without_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids`` (a small written table): see :func:`split_by_ids`."""
    maybe, no = split_by_ids(df, key, ids)
    left = maybe.join(ids, key, "left_anti").select(*df.columns)
    return left if no is None else no.select(*df.columns).unionAll(left)


def tasks_for(df: DataFrame, bytes_per_task: int = 64 << 20) -> int:
    """Partitions for a shuffle of about ``df``'s size, from the plan's own size estimate.

    Never fewer than spark.sql.shuffle.partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, math.ceil(size / bytes_per_task))) if size < 1 << 60 else least


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put on until no column of ``df`` is called so (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_ids(docs: DataFrame, id_col: str) -> Column:
    """The ids as long. Ids of other types than whole numbers have no order or digest column here: an error, not a failing cast."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in INTEGERS and kind != "void":
        raise TypeError(f"{id_col} is {kind}; ids are whole numbers (number the rows first, as with_row_id does)")
    return F.col(id_col).cast("long")


def with_row_id(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row for good, and that column's name (one that ``docs`` doesn't have).

    It is the id itself where ids are whole numbers, unique and not null; else the
    rows are numbered and written once.
    """
    (uid,) = fresh(docs, "__uid")
    if dict(docs.dtypes)[id_col] in INTEGERS:
        n, different = docs.agg(F.count(F.lit(1)), F.count_distinct(F.col(id_col))).first()
        if n == different:
            return docs.withColumn(uid, F.col(id_col).cast("long")), uid
    return materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "docs"), uid
