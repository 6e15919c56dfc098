"""Reading coded tables and writing samples and results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layout of the study table.
SENTINEL = -99.99
NULL_TOKENS = ("-99.99", "NA", "")
TARGET = "yd"
RATIOS = ("tdta", "reta", "opita", "ebita", "lsls", "lta", "gempl", "invsls",
          "nwcta", "cacl", "qacl", "fata", "ltdta", "mveltd")

STUDY_SCHEMA = T.StructType(
    [T.StructField(TARGET, T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in RATIOS]
)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType = STUDY_SCHEMA,
    sep: str = ";",
    null_tokens: tuple[str, ...] = NULL_TOKENS,
    malformed: str = "fail",
) -> DataFrame:
    """Delimited text with a header, by column name, with any number of spellings of a missing value.

    Columns may stand in any order and the file may have more of them; an absent one is an error, and
    so are files of one folder whose headers differ. Cells are trimmed. A cell that is neither a null
    token nor of its column's type is an error, or NULL with `malformed="null"`.
    """
    if malformed not in ("fail", "null"):
        raise ValueError("malformed must be 'fail' or 'null'")
    raw = spark.read.csv(path, sep=sep, header=True, enforceSchema=False)
    absent = [f.name for f in schema if f.name not in raw.columns]
    if absent:
        raise ValueError(f"columns not in the header: {absent}")

    def cell(f: T.StructField):
        text = F.trim(F.col(f"`{f.name}`"))
        text = F.when(~text.isin(*null_tokens), text) if null_tokens else text
        value = text.try_cast(f.dataType)
        if malformed == "fail" and not isinstance(f.dataType, T.StringType):
            wrong = F.raise_error(F.concat(F.lit(f"malformed cell in column {f.name}: "), text))
            value = F.when(text.isNotNull() & value.isNull(), wrong.cast(f.dataType)).otherwise(value)
        return value.alias(f.name)

    return raw.select(*[cell(f) for f in schema])


def numeric_fields(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def sentinel_to_null(
    df: DataFrame, columns: list[str] | None = None, sentinel: float = SENTINEL
) -> DataFrame:
    """Coded missing value and NaN become NULL in the numeric columns."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    out = {}
    for c in columns or numeric_fields(df):
        keep = F.col(c) != F.lit(sentinel)
        if c in floating:
            keep = keep & ~F.isnan(c)
        out[c] = F.when(keep, F.col(c))
    return df.withColumns(out)


def write_samples(df: DataFrame, path: str, sample: str = "dumVE", mode: str = "errorifexists") -> None:
    """One directory per sample, so later reads prune to the sample they need."""
    df.write.mode(mode).partitionBy(sample).parquet(path)


def read_sample(spark: SparkSession, path: str, value: int, sample: str = "dumVE") -> DataFrame:
    return spark.read.parquet(path).where(F.col(sample) == value)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; only a local session gets one of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "frame") -> DataFrame:
    """The table written once to the shared folder and read back.

    Cuts the lineage for frames that several passes read: later passes scan only the columns they
    need, and a lost executor repeats a scan instead of the joins behind it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
