"""Sources and sinks: parquet / warehouse tables, quoted multi-line CSV with an
explicit schema, missing-input guards, result writers and the export gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import MissingInputError, assert_aggregate_only, require_columns

# The report extract's columns (free text may span lines inside quotes).
REPORT_SCHEMA = T.StructType(
    [
        T.StructField("note_id", T.StringType()),
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("charttime", T.TimestampNTZType()),
        T.StructField("exam_name", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path_or_name: str) -> DataFrame:
    """A catalog table name or a parquet path."""
    if "/" in path_or_name or path_or_name.endswith(".parquet"):
        return spark.read.parquet(path_or_name)
    return spark.read.table(path_or_name)


def read_reports_csv(spark: SparkSession, path: str, schema: T.StructType = REPORT_SCHEMA) -> DataFrame:
    """Header CSV whose quoted fields hold line breaks (report text). Such files
    are not splittable: convert once to parquet with ``to_parquet``."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .schema(schema)
        .csv(path)
    )


def require_input(spark: SparkSession, path: str, columns: Sequence[str] = (), what: str = "input") -> DataFrame:
    """Read parquet at ``path`` or raise a named error explaining what is missing."""
    try:
        df = read_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise
        raise MissingInputError(f"{what} not found at {path}; produce it first") from e
    return require_columns(df, columns, what)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", forbidden: Sequence[str] = ()) -> None:
    """Overwrite a result table (no index column). When ``forbidden`` names
    identifier/text columns, the export gate refuses frames carrying them."""
    if forbidden:
        assert_aggregate_only(df, forbidden)
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_reports_csv(df: DataFrame, path: str) -> None:
    """Header CSV that round-trips free text: every field quoted, quotes doubled,
    leading/trailing whitespace kept (the writer would trim it by default)."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def to_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def parse_time(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """String → wall-clock timestamp (NTZ)."""
    c = F.to_timestamp_ntz(F.col(col), F.lit(fmt)) if fmt else F.col(col).cast("timestamp_ntz")
    return df.withColumn(col, c)
