"""Reading the customer table and writing/reading result tables.

Paths go through Hadoop's FileSystem API, so the same code lists and checks
files on local disk, HDFS or object storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PREFERRED_FILE_NAMES, REQUIRED_COLUMNS, REQUIRED_ARTIFACTS


#: Added by the reader: which row of a duplicated id comes first.
FILE_ORDER = "_file_order"


def missing_columns(columns) -> list[str]:
    return sorted(set(REQUIRED_COLUMNS) - {str(c) for c in columns})


def validate_columns(df: DataFrame) -> DataFrame:
    missing = missing_columns(df.columns)
    if missing:
        raise ValueError(f"Dataset is missing required columns: {', '.join(missing)}")
    return df


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_csv(spark: SparkSession, directory: str) -> list[str]:
    fs, p = _fs(spark, directory)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if str(s.getPath().getName()).endswith(".csv"))


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text (no type inference: TotalCharges holds blanks); columns checked.

    ``FILE_ORDER`` (file, start of the block, row in the block's scan) orders rows
    as they stand in the files, however Spark packs the files into partitions.
    """

    df = validate_columns(spark.read.option("header", True).option("inferSchema", False).csv(path))
    return df.withColumn(FILE_ORDER, F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def find_local_dataset(spark: SparkSession, directory: str) -> str | None:
    """Preferred file names first, then *.csv in name order; first whose header has every required column."""

    candidates = [f"{directory.rstrip('/')}/{n}" for n in PREFERRED_FILE_NAMES] + list_csv(spark, directory)
    seen = set()
    for candidate in candidates:
        if candidate in seen or not path_exists(spark, candidate):
            continue
        seen.add(candidate)
        try:
            header = spark.read.option("header", True).csv(candidate).columns
        except Exception:  # unreadable file: skip it
            continue
        if not missing_columns(header):
            return candidate
    return None


def load_dataset(spark: SparkSession, data_source: str, data_dir: str | None = None) -> tuple[DataFrame, str]:
    """An explicit path (which must exist), or for ``auto`` and ``local`` discovery in ``data_dir``."""

    if data_source not in {"auto", "local"}:
        if not path_exists(spark, data_source):
            raise FileNotFoundError(f"No such dataset: {data_source}")
        return read_customers_csv(spark, data_source), data_source
    if data_dir is not None:
        found = find_local_dataset(spark, data_dir)
        if found is not None:
            return read_customers_csv(spark, found), found
    raise FileNotFoundError(f"No compatible customer CSV found (source={data_source!r}, dir={data_dir!r})")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if fmt == "json":
        return spark.read.json(path)
    return spark.read.parquet(path)


def artifact_status(spark: SparkSession, artifact_dir: str, names=REQUIRED_ARTIFACTS) -> DataFrame:
    """(artifact, present) for every table a report needs."""

    rows = [(n, path_exists(spark, f"{artifact_dir.rstrip('/')}/{n}")) for n in names]
    return spark.createDataFrame(rows, "artifact string, present boolean")


def require_artifacts(spark: SparkSession, artifact_dir: str, names=REQUIRED_ARTIFACTS) -> None:
    missing = [r.artifact for r in artifact_status(spark, artifact_dir, names).filter(~F.col("present")).collect()]
    if missing:
        raise FileNotFoundError("Training artifacts are missing: " + ", ".join(missing))
