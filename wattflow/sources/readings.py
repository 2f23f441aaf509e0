"""Reading tables of power readings, labelled features and submissions, and writing results.

Readings are held long: building INT, channel STRING, t BIGINT, watts DOUBLE, a gap being null and never NaN.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import known

FORMATS = ("parquet", "csv", "json", "orc")


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a glob names, through the file system that holds them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(x.getPath().toString() for x in found) if found is not None else []


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """All part files that a glob names, in wide form: building, part, idx, and one column for each channel.

    A file's name holds house{building}_{part}.csv, its first column is the row index. Buildings have different
    channels: columns are matched by name, and absent ones are null. Parts of one building are read in one scan if
    their headers agree.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in _files(spark, path):
        header = spark.read.text(file).first()
        if header is not None:
            by_header.setdefault(tuple(header[0].split(",")), []).append(file)
    if not by_header:
        raise ValueError(f"no readings at {path}")
    name = F.input_file_name()
    parts = []
    for header, files in by_header.items():
        schema = ", ".join(f"`{c.strip() or '_idx'}` {'bigint' if i == 0 else 'double'}" for i, c in enumerate(header))
        raw = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(files)
        channels = [c for c in raw.columns[1:]]
        number = [F.regexp_extract(name, r"house(\d+)_(\d+)\.csv$", g).cast("int") for g in (1, 2)]
        parts.append(raw.select(number[0].alias("building"), number[1].alias("part"), F.col(f"`{raw.columns[0]}`").alias("idx"), *(known(F.col(f"`{c}`")).alias(c) for c in channels)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_sample_number(df: DataFrame, keys: tuple[str, ...] = ("building",), order: tuple[str, ...] = ("part", "idx"), to: str = "t") -> DataFrame:
    """Rows numbered from 0 through all parts of a building."""
    return df.withColumn(to, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """features ARRAY<DOUBLE>, label STRING of a CSV whose last column is the label."""
    raw = spark.read.option("header", True).csv(path)
    *features, label = raw.columns
    return raw.select(F.array(*(F.col(f"`{c}`").cast("double") for c in features)).alias("features"), F.col(f"`{label}`").alias("label"))


def read_submission(spark: SparkSession, path: str, building: int, index: str | None = None) -> DataFrame:
    """building, channel, t, value of a wide CSV; blanks and other text are 0. t is the index column, else the row's place."""
    raw = spark.read.option("header", True).csv(path)
    channels = [c for c in raw.columns if c != index and not re.fullmatch(r"_c0|", c)]
    at = index or next((c for c in raw.columns if c in ("_c0", "")), None)
    if at is None:
        raise ValueError("the submission needs an index column")
    values = [F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)).alias(c) for c in channels]
    wide = raw.select(F.lit(building).alias("building"), F.col(f"`{at}`").cast("long").alias("t"), *values)
    return wide.unpivot(["building", "t"], channels, "channel", "value").select("building", "channel", "t", "value")


def melt(wide: DataFrame, ids: tuple[str, ...] = ("building", "t"), channels: list[str] | None = None) -> DataFrame:
    """Wide readings as long ones; null samples stay."""
    channels = channels or [c for c in wide.columns if c not in ids]
    kept = wide.select(*ids, *(F.col(f"`{c}`").cast("double").alias(c) for c in channels))
    return kept.unpivot(list(ids), channels, "channel", "watts")


def widen(long: DataFrame, channels: list[str], value: str = "on", ids: tuple[str, ...] = ("building", "t")) -> DataFrame:
    """Long values as a column for each of the named channels, 0 where a channel has no row. One shuffle on ids."""
    return long.groupBy(*ids).pivot("channel", channels).agg(F.first(value)).na.fill(0)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ("building",)) -> None:
    """Write a stage's table by building. Arrays become JSON text where the format has none."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt == "csv":
        df = df.withColumns({c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))})
    writer = df.write.mode("overwrite").format(fmt).partitionBy(*(c for c in partition_by if c in df.columns))
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_parts(wide: DataFrame, path: str, part_col: str = "part", index_col: str = "idx") -> None:
    """Write wide readings (building, part, idx, channels) as read_readings takes them: path/house{building}_{part}.csv, the row index in a first column without a name."""
    spark, staged = wide.sparkSession, f"{path}/_staged"
    channels = [c for c in wide.columns if c not in ("building", part_col, index_col)]
    rows = wide.select("building", F.col(part_col).alias("part"), F.col(index_col).alias(" "), *(F.col(f"`{c}`") for c in channels))
    rows.repartition("building", "part").sortWithinPartitions("building", "part", " ").write.mode("overwrite").partitionBy("building", "part").option("header", True).csv(staged)
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for file in _files(spark, f"{staged}/building=*/part=*/*.csv"):
        building, part = re.search(r"building=(\d+)/part=(\d+)/", file).groups()
        if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(file), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/house{building}_{part}.csv")):
            raise OSError(f"{file} could not be moved")
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)


def read_stage(spark: SparkSession, path: str, buildings: list[int] | None = None, channels: list[str] | None = None, channel_col: str = "channel") -> DataFrame:
    """A stage's table, for some buildings and channels; a combination without rows is just absent."""
    df = spark.read.parquet(path)
    if buildings is not None:
        df = df.where(F.col("building").isin(buildings))
    return df.where(F.col(channel_col).isin(channels)) if channels is not None else df
