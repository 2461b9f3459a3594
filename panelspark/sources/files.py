"""Sources and sinks: partitioned Parquet, landing, pages, CSV, JSON lines, whole-day extracts."""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _leaves(spark: SparkSession, path: str, glob: str) -> dict[str, list[str]]:
    """The folders below path that hold files of the pattern, and those files; listed by Hadoop, nothing is opened."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, match = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.GlobFilter(glob)
    files = fs.listFiles(jvm_path, True)
    out: dict[str, list[str]] = {}
    while files.hasNext():
        f = files.next().getPath()
        if match.accept(f) and not f.getName().startswith(("_", ".")):
            out.setdefault(f.getParent().toString(), []).append(f.toString())
    return out


def _by_schema(spark: SparkSession, path: str, glob: str) -> list[DataFrame]:
    """The files below path, those of one schema together. Footers are read file by file, so this is for tables whose files differ."""
    groups: dict[str, list[str]] = {}
    for files in _leaves(spark, path, glob).values():
        for f in sorted(files):
            groups.setdefault(spark.read.parquet(f).schema.json(), []).append(f)
    return [spark.read.option("basePath", path).parquet(*files) for files in groups.values()]


def scan(spark: SparkSession, path: str, schema: str | T.StructType, glob: str = "*.parquet", since: str | None = None, partition: str = "day") -> DataFrame:
    """Parquet below path cast to the schema; since: only partitions from that value on, which Spark prunes. Nothing there: an empty table.

    Files may lack columns (null) or hold others (left out). Where their types can't be merged, files of one schema are read
    together, cast, and united; a value that the wished type can't hold is null.
    """
    want = spark.createDataFrame([], schema).schema
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path) or not _leaves(spark, path, glob):
        return spark.createDataFrame([], want)
    try:
        parts = [spark.read.option("pathGlobFilter", glob).option("mergeSchema", "true").option("recursiveFileLookup", "false").parquet(path)]
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
        parts = _by_schema(spark, path, glob)
    if since is not None:
        parts = [p.where(F.col(partition) >= since) for p in parts]
    cast = lambda p, f: F.col(f.name).try_cast(f.dataType) if f.name in p.columns else F.lit(None).cast(f.dataType)
    return reduce(DataFrame.unionByName, [p.select(*[cast(p, f).alias(f.name) for f in want]) for p in parts])


def index_weight_source(raw: DataFrame, index_code: str) -> tuple[DataFrame, DataFrame]:
    """One index's weights as shares, and its snapshot days; fails if a member repeats in a snapshot."""
    w = raw.where(F.col("index_code") == index_code).select("trade_date", F.col("con_code").alias("ts_code"), (F.col("weight") / 100).alias("weight"))
    if w.groupBy("trade_date", "ts_code").count().where("count > 1").limit(1).count():
        raise ValueError("a snapshot repeats a member")
    return w, w.select("trade_date").distinct()


def lookback_start(days: DataFrame, start: str, n: int) -> str | None:
    """The n-th day before start, from which partitions are to be read."""
    return days.where(F.col("trade_date") < start).orderBy(F.desc("trade_date")).limit(n).agg(F.min("trade_date")).first()[0]


def land(df: DataFrame, path: str, columns: list[str], day: str = "trade_date", snapshot: bool = False) -> None:
    """Writes the declared columns by year and day, replacing only the days that df has; snapshots lose repeated rows, daily data keep them."""
    d = df.select(*columns)
    d = d.dropDuplicates() if snapshot else d
    d = d.withColumns({"year": F.substring(day, 1, 4), "day": F.col(day)}).repartition("year", "day").sortWithinPartitions("year", "day", *columns)
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "day").parquet(path)


def landed_counts(landed: dict[str, DataFrame]) -> DataFrame:
    """(dataset, day, rows) of landed tables, by day and then in the datasets' order."""
    parts = [d.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("_i"), F.lit(n).alias("dataset"), "day", "rows") for i, (n, d) in enumerate(landed.items())]
    return reduce(DataFrame.unionByName, parts).orderBy("day", "_i").drop("_i")


def merge_pages(*pages: DataFrame) -> DataFrame:
    """Overlapping pages of an extract: columns aligned, exact repeats dropped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages).dropDuplicates()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(raw, parsed, error) of every line that isn't blank: a malformed one is kept with an error."""
    fields = spark.createDataFrame([], schema).schema
    full = T.StructType([*fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    p = lines.select(F.col("value").alias("raw"), F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"}).alias("p"))
    bad = F.col("p").isNull() | F.col("p._bad").isNotNull()
    return p.select("raw", F.when(~bad, F.struct(*[F.col(f"p.{f.name}") for f in fields])).alias("parsed"), F.when(bad, "malformed JSON").alias("error"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str) -> None:
    """Zstd Parquet in place of what path holds: written beside it whole, then exchanged by renames. A write that fails leaves
    the old table; between the two renames, on a store that has them, path is missing and its old files stand beside it."""
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    staged, old, final = (jvm_path(f"{path.rstrip('/')}{mark}") for mark in (f".new-{uuid.uuid4().hex[:12]}", f".old-{uuid.uuid4().hex[:12]}", ""))
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.option("compression", "zstd").parquet(staged.toString())
    except BaseException:
        fs.delete(staged, True)
        raise
    had = fs.exists(final)
    if had and not fs.rename(final, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(staged, final):
        if had:
            fs.rename(old, final)
        raise OSError(f"{path} can't be replaced")
    fs.delete(old, True)


def write_ordered(df: DataFrame, path: str, *keys: str, ranges: int | None = None) -> None:
    """Parquet sorted by keys: each file is a range, and the files' names are in the order of the ranges (so many, or as Spark deals them)."""
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def order_faults(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(file, first, last, rows) of files below path, in the order of their names, that begin before an earlier one ended, or
    whose own rows are not in the order of keys. Ranges of files are compared, a row for each; rows only within their file."""
    d = spark.read.parquet(path).select(F.struct(*keys).alias("k"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    ahead = Window.partitionBy("file").orderBy("start", "id")  # a scan numbers the rows of a file's block as they stand
    falls = d.withColumn("falls", F.lag("k").over(ahead) > F.col("k")).groupBy("file").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("rows"), F.count_if("falls").alias("falls"))
    before = F.max("last").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return falls.withColumn("before", before).where((F.col("before") > F.col("first")) | (F.col("falls") > 0)).select("file", "first", "last", "rows")


def schema_report(df: DataFrame) -> DataFrame:
    """(column, type, nullable, non_null): one row per column."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns])
    item = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.col(f.name).alias("non_null")) for f in df.schema]))
    return n.select(item.alias("r")).select("r.*")


def json_safe(df: DataFrame) -> DataFrame:
    """Doubles that aren't finite become null, dates and times ISO text."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def latest_days(df: DataFrame, budget: int, day: str = "trade_date", share: float = 0.8) -> DataFrame:
    """The newest whole days: the newest always, older ones while the rows so far stay within share of the budget; while
    what is kept exceeds the budget, the newer half of the days. Days are few; rows follow by a join."""
    w = Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    d = df.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    d = d.withColumns({"_total": F.sum("_n").over(w), "_place": F.row_number().over(Window.orderBy(F.desc(day)))})
    kept = [(r[day], r["_n"]) for r in d.where((F.col("_place") == 1) | (F.col("_total") <= share * budget)).orderBy("_place").collect()]
    while len(kept) > 1 and sum(n for _, n in kept) > budget:
        kept = kept[: len(kept) // 2]
    return df.where(F.col(day).isin([k for k, _ in kept])) if kept else df.limit(0)
