"""Raw files, the ingest manifest and the date-partitioned tables on shared storage."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from hitloom import schema
from hitloom.sources.versions import Store, Transaction

# The log date inside a file name, else inside the name of the folder that holds its parts.
DATE_IN_FILE = r"_access_(\d{4}-\d{2}-\d{2})_[^/]*$"
DATE_IN_FOLDER = r"_access_(\d{4}-\d{2}-\d{2})_[^/]*/[^/]*$"
#: The one table of a folder that ``replace_partitions`` writes.
ROWS = "rows"
#: Writer options for tables in which single requests are looked up: Bloom filters on what a request is known by.
LOOKUP_OPTIONS = {"parquet.bloom.filter.enabled#path": "true", "parquet.bloom.filter.enabled#edge_ip": "true",
                  "parquet.bloom.filter.expected.ndv#path": "200000", "parquet.bloom.filter.expected.ndv#edge_ip": "200000"}


def file_date(path: Column) -> Column:
    """Log date of a raw file; empty when neither its name nor its folder's has one."""
    return F.coalesce(F.nullif(F.regexp_extract(path, DATE_IN_FILE, 1), F.lit("")), F.regexp_extract(path, DATE_IN_FOLDER, 1))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the dated raw files: ``date``, ``value`` and file columns. Undated files are skipped.

    Invalid UTF-8 is replaced, lines have no length limit, compressed files are read as they are.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(
        file_date(meta["file_path"]).alias("date"),
        "value",
        meta["file_path"].alias("file_path"),
        meta["file_name"].alias("file_name"),
        meta["file_size"].alias("file_size"),
        meta["file_modification_time"].alias("file_modification_time"),
    ).where(F.col("date") != "")


def list_raw(spark: SparkSession, path: str) -> DataFrame:
    """Listing of the raw files: path, size, modification time and log date, without reading them.

    Spark's readers pass over empty files, so those come from the reader's list of names; their time is 0.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = reader.select("path", F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("mtime_epoch"))
    names = spark.createDataFrame([(n,) for n in reader.inputFiles()], "name string")
    # Names come percent-encoded, with a plus sign for itself.
    names = names.select(F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("path"))
    names = names.withColumn("key", plain_path(F.col("path")))
    empty = names.join(files.select(plain_path(F.col("path")).alias("key")), "key", "left_anti")
    empty = empty.select("path", F.lit(0).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_epoch"))
    return files.unionByName(empty).withColumn("log_date", file_date(F.col("path"))).where(F.col("log_date") != "")


def plain_path(path: Column) -> Column:
    """A path with one slash after its scheme, however many it was written with."""
    return F.regexp_replace(path, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)/+", "$1/")


def file_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each raw file as ``ingested``, ``changed`` or ``pending``; a file that became empty is changed, one that always was is ``empty``."""
    known = manifest.select(plain_path(F.col("path")).alias("_path"), F.col("size_bytes").alias("_size"), F.col("mtime_epoch").alias("_mtime"))
    same = (F.col("_size") == F.col("size_bytes")) & ((F.col("_mtime") == F.col("mtime_epoch")) | (F.col("size_bytes") == 0))
    none = F.col("_size").isNull()
    status = (F.when(none & (F.col("size_bytes") == 0), "empty").when(none, "pending").when(same, "ingested").otherwise("changed"))
    found = files.join(known, plain_path(F.col("path")) == F.col("_path"), "left")
    return found.withColumn("status", status).drop("_path", "_size", "_mtime")


def affected_dates(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Dates with a new, changed or emptied file; all their files are to be read again."""
    return file_status(files, manifest).where(F.col("status").isin("pending", "changed")).select("log_date").distinct()


def ingested_files(files: DataFrame) -> DataFrame:
    """Manifest rows of files, by date."""
    return schema.conform(files.withColumns({"date": F.col("log_date"), "ingested_at_epoch": F.unix_timestamp(F.current_timestamp())}), schema.MANIFEST)


# Tables -----------------------------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, table_schema: T.StructType | None = None) -> DataFrame:
    """A table with ``date=`` partitions, the date as text. A table that does not exist yet is empty.

    With an explicit schema, columns that old files lack read as NULL. Folders that ``replace_partitions`` wrote are
    read as of their newest commit, others as they are.
    """
    store = Store(spark, path)
    if store.numbers():
        return store.read(ROWS, table_schema)
    reader = spark.read.option("basePath", path)
    if table_schema is not None:
        reader = reader.schema(table_schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if table_schema is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], table_schema)


def replace_partitions(df: DataFrame, path: str, dates=(), rows_per_file: int | None = None) -> None:
    """Write a table, replacing exactly the dates that occur in ``df`` and those listed in ``dates``.

    A listed date without rows ends up empty. Rows are not shuffled before the write; ``rows_per_file`` bounds the
    size of a file. Readers see the old rows until all new ones are written.
    """
    change = Store(df.sparkSession, path).begin()
    change.write(ROWS, df, dates, rows_per_file)
    change.commit()


def by_date(df: DataFrame) -> DataFrame:
    """Rows gathered by date for the write; Spark splits a date that is too large for one task."""
    return df.hint("rebalance", "date")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for results with a row limit only."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", "true").csv(path)


def mistyped(spark: SparkSession, folders: list[str], column: str, wanted: T.DataType) -> list[tuple[T.StructType, list[str]]]:
    """Files whose own footer gives ``column`` another type than ``wanted``, grouped by that footer's schema.

    Only footers are read, a file at a time by a few threads of the driver; files without the column need no repair.
    """
    if not folders:
        return []
    with ThreadPoolExecutor(8) as pool:
        files = sorted(spark.read.parquet(*folders).inputFiles())
        schemas = list(pool.map(lambda f: spark.read.parquet(f).schema, files))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for file, found in zip(files, schemas):
        if column in found.names and found[column].dataType != wanted:
            groups.setdefault(found.json(), (found, []))[1].append(file)
    return list(groups.values())


def repair_column(change: Transaction, table: str, table_schema: T.StructType, column: str) -> list[str]:
    """Rewrite the dates of a table that have files in which ``column`` has another type than declared; returns them.

    Every group of files with one schema is read with that schema and cast alone. The other files of a rewritten date
    are copied as they are.
    """
    store, wanted, basis = change.store, table_schema[column].dataType, f"{change.store.root}/{table}"
    groups = mistyped(store.spark, store.folders(change.now, table), column, wanted)
    if not groups:
        return []
    wrong = {f for _, files in groups for f in files}
    dates = sorted({_date_of(f) for f in wrong})
    parts = [(found, files) for found, files in groups]
    good = [f for f in store.spark.read.parquet(*store.folders(change.now, table, dates)).inputFiles() if f not in wrong]
    if good:
        parts.append((table_schema, good))
    rows = []
    for found, files in parts:
        own = T.StructType([f for f in found if f.name not in ("date", "version")]).add("date", "string")
        rows.append(schema.conform(store.spark.read.option("basePath", basis).schema(own).parquet(*files), table_schema))
    change.write(table, reduce(DataFrame.unionByName, rows), dates)
    return dates


def _date_of(file: str) -> str:
    return next(part[5:] for part in reversed(file.split("/")) if part.startswith("date="))
