"""Append-only log folders: load whatever arrived since the last run, then stop.

Files that change after they were read are not noticed here; ``Warehouse.ingest`` with its manifest is.
"""

from hitloom.plans.refresh import Warehouse


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def load_new_files(warehouse: Warehouse, raw: str, checkpoint: str) -> None:
    """Find the dates of new files with Structured Streaming and redo those dates whole."""
    from hitloom.sources.storage import file_date
    from pyspark.sql import functions as F

    # Names only: the content column is never asked for, so no file is opened here.
    files = warehouse.spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(raw)
    dated = files.select(file_date(F.col("path")).alias("date")).where(F.col("date") != "")

    def redo(batch, _):
        dates = [r.date for r in batch.distinct().collect()]  # one row per day
        if dates:
            warehouse.ingest(raw, dates)

    query = dated.writeStream.foreachBatch(redo).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()
