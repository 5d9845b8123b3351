"""Many small files."""

import os
from urllib.parse import unquote, urlsplit

from pyspark import TaskContext
from pyspark.sql import DataFrame


def write_each(rows: DataFrame, folder: str) -> None:
    """One text file for each row of a single text column, below a new folder.

    On a local or mounted disk the tasks write the files themselves, each under a hidden name until it is whole: there
    Hadoop's writer starts a process for every permission it sets and the driver moves the files one by one. Other stores
    are written by Spark.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = urlsplit(store.makeQualified(place).toUri().toString())
    spread = rows.repartition(spark.sparkContext.defaultParallelism)
    if full.scheme != "file":
        spread.write.option("maxRecordsPerFile", 1).text(folder)
        return
    store.mkdirs(place)
    local = unquote(full.path)

    def write(part):
        context = TaskContext.get()
        for i, (value,) in enumerate(part):
            name = f"part-{context.partitionId():05d}-{i:08d}.txt"
            hidden = f"{local}/.{name}.{context.taskAttemptId()}"
            with open(hidden, "w", encoding="utf-8", newline="") as file:
                file.write(f"{value or ''}\n")
            os.replace(hidden, f"{local}/{name}")

    spread.foreachPartition(write)
