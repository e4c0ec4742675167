"""Small files that appear complete or not at all, and that only one of several writers can put in place."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def put_if_absent(spark: SparkSession, folder: str, name: str, content: bytes) -> bool:
    """Write ``folder/name`` on Hadoop's file system; False if there is one already.

    The file is written under a hidden name and renamed, which FileContext does over no file that is there.
    """
    hadoop, settings = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    log = hadoop.Path(folder)
    hidden, final = (hadoop.Path(log, n) for n in (f".{uuid.uuid4().hex}", name))
    store = log.getFileSystem(settings)
    store.mkdirs(log)
    out = store.create(hidden, False)
    try:
        out.write(bytearray(content))
        out.hsync()
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(store.getUri(), settings).rename(hidden, final, options)
    except Py4JJavaError as problem:
        store.delete(hidden, False)
        if "FileAlreadyExistsException" not in problem.java_exception.getClass().getName():
            raise
        return False
    return True
