"""Files by path: names below a root, and single files that tasks write."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def qualified(spark: SparkSession, root: str) -> str:
    """An absolute URI of a path, without a slash at its end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def below(spark: SparkSession, path: Column, root: str) -> Column:
    """What a file's path adds to its root, by the root's length."""
    return F.substring(F.regexp_replace(path, SCHEME, ""), len(re.sub(SCHEME, "", qualified(spark, root))) + 2, 1 << 30)


def decoded(url: Column) -> Column:
    """The path of a URL such as ``_metadata.file_path`` gives."""
    return F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def opened(uri: str):
    """(file system, path) for pyarrow, of a URI or a local path."""
    from pyarrow import fs

    uri = re.sub(r"^file:/*", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


@contextmanager
def replacing(uri: str):
    """A stream whose content takes the file's place when all is written; a
    retried or doubled task can't leave half a file."""
    store, path = opened(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(part) as out:
            yield out
    except BaseException:
        store.delete_file(part)
        raise
    store.move(part, path)


def put(uri: str, content: bytes) -> None:
    with replacing(uri) as out:
        out.write(content)


