"""Archives as they arrive in a folder.

`arriving` goes through Spark's file stream, whose log remembers what was read in bounded space and
which opens whatever Spark opens; each archive is read once and must fit one row. The data source
`archive` streams too, for local or mounted folders and larger archives; its offset is the list of
names seen, so it suits folders of moderate size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import archive

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, max_files: int = 100, **options) -> DataFrame:
    """Streaming entries of archives under `path`, at most `max_files` of them in a batch."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", max_files).load(path)
    return archive.entries_of(files, **options)
