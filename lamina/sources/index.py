"""An index of archives by byte ranges, and bodies read through it by any task.

Headers of a TAR or AR archive follow each other, so one task walks them, from header to header without
the bodies between. After that the rows of the index are ordinary rows: they are filtered, joined and
spread, and each task reads the ranges of its own rows, wherever they are in an archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive

#: Formats whose bodies are plain ranges of the file.
RANGED = ("tar", "ar")


def indexed(spark: SparkSession, path: str, **options) -> DataFrame:
    """Metadata of the files in TAR and AR archives with `data_offset`; compressed archives and sparse files have none."""
    archive.register(spark)
    entries = spark.read.format("archive").options(**{k: str(v) for k, v in options.items()}).load(path)
    offset = F.coalesce(*[F.col(f"{f}.data_offset") for f in RANGED])
    plain = F.size(F.coalesce("outer_codecs", F.array().cast("array<string>"))) == 0
    return entries.withColumn("data_offset", F.when(plain & (F.col("type") == "file"), offset)).drop("body")


def bodies(index: DataFrame, per_task: int | None = None) -> DataFrame:
    """Rows (archive, path, body) of an index's rows that have ranges; neighbours are read together.

    Paths must be the same on all workers. per_task deals the rows out in ranges of about so many.
    """
    rows = index.where("data_offset is not null").select("archive", "path", "data_offset", "size")
    if per_task:
        n = max(1, -(-rows.count() // per_task))
        rows = rows.repartitionByRange(n, "archive", "data_offset")
    rows = rows.sortWithinPartitions("archive", "data_offset")

    def run(batches):
        import pyarrow as pa

        name, f = None, None
        try:
            for batch in batches:
                out, heavy, start = [], 0, 0
                cols = [c.to_pylist() for c in batch.columns]
                for i, (a, _, at, size) in enumerate(zip(*cols)):
                    if a != name:
                        if f is not None:
                            f.close()
                        name, f = a, open(a, "rb")  # noqa: SIM115
                    f.seek(at)
                    out.append(archive.formats.entry.exactly(f, size))
                    heavy += size
                    if heavy >= 32 << 20 or i + 1 == batch.num_rows:
                        yield pa.RecordBatch.from_arrays([batch.column(0)[start : i + 1], batch.column(1)[start : i + 1], pa.array(out, pa.binary())], ["archive", "path", "body"])
                        out, heavy, start = [], 0, i + 1
        finally:
            if f is not None:
                f.close()

    return rows.mapInArrow(run, "archive string, path string, body binary")
