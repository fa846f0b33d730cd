"""Catalogs of formats and codecs as DataFrames, and lookups by any of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import codecs, formats

SCHEMA = "kind string, name string, aliases array<string>, extensions array<string>, probe int, readable boolean, writable boolean, framed boolean, dictionary boolean, level_min int, level_max int, level_default int"


def catalog(spark: SparkSession) -> DataFrame:
    """One row per archive format and codec, in catalog order."""
    rows = [("archive", k, list(v[0]), list(v[1]), v[2], True, v[4] is not None, None, None, None, None, None) for k, v in formats.CATALOG.items()]
    rows += [("codec", c.name, list(c.aliases), list(c.extensions), c.probe, True, True, c.framed, c.dictionary, *(c.levels or (None,) * 3)) for c in codecs.CATALOG]
    return spark.createDataFrame(rows, SCHEMA)


def find(name: str) -> tuple[str, str] | None:
    """(kind, name) by a name, another name or an extension; case doesn't count."""
    low = name.lower().lstrip(".")
    if (found := formats.find(low)) is not None:
        return "archive", found
    if (codec := codecs.find(low)) is not None:
        return "codec", codec.name
    for k, v in formats.CATALOG.items():
        if low in v[1]:
            return "archive", k
    return next((("codec", c.name) for c in codecs.CATALOG if low in [e.lower() for e in c.extensions]), None)
