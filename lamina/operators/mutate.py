"""Updates of archives as operations on entry rows; a rewrite then packs them anew.

All are joins, filters and unions on (archive, entry_key); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["archive", "entry_key"]


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same key."""
    return entries.join(new.select(*KEY), KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def materialized(entries: DataFrame, gone: Column) -> DataFrame:
    """Hard links to entries that will go become files with their bodies; the first takes the place of the target.

    Rows keep their order; links to what stays are left alone.
    """
    targets = entries.where(gone & (F.col("type") == "file")).select("archive", F.col("entry_key").alias("_t"), F.col("body").alias("_b"), F.col("size").alias("_n"))
    met = entries.alias("e").join(targets.alias("t"), (F.col("e.archive") == F.col("t.archive")) & (F.col("e.link_target") == F.col("_t")) & (F.col("e.type") == "hardlink"), "left")
    out = met.select("e.*", "_t", "_b", "_n")
    linked = F.col("_t").isNotNull()
    return out.withColumns({"body": F.when(linked, F.col("_b")).otherwise(F.col("body")), "size": F.when(linked, F.col("_n")).otherwise(F.col("size")), "type": F.when(linked, "file").otherwise(F.col("type")), "link_target": F.when(~linked, F.col("link_target"))}).drop("_t", "_b", "_n")


def delete(entries: DataFrame, which: Column) -> DataFrame:
    """Entries go; hard links to them are turned into files first."""
    return materialized(entries, which).where(~F.coalesce(which, F.lit(False)))


def added(entries: DataFrame, keys: DataFrame, **columns: Column) -> DataFrame:
    """New entries of keys (archive, entry_key); where there is one of the key already, the query fails.

    Directories may be there: they are kept as they are.
    """
    new = keys.select(*KEY).distinct().withColumns({"path": F.col("entry_key"), **columns})
    old = entries.select(*KEY, F.col("type").alias("_type")).dropDuplicates(KEY)
    met = new.join(old, KEY, "left")
    there = F.col("_type").isNotNull()
    same = there & (F.col("_type") == "directory") & (F.col("type") == "directory")
    clash = F.concat(F.lit("entry is there already: "), F.col("entry_key"))
    fresh = met.where(~F.coalesce(same, F.lit(False))).withColumn("entry_key", F.when(there, F.raise_error(clash)).otherwise(F.col("entry_key")))
    return entries.unionByName(fresh.drop("_type"), allowMissingColumns=True)


def create_directories(entries: DataFrame, keys: DataFrame, mode: int = 0o755) -> DataFrame:
    return added(entries, keys, type=F.lit("directory"), mode=F.lit(mode))


def create_symlinks(entries: DataFrame, keys: DataFrame, target: Column) -> DataFrame:
    """Symbolic links; targets aren't looked up."""
    return added(entries, keys, type=F.lit("symlink"), link_target=target)


def create_links(entries: DataFrame, keys: DataFrame, target: str) -> DataFrame:
    """Hard links to a file that every archive of `keys` must have."""
    files = entries.where((F.col("entry_key") == target) & (F.col("type") == "file")).select("archive", F.lit(True).alias("_file")).distinct()
    known = keys.select(*KEY).join(files, "archive", "left")
    known = known.withColumn("entry_key", F.when(F.col("_file"), F.col("entry_key")).otherwise(F.raise_error(F.concat(F.lit("no file to link to: "), F.lit(target)))))
    return added(entries, known, type=F.lit("hardlink"), link_target=F.lit(target))


def move(entries: DataFrame, source: str, target: str, replace: bool = False) -> DataFrame:
    """Rename an entry and all below it; links to moved entries follow. What is at the target already fails the
    query, or goes with replace."""
    if target == source or target.startswith(source + "/"):
        raise ValueError("an entry can't move below itself")
    held = F.col("entry_key")
    landing = (held == target) | held.startswith(target + "/")
    here = (held == source) | held.startswith(source + "/")
    if replace:
        moving = entries.where(here).select("archive").distinct()
        gone = entries.where(landing).select(*KEY).join(moving, "archive", "left_semi")
        entries = entries.join(gone, KEY, "left_anti")
    else:
        sides = entries.where(landing | here).groupBy("archive").agg(F.max(landing).alias("_there"), F.max(here).alias("_moves"))
        clash = sides.where("_there and _moves").select("archive", F.lit(True).alias("_clash"))
        checked = entries.join(clash, "archive", "left")
        entries = checked.withColumn("entry_key", F.when(F.col("_clash") & here, F.raise_error(F.lit(f"entry is there already: {target}"))).otherwise(held)).drop("_clash")
    below = lambda c: (c == source) | c.startswith(source + "/")
    moved = lambda c: F.when(below(c), F.concat(F.lit(target), F.substring(c, len(source) + 1, 1 << 30))).otherwise(c)
    return entries.withColumns({"path": F.when(below(F.col("entry_key")), moved(F.col("entry_key"))).otherwise(F.col("path")), "entry_key": moved(F.col("entry_key")), "link_target": F.when(F.col("type") == "hardlink", moved(F.col("link_target"))).otherwise(F.col("link_target"))})


def set_attributes(entries: DataFrame, which: Column, **values: Column) -> DataFrame:
    return entries.withColumns({k: F.when(which, v).otherwise(F.col(k)) for k, v in values.items()})


def duplicates(entries: DataFrame) -> DataFrame:
    """Keys that occur more than once in an archive, which an index refuses."""
    return entries.groupBy(*KEY).agg(F.count("*").alias("times")).where("times > 1")


def listing(entries: DataFrame) -> DataFrame:
    """Directory tree: every entry and every implied directory, with parent."""
    parts = F.split("entry_key", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    implied = entries.where(F.size(parts) > 1).select("archive", F.explode(above).alias("entry_key")).distinct().join(entries.select(*KEY), KEY, "left_anti").withColumn("type", F.lit("directory"))
    every = entries.select(*KEY, "type").unionByName(implied)
    return every.withColumn("parent", F.when(F.col("entry_key").contains("/"), F.regexp_replace("entry_key", "/[^/]*$", "")).otherwise(F.lit("")))
