"""Chat formatting by quotation linking.

Each line of a message has a quote level, the number of `>` before it. Neighbouring lines of one level
are a passage. Passages are normalised (lower case, words joined by one space) and hashed, whole and by
line; so is what messages say themselves. A quoted passage comes from the latest earlier message of its
conversation that says all of it, or else its lines come from the latest ones that say them. A message
replies to the latest message it quotes at level 1; deeper levels are linked alike and name the
messages before. Without such a message it starts a thread. Conversations come out without quotes and
in reply order: by the thread's first turn, then by depth, then by turn.

The search for the latest earlier message is a window over blocks of turns and one over block ends, so
a conversation with a third of all rows is spread. Threads are followed by pointer doubling; positions
come from a global order. DataFrame functions alone.

Null texts are empty. Rows with one conv_id and turn are parts of one message and share its links. Rows
without conv_id are one conversation, rows without turn are never linked and come first. Passages and
lines of fewer than `min_chars` normalised characters are ambiguous: they link where nothing longer of
their level does. Text without letters or digits stands for itself; blank lines link nothing. Extra
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, aside, beside, let, numbered, stored

QUOTE = r"^((?:[ \t]*>)+)[ \t]?"
#: A line that only announces the quote after it.
WROTE = r"(?i)^[ \t]*on\b.*\bwrote:[ \t]*$"
BLOCK = 4096


def level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), "[^>]", ""))


def normal(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(words == "", F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(words)


def lines(text: Column) -> Column:
    """Array of (level, body); announcements count as level -1."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    read = F.transform(parts, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body")))

    def announced(all_lines: Column) -> Column:
        return F.transform(all_lines, lambda x, i: F.when((x["level"] == 0) & x["body"].rlike(WROTE) & (F.coalesce(F.get(all_lines, i + 1)["level"], F.lit(0)) > 0), F.struct(F.lit(-1).alias("level"), x["body"].alias("body"))).otherwise(x))

    return F.transform(F.array(read), announced)[0]


def passages(read: Column) -> Column:
    """Array of (level, body): neighbouring lines of one level as one. Levels change at heads; each passage
    is the slice from its head to the next, so the work grows with the lines."""

    def cut(x: Column) -> Column:
        changes = F.transform(x, lambda line, i: F.when((i == 0) | (F.get(x, i - 1)["level"] != line["level"]), i))
        heads = F.filter(changes, lambda i: i.isNotNull())
        whole = lambda h: F.transform(h, lambda i, k: F.struct(F.get(x, i)["level"].alias("level"), F.array_join(F.slice(x, i + 1, F.coalesce(F.get(h, k + 1), F.size(x)) - i)["body"], "\n").alias("body")))
        return let(heads, whole)

    return let(read, cut)


def units(found: Column, quoted: bool) -> Column:
    """Distinct (level, passage, part, weak, h, h2) that can be matched, of what passages quote or say: whole
    passages (part 0) and their lines (part 1), as hashes of their normal form."""
    wanted = F.filter(found, lambda p: (p["level"] > 0) if quoted else (p["level"] == 0))

    def of(p: Column) -> Column:
        one = lambda text, passage, part: F.struct(p["level"].alias("level"), F.md5(passage).alias("passage"), F.lit(part).alias("part"), F.char_length(text).alias("length"), F.xxhash64(text).alias("h"), F.md5(text).alias("h2"))
        parts = lambda passage: F.concat(F.array(one(passage, passage, 0)), F.transform(F.split(p["body"], "\n"), lambda x: let(normal(x), lambda text: one(text, passage, 1))))
        return let(normal(p["body"]), parts)

    return F.array_distinct(F.filter(F.flatten(F.transform(wanted, of)), lambda u: u["length"] > 0))


def own_text(read: Column) -> Column:
    """What the message says itself."""
    kept = F.transform(F.filter(read, lambda x: x["level"] == 0), lambda x: x["body"])
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def linked(messages: DataFrame, min_chars: int = 8) -> DataFrame:
    """(conv, turn, level, passage, weak, source) of messages(conv, turn, text, quoted): what quoted passages
    come from, one row or one per line that links.

    `weak` marks short units; all that link come out. What messages say is parsed only where quotes exist.
    """
    timed = messages.where("turn is not null")
    quoted = timed.select("conv", "turn", F.explode("quoted").alias("u")).select("conv", "turn", "u.level", "u.passage", "u.part", (F.col("u.length") < min_chars).alias("weak"), "u.h", "u.h2")
    quoted = stored(quoted.distinct())
    if quoted.isEmpty():
        return quoted.select("conv", "turn", "level", "passage", "weak", F.col("turn").alias("source"))
    key = ["conv", "h", "h2"]
    every = timed.select("conv", "turn", F.explode(units(passages(lines(F.col("text"))), False)).alias("u")).select("conv", "u.h", "u.h2", "turn")
    said = every.join(quoted.select(*key).distinct(), key, "left_semi").select(*key, "turn").distinct()
    asked = quoted.select(*key, "turn").distinct()
    rows = asked.select(*key, "turn", F.lit(True).alias("asks"), F.lit(None).cast("long").alias("said")).unionByName(said.select(*key, "turn", F.lit(False).alias("asks"), F.col("turn").alias("said")))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    near = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    ends = said.withColumn("block", F.floor(F.col("turn") / BLOCK)).unionByName(asked.select(*key, F.lit(None).cast("long").alias("turn"), F.floor(F.col("turn") / BLOCK).alias("block")))
    ends = ends.groupBy(*key, "block").agg(F.max("turn").alias("end"))
    far = ends.withColumn("far", F.max("end").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    rows = rows.withColumn("near", F.max("said").over(near)).where("asks").join(far, [*key, "block"])
    sources = rows.withColumn("source", F.coalesce("near", "far")).where("source is not null").select(*key, "turn", "source")
    links = quoted.join(sources, [*key, "turn"])
    # a passage that is known as a whole isn't looked up by lines
    parts = Window.partitionBy("conv", "turn", "level", "passage")
    links = links.withColumn("first", F.min("part").over(parts)).where("part = first")
    return links.select("conv", "turn", "level", F.col("h2").alias("passage"), "weak", "source").distinct()


def parents_of(links: DataFrame) -> DataFrame:
    """(conv, turn, source, quotes): the latest message quoted at the shallowest level that links, short units
    only where no longer one does; and all links as array of (level, passage, source)."""
    best = F.max(F.struct((-F.col("level")).alias("level"), (~F.col("weak")).alias("strong"), F.col("source").alias("source")))["source"]
    quotes = F.array_sort(F.collect_set(F.struct("level", "passage", "source")))
    return links.groupBy("conv", "turn").agg(best.alias("source"), quotes.alias("quotes"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of replies, by pointer doubling: each round halves what is left of every way up."""
    ways = stored(parents.select("conv", "turn", F.col("source").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done")))
    while not ways.where("not done").isEmpty():
        up = ways.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("done").alias("e"))
        met = ways.join(up, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        ways = stored(met.select("conv", "turn", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.coalesce("e", F.lit(True)).alias("done")))
    return ways.drop("done")


#: What formatted() adds; a column of the caller's with one of these names gives way to it.
RESULTS = ("n_quotes", "max_level", "quotes", "parent_turn", "thread_turn", "depth", "position", "clean_text")


def formatted(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", min_chars: int = 8) -> DataFrame:
    """The rows with n_quotes, max_level, quotes, parent_turn, thread_turn, depth, position and clean_text.

    quotes has (level, passage, source) of every quoted passage or line that links, passage being the MD5
    of its normal form and source the turn that says it.
    position counts from 0 inside a conversation, in reply order.
    """
    scratch = Scratch(conversations.sparkSession)
    keyed = aside(conversations, conv=F.struct(F.col(conv)), turn=F.col(turn).cast("long"), role=F.col(role), text=F.col(text))

    def parsed(read: Column) -> Column:
        top = F.greatest(F.array_max(F.transform(read, lambda x: x["level"])), F.lit(0))
        of = lambda p: F.struct(F.size(F.filter(p, lambda x: x["level"] > 0)).alias("n_quotes"), top.alias("max_level"), own_text(read).alias("clean_text"), units(p, True).alias("quoted"))
        return let(passages(read), of)

    # texts are read once, into a table: later plans sort, join and sample its columns
    rows = scratch.table("parsed", keyed.withColumn("p", let(lines(F.col("text")), parsed)).select("_row", "conv", "turn", "role", "p.*"))
    links = linked(rows.select("conv", "turn", F.col("_row")[text].alias("text"), "quoted"), min_chars)
    parents = stored(parents_of(links))
    above = parents.join(threads(parents.drop("quotes")), ["conv", "turn"])
    out = rows.drop("quoted").join(above, ["conv", "turn"], "left").withColumns(
        {
            "quotes": F.coalesce("quotes", F.array().cast("array<struct<level:int,passage:string,source:bigint>>")),
            "thread_turn": F.coalesce("root", "turn"),
            "depth": F.coalesce("depth", F.lit(0).cast("long")),
        }
    ).withColumnRenamed("source", "parent_turn").drop("root")
    ordered = numbered(out, "conv", "thread_turn", "depth", "turn", "role", "clean_text", name="n", keep=lambda df: scratch.table("ordered", df))
    first = ordered.groupBy("conv").agg(F.min("n").alias("first"))
    return beside(ordered.join(first, "conv").withColumn("position", F.col("n") - F.col("first")), *RESULTS)
