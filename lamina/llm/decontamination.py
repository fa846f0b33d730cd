"""Benchmark decontamination by winnowing.

Words of both sides are hashed to 64 bits. Of every 9 consecutive 5-word hashes the smallest, the
leftmost among equals, is kept; so each stretch of 13 words has a fingerprint inside it, and equal
stretches have the same one. Fingerprints of documents meet those of the benchmark by an equi-join,
and each meeting is extended word by word to both sides from the neighbours it carries. A stretch of
13 equal words or more is a hit, so every shared window is found and nothing else is.

Items shorter than a window are windows as they are; for these lengths every position of a document
is a fingerprint too, in the same pass, and only if there are such items.

DataFrame functions alone. Texts are never shuffled: a fingerprint carries its 21 words' hashes.
Null texts and texts without words have no fingerprints: their rows come back with zeros. Repeated
rows are worked on together and come back as often as they came. A null item_id hits words but isn't
listed. Without items, or with an empty table, nothing is hit. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_key, stored, with_keys

WINDOW, GRAM = 13, 5
#: Hashes in one choice: WINDOW words have this many GRAM-word stretches.
CHOICE = WINDOW - GRAM + 1
#: Benchmark fingerprints up to this number are broadcast (some 50 MB); beyond it the join is shuffled.
BROADCAST_ROWS = 200_000

#: The item words of the contract before A-Z are lower-cased.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    """Hash of each word with A-Z lower-cased. Plain ASCII words take the quick way."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ITEM_WORD), F.lit(0))
    lower = lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(words, lambda w: F.xxhash64(lower(w)))


#: Low bits of a packed hash that hold its place; texts may have that many words.
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1


def smaller_of(a: Column, ahead: int) -> Column:
    """Each value or the one `ahead` places on, whichever is smaller; past the end the value itself."""
    return F.zip_with(a, F.slice(a, ahead + 1, F.size(a)), lambda x, y: F.least(x, y))


def fingerprints(words: Column) -> Column:
    """Array of (at, fp, left, right): place from 1, hash, the hashes of words before it and from it on.

    A hash carries its place in its low bits, so the smaller of two is the smaller hash, or the one
    further left. Minima of 2, 4 and 8 neighbours come from three passes, those of 9 from one more.
    """

    def packed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(w, i, GRAM)).bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("long")))

    def chosen(g: Column) -> Column:
        of_nine = lambda m: F.zip_with(m, F.slice(g, CHOICE, F.size(g)), lambda x, y: F.least(x, y))
        minima = let(smaller_of(g, 1), lambda a: let(smaller_of(a, 2), lambda b: let(smaller_of(b, 4), of_nine)))
        return F.array_distinct(F.slice(minima, F.lit(1), F.size(g) - (CHOICE - 1)))

    def marks(g: Column) -> Column:
        return F.transform(chosen(g), lambda x: mark(words, x.bitwiseAND(F.lit(PLACES)).cast("int"), F.shiftright(x, PLACE_BITS)))

    return F.when(F.size(words) >= WINDOW, let(packed(words), marks)).otherwise(F.array())


def mark(words: Column, p: Column, fp: Column) -> Column:
    before = F.least(p - 1, F.lit(CHOICE - 1))
    return F.struct(p.alias("at"), fp.alias("fp"), F.slice(words, p - before, before).alias("left"), F.slice(words, p, WINDOW).alias("right"))


def every_gram(words: Column, n: int) -> Column:
    """Marks of all n-word stretches, for items of n words; n is part of the hash."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), F.slice(words, i, n)).alias("fp"), F.slice(words, 1, 0).alias("left"), F.slice(words, i, n).alias("right")))).otherwise(F.array())


def common_prefix(a: Column, b: Column) -> Column:
    return let(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda m: F.when(F.array_position(m, False) == 0, F.size(m)).otherwise(F.array_position(m, False).cast("int") - 1))


def union_length(spans: Column) -> Column:
    """Words in the union of spans (start, end), end excluded."""
    none = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), none, step, lambda s: s["n"])


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per distinct (id, key) of docs(id, key, words): rows, n_words, spans and items hit.

    Each document also sends one row without a fingerprint, so that those without hits stay.
    """
    lengths = sorted(r[0] for r in items.where((F.size("words") > 0) & (F.size("words") < WINDOW)).select(F.size("words")).distinct().collect())  # below WINDOW: 12 at most
    whole = items.where(F.size("words") > 0).withColumn("least", F.least(F.size("words"), F.lit(WINDOW)))
    # an item's marks are those of its own length; a text is read once and has marks of all lengths
    own = F.when(F.col("least") == WINDOW, fingerprints(F.col("words")))
    for n in lengths:
        own = own.when(F.col("least") == n, every_gram(F.col("words"), n))
    side = whole.select("item_id", "least", F.explode(own).alias("m"))
    side = stored(side.select("item_id", F.col("least").alias("i_least"), *[F.col(f"m.{c}").alias(f"i_{c}") for c in ("fp", "left", "right")]).distinct())
    # the row without a fingerprint; its hash is spread over partitions and joins nothing
    itself = F.struct(F.lit(0).alias("at"), F.col("key").alias("fp"), F.slice("words", 1, 0).alias("left"), F.slice("words", 1, 0).alias("right"))
    found = F.concat(F.array(itself), fingerprints(F.col("words")), *[every_gram(F.col("words"), n) for n in lengths])
    rows = docs.select("id", "key", F.size("words").alias("n_words"), F.explode(found).alias("m")).select("id", "key", "n_words", "m.*")
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    rows = rows.join(side, (F.col("fp") == F.col("i_fp")) & (F.col("at") > 0), "left").where("at = 0 or i_fp is not null")
    rows = rows.withColumn("_l", common_prefix(F.reverse("left"), F.reverse("i_left"))).withColumn("_r", common_prefix(F.col("right"), F.col("i_right")))
    rows = rows.where("at = 0 or _l + _r >= i_least")
    span = F.when(F.col("at") > 0, F.struct((F.col("at") - F.col("_l")).alias("start"), (F.col("at") + F.col("_r")).alias("end")))
    rows = rows.select("id", "key", "n_words", F.when(F.col("at") == 0, 1).otherwise(0).alias("rows"), span.alias("span"), F.when(F.col("at") > 0, F.col("item_id")).alias("item_id"))
    return rows.groupBy("id", "key").agg(F.sum("rows").alias("rows"), F.max("n_words").cast("long").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items"))


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, key, n_words, spans, items, n_hit, n_items, items_sha256, contaminated."""
    words = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), word_hashes(F.col(text_col)).alias("words"))
    items = stored(benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text)).alias("words")))
    found = hits(words, items)
    found = found.withColumn("n_hit", union_length(F.col("spans")).cast("long")).withColumn("n_items", F.size("items").cast("long"))
    found = found.withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def per_row(found: DataFrame) -> DataFrame:
    """Repeated rows as often as they came."""
    return found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("_row", "rows")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that aren't contaminated. Only the keys of contaminated rows go to the join."""
    return with_keys(docs, judged(docs, benchmark, id_col, text_col).where("contaminated"), "left_anti", id_col, text_col)
