"""Quality rules: text statistics and a decision list learned by sequential covering.

Statistics are computed inside each row with array functions, without a shuffle. The list is learned
from labelled statistics that are first counted per vector of features, so every later step works on
counts. A rule grows by the threshold condition with the best gain on two thirds of the counts, is
pruned on the last third, and takes the rows it covers out of the rest. Every value of a feature can be
a threshold. A rule that fails is set aside with its first feature and direction, and the next best
start is tried; learning ends when all have failed. The list becomes one Spark expression of nested
conditions. The driver holds the best condition per feature and direction, never rows.

Null texts and texts without words have zeros everywhere and fail the base rule. Without labels, or
with labels of one kind only, the list is empty and the base rule decides. Labels other than 0 and 1,
null ones, and those of unknown documents are ignored; repeated labels count as often as they come.
Extra columns are carried along; one with the name of a result gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, aside, beside, let, row_key, stored, with_keys

SYMBOLS = r"[#*$%&|<>]"
SHINGLE = 8
#: Ratios, per thousand, that conditions look at, beside n_words.
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Labelled rows to learn from; a documented bound, more are sampled down by hash.
MAX_LABELLED = 2_000_000


def covered_by_repeats(windows: Column) -> Column:
    """Words in windows that occur twice or more; `windows` holds a hash per start."""

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            twice = F.filter(p, lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | ((i < F.size(p) - 1) & (F.get(p, i + 1)["h"] == x["h"])))
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            none = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
            step = lambda s, i: F.struct((i + SHINGLE).alias("to"), (s["n"] + F.least(F.lit(SHINGLE), i + SHINGLE - s["to"])).alias("n"))
            return F.aggregate(starts, none, step, lambda s: s["n"])

        # most texts repeat nothing, which a hash set shows without sorting
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, repeated))

    return let(windows, count)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def of_words(w: Column) -> Column:
        hashes = F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(F.array())
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            covered_by_repeats(hashes).cast("long").alias("n_repeat_words"),
        )

    words = let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), of_words)
    lines = let(F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = aside(docs, w=words, n_symbols=F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"), n_dup_lines=lines)
    out = out.withColumns({c: F.col("w")[c] for c in ("n_words", "word_chars", "n_repeat_words")})
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    return beside(out, *STATISTICS, "base_failed")


def features() -> dict[str, Column]:
    """Whole numbers, so that thresholds and results are exact."""
    per = lambda a, b: F.when(F.col(b) > 0, F.call_function("div", F.col(a) * 1000, F.col(b))).otherwise(F.lit(0).cast("long"))
    return {"n_words": F.col("n_words"), "mean_word": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_words"), "repeat_rate": per("n_repeat_words", "n_words")}


@dataclass
class Rule:
    """Rows that meet all conditions (feature, "<=" or ">", threshold) get the label."""

    conditions: list[tuple[str, str, int]]
    label: int
    right: int = 0
    covered: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & ((features()[name] <= at) if op == "<=" else (features()[name] > at))
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: int = 1

    def column(self) -> Column:
        """The label of a row: the first rule that covers it decides."""
        out = F.lit(self.default)
        for rule in reversed(self.rules):
            out = F.when(rule.column(), rule.label).otherwise(out)
        return out


def _met(conditions: list[tuple[str, str, int]]) -> Column:
    out = F.lit(True)
    for name, op, at in conditions:
        out = out & ((F.col(name) <= at) if op == "<=" else (F.col(name) > at))
    return out


def _totals(counts: DataFrame) -> dict[bool, tuple[int, int]]:
    """(positive, negative) of the growing (False) and the pruning part (True)."""
    rows = counts.groupBy("held").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()  # two rows at most
    return {r["held"]: (r["p"], r["n"]) for r in rows}


def _best(counts: DataFrame, p0: int, n0: int) -> list[tuple[tuple[str, str, int], int, int]]:
    """The condition of the largest FOIL gain on the growing part per feature and direction, with what it
    covers; the best first, ties in order of features, thresholds and directions."""
    stacked = counts.where("not held").select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("v")) for i, f in enumerate(FEATURES)])).alias("x"), "pos", "neg")
    values = stacked.groupBy(F.col("x.f").alias("f"), F.col("x.v").alias("v")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    # a window per feature, over its distinct values on at most MAX_LABELLED rows
    upto = Window.partitionBy("f").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.select("f", "v", F.sum("p").over(upto).alias("p"), F.sum("n").over(upto).alias("n")).where((F.col("p") + F.col("n") > 0) & (F.col("p") + F.col("n") < p0 + n0))
    sides = F.array(F.struct(F.lit(0).alias("op"), F.col("p").alias("a"), F.col("n").alias("b")), F.struct(F.lit(1).alias("op"), (p0 - F.col("p")).alias("a"), (n0 - F.col("n")).alias("b")))
    found = values.select("f", "v", F.explode(sides).alias("s")).select("f", "v", "s.*").where("a > 0")
    gain = F.round(F.col("a") * (F.log2(F.col("a") / (F.col("a") + F.col("b"))) - F.log2(F.lit(p0 / (p0 + n0)))), 9)
    top = found.withColumn("gain", gain).where("gain > 0").groupBy("f", "op").agg(F.max(F.struct("gain", (-F.col("v")).alias("v"), "a", "b")).alias("m"))
    rows = top.select("f", "op", "m.*").collect()  # a row per feature and direction
    rows.sort(key=lambda r: (-r["gain"], r["f"], -r["v"], r["op"]))
    return [((FEATURES[r["f"]], ("<=", ">")[r["op"]], -r["v"]), r["a"], r["b"]) for r in rows]


def counted(labelled: DataFrame, label: str) -> DataFrame:
    """Counts per vector of features; `held` marks the pruning part."""
    rows = labelled.select(F.col(label).alias("y"), (F.pmod(F.xxhash64(F.col("_id")), F.lit(3)) == 0).alias("held"), *[c.alias(n) for n, c in features().items()])
    return stored(rows.groupBy("held", *FEATURES).agg(F.sum("y").alias("one"), F.sum(1 - F.col("y")).alias("zero")))


def _grown(left: DataFrame, start: tuple[str, str, int], p: int, n: int, max_conditions: int) -> Rule:
    """The rule that grows from a first condition, pruned; right and covered are those of the pruning part."""
    conditions = [start]
    while len(conditions) < max_conditions and n:
        found = _best(left.where(_met(conditions)), p, n)
        if not found:
            break
        condition, p, n = found[0]
        conditions.append(condition)
    # prune: the shortest prefix of conditions that judges best on the held part
    held = left.where("held").agg(*[c for k in range(1, len(conditions) + 1) for c in (F.sum(F.when(_met(conditions[:k]), F.col("pos")).otherwise(0)).alias(f"p{k}"), F.sum(F.when(_met(conditions[:k]), F.col("neg")).otherwise(0)).alias(f"n{k}"))]).first()
    worth = [((held[f"p{k}"] or 0) - (held[f"n{k}"] or 0)) / max(1, (held[f"p{k}"] or 0) + (held[f"n{k}"] or 0)) for k in range(1, len(conditions) + 1)]
    k = 1 + worth.index(max(worth))
    right, wrong = held[f"p{k}"] or 0, held[f"n{k}"] or 0
    return Rule(conditions[:k], 0, right, right + wrong)


def learned(labelled: DataFrame, label: str = "quality", target: int = 0, max_rules: int = 6, max_conditions: int = 3, min_covered: int = 8, min_precision: float = 0.9) -> DecisionList:
    """Rules for the label `target` in order, everything else gets the other label.

    `labelled` has the statistics, the label and `_id`. Only rules whose precision on the pruning part
    reaches `min_precision` are kept, so that rows of the other label are left alone.
    """
    counts = counted(labelled.where(F.col(label).isin(0, 1)), label)
    pos, neg = ("one", "zero") if target == 1 else ("zero", "one")
    counts = counts.select("held", *FEATURES, F.col(pos).alias("pos"), F.col(neg).alias("neg"))
    out = DecisionList(default=1 - target)
    remaining: list[list[tuple[str, str, int]]] = []
    for _ in range(max_rules):
        left = counts
        for done in remaining:
            left = left.where(~_met(done))
        p0, n0 = _totals(left).get(False, (0, 0))
        for start, p1, n1 in _best(left, p0, n0) if p0 and n0 else []:
            rule = _grown(left, start, p1, n1, max_conditions)
            if rule.covered >= max(1, min_covered // 3) and rule.right >= min_precision * rule.covered:
                break
        else:
            break
        rule.label = target
        out.rules.append(rule)
        remaining.append(rule.conditions)
    return out


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED, keep=stored) -> tuple[DataFrame, DecisionList]:
    """The documents with statistics, base_failed and kept, and the list that decided."""
    stats = keep(docs)
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).cast("long").alias(label))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * max_labelled / n))
    # rows that fail the base rule are out already; the list learns what it alone must decide
    labelled = stats.where("not base_failed").select(F.col(id_col).alias("_id"), *STATISTICS, "base_failed").join(known, "_id")
    rules = learned(labelled, label)
    return stats.withColumn("kept", ~F.col("base_failed") & (rules.column() == 1)), rules


def kept_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass the base rule and the learned list; columns as they are."""
    numbers = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))).drop("text")
    found, _ = judged(numbers, labels)
    return with_keys(docs, found.where("kept").select(F.col("doc_id").alias("id"), "key").distinct(), "left_semi", id_col, text_col)
