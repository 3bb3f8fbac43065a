"""Quality rules: a learned decision list of threshold conjunctions; DataFrame functions only.

Statistics of each text are computed within its row. Sequential covering on labelled statistics grows a
conjunction of thresholds by information gain, prunes it on rows held out for that, takes the rows it
covers away and goes on. The list becomes ordered conditional expressions that Spark compiles. Growing
asks for histograms (feature, bin, class) only, so each step moves a bounded count table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidewater.llm.common import NON_BLANK, materialise, text_of, words_of

#: Fixed values of the contract: symbol characters, least words, most per cent of repeated words.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Ratios that rules may test, each a function of the counted columns.
FEATURES: dict[str, str] = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "n_words": "cast(n_words as double)",
}


def with_statistics(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` behind ``_in`` (a struct), and one column for each statistic of the text.

    Null text counts as empty: all counts are 0. A text is one row throughout, so a very long one costs
    memory in proportion to itself. Three-word windows are compared by 64-bit hashes of their words.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_in"), (text_of() if text is None else text).alias("_text"))
    split = rows.select(
        "_in",
        words_of(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(NON_BLANK)).alias("_lines"),
        F.regexp_replace("_text", f"[^{SYMBOLS}A-Z0-9!]+", "").alias("_marks"),
    )
    w = F.col("_words")
    counted = split.select(
        "_in",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("_marks", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_marks", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_marks", "[^0-9]+", "")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("_marks", "[^!]+", "")).cast("long").alias("n_bangs"),
        F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
        ).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    # Windows sorted with their places, only where some window comes twice: equal ones stand side by side.
    placed = counted.withColumn(
        "_sorted",
        F.when(
            F.size("_windows") != F.size(F.array_distinct("_windows")),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("_windows")
    s = F.col("_sorted")
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    places = placed.withColumn(
        "_at",
        F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])),
    ).drop("_sorted")
    gaps = F.zip_with(
        "_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))
    )
    # A filter on a statistic must not be pushed below the arrays it comes from, where it would expand into
    # all of them: the row number, which a filter names, holds it here (see only()).
    return places.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda t, g: t + g).cast("long")).withColumn(
        "_row", F.monotonically_increasing_id()
    ).drop("_at")


def only(stats: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``with_statistics`` that meet the condition, which is tested once the statistics are there."""
    return stats.filter(condition & (F.col("_row") >= 0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def decision(rules: list[Rule]) -> Column:
    """The first rule that a row meets, as text; null where none does. One ordered conditional expression."""
    out = None
    for rule in rules:
        name = F.lit(" and ".join(map(str, rule)))
        out = F.when(_all(rule), name) if out is None else out.when(_all(rule), name)
    return F.lit(None).cast("string") if out is None else out


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labels: int) -> DataFrame:
    """Statistics of the documents with a quality label, about ``most_labels`` of them at most.

    Which labels are taken depends on a hash of doc_id alone. A doc_id with several labels takes the lowest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    n = known.count()
    share = min(1.0, most_labels / max(n, 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    taken = slim.join(F.broadcast(known), "doc_id")  # bounded by most_labels
    stats = with_statistics(taken)
    return only(stats, ~base_failed()).select(
        F.col("_in.doc_id").alias("doc_id"),
        (F.col("_in.quality") == 0).alias("bad"),
        (F.pmod(F.xxhash64(F.col("_in.doc_id"), F.lit(29)), F.lit(3)) == 0).alias("held"),
        F.array(*[F.expr(e) for e in FEATURES.values()]).alias("x"),
    )


def _below(value: Column):
    return lambda cut: cut < value


def _gain(p: float, n: float, base: float) -> float:
    return p * (math.log2(p / (p + n)) - base) if p else 0.0


def learn(
    docs: DataFrame,
    labels: DataFrame,
    most_labels: int = 50_000,
    max_rules: int = 12,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_cover: int = 3,
    quantiles: int = 24,
) -> list[Rule]:
    """The decision list. Every row that it takes in is one of a bounded sample of labelled documents.

    Thresholds are midpoints between neighbouring class quantiles. A rule must reach ``min_precision`` on
    the rows it was grown on and on those held out, and cover ``min_cover`` bad rows; learning ends with the
    first that does not, with no bad row left, or after ``max_rules``. Without labels the list is empty.
    """
    names = list(FEATURES)
    sample = materialise(labelled_sample(docs, labels, most_labels), "labelled")
    points = F.array(*[F.lit(i / quantiles) for i in range(quantiles + 1)])
    found = (
        sample.groupBy("bad").agg(*[F.percentile_approx(F.col("x")[j], points, F.lit(1000)).alias(f"q{j}") for j in range(len(names))]).collect()
    )  # two rows
    if not any(r["bad"] for r in found):
        return []
    cuts = []
    for j in range(len(names)):
        values = sorted({v for r in found for v in r[f"q{j}"] or []})
        cuts.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)])
    bins = F.array(
        *[
            F.size(F.filter(F.array(*map(F.lit, cuts[j])), _below(F.col("x")[j]))) if cuts[j] else F.lit(0)
            for j in range(len(names))
        ]
    )
    table = materialise(sample.select("bad", "held", bins.alias("b")), "binned")

    def meets(rule: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for j, above, k in rule:
            out = out & ((F.col("b")[j] > k) if above else (F.col("b")[j] <= k))
        return out

    def histogram(where: Column) -> list[Row]:
        return (
            table.filter(where).select("bad", "held", F.posexplode("b").alias("f", "bin")).groupBy("bad", "held", "f", "bin").count().collect()
        )  # features x bins x 4 rows at most

    rules: list[list[tuple[int, bool, int]]] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: list[tuple[int, bool, int]] = []
        counts: list[tuple[float, float, float, float]] = []  # grown bad, good; held bad, good, after each condition
        while len(rule) < max_conditions:
            rows = histogram(left & meets(rule))
            total = [sum(r["count"] for r in rows if r["f"] == 0 and r["bad"] is b and r["held"] is h) for h in (False, True) for b in (True, False)]
            if not total[0] or (rule and not total[1] and not total[3]):
                break
            base = math.log2(total[0] / (total[0] + total[1]))
            best = None
            for j in range(len(names)):
                at = {(r["bad"], r["held"], r["bin"]): r["count"] for r in rows if r["f"] == j}
                low = [0, 0, 0, 0]
                for k in range(len(cuts[j])):
                    low = [v + at.get((b, h, k), 0) for v, (h, b) in zip(low, [(h, b) for h in (False, True) for b in (True, False)], strict=True)]
                    for above in (True, False):
                        side = [t - v for t, v in zip(total, low, strict=True)] if above else low
                        gain = _gain(side[0], side[1], base)
                        if side[0] >= min_cover and (best is None or gain > best[0] + 1e-9):
                            best = (gain, (j, above, k), tuple(side))
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            counts.append(best[2])
            if not best[2][1] and not best[2][3]:
                break
        if not rule:
            break
        # Prune: the shortest beginning of the rule that does no worse on the held rows.
        worth = [(c[2] - c[3]) / max(c[2] + c[3], 1) for c in counts]
        keep = max(range(len(rule)), key=lambda i: (round(worth[i], 6), -i))
        c = counts[keep]
        held = c[2] + c[3]  # a rule that covers none of the held rows proves nothing
        if (c[0] + 1) / (c[0] + c[1] + 1) < min_precision or not held or (c[2] + 1) / (held + 1) < min_precision:
            break
        rule = rule[: keep + 1]
        rules.append(rule)
        left = left & ~meets(rule)
    return [tuple(Condition(names[j], above, cuts[j][k]) for j, above, k in rule) for rule in rules]


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` as the struct ``_in``, its statistics, base_failed, rule (what rejected it) and kept."""
    stats = with_statistics(docs)
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(F.col("base_failed"), F.lit(None)).otherwise(decision(rules)))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, rule.

    Empty and null texts have no words and fail the base rule; repeated rows are judged alike; an empty
    table gives an empty result; columns but doc_id, text (and quality of the labels) are ignored.
    """
    judged = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels, **options))
    # Each row is generated, from a list of one: what a caller filters by is tested after that, never inside the arrays.
    row = F.struct(
        F.col("_in.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )
    return judged.select(F.inline(F.array(row)))
