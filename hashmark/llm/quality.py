"""Quality rules: text statistics, fixed base rules and a decision list learned by sequential covering.

Everything is DataFrame functions.  Statistics come from array expressions over each whole text, with no shuffle.  The
learner sees only counts: each growing step is one aggregate of the labelled statistics by (feature, bin, label), at most
``len(FEATURES) * 2 * (BINS + 1)`` rows, from which the next threshold condition is chosen; a held-out third of the
labelled rows prunes each rule from its end.  The list is emitted as one ``CASE WHEN`` expression.

Nulls and empty texts have no words and fail the base rules.  Labels with NULL or no statistics row are not learned from;
without labels the list is empty and only the base rules speak.  Rows are neither merged nor dropped: equal rows get equal
results.  Columns of the input beyond ``id_col`` and ``text_col`` are not read, but for those named to come along.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.tables import BLANKS, documents, labels, word_array, written

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must have this share of rejects on the pruning rows, and so many of them.
MIN_PRECISION = 0.9
MIN_REJECTS = 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")
#: Per-mille rates and counts that conditions may test.
FEATURES = {
    "words": "n_words",
    "word_length": "1000 * word_chars div n_words",
    "symbol_rate": "1000 * n_symbols div n_words",
    "repeat_rate": "1000 * n_repeat_words div n_words",
    "dup_line_rate": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "capital_rate": "1000 * n_capitals div greatest(word_chars, 1)",
    "exclaim_rate": "1000 * n_exclaims div n_words",
    "words_a_line": "n_words div greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions hold; ``rejects`` and ``keeps`` are its counts on the pruning rows."""

    conditions: tuple[Condition, ...]
    rejects: int
    keeps: int

    def column(self) -> Column:
        found = F.lit(True)
        for condition in self.conditions:
            found = found & condition.column()
        return found


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """``id_col`` and the counts named in ``COUNTS``, over the whole text, which two regular expressions scan.

    The columns ``others`` come along in one struct, ``others``.

    Most texts repeat no window of three words, which a distinct count of window hashes tells; only the others are sorted
    to find the positions that repeats cover.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    split = docs.select(
        F.col(id_col),
        word_array(F.col(text_col)).alias("w"),
        lines.alias("lines"),
        F.regexp_replace(text, f"[^{SYMBOLS}A-Z!]+", "").alias("signs"),
        *([F.struct(*others).alias("others")] if others else []),
    )
    hashed = split.withColumn("h", F.when(F.size("w") > 3, F.expr(
        "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    )))
    ordered = hashed.withColumn("sorted", F.when(
        F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ))
    repeated = F.expr(
        "filter(sorted, (x, k) -> (k > 0 AND sorted[k - 1].h = x.h) OR (k + 1 < size(sorted) AND sorted[k + 1].h = x.h))"
    )
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    return ordered.select(
        id_col,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        (F.char_length("signs") - F.char_length(F.translate("signs", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("sorted").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.char_length("signs") - F.char_length(F.translate("signs", CAPITALS, ""))).cast("long").alias("n_capitals"),
        (F.char_length("signs") - F.char_length(F.translate("signs", "!", ""))).cast("long").alias("n_exclaims"),
        *(["others"] if others else []),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    """The rates that conditions test; a text without words has 0 for all."""
    return stats.withColumns({
        name: F.when(F.col("n_words") > 0, F.expr(rule)).otherwise(F.lit(0)).cast("long") for name, rule in FEATURES.items()
    })


def learn_rules(
    stats: DataFrame, labelled: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
    max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION,
) -> list[Rule]:
    """Sequential covering over the labelled rows that pass the base rules; label 0 is what a rule rejects."""
    marks = labelled.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(F.col(label_col)).cast("int").alias("label")
    )
    rows = written(
        with_features(stats.filter(~base_failed())).join(marks, id_col).select(
            "label", (F.pmod(F.xxhash64(id_col), F.lit(3)) == 0).alias("prunes"), *FEATURES
        ),
        "quality-labelled",
    )
    cuts = _cuts(rows)
    if not cuts:
        return []
    rules: list[Rule] = []
    open_rows = F.lit(True)
    for _ in range(max_rules):
        grown = _grow(rows.filter(open_rows & ~F.col("prunes")), cuts, max_conditions)
        rule = _prune(rows.filter(open_rows & F.col("prunes")), grown) if grown else None
        if rule is None or rule.rejects < MIN_REJECTS or rule.rejects / (rule.rejects + rule.keeps) < min_precision:
            break
        rules.append(rule)
        open_rows = open_rows & ~rule.column()
    return rules


def _cuts(rows: DataFrame) -> dict[str, list[int]]:
    """Candidate thresholds: quantiles of each feature within each label, ``2 * (BINS + 1)`` at most."""
    shares = [k / BINS for k in range(BINS + 1)]
    found = rows.groupBy("label").agg(*(F.percentile_approx(name, shares).alias(name) for name in FEATURES)).collect()
    if len(found) < 2:
        return {}
    return {name: sorted({int(v) for row in found for v in row[name]}) for name in FEATURES}


def _grow(rows: DataFrame, cuts: dict[str, list[int]], max_conditions: int) -> tuple[Condition, ...]:
    chosen: tuple[Condition, ...] = ()
    for _ in range(max_conditions):
        part = rows.filter(Rule(chosen, 0, 0).column())
        best, gain, left = None, 0.0, 1
        counts: dict[str, dict[int, list[int]]] = {name: {} for name in cuts}
        binned = F.array(*(
            F.struct(F.lit(name).alias("feature"), sum((F.col(name) >= c).cast("int") for c in at).alias("bin"))
            for name, at in cuts.items()
        ))
        total = [0, 0]
        grouped = part.select("label", F.explode(binned).alias("b")).groupBy("b.feature", "b.bin").agg(
            F.count_if(F.col("label") == 0).alias("rejects"), F.count_if(F.col("label") != 0).alias("keeps")
        )
        for row in grouped.collect():
            counts[row["feature"]][row["bin"]] = [row["rejects"], row["keeps"]]
        for k in (0, 1):
            total[k] = sum(v[k] for v in counts[next(iter(cuts))].values())
        if total[0] == 0 or total[1] == 0:
            break
        base = log2(total[0] / sum(total))
        for name in sorted(cuts):
            below = [0, 0]
            for b, threshold in enumerate(cuts[name]):
                below = [below[k] + counts[name].get(b, [0, 0])[k] for k in (0, 1)]
                above = [total[k] - below[k] for k in (0, 1)]
                for at_least, (p, n) in ((True, above), (False, below)):
                    value = p * (log2(p / (p + n)) - base) if p else 0.0
                    if value > gain + 1e-9:
                        best, gain, left = Condition(name, at_least, threshold), value, n
        if best is None:
            break
        chosen += (best,)
        if left == 0:
            break
    return chosen


def _prune(rows: DataFrame, grown: tuple[Condition, ...]) -> Rule | None:
    """The beginning of the conjunction with the best (rejects - keeps) / (rejects + keeps); the shorter one on a tie."""
    counts = []
    for k in range(1, len(grown) + 1):
        hit = Rule(grown[:k], 0, 0).column()
        counts += [F.count_if(hit & (F.col("label") == 0)).alias(f"r{k}"), F.count_if(hit & (F.col("label") != 0)).alias(f"k{k}")]
    row = rows.agg(*counts).first()
    best = None
    for k in range(1, len(grown) + 1):
        r, n = row[f"r{k}"], row[f"k{k}"]
        worth = (r - n) / (r + n) if r + n else -1.0
        if r and (best is None or worth > best[0]):
            best = (worth, Rule(grown[:k], r, n))
    return best[1] if best else None


def rule_columns(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, 0 for none, as one ordered conditional expression."""
    found = F.when(F.lit(False), 0)
    for k, rule in enumerate(rules, 1):
        found = found.when(rule.column(), k)
    return found.otherwise(0)


def quality_rules(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()
) -> DataFrame:
    """Counts, ``base_failed``, the number of the learned rule that fires and ``kept`` for every row of ``docs``.

    The columns ``others`` come along in one struct, ``others``, so that a row keeps its own decision whatever its id.
    """
    stats = written(text_statistics(docs, id_col, text_col, others), "quality-statistics")
    rules = learn_rules(stats, labelled, id_col)
    return with_features(stats).select(
        id_col, *COUNTS, *(["others"] if others else []), base_failed().alias("base_failed"), rule_columns(rules).alias("rule")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
