"""Quality rules learned as an ordered decision list.

Statistics of a text are native Spark expressions.  Sequential covering on a
bounded sample of labelled rows grows conjunctions of thresholds that find
low-quality texts, prunes each on held-back rows, and emits the list as one
ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: labelled rows that the list is learned from at most, taken by a hash of their ids
SAMPLE_ROWS = 20_000
#: a rule must reject with at least this precision on rows it was not grown on
MIN_PRECISION = 0.9
MAX_RULES = 12
MAX_CONDITIONS = 4
#: candidate thresholds per statistic
THRESHOLDS = 48
#: labelled rows that a rule must find, grown and held back each
MIN_ROWS = 3

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "distinct_rate", "words_per_line"]


def _window(i: Column) -> list[Column]:
    return [F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)]


def _packed() -> Column:
    """For each 3-word window its hash, the low ``bits`` bits replaced by its place, in order."""
    place = F.expr("shiftleft(-1L, bits)")
    return F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(*_window(i)).bitwiseAND(place).bitwiseOR(i.cast("long")),
        )
    )


def _candidates() -> Column:
    """Places of windows whose packed hash has an equal neighbour: all repeated ones, hardly any other."""
    same = lambda x, k: F.coalesce(F.call_function("shiftright", x.bitwiseXOR(F.get("packed", k)), F.col("bits")) == 0, F.lit(False))
    hits = F.filter("packed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    return F.transform(hits, lambda x: x.bitwiseAND(F.expr("~shiftleft(-1L, bits)")).cast("int"))


def _repeat_words() -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    The candidates are put in order by their words; equal neighbours are the
    repeated windows, and the words that their places cover are summed from
    left to right.
    """
    ordered = F.sort_array(F.transform("found", lambda i: F.struct(F.concat_ws(" ", *_window(i)).alias("w"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    # bind the ordered windows once: the outer lambda has them as its only element
    repeated = F.flatten(
        F.transform(
            F.array(ordered),
            lambda o: F.transform(F.filter(o, lambda x, k: same(F.get(o, k - 1), x) | same(F.get(o, k + 1), x)), lambda x: x["i"]),
        )
    )
    covered = F.aggregate(
        F.sort_array(repeated),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return F.when(F.size("found") > 0, covered).otherwise(0).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, statistics...): ``doc`` is a struct of the row's own columns, whatever their names."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = base.select(
        "doc",
        F.regexp_replace("text", r"[\x20\x09-\x0D]+", "").alias("bare"),
        F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    ).select(
        "*",
        F.regexp_replace("bare", "[^A-Z0-9#*$%&|<>]+", "").alias("marks"),
        F.greatest(F.lit(1), F.ceil(F.log2(F.size("words") + 1))).cast("int").alias("bits"),
    )
    packed = parts.withColumn("packed", F.when(F.size("words") >= 4, _packed()))
    found = packed.withColumn("found", F.when(F.col("packed").isNotNull(), _candidates()))
    long = lambda c: c.cast("long")
    stats = found.select(
        "doc",
        long(F.size("words")).alias("n_words"),
        long(F.length("bare")).alias("word_chars"),
        long(F.length(F.regexp_replace("marks", "[A-Z0-9]+", ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        F.length(F.regexp_replace("marks", "[^A-Z]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("marks", "[^0-9]+", "")).alias("n_digits"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 6)
    rates = stats.select(
        "doc",
        *BASE,
        rate("word_chars", "n_words").alias("mean_word"),
        rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_upper", "word_chars").alias("upper_rate"),
        rate("n_digits", "word_chars").alias("digit_rate"),
        rate("n_distinct", "n_words").alias("distinct_rate"),
        rate("n_words", "n_lines").alias("words_per_line"),
    )
    # a one-element explode: filters on a statistic stay above it, else they would
    # be pushed down and repeat the whole expressions once per level
    return rates.select("doc", F.explode(F.array(F.struct(*rates.columns[1:]))).alias("s")).select("doc", "s.*")


@dataclass
class Rule:
    """A conjunction of (statistic, is_greater, threshold); a text that meets it is rejected."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, greater, at in self.conditions:
            out = out & (F.col(name) > at if greater else F.col(name) <= at)
        return out

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, greater, at in self.conditions:
            out &= x[name] > at if greater else x[name] <= at
        return out

    def __str__(self):
        return " and ".join(f"{n} {'>' if g else '<='} {t:g}" for n, g, t in self.conditions)


def _gain(hit_bad, hit_all, bad, every):
    """FOIL's gain of narrowing (bad, every) to (hit_bad, hit_all)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = hit_bad * (np.log2(hit_bad / hit_all) - np.log2(bad / every))
    return np.nan_to_num(gain, nan=-1.0, neginf=-1.0)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    rule, inside = Rule(), np.ones(len(y), bool)
    while len(rule.conditions) < MAX_CONDITIONS and y[inside].any() and not y[inside].all():
        best = (1e-9, None)
        for name in FEATURES:
            v, t = x[name][inside], y[inside]
            low_all = np.searchsorted(np.sort(v), cuts[name], side="right")
            low_bad = np.searchsorted(np.sort(v[t]), cuts[name], side="right")
            for greater in (False, True):
                every = len(v) - low_all if greater else low_all
                bad = t.sum() - low_bad if greater else low_bad
                gain = np.where(bad >= MIN_ROWS, _gain(bad, every, t.sum(), len(t)), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, greater, float(cuts[name][k])))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside = rule.mask(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule that is worth most on held-back rows."""
    best = (rule, 0.0, 0)
    for k in range(len(rule.conditions), 0, -1):
        short = Rule(rule.conditions[:k])
        hit = short.mask(x)
        n, bad = int(hit.sum()), int((hit & y).sum())
        worth = (bad + 1) / (n + 2)
        if worth > best[1]:
            best = (short, worth, bad)
    return best


def thresholds(values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values at quantiles of all rows and of the low-quality ones."""
    known = np.unique(values)
    grid = np.linspace(0, 1, THRESHOLDS)
    picks = [np.quantile(v, grid, method="lower") for v in (values, values[low], values[~low]) if len(v)]
    at = np.unique(np.searchsorted(known, np.concatenate(picks)))
    at = np.unique(np.r_[at[at > 0], at[at < len(known) - 1] + 1])
    return (known[at - 1] + known[at]) / 2 if len(at) else known


def learn_rules(rows: list[tuple], min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Sequential covering over (label is low, held back, *FEATURES) rows."""
    if not rows:
        return []
    table = np.array(rows, float)
    y, held = table[:, 0] > 0, table[:, 1] > 0
    x = {n: table[:, k + 2] for k, n in enumerate(FEATURES)}
    cuts = {n: thresholds(v, y) for n, v in x.items()}
    rules, left = [], np.ones(len(y), bool)
    while len(rules) < MAX_RULES:
        sub = lambda m: ({n: v[m] for n, v in x.items()}, y[m])  # noqa: B023, E731
        grown, back = sub(left & ~held), sub(left & held)
        if not grown[1].any() or not back[1].any():
            break
        rule, worth, found = _prune(_grow(*grown, cuts), *back)
        if not rule.conditions or worth < min_precision or found < MIN_ROWS:
            break
        rules.append(rule)
        left &= ~rule.mask(x)
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """Statistics of at most ``rows`` labelled documents, chosen by a hash of their ids."""
    chosen = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("id"))
        .agg((F.avg("quality") < 0.5).alias("low"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    # at most ``rows`` rows of two fixed-width columns
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    stats = with_statistics(found.select("doc_id", "low", "text"))
    held = F.pmod(F.xxhash64("doc.doc_id", F.lit("prune")), F.lit(3)) == 0
    picked = stats.select(F.col("doc.low").cast("int"), held.cast("int"), *FEATURES).orderBy("doc.doc_id", *FEATURES).limit(rows)
    return [tuple(r) for r in picked.collect()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the first condition that holds decides."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def quality_report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, the base statistics, base_failed and kept.

    A null text has no words, and an empty or short text fails the base.  No
    labelled row, or none that a precise enough rule finds, leaves the base
    alone.  Rows that repeat a doc_id are judged each; other columns of
    ``docs`` and ``labels`` are not read.
    """
    rules = learn_rules(labelled_sample(docs, labels, sample_rows))
    stats = with_statistics(docs.select("doc_id", "text"))
    return stats.select("doc.doc_id", *BASE, base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    rules = learn_rules(labelled_sample(docs, labels, sample_rows))
    return with_statistics(docs).where(verdict(rules)).select("doc.*")
