"""Quality rules: base statistics of a text, and a learned decision list over them.

Everything is a DataFrame expression; no Python runs on the executors. The list is learned by
sequential covering: a rule grows by the threshold condition of most information gain, is cut
back to the conditions that hold on rows it was not grown on, and the rows it covers go before the
next rule is grown. Learning reads grouped counts (feature, bin, label), a few hundred rows at a
time; the result is one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from metricloom.llm import common

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Labelled rows of each quality that the list is learned from, the first by a hash of their ids.
SAMPLE = 3000
#: Thresholds tried per feature, conditions per rule, rules, share of low quality a rule must have on the rows kept for pruning.
BINS, CONDITIONS, RULES, PRECISION = 24, 3, 8, 0.95
FEATURES = ["n_words", "mean_word", "symbol_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "line_words"]


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once per row."""
    return F.transform(F.array(value), use)[0]


def repeat_words(hashes: Column) -> Column:
    """Words in windows of 8 that occur twice or more, from the array of word hashes."""
    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda p: F.filter(
            F.transform(p, lambda x, j: F.when((x.h == F.get(p, j - 1).h) | (x.h == F.get(p, j + 1).h), x.i)), lambda i: i.isNotNull()))
        return let(F.sort_array(twice), lambda at: F.aggregate(
            F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))
    # sorting is only for texts that repeat a window
    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(hashes) >= WINDOW, some).otherwise(F.lit(0)).cast("long")


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, and the features of the decision list, of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = lambda gone: (F.length("text") - F.length(F.translate("text", gone, ""))).cast("long")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(
        F.size(h).cast("long").alias("n_words"), repeat_words(h).alias("n_repeat_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct")))
    about = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = cut.select("doc_id", facts.alias("w"), about.alias("l"), (F.length("text") - length(SPACE)).cast("long").alias("word_chars"),
                      length(SYMBOLS).alias("n_symbols"), length("0123456789").alias("n_digits"))
    rows = rows.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_digits")
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return rows.withColumns({
        "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "digit_share": share("n_digits", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"), "line_words": share("n_words", "n_lines")})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    @property
    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def all_of(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column
    return out


def thresholds(sample: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    at = [i / bins for i in range(1, bins)]
    row = sample.agg(*(F.percentile_approx(F.col(f).cast("double"), at, 10000).alias(f) for f in features)).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """Rows of low and other quality that each single condition covers, by one grouped count."""
    bin_of = lambda f, c: F.lit(0) + sum((F.when(F.col(f) > t, 1).otherwise(0) for t in c), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), bin_of(f, c).alias("bin")) for f, c in cuts.items())))
    table: dict = defaultdict(lambda: [0, 0])
    for r in rows.select("bad", each.alias("x")).groupBy("x.feature", "x.bin", "bad").count().collect():
        table[r.feature, r.bin][0 if r.bad else 1] = r["count"]
    out = {}
    for f, c in cuts.items():
        for k, t in enumerate(c):
            # bin b has b thresholds below it
            low = [sum(table[f, b][s] for b in range(k + 1)) for s in (0, 1)]
            high = [sum(table[f, b][s] for b in range(k + 1, len(c) + 1)) for s in (0, 1)]
            out[Condition(f, False, t)], out[Condition(f, True, t)] = tuple(low), tuple(high)
    return out


def grow(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> list[Condition]:
    rule: list[Condition] = []
    tally = rows.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    p, n = tally[0], tally[1]
    while p and n and len(rule) < most:
        gain = lambda x, p=p, n=n: x[0] * (math.log2(x[0] / (x[0] + x[1])) - math.log2(p / (p + n))) if x[0] else 0.0
        found = counts(rows.where(all_of(rule)), cuts)
        best = max(found, key=lambda c: (gain(found[c]), str(c)), default=None)
        if best is None or gain(found[best]) <= 0:
            break
        rule.append(best)
        p, n = found[best]
    return rule


def prune(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], float]:
    """The first conditions of the rule that do best on rows it was not grown on, and their precision there."""
    if not rule:
        return rule, 0.0
    sums = [c for k in range(1, len(rule) + 1) for c in (F.count_if(all_of(rule[:k]) & F.col("bad")), F.count_if(all_of(rule[:k]) & ~F.col("bad")))]
    row = rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first()
    worth = lambda k: (row[2 * k - 2] - row[2 * k - 1]) / max(1, row[2 * k - 2] + row[2 * k - 1])
    k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
    p, n = row[2 * k - 2], row[2 * k - 1]
    return rule[:k], p / (p + n) if p + n else 0.0


def learn(sample: DataFrame, features: list[str] = FEATURES, bins: int = BINS, conditions: int = CONDITIONS, most: int = RULES, precision: float = PRECISION) -> list[list[Condition]]:
    """Ordered rules for low quality from labelled rows (features, bad, grown)."""
    rules: list[list[Condition]] = []
    left = sample
    while len(rules) < most:
        cuts = thresholds(left.where("grown"), features, bins)
        rule, sure = prune(left.where("not grown"), grow(left.where("grown"), cuts, conditions))
        if not rule or sure < precision:
            break
        rules.append(rule)
        left = sample.where(~decided(rules))
    return rules


def decided(rules: list[list[Condition]]) -> Column:
    """Whether a rule of the list fits: the first that does decides."""
    out = None
    for rule in rules:
        out = F.when(all_of(rule), True) if out is None else out.when(all_of(rule), True)
    return F.lit(False) if out is None else out.otherwise(False)


def labelled(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` labelled rows of each quality, with features; a third is kept for pruning. Several labels of an id: the lowest."""
    once = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    once = once.withColumn("order", F.xxhash64("doc_id"))
    both = [once.where(c).orderBy("order", "doc_id").limit(sample) for c in ("bad", "not bad")]
    return stats.join(F.broadcast(both[0].unionByName(both[1])), "doc_id").withColumn("grown", F.expr("pmod(order, 3) != 0")).drop("order")


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics, features, base_failed, kept, and the rule that decided (null: none).

    Defined results: a null or empty text has no words and fails the base rule; a null doc_id stays
    null; repeated rows are judged each; without labels of both kinds the list is empty and only
    the base rule drops; other columns are ignored.
    """
    stats = common.settle(base_statistics(docs))
    rules = learn(common.settle(labelled(stats, labels, sample)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    name = F.coalesce(*(F.when(all_of(r), F.lit(" and ".join(map(str, r)))) for r in rules), F.lit(None).cast("string"))
    return stats.withColumns({"base_failed": failed, "rule": name, "kept": ~failed & ~decided(rules)})
