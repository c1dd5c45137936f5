"""Quality rules whose cutoffs are risk-controlled by exact binomial bounds.

Base rules are fixed. Beyond them, each rule of RULES compares a measure of the text with a cutoff
chosen per stratum on all labelled documents: going from the loosest cutoff of a fixed grid to tighter ones,
each is tested with the exact binomial tail against "it rejects more than its share of good documents", and the
last one before the first failure is used. Testing in a fixed order needs no correction along the grid; the rules
and strata share the error probability equally (Bonferroni), and the rules of a stratum share the
permitted rate of false rejections, so with probability 1 - DELTA no stratum loses more than ALPHA of its good documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import among, stored, with_row_id

#: Words, symbols and windows of the base measures.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Permitted rate of false rejections, error probability.
ALPHA, DELTA = 0.01, 0.05
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def _rules() -> dict[str, tuple[Column, list[float]]]:
    """rule -> measure (larger is worse) and its grid from the loosest cutoff to the tightest."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    shares = [x / 50 for x in range(50, 0, -1)]
    return {
        "symbols": (F.col("n_symbols") / words, [x / 10 for x in range(40, 0, -1)]),
        "dup_lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"), shares),
        "repeats": (F.col("n_repeat_words") / words, shares),
        "long_words": (F.col("word_chars") / words, [float(x) for x in range(60, 5, -1)]),
    }


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeats = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        times = Counter(windows)
        if len(times) < len(windows):
            covered = 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeats += i + WINDOW - max(covered, i)
                    covered = i + WINDOW
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(lines), repeats


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base measures and base_failed; whole texts, a null text has no words. Columns with these names are replaced."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    base = docs.drop(*names, "base_failed")

    @F.pandas_udf(MEASURES)
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(x) for x in texts], columns=names)

    out = base.withColumn("_m", solve(F.col(text))).select(*base.columns, *[F.col(f"_m.{n}").alias(n) for n in names])
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of Binomial(n, p), summed from its largest terms."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = min(k, int((n + 1) * p))
    terms, total = [range(top, -1, -1), range(top + 1, k + 1)], 0.0
    for part in terms:
        for i in part:
            x = math.exp(log(i))
            total += x
            if x < 1e-18 * max(total, 1e-300) and total:
                break
    return min(1.0, total)


def stratum(column: str) -> Column:
    """A stratum's name, never null: `=` and the value, or `null`."""
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def testable(sizes: dict[str, int], rules: int, alpha: float, delta: float) -> list[str]:
    """The largest strata, as many as leave each large enough for a test to succeed when the error probability is shared by all of them."""
    ranked = sorted(sizes, key=lambda name: (-sizes[name], name))
    enough = [m for m, name in enumerate(ranked, 1) if sizes[name] >= math.log(delta / (rules * m)) / math.log1p(-alpha / rules)]
    return ranked[: max(enough, default=0)]


def fit_cutoffs(measured: DataFrame, labels: DataFrame, by: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> list[tuple[str, str, float]]:
    """(stratum, rule, cutoff) for each rule that may be used there.

    All labelled documents take part: labels has doc_id and quality (1: good); a doc_id is good if its largest
    quality is 1, null labels are ignored. Good documents that fail the base rules or lack a measure do not count, as no cutoff decides
    on them. Each value of `by`, null included, is a stratum tested on its own labels; one with too few of them for a test to succeed gets no cutoff.
    What reaches the driver is one count for each stratum, rule and grid step.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    seen = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    rules = _rules()
    steps = [F.struct(F.lit(name).alias("rule"), sum([(m > g).cast("int") for g in grid], F.lit(0)).alias("step")) for name, (m, grid) in rules.items()]
    counts = seen.select(stratum(by).alias("stratum"), F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "s.rule", "s.step").agg(F.count("*").alias("n")).collect()
    table: dict[tuple[str, str], Counter] = {}
    for r in counts:
        table.setdefault((r["stratum"], r["rule"]), Counter())[r["step"]] += r["n"]
    tested = testable({name: sum(c.values()) for (name, _), c in table.items()}, len(rules), alpha, delta)
    cutoffs = []
    for name, rule in [(t, r) for t in sorted(tested) for r in sorted(rules)]:
        c, grid, best = table[name, rule], rules[rule][1], None
        for i, cut in enumerate(grid):
            rejected = sum(v for step, v in c.items() if step >= len(grid) - i)  # step: how many cutoffs the measure is above
            if binomial_tail(rejected, sum(c.values()), alpha / len(rules)) > delta / (len(rules) * len(tested)):
                break
            best = cut
        if best is not None:
            cutoffs.append((name, rule, best))
    return cutoffs


def apply_rules(measured: DataFrame, cutoffs: list[tuple[str, str, float]], by: str = "lang") -> DataFrame:
    """Adds kept (boolean). A stratum without a tested cutoff is judged by the base rules alone."""
    fails = F.col("base_failed")
    for rule, (measure_of, _) in _rules().items():
        found = [F.lit(x) for name, r, cut in cutoffs if r == rule for x in (name, cut)]
        if found:
            fails = fails | F.coalesce(measure_of > F.element_at(F.create_map(*found), stratum(by)), F.lit(False))
    return measured.withColumn("kept", ~fails)


def judge(docs: DataFrame, labels: DataFrame, by: str = "lang", keep_text: bool = True) -> DataFrame:
    """Measures, cutoffs fitted on the labelled documents, and the verdict `kept` for every row.

    Every text is measured once and stored with its measures; labels are joined with the measures alone, so no text is shuffled. keep_text: whether the result has the
    texts. Without labels only the base rules decide. Repeated rows are judged alike; an empty table gives an empty result. Input columns with the added
    names are replaced, others carried.
    """
    measured = with_measures(docs)
    table = stored(measured if keep_text else measured.drop("text"), "measures")
    return apply_rules(table, fit_cutoffs(table, labels, by), by)


def kept_documents(docs: DataFrame, labels: DataFrame, by: str = "lang") -> DataFrame:
    """The rows that judge() keeps, with their own columns. Only measures are stored; texts are read a second time and neither written nor shuffled. Names that start with _ are reserved."""
    ided = with_row_id(docs)
    judged = judge(ided.select("_rid", "doc_id", "text", *{by} - {"doc_id", "text"}), labels, by, keep_text=False)
    return among(ided, judged.where("kept").select("_rid"), "_rid").select(*docs.columns)
