"""Quality rules whose thresholds have controlled risk, in DataFrame functions only.

Every text gets counts (words, symbols, repeated lines and words) and, from these, the rates that rules cut. A rule rejects
a text whose rate is above the cutoff of the text's stratum (its language). Cutoffs are chosen from labelled texts:

* A cutoff may be used if false rejection is certified: with k of n good labelled texts of the stratum rejected, the exact binomial
  p-value P(Binomial(n, risk) <= k) must be at most the level.
* Each rule tests its cutoffs from the mildest to the strictest and stops at the first failure, which needs no correction
  within the rule (fixed-sequence testing). The level ``delta`` is shared by all rules and strata (Bonferroni). So with probability 1 - delta, no rule
  rejects more than the share ``risk`` of the good texts of any stratum.
* The grid of cutoffs is fixed beforehand, so labelled texts serve only as the holdout and none are spent on choosing it.

A stratum or rule without enough labelled texts gets no cutoff and rejects nothing. The table of cutoffs has (strata * rules)
rows; it is written first, so Spark knows its size when it joins.

Defined results: null texts have no words. A null language is a stratum of its own. A null label, or a label of an unknown id, is no label; if an id has several
labels, the least counts. Repeated rows are judged alike. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.storage import materialise

#: Separators of words, the symbols that are counted.
BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
GRAM = 5


@dataclass(frozen=True)
class QualityConfig:
    """``risk``: greatest share of good texts one rule may reject; ``delta``: probability that any bound fails."""

    risk: float = 0.01
    delta: float = 0.05


#: Cutoffs of every rule, mildest first.
GRIDS: dict[str, list[float]] = {
    "symbol_rate": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04],
    "upper_rate": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "mark_rate": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08],
    "line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "word_length": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0],
}


def counted(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """doc_id, lang and the counts of every text; ``more`` names columns to carry along."""
    more = more or []
    rows = docs.select(
        *more,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # Words as hashes: an array of longs is far smaller than one of strings.
    flat = F.translate("text", BLANKS[1:], " " * (len(BLANKS) - 1))
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    bare = F.translate("text", BLANKS, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    first = rows.select(
        *more,
        "doc_id",
        "lang",
        F.transform(words, lambda w: F.xxhash64(w)).alias("codes"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(bare) - F.length(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length(bare) - F.length(F.translate(bare, "!?", ""))).cast("long").alias("n_marks"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
    )
    shifted = [F.slice("codes", k + 1, F.greatest(F.size("codes") - F.lit(GRAM - 1), F.lit(0))) for k in range(GRAM)]
    grams = F.transform(F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)]), lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(GRAM)]))
    second = first.withColumns(
        {
            "grams": grams,
            "n_words": F.size("codes").cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("codes", "lines")
    return second.withColumn("n_repeat_words", repeated_words("grams")).drop("grams")


def repeated_words(grams: str) -> Column:
    """Words covered by windows that occur more than once, from the array of window hashes.

    Sorting brings equal windows together; each window equal to a neighbour is a repeat. The repeats' places in
    order then cover GRAM words each, less where the next repeat begins earlier.
    """
    placed = F.array_sort(F.transform(F.col(grams), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.zip_with(
        placed,
        F.slice(placed, 2, F.greatest(F.size(grams) - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.array_sort(F.array_distinct(F.flatten(pairs)))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-GRAM).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(GRAM), s - acc["last"])).alias("n"), s.alias("last")),
        lambda acc: acc["n"],
    )
    some = F.size(F.array_distinct(F.col(grams))) < F.size(grams)
    return F.when(some, covered).otherwise(F.lit(0).cast("long"))


def rates(counts: DataFrame) -> DataFrame:
    """Adds base_failed and the rates that rules cut, 0 for texts without words."""

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumns(
        {
            "base_failed": failed,
            "symbol_rate": share("n_symbols", "word_chars"),
            "upper_rate": share("n_upper", "word_chars"),
            "mark_rate": share("n_marks", "n_words"),
            "line_rate": share("n_dup_lines", "n_lines"),
            "word_length": share("word_chars", "n_words"),
        }
    )


def _log_factorial(x: Column) -> Column:
    """Natural log of x!: exact for small x, else Stirling's series with relative error below 1e-15."""
    y = F.greatest(x, F.lit(20)).cast("double")
    series = (y + 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k <= n * p, and 1 above (the p-value is then of no use).

    The terms fall geometrically from k down, so summing 60 + 12 * sqrt(n) of them reaches double precision.
    """
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    last = F.least(k, F.ceil(60 + 12 * F.sqrt(n.cast("double"))).cast("long"))
    ratio = F.lit((1 - p) / p)
    summed = F.aggregate(
        F.sequence(F.lit(0).cast("long"), last),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * ratio * (k - i) / (n - k + i + 1)).alias("term"), (acc["total"] + acc["term"]).alias("total")
        ),
        lambda acc: acc["total"],
    )
    return F.when(k.cast("double") <= n * F.lit(p), F.exp(top) * summed).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), label: str = "quality") -> DataFrame:
    """(lang, rule, cutoff, n_good, n_rejected, p_value): the certified cutoff of every rule and stratum that has one.

    ``measured`` needs doc_id, lang, base_failed and the rates. Good texts are those labelled 1 that pass the base rules.
    """
    good = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter("_id IS NOT NULL AND _y IS NOT NULL")
        .groupBy("_id")
        .agg(F.min("_y").alias("_y"))
        .filter("_y = 1")
    )
    holdout = measured.filter("NOT base_failed").join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    rejected = [
        F.sum((F.col(rule) > cut).cast("long")).alias(f"{rule}_{i}") for rule, grid in GRIDS.items() for i, cut in enumerate(grid)
    ]
    # One row per stratum, combined on the map side, then one row per candidate.
    sums = holdout.groupBy("lang").agg(F.count(F.lit(1)).alias("n_good"), *rejected)
    candidates = [
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("place"), F.lit(float(cut)).alias("cutoff"), F.col(f"{rule}_{i}").alias("n_rejected"))
        for rule, grid in GRIDS.items()
        for i, cut in enumerate(grid)
    ]
    rows = sums.select("lang", "n_good", F.inline(F.array(*candidates)))
    strata = sums.agg(F.count(F.lit(1)).alias("strata"))
    tested = rows.join(F.broadcast(strata)).withColumn("p_value", binomial_tail(F.col("n_rejected"), F.col("n_good"), config.risk))
    passed = F.col("p_value") <= F.lit(config.delta / len(GRIDS)) / F.col("strata")
    # A chain ends at its first failure: all milder cutoffs must have passed too.
    chain = Window.partitionBy("lang", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    open_still = tested.withColumn("ok", F.min(passed.cast("int")).over(chain) == 1).filter("ok")
    best = open_still.groupBy("lang", "rule").agg(F.max_by(F.struct("cutoff", "n_good", "n_rejected", "p_value"), "place").alias("b"))
    return best.select("lang", "rule", "b.*")


def judge(
    docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), label: str = "quality", more: list[str] | None = None
) -> DataFrame:
    """The counts and rates of every document with ``base_failed``, ``failed_rules`` and ``kept``."""
    measured = materialise(rates(counted(docs, more)), "measured")
    chosen = cutoffs(measured, labels, config, label)
    wide = chosen.groupBy(F.col("lang").alias("_lang")).agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"_cut_{rule}") for rule in GRIDS]
    )
    wide = materialise(wide, "cutoffs")
    joined = measured.join(wide, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    broken = [F.when(F.col(rule) > F.col(f"_cut_{rule}"), F.lit(rule)) for rule in GRIDS]
    out = joined.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("_lang", *[f"_cut_{rule}" for rule in GRIDS])


def keep_good(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    judged = judge(docs.withColumn("_row_key", F.xxhash64(F.col("text").cast("string"))), labels, config, label, more=["_row_key"])
    gone = judged.filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("_row_key").alias("_key"), F.col("lang").alias("_lang"))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
        & (F.xxhash64(F.col("text").cast("string")) == F.col("_key"))
        & F.col("lang").cast("string").eqNullSafe(F.col("_lang"))
    )
    return docs.join(gone, same, "left_anti")
