"""Quality rules with risk-controlled thresholds (native: DataFrame functions only).

Each rule rejects a document whose value is over a cutoff. Cutoffs come from labelled documents: within a
stratum (language) a rule walks a fixed list of cutoffs from lenient to strict; a cutoff is accepted while the
exact binomial tail P(Bin(n, a) <= x) stays within its share of delta, where n counts the good labelled
documents that pass the base rules, x those the cutoff would reject and a is the rule's share of alpha. The
walk stops at the first failure (fixed-sequence testing needs no correction along a walk); delta is divided by
the number of strata times rules (Bonferroni). With confidence 1 - delta, in every stratum all rules together
then reject at most a share alpha of good documents. A stratum with too few labels accepts no cutoff and
rejects nothing by the method.

Cases: null text counts as empty (no words, so the base rule fails it); null language is a stratum of its own;
repeated labels of a document count once, the lowest quality wins; labels without a quality or document count
nothing; repeated documents are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, staged, word_array

#: Symbol characters, and each rule's cutoffs from lenient to strict.
SYMBOLS = "#*$%&|<>"
CUTOFFS = {
    "symbols": [0.80, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05, 0.04, 0.03],
    "dup_lines": [0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15],
    "repeats": [0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15],
    "word_length": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0],
}
ALPHA, DELTA = 0.04, 0.05
MIN_WORDS = 50

METRICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def with_metrics(df: DataFrame, text_col: str, into: str = "__vw_metrics") -> DataFrame:
    """Add a struct column of METRICS (longs) of each whole text; all other columns stay."""
    p = "__vw_q_"
    text, words, hashes, grams, twice, at = (F.col(p + x) for x in ("text", "words", "hashes", "grams", "twice", "at"))
    n = F.size(words)
    same = lambda x, i: F.coalesce(F.get(grams, i)["h"] == x["h"], F.lit(False))
    return (
        df.withColumn(p + "text", F.coalesce(F.col(text_col), F.lit("")))
        .withColumn(p + "words", word_array(text))
        .withColumn(p + "lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")))
        .withColumn(p + "hashes", F.when(n > 3, F.transform(F.slice(words, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))))
        # where windows repeat: sorted by hash, equal ones are neighbours
        .withColumn(p + "grams", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
        .withColumn(p + "twice", F.filter(grams, lambda x, i: same(x, i - 1) | same(x, i + 1)))
        .withColumn(p + "at", F.sort_array(F.transform(twice, lambda x: x["p"])))
        .withColumn(
            into,
            F.struct(
                n.cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                F.size(p + "lines").cast("long").alias("n_lines"),
                (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("long").alias("n_dup_lines"),
                # each repeated window covers up to the next one's start, three words at most
                F.coalesce(F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
            ),
        )
        .drop(*(p + x for x in ("text", "words", "lines", "hashes", "grams", "twice", "at")))
    )


def base_failed(m: str | None = "__vw_metrics") -> Column:
    c = lambda x: F.col(f"{m}.{x}" if m else x)
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def rule_values(m: str | None = "__vw_metrics") -> dict[str, Column]:
    c = lambda x: F.col(f"{m}.{x}" if m else x).cast("double")
    share = lambda a, b: a / F.greatest(b, F.lit(1.0))
    return {
        "symbols": share(c("n_symbols"), c("word_chars")),
        "dup_lines": share(c("n_dup_lines"), c("n_lines")),
        "repeats": share(c("n_repeat_words"), c("n_words")),
        "word_length": share(c("word_chars"), c("n_words")),
    }


def ln_factorial(m: Column) -> Column:
    """ln(m!) for m >= 0: exact products below 20, Stirling's series above (error under 1e-12)."""
    z = m.cast("double") + 1.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    small = F.array(*(F.lit(math.log(math.factorial(i))) for i in range(20)))
    return F.when(m < 20, F.get(small, F.least(m, F.lit(19)).cast("int"))).otherwise(series)


def binomial_tail(x: Column, n: Column, a: float) -> Column:
    """P(Bin(n, a) <= x); 1 where x is at or over the mean, as no test can pass there."""
    odds = (1 - a) / a
    ln_pmf = ln_factorial(n) - ln_factorial(x) - ln_factorial(n - x) + x * math.log(a) + (n - x) * math.log1p(-a)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (x - i + 1).cast("double") / (n - x + i).cast("double") * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    # below the mean the j-th term down is at most exp(-j * (j - 1) / (2 * n * a)) of the first: what 10 * sqrt(n) terms leave out is under 1e-20 of it
    upto = F.least(x, F.ceil(F.sqrt(n) * 10) + 1).cast("long")
    steps = F.when(upto > 0, F.sequence(F.lit(1).cast("long"), F.greatest(upto, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    tail = F.when(x < n * a, F.aggregate(steps, start, add, lambda acc: acc["sum"])).otherwise(1.0)
    return F.when((n <= 0) | (x >= n * a), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(ln_pmf) * tail))


def select_cutoffs(good: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """good: a row for each good labelled document that passes the base rules, with METRICS. One row per stratum:
    n_good and a cutoff for each rule (null: none accepted). Counts only, so its size is the number of strata."""
    values, share = rule_values(None), alpha / len(CUTOFFS)
    tests = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"__x_{r}_{i}").alias("x")) for r, cs in CUTOFFS.items() for i, c in enumerate(cs)]
    counts = good.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n_good"), *(F.count_if(values[r] > c).alias(f"__x_{r}_{i}") for r, cs in CUTOFFS.items() for i, c in enumerate(cs))
    )
    walks = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy())).select("stratum", "n_good", "strata", F.inline(F.array(*tests)))
    ok = binomial_tail(F.col("x"), F.col("n_good"), share) <= delta / (F.col("strata") * len(CUTOFFS))
    walk = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    accepted = walks.withColumn("ok", ok).withColumn("ok", F.min("ok").over(walk))
    return accepted.groupBy("stratum").agg(
        F.first("n_good").alias("n_good"), *(F.min(F.when(F.col("ok") & (F.col("rule") == r), F.col("cutoff"))).alias(f"cut_{r}") for r in CUTOFFS)
    )


def rejected(values: dict[str, Column]) -> Column:
    out = F.lit(False)
    for r, v in values.items():
        out = out | F.coalesce(v > F.col(f"cut_{r}"), F.lit(False))
    return out


def _labels(labels: DataFrame, id_col: str, quality_col: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("doc_id"), F.col(quality_col).alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          label_id: str = "doc_id", quality_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: id, stratum, METRICS, base_failed, the stratum's cutoffs, kept."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("__vw_text"))
    m = staged(with_metrics(slim, "__vw_text").select("doc_id", "stratum", "__vw_metrics.*").withColumn("base_failed", base_failed(None)), "quality")
    good = m.join(_labels(labels, label_id, quality_col).where("quality = 1"), "doc_id", "left_semi").where("not base_failed")
    cuts = select_cutoffs(good, "stratum", alpha, delta).withColumnRenamed("stratum", "__cut_stratum")
    return m.join(cuts, F.col("stratum").eqNullSafe(F.col("__cut_stratum")), "left").drop("__cut_stratum").withColumn("kept", ~F.col("base_failed") & ~rejected(rule_values(None)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns. Measured documents are settled as a table (a filter
    on the metrics themselves would be pushed into them and take them apart); the cutoffs have a row per stratum."""
    row = lambda c: F.col("row").getField(c)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    measured = staged(with_metrics(whole.withColumn("text", row(text_col)), "text").drop("text"), "measured")
    slim = measured.select(row(id_col).alias("doc_id"), row(stratum_col).alias("stratum"), "__vw_metrics.*").where(~base_failed(None))
    good = slim.join(_labels(labels, "doc_id", "quality").where("quality = 1"), "doc_id", "left_semi")
    cuts = staged(select_cutoffs(good, "stratum").withColumnRenamed("stratum", "cut_stratum"), "cutoffs")
    judged = measured.where(~base_failed()).join(cuts, row(stratum_col).eqNullSafe(F.col("cut_stratum")), "left").where(~rejected(rule_values()))
    return judged.select("row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    out = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
