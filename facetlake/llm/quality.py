"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Method: every document has a few signals. Each signal has a row of cutoffs from lenient to strict, step by step in common; a
document's level is the first step at which any signal fails. For each stratum and step, labelled good documents give the
number of false rejections; the step is certified where an exact binomial tail says that a false-rejection rate of ``risk`` or
more would show so few with probability at most ``delta``, divided by the number of all tests (Bonferroni). The strictest
certified step is the stratum's cutoff; a stratum without one rejects nothing beyond the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sharing import written

#: Fixed: ASCII white space, symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
#: Cutoffs of each signal, lenient to strict; a value above the cutoff fails.
CUTOFFS = {
    "symbol_share": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "repeat_share": [0.98, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.55, 0.5, 0.45],
    "dup_line_share": [0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25],
    "long_words": [40.0, 35.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0],
    "short_words": [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45],
}
STEPS = 10
#: Strata up to which their cutoffs may be broadcast.
BROADCAST_STRATA = 10_000


def signals(df: DataFrame, text_col: str = "text", stratum_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, level) of every row; null text has no words.

    n_repeat_words counts the words covered by 3-word windows that occur twice or more; windows are compared by 64-bit hashes.
    level is the first step (from 0) at which a signal fails, STEPS where none does.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"), F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "").alias("w"))
    windows = F.transform(F.arrays_zip(F.col("w"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0)))), lambda z: F.xxhash64(z))
    windows = F.when(F.size("w") >= 3, F.slice(windows, 1, F.size("w") - 2)).otherwise(F.array().cast("array<long>"))
    worded = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        worded.alias("lines"),
        windows.alias("h"),
    )
    at = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("at", F.when(F.size(F.array_distinct("h")) < F.size("h"), at))
    same = lambda a, b: F.get(F.col("at"), a)["h"] == F.get(F.col("at"), b)["h"]
    twice = F.filter(F.col("at"), lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    rows = rows.select(
        "id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.when(F.col("at").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.greatest(F.col(b), F.lit(1))).otherwise(0.0)
    value = {
        "symbol_share": share("n_symbols", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "long_words": share("word_chars", "n_words"),
        "short_words": F.when(F.col("word_chars") > 0, F.col("n_words") / F.greatest(F.col("word_chars"), F.lit(1))).otherwise(0.0),
    }
    return rows.select("id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.least(*(_step(value[s], c) for s, c in CUTOFFS.items())).alias("level"))


def _step(value: Column, cutoffs: list[float]) -> Column:
    """The first step whose cutoff the value exceeds, else STEPS."""
    out = F.lit(STEPS)
    for k in range(STEPS - 1, -1, -1):
        out = F.when(value > cutoffs[k], k).otherwise(out)
    return out


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial by its terms in logarithms; 1 where k is at least n * p (it is over 0.4 there)."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    step = lambda acc, i: F.struct(
        (acc["term"] + F.log((n - i + 1) / i.cast("double")) + odds).alias("term"),
        (acc["sum"] + F.exp(acc["term"] + F.log((n - i + 1) / i.cast("double")) + odds)).alias("sum"),
    )
    total = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda acc: acc["sum"])
    return F.when(k >= n * p, 1.0).otherwise(total)


def certified(found: DataFrame, labels: DataFrame, risk: float, delta: float, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, cutoff): the strictest certified step of each stratum that has one.

    Labels repeated for an id count once, as the largest; null ids and labels don't count.
    """
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("good")).where("good = 1")
    held = found.join(good, found["id"] == good["label_id"], "left_semi")
    by = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum((F.col("level") <= k).cast("long")).alias(f"k{k}") for k in range(STEPS)))
    tests = by.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"k{k}").alias("k")) for k in range(STEPS)))).alias("t")).select("stratum", "n", "t.*")
    m = by.agg((F.count("*") * STEPS).alias("m"))
    passed = tests.join(F.broadcast(m)).where(binomial_tail(F.col("k"), F.col("n"), risk) <= F.lit(delta) / F.col("m"))
    return passed.groupBy("stratum").agg(F.max("step").alias("cutoff"))


def judge(df: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, level, cutoff, kept) of every row.

    Each stratum (null is one too) rejects at most ``risk`` of its good documents by the certified cutoff, all strata together
    with probability 1 - ``delta``. Null and empty texts have no words and fail the base rules. Repeated rows and ids stay.
    Other columns are ignored. Empty tables give an empty result; without labels only the base rules reject.
    """
    found = written(signals(df, text_col, stratum_col, id_col), "signals")
    cutoffs = written(certified(found, labels, risk, delta), "cutoffs").withColumnRenamed("stratum", "of")
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    joined = found.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & ~F.coalesce(F.col("level") <= F.col("cutoff"), F.lit(False))
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "level", "cutoff", kept.alias("kept"))
