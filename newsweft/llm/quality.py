"""Quality rules whose cutoffs are certified on labelled holdouts.

Features of a text (words are runs of anything but 0x20 and 0x09-0x0D): shares of symbols, of repeated
lines, of words in repeated 3-word windows, and of capital letters.  A document whose feature exceeds the
cutoff of its stratum (its language) is rejected.

Cutoffs come from labelled documents and are risk-controlled:

* labelled documents are dealt by a hash of the text, so copies together, into a fitting half and a holdout half;
* for each (stratum, feature, cutoff of the fixed grid) the holdout gives n good documents and k of them
  falsely rejected; a cutoff is certified if the exact binomial tail P(Bin(n, alpha / features) <= k) is at most
  delta / (number of strata x features x cutoffs), that is, if the exact upper confidence bound of the false
  rejection rate is below the rule's part of alpha, with Bonferroni correction over all tests;
* of the certified cutoffs the one with the best balance on the fitting half is taken
  (bad ones caught, less ``PENALTY`` times the good ones lost; none if that is not positive).

So with probability 1 - delta the rules together reject no more than alpha of the good documents of any stratum, whichever
cutoffs are taken.  A stratum with too few labels certifies nothing and rejects by the base rule alone.

Only DataFrame functions are used, and nothing but counts is shuffled.  Defined results: a null text
is empty; a null stratum is a stratum of its own; labels without a document, with a null id or a null quality
are ignored; a document labelled twice counts twice; empty tables give empty results; repeated rows are
judged alike; all columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.binding import let
from newsweft.llm.common import cut_lineage, set_aside

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
ALPHA = 0.01  # false rejections allowed per stratum, all rules together
DELTA = 0.05  # chance that any certified bound is wrong
PENALTY = 20  # good documents lost weigh so many times a bad one caught
MIN_WORDS = 50
SMALL_TABLE = 10_000  # rows of cutoffs that may be broadcast
GRID = {
    "symbol_share": [0.005, 0.01, 0.02, 0.04, 0.08, 0.16],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.5],
    "repeat_share": [0.1, 0.2, 0.3, 0.4],
    "capital_share": [0.1, 0.2, 0.3, 0.5],
}


def _repeat_words(hashes: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more; a window is three words."""

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        hit = F.filter(
            pairs,
            lambda p, i: ((i > 0) & (F.get(pairs, F.greatest(i - 1, F.lit(0)))["h"] == p["h"])) | ((i < last) & (F.get(pairs, F.least(i + 1, last))["h"] == p["h"])),
        )
        starts = F.array_sort(F.transform(hit, lambda p: p["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(s, i + 1) - x), F.lit(3))), F.lit(0), lambda a, b: a + b))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered)))


def measure(documents: DataFrame) -> DataFrame:
    """The input columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (all long).

    Every array is bound in a projection of its own, so no text is split twice.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = documents.withColumns(
        {
            "_words": F.filter(F.split(text, WORD_BREAK, -1), lambda w: w != ""),
            "_lines": F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""),
            "n_symbols": F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")),
            "n_capitals": F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", "")),
        }
    )
    counted = words.withColumns(
        {
            "_size": F.size("_words"),
            "word_chars": F.length(F.array_join("_words", "")),
            "n_lines": F.size("_lines"),
            "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
            "_hashes": F.transform(
                F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>")),
                lambda i: F.xxhash64(F.get(F.col("_words"), i), F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2)),
            ),
        }
    )
    return counted.select(
        *documents.columns,
        F.col("_size").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_hashes")).cast("long").alias("n_repeat_words"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_capitals").cast("long").alias("n_capitals"),
        F.xxhash64(text).alias("text_hash"),
    )


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def features() -> dict[str, Column]:
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "capital_share": _share("n_capitals", "word_chars"),
    }


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed exactly in logarithms."""
    start = n * F.log1p(F.lit(-rate))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.log(F.lit(rate / (1 - rate)))
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.least(k, n))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(start.alias("term"), start.alias("total")), step, lambda acc: acc["total"])
    return F.least(F.exp(total), F.lit(1.0))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, feature, cutoff): at most one row per stratum and feature."""
    names = list(GRID)
    good = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 1).alias("good"))
    judged = measured.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("_id"), "text_hash", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *[v.alias(k) for k, v in features().items()]
    )
    tests = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("cutoff"), (F.col(f) > c).alias("over")) for f in names for c in GRID[f]])).alias("t")
    held = F.pmod("text_hash", F.lit(2)) == 0  # copies lie in one half
    counts = (
        judged.join(good, "_id")
        .select("stratum", "good", held.alias("held"), tests)
        .select("stratum", "good", "held", "t.*")
        .groupBy("stratum", "feature", "cutoff")
        .agg(
            F.count_if(F.col("good") & F.col("held")).alias("n"),
            F.count_if(F.col("good") & F.col("held") & F.col("over")).alias("k"),
            F.count_if(F.col("good") & ~F.col("held") & F.col("over")).alias("lost"),
            F.count_if(~F.col("good") & ~F.col("held") & F.col("over")).alias("caught"),
        )
    )
    counts = cut_lineage(counts)
    number = max(1, counts.count())
    fit = F.col("caught") - PENALTY * F.col("lost")
    passed = counts.filter((binomial_tail(F.col("n"), F.col("k"), alpha / len(names)) <= delta / number) & (fit > 0))
    return passed.groupBy("stratum", "feature").agg(F.max(F.struct(fit.alias("fit"), F.col("cutoff"))).alias("best")).select("stratum", "feature", "best.cutoff")


def judge(documents: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The input columns without the text, the measures, base_failed, kept and text_hash.

    One row per input row; a column of the input that has the name of one of these gives way to it.  The measures are written
    once to the shared folder.
    """
    documents, columns = set_aside(documents, "doc_id", "text", stratum)
    measured = cut_lineage(measure(documents).drop("text"))
    cutoffs = certified_cutoffs(measured, labels, stratum, alpha, delta)
    names = list(GRID)
    wide = cut_lineage(cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("feature") == f, F.col("cutoff"))).alias(f"_{f}") for f in names]).withColumnRenamed("stratum", "_stratum"))
    if wide.count() <= SMALL_TABLE:
        wide = F.broadcast(wide)
    values = features()
    rejected = F.lit(False)
    for f in names:
        rejected = rejected | F.coalesce(values[f] > F.col(f"_{f}"), F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = measured.join(wide, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("_stratum"), "left")
    own = [F.col(c) for c in measured.columns if c not in documents.columns]
    judged = joined.select(*[c for i, c in zip(documents.columns, columns) if i != "text"], *own, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
    new = len(documents.columns) - 1
    taken = {c.lower() for c in judged.columns[new:]}
    left = [i for i, c in enumerate(judged.columns) if i >= new or c.lower() not in taken]
    names_now = judged.columns
    return judged.toDF(*[f"c{i}" for i in range(len(names_now))]).select(*[F.col(f"c{i}").alias(names_now[i]) for i in left])


def keep_good(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``documents`` that the rules keep, with their columns.

    Rows are matched to verdicts by id and text hash; equal rows share a verdict.
    """
    inner, columns = set_aside(documents, "doc_id", "text", stratum)
    bad = judge(inner.select("doc_id", "text", stratum), labels, stratum).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_bad")).distinct()
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_bad"))
    return inner.join(bad, own, "left_anti").select(*columns)
