"""Quality rules with robust multivariate outliers (operator 9), DataFrame functions only.

*Base.*  Per document, inside its row: words, their characters, symbols, repeated
lines, and words that lie in 5-word windows found twice or more.

*Method.*  Documents that pass the base rules are described by four transformed
statistics (mean word length, share of symbols, share of repeated words, words
per line; see ``statistics``).  Per language and source a minimum covariance
determinant estimate is made: from the documents nearest to the medians, a few
concentration steps each take mean and covariance of the ``SUPPORT`` share of
documents with the least Mahalanobis distances under the step before.  Documents
whose final squared distance is beyond ``CUTOFF`` are rejected.

*Scale and repeatability.*  A step is one aggregation: distances are binned,
counts and moments are summed per (group, bin) on the map side, and running sums
over a group's bins find where the support ends.  So a group that holds a third
of all rows is no larger task than any other.  Statistics are whole thousandths
and moments exact decimals, so results don't depend on the order of the sums.

Groups of fewer than ``GROUP_ROWS`` documents are taken together per language; if
these are still fewer, they are held against all documents of the language, or if
that has too few, against all documents: every document that passes the base rules
has a distance.  ``FLOOR`` is added to
each variance: a statistic that hardly varies (most documents hold no symbol)
mustn't turn a small difference into a large distance.

Defined results: null text has no words (and fails the base rules, as all texts
of fewer than ten words do); null ``lang`` and ``source`` are values like others;
repeated rows each give a row; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.llm.common import written

WINDOW = 5
SUPPORT = 0.75
STEPS = 4
#: Passing documents of an estimate, for four means and ten covariances.
GROUP_ROWS = 20
#: Added to the variances of the statistics (in their own units).
FLOOR = 0.25**2
#: Of the squared distance: the chi-square quantile (4 degrees of freedom) that one in a million exceeds.
CUTOFF = 33.38
#: The covariance of the nearest three quarters times this estimates that of all (normal data, 4 dimensions).
CONSISTENCY = 1.4866
#: Shares are told in tenths, so that ``FLOOR`` is a spread of 2.5 % of the words.
SHARE_SCALE = 10
#: Words and lines added to a text's own, so that short texts don't swing far.
PRIOR_WORDS, PRIOR_WORD_CHARS, PRIOR_LINES = 50, 5, 5

NAMES = ("s1", "s2", "s3", "s4")
_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""

    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, hashes: Column, windows: Column) -> Column:
    """Words inside windows that are found twice or more.

    Windows are compared by hash, and where hashes agree word by word.  Sorted
    by (hash, place), copies are neighbours; sorted places give the union of the
    windows as a sum of gaps.
    """

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, WINDOW) == F.slice(words, b["i"] + 1, WINDOW))

    def places(by_hash: Column) -> Column:
        last = F.size(by_hash) - 1
        found = F.filter(by_hash, lambda w, k: F.when(k > 0, same(w, F.get(by_hash, k - 1))).otherwise(False)
                         | F.when(k < last, same(w, F.get(by_hash, k + 1))).otherwise(False))
        return F.sort_array(F.transform(found, lambda w: w["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = _let(by_hash, lambda s: _let(places(s), covered))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(0)


def base_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the base columns of every row, whole texts."""

    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "lang", "source", text.alias("text")).select(
        "doc_id", "lang", "source", "text",
        F.array_remove(F.split("text", _SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    hashed = split.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    windows = F.when(n >= WINDOW, F.transform(
        F.slice("hashes", F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))),
        lambda h, i: F.xxhash64(h, *(F.get(F.col("hashes"), i + k) for k in range(1, WINDOW)))))
    windowed = hashed.withColumn("windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    counted = windowed.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("hashes"), F.col("windows")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"))
    return counted.withColumn("base_failed", (F.col("n_words") < 10)
                              | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def statistics() -> dict[str, Column]:
    """The transformed statistics in whole thousandths."""

    n = F.col("n_words") + PRIOR_WORDS
    values = (
        (F.col("word_chars") + PRIOR_WORDS * PRIOR_WORD_CHARS) / n,
        SHARE_SCALE * F.col("n_symbols") / n,
        SHARE_SCALE * F.col("n_repeat_words") / n,
        F.log(n / (F.col("n_lines") + PRIOR_LINES)),
    )
    return {name: F.round(value * 1000).cast("long") for name, value in zip(NAMES, values)}


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _squared_distance() -> Column:
    """By forward substitution with the Cholesky factor in columns ``l_a_b``."""

    solved: dict[str, Column] = {}
    for i, a in enumerate(NAMES):
        rest = F.col(a) / 1000.0 - F.col(f"m_{a}")
        for b in NAMES[:i]:
            rest = rest - F.col(f"l_{a}_{b}") * solved[b]
        solved[a] = rest / F.col(f"l_{a}_{a}")
    return _add([y * y for y in solved.values()])


def _estimates(sums: DataFrame) -> DataFrame:
    """Mean ``m_*`` and Cholesky factor ``l_*_*`` per group from exact counts and moments."""

    out = sums
    n = F.col("n").cast("decimal(38,0)")
    for a in NAMES:
        out = out.withColumn(f"m_{a}", F.col(a).cast("double") / F.col("n") / 1000.0)
    for a, b in _PAIRS:  # n times the sum of products less the product of sums, exactly, then as a covariance
        spread = (n * F.col(f"{a}_{b}") - F.col(a) * F.col(b)).cast("double")
        cov = spread / F.col("n") / F.col("n") / 1e6 * CONSISTENCY + (FLOOR if a == b else 0.0)
        out = out.withColumn(f"c_{a}_{b}", cov)
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[: i + 1]):
            rest = F.col(f"c_{a}_{b}")
            for c in NAMES[:j]:
                rest = rest - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(rest) if a == b else rest / F.col(f"l_{b}_{b}"))
    return out.select("grp", *(f"m_{a}" for a in NAMES), *(f"l_{a}_{b}" for a, b in _PAIRS))


def _support_sums(placed: DataFrame) -> DataFrame:
    """Counts and moments of each group's nearest ``SUPPORT`` share, whole bins; ``placed`` has ``bin``."""

    wide = {a: F.col(a).cast("decimal(20,0)") for a in NAMES}
    binned = placed.groupBy("grp", "bin").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(wide[a]).alias(a) for a in NAMES),
        *(F.sum((F.col(a) * F.col(b)).cast("decimal(20,0)")).alias(f"{a}_{b}") for a, b in _PAIRS))
    upto = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    inside = binned.withColumns({"__before": F.coalesce(F.sum("n").over(upto), F.lit(0)),
                                 "__all": F.sum("n").over(whole)}).filter(F.col("__before") < SUPPORT * F.col("__all"))
    return inside.groupBy("grp").agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in
                                       ("n", *NAMES, *(f"{a}_{b}" for a, b in _PAIRS))))


def _medians(rows: DataFrame) -> DataFrame:
    """Per group the medians (lower, in hundredths) of the statistics, from histograms."""

    each = rows.select("grp", F.posexplode(F.array(*(F.floor(F.col(a) / 10) for a in NAMES))).alias("k", "v"))
    bins = each.groupBy("grp", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("grp", "k")
    run = bins.withColumns({"__upto": F.sum("n").over(by.orderBy("v")), "__all": F.sum("n").over(by)})
    middle = run.filter(2 * F.col("__upto") >= F.col("__all")).groupBy("grp", "k").agg(F.min("v").alias("v"))
    return middle.groupBy("grp").agg(*(
        (F.max(F.when(F.col("k") == i, F.col("v"))) * 10).alias(f"med_{a}") for i, a in enumerate(NAMES)))


def quality_rules(docs: DataFrame, steps: int = STEPS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Base columns, ``distance`` (squared, null where the base rules fail) and ``kept``."""

    described = base_columns(docs).withColumns(statistics())
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in ("lang", "source"))
    rows = written(described.withColumns({"__lang": F.to_json(F.array(lang)), "__both": F.to_json(F.array(lang, source))}))

    passed = rows.filter(~F.col("base_failed"))
    sizes = passed.groupBy("__both", "__lang").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < group_rows, F.col("n")).otherwise(0)
    langs = sizes.groupBy("__lang").agg(F.sum("n").alias("__rows"), F.sum(small).alias("__pool"))
    whole = F.concat(F.lit("whole "), F.col("__lang"))
    groups = written(sizes.join(langs, "__lang").select(
        "__both", whole.alias("__whole"),
        F.when(F.col("n") >= group_rows, F.col("__both")).when(F.col("__pool") >= group_rows, F.col("__lang"))
        .when(F.col("__rows") >= group_rows, whole).otherwise("all").alias("grp")))
    # a group's documents count for its own estimate, and for a wider one that another group is held against
    wider = groups.select(F.col("grp").alias("__wide")).filter("__wide = 'all' or __wide like 'whole %'").distinct()
    wide = groups.select("__both", F.explode(F.array("__whole", F.lit("all"))).alias("__wide")).join(wider, "__wide")
    own = groups.select("__both", "grp").filter("grp <> 'all' and grp not like 'whole %'")
    feeds = written(own.unionByName(wide.select("__both", F.col("__wide").alias("grp"))))
    groups = groups.select("__both", "grp")
    measured = passed.select("__both", *NAMES).join(feeds, "__both")

    def binned(squared: Column) -> Column:
        return F.floor(F.log1p(squared) * 200).alias("bin")

    medians = written(_medians(measured))
    first = _add([((F.col(a) - F.col(f"med_{a}")) / 1000.0) ** 2 for a in NAMES]) / FLOOR
    placed = measured.join(medians, "grp").select("grp", *NAMES, binned(first))
    estimates = written(_estimates(_support_sums(placed)))
    for _ in range(steps):
        placed = measured.join(estimates, "grp").select("grp", *NAMES, binned(_squared_distance()))
        estimates = written(_estimates(_support_sums(placed)))

    judged = rows.join(groups, "__both", "left").join(estimates, "grp", "left")
    distance = F.when(~F.col("base_failed"), _squared_distance())
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= CUTOFF)).alias("kept"),
        distance.alias("distance"))
