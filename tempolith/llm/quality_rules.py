"""Quality rules with robust multivariate outliers, in DataFrame expressions alone.

Each text gives exact counts and a vector of transformed statistics.  Vectors are grouped by
language and source; groups of fewer than ``min_group`` base-passing rows are pooled by
language, and what is still small is pooled over all.  Per group the minimum covariance
determinant is searched from several starts: medians and median deviations, and means and
covariances of small subsets drawn by hash.  A concentration step is one scan and one small
aggregation: rows are binned by squared distance, and running sums over the bins give mean and
covariance of the half with the least distances (exact up to a bin of 1/1024 log-distance).
After two steps the start of the least determinant goes on alone, until no group's determinant
falls.  The rows within the 97.5 % point of chi-squared around it give the reweighted estimate,
and rows beyond its ``quantile`` point are rejected.

Statistics are integers in steps of 1/256, so every sum is exact and results do not depend on
partitioning.  Variances get a fixed floor, the spread that means nothing: most texts repeat no
line and have no symbols, and half of them would have no variance at all.

Defined cases: null text has no words and fails the base rules; null language or source is a
value of its own; base-failed rows never enter an estimate; a pool of fewer than
``min_group`` rows rejects nothing; repeated rows each count.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, words

#: Steps of the statistics in one unit, and of the logarithm of a distance in one bin.
UNIT, BINS = 256, 1024
#: (name, standard deviation whose square each variance gets on top)
FEATURES = (("len", 0.1), ("word", 0.02), ("symbols", 0.02), ("lines", 0.1), ("repeats", 0.1))
#: Drawn subsets that the search starts from, and the rows expected in each.
SUBSETS, SUBSET_ROWS = 4, 18
#: Shares of a group that join an estimate as rows of their own where it cannot be broadcast.
SALTS = 16


def chi2_share(x: float, degrees: int) -> float:
    """Probability that a chi-squared variable is at most x, by the series of the incomplete gamma function."""
    a, x = degrees / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi2_point(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, degrees) < share else (low, mid)
    return high


def text_counts(text: Column) -> dict[str, Column]:
    """Expressions for the exact counts of a text, over the columns that steps() adds."""
    return {
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.octet_length(F.coalesce(text, F.lit(""))) - F.octet_length(F.regexp_replace(F.coalesce(text, F.lit("")), "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(F.col("_covered"), F.lit(0)).cast("long"),
        "_n_lines": F.size("_l").cast("long"),
    }


def _covered(grams: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from (window, place) pairs in order."""
    same = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
    twice = F.filter(grams, lambda x, i: same(x, F.get(grams, i - 1)) | same(x, F.get(grams, i + 1)))
    places = F.sort_array(F.transform(twice, lambda x: x["at"]))
    return F.aggregate(
        places,
        F.struct(F.lit(-9).alias("last"), F.lit(0).alias("sum")),
        lambda acc, at: F.struct(at.alias("last"), (acc["sum"] + F.least(F.lit(3), at - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _n_lines.

    docs must not have columns of these names, nor of ``_w``, ``_l``, ``_h``, ``_g`` and ``_covered``.
    """
    # 64-bit hashes stand for words and windows; that two windows of one text share one is beyond belief
    grams = F.transform(
        F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)).alias("g"), i.alias("at")),
    )
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = (
        docs.withColumns({"_w": words(F.col(text_col)), "_l": lines})
        .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
        .withColumn("_g", F.sort_array(grams))
        .withColumn("_covered", _covered(F.col("_g")))
        .withColumns(text_counts(F.col(text_col)))
    )
    return counted.drop("_w", "_l", "_h", "_g", "_covered")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = {
        "len": F.log(n),
        "word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbols": F.log1p(F.col("n_symbols") / n),
        "lines": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
    }
    return {f"_x_{k}": F.round(v * UNIT).cast("long") for k, v in share.items()}


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _x(i: int) -> Column:
    return F.col(f"_x_{FEATURES[i][0]}")


def _value(prices: Iterable[Column]) -> Column:
    total = F.lit(0.0)
    for p in prices:
        total = total + p
    return total


def _with_group(df: DataFrame, lang: str, source: str, min_group: int) -> DataFrame:
    """df with _group: by language and source, else by language, else all, each of min_group rows at least."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    both, one = F.concat(part(lang), F.lit("\x01"), part(source)), part(lang)
    df = df.withColumns({"_both": both, "_one": one})
    sizes = df.where("not base_failed").groupBy("_both", "_one").agg(F.count("*").alias("_n"))
    pooled = sizes.where(F.col("_n") < min_group).groupBy("_one").agg(F.sum("_n").alias("_pool"))
    sizes = sizes.join(pooled, "_one", "left").select(
        F.col("_both").alias("_key"),
        F.when(F.col("_n") >= min_group, F.col("_both")).when(F.col("_pool") >= min_group, F.col("_one")).otherwise("").alias("_to"),
    )
    # a language and source with no base-passing row needs no group: all its rows are rejected
    sizes = broadcast_if_small(materialize(sizes, "quality-groups"))
    return df.join(sizes, F.col("_both") == F.col("_key"), "left").drop("_key").withColumnRenamed("_to", "_group").drop("_both", "_one")


def _attach(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of their group in a written table, a group's rows spread over tasks."""
    small = broadcast_if_small(table)
    if small is not table:
        return rows.join(small, "_group")
    salt = F.pmod(F.xxhash64(*[_x(i) for i in range(len(FEATURES))]), F.lit(SALTS))
    many = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.withColumn("_salt", salt).join(many, ["_group", "_salt"]).drop("_salt")


def _sums() -> dict[str, Column]:
    return {f"_s_{i}": F.sum(_x(i)) for i in range(len(FEATURES))} | {f"_s_{i}_{j}": F.sum(_x(i) * _x(j)) for i, j in _pairs()}


def _with_factor(est: DataFrame) -> DataFrame:
    """_group, _start, mean, the Cholesky factor of the covariance, floors added, and _logdet, from sums over _h rows."""
    n = F.col("_h").cast("double")
    est = est.withColumns({f"_mu_{i}": F.col(f"_s_{i}") / n for i in range(len(FEATURES))})
    for i, j in _pairs():
        value = F.col(f"_s_{i}_{j}") / n - F.col(f"_mu_{i}") * F.col(f"_mu_{j}")
        if i == j:
            value = F.greatest(value, F.lit(0.0)) + (FEATURES[i][1] * UNIT) ** 2
        value = value - _value(F.col(f"_l_{i}_{k}") * F.col(f"_l_{j}_{k}") for k in range(j))
        # what rounding leaves of a variance is no less than a hundredth of its floor
        least = F.lit((FEATURES[i][1] * UNIT) ** 2 / 100)
        est = est.withColumn(f"_l_{i}_{j}", F.sqrt(F.greatest(value, least)) if i == j else value / F.col(f"_l_{j}_{j}"))
    return est.withColumn("_logdet", _logdet()).select("_group", "_start", "_logdet", *_shape())


def _logdet() -> Column:
    return 2 * _value(F.log(F.col(f"_l_{i}_{i}")) for i in range(len(FEATURES)))


def _shape() -> list[str]:
    return [f"_mu_{i}" for i in range(len(FEATURES))] + [f"_l_{i}_{j}" for i, j in _pairs()]


def _starts(rows: DataFrame, min_group: int) -> DataFrame:
    """Estimates to start from, per group: start 0 of medians and median deviations, the others of drawn subsets."""
    names = [f for f, _ in FEATURES]

    def medians(df: DataFrame, values: list[Column], out: str) -> DataFrame:
        long = df.select("_group", F.posexplode(F.array(*values)).alias("_f", "_v")).groupBy("_group", "_f", "_v").agg(F.count("*").alias("_c"))
        run = Window.partitionBy("_group", "_f").orderBy("_v")
        whole = Window.partitionBy("_group", "_f")
        found = long.withColumns({"_cum": F.sum("_c").over(run), "_all": F.sum("_c").over(whole)}).where("2 * _cum >= _all")
        least = found.groupBy("_group", "_f").agg(F.min("_v").alias("_m"), F.first("_all").alias("_all"))
        return least.groupBy("_group").agg(
            *[F.max(F.when(F.col("_f") == i, F.col("_m"))).alias(f"_{out}_{f}") for i, f in enumerate(names)],
            F.max("_all").alias("_n"),
        )

    middle = materialize(medians(rows, [_x(i) for i in range(len(FEATURES))], "mid").where(F.col("_n") >= min_group), "quality-middle")
    centred = _attach(rows, middle)
    far = medians(centred, [F.abs(_x(i) - F.col(f"_mid_{f}")) for i, f in enumerate(names)], "mad")
    plain = {f"_mu_{i}": F.col(f"_mid_{f}").cast("double") for i, f in enumerate(names)}
    plain |= {f"_l_{i}_{j}": F.greatest(1.4826 * F.col(f"_mad_{names[i]}"), F.lit(FEATURES[i][1] * UNIT)) if i == j else F.lit(0.0) for i, j in _pairs()}
    first = middle.join(far.drop("_n"), "_group").withColumns(plain).select("_group", F.lit(0).alias("_start"), _logdet().alias("_logdet"), *_shape())
    # rows of one vector are drawn together
    shares = [F.pmod(F.xxhash64(*[_x(i) for i in range(len(FEATURES))], F.lit(k)), F.col("_n")) < SUBSET_ROWS for k in range(1, SUBSETS + 1)]
    drawn = centred.withColumn("_start", F.explode(F.filter(F.array(*[F.when(s, k) for k, s in enumerate(shares, 1)]), lambda x: x.isNotNull())))
    sums = drawn.groupBy("_group", "_start").agg(F.count("*").alias("_h"), *[v.alias(k) for k, v in _sums().items()])
    return first.union(_with_factor(sums))


def _with_distance(rows: DataFrame) -> DataFrame:
    """rows joined with estimates, with _d2."""
    for i in range(len(FEATURES)):
        inner = _value(F.col(f"_l_{i}_{k}") * F.col(f"_y_{k}") for k in range(i))
        rows = rows.withColumn(f"_y_{i}", (_x(i) - F.col(f"_mu_{i}") - inner) / F.col(f"_l_{i}_{i}"))
    return rows.withColumn("_d2", _value(F.col(f"_y_{i}") * F.col(f"_y_{i}") for i in range(len(FEATURES))))


def _half(rows: DataFrame) -> DataFrame:
    """Sums over the half of each (_group, _start) with the least _d2, and the median's _bin."""
    sums, keys = _sums(), ["_group", "_start"]
    bins = rows.withColumn("_bin", F.floor(F.log1p("_d2") * BINS)).groupBy(*keys, "_bin").agg(F.count("*").alias("_h"), *[v.alias(k) for k, v in sums.items()])
    run, whole = Window.partitionBy(*keys).orderBy("_bin"), Window.partitionBy(*keys)
    cum = bins.select(*keys, "_bin", F.sum("_h").over(whole).alias("_n"), *[F.sum(k).over(run).alias(k) for k in ["_h", *sums]])
    # the first bin at which half of the rows are in
    return cum.where("2 * _h >= _n").withColumn("_r", F.row_number().over(run)).where("_r = 1").drop("_r")


def least_determinant(rows: DataFrame, min_group: int) -> DataFrame:
    """(_group, _start, _logdet, mean and factor): the half of the least determinant that any start leads to."""
    step = lambda est: _with_factor(_half(_with_distance(_attach(rows, est.drop("_logdet")))))
    est = materialize(_starts(rows, min_group), "quality-start")
    for _ in range(2):
        est = materialize(step(est), "quality-step")
    best = est.groupBy("_group").agg(F.min(F.struct("_logdet", "_start", *_shape())).alias("b")).select("_group", "b._start", "b._logdet", *[f"b.{c}" for c in _shape()])
    best = materialize(best, "quality-best")
    while True:
        both = best.withColumn("_new", F.lit(False)).union(step(best).withColumn("_new", F.lit(True)))
        # the older of equals stays
        pick = both.groupBy("_group").agg(F.min(F.struct(F.round("_logdet", 6).alias("d"), "_new", "_start", "_logdet", *_shape())).alias("b"))
        best = materialize(pick.select("_group", "b._start", "b._logdet", *[f"b.{c}" for c in _shape()], "b._new"), "quality-step")
        if best.where("_new").isEmpty():
            return best.drop("_new")
        best = best.drop("_new")


def judge(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = 200, quantile: float = 0.9999) -> DataFrame:
    """docs (the columns of ``keep``, or all), as a struct column ``doc``, with the counts, base_failed, kept and distance2.

    distance2 is null for base-failed rows and where no estimate exists.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"),
        F.col(text_col).cast("string").alias("_text"),
        F.col(lang_col).alias("_lang"),
        F.col(source_col).alias("_source"),
    )
    counted = with_counts(packed, "_text").drop("_text").withColumn("base_failed", base_failed()).withColumns(_features())
    table = materialize(counted, "quality-counts")
    table = _with_group(table, "_lang", "_source", min_group)
    rows = materialize(table.where("not base_failed").select("_group", *[f"_x_{f}" for f, _ in FEATURES]), "quality-vectors")
    degrees = len(FEATURES)
    raw = least_determinant(rows, min_group)
    # distances are scaled so that their median is that of a normal vector; then all that is near counts
    middle = _half(_with_distance(_attach(rows, raw.drop("_logdet"))))
    scale = middle.select("_group", F.greatest(F.lit(1.0), F.expm1((F.col("_bin") + 0.5) / BINS) / chi2_point(0.5, degrees)).alias("_scale"))
    scaled = materialize(raw.drop("_logdet").join(scale, "_group"), "quality-raw")
    near_point = chi2_point(0.975, degrees)
    near = _with_distance(_attach(rows, scaled)).where(F.col("_d2") <= near_point * F.col("_scale"))
    sums = near.groupBy("_group", "_start").agg(F.count("*").alias("_h"), *[v.alias(k) for k, v in _sums().items()])
    final = materialize(_with_factor(sums).drop("_start", "_logdet"), "quality-estimates")
    # the covariance of vectors within that point is less than that of all by this factor
    factor = chi2_share(near_point, degrees + 2) / 0.975
    judged = _with_distance(table.join(broadcast_if_small(final), "_group", "left"))
    distance = F.when(~F.col("base_failed"), F.col("_d2") * factor)
    cutoff = chi2_point(quantile, degrees)
    return judged.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))).alias("kept"),
        distance.alias("distance2"),
    )


def keep_regular(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that the rules reject; columns unchanged."""
    return judge(docs, **options).where("kept").select("doc.*")


def quality_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs.select("doc_id", "text", "lang", "source"), keep=["doc_id"], **options).select("doc.doc_id", *names)
