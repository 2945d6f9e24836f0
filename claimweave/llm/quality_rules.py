"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Five transformed statistics of each document (log words, log characters a word, and the shares of symbols, repeated
lines and repeated words) are judged by their Mahalanobis distance from a minimum-covariance-determinant estimate:
centre and covariance of the (n + p + 1) / 2 documents of a group whose covariance has the least determinant found.
Three starts (median deviations alone, and with the correlations of tanh scores or of spatial signs) go through
concentration steps side by side until the determinant falls no more. A step is one aggregate over all documents of all
groups: moments by bins of the distance, of which the nearest are taken, the last in part. Covariances are scaled so
that the median squared distance, of the statistics that vary, is that of chi-square. Groups of fewer than ``MIN_GROUP`` documents use their
language's estimate, and languages as small that of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.llm.stages import small_batches, staged
from claimweave.llm.text_stats import Stats
from claimweave.llm.words import slices

MIN_WORDS = 50
REPEAT_PERCENT = 50
FALL = 1e-3  # a step goes on where the log determinant falls by more than this
BINS = 16  # for each doubling of the squared distance
MIN_GROUP = 200
CHI2_MEDIAN = (1.0, 0.455, 1.386, 2.366, 3.357, 4.351)  # of 0 (not used) to 5 degrees of freedom
CUTOFF = 20.515  # squared distance: the 99.9 % point of chi-square of five degrees of freedom
FLOOR = (0.3, 0.05, 0.02, 0.1, 0.1)  # a statistic that deviates less within the half counts as constant, with this deviation
_P = 5
_SMALL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_EACH = ", ".join(f"x{i} double" for i in range(_P))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            s = Stats(part.column("text"))
            words, lines, chars = np.maximum(s.n_words, 1), np.maximum(s.n_lines, 1), np.maximum(s.chars, 1)
            x = [np.log1p(s.n_words), np.log1p(s.word_chars / words), s.n_symbols / chars, s.n_dup_lines / lines, s.n_repeat_words / words]
            counts = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
            names = ["id", "grp", "lng", *(f.split()[0] for f in _SMALL.split(", ")), *(f"x{i}" for i in range(_P))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *map(pa.array, counts), *map(pa.array, x)], names)


def _inverses(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper triangle of the inverse of each covariance (given by its upper triangle), log determinant, 1 / FLOOR^2 of constant statistics, else 0."""
    upper = np.triu_indices(_P)
    full = np.zeros((len(cov), _P, _P))
    full[:, upper[0], upper[1]] = cov
    full = full + np.triu(full, 1).swapaxes(1, 2)
    var = np.einsum("kii->ki", full)
    fixed = ~(var > np.square(FLOOR))
    sd = np.where(fixed, FLOOR, np.sqrt(np.where(fixed, 1.0, var)))
    corr = full / (sd[:, :, None] * sd[:, None, :])
    corr[(fixed[:, :, None] | fixed[:, None, :])] = 0
    corr[:, range(_P), range(_P)] = 1
    values, vectors = np.linalg.eigh(corr)
    values = np.maximum(values, 1e-6)  # statistics that determine each other
    inverse = (vectors / values[:, None, :]) @ vectors.swapaxes(1, 2) / (sd[:, :, None] * sd[:, None, :])
    logdet = np.log(values).sum(axis=1) + 2 * np.log(sd).sum(axis=1)
    return inverse[:, upper[0], upper[1]], logdet, np.where(fixed, 1 / np.square(FLOOR), 0.0)


@F.pandas_udf(T.StructType().add("inverse", T.ArrayType(T.DoubleType())).add("fixed", T.ArrayType(T.DoubleType())))
def _solved(cov: pd.Series) -> pd.DataFrame:
    inverse, _, fixed = _inverses(np.stack(cov.to_numpy()) if len(cov) else np.zeros((0, _P * (_P + 1) // 2)))
    return pd.DataFrame({"inverse": list(inverse), "fixed": list(fixed)})


def _distance():
    """Squared Mahalanobis distance of a row joined with its group's centre and inverse."""
    d = [F.col(f"x{i}") - F.col("centre")[i] for i in range(_P)]
    total, k = F.lit(0.0), 0
    for i in range(_P):
        for j in range(i, _P):
            total = total + F.col("inverse")[k] * d[i] * d[j] * (1 if i == j else 2)
            k += 1
    return total


_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


_MOMENTS = [f"s{i}" for i in range(_P)] + [f"q{i}{j}" for i, j in _PAIRS]
_STATE = "grp long, start int, n long, centre array<double>, inverse array<double>, logdet double, fixed array<double>, moving boolean"


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, n, centre, inverse, logdet, fixed, moving): medians with three covariances for each group, of unknown determinant."""
    middle = [F.percentile_approx(f"x{i}", F.lit(0.5), F.lit(2000)) for i in range(_P)]
    centre = staged(rows.groupBy("grp").agg(F.count("*").alias("n"), F.array(*middle).alias("centre")), "medians")
    apart = rows.join(centre.drop("n"), "grp").select("grp", *((F.col(f"x{i}") - F.col("centre")[i]).alias(f"x{i}") for i in range(_P)))
    spread = [F.percentile_approx(F.abs(f"x{i}"), F.lit(0.5), F.lit(2000)) * 1.4826 for i in range(_P)]
    spread = apart.groupBy("grp").agg(F.array(*(F.greatest(s, F.lit(f)) for s, f in zip(spread, FLOOR))).alias("s"))
    spread = staged(spread.join(centre, "grp"), "deviations")
    z = rows.join(spread.drop("n"), "grp").select("grp", *(((F.col(f"x{i}") - F.col("centre")[i]) / F.col("s")[i]).alias(f"x{i}") for i in range(_P)))
    norm = F.greatest(F.sqrt(sum(F.col(f"x{i}") * F.col(f"x{i}") for i in range(_P))), F.lit(1e-9))
    z = z.withColumn("norm", norm)
    forms = {1: lambda i: F.tanh(f"x{i}"), 2: lambda i: F.col(f"x{i}") / F.col("norm")}
    products = [F.sum(form(i) * form(j)).alias(f"p{k}_{i}{j}") for k, form in forms.items() for i, j in _PAIRS]
    sums = z.groupBy("grp").agg(*products).join(spread, "grp")

    def cov(k: int):
        scale = {(i, j): F.col("s")[i] * F.col("s")[j] for i, j in _PAIRS}
        if k == 0:
            return F.array(*(scale[i, j] if i == j else F.lit(0.0) for i, j in _PAIRS))
        size = {i: F.sqrt(F.col(f"p{k}_{i}{i}")) for i in range(_P)}
        return F.array(*(scale[i, j] * (F.lit(1.0) if i == j else F.coalesce(F.try_divide(F.col(f"p{k}_{i}{j}"), size[i] * size[j]), F.lit(0.0))) for i, j in _PAIRS))

    each = F.explode(F.array(*(F.struct(F.lit(k).alias("start"), cov(k).alias("cov")) for k in range(3))))
    each = sums.select("grp", "n", "centre", each.alias("_e")).select("grp", "n", "centre", "_e.start", _solved("_e.cov").alias("_s"))
    return each.select("grp", "start", "n", "centre", "_s.inverse", F.lit(np.inf).alias("logdet"), "_s.fixed", F.lit(True).alias("moving"))


def _nearest_half(bins: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """A start with centre and covariance of the half of its group that lies closest to it, or settled as it is."""
    state = state.iloc[:1]
    if bins.empty:
        return state.assign(moving=False)
    old, bins = state.iloc[0], bins.sort_values("bin")
    m, sums = bins["m"].to_numpy(float), bins[_MOMENTS].to_numpy(float)
    half = min((old["n"] + _P + 1) // 2, old["n"])
    w = np.clip((half - (np.cumsum(m) - m)) / m, 0, 1)  # the nearest bins, the last in part
    mean = w @ sums / (w @ m)
    cov = [q - mean[i] * mean[j] for q, (i, j) in zip(mean[_P:], _PAIRS)]
    inverse, logdet, fixed = _inverses(np.array([cov]))
    if not (np.isinf(old["logdet"]) or logdet[0] < old["logdet"] - FALL):
        return state.assign(moving=False)
    new = {"centre": [old["centre"] + mean[:_P]], "inverse": [inverse[0]], "logdet": logdet, "fixed": [fixed[0]]}
    return state.assign(**{c: pd.Series(v, index=state.index) for c, v in new.items()})


def _concentrated(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One step of all starts that move. Its plan is small, as it is planned again for every step: one join, and bins of a start meet its state."""
    d = [(F.col(f"x{i}") - F.col("centre")[i]).alias(f"d{i}") for i in range(_P)]
    far = rows.join(state.where("moving").select("grp", F.col("start").alias("of"), "centre", "inverse"), "grp").select("grp", F.col("of").alias("start"), _distance().alias("d"), *d)
    place = F.floor(F.log2(F.greatest(F.least("d", F.lit(2.0**20)), F.lit(2.0**-20))) * BINS).cast("int").alias("bin")
    sums = [F.sum(f"d{i}").alias(f"s{i}") for i in range(_P)] + [F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"q{i}{j}") for i, j in _PAIRS]
    bins = far.groupBy("grp", "start", place).agg(F.count("*").alias("m"), *sums)
    return bins.groupBy("grp", "start").cogroup(state.groupBy("grp", "start")).applyInPandas(_nearest_half, _STATE)


def estimates(rows: DataFrame) -> DataFrame:
    """(grp, n, centre, inverse, logdet, scale) for ``rows(grp, x0..)``; the inverse is that of the scaled covariance.

    The scale applies to statistics that vary; the deviation of constant ones is given, not estimated from a half.
    A start that has settled leaves the steps, so each is over the rows of the groups that still move. The determinant
    is bounded by ``FLOOR`` and falls by ``FALL`` at least wherever a step goes on, so the steps end.
    """
    found = staged(_starts(rows), "starts")
    while not found.where("moving").isEmpty():
        found = staged(_concentrated(rows, found), "half")
    best = found.groupBy("grp").agg(F.min_by(F.struct("n", "centre", "inverse", "logdet", "fixed"), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    best = staged(best, "best")
    vary = F.array(*(F.col("inverse")[k] - F.col("fixed")[i] if i == j else F.col("inverse")[k] for k, (i, j) in enumerate(_PAIRS)))
    middle = rows.join(best.withColumn("inverse", vary), "grp").withColumn("d", _distance())
    middle = middle.groupBy("grp").agg(F.percentile_approx("d", F.lit(0.5), F.lit(2000)).alias("m"))
    normal = F.array(*map(F.lit, CHI2_MEDIAN))[F.size(F.filter("fixed", lambda x: x == 0))]
    scale = F.when(F.col("m") > 0, F.col("m") / normal).otherwise(F.lit(1.0))
    final = [F.try_divide(vary.getItem(k), F.col("scale")) + (F.col("fixed")[i] if i == j else 0.0) for k, (i, j) in enumerate(_PAIRS)]
    return best.join(middle, "grp").withColumn("scale", scale).select("grp", "n", "centre", F.array(*final).alias("inverse"), "logdet", "scale")


def _named(*columns: str):
    """A number for a combination of values; null is a value of its own."""
    return F.xxhash64(*(c for name in columns for c in (F.col(name), F.col(name).isNull())))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", stored: bool = True) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Null and empty texts have no words and fail the base limits. Documents that fail these take no part in the
    estimates and are not kept whatever their distance. Null languages and sources are groups like others. Repeated
    rows are judged alike. distance is the squared robust distance; it is null for rows that failed. With ``stored`` false
    no ids are written: the verdict computes the statistics again, for ids as long as the texts.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _named(lang_col, source_col).alias("grp"), _named(lang_col).alias("lng"))
    measured = rows.select("id", "grp", "lng", "text").mapInArrow(_stats, f"id {kind}, grp long, lng long, {_SMALL}, {_EACH}")
    apart = rows.select(F.lit(0).alias("id"), "grp", "lng", "text").mapInArrow(_stats, f"id int, grp long, lng long, {_SMALL}, {_EACH}")
    stats = staged(measured if stored else apart.drop("id"), "text_stats")
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    good = stats.where(~failed)
    sizes = good.groupBy("grp", "lng").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("lng").agg(F.sum("n").alias("m"))
    level = F.when(F.col("n") >= MIN_GROUP, F.col("grp")).when(F.col("m") >= MIN_GROUP, F.xxhash64(F.lit("language"), F.col("lng"))).otherwise(F.lit(0))
    sizes = staged(sizes.join(by_lang, "lng").select("grp", F.explode(F.array_distinct(F.array(level, F.xxhash64(F.lit("language"), "lng"), F.lit(0)))).alias("to"), level.alias("use")), "levels")
    needed = sizes.select(F.col("use").alias("to")).distinct()
    pooled = good.join(sizes.select("grp", "to").join(needed, "to", "left_semi"), "grp").drop("grp").withColumnRenamed("to", "grp")
    pooled = staged(pooled.select("grp", *(f"x{i}" for i in range(_P))), "pooled")  # read in every step
    found = staged(estimates(pooled), "estimates")
    used = sizes.select("grp", "use").distinct().join(found.withColumnRenamed("grp", "use"), "use").select("grp", "centre", "inverse")
    used = staged(used, "used")  # of known size: where it is small, rows are not shuffled to meet it
    judged = (stats if stored else measured).withColumn("base_failed", failed).join(used, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = (~F.col("base_failed")) & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    names = [f.split()[0] for f in _SMALL.split(", ")]
    return judged.select(F.col("id").alias(id_col), *names, "base_failed", "distance", kept.alias("kept"))
