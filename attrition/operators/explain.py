"""Explanations: attributions, global and local summaries, local surrogates.

* Linear models: on the log-odds, the Shapley value of feature j under the
  background expectation is ``w_j * (x_j - mean_j)``, a projection.
* Tree models: ``trees.tree_attributions``.
* Any other model: ``coalitions.coalition_attributions``.

All rows are explained and the background is all training rows; ``limit`` makes
either a bounded top or sample.  Global importance is a partial-aggregated
``avg(abs)`` per feature; local top-5 text sorts each row's array in place.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ID_COLUMN, RANDOM_STATE
from ..functions.text import fixed


def top_rows(scores: DataFrame, limit: int | None = None, prob: str = "churn_probability") -> DataFrame:
    """All rows, or the ``limit`` of highest probability (ties by id)."""

    return scores if limit is None else scores.orderBy(F.col(prob).desc(), ID_COLUMN).limit(limit)


def background_rows(train: DataFrame, limit: int | None = None, seed: int = RANDOM_STATE) -> DataFrame:
    """All training rows, or a keyed, repeatable sample of ``limit``."""

    if limit is None:
        return train
    return train.orderBy(F.md5(F.concat(F.col(ID_COLUMN).cast("string"), F.lit(str(seed)))), ID_COLUMN).limit(limit)


def linear_attributions(encoded: DataFrame, weights: list[float], background_mean: list[float],
                        features: str = "features") -> DataFrame:
    """Adds ``attributions`` = array of w_j * (x_j - mean_j) (log-odds units)."""

    w = F.array(*[F.lit(float(v)) for v in weights])
    mu = F.array(*[F.lit(float(v)) for v in background_mean])
    x = vector_to_array(features)
    return encoded.withColumn(
        "attributions",
        F.zip_with(F.zip_with(x, mu, lambda a, b: a - b), w, lambda d, ww: d * ww),
    )


def background_mean(encoded_background: DataFrame, features: str = "features") -> list[float]:
    """Per-feature mean of the background rows."""

    from pyspark.ml.stat import Summarizer
    row = encoded_background.select(Summarizer.mean(F.col(features)).alias("m")).first()
    return [float(v) for v in row["m"]]


def global_importance(attributed: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean_abs_shap) sorted by importance."""

    name_arr = F.array(*[F.lit(n) for n in names])
    long = attributed.select(F.posexplode("attributions").alias("j", "v"))
    agg = long.groupBy("j").agg(F.avg(F.abs("v")).alias("mean_abs_shap"))
    return agg.select(name_arr[F.col("j")].alias("feature"), "mean_abs_shap").orderBy(
        F.col("mean_abs_shap").desc(), "feature")


def top_importance(importance: DataFrame, n: int) -> DataFrame:
    return importance.orderBy(F.col("mean_abs_shap").desc(), "feature").limit(n)


def local_drivers(attributed: DataFrame, names: list[str], k: int = 5, prob: str = "churn_probability") -> DataFrame:
    """(customerID, churn_probability, top_shap_drivers): top-k |attribution| as
    'name (increases/decreases churn risk, v)' joined by '; '."""

    name_arr = F.array(*[F.lit(n) for n in names])
    items = F.transform("attributions", lambda v, i: F.struct(F.abs(v).alias("a"), i.alias("i"), v.alias("v"),
                                                              name_arr[i].alias("name")))
    top = F.slice(F.reverse(F.array_sort(items)), 1, k)
    exploded = attributed.select(ID_COLUMN, prob, F.posexplode(top).alias("pos", "it"))
    text = exploded.select(
        ID_COLUMN, prob, "pos",
        F.concat(F.col("it.name"), F.lit(" ("),
                 F.when(F.col("it.v") > 0, F.lit("increases churn risk")).otherwise(F.lit("decreases churn risk")),
                 F.lit(", "), fixed(F.col("it.v")), F.lit(")")).alias("item"),
    )
    return text.groupBy(ID_COLUMN, prob).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]), "; ")
        .alias("top_shap_drivers"))


def lime_explanations(predict_encoded, train_encoded: DataFrame, explained: DataFrame, names: list[str],
                      num_samples: int = 5000, num_features: int = 5, seed: int = RANDOM_STATE,
                      prob: str = "churn_probability") -> DataFrame:
    """Local surrogate explanations for a few rows (LIME, tabular, continuous features).

    Perturbations are drawn around the training mean with the training standard
    deviation (Box-Muller on hashed uniforms, so a recomputed task draws the same
    sample), scored by the model as one Spark job, and one weighted ridge per
    explained row is fitted in ``applyInPandas`` — each group holds exactly
    ``num_samples`` rows.  Output: (customerID, churn_probability, lime_explanation).
    """

    import numpy as np
    import pandas as pd
    from pyspark.ml.stat import Summarizer

    stats = train_encoded.select(Summarizer.metrics("mean", "std").summary(F.col("features")).alias("s")).first()["s"]
    mean = np.asarray(stats["mean"].toArray())
    std = np.asarray(stats["std"].toArray())
    std = np.where(std > 0, std, 1.0)
    d = len(mean)
    mean_arr = F.array(*[F.lit(float(v)) for v in mean])
    std_arr = F.array(*[F.lit(float(v)) for v in std])

    def u(*cols):
        return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))

    base = explained.select(ID_COLUMN, prob, vector_to_array("features").alias("_x0"))
    samples = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))).alias("_s"))
    gauss = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.sqrt(-2.0 * F.log(u(F.col(ID_COLUMN), F.col("_s"), j, F.lit(seed))))
        * F.cos(2.0 * np.pi * u(F.col(ID_COLUMN), F.col("_s"), j, F.lit(seed + 1))))
    point = F.when(F.col("_s") == 0, F.col("_x0")).otherwise(
        F.zip_with(F.zip_with(gauss, std_arr, lambda g, s: g * s), mean_arr, lambda a, m: a + m))
    perturbed = samples.select(ID_COLUMN, "_s", "_x0", point.alias("_x")).withColumn("features", array_to_vector("_x"))
    scored = predict_encoded(perturbed, [ID_COLUMN, "_s", "_x"])
    width = float(np.sqrt(d) * 0.75)
    mean_l, std_l = mean.tolist(), std.tolist()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        x = np.vstack(pdf["_x"].to_numpy())
        z = (x - np.asarray(mean_l)) / np.asarray(std_l)
        y = pdf[prob].to_numpy()
        dist = np.sqrt(((z - z[0]) ** 2).sum(axis=1))
        w = np.sqrt(np.exp(-(dist ** 2) / width ** 2))

        def ridge(a, alpha):
            sw = w / w.sum()
            am = (a * sw[:, None]).sum(axis=0)
            ym = (y * sw).sum()
            ac, yc = (a - am) * np.sqrt(w)[:, None], (y - ym) * np.sqrt(w)
            return np.linalg.solve(ac.T @ ac + alpha * np.eye(a.shape[1]), ac.T @ yc)

        def unexplained(columns):
            sw = w / w.sum()
            a = (z[:, columns] - (z[:, columns] * sw[:, None]).sum(axis=0)) * np.sqrt(w)[:, None]
            yc = (y - (y * sw).sum()) * np.sqrt(w)
            return float(((yc - a @ np.linalg.lstsq(a, yc, rcond=None)[0]) ** 2).sum())

        # forward selection: the feature that leaves least unexplained joins next
        chosen = []
        for _ in range(min(num_features, d)):
            rest = [j for j in range(d) if j not in chosen]
            chosen.append(min(rest, key=lambda j: unexplained([*chosen, j])))
        chosen = np.array(chosen)
        final = ridge(z[:, chosen], 1.0)
        order = np.argsort(-np.abs(final), kind="stable")
        text = "; ".join(f"{names[chosen[i]]}: {final[i]:.3f}" for i in order)
        return pd.DataFrame({ID_COLUMN: [pdf[ID_COLUMN].iloc[0]], "lime_explanation": [text]})

    surrogate = scored.groupBy(ID_COLUMN).applyInPandas(fit, f"{ID_COLUMN} string, lime_explanation string")
    return base.select(ID_COLUMN, prob).join(surrogate, ID_COLUMN)
