"""Model-input preparation fitted on training rows only.

* numeric: exact median imputation, optional standardisation with the
  population standard deviation (0 std -> 0);
* categorical: most-frequent imputation (ties -> smallest value), then Spark ML's
  string indexer (levels in alphabetical order) and either its one-hot encoder
  (sparse vectors, unseen level -> all zeros) or its target encoder (smoothed,
  unseen level -> mean target; out of fold on the training rows);
* class weights n / (2 n_c).

Fitting is a handful of aggregates whose results are one value per column or per
category level; transforming is row-local, so scoring never shuffles.  There is
no largest number of levels.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import (
    OneHotEncoder,
    OneHotEncoderModel,
    StringIndexer,
    StringIndexerModel,
    TargetEncoder,
    TargetEncoderModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..constants import ID_COLUMN, TARGET_COLUMN, TARGET_ENCODING_SMOOTHING
from ..functions.columns import lit, q
from .stats import exact_medians, medians

def split_feature_types(df: DataFrame, drop_columns=(), exclude=(ID_COLUMN, TARGET_COLUMN)) -> tuple[list[str], list[str]]:
    """Model columns (all but id/target/dropped) split into numeric and categorical by type."""

    dropped = set(drop_columns) | set(exclude)
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name in dropped or f.name.startswith("_") or f.name in ("is_test", "fold"):
            continue
        if isinstance(f.dataType, NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, StringType):
            categorical.append(f.name)
    return numeric, categorical


def _stack_text(df: DataFrame, cols: list[str], extra=()) -> DataFrame:
    """Long form (extra..., k = column name, v = value as text) in one projection."""

    pairs = ", ".join(f"{lit(c)}, CAST({q(c)} AS STRING)" for c in cols)
    return df.selectExpr(*[q(e) for e in extra], f"stack({len(cols)}, {pairs}) AS (k, v)")


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent value per column; ties go to the smallest value (NULLs ignored)."""

    if not cols:
        return {}
    counts = _stack_text(df, cols).filter("v IS NOT NULL").groupBy("k", "v").count()
    best = counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("mode"))
    found = {r["k"]: r["mode"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in cols}


def level_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """``feature, level, slot``: the one-hot layout (levels in alphabetical order, from 0)."""

    levels = _stack_text(df, cols).filter("v IS NOT NULL").distinct()
    slot = F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1
    return levels.select(F.col("k").alias("feature"), F.col("v").alias("level"), slot.alias("slot"))


def class_weight_expr(counts: dict, label: str = TARGET_COLUMN) -> str:
    """Balanced weights n / (k * n_c) as a SQL CASE over the label."""

    n, k = sum(counts.values()), len(counts)
    whens = " ".join(f"WHEN {q(label)} = {lit(c)} THEN {lit(n / (k * m))}" for c, m in sorted(counts.items()))
    return f"CASE {whens} ELSE 1.0D END"


@dataclass
class FittedPrep:
    numeric: list[str]
    categorical: list[str]
    encoder: str
    scale: bool
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    smoothing: float = TARGET_ENCODING_SMOOTHING
    indexer: StringIndexerModel | None = None
    coder: OneHotEncoderModel | TargetEncoderModel | None = None

    # -- expressions -------------------------------------------------------------
    def numeric_exprs(self) -> list[tuple[str, str]]:
        out = []
        for c in self.numeric:
            med = self.medians.get(c)
            x = f"coalesce(CAST({q(c)} AS DOUBLE), {lit(float(med)) if med is not None else '0.0D'})"
            if self.scale:
                mu, sd = self.means.get(c) or 0.0, self.stds.get(c) or 0.0
                x = f"({x} - {lit(float(mu))}) / {lit(float(sd))}" if sd > 0 else "0.0D"
            out.append((c, x))
        return out

    @property
    def encoded_columns(self) -> list[str]:
        """Categorical columns with a value at all."""

        return [c for c in self.categorical if self.modes.get(c) is not None]

    def imputed(self, c: str) -> str:
        return f"coalesce(CAST({q(c)} AS STRING), {lit(self.modes[c])})"

    @property
    def levels(self) -> dict[str, list[str]]:
        return dict(zip(self.encoded_columns, map(list, self.indexer.labelsArray))) if self.indexer else {}

    @property
    def feature_names(self) -> list[str]:
        if self.encoder == "target":
            return self.numeric + self.encoded_columns
        return self.numeric + [f"{c}_{level}" for c, levels in self.levels.items() for level in levels]

    # -- applying ----------------------------------------------------------------
    def _indexed(self, df: DataFrame, keep) -> DataFrame:
        """Passed-through columns, numbers as ``_n<i>`` and category indices as ``_i<i>``."""

        exprs = [f"{e} AS _n{i}" for i, (_, e) in enumerate(self.numeric_exprs())]
        exprs += [f"{self.imputed(c)} AS _s{i}" for i, c in enumerate(self.encoded_columns)]
        projected = df.selectExpr(*[q(c) for c in keep if c in df.columns], *exprs)
        return self.indexer.transform(projected) if self.indexer else projected

    def _assembled(self, indexed: DataFrame, keep, output_col: str, coder=None) -> DataFrame:
        coder = coder or self.coder
        coded = coder.transform(indexed) if coder else indexed
        parts = [f"_n{i}" for i in range(len(self.numeric))] + [f"_c{i}" for i in range(len(self.encoded_columns))]
        assembler = VectorAssembler(inputCols=parts, outputCol=output_col, handleInvalid="keep")
        kept = [q(c) for c in keep if c in indexed.columns]
        return assembler.transform(coded).select(*kept, output_col)

    def transform(self, df: DataFrame, keep=(ID_COLUMN, TARGET_COLUMN), output_col: str = "features") -> DataFrame:
        """Row-local: model columns in one vector; ``keep`` columns pass through."""

        return self._assembled(self._indexed(df, keep), keep, output_col)

    def smoothed(self, smoothing: float) -> FittedPrep:
        """The same preparation with another smoothing of its target encodings, which are made of their sums when applied."""

        return replace(self, smoothing=smoothing, coder=_smoothed(self.coder, smoothing) if self.encoder == "target" else self.coder)

    def out_of_fold_coders(self, train: DataFrame, fold: F.Column, folds: int, label: str = TARGET_COLUMN) -> list[TargetEncoderModel]:
        """For each fold the target encoder of the training rows outside it; none where nothing is target-encoded."""

        if self.encoder != "target" or not self.encoded_columns:
            return []
        indexed = self._indexed(train.withColumn("_fold", fold), [label, "_fold"])
        return [_target_encoder(self, label).fit(indexed.filter(F.col("_fold") != k)) for k in range(folds)]

    def transform_out_of_fold(self, train: DataFrame, fold: F.Column, folds: int, keep=(ID_COLUMN, TARGET_COLUMN),
                              label: str = TARGET_COLUMN, output_col: str = "features",
                              coders: list[TargetEncoderModel] | None = None) -> DataFrame:
        """Training rows, each with the target encodings of the rows outside its fold (``coders``, or fitted here)."""

        coders = self.out_of_fold_coders(train, fold, folds, label) if coders is None else coders
        if not coders:
            return self.transform(train, keep, output_col)
        indexed = self._indexed(train.withColumn("_fold", fold), [*keep, label, "_fold"])
        out = None
        for k, coder in enumerate(coders):
            part = self._assembled(indexed.filter(F.col("_fold") == k), keep, output_col, _smoothed(coder, self.smoothing))
            out = part if out is None else out.unionByName(part)
        return out

    # -- keeping -----------------------------------------------------------------
    def save(self, spark, path: str) -> None:
        names = ("numeric", "categorical", "encoder", "scale", "medians", "means", "stds", "modes", "smoothing")
        record = json.dumps({n: getattr(self, n) for n in names})
        spark.createDataFrame([(record,)], "record string").coalesce(1).write.mode("overwrite").text(f"{path}/prep")
        if self.indexer:
            self.indexer.write().overwrite().save(f"{path}/indexer")
            self.coder.write().overwrite().save(f"{path}/coder")

    @staticmethod
    def load(spark, path: str) -> FittedPrep:
        prep = FittedPrep(**json.loads(spark.read.text(f"{path}/prep").first()[0]))
        if prep.encoded_columns:
            prep.indexer = StringIndexerModel.load(f"{path}/indexer")
            prep.coder = (TargetEncoderModel if prep.encoder == "target" else OneHotEncoderModel).load(f"{path}/coder")
        return prep


def _columns(prefix: str, prep: FittedPrep) -> list[str]:
    return [f"{prefix}{i}" for i in range(len(prep.encoded_columns))]


def _smoothed(coder: TargetEncoderModel | None, smoothing: float) -> TargetEncoderModel | None:
    return coder and coder.copy({coder.smoothing: smoothing})


def _target_encoder(prep: FittedPrep, label: str) -> TargetEncoder:
    return TargetEncoder(inputCols=_columns("_i", prep), outputCols=_columns("_c", prep), labelCol=label,
                         targetType="binary", smoothing=prep.smoothing, handleInvalid="keep")


def fit_prep(train: DataFrame, encoder: str = "onehot", scale: bool = True, drop_columns=(),
             label: str = TARGET_COLUMN, smoothing: float = TARGET_ENCODING_SMOOTHING) -> FittedPrep:
    numeric, categorical = split_feature_types(train, drop_columns)
    prep = FittedPrep(numeric=numeric, categorical=categorical, encoder=encoder, scale=scale, smoothing=smoothing)
    prep.medians = exact_medians(train, numeric)
    if scale and numeric:
        imputed = train.selectExpr(*[
            f"coalesce(CAST({q(c)} AS DOUBLE), {lit(float(prep.medians.get(c) or 0.0))}) AS _v{i}"
            for i, c in enumerate(numeric)])
        stats = imputed.agg(*[F.expr(f"avg(_v{i}) AS m_{i}") for i in range(len(numeric))],
                            *[F.expr(f"stddev_pop(_v{i}) AS s_{i}") for i in range(len(numeric))]).first()
        prep.means = {c: stats[f"m_{i}"] for i, c in enumerate(numeric)}
        prep.stds = {c: stats[f"s_{i}"] for i, c in enumerate(numeric)}
    prep.modes = column_modes(train, categorical)
    if prep.encoded_columns:
        texts = train.selectExpr(*[f"{prep.imputed(c)} AS _s{i}" for i, c in enumerate(prep.encoded_columns)], q(label))
        prep.indexer = StringIndexer(inputCols=_columns("_s", prep), outputCols=_columns("_i", prep),
                                     handleInvalid="keep", stringOrderType="alphabetAsc").fit(texts)
        indexed = prep.indexer.transform(texts)
        if encoder == "target":
            prep.coder = _target_encoder(prep, label).fit(indexed)
        else:
            prep.coder = OneHotEncoder(inputCols=_columns("_i", prep), outputCols=_columns("_c", prep),
                                       dropLast=True).fit(indexed)
    return prep


def _long_categories(df: DataFrame, cols: list[str], label: str, extra=()) -> DataFrame:
    return df.select(
        *[F.col(e) for e in extra], F.col(label).cast("double").alias("_y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols])).alias("kv"),
    ).select(*extra, "_y", "kv.k", "kv.v")


def target_encoding_long(df: DataFrame, cols: list[str], label: str = TARGET_COLUMN,
                         smoothing: float = TARGET_ENCODING_SMOOTHING) -> DataFrame:
    """``feature, level, encoding``: (sum_y + s * mean_y) / (n + s) of every level."""

    prior = df.agg(F.avg(F.col(label).cast("double")).alias("prior"))
    stats = (_long_categories(df, cols, label).groupBy("k", "v")
             .agg(F.sum("_y").alias("sy"), F.count(F.lit(1)).alias("n")))
    return stats.crossJoin(F.broadcast(prior)).select(  # prior: 1 row
        F.col("k").alias("feature"), F.col("v").alias("level"),
        ((F.col("sy") + F.lit(smoothing) * F.col("prior")) / (F.col("n") + F.lit(smoothing))).alias("encoding"),
    )


def cross_fitted_target_encoding(train: DataFrame, cols: list[str], fold_col: str = "fold",
                                 label: str = TARGET_COLUMN, smoothing: float = TARGET_ENCODING_SMOOTHING) -> DataFrame:
    """Out-of-fold encodings for training rows: (column, level, fold, encoding).

    For fold k the encoding uses only rows outside k: per (column, level) totals
    minus the fold's own sums, with the prior also taken outside the fold.
    Levels missing outside fold k get that fold's prior.
    """

    per_fold = (_long_categories(train, cols, label, extra=(fold_col,)).groupBy("k", "v", fold_col)
                .agg(F.sum("_y").alias("sy_f"), F.count(F.lit(1)).alias("n_f")))
    totals = per_fold.groupBy("k", "v").agg(F.sum("sy_f").alias("sy"), F.sum("n_f").alias("n"))
    fold_prior = train.groupBy(fold_col).agg(F.sum(F.col(label).cast("double")).alias("fy"), F.count(F.lit(1)).alias("fn"))
    everything = train.agg(F.sum(F.col(label).cast("double")).alias("ty"), F.count(F.lit(1)).alias("tn"))
    priors = fold_prior.crossJoin(F.broadcast(everything)).select(  # 1 row
        fold_col, ((F.col("ty") - F.col("fy")) / (F.col("tn") - F.col("fn"))).alias("prior"))
    # every (column, level) seen in training x every fold: bounded by levels * folds
    grid = totals.crossJoin(F.broadcast(priors))  # priors: one row per fold
    joined = grid.join(per_fold, ["k", "v", fold_col], "left").fillna(0, subset=["sy_f", "n_f"])
    return joined.select(
        F.col("k").alias("feature"), F.col("v").alias("level"), fold_col,
        ((F.col("sy") - F.col("sy_f") + F.lit(smoothing) * F.col("prior"))
         / (F.col("n") - F.col("n_f") + F.lit(smoothing))).alias("encoding"),
    )


# -- distributed/table forms of the fitted statistics (for reports and checks) ----------

def median_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, median) — exact medians, one row per column."""

    return medians(df, cols)


def scaling_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mean, std) of the median-imputed values, population std."""

    med = exact_medians(df, cols)
    imputed = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med[c] or 0.0)).alias(c) for c in cols])
    stacked = imputed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"))
                                                 for c in cols])).alias("kv")).select("kv.feature", "kv.x")
    return stacked.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def mode_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mode) with ties broken by the smallest value — fully distributed."""

    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                            for c in cols])).alias("kv")).select("kv.k", "kv.v")
    counts = stacked.filter(F.col("v").isNotNull()).groupBy("k", "v").count()
    return counts.groupBy(F.col("k").alias("feature")).agg(
        F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("mode"))
