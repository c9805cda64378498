"""Cleaning: trimmed text, NULL for missing tokens, lenient numbers, one row per customer.

Plan shape: one projection (codegen) then one aggregate on ``customerID`` that
keeps the first-ingested row of each id via ``min_by`` — a map-side partial
aggregate, so a hot id (say a third of the rows with a NULL id) collapses to
one row per map task before the shuffle instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import ID_COLUMN, MISSING_TOKENS, NUMERIC_RAW_COLUMNS, TARGET_COLUMN
from ..functions.columns import lenient_double, null_if_token, q, strip_text

INGEST_ORDER = "_ingest_order"


def clean_expressions(df: DataFrame) -> list[str]:
    """Per-column SQL that trims text, nulls missing tokens and parses the numeric columns."""

    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    exprs = []
    for name in df.columns:
        col = q(name)
        is_string = name in string_cols
        if is_string:
            col = null_if_token(strip_text(col), MISSING_TOKENS)
        if name in NUMERIC_RAW_COLUMNS:
            col = lenient_double(col, is_string)
        elif name == "SeniorCitizen":
            col = f"CAST(coalesce({lenient_double(col, is_string)}, 0.0D) AS INT)"
        exprs.append(f"{col} AS {q(name)}")
    return exprs


def label_expression() -> str:
    t = q(TARGET_COLUMN)
    return (f"CASE WHEN {t} = 'No' THEN 0 WHEN {t} = 'Yes' THEN 1 "
            f"ELSE CAST(raise_error(concat('Unexpected {TARGET_COLUMN} label: ', {t})) AS INT) END AS {t}")


def clean_dataset(df: DataFrame, order_col: str | None = None, dedupe: bool = True,
                  columns: tuple[str, ...] | None = None) -> DataFrame:
    """Return the cleaned customer table.

    ``order_col`` says which copy of a duplicated id is "first" (the file reader
    adds one: file, place in the file); without it the order of the input's
    partitions is used, which is the ingest order only of an unsplit input.
    ``columns``: the raw columns that are wanted beside id and label; others are
    neither parsed nor shuffled.
    """

    renamed = df.toDF(*[str(c).strip() for c in df.columns])
    wanted = None if columns is None else {ID_COLUMN, TARGET_COLUMN, *columns}
    columns = [c for c in renamed.columns if c != order_col and (wanted is None or c in wanted)]
    order_expr = q(order_col) if order_col else "monotonically_increasing_id()"
    typed = renamed.selectExpr(*clean_expressions(renamed.select(*[q(c) for c in columns])),
                               f"{order_expr} AS {INGEST_ORDER}")
    others = [c for c in columns if c != ID_COLUMN]
    if dedupe:
        fields = ", ".join(f"{q(c)}" for c in others)
        typed = typed.groupBy(q(ID_COLUMN)).agg(F.expr(f"min_by(struct({fields}), {INGEST_ORDER})").alias("_first"))
        typed = typed.selectExpr(q(ID_COLUMN), *[f"_first.{q(c)} AS {q(c)}" for c in others])
    labelled = typed.filter(f"{q(TARGET_COLUMN)} IS NOT NULL")
    return labelled.selectExpr(*[q(c) if c != TARGET_COLUMN else label_expression() for c in columns])
