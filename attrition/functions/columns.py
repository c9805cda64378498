"""SQL expression builders shared by the cleaning, feature and decision operators.

Expressions are produced as Spark SQL text and applied with ``selectExpr`` /
``F.expr``: one round trip to the JVM per projection instead of one per
expression node, and the same built-in (codegen'd) functions either way.
No Python runs per row.
"""

from __future__ import annotations


def q(name: str) -> str:
    """Quote a column name."""

    return "`" + name.replace("`", "``") + "`"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return f"CAST('{'NaN' if value != value else ('Infinity' if value > 0 else '-Infinity')}' AS DOUBLE)"
        return repr(value) + "D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


# Python's str.strip() removes every Unicode whitespace character, including
# NBSP and the information separators; Java's (?U)\s covers the first group.
STRIP_PATTERN = r"(?U)^[\s\x{1c}-\x{1f}\x{85}]+|[\s\x{1c}-\x{1f}\x{85}]+$"

# What a lenient numeric parse accepts: plain decimals with optional exponent
# and infinities.  Spark's own cast would also take "1d", "0x1p3" or "NaN".
NUMERIC_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY_PATTERN = r"(?i)^[+-]?inf(inity)?$"


def strip_text(c: str) -> str:
    return f"regexp_replace({c}, r'{STRIP_PATTERN}', '')"


def null_if_token(c: str, tokens) -> str:
    return f"CASE WHEN {c} IN ({', '.join(lit(t) for t in tokens)}) THEN CAST(NULL AS STRING) ELSE {c} END"


def lenient_double(c: str, is_string: bool = True) -> str:
    """Parse to double; anything that is not a number becomes NULL (never NaN)."""

    if not is_string:
        return f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN CAST(NULL AS DOUBLE) ELSE CAST({c} AS DOUBLE) END"
    return (
        f"CASE WHEN {c} RLIKE r'{NUMERIC_PATTERN}' THEN CAST({c} AS DOUBLE) "
        f"WHEN {c} RLIKE r'{INFINITY_PATTERN}' THEN "
        f"CASE WHEN startswith({c}, '-') THEN CAST('-Infinity' AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END "
        f"ELSE CAST(NULL AS DOUBLE) END"
    )


def is_(c: str, value) -> str:
    """Null-safe equality as 0/1 (a missing value is never equal)."""

    return f"CAST(coalesce({c} = {lit(value)}, FALSE) AS INT)"


def is_not(c: str, value) -> str:
    """Null-safe inequality as 0/1 (a missing value is always unequal)."""

    return f"CAST(NOT ({c} <=> {lit(value)}) AS INT)"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, FALSE) AS INT)"


def text_or_nan(c: str) -> str:
    """A string with missing shown as 'nan', as string concatenation of missing values reads."""

    return f"coalesce(CAST({c} AS STRING), 'nan')"


def band(c: str, bands) -> str:
    """Right-closed bands ((lo, hi] -> label); below the first edge or NULL -> NULL."""

    whens = []
    for lo, hi, label in bands:
        conds = []
        if lo is not None:
            conds.append(f"{c} > {lit(lo)}")
        if hi is not None:
            conds.append(f"{c} <= {lit(hi)}")
        whens.append(f"WHEN {' AND '.join(conds) or 'TRUE'} THEN {lit(label)}")
    return f"CASE {' '.join(whens)} ELSE CAST(NULL AS STRING) END"


def lookup(c: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {c} {whens} ELSE {lit(default)} END"
