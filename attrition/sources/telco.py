"""The ``telco`` customer view derived from the driver's order tables.

The library works on a 21-column customer table.  The test data has no such
table, so this view derives one from ``customer`` and ``orders``: one
aggregate over ``orders`` (partial aggregation, one shuffle on ``o_custkey``)
and one left join to ``customer`` on the key.  The same SQL text runs in Spark
and DuckDB, which makes it the shared input of every oracle check.

``SCORE_SQL_EXPR`` is a deterministic probability with many ties, used by the
metric, threshold and decision queries that need a score column without
fitting a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import REQUIRED_COLUMNS

SERVICE_COLUMNS = ("PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
                   "TechSupport", "StreamingTV", "StreamingMovies")

# The fixture definition is shared with the DuckDB oracle; keep it one text.
TELCO_SQL = """
WITH o AS (SELECT o_custkey, COUNT(*) AS n_orders, MIN(o_orderdate) AS first_dt,
  SUM(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
  SUM(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS n_f FROM orders GROUP BY o_custkey),
b AS (SELECT c.c_custkey AS k, c.c_name, c.c_nationkey AS nk, c.c_mktsegment AS seg,
  CAST(FLOOR(c.c_acctbal+1000) AS BIGINT) AS bal, COALESCE(o.n_orders,0) AS n_orders, COALESCE(o.n_urgent,0) AS nu, COALESCE(o.n_f,0) AS nf,
  CASE WHEN o.first_dt IS NULL THEN 0 ELSE ((24020 - (YEAR(o.first_dt)*12+MONTH(o.first_dt))) * (1 + c.c_custkey % 7)) % 73 END AS tenure
  FROM customer c LEFT JOIN o ON c.c_custkey=o.o_custkey),
m AS (SELECT *, CAST(bal % 101 + 18 AS DOUBLE) + CAST(k % 4 AS DOUBLE)*0.25 AS mc FROM b)
SELECT c_name AS customerID,
 CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
 CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
 CASE WHEN nk % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
 CASE WHEN nk % 3 = 0 THEN 'Yes' ELSE 'No' END AS Dependents,
 CAST(tenure AS INT) AS tenure,
 CASE WHEN k % 10 = 0 THEN 'No' ELSE 'Yes' END AS PhoneService,
 CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN nf % 2 = 0 THEN 'Yes' ELSE 'No' END AS MultipleLines,
 CASE WHEN bal % 5 = 0 THEN 'No' WHEN mc >= 65 THEN 'Fiber optic' ELSE 'DSL' END AS InternetService,
 CASE WHEN bal % 5 = 0 THEN 'No internet service' WHEN (k + nu) % 3 = 0 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
 CASE WHEN bal % 5 = 0 THEN 'No internet service' WHEN (k + nf) % 3 = 1 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
 CASE WHEN bal % 5 = 0 THEN 'No internet service' WHEN n_orders % 3 = 0 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
 CASE WHEN bal % 5 = 0 THEN 'No internet service' WHEN (bal + nu) % 3 = 0 THEN 'Yes' ELSE 'No' END AS TechSupport,
 CASE WHEN bal % 5 = 0 THEN 'No internet service' WHEN bal % 7 < 3 THEN 'Yes' ELSE 'No' END AS StreamingTV,
 CASE WHEN bal % 5 = 0 THEN 'No internet service' WHEN k % 7 < 3 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
 CASE WHEN seg IN ('AUTOMOBILE','BUILDING','FURNITURE') THEN 'Month-to-month' WHEN seg='HOUSEHOLD' THEN 'One year' ELSE 'Two year' END AS Contract,
 CASE WHEN n_orders % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
 CASE (k + n_orders) % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
 mc AS MonthlyCharges,
 CASE WHEN tenure = 0 THEN ' ' ELSE CAST(mc*tenure + CAST(nf AS DOUBLE)*0.5 AS VARCHAR(40)) END AS TotalCharges,
 CASE WHEN (CASE WHEN seg IN ('AUTOMOBILE','BUILDING','FURNITURE') THEN 4 ELSE 0 END) + (CASE WHEN tenure <= 12 THEN 3 ELSE 0 END) + (CASE WHEN mc >= 65 THEN 2 ELSE 0 END) + k % 4 >= 7 THEN 'Yes' ELSE 'No' END AS Churn
FROM m
"""

# Deterministic score over the raw view: 0..16 points / 16, ties everywhere.
SCORE_SQL_EXPR = (
    "CAST((CASE WHEN Contract='Month-to-month' THEN 4 ELSE 0 END)"
    "+(CASE WHEN tenure<=12 THEN 3 ELSE 0 END)"
    "+(CASE WHEN InternetService='Fiber optic' THEN 2 ELSE 0 END)"
    "+CAST(SUBSTR(customerID,10) AS BIGINT)%7 AS DOUBLE)/16"
)

# Customers as text, and rows derived from them that cleaning must survive.  One text for both engines.
_TEXT_COLUMNS = [c for c in REQUIRED_COLUMNS if c != "customerID"]


def _derived(prefix: str, every: int, copy: int, **changes: str) -> str:
    """Customers whose number is divisible by ``every`` under ids of their own, with some columns changed."""

    columns = ", ".join(f"{changes.get(c, f'CAST({c} AS VARCHAR(60))')} AS {c}" for c in _TEXT_COLUMNS)
    ident = f"'{prefix}' || SUBSTR(customerID, 10)"
    return (f"SELECT {ident} AS customerID, {columns}, {copy} AS copy_number FROM telco "
            f"WHERE CAST(SUBSTR(customerID, 10) AS BIGINT) % {every} = 0")


_FLIPPED = "CASE WHEN Churn = 'Yes' THEN 'No' ELSE 'Yes' END"
_NUMBER = "CAST(SUBSTR(customerID, 10) AS BIGINT)"
DIRTY_SQL = " UNION ALL ".join([
    _derived("Customer#", 1, 0),
    _derived("Customer#", 7, 1, Churn=_FLIPPED, tenure="'5'"),  # a second copy that says otherwise
    _derived("Customer#", 21, 2, Churn="'Yes'", Contract="'None'"),
    _derived("unlabelled", 11, 0, Churn="CAST(NULL AS VARCHAR(60))"),  # no label on the first copy
    _derived("unlabelled", 11, 1, Churn="'Yes'"),
    _derived("token", 13, 0, Churn="' nan '"),
    _derived("padded", 13, 0, gender="CHR(9) || gender || '  '", Partner="'nan'", Dependents="'None'",
             TotalCharges="'1d'", Churn="' ' || Churn || CHR(9)"),
    _derived("hex", 17, 0, TotalCharges="'0x1p3'", SeniorCitizen="'1.9'", MonthlyCharges="' 7.05e1 '"),
    _derived("nan", 17, 0, TotalCharges="'NaN'", SeniorCitizen="'abc'", MonthlyCharges="'85'"),
    _derived("gap", 19, 0, InternetService="''", Contract="CAST(NULL AS VARCHAR(60))", tenure="'none'",
             OnlineSecurity="'nan'", PaymentMethod="CAST(NULL AS VARCHAR(60))"),
    _derived("edge", 5, 0, tenure=f"CAST({_NUMBER} % 90 AS VARCHAR(60))",
             MonthlyCharges=f"CAST(35 + 5 * ({_NUMBER} % 11) AS VARCHAR(60))", TotalCharges="' '"),
    _derived("bare", 23, 0, **{c: "'No'" for c in SERVICE_COLUMNS}),
])

# Deterministic rule scorers over the same columns: inputs for the model
# comparison and selection queries (they stand in for fitted models).
FIXTURE_SCORERS = {
    "Fixture score": SCORE_SQL_EXPR,
    "Contract rule": "CAST(CASE WHEN Contract='Month-to-month' THEN 0.7 WHEN Contract='One year' THEN 0.3 ELSE 0.1 END AS DOUBLE)",
    "Tenure rule": "CAST(73 - tenure AS DOUBLE) / CAST(73 AS DOUBLE)",
    "Charge rule": "CAST(MonthlyCharges AS DOUBLE) / CAST(125 AS DOUBLE)",
}


def register_tables(spark: SparkSession, sf_dir: str, names=("customer", "orders")) -> None:
    """Register parquet tables as temp views (column pruning and pushdown still apply)."""

    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def telco_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw 21-column customer view (strings and numbers as the fixture makes them)."""

    register_tables(spark, sf_dir)
    df = spark.sql(TELCO_SQL)
    df.createOrReplaceTempView("telco")
    return df

