"""Queries that run a whole path."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import views as v
from furrow.checks.features import FILLED, NAMES, STAT_SQL
from furrow.checks.registry import check
from furrow.checks.views import r6
from furrow.config import TabularParams
from furrow.operators.reshape import long_features
from furrow.plans import tabular

LABELLED = "parcel_id IN (SELECT parcel_id FROM parcel_labels)"
KEPT = f"""WITH base AS (SELECT * FROM agg40 WHERE {LABELLED} AND date IN (SELECT date FROM agg40 WHERE {LABELLED} GROUP BY 1 ORDER BY count(DISTINCT parcel_id) DESC, 1 LIMIT 12)),
    kept AS (SELECT parcel_id, label FROM (SELECT parcel_id, label, count(*) OVER (PARTITION BY label) AS n FROM parcel_labels WHERE parcel_id IN (SELECT parcel_id FROM base)) WHERE n >= 20),
    own AS (SELECT base.* FROM base JOIN kept USING (parcel_id)), """
# The positions come from all labelled cells, the series from the kept parcels.
OWN_FILLED = FILLED.removeprefix("WITH ").replace("(SELECT DISTINCT idx, date FROM agg40)", "(SELECT DISTINCT idx, date FROM base)").replace("agg40", "own")


@check(
    "tabular_feature_table",
    "agg40 parcel_labels",
    KEPT
    + OWN_FILLED
    + f""", med AS (SELECT idx, date, median(value) AS value FROM filled GROUP BY ALL),
    gone AS (SELECT parcel_id, idx FROM (SELECT DISTINCT parcel_id FROM own) CROSS JOIN (SELECT DISTINCT idx FROM own) EXCEPT SELECT parcel_id, idx FROM own),
    series AS (SELECT parcel_id, date, idx, value FROM filled UNION ALL SELECT parcel_id, date, idx, value FROM gone JOIN med USING (idx)),
    stats AS (SELECT parcel_id, idx, {', '.join(f'cast({e} AS DOUBLE) AS "{n}"' for n, e in STAT_SQL.items())} FROM
      (SELECT *, lead(value) OVER w AS nv, lead(dayofyear(date)) OVER w AS nd FROM own WINDOW w AS (PARTITION BY parcel_id, idx ORDER BY date)) GROUP BY ALL),
    tall AS (UNPIVOT stats ON {', '.join(f'"{n}"' for n in STAT_SQL)} INTO NAME stat VALUE x),
    pheno AS (SELECT k.parcel_id, i.idx, n.stat, coalesce(x, m) AS value FROM kept k CROSS JOIN (SELECT DISTINCT idx FROM own) i CROSS JOIN (SELECT DISTINCT stat FROM tall) n
      LEFT JOIN tall USING (parcel_id, idx, stat) LEFT JOIN (SELECT idx, stat, median(x) AS m FROM tall GROUP BY ALL) USING (idx, stat))
    SELECT parcel_id, label, label_id, feature, {r6('value', 'value')} FROM (SELECT parcel_id, label, dense_rank() OVER (ORDER BY label) - 1 AS label_id FROM kept) JOIN
    (SELECT parcel_id, concat(idx, '__', cast(date AS varchar)) AS feature, value FROM series UNION ALL SELECT parcel_id, concat(idx, '__', stat), value FROM pheno) USING (parcel_id)""",
)
def _(spark, sf):
    p = TabularParams(indices=tuple(NAMES), min_class_count=20, max_dates=12, fit_on="all")
    labels = v.parcel_labels(spark, sf).drop("label_group")
    agg = tabular.cells(v.obs(spark, sf), labels, p)
    kept = tabular.targets(agg, labels, p)
    table = tabular.feature_table(agg, kept, p)
    long = long_features(table, [c for c in table.columns if "__" in c])
    return long.join(kept.select("parcel_id", "label", F.col("label_id")), "parcel_id")
