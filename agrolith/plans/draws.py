"""Components of variance and intervals from draws that the tables stand for (kernels' effects and phenotypes from line items), and what principal components must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.models import components
from agrolith.operators import pca
from agrolith.plans.base import EMBEDDING_W, embedding_w, rounded, table

QUERIES, SQL = {}, {}

_DRAWS = """dr AS (SELECT CASE l_linenumber % 5 WHEN 0 THEN 'KG_A' WHEN 1 THEN 'ke_w' WHEN 2 THEN 'KGE_AW' WHEN 3 THEN 'KG_TREE' ELSE 'noise' END AS kernel, l_orderkey % 20 AS draw, 'N' || CAST(s_nationkey AS VARCHAR) AS env, p_brand AS gid, l_extendedprice / 1000 AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
ph AS (SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS env, p_brand AS gid, l_quantity + l_extendedprice / 1000 AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _joined(spark, sf_dir):
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.withColumn("env", F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).withColumn("gid", F.col("p_brand"))


def _draws(spark, sf_dir):
    k = F.col("l_linenumber") % 5
    kernel = F.when(k == 0, "KG_A").when(k == 1, "ke_w").when(k == 2, "KGE_AW").when(k == 3, "KG_TREE").otherwise("noise")
    return _joined(spark, sf_dir).select(kernel.alias("kernel"), (F.col("l_orderkey") % 20).alias("draw"), "env", "gid", (F.col("l_extendedprice") / 1000).alias("value"))


def varcomp_draws(spark, sf_dir):
    phenotypes = _joined(spark, sf_dir).select("env", "gid", (F.col("l_quantity") + F.col("l_extendedprice") / 1000).alias("value"))
    return rounded(components.variance_components(_draws(spark, sf_dir), phenotypes))


SQL["varcomp_draws"] = f"""WITH {_DRAWS}, m AS (SELECT kernel, env, gid, avg(value) AS u FROM dr GROUP BY ALL),
r AS (SELECT CASE WHEN kernel IN ('KG_A', 'KG_TREE') THEN 'G' WHEN kernel = 'ke_w' THEN 'E' WHEN kernel = 'KGE_AW' THEN 'GE' END AS role, env, gid, sum(u) AS u FROM m GROUP BY ALL),
v AS (SELECT var_samp(u) FILTER (role = 'G') AS g, var_samp(u) FILTER (role = 'E') AS e, var_samp(u) FILTER (role = 'GE') AS ge FROM r),
t AS (SELECT var_samp(value) AS total, count(DISTINCT gid) AS p, count(DISTINCT env) AS q FROM ph),
x AS (SELECT *, total - (coalesce(g, 0) + coalesce(e, 0) + coalesce(ge, 0)) AS l FROM v, t), y AS (SELECT *, CASE WHEN l < 0 THEN greatest(1e-6 * total, 1e-8) ELSE l END AS s FROM x)
SELECT round(g, 4) AS "var_G", round(e, 4) AS "var_E", round(ge, 4) AS "var_GE", round(s, 4) AS var_resid, round(total, 4) AS var_total, round(g / (g + e / q + ge / (p * q) + s), 4) AS h2_entry,
  round(g / (g + ge + s), 4) AS h2_plot, round(g / (g + ge), 4) AS rg, p, q, l < 0 AS negative_residual, q < 20 AS few_environments FROM y"""


def prediction_intervals(spark, sf_dir):
    draws = _draws(spark, sf_dir)
    return rounded(components.prediction_intervals(draws, draws.groupBy("draw").agg(F.avg("value").alias("mu"))))


SQL["prediction_intervals"] = f"""WITH {_DRAWS}, k AS (SELECT env, gid, kernel, draw, avg(value) AS u FROM dr GROUP BY ALL), m AS (SELECT draw, avg(value) AS mu FROM dr GROUP BY 1),
y AS (SELECT env, gid, sum(u) + any_value(mu) AS y FROM k JOIN m USING (draw) GROUP BY env, gid, draw)
SELECT env, gid, round(avg(y), 4) AS yhat, round(quantile_cont(y, 0.025), 4) AS lower, round(quantile_cont(y, 0.975), 4) AS upper FROM y GROUP BY 1, 2"""

def pca_power_sums(spark, sf_dir):
    """Sums of powers of the components' variances, which no other rotation has: traces of powers of the correlation matrix."""
    variance = pca.env_pca(embedding_w(spark, sf_dir)).variance.withColumn("v", F.col("sd") * F.col("sd"))
    each = variance.select(F.posexplode(F.array(*[F.pow("v", F.lit(float(k))) for k in (1, 2, 3, 4)])).alias("k", "x"))
    return rounded(each.groupBy((F.col("k") + 1).alias("power")).agg(F.sum("x").alias("total")), 3)


SQL["pca_power_sums"] = f"""WITH {EMBEDDING_W}, z AS (SELECT env, covariable, (value - avg(value) OVER v) / stddev_samp(value) OVER v AS z FROM w WINDOW v AS (PARTITION BY covariable)), n AS (SELECT count(DISTINCT env) AS n FROM z),
g AS (SELECT a.env AS i, b.env AS j, sum(a.z * b.z) / (any_value(n) - 1) AS v FROM n, z a JOIN z b USING (covariable) GROUP BY 1, 2), h AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2)
SELECT CAST(power AS INTEGER) AS power, round(total, 3) AS total FROM (SELECT 1 AS power, sum(v) AS total FROM g WHERE i = j UNION ALL SELECT 2, sum(v) FROM h WHERE i = j UNION ALL SELECT 3, sum(h.v * g.v) FROM h JOIN g ON h.j = g.i AND h.i = g.j UNION ALL SELECT 4, sum(a.v * b.v) FROM h a JOIN h b ON a.j = b.i AND a.i = b.j)"""


def pca_cells(spark, sf_dir):
    """Scores times loadings give back every standardised cell."""
    p = pca.env_pca(embedding_w(spark, sf_dir))
    cells = p.scores.join(p.loadings.withColumnRenamed("value", "loading"), "PC").groupBy("env", "covariable").agg(F.sum(F.col("value") * F.col("loading")).alias("value"))
    return rounded(cells)


SQL["pca_cells"] = f"WITH {EMBEDDING_W} SELECT env, covariable, round((value - avg(value) OVER v) / stddev_samp(value) OVER v, 4) AS value FROM w WINDOW v AS (PARTITION BY covariable)"

QUERIES |= {f.__name__: f for f in (varcomp_draws, prediction_intervals, pca_power_sums, pca_cells)}
