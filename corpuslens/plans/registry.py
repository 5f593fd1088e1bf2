"""Every query by name, with the SQL that gives the same rows. Numbers are rounded to six digits on both sides.

`embeddings` stands for a corpus of unit vectors: labels below 5 are the real series, the others the synthetic one. `lineitem`
gives four-wide vectors with zeros: returned items are real, the others synthetic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import scans
from corpuslens.functions.vectors import as_double, exploded, l2_normalize, r6, sound
from corpuslens.operators import difficulty, fidelity, gates, panels, preprocess, sampling, structure
from corpuslens.operators import generator as G
from corpuslens.operators import knn as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def corpus(spark, sf: str) -> DataFrame:
    series = F.when(F.col("label") < 5, "real").otherwise("synth")
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id"), as_double(F.col("embedding")).alias("v"), series.alias("series"), "label")


def real(spark, sf: str) -> DataFrame:
    return corpus(spark, sf).where("series = 'real'")


def synth(spark, sf: str) -> DataFrame:
    return corpus(spark, sf).where("series = 'synth'")


def items(spark, sf: str) -> DataFrame:
    series = F.when(F.col("l_returnflag") == "R", "real").otherwise("synth")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(series.alias("series"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("v"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def one(spark, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def wide(spark, sf: str) -> DataFrame:
    """128-wide descriptors: neighbouring ids end to end."""
    e = corpus(spark, sf)
    a = e.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("vec_id"), F.col("v").alias("a"))
    b = e.where("vec_id % 2 = 1").select(((F.col("vec_id") - 1) / 2).cast("long").alias("vec_id"), F.col("v").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.concat("a", "b").alias("v"))


E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label < 5 THEN 'real' ELSE 'synth' END AS series, label FROM embeddings)"
SIDES = E + ", re AS (SELECT * FROM e WHERE series = 'real'), sy AS (SELECT * FROM e WHERE series = 'synth')"
X = E + ", x AS (SELECT vec_id, series, unnest(range(len(v)))::INT AS dim, unnest(v) AS x FROM e)"
M = X + ", m AS (SELECT series, dim, avg(x) AS mean, var_pop(x) AS var, stddev_pop(x) AS std, avg((x = 0)::INT) AS zero FROM x GROUP BY ALL)"
ITEMS = "e AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'real' ELSE 'synth' END AS series, [l_quantity, l_extendedprice, l_discount, l_tax] AS v FROM lineitem)"
WIDE = E + ", w AS (SELECT a.vec_id // 2 AS vec_id, list_concat(a.v, b.v) AS v FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0), c AS (SELECT vec_id, unnest(range(len(v)))::INT AS dim, unnest(v) AS x FROM w)"
COS = "list_cosine_similarity({a}.v, {b}.v)"


def drawn(src: str, rows: int, seed=42) -> str:
    return f"(SELECT * FROM {src} ORDER BY md5(concat_ws(':', '{seed}', vec_id)), vec_id LIMIT {rows})"


def near(k, a: str = "e", b: str = "e", name: str = "knn", d: str = "list_distance(a.v, b.v)", own: bool = True) -> str:
    return f"{name} AS (SELECT q, rk, t, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rk FROM (SELECT a.vec_id AS q, b.vec_id AS t, {d} AS d FROM {a} a, {b} b{' WHERE a.vec_id <> b.vec_id' * own})) WHERE rk <= {k})"


def lids(knn: str = "knn", name: str = "lids") -> str:
    return f"{name}_s AS (SELECT *, min(d) OVER (PARTITION BY q) AS r1, max(d) OVER (PARTITION BY q) AS rmax FROM {knn}), {name} AS (SELECT q, -1 / avg(ln(greatest(least(d / rmax, 1.0), 1e-12))) AS lid FROM {name}_s WHERE r1 > 0 AND r1 < rmax GROUP BY q)"


def contrast(src: str = "e", knn: str = "knn", name: str = "contrasts", targets: int = 2000) -> str:
    return f"{name}_m AS (SELECT a.vec_id AS q, avg(list_distance(a.v, b.v)) AS mean FROM {src} a, {drawn(src, targets) if targets else src} b GROUP BY 1), {name} AS (SELECT q, mean / r1 AS contrast FROM {name}_m JOIN (SELECT q, min(d) AS r1, max(d) AS rmax FROM {knn} GROUP BY q) USING (q) WHERE r1 > 0 AND r1 < rmax)"


def occurrence(k_hub: str, src: str = "e", knn: str = "knn", name: str = "occ") -> str:
    return f"{name} AS (SELECT p.vec_id, count(k.t) AS n FROM {src} p LEFT JOIN (SELECT t FROM {knn} WHERE rk <= {k_hub}) k ON p.vec_id = k.t GROUP BY 1)"


SKEW = "coalesce((avg(n ** 3) - 3 * avg(n) * avg(n ** 2) + 2 * avg(n) ** 3) / nullif(stddev_pop(n), 0) ** 3, 0)"


def cells(nlist, src: str = "e", name: str = "cells") -> str:
    return f"{name}_c AS {drawn(src, nlist)}, {name}_a AS (SELECT vec_id, cell FROM (SELECT p.vec_id, c.vec_id AS cell, row_number() OVER (PARTITION BY p.vec_id ORDER BY list_distance(p.v, c.v), c.vec_id) AS r FROM {src} p, {name}_c c) WHERE r = 1), {name} AS (SELECT c.vec_id AS cell, count(a.vec_id) AS n FROM {name}_c c LEFT JOIN {name}_a a ON a.cell = c.vec_id GROUP BY 1)"


GINI = "CASE WHEN sum(n) > 0 THEN 2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) ELSE 0 END"


def hist(values: str, bins: int, *keys: str) -> str:
    """The histogram of a CTE (series, keys, x)."""
    k = "".join(f", {x}" for x in keys)
    on = f"USING ({', '.join(keys)})" if keys else "ON true"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""ends AS (SELECT a{k}, CASE WHEN b <= a THEN a + 1e-6 ELSE b END AS b FROM (SELECT min(x) AS a, max(x) AS b{k} FROM {values} {group})),
counted AS (SELECT series{k}, least(floor((x - a) / (b - a) * {bins}), {bins - 1})::INT AS bin, any_value(a) AS a, (any_value(b) - any_value(a)) / {bins} AS w, count(*) AS n FROM {values} JOIN ends {on} GROUP BY series{k}, 2{"".join(f", {i + 2}" for i in range(0))}{", bin" * bool(keys)})
SELECT series{k}, bin, round(a + bin * w, 6) + 0.0 AS lo, round(a + bin * w + w, 6) + 0.0 AS hi, round(n / sum(n) OVER (PARTITION BY series{k}) / w, 6) + 0.0 AS density FROM counted"""


def panel(df: DataFrame) -> DataFrame:
    return rounded(df, "lo", "hi", "density")


# Neighbours


@query("knn_topk", f"WITH {E}, {near(10)} SELECT q, rk, t, round(d, 6) AS d FROM knn")
def _(spark, sf):
    return rounded(K.knn(corpus(spark, sf), 10), "d")


COSINE = "1 - list_cosine_similarity(a.v, b.v)"


@query("knn_cosine", f"WITH {E}, {near(10, d=COSINE)} SELECT q, rk, t, round(d, 6) AS d FROM knn")
def _(spark, sf):
    return rounded(K.knn(corpus(spark, sf), 10, "cosine"), "d")


@query("knn_cross", f"WITH {SIDES}, {near(5, 're', 'sy', own=False)} SELECT q, rk, t, round(d, 6) AS d FROM knn")
def _(spark, sf):
    return rounded(K.knn(real(spark, sf), 5, targets=synth(spark, sf)), "d")


@query("knn_agreement", f"WITH {E}, {near(10, name='a')}, {near(10, name='b', d=COSINE)} SELECT a.q, round(count(b.t) / 10, 6) AS overlap FROM a LEFT JOIN b ON a.q = b.q AND a.t = b.t GROUP BY a.q")
def _(spark, sf):
    return rounded(structure.overlap(K.both(corpus(spark, sf), 10), 10), "overlap")


@query("kth_nn", f"WITH {E}, {near(5)} SELECT q, round(max(d), 6) AS d FROM knn GROUP BY q")
def _(spark, sf):
    return rounded(K.knn(corpus(spark, sf), 5).groupBy("q").agg(F.max("d").alias("d")), "d")


# Difficulty


@query("lid_per_query", f"WITH {E}, {near(20)}, {lids()} SELECT q, round(lid, 6) AS lid FROM lids")
def _(spark, sf):
    return rounded(difficulty.lid(K.knn(corpus(spark, sf), 20)), "lid")


@query("relative_contrast", f"WITH {E}, {near(10)}, {contrast()} SELECT q, round(contrast, 6) AS contrast FROM contrasts")
def _(spark, sf):
    e = corpus(spark, sf)
    return rounded(difficulty.relative_contrast(e, K.knn(e, 10), targets=difficulty.CONTRAST_TARGETS), "contrast")


@query("k_occurrence", f"WITH {E}, {near(10)}, {occurrence('10')} SELECT vec_id, n FROM occ")
def _(spark, sf):
    e = corpus(spark, sf)
    return difficulty.k_occurrence(e, K.knn(e, 10), 10)


@query("hubness_skew", f"WITH {E}, {near(10)}, {occurrence('10')} SELECT round({SKEW}, 6) AS hubness_skew FROM occ")
def _(spark, sf):
    e = corpus(spark, sf)
    return difficulty.k_occurrence(e, K.knn(e, 10), 10).agg(r6(difficulty.skew("n")).alias("hubness_skew"))


@query("ivf_occupancy", f"WITH {E}, {cells(16)} SELECT cell, n FROM cells")
def _(spark, sf):
    return difficulty.ivf_occupancy(corpus(spark, sf), 16)


@query("ivf_gini", f"WITH {E}, {cells(16)} SELECT round({GINI}, 6) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM cells)")
def _(spark, sf):
    return rounded(difficulty.gini(difficulty.ivf_occupancy(corpus(spark, sf), 16)), "gini")


@query("ivf_lorenz", f"WITH {E}, {cells(16)} SELECT i, round(i / count(*) OVER (), 6) AS share_cells, round(c / sum(n) OVER (), 6) AS share_points FROM (SELECT n, row_number() OVER w AS i, sum(n) OVER w AS c FROM cells WINDOW w AS (ORDER BY n, cell ROWS UNBOUNDED PRECEDING))")
def _(spark, sf):
    return rounded(difficulty.lorenz(difficulty.ivf_occupancy(corpus(spark, sf), 16)), "share_cells", "share_points")


def summary_sql(src: str, k: int, k_hub: int, nlist: int, p: str, targets: int = 2000) -> tuple[str, str]:
    """CTEs and the row of one corpus; its contrast is against a sample of `targets`, or all if 0."""
    lists = f"(SELECT greatest(2, least({nlist}, count(*) // 2)) FROM {src})"
    ctes = f"{near(k, src, src, f'{p}k')}, {lids(f'{p}k', f'{p}l')}, {contrast(src, f'{p}k', f'{p}c', targets)}, {occurrence(str(k_hub), src, f'{p}k', f'{p}o')}, {cells(lists, src, f'{p}i')}"
    row = f"""(SELECT round(quantile_cont(lid, 0.5), 6) FROM {p}l) AS lid_median, (SELECT round(quantile_cont(contrast, 0.5), 6) FROM {p}c) AS relative_contrast_median,
      (SELECT round({SKEW}, 6) FROM {p}o) AS hubness_skew, (SELECT round({GINI}, 6) FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM {p}i)) AS ivf_gini,
      (SELECT count(*) FROM {src}) - (SELECT count(*) FROM {p}l) AS lid_discarded_queries, (SELECT count(*) FROM {src}) AS ann_measured_rows,
      (SELECT least({k}, count(*) - 1) FROM {src}) AS ann_k, {lists} AS ann_nlist"""
    return ctes, row


FOUR = ("lid_median", "relative_contrast_median", "hubness_skew", "ivf_gini")
_all = summary_sql("e", 100, 10, 256, "z")
_whole = summary_sql("e", 100, 10, 256, "z", 0)


@query("ann_summary", f"WITH {E}, {_whole[0]} SELECT {_whole[1]}")
def ann_summary(spark, sf):
    return rounded(difficulty.summary(corpus(spark, sf)), *FOUR)


@query("ann_summary_orders")
def _(spark, sf):
    """The canonical conditions, which the vectors' table is too small for: 20,000 orders, 100 neighbours, 256 cells."""
    v = F.array(F.col("o_totalprice") / 1000, (F.col("o_custkey") % 1000).cast("double"), F.dayofyear("o_orderdate").cast("double"), F.year("o_orderdate") * 10.0)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("vec_id"), v.alias("v"))
    return rounded(difficulty.summary(orders, max_rows=20_000, targets=difficulty.CONTRAST_TARGETS), *FOUR)


_re, _sy = summary_sql("re", 50, 10, 64, "r"), summary_sql("sy", 50, 10, 64, "s")


@query("ann_summary_by_series", f"WITH {SIDES}, {_re[0]}, {_sy[0]} SELECT 'real' AS series, {_re[1]} UNION ALL SELECT 'synth', {_sy[1]}")
def _(spark, sf):
    a, b = (difficulty.summary(s(spark, sf), 50, 10, 64, targets=difficulty.CONTRAST_TARGETS).withColumn("series", F.lit(n)) for n, s in (("real", real), ("synth", synth)))
    return rounded(a.unionByName(b), *FOUR)


@query("kmeans_ivf")
def _(spark, sf):
    return difficulty.kmeans_occupancy(corpus(spark, sf), 16)


# Sampling


@query("sample_topk", f"WITH {E} SELECT vec_id, series FROM {drawn('e', 50)}")
def _(spark, sf):
    return sampling.sample(corpus(spark, sf), 50, 42).select("vec_id", "series")


@query("holdout_split", f"WITH {E}, r AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', vec_id)), vec_id) AS rn FROM e) SELECT vec_id, rn <= greatest(1, round_even(0.05::DOUBLE * (SELECT count(*) FROM e), 0)::BIGINT) AS is_holdout FROM r")
def _(spark, sf):
    return sampling.holdout_split(corpus(spark, sf), 0.05, 42).select("vec_id", "is_holdout")


@query("disjoint_draws", f"WITH {E}, r AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', vec_id)), vec_id) AS rn FROM e) SELECT vec_id, ((rn - 1) // 100)::INT AS draw FROM r WHERE rn <= 400")
def _(spark, sf):
    return sampling.disjoint_draws(corpus(spark, sf), 4, 100, 42).select("vec_id", "draw")


def pairs_sql(pairs: int, src: str = "e", seed=42, name: str = "pairs") -> str:
    n = lambda side: f"('0x' || substr(md5(concat_ws(':', '{seed}', '{side}', p)), 1, 12))::BIGINT % (SELECT count(*) FROM {src})"
    return f"{name}_r AS (SELECT vec_id, v, row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}', vec_id)), vec_id) - 1 AS r FROM {src}), {name} AS (SELECT p AS pair, a.vec_id AS a, b.vec_id AS b, a.v AS va, b.v AS vb FROM (SELECT p, {n('a')} AS i, {n('b')} AS j FROM (SELECT unnest(range({pairs})) AS p)) d JOIN {name}_r a ON a.r = i JOIN {name}_r b ON b.r = j WHERE i <> j)"


@query("random_pairs", f"WITH {E}, {pairs_sql(2000)} SELECT pair, a, b FROM pairs")
def _(spark, sf):
    return sampling.random_pairs(corpus(spark, sf), 2000, 42)


@query("shuffled_batches", f"WITH {E}, r AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42:3', vec_id)), vec_id) AS rn FROM e) SELECT vec_id, (rn - 1) // 64 AS batch FROM r WHERE rn <= (SELECT count(*) // 64 * 64 FROM e)")
def _(spark, sf):
    return sampling.shuffled_batches(spark, corpus(spark, sf), 64, 3, 42)


@query("variant_seed", "SELECT name, (42 + ('0x' || substr(sha256(name), 1, 8))::BIGINT) % 2147483648 AS seed FROM (SELECT DISTINCT p_name AS name FROM part)")
def _(spark, sf):
    return sampling.variant_seeds(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("name")).distinct(), 42)


# Vectors


@query("l2_normalize", f"WITH {ITEMS} SELECT series, dim, round(avg(y), 6) AS mean, round(max(y), 6) AS high FROM (SELECT series, unnest(range(4))::INT AS dim, unnest(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8))) AS y FROM e) GROUP BY ALL")
def _(spark, sf):
    x = exploded(l2_normalize(items(spark, sf)), "series")
    return rounded(x.groupBy("series", "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("high")), "mean", "high")


@query("unit_norm_check", f"WITH {E}, n AS (SELECT sqrt(list_dot_product(v, v)) AS n FROM e) SELECT count(*) AS rows, count(*) FILTER (abs(n - 1) > 1e-4 + 1e-5 AND n <> 0) AS off, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max FROM n")
def _(spark, sf):
    return rounded(structure.unit_norm(corpus(spark, sf)), "norm_min", "norm_max")


@query("finite_check", f"WITH {E} SELECT count(*) AS rows, count(*) FILTER (len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS off FROM e")
def _(spark, sf):
    return corpus(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~sound(F.col("v"))).alias("off"))


@query("glyph_cells", f'WITH {WIDE} SELECT vec_id, dim, dim // 32 AS "row", (dim // 8) % 4 AS col, dim % 8 AS bin, round(x, 6) AS x FROM c')
def _(spark, sf):
    return rounded(panels.glyph_cells(wide(spark, sf)), "x")


@query("glyph_scale", f"WITH {WIDE} SELECT round(coalesce(1 / quantile_cont(abs(x), 0.99), 0), 6) AS scale FROM c WHERE x <> 0")
def _(spark, sf):
    return rounded(panels.glyph_scale(wide(spark, sf)), "scale")


@query("glyph_rays", f"""WITH {WIDE}, r AS (SELECT vec_id, dim, x, dim // 32 AS "row", (dim // 8) % 4 AS col, radians(45.0::DOUBLE) * (dim % 8) AS angle,
  CASE WHEN x < 0 THEN greatest(least(abs(x) * 2, 1), 0.35) ELSE least(abs(x) * 2, 1) END / 2 AS len FROM c WHERE x <> 0)
SELECT vec_id, dim, x < 0 AS negative, col::DOUBLE AS x0, -"row"::DOUBLE + 0.0 AS y0, round(col + len * cos(angle), 6) + 0.0 AS x1, round(-"row" + len * sin(angle), 6) + 0.0 AS y1 FROM r""")
def _(spark, sf):
    return rounded(panels.glyph_rays(wide(spark, sf), 2.0), "x0", "y0", "x1", "y1")


# Fidelity


@query("mean_var_l2", f"WITH {M} SELECT round(sqrt(sum((r.mean - s.mean) ** 2)), 6) AS mean_l2, round(sqrt(sum((r.var - s.var) ** 2)), 6) AS var_l2 FROM m r JOIN m s USING (dim) WHERE r.series = 'real' AND s.series = 'synth'")
def _(spark, sf):
    return rounded(fidelity.mean_var_l2(corpus(spark, sf)), "mean_l2", "var_l2")


PAIRED = X + ", p AS (SELECT a.series, a.dim AS i, b.dim AS j, {f} AS c FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL)"


@query("cov_fro", f"WITH {PAIRED.format(f='covar_samp(a.x, b.x)')} SELECT round(sqrt(sum((r.c - s.c) ** 2)), 6) AS cov_fro FROM p r JOIN p s USING (i, j) WHERE r.series = 'real' AND s.series = 'synth'")
def _(spark, sf):
    return rounded(one(spark, cov_fro=fidelity.covariance_fro(corpus(spark, sf))), "cov_fro")


def _kernel(a: str, b: str) -> str:
    return f"(SELECT avg(exp(-(list_distance(a.v, b.v) ** 2))) FROM {a} a, {b} b)"


@query("mmd_rbf", f"WITH {SIDES} SELECT round({_kernel('re', 're')} + {_kernel('sy', 'sy')} - 2 * {_kernel('re', 'sy')}, 6) AS mmd_rbf")
def _(spark, sf):
    a, b = (sampling.sample(s(spark, sf), 5000, 42) for s in (real, synth))
    return rounded(one(spark, mmd_rbf=fidelity.mmd_rbf(a, b)), "mmd_rbf")


_L1 = f"""WITH {SIDES}, h AS (SELECT greatest(2 * a, a + b, 1e-6) AS h FROM (SELECT (SELECT max(sqrt(list_dot_product(v, v))) FROM re) AS a, (SELECT max(sqrt(list_dot_product(v, v))) FROM sy) AS b)),
d AS (SELECT 'r' AS s, list_distance(a.v, b.v) AS d FROM re a, re b UNION ALL SELECT 'f', list_distance(a.v, b.v) FROM re a, sy b),
n AS (SELECT s, least(floor(d / h * 50), 49)::BIGINT AS bin, count(*) AS n FROM d, h GROUP BY ALL),
p AS (SELECT s, bin, n / sum(n) OVER (PARTITION BY s) / (h / 50) AS p FROM n, h),
b AS (SELECT unnest(range(50)) AS bin)"""


@query("pairwise_hist_l1", f"{_L1} SELECT round(sum(abs(coalesce(r.p, 0) - coalesce(f.p, 0))), 5) AS hist_l1 FROM b LEFT JOIN (SELECT * FROM p WHERE s = 'r') r USING (bin) LEFT JOIN (SELECT * FROM p WHERE s = 'f') f USING (bin)")
def _(spark, sf):
    own = fidelity.pairwise_hist_l1(real(spark, sf), synth(spark, sf))
    return own.agg(F.round(F.sum(F.abs(F.col("real") - F.col("synth"))), 5).alias("hist_l1"))


def halves(spark, sf):
    """Queries and training part of the real series."""
    split = sampling.holdout_split(real(spark, sf), 0.2, 42)
    return split.where("is_holdout"), split.where("not is_holdout")


HALVES = SIDES + ", ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', vec_id)), vec_id) AS rn, greatest(1, round_even(0.2::DOUBLE * count(*) OVER (), 0)) AS h FROM re), qs AS (SELECT * FROM ranked WHERE rn <= h), tr AS (SELECT * FROM ranked WHERE rn > h)"


@query("knn_recall", f"WITH {HALVES}, {near(10, 'qs', 'tr', 'kr', own=False)}, {near(1, 'qs', 'sy', 'ks', own=False)} SELECT round(avg((f <= r)::INT), 6) AS knn_recall FROM (SELECT q, max(d) AS r FROM kr GROUP BY q) JOIN (SELECT q, d AS f FROM ks) USING (q)")
def _(spark, sf):
    q, t = halves(spark, sf)
    return rounded(fidelity.knn_recall(q, t, synth(spark, sf)), "knn_recall")


@query("ann_proxy_recall", f"WITH {HALVES}, {near(10, 'qs', 'tr', 'kr', own=False)}, {near(10, 'qs', 'sy', 'ks', own=False)} SELECT round(exp(-abs(avg(least(greatest(f / (r + 1e-8), 0), 10)) - 1)), 6) AS ann_proxy_recall FROM (SELECT q, avg(d) AS r FROM kr GROUP BY q) JOIN (SELECT q, avg(d) AS f FROM ks GROUP BY q) USING (q)")
def _(spark, sf):
    q, t = halves(spark, sf)
    return rounded(fidelity.ann_proxy_recall(q, t, synth(spark, sf)), "ann_proxy_recall")


W1 = X + ", lv AS (SELECT unnest(range(512)) / 511.0::DOUBLE AS p), srt AS (SELECT series, dim, list_sort(list(x)) AS s FROM x GROUP BY ALL), qn AS (SELECT series, dim, p, s[floor(p * (len(s) - 1))::INT + 1] + (p * (len(s) - 1) - floor(p * (len(s) - 1))) * (s[ceil(p * (len(s) - 1))::INT + 1] - s[floor(p * (len(s) - 1))::INT + 1]) AS q FROM srt, lv), w1 AS (SELECT dim, avg(abs(a.q - b.q)) AS w1 FROM qn a JOIN qn b USING (dim, p) WHERE a.series = 'real' AND b.series = 'synth' GROUP BY dim)"


@query("w1_by_dim", f"WITH {W1} SELECT dim, round(w1, 6) AS w1 FROM w1")
def _(spark, sf):
    return rounded(fidelity.wasserstein_by_dim(corpus(spark, sf)), "w1")


@query("dim_divergence", f"WITH {W1} SELECT dim, round(w1, 6) AS w1, ord FROM (SELECT *, row_number() OVER (ORDER BY w1 DESC, dim) AS ord FROM w1) WHERE ord <= 16")
def _(spark, sf):
    return rounded(fidelity.dimension_divergence(corpus(spark, sf)), "w1")


TENSOR = f"""WITH {ITEMS}, x AS (SELECT series, unnest(range(4))::INT AS dim, unnest(v) AS x FROM e), m AS (SELECT series, dim, avg(x) AS mean, var_pop(x) AS var, avg((x = 0)::INT) AS zero FROM x GROUP BY ALL),
n AS (SELECT series, stddev_pop(len(list_filter(v, lambda x: x <> 0))) AS std, sum(len(list_filter(v, lambda x: x < 0))) / sum(len(v)) AS neg FROM e GROUP BY series),
c AS (SELECT series, i, j, covar_samp(v[i], v[j]) AS c FROM e, (SELECT unnest(range(1, 5)) AS i) a, (SELECT unnest(range(1, 5)) AS j) b GROUP BY ALL)
SELECT round(sqrt(sum((r.mean - s.mean) ** 2)), 4) AS mean_l2, round(sqrt(sum((r.var - s.var) ** 2)), 1) AS var_l2, round(avg(abs(r.zero - s.zero)), 6) AS per_dim_zero_rate_l1, round(abs(avg(r.zero) - avg(s.zero)), 6) AS zero_fraction_gap,
  (SELECT round(neg, 6) FROM n WHERE series = 'synth') AS negative_fraction, (SELECT round(abs(max(std) - min(std)), 6) FROM n) AS nnz_std_gap,
  (SELECT round(sqrt(sum((a.c - b.c) ** 2)), 1) FROM c a JOIN c b USING (i, j) WHERE a.series = 'real' AND b.series = 'synth') AS cov_fro
FROM m r JOIN m s USING (dim) WHERE r.series = 'real' AND s.series = 'synth'"""


@query("tensor_stats", TENSOR)
def _(spark, sf):
    t = fidelity.tensor_stats(items(spark, sf))
    return one(spark, **{k: float(v) for k, v in t.items()}).select(*[(F.round(c, {"mean_l2": 4, "var_l2": 1, "cov_fro": 1}.get(c, 6)) + F.lit(0.0)).alias(c) for c in t])


@query("collapse_stats", f"WITH {X}, s AS {drawn('e', 512)}, d AS (SELECT list_distance(a.v, b.v) AS d FROM s a JOIN s b ON a.vec_id < b.vec_id) SELECT round(avg(d), 6) AS pdist_mean, round(min(d), 6) AS pdist_min, (SELECT round(avg(sd), 6) FROM (SELECT stddev_pop(x) AS sd FROM x WHERE vec_id IN (SELECT vec_id FROM s) GROUP BY dim)) AS std_mean FROM d")
def _(spark, sf):
    return rounded(fidelity.pdist(sampling.sample(corpus(spark, sf), 512, 42)), "pdist_mean", "pdist_min", "std_mean")


PROFILE = "{n} AS (SELECT rk, avg(ln(greatest(least(d / rmax, 1.0), 1e-12))) AS profile FROM (SELECT *, min(d) OVER (PARTITION BY q) AS r1, max(d) OVER (PARTITION BY q) AS rmax, max(rk) OVER (PARTITION BY q) AS k FROM {k}) WHERE r1 > 0 AND r1 < rmax AND rk < k GROUP BY rk)"


@query("log_ratio_profile", f"WITH {SIDES}, {near(12, 're', 're')}, {PROFILE.format(n='p', k='knn')} SELECT rk, round(profile, 6) + 0.0 AS profile FROM p")
def _(spark, sf):
    return rounded(fidelity.log_ratio_profile(K.knn(real(spark, sf), 12)), "profile")


@query("log_ratio_penalty", f"WITH {SIDES}, {near(12, 're', 're', 'ka')}, {near(12, 'sy', 'sy', 'kb')}, {PROFILE.format(n='pa', k='ka')}, {PROFILE.format(n='pb', k='kb')} SELECT round(sum(abs(pa.profile - pb.profile)), 6) AS penalty FROM pa JOIN pb USING (rk)")
def _(spark, sf):
    a, b = (fidelity.log_ratio_profile(K.knn(s(spark, sf), 12)) for s in (real, synth))
    return rounded(fidelity.log_ratio_penalty(a, b), "penalty")


#: Small, so that a few thousand events of a key are several tasks' work too.
EVENTS_OF_A_PIECE = 512


@query("ema_target", """WITH RECURSIVE x AS (SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step, avg(value) OVER (PARTITION BY event_type ORDER BY event_id) AS x FROM events),
f AS (SELECT key, step, x AS ema FROM x WHERE step = 1 UNION ALL SELECT x.key, x.step, f.ema * 0.99 + x.x * (1 - 0.99) FROM f JOIN x ON x.key = f.key AND x.step = f.step + 1) SELECT key, step, round(ema, 6) AS ema FROM f""")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("key"), "event_id", "value")
    sums = scans.running(events, ["key"], "event_id", {"step": ("sum", F.lit(1).cast("long")), "total": ("sum", F.col("value")), "n": ("sum", F.col("value").isNotNull().cast("long"))}, piece_rows=EVENTS_OF_A_PIECE)
    return fidelity.ema(sums.select("key", "step", (F.col("total") / F.nullif("n", F.lit(0))).alias("x")), piece_rows=EVENTS_OF_A_PIECE).withColumn("ema", F.round("ema", 6))


# Panels

SXV = X + ", vals AS (SELECT series, x FROM x)"


@query("value_hist", f"WITH {SXV}, {hist('vals', 80)}")
def _(spark, sf):
    return panel(panels.histogram(panels.values(corpus(spark, sf)), 80))


@query("dim_marginals", f"WITH {X}, vals AS (SELECT series, dim, x FROM x), {hist('vals', 20, 'dim')}")
def _(spark, sf):
    return panel(panels.dim_marginals(corpus(spark, sf), 20))


@query("dim_profiles", f"WITH {M} SELECT series, dim, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std, round(zero, 6) AS zero_fraction FROM m")
def _(spark, sf):
    return rounded(panels.dim_profiles(corpus(spark, sf)), "mean", "std", "zero_fraction")


@query("dim_profiles_items", f"WITH {ITEMS}, x AS (SELECT series, unnest(range(4))::INT AS dim, unnest(v) AS x FROM e) SELECT series, dim, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(avg((x = 0)::INT), 6) AS zero_fraction FROM x GROUP BY ALL")
def _(spark, sf):
    d = panels.dim_profiles(items(spark, sf))
    return d.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "zero_fraction": F.round("zero_fraction", 6)})


@query("norm_hist", f"WITH {ITEMS}, vals AS (SELECT series, sqrt(list_dot_product(v, v)) AS x FROM e), {hist('vals', 40)}")
def _(spark, sf):
    return panel(panels.histogram(panels.norms(items(spark, sf)), 40))


@query("pairwise_hist", f"WITH {SIDES}, {pairs_sql(200_000, 're', name='pr')}, {pairs_sql(200_000, 'sy', name='ps')}, vals AS (SELECT 'real' AS series, list_distance(va, vb) AS x FROM pr UNION ALL SELECT 'synth', list_distance(va, vb) FROM ps), {hist('vals', 40)}")
def _(spark, sf):
    return panel(panels.histogram(panels.pairwise(corpus(spark, sf), 200_000, 42), 40))


@query("kth_nn_hist", f"WITH {SIDES}, {near(5, 're', 're', 'ka')}, {near(5, 'sy', 'sy', 'kb')}, vals AS (SELECT 'real' AS series, max(d) AS x FROM ka GROUP BY q UNION ALL SELECT 'synth', max(d) FROM kb GROUP BY q), {hist('vals', 40)}")
def _(spark, sf):
    return panel(panels.histogram(panels.kth_distance(corpus(spark, sf), 5), 40))


@query("lid_hist", f"WITH {SIDES}, {near(20, 're', 're', 'ka')}, {near(20, 'sy', 'sy', 'kb')}, {lids('ka', 'la')}, {lids('kb', 'lb')}, vals AS (SELECT 'real' AS series, lid AS x FROM la UNION ALL SELECT 'synth', lid FROM lb), {hist('vals', 40)}")
def _(spark, sf):
    return panel(panels.histogram(panels.lids(corpus(spark, sf), 20), 40))


@query("contrast_hist", f"WITH {SIDES}, {near(10, 're', 're', 'ka')}, {near(10, 'sy', 'sy', 'kb')}, {contrast('re', 'ka', 'ca')}, {contrast('sy', 'kb', 'cb')}, vals AS (SELECT 'real' AS series, contrast AS x FROM ca UNION ALL SELECT 'synth', contrast FROM cb), {hist('vals', 40)}")
def _(spark, sf):
    return panel(panels.histogram(panels.contrasts(corpus(spark, sf), 10, 42), 40))


@query("hubness_hist", f"WITH {SIDES}, {near(10, 're', 're', 'ka')}, {near(10, 'sy', 'sy', 'kb')}, {occurrence('10', 're', 'ka', 'oa')}, {occurrence('10', 'sy', 'kb', 'ob')}, vals AS (SELECT 'real' AS series, n::DOUBLE AS x FROM oa UNION ALL SELECT 'synth', n::DOUBLE FROM ob), {hist('vals', 30)}")
def _(spark, sf):
    return panel(panels.histogram(panels.hubness(corpus(spark, sf), 10), 30))


@query("distance_cdf", f"""WITH {SIDES}, qs AS {drawn('re', 200)}, ts AS {drawn('re', 5000, 43)}, d AS (SELECT q.vec_id AS q, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS i, list_distance(q.v, t.v) AS d FROM qs q JOIN ts t ON q.vec_id <> t.vec_id),
n AS (SELECT min(m) AS m FROM (SELECT max(i) AS m FROM d GROUP BY q)) SELECT i, round(i / any_value(m), 6) AS y, round(quantile_cont(d, 0.1), 6) AS q10, round(quantile_cont(d, 0.5), 6) AS q50, round(quantile_cont(d, 0.9), 6) AS q90 FROM d, n WHERE i <= m GROUP BY i""")
def _(spark, sf):
    r = real(spark, sf)
    return rounded(panels.distance_cdf(sampling.sample(r, 200, 42), sampling.sample(r, 5000, 43)), "y", "q10", "q50", "q90")


CORR = PAIRED.format(f="corr(a.x, b.x)")


@query("correlation", f"WITH {CORR} SELECT series, i, j, round(c, 6) + 0.0 AS r FROM p")
def _(spark, sf):
    return rounded(structure.correlation(corpus(spark, sf)), "r")


@query("correlation_diff", f"WITH {CORR} SELECT i, j, round(b.c - a.c, 6) + 0.0 AS diff FROM p a JOIN p b USING (i, j) WHERE a.series = 'real' AND b.series = 'synth'")
def _(spark, sf):
    c = structure.correlation(corpus(spark, sf))
    a, b = (c.where(F.col("series") == s).select("i", "j", F.col("r").alias(s)) for s in ("real", "synth"))
    return a.join(b, ["i", "j"]).select("i", "j", r6(F.col("synth") - F.col("real")).alias("diff"))


@query("pca_spectrum")
def _(spark, sf):
    return rounded(panels.pca_spectrum(corpus(spark, sf)), "ratio", "cum")


# Structure


@query("norm_facts", f"WITH {ITEMS}, n AS (SELECT sqrt(list_dot_product(v, v)) AS n FROM e) SELECT round(avg(n), 3) AS norm_mean, round(stddev_pop(n), 3) AS norm_std, round(max(abs(n - 1)), 3) AS max_deviation FROM n")
def _(spark, sf):
    return structure.norm_facts(items(spark, sf)).select(*[F.round(c, 3).alias(c) for c in ("norm_mean", "norm_std", "max_deviation")])


@query("anisotropy", f"WITH {X}, mv AS (SELECT list(m ORDER BY dim) AS m FROM (SELECT dim, avg(x) AS m FROM x GROUP BY dim)), s AS (SELECT m, sqrt(list_dot_product(m, m)) AS size FROM mv), c AS (SELECT size, list_dot_product(v, m) / greatest(size, 1e-12) AS c FROM e, s) SELECT round(max(size), 6) AS mean_norm, round(quantile_cont(c, 0.5), 6) + 0.0 AS cos_median, round(min(c), 6) AS cos_min FROM c")
def _(spark, sf):
    return rounded(structure.anisotropy(corpus(spark, sf)), "mean_norm", "cos_median", "cos_min")


@query("pairwise_cosine", f"WITH {E}, {pairs_sql(200_000)}, c AS (SELECT list_cosine_similarity(va, vb) AS c FROM pairs) SELECT round(quantile_cont(c, 0.5), 6) + 0.0 AS cos_median, round(quantile_cont(c, 0.99), 6) AS cos_p99 FROM c")
def _(spark, sf):
    x = structure.pair_values(corpus(spark, sf), 200_000, 42, structure.cosine)
    return rounded(x.agg(F.percentile("x", F.lit(0.5)).alias("cos_median"), F.percentile("x", F.lit(0.99)).alias("cos_p99")), "cos_median", "cos_p99")


def _gram(f: str) -> str:
    return f"SELECT series, sum(CASE WHEN i = j THEN c END) ** 2 / sum(c * c) AS p FROM (SELECT a.series, a.dim AS i, b.dim AS j, {f} AS c FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL) GROUP BY series"


@query("gram_participation", f"WITH {X}, raw AS ({_gram('avg(a.x * b.x)')}), mid AS ({_gram('covar_pop(a.x, b.x)')}) SELECT series, round(raw.p, 5) AS raw, round(mid.p, 5) AS centred FROM raw JOIN mid USING (series)")
def _(spark, sf):
    e = corpus(spark, sf)
    raw, mid = (structure.gram_participation(e, c) for c in (False, True))
    return spark.createDataFrame([(s, raw[s], mid[s]) for s in raw], "series string, raw double, centred double").withColumns({c: F.round(c, 5) for c in ("raw", "centred")})


@query("spectrum_facts")
def _(spark, sf):
    rows = [(s, *map(float, structure.spectrum_facts(v).values())) for s, v in structure.eigenvalues(corpus(spark, sf)).items()]
    return rounded(spark.createDataFrame(rows, "series string, components_90 double, components_95 double, components_99 double, participation double, top_share double"), "participation", "top_share")


@query("effective_rank")
def _(spark, sf):
    e = corpus(spark, sf)
    n = {r.series: r["count"] for r in e.groupBy("series").count().collect()}
    return rounded(spark.createDataFrame([(s, structure.effective_rank(v, n[s])) for s, v in structure.eigenvalues(e, True, 1).items()], "series string, effective_rank double"), "effective_rank")


@query("spectrum_distance")
def _(spark, sf):
    v = structure.eigenvalues(corpus(spark, sf), True, 1)
    return rounded(one(spark, spectrum_distance=structure.spectrum_distance(v["real"], v["synth"])), "spectrum_distance")


@query("residual_correlation")
def _(spark, sf):
    """Mean correlation left by distance of dimensions, after the first eigenvector."""
    c, _, _ = fidelity.covariances(corpus(spark, sf).withColumn("series", F.lit("x")), 0)["x"]
    d = np.sqrt(np.diag(c))
    r = structure.residual_correlation(c / np.outer(d, d))
    rows = [(g, float(np.mean(np.diagonal(r, g)))) for g in range(1, 13)]
    mass = structure.rank_mass(c / np.outer(d, d))
    return rounded(spark.createDataFrame([(g, x, mass.get(g)) for g, x in rows], "gap int, residual double, mass double"), "residual", "mass")


@query("two_nn", f"WITH {E}, {near(2)} SELECT round(1 / avg(ln(r2 / r1)), 5) AS dimension FROM (SELECT min(d) AS r1, max(d) AS r2 FROM knn GROUP BY q) WHERE r1 > 0 AND r2 > r1")
def _(spark, sf):
    return structure.two_nn(sampling.sample(corpus(spark, sf), 20_000, 42)).select(F.round("dimension", 5).alias("dimension"))


@query("angular_vs_l2", f"WITH {E}, {near(10, name='a')}, {near(10, name='b', d=COSINE)}, {lids('a', 'la')}, {lids('b', 'lb')}, {occurrence('10', 'e', 'a', 'oa')}, {occurrence('10', 'e', 'b', 'ob')} SELECT (SELECT round(avg(c) / 10, 6) FROM (SELECT count(b.t) AS c FROM a LEFT JOIN b ON a.q = b.q AND a.t = b.t GROUP BY a.q)) AS agreement, (SELECT round(quantile_cont(lid, 0.5), 5) FROM la) AS lid_l2, (SELECT round({SKEW}, 5) FROM oa) AS hubness_l2, (SELECT round(quantile_cont(lid, 0.5), 5) FROM lb) AS lid_cosine, (SELECT round({SKEW}, 5) FROM ob) AS hubness_cosine")
def _(spark, sf):
    out = structure.angular_vs_l2(corpus(spark, sf), 10)
    return out.select(*[F.round(c, 6 if c == "agreement" else 5).alias(c) for c in out.columns])


_draws = {d: summary_sql(f"e{d}", 100, 10, 256, f"d{d}") for d in range(10)}
_floor = ", ".join(f"e{d} AS (SELECT vec_id, v FROM rk WHERE (rn - 1) // (SELECT least(20000, count(*) // 10) FROM e) = {d})" for d in _draws) + ", " + ", ".join(c for c, _ in _draws.values())
_stats = " UNION ALL ".join(f"SELECT {d} AS draw, {r}" for d, (_, r) in _draws.items())


def unrounded(sql: str) -> str:
    return sql.replace("round(quantile_cont(lid, 0.5), 6)", "quantile_cont(lid, 0.5)").replace("round(quantile_cont(contrast, 0.5), 6)", "quantile_cont(contrast, 0.5)").replace(f"round({SKEW}, 6)", SKEW).replace(f"round({GINI}, 6)", GINI)


_raw = unrounded(_stats)


@query("draw_noise_floor", f"WITH {E}, rk AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', vec_id)), vec_id) AS rn FROM e), {_floor}, st AS ({_raw}), lg AS (UNPIVOT (SELECT lid_median, relative_contrast_median, hubness_skew, ivf_gini FROM st) ON COLUMNS(*) INTO NAME statistic VALUE value) SELECT statistic, round(min(value), 5) + 0.0 AS low, round(quantile_cont(value, 0.5), 5) + 0.0 AS middle, round(max(value), 5) + 0.0 AS high, round(max(value) - min(value), 5) AS spread, round(100 * (max(value) - min(value)) / nullif(abs(quantile_cont(value, 0.5)), 0), 3) AS spread_pct FROM lg GROUP BY statistic")
def _(spark, sf):
    e = corpus(spark, sf)
    out = structure.draw_floor(structure.long_statistics(structure.draw_statistics(e, 10, min(20_000, e.count() // 10), 100, 10, 256), "draw"))
    return out.select("statistic", *[(F.round(c, 3 if c == "spread_pct" else 5) + F.lit(0.0)).alias(c) for c in ("low", "middle", "high", "spread", "spread_pct")])


DRAWS = f"WITH {E}, rk AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', vec_id)), vec_id) AS rn FROM e), {_floor}, st AS ({_raw}), lg AS (UNPIVOT (SELECT lid_median, relative_contrast_median, hubness_skew, ivf_gini FROM st) ON COLUMNS(*) INTO NAME statistic VALUE value), sp AS (SELECT statistic, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low, max(value) AS high FROM lg GROUP BY statistic HAVING count(*) > 1)"


def drawn_statistics(spark, sf) -> DataFrame:
    """The statistics of ten disjoint draws."""
    e = corpus(spark, sf)
    return structure.long_statistics(structure.draw_statistics(e, 10, min(20_000, e.count() // 10), 100, 10, 256), "draw").select("statistic", "value")


@query("spread", f"{DRAWS} SELECT statistic, round(mean, 5) AS mean, round(std, 5) AS std, round(low, 5) AS low, round(high, 5) AS high, round(100 * (high - low) / nullif(abs(mean), 0), 3) AS range_pct, round(100 * std / nullif(abs(mean), 0), 3) AS cv_pct FROM sp")
def _(spark, sf):
    out = structure.spread(drawn_statistics(spark, sf))
    return out.select("statistic", *[(F.round(c, 3 if c.endswith("_pct") else 5) + F.lit(0.0)).alias(c) for c in ("mean", "std", "low", "high", "range_pct", "cv_pct")])


@query("noise_floor", f"{DRAWS}, {_all[0]}, al AS (SELECT {unrounded(_all[1])}), r AS (UNPIVOT (SELECT lid_median, relative_contrast_median, hubness_skew, ivf_gini FROM al) ON COLUMNS(*) INTO NAME statistic VALUE real) SELECT statistic, round(mean - real, 5) + 0.0 AS gap, round(abs(mean - real) / nullif(high - low, 0), 4) AS distance_in_spreads FROM sp JOIN r USING (statistic)")
def _(spark, sf):
    """How far the draws' means lie from the whole corpus, in spreads of the draws."""
    whole = structure.long_statistics(difficulty.summary(corpus(spark, sf), targets=difficulty.CONTRAST_TARGETS)).withColumnRenamed("value", "real")
    out = structure.floor(drawn_statistics(spark, sf), whole)
    return out.select("statistic", (F.round("gap", 5) + F.lit(0.0)).alias("gap"), F.round("distance_in_spreads", 4).alias("distance_in_spreads"))


@query("zero_probe", f"WITH {ITEMS}, x AS (SELECT series, unnest(range(4))::INT AS dim, unnest(v) AS x FROM e), z AS (SELECT series, avg(zero) AS zero_rate, sqrt(sum(zero * (1 - zero))) AS independent_std FROM (SELECT series, dim, avg((x = 0)::INT) AS zero FROM x GROUP BY ALL) GROUP BY series), n AS (SELECT series, avg(len(list_filter(v, lambda x: x <> 0))) AS nnz_mean, stddev_pop(len(list_filter(v, lambda x: x <> 0))) AS nnz_std FROM e GROUP BY series) SELECT series, round(nnz_mean, 6) AS nnz_mean, round(nnz_std, 6) AS nnz_std, round(zero_rate, 6) AS zero_rate, round(independent_std, 6) AS independent_std FROM z JOIN n USING (series)")
def _(spark, sf):
    return rounded(structure.zero_probe(items(spark, sf)), "nnz_mean", "nnz_std", "zero_rate", "independent_std")


@query("zero_correlation", f"WITH {ITEMS} SELECT series, (i - 1)::INT AS i, (j - 1)::INT AS j, round(CASE WHEN stddev_pop((v[i] = 0)::INT) * stddev_pop((v[j] = 0)::INT) > 0 THEN corr((v[i] = 0)::INT, (v[j] = 0)::INT) END, 6) + 0.0 AS r FROM e, (SELECT unnest(range(1, 5)) AS i) a, (SELECT unnest(range(1, 5)) AS j) b GROUP BY ALL")
def _(spark, sf):
    zeros = items(spark, sf).withColumn("v", F.transform("v", lambda x: (x == 0).cast("double")))
    return rounded(structure.correlation(zeros), "r")


@query("buffer_stability", f"WITH {SIDES}, p1 AS (SELECT * FROM re WHERE vec_id % 2 = 0), p2 AS (SELECT * FROM re WHERE vec_id % 2 = 1), {near(20, 'sy', 'p1', 'ka', own=False)}, {near(20, 'sy', 'p2', 'kb', own=False)}, j AS (SELECT rk, a.d AS x, b.d AS y FROM ka a JOIN kb b USING (q, rk)) SELECT round(sqrt(avg((x - y) ** 2)) / sqrt(avg(x ** 2)), 6) AS change, round(corr(x, y) FILTER (rk = 1), 6) AS corr_r1, round(corr(x, y) FILTER (rk = 5), 6) AS corr_r5 FROM j")
def _(spark, sf):
    r = real(spark, sf)
    return rounded(structure.buffer_stability(synth(spark, sf), r.where("vec_id % 2 = 0"), r.where("vec_id % 2 = 1")), "change", "corr_r1", "corr_r5")


@query("separability_auc")
def _(spark, sf):
    e = corpus(spark, sf).withColumn("label", (F.col("series") == "real").cast("int"))
    r = e.where("series = 'real'")
    pool = sampling.sample(r, r.count() // 3, 42)
    points = e.join(pool.select("vec_id"), "vec_id", "left_anti")  # the real rows of the pool only
    return rounded(one(spark, auc=structure.separability(points, pool, 10)), "auc")


SUMMARY = f"""SELECT series, count(*) AS rows, round(avg(mean), 6) + 0.0 AS mean, round(max(high), 6) AS high, round(min(low), 6) AS low, round(avg(neg), 6) AS negative_fraction, round(avg(zero), 6) AS zero_fraction, round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) + 0.0 AS norm_std, round(1 - count(DISTINCT v) / count(*), 6) AS duplicate_fraction
FROM (SELECT series, v, list_avg(v) AS mean, list_max(v) AS high, list_min(v) AS low, len(list_filter(v, lambda x: x < 0)) / len(v) AS neg, len(list_filter(v, lambda x: x = 0)) / len(v) AS zero, sqrt(list_dot_product(v, v)) AS norm FROM e) GROUP BY series"""


@query("summary_stats", f"WITH {E} {SUMMARY}")
def _(spark, sf):
    from corpuslens.functions.vectors import norm

    v = F.col("v")
    count = lambda p: F.size(F.filter(v, p)) / F.size(v)
    own = corpus(spark, sf).select("series", "v", (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).alias("m"), F.array_max(v).alias("h"), F.array_min(v).alias("l"), count(lambda x: x < 0).alias("neg"), count(lambda x: x == 0).alias("zero"), norm(v).alias("norm"))
    out = own.groupBy("series").agg(F.count(F.lit(1)).alias("rows"), F.avg("m").alias("mean"), F.max("h").alias("high"), F.min("l").alias("low"), F.avg("neg").alias("negative_fraction"), F.avg("zero").alias("zero_fraction"), F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std"), (1 - F.count_distinct("v") / F.count(F.lit(1))).alias("duplicate_fraction"))
    return rounded(out, *[c for c in out.columns if c not in ("series", "rows")])


# Gates and manifests

GATE = """
canonical: {n: 20000, k: 100, k_hub: 10, nlist: 256}
statistics: {lid_median: {min: 8, max: 16}, relative_contrast_median: {min: 1.5}, hubness_skew: null, ivf_gini: {min: 0.2, max: 0.3}}
"""
_bands = "b(statistic, min, max) AS (VALUES ('lid_median', 8.0::DOUBLE, 16.0::DOUBLE), ('relative_contrast_median', 1.5, NULL), ('hubness_skew', NULL, NULL), ('ivf_gini', 0.2, 0.3))"
_synth = summary_sql("sy", 100, 10, 256, "g")
MEASURED = f"WITH {SIDES}, {_synth[0]}, st AS (SELECT {_synth[1]}), {_bands}, m(statistic, value) AS ({' UNION ALL '.join(f"SELECT '{x}', {x}::DOUBLE FROM st" for x in FOUR)})"
CHECKED = "ck AS (SELECT statistic, value, min, max, CASE WHEN value IS NULL OR isnan(value) THEN 'fail' WHEN min IS NULL AND max IS NULL THEN 'unset' WHEN value < min OR value > max THEN 'fail' ELSE 'pass' END AS outcome FROM b LEFT JOIN m USING (statistic))"
CONDITIONS = "cn AS (SELECT condition, expected, actual, coalesce(expected = actual, false) AS ok FROM (SELECT 'n' AS condition, 20000::BIGINT AS expected, ann_measured_rows AS actual FROM st UNION ALL SELECT 'k', 100, ann_k FROM st UNION ALL SELECT 'nlist', 256, ann_nlist FROM st))"


def gate_parts(spark, sf):
    """A gate on the synthetic series, as it is measured here."""
    gate = gates.load_gate(GATE)
    stats = rounded(difficulty.summary(synth(spark, sf), targets=difficulty.CONTRAST_TARGETS), *FOUR)
    checked = gates.check_statistics(structure.long_statistics(stats), gates.bands(spark, gate))
    canonical = spark.createDataFrame(list(gate["canonical"].items()), "condition string, expected long")
    actual = stats.select(F.inline(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(c).alias("actual")) for n, c in (("n", "ann_measured_rows"), ("k", "ann_k"), ("nlist", "ann_nlist"))])))
    return checked, gates.check_conditions(actual, canonical)


@query("gate_statistics", f"{MEASURED}, {CHECKED} SELECT * FROM ck")
def _(spark, sf):
    return gate_parts(spark, sf)[0]


@query("condition_check", f"{MEASURED}, {CONDITIONS} SELECT * FROM cn")
def _(spark, sf):
    return gate_parts(spark, sf)[1]


@query("gate_verdict", f"{MEASURED}, {CHECKED}, {CONDITIONS}, v AS (SELECT CASE WHEN (SELECT count(*) FROM ck WHERE outcome = 'fail') + (SELECT count(*) FROM cn WHERE NOT ok) > 0 THEN 'fail' WHEN (SELECT count(*) FROM ck WHERE outcome = 'unset') > 0 THEN 'unset' ELSE 'pass' END AS verdict) SELECT verdict, CASE verdict WHEN 'fail' THEN 1 WHEN 'unset' THEN 2 ELSE 0 END AS exit_code FROM v")
def _(spark, sf):
    return gates.verdict(*gate_parts(spark, sf))


@query("family_metric", "SELECT family, CASE WHEN count(DISTINCT metric) = 1 THEN min(metric) END AS metric, count(DISTINCT metric) = 1 AS agreed FROM (SELECT concat(l_returnflag, l_suppkey % 50) AS family, l_linestatus AS metric FROM lineitem) GROUP BY family")
def _(spark, sf):
    """Suppliers' return flags as families, items as variants, their statuses as metrics."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    return gates.family_metric(line.select(F.concat("l_returnflag", F.col("l_suppkey") % 50).alias("family"), F.col("l_linenumber").alias("name"), F.col("l_linestatus").alias("metric")))


@query("sweep_cells", "SELECT rung, seed, rung || '_s' || seed AS name FROM (SELECT DISTINCT source AS rung FROM documents) r, (SELECT DISTINCT label AS seed FROM embeddings) s")
def _(spark, sf):
    rungs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("rung")).distinct()
    return gates.sweep_cells(rungs, spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").alias("seed")).distinct())


@query("condition_note", f"WITH {SIDES}, c AS (SELECT series, 'n=' || least(20000, count(*)) || ', k=' || least(100, count(*) - 1) || ', nlist=' || greatest(2, least(256, count(*) // 2)) AS t FROM e GROUP BY series) SELECT CASE WHEN min(t) = max(t) THEN 'All series: ' || min(t) ELSE string_agg(series || ': ' || t, '; ' ORDER BY series) END AS note FROM c")
def _(spark, sf):
    """How the two series are measured, after clamping."""
    n = corpus(spark, sf).groupBy("series").agg(F.least(F.lit(20_000), F.count(F.lit(1))).alias("n"))
    return panels.condition_note(n.select("series", "n", F.least(F.lit(100), F.col("n") - 1).alias("k"), F.greatest(F.lit(2), F.least(F.lit(256), F.expr("n div 2"))).alias("nlist")))


@query("subset_name", "SELECT dataset, rows, CASE WHEN rows >= 1000000 THEN dataset || '_' || rows // 1000000 || 'm' ELSE dataset || '_' || rows // 1000 || 'k' END AS name FROM (SELECT lang || source AS dataset, sum(n_chars)::BIGINT * CASE WHEN lang = 'en' THEN 100 ELSE 1 END AS rows FROM documents GROUP BY lang, source)")
def _(spark, sf):
    sizes = spark.read.parquet(f"{sf}/documents.parquet").groupBy("lang", "source").agg(F.sum("n_chars").alias("n"))
    own = sizes.select(F.concat("lang", "source").alias("dataset"), (F.col("n") * F.when(F.col("lang") == "en", 100).otherwise(1)).alias("rows"))
    return own.withColumn("name", gates.subset_name(F.col("dataset"), F.col("rows")))


@query("parse_spec", "SELECT spec, CASE WHEN instr(spec, '=') > 1 THEN substr(spec, 1, instr(spec, '=') - 1) ELSE regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1') END AS label, path FROM (SELECT spec, CASE WHEN instr(spec, '=') > 0 THEN substr(spec, instr(spec, '=') + 1) ELSE spec END AS path FROM (SELECT unnest([url, '=' || url || '.npy', page_id || '=' || url, 'p' || page_id || '.fvecs', 'runs/' || page_id]) AS spec FROM pages))")
def _(spark, sf):
    pages, url, page = spark.read.parquet(f"{sf}/pages.parquet"), F.col("url"), F.col("page_id").cast("string")
    specs = [url, F.concat(F.lit("="), url, F.lit(".npy")), F.concat(page, F.lit("="), url), F.concat(F.lit("p"), page, F.lit(".fvecs")), F.concat(F.lit("runs/"), page)]
    label, path = gates.parse_spec(F.col("spec"))
    return pages.select(F.explode(F.array(*specs)).alias("spec")).select("spec", label.alias("label"), path.alias("path"))


@query("best_so_far", "SELECT event_type AS run, event_id AS step, value, coalesce(value < min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM events")
def _(spark, sf):
    return structure.best_so_far(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value"), EVENTS_OF_A_PIECE)


@query("ema_bias_correction", "SELECT user_id, count(*) AS step, round(1 / (1 - 0.99::DOUBLE ** count(*)), 6) AS factor FROM events GROUP BY user_id")
def _(spark, sf):
    """What the average of as many values as a user has events is to be multiplied with."""
    steps = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("step"))
    return steps.select("user_id", "step", F.round(1 / (1 - F.pow(F.lit(0.99), F.col("step"))), 6).alias("factor"))


_whitened = '{"data": {"preprocess": {"center": true, "whiten": true}}}'
_state = '{"preprocess_state": {"descriptor_dim": 1, "mean": [0.5], "whitening_matrix": null, "config": {"center": true, "l2_normalize": %s}}}'
#: The runs' files: a supplier is a run, and what it lacks follows from its number and nation.
_meta = f"CASE s_nationkey % 3 WHEN 0 THEN '{{}}' WHEN 1 THEN '{_state % "true"}' ELSE '{_state % "false"}' END"
FILES = f"""SELECT concat('r/', s_suppkey, '/best_generator.pt') AS path, NULL AS text FROM supplier WHERE s_suppkey % 7 <> 1 AND s_suppkey % 11 <> 3
UNION ALL SELECT concat('r/', s_suppkey, '/run_config.yaml'), CASE WHEN s_suppkey % 4 = 0 THEN '{{"data": {{}}}}' ELSE '{_whitened}' END FROM supplier WHERE s_suppkey % 5 <> 2 AND s_suppkey % 11 <> 3
UNION ALL SELECT concat('r/', s_suppkey, '/run_metadata.json'), {_meta} FROM supplier WHERE s_suppkey % 3 <> 1 AND s_suppkey % 11 <> 3
UNION ALL SELECT concat('r/', s_suppkey, '/notes'), NULL FROM supplier WHERE s_suppkey % 11 <> 3"""


@query("resolve_variants", f"""WITH v AS (SELECT s_name AS name, concat('r/', s_suppkey) AS run_dir FROM supplier), f AS ({FILES}),
r AS (SELECT name, run_dir, count(path) > 0 AS dir, coalesce(bool_or(path = run_dir || '/best_generator.pt'), false) AS pt, coalesce(bool_or(path = run_dir || '/run_config.yaml'), false) AS cfg,
  max(CASE WHEN path = run_dir || '/run_config.yaml' THEN text END) AS config, max(CASE WHEN path = run_dir || '/run_metadata.json' THEN text END) AS meta FROM v LEFT JOIN f ON regexp_replace(path, '/[^/]*$', '') = run_dir GROUP BY ALL),
w AS (SELECT *, coalesce((config::JSON -> 'data' -> 'preprocess' ->> 'whiten')::BOOLEAN, false) OR coalesce((config::JSON -> 'data' -> 'preprocess' ->> 'center')::BOOLEAN, false) AS moved, meta::JSON -> 'preprocess_state' AS state FROM r),
z AS (SELECT name, CASE WHEN NOT dir THEN 'no run directory at ' || run_dir WHEN NOT pt THEN 'no best_generator.pt in ' || run_dir WHEN NOT cfg THEN 'no run_config.yaml in ' || run_dir
  WHEN NOT moved THEN NULL WHEN meta IS NULL THEN 'it centres or whitens, but there are no metadata' WHEN state IS NULL THEN 'it centres or whitens, but its metadata hold no preprocess_state'
  WHEN (state -> 'config' ->> 'l2_normalize')::BOOLEAN AND (state -> 'mean') IS NOT NULL THEN 'rows were divided by their norms after centring' END AS reason FROM w) SELECT name, reason IS NULL AS found, reason FROM z""")
def _(spark, sf):
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    runs = supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("r/"), "s_suppkey").alias("run_dir"))
    braces = FILES.replace("{", "{{").replace("}", "}}")
    return gates.resolve_variants(runs, spark.sql(braces.replace("FROM supplier", "FROM {supplier}"), supplier=supplier))


@query("gate_on_corpus", f"WITH {E}, {_whole[0]}, st AS (SELECT {_whole[1]}), {_bands.replace("b(", "bd(", 1)}, lg(statistic, value) AS ({' UNION ALL '.join(f"SELECT '{s}', {s}::DOUBLE FROM st" for s in FOUR)}) SELECT statistic, value, min, max, CASE WHEN value IS NULL OR isnan(value) THEN 'fail' WHEN min IS NULL AND max IS NULL THEN 'unset' WHEN value < min OR value > max THEN 'fail' ELSE 'pass' END AS outcome FROM bd LEFT JOIN lg USING (statistic)")
def _(spark, sf):
    """The bands of a gate on statistics that are measured here."""
    values = structure.long_statistics(rounded(difficulty.summary(corpus(spark, sf)), *FOUR))
    return gates.check_statistics(values, gates.bands(spark, gates.load_gate(GATE)))


CUSTOMERS = "e AS (SELECT c_custkey AS vec_id, [c_acctbal, c_nationkey::DOUBLE, 100000.0 + c_custkey % 7] AS v FROM customer)"


@query("knn_large_norms", f"WITH {CUSTOMERS}, {near(10)} SELECT q, rk, t, round(d, 6) AS d FROM knn")
def _(spark, sf):
    """Rows of norms around 100,000 whose distances are below 1."""
    v = F.array("c_acctbal", F.col("c_nationkey").cast("double"), F.lit(100_000.0) + F.col("c_custkey") % 7)
    return rounded(K.knn(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("vec_id"), v.alias("v")), 10), "d")


@query("knn_in_blocks", f"WITH {CUSTOMERS}, {near(7)} SELECT q, rk, t, round(d, 6) AS d FROM knn")
def _(spark, sf):
    """Targets that aren't broadcast: they meet the queries block by block."""
    v = F.array("c_acctbal", F.col("c_nationkey").cast("double"), F.lit(100_000.0) + F.col("c_custkey") % 7)
    return rounded(K.knn(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("vec_id"), v.alias("v")), 7, most=0), "d")


@query("batch_knn", f"WITH {E}, b AS (SELECT *, vec_id // 64 AS batch FROM e) SELECT batch, q, rk, t, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rk FROM (SELECT x.batch, x.vec_id AS q, y.vec_id AS t, list_distance(x.v, y.v) AS d FROM b x JOIN b y ON x.batch = y.batch AND x.vec_id <> y.vec_id)) WHERE rk <= 12")
def _(spark, sf):
    return rounded(structure.batch_knn(corpus(spark, sf).withColumn("batch", F.expr("vec_id div 64")), 12), "d")


@query("scatter")
def _(spark, sf):
    return rounded(panels.scatter(corpus(spark, sf)), "x", "y")


_by_series = " UNION ALL ".join(f"SELECT '{n}' AS series, i, round(i / count(*) OVER (), 6) AS share_cells, round(c / sum(n) OVER (), 6) AS share_points FROM (SELECT n, row_number() OVER w AS i, sum(n) OVER w AS c FROM {t}cells WINDOW w AS (ORDER BY n, cell ROWS UNBOUNDED PRECEDING))" for n, t in (("real", "re"), ("synth", "sy")))


@query("ivf_lorenz_by_series", f"WITH {SIDES}, {cells(16, 're', 'recells')}, {cells(16, 'sy', 'sycells')} {_by_series}")
def _(spark, sf):
    return rounded(panels.lorenz(corpus(spark, sf), 16, 42), "share_cells", "share_points")


@query("glyph_rows", f"WITH {SIDES}, r AS (SELECT vec_id, series, row_number() OVER (ORDER BY md5(concat_ws(':', '42', vec_id)), vec_id) AS rn FROM re) SELECT vec_id, series, 'real_' || ((rn - 1) // 8) AS part FROM r WHERE rn <= 16 UNION ALL SELECT vec_id, series, series FROM {drawn('sy', 8)}")
def _(spark, sf):
    return sampling.glyph_rows(corpus(spark, sf), 8, 42)


def relu(spark, sf: str) -> DataFrame:
    return wide(spark, sf).withColumn("v", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))))


@query("empty_cells", f"""WITH {WIDE}, z AS (SELECT vec_id, dim, dim // 8 AS cell, (x <= 0)::INT AS zero FROM c)
SELECT (SELECT round(avg(e), 6) FROM (SELECT min(zero) AS e FROM z GROUP BY vec_id, cell)) AS empty_share, (SELECT round(avg(p), 6) FROM (SELECT product(rate) AS p FROM (SELECT dim, cell, avg(zero) AS rate FROM z GROUP BY ALL) GROUP BY cell)) AS independent_share""")
def _(spark, sf):
    return rounded(structure.empty_cells(relu(spark, sf)), "empty_share", "independent_share")


_pairs = "r AS (SELECT a.dim AS i, b.dim AS j, corr(a.zero, b.zero) AS r FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY ALL), g AS (SELECT r, i // 8 = j // 8 AS same, least((i - j + 16) % 8, (j - i + 16) % 8) AS gap, greatest(abs(i // 32 - j // 32), abs(i // 8 % 4 - j // 8 % 4)) AS steps FROM (SELECT i::INT AS i, j::INT AS j, r FROM r))"


@query("group_correlations", f"""WITH {WIDE}, z AS (SELECT vec_id, dim, (x <= 0)::INT AS zero FROM c), {_pairs.replace("(i - j + 16)", "(i % 8 - j % 8 + 8)").replace("(j - i + 16)", "(j % 8 - i % 8 + 8)")}
SELECT 'cell_gap_' || gap AS pairs, round(avg(r), 6) AS mean FROM g WHERE same AND gap > 0 GROUP BY gap UNION ALL SELECT CASE WHEN steps = 1 THEN 'touching_cells' ELSE 'apart_cells' END, round(avg(r), 6) FROM g WHERE NOT same AND gap = 0 GROUP BY 1""")
def _(spark, sf):
    zeros = relu(spark, sf).select(F.lit("x").alias("series"), F.transform("v", lambda x: (x == 0).cast("double")).alias("v"))
    c, _, _ = fidelity.covariances(zeros, 0)["x"]
    d = np.sqrt(np.diag(c))
    return rounded(spark.createDataFrame(structure.group_correlations(c / np.outer(d, d)), "pairs string, mean double"), "mean")


@query("penalty_scale")
def _(spark, sf):
    out = structure.penalty_scale(corpus(spark, sf).select("vec_id", "v", "series"))
    return rounded(out, "floor_mean", "floor_std", "signal_mean", "signal_std", "ratio", "suggested_alpha")


# Preprocessing and generation


@query("whiten")
def _(spark, sf):
    """Moments of the held-out part after whitening that was fitted on the rest."""
    train, held, _ = preprocess.training_data(corpus(spark, sf), 0.2, preprocess.Settings(center=True, whiten=True, l2_normalize=False))
    x = exploded(train.withColumn("series", F.lit("train")).unionByName(held.withColumn("series", F.lit("held"))), "series")
    return rounded(x.groupBy("series", "dim").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var")), "mean", "var")


@query("generate")
def _(spark, sf):
    network = G.build("gated", trunk=G.random_layers([16, 32], 1), sizes=G.random_layers([32, 64], 2)[0], gates=G.random_layers([32, 64], 3)[0])
    rows = corpus(spark, sf).count()  # as many as the corpus has
    return panels.dim_profiles(G.generate(spark, network, rows, 16, 64).select(F.lit("generated").alias("series"), as_double(F.col("v")).alias("v")))


#: The timed queries.
HEADLINE = ["ann_summary", "ann_summary_orders", "knn_topk", "knn_cosine", "knn_large_norms", "lid_per_query", "relative_contrast", "k_occurrence", "ivf_gini", "mmd_rbf", "pairwise_hist_l1", "cov_fro", "w1_by_dim", "correlation", "distance_cdf", "dim_profiles_items", "norm_hist", "tensor_stats", "zero_probe"]
