"""Queries over cluster isolation: n-dimensional geometry and the grades that build on it."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry, grading, moments, selection, steps
from ..operators import trains as T
from ..sources import views as V
from .catalogue import F1, F3, XY, _xy, query, r6

DIMS = ["p1", "p2", "p3", "p4"]
PAIRS = list(combinations_with_replacement(DIMS, 2))
LEAST = 13  # rows of a cluster that four dimensions need here


# SQL of the same geometry: moments, LDL factors column by column, forward substitution.
def _moments_sql(source: str, keys: str) -> str:
    return f"select {keys}, count(*) as n, " + ", ".join([f"avg({x}) as mu_{x}" for x in DIMS] + [f"covar_samp({a}, {b}) as c_{a}_{b}" for a, b in PAIRS]) + f" from {source} group by {keys}"


def _factored_sql(name: str, source: str, cov="c_{0}_{1}", prefix: str = "") -> str:
    """CTEs that add the factors to ``source``, one dimension at a time; the last is called ``name``."""
    parts, before = [], source
    for j, q in enumerate(DIMS):
        d = cov.format(q, q) + "".join(f" - {prefix}l{j}{k} * {prefix}l{j}{k} * {prefix}d{k}" for k in range(j))
        parts.append(f"{name}_d{j} as (select *, {d} as {prefix}d{j} from {before})")
        lower = [f"({cov.format(q, DIMS[i])}" + "".join(f" - {prefix}l{i}{k} * {prefix}l{j}{k} * {prefix}d{k}" for k in range(j)) + f") / {prefix}d{j} as {prefix}l{i}{j}" for i in range(j + 1, 4)]
        parts.append(f"{name if j == 3 else f'{name}_l{j}'} as (select *{''.join(', ' + x for x in lower)} from {name}_d{j})")
        before = f"{name}_l{j}"
    return ", ".join(parts)


def _quadratic_sql(differences: list[str], prefix: str = "") -> str:
    solved: list[str] = []
    for i, v in enumerate(differences):
        solved.append(f"({v}" + "".join(f" - {prefix}l{i}{k} * {solved[k]}" for k in range(i)) + ")")
    return "(" + " + ".join(f"{y} * {y} / {prefix}d{i}" for i, y in enumerate(solved)) + ")"


BIG = f"big as (select * from p semi join (select tetrode, cluster_id from p group by 1, 2 having count(*) >= {LEAST}) using (tetrode, cluster_id))"
OWN = f"m as ({_moments_sql('big', 'tetrode, cluster_id')})"
DISTANCE = _quadratic_sql([f"({x} - mu_{x})" for x in DIMS])
REST = f"rest as ({_moments_sql('(select big.*, k.cluster_id as k from big join (select distinct tetrode, cluster_id from big) k on big.tetrode = k.tetrode and big.cluster_id <> k.cluster_id)', 'tetrode, k')})"


def _big(spark, sf_dir):
    """Peaks of clusters with enough rows for four dimensions."""
    rows = V.peaks(spark, sf_dir)
    rows = steps.dealt(rows, rows.count(), "tetrode", "cluster_id")  # sizes, moments and joins by cluster stay where the rows are
    sizes = rows.groupBy("tetrode", "cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST).drop("size")
    return rows.join(sizes, ["tetrode", "cluster_id"])


@query(f"with {F3}, {BIG}, {OWN}, {_factored_sql('f', 'm')} select item, round({DISTANCE}, 6) as d from big join f using (tetrode, cluster_id)")
def mahal_nd(spark, sf_dir):
    rows = _big(spark, sf_dir)
    table = geometry.factored(moments.moments(rows, ["tetrode", "cluster_id"], DIMS), DIMS)
    return rows.join(table, ["tetrode", "cluster_id"]).select("item", r6(geometry.mahalanobis(DIMS)).alias("d"))


@query("with x as (select cluster_id, list_max(w1) as a from w), m as (select cluster_id, avg(a) as m, var_samp(a) as v from x group by 1) select cluster_id, round(avg((a - m) ** 2 / v), 6) as mean_d, round(max((a - m) ** 2 / v), 6) as max_d from x join m using (cluster_id) group by 1".replace("with x", f"with {F1}, x"))
def mahal_1d(spark, sf_dir):
    rows = _xy(spark, sf_dir).select("cluster_id", "a")
    d = rows.join(rows.groupBy("cluster_id").agg(F.avg("a").alias("m"), F.var_samp("a").alias("v")), "cluster_id").withColumn("d", (F.col("a") - F.col("m")) * (F.col("a") - F.col("m")) / F.col("v"))
    return d.groupBy("cluster_id").agg(r6(F.avg("d")).alias("mean_d"), r6(F.max("d")).alias("max_d"))


@query(f"with {F3}, {BIG}, {REST}, {_factored_sql('f', 'rest')} select big.tetrode, cluster_id, round(avg(exp(-{DISTANCE} / 2) * (1 + {DISTANCE} / 2)), 6) as lratio from big join f on big.tetrode = f.tetrode and cluster_id = k group by 1, 2")
def lratio_nd(spark, sf_dir):
    rows = _big(spark, sf_dir)
    rest = geometry.rest_moments(moments.moments(rows, ["tetrode", "cluster_id"], DIMS), "tetrode", "cluster_id", DIMS)
    return geometry.lratio(rows.select("tetrode", "cluster_id", *DIMS), rest, ["tetrode", "cluster_id"], DIMS).select("tetrode", "cluster_id", r6("lratio", "lratio"))


_RENAMED = ", ".join(["cluster_id as o_cluster_id", *(f"mu_{x} as o_mu_{x}" for x in DIMS), *(f"c_{a}_{b} as o_c_{a}_{b}" for a, b in PAIRS)])
_BHAT = f"""{_factored_sql('fx', 'j', prefix='x')}, {_factored_sql('fy', 'fx', cov='o_c_{0}_{1}', prefix='y')}, {_factored_sql('fz', 'fy', cov='((c_{0}_{1} + o_c_{0}_{1}) / 2)', prefix='z')},
  bh as (select *, {_quadratic_sql([f'(mu_{x} - o_mu_{x})' for x in DIMS], 'z')} / 8 + ln(zd0 * zd1 * zd2 * zd3 / sqrt(xd0 * xd1 * xd2 * xd3 * yd0 * yd1 * yd2 * yd3)) / 2 as bhat from fz)"""


@query(f"with {F3}, {BIG}, {OWN}, o as (select tetrode, {_RENAMED} from m), j as (select * from m join o using (tetrode) where cluster_id < o_cluster_id), {_BHAT} select tetrode, cluster_id as a, o_cluster_id as b, round(bhat, 6) as bhat from bh")
def bhat_nd(spark, sf_dir):
    table = moments.moments(_big(spark, sf_dir), ["tetrode", "cluster_id"], DIMS)
    pairs = table.join(geometry.named_other(table, ["tetrode"]), "tetrode").where("cluster_id < o_cluster_id")
    return geometry.bhattacharyya(pairs, DIMS).select("tetrode", F.col("cluster_id").alias("a"), F.col("o_cluster_id").alias("b"), r6("bhat", "bhat"))


# The largest label stands for the rows that no cluster has.
@query(f"""with {F3}, {BIG}, {OWN}, o as (select tetrode, {_RENAMED} from m where cluster_id = 'NO'), j as (select * from m join o using (tetrode) where cluster_id <> 'NO'), {_BHAT},
  u as (select * from m where cluster_id = 'NO'), {_factored_sql('f', 'u')},
  l as (select big.tetrode, big.cluster_id, avg(exp(-{DISTANCE} / 2) * (1 + {DISTANCE} / 2)) as lratio from big join f using (tetrode) where big.cluster_id <> 'NO' group by 1, 2)
  select tetrode, cluster_id, round(bhat, 6) as bhat_unsorted, round(lratio, 6) as lratio_unsorted from bh join l using (tetrode, cluster_id)""")
def unsorted_grades(spark, sf_dir):
    rows = _big(spark, sf_dir)
    table = moments.moments(rows, ["tetrode", "cluster_id"], DIMS)
    rest = table.where("cluster_id = 'NO'")
    pairs = table.where("cluster_id <> 'NO'").join(geometry.named_other(rest, ["tetrode"]), "tetrode")
    bhat = geometry.bhattacharyya(pairs, DIMS).select("tetrode", "cluster_id", r6("bhat", "bhat_unsorted"))
    reference = table.where("cluster_id <> 'NO'").select("tetrode", "cluster_id").join(rest.drop("cluster_id"), "tetrode")
    lratio = geometry.lratio(rows.where("cluster_id <> 'NO'").select("tetrode", "cluster_id", *DIMS), reference, ["tetrode", "cluster_id"], DIMS)
    return bhat.join(lratio, ["tetrode", "cluster_id"]).select("tetrode", "cluster_id", "bhat_unsorted", r6("lratio", "lratio_unsorted"))


@query(f"""with {F3}, {BIG}, {OWN}, {_factored_sql('f', 'm')},
  own as (select tetrode, cluster_id, count(*) as size, median({DISTANCE}) + 5 * stddev_samp({DISTANCE}) as limit_ from big join f using (tetrode, cluster_id) group by 1, 2),
  near as (select big.* exclude (cluster_id), f.cluster_id from big join f on big.tetrode = f.tetrode and big.cluster_id = 'NO' and f.cluster_id <> 'NO' join own on own.tetrode = f.tetrode and own.cluster_id = f.cluster_id where {DISTANCE} < limit_),
  nm as ({_moments_sql('near', 'tetrode, cluster_id')}), o as (select tetrode, {_RENAMED}, n as near_n from nm), j as (select * from m join o on m.tetrode = o.tetrode and m.cluster_id = o.o_cluster_id where n > 4 and near_n > 4), {_BHAT.replace('select *, ', 'select *, ')}
  select own.tetrode, own.cluster_id, coalesce(nm.n, 0) as n_near, case when coalesce(nm.n, 0) > 0.2 * size then round(bhat, 6) else 'infinity'::double end as bhat_near
  from own left join nm using (tetrode, cluster_id) left join bh on bh.tetrode = own.tetrode and bh.cluster_id = own.cluster_id where own.cluster_id <> 'NO'""")
def nearby_unsorted(spark, sf_dir):
    # written once: rows, fits and distances are each read several times below
    rows, key = steps.written(_big(spark, sf_dir), "big"), ["tetrode", "cluster_id"]
    table = steps.written(moments.moments(rows, key, DIMS), "moments")
    fit = geometry.factored(table, DIMS)
    far = steps.written(rows.where("cluster_id <> 'NO'").join(fit, key).withColumn("d", geometry.mahalanobis(DIMS)).select(*key, "d"), "distances")
    own = steps.written(far.groupBy(*key).agg(F.count("*").alias("size")).join(selection.limits(far, key, "d", 5.0), key), "own")
    loose = rows.where("cluster_id = 'NO'").drop("cluster_id")
    near = loose.join(fit.join(own, key), "tetrode").where(geometry.mahalanobis(DIMS) < F.col("limit")).select(*key, *DIMS)
    found = moments.moments(near, key, DIMS)
    pairs = table.join(geometry.named_other(found, key), key).where("n > 4 and o_n > 4")
    bhat = geometry.bhattacharyya(pairs, DIMS).select(*key, "bhat")
    out = own.join(found.select(*key, F.col("n").alias("m")), key, "left").join(bhat, key, "left").withColumn("n_near", F.coalesce("m", F.lit(0).cast("long")))
    return out.select(*key, "n_near", F.when(F.col("n_near") > 0.2 * F.col("size"), F.round("bhat", 6)).otherwise(float("inf")).alias("bhat_near"))


_Z = "sqrt(({0} - mu_{0}) ** 2 / c_{0}_{0} / 2)"
# the two-sided normal tail from the series of the incomplete gamma function
_E = "case when z = 0 then 1.0 when z > 6 then 0.0 else 1 - list_sum(list_transform(range(0, 150), lambda n: exp(-z * z + (2 * n + 1) * ln(z) - lgamma(n + 1.5)))) end"
RATES = f"""z as (select big.tetrode, cluster_id, unnest([{', '.join(f"{{'dim': '{x}', 'z': {_Z.format(x)}}}" for x in DIMS)}], recursive := true) from big join rest on big.tetrode = rest.tetrode and cluster_id = k),
  rates as (select tetrode, cluster_id, dim, avg({_E}) as rate from z group by all)"""


@query(f"with {F3}, {BIG}, {REST}, {RATES} select tetrode, cluster_id, dim, round(rate, 6) as rate from rates")
def rate_clusters(spark, sf_dir):
    return geometry.rates_1d(_big(spark, sf_dir), "tetrode", "cluster_id", DIMS).select("tetrode", "cluster_id", "dim", r6("rate", "rate"))


@query(f"""with {F3}, {BIG}, {REST}, {RATES}, u as (select tetrode, cluster_id, unnest([{', '.join(f"{{'dim': '{x}', 'usable': count(distinct {x}) >= 0.05 * count(*)}}" for x in DIMS)}], recursive := true) from big group by 1, 2),
  v as (select tetrode, cluster_id, item, unnest([{', '.join(f"{{'dim': '{x}', 'v': {x}}}" for x in DIMS)}], recursive := true) from big)
  select item, dim, round(v * (1 - rate), 6) as scaled from v join rates using (tetrode, cluster_id, dim) join u using (tetrode, cluster_id, dim) where usable and rate < 1""")
def transform_features(spark, sf_dir):
    rows, key = _big(spark, sf_dir), ["tetrode", "cluster_id"]
    # a row a cluster meets the rows, which only then become one for each dimension
    by_dim = lambda table, c, name: table.groupBy(*key).agg(*(F.max(F.when(F.col("dim") == x, F.col(c))).alias(f"{name}_{x}") for x in DIMS))
    rates = by_dim(geometry.rates_1d(rows, *key, DIMS), "rate", "rate")
    long = rows.select(*key, F.inline(F.array(*(F.struct(F.lit(x).alias("dim"), F.col(x).alias("v")) for x in DIMS))))
    values = long.groupBy(*key, "dim", "v").agg(F.count("*").alias("n")).groupBy(*key, "dim").agg((F.count("*") >= 0.05 * F.sum("n")).alias("usable"))
    near = rows.join(rates.join(by_dim(values, "usable", "usable"), key), key)
    parts = near.select("item", F.inline(F.array(*(F.struct(F.lit(x).alias("dim"), F.col(x).alias("v"), F.col(f"rate_{x}").alias("rate"), F.col(f"usable_{x}").alias("usable")) for x in DIMS))))
    return parts.where("usable and rate < 1").select("item", "dim", r6(F.col("v") * (1 - F.col("rate"))).alias("scaled"))


# Spans of 200, 300 and 200: cells of 10 in windows of 9, 13 and 9.
DENSE = {"x": "p1 * 4", "y": "p2 * 3", "z": "p3 * 20"}


@query(f"""with {F3}, q as (select item, {', '.join(f'{v} as {k}' for k, v in DENSE.items())} from p),
  s as (select {', '.join(f"min({k}) as lo_{k}, max({k}) - min({k}) as r_{k}, round((max({k}) - min({k})) / 10) as n_{k}, ceil(stddev_samp({k}) / 7)::bigint as w_{k}" for k in DENSE)} from q),
  b as (select item, {', '.join(f'floor(({k} - lo_{k}) / (r_{k} / n_{k}))::bigint as b_{k}' for k in DENSE)} from q, s),
  c as (select b_x, b_y, b_z, count(*) as n, 1 as m from b group by all),
  cx as (select unnest(range(b_x - w_x // 2, b_x + w_x - w_x // 2)) as b_x, b_y, b_z, n, m from c, s), sx as (select b_x, b_y, b_z, sum(n) as n, sum(m) as m from cx group by 1, 2, 3),
  cy as (select b_x, unnest(range(b_y - w_y // 2, b_y + w_y - w_y // 2)) as b_y, b_z, n, m from sx, s), sy as (select b_x, b_y, b_z, sum(n) as n, sum(m) as m from cy group by 1, 2, 3),
  cz as (select b_x, b_y, unnest(range(b_z - w_z // 2, b_z + w_z - w_z // 2)) as b_z, n, m from sy, s), sz as (select b_x, b_y, b_z, sum(n) as n, sum(m) as m from cz group by 1, 2, 3)
  select item from b join c using (b_x, b_y, b_z) join (select b_x, b_y, b_z, n / m as mean from sz) using (b_x, b_y, b_z) where (n > 1 or mean > 1) and n > 1.25 * mean""")
def density_filter(spark, sf_dir):
    rows = V.peaks(spark, sf_dir).select("item", *(F.expr(v).alias(k) for k, v in DENSE.items()))
    return geometry.density(rows, list(DENSE)).select("item")


# -- grades of the two-wire clusters, labels 8 and 9 standing for unsorted rows ------------------------

MEAN = "mean as (select cluster_id, wire, list(v order by pos) as mw from (select cluster_id, wire, pos, avg(v) as v from (select cluster_id, wire, unnest(range(0, 32)) as pos, unnest(wf) as v from ww) group by all) group by 1, 2)"
COMPARE = "cw as (select cluster_id, arg_min(wire, (-n, wire)) as wire from (select cluster_id, case when list_max(w1) >= list_max(w2) then 1 else 2 end as wire, count(*) as n from w group by 1, 2) group by 1)"


def _compare_wire(spark, sf_dir):
    rows = _xy(spark, sf_dir)
    return rows.groupBy("cluster_id").agg(F.mode(F.when(F.col("a") >= F.col("b"), 1).otherwise(2), True).alias("wire"))


@query(f"with {F1}, {COMPARE} select cluster_id, wire from cw")
def compare_wire(spark, sf_dir):
    return _compare_wire(spark, sf_dir)


HALF = """h as (select *, list_max(mw) as top, list_position(mw, list_max(mw)) as place from mean),
  h1 as (select *, coalesce(list_max(list_filter(range(2, 32), lambda i: mw[i] < mw[i - 1] and mw[i] <= mw[i + 1] and i < place)), 1) as low from h),
  h2 as (select *, coalesce(list_min(list_filter(range(1, 33), lambda i: i > low and mw[i] < mw[low])) - 1, 32) as high from h1)"""


def _half_sql(percent: float) -> str:
    return f"greatest(low, coalesce(list_max(list_filter(range(1, 33), lambda i: i < place and mw[i] < top * {percent})) + 1, 1)) as s{int(percent * 100)}, least(high, coalesce(list_min(list_filter(range(1, 33), lambda i: i > place and mw[i] < top * {percent})) - 1, 32)) as e{int(percent * 100)}"


def _mean_waves(spark, sf_dir):
    long = V.wires(V.waveforms(spark, sf_dir)).select("cluster_id", "wire", F.posexplode("wf").alias("pos", "v"))
    at = long.groupBy("cluster_id", "wire", "pos").agg(F.avg("v").alias("v")).groupBy("cluster_id", "wire").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
    return at.select("cluster_id", "wire", F.transform("m", lambda x: x["v"]).alias("mw"))


@query(f"with {F1}, {MEAN}, {HALF} select cluster_id, wire, {', '.join(_half_sql(p) for p in (0.5, 0.33, 0.25))} from h2 where top > 0")
def half_peak_range(spark, sf_dir):
    waves = _mean_waves(spark, sf_dir).where(F.array_max("mw") > 0)
    for p in (0.5, 0.33, 0.25):
        waves = waves.withColumn("h", grading.half_peak_range("mw", p)).withColumns({f"s{int(p * 100)}": F.col("h.start") + 1, f"e{int(p * 100)}": F.col("h.end") + 1})
    return waves.select("cluster_id", "wire", *(F.col(f"{k}{n}").cast("long").alias(f"{k}{n}") for n in (50, 33, 25) for k in "se"))


def _new_cv_sql(percent: float) -> str:
    return f"""r{int(percent * 100)} as (select cluster_id, wire, {_half_sql(percent).replace(f' as s{int(percent * 100)}', ' as s').replace(f' as e{int(percent * 100)}', ' as e')}, mw from h2 join cw using (cluster_id, wire) where top > 0),
  p{int(percent * 100)} as (select ww.spike_id, cluster_id, wf[s:e] as v, mw[s:e] as m from ww join r{int(percent * 100)} using (cluster_id, wire)),
  q{int(percent * 100)} as (select cluster_id, list_transform(v, lambda x: x - list_avg(v)) as v, list_transform(m, lambda x: x - list_avg(m)) as m from p{int(percent * 100)}),
  sh{int(percent * 100)} as (select cluster_id, avg((list_dot_product(v, m) ** 2 / nullif(list_dot_product(m, m) * list_dot_product(v, v), 0) < 0.7)::int) as low_share from q{int(percent * 100)} group by 1),
  c{int(percent * 100)} as (select cluster_id, max(cv) as cv from (select cluster_id, pos, stddev_samp(x) / nullif(avg(x), 0) as cv from (select cluster_id, generate_subscripts(v, 1) as pos, unnest(v) as x from p{int(percent * 100)}) group by 1, 2) group by 1)"""


@query(f"with {F1}, {MEAN}, {COMPARE}, {HALF}, {_new_cv_sql(0.5)}, {_new_cv_sql(0.33)}, {_new_cv_sql(0.25)} " + " union all ".join(f"select cluster_id, {n} as percent, round(cv, 6) as cv, round(low_share, 6) as low_share from c{n} join sh{n} using (cluster_id)" for n in (50, 33, 25)))
def half_peak_cv(spark, sf_dir):
    rows = V.wires(V.waveforms(spark, sf_dir)).join(_compare_wire(spark, sf_dir), ["cluster_id", "wire"])
    waves = _mean_waves(spark, sf_dir).where(F.array_max("mw") > 0)
    parts = []
    for p in (0.5, 0.33, 0.25):
        limits = waves.withColumn("h", grading.half_peak_range("mw", p)).select("cluster_id", "wire", "mw", "h.*")
        got = grading.half_peak_spread(rows.join(limits, ["cluster_id", "wire"]), "cluster_id", "wf", "mw", "start", "end")
        parts.append(got.select("cluster_id", F.lit(int(p * 100)).alias("percent"), r6("cv", "cv"), r6("low_share", "low_share")))
    return parts[0].union(parts[1]).union(parts[2])


def _quoted(x: float) -> str:
    return f"{x!r}::double"


GRADED = f"""x8 as (select * from x where cluster_id < 8), loose as (select * from x where cluster_id >= 8), lim as (select 200.0::double as thr),
  mo as (select cluster_id, count(*) as n, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from x8 group by 1),
  ml as (select avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from loose),
  isi as (select cluster_id, (ts_us - lag(ts_us) over (partition by cluster_id order by ts_us, spike_id)) / 1e6 as isi from x8),
  si as (select cluster_id, avg((isi < 600)::int) as short_isi from isi group by 1),
  whole as (select max(ts_us) - min(ts_us) as span from x),
  tm as (select cluster_id, count(*) * 1e6 / any_value(span) as rate, 2 * stddev_samp(ts_us) / any_value(span) as share from x8, whole group by 1),
  cwx as (select cluster_id, case wire when 1 then a else b end as v from x8 join cw using (cluster_id)),
  io as (select cluster_id, (avg(v) - any_value(thr)) ** 2 / var_samp(v) as iso from cwx, lim group by 1),
  ed as (select cluster_id, min(v) as lo, max(v) as hi from cwx group by 1),
  bn as (select cluster_id, least(20, floor((v - lo) / ((hi - lo) / 21))) as bin, count(*) as n, any_value(lo) as lo, any_value((hi - lo) / 21) as d from cwx join ed using (cluster_id) group by 1, 2),
  md as (select cluster_id, arg_min(bin, (-n, bin)) as modal from bn group by 1),
  bl as (select cluster_id, (sum(case when bin > modal and lo + (2 * modal - bin + 0.5) * d < thr then n else 0 end) + sum(case when lo + (bin + 0.5) * d < thr then n else 0 end)) / sum(case when bin > modal then 2 * n else n end) as below from bn join md using (cluster_id), lim where bin >= modal group by 1),
  bp as (select x.cluster_id as k, y.cluster_id as o, ((x.bb + y.bb) / 2 * (x.ma - y.ma) ** 2 - (x.ab + y.ab) * (x.ma - y.ma) * (x.mb - y.mb) + (x.aa + y.aa) / 2 * (x.mb - y.mb) ** 2) / ((x.aa + y.aa) / 2 * (x.bb + y.bb) / 2 - ((x.ab + y.ab) / 2) ** 2) / 8
    + ln(((x.aa + y.aa) / 2 * (x.bb + y.bb) / 2 - ((x.ab + y.ab) / 2) ** 2) / sqrt((x.aa * x.bb - x.ab ** 2) * (y.aa * y.bb - y.ab ** 2))) / 2 as bhat from mo x join (select cluster_id, ma, mb, aa, ab, bb from mo union all select -1, * from ml) y on x.cluster_id <> y.cluster_id),
  bm as (select k as cluster_id, min(case when o >= 0 then bhat end) as min_bhat, min(case when o = -1 then bhat end) as bhat_unsorted from bp group by 1),
  ot as (select k.cluster_id as k, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from x, (select distinct cluster_id from x8) k where x.cluster_id <> k.cluster_id group by 1),
  lr as (select cluster_id, avg(exp(-((bb * (a - ma) ** 2 - 2 * ab * (a - ma) * (b - mb) + aa * (b - mb) ** 2) / (aa * bb - ab * ab)) / 2)) as lratio from x8 join ot on cluster_id = k group by 1),
  cvs as (select cluster_id, case when avg(a) >= avg(b) then stddev_samp(a) / avg(a) else stddev_samp(b) / avg(b) end as cv from x8 group by 1),
  wr as (select cluster_id, (count(distinct a) >= 0.5 * count(*))::int + (count(distinct b) >= 0.5 * count(*))::int as wires from x8 group by 1),
  vw as (select cluster_id, mw, list_filter(range(2, 32), lambda i: mw[i] > mw[i - 1] and mw[i] >= mw[i + 1]) as pk, list_filter(range(2, 32), lambda i: mw[i] < mw[i - 1] and mw[i] <= mw[i + 1]) as vl from mean join cw using (cluster_id, wire)),
  va as (select cluster_id, coalesce(list_max(vl) > list_reduce(pk, lambda p, q: case when mw[q] > mw[p] then q else p end), false) as valley from vw where len(pk) > 0 union all select cluster_id, false from vw where len(pk) = 0),
  g as (select cluster_id, n, lratio, cv, short_isi, below, iso, min_bhat, bhat_unsorted, rate, share, wires, valley from mo join lr using (cluster_id) join cvs using (cluster_id) join si using (cluster_id) join bl using (cluster_id) join io using (cluster_id) join bm using (cluster_id) join tm using (cluster_id) join wr using (cluster_id) join va using (cluster_id))"""


def _graded(spark, sf_dir):
    """Grades of clusters 0 to 7 from their rows; labels 8 and 9 stand for unsorted rows, 200 for the threshold of both wires."""
    rows = _xy(spark, sf_dir)
    own, loose, limit = rows.where("cluster_id < 8"), rows.where("cluster_id >= 8"), 200.0
    table = moments.moments(own, ["cluster_id"], ["a", "b"])
    rest = moments.moments(loose.withColumn("cluster_id", F.lit(-1)), ["cluster_id"], ["a", "b"])
    pairs = table.crossJoin(geometry.named_other(table.unionByName(rest), [])).where("cluster_id <> o_cluster_id")  # a row a pair of clusters
    pairs = geometry.bhattacharyya(pairs, ["a", "b"])
    bhat = pairs.groupBy("cluster_id").agg(F.min(F.when(F.col("o_cluster_id") >= 0, F.col("bhat"))).alias("min_bhat"), F.min(F.when(F.col("o_cluster_id") == -1, F.col("bhat"))).alias("bhat_unsorted"))
    everything = moments.moments(rows, ["cluster_id"], ["a", "b"]).withColumn("all", F.lit(1))
    lratio = geometry.lratio(own.withColumn("all", F.lit(1)), geometry.rest_moments(everything, "all", "cluster_id", ["a", "b"]), ["all", "cluster_id"], ["a", "b"]).drop("all")
    short = T.intervals(own, "cluster_id", "ts_us", "spike_id").groupBy("cluster_id").agg(F.avg((F.col("isi") < 600).cast("int")).alias("short_isi"))
    span = rows.agg((F.max("ts_us") - F.min("ts_us")).alias("span"))
    cv = lambda x: F.stddev(x) / F.avg(x)
    times = own.groupBy("cluster_id").agg(F.count("*").alias("n"), F.stddev("ts_us").alias("std"), F.when(F.avg("a") >= F.avg("b"), cv("a")).otherwise(cv("b")).alias("cv"), *((F.countDistinct(x) >= 0.5 * F.count("*")).cast("int").alias(f"use_{x}") for x in "ab"))
    times = times.crossJoin(span).select("cluster_id", "n", "cv", (F.col("n") * 1e6 / F.col("span")).alias("rate"), (2 * F.col("std") / F.col("span")).alias("share"), (F.col("use_a") + F.col("use_b")).alias("wires"))
    wire = _compare_wire(spark, sf_dir)
    peaks = own.join(wire, "cluster_id").select("cluster_id", F.when(F.col("wire") == 1, F.col("a")).otherwise(F.col("b")).alias("v"))
    iso = peaks.groupBy("cluster_id").agg(((F.avg("v") - limit) * (F.avg("v") - limit) / F.var_samp("v")).alias("iso"))
    below = grading.incompleteness(peaks, "cluster_id", "v", F.lit(limit))
    valley = _mean_waves(spark, sf_dir).join(wire, ["cluster_id", "wire"]).select("cluster_id", grading.valley_after_peak("mw").alias("valley"))
    out = times
    for part in (lratio, short, below, iso, bhat, valley):
        out = out.join(part, "cluster_id")
    return out


_GRADE_COLUMNS = ["lratio", "cv", "short_isi", "below", "iso", "min_bhat", "bhat_unsorted", "rate", "share"]


@query(f"with {F1}, {XY}, {MEAN}, {COMPARE}, {GRADED} select cluster_id, n, {', '.join(f'round({c}, 6) as {c}' for c in _GRADE_COLUMNS)}, wires, valley from g")
def cluster_grades(spark, sf_dir):
    return _graded(spark, sf_dir).select("cluster_id", "n", *(r6(c, c) for c in _GRADE_COLUMNS), "wires", "valley")


# Grades that need more than two wires, a spline or a fit are missing here (NaN, infinity): their rules don't fire.
FINAL = """f as (select *, case when share < 0.25 then -2 when below > 0.35 and iso < 1 then -4 when wires <= 1 then -5 when short_isi > 0.05 then -7 when rate > 50 then -8 when lratio > 0.3 and iso < 5 then -9 when not valley then -10
  when below > 0.25 and iso < 1 then 1 when ((min_bhat > 4 and bhat_unsorted > 2) or lratio < 0.05) and below < 0.1 then 5 when lratio < 0.1 then case when bhat_unsorted > 1 and min_bhat > 2 and short_isi < 0.05 and below < 0.1 then 4 else 3 end else 2 end as final_grade from g)"""


def _final(spark, sf_dir):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    graded = _graded(spark, sf_dir).withColumns({"snr": nan, "mpc": nan, "width": nan, "bhat_mua": nan, "bhat_near": inf})
    return grading.final_grades(graded, few_wires=1)


@query(f"with {F1}, {XY}, {MEAN}, {COMPARE}, {GRADED}, {FINAL} select cluster_id, final_grade, case when final_grade = -9 then 0.8 when final_grade in (3, 4) and below > 0.15 then 0.5 else 1.0 end::double as confidence from f")
def final_grades(spark, sf_dir):
    return _final(spark, sf_dir).select("cluster_id", "final_grade", "confidence")


@query(f"with {F1}, {XY}, {MEAN}, {COMPARE}, {GRADED}, {FINAL} select final_grade, count(*) as clusters, count(*) filter (where min_bhat < 0.75) as found, round(count(*) filter (where min_bhat < 0.75) / count(*), 6) as ratio from f where n >= 20 or final_grade <= 2 group by final_grade")
def find_ratio(spark, sf_dir):
    return grading.find_ratio(_final(spark, sf_dir), least=20).select("final_grade", "clusters", "found", r6("ratio", "ratio"))


_MANUAL = "mm as (select cluster_id, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from x group by 1), au as (select (case when a >= b then 0 else 2 end + case when a + b >= 600 then 1 else 0 end) as cluster_id, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from x group by 1 having count(*) > 2)"


@query(f"""with {F1}, {XY}, {_MANUAL}, q as (select x.cluster_id as manual, y.cluster_id as auto, ((x.bb + y.bb) / 2 * (x.ma - y.ma) ** 2 - (x.ab + y.ab) * (x.ma - y.ma) * (x.mb - y.mb) + (x.aa + y.aa) / 2 * (x.mb - y.mb) ** 2) / ((x.aa + y.aa) / 2 * (x.bb + y.bb) / 2 - ((x.ab + y.ab) / 2) ** 2) / 8
    + ln(((x.aa + y.aa) / 2 * (x.bb + y.bb) / 2 - ((x.ab + y.ab) / 2) ** 2) / sqrt((x.aa * x.bb - x.ab ** 2) * (y.aa * y.bb - y.ab ** 2))) / 2 as bhat from mm x, au y)
  select manual, auto, round(bhat, 6) as bhat, min(bhat) over (partition by manual) < 1 as found from q""")
def manual_compare(spark, sf_dir):
    rows = _xy(spark, sf_dir)
    auto = rows.withColumn("cluster_id", F.when(F.col("a") >= F.col("b"), 0).otherwise(2) + F.when(F.col("a") + F.col("b") >= 600, 1).otherwise(0))
    left, right = (moments.moments(x, ["cluster_id"], ["a", "b"]) for x in (rows, auto))
    pairs = left.crossJoin(geometry.named_other(right.where("n > 2"), []))  # a row a pair of clusters
    return geometry.bhattacharyya(pairs, ["a", "b"]).select(F.col("cluster_id").alias("manual"), F.col("o_cluster_id").alias("auto"), r6("bhat", "bhat"), (F.min("bhat").over(Window.partitionBy("cluster_id")) < 1).alias("found"))
