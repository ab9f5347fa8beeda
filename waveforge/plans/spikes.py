"""Queries over snippets of several spikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import moments, overlaps, shapes, splitting
from ..sources import views as V
from .catalogue import F1, F3, MAHAL, MOM, XY, query, r6

THRESHOLD = 100.0  # stands for the wires' own


def _listed(wave: str, k: int) -> str:
    return f"""list_filter(range(2, 32), lambda i: {wave}[i] > {wave}[i - 1] and {wave}[i] >= {wave}[i + 1]) as pk{k}, list_filter(range(2, 32), lambda i: {wave}[i] < {wave}[i - 1] and {wave}[i] <= {wave}[i + 1]) as vl{k}"""


SPLIT = f"""pv as (select spike_id, ts_us, cluster_id, w1, w2, {_listed("w1", 1)}, {_listed("w2", 2)} from w),
  hi as (select *, list_filter(pk1, lambda p: w1[p] >= 0.99 * {THRESHOLD}) as h1, list_filter(pk2, lambda p: w2[p] >= 0.99 * {THRESHOLD}) as h2 from pv),
  sp as (select *, list_filter(h1, lambda p: w1[p] >= w2[p] and len(list_filter(vl1, lambda v: v > p and v < coalesce(list_min(list_filter(h1, lambda q: q > p)), 32) and w1[v] < {THRESHOLD} / 2)) > 0) as s1,
    list_filter(h2, lambda p: w2[p] > w1[p] and len(list_filter(vl2, lambda v: v > p and v < coalesce(list_min(list_filter(h2, lambda q: q > p)), 32) and w2[v] < {THRESHOLD} / 2)) > 0) as s2 from hi),
  cp as (select *, list_filter(s1, lambda p: len(list_filter(s2, lambda q: abs(p - q) <= 8 and w1[p] <= w2[q])) = 0) as c1, list_filter(s2, lambda q: len(list_filter(s1, lambda p: abs(p - q) <= 8 and w1[p] > w2[q])) = 0) as c2 from sp),
  ev as (select *, list_concat(c1, c2) as every from cp),
  pt as (select *, 1 as wire, unnest(c1) as p, w1 as own, pk1 as pk, vl1 as vl from ev union all select *, 2, unnest(c2), w2, pk2, vl2 from ev),
  ne as (select *, list_max(list_filter(every, lambda q: q < p)) as prev, list_min(list_filter(every, lambda q: q > p)) as next from pt),
  en as (select *, case when prev is null then coalesce(list_max(list_filter(pk, lambda q: q < p)), 1) else list_max(list_filter(vl, lambda v: v > prev and v < p)) end as lo0,
    case when next is null then coalesce(list_min(list_filter(pk, lambda q: q > p)), 32) else list_max(list_filter(vl, lambda v: v > p and v < next)) end as up0 from ne),
  od as (select *, coalesce(bool_or(lo0 is null or up0 is null) over (partition by spike_id order by wire, p), false) as spoiled from en),
  sh as (select *, case when w1[lo0] <= w1[p] and w2[lo0] <= w2[p] then lo0 else list_min(list_filter(range(lo0 + 1, p), lambda i: w1[i] <= w1[p] and w2[i] <= w2[p])) end as lo,
    case when w1[up0] <= w1[p] and w2[up0] <= w2[p] then up0 else list_max(list_filter(range(p + 1, up0), lambda i: w1[i] <= w1[p] and w2[i] <= w2[p])) end as up from od where not spoiled),
  parts as (select spike_id, cluster_id, row_number() over (partition by spike_id order by wire, p) as part, wire, p, lo, up, ts_us::double + (lo - 1)::double * 1000.0::double / 32::double as ts, w1[lo:up] as v1, w2[lo:up] as v2, (32 - (up - lo + 1)) // 2 as start from sh where lo is not null and up is not null)"""


def _parts(spark, sf_dir):
    return splitting.split(V.waveforms(spark, sf_dir), ["w1", "w2"], [THRESHOLD, THRESHOLD])


def _weighed(wave: str):
    """The samples times their places from 1, summed: tells a moved or a changed wave."""
    return F.aggregate(F.transform(wave, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query(f"""with {F1}, {SPLIT} select spike_id, part, wire as part_wire, p - 1 as part_at, lo - 1 as lower, up - 1 as upper, floor(ts)::bigint as ts_us,
  round(list_sum(list_transform(v1, lambda x, i: x * (i + start))), 6) as m1, round(list_sum(list_transform(v2, lambda x, i: x * (i + start))), 6) as m2 from parts""")
def split_spikes(spark, sf_dir):
    return _parts(spark, sf_dir).select("spike_id", "part", "part_wire", "part_at", "lower", "upper", F.floor("ts_us").alias("ts_us"), r6(_weighed("w1"), "m1"), r6(_weighed("w2"), "m2"))


@query(f"""with {F1}, {XY}, {MOM}, {SPLIT}, lm as (select cluster_id, median(d) + 2.5 * stddev_samp(d) as limit_ from (select cluster_id, {MAHAL} as d from x join m using (cluster_id)) group by 1),
  np as (select spike_id, part, greatest(list_max(v1), case when len(v1) < 32 then 0 else list_max(v1) end) as a, greatest(list_max(v2), case when len(v2) < 32 then 0 else list_max(v2) end) as b from parts),
  nd as (select spike_id, part, m.cluster_id, {MAHAL} as d from np cross join m)
  select spike_id, part, coalesce(max(case when d < limit_ then nd.cluster_id end), 0)::int as cluster_id from nd join lm using (cluster_id) group by 1, 2""")
def classify_split(spark, sf_dir):
    """The split spikes, in the clusters of the others."""
    peaks = [F.array_max("w1").alias("a"), F.array_max("w2").alias("b")]
    members = V.waveforms(spark, sf_dir).select(F.lit(0).alias("recording"), "cluster_id", *peaks)
    new = _parts(spark, sf_dir).select(F.lit(0).alias("recording"), "spike_id", "part", *peaks)
    return shapes.classified(members, new, "cluster_id", ["spike_id", "part"], ["a", "b"], n_std=2.5, by=["recording"]).select("spike_id", "part", "cluster_id")


# -- overlaps ----------------------------------------------------------------------------------------

# Besides its own, an item is in each cluster to whose distribution it is nearer than .5; the first cluster of each third recording takes in nearly all.
NEAR = "0.5 + case when tetrode % 3 = 0 and {0} = 'A' then 5.5 else 0.0 end"


def _tail(value: str) -> str:
    """P(chi-squared with one degree of freedom > value) by the series of the incomplete gamma function."""
    return f"case when {value} = 0 then 1.0 when {value} > 72 then 0.0 else 1 - list_sum(list_transform(range(0, 150), lambda n: exp(-{value} / 2 + (n + 0.5) * ln({value} / 2) - lgamma(n + 1.5)))) end"


def _settle_sql(step: int, before: str, k: str, m: str) -> str:
    """CTEs that settle clusters ``k`` and ``m`` of all recordings; the last is ``m<step>``."""
    own = {"a": "ia and not ib", "b": "ib and not ia"}
    stats = ", ".join(f"count_if({w}) as n{s}, avg(p1) filter ({w}) as {s}1, avg(p2) filter ({w}) as {s}2, covar_samp(p1, p1) filter ({w}) as {s}11, covar_samp(p1, p2) filter ({w}) as {s}12, covar_samp(p2, p2) filter ({w}) as {s}22, count(distinct p1) filter ({w}) as {s}d1, count(distinct p2) filter ({w}) as {s}d2" for s, w in own.items())
    use = [f"(na = 0 or ad{d} >= 0.05 * na) and (nb = 0 or bd{d} >= 0.05 * nb)" for d in (1, 2)]
    rates = ", ".join(f"1 - avg({_tail(f'(pow(p{d} - {s}{d}, 2) / nullif({s}{d}{d}, 0))')}) as {s}k{d}" for s in "ab" for d in (1, 2))
    scaled = ", ".join(f"{s}k1 * {s}1 as {s}m1, {s}k2 * {s}2 as {s}m2, case when u1 then {s}k1 * {s}k1 * {s}11 else 1 end as {s}v11, case when u1 and u2 then {s}k1 * {s}k2 * {s}12 else 0 end as {s}v12, case when u2 then {s}k2 * {s}k2 * {s}22 else 1 end as {s}v22" for s in "ab")
    away = {s: (f"case when u1 then p1 - {s}m1 else 0 end", f"case when u2 then p2 - {s}m2 else 0 end") for s in "ab"}
    apart = ", ".join(f"({s}v22 * pow({x}, 2) - 2 * {s}v12 * ({x}) * ({y}) + {s}v11 * pow({y}, 2)) / nullif({s}v11 * {s}v22 - {s}v12 * {s}v12, 0) as d{s}" for s, (x, y) in away.items())
    t = f"_{step}"
    return f"""h{t} as materialized (select tetrode, item, any_value(p1) as p1, any_value(p2) as p2, bool_or(c = '{k}') as ia, bool_or(c = '{m}') as ib from {before} where c in ('{k}', '{m}') group by 1, 2),
  s{t} as materialized (select *, {use[0]} as u1, {use[1]} as u2 from (select tetrode, count_if(ia) as alla, count_if(ib) as allb, count_if(ia and ib) as nx, {stats} from h{t} group by 1) where nx > 0),
  r{t} as materialized (select tetrode, {rates} from h{t} join s{t} using (tetrode) where ia and ib group by 1),
  f{t} as materialized (select *, {scaled} from s{t} join r{t} using (tetrode)),
  n{t} as materialized (select tetrode, item, p1, p2, coalesce(ok and da < db, false) as ka, coalesce(ok and db < da, false) as kb from (select tetrode, item, p1, p2, na >= u1::int + u2::int and nb >= u1::int + u2::int as ok, {apart} from h{t} join f{t} using (tetrode) where ia and ib)),
  w{t} as materialized (select tetrode, case when any_value(nx) <= 0.65 * any_value(least(alla, allb)) then 'part' when count_if(ka) > count_if(kb) then '{k}' else '{m}' end as win from n{t} join f{t} using (tetrode) group by 1),
  m{step} as materialized (select tetrode, c, item, p1, p2 from {before} where c not in ('{k}', '{m}') or tetrode not in (select tetrode from w{t})
    union all select h.tetrode, win, item, p1, p2 from h{t} h join w{t} using (tetrode) where win <> 'part'
    union all select h.tetrode, case when ia then '{k}' else '{m}' end, item, p1, p2 from h{t} h join w{t} using (tetrode) where win = 'part' and not (ia and ib)
    union all select tetrode, case when ka then '{k}' else '{m}' end, item, p1, p2 from n{t} join w{t} using (tetrode) where win = 'part' and (ka or kb))"""


_ORDER = ["A", "N", "R"]
_STEPS = [(k, m) for i, k in enumerate(_ORDER) for m in _ORDER[i + 1 :]]
_D2 = "(f.c22 * pow(o.p1 - f.m1, 2) - 2 * f.c12 * (o.p1 - f.m1) * (o.p2 - f.m2) + f.c11 * pow(o.p2 - f.m2, 2)) / (f.c11 * f.c22 - f.c12 * f.c12)"
FILLED = f"""one as (select tetrode, item, c, p1, p2 from (select *, left(cluster_id, 1) as c, row_number() over (partition by tetrode, item order by cluster_id, p1, p2) as r from p) where r = 1),
  fit as (select tetrode, c, avg(p1) as m1, avg(p2) as m2, covar_samp(p1, p1) as c11, covar_samp(p1, p2) as c12, covar_samp(p2, p2) as c22 from one group by 1, 2 having count(*) > 3),
  m0 as materialized (select tetrode, f.c, item, o.p1, o.p2 from one o join fit f using (tetrode) where f.c = o.c or {_D2} < {NEAR.format('f.c')})"""


def _filled(spark, sf_dir):
    """Each cluster of a recording with its own items and those near the middle of its distribution."""
    first = F.min(F.struct("cluster_id", "p1", "p2")).alias("x")  # item numbers repeat in the table
    rows = V.peaks(spark, sf_dir).groupBy("tetrode", "item").agg(first).select("tetrode", "item", F.left("x.cluster_id", F.lit(1)).alias("own"), "x.p1", "x.p2")
    fit = moments.moments(rows, ["tetrode", "own"], ["p1", "p2"]).where("n > 3").withColumnRenamed("own", "cluster_id")
    near = rows.join(fit, "tetrode").where((F.col("own") == F.col("cluster_id")) | (moments.mahalanobis_2d("p1", "p2") < F.expr(NEAR.format("cluster_id"))))
    return near.select("tetrode", "cluster_id", "item", "p1", "p2")


@query(f"with {F3}, {FILLED}, " + ", ".join(_settle_sql(i + 1, f"m{i}", k, m) for i, (k, m) in enumerate(_STEPS)) + f" select tetrode, c as cluster_id, item from m{len(_STEPS)}")
def settle_overlaps(spark, sf_dir):
    """All recordings' overlapping clusters, merged or parted pair by pair."""
    return overlaps.settled(_filled(spark, sf_dir), ["tetrode"], "cluster_id", "item", ["p1", "p2"]).select("tetrode", "cluster_id", "item")
