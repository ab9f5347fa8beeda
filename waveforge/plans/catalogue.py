"""Registry of the engine's queries and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import waveform as W
from ..operators import cores, fuzzy, geometry, grading, moments, selection, steps
from ..operators import trains as T
from ..sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "train_report"

# Views of the oracle: the same stand-ins as in sources.views.
F1 = """w as (select e.vec_id as spike_id, epoch_us(v.ts) as ts_us, e.label as cluster_id,
    list_transform(e.embedding[1:32], lambda x: x::double * 1000) as w1, list_transform(e.embedding[33:64], lambda x: x::double * 1000) as w2
    from embeddings e join events v on e.vec_id = v.event_id),
  ww as (select spike_id, ts_us, cluster_id, 1 as wire, w1 as wf from w union all select spike_id, ts_us, cluster_id, 2, w2 from w)"""
F2 = "t as (select event_id, user_id as unit, event_type as wire, epoch_us(ts) as ts_us, value as amplitude from events)"
F3 = """p as (select l_suppkey as tetrode, l_returnflag || l_linestatus as cluster_id, l_orderkey * 8 + l_linenumber as item,
    l_quantity as p1, l_extendedprice / 1000 as p2, l_discount * 100 as p3, l_tax * 100 as p4 from lineitem)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


# -- sources ---------------------------------------------------------------------------------------


@query("""with g as (select r, c from range(1, 96) a(r), range(1, 4) b(c))
  select (r - 1) * 3 + c as tetrode, pos, case pos when 1 then r + 96 * (c - 1) when 2 then r + 1 + 96 * (c - 1) when 3 then r + 96 * c else r + 1 + 96 * c end as channel
  from g, range(1, 5) x(pos)""")
def tetrode_map(spark, sf_dir):
    return V.tetrode_map(spark)


# -- event trains ----------------------------------------------------------------------------------


@query(f"""with {F2}, i as (select *, (ts_us - lag(ts_us) over (partition by unit order by ts_us, event_id)) / 1e6 as isi from t),
  whole as (select avg(ts_us) as m, stddev_samp(ts_us) as s, min(ts_us) as t0, max(ts_us) as t1 from t)
  select unit, count(*) as n_spikes, round(avg(isi), 6) as isi_mean, round(avg((isi < 60)::int), 6) as short_isi,
    round(sum((isi < 600)::int) / nullif(sum((isi < 7200)::int), 0), 6) as burst_ratio,
    round(count(*) * 1e6 / nullif(max(ts_us) - min(ts_us), 0), 9) as rate_hz, round(2 * stddev_samp(ts_us) / (any_value(t1) - any_value(t0)), 6) as recording_share,
    median(ts_us) < any_value(m - s) or median(ts_us) > any_value(m + s) as non_stationary
  from i, whole group by unit""")
def train_report(spark, sf_dir):
    got = T.train_report(V.trains(spark, sf_dir), short=60, burst=(600, 7200))
    return got.select("unit", "n_spikes", r6("isi_mean", "isi_mean"), r6("short_isi", "short_isi"), r6("burst_ratio", "burst_ratio"), F.round("rate_hz", 9).alias("rate_hz"), r6("recording_share", "recording_share"), "non_stationary")


@query(f"""with {F2}, b as (select *, (ts_us - (select min(ts_us) from t)) // 600000000 as bin from t),
  e as (select min(ts_us) as t0, max(ts_us) as t1 from t),
  spine as (select unnest(range(0, (select (t1 - t0) // 600000000 + 1 from e))) as bin),
  c as (select s.bin, count(b.event_id) as n from spine s left join b on b.bin = s.bin and (b.bin < (select (t1 - t0) // 600000000 from e) or b.ts_us = (select t0 + (t1 - t0) // 600000000 * 600000000 from e)) group by s.bin),
  h as (select bin from c where n > (select avg(n) + 2 * stddev_samp(n) from c))
  select event_id from t where exists (select 1 from h, e where abs(t.ts_us - (e.t0 + h.bin * 600000000)) <= 600000000)""")
def burst_filter(spark, sf_dir):
    return T.burst_flags(V.trains(spark, sf_dir), bin_us=600_000_000, n_std=2).select("event_id")


@query("""with l as (select o_orderkey as label_id, epoch_us(o_orderdate) - epoch_us(min(o_orderdate) over ()) + (select epoch_us(min(ts)) from events) + o_orderkey * 997000 % 86400000000 as ts_us from orders),
  j as (select label_id, event_id, epoch_us(ts) as ev, abs(epoch_us(ts) - ts_us) as distance from l join events on epoch_us(ts) > ts_us - 60000000 and epoch_us(ts) < ts_us + 60000000)
  select label_id, arg_min(event_id, (distance, ev, event_id)) as event_id, min(distance) as distance from j group by label_id""")
def asof_nearest(spark, sf_dir):
    events = V.trains(spark, sf_dir)
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"))
    starts = F.broadcast(orders.agg(F.min("day").alias("d0")).crossJoin(events.agg(F.min("ts_us").alias("t0"))))
    labels = orders.crossJoin(starts).select(F.col("o_orderkey").alias("label_id"), (F.col("day") - F.col("d0") + F.col("t0") + F.col("o_orderkey") * 997000 % 86400000000).alias("ts_us"))
    return T.nearest(labels, events, tolerance_us=60_000_000)


@query(f"""with {F2}, z as (select wire, event_id, ts_us, (amplitude - avg(amplitude) over (partition by wire)) / stddev_samp(amplitude) over (partition by wire) as z from t),
  n as (select *, lag(z) over (partition by wire order by ts_us, event_id) as a, lead(z) over (partition by wire order by ts_us, event_id) as b from z)
  select wire, event_id, round(z, 6) as z from n where z >= 3 and z > coalesce(a, '-infinity') and z >= coalesce(b, '-infinity')""")
def zscore_detect(spark, sf_dir):
    train = V.trains(spark, sf_dir)
    stats = train.groupBy("wire").agg(F.avg("amplitude").alias("m"), F.stddev("amplitude").alias("s"))
    z = train.join(stats, "wire").withColumn("z", (F.col("amplitude") - F.col("m")) / F.col("s"))
    low = F.lit(float("-inf"))
    z = selection.with_neighbours(z, ["wire"], ["ts_us", "event_id"], before={"a": "z"}, after={"b": "z"})
    return z.where((F.col("z") >= 3) & (F.col("z") > F.coalesce("a", low)) & (F.col("z") >= F.coalesce("b", low))).select("wire", "event_id", r6("z", "z"))


@query(f"with {F2} select event_id, round((amplitude - min(amplitude) over ()) / (max(amplitude) over () - min(amplitude) over ()) * 2 - 1, 6) as scaled from t")
def minmax_norm(spark, sf_dir):
    train = V.trains(spark, sf_dir)
    ends = train.agg(F.min("amplitude").alias("lo"), F.max("amplitude").alias("hi"))
    return train.crossJoin(ends).select("event_id", r6((F.col("amplitude") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 2 - 1, "scaled"))


@query(f"""with {F2}, e as (select wire, min(amplitude) as lo, max(amplitude) as hi, avg(amplitude) * 0.25 as threshold from t group by wire),
  c as (select t.wire, least(20, floor((amplitude - lo) / ((hi - lo) / 21))) as bin, count(*) as n, any_value(lo) as lo, any_value((hi - lo) / 21) as d, any_value(threshold) as threshold from t join e using (wire) group by 1, 2),
  m as (select wire, arg_min(bin, (-n, bin)) as modal from c group by wire)
  select wire, round((sum(case when bin > modal and lo + (2 * modal - bin + 0.5) * d < threshold then n else 0 end) + sum(case when lo + (bin + 0.5) * d < threshold then n else 0 end))
    / sum(case when bin > modal then 2 * n else n end), 6) as below from c join m using (wire) where bin >= modal group by wire""")
def incompleteness(spark, sf_dir):
    train = V.trains(spark, sf_dir)
    limits = train.groupBy("wire").agg((F.avg("amplitude") * 0.25).alias("limit"))
    got = grading.incompleteness(train.join(limits, "wire"), "wire", "amplitude", F.col("limit"))
    return got.select("wire", r6("below", "below"))


@query(f"""with {F2}, l as (select wire, avg(amplitude) * 0.25 as threshold from t group by wire)
  select wire, round(pow(any_value(threshold) - avg(amplitude), 2) / var_samp(amplitude), 6) as iso from t join l using (wire) group by wire""")
def iso_dist(spark, sf_dir):
    train = V.trains(spark, sf_dir)
    got = train.groupBy("wire").agg(F.avg("amplitude").alias("m"), F.var_samp("amplitude").alias("v"))
    return got.select("wire", r6((F.col("m") * 0.25 - F.col("m")) * (F.col("m") * 0.25 - F.col("m")) / F.col("v"), "iso"))


# -- waveforms -------------------------------------------------------------------------------------


@query(f"with {F1} select wire, avg((len(list_filter(wf, lambda x: x <> 0)) > 0)::int) > 0.5 as live from ww group by wire")
def live_wires(spark, sf_dir):
    rows = V.wires(V.waveforms(spark, sf_dir))
    return rows.groupBy("wire").agg((F.avg(F.exists("wf", lambda x: x != 0).cast("int")) > 0.5).alias("live"))


@query(f"with {F3} " + " union all ".join(f"select '{c}' as dim, count(distinct {c}) >= 0.05 * count(*) as usable from p" for c in ("p1", "p2", "p3", "p4")))
def singular_cols(spark, sf_dir):
    dims = ["p1", "p2", "p3", "p4"]
    long = V.peaks(spark, sf_dir).select(F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("v")) for d in dims))))
    # two levels: values are made distinct where they are before they meet
    values = long.groupBy("dim", "v").agg(F.count("*").alias("n"))
    return values.groupBy("dim").agg((F.count("*") >= 0.05 * F.sum("n")).alias("usable"))


LERP = "list_transform(range(0, 120), lambda j: wf[least(floor(j * 31.0 / 119)::int, 30) + 1] + (wf[least(floor(j * 31.0 / 119)::int, 30) + 2] - wf[least(floor(j * 31.0 / 119)::int, 30) + 1]) * (j * (31::double / 119) - least(floor(j * (31::double / 119))::int, 30)))"
I120 = f"i as (select spike_id, cluster_id, wire, {LERP.replace('j * 31.0 / 119', 'j * (31::double / 119)')} as wf from ww)"


def _interpolated(spark, sf_dir):
    return V.wires(V.waveforms(spark, sf_dir)).withColumn("wf", W.resample(F.col("wf"), 120))


def _points(frame, name="v"):
    return frame.select("spike_id", "wire", F.posexplode("wf").alias("pos", name)).select("spike_id", "wire", F.col("pos").cast("long").alias("pos"), r6(name, name))


@query(f"with {F1}, {I120} select spike_id, wire, unnest(range(0, 120)) as pos, round(unnest(wf), 6) as v from i")
def interp_linear(spark, sf_dir):
    return _points(_interpolated(spark, sf_dir))


@query(f"""with {F1}, {I120}, a as (select *, list_position(wf[20:100], list_max(wf[20:100])) + 18 as peak from i)
  select spike_id, wire, unnest(range(0, 150)) as pos, round(unnest(list_transform(range(0, 150), lambda q: case when q - (46 - peak) between 0 and 119 then wf[q - (46 - peak) + 1] else 0.0 end)), 6) as v from a""")
def align_peak(spark, sf_dir):
    return _points(_interpolated(spark, sf_dir).withColumn("wf", W.align_to_peak(F.col("wf"), 120)))


@query(f"with {F1} select spike_id, wire, len(list_filter(range(2, 32), lambda i: wf[i] > wf[i - 1] and wf[i] >= wf[i + 1])) as n_peaks, len(list_filter(range(2, 32), lambda i: wf[i] < wf[i - 1] and wf[i] <= wf[i + 1])) as n_valleys from ww")
def local_extrema(spark, sf_dir):
    rows = V.wires(V.waveforms(spark, sf_dir))
    return rows.select("spike_id", "wire", F.size(W.local_peaks(F.col("wf"))).cast("long").alias("n_peaks"), F.size(W.local_valleys(F.col("wf"))).cast("long").alias("n_valleys"))


@query(f"with {F1} select spike_id, wire, round(list_max(wf), 6) as peak, list_position(wf, list_max(wf)) - 1 as place from ww")
def peaks_max(spark, sf_dir):
    rows = V.wires(V.waveforms(spark, sf_dir))
    return rows.select("spike_id", "wire", r6(F.array_max("wf"), "peak"), W.first_argmax(F.col("wf")).alias("place"))


@query(f"""with {F1}, m as (select wire, arg_min(place, (-n, place)) as place from (select wire, list_position(wf, list_max(wf)) as place, count(*) as n from ww group by 1, 2) group by wire)
  select spike_id, wire, round(wf[place], 6) as peak from ww join m using (wire)""")
def peaks_mode_aligned(spark, sf_dir):
    rows = V.wires(V.waveforms(spark, sf_dir))
    places = rows.groupBy("wire").agg(F.mode(W.first_argmax(F.col("wf")), True).alias("place"))
    return rows.join(places, "wire").select("spike_id", "wire", r6(F.get("wf", F.col("place")), "peak"))


@query(f"""with {F1}, a as (select spike_id, greatest(list_max(w1), list_max(w2)) as top, case when list_max(w1) >= list_max(w2) then 1 else 2 end as wire from w)
  select wire, round(min(top), 6) as threshold from a group by wire""")
def threshold_impute(spark, sf_dir):
    rows = V.waveforms(spark, sf_dir).select(F.array_max("w1").alias("a"), F.array_max("w2").alias("b"))
    return rows.groupBy(F.when(F.col("a") >= F.col("b"), 1).otherwise(2).alias("wire")).agg(r6(F.min(F.greatest("a", "b"))).alias("threshold"))


@query(f"with {F1} select spike_id from w where least(list_max(w1), list_max(w2)) < 300 and greatest(list_min(w1), list_min(w2)) > -300")
def saturation_filter(spark, sf_dir):
    rows = V.waveforms(spark, sf_dir)
    return rows.where((F.least(F.array_max("w1"), F.array_max("w2")) < 300) & (F.greatest(F.array_min("w1"), F.array_min("w2")) > -300)).select("spike_id")


@query(f"""with {F1}, c as (select spike_id, list_filter(range(2, 33), lambda i: (i = 32 or (wf[i] > wf[i - 1] and wf[i] >= wf[i + 1])) and wf[i] >= 1.25 * 100 and wf[i] >= 0.25 * list_max(wf)) as places from ww)
  select spike_id, coalesce((max(list_max(places)) - min(list_min(places))) >= 11, false) as several from c group by spike_id""")
def nearsim_flag(spark, sf_dir):
    frame = V.waveforms(spark, sf_dir)

    def candidates(w: Column) -> Column:
        top = F.array_max(w)
        return F.filter(W.local_peaks(w, include_last=True), lambda i: (F.get(w, i) >= 125.0) & (F.get(w, i) >= 0.25 * top))

    both = F.concat(candidates(F.col("w1")), candidates(F.col("w2")))
    frame = frame.select("spike_id", both.alias("at"))
    return frame.select("spike_id", F.coalesce(F.array_max("at") - F.array_min("at") >= 11, F.lit(False)).alias("several"))


@query(f"with {F1} select cluster_id, wire, pos, round(avg(v), 6) as mean from (select cluster_id, wire, unnest(range(0, 32)) as pos, unnest(wf) as v from ww) group by all")
def mean_waveform(spark, sf_dir):
    rows = V.wires(V.waveforms(spark, sf_dir)).select("cluster_id", "wire", F.posexplode("wf").alias("pos", "v"))
    return rows.groupBy("cluster_id", "wire", F.col("pos").cast("long").alias("pos")).agg(r6(F.avg("v")).alias("mean"))


TEMPLATE = [0.1, 0.3, 0.9, 0.3, 0.1]
_T = "[" + ", ".join(f"{x}::double" for x in TEMPLATE) + "]"


@query(f"""with {F1} select spike_id, wire, round(list_max(list_transform(range(1, 29), lambda i: pow(list_dot_product(wf[i:i + 4], {_T}), 2) / (list_dot_product(wf[i:i + 4], wf[i:i + 4]) - pow(list_dot_product(wf[i:i + 4], {_T}), 2)))), 6) as snr from ww""")
def template_match(spark, sf_dir):
    return V.wires(V.waveforms(spark, sf_dir)).select("spike_id", "wire", r6(W.template_snr(F.col("wf"), TEMPLATE), "snr"))


# -- clusters --------------------------------------------------------------------------------------

XY = "x as (select spike_id, ts_us, cluster_id, list_max(w1) as a, list_max(w2) as b from w)"


def _xy(spark, sf_dir):
    return V.waveforms(spark, sf_dir).select("spike_id", "ts_us", "cluster_id", F.array_max("w1").alias("a"), F.array_max("w2").alias("b"))


@query(f"""with {F1}, {XY} select cluster_id, case when avg(a) >= avg(b) then 1 else 2 end as wire,
  round(case when avg(a) >= avg(b) then stddev_samp(a) / avg(a) else stddev_samp(b) / avg(b) end, 6) as cv from x group by cluster_id""")
def peak_cv(spark, sf_dir):
    cv = lambda x: F.stddev(x) / F.avg(x)
    first = F.avg("a") >= F.avg("b")  # the wire of the highest mean peak
    return _xy(spark, sf_dir).groupBy("cluster_id").agg(F.when(first, 1).otherwise(2).alias("wire"), r6(F.when(first, cv("a")).otherwise(cv("b"))).alias("cv"))


@query(f"with {F3} select tetrode, cluster_id, count(*) as n, round(avg(p1), 6) as mu_p1, round(avg(p2), 6) as mu_p2, round(covar_samp(p1, p1), 6) as c_p1_p1, round(covar_samp(p1, p2), 6) as c_p1_p2, round(covar_samp(p2, p2), 6) as c_p2_p2 from p group by 1, 2")
def cluster_moments(spark, sf_dir):
    got = moments.moments(V.peaks(spark, sf_dir), ["tetrode", "cluster_id"], ["p1", "p2"])
    return got.select("tetrode", "cluster_id", "n", *(r6(c, c) for c in got.columns[3:]))


MOM = "m as (select cluster_id, count(*) as n, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from x group by 1)"
MAHAL = "(bb * (a - ma) * (a - ma) - 2 * ab * (a - ma) * (b - mb) + aa * (b - mb) * (b - mb)) / (aa * bb - ab * ab)"


def _mahal(spark, sf_dir, sample=True):
    rows = _xy(spark, sf_dir)
    table = moments.moments(rows, ["cluster_id"], ["a", "b"], sample)
    return rows.join(table, "cluster_id").withColumn("d", moments.mahalanobis_2d("a", "b"))


@query(f"with {F1}, {XY}, {MOM} select spike_id, cluster_id, round({MAHAL}, 6) as d from x join m using (cluster_id)")
def mahal_2d(spark, sf_dir):
    return _mahal(spark, sf_dir).select("spike_id", "cluster_id", r6("d", "d"))


@query(f"""with {F1}, {XY}, k as (select distinct cluster_id as k from x),
  m as (select k, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from x, k where cluster_id <> k group by k)
  select cluster_id, round(avg(exp(-({MAHAL}) / 2)), 6) as lratio from x join m on cluster_id = k group by cluster_id""")
def lratio_2d(spark, sf_dir):
    rows = _xy(spark, sf_dir).withColumn("all", F.lit(1))
    rest = geometry.rest_moments(moments.moments(rows, ["all", "cluster_id"], ["a", "b"]), "all", "cluster_id", ["a", "b"])
    return geometry.lratio(rows.select("all", "cluster_id", "a", "b"), rest, ["all", "cluster_id"], ["a", "b"]).select("cluster_id", r6("lratio", "lratio"))


BHAT = """select x.cluster_id as a, y.cluster_id as b, round(((x.bb + y.bb) / 2 * (x.ma - y.ma) ** 2 - (x.ab + y.ab) * (x.ma - y.ma) * (x.mb - y.mb) + (x.aa + y.aa) / 2 * (x.mb - y.mb) ** 2)
  / ((x.aa + y.aa) / 2 * (x.bb + y.bb) / 2 - ((x.ab + y.ab) / 2) ** 2) / 8
  + ln(((x.aa + y.aa) / 2 * (x.bb + y.bb) / 2 - ((x.ab + y.ab) / 2) ** 2) / sqrt((x.aa * x.bb - x.ab ** 2) * (y.aa * y.bb - y.ab ** 2))) / 2, 6) as bhat
  from m x join m y on x.cluster_id < y.cluster_id"""


@query(f"with {F1}, {XY}, {MOM} {BHAT}")
def bhat_pairs(spark, sf_dir):
    table = moments.moments(_xy(spark, sf_dir), ["cluster_id"], ["a", "b"])
    return moments.bhattacharyya_2d(table, "cluster_id", "a", "b").select("a", "b", r6("bhat", "bhat"))


@query(f"with {F1}, {XY}, {MOM}, q as ({BHAT}) select cluster_id, min(bhat) as min_bhat from (select a as cluster_id, bhat from q union all select b, bhat from q) group by 1")
def bhat_min(spark, sf_dir):
    pairs = bhat_pairs(spark, sf_dir)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("cluster_id"), "bhat"), F.struct(F.col("b").alias("cluster_id"), "bhat"))))
    return both.groupBy("cluster_id").agg(F.min("bhat").alias("min_bhat"))


@query(f"""with {F1}, {XY}, {MOM}, d as (select spike_id, cluster_id, n, {MAHAL} as d from x join m using (cluster_id)),
  r as (select *, row_number() over (partition by cluster_id order by d, spike_id) as rank from d)
  select spike_id, cluster_id, rank from r where rank <= least(round(0.6 * n), greatest(200, round(0.3 * n)))""")
def core_topk(spark, sf_dir):
    rows = _mahal(spark, sf_dir).select("spike_id", "cluster_id", "d")
    core = grading.core_rows(rows, "cluster_id", "d", "spike_id")
    ranked = selection.numbered(core, ["cluster_id"], ["d", "spike_id"], steps.Stages(spark))
    return ranked.select("spike_id", "cluster_id", (F.col("place") + 1).alias("rank"))


@query(f"""with {F1}, {XY}, {MOM.replace('covar_samp', 'covar_pop')}, o as (select cluster_id, median(d) + stddev_samp(d) as limit_ from (select cluster_id, {MAHAL} as d from x join m using (cluster_id)) group by 1)
  select m.cluster_id, spike_id from x cross join m join o on o.cluster_id = m.cluster_id where x.cluster_id = m.cluster_id or {MAHAL} < limit_""")
def gaussian_fill(spark, sf_dir):
    rows = _xy(spark, sf_dir)
    table = moments.moments(rows, ["cluster_id"], ["a", "b"], sample=False)
    own = rows.join(table, "cluster_id").withColumn("d", moments.mahalanobis_2d("a", "b"))
    limits = selection.limits(own, ["cluster_id"], "d", 1.0)
    # every row meets the table of clusters, a few rows; no pair of rows is made
    clusters = table.join(limits, "cluster_id")
    hit = rows.withColumnRenamed("cluster_id", "own").crossJoin(clusters).where((F.col("own") == F.col("cluster_id")) | (moments.mahalanobis_2d("a", "b") < F.col("limit")))
    return hit.select("cluster_id", "spike_id")


@query(f"""with {F3}, b as (select cluster_id, greatest(min(p1), avg(p1) - 3 * stddev_samp(p1)) as l1, least(max(p1), avg(p1) + 3 * stddev_samp(p1)) as h1, greatest(min(p2), avg(p2) - 3 * stddev_samp(p2)) as l2, least(max(p2), avg(p2) + 3 * stddev_samp(p2)) as h2 from p where p4 > 6 and cluster_id in ('AF', 'RF') group by 1)
  select p.item from p where not (p4 > 6 and cluster_id in ('AF', 'RF')) and not exists (select 1 from b where p1 > l1 and p1 < h1 and p2 > l2 and p2 < h2)""")
def box_removal(spark, sf_dir):
    rows = V.peaks(spark, sf_dir)
    member = (F.col("p4") > 6) & F.col("cluster_id").isin("AF", "RF")
    low = lambda d: F.greatest(F.min(d), F.avg(d) - 3 * F.stddev(d))
    high = lambda d: F.least(F.max(d), F.avg(d) + 3 * F.stddev(d))
    boxes = rows.where(member).groupBy("cluster_id").agg(low("p1").alias("l1"), high("p1").alias("h1"), low("p2").alias("l2"), high("p2").alias("h2"))
    inside = (F.col("p1") > F.col("l1")) & (F.col("p1") < F.col("h1")) & (F.col("p2") > F.col("l2")) & (F.col("p2") < F.col("h2"))
    return rows.where(~member).join(boxes.drop("cluster_id"), inside, "left_anti").select("item")


@query("""with c as (select o_orderstatus as a, o_orderpriority as b, count(*) as common from orders group by 1, 2)
  select a, b, common, round(common / sum(common) over (partition by a), 6) as of_a, round(common / sum(common) over (partition by b), 6) as of_b from c""")
def overlap_matrix(spark, sf_dir):
    got = grading.overlaps(V.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey")
    return got.select("a", "b", "common", r6("of_a", "of_a"), r6("of_b", "of_b"))


@query("""with a as (select o_custkey as k from orders where o_orderstatus = 'F'), b as (select o_custkey as k from orders where o_orderpriority = '1-URGENT')
  select 'union' as op, count(*) as n from (from a union from b) union all select 'union_all', count(*) from (from a union all from b)
  union all select 'intersect', count(*) from (from a intersect from b) union all select 'except', count(*) from (from a except from b) union all select 'anti', count(*) from a anti join b using (k)""")
def set_ops(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    a = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    made = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "except": a.subtract(b), "anti": a.join(b, "k", "left_anti")}
    out = None
    for name, frame in made.items():
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"with {F3} select floor(p1 / 10)::bigint as b1, floor(p2 / 10)::bigint as b2, count(*) as n, round(avg(p3), 6) as mean3 from p group by 1, 2")
def hist_nd(spark, sf_dir):
    rows = V.peaks(spark, sf_dir)
    return rows.groupBy(F.floor(F.col("p1") / 10).alias("b1"), F.floor(F.col("p2") / 10).alias("b2")).agg(F.count("*").alias("n"), r6(F.avg("p3")).alias("mean3"))


_U = "1 / ((a - {0}) ** 2 + (b - {1}) ** 2)"
_C = ((150.0, 150.0), (350.0, 300.0))
_UU = [_U.format(*c) for c in _C]


@query(f"""with {F1}, {XY}, u as (select a, b, {_UU[0]} / ({_UU[0]} + {_UU[1]}) as u0, {_UU[1]} / ({_UU[0]} + {_UU[1]}) as u1 from x)
  select 0::bigint as cluster, round(sum(u0 * u0 * a) / sum(u0 * u0), 6) as a, round(sum(u0 * u0 * b) / sum(u0 * u0), 6) as b, round(1 - 2 * (1 - sum(u0 * u0 + u1 * u1) / count(*)), 6) as mpc from u
  union all select 1, round(sum(u1 * u1 * a) / sum(u1 * u1), 6), round(sum(u1 * u1 * b) / sum(u1 * u1), 6), round(1 - 2 * (1 - sum(u0 * u0 + u1 * u1) / count(*)), 6) from u""")
def fcm_step(spark, sf_dir):
    centers, coefficient = fuzzy.fit(_xy(spark, sf_dir), ["a", "b"], [list(c) for c in _C], max_iter=1)
    rows = [(i, *c, fuzzy.validity(coefficient, 2)) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster long, a double, b double, mpc double").select("cluster", r6("a", "a"), r6("b", "b"), r6("mpc", "mpc"))


@query()
def fcm_cluster(spark, sf_dir):
    stages = steps.Stages(spark)
    rows = stages(_xy(spark, sf_dir).select(F.lit(0).alias("recording"), "spike_id", F.array("a", "b").alias("x")), "rows")
    fits = cores.fit_groups(rows, ["recording"], "spike_id", k_max=6, n_dims=2, stages=stages).withColumn("weights", F.array(F.lit(1.0), F.lit(1.0)))
    return cores.assigned(rows, fits, ["recording"]).select("spike_id", F.col("child").alias("cluster"))
