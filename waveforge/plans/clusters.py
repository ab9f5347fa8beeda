"""Queries over whole clusterings: grouped fits, the recursion, refinement and passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import waveform as W
from ..operators import comparison, cores, features, gradebook, histograms, refinement, selection, session, shapes, steps
from ..sources import views as V
from .catalogue import F1, F3, TEMPLATE, XY, _xy, query, r6

# -- grouped fits ------------------------------------------------------------------------------------


def _fuzzy_step(i: int) -> str:
    """CTEs of one step: centres ``c<i>`` from centres ``c<i - 1>``."""
    d = [f"nullif(pow(p1 - {k}1, 2) + pow(p2 - {k}2, 2), 0)" for k in "ab"]
    u = f"case when {{0}} is null and {{1}} is null then 0.5 when {{0}} is null then 1.0 when {{1}} is null then 0.0 else (1 / {{0}}) / (1 / {{0}} + 1 / {{1}}) end"
    degrees = f"select tetrode, p1, p2, {u.format(d[0], d[1])} as u, {u.format(d[1], d[0])} as v from p join c{i - 1} using (tetrode)"
    return f"c{i} as materialized (select tetrode, sum(u * u * p1) / sum(u * u) as a1, sum(u * u * p2) / sum(u * u) as a2, sum(v * v * p1) / sum(v * v) as b1, sum(v * v * p2) / sum(v * v) as b2, 1 - 2 * (1 - sum(u * u + v * v) / count(*)) as before from ({degrees}) group by 1)"


FITS = f"""m as (select tetrode, avg(p1) as a1, avg(p2) as a2 from p group by 1),
  c0 as materialized (select p.tetrode, any_value(a1) as a1, any_value(a2) as a2, arg_min(p1, (pow(p1 - a1, 2) + pow(p2 - a2, 2), item)) + 1e-5::double as b1, arg_min(p2, (pow(p1 - a1, 2) + pow(p2 - a2, 2), item)) + 1e-5::double as b2 from p join m using (tetrode) group by 1),
  {_fuzzy_step(1)}, {_fuzzy_step(2)}, {_fuzzy_step(3)}, fit as (select c2.*, c3.before as validity from c2 join c3 using (tetrode))"""


@query(f"with {F3}, {FITS} select tetrode, 0 as cluster, round(a1, 6) as a, round(a2, 6) as b, round(validity, 6) as validity from fit where validity > 0 union all select tetrode, 1, round(b1, 6), round(b2, 6), round(validity, 6) from fit where validity > 0")
def fcm_recordings(spark, sf_dir):
    """Two steps of a fit in two clusters, for all recordings at once."""
    stages = steps.Stages(spark)
    rows = stages(V.peaks(spark, sf_dir).select("tetrode", "item", F.array("p1", "p2").alias("x")), "rows")
    fits = cores.fit_groups(rows, ["tetrode"], "item", k_max=2, n_dims=2, stages=stages, max_iter=2).where("k > 1")
    each = fits.select("tetrode", "validity", F.posexplode("centers").alias("cluster", "c"))
    return each.select("tetrode", "cluster", r6(F.get("c", F.lit(0)), "a"), r6(F.get("c", F.lit(1)), "b"), r6("validity", "validity"))


def _spike_features(waves):
    """Features of clusters of two-wire waveforms, made from each cluster's own rows."""

    def made(members, group):
        return features.spike_features(members.join(waves, ["recording", "spike_id"]), group, "spike_id", ["w1", "w2"]).select(group, F.col("spike_id"), F.col("features").alias("x"))

    return made


@query()
def core_recursion(spark, sf_dir):
    """The recursion over all waveforms as one recording."""
    waves = V.waveforms(spark, sf_dir).select(F.lit(0).alias("recording"), "spike_id", "w1", "w2")
    return cores.core_loop(waves.select("recording", "spike_id"), ["recording"], "spike_id", _spike_features(waves), n_dims=5).select("spike_id", "cluster")


@query()
def core_recursion_peaks(spark, sf_dir):
    """The recursion over the peaks of all recordings, with redundant dimensions left out."""
    peaks = V.peaks(spark, sf_dir).groupBy("tetrode", "item").agg(F.min(F.struct("p1", "p2", "p3", "p4")).alias("x")).select("tetrode", "item", F.array("x.p1", "x.p2", "x.p3", "x.p4").alias("x"))
    peaks = steps.written(peaks, "peaks")  # read again at each level
    made = lambda members, group: members.join(peaks, ["tetrode", "item"]).select(group, "item", "x")
    return cores.core_loop(peaks.select("tetrode", "item"), ["tetrode"], "item", made, n_dims=4, drop_redundant=True)


# -- refinement, grades, samples -----------------------------------------------------------------------


def _described(spark, sf_dir):
    """The waveforms as one recording: peaks at the place most waves have theirs, and for the refinement these and the first components, as scores."""
    # written once: each of the many jobs after it would read all events again
    waves = steps.written(V.waveforms(spark, sf_dir).withColumn("recording", F.lit(0)), "waves")
    made = features.spike_features(waves, "recording", "spike_id", ["w1", "w2"])
    values = made.select("recording", "spike_id", *(F.get("features", F.lit(i)).alias(f"f{i}") for i in range(4)), *(F.get("features", F.lit(i)).alias(f"p{i + 1}") for i in range(2)))
    return waves, steps.written(shapes.zscored(values, [f"f{i}" for i in range(4)]), "described")


@query()
def refined_clusters(spark, sf_dir):
    """The labels' clusters after refinement, with the branch each took."""
    waves, rows = _described(spark, sf_dir)
    members = waves.select("recording", "cluster_id", "spike_id")
    found = refinement.refined(rows, members, ["recording"], "cluster_id", "spike_id", [f"f{i}" for i in range(4)], ["p1", "p2"], steps.Stages(spark))
    return found.select("cluster_id", "spike_id", "branch")


@query()
def graded_clusters(spark, sf_dir):
    """All grades of clusters 0 to 7; labels 8 and 9 stand for unsorted rows."""
    waves, rows = _described(spark, sf_dir)
    spikes = rows.select("recording", "spike_id", "p1", "p2").join(waves.select("spike_id", "ts_us", "w1", "w2"), "spike_id")
    members = waves.where("cluster_id < 8").select("recording", "cluster_id", "spike_id")
    got = gradebook.graded(spikes, members, ["recording"], "cluster_id", "spike_id", "ts_us", ["w1", "w2"], ["p1", "p2"], [100.0, 100.0], TEMPLATE, short_isi=600.0, few_wires=1)
    whole = ["n", "n_near", "wires", "final_grade", "valley", "non_stationary"]
    return got.select("cluster_id", *whole, *(r6(c, c) for c in got.columns if c not in ("recording", "cluster_id", *whole)))


@query(f"with {F3}, d as (select distinct tetrode, item from p), r as (select *, row_number() over (partition by tetrode order by sha256('7:' || item), item) as k from d) select tetrode, item from r where k <= 100")
def sampled_items(spark, sf_dir):
    """A hundred items of each recording, the same whatever the partitions."""
    rows = V.peaks(spark, sf_dir).select("tetrode", "item")
    many = rows.count()
    return selection.sampled(steps.dealt(rows, many, "tetrode", "item").distinct(), ["tetrode"], "item", 100, seed=7, many=many)


@query(f"""with {F1}, n as (select cluster_id, spike_id, row_number() over (partition by cluster_id order by spike_id) - 1 as place, count(*) over (partition by cluster_id) as n from w),
  d as (select cluster_id, n, unnest(range(0, 100)) as draw from (select distinct cluster_id, n from n)), p as (select cluster_id, draw, ('0x' || sha256('3:' || cluster_id || ':' || draw)[1:12])::bigint % n as place from d)
  select cluster_id, draw::int as draw, spike_id from p join n using (cluster_id, place)""")
def drawn_spikes(spark, sf_dir):
    """A hundred draws of each cluster with replacement."""
    rows = V.waveforms(spark, sf_dir).select("cluster_id", "spike_id")
    return selection.drawn(rows, ["cluster_id"], "spike_id", 100, seed=3).select("cluster_id", "draw", "spike_id")


@query()
def sorted_session(spark, sf_dir):
    """All waveforms as one recording, from resampling to sorted spikes."""
    waves = V.waveforms(spark, sf_dir).withColumn("recording", F.lit(0))
    done = session.sorted_session(waves, ["recording"], "spike_id", "ts_us", session.Settings(["w1", "w2"], [100.0, 100.0], [400.0, 400.0], n_passes=2))
    return done.spikes.select("spike_id", "part", r6("ts_s", "ts_s"), "cluster")


# -- two sortings of a recording -------------------------------------------------------------------

KINDS = ["click", "error", "purchase", "signup", "view"]  # event types in order; one that isn't among them is no cluster


def _sortings(spark, sf_dir):
    """Two sortings of the waveforms, by time: the labels as the automatic one, the types of their events as the manual one."""
    rows = steps.written(_xy(spark, sf_dir).withColumn("recording", F.lit(0)), "rows")
    kinds = V.trains(spark, sf_dir).select(F.col("event_id").alias("spike_id"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("wire")).cast("int").alias("cluster"))
    auto = rows.select("recording", (F.col("ts_us") / 1e6).alias("ts_s"), (F.col("cluster_id") + 1).alias("cluster"))
    manual = steps.written(rows.join(kinds, "spike_id").select("recording", (F.col("ts_us") / 1e6).alias("ts_s"), "cluster"), "manual")
    return rows, auto, manual


@query(f"""with {F1}, {XY}, k as (select spike_id, a, b, cluster_id + 1 as auto, list_position([{', '.join(f"'{x}'" for x in KINDS)}], event_type) as manual from x join events on spike_id = event_id),
  s as (select *, row_number() over (partition by ts_us order by spike_id) as r from (select k.*, ts_us from k join x using (spike_id))),
  q as (select s.manual, s.auto, f.spike_id, f.a, f.b from s join s f on f.ts_us = s.ts_us and f.r = 1),
  am as (select distinct auto, spike_id, a, b from q), mm as (select distinct manual, spike_id, a, b from q where manual > 0),
  ma_ as (select auto, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from am group by 1),
  mo_ as (select manual, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from mm group by 1),
  p as (select manual, auto, ((x.bb + y.bb) / 2 * (x.ma - y.ma) ** 2 - (x.ab + y.ab) * (x.ma - y.ma) * (x.mb - y.mb) + (x.aa + y.aa) / 2 * (x.mb - y.mb) ** 2) / ((x.aa + y.aa) / 2 * (x.bb + y.bb) / 2 - ((x.ab + y.ab) / 2) ** 2) / 8
    + ln(((x.aa + y.aa) / 2 * (x.bb + y.bb) / 2 - ((x.ab + y.ab) / 2) ** 2) / sqrt((x.aa * x.bb - x.ab ** 2) * (y.aa * y.bb - y.ab ** 2))) / 2 as bhat from mo_ x cross join ma_ y),
  c as (select manual, auto, count(*) as common from mm join am using (spike_id) group by 1, 2)
  select manual, auto, coalesce(common, 0) as common, round(bhat, 6) as bhat, min(bhat) over (partition by manual) < 1 as found from p left join c using (manual, auto)""")
def compared_sortings(spark, sf_dir):
    rows, auto, manual = _sortings(spark, sf_dir)
    sets = [comparison.members_at(x, rows, ["recording"], "cluster", "spike_id", "ts_us", 1000.0) for x in (manual, auto)]
    return comparison.compared(rows.select("recording", "spike_id", "a", "b"), *sets, ["recording"], "spike_id", ["a", "b"]).select("manual", "auto", "common", r6("bhat", "bhat"), "found")


@query()
def regraded_statistics(spark, sf_dir):
    """How many clusters of the manual sorting the automatic one finds, by their grades."""
    waves, described = _described(spark, sf_dir)
    _, auto, manual = _sortings(spark, sf_dir)
    spikes = waves.select("recording", "spike_id", "ts_us", "w1", "w2").join(described.select("recording", "spike_id", "p1", "p2"), ["recording", "spike_id"])
    return comparison.regraded(auto, manual, spikes, ["recording"], "spike_id", "ts_us", ["w1", "w2"], ["p1", "p2"], [100.0, 100.0], TEMPLATE, short_isi=600.0)[3]


# -- histograms, templates, windows ------------------------------------------------------------------

_EDGES = [0.0, 10.0, 20.0, 30.0, 50.0]


@query(f"""with {F3}, e as (select cluster_id, min(p2) as lo, max(p2) as hi from p group by 1),
  b as (select cluster_id, p3, p4, len(list_filter({_EDGES}, lambda e: e <= p1)) as bin_p1, case when p2 = hi then 9 else least(8, floor((p2 - lo) / nullif(hi - lo, 0) * 8) + 1) end::int as bin_p2, lo, hi from p join e using (cluster_id) where p1 <= 50)
  select cluster_id, bin_p1, bin_p2, case when bin_p1 < 5 then ({_EDGES}[bin_p1] + {_EDGES}[bin_p1 + 1]) / 2 end as mid_p1, case when bin_p2 <= 8 then round(any_value(lo + (bin_p2 - 0.5::double) * (hi - lo) / 8), 6) end as mid_p2,
    count(*) as count, round(avg(p3), 6) as mean3, max(p4) as most4 from b where bin_p1 >= 1 group by 1, 2, 3""")
def histogram_edges(spark, sf_dir):
    got = histograms.histogram(V.peaks(spark, sf_dir), ["p1", "p2"], {"p1": _EDGES, "p2": 8}, by=["cluster_id"], mean3=F.avg("p3"), most4=F.max("p4"))
    return got.select("cluster_id", "bin_p1", "bin_p2", "mid_p1", r6("mid_p2", "mid_p2"), "count", r6("mean3", "mean3"), "most4")


TEMPLATES = [[0.6, 0.8, 0.0], [0.0, 0.0, 1.0]]


@query(f"""with {F1}, o as (select spike_id, wire, i, wf[i:i + 2] as v from (select *, unnest(range(1, 31)) as i from ww)),
  a as (select spike_id, wire, i, pow(list_dot_product(v, [0.6::double, 0.8::double, 0.0::double]), 2) + pow(list_dot_product(v, [0.0::double, 0.0::double, 1.0::double]), 2) as a, list_dot_product(v, v) as e from o),
  s as (select *, a / nullif(e - a, 0) as snr from a), r as (select *, row_number() over (partition by spike_id, wire order by snr desc, i) as r from s where snr is not null)
  select spike_id, wire, round(a, 4) as amplitude, (i - 1)::int as offset_ from r where r = 1""")
def template_offsets(spark, sf_dir):
    got = V.wires(V.waveforms(spark, sf_dir)).select("spike_id", "wire", W.template_matches(F.col("wf"), TEMPLATES).alias("t"))
    return got.select("spike_id", "wire", F.round("t.amplitude", 4).alias("amplitude"), F.col("t.offset").alias("offset_"))


@query("""with t as (select event_id, event_type as channel, epoch_us(ts) as ts_us, value as v from events),
  s as (select *, row_number() over (partition by channel order by ts_us, event_id) - 1 as place, count(*) over (partition by channel) as n, (v - avg(v) over (partition by channel)) / stddev_samp(v) over (partition by channel) as z from t),
  d as (select *, lag(z) over (partition by channel order by place) as a, lead(z) over (partition by channel order by place) as b from s)
  select channel, place as peak, greatest(place - 30, 0) as begin_, least(place + 29, n - 1) as end_ from d where z >= 3 and z > coalesce(a, '-infinity') and z >= coalesce(b, '-infinity')""")
def channel_windows(spark, sf_dir):
    """Windows of 60 samples around the peaks of each channel's own samples, cut at the channel's ends."""
    samples = V.trains(spark, sf_dir).select("event_id", F.col("wire").alias("channel"), "ts_us", F.col("amplitude").alias("v"))
    stats = samples.groupBy("channel").agg(F.avg("v").alias("m"), F.stddev("v").alias("s"), F.count("*").alias("n"))
    placed = selection.numbered(samples, ["channel"], ["ts_us", "event_id"], steps.Stages(spark)).join(stats, "channel")
    z = selection.with_neighbours(placed.withColumn("z", (F.col("v") - F.col("m")) / F.col("s")), ["channel"], ["place"], before={"a": "z"}, after={"b": "z"})
    low = F.lit(float("-inf"))
    hit = z.where((F.col("z") >= 3) & (F.col("z") > F.coalesce("a", low)) & (F.col("z") >= F.coalesce("b", low)))
    return hit.select("channel", F.col("place").alias("peak"), F.greatest(F.col("place") - 30, F.lit(0)).alias("begin_"), F.least(F.col("place") + 29, F.col("n") - 1).alias("end_"))
