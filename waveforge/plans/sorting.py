"""Queries over features, expansion and refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, geometry, grading, moments, shapes, sorting
from ..sources import views as V
from .catalogue import F1, F3, MAHAL, MOM, XY, _xy, query, r6
from .isolation import _BHAT, _RENAMED, BIG, DIMS, OWN, _big, _moments_sql
from .recordings import OVERLAP


def _recording(spark, sf_dir):
    """All waveforms as one recording."""
    return V.waveforms(spark, sf_dir).withColumn("tetrode", F.lit(0))


@query()
def pca_features(spark, sf_dir):
    got = features.spike_features(_recording(spark, sf_dir), "tetrode", "spike_id", ["w1", "w2"])
    return got.select("spike_id", *(r6(F.get("features", F.lit(i)), f"f{i}") for i in range(5)))


@query()
def refine_features(spark, sf_dir):
    got = features.spike_features(_recording(spark, sf_dir), "tetrode", "spike_id", ["w1", "w2"])
    rows = got.select("spike_id", *(F.get("features", F.lit(i)).alias(f"f{i}") for i in range(4)))
    return shapes.zscored(rows, [f"f{i}" for i in range(4)]).select("spike_id", *(r6(f"f{i}", f"f{i}") for i in range(4)))


@query()
def feature_lines(spark, sf_dir):
    return features.feature_lines(_recording(spark, sf_dir), "tetrode", "spike_id", ["w1", "w2"])


LIMIT = shapes.chi2_limit(0.99, 2) * 15
BINS = int(LIMIT * 0.25 + 0.5)
CORE = f"""dd as (select spike_id, cluster_id, n, {MAHAL} as d from x join m using (cluster_id)), rk as (select *, row_number() over (partition by cluster_id order by d, spike_id) as rank from dd),
  core as (select cluster_id, a, b from x join (select spike_id from rk where rank <= least(round(0.6 * n), greatest(200, round(0.3 * n)))) using (spike_id)),
  cm as (select cluster_id, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from core group by 1 having count(*) > 2)"""


@query(f"""with {F1}, {XY}, {MOM}, {CORE}, q as (select cm.cluster_id, spike_id, a, b, {MAHAL} as m from x cross join cm), nr as (select * from q where m < {LIMIT!r}::double), e as (select cluster_id, min(m) as lo, max(m) as hi from nr group by 1),
  bn as (select cluster_id, least({BINS - 1}, floor((m - lo) / ((hi - lo) / {BINS})))::int as bin, count(*) as n from nr join e using (cluster_id) where hi > lo group by 1, 2), ends as (select cluster_id, min(bin) as b0, max(bin) as b1 from bn group by 1),
  al as (select cluster_id, unnest(range(b0, b1 + 1))::int as bin, b0, b1 from ends), fl as (select al.*, coalesce(n, 0) as n from al left join bn using (cluster_id, bin)), rd as (select *, least(2, bin - b0, b1 - bin) as r from fl),
  sm as (select p.cluster_id, p.bin, avg(o.n) as s from rd p join rd o on p.cluster_id = o.cluster_id and abs(p.bin - o.bin) <= p.r group by 1, 2), fs as (select cluster_id, list(s order by bin) as f from sm group by 1),
  pv as (select *, list_filter(range(2, len(f)), lambda i: f[i] > f[i - 1] and f[i] >= f[i + 1]) as pk, list_filter(range(2, len(f)), lambda i: f[i] < f[i - 1] and f[i] <= f[i + 1]) as vl from fs),
  st as (select *, case when len(pk) = 0 or (len(vl) > 0 and vl[1] < pk[1]) then 1 else pk[1] end as first from pv), vy as (select cluster_id, list_filter(vl, lambda i: i > first)[1] as valley from st),
  th as (select cluster_id, lo + (valley - 1 + 0.5) * (hi - lo) / {BINS} as t from vy join e using (cluster_id)), ins as (select nr.* from nr join th using (cluster_id) where m < t),
  im as (select cluster_id, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from ins group by 1 having count(*) > 2), od as (select cluster_id, spike_id, {MAHAL} as d from ins join im using (cluster_id)),
  lm as (select cluster_id, median(d) + stddev_samp(d) as limit_ from od group by 1) select cluster_id, spike_id from od join lm using (cluster_id) where d < limit_""")
def expand_cluster(spark, sf_dir):
    rows = _xy(spark, sf_dir)
    own = rows.join(moments.moments(rows, ["cluster_id"], ["a", "b"]), "cluster_id").withColumn("d", moments.mahalanobis_2d("a", "b")).select("cluster_id", "spike_id", "a", "b", "d")
    cores = grading.core_rows(own, "cluster_id", "d", "spike_id").select("cluster_id", "spike_id", "a", "b")
    return sorting.expanded(rows, cores, "cluster_id", "spike_id", ["a", "b"])


@query(f"with {F1}, {XY}, l as (select cluster_id, 'a' as dim, a as v from x union all select cluster_id, 'b', b from x), t as (select * from (with {OVERLAP})) select cluster_id, bool_or(passed) as bad from t group by 1")
def bad_clusters(spark, sf_dir):
    return sorting.bad_clusters(_xy(spark, sf_dir), "cluster_id", ["a", "b"])


@query(f"with {F1}, {XY}, l as (select 0 as cluster_id, 'a' as dim, a as v from x union all select 0, 'b', b from x), t as (select * from (with {OVERLAP})) select dim, passed, good from t")
def dip_dimensions(spark, sf_dir):
    rows = _xy(spark, sf_dir).select(F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("v")) for d in "ab"))))
    return shapes.overlap_test(rows, ["dim"], "v")


_ROUND = "m{0} as (select cluster_id, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from {1} group by 1), d{0} as (select {1}.*, " + MAHAL + " as d from {1} join m{0} using (cluster_id)), l{0} as (select cluster_id, median(d) + 2 * stddev_samp(d) as limit_ from d{0} group by 1), x{0} as (select cluster_id, spike_id, a, b from d{0} join l{0} using (cluster_id) where d < limit_)"


@query(f"with {F1}, {XY}, {_ROUND.format(1, 'x')}, {_ROUND.format(2, 'x1')} select cluster_id, spike_id from x2")
def cleaned_clusters(spark, sf_dir):
    return sorting.cleaned(_xy(spark, sf_dir).select("cluster_id", "spike_id", "a", "b"), "cluster_id", "spike_id", ["a", "b"]).select("cluster_id", "spike_id")


# Thresholds of the four wires; a row is near them if all of its peaks are under 1.5 times theirs.
THRESHOLDS = {"p1": 30, "p2": 50, "p3": 6, "p4": 5}


@query(f"""with {F3}, {BIG}, {OWN}, nt as (select * from big where cluster_id = 'NO' and {' and '.join(f'{x} < 1.5 * {t}' for x, t in THRESHOLDS.items())}), un as ({_moments_sql('nt', 'tetrode')}),
  o as (select tetrode, n as near_n, {_RENAMED.replace('cluster_id as o_cluster_id, ', '')} from un), j as (select * from m join o using (tetrode) where cluster_id <> 'NO' and near_n > 0.5 * n and near_n > 4), {_BHAT} select tetrode, cluster_id, near_n as n_near, round(bhat, 6) as bhat from bh""")
def near_threshold(spark, sf_dir):
    rows = _big(spark, sf_dir)
    near = rows.where("cluster_id = 'NO'")
    for x, t in THRESHOLDS.items():
        near = near.where(F.col(x) < 1.5 * t)
    table = moments.moments(rows.where("cluster_id <> 'NO'"), ["tetrode", "cluster_id"], DIMS)
    pairs = table.join(geometry.named_other(moments.moments(near, ["tetrode"], DIMS), ["tetrode"]), "tetrode").where("o_n > 0.5 * n and o_n > 4")
    return geometry.bhattacharyya(pairs, DIMS).select("tetrode", "cluster_id", F.col("o_n").alias("n_near"), r6("bhat", "bhat"))
