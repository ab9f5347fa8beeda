"""Queries over recordings: record selection, headers, scaling, labels, file tables, and the waveform shapes that need more than one step."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import waveform as W
from ..operators import shapes, steps
from ..operators import trains as T
from ..sources import recordfiles
from ..sources import records as R
from ..sources import views as V
from .catalogue import F1, F2, XY, _xy, query, r6, zscore_detect

# Records: the two-wire waveforms as counts, every fiftieth at time 0; a label stands for a file.
RECORDS = f"""{F1}, r as (select cluster_id as tetrode, spike_id as idx, case when spike_id % 50 = 7 then 0 else ts_us end as ts_us,
  list_transform(w1, lambda x: round(x * 30)::int) as w1, list_transform(w2, lambda x: round(x * 30)::int) as w2 from w)"""


def _records(spark, sf_dir):
    counts = lambda w: F.transform(w, lambda x: F.round(x * 30).cast("int")).alias(w)
    return V.waveforms(spark, sf_dir).select(F.col("cluster_id").alias("tetrode"), F.col("spike_id").alias("idx"), F.when(F.col("spike_id") % 50 == 7, 0).otherwise(F.col("ts_us")).alias("ts_us"), counts("w1"), counts("w2"))


@query(f"""with {RECORDS}, l as (select unnest([5, 3, 99999, 3, 41]) as idx, unnest(range(0, 5)) as ord)
  select 'all' as mode, idx as ord, idx from r union all select 'range', idx, idx from r where idx between 100 and 199 union all select 'list', ord, idx from r join l using (idx)
  union all select 'ts_range', idx, idx from r where ts_us between 1704067200000000 and 1714067200000000 union all select 'ts_list', idx, idx from r where ts_us in (0, 5)""")
def record_modes(spark, sf_dir):
    records, out = _records(spark, sf_dir), None
    for mode, values in (("all", None), ("range", [100, 199]), ("list", [5, 3, 99999, 3, 41]), ("ts_range", [1704067200000000, 1714067200000000]), ("ts_list", [0, 5])):
        one = R.select_records(records, mode, values, ["idx"]).select(F.lit(mode).alias("mode"), "ord", "idx")
        out = one if out is None else out.unionByName(one)
    return out


_FILED = f"""{RECORDS}, f as (select row_number() over (order by idx) as place, ts_us, tetrode as cell, list_sum(list_transform(w1, lambda x, i: x * i))::bigint as m1, list_sum(list_transform(w2, lambda x, i: x * i))::bigint as m2 from r)"""


@query(f"""with {_FILED}, l as (select unnest([5, 3, 99999, 3, 41]) as place, unnest(range(0, 5)) as ord)
  select 'all' as mode, place as ord, * from f union all select 'range', place, * from f where place between 100 and 199 union all select 'list', ord, f.* from f join l using (place)
  union all select 'ts_range', place, * from f where ts_us between 1704067200000000 and 1714067200000000 union all select 'ts_list', place, * from f where ts_us in (0, 5)""")
def record_files(spark, sf_dir):
    """The records as binary files of two wires, read back in each mode."""
    rows = _records(spark, sf_dir).select("idx", "ts_us", F.col("tetrode").cast("int").alias("cell"), F.array("w1", "w2").alias("waves"))
    folder = f"{steps.shared_folder(spark)}/records-{uuid.uuid4().hex}"
    recordfiles.write(rows, folder, "nst", ["idx"], header="######## waveforms\n")
    weighed = lambda i: F.aggregate(F.transform(F.get("waves", F.lit(i)), lambda x, k: x * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = None
    for mode, values in (("all", None), ("range", [100, 199]), ("list", [5, 3, 99999, 3, 41]), ("ts_range", [1704067200000000, 1714067200000000]), ("ts_list", [0, 5])):
        got = recordfiles.read(spark, folder, mode, values, ["idx", "ts_us", "cell", "waves"])
        one = got.select(F.lit(mode).alias("mode"), "ord", F.col("idx").alias("place"), "ts_us", "cell", weighed(0).alias("m1"), weighed(1).alias("m2"))
        out = one if out is None else out.unionByName(one)
    return out


_LINES = """lines as (select s_suppkey as file, unnest(range(0, 6)) as line_no, unnest(['######## header', case when s_suppkey % 3 = 0 then '-Other 1' else '-ADMaxValue ' || (2000 + s_suppkey) end,
    case when s_suppkey % 2 = 0 then '-Other 2' else '-ADBitVolts 0.00000' || (1 + s_suppkey % 9) || ' 0.00000' || (1 + s_suppkey % 7) end, case when s_suppkey % 4 = 1 then '-Other 3' else '-InputRange ' || (100 + s_suppkey) || ' ' || (50 + s_suppkey) end,
    '-ThreshVal ' || (20 + s_suppkey % 5) || ' 31', '-ADMaxValue 7']) as line from supplier)"""


@query(f"""with {_LINES}, s as (select file, min(line_no) as stop from lines where contains(line, 'ThreshVal') group by 1), k as (select * from lines join s using (file) where line_no <= stop),
  v as (select file, any_value(try_cast(string_split(trim(line[13:]), ' ')[1] as double)) filter (where contains(line, 'ADMaxValue')) as a, any_value(list_transform(string_split(trim(line[13:]), ' '), lambda x: try_cast(x as double))) filter (where contains(line, 'ADBitVolts')) as b,
    any_value(list_transform(string_split(trim(line[13:]), ' '), lambda x: try_cast(x as double))) filter (where contains(line, 'InputRange')) as r, any_value(list_transform(string_split(trim(line[12:]), ' '), lambda x: try_cast(x as double))) filter (where contains(line, 'ThreshVal')) as t from k group by 1),
  d as (select file, coalesce(a, 32767) as admax, coalesce(b, list_transform(r, lambda x: x / 1e6 / coalesce(a, 32767)), [6e-9::double]) as bv, r, t from v)
  select file, admax, round(bv[1] * 1e9, 6) as nanovolts, round(coalesce(r, list_transform(bv, lambda x: x * admax * 1e6))[1], 6) as range1, t[2] as threshold2 from d""")
def header_parse(spark, sf_dir):
    k = F.col("s_suppkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    lines = [
        F.lit("######## header"), F.when(k % 3 == 0, "-Other 1").otherwise(text("-ADMaxValue ", k + 2000)),
        F.when(k % 2 == 0, "-Other 2").otherwise(text("-ADBitVolts 0.00000", k % 9 + 1, " 0.00000", k % 7 + 1)),
        F.when(k % 4 == 1, "-Other 3").otherwise(text("-InputRange ", k + 100, " ", k + 50)), text("-ThreshVal ", k % 5 + 20, " 31"), F.lit("-ADMaxValue 7"),
    ]
    got = R.parse_headers(V.table(spark, sf_dir, "supplier").select(k.alias("file"), F.posexplode(F.array(*lines)).alias("line_no", "line")))
    return got.select("file", "admax", r6(F.get("bitvolts", F.lit(0)) * 1e9, "nanovolts"), r6(F.get("input_range", F.lit(0)), "range1"), F.get("threshold", F.lit(1)).alias("threshold2"))


@query(f"""with {RECORDS}, n as (select * from r where ts_us <> 0), f as (select tetrode from n group by 1 having count(*) <= 400000 and count(*) * 1e6 / nullif(max(ts_us) - min(ts_us), 0) <= 250),
  k as (select * from n semi join f using (tetrode)), g as (select * from k where least(list_max(w1), list_max(w2)) < 9000 and greatest(list_min(w1), list_min(w2)) > -9000)
  select tetrode, idx, round(list_max(w1) * 1e-8::double * 1e6, 6) as top1, round(list_min(w2) * 1e-8::double * 1e6, 6) as low2 from g semi join (select tetrode from g group by 1 having count(*) >= 20) using (tetrode)""")
def extract_records(spark, sf_dir):
    good = R.unsaturated(R.within_limits(_records(spark, sf_dir)), ["w1", "w2"], admax=9000, least=20)
    scaled = good.withColumns({w: R.microvolts(F.col(w), 1e-8) for w in ("w1", "w2")})
    return scaled.select("tetrode", "idx", r6(F.array_max("w1"), "top1"), r6(F.array_min("w2"), "low2"))


@query(f"with {F1}, e as (select least(max(greatest(list_max(w1), list_max(w2))) / 32768, -min(least(list_min(w1), list_min(w2))) / 32769) as k from w), c as (select spike_id, list_transform(w1, lambda x: round(x / k)::bigint) as w1, list_transform(w2, lambda x: round(x / k)::bigint) as w2 from w, e) select spike_id, list_sum(w1)::bigint as s1, list_sum(w2)::bigint as s2 from c")
def record_counts(spark, sf_dir):
    return _summed(R.to_counts(V.waveforms(spark, sf_dir), ["w1", "w2"]))


@query(f"with {F1}, e as (select 1.05::double * greatest(max(list_max(w1)) / 32768, -min(list_min(w1)) / 32769) as k1, 1.05::double * greatest(max(list_max(w2)) / 32768, -min(list_min(w2)) / 32769) as k2 from w), c as (select spike_id, list_transform(w1, lambda x: round(x / k1)::bigint) as w1, list_transform(w2, lambda x: round(x / k2)::bigint) as w2 from w, e) select spike_id, list_sum(w1)::bigint as s1, list_sum(w2)::bigint as s2 from c")
def record_counts_per_wire(spark, sf_dir):
    return _summed(R.to_counts(V.waveforms(spark, sf_dir), ["w1", "w2"], per_wire=True))


def _summed(rows):
    total = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("spike_id", total("w1").alias("s1"), total("w2").alias("s2"))


@query("""with m as (select event_id, epoch_us(ts)::double as c0, (user_id % 6)::double as c1, value as c2, (event_id % 3)::double as c3, -1.0::double as c4 from events),
  l as (unpivot m on c0, c1, c2, c3, c4 into name "column" value v), g as (select "column", v - lag(v) over (partition by "column" order by v) as gap from (select distinct "column", v from l)),
  f as (select "column", min(d) as fall from (select "column", v - lag(v) over (partition by "column" order by event_id) as d from l) group by 1),
  s as (select "column", min(v) as lo, max(v) as hi, min(gap) as gap, any_value(fall) as fall from l join (select "column", min(gap) as gap from g group by 1) using ("column") join f using ("column") group by 1 having min(v) >= 0),
  c as (select arg_max("column", (hi, -ascii("column"[2]))) as c from s where lo = hi or gap = 1), t as (select min("column") as t from s, c where "column" <> c and fall >= 0)
  select "column", case when "column" = c then 'cluster' when "column" = t then 'time' end as role from s, c, t""")
def label_columns(spark, sf_dir):
    ts = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    matrix = V.table(spark, sf_dir, "events").select("event_id", ts.alias("c0"), (F.col("user_id") % 6).cast("double").alias("c1"), F.col("value").alias("c2"), (F.col("event_id") % 3).cast("double").alias("c3"), F.lit(-1.0).alias("c4"))
    return R.label_columns(matrix, ["c0", "c1", "c2", "c3", "c4"], "event_id")


@query("select event_type as file, epoch_us(ts) as ts_us, (user_id % 7)::int as cluster_id from events where event_id >= 0")
def file_labels(spark, sf_dir):
    events = V.trains(spark, sf_dir).select(F.col("wire").alias("file"), F.col("event_id").alias("pos"), "ts_us", "unit")
    lines = events.select("file", (F.col("pos") + 1).alias("line_no"), F.concat(F.lit(" "), (F.col("unit") % 7).cast("string")).alias("line"))
    return R.file_labels(lines.union(events.select("file", F.lit(0).cast("long"), F.lit("7")).distinct()), events.drop("unit"))


@query("select s_suppkey as number, 'tt' || lpad(s_suppkey::varchar, 3, '0') || '.clu.0' as labels, 'TT' || p_partkey || '.ntt' as records from supplier join part on s_suppkey = p_partkey where s_suppkey % 3 <> 0 and length(s_suppkey::varchar) <= 3")
def file_pairs(spark, sf_dir):
    labels = V.table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0 and length(s_suppkey) <= 3").select(F.concat(F.lit("tt"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0"), F.lit(".clu.0")).alias("labels"))
    records = V.table(spark, sf_dir, "part").select(F.concat(F.lit("TT"), F.col("p_partkey").cast("string"), F.lit(".ntt")).alias("records"))
    number = lambda c: F.regexp_extract(c, r"(?i)^tt(\d+)", 1).cast("long").alias("number")
    return labels.select(number("labels"), "labels").join(records.select(number("records"), "records"), "number")


_NAMES = """n as (select p_partkey as k, case p_partkey % 6 when 0 then 's' || p_partkey || '_info.mat' when 1 then 's' || (p_partkey - 1) || '_stat.mat' when 2 then 's' || p_partkey || '_coact.mat' when 3 then 's' || p_partkey || '_new.mat' when 4 then 's' || p_partkey || '_info.mat' else 's' || p_partkey || '.mat' end as name from part)"""


@query(f"with {_NAMES}, c as (select k, regexp_extract(name, '^(.*)_(info|stat)\\.mat$', 1) as core, regexp_extract(name, '^(.*)_(info|stat)\\.mat$', 2) as kind from n) select i.core, i.k as info, s.k as stat from c i join c s on i.core = s.core where i.kind = 'info' and s.kind = 'stat' and i.core <> ''")
def info_stat(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda key, end: F.concat(F.lit("s"), key.cast("string"), F.lit(end))
    ends = F.when(k % 6 == 0, name(k, "_info.mat")).when(k % 6 == 1, name(k - 1, "_stat.mat")).when(k % 6 == 2, name(k, "_coact.mat")).when(k % 6 == 3, name(k, "_new.mat")).when(k % 6 == 4, name(k, "_info.mat")).otherwise(name(k, ".mat"))
    names = V.table(spark, sf_dir, "part").select(k.alias("k"), ends.alias("name"))
    kind = names.select("k", F.regexp_extract("name", r"^(.*)_(info|stat)\.mat$", 1).alias("core"), F.regexp_extract("name", r"^(.*)_(info|stat)\.mat$", 2).alias("kind"))
    info, stat = (kind.where(F.col("kind") == x).select("core", F.col("k").alias(x)) for x in ("info", "stat"))
    return info.join(stat, "core")


@query("""with f as (select p_partkey as k, case when p_partkey % 11 = 0 then '.hidden/' else 'session' || p_partkey % 5 || '/' end || 'tt' || p_partkey || case when p_partkey % 4 = 0 then '.NTT' when p_partkey % 4 = 1 then '.txt' else '.ntt' end as path from part),
  d as (select 'session' || s_suppkey % 5 || '/tt' || s_suppkey || '.ntt' as path from supplier where s_suppkey % 2 = 0)
  select path from f where lower(path) like '%.ntt' and path not like '.%' and path not like '%/.%' and path not in (select path from d)""")
def pending_files(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    folder = F.when(k % 11 == 0, ".hidden/").otherwise(F.concat(F.lit("session"), (k % 5).cast("string"), F.lit("/")))
    ending = F.when(k % 4 == 0, ".NTT").when(k % 4 == 1, ".txt").otherwise(".ntt")
    files = V.table(spark, sf_dir, "part").select(F.concat(folder, F.lit("tt"), k.cast("string"), ending).alias("path"))
    done = V.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("session"), (s % 5).cast("string"), F.lit("/tt"), s.cast("string"), F.lit(".ntt")).alias("path"))
    return shapes.pending(files, done)


@query("select event_type as channel, event_id, round(value * -1, 6) as v from events where event_type in ('click', 'view') and epoch_us(ts) between (select min(epoch_us(ts)) from events) + 3600000000 and (select min(epoch_us(ts)) from events) + 360000000000")
def trace_slice(spark, sf_dir):
    train = V.trains(spark, sf_dir)
    start = train.agg(F.min("ts_us").alias("t0"))  # one row
    rows = train.where(F.col("wire").isin("click", "view")).crossJoin(start).where(F.col("ts_us").between(F.col("t0") + 3_600_000_000, F.col("t0") + 360_000_000_000))
    return rows.select(F.col("wire").alias("channel"), "event_id", r6(F.col("amplitude") * -1, "v"))


@query(f"with {F2} select event_id, round(ts_us / 1e6 * 1e3)::bigint as ms from t")
def round_times(spark, sf_dir):
    return V.trains(spark, sf_dir).select("event_id", F.round(F.col("ts_us") / 1e6 * 1e3).cast("long").alias("ms"))


_DETECTED = f"""{F2}, z as (select wire, event_id, ts_us, (amplitude - avg(amplitude) over (partition by wire)) / stddev_samp(amplitude) over (partition by wire) as z from t),
  nb as (select *, lag(z) over (partition by wire order by ts_us, event_id) as a, lead(z) over (partition by wire order by ts_us, event_id) as b from z),
  det as (select wire, event_id, round(z, 6) as z from nb where z >= 3 and z > coalesce(a, '-infinity') and z >= coalesce(b, '-infinity'))"""


@query(f"with {_DETECTED} select wire as channel, event_id as peak, greatest(event_id - 30, (select min(event_id) from events)) as begin_, least(event_id + 30, (select max(event_id) from events)) as end_ from det")
def spike_windows(spark, sf_dir):
    ends = V.table(spark, sf_dir, "events").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return zscore_detect(spark, sf_dir).crossJoin(ends).select(F.col("wire").alias("channel"), F.col("event_id").alias("peak"), F.greatest(F.col("event_id") - 30, F.col("lo")).alias("begin_"), F.least(F.col("event_id") + 30, F.col("hi")).alias("end_"))


@query("""with g as (select r, c from range(1, 96) a(r), range(1, 4) b(c)), tm as (select (r - 1) * 3 + c as tetrode, case pos when 1 then r + 96 * (c - 1) when 2 then r + 1 + 96 * (c - 1) when 3 then r + 96 * c else r + 1 + 96 * c end as channel from g, range(1, 5) x(pos))
  select tetrode, count(*) as n_spikes, count(distinct channel) as n_channels from tm join (select event_id, user_id % 384 + 1 as channel from events) using (channel) group by 1""")
def tetrode_spikes(spark, sf_dir):
    spikes = V.trains(spark, sf_dir).select("event_id", (F.col("unit") % 384 + 1).alias("channel"))
    return V.tetrode_map(spark).join(spikes, "channel").groupBy("tetrode").agg(F.count("*").alias("n_spikes"), F.countDistinct("channel").alias("n_channels"))


@query("""with m as (select o_orderkey as item, 'S' || o_orderstatus as k from orders union all select o_orderkey, 'P' || o_orderpriority[1] from orders union all select o_orderkey, 'X' from orders where o_custkey % 3 = 0), s as (select k, count(*) as n from m group by 1)
  select a.k as a, b.k as b, count(*) as common, count(*) > 0.65 * least(any_value(sa.n), any_value(sb.n)) as merge_ from m a join m b on a.item = b.item and a.k < b.k join s sa on sa.k = a.k join s sb on sb.k = b.k group by 1, 2""")
def overlap_pairs(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    item = F.col("o_orderkey").alias("item")
    members = orders.select(item, F.concat(F.lit("S"), "o_orderstatus").alias("k")).union(orders.select(item, F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)))).union(orders.where("o_custkey % 3 = 0").select(item, F.lit("X")))
    return shapes.overlapping(members, "k", "item", 0.65).select("a", "b", "common", F.col("merge").alias("merge_"))


@query("""with l as (select o_orderkey as label_id, o_orderkey % 4 as id, epoch_us(o_orderdate) - epoch_us(min(o_orderdate) over ()) + (select epoch_us(min(ts)) from events) + o_orderkey * 997000 % 86400000000 as ts_us from orders),
  j as (select label_id, id, event_id, epoch_us(ts) as ev, abs(epoch_us(ts) - ts_us) as distance from l join events on epoch_us(ts) > ts_us - 60000000 and epoch_us(ts) < ts_us + 60000000 where id > 0)
  select id as cluster_id, label_id, arg_min(event_id, (distance, ev, event_id)) as event_id from j group by 1, 2""")
def clusters_from_output(spark, sf_dir):
    events = V.trains(spark, sf_dir)
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"))
    starts = orders.agg(F.min("day").alias("d0")).crossJoin(events.agg(F.min("ts_us").alias("t0")))
    labels = orders.crossJoin(starts).select(F.col("o_orderkey").alias("label_id"), (F.col("o_orderkey") % 4).alias("cluster_id"), (F.col("day") - F.col("d0") + F.col("t0") + F.col("o_orderkey") * 997000 % 86400000000).alias("ts_us"))
    named = labels.where("cluster_id > 0")
    return T.nearest(named.select("label_id", "ts_us"), events, tolerance_us=60_000_000).join(named.select("label_id", "cluster_id"), "label_id").select("cluster_id", "label_id", "event_id")


# -- shapes ------------------------------------------------------------------------------------------


@query(f"""with {F1}, k as (select spike_id, wire, list_transform(range(0, 24), lambda j: j * (19::double / 23)) as spots, wf from ww), v as (select spike_id, wire, list_transform(spots, lambda p: wf[floor(p)::int + 1] + (wf[least(floor(p)::int + 2, 32)] - wf[floor(p)::int + 1]) * (p - floor(p))) as wf from k)
  select spike_id, wire, unnest(range(0, 24)) as pos, round(unnest(wf), 6) as v from v""")
def downsample(spark, sf_dir):
    rows = V.wires(V.waveforms(spark, sf_dir)).withColumn("wf", W.resample(F.col("wf"), 24, last=19))
    return rows.select("spike_id", "wire", F.posexplode("wf").alias("pos", "v")).select("spike_id", "wire", F.col("pos").cast("long").alias("pos"), r6("v", "v"))


# Threshold 100 and input range 400 stand for the wires' own.
REP = """p as (select *, case when list_max(w1) >= 399.9 then '-infinity'::double else list_max(w1) end as t1, case when list_max(w2) >= 399.9 then '-infinity'::double else list_max(w2) end as t2, list_position(w1, list_max(w1)) as i1, list_position(w2, list_max(w2)) as i2 from {source}),
  b as (select *, case when t1 >= t2 then w1 else w2 end as r, case when t1 >= t2 then i1 else i2 end as ri, case when t1 >= t2 then i2 else i1 end as oi, case when t1 >= t2 then t2 else t1 end as ot, case when t1 >= t2 then 1 else 2 end as first from p),
  c as (select *, list_max(list_filter(range(2, 32), lambda i: r[i] < r[i - 1] and r[i] <= r[i + 1] and i < ri)) as valley from b),
  rep as (select spike_id, cluster_id, w1, w2, case when valley is not null and ot >= 99.9 and abs(oi - valley) <= 2 then 3 - first else first end as wire from c)"""


def _rep(frame) -> Column:
    return shapes.rep_wire(["w1", "w2"], thresholds=[100.0, 100.0], ranges=[400.0, 400.0])


@query(f"with {F1}, {REP.format(source='w')} select spike_id, wire from rep")
def rep_wire(spark, sf_dir):
    frame = V.waveforms(spark, sf_dir)
    return frame.select("spike_id", _rep(frame).alias("wire"))


PEAKS_AT = """pa as (select *, list_position(case wire when 1 then w1 else w2 end, list_max(case wire when 1 then w1 else w2 end)) as i from rep),
  pk as (select spike_id, list_max(w1[greatest(1, i - 8):least(32, i + 8)]) as p1, list_max(w2[greatest(1, i - 8):least(32, i + 8)]) as p2 from pa)"""


@query(f"with {F1}, {REP.format(source='w')}, {PEAKS_AT} select spike_id, round(p1, 6) as p1, round(p2, 6) as p2 from pk")
def peaks_near_rep(spark, sf_dir):
    frame = V.waveforms(spark, sf_dir)
    return frame.withColumn("wire", _rep(frame)).select("spike_id", *(r6(p, f"p{i + 1}") for i, p in enumerate(shapes.peaks_near(["w1", "w2"], "wire", 8))))


SNR = f"""{F1}, mo as (select wire, arg_min(place, (-n, place)) as place from (select wire, list_position(wf, list_max(wf)) as place, count(*) as n from ww group by 1, 2) group by wire),
  neg as (select spike_id, cluster_id, list_transform(w1, lambda x: -x) as w1, list_transform(w2, lambda x: -x) as w2 from w), {REP.format(source='neg')}, {PEAKS_AT},
  su as (select spike_id, w.w1[(select place from mo where wire = 1)] + p1 as s1, w.w2[(select place from mo where wire = 2)] + p2 as s2 from w join pk using (spike_id)),
  zz as (select spike_id, greatest((s1 - avg(s1) over ()) / stddev_samp(s1) over (), (s2 - avg(s2) over ()) / stddev_samp(s2) over ()) as m from su),
  snr as (select spike_id, (m - avg(m) over ()) / stddev_samp(m) over () as score from zz)"""


def _snr(spark, sf_dir):
    frame = V.waveforms(spark, sf_dir)
    places = frame.agg(*(F.mode(W.first_argmax(F.col(w)), True).alias(f"place_{w}") for w in ("w1", "w2")))  # one row
    turned = frame.select("spike_id", *(F.transform(w, lambda x: -x).alias(w) for w in ("w1", "w2")))
    valleys = turned.withColumn("wire", _rep(turned)).select("spike_id", *(v.alias(f"v{i + 1}") for i, v in enumerate(shapes.peaks_near(["w1", "w2"], "wire", 8))))
    sums = frame.crossJoin(places).join(valleys, "spike_id").select("spike_id", *((F.get(f"w{i}", F.col(f"place_w{i}")) + F.col(f"v{i}")).alias(f"s{i}") for i in (1, 2)))
    best = shapes.zscored(sums, ["s1", "s2"]).select("spike_id", F.greatest("s1", "s2").alias("score"))
    return shapes.zscored(best, ["score"])


@query(f"with {SNR} select spike_id, round(score, 6) as score from snr")
def snr_statistic(spark, sf_dir):
    return _snr(spark, sf_dir).select("spike_id", r6("score", "score"))


@query(f"""with {SNR}, t as (select 1 as pass, 2.0::double as t union all select 2, 4.0::double / 3 union all select 3, 2.0::double / 3 union all select 4, 0.0::double), k as (select pass, spike_id from snr, t where score > t),
  g as (select pass from k group by 1 having count(*) >= 60) select pass::int as pass, spike_id from k semi join g using (pass) union all select 5, spike_id from snr""")
def snr_passes(spark, sf_dir):
    return shapes.passes(_snr(spark, sf_dir), "score", n_passes=5, least=60, least_rows=100).select("pass", "spike_id")


@query(f"""with {F1}, e as (select spike_id, wire, wf, list_filter(range(2, 32), lambda i: wf[i] > wf[i - 1] and wf[i] >= wf[i + 1]) as pk, list_filter(range(2, 32), lambda i: wf[i] < wf[i - 1] and wf[i] <= wf[i + 1]) as vl from ww),
  s as (select *, case when len(pk) = 0 or (len(vl) > 0 and vl[1] < pk[1]) then 1 else pk[1] end as first from e), c as (select *, list_filter(vl, lambda i: i > first)[1:3] as cand from s)
  select spike_id, wire, coalesce(list_filter(cand, lambda i: wf[i] < -50 and list_max(pk) > i)[1], 0)::int as valley, first::int as peak from c""")
def first_valley(spark, sf_dir):
    rows = V.wires(V.waveforms(spark, sf_dir))
    got = rows.select("spike_id", "wire", shapes.first_valley("wf", -50.0).alias("x"))
    return got.select("spike_id", "wire", "x.valley", "x.peak")


@query(f"""with {F2}, d as (select unit, floor(amplitude / 5)::bigint as bin, count(*) as n from t group by 1, 2), s as (select unit, min(bin) as lo, max(bin) as hi from d group by 1), a as (select unit, unnest(range(lo, hi + 1)) as bin, lo, hi from s),
  f as (select a.*, coalesce(n, 0) as n from a left join d using (unit, bin)), g as (select f.unit, f.bin, least(2, f.bin - f.lo, f.hi - f.bin) as r, f.n from f)
  select g.unit, g.bin, round(avg(o.n), 6) as smooth from g join g o on g.unit = o.unit and abs(g.bin - o.bin) <= g.r group by 1, 2""")
def smoothed_counts(spark, sf_dir):
    counts = V.trains(spark, sf_dir).groupBy("unit", F.floor(F.col("amplitude") / 5).alias("bin")).agg(F.count("*").alias("n"))
    return shapes.smoothed(counts, "unit", "bin", "n").select("unit", "bin", r6("smooth", "smooth"))


@query(f"with {F1}, {XY} select cluster_id, spike_id, row_number() over (partition by cluster_id order by a desc, spike_id) as place from x qualify place <= 5 union all select -1, spike_id, row_number() over (order by ts_us, cluster_id, spike_id) as place from x qualify place <= 10")
def ordered_rows(spark, sf_dir):
    rows = _xy(spark, sf_dir)
    top = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("a").desc(), "spike_id"))
    best = rows.withColumn("place", top).where("place <= 5").select("cluster_id", "spike_id", F.col("place").cast("long").alias("place"))
    first = rows.orderBy("ts_us", "cluster_id", "spike_id").limit(10)  # a top-k report
    first = first.withColumn("place", F.row_number().over(Window.orderBy("ts_us", "cluster_id", "spike_id"))).select(F.lit(-1).alias("cluster_id"), "spike_id", F.col("place").cast("long").alias("place"))
    return best.union(first)


_GRID = ", ".join(f"{{'i': {i}, 'f': sum(exp(-(((v - (lo + {i} * (hi - lo) / 99)) / h) ** 2) / 2)) / any_value(n * h * 2.5066282746310002::double), 'x': any_value(lo + {i} * (hi - lo) / 99)}}" for i in range(100))


# Kernel densities of the values ``l`` (cluster_id, dim, v) and what the test finds in them.
OVERLAP = f"""z as (select cluster_id, dim, (v - avg(v) over w) / stddev_samp(v) over w as v, count(*) over w as n from l window w as (partition by cluster_id, dim)),
  e as (select cluster_id, dim, v, n, 0.75::double * pow(4 / (3.0::double * n), 0.2::double) as h from z), k as (select *, min(v) over w - 3 * h as lo, max(v) over w + 3 * h as hi from e window w as (partition by cluster_id, dim)),
  g as (select cluster_id, dim, any_value(n) as n, list_transform([{_GRID}], lambda q: q.f) as f, any_value(lo) as lo, any_value(hi) as hi from k group by 1, 2),
  p as (select *, list_filter(range(2, 100), lambda i: f[i] > f[i - 1] and f[i] >= f[i + 1]) as pk, list_filter(range(2, 100), lambda i: f[i] < f[i - 1] and f[i] <= f[i + 1]) as vl from g),
  u as (select cluster_id, dim, n, lo, hi, f, pk, unnest(vl) as valley from p), m as (select *, f[valley] as val, list_max(list_transform(list_filter(pk, lambda i: i < valley), lambda i: f[i])) as before_, list_max(list_transform(list_filter(pk, lambda i: i > valley), lambda i: f[i])) as after_, lo + (valley - 1) * (hi - lo) / 99 as x from u),
  c as (select m.cluster_id, m.dim, valley, any_value(val) as val, any_value(before_) as before_, any_value(after_) as after_, any_value(m.n) as n, sum((k.v < m.x)::int) as below_, sum((k.v > m.x)::int) as above_ from m join k on m.cluster_id = k.cluster_id and m.dim = k.dim where before_ is not null and after_ is not null group by 1, 2, 3),
  s as (select *, val < 0.75 * greatest(before_, after_) and case when before_ <= after_ then below_ else above_ end > least(0.25 * n, 500) as hit, val < 0.35 * greatest(before_, after_) or (least(before_, after_) > 0.7 * greatest(before_, after_) and val < 0.7 * greatest(before_, after_)) as fine from c),
  r as (select cluster_id, dim, arg_min(fine, valley) as fine from s where hit group by 1, 2)
  select g.cluster_id, g.dim, r.fine is not null as passed, coalesce(r.fine, false) as good from g left join r using (cluster_id, dim)"""


@query(f"with {F1}, {XY}, l as (select cluster_id, 'a' as dim, a as v from x union all select cluster_id, 'b', b from x), {OVERLAP}")
def overlap_test(spark, sf_dir):
    rows = _xy(spark, sf_dir).select("cluster_id", F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("v")) for d in "ab"))))
    return shapes.overlap_test(rows, ["cluster_id", "dim"], "v")


@query(f"with {F1}, {XY} select ts_us / 1e6 as ts_s, max(cluster_id) as cluster_id, len(any_value(list_concat(w1, w2))) as n_samples, round(list_sum(any_value(list_concat(w1, w2))), 6) as total from w where cluster_id > 0 group by spike_id, ts_us")
def output_rows(spark, sf_dir):
    rows = V.waveforms(spark, sf_dir).where("cluster_id > 0")
    got = shapes.output_rows(rows, "spike_id", "ts_us", "cluster_id", ["w1", "w2"])
    return got.select("ts_s", "cluster_id", F.size("wf").cast("long").alias("n_samples"), r6(F.aggregate("wf", F.lit(0.0), lambda a, x: a + x), "total"))


@query(f"""with {F1}, {XY}, m as (select cluster_id, avg(a) as ma, avg(b) as mb, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(b, b) as bb from x where spike_id % 5 <> 0 group by 1),
  d as (select x.cluster_id as own, x.spike_id, m.cluster_id, (bb * (a - ma) ** 2 - 2 * ab * (a - ma) * (b - mb) + aa * (b - mb) ** 2) / (aa * bb - ab * ab) as d from x, m), l as (select cluster_id, median(d) + 2.5 * stddev_samp(d) as limit_ from d where own = cluster_id and spike_id % 5 <> 0 group by 1)
  select spike_id, coalesce(max(cluster_id) filter (where d < limit_), 0)::int as cluster_id from d join l using (cluster_id) where spike_id % 5 = 0 group by 1""")
def classify_new(spark, sf_dir):
    rows = _xy(spark, sf_dir)
    return shapes.classified(rows.where("spike_id % 5 <> 0"), rows.where("spike_id % 5 = 0").drop("cluster_id"), "cluster_id", "spike_id", ["a", "b"], n_std=2.5).select("spike_id", "cluster_id")
