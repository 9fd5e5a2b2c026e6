"""Series, streaming twins, graphs, splits, vectors and array operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import arrays as R
from quern.functions import physics as P
from quern.functions import text as T
from quern.operators import graph as G
from quern.operators import images as I
from quern.operators import quantiles as Q
from quern.operators import series as Z
from quern.operators import splits as X
from quern.operators import stats as S
from quern.operators import vectors as V

from .registry import Tables, query

r6 = lambda c, name: F.round(c, 6).alias(name)

PANEL = "(select user_id as station, ts::date::varchar as day, avg(value) as q, count(*)::double as h from events group by all)"


def panel(t: Tables):
    return t.events.groupBy(
        F.col("user_id").alias("station"),
        F.to_date("ts").cast("string").alias("day"),
    ).agg(F.avg("value").alias("q"), F.count("*").cast("double").alias("h"))


WINDOWS = f"""(select * from (
  select station, day as start, list([q, h]) over a as x, list(q) over b as y from {PANEL}
  window a as (partition by station order by day rows between current row and 9 following), b as (partition by station order by day rows between 10 following and 12 following)) where len(x) = 10 and len(y) = 3)"""


def windows(t: Tables):
    return Z.sliding(panel(t), "station", "day", ["q", "h"], "q", 10, 3)


@query(
    "windows",
    f"select station, start, round(x[1][1], 6) as x_first, round(x[10][1], 6) as x_last, round(y[1], 6) as y_first, round(y[3], 6) as y_last from "
    f"{WINDOWS}",
)
def windows_query(t: Tables):
    x, y = F.col("x"), F.col("y")
    return windows(t).select("station", "start", r6(x[0][0], "x_first"), r6(x[9][0], "x_last"), r6(y[0], "y_first"), r6(y[2], "y_last"))


@query(
    "window_mean",
    f"select station, start, round(list_sum(list_transform(x, lambda r: r[1])) / 10, 6) as q, round(list_sum(list_transform(x, lambda r: r[2])) / "
    f"10, 6) as h from {WINDOWS}",
)
def window_mean(t: Tables):
    return windows(t).select("station", "start", r6(Z.mean_row(F.col("x"), 0), "q"), r6(Z.mean_row(F.col("x"), 1), "h"))


@query(
    "standardize",
    f"select station, day, round((q - (select avg(q) from {PANEL})) / (select stddev_pop(q) from {PANEL}), 5) as q, round((h - (select avg(h) from "
    f"{PANEL})) / (select stddev_pop(h) from {PANEL}), 5) as h from {PANEL}",
)
def standardize(t: Tables):
    return S.standardize(panel(t), ["q", "h"]).select("station", "day", F.round("q", 5).alias("q"), F.round("h", 5).alias("h"))


FORECAST = f"(select q as obs, lag(q) over (partition by station order by day) as pred from {PANEL})"


def forecast(t: Tables):
    """Yesterday's value as today's forecast."""
    return panel(t).withColumn(
        "pred",
        F.lag("q").over(Window.partitionBy("station").orderBy("day")),
    ).where("pred is not null").withColumnRenamed("q", "obs")


@query(
    "nse_metrics",
    f"select round(avg((obs - pred) ** 2), 6) as mse, round(avg(abs(obs - pred)), 6) as mae, round(sqrt(avg((obs - pred) ** 2)), 6) as rmse, "
    f"round(1 - sum((obs - pred) ** 2) / (var_pop(obs) * count(*)), 6) as nse from {FORECAST} where pred is not null",
)
def nse_metrics(t: Tables):
    out = forecast(t).agg(*Z.metrics("obs", "pred"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("hydro_loss", f"""
with f as (select * from {FORECAST} where pred is not null), c as (select quantile_cont(obs, 0.9) as hi, quantile_cont(obs, 0.1) as lo from f),
p as (select avg((pred - obs) ** 2) as mse, avg((pred - obs) ** 2) filter (obs > hi) as peak, avg(pred - obs) filter (obs < lo) ** 2 as low from f, c)
select round(mse, 5) as mse, round(peak, 5) as peak, round(low, 5) as low, round(mse + 0.5 * peak + 0.2 * low, 5) as total from p""")
def hydro_loss(t: Tables):
    out = Z.flow_loss(forecast(t), "obs", "pred")
    return out.select(*[F.round(c, 5).alias(c) for c in ("mse", "peak", "low", "total")])


def _steps(t: Tables):
    return panel(t).groupBy("station").agg(
        F.array_sort(
            F.collect_list(F.struct(F.datediff("day", F.lit("2024-01-01")).cast("long").alias("step"), F.col("q").alias("val")))
        ).alias("steps")
    )


EARLY = f"""
with recursive s as (select station, date_diff('day', date '2024-01-01', day::date) as step, q as val, row_number() over (partition by station order by day) as n from {PANEL}),
walk as (
  select station, 0::bigint as n, 'infinity'::double as best, 0 as bad, null::bigint as stop from (select distinct station from s)
  union all
  select w.station, s.n, case when w.stop is not null then w.best when s.val < w.best - 0.5 then s.val else w.best end,
    case when w.stop is not null then w.bad when s.val < w.best - 0.5 then 0 else w.bad + 1 end,
    case when w.stop is not null then w.stop when s.val >= w.best - 0.5 and w.bad + 1 >= 3 then s.step end
  from walk w join s on s.station = w.station and s.n = w.n + 1)
select station, round(arg_max(best, n), 6) as best, max(stop) as stop from walk group by station"""


@query("early_stop", EARLY)
def early_stop(t: Tables):
    out = _steps(t).select("station", Z.early_stop(F.col("steps"), 3, 0.5).alias("e"))
    return out.select("station", r6(F.col("e.best"), "best"), "e.stop")


@query("early_stop_stream", EARLY)
def early_stop_stream(t: Tables):
    """The same by a stateful stream over files of steps that come one by one and in no order: lateness is the span of all steps."""
    from quern.plans.ship import ship
    from quern.sources.shared import fresh
    from quern.streaming.patience import stopped

    ship(t.spark)
    path = fresh(t.spark, "steps")
    steps = panel(t).select("station", F.to_timestamp("day").alias("ts"), F.datediff("day", F.lit("2024-01-01")).alias("step"), F.col("q").alias("val"))
    steps.repartition(3, F.xxhash64("station", "step")).write.parquet(path)
    back = t.spark.read.parquet(path)
    span = back.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    rows = t.spark.readStream.schema(back.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stopped(rows, 3, 0.5, f"{span + 1} days").select("station", r6(F.col("best"), "best"), "stop")


@query(
    "running_best",
    f"select station, day, q < coalesce(min(q) over (partition by station order by day rows between unbounded preceding and 1 preceding), "
    f"'infinity'::double) as new_best from {PANEL}",
)
def running_best(t: Tables):
    """By means that are summed in order of events, as ties of days would else hang on how rows are parted."""
    before = Window.partitionBy("station").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    events = t.events.select(F.col("user_id").alias("station"), F.to_date("ts").cast("string").alias("day"), "event_id", "value")
    return Z.means_in_order(events, ["station", "day"], "event_id", "value", "q").select("station", "day", (F.col("q") < F.coalesce(F.min("q").over(before), F.lit(float("inf")))).alias("new_best"))


@query("log_steps", f"select station, day from (select *, row_number() over (partition by station order by day) as n from {PANEL}) where n % 5 = 0")
def log_steps(t: Tables):
    kept = _steps(t).select("station", F.explode(Z.every_kth(F.col("steps"), 5)).alias("s"))
    return kept.select("station", F.date_add(F.lit("2024-01-01").cast("date"), F.col("s.step").cast("int")).cast("string").alias("day"))


DAILY = (
    "select event_type, date_trunc('day', ts) as day, round(avg(value), 6) as mean, min(value) as min, max(value) as max, count(*) as n from "
    "events group by 1, 2"
)


@query("daily_rollup", DAILY)
def daily_rollup(t: Tables):
    from quern.streaming.rollup import rollup

    return rollup(t.events).withColumn("mean", F.round("mean", 6))


@query("daily_rollup_stream", DAILY)
def daily_rollup_stream(t: Tables):
    """The same by Structured Streaming over the files that are there, with a watermark and its state in the shared folder."""
    from quern.streaming.rollup import streamed

    return streamed(t.spark, t.folder, "events").withColumn("mean", F.round("mean", 6))


MONTHLY = DAILY.replace("'day', ts) as day", "'month', ts) as month")


@query("monthly_rollup", MONTHLY)
def monthly_rollup(t: Tables):
    from quern.streaming.rollup import rollup

    return rollup(t.events, "month").withColumn("mean", F.round("mean", 6))


@query("monthly_rollup_stream", MONTHLY)
def monthly_rollup_stream(t: Tables):
    from quern.streaming.rollup import streamed

    return streamed(t.spark, t.folder, "events", "month").withColumn("mean", F.round("mean", 6))


@query(
    "chrono_split",
    "select event_id, case when n <= floor(c * 0.7) then 'train' when n <= floor(c * 0.7) + floor(c * 0.15) then 'val' else 'test' end as split "
    "from (select event_id, row_number() over (order by ts, event_id) as n, count(*) over () as c from events)",
)
def chrono_split(t: Tables):
    return X.chronological(t.events.select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "split")


@query("synthetic_panel", """
with days as (select unnest(range(0, date_diff('day', a, b) + 1))::int as t, a from (select min(ts)::date as a, max(ts)::date as b from events)),
grid as (select s_suppkey as s, t, a, s_suppkey::bigint * 100000 + t as i from supplier cross join days),
u as (select *, list_transform([1, 2, 3, 4, 5], lambda k: (('0x' || substr(md5(i || '|42|' || k), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) as u from grid),
w as (select *, -ln(u[1]) * 3 as rain, sqrt(-2 * ln(u[2])) * cos(2 * pi() * u[3]) as n1, sqrt(-2 * ln(u[4])) * cos(2 * pi() * u[5]) as n2, sin(2 * pi() * t / 365.25) as wave from u),
f as (select *, greatest(0.1, 5 + s * 0.5 + 3 * wave + 0.4 * rain + 0.3 * n1) as flow from w)
select s as station_id, (a + t)::varchar as day, round(flow, 6) as q, round(0.3 + 0.08 * flow ** 0.6, 6) as h, round(rain, 6) as rain, round(12 - 8 * wave + n2, 6) as temperature from f""")
def synthetic_panel(t: Tables):
    """Every supplier a station, on every day of the events: seasonal flow, exponential rain, noise; the draws follow from the row and a seed."""
    from quern.sources.generate import river_panel

    p = river_panel(t.supplier.select(F.col("s_suppkey").alias("station_id")), t.events.select(F.to_date("ts").alias("date")))
    return p.select(
        "station_id",
        F.col("date").cast("string").alias("day"),
        r6(F.col("Q"), "q"),
        r6(F.col("H"), "h"),
        r6(F.col("PRELIQ_Q"), "rain"),
        r6(F.col("T_Q"), "temperature"),
    )


# Graph nodes out of embeddings: position, elevation, karst share, area, slope.
NODES = (
    "(select vec_id as id, embedding[1]::double * 200 as x, embedding[2]::double * 200 as y, 500 + embedding[3]::double * 1000 as elevation, "
    "least(1, abs(embedding[4]::double) * 4) as karst, 10 + abs(embedding[5]::double) * 1000 as area, 0.001 + abs(embedding[6]::double) / 10 as "
    "slope from embeddings)"
)


def nodes(t: Tables):
    e = lambda k: F.col("embedding")[k].cast("double")
    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        (e(0) * 200).alias("x"),
        (e(1) * 200).alias("y"),
        (500 + e(2) * 1000).alias("elevation"),
        F.least(F.lit(1.0), F.abs(e(3)) * 4).alias("karst"),
        (10 + F.abs(e(4)) * 1000).alias("area"),
        (0.001 + F.abs(e(5)) / 10).alias("slope"),
    )


DIST = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"
RIVER = (
    f"(select a.id as src, b.id as dst, a.area, a.slope as own_slope, {DIST} as distance, (a.elevation - b.elevation) / ({DIST} * 1000) as slope "
    f"from {NODES} a join {NODES} b on a.id <> b.id and {DIST} < 5 and b.elevation < a.elevation where (a.elevation - b.elevation) / ({DIST} * "
    f"1000) between 0.0001000000001 and 0.0999999999)"
)
KARST = (
    f"(select a.id as src, b.id as dst, {DIST} as distance, a.karst as ka, b.karst as kb, a.elevation as ea, b.elevation as eb from {NODES} a join "
    f"{NODES} b on a.id <> b.id and a.karst > 0.4 and b.karst > 0.4 and {DIST} < 3.5)"
)


@query("river_edges", f"select src, dst, round(distance, 5) as distance, round(slope, 6) as slope from {RIVER}")
def river_edges(t: Tables):
    return G.river(nodes(t), 5.0).select(
        F.col("a_id").alias("src"),
        F.col("b_id").alias("dst"),
        F.round("distance", 5).alias("distance"),
        r6(F.col("slope"), "slope"),
    )


@query(
    "river_edges_once",
    f"select a.id as src, b.id as dst from {NODES} a join {NODES} b on a.id < b.id and {DIST} < 5 and b.elevation < a.elevation",
)
def river_edges_once(t: Tables):
    return G.river(nodes(t), 5.0, once=True).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))


@query("karst_edges", f"select src, dst, round(distance, 5) as distance from {KARST}")
def karst_edges(t: Tables):
    return G.karst(nodes(t), 3.5, 0.4).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.round("distance", 5).alias("distance"))


@query("manning", f"""select src, dst, round(v, 6) as velocity, round(distance * 1000 / v / 3600, 5) as hours, round(1000 * 9.81 * 0.5 * area ** 0.8 * slope, 4) as power
from (select *, (1 / 0.035) * (0.3 * (0.5 * area ** 0.8) ** 0.4) ** (2.0 / 3.0) * sqrt(slope) as v from {RIVER})""")
def manning(t: Tables):
    e = G.river(nodes(t), 5.0)
    v = P.manning_velocity(F.col("a_area"), F.lit(0.035), F.col("slope"))
    return e.select(
        F.col("a_id").alias("src"),
        F.col("b_id").alias("dst"),
        r6(v, "velocity"),
        F.round(P.travel_hours(F.col("distance") * 1000, v), 5).alias("hours"),
        F.round(P.stream_power(F.col("a_area"), F.col("slope")), 4).alias("power"),
    )


@query("darcy", f"""select src, dst, round(k * 1e6, 6) as conductivity, round(area, 6) as area, round(k * area * g * 1e9, 6) as flux
from (select src, dst, (1e-5 * (1 + 100 * ka * ka) + 1e-5 * (1 + 100 * kb * kb)) / 2 as k, pi() * (0.5 * least(ka, kb)) * (0.5 * least(ka, kb)) as area, abs(ea - eb) / (distance * 1000) as g from {KARST})""")
def darcy(t: Tables):
    e = G.karst(nodes(t), 3.5, 0.4)
    k = (P.conductivity(F.col("a_karst")) + P.conductivity(F.col("b_karst"))) / 2
    area = P.conduit(F.col("a_karst"), F.col("b_karst"))
    g = F.abs(F.col("a_elevation") - F.col("b_elevation")) / (F.col("distance") * 1000)
    return e.select(
        F.col("a_id").alias("src"),
        F.col("b_id").alias("dst"),
        r6(k * 1e6, "conductivity"),
        r6(area, "area"),
        r6(k * area * g * 1e9, "flux"),
    )


@query(
    "wetness",
    f"select id, round(ln(area / (tan(slope) + 1e-6)), 6) as twi, greatest(1, least(7, ceil(log2(area / 10)))) as stream_order, round(0.01 + 0.2 * "
    f"karst, 6) as porosity, round(0.3 + 0.08 * area ** 0.6, 6) as rating, round(sin(2 * pi() * (id % 365) / 365.25), 6) as season from {NODES}",
)
def wetness(t: Tables):
    a, k = F.col("area"), F.col("karst")
    return nodes(t).select(
        "id",
        r6(P.wetness(a, F.col("slope")), "twi"),
        P.stream_order(a).alias("stream_order"),
        r6(P.porosity(k), "porosity"),
        r6(P.rating(a), "rating"),
        r6(P.seasonal(F.col("id") % 365), "season"),
    )


@query("degree", f"select id, count(src) as in_degree from {NODES} n left join {RIVER} r on n.id = r.dst group by id")
def degree(t: Tables):
    per = G.river(nodes(t), 5.0).groupBy(F.col("b_id").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes(t).select("id").join(per, "id", "left").fillna(0, ["in_degree"])


@query("flow_balance", f"""
with e as (select src, dst, distance from {RIVER}), i as (select dst as id, sum(distance) as v from e group by 1), o as (select src as id, sum(distance) as v from e group by 1)
select n.id, round(coalesce(i.v, 0), 4) as inflow, round(coalesce(o.v, 0), 4) as outflow, round(abs(coalesce(i.v, 0) - coalesce(o.v, 0)) / (coalesce(i.v, 0) + coalesce(o.v, 0) + 1e-6), 5) as relative from {NODES} n left join i using (id) left join o using (id)""")
def flow_balance(t: Tables):
    e = G.river(nodes(t), 5.0).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "distance")
    return G.balance(nodes(t), e, "distance").select(
        "id",
        F.round("inflow", 4).alias("inflow"),
        F.round("outflow", 4).alias("outflow"),
        F.round("relative", 5).alias("relative"),
    )


@query("accumulate", f"""
with recursive e as materialized (select src, dst from {RIVER}), walk as (
  select id, area as v, 0 as level from {NODES}
  union all
  select e.dst, sum(w.v), w.level + 1 from walk w join e on e.src = w.id group by e.dst, w.level)
select id, round(sum(v), 3) as total from walk group by id""")
def accumulate(t: Tables):
    """Over the whole river graph, once a path."""
    from quern.plans.ship import ship

    ship(t.spark)
    return G.accumulate_down(nodes(t), G.river(nodes(t), 5.0), "area", "elevation").select("id", F.round("total", 3).alias("total"))


@query("components", f"""
with recursive r as materialized (select src, dst from {RIVER}), e as (select src, dst from r union select dst, src from r), walk as (select id, id as c from (select distinct src as id from e) union select e.dst, w.c from walk w join e on e.src = w.id)
select id, min(c) as component from walk group by id""")
def components(t: Tables):
    """Of the whole river graph."""
    from quern.plans.ship import ship

    ship(t.spark)
    return G.components(G.river(nodes(t), 5.0).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


@query(
    "graph_stats",
    f"select (select count(*) from {NODES}) as n_nodes, count(*) as n_edges, round(2 * count(*) / (select count(*) from {NODES})::double, 6) as "
    f"mean_degree, round(count(*) / ((select count(*) from {NODES}) * ((select count(*) from {NODES}) - 1))::double, 6) as density from (select "
    f"distinct src, dst from {RIVER})",
)
def graph_stats(t: Tables):
    e = G.river(nodes(t), 5.0).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    return G.statistics(t.embeddings.count(), e).select(
        "n_nodes",
        "n_edges",
        r6(F.col("mean_degree"), "mean_degree"),
        r6(F.col("density"), "density"),
    )


@query(
    "edge_styles",
    f"select kind, src, dst, round(distance / (max(distance) over (partition by kind) + 1e-6), 6) as style from (select 'river' as kind, src, dst, "
    f"distance from {RIVER} union all select 'karst', src, dst, distance from {KARST})",
)
def edge_styles(t: Tables):
    """Style weights relative to the longest edge of each type."""
    of = lambda e, kind: e.select(F.lit(kind).alias("kind"), F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "distance")
    e = of(G.river(nodes(t), 5.0), "river").union(of(G.karst(nodes(t), 3.5, 0.4), "karst"))
    top = F.broadcast(e.groupBy("kind").agg(F.max("distance").alias("top")))  # one row a type
    return e.join(top, "kind").select("kind", "src", "dst", r6(F.col("distance") / (F.col("top") + 1e-6), "style"))


@query(
    "edge_weights",
    f"select src, dst, round(distance / (max(distance) over () + 1e-6), 6) as style, round(avg(case when hours < 1000 then hours else 0 end) over "
    f"(), 4) as penalty from (select *, distance * 1000 / ((1 / 0.035) * (0.3 * (0.5 * area ** 0.8) ** 0.4) ** (2.0 / 3.0) * sqrt(slope)) / 3600 "
    f"as hours from {RIVER})",
)
def edge_weights(t: Tables):
    """Style weights relative to the longest edge, and the mean travel time with those of 1,000 hours or more as 0."""
    v = P.manning_velocity(F.col("a_area"), F.lit(0.035), F.col("slope"))
    e = G.river(nodes(t), 5.0).withColumn("hours", P.travel_hours(F.col("distance") * 1000, v))
    e = S.with_scalars(e, F.max("distance").alias("top"), F.avg(F.when(F.col("hours") < 1000, F.col("hours")).otherwise(0.0)).alias("mean"))
    return e.select(
        F.col("a_id").alias("src"),
        F.col("b_id").alias("dst"),
        r6(F.col("distance") / (F.col("top") + 1e-6), "style"),
        F.round("mean", 4).alias("penalty"),
    )


# Bins and splits.
SORTED = "(select n_chars::double as v, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from documents)"


def edge_sql(k: int, q: int) -> str:
    return f"(select quantile_cont(n_chars::double, {k} / {q}) from documents)"


BIN3 = f"case when n_chars is null then null when n_chars <= {edge_sql(1, 3)} then 'easy' when n_chars <= {edge_sql(2, 3)} then 'medium' else 'hard' end"
DIGIT, NAME = "case when coalesce(regexp_matches(text, '[0-9]'), false) then 'has_nums' else 'no_nums' end", "case when coalesce(regexp_matches(text, '[A-Z]'), false) then 'has_names' else 'no_names' end"


@query("qcut3", f"select doc_id, {BIN3} as bin from documents")
def qcut3(t: Tables):
    return S.qcut(t.documents, "n_chars", 3, "bin", ["easy", "medium", "hard"]).select("doc_id", "bin")


@query(
    "qcut5",
    f"select doc_id, (n_chars > {edge_sql(1, 5)})::int + (n_chars > {edge_sql(2, 5)})::int + (n_chars > {edge_sql(3, 5)})::int + (n_chars > "
    f"{edge_sql(4, 5)})::int as bin from documents",
)
def qcut5(t: Tables):
    return S.qcut(t.documents, "n_chars", 5, "bin").select("doc_id", "bin")


def strata_rows(t: Tables):
    d = S.qcut(t.documents, "n_chars", 3, "bin", ["easy", "medium", "hard"])
    flag = lambda p: F.coalesce(F.col("text").rlike(p), F.lit(False))
    nums, names = F.when(flag("[0-9]"), "has_nums").otherwise("no_nums"), F.when(flag("[A-Z]"), "has_names").otherwise("no_names")
    return d.select(
        "doc_id",
        "source",
        "n_chars",
        "bin",
        F.concat_ws("_", nums, names).alias("pair"),
        F.concat("bin", F.lit("_"), nums, F.lit("_"), names).alias("stratum"),
    )


STRATA = (
    f"(select doc_id, source, n_chars, {BIN3} as bin, {DIGIT} || '_' || {NAME} as pair, {BIN3} || '_' || {DIGIT} || '_' || {NAME} as stratum from "
    f"documents)"
)


@query("strata", f"select doc_id, stratum from {STRATA}")
def strata(t: Tables):
    return strata_rows(t).select("doc_id", "stratum")


HASH = "md5(doc_id || '|42'), doc_id"


@query(
    "stratified_split",
    f"select doc_id, row_number() over (partition by bin order by {HASH}) <= ceil(count(*) over (partition by bin) * 0.2) as in_val from {STRATA}",
)
def stratified_split(t: Tables):
    return X.holdout(strata_rows(t).select("doc_id", "bin"), "doc_id", ["bin"], 0.2).select("doc_id", "in_val")


@query("plain_split", f"select doc_id, row_number() over (order by {HASH}) <= ceil(count(*) over () * 0.1) as in_val from documents")
def plain_split(t: Tables):
    return X.holdout(t.documents.select("doc_id"), "doc_id", [], 0.1).select("doc_id", "in_val")


@query("fallback_split", f"""
with s as {STRATA}, f as (select min(n) >= 2 and count(*) <= ceil(sum(n) * 0.2) as ok from (select count(*) as n from s group by stratum))
select doc_id, case when (select ok from f) then 0 else 1 end as level,
  case when (select ok from f) then row_number() over (partition by stratum order by {HASH}) <= ceil(count(*) over (partition by stratum) * 0.2) else row_number() over (partition by bin order by {HASH}) <= ceil(count(*) over (partition by bin) * 0.2) end as in_val from s""")
def fallback_split(t: Tables):
    return X.fallback(
        strata_rows(t).select("doc_id", "stratum", "bin", "pair"),
        "doc_id",
        ["stratum", "bin", "pair"],
        0.2,
    ).select("doc_id", "level", "in_val")


@query("kfold", f"select doc_id, ((row_number() over (partition by bin order by {HASH}) - 1) % 5)::int as fold from {STRATA}")
def kfold(t: Tables):
    return X.kfold(strata_rows(t).select("doc_id", "bin"), "doc_id", ["bin"], 5).select("doc_id", "fold")


@query(
    "group_split",
    "with g as (select source, row_number() over (order by md5(concat_ws('|', source, '42')), source) <= ceil(count(*) over () * 0.2) as in_val from "
    "(select distinct source from documents)) select doc_id, in_val from documents d join g on d.source is not distinct from g.source",
)
def group_split(t: Tables):
    return X.group_holdout(t.documents.select("doc_id", "source"), "doc_id", "source", 0.2).select("doc_id", "in_val")


@query("group_kfold", f"""
with per as (select source, bin, count(*) as n from {STRATA} group by all),
sized as (select source, sum(n) as size, arg_min(coalesce(bin, ''), {{'a': -n, 'b': coalesce(bin, '')}}) as kind from per group by source),
line as (select source, row_number() over (order by kind, size desc, source nulls first) - 1 as place from sized)
select doc_id, d.source, case when place // 5 % 2 = 0 then place % 5 else 4 - place % 5 end::int as fold from documents d join line l on d.source is not distinct from l.source""")
def group_kfold(t: Tables):
    """Whole sources, by their commonest length and size, to and fro over five folds."""
    return X.group_kfold(strata_rows(t).select("doc_id", "source", "bin"), "source", "bin", 5).select("doc_id", "source", "fold")


FOLDS = f"(select n_chars, ((row_number() over (partition by bin order by {HASH}) - 1) % 5)::int as fold from {STRATA})"


@query(
    "fold_stats",
    f"select k, round(avg(n_chars) filter (fold <> k), 6) as train_mean, round(avg(n_chars) filter (fold = k), 6) as val_mean, count(*) filter "
    f"(fold = k) as n_val from {FOLDS}, (select unnest([0, 1, 2, 3, 4]) as k) group by k",
)
def fold_stats(t: Tables):
    """Both sides of every fold from one pass: sums a fold, and the rest by difference."""
    per = X.kfold(
        strata_rows(t).select("doc_id", "bin", "n_chars"),
        "doc_id",
        ["bin"],
        5,
    ).groupBy("fold").agg(F.sum("n_chars").alias("s"), F.count("*").alias("n"))
    both = S.with_scalars(per, F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    return both.select(
        F.col("fold").alias("k"),
        r6((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")), "train_mean"),
        r6(F.col("s") / F.col("n"), "val_mean"),
        F.col("n").alias("n_val"),
    )


@query("split_balance", f"""
with s as (select n_chars, row_number() over (partition by bin order by {HASH}) <= ceil(count(*) over (partition by bin) * 0.2) as v from {STRATA}),
a as (select avg(n_chars) filter (not v) as tm, avg(n_chars) filter (v) as vm, median(n_chars) filter (not v) as td, median(n_chars) filter (v) as vd from s)
select round(tm, 6) as train_mean, round(vm, 6) as val_mean, round(td, 6) as train_median, round(vd, 6) as val_median, round(100 * (vm - tm) / tm, 6) as difference from a""")
def split_balance(t: Tables):
    s = X.holdout(strata_rows(t).select("doc_id", "bin", "n_chars"), "doc_id", ["bin"], 0.2)
    side = lambda v, x: F.when(F.col("in_val") == v, x)
    middle = Q.quantiles(s, "n_chars", [0.5], by=["in_val"]).agg(*[F.max(side(v, F.col("q")[0])).alias(n) for v, n in ((False, "td"), (True, "vd"))])
    a = s.agg(*[F.avg(side(v, F.col("n_chars"))).alias(n) for v, n in ((False, "tm"), (True, "vm"))]).crossJoin(F.broadcast(middle))  # one row each
    return a.select(
        r6(F.col("tm"), "train_mean"),
        r6(F.col("vm"), "val_mean"),
        r6(F.col("td"), "train_median"),
        r6(F.col("vd"), "val_median"),
        r6(100 * (F.col("vm") - F.col("tm")) / F.col("tm"), "difference"),
    )


# Vectors and clusters.
NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))"


@query("l2_norm", f"select vec_id, round({NORM}, 6) as norm, round(embedding[1]::double / ({NORM} + 1e-8), 6) as first from embeddings")
def l2_norm(t: Tables):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", r6(V.norm(e), "norm"), r6(V.unit(e)[0], "first"))


@query(
    "embedding_diag",
    "select round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, min(x)::double as min, max(x)::double as max, (select count(*) from "
    "embeddings where list_sum(list_transform(embedding, lambda y: abs(y))) = 0) as n_zero from (select unnest(embedding)::double as x from "
    "embeddings)",
)
def embedding_diag(t: Tables):
    zero = t.embeddings.agg(F.count_if(V.norm(F.col("embedding")) == 0).alias("n_zero"))
    x = t.embeddings.select(F.explode("embedding").alias("f")).select(F.col("f").cast("double").alias("x")).agg(
        r6(F.avg("x"), "mean"),
        r6(F.stddev_pop("x"), "std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return x.crossJoin(zero)


@query(
    "cluster_sizes",
    "select count(*) as clusters, min(n) as least, max(n) as most, floor(median(n))::bigint as median, round(avg(n), 6) as mean, count(*) = 1 as "
    "degenerate, greatest(30, least(80, sum(n) // 60))::bigint as suggested from (select label, count(*) as n from embeddings group by label)",
)
def cluster_sizes(t: Tables):
    per = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("clusters"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.floor(F.median("n")).alias("median"),
        r6(F.avg("n"), "mean"),
        (F.count("*") == 1).alias("degenerate"),
        F.greatest(F.lit(30), F.least(F.lit(80), F.floor(F.sum("n") / 60))).cast("long").alias("suggested"),
    )


@query(
    "mean_pool",
    "select label, list(m order by k) as pooled from (select label, k, round(avg(x), 6) as m from (select label, unnest(embedding)::double as x, "
    "unnest(generate_series(1, len(embedding))) as k from embeddings) group by label, k) group by label",
)
def mean_pool(t: Tables):
    """All components of each label's mean vector."""
    return V.mean_pool(t.embeddings, "label", "embedding").select("label", F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))


CENTRES = (
    "(select label, list(m order by k) as c from (select label, k, avg(x) as m from (select label, unnest(embedding)::double as x, "
    "unnest(generate_series(1, 64)) as k from embeddings) group by label, k) group by label)"
)


@query("nearest_centroid", f"""
select vec_id, arg_min(label, (d, label)) as label, round(min(d), 5) as distance from (
  select vec_id, c.label, sqrt(list_sum(list_transform(list_zip(embedding, c.c), lambda z: (z[1]::double - z[2]) ** 2))) as d from embeddings, {CENTRES} c) group by vec_id""")
def nearest_centroid(t: Tables):
    centres = V.mean_pool(t.embeddings, "label", "embedding").select(F.col("label").alias("label_c"), F.col("pooled").alias("centroid"))
    from quern.plans.ship import ship

    ship(t.spark)
    return V.nearest(t.embeddings, "vec_id", "embedding", centres).select("vec_id", "label", F.round("distance", 5).alias("distance"))


@query("kmeans")
def kmeans(t: Tables):
    """Seeded k-means on unit vectors, the best of ten starts, with as many clusters as the rows call for: invariants are tested."""
    from quern.plans.ship import ship

    ship(t.spark)
    return V.kmeans(t.embeddings, "vec_id", "embedding", V.n_clusters(t.embeddings.count()))


# Arrays.
IDS = "(select conv_id, list(turn order by turn) || [1, 2] as a from conversations group by conv_id)"


@query(
    "rfind_subsequence",
    f"select conv_id, coalesce(list_max(list_filter(generate_series(1, len(a) - 1), lambda i: a[i] = 1 and a[i + 1] = 2)) - 1, -1)::int as "
    f"last_at, coalesce(list_min(list_filter(generate_series(1, len(a) - 1), lambda i: a[i] = 1 and a[i + 1] = 2)) - 1, -1)::int as first_at from "
    f"{IDS}",
)
def rfind_subsequence(t: Tables):
    return _ids(t).select(
        "conv_id",
        R.rfind(F.col("a"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("last_at"),
        R.find(F.col("a"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("first_at"),
    )


def _ids(t: Tables):
    listed = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("a"))
    return listed.select("conv_id", F.concat("a", F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("a"))


@query(
    "label_mask",
    f"select conv_id, list_transform(generate_series(1, len(a)), lambda i: case when i <= coalesce(list_max(list_filter(generate_series(1, len(a) "
    f"- 1), lambda j: a[j] = 1 and a[j + 1] = 2)) + 1, 0) or a[i] = 0 then -100 else a[i] end) as labels from (select conv_id, a || [5, 6, 0, 0] "
    f"as a from {IDS})",
)
def label_mask(t: Tables):
    a = F.concat("a", F.array(*map(F.lit, (5, 6, 0, 0))).cast("array<bigint>"))
    return _ids(t).select("conv_id", R.masked(a, F.array(F.lit(1), F.lit(2)).cast("array<bigint>"), 0).alias("labels"))


@query("latest_checkpoint", "select o_custkey, arg_max('checkpoint-' || o_orderkey, o_orderkey) as name from orders group by o_custkey")
def latest_checkpoint(t: Tables):
    name = F.concat(F.lit("checkpoint-"), "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.max_by(name, F.regexp_extract(name, r"-(\d+)$", 1).cast("long")).alias("name"))


@query(
    "step_schedule",
    "select p_partkey, ceil(ceil(p_size / 4.0) / 2.0)::bigint as per_epoch, (ceil(ceil(p_size / 4.0) / 2.0) * 3)::bigint as total, greatest(1, "
    "floor(ceil(ceil(p_size / 4.0) / 2.0) * 3 * 0.1))::bigint as warmup from part",
)
def step_schedule(t: Tables):
    return t.part.select("p_partkey", *R.schedule(F.col("p_size"), 4, 2, 3, 0.1))


@query(
    "best_of_history",
    "select conv_id, list_min(list_filter(h, lambda x: x is not null)) as best from (select conv_id, list(case when role = 'user' then "
    "length(text) end order by turn) as h from conversations group by conv_id)",
)
def best_of_history(t: Tables):
    h = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", F.length("text")).alias("v"))))
    return t.conversations.groupBy("conv_id").agg(F.array_min(F.filter(F.transform(h, lambda x: x["v"]), lambda v: v.isNotNull())).alias("best"))


@query("ocr_unpack", "select item_id, case when item_id % 4 = 3 then '' else coalesce(text, '') end as text from benchmark")
def ocr_unpack(t: Tables):
    """Texts out of nested recognition results: a line, several lines, an object, nothing."""
    from quern.plans.ship import ship

    ship(t.spark)
    said = F.regexp_extract(F.to_json(F.struct(T.whole("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    line = F.concat(F.lit("[[[0,0],[9,9]],["), said, F.lit(",0.9]]"))
    shapes = [
        F.concat(F.lit("["), line, F.lit("]")),
        F.concat(F.lit("[["), line, F.lit(',[[[0,9],[9,18]],["another line",0.8]]]]')),
        F.concat(F.lit('{"rec_score":0.7,"rec_text":'), said, F.lit("}")),
        F.lit("[]"),
    ]
    nested = F.element_at(F.array(*shapes), (F.col("item_id") % 4 + 1).cast("int"))
    return t.benchmark.select("item_id", R.ocr_text(nested).alias("text"))


# Pixels: a table (img, y, x, v) stands for decoded images.
PIXELS = "(select l_partkey as img, l_linenumber % 4 as y, l_suppkey % 8 as x, (l_quantity * 5)::int as v from lineitem)"


def pixels(t: Tables):
    return t.lineitem.select(
        F.col("l_partkey").alias("img"),
        (F.col("l_linenumber") % 4).alias("y"),
        (F.col("l_suppkey") % 8).alias("x"),
        (F.col("l_quantity") * 5).cast("int").alias("v"),
    )


@query("otsu_threshold", f"""
with h as (select img, v, count(*)::double as n from {PIXELS} group by all),
c as (select img, v, sum(n) over w as w0, sum(n * v) over w as s0, sum(n) over (partition by img) as n, sum(n * v) over (partition by img) as s from h window w as (partition by img order by v))
select img, arg_min(v, (-round(w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) ** 2, 4), v)) as threshold from c where w0 < n group by img""")
def otsu_threshold(t: Tables):
    return I.otsu(pixels(t))


@query(
    "dark_tiles",
    f"select img, count(*) as tiles, count(*) filter (m < 100) as dark from (select img, y // 2 as ty, x // 4 as tx, avg(v) as m from {PIXELS} "
    f"group by all) group by img",
)
def dark_tiles(t: Tables):
    return I.dark_tiles(pixels(t), 2, 4, 100)


GREY = f"(select img, y, x, round(avg(v))::int as v from {PIXELS} group by all)"


def grey(t: Tables):
    """One value a place."""
    return pixels(t).groupBy("img", "y", "x").agg(F.round(F.avg("v")).cast("int").alias("v"))


@query("image_contrast", f"""
with g as {GREY}, h as (select img, v, count(*)::double as n from g group by all), s as (select img, min(v) as lo, max(v) as hi from g group by img),
e as (select img, -sum(n / total * log2(n / total)) as entropy from (select *, sum(n) over (partition by img) as total from h) group by img)
select img, round(entropy, 5) as entropy, round(least(100, case when lo + hi = 0 then 0 else ((hi - lo) / (hi + lo)::double * 50 + entropy / 8 * 50) * 100 end), 4) as contrast from s join e using (img)""")
def image_contrast(t: Tables):
    c = I.contrast(grey(t))
    return c.select("img", F.round("entropy", 5).alias("entropy"), F.round("contrast", 4).alias("contrast"))


@query("image_fade", f"""
with g as {GREY}, h as (select img, v, count(*)::double as n from g group by all),
c as (select img, v, sum(n) over w as w0, sum(n * v) over w as s0, sum(n) over (partition by img) as n, sum(n * v) over (partition by img) as s from h window w as (partition by img order by v)),
o as (select img, arg_min(v, (-round(w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) ** 2, 4), v)) as cut from c where w0 < n group by img),
m as (select img, avg(v) filter (v < cut) as dark, avg(v) filter (v >= cut) as light from g left join o using (img) group by img)
select img, round(case when dark is null or light is null then 100 else least(100, greatest(0, 100 - (light - dark) * 0.8)) end, 4) as fade from m""")
def image_fade(t: Tables):
    return I.ink_fade(grey(t)).select("img", F.round("fade", 4).alias("fade"))


LAPLACE = f"""(select *, coalesce(lag(v) over r, lead(v) over r, v) + coalesce(lead(v) over r, lag(v) over r, v) + coalesce(lag(v) over c, lead(v) over c, v) + coalesce(lead(v) over c, lag(v) over c, v) - 4 * v as edge
  from {GREY} window r as (partition by img, y order by x), c as (partition by img, x order by y))"""


@query(
    "image_blur",
    f"select img, round(var_pop(edge), 4) as edges, round(least(100, greatest(0, 100 - var_pop(edge) / 10.0)), 4) as blur from {LAPLACE} group by "
    f"img",
)
def image_blur(t: Tables):
    return I.blur(grey(t)).select("img", F.round("edges", 4).alias("edges"), F.round("blur", 4).alias("blur"))


@query("image_scores", """
select doc_id, round(0.25 * a + 0.30 * (100 - b) + 0.15 * a + 0.20 * b + 0.05 * a + 0.05 * b, 6) as difficulty, round(0.35 * a + 0.20 * b + 0.25 * a + 0.10 * b + 0.10 * a, 6) as condition
from (select doc_id, n_chars % 100 as a, doc_id % 100 as b from documents)""")
def image_scores(t: Tables):
    a, b = F.col("n_chars") % 100, F.col("doc_id") % 100
    return t.documents.select("doc_id", r6(I.image_difficulty(a, b, a, b, a, b), "difficulty"), r6(I.condition_score(a, b, a, b, a), "condition"))
