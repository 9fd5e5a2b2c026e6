"""Projections, filters, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import quantiles as Q
from quern.operators import stats as S

from .registry import Tables, query

r6 = lambda c, name: F.round(c, 6).alias(name)


@query(
    "project_computed",
    "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) as net, round(l_extendedprice * (1 - l_discount) * (1 + "
    "l_tax), 6) as gross from lineitem",
)
def project_computed(t: Tables):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(net, "net"), r6(net * (1 + F.col("l_tax")), "gross"))


@query(
    "range_tiers",
    "select tier, count(*) as n, round(avg(l_extendedprice), 6) as mean_price from (select *, case when l_quantity < 15 then 'mild' when "
    "l_quantity >= 15 and l_quantity < 25 then 'moderate' else 'severe' end as tier from lineitem) group by tier",
)
def range_tiers(t: Tables):
    q = F.col("l_quantity")
    tier = F.when(q < 15, "mild").when((q >= 15) & (q < 25), "moderate").otherwise("severe")
    return t.lineitem.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), r6(F.avg("l_extendedprice"), "mean_price"))


@query(
    "regex_flags",
    "select doc_id, coalesce(regexp_matches(text, '[0-9]'), false) as has_digit, coalesce(regexp_matches(text, '[A-Z]'), false) as has_upper from "
    "documents",
)
def regex_flags(t: Tables):
    flag = lambda p: F.coalesce(F.col("text").rlike(p), F.lit(False))
    return t.documents.select("doc_id", flag("[0-9]").alias("has_digit"), flag("[A-Z]").alias("has_upper"))


@query(
    "semi_members",
    "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
)
def semi_members(t: Tables):
    some = t.customer.where("c_mktsegment = 'BUILDING'")
    return t.orders.join(some, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("anti_members", "select doc_id, source from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def anti_members(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


@query(
    "left_join_median_fill",
    "select doc_id, round(coalesce(quality::double, (select median(quality) from documents left join labels using (doc_id))), 6) as quality, "
    "quality is null as filled from documents left join labels using (doc_id)",
)
def left_join_median_fill(t: Tables):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("filled", F.col("quality").isNull())
    return S.median_fill(joined, "quality").select("doc_id", r6(F.col("quality"), "quality"), "filled")


@query("inner_join", "select d.doc_id, source, quality, toxic from documents d join labels l on d.doc_id = l.doc_id")
def inner_join(t: Tables):
    return t.documents.join(t.labels, "doc_id").select("doc_id", "source", "quality", "toxic")


@query("suffix_join_combined", """
select c_custkey, c_name as name, n_name as name_nation, r_name as name_region from customer
left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def suffix_join_combined(t: Tables):
    c = t.customer.select("c_custkey", "c_nationkey", F.col("c_name").alias("name"))
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey", F.col("n_name").alias("name_nation"))
    r = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name_region"))
    return c.join(n, "c_nationkey", "left").join(r, "n_regionkey", "left").select("c_custkey", "name", "name_nation", "name_region")


@query("aligned_zip", "select a.doc_id, a.source as first_source, b.n_chars from documents a join documents b on a.doc_id = b.doc_id")
def aligned_zip(t: Tables):
    """Position-wise pairing of two tables, by id and only if both hold the same ids."""
    a, b = t.documents.select("doc_id", F.col("source").alias("first_source")), t.documents.select("doc_id", "n_chars")
    if not (a.join(b, "doc_id", "left_anti").isEmpty() and b.join(a, "doc_id", "left_anti").isEmpty()):
        raise ValueError("the tables hold different ids")
    return a.join(b, "doc_id")


@query("keyed_lookup_default", """
select conv_id as id, list(coalesce(p.text, '') order by f.turn) as preds
from (select distinct conv_id from conversations) i cross join (select distinct turn from conversations) f left join conversations p using (conv_id, turn) group by conv_id""")
def keyed_lookup_default(t: Tables):
    c = t.conversations
    turns = c.agg(F.sort_array(F.collect_set("turn")).alias("turns"))  # the folds, one row
    said = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    own = c.groupBy(F.col("conv_id").alias("id")).agg(said.alias("said")).crossJoin(F.broadcast(turns))

    def of(turn):
        found = F.transform(F.filter("said", lambda x: x["turn"] == turn), lambda x: x["text"])
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))

    return own.select("id", F.flatten(F.transform("turns", of)).alias("preds"))


@query(
    "matched_counts",
    "select count(*) as total_reference, count(l.doc_id) as matched, count(*) = count(l.doc_id) as complete from documents d left join labels l "
    "on d.doc_id = l.doc_id",
)
def matched_counts(t: Tables):
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return j.agg(F.count("*").alias("total_reference"), F.count("hit").alias("matched"), (F.count("*") == F.count("hit")).alias("complete"))


@query("group_stats", """
select source, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars), 6) as std, min(n_chars) as min, max(n_chars) as max, count(*) as n, round(avg(length(text)), 6) as mean_length
from documents group by source""")
def group_stats(t: Tables):
    return t.documents.groupBy("source").agg(
        r6(F.avg("n_chars"), "mean"),
        r6(F.stddev_samp("n_chars"), "std"),
        F.min("n_chars").alias("min"),
        F.max("n_chars").alias("max"),
        F.count("*").alias("n"),
        r6(F.avg(F.length("text")), "mean_length"),
    )


@query("group_mean_count", "select event_type, round(avg(value), 6) as mean, count(*) as n from events group by event_type")
def group_mean_count(t: Tables):
    return t.events.groupBy("event_type").agg(r6(F.avg("value"), "mean"), F.count("*").alias("n"))


@query("value_counts", "select lang, count(*) as n from documents group by lang order by n desc, lang")
def value_counts(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("value_counts_norm", "select lang, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from documents group by lang")
def value_counts_norm(t: Tables):
    return S.shares(t.documents, "lang").withColumn("share", F.round("share", 6))


@query(
    "having_dups",
    f"select key, count(*) as n from (select regexp_replace(lower(coalesce(text, '')), '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g') as key from "
    f"documents) group by key having count(*) > 1",
)
def having_dups(t: Tables):
    return t.documents.groupBy(T.key(T.whole("text")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("count_distinct", "select count(distinct source) as sources, count(distinct lang) as langs, count(distinct text) as texts from documents")
def count_distinct(t: Tables):
    return t.documents.agg(*[F.countDistinct(c).alias(f"{c}s") for c in ("source", "lang", "text")])


@query(
    "global_stats",
    "select round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_samp(value), 6) as std, min(value) as min, max(value) "
    "as max from events",
)
def global_stats(t: Tables):
    middle = Q.quantiles(t.events, "value", [0.5]).select(r6(F.col("q")[0], "median"))
    return t.events.agg(  # one row each
        r6(F.avg("value"), "mean"),
        r6(F.stddev_samp("value"), "std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ).crossJoin(F.broadcast(middle))


@query("describe", """
select event_type, count(value) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min,
  round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.75), 6) as q75, max(value) as max
from events group by event_type""")
def describe(t: Tables):
    out = S.describe(t.events, "value", ["event_type"])
    return out.select("event_type", "count", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(
    "quantiles",
    "select unnest([0.05, 0.25, 0.5, 0.75, 0.95]) as q, round(unnest(quantile_cont(n_chars::double, [0.05, 0.25, 0.5, 0.75, 0.95])), 6) as value "
    "from documents",
)
def quantiles(t: Tables):
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    both = Q.quantiles(t.documents, "n_chars", qs, "v").select(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), "v").alias("z"))
    return both.select(F.explode("z").alias("z")).select("z.q", r6(F.col("z.v"), "value"))


@query("correlation", "select round(corr(n_chars, quality), 6) as r from documents join labels using (doc_id)")
def correlation(t: Tables):
    return t.documents.join(t.labels, "doc_id").agg(r6(F.corr("n_chars", "quality"), "r"))


@query(
    "argmin_argmax",
    "select source, arg_min(doc_id, (n_chars, doc_id)) as least, arg_max(doc_id, (n_chars, doc_id)) as most from documents group by source",
)
def argmin_argmax(t: Tables):
    by = F.struct("n_chars", "doc_id")
    return t.documents.groupBy("source").agg(F.min_by("doc_id", by).alias("least"), F.max_by("doc_id", by).alias("most"))


@query(
    "conditional_share",
    "select source, count(*) filter (n_chars > 2000) as n_long, round(avg((n_chars > 2000)::int), 6) as share_long from documents group by source",
)
def conditional_share(t: Tables):
    long = F.col("n_chars") > 2000
    return t.documents.groupBy("source").agg(F.count_if(long).alias("n_long"), r6(F.avg(long.cast("int")), "share_long"))


@query("range_histogram", """
select bucket, count(*) as n, round(count(*) / (select count(*) from lineitem), 6) as share
from (select case when d < 0.02 then '0.00-0.02' when d < 0.04 then '0.02-0.04' when d < 0.06 then '0.04-0.06' when d < 0.1 then '0.06-0.10' end as bucket from (select l_discount as d from lineitem)) where bucket is not null group by bucket""")
def range_histogram(t: Tables):
    """Half-open ranges; the top one excludes its end. Shares are of all rows."""
    d = F.col("l_discount")
    bucket = F.when(d < 0.02, "0.00-0.02").when(d < 0.04, "0.02-0.04").when(d < 0.06, "0.04-0.06").when(d < 0.1, "0.06-0.10")
    per = S.shares(t.lineitem.withColumn("bucket", bucket), "bucket").where("bucket is not null")
    return per.withColumn("share", F.round("share", 6))


THRESHOLDS = (10, 20, 30, 40, 50, 100, 500)


@query("resize_impact", """
select limit_px, count(*) filter (px > limit_px) as n_resized, round(coalesce(avg(case when px > limit_px then sqrt(limit_px / px) end), 1.0), 6) as mean_scale
from (select p_size * p_retailprice / 1000 as px from part) cross join (select unnest([10, 20, 30, 40, 50, 100, 500]) as limit_px) group by limit_px""")
def resize_impact(t: Tables):
    """Over seven limits: how many images shrink, and their mean scale (1 if none)."""
    px = t.part.select((F.col("p_size") * F.col("p_retailprice") / 1000).alias("px"), F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("limit_px"))
    over = F.col("px") > F.col("limit_px")
    return px.groupBy("limit_px").agg(
        F.count_if(over).alias("n_resized"),
        r6(F.coalesce(F.avg(F.when(over, F.sqrt(F.col("limit_px") / F.col("px")))), F.lit(1.0)), "mean_scale"),
    )


@query(
    "orientation",
    "select case when w > h then 'landscape' when w < h then 'portrait' else 'square' end as orientation, count(*) as n from (select l_quantity "
    "as w, l_linenumber * 8 as h from lineitem) group by 1",
)
def orientation(t: Tables):
    w, h = F.col("l_quantity"), F.col("l_linenumber") * 8
    return t.lineitem.groupBy(
        F.when(w > h, "landscape").when(w < h, "portrait").otherwise("square").alias("orientation")
    ).agg(F.count("*").alias("n"))


@query("image_targets", """
select p_partkey, round(w * h, 6) as area, round(w / h, 6) as aspect, case when w * h > 20000 then floor(w * sqrt(20000 / (w * h)))::bigint else floor(w)::bigint end as scaled_width,
  case when w / h > 12 then '1400x256' when w / h > 6 then '1400x384' when w / h > 3 then '1200x512' else '1024x512' end as train_box,
  case when w / h > 10 then '2048x384' when w / h > 5 then '2048x512' else '1536x768' end as infer_box,
  '~' || floor(sqrt(w * h))::bigint || 'x' || floor(sqrt(w * h))::bigint as label
from (select p_partkey, p_retailprice as w, p_size::double * 4 as h from part)""")
def image_targets(t: Tables):
    p = t.part.select("p_partkey", F.col("p_retailprice").alias("w"), (F.col("p_size").cast("double") * 4).alias("h"))
    area, aspect = F.col("w") * F.col("h"), F.col("w") / F.col("h")
    scaled = F.when(area > 20000, F.floor(F.col("w") * F.sqrt(F.lit(20000) / area))).otherwise(F.floor("w"))
    side = F.floor(F.sqrt(area))
    train = F.when(aspect > 12, "1400x256").when(aspect > 6, "1400x384").when(aspect > 3, "1200x512").otherwise("1024x512")
    infer = F.when(aspect > 10, "2048x384").when(aspect > 5, "2048x512").otherwise("1536x768")
    return p.select(
        "p_partkey",
        r6(area, "area"),
        r6(aspect, "aspect"),
        scaled.alias("scaled_width"),
        train.alias("train_box"),
        infer.alias("infer_box"),
        F.concat(F.lit("~"), side, F.lit("x"), side).alias("label"),
    )


@query("doubly_hard", """
select o_orderkey, o_totalprice, n_lines from (select o_orderkey, o_totalprice, count(l_orderkey) as n_lines from orders left join lineitem on o_orderkey = l_orderkey group by 1, 2)
where o_totalprice > (select quantile_cont(o_totalprice, 0.75) from orders)
  and n_lines > (select quantile_cont(n, 0.75) from (select count(l_orderkey) as n from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey))""")
def doubly_hard(t: Tables):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    both = t.orders.select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    cut = Q.with_quantiles(Q.with_quantiles(both, "o_totalprice", p=0.75), "n_lines", q=0.75)
    return cut.where("o_totalprice > p and n_lines > q").select("o_orderkey", "o_totalprice", "n_lines")


@query(
    "decile_filter",
    "select doc_id, n_chars, n_chars >= hi as top from documents, (select quantile_cont(n_chars, 0.9) as hi, quantile_cont(n_chars, 0.1) as lo "
    "from documents) where n_chars >= hi or n_chars <= lo",
)
def decile_filter(t: Tables):
    d = Q.with_quantiles(t.documents.select("doc_id", "n_chars"), "n_chars", hi=0.9, lo=0.1)
    return d.where("n_chars >= hi or n_chars <= lo").select("doc_id", "n_chars", (F.col("n_chars") >= F.col("hi")).alias("top"))


@query("std_outliers", """
with g as (select source, avg(n_chars) as m from documents group by source), s as (select avg(m) as a, stddev_samp(m) as d from g)
select source, round(m, 6) as mean, case when m > a + d then 'hard' else 'easy' end as side from g, s where m > a + d or m < a - d""")
def std_outliers(t: Tables):
    g = t.documents.groupBy("source").agg(F.avg("n_chars").alias("m"))
    x = S.with_scalars(g, F.avg("m").alias("a"), F.stddev_samp("m").alias("d"))
    return x.where("m > a + d or m < a - d").select(
        "source",
        r6(F.col("m"), "mean"),
        F.when(F.expr("m > a + d"), "hard").otherwise("easy").alias("side"),
    )


@query("topk", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 10")
def topk(t: Tables):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("bottomk", "select doc_id, n_chars from documents order by n_chars, doc_id limit 10")
def bottomk(t: Tables):
    return t.documents.select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(10)


@query("modal_values", "select source, count(*) as n from documents group by source order by n desc, source limit 3")
def modal_values(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(3)


@query(
    "hash_sample",
    "select doc_id, source from documents order by md5(doc_id || '|42'), doc_id limit (select least(1000, count(*) // 2) from documents)",
)
def hash_sample(t: Tables):
    """A seeded sample without replacement; a share or a capped count."""
    size = min(1000, t.documents.count() // 2)
    return t.documents.select("doc_id", "source").orderBy(F.md5(F.concat_ws("|", "doc_id", F.lit("42")).cast("binary")), "doc_id").limit(size)


@query("full_shuffle", "select doc_id, row_number() over (order by md5(doc_id || '|7'), doc_id) as place from documents")
def full_shuffle(t: Tables):
    from quern.operators.splits import place

    return place(
        t.documents.select("doc_id", F.md5(F.concat_ws("|", "doc_id", F.lit("7")).cast("binary")).alias("h")),
        [],
        ["h", "doc_id"],
    ).select("doc_id", "place")


@query("positional_slice", "select doc_id, source from (select *, row_number() over (order by doc_id) as n from documents) where n <= 150")
def positional_slice(t: Tables):
    """The first 150 rows in order: a limit that is the feature."""
    return t.documents.select("doc_id", "source").orderBy("doc_id").limit(150)


@query("union_tagged", "select doc_id as id, text, 'train' as split from documents union all select item_id, text, 'test' from benchmark")
def union_tagged(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), "text", F.lit("train").alias("split")).unionByName(
        t.benchmark.select(F.col("item_id").alias("id"), "text", F.lit("test").alias("split"))
    )


@query("intersect_keys", "select c_nationkey as nation from customer intersect select s_nationkey from supplier")
def intersect_keys(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select("s_nationkey"))


@query("except_missing", "select doc_id from documents except select doc_id from labels")
def except_missing(t: Tables):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("distinct_pairs", "select distinct lang, source from documents")
def distinct_pairs(t: Tables):
    return t.documents.select("lang", "source").distinct()


@query("drop_reasons", """
select case when coalesce(trim(source), '') in ('', 'nan') then 'bad_id' when text is null or length(regexp_replace(text, '\\s', '', 'g')) < 20 then 'empty_target' when l.doc_id is null then 'missing_image' else 'kept' end as reason, count(*) as n
from documents d left join labels l on d.doc_id = l.doc_id group by 1""")
def drop_reasons(t: Tables):
    from quern.operators.rules import drop_reason

    j = t.documents.join(t.labels.select("doc_id", F.lit(True).alias("present")), "doc_id", "left")
    target = F.when(F.length(F.regexp_replace("text", r"\s", "")) >= 20, F.col("text"))
    return j.groupBy(drop_reason(F.col("source"), target, F.col("present")).alias("reason")).agg(F.count("*").alias("n"))


@query("verdicts", """
with g as (select source, stddev_samp(n_chars) / avg(n_chars) as spread from documents group by source)
select source, round(spread, 6) as spread, case when spread > 2 then 'high' when spread > 1 then 'moderate' else 'low' end as verdict from g""")
def verdicts(t: Tables):
    from quern.operators.rules import verdict

    g = t.documents.groupBy("source").agg((F.stddev_samp("n_chars") / F.avg("n_chars")).alias("spread"))
    return g.select("source", r6(F.col("spread"), "spread"), verdict(F.col("spread"), [(2, "high"), (1, "moderate")], "low").alias("verdict"))


@query("rule_multipliers", """
select l_orderkey, l_linenumber, case when coalesce(l_quantity, 0) > 44 then 0.0 else 1.0 end as p_brightness, case when coalesce(l_quantity, 0) > 44 then 0.0 else 1.0 end as p_contrast,
  case when l_linenumber > 5 then 1.5 else 1.0 end as p_elastic, case when l_discount * 400 > 28 then 0.0 else 1.0 end as p_color,
  case when l_tax * 300 > 19 then 0.5 else 1.0 end as hue_sat, case when l_quantity / 2 > 18 then 0.0 else 1.0 end as p_degradation,
  case when l_quantity < 19 then 'good' when l_quantity < 37 then 'fair' when l_quantity <= 42 then 'poor' else 'bad' end as condition
from lineitem""")
def rule_multipliers(t: Tables):
    from quern.operators.rules import condition_class, multipliers

    q = F.col("l_quantity")
    rules = multipliers(q, F.when(F.col("l_linenumber") > 5, 8).otherwise(0), F.col("l_discount") * 400, F.col("l_tax") * 300, q / 2)
    return t.lineitem.select("l_orderkey", "l_linenumber", *rules, condition_class(q).alias("condition"))


@query(
    "boolean_parse",
    "select event_id, lower(trim(v)) in ('1', 'true', 'yes', 'y') as flag from (select event_id, case event_id % 5 when 0 then ' TRUE ' when 1 "
    "then 'no' when 2 then 'Y' when 3 then '1' else '' end as v from events)",
)
def boolean_parse(t: Tables):
    k = F.col("event_id") % 5
    v = F.when(k == 0, " TRUE ").when(k == 1, "no").when(k == 2, "Y").when(k == 3, "1").otherwise("")
    return t.events.select("event_id", T.parse_boolean(v).alias("flag"))


@query("constant_fallback", "select doc_id, 0 as cluster_id from documents")
def constant_fallback(t: Tables):
    from quern.sources.tables import with_default

    return with_default(t.documents, "cluster_id", 0).select("doc_id", "cluster_id")


@query("alias_scan", "select doc_id::varchar as id, nullif(nullif(trim(text), ''), 'nan') as target from documents")
def alias_scan(t: Tables):
    from quern.sources.tables import resolve

    return resolve(t.documents.withColumnRenamed("doc_id", "new_id").withColumnRenamed("text", "label"))


@query("prefix_lookup", """
select c_custkey, coalesce(min(case when n = c_name then n end), min(case when starts_with(n, c_name) then n end)) as file
from customer left join (select c_name || case when c_custkey % 2 = 0 then '' else '_scan' end as n from customer) f on left(n, 18) = left(c_name, 18) and starts_with(n, c_name) group by c_custkey""")
def prefix_lookup(t: Tables):
    from quern.sources.tables import resolve_files

    files = t.customer.select(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "").otherwise("_scan")).alias("file"))
    return resolve_files(t.customer.select("c_custkey", F.col("c_name").alias("name")), files, "c_custkey")


@query("revenue_by_nation", """
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by n_name""")
def revenue_by_nation(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(t.nation),
        F.col("c_nationkey") == F.col("n_nationkey"),
    )
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
