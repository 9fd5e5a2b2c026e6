"""Sources and sinks: what is written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources import tables as Q
from quern.sources.shared import fresh

from .registry import Tables, query
from .ship import ship

r6 = lambda c, name: F.round(c, 6).alias(name)
STRIPPED = f"regexp_replace(coalesce(text, ''), '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')"
TURNS = f"(select conv_id || ':' || turn as id, {STRIPPED} as pred from conversations)"


def turns(t: Tables):
    return t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("id"), T.whole("text").alias("pred"))


@query(
    "csv_round_trip",
    "select item_id::varchar as id, case when item_id % 7 = 0 then null else text end as target from benchmark where text is not null",
)
def csv_round_trip(t: Tables):
    """Texts with quotes, commas and line ends through CSV files; the words for a missing value read as null."""
    path = fresh(t.spark, "csv")
    rows = t.benchmark.where("text is not null").select(
        F.col("item_id").cast("string").alias("ID"),
        F.when(F.col("item_id") % 7 == 0, "NA").otherwise(F.col("text")).alias("Target"),
    )
    Q.write_csv(rows, path)
    return Q.resolve(Q.read_csv(t.spark, path, "ID string, Target string"))


@query("json_maps", f"select id, pred from {TURNS}")
def json_maps(t: Tables):
    """A fold cache in several objects of at most 30 or so texts."""
    path = fresh(t.spark, "maps")
    Q.write_json_map(turns(t), path, "id", "pred", entries=30)
    return Q.read_json_map(t.spark, path)


@query("cached_fold", f"select id, pred from {TURNS}")
def cached_fold(t: Tables):
    """Predictions computed once, and then read from their cache by the second call."""
    path = fresh(t.spark, "cache")
    Q.cached(t.spark, f"{path}/fold_1.json", f"{path}/fold_1.csv", lambda: turns(t))
    return Q.cached(t.spark, f"{path}/fold_1.json", f"{path}/fold_1.csv", lambda: 1 / 0)


@query(
    "resumed_folds",
    f"select turn::int as fold, conv_id::varchar as id, {STRIPPED} as pred from conversations where turn is not null",
)
def resumed_folds(t: Tables):
    """Every turn a fold, of which the second was done before the run stopped: it is read, the others are computed."""
    path = fresh(t.spark, "resumed")
    fold = lambda k: t.conversations.where(F.col("turn") == k).select(
        F.col("conv_id").cast("string").alias("id"),
        T.whole("text").alias("pred"),
    )
    folds = sorted(r.turn for r in t.conversations.where("turn is not null").select("turn").distinct().collect())  # a name a fold
    done = folds[1:2]
    for k in done:
        Q.write_json_map(fold(k), f"{path}/fold_{k}_predictions.json", "id", "pred")
    return Q.resumed(t.spark, path, {k: (lambda: 1 / 0) if k in done else (lambda k=k: fold(k)) for k in folds})


@query(
    "csv_to_cache",
    "select id, pred from (select conv_id::varchar as id, coalesce(string_agg(role, ' ' order by turn), '') as pred from conversations group by "
    "conv_id)",
)
def csv_to_cache(t: Tables):
    """A fold's CSV read where it has no cache yet."""
    path = fresh(t.spark, "folds")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ")
    Q.write_csv(t.conversations.groupBy(F.col("conv_id").cast("string").alias("ID")).agg(listed.alias("Target")), f"{path}/fold_1.csv")
    return Q.cached(t.spark, f"{path}/fold_1.json", f"{path}/fold_1.csv", lambda: 1 / 0)


@query("label_files", "select string_split('page_' || item_id || '.tar.jpg', '.')[1] as stem, text as target from benchmark where text <> ''")
def label_files(t: Tables):
    """One label file a row, and the folder read back."""
    ship(t.spark)
    path = fresh(t.spark, "labels")
    rows = t.benchmark.select(F.concat(F.lit("page_"), "item_id", F.lit(".tar.jpg")).alias("id"), F.col("text").alias("target"))
    Q.nonempty(Q.label_files(rows, path), "label files").count()
    return Q.read_label_files(t.spark, path)


@query("file_listing", "select 'page_' || item_id || '.gt.txt' as name from benchmark where text <> '' and item_id % 3 = 0")
def file_listing(t: Tables):
    """Rows whose file is there: a semi-join against a listing of the folder, whose contents are not read."""
    ship(t.spark)
    path = fresh(t.spark, "listing")
    rows = t.benchmark.select(F.concat(F.lit("page_"), "item_id").alias("id"), F.when(F.col("item_id") % 3 == 0, F.col("text")).alias("target"))
    Q.label_files(rows, path).count()
    wanted = t.benchmark.select(F.concat(F.lit("page_"), "item_id", F.lit(".gt.txt")).alias("name"))
    return Q.existing(wanted, "name", Q.list_files(t.spark, path, "*.gt.txt").select(F.col("name").alias("file")))


@query(
    "manifest",
    "select 'd' || doc_id || '.png' || chr(9) || source as value from (select doc_id, source from documents where source is not null order by 'd' "
    "|| doc_id limit 100)",
)
def manifest(t: Tables):
    """The first hundred lines of a training manifest by id (a cap that is the sink's)."""
    path = fresh(t.spark, "manifest")
    Q.manifest(t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("target")), 100).write.text(path)
    return t.spark.read.text(path)


RUNS = "(select (p_partkey % 40)::int as run, count(*) as n, list_sort(list(distinct p_size)) as sizes, max(p_name) as best, min(p_retailprice) as price from part group by 1)"


@query("config_scan", f"""
select run::varchar as run, unnest(['name', 'parts.count', 'parts.sizes', 'parts.whole', 'price']) as name,
  unnest(['"' || best || '"', n::varchar, '[' || array_to_string(sizes, ', ') || ']', case when n % 2 = 0 then 'true' else 'false' end, '"' || printf('%.2f', price) || '"']) as value from {RUNS}""")
def config_scan(t: Tables):
    """Configurations of runs over parts, of even runs as YAML, of odd ones in the summaries that they left behind; all of them read back."""
    ship(t.spark)
    path = fresh(t.spark, "config")
    runs = t.part.groupBy((F.col("p_partkey") % 40).cast("int").alias("run")).agg(
        F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_set("p_size")), ", ").alias("sizes"),
        F.max("p_name").alias("best"),
        F.format_string("%.2f", F.min("p_retailprice")).alias("price"),
    )
    whole = F.when(F.col("n") % 2 == 0, "true").otherwise("false")
    yaml = F.format_string('# a run\nname: "%s"\nparts:\n  count: %d\n  sizes: [%s]\n  whole: %s\nprice: "%s"\n', "best", "n", "sizes", whole, "price")
    summary = F.format_string('{"config": {"name": "%s", "parts": {"count": %d, "sizes": [%s], "whole": %s}, "price": "%s"}, "results": []}', "best", "n", "sizes", whole, "price")
    even = F.col("run") % 2 == 0
    files = runs.select(F.when(even, F.concat("run", F.lit(".yaml"))).otherwise(F.concat("run", F.lit("/summary_1.json"))).alias("name"), F.when(even, yaml).otherwise(summary).alias("text"))
    Q.write_files(files, path).count()
    return Q.configurations(t.spark, path)


@query("checked_turns", f"select conv_id, turn, {STRIPPED} as said from conversations where text is not null")
def checked_turns(t: Tables):
    """Turns that were said, or an error if none was."""
    said = t.conversations.where("text is not null").select("conv_id", "turn", T.whole("text").alias("said"))
    return Q.nonempty(said, "conversations")


@query(
    "fixed_decimals",
    "select source, printf('%.4f', avg(n_chars)) as mean, printf('%.2f%%', 100 * count(*) / (select count(*) from documents)::double) as share "
    "from documents group by source",
)
def fixed_decimals(t: Tables):
    """Scores as text of a fixed number of decimals."""
    per = t.documents.groupBy("source").agg(F.avg("n_chars").alias("m"), F.count("*").alias("n"))
    total = t.documents.agg(F.count("*").alias("all"))
    return per.crossJoin(F.broadcast(total)).select(
        "source",
        F.format_string("%.4f", "m").alias("mean"),
        F.format_string("%.2f%%", 100 * F.col("n") / F.col("all").cast("double")).alias("share"),
    )


@query("decoded_images", """
select vec_id as img, (k - 1) // 8 as y, (k - 1) % 8 as x, greatest(0, least(255, floor(128 + 400 * e)))::int as v
from (select vec_id, unnest(embedding)::double as e, unnest(generate_series(1, len(embedding))) as k from embeddings)""")
def decoded_images(t: Tables):
    """Vectors of 64 components as image files of 8 by 8 grey pixels, listed, decoded and laid out as pixels."""
    from quern.sources import images as J

    ship(t.spark)
    path = fresh(t.spark, "images")
    value = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * e.cast("double")))).cast("long")
    hexed = F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(value(e)), 2, "0")), "")
    made = t.embeddings.select(
        F.col("vec_id").cast("string").alias("name"),
        F.lit(8).alias("width"),
        (F.size("embedding") / 8).cast("int").alias("height"),
        F.unhex(hexed).alias("grey"),
    )
    J.write_images(made, path).count()
    back = J.read_images(t.spark, path).withColumn("img", F.regexp_extract("path", r"([^/]+)\.png$", 1).cast("long"))
    return J.pixels(back, "img")


@query("decoded_colours", """
with e as (select vec_id as img, unnest(embedding)::double as e, unnest(generate_series(0, len(embedding) - 1)) as k from embeddings),
c as (select img, greatest(0, least(255, floor(128 + 400 * e)))::int as r, (greatest(0, least(255, floor(128 + 400 * e)))::int * 7 + 31) % 256 as g, 255 - greatest(0, least(255, floor(128 + 400 * e)))::int as b from e)
select img, sum(r)::bigint as red, sum(g)::bigint as green, sum(b)::bigint as blue, sum(round_even(0.299::double * r + 0.587::double * g + 0.114::double * b, 0))::bigint as grey from c group by img""")
def decoded_colours(t: Tables):
    """Vectors as coloured image files, decoded again: sums of each colour and of the grey made of them."""
    from quern.operators.pages import by_rows
    from quern.sources import images as J

    ship(t.spark)
    path = fresh(t.spark, "colours")
    value = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * e.cast("double")))).cast("long")
    plane = lambda change: F.unhex(F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(change(value(e))), 2, "0")), ""))
    made = t.embeddings.select(
        F.col("vec_id").cast("string").alias("name"),
        F.lit(8).alias("width"),
        (F.size("embedding") / 8).cast("int").alias("height"),
        plane(lambda v: v).alias("red"),
        plane(lambda v: (v * 7 + 31) % 256).alias("green"),
        plane(lambda v: 255 - v).alias("blue"),
    )
    J.write_images(made, path).count()
    back = J.read_images(t.spark, path).withColumn("img", F.regexp_extract("path", r"([^/]+)\.png$", 1).cast("long"))
    sums = lambda row: [(row["img"], *[sum(row[c]) for c in ("red", "green", "blue", "grey")])]
    return by_rows(back.select("img", "red", "green", "blue", "grey"), sums, "img long, red long, green long, blue long, grey long")
