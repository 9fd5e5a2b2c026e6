"""Secret scan with multipart credential linking (DataFrame functions only).

Three base kinds stand alone: assignments of 12 or more characters to a secret-like name, access keys of 18 or more
characters, and lower-case hex runs of 16 or more. Three weak kinds are only parts of a credential: identifiers
(``ident``), unnamed token strings (``part``) and endpoints (``endpoint``). Parts are linked by an interval join
inside scopes: two spans of a document belong together when at most ``reach`` code points lie between them. An
identifier counts if a secret (base or part) is in reach, a part if an identifier or access key is, and an endpoint if
both are. Weak spans that overlap a base span are dropped, as the base span says it already.

Positions come from cutting a text at its matches: the lengths of the gaps and of the matches, summed in order,
are the code-point offsets. The interval join meets on cells of ``CELL`` code points of one document, so
a cell holds a bounded number of spans, whatever the length of the text.

Defined cases: a null text is empty and has no span; repeated rows are scanned one by one; ties in
start are listed in the order of ``KINDS``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stages

KINDS = ("assign", "access", "hex", "ident", "part", "endpoint")
BASE = 3
#: kind -> (pattern, group whose length counts, least length of it)
PATTERNS = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
    "ident": (r"(?i:client_?id|key_?id|user_?id|user_?name|login|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@+/_.-]+", 0, 0),
    "part": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+", 0, 24),
    "endpoint": (r"[a-z][a-z0-9+]*+://[A-Za-z0-9.:@/_-]+", 0, 0),
}
REACH = 200
CELL = 256


def _cut(text: Column, kind: str) -> Column:
    """Matches of one kind as array<struct<gap, hit, counted>>: code points before it since the last, in it, and in its counted group."""
    pattern, group, _ = PATTERNS[kind]
    length = lambda x: F.length(x)
    gaps = F.transform(F.split(text, pattern, -1), length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), length) if group else hits
    found = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), counted.alias("counted"))
    return F.when(
        text.rlike(pattern),
        F.transform(found, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), x["counted"].alias("counted"))),
    )


def spans(docs: DataFrame, stages: Stages, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has row, doc_id; spans has row, kind (its place in KINDS), start, end."""
    text = F.coalesce("text", F.lit(""))
    cuts = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("kind"),
                    F.lit(PATTERNS[name][2]).alias("least"),
                    _cut(text, name).alias("found"),
                ) for k, name in enumerate(KINDS)
            ]
        ),
        lambda x: x["found"].isNotNull(),
    )
    cut = stages.put(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", cuts.alias("cuts")), "cuts")
    each = cut.select("row", F.explode("cuts").alias("c")).select("row", "c.kind", "c.least", F.posexplode("c.found").alias("n", "m"))
    running = Window.partitionBy("row", "kind").orderBy("n")
    each = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.hit")).over(running)).where("m.counted >= least")
    found = stages.put(each.select("row", "kind", (F.col("end") - F.col("m.hit")).alias("start"), "end"), "spans")

    base, weak = found.where(F.col("kind") < BASE), found.where(F.col("kind") >= BASE)
    weak = weak.join(
        _keys(_celled(weak, 0), _celled(base, 0), F.col("x.start") < F.col("y.end"), F.col("y.start") < F.col("x.end")),
        ["row", "kind", "start", "end"],
        "left_anti",
    )
    parts = stages.put(base.union(weak), "parts")
    near = (F.col("x.start") <= F.col("y.end") + reach, F.col("y.start") <= F.col("x.end") + reach)
    names, holds = (F.col("kind").isin(*[KINDS.index(k) for k in ks]) for ks in (("access", "ident"), ("assign", "hex", "part")))
    weak = parts.where(F.col("kind") >= BASE)
    by_name = _keys(_celled(weak.where(F.col("kind") != KINDS.index("ident")), reach), _celled(parts.where(names), 0), *near)
    by_hold = _keys(_celled(weak.where(F.col("kind") != KINDS.index("part")), reach), _celled(parts.where(holds), 0), *near)
    meets = by_name.withColumn("named", F.lit(1)).withColumn("held", F.lit(0)).union(
        by_hold.withColumn("named", F.lit(0)).withColumn("held", F.lit(1))
    )
    meets = meets.groupBy("row", "kind", "start", "end").agg(F.max("named").alias("named"), F.max("held").alias("held"))
    linked = meets.where((F.col("kind") != KINDS.index("endpoint")) | (F.col("named") + F.col("held") == 2))
    return cut.select("row", "doc_id"), parts.where(F.col("kind") < BASE).union(linked.select("row", "kind", "start", "end"))


def _celled(parts: DataFrame, reach: int) -> DataFrame:
    """Each span once for every cell that it reaches."""
    lo, hi = F.floor((F.col("start") - reach) / CELL), F.floor((F.col("end") + reach) / CELL)
    return parts.withColumn("cell", F.explode(F.sequence(lo, hi)))


def _keys(x: DataFrame, y: DataFrame, *where: Column) -> DataFrame:
    """Distinct spans of x with some span of y in a common cell for which ``where`` holds."""
    on = (F.col("x.row") == F.col("y.row")) & (F.col("x.cell") == F.col("y.cell"))
    for w in where:
        on &= w
    return x.alias("x").join(y.alias("y"), on, "left_semi").select("row", "kind", "start", "end").distinct()


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row a document: doc_id, a count a base kind, base_sha256, spans, n_linked (weak spans reported)."""
    rows, found = spans(docs, Stages(docs.sparkSession, "secrets"), reach)
    names = F.array(*map(F.lit, KINDS))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    per = found.groupBy("row").agg(
        listed.alias("all"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.count_if(F.col("kind") >= BASE).alias("n_linked"),
    )
    said = lambda some: F.array_join(
        F.transform(some, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])),
        ",",
    )
    out = rows.join(per, "row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(said(F.filter("all", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"),
        said(F.col("all")).alias("spans"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
