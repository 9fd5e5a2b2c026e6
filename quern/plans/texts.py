"""Text scores, cleaning, edit distances, ensembles and duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import edit as D
from quern.functions import ensemble as E
from quern.functions import text as T
from quern.operators import dedup as U
from quern.operators import similarity as M

from .registry import Tables, query

r6 = lambda c, name: F.round(c, 6).alias(name)
quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
A = "coalesce(text, '')"
SPLIT = f"list_filter(string_split_regex({{0}}, '[{T.SPACE}]+'), lambda w: w <> '')"
RUNS = f"regexp_extract_all(t, '[{T.LETTERS}]+')"
N = f"len({SPLIT.format('t')})"
found = lambda p, o="": f"len(regexp_extract_all(t, '{p}'{o}))"
ratio = lambda a, b: f"case when {b} > 0 then ({a})::double / {b} else 0 end"

WORD_FREQ_CTE = f"""
docs as (select doc_id, {A} as t from documents),
each as (select doc_id, word, count(*) as n from (select doc_id, unnest({SPLIT.format('lower(t)')}) as word from docs) group by all),
freqs as (select word, sum(n)::double / (select sum(n) from each) as freq from each group by word),
mid as (select median(freq) as m from freqs)"""
# Edges of words are marked by two private characters, as this SQL's own edges know ASCII words only.
OPEN, SHUT = "\uf8fe", "\uf8ff"
MARKED = f"regexp_replace(t, '([{T.LETTERS}]+)', '{OPEN}\\1{SHUT}', 'g')"
ARCHAIC_SQL = " + ".join(f"len(regexp_extract_all({MARKED if E in p else 't'}, '(?i){p}'))" for E in [r"\b"] for p in [
    x.replace("[o|i]", f"(?:[oi]|{SHUT}\\|)") for x in T.ARCHAIC])
ARCHAIC_SQL = ARCHAIC_SQL.replace(r"(?i)\b", f"(?i){OPEN}").replace(r"\b", SHUT)
NAMES_SQL = (
    f"len(list_filter(list_transform({RUNS}, lambda r: regexp_extract(r, '^[A-Z][a-z]+')), lambda w: w <> '' and w not in "
    f"({quoted(T.KNOWN_NAMES)})))"
)
NUMBERS_SQL = rf"list_filter({RUNS}, lambda r: regexp_full_match(r, '\p{{Nd}}+'))"
SCORES_CTE = f"""
rare as (
  select doc_id, sum(n) filter (regexp_replace(word, '[^{T.LETTERS}{T.SPACE}]', '', 'g') not in ({quoted(T.BOILERPLATE)}) and freq < m)::double / sum(n) as rare
  from each join freqs using (word), mid group by doc_id),
scores as (
  select doc_id, length(t) as text_length, {N} as word_count,
    least(100, 100 * ({ratio(f"len(list_distinct({SPLIT.format('lower(t)')}))", N)})) as vocabulary_diversity,
    least(100, 200 * coalesce(rare, 0)) as rare_word_ratio,
    least(100, 500 * ({ratio(NAMES_SQL, N)})) as named_entity_score,
    case when {N} > 0 then least(100, 300 * ({ratio(f'len({NUMBERS_SQL})', N)}) + 5 * ({ratio(f"length(array_to_string({NUMBERS_SQL}, ''))", f'len({NUMBERS_SQL})')})) else 0 end as number_complexity,
    least(100, 500 * ({ratio(found(T.SPECIAL), N)})) as special_char_complexity,
    least(100, 500 * ({ratio(ARCHAIC_SQL, N)})) as historical_spelling,
    least(100, length(t) / 2.0) as text_length_complexity,
    least(100, 500 * ({ratio(found(T.PUNCTUATION), 'length(t)')})) as punctuation_complexity
  from docs left join rare using (doc_id)),
scored as (select *, {" + ".join(f"{k} * {w}" for k, w in T.WEIGHTS.items())} as difficulty_score from scores)"""
ROUNDED = ", ".join(f"round({k}, 6) as {k}" for k in T.WEIGHTS)


@query("word_freq", f"with {WORD_FREQ_CTE} select word, round(freq, 9) as freq, freq < m as rare from freqs, mid")
def word_freq(t: Tables):
    f = U.word_frequencies(U.document_words(t.dealt("documents")))
    return f.select("word", F.round("freq", 9).alias("freq"), (F.col("freq") < F.col("median")).alias("rare"))


@query(
    "text_scores",
    f"with {WORD_FREQ_CTE}, {SCORES_CTE} select doc_id, text_length, word_count, {ROUNDED}, round(difficulty_score, 5) as difficulty_score from "
    f"scored",
)
def text_scores(t: Tables):
    s = U.scored(t.dealt("documents"))
    return s.select(
        "doc_id",
        "text_length",
        "word_count",
        *[r6(F.col(k), k) for k in T.WEIGHTS],
        F.round("difficulty_score", 5).alias("difficulty_score"),
    )


@query(
    "text_difficulty_top10",
    f"with {WORD_FREQ_CTE}, {SCORES_CTE} select doc_id, round(difficulty_score, 5) as difficulty_score from scored order by "
    f"round(difficulty_score, 5) desc, doc_id limit 10",
)
def text_difficulty_top10(t: Tables):
    s = U.scored(t.dealt("documents")).select("doc_id", F.round("difficulty_score", 5).alias("difficulty_score"))
    return s.orderBy(F.desc("difficulty_score"), "doc_id").limit(10)


DIGIT, CAPITAL, LETTER = r"\p{Nd}", r"\p{Lu}", r"\p{L}"


@query("text_densities", f"""
select doc_id, round({found(f'[^{T.MARKLESS}]')} / greatest(length(t), 1)::double, 6) as special, round({found(DIGIT)} / greatest(length(t), 1)::double, 6) as digit,
  round({ratio(found(CAPITAL), found(LETTER))}, 6) as upper, round({ratio(f"len(list_distinct({SPLIT.format('lower(t)')}))", N)}, 6) as lexical,
  round({ratio(f"length(array_to_string({SPLIT.format('t')}, ''))", N)}, 6) as word_length,
  round({ratio("len(list_distinct(regexp_extract_all(t, '(?s).')))", 'length(t)')}, 6) as characters
from (select doc_id, {A} as t from documents)""")
def text_densities(t: Tables):
    x = T.whole("text")
    return t.dealt("documents").select(
        "doc_id",
        r6(T.density(x, f"[^{T.MARKLESS}]"), "special"),
        r6(T.density(x, DIGIT), "digit"),
        r6(T.uppercase_ratio(x), "upper"),
        r6(T.lexical_diversity(x), "lexical"),
        r6(T.avg_word_length(x), "word_length"),
        r6(T.char_diversity(x), "characters"),
    )


@query("proxy_difficulty", f"""
select doc_id, round(50 * d + 30 * u + 20 * l, 5) as difficulty, round(100 * u, 6) as named, round(100 * d, 6) as number
from (select doc_id, {found(DIGIT)} / greatest(length(t), 1)::double as d, {ratio(found(CAPITAL), found(LETTER))} as u, {ratio(f"len(list_distinct({SPLIT.format('lower(t)')}))", N)} as l from (select doc_id, {A} as t from documents))""")
def proxy_difficulty(t: Tables):
    x = T.whole("text")
    p = t.dealt("documents").select("doc_id", T.density(x, DIGIT).alias("d"), T.uppercase_ratio(x).alias("u"), T.lexical_diversity(x).alias("l"))
    return p.select(
        "doc_id",
        F.round(50 * F.col("d") + 30 * F.col("u") + 20 * F.col("l"), 5).alias("difficulty"),
        r6(100 * F.col("u"), "named"),
        r6(100 * F.col("d"), "number"),
    )


CLEANED = f"""
select conv_id, turn, trim(regexp_replace(d, '[{T.SPACE}]+', ' ', 'g')) as cleaned from (select conv_id, turn, string_split(c, 'Assistant:')[-1] as d from (select conv_id, turn, string_split(b, 'assistant')[-1] as c from (
  select conv_id, turn, string_split(a, '<|user|>')[-1] as b from (select conv_id, turn, string_split('<|assistant|> ' || role || ' said: ' || {A}, '<|assistant|>')[-1] as a from conversations))))"""


@query("clean_output", CLEANED)
def clean_output(t: Tables):
    said = F.concat(F.lit("<|assistant|> "), "role", F.lit(" said: "), T.whole("text"))
    return t.conversations.select("conv_id", "turn", T.squeeze(T.after_artifacts(said)).alias("cleaned"))


# The first place where a token is followed by enough repeats of itself, else a phrase of two, else of three: enough places in a row hold the
# token that stands so many further on.
def uncut(rows: str, key: str) -> str:
    """``rows`` of key and t, with t up to its first excessive repetition."""
    same = lambda k: f"coalesce(w = lead(w, {k}) over p, false)::int as s{k}"
    full = lambda k, most: f"sum(s{k}) over (partition by row order by i rows between current row and {k * most - 1} following) = {k * most}"
    marks = ", ".join(f"'{m}'" for m in D.LOOSE)
    return f"""(
  with texts as materialized (select *, row_number() over () as row, {SPLIT.format("coalesce(t, '')")} as ws from {rows}),
  tokens as (select row, unnest(ws) as w, unnest(generate_series(1, len(ws))) as i from texts where length(t) >= 10 and len(ws) >= 5),
  ahead as (select *, {same(1)}, {same(2)}, {same(3)} from tokens window p as (partition by row order by i)),
  found as (select row, i, case when w in ({marks}) then {full(1, D.LOOSE_MOST)} else {full(1, 5)} end as one, {full(2, 5)} as two, {full(3, 5)} as three from ahead),
  cuts as (select row, coalesce(min(i) filter (one), min(i) filter (two), min(i) filter (three)) as cut from found group by row)
  select {key}, case when cut is null then t else array_to_string(ws[1:cut - 1], ' ') end as t from texts left join cuts using (row))"""


@query("repetition_filter", f"select doc_id, t as text from {uncut('(select doc_id, text as t from documents)', 'doc_id')}")
def repetition_filter(t: Tables):
    """Whole texts cut at their first excessive repetition."""
    from quern.plans.ship import ship

    ship(t.spark)
    return t.dealt("documents").select("doc_id", D.without_repetitions("text").alias("text"))


CUT_OUT = CLEANED.replace(f"trim(regexp_replace(d, '[{T.SPACE}]+', ' ', 'g')) as cleaned", "d as t")


@query(
    "clean_chained",
    f"select conv_id, turn, trim(regexp_replace(t, '[{T.SPACE}]+', ' ', 'g')) as cleaned from {uncut(f'({CUT_OUT})', 'conv_id, turn')}",
)
def clean_chained(t: Tables):
    """The whole cleaner: what follows the last artifact, cut at its first excessive repetition, with white space squeezed."""
    from quern.plans.ship import ship

    ship(t.spark)
    said = F.concat(F.lit("<|assistant|> "), "role", F.lit(" said: "), T.whole("text"))
    return t.dealt("conversations").select("conv_id", "turn", T.squeeze(D.without_repetitions(T.after_artifacts(said))).alias("cleaned"))


@query("label_cleaning", f"""
select item_id, trim(regexp_replace(t, '[{T.SPACE}]+', ' ', 'g')) as squeezed,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')), lambda x: x <> ''), ' ') as lines,
  case when length(t) > 60 then t[1:60] || '...' else t end as preview, string_split('img_' || item_id || '.tar.gz', '.')[1] as stem
from (select item_id, {A} as t from benchmark)""")
def label_cleaning(t: Tables):
    x = T.whole("text")
    name = F.concat(F.lit("img_"), "item_id", F.lit(".tar.gz"))
    return t.benchmark.select(
        "item_id",
        T.squeeze(x).alias("squeezed"),
        T.clean_lines(x).alias("lines"),
        T.preview(x).alias("preview"),
        T.stem(name).alias("stem"),
    )


PAIR = f"select conv_id, turn, {A} as ref, regexp_replace(translate({A}, 'aeo', 'xe'), 'th', 't', 'g') as pred from conversations"
# This SQL measures bytes: the characters of a pair, at most 127, are coded as single ones first; more raise.
ASCII = "".join(map(chr, range(1, 128))).replace("'", "''")


def coded(rows: str, a: str, b: str) -> str:
    """``rows`` with edits, the edit distance of columns ``a`` and ``b``."""
    known = f"list_distinct(regexp_extract_all({a} || {b}, '(?s).'))"
    return f"""(select * exclude (known, k, c), levenshtein(translate({a}, k, c), translate({b}, k, c)) as edits from (
      select *, array_to_string(known, '') as k, case when len(known) > 127 then error('more than 127 characters') else '{ASCII}'[1:len(known)] end as c from (select *, {known} as known from {rows})))"""


CODED = coded(f"({PAIR})", "ref", "pred")


def pairs(t: Tables):
    """References and a deterministic corruption of them."""
    from quern.plans.ship import ship

    ship(t.spark)
    x = T.whole("text")
    return t.dealt("conversations").select("conv_id", "turn", x.alias("ref"), F.regexp_replace(F.translate(x, "aeo", "xe"), "th", "t").alias("pred"))


def measured(t: Tables):
    """Pairs with the edits of characters and of words, and the lengths that they are taken over."""
    return pairs(t).select(
        "conv_id",
        "turn",
        D.char_distance("ref", "pred").alias("char_edits"),
        F.length("ref").alias("chars"),
        D.word_distance("ref", "pred").alias("word_edits"),
        F.size(T.words(F.col("ref"))).alias("words"),
    )


@query("char_errors", f"select conv_id, turn, edits, length(ref) as length from {CODED}")
def char_errors(t: Tables):
    return pairs(t).select("conv_id", "turn", D.char_distance("ref", "pred").alias("edits"), F.length("ref").alias("length"))


@query("cer", f"select round(sum(edits) / greatest(sum(length(ref)), 1)::double, 6) as cer from {CODED}")
def cer(t: Tables):
    return pairs(t).agg(r6(D.micro(D.char_distance("ref", "pred"), F.length("ref")), "cer"))


# Word distances, row by row of the table: all cells of a row come from the row before it, and a running minimum.
WORDED = f"""
with recursive lists as materialized (select row_number() over () as p, conv_id, turn, {SPLIT.format('ref')} as a, {SPLIT.format('pred')} as b from ({PAIR})),
known as materialized (select w, row_number() over () as code from (select distinct unnest(a || b) as w from lists)),
rows_ as materialized (select p, i, code from (select p, unnest(generate_series(1, len(a))) as i, unnest(a) as w from lists) join known using (w)),
steps as (
  select p, 0::bigint as i, j, j as d, code from (select p, unnest(generate_series(0, len(b))) as j, unnest([''] || b) as w from lists) left join known using (w)
  union all
  select p, i, j, j + min(least_ - j) over (partition by p order by j), code from (
    select s.p, s.i + 1 as i, s.j, s.code, least(s.d + 1, coalesce(lag(s.d) over (partition by s.p order by s.j) + (r.code <> s.code)::int, s.d + 1)) as least_
    from steps s join rows_ r on s.p = r.p and r.i = s.i + 1)),
worded as (select conv_id, turn, s.d as edits, len(l.a) as length from lists l join steps s on l.p = s.p and s.i = len(l.a) and s.j = len(l.b))"""


@query("word_errors", f"{WORDED} select conv_id, turn, edits, length from worded")
def word_errors(t: Tables):
    """Word edit distances of all pairs, of any length."""
    return measured(t).select("conv_id", "turn", F.col("word_edits").alias("edits"), F.col("words").alias("length"))


@query("wer", f"{WORDED} select round(sum(edits) / greatest(sum(length), 1)::double, 6) as wer from worded")
def wer(t: Tables):
    """Corpus word error rate over all pairs, of any length."""
    return pairs(t).agg(r6(D.micro(D.word_distance("ref", "pred"), F.size(T.words(F.col("ref")))), "wer"))


@query("competition_score", f"""{WORDED}, scored as (
select conv_id, sum(w.edits) / greatest(sum(w.length), 1)::double as wer, sum(c.edits) / greatest(sum(length(ref)), 1)::double as cer from worded w join {CODED} c using (conv_id, turn) group by conv_id)
select conv_id, round(wer, 6) as wer, round(cer, 6) as cer, round(0.5 * wer + 0.5 * cer, 6) as score, round(0.7 * cer + 0.3 * wer, 6) as weighted from scored""")
def competition_score(t: Tables):
    w, c = F.col("wer"), F.col("cer")
    rates = measured(t).groupBy("conv_id").agg(
        D.micro(F.col("word_edits"), F.col("words")).alias("wer"),
        D.micro(F.col("char_edits"), F.col("chars")).alias("cer"),
    )
    return rates.select("conv_id", r6(w, "wer"), r6(c, "cer"), r6(0.5 * w + 0.5 * c, "score"), r6(0.7 * c + 0.3 * w, "weighted"))


@query(
    "weighted_score",
    f"select round(sum(sqrt(length(ref)) * least(1, edits / length(ref)::double)) / sum(sqrt(length(ref))), 6) as weighted_cer from {CODED} where "
    f"length(ref) > 0",
)
def weighted_score(t: Tables):
    """Long references weigh more: weights are lengths to the power 0.5, errors are cut at 1."""
    p = pairs(t).where(F.length("ref") > 0).select(
        F.sqrt(F.length("ref")).alias("w"),
        F.least(F.lit(1.0), D.char_distance("ref", "pred") / F.length("ref").cast("double")).alias("e"),
    )
    return p.agg(r6(F.sum(F.col("w") * F.col("e")) / F.sum("w"), "weighted_cer"))


SET = "case when turn = 0 then 'first' else role end"
WEIGHED = "case when count(*) filter (matched) = 0 then 1 else sum({1} ** 0.5 * least(1, {0} / {1}::double)) filter (matched and {1} > 0) / sum({1} ** 0.5) filter (matched and {1} > 0) end"


@query("set_scores", f"""{WORDED}, m as (
  select {SET} as name, c.edits as ce, length(c.ref) as cn, w.edits as we, w.length as wn, turn > 0 as matched
  from {CODED} c join worded w using (conv_id, turn) join (select conv_id, turn, role from conversations) using (conv_id, turn)),
s as (select name, count(*) filter (matched) as samples, count(*) as total, {WEIGHED.format('ce', 'cn')} as cer, {WEIGHED.format('we', 'wn')} as wer from m group by name)
select name, samples, total, round(cer, 6) as cer, round(wer, 6) as wer, round(0.7 * cer + 0.3 * wer, 6) as final from s""")
def set_scores(t: Tables):
    """Reference sets scored by length-weighted rates; first turns have no prediction here, so nothing of their set matches and all its rates are 1."""
    p = pairs(t)
    role = F.when(F.col("turn") == 0, "first").otherwise(F.col("role")).alias("set")
    refs = t.conversations.select("conv_id", "turn", role, T.whole("text").alias("ref"))
    s = D.evaluated(refs, p.where("turn > 0").select("conv_id", "turn", "pred"), ["conv_id", "turn"], "set")
    return s.select(F.col("set").alias("name"), "samples", "total", r6(F.col("cer"), "cer"), r6(F.col("wer"), "wer"), r6(F.col("final"), "final"))


@query(
    "fold_mean_std",
    f"select round(avg(cer), 6) as mean, round(stddev_pop(cer), 6) as std, round(min(cer), 6) as best from (select turn, sum(edits) / "
    f"greatest(sum(length(ref)), 1)::double as cer from {CODED} group by turn)",
)
def fold_mean_std(t: Tables):
    per = pairs(t).groupBy("turn").agg(D.micro(D.char_distance("ref", "pred"), F.length("ref")).alias("cer"))
    return per.agg(r6(F.avg("cer"), "mean"), r6(F.stddev_pop("cer"), "std"), r6(F.min("cer"), "best"))


@query(
    "fold_ranks",
    f"select turn, cer, row_number() over (order by cer, turn) as place, rank() over (order by cer) as rank from (select turn, round(sum(edits) / "
    f"greatest(sum(length(ref)), 1)::double, 6) as cer from {CODED} group by turn)",
)
def fold_ranks(t: Tables):
    """Folds from the best to the worst; there are as many rows as folds."""
    per = pairs(t).groupBy("turn").agg(r6(D.micro(D.char_distance("ref", "pred"), F.length("ref")), "cer"))
    return per.select(
        "turn",
        "cer",
        F.row_number().over(Window.orderBy("cer", "turn")).alias("place"),
        F.rank().over(Window.orderBy("cer")).alias("rank"),
    )


@query(
    "empty_predictions",
    f"select count(*) filter (length(t) < 100) as n_short, round(avg((length(t) < 100)::int), 6) as share, min(length(t)) as least, max(length(t)) "
    f"as most, round(avg(length(t)), 6) as mean from (select {A} as t from conversations)",
)
def empty_predictions(t: Tables):
    n = F.length(T.whole("text"))
    return t.conversations.agg(
        F.count_if(n < 100).alias("n_short"),
        r6(F.avg((n < 100).cast("int")), "share"),
        F.min(n).alias("least"),
        F.max(n).alias("most"),
        r6(F.avg(n), "mean"),
    )


# Predictions of each conversation: its turns' texts, in order.
PREDS = f"(select conv_id, list({A} order by turn) as p from conversations group by conv_id)"
SEEN = "list_transform(list_distinct(p), lambda x: {{'k': {0}, 'at': list_position(p, x), 'v': x}})"
PICK = "list_sort(" + SEEN + ")[1].v"


def predictions(t: Tables):
    from quern.plans.ship import ship

    ship(t.spark)
    listed = F.array_sort(F.collect_list(F.struct("turn", T.whole("text").alias("text"))))
    return t.conversations.groupBy("conv_id").agg(F.transform(listed, lambda x: x["text"]).alias("p"))


def _picked(strategy: str):
    return lambda t: predictions(t).select("conv_id", E.ensemble(F.col("p"), strategy).alias("pred"))


for _name, _key in {"majority": "-len(list_filter(p, lambda y: y = x))", "longest": "-length(x)", "shortest": "length(x)"}.items():
    query(f"ens_{_name}", f"select conv_id, {PICK.format(_key)} as pred from {PREDS}")(_picked(_name))
query("ens_first", f"select conv_id, p[1] as pred from {PREDS}")(_picked("first"))

# Votes by place: the most frequent character, the first seen on ties.
VOTE = """(
select conv_id, i, arg_min(c, (-n, seen)) as c from (
  select conv_id, i, c, count(*) as n, min(f) as seen from (
    select conv_id, i, f, {0} as c from (
      select *, unnest(generate_series(1, len(p))) as f from (select conv_id, p, unnest(generate_series(1, list_max(list_transform(p, lambda x: length(x))))) as i from {1})))
  where c <> '' group by all) group by conv_id, i)"""
CHARS = (
    f"select conv_id, case when any_value(len(p)) = 1 then any_value(p[1]) else coalesce({{0}}, '') end as pred from {PREDS} left join {{1}} using "
    f"(conv_id) group by conv_id"
)
VOTED = CHARS.format(
    r"regexp_replace(string_agg(c, '' order by i), '[" + T.SPACE + r"]+$', '')",
    VOTE.format("case when length(p[f]) >= i then substr(p[f], i, 1) else ' ' end", PREDS),
)
query("ens_char_vote", VOTED)(_picked("char_voting"))
query("ens_rover", CHARS.format("string_agg(c, '' order by i)", VOTE.format("replace(substr(p[f], i, 1), '-', '')", PREDS)))(_picked("rover"))
RISKS = coded(
    f"""(select a.conv_id, a.p, a.f, a.x, b.x as y from (select conv_id, p, unnest(p) as x, unnest(generate_series(1, len(p))) as f from {PREDS}) a join (select conv_id, unnest(p) as x from {PREDS}) b using (conv_id) where a.x <> '' and b.x <> '')""",
    "x",
    "y",
)
query("ens_mbr", f"""
select conv_id, case when any_value(len(p)) = 1 then any_value(p[1]) else coalesce(arg_min(x, (risk, f)), '') end as pred from (
  select conv_id, p, f, x, coalesce(avg(edits) filter (y <> x), 0) as risk from {RISKS} group by all) group by conv_id""")(_picked("mbr"))


MODE = f"{PICK.format('-len(list_filter(p, lambda y: y = x))')}"


@query(
    "fold_agreement",
    f"select conv_id, len(list_distinct(p)) as n_distinct, round(list_max(list_transform(p, lambda x: len(list_filter(p, lambda y: y = x)))) / "
    f"len(p)::double, 6) as agreement, len(list_distinct(p)) = 1 as full_agreement, {MODE} as most_common from {PREDS}",
)
def fold_agreement(t: Tables):
    p = F.col("p")
    top = F.array_max(F.transform(p, lambda x: E.times(p, x)))
    return predictions(t).select(
        "conv_id",
        F.size(F.array_distinct(p)).alias("n_distinct"),
        r6(top / F.size(p).cast("double"), "agreement"),
        (F.size(F.array_distinct(p)) == 1).alias("full_agreement"),
        E.majority(p).alias("most_common"),
    )


COMPARED = ["char_voting", "first", "longest", "majority", "shortest"]


@query("strategy_compare", f"""
select conv_id, unnest({COMPARED}) as strategy, unnest([v.pred, p[1], {PICK.format('-length(x)')}, {MODE}, {PICK.format('length(x)')}]) as pred from {PREDS} join ({VOTED}) v using (conv_id)""")
def strategy_compare(t: Tables):
    wide = predictions(t).select("conv_id", *[E.ensemble(F.col("p"), s).alias(s) for s in COMPARED])
    return wide.unpivot("conv_id", COMPARED, "strategy", "pred")


@query(
    "two_model",
    f"select conv_id, case when p[1] = p[2] then p[1] when length(p[2]) < length(p[1]) then p[2] else p[1] end as pred, p[1] = p[2] as agree from "
    f"{PREDS} where len(p) >= 2",
)
def two_model(t: Tables):
    p = predictions(t).where(F.size("p") >= 2)
    return p.select("conv_id", E.two_model(F.col("p")[0], F.col("p")[1]).alias("pred"), (F.col("p")[0] == F.col("p")[1]).alias("agree"))


@query(
    "json_cache",
    f"select conv_id || ':' || turn as id, coalesce(regexp_replace(text, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g'), '') as pred from conversations",
)
def json_cache(t: Tables):
    """A fold's predictions through the shape of their JSON cache: one object, and back to rows."""
    object_ = t.conversations.select(F.to_json(F.create_map(F.concat_ws(":", "conv_id", "turn"), T.strip(F.col("text")))).alias("j"))
    back = object_.select(F.explode(F.from_json("j", "map<string,string>")).alias("id", "pred"))
    return back.select("id", T.whole("pred").alias("pred"))


# Exact duplicates.
KEY = f"regexp_replace(lower({A}), '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')"
KEYED = f"(select doc_id, source, {KEY} as key from documents)"


@query("dedup_first", f"select doc_id from (select doc_id, row_number() over (partition by key order by doc_id) as n from {KEYED}) where n = 1")
def dedup_first(t: Tables):
    return U.keep_first(U.keyed(t.documents), "doc_id").select("doc_id")


@query(
    "dup_flags",
    f"select doc_id, doc_id > min(doc_id) over (partition by key) as later, count(*) over (partition by key) > 1 as any_copy from {KEYED}",
)
def dup_flags(t: Tables):
    return U.flags(U.keyed(t.documents), "doc_id").select("doc_id", "later", "any_copy")


@query("dup_report", f"select key, count(*) as copies, list_sort(list(doc_id))[1:5] as first_ids from {KEYED} group by key having count(*) > 1")
def dup_report(t: Tables):
    return U.report(U.keyed(t.documents), "doc_id")


@query(
    "dup_group_id",
    f"select doc_id, coalesce(g, -1) as dup_group from {KEYED} left join (select key, (dense_rank() over (order by count(*) desc, key) - 1)::int "
    f"as g from {KEYED} group by key having count(*) > 1) using (key)",
)
def dup_group_id(t: Tables):
    return U.group_ids(U.keyed(t.documents), "doc_id")


@query(
    "leak_check",
    f"select key, count(*) filter (doc_id % 5 <> 0) as n_train, count(*) filter (doc_id % 5 = 0) as n_val from {KEYED} group by key having n_train "
    f"> 0 and n_val > 0",
)
def leak_check(t: Tables):
    """Copies of each text on both sides of a split (every fifth id validates: the split is the feature)."""
    return U.leaks(U.keyed(t.documents), "doc_id", F.col("doc_id") % 5 == 0)


@query(
    "group_representative",
    f"select key, arg_min(doc_id, doc_id) as doc_id, arg_min(source, doc_id) filter (source is not null) as source, arg_min(quality, doc_id) "
    f"filter (quality is not null) as quality from {KEYED} left join labels using (doc_id) group by key",
)
def group_representative(t: Tables):
    from quern.operators.splits import representatives

    rows = U.keyed(t.documents).select("doc_id", "source", "digest").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    found = representatives(rows, "digest", "doc_id")
    return U.with_keys(found.withColumn("first", F.col("doc_id")), U.keyed(t.documents), "doc_id").select("key", "doc_id", "source", "quality")


# TF-IDF similarity: 1- to 3-grams of tokens of two or more word characters, the 500 commonest in two or more texts.
GRAMS = r"""
toks as (select item_id as doc, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') as w from benchmark),
grams as (select doc, array_to_string(w[i : i + k - 1], ' ') as term from (select doc, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from toks, (select unnest([1, 2, 3]) as k) where len(w) >= k)),
tf as (select doc, term, count(*) as n from grams group by all),
vocab as (select term, count(*) as df, sum(n) as total from tf group by term having df >= 2 order by total desc, term limit 500),
weights as (select doc, term, n * (ln((1 + (select count(*) from toks)) / (1 + df)::double) + 1) as w from tf join vocab using (term)),
unit as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) as w from weights),
sims as (select a.doc as i, b.doc as j, sum(a.w * b.w) as sim from unit a join unit b on a.term = b.term and a.doc < b.doc group by all)"""


@query("tfidf", f"with {GRAMS} select doc, term, round(w, 6) as w from unit")
def tfidf(t: Tables):
    return M.tfidf(t.benchmark.select(F.col("item_id").alias("doc"), T.whole("text").alias("text"))).select("doc", "term", r6(F.col("w"), "w"))


def _items(t: Tables):
    return M.classes(t.benchmark.select(F.col("item_id").alias("doc"), T.whole("text").alias("text")))


TURNS = GRAMS.replace("item_id as doc", "conv_id || ':' || turn as doc").replace("from benchmark", "from conversations")


def _turns(t: Tables):
    return M.classes(t.dealt("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc"), T.whole("text").alias("text")))


@query("near_dups", f"with {TURNS} select i, j, round(sim, 6) as sim from sims where sim > 0.8")
def near_dups(t: Tables):
    """Turns whose cosine is above 0.8."""
    from quern.plans.ship import ship

    ship(t.spark)
    return M.similar(_turns(t), 0.8).select("i", "j", r6(F.col("sim"), "sim"))


@query(
    "templates",
    f"with {TURNS}, near as (select i, j from sims where sim > 0.6 union all select j, i from sims where sim > 0.6) select i as doc, count(*) as "
    f"neighbours from near group by i having count(*) >= 5",
)
def templates(t: Tables):
    """Turns with five or more others above 0.6."""
    from quern.plans.ship import ship

    ship(t.spark)
    return M.templates(_turns(t), 0.6, 5)


EVERY = (
    "every as (select coalesce(sim, 0) as sim from (select a.doc as i, b.doc as j from toks a join toks b on a.doc < b.doc) left join sims using "
    "(i, j))"
)
SHARES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query("sim_percentiles", f"with {GRAMS}, {EVERY} select unnest({SHARES}) as q, round(unnest(quantile_cont(sim, {SHARES})), 6) as sim from every")
def sim_percentiles(t: Tables):
    return M.percentiles(_items(t), t.benchmark.count(), SHARES).select("q", r6(F.col("sim"), "sim"))


@query(
    "sim_ranges",
    f"with {GRAMS}, {EVERY} select case when sim < 0.2 then '0.0-0.2' when sim < 0.4 then '0.2-0.4' when sim < 0.6 then '0.4-0.6' when sim < 0.8 "
    f"then '0.6-0.8' else '0.8-1.0' end as bucket, count(*) as n from every where sim < 1 - 1e-12 group by 1",
)
def sim_ranges(t: Tables):
    return M.ranges(_items(t), t.benchmark.count())
