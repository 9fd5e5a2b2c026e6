"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens become labels: insult, threat, target, negation, reported speech, other. Four small transducers rewrite and weigh
the label sequence of a clause and are composed once into a single deterministic machine:

* reported speech turns the insults and threats that follow it in the clause into quoted ones;
* negation turns those within ``SPAN`` tokens into negated ones;
* a target word turns those within ``SPAN`` tokens into aimed ones;
* the scorer gives each rewritten label its gain, and a little more for a target soon after.

A match adds gain times the weight of its lexicon entry. The lexicon starts from a seed list and is extended from labelled
documents by greedy cover: words and word stems that are frequent in toxic and all but absent from other documents are
taken while each explains toxic documents that no entry explains yet, so chance words of copied documents stay
out. Weights are log-odds with the seed counted as prior evidence. A document's margin is the log of its summed
clause weights; the cut and slope of the score are fitted on the labelled sample, bounded by ``train_rows`` ids chosen by hash.

Defined cases: null, empty and lexicon-free texts match nothing and share the lowest score; repeated rows score alike; with
no labelled rows the seeds and a fixed cut decide; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as L
from .staging import Stages, filtered
from .text import Words, chunks, hash_of, lean, starts_hash, utf8, word_bytes, words

ALNUM = word_bytes("alnum")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRAIN_ROWS = 20_000
CUT = 0.7
SPAN = 3
#: Stems of so many characters may enter the lexicon.
STEMS = (4, 5, 6, 7)
LEAST_TOXIC = 8
LEAST_NEW = 3
MOST_CLEAN_SHARE = 0.002
PRIOR = 2.0

SEEDS = {
    "insult": "idiot moron loser scum trash clown pathetic worthless stupid disgusting imbecile dumbass scumbag idiota imbécil estúpido basura escoria connard imbécile crétin ordure abruti trottel dummkopf abschaum vollidiot depp",
    "threat": "kill hurt stab shoot strangle matar matarte tuer frapper töten umbringen verprügeln",
    "target": "you your yours yourself he she they them him her tu vous toi ton tes eres usted ustedes vosotros du dich dir dein deine ihr euch sie",
    "negation": "not no never nobody isn't aren't ne pas jamais nicht nie kein keine nunca jamás tampoco",
    "report": "said says say called wrote writes quoted quote claimed dijo escribió llamó dit écrit appelé sagte schrieb nannte zitat",
}
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
QUOTED, NEGATED, AIMED = 8, 16, 32
STOPS = np.isin(np.arange(256), np.frombuffer(b".!?;:\n", np.uint8))


class Transducer(NamedTuple):
    """A deterministic machine on integer labels: (state, label) -> (state, label, gain); missing arcs keep state by ``idle`` and label."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    idle: dict[int, int]

    def step(self, state: int, label: int) -> tuple[int, int, float]:
        return self.arcs.get((state, label), (self.idle.get(state, state), label, 0.0))


def reported() -> Transducer:
    return Transducer({(0, REPORT): (1, OTHER, 0.0), (1, INSULT): (1, INSULT | QUOTED, 0.0), (1, THREAT): (1, THREAT | QUOTED, 0.0)}, {})


def within(mark: int, label: int, passes: bool, on: list[int]) -> Transducer:
    """After ``label``, labels of ``on`` get ``mark`` for ``SPAN`` tokens."""
    idle = {k: k - 1 for k in range(1, SPAN + 1)}
    arcs = {(k, label): (SPAN, label if passes else OTHER, 0.0) for k in range(SPAN + 1)}
    return Transducer(arcs | {(k, x): (k - 1, x | mark, 0.0) for k in idle for x in on}, idle)


def scorer() -> Transducer:
    """Gains of the rewritten labels; states count down from a match, for a target that follows."""
    gains = {}
    for x, plain, aimed in ((INSULT, 1.0, 1.5), (THREAT, 0.4, 1.5)):
        for marks in range(0, 64, 8):
            gain = aimed if marks & AIMED else plain
            gains[x | marks] = gain * (0.2 if marks & QUOTED else 1.0) * (0.2 if marks & NEGATED else 1.0)
    idle = {k: k - 1 for k in range(1, SPAN + 1)}
    arcs = {(k, x): (SPAN if g >= 0.4 else 0, x, g) for k in range(SPAN + 1) for x, g in gains.items()}
    return Transducer(arcs | {(k, TARGET): (0, TARGET, 0.3) for k in idle}, idle)


def compose(*machines: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """Tables next[state, label] and gain[state, label] of the machines run one on the output of the other."""
    states, todo, rows = {(0,) * len(machines): 0}, [(0,) * len(machines)], []
    while todo:
        state, row = todo.pop(0), []
        for label in range(6):
            after, out, gain = [], label, 0.0
            for m, s in zip(machines, state, strict=True):
                s, out, g = m.step(s, out)
                after.append(s)
                gain += g
            if tuple(after) not in states:
                states[tuple(after)] = len(states)
                todo.append(tuple(after))
            row.append((states[tuple(after)], gain))
        rows.append(row)
    return np.array([[x[0] for x in r] for r in rows]), np.array([[x[1] for x in r] for r in rows])


def grammar() -> tuple[np.ndarray, np.ndarray]:
    plain, quoted = [INSULT, THREAT], [INSULT | QUOTED, THREAT | QUOTED]
    some = plain + quoted
    return compose(reported(), within(NEGATED, NEGATION, False, some), within(AIMED, TARGET, True, some + [x | NEGATED for x in some]), scorer())


class Lexicon(NamedTuple):
    """Entries: text, whole word or stem, label, weight."""

    entries: list[tuple[str, bool, int, float]]


class Tables(NamedTuple):
    """By byte length of a stem (0: whole words), sorted hashes with labels and weights."""

    by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def tables(lexicon: Lexicon) -> Tables:
    by: dict[int, list] = {}
    for text, whole, label, weight in lexicon.entries:
        by.setdefault(0 if whole else len(text.encode()), []).append((hash_of(text, ALNUM), label, weight))
    return Tables(
        {
            k: tuple(
                np.array(c, t) for c, t in zip(zip(*sorted(v), strict=True), (np.uint64, np.int64, np.float64), strict=True)
            ) for k, v in by.items()
        }
    )


def _looked_up(hashes: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    known, label, weight = table
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    return np.where(hit, label[at], OTHER), np.where(hit, weight[at], 0.0)


def _found(data: np.ndarray, at: np.ndarray, w: Words, known: Tables) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words that an entry matches with its label and weight: by whole words, then by stems from short to long."""
    if 0 in known.by:
        label, weight = _looked_up(w.hash, known.by[0])
        hit = np.flatnonzero(label != OTHER)
        yield hit, label[hit], weight[hit]
    for size, some, h in starts_hash(data, at, w, ALNUM, [k for k in known.by if k]):
        label, weight = _looked_up(h, known.by[size])
        hit = np.flatnonzero(label != OTHER)
        yield some[hit], label[hit], weight[hit]


def totals(data: np.ndarray, at: np.ndarray, known: Tables, machine: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document of a chunk: summed clause weights, greatest clause weight, matched clauses."""
    n = len(at) - 1
    total, most, clauses = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    w = words(data, at, ALNUM)
    if not len(w.start):
        return total, most, clauses
    label, weight = np.zeros(len(w.start), np.int8), np.zeros(len(w.start))
    for some, lab, wei in _found(data, at, w, known):  # the first that matches decides
        new = label[some] == OTHER
        label[some[new]], weight[some[new]] = lab[new], wei[new]
    hits = np.flatnonzero((label == INSULT) | (label == THREAT))
    if not len(hits):
        return total, most, clauses
    chunk = data[at[0] : at[-1]]
    stop = np.flatnonzero(STOPS[chunk])
    bounds = np.unique(np.concatenate([stop, at[:-1] - at[0], at[1:] - at[0]]))
    clause = np.searchsorted(bounds, w.start[hits], "right")
    after, gain = machine
    for c in np.unique(clause):
        lo, hi = np.searchsorted(w.start, [bounds[c - 1], bounds[c] if c < len(bounds) else len(chunk)])
        some = lo + np.flatnonzero(label[lo:hi])
        # tokens between labelled ones change nothing after SPAN of them
        gaps = np.minimum(np.diff(some, prepend=lo - 1) - 1, SPAN)
        state, got, last = 0, 0.0, 0.0
        for gap, x, y in zip(gaps.tolist(), label[some].tolist(), weight[some].tolist(), strict=True):
            for _ in range(gap):
                state = after[state, OTHER]
            last = y if y else last
            got += gain[state, x] * (last if x == TARGET else y)
            state = after[state, x]
        d = w.doc[lo]
        total[d] += got
        most[d] = max(most[d], got)
        clauses[d] += got > 0
    return total, most, clauses


def _evidence(sampled: DataFrame) -> DataFrame:
    """(term, whole, toxic, clean): labelled documents with each word or stem, stems of repeated words counted once."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))))
    numbered = sampled.select("label", "text", F.monotonically_increasing_id().alias("row"))  # before words are rows
    each = numbered.select("label", "row", word.alias("word"))
    stems = F.filter(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEMS]), lambda x: x.isNotNull())
    terms = F.concat(
        F.array(F.struct(F.col("word").alias("term"), F.lit(True).alias("whole"))),
        F.transform(stems, lambda s: F.struct(s.alias("term"), F.lit(False).alias("whole"))),
    )
    each = each.select("label", "row", F.explode(terms).alias("t")).select("label", "row", "t.term", "t.whole")
    # a document counts once for a stem that several of its words share
    once = each.where("whole").select("label", "term", "whole").union(
        each.where("not whole").select("label", "row", "term", "whole").distinct().select("label", "term", "whole")
    )
    return once.groupBy("term", "whole").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, held_out: F.Column, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Fits the lexicon, and the cut and slope of the margin."""
    some = L.sample(labels, "toxic", ~held_out, train_rows)
    # the bounded sample, staged once for all that reads it
    stages = Stages(docs.sparkSession, "toxicity")
    rows = stages.put(docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("text", "label"), "sample")
    n_toxic, n_clean = (some.where(F.col("label") == k).count() for k in (1, 0))
    seeds = {w: k for k, kind in ((INSULT, "insult"), (THREAT, "threat")) for w in SEEDS[kind].split()}
    known = {}
    if n_toxic:
        counts = _evidence(rows)
        clean_most = max(1.0, MOST_CLEAN_SHARE * n_clean)
        wanted = (F.col("toxic") >= LEAST_TOXIC) & (
            F.col("clean") <= F.least(F.lit(clean_most), F.col("toxic") * 0.1)
        ) | (F.col("whole") & F.col("term").isin(*seeds))
        # every term, and the counts of all seeds: the labelled sample bounds them
        found = counts.where(wanted).toPandas().sort_values(["toxic", "clean", "whole", "term"], ascending=[False, True, False, True])
        known = {
            (term, whole): (toxic, clean) for term, whole, toxic, clean in zip(
                *(found[c].tolist() for c in ("term", "whole", "toxic", "clean")),
                strict=True,
            )
        }
    weight = lambda toxic, clean, prior: float(
        np.log((toxic + prior + 0.5) / (n_toxic + prior + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    )
    entries = {}
    for w, k in seeds.items():
        toxic, clean = known.get((w, True), (0, 0))
        value = weight(toxic, clean, PRIOR) if n_clean >= 100 else 5.0
        if value > 1.0:
            entries[w, True] = (k, min(value, 8.0))
    candidates = [k for k in known if k not in entries and k[0] not in seeds]
    if candidates:
        for key in _cover(rows, entries, candidates):
            entries[key] = (INSULT, min(max(weight(*known[key], 0.0), 1.0), 8.0))
    listed = [(t, whole, k, w) for (t, whole), (k, w) in sorted(entries.items())]
    listed += [
        (w, True, k, 0.0) for k, kind in (
            (TARGET, "target"),
            (NEGATION, "negation"),
            (REPORT, "report"),
        ) for w in SEEDS[kind].split() if (w, True) not in entries
    ]
    lexicon = Lexicon(listed)
    seen = matches(rows, Scorer(lexicon, 0.0, 1.0), key="label").select("label", "total").toArrow()
    stages.drop(rows)
    margin, label = np.log1p(seen["total"].to_numpy()), seen["label"].to_numpy().astype(np.int64)
    if not len(label) or label.min() == label.max():
        return Scorer(lexicon, float(np.log1p(2.0)), 4.0)
    cut = L.balanced_cut(margin, label)
    return Scorer(lexicon, cut, max(L.slope(margin, label, cut), 3.0))


def _cover(rows: DataFrame, entries: dict, candidates: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """Greedy cover of the sample's toxic documents: which candidates explain what nothing before them does."""
    lexicon = Lexicon([(t, w, INSULT, float(i + 1)) for i, (t, w) in enumerate([*entries, *candidates])])
    known, n_seeds = tables(lexicon), len(entries)

    @lean
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in chunks(at):
                w = words(data, at[lo : hi + 1], ALNUM)
                docs, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for some, _, number in _found(data, at[lo : hi + 1], w, known):
                    docs.append(w.doc[some])
                    ids.append(number.astype(np.int64) - 1)
                pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(ids)]), axis=1)
                # a document with a seed is explained
                pairs = pairs[:, ~np.isin(pairs[0], pairs[0, pairs[1] < n_seeds])] - np.array([[0], [n_seeds]])
                ends = np.searchsorted(pairs[0], np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pairs[1].astype(np.int32))], ["found"])

    toxic = rows.where("label = 1").select("text").mapInArrow(present, "found array<int>").toArrow()
    found = toxic["found"].combine_chunks()
    ids = found.flatten().to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())]).astype(np.int64)
    # each candidate's documents; of the most frequent, the longest and then the first is taken
    doc = np.repeat(np.arange(len(found)), np.diff(starts))[np.argsort(ids, kind="stable")]
    counts = np.bincount(ids, minlength=len(candidates))
    ends = np.concatenate([[0], np.cumsum(counts)])
    preferred = np.lexsort((np.arange(len(candidates)), [-len(t) for t, _ in candidates]))
    left, chosen = np.ones(len(found), bool), []
    while True:
        best = int(preferred[np.argmax(counts[preferred])])
        if counts[best] < LEAST_NEW:
            return chosen
        chosen.append(candidates[best])
        for d in doc[ends[best] : ends[best + 1]]:
            if left[d]:
                left[d] = False
                counts[ids[starts[d] : starts[d + 1]]] -= 1


class Scorer(NamedTuple):
    """What decides a text: the lexicon, and the cut and slope of the margin."""

    lexicon: Lexicon
    cut: float
    slope: float

    def __call__(self, texts: pa.Array, at: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """score, total, most, clauses of each text."""
        known, machine = tables(self.lexicon), grammar()
        data, ends = utf8(texts)
        parts = [totals(data, ends[lo : hi + 1], known, machine) for lo, hi in chunks(ends)]
        total, most, clauses = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0), np.empty(0), np.empty(0, np.int64))
        return L.probability(np.log1p(total), self.cut, self.slope, at), total, most, clauses


def matches(docs: DataFrame, scorer: Scorer, at: float = CUT, key: str = "doc_id") -> DataFrame:
    """``key``, score, total, most, clauses for every row."""

    @lean
    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, scorer(batch.column(1), at))],
                ["key", "score", "total", "most", "clauses"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(
        matched,
        f"key {kind}, score double, total double, most double, clauses long",
    ).withColumnRenamed("key", key)


def trained(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    return learn(docs, labels, L.fold("doc_id", 3) == 1, train_rows)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, at: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses, most for every row."""
    out = matches(docs, trained(docs, labels, train_rows), at)
    return out.select(
        "doc_id",
        (L.fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= at).cast("int").alias("predicted"),
        "clauses",
        "most",
    )


def keep_clean(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, at: float = CUT) -> DataFrame:
    """The documents that score below ``at``, with the columns they came with, whatever their names.

    Each row is judged by its own text: null and empty texts match nothing and stay, rows that share an id or a text are judged one by
    one, ties at ``at`` go; without labels the seeds decide; an empty table stays empty.
    """
    scorer, place = trained(docs, labels, train_rows), docs.columns.index("text")

    @lean
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(place), at)[0] < at))

    return filtered(docs, kept)
