"""Language identification by Bayesian evidence fusion.

A text's likelihood under each language comes from hashed byte trigrams, counted over all labelled documents outside the held-out
fold. It is joined with three kinds of prior evidence about where the text was found:

* the declared markup language, by how often texts of each language declare it;
* the address suffix, by how the suffix's other texts divide among languages;
* the host, smoothed hierarchically: host towards registered domain, domain towards all texts.

The counts behind the priors are grouped sums of the text-only posteriors of all rows, each row's own share taken out. Long
texts count as at most ``EVIDENCE`` independent trigrams, so that the other evidence stays commensurable.

Pages take host, suffix and markup from their address and html; plain documents have a source as host and neither of the others.

Defined cases: null and empty texts have no text evidence; a missing host, suffix or declaration adds nothing; a
declared language that no model knows is ignored; repeated rows are identified one by one; with no labelled documents every language
is null; an empty table gives an empty result; other columns are ignored. Every labelled language is modelled.

A registered domain is the last two labels of a host, or three where a short label stands before a country's two letters (``co.uk``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import labels as L
from .staging import Stages, small_side
from .text import lean, utf8

BITS = 16
BLOCK = 1 << 20
#: Most bytes of a model, which goes to every task; more labelled languages than it holds are an error and none is dropped.
MODEL_BYTES = 512 << 20
EVIDENCE = 60.0
STRENGTH = 20.0
DECLARED_TRUE = 0.9


def trigrams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every byte trigram of a chunk, with ASCII letters lowered and other ASCII as one blank, block by block."""
    for lo in range(int(at[0]), int(at[-1]) - 2, BLOCK):
        hi = min(lo + BLOCK + 2, int(at[-1]))
        b = FOLD[data[lo:hi]]
        gram = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        first = int(np.searchsorted(at, lo, "right")) - 1
        ends = np.clip(at[first + 1 : int(np.searchsorted(at, hi - 1, "right")) + 1], lo, hi)
        doc = np.repeat(np.arange(first, first + len(ends)), np.diff(ends, prepend=lo))
        inside = doc[2:] == doc[:-2]
        yield doc[:-2][inside], bucket[inside]


def _fold() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    v[:128] = 32
    v[97:123] = np.arange(97, 123)
    v[65:91] = np.arange(97, 123)
    return v


FOLD = _fold()


def learn(docs: DataFrame, train: Column) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities [language, bucket] from all labelled training documents."""
    labelled = docs.where(train & F.col("lang").isNotNull()).select("lang", "text")
    names = sorted(r.lang for r in labelled.select("lang").distinct().collect())  # one row a language
    if len(names) << (BITS + 2) > MODEL_BYTES:
        raise ValueError(f"{len(names)} labelled languages make a model of more than {MODEL_BYTES} bytes")
    number = {n: k for k, n in enumerate(names)}

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(number), 1 << BITS), np.int64)
        for batch in batches:
            lang = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            data, at = utf8(batch.column("text"))
            for doc, bucket in trigrams(data, at):
                of = lang[doc]
                for k in np.unique(of[of >= 0]):
                    total[k] += np.bincount(bucket[of == k], minlength=1 << BITS)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((k << BITS | b).astype(np.int64)), pa.array(total[k, b])], ["at", "n"])

    rows = labelled.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(names), 1 << BITS), 0.5)
    at = rows["at"].to_numpy()
    counts[at >> BITS, at & ((1 << BITS) - 1)] += rows["n"].to_numpy()
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts


def likelihoods(rows: DataFrame, names: list[str], model: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, evidence (the tempered log-likelihood of the text in each language) and soft (the posteriors that it alone gives)."""
    shared = rows.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    @lean
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, at = utf8(batch.column("text"))
            out = np.zeros((batch.num_rows, len(model)))
            n = np.zeros(len(out), np.int64)
            for doc, bucket in trigrams(data, at):
                if not len(doc):
                    continue
                lo, hi = int(doc[0]), int(doc[-1]) + 1
                n[lo:hi] += np.bincount(doc - lo, minlength=hi - lo)
                for k in range(len(model)):
                    out[lo:hi, k] += np.bincount(doc - lo, model[k][bucket], hi - lo)
            out *= np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
            ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (out, _normal(out) if len(out) else out)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *lists], [*keep, "evidence", "soft"])

    types = dict(rows.dtypes)
    return rows.select(*keep, "text").mapInArrow(scored, ", ".join(f"{c} {types[c]}" for c in keep) + ", evidence array<double>, soft array<double>")


def _normal(logs: np.ndarray) -> np.ndarray:
    """Probabilities of rows of logarithms."""
    raised = np.exp(logs - logs.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("soft")[k]) for k in range(n)]).alias("sums"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """Rows of ``n`` doubles; a null row is all NaN."""
    out = np.full((len(column), n), np.nan)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _smoothed(sums: np.ndarray, own: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Shares of a group without the row's own posterior, drawn towards the shares above by ``STRENGTH`` rows."""
    rest = np.maximum(sums - own, 0.0)
    return np.where(np.isnan(rest), above, (rest + STRENGTH * above) / (rest.sum(axis=1, keepdims=True) + STRENGTH))


def posteriors(evidence: np.ndarray, soft: np.ndarray, sums: dict[str, np.ndarray], every: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Posteriors of rows: text evidence, host and suffix priors, and the declaration (``said``: its number among the languages, or -1)."""
    n = evidence.shape[1]
    prior = _smoothed(np.broadcast_to(every, soft.shape), soft, np.full(n, 1.0 / n))
    host = _smoothed(sums["host"], soft, _smoothed(sums["domain"], soft, prior))
    suffix = _smoothed(sums["suffix"], soft, prior)
    logs = evidence + np.log(host + 1e-9) + np.log(suffix + 1e-9) - np.log(prior + 1e-9)
    # P(declared | language): its texts' share that declare it, drawn towards a mostly true declaration
    expected = np.where(np.arange(n) == said[:, None], DECLARED_TRUE, (1 - DECLARED_TRUE) / max(n - 1, 1))
    declared = (np.maximum(sums["declared"] - soft, 0.0) + STRENGTH * expected) / (every + STRENGTH)
    return _normal(logs + np.where(np.isnan(declared), 0.0, np.log(np.where(np.isnan(declared), 1.0, declared) + 1e-9)))


def fuse(rows: DataFrame, names: list[str], stages: Stages) -> DataFrame:
    """Adds lang, posterior, text_lang to rows with host, domain, suffix, declared, evidence, soft."""
    n = len(names)
    rows = stages.put(rows, "soft")
    every = np.array(rows.agg(*[F.sum(F.col("soft")[k]) for k in range(n)]).first(), np.float64)
    if np.isnan(every).any():
        every = np.zeros(n)  # no rows
    keys = ("host", "domain", "suffix", "declared")
    out = rows
    for key in keys:
        known = rows.where(F.col(key).isNotNull() if key != "declared" else F.col(key).isin(*names))
        out = out.join(small_side(stages.put(_sums(known, [key], n), key)).withColumnRenamed("sums", f"{key}_sums"), key, "left")
    number = {x: k for k, x in enumerate(names)}
    listed = pa.array(names, pa.string())
    carried = [c for c in rows.columns if c not in ("evidence", "soft")]

    @lean
    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence, soft = (_matrix(batch.column(c), n) for c in ("evidence", "soft"))
            said = np.array([number.get(x, -1) for x in batch.column("declared").to_pylist()], np.int64)
            sums = {k: _matrix(batch.column(f"{k}_sums"), n) for k in keys}
            p = posteriors(evidence, soft, sums, every, said) if len(said) else soft
            best = [listed.take(pa.array(x.argmax(axis=1))) for x in (p, soft)] if len(said) else [listed[:0]] * 2
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], best[0], pa.array(p.max(axis=1, initial=0.0)), best[1]],
                [*carried, "lang", "posterior", "text_lang"],
            )

    added = [StructField("lang", StringType()), StructField("posterior", DoubleType()), StructField("text_lang", StringType())]
    return out.mapInArrow(fused, StructType([*[rows.schema[c] for c in carried], *added]))


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, host, domain, suffix, declared, text of pages."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    named = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    page = pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        "page_id",
        host.alias("host"),
        F.when(named != "", named).alias("declared"),
        text.alias("text"),
    )
    is_name = ~F.col("host").rlike(r"^[0-9.]+$")
    page = page.withColumn(
        "domain",
        F.when(
            is_name,
            F.when(F.col("host").rlike(r"\.[a-z]{2,3}\.[a-z]{2}$"), F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2)),
        ),
    ).withColumn("suffix", F.when(is_name, F.substring_index("host", ".", -1)))
    return page.select("doc_id", "page_id", "host", "domain", "suffix", "declared", "text")


def document_rows(docs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id",
        F.lit(None).cast("long").alias("page_id"),
        F.concat(F.lit("source:"), "source").alias("host"),
        none.alias("domain"),
        none.alias("suffix"),
        none.alias("declared"),
        "text",
    )


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id or page_id, host, declared, held_out, lang, posterior, text_lang for every document and page."""
    stages = Stages(docs.sparkSession, "language")
    names, model = learn(docs, L.fold("doc_id", 5) != 0)
    rows = document_rows(docs).union(page_rows(pages))
    if not names:
        return rows.select(
            "doc_id",
            "page_id",
            "host",
            "declared",
            F.lit(None).cast("boolean").alias("held_out"),
            F.lit(None).cast("string").alias("lang"),
            F.lit(None).cast("double").alias("posterior"),
            F.lit(None).cast("string").alias("text_lang"),
        )
    keep = ["doc_id", "page_id", "host", "domain", "suffix", "declared"]
    found = fuse(likelihoods(rows, names, model, keep), names, stages)
    held = F.when(F.col("doc_id").isNotNull(), L.fold("doc_id", 5) == 0)
    return found.select("doc_id", "page_id", "host", "declared", held.alias("held_out"), "lang", "posterior", "text_lang")
