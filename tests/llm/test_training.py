"""The fitted operators against restatements in plain Python, and samples with odd shares."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import labels, language, nbsvm, toxicity
from quern.llm import text as T


def test_a_family_of_copies_takes_no_places(spark):
    """Copies of one long toxic text have thousands of terms; a rare toxic word and rare seeds are learned all the same."""
    rng = random.Random(22)
    said = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    family = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(900))
    rows = [(i, said(30), 0) for i in range(900)] + [(1000 + i, family, 1) for i in range(60)] + [
        (2000 + i, f"{said(20)} zurblic {said(5)}", 1) for i in range(24)
    ]
    rows += [(3000 + i, f"{said(20)} hurt {said(5)}", int(i < 4)) for i in range(150)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marked = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marked, F.lit(False)).lexicon
    weights = {(t, whole): w for t, whole, label, w in lexicon.entries if label in (toxicity.INSULT, toxicity.THREAT)}
    assert any("zurblic".startswith(t) for t, _ in weights) and any(t in family for t, _ in weights)
    assert ("hurt", True) not in weights  # 4 toxic and 146 clean documents
    assert len(weights) < 60


# Plain restatements, one byte, word or label at a time.
BASE, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def mixed_bits(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def hashed(values):
    return mixed_bits(sum(v * BASE**k for k, v in enumerate(values)) & ALL)


def byte_values(word):
    return [b + 1 + (32 if 65 <= b <= 90 else 0) for b in word.encode()]


def clause_weights(text, entries, span=3):
    """Summed and greatest clause weight and matched clauses, by walking words with three countdowns and a flag."""
    whole = {t: (k, w) for t, is_whole, k, w in entries if is_whole}
    stems = sorted(((t, k, w) for t, is_whole, k, w in entries if not is_whole), key=lambda x: len(x[0].encode()))
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    total, most, matched = 0.0, 0.0, 0
    for clause in re.split(r"[.!?;:\n]", lowered):
        quoted, negated, aimed, after, last, got = False, 0, 0, 0, 0.0, 0.0
        for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause):
            kind, weight = whole.get(word) or next(((k, w) for t, k, w in stems if word.startswith(t)), (toxicity.OTHER, 0.0))
            last = weight or last
            now_negated, now_aimed, close = negated > 0, aimed > 0, after > 0
            negated, aimed, after = max(negated - 1, 0), max(aimed - 1, 0), max(after - 1, 0)
            if kind == toxicity.REPORT:
                quoted = True
            elif kind == toxicity.NEGATION:
                negated = span
            elif kind == toxicity.TARGET:
                aimed, after = span, 0
                got += 0.3 * last * close
            elif kind in (toxicity.INSULT, toxicity.THREAT):
                gain = (1.5 if now_aimed else 1.0 if kind == toxicity.INSULT else 0.4) * (0.2 if quoted else 1) * (0.2 if now_negated else 1)
                got += gain * weight
                after = span if gain >= 0.4 else 0
        total, most, matched = total + got, max(most, got), matched + (got > 0)
    return total, most, matched


def test_clauses_of_whole_texts():
    rng = random.Random(31)
    seeds = {
        "insult": toxicity.INSULT,
        "threat": toxicity.THREAT,
        "target": toxicity.TARGET,
        "negation": toxicity.NEGATION,
        "report": toxicity.REPORT,
    }
    entries = [
        (
            w,
            True,
            k,
            round(rng.uniform(1, 8), 2) if name in ("insult", "threat") else 0.0,
        ) for name, k in seeds.items() for w in toxicity.SEEDS[name].split()[:6]
    ]
    entries += [("zurb", False, toxicity.INSULT, 2.5), ("zurbli", False, toxicity.INSULT, 4.5), ("écla", False, toxicity.THREAT, 3.0)]
    words = [e[0] for e in entries] + ["zurblic", "zurbon", "éclat", "then", "the", "x1"] * 4
    texts = [
        "".join(rng.choice(words).title() + rng.choice([" ", " ", " ", ", ", ". ", "; ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(400)
    ] + [None, "", "..."]
    _, *got = toxicity.Scorer(toxicity.Lexicon(entries), 1.0, 2.0)(pa.array(texts, pa.string()), 0.7)
    for t, *row in zip(texts, *got, strict=True):
        assert row == pytest.approx(clause_weights(t or "", entries)), t


def plain_indicators(text):
    shape = lambda b: 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b + 1
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [hashed(byte_values(w)) for w in words]
    s = []
    for w in words:
        kinds = [shape(b) for b in w.encode()]
        s.append(hashed([k for j, k in enumerate(kinds) if j == 0 or kinds[j - 1] != k]))
    found = [*h, *[(x + 1) & ALL for x in s]]
    for i in range(1, len(words)):
        same = int(h[i] == h[i - 1])
        found += [mixed_bits((h[i - 1] * 3 + h[i]) & ALL), mixed_bits((s[i - 1] * 5 + s[i] + same) & ALL), mixed_bits(same + 77)]
    return sorted({mixed_bits(x) >> (64 - nbsvm.BITS) for x in found})


def test_indicators_of_whole_texts(monkeypatch):
    rng = random.Random(32)
    texts = [
        " ".join("".join(rng.choice("aZ9é!.") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30))) for _ in range(60)
    ] + ["", None, "a a a", "x" * 50]
    data, at = T.utf8(pa.array(texts, pa.string()))
    for block, segment in ((T.BLOCK, nbsvm.SEGMENT), (16, 7)):
        monkeypatch.setattr(T, "BLOCK", block)
        monkeypatch.setattr(nbsvm, "BLOCK", block)
        monkeypatch.setattr(nbsvm, "SEGMENT", segment)
        T._powers.clear()
        doc, bucket = nbsvm.indicators(data, at)
        for i, t in enumerate(texts):
            assert bucket[doc == i].tolist() == plain_indicators(t or "")
    monkeypatch.undo()
    T._powers.clear()


def test_dual_solution(monkeypatch):
    """The fitted weights against a plain solver of the same hinge-loss problem, and scores against their definition."""
    rng = np.random.default_rng(33)
    label = np.array([i % 3 == 0 for i in range(150)], np.int64)
    features = [np.unique(np.concatenate([rng.integers(0, 40, 6), rng.integers(40 + 20 * y, 60 + 20 * y, 3)])) for y in label]
    monkeypatch.setattr(nbsvm, "EPOCHS", 400)  # until it stands still
    model = nbsvm.fit(features, label)
    order = np.random.default_rng(7).permutation(len(label))
    train = order[len(order) // 5 :]
    counts = np.ones((2, 1 << nbsvm.BITS))
    for i in train:
        counts[label[i], features[i]] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    assert model.ratio == pytest.approx(ratio, abs=1e-5)
    x = np.zeros((len(train), 81))
    for row, i in enumerate(train):
        x[row, features[i]] = ratio[features[i]]
        x[row] /= np.sqrt((x[row] ** 2).sum())
    x[:, 80] = 1.0  # the bias
    y = np.where(label[train] == 1, 1.0, -1.0)
    cost = nbsvm.COST * 0.5 / np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    gram, alpha = (x @ x.T) * np.outer(y, y), np.zeros(len(y))
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(40_000):  # projected gradient on the dual
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    best = alpha.sum() - 0.5 * alpha @ gram @ alpha
    w = x.T @ (alpha * y)
    hinge = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert hinge(w) == pytest.approx(best, rel=1e-3)
    # the model's weights are drawn towards their mean size; undone, they solve the same problem
    used = np.zeros(1 << nbsvm.BITS, bool)
    used[np.unique(np.concatenate([features[i] for i in train]))] = True
    drawn = np.where(ratio != 0, model.weight / np.where(ratio != 0, ratio, 1), 0.0)
    mean = np.abs(drawn[used & (drawn != 0)]).mean()
    own = np.zeros(81)
    own[:80] = ((drawn - (1 - nbsvm.BETA) * mean * np.sign(drawn)) / nbsvm.BETA)[:80]
    own[80] = model.bias
    assert hinge(own) <= best * 1.01
    margin = [drawn[f] @ ratio[f] / np.sqrt((ratio[f] ** 2).sum()) + model.bias for f in features]
    got = np.concatenate([nbsvm.margins(model, np.zeros(len(f), np.int64), f, 1) for f in features])
    assert got == pytest.approx(np.array(margin), abs=1e-4)
    assert labels.probability(got, model.cut, model.slope, 0.3) == pytest.approx(
        1 / (1 + np.exp(-(model.slope * (got - model.cut) + math.log(0.3 / 0.7))))
    )


def test_bayes_by_hand(spark):
    """Posteriors of documents and pages from their trigrams, hosts, suffixes and declarations, with dictionaries."""
    rng = random.Random(34)
    alphabets = {"de": "äöüchtz kß ein", "en": "aeiount shr the", "nl": "aeij vzg oe het"}
    say = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    docs = [
        (
            i,
            say(k, rng.choice([0, 2, 9, 80])),
            k if rng.random() < 0.8 else None,
            f"s{i % 4}",
        ) for i in range(120) for k in [rng.choice(list(alphabets))]
    ] + [(900, None, "en", None)]
    pages = []
    for i in range(60):
        k = rng.choice(list(alphabets))
        said = rng.choice([f'<html lang="{k}">', '<html lang="xx">', "<html>"])
        pages.append(
            (i, f"http://{rng.choice('abc')}.{rng.choice('pq')}.{rng.choice([k, 'com'])}/x", f"{said}<p>{say(k, rng.choice([3, 12, 40]))}</p>")
        )
    pages += [(98, None, None), (99, "http://10.0.0.1/", "<p>the het</p>")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lang string, source string, soft int")
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {("d", r.doc_id) if r.page_id is None else ("p", r.page_id): r for r in language.identify(d, p).collect()}

    fold = bytes(32 if b < 128 and not 97 <= (b | 32) <= 122 else (b | 32 if b < 128 else b) for b in range(256))

    def grams(text):
        b = (text or "").encode().translate(fold)
        return [((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS) for i in range(len(b) - 2)]

    counts = {k: [0.5] * (1 << language.BITS) for k in alphabets}
    for i, text, k, _ in docs:
        if k and zlib.crc32(str(i).encode()) % 5:
            for g in grams(text):
                counts[k][g] += 1
    logs = {k: [math.log(x / total) for x in v] for k, v in counts.items() for total in [sum(v)]}
    rows = [(("d", i), text, f"source:{s}" if s else None, None, None, None) for i, text, _, s in docs]
    for i, url, html in pages:
        host = url and url.split("/")[2]
        named = host and not re.fullmatch("[0-9.]+", host)
        declared = re.search('lang="(..)"', html or "")
        rows.append(
            (
                ("p", i),
                re.sub("<[^>]*>", " ", html) if html else None,
                host,
                ".".join(host.split(".")[-2:]) if named else None,
                host.split(".")[-1] if named else None,
                declared and declared[1],
            )
        )
    names = sorted(alphabets)
    evidence = {}
    for key, text, *_ in rows:
        g = grams(text)
        evidence[key] = [sum(logs[k][x] for x in g) * min(1, language.EVIDENCE / max(len(g), 1)) for k in names]
    normal = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    soft = {k: normal(v) for k, v in evidence.items()}
    sums = {}
    for key, _, host, domain, suffix, declared in rows:
        for group in [
            ("all",),
            host and ("host", host),
            domain and ("domain", domain),
            suffix and ("suffix", suffix),
            declared in names and ("declared", declared),
        ]:
            if group:
                sums[group] = [a + b for a, b in zip(sums.get(group, [0] * 3), soft[key], strict=True)]

    def smoothed(group, key, above):
        if not group:
            return above
        rest = [max(a - b, 0) for a, b in zip(sums[group], soft[key], strict=True)]
        return [(r + language.STRENGTH * a) / (sum(rest) + language.STRENGTH) for r, a in zip(rest, above, strict=True)]

    for key, _, host, domain, suffix, declared in rows:
        prior = smoothed(("all",), key, [1 / 3] * 3)
        by_host = smoothed(host and ("host", host), key, smoothed(domain and ("domain", domain), key, prior))
        by_suffix = smoothed(suffix and ("suffix", suffix), key, prior)
        log = [
            e + math.log(h + 1e-9) + math.log(s + 1e-9) - math.log(q + 1e-9) for e, h, s, q in zip(
                evidence[key],
                by_host,
                by_suffix,
                prior,
                strict=True,
            )
        ]
        if declared in names:
            expected = [language.DECLARED_TRUE if k == declared else (1 - language.DECLARED_TRUE) / 2 for k in names]
            share = [
                (max(a - b, 0) + language.STRENGTH * e) / (t + language.STRENGTH) for a, b, e, t in zip(
                    sums["declared", declared],
                    soft[key],
                    expected,
                    sums[("all",)],
                    strict=True,
                )
            ]
            log = [x + math.log(s + 1e-9) for x, s in zip(log, share, strict=True)]
        posterior = normal(log)
        assert got[key].posterior == pytest.approx(max(posterior), abs=1e-3), key
        assert sorted(posterior)[-1] - sorted(posterior)[-2] < 1e-3 or got[key].lang == names[posterior.index(max(posterior))], key
    assert len(got) == len(rows)


def labelled_texts():
    """Texts with rare toxic words and families of them, seeds, other cases and repeated words."""
    rng = random.Random(31)
    said = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    bad = ["zurblic", "Zurblics", "zurbling", "quonkish", "vrex", "hurt"]
    rows = []
    for i in range(160):
        words = said(12) + ([rng.choice(bad)] * rng.randrange(1, 3) if i % 2 else [])
        rng.shuffle(words)
        rows.append((" ".join(words) + rng.choice(["", ".", " Ünïcode"]), i % 2))
    return [*rows, ("", 1), (" . ", 0), ("stem stemmed stems", 1)]


def words_of(text):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def test_evidence_restated(spark):
    """Documents with each word, and with some longer word of each stem, by label."""
    rows = labelled_texts()
    want = {}
    for text, label in rows:
        words = words_of(text)
        for key in {(w, True) for w in words} | {(w[:k], False) for w in words for k in toxicity.STEMS if len(w) > k}:
            want.setdefault(key, [0, 0])[1 - label] += 1
    got = toxicity._evidence(spark.createDataFrame(rows, "text string, label int")).collect()
    assert {(r.term, r.whole): [r.toxic, r.clean] for r in got} == want


@pytest.mark.parametrize("seeds", [[], [("hurt", True), ("w1", True)]])
def test_cover_restated(spark, monkeypatch, seeds):
    """Each time the candidate that explains most of what is left, the longest and then the first of several, until it is too few."""
    monkeypatch.setattr(toxicity, "LEAST_NEW", 3)
    rows = labelled_texts()
    candidates = [("zurb", False), ("zurblic", True), ("zurbli", False), ("quon", False), ("quonkish", True), ("vrex", True), ("w2", True), ("stem", False)]
    df = spark.createDataFrame(rows, "text string, label int").coalesce(1)

    def terms(text):
        return {(t, whole) for t, whole in [*seeds, *candidates] if any(w == t if whole else w.startswith(t) for w in words_of(text))}

    left = [t for t in (terms(text) for text, label in rows if label) if not t & set(seeds)]
    want = []
    while True:
        counts = [sum(c in t for t in left) for c in candidates]
        best = max(range(len(candidates)), key=lambda k: (counts[k], len(candidates[k][0]), -k))
        if counts[best] < 3:
            break
        want.append(candidates[best])
        left = [t for t in left if candidates[best] not in t]
    entries = {key: (toxicity.INSULT, 2.0) for key in seeds}
    assert toxicity._cover(df, entries, candidates) == want and len(want) >= 3


def test_learned_weights_restated(spark):
    """Seeds by their smoothed log ratio, learned terms by theirs without the prior, both within their bounds."""
    rows = labelled_texts()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    marked = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marked, F.lit(False)).lexicon
    n = [sum(y == k for _, y in rows) for k in (0, 1)]

    def weight(term, whole, prior):
        hit = [y for t, y in rows if any(w == term if whole else len(w) > len(term) and w.startswith(term) for w in words_of(t))]
        return math.log((sum(hit) + prior + 0.5) / (n[1] + prior + 1)) - math.log((len(hit) - sum(hit) + 0.5) / (n[0] + 1))

    seeds = set(" ".join(toxicity.SEEDS[k] for k in ("insult", "threat")).split())
    learned = [(t, whole, w) for t, whole, kind, w in lexicon.entries if kind == toxicity.INSULT and t not in seeds]
    assert learned and all(w == pytest.approx(min(max(weight(t, whole, 0.0), 1.0), 8.0)) for t, whole, w in learned)
