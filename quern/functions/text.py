"""Text scores, densities and cleaning as columns (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text-difficulty scores.
BOILERPLATE = "the and of in to a all said one that for with by be was this his her their from or as an at are have had upon unto aforesaid being same given granted made sealed delivered presence witness premises bargain sell convey deed will testament executor land acres plantation island barbados thomas parish day year lord kingdom england scotland ireland grace majesty thousand hundred first second third fourth fifth".split()
KNOWN_NAMES = "Barbados England Scotland Ireland Thomas Lord Kingdom Island Parish August January February March April May June July September October November December".split()
SPECIAL = r"[\^~\*\-]{2,}|y\^e|s\^d|w\^th|Dec\^d|afores\^d|Rec\^d|deliver\^d"
# \\b stands for an edge of a word; it is replaced by each engine's own way to say so.
ARCHAIC = [r"\bff[a-z]", r"\bvp?on\b", r"\bvnt[o|i]", r"\bw[t]h", r"\bwhich", r"[aeiou]{3,}"]
PUNCTUATION = r"[,;:\.!?\-\(\)]"
WEIGHTS = {
    "vocabulary_diversity": 0.15,
    "rare_word_ratio": 0.25,
    "named_entity_score": 0.20,
    "number_complexity": 0.15,
    "special_char_complexity": 0.10,
    "historical_spelling": 0.05,
    "text_length_complexity": 0.05,
    "punctuation_complexity": 0.05,
}
ARTIFACTS = ["<|assistant|>", "<|user|>", "assistant", "Assistant:"]


# Character classes are spelled out, so that every engine reads them alike: white space, and what words are made of.
SPACE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = r"\p{L}\p{N}_"
MARKLESS = r"\p{L}\p{N}" + SPACE
START, STOP = rf"(?<![{LETTERS}])", rf"(?![{LETTERS}])"


def whole(text: Column | str) -> Column:
    """The text as it is; null is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def capped(ratio: Column, scale: float) -> Column:
    return F.least(F.lit(100.0), ratio * scale)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def vocabulary_diversity(lower: Column) -> Column:
    """Of the lowered words."""
    return capped(share(F.size(F.array_distinct(lower)), F.size(lower)), 100)


def named_entity_score(text: Column, w: Column) -> Column:
    names = F.filter(F.regexp_extract_all(text, F.lit(START + "[A-Z][a-z]+"), F.lit(0)), lambda w: ~w.isin(*KNOWN_NAMES))
    return capped(share(F.size(names), F.size(w)), 500)


def number_complexity(text: Column, w: Column) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(rf"{START}\p{{Nd}}+{STOP}"), F.lit(0))
    digits = F.length(F.array_join(numbers, ""))
    n = F.size(w)
    return F.when(n > 0, F.least(F.lit(100.0), share(F.size(numbers), n) * 300 + share(digits, F.size(numbers)) * 5)).otherwise(0.0)


def special_char_complexity(text: Column, w: Column) -> Column:
    return capped(share(count(text, SPECIAL), F.size(w)), 500)


def historical_spelling(text: Column, w: Column) -> Column:
    edged = [p.removeprefix(r"\b").removesuffix(r"\b") for p in ARCHAIC]
    edged = [START * p.startswith(r"\b") + e + STOP * p.endswith(r"\b") for p, e in zip(ARCHAIC, edged, strict=True)]
    found = sum((count(text, f"(?i){p}") for p in edged), F.lit(0))
    return capped(share(found, F.size(w)), 500)


def text_length_complexity(text: Column) -> Column:
    return F.least(F.lit(100.0), F.length(text) / 2.0)


def punctuation_complexity(text: Column) -> Column:
    return capped(share(count(text, PUNCTUATION), F.length(text)), 500)


def difficulty() -> Column:
    return sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))


def density(text: Column, pattern: str) -> Column:
    """Matches over length, an empty text counting as one character."""
    return count(text, pattern) / F.greatest(F.length(text), F.lit(1)).cast("double")


def uppercase_ratio(text: Column) -> Column:
    return share(count(text, r"\p{Lu}"), count(text, r"\p{L}"))


def lexical_diversity(text: Column) -> Column:
    return share(F.size(F.array_distinct(words(F.lower(text)))), F.size(words(text)))


def avg_word_length(text: Column) -> Column:
    return share(F.length(F.array_join(words(text), "")), F.size(words(text)))


def char_diversity(text: Column) -> Column:
    return share(F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))), F.length(text))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"[{SPACE}]+", " "), r"^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def key(text: Column) -> Column:
    """The exact-duplicate key: lowered and stripped."""
    return strip(F.lower(text))


def after_artifacts(text: Column, artifacts: list[str] = ARTIFACTS) -> Column:
    """What follows the last of each chat artifact, in order."""
    for a in artifacts:
        text = F.substring_index(text, a, -1)
    return text


def clean_lines(text: Column) -> Column:
    """Line ends unified, lines stripped, blank ones dropped, joined by a space."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), " ")


def preview(text: Column, n: int = 60) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def parse_boolean(value: Column) -> Column:
    return F.lower(strip(value)).isin("1", "true", "yes", "y")


def stem(name: Column) -> Column:
    return F.substring_index(name, ".", 1)
