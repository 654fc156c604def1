"""Text expressions: counts, readability, tokens. White space is Unicode's, sizes named so are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u0085   -     　]+"
#: Fixed value: what a page says that is not there.
SOFT_404 = r"(?i)(page not found|404 not found|not found|page doesn.t exist|no longer available|nothing found|does not exist)"


def fields(t: Column) -> Column:
    return F.filter(F.split(t, SPACE), lambda w: w != "")


def sentences(t: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(t, F.lit("[.!?]+")))


def syllables(word: Column) -> Column:
    """Of a lower-cased word: vowel groups without a final e; one for words of up to three bytes."""
    body = F.regexp_replace(word, "e$", "")
    return F.when(F.octet_length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(body, F.lit("[aeiouy]+"))))


def syllable_count(t: Column) -> Column:
    return F.aggregate(F.transform(fields(F.lower(t)), syllables), F.lit(0), lambda a, x: a + x)


def grade(words: Column, sentence_count: Column, syllable_total: Column) -> Column:
    """Flesch-Kincaid grade, two decimals, halves up (a hair is added, as sums in another order end a hair off); null without words."""
    g = 0.39 * (words / sentence_count) + 11.8 * (syllable_total / words) - 15.59
    return F.when(words > 0, F.floor(g * 100 + 0.5000001) / 100)


def tokens(t: Column, stop: tuple[str, ...]) -> Column:
    """For n-grams: lower case, letters, digits, ' and - only, trimmed of those, two bytes or more, no stopword, not all digits."""
    clean = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s'-]", " ")
    w = F.transform(fields(clean), lambda x: F.trim(x, F.lit("'-")))
    return F.filter(w, lambda x: (F.octet_length(x) >= 2) & ~x.isin(*stop) & ~x.rlike(r"^\p{Nd}+$"))


def terms(t: Column) -> Column:
    """For topicality: lower-cased runs of letters and digits of two characters or more."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{Nd}]+"), lambda x: F.char_length(x) >= 2)


def jaccard(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)), 3)


def soft_404(title: Column, h1: Column, body: Column) -> Column:
    return F.coalesce(title.rlike(SOFT_404), F.lit(False)) | F.coalesce(h1.rlike(SOFT_404), F.lit(False)) | ((F.octet_length(body) < 500) & F.coalesce(body.rlike(SOFT_404), F.lit(False)))
