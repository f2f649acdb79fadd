"""Tokens and similarities over arrays of tokens, in the JVM, and answer metrics over whole texts.

The inputs named `normalised` are keys (compatibility form, case-folded). Texts without tokens give
0 where a share has no meaning otherwise, or null where the docstring says so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Words left out of terms.
TERM_STOPWORDS = ("atas", "dan", "dari", "dalam", "di", "dengan", "ke", "pada", "atau", "untuk", "yang")
# Words left out of questions and passages.
CONTENT_STOPWORDS = (
    "adalah", "agar", "atau", "atas", "apa", "bagi", "bahwa", "dan", "dari", "dengan", "dalam", "dan/atau", "ini", "itu", "ke", "kepada",
    "menurut", "oleh", "pada", "sebagai", "secara", "tentang", "terdiri", "terhadap", "untuk", "yang", "serta", "saja", "sifat", "bersifat",
    "termasuk", "dimaksud", "merupakan", "tahun", "nomor", "no", "pasal", "ayat", "huruf", "angka", "undang", "undangundang", "peraturan",
    "pemerintah",
)
CONTENT_STOPWORDS_SET = frozenset(CONTENT_STOPWORDS)
# Phrases by which an answer abstains.
ABSTENTIONS = (
    "tidak menemukan", "tidak tersedia", "tidak dapat memastikan", "tidak ada informasi", "tidak ada pasal", "tidak terdapat pasal",
    "tidak terdapat", "tidak memuat", "tidak ditemukan", "konteks tidak memuat",
)


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def term_tokens(normalised: Column) -> Column:
    return F.array_distinct(F.filter(_all(normalised, "[a-z0-9ı]+"), lambda t: ~t.isin(*TERM_STOPWORDS) & (F.length(t) > 1)))


def text_tokens(normalised: Column) -> Column:
    return F.array_distinct(_all(normalised, "[a-z0-9ı]+"))


def words(normalised: Column) -> Column:
    """All words in their order."""
    return _all(normalised, r"[\p{L}\p{N}]+")


def content_of(listed: Column) -> Column:
    """The words that carry content."""
    return F.filter(listed, lambda t: ~t.isin(*CONTENT_STOPWORDS) & (F.length(t) > 1))


def content_words(normalised: Column) -> Column:
    return content_of(words(normalised))


def coverage(wanted: Column, given: Column) -> Column:
    """Share of the distinct wanted tokens that are given."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, given)) / F.size(wanted)).otherwise(0.0)


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """From the number of shared tokens and the two sizes."""
    return F.try_divide(shared, left + right - shared)


def anchor_recall(answer: Column, anchors: Column) -> Column:
    """Share of the normalised anchors that stand in the normalised answer; null without anchors."""
    return F.when(F.size(anchors) > 0, F.size(F.filter(anchors, lambda a: F.contains(answer, a))) / F.size(anchors))


_WORDS = re.compile(r"[^\W_]+")
_CITED_ARTICLE = re.compile(r"\bpasal\s+\d+[a-z]?(?:\s+ayat\s*\(\d+\))?", re.A)
_CITED_YEAR = re.compile(r"\b(?:19|20)\d{2}\b", re.A)
_SPACE = re.compile(r"\s+", re.A)


def legal_markers(normalised: str) -> set[str]:
    """The articles and years a text cites."""
    return {_SPACE.sub(" ", x) for x in _CITED_ARTICLE.findall(normalised)} | set(_CITED_YEAR.findall(normalised))


def repeated_ngrams(listed: list[str], n: int = 6) -> float:
    """Share of a text's n-grams that occur before; 0 for texts shorter than two of them."""
    if len(listed) < 2 * n:
        return 0.0
    total = len(listed) - n + 1
    return (total - len(set(zip(*(listed[i:] for i in range(n)))))) / total


def answer_metrics(answer: str, reference: str, context: str | None = None) -> dict[str, float | bool | None]:
    """The metrics of a key against that of its reference and, if there is one, its context, in time
    linear in their lengths. What has no meaning is null; texts without words score 0."""
    own, other = _WORDS.findall(answer), _WORDS.findall(reference)
    shared = (Counter(own) & Counter(other)).total() if own and other else 0
    expected = legal_markers(reference)
    grounded = None
    if context is not None:
        content = [w for w in own if len(w) > 1 and w not in CONTENT_STOPWORDS_SET]
        known = set(_WORDS.findall(context))
        grounded = sum(map(known.__contains__, content)) / len(content) if content and known else None
    return {
        "precision": shared / len(own) if own and other else 0.0,
        "recall": shared / len(other) if own and other else 0.0,
        "f1": 2.0 * shared / (len(own) + len(other)) if shared else 0.0,
        "marker_recall": len(expected & legal_markers(answer)) / len(expected) if expected else None,
        "grounded": grounded,
        "repeated": repeated_ngrams(own),
        "abstains": any(map(answer.__contains__, ABSTENTIONS)),
    }


def cites(answer: Column, letter: str = "s") -> Column:
    return answer.rlike(rf"(?iu)\[\s*{letter}1\s*\]|\b{letter}1\b")


def cites_exactly(answer: Column, letter: str = "s") -> Column:
    return answer.rlike(rf"(?iu)\[\s*{letter}1\s*\]")


def screening_score(f1: Column, anchors: Column, abstained: Column, out_of_scope: Column) -> Column:
    inside = F.round(100 * (0.65 * anchors + 0.35 * F.coalesce(f1, F.lit(0.0))), 2)
    return F.when(out_of_scope, F.when(abstained, 100.0).otherwise(0.0)).otherwise(inside)


def grounding_score(grounded: Column, hit: Column, cited: Column, abstained: Column, out_of_scope: Column) -> Column:
    inside = F.round(100 * (0.45 * F.coalesce(grounded, F.lit(0.0)) + 0.30 * hit.cast("double") + 0.25 * cited.cast("double")), 2)
    return F.when(out_of_scope, F.when(~hit & abstained, 100.0).otherwise(0.0)).otherwise(inside)


@F.pandas_udf(T.DoubleType())
def matching_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two keys, for which the JVM has no function."""
    from difflib import SequenceMatcher

    for a, b in batches:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")
