"""Problem 10: per-document text quality statistics.

Each document gets one row of statistics over its whole text. Prose is then modelled per language
by a mean and covariance over all statistics, made robust by starting from medians and absolute
deviations and re-estimating from the inliers; a document's squared Mahalanobis distance measures
how far it is from prose, and each statistic's part of it is reported. Documents beyond the cut
whose main body (more than `MAIN` of the characters) is rows of cells, items or noise are named
`table`, `list` or `junk`.

The language is the one whose function words the text uses most; without enough of them, the
`lang` column, else `id`. Null, empty and blank texts have no statistics (null) and are no cases. Texts of any
length are measured whole. Repeated documents each have a row; extra columns are ignored. A
document's kind doesn't depend on its length: all rules are shares, of its characters, lines or
sequences, and what holds for a line (an item has at most nine words) holds for it alone. A
language with fewer than `least` documents is measured against all languages together; with fewer
than that in all, no document is an outlier. A kind that ties takes the order junk, table, list.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lontar.llm.language import WORDS_OF, language
from lontar.runtime import materialize

STATISTICS = (
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "closed_lines", "common_words", "distinct_words",
    "vowel_ratio", "row_share", "item_share", "noise_share", "repeat_share",
)
LANGUAGES = ("id", "en", "nl", "de", "fr", "es", "it", "pt")
#: Squared distance beyond which a document isn't prose: the 0.9999 quantile of chi-square with 12 degrees of freedom.
CUT = 39.1
LEAST = 30
#: Share of function words from which a text tells its language.
SPOKEN = 0.08
#: Share of a document's characters from which list, table or noise lines are its main body: a
#: list under one introducing paragraph passes, a small one in prose doesn't.
MAIN = 0.4
#: A statistic that hardly varies in prose is given at least this deviation.
SMALLEST = np.array([0.3, 0.4, 0.02, 0.02, 0.1, 0.05, 0.05, 0.03, 0.05, 0.08, 0.03, 0.05])

_WORD = re.compile(r"[^\W_]+")
_LINES = re.compile(r"[\r\n\v\f\x85  ]+")
_SENTENCES = re.compile(r"[.!?;\r\n]+")
_MARK = re.compile(r"^\s*(?:[-*•▪◦·–—+>#✓✔o]\s+|\[.?\]\s*|\(?\w{1,4}[.)\]:]\s+|\d+(?:\.\d+)*[.)]?\s+)+")
_GAP = re.compile(r"(?<=\S)(?:\t+| {2,})(?=\S)")
_RULE = re.compile(r"^[\s|+\-=_:─-╿]{4,}$")
_CELL = re.compile(r"^[\w\s.,:%()'’/+\-–—*]*$")
_CELL_TAG = re.compile(r"(?i)</?(?:table|tr|td|th|thead|tbody)\b|\\\\\s*$|\\hline")
_MIXED = re.compile(r"[^\W\d_][^\s\w'’\-/.,&]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|[^\W\d_]{3,}\d{2,}|\d{2,}[^\W\d_]{2,}|\w[@#%^~|¬_]+\w")
_MOJIBAKE = re.compile(r"[ÂÃÐÑâ�][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]?|ï¿½|�|[\u0080-\u009f]")
_DIGIT = re.compile(r"\d")
_VOWELS = "aeiouyàáäâèéêëíìïîòóöôùúüû"
_NUMBER = re.compile(r"^[\s\-+(]*[\d.,:/%\s]*[\d%\-–)]?\s*$")
_CLOSED = (".", "!", "?", ":", ";", '."', ".”", ".)", "…")


def _cells(line: str) -> list[str] | None:
    """The cells of a line that is a row of a table."""
    text = line.strip()
    if _CELL_TAG.search(text) or _RULE.match(text) and ("-" in text or "=" in text) and ("|" in text or "+" in text):
        return [text]
    for mark, most in (("|", 6), ("\t", 6), (";", 3), ("&", 3), ("│", 6), ("¦", 6)):
        if text.count(mark) >= (1 if mark == "\t" else 2):
            cells = [c.strip() for c in text.strip(mark).split(mark)]
            filled = [c for c in cells if c]
            if len(cells) >= 2 and filled and sum(map(bool, map(_CELL.match, filled))) >= 0.7 * len(filled) and sum(len(c.split()) for c in filled) <= most * len(filled) / (1 if mark == "|" else 1.2):
                return cells
    gaps = _GAP.split(text)
    if len(gaps) >= 3:
        short = sum(len(c.split()) <= 3 for c in gaps) >= 0.7 * len(gaps)
        numeric = sum(bool(_NUMBER.match(c)) or c in ("-", "–") for c in gaps)
        if short and (numeric >= 1 and numeric >= 0.3 * len(gaps) or re.search(r"\S {4,}\S", text) and len(gaps) <= 12):
            return gaps
    if text.count(",") >= 2:
        cells = [c.strip() for c in text.split(",")]
        numeric = sum(bool(_NUMBER.match(c)) for c in cells)
        if len(cells) >= 3 and numeric >= 0.4 * len(cells) and all(len(c.split()) <= 5 for c in cells):
            return cells
    return None


def _noisy(line: str, listed: list[str]) -> bool:
    """Encoded, garbled, letter-spaced or random characters."""
    chunks = line.split()
    solid = sum(map(len, chunks))
    if not solid:
        return False
    if not listed:
        return solid >= 4
    letters = sum(map(len, listed))
    if solid - letters > 0.42 * solid:
        return True
    if sum(len(w) == 1 for w in listed) > 0.55 * (len(listed) + 2):
        return True
    if letters > 14 * len(listed):
        return True
    if not line.isascii() and sum(map(len, _MOJIBAKE.findall(line))) > 0.15 * solid:
        return True
    if sum(1 for c in chunks if not c.isalpha() and _MIXED.search(c)) > 0.34 * len(chunks):
        return True
    alphabetic = letters - len(_DIGIT.findall(line))
    if listed[0][0] >= "\u0370":
        return False
    # six letters of ordinary text are added, so that the share means as much for few letters
    return not 0.29 <= (sum(map(line.count, _VOWELS)) + 2.7) / (alphabetic + 6) <= 0.7


def _passages(listed: list[str], size: int = 20) -> float:
    """Share of sequences of `size` words that stand before anywhere in the text."""
    number = {w: i for i, w in enumerate(dict.fromkeys(listed))}
    own = np.fromiter(map(number.__getitem__, listed), np.int64, len(listed))

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # equal pairs get equal numbers below the length of the text, so that they never overflow
        return np.unique(a * np.int64(len(listed)) + b, return_inverse=True)[1]

    done, spans = 1, {1: own}
    while 2 * done <= size:
        spans[2 * done] = paired(spans[done][:-done], spans[done][done:])
        done *= 2
    whole = spans[done]
    for n in sorted(spans, reverse=True)[1:]:
        if done + n <= size:
            whole = paired(whole[:-n], spans[n][done:])
            done += n
    return 1 - (int(whole.max()) + 1) / len(whole)


def _repetition(listed: list[str], low: str) -> float:
    """Share of three-word sequences that stand before within the same 300 words, of 20-word
    sequences that stand before anywhere, or of text in sentences that occur four times, whichever
    is most: none grows with the length of natural prose."""
    if len(listed) < 3:
        return 0.0  # there is no such sequence
    again = 0
    for i in range(0, len(listed) - 2, 300):
        part = listed[i : i + 302]
        again += len(part) - 2 - len(set(zip(part, part[1:], part[2:])))
    share = again / (len(listed) - 2)
    if len(listed) > 302:  # within one window, repeated passages are repeated three-word sequences
        share = max(share, _passages(listed))
    sentences = Counter(map(str.strip, _SENTENCES.split(low)))
    often = sum(len(x) * n for x, n in sentences.items() if n >= 4 and len(x) >= 12)
    if often:
        share = max(share, often / sum(len(x) * n for x, n in sentences.items()))
    return share


def measure(text: str | None, lang: str | None = None) -> tuple[str, tuple[float, ...]] | None:
    """(language, statistics in the order of STATISTICS) of a text."""
    if not text or text.isspace():
        return None
    low = text.lower().replace("\ufeff", "")
    lines = [x for x in _LINES.split(low) if x and not x.isspace()]
    if not lines:
        return None
    words_of = [_WORD.findall(x) for x in lines]
    listed = list(chain.from_iterable(words_of))
    own = language(listed, None, LANGUAGES)
    if own is None or sum(map(WORDS_OF[own].__contains__, listed)) < SPOKEN * len(listed):
        # a few words by chance are no language
        own = lang if lang in LANGUAGES else "id"
    common = WORDS_OF[own]
    solid_all = n_rows = n_items = n_noise = closed = repeated = functional_all = 0
    often = {x for x, n in Counter(map(str.strip, lines)).items() if n >= 5}
    rows_before = False
    for line, own_words in zip(lines, words_of):
        solid = len(line) - line.count(" ") - line.count("\t")
        solid_all += solid
        body = line.strip()
        if body.endswith(_CLOSED):
            closed += 1
        functional = sum(map(common.__contains__, own_words))
        functional_all += functional
        if often and body in often:
            repeated += solid
            n_noise += solid
            continue
        size = len(own_words)
        if size > 9 and functional >= 0.14 * size and solid > 2.5 * size and "|" not in line and "<" not in line and "\t" not in line:
            continue  # running text
        cells = _cells(line)
        if cells is not None:
            n_rows += solid
            rows_before = True
            continue
        if size <= 10:
            plain = _MARK.sub("", line, count=1)
            words = own_words if len(plain) == len(line) else _WORD.findall(plain)
        else:
            plain, words = line, own_words
        if functional < 0.25 * size + 0.01 and _noisy(plain if words else line, words or own_words) and not (rows_before and _NUMBER.match(body)):
            n_noise += solid
        elif size <= 9:
            functional = sum(map(common.__contains__, words))
            if functional == 0 and len(words) <= 8 or functional == 1 and len(words) <= 7 and len(plain) < len(line):
                n_items += solid
    words = len(listed)
    letters = sum(map(len, listed))
    digits = len(_DIGIT.findall(low))
    solid_all = max(1, solid_all)
    alphabetic = letters - digits
    repeat = _repetition(listed, low)
    if repeat > 0.8:
        n_noise, n_rows, n_items, repeated = solid_all, 0, 0, solid_all
    return own, (
        math.log1p(words),
        letters / words if words else 0.0,
        max(0.0, 1 - letters / solid_all),
        digits / solid_all,
        closed / len(lines),
        functional_all / words if words else 0.0,
        len(set(listed)) / words if words else 0.0,
        sum(map(low.count, _VOWELS)) / alphabetic if alphabetic > 0 else 0.0,
        n_rows / solid_all,
        n_items / solid_all,
        n_noise / solid_all,
        max(repeat, repeated / solid_all),
    )


def statistics(documents: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, language, x): the statistics of every document as one array, null without a text."""
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2).to_pylist()
            done = [measure(t.as_py(), lang) for t, lang in zip(batch.column(1), langs)]
            languages = pa.array([d and d[0] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), languages, pa.array([d and list(d[1]) for d in done], pa.list_(pa.float64()))], names=["doc_id", "language", "x"])

    return rows.mapInArrow(run, f"doc_id {kind}, language string, x array<double>")


class ProseModel:
    """Means and inverse covariances by language; `None` is all languages together."""

    def __init__(self, means: dict[str | None, np.ndarray], inverses: dict[str | None, np.ndarray]):
        self.means, self.inverses = means, inverses

    def parts(self, languages: pd.Series, xs: pd.Series) -> tuple[list[float | None], list[list[float] | None]]:
        """The squared distance of each document and each statistic's part of it, a batch at a time."""
        distance: list[float | None] = [None] * len(xs)
        parts: list[list[float] | None] = [None] * len(xs)
        places: dict[str | None, list[int]] = {}
        for i, (language, x) in enumerate(zip(languages, xs)):
            key = language if language in self.means else None
            if x is not None and key in self.means:
                places.setdefault(key, []).append(i)
        for key, own in places.items():
            away = np.vstack([xs.iloc[i] for i in own]) - self.means[key]
            found = away * np.einsum("ij,jk->ik", away, self.inverses[key])
            for i, total, each in zip(own, found.sum(axis=1).tolist(), found.tolist()):
                distance[i], parts[i] = total, each
        return distance, parts


def _moments(measured: DataFrame, model: ProseModel | None, centres: dict, cut: float) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and outer products of the inliers, by language, summed over all documents."""
    k = len(STATISTICS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, part in batch.groupby("language"):
                x = np.vstack(part["x"].to_list())
                if model is None:
                    middle, spread = centres.get(language, centres[None])
                    inside = (np.abs(x - middle) <= 4 * spread).all(axis=1)
                else:
                    key = language if language in model.means else None
                    away = x - model.means[key]
                    inside = np.einsum("ij,jk,ik->i", away, model.inverses[key], away) <= cut
                x = x[inside]
                row = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                total[language] = total.get(language, 0) + row
        for language, row in total.items():
            yield pd.DataFrame({"language": language, "place": np.arange(len(row)), "value": row})

    summed = measured.where("x is not null").select("language", "x").mapInPandas(run, "language string, place int, value double").groupBy("language", "place").agg(F.sum("value").alias("value")).collect()
    out: dict[str, np.ndarray] = {}
    for r in summed:
        out.setdefault(r.language, np.zeros(1 + k + k * k))[r.place] = r.value
    return {a: (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)) for a, v in out.items()}


def fit(measured: DataFrame, rounds: int = 2, cut: float = CUT, least: int = LEAST) -> ProseModel:
    """The robust model, from all documents that have statistics."""
    k = len(STATISTICS)
    known = measured.where("x is not null")
    cells = [F.col("x")[i] for i in range(k)]
    # documents that are mostly something else would shift the start: prose has function words
    start = known.where(F.col("x")[STATISTICS.index("common_words")] >= 0.1)
    quartiles = start.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, c in enumerate(cells)]).collect()
    centres: dict = {}
    for r in quartiles:
        q = np.array([r[f"q{i}"] for i in range(k)])
        centres[r.language] = (q[:, 1], np.maximum((q[:, 2] - q[:, 0]) / 1.349, SMALLEST))
    if not centres:
        return ProseModel({}, {})
    biggest = max(quartiles, key=lambda r: (r.n, r.language)).language
    centres[None] = centres[biggest]
    model = None
    for _ in range(rounds):
        moments = _moments(known, model, centres, cut)
        means, inverses = {}, {}
        everything = [sum(m[i] for m in moments.values()) for i in range(3)] if moments else [0, 0, 0]
        for language, (n, s, o) in [*moments.items(), (None, everything)]:
            if n < least:
                continue
            mean = s / n
            spread = o / n - np.outer(mean, mean) + np.diag(SMALLEST**2)
            means[language], inverses[language] = mean, np.linalg.inv(spread)
        model = ProseModel(means, inverses)
        if not means:
            break
    return model


def judged(documents: DataFrame, cut: float = CUT, least: int = LEAST, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, language, the statistics, distance, part_* of each, kind) of every document; `kind`
    is `prose` for what isn't a case, null without a text."""
    measured, _ = materialize(statistics(documents, doc, text, lang))
    model = documents.sparkSession.sparkContext.broadcast(fit(measured, cut=cut, least=least))
    places = {k: STATISTICS.index(f"{n}_share") for k, n in (("junk", "noise"), ("table", "row"), ("list", "item"))}

    @F.pandas_udf("struct<distance: double, parts: array<double>>")
    def away(languages: pd.Series, xs: pd.Series) -> pd.DataFrame:
        distance, parts = model.value.parts(languages, xs)
        return pd.DataFrame({"distance": distance, "parts": parts})

    rated = measured.select("doc_id", "language", "x", away("language", "x").alias("d"))
    share = {k: F.col("x")[i] for k, i in places.items()}
    top = F.greatest(*share.values())
    named = F.lit("prose")
    for k in ("list", "table", "junk"):
        named = F.when((share[k] == top) & (top > MAIN), k).otherwise(named)
    # two kinds may share a body that is no prose: then it is the larger of them
    mixed = sum(share.values()) > MAIN
    for k in ("list", "table", "junk"):
        named = F.when((named == "prose") & mixed & (share[k] == top), k).otherwise(named)
    kind = F.when(F.col("x").isNull(), F.lit(None).cast("string")).when(F.col("d.distance") > cut, named).otherwise("prose")
    return rated.select(
        "doc_id",
        "language",
        *[F.col("x")[i].alias(s) for i, s in enumerate(STATISTICS)],
        F.col("d.distance").alias("distance"),
        *[F.col("d.parts")[i].alias(f"part_{s}") for i, s in enumerate(STATISTICS)],
        kind.alias("kind"),
    )
