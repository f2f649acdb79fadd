"""Normalisation and identity parsing, as Column -> Column.

Only the Unicode normal forms and case folding need Python (one Arrow UDF each); everything else
stays in the JVM. Null counts as the empty string throughout, as it does in the source format.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Every character that Python's str.split() takes for white space.
SPACES = r"[\s\x1c-\x1f\x85   -     　]+"


def display_text(x: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", x).split()) if x else ""


def key_text(x: str | None) -> str:
    return display_text(x).casefold()


@F.pandas_udf(T.StringType())
def _display(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: display_text(x) if isinstance(x, str) else "")


@F.pandas_udf(T.StringType())
def _key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: key_text(x) if isinstance(x, str) else "")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def display(c: Column | str) -> Column:
    """Compatibility form, white space collapsed; case is kept."""
    return _display(_col(c).cast("string"))


def key(c: Column | str) -> Column:
    """`display`, case-folded: equal keys are the same text."""
    return _key(_col(c).cast("string"))


def plain(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def group(c: Column | str, pattern: str, n: int = 1) -> Column:
    """Group `n` of the first match, '' without one."""
    return F.regexp_extract(_col(c), pattern, n)


def strip_prefix(term: Column, definition: Column) -> Column:
    """struct(text, removed): the definition without the leading term (both in display form).

    The term must be followed by a separator, and optionally by a defining verb; a definition that
    would become empty is kept.
    """
    head, rest = F.substring(definition, F.lit(1), F.length(term)), F.substr(definition, F.length(term) + F.lit(1))
    tail = F.regexp_replace(rest, r"(?iu)^(?:\s*[,;:\-–—]\s*|\s+)(?:(?:adalah|merupakan)\s+)?", "")
    separated = rest.rlike(r"^(?:\s*[,;:\-–—]|\s)")
    removed = (term != "") & (F.lower(head) == F.lower(term)) & separated & (F.trim(tail) != "")
    return F.struct(F.when(removed, F.trim(tail)).otherwise(definition).alias("text"), removed.alias("removed"))


# How labels and prompts write numbers, years, regulations and articles.
TYPE_BEFORE_NUMBER = r"(?iu)^(.+?)\s+nomor\b"
NUMBER_AND_YEAR = r"(?iu)\bnomor\s+(.+?)\s+tahun\s+((?:19|20)\d{2})\b"
NUMBER_ALONE = r"(?iu)\bnomor\s+([A-Za-z0-9./-]+)"
YEAR_ALONE = r"(?iu)\btahun\s+((?:19|20)\d{2})\b"
BARE_YEAR = r"\b(?:19|20)\d{2}\b"
ASKED_REGULATION = r"(?iu)(undang-undang|uu|peraturan pemerintah|pp)\s*(?:nomor|no\.?|#)?\s*(\d+)\s+tahun\s+(\d{4})"
ASKED_ARTICLE = r"(?iu)pasal\s+(\d+[a-z]?)(?:\s+ayat\s*\((\d+)\))?(?:\s+huruf\s+([a-z]))?(?:\s+angka\s+(\d+))?"


def regulation(label: Column) -> Column:
    """struct(label, type, number, year) of a regulation's label in display form."""
    kind = F.trim(group(label, TYPE_BEFORE_NUMBER))
    number, year = F.trim(group(label, NUMBER_AND_YEAR)), group(label, NUMBER_AND_YEAR, 2)
    alone, after = group(label, NUMBER_ALONE), group(label, YEAR_ALONE)
    years = F.regexp_extract_all(label, F.lit(BARE_YEAR), F.lit(0))
    latest = F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit(""))
    return F.struct(
        label.alias("label"),
        F.when(kind != "", kind).otherwise(label).alias("type"),
        F.when(year != "", number).otherwise(alone).alias("number"),
        F.when(year != "", year).when(after != "", after).otherwise(latest).alias("year"),
    )


# Short names of kinds of regulations.
KINDS = {
    "uu": "undangundang",
    "undangundang": "undangundang",
    "pp": "peraturanpemerintah",
    "perpu": "peraturanpemerintahpenggantiundangundang",
}


def kind_key(normalised: Column) -> Column:
    """A kind of regulation, from its key, with short names written out."""
    bare = F.regexp_replace(normalised, "[^a-z0-9]+", "")
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, bare), bare)


def number_key(shown: Column) -> Column:
    """The first run of digits without leading zeros."""
    return F.regexp_replace(group(shown, r"\d+", 0), r"^0+(?=\d)", "")


def kind_name(normalised: Column) -> Column:
    return (
        F.when(normalised.isin("uu", "undang-undang", "undang undang"), "undang-undang")
        .when(normalised.isin("pp", "peraturan pemerintah"), "peraturan pemerintah")
        .otherwise(normalised)
    )


def article_name(normalised: Column) -> Column:
    return F.replace(F.replace(normalised, F.lit("ayat ("), F.lit("ayat(")), F.lit(" )"), F.lit(")"))


def article_number(normalised: Column) -> Column:
    """The article's number with its letter; null without one."""
    found = group(normalised, r"pasal\s+(\d+[a-z]?)")
    return F.when(found != "", found)


def regulation_key(normalised: Column) -> Column:
    """struct(kind, number, year) of `kind|number|year`; null for anything else and for `answer:`."""
    pattern = r"^([^|]+)\|([^|]+)\|(\d{4})$"
    ok = normalised.rlike(pattern) & ~normalised.startswith("answer:")
    return F.when(ok, F.struct(group(normalised, pattern, 1).alias("kind"), group(normalised, pattern, 2).alias("number"), group(normalised, pattern, 3).cast("int").alias("year")))


def asked_regulation(prompt: Column) -> Column:
    """struct(kind, number, year) of the regulation a prompt names; null without one."""
    pattern = ASKED_REGULATION
    kind = F.lower(group(prompt, pattern, 1))
    return F.when(kind != "", F.struct(kind_name(kind).alias("kind"), group(prompt, pattern, 2).alias("number"), group(prompt, pattern, 3).cast("int").alias("year")))


def asked_article(prompt: Column) -> Column:
    """`pasal N ayat(N) huruf x angka N`, as far as the prompt gives it; null without an article."""
    pattern = ASKED_ARTICLE

    def part(n: int, form: str) -> Column:
        found = group(prompt, pattern, n)
        return F.when(found != "", F.format_string(form, found))

    return F.when(group(prompt, pattern, 1) != "", F.concat_ws(" ", part(1, "pasal %s"), part(2, "ayat(%s)"), part(3, "huruf %s"), part(4, "angka %s")))


def host(url: Column) -> Column:
    """The host of an address, lower-case, without port and user; '' without one."""
    return F.lower(F.regexp_replace(group(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"), r"[\[\]]", ""))


def official(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether an address is https on one of the hosts."""
    return url.rlike(r"(?i)^https://") & host(url).isin(*hosts)


def is_sha256(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{64}\z")


@F.pandas_udf(T.BooleanType())
def _iso(batch: pd.Series) -> pd.Series:
    from datetime import datetime

    def ok(x: object) -> bool:
        try:
            datetime.fromisoformat(str(x).replace("Z", "+00:00"))
        except ValueError:
            return False
        return True

    return batch.map(ok).astype(bool)


def is_iso_time(c: Column) -> Column:
    """Whether a text is an ISO 8601 date or time."""
    return _iso(F.coalesce(c, F.lit("")))


# Marks that a chat model may leave in its output.
MARKS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>")
ROLES = ("assistant", "user")


def clean_answer(raw: Column) -> Column:
    """A model's answer without chat marks, thinking and lines that only name a role."""
    text = plain(raw)
    for mark in MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    text = F.when(text.contains("</think>"), F.regexp_replace(text, r"(?s)^.*?</think>", "")).otherwise(F.regexp_replace(text, r"(?s)<think>.*$", ""))
    lines = F.filter(F.split(text, "\n"), lambda line: ~F.lower(F.trim(line)).isin(*ROLES))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def mark_count(raw: Column) -> Column:
    """How many chat marks and role lines an answer has."""
    text = plain(raw)
    found = sum((F.regexp_count(text, F.lit(m.replace("|", r"\|"))) for m in MARKS), F.lit(0))
    return found + F.size(F.filter(F.split(text, "\n"), lambda line: F.lower(F.trim(line)).isin(*ROLES)))


def messages(prompt: Column, completion: Column) -> Column:
    """The pair as chat messages."""
    return F.array(
        F.struct(F.lit("user").alias("role"), plain(prompt).alias("content")),
        F.struct(F.lit("assistant").alias("role"), plain(completion).alias("content")),
    )
