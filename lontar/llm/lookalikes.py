"""Problem 6: visually identical text with different characters.

Look-alike classes are computed by union-find over strings and code points: the pairs come from a
rule over the Unicode database (full-width, half-width, ligature and blank forms with what they
stand for) and from a short list of letters of other scripts with the Latin letters they cannot be
told from. Classes are transitive. Each class gets the single code point that is most frequent in
the data as its representative; a class that holds a spelling of several letters is represented by
that spelling, written with the representatives of its letters. Texts are rewritten greedily,
leftmost-longest, by one multi-pattern automaton over their canonical decomposition, so that a
composed letter is its base and its marks, and are composed again. A representative's letters
represent themselves: one pass is enough, and a rewritten text is rewritten to itself.

Kept apart: case, visible accents, punctuation and the number of ordinary blanks, tabs and line
breaks. Mathematical letters, superscripts, fractions, circled and similar forms look different
and are left alone. Null stays null, empty stays empty; a text of invisible characters only
becomes empty. Texts are rewritten whole, at any length. Ties for a representative go to ASCII,
then to the lower code point. Columns other than those named pass through untouched.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lontar.runtime import materialize

# Letters of other scripts that look like a Latin letter, with that letter.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
}
GREEK = {
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "ρ": "p", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I",
    "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
}
OTHER = {
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L", "ɑ": "a", "ɡ": "g",
    "‐": "-", "‑": "-", "−": "-", "⁃": "-", "ꓲ": "I", "ꓳ": "O",
}
#: Characters without a mark of their own.
_INVISIBLE_RANGES = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
)
INVISIBLE = "".join(chr(c) for a, b in _INVISIBLE_RANGES for c in range(a, b + 1))
#: Kinds of compatibility forms that look like what they stand for; of the <compat> kind only the
#: Latin ligatures do.
SAME_LOOK = {"<wide>", "<narrow>"}
LIGATURES = range(0xFB00, 0xFB07)
#: Blanks that are not the ordinary one; none of them breaks a line.
BLANKS = "\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        parent.setdefault(x, x)
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = defaultdict(list)
        for x in list(self.parent):
            out[self.find(x)].append(x)
        return [sorted(v) for v in out.values() if len(v) > 1]


def _compatibility_pairs() -> Iterator[tuple[str, str]]:
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0x3400 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7A3 or 0xE000 <= code <= 0xF8FF or code >= 0x20000:
            continue
        ch = chr(code)
        tag = unicodedata.decomposition(ch).split(" ")[0]
        if (tag not in SAME_LOOK and code not in LIGATURES) or ch in BLANKS or ch in INVISIBLE:
            continue
        plain = unicodedata.normalize("NFKD", ch)
        # marks by themselves belong to the letter before them and are no class
        if plain != ch and plain.strip() and not plain.startswith(" ") and not any(map(unicodedata.combining, plain)):
            yield ch, plain


@functools.lru_cache(1)
def lookalike_classes() -> tuple[tuple[str, ...], ...]:
    """The transitive look-alike classes, each sorted."""
    sets = UnionFind()
    for ch, plain in _compatibility_pairs():
        sets.union(ch, plain)
    for script in (CYRILLIC, GREEK, OTHER):
        for ch, latin in script.items():
            sets.union(ch, latin)
    for ch in BLANKS:
        sets.union(ch, " ")
    return tuple(tuple(g) for g in sorted(sets.classes()))


def representatives(counts: dict[str, int] | None = None) -> dict[str, str]:
    """member -> representative, for the members that aren't their own.

    Of code points: the most frequent, among equals ASCII, then the lowest. `counts` are those of
    the canonically decomposed texts.
    """
    counts = counts or {}
    single: dict[str, str] = {}
    spelt: list[tuple[str, ...]] = []
    for group in lookalike_classes():
        if any(len(x) > 1 for x in group):
            spelt.append(group)
            continue
        # what is decomposed never stands in a decomposed text
        able = [x for x in group if unicodedata.normalize("NFD", x) == x]
        best = min(able, key=lambda x: (-counts.get(x, 0), not x.isascii(), x))
        single.update({x: best for x in group})
    out = {x: best for x, best in single.items() if x != best}
    for group in spelt:
        letters = min((x for x in group if len(x) > 1), key=lambda x: (not x.isascii(), x))
        best = "".join(single.get(ch, ch) for ch in letters)
        out.update({x: best for x in group if len(x) == 1 or "".join(single.get(ch, ch) for ch in x) != best})
    return out


class Rewriter:
    """One automaton over all members that aren't representatives; leftmost-longest."""

    def __init__(self, mapping: dict[str, str]):
        import ahocorasick

        self.mapping = mapping
        self.table = {ord(ch): None for ch in INVISIBLE}
        self.automaton = ahocorasick.Automaton()
        for x, to in mapping.items():
            self.automaton.add_word(x, (len(x), to))
        self.automaton.make_automaton()
        self.ascii_stays = not any(x.isascii() for x in mapping)

    def __call__(self, text: str | None) -> str | None:
        if text is None or (self.ascii_stays and text.isascii()):
            return text
        text = unicodedata.normalize("NFD", text.translate(self.table))
        out, at = [], 0
        for end, (length, to) in self.automaton.iter_long(text):
            out.append(text[at : end - length + 1])
            out.append(to)
            at = end + 1
        if out:
            out.append(text[at:])
            text = "".join(out)
        return unicodedata.normalize("NFC", text)


@functools.lru_cache(4)
def _rewriter(key: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(dict(key))


@functools.lru_cache(1)
def plain_rewriter() -> Rewriter:
    """The rewriter with data-independent representatives."""
    return _rewriter(tuple(sorted(representatives().items())))


def member_counts(texts: list[tuple[DataFrame, str]]) -> dict[str, int]:
    """How often each code point of a class occurs in all the texts together, so that one mapping
    holds for all fields; one row per member reaches the driver, and the members are a fixed list."""
    watched = frozenset(x for group in lookalike_classes() for x in group if len(x) == 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                whole = "".join(x for x in batch.column(0).slice(at, 200).to_pylist() if x)
                seen.update(whole if whole.isascii() else unicodedata.normalize("NFD", whole))
        found = {x: n for x, n in seen.items() if x in watched}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["member", "n"])

    every = [df.select(F.col(c).alias("text")) for df, c in texts]
    rows = functools.reduce(DataFrame.unionByName, every).mapInArrow(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n")).collect()
    return {r.member: r.n for r in rows}


def consistent(column: Column | str, counts: dict[str, int] | None = None) -> Column:
    """The text in its one consistent form."""
    key = tuple(sorted(representatives(counts).items()))

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = _rewriter(key)
        for batch in batches:
            yield batch.map(lambda x: rewriter(x) if isinstance(x, str) else None)

    return rewrite(F.col(column) if isinstance(column, str) else column)


def _digest(columns: list[str]) -> Column:
    """SHA-256 over whole texts, lengths keep columns apart."""
    return F.unhex(F.sha2(F.concat_ws("\x1f", *[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in columns]), 256))


def _mixed(rows: DataFrame, columns: list[str], counts: dict[str, int] | None) -> DataFrame:
    """(id, look, spelling) of the rows that share a look with another spelling, as digests."""
    full = rows
    for c in columns:
        full = full.where(F.col(c).isNotNull() & (F.col(c) != ""))
    places = range(len(columns))
    stored = full.select("id", *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    seen = stored.select("id", _digest([f"c{i}" for i in places]).alias("spelling"), *[consistent(f"c{i}", counts).alias(f"l{i}") for i in places])
    seen, _ = materialize(seen.select("id", "spelling", _digest([f"l{i}" for i in places]).alias("look")))
    mixed = seen.groupBy("look").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("look")
    return seen.join(mixed, "look", "left_semi")


def same_look(rows: DataFrame, columns: list[str], counts: dict[str, int] | None = None) -> DataFrame:
    """Pairs (id_a, id_b) of rows that differ as stored and look the same; id_a is the smaller.

    `rows` has a unique `id` and `columns`; rows with a null or empty one of them have no pairs.
    Byte-identical rows are collapsed first. Variants are compared once per pair of distinct
    spellings, then expanded to their rows: the result is as large as the pairs that exist, and
    repeated spellings cost no comparisons. `same_look_rows` doesn't list pairs.
    """
    members = _mixed(rows, columns, counts)
    forms = members.select("look", "spelling").distinct()
    a, b = forms.toDF("look", "sa"), forms.toDF("look", "sb")
    variants = a.join(b, "look").where("sa < sb").select("sa", "sb")
    left, right = members.select(F.col("spelling").alias("sa"), F.col("id").alias("x")), members.select(F.col("spelling").alias("sb"), F.col("id").alias("y"))
    pairs = variants.join(left, "sa").join(right, "sb")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a <> id_b").distinct()


def same_look_rows(rows: DataFrame, columns: list[str], counts: dict[str, int] | None = None) -> DataFrame:
    """(id, class_id, links) of every row that looks like one of another spelling: `class_id` is the
    smallest id of the look, `links` the number of its rows spelt otherwise. One row each, however
    many rows a look has."""
    members = _mixed(rows, columns, counts)
    spelt = members.groupBy("look", "spelling").agg(F.count(F.lit(1)).alias("own"), F.min("id").alias("low"))
    looks = spelt.groupBy("look").agg(F.sum("own").alias("all"), F.min("low").alias("class_id"))
    classes = spelt.join(looks, "look").select("spelling", "class_id", (F.col("all") - F.col("own")).alias("links"))
    return members.join(classes, "spelling").select("id", "class_id", "links")
