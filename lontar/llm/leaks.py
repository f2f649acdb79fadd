"""Problem 9: evaluation texts leaking into training text.

The prompts and reference answers of the cases are cut into blocks of consecutive words, which are
the patterns of one Aho-Corasick automaton. A word is a maximal run of letters and digits, compared
without case, after canonical composition. The words of the cases are numbered and written as one
character each, so that the automaton works on whole words; a document is normalised the same way,
with any other word as a character that no pattern has, and scanned once. A block found is extended
to either side as far as the words agree, and is a leak from `words` words. Blocks have half that
length, so every such passage holds a whole one: none is lost, and the automaton has no more nodes
than the cases have words. The words of a passage are mapped to the characters of the original text.

The automaton grows with the cases, not with the documents. The cases are a stated query set: one
that is longer than `max_chars` characters goes in several automata, by a hash of the case, each
collected by itself; none is dropped. Null texts, cases and parts shorter than `words` words have
no hits. Texts of any length are scanned whole. Repeated documents each have their own rows; cases
that share a passage are all reported. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORDS = 15
MAX_CHARS = 5_000_000
_WORD = re.compile(r"[^\W_]+")
_OTHER = "\x00"


def composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """The composed, lower-cased text, and where the original of each of its characters begins and ends."""
    out: list[str] = []
    begins: list[int] = []
    ends: list[int] = []
    at = 0
    while at < len(text):
        to = at + 1
        # what composes with the characters before it belongs to them
        while to < len(text) and not text[to].isascii():
            if not unicodedata.combining(text[to]) and unicodedata.normalize("NFC", text[at : to + 1]) == unicodedata.normalize("NFC", text[at:to]) + unicodedata.normalize("NFC", text[to]):
                break
            to += 1
        part = unicodedata.normalize("NFC", text[at:to]).lower()
        out.append(part)
        begins += [at] * len(part)
        ends += [to] * len(part)
        at = to
    return "".join(out), begins, ends


class PassageScanner:
    """The automaton of a list of (case_id, part, text)."""

    def __init__(self, cases: tuple[tuple[str, str, str], ...], words: int = WORDS):
        import ahocorasick

        self.codes: dict[str, str] = {}
        self.words, self.block = words, (words + 1) // 2
        self.lines: list[str] = []
        self.names: list[tuple[str, str]] = []
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for case, part, text in cases:
            line = "".join(map(self._code, _WORD.findall(composed(text).lower())))
            if len(line) < words:
                continue
            for at in range(0, len(line) - self.block + 1, self.block):
                owners[line[at : at + self.block]].append((len(self.lines), at))
            self.lines.append(line)
            self.names.append((case, part))
        self.automaton = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.automaton.add_word(pattern, who)
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def _code(self, word: str) -> str:
        known = self.codes.get(word)
        if known is None:
            n = len(self.codes) + 1
            known = self.codes[word] = chr(n if n < 0xD800 else n + 0x800)
        return known

    def coded(self, text: str) -> str:
        get = self.codes.get
        return "".join([get(w, _OTHER) for w in _WORD.findall(composed(text).lower())])

    def hits(self, text: str | None) -> dict[str, list[tuple[str, int, int]]]:
        """case -> [(part, first word, last word + 1)], overlapping passages joined."""
        if not text or self.empty:
            return {}
        line = self.coded(text)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        reached: dict[tuple[int, int], int] = {}
        for end, who in self.automaton.iter(line):
            start = end - self.block + 1
            for own, at in who:
                shift = start - at
                if reached.get((own, shift), 0) > end:
                    continue  # within a passage that was followed already
                case, a, b = self.lines[own], start, end + 1
                while a > 0 and a > shift and line[a - 1] == case[a - 1 - shift]:
                    a -= 1
                while b < len(line) and b - shift < len(case) and line[b] == case[b - shift]:
                    b += 1
                reached[own, shift] = b
                if b - a >= self.words:
                    spans[own].append((a, b))
        out: dict[str, list[tuple[str, int, int]]] = defaultdict(list)
        for own, found in spans.items():
            case, part = self.names[own]
            found.sort()
            a, b = found[0]
            for c, d in found[1:]:
                if c <= b:
                    b = max(b, d)
                else:
                    out[case].append((part, a, b))
                    a, b = c, d
            out[case].append((part, a, b))
        return out

    @staticmethod
    def places(text: str) -> list[tuple[int, int]]:
        """Where each word begins and ends in the original text."""
        if text.isascii():
            return [m.span() for m in _WORD.finditer(text)]
        low, begins, ends = folded(text)
        return [(begins[m.start()], ends[m.end() - 1]) for m in _WORD.finditer(low)]


@functools.lru_cache(2)
def _scanner(cases: tuple[tuple[str, str, str], ...], words: int) -> PassageScanner:
    return PassageScanner(cases, words)


def leaks(documents: DataFrame, cases: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, case_id, part, start, end): every leaked passage with its place.

    Offsets count characters of the text as it is stored, `end` exclusive.
    """
    listed = cases.select("case_id", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("text")) for p in ("prompt", "reference_answer")])))
    listed = listed.where("case_id is not null and text is not null")
    blocks = max(1, -(-(listed.agg(F.sum(F.length("text"))).first()[0] or 0) // max_chars))
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, case_id string, part string, start int, end int"
    result = None
    for block in range(blocks):
        own = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("case_id"), F.lit(blocks)) == block)
        some = rows.sparkSession.sparkContext.broadcast(tuple(sorted({(r.case_id, r.part, r.text) for r in own.collect()})))

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(some.value, words)
            for batch in batches:
                found = ([], [], [], [], [])
                ids = batch.column(0).to_pylist()
                for i, x in enumerate(batch.column(1)):
                    value = x.as_py()
                    hits = scanner.hits(value)
                    places = scanner.places(value) if hits else []
                    for case, spans in hits.items():
                        for part, first, last in spans:
                            for column, cell in zip(found, (ids[i], case, part, places[first][0], places[last - 1][1])):
                                column.append(cell)
                types = (batch.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], names=["doc_id", "case_id", "part", "start", "end"])

        part = rows.mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return result
