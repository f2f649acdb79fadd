"""What counts as an empty completion, shared by problems 3 and 4."""

from __future__ import annotations

import re

# Words that stand for a missing text, and labels that may precede an answer.
PLACEHOLDERS = (
    "n a", "na", "null", "none", "nil", "nan", "kosong", "tidak ada", "tidak ada jawaban", "belum diisi", "belum ada", "belum ada jawaban",
    "tbd", "todo", "undefined", "empty", "blank", "isi jawaban di sini", "xxx", "lorem ipsum", "no answer", "geen", "leeg",
)
LABELS = ("jawaban", "jawab", "jawabannya", "answer", "response", "respons", "tanggapan", "balasan", "output", "hasil", "completion", "assistant", "asisten", "antwoord", "a", "j")
_GAP = r"[\W_]"


def _any(phrases: tuple[str, ...]) -> str:
    listed = sorted(phrases, key=len, reverse=True)
    return "|".join(p.replace(" ", f"{_GAP}+") for p in listed) + f")(?={_GAP}|\\Z"


# nothing is tried twice: a text of any length is left at its first other word
_EMPTY = re.compile(rf"{_GAP}*+(?>(?:(?:{_any(LABELS)})|(?:{_any(PLACEHOLDERS)})){_GAP}*+)*+\Z")


def is_empty(text: str | None) -> bool:
    """Null, blank, without a letter or digit, or only labels and placeholders, of any length and
    however often repeated."""
    return not text or _EMPTY.match(text.lower()) is not None
