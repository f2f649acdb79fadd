"""Function words of the languages that occur, shared by problems 3 and 10."""

from __future__ import annotations

# Frequent function words, which natural prose of a language can't do without.
FUNCTION_WORDS = {
    "id": (
        "yang dan di ke dari untuk dengan pada dalam oleh adalah atau ini itu tidak akan telah sebagai kepada bagi serta karena jika apabila "
        "setelah secara dapat harus wajib menurut berdasarkan tentang mengenai terhadap antara hanya juga sudah belum agar bahwa setiap para "
        "ialah merupakan tersebut selama kecuali paling sesuai melalui hal atas per sebesar dimaksud berlaku apa bagaimana boleh perlu"
    ),
    "en": (
        "the of and to in is by for with on be or an that this from at which as are not may must shall has have been no than any its it was "
        "after within each unless because while when whenever once if should would can their a"
    ),
    "nl": (
        "de het een van en in is te bij dat op voor met zijn niet aan door of om als er wordt na moet dient mag kan tot uit ook worden heeft "
        "omdat zolang tenzij wanneer binnen gedurende eens per uiterlijk elke"
    ),
    "de": (
        "der die das und ist in von den zu mit dem des ein eine nicht für auf als sich auch es an werden aus er hat dass nach bei einer um am "
        "sind noch wie einem über einen so zum war haben nur oder aber vor zur muss darf kann jede jeder wenn solange binnen spätestens sofern weil"
    ),
    "fr": (
        "le la les de des du un une et est à en que qui dans pour pas au sur par plus ne se ce il sont avec son sa ses ou mais aux être "
        "doit peut chaque si sous tant tous après car lorsque sauf"
    ),
    "es": "el la los las de del y en que un una por con para es no se al lo como más su sus o pero debe puede cada si cuando",
    "it": "il lo la gli le di del della e in che un una per con non si è da al come più sono deve può ogni se quando nel",
    "pt": "o os as de do da dos das e em que um uma por com para não se ao como mais é deve pode cada quando no na",
    "ms": "ialah iaitu hendaklah boleh ini itu dan yang untuk dengan pada oleh kepada daripada tidak akan telah atau jika bagi adalah perlu mesti",
    "jv": "lan sing ing iku karo saka kanggo ora wis bakal utawa yen kudu saben marang amarga uga",
    "su": "jeung nu dina tina pikeun ka ku teu geus bakal atawa lamun kudu unggal kana sabab oge",
}
LANGUAGES = tuple(FUNCTION_WORDS)
WORDS_OF = {k: frozenset(w for w in v.split() if len(w) > 1) for k, v in FUNCTION_WORDS.items()}
ANY = frozenset().union(*WORDS_OF.values())


def shares(listed: list[str], languages: tuple[str, ...] = LANGUAGES) -> dict[str, int]:
    """How many of the (lower-case) words are function words of each language."""
    known = list(filter(ANY.__contains__, listed))
    return {k: sum(map(WORDS_OF[k].__contains__, known)) for k in languages}


def language(listed: list[str], default: str | None = None, languages: tuple[str, ...] = LANGUAGES) -> str | None:
    """The language with most function words; ties go to the earlier one."""
    if not listed:
        return default
    found = shares(listed, languages)
    best = max(languages, key=lambda k: found[k])
    return best if found[best] else default
