"""Reference SQL for the text problems that SQL can express over whole tables."""

import unicodedata
from collections.abc import Iterable

from lontar.llm.lookalikes import INVISIBLE, plain_rewriter, representatives

_LEAKS = r"""
parts AS (
    SELECT case_id, regexp_extract_all(lower(nfc_normalize(t)), '[\p{L}\p{N}]+') AS w
    FROM (SELECT case_id, prompt AS t FROM eval_cases UNION ALL SELECT case_id, reference_answer FROM eval_cases) x WHERE t IS NOT NULL
),
patterns AS (
    SELECT DISTINCT case_id, array_to_string(w[i : i + 14], ' ') AS g
    FROM (SELECT case_id, w, unnest(range(1, len(w) - 13)) AS i FROM parts WHERE len(w) >= 15) p
),
docs AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
grams AS (
    SELECT doc_id, array_to_string(w[i : i + 14], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM docs WHERE len(w) >= 15) d
),
found AS (SELECT DISTINCT doc_id, case_id FROM grams JOIN patterns USING (g))
"""

_KEY = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_LINKS = f"""
e AS (SELECT DISTINCT {_KEY.format('regulation_key')} AS k, {_KEY.format('answer_hash')} AS h FROM qa_sft),
l AS (SELECT DISTINCT a.k AS k1, b.k AS k2 FROM e a JOIN e b USING (h) WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND h IS NOT NULL),
r AS (SELECT k1, k2 FROM l UNION SELECT r.k1, l.k2 FROM r JOIN l ON r.k2 = l.k1)
"""


def _quoted(characters: Iterable[str]) -> str:
    return "'" + "".join(characters).replace("'", "''") + "'"


def _consistent(column: str) -> str:
    """A text in its consistent form where the Latin letters are the most frequent ones, by
    replacing characters one by one."""
    mapping = representatives()
    letters = {x: to for x, to in mapping.items() if len(x) == len(to) == 1}
    # composed letters of other scripts, which SQL can't take apart
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        to = plain_rewriter()(chr(code))
        if to != unicodedata.normalize("NFC", chr(code)) and len(to) == 1:
            letters[chr(code)] = to
    out = f"regexp_replace({column}, '[{INVISIBLE}]', '', 'g')"
    for x, to in mapping.items():
        if len(x) == 1 < len(to):
            out = f"replace({out}, {_quoted(x)}, {_quoted(to)})"
    return f"nfc_normalize(translate({out}, {_quoted(letters)}, {_quoted(letters.values())}))"


def _canonical(column: str) -> str:
    """The letters, digits and marks of a text, comparable."""
    folded = _consistent(f"lower({_consistent(column)})")
    return f"regexp_replace(coalesce({folded}, ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')"


_ENTRIES = f"""
raw AS (
    SELECT entry_id, istilah, pengertian, undang_undang FROM glossary
    UNION ALL SELECT entry_id, payload ->> '$.istilah', payload ->> '$.pengertian', payload ->> '$.undang_undang' FROM glossary_feed
),
e AS (SELECT entry_id, {_canonical('istilah')} AS a, {_canonical('pengertian')} AS b, {_canonical('undang_undang')} AS c FROM raw)
"""
_LOOKS = f"""
stored AS (
    SELECT 'glossary' AS table_name, entry_id AS id, length(istilah) || ':' || istilah || pengertian AS spelling,
        length({_consistent('istilah')}) || ':' || {_consistent('istilah')} || {_consistent('pengertian')} AS look
    FROM glossary WHERE istilah <> '' AND pengertian <> ''
    UNION ALL SELECT 'corpus', global_id, content, {_consistent('content')} FROM corpus WHERE content <> ''
),
pairs AS (
    SELECT a.table_name, a.id AS id_a, b.id AS id_b, a.low
    FROM (SELECT *, min(id) OVER (PARTITION BY table_name, look) AS low FROM stored) a JOIN stored b ON a.table_name = b.table_name AND a.look = b.look AND a.spelling <> b.spelling
)
"""

SQL = {
    "p2_found": f"WITH {_ENTRIES} SELECT DISTINCT * FROM (SELECT entry_id, min(entry_id) OVER (PARTITION BY a, b, c) AS keep_id FROM e) x WHERE entry_id <> keep_id",
    "p2_records": f"WITH {_ENTRIES} SELECT min(entry_id) AS keep_id, count(*) AS copies FROM e GROUP BY a, b, c",
    "p6_found": f"WITH {_LOOKS} SELECT table_name, id_a, id_b FROM pairs WHERE id_a < id_b",
    "p6_rows": f"WITH {_LOOKS} SELECT table_name, id_a AS id, min(low) AS class_id, count(*) AS links FROM pairs GROUP BY table_name, id_a",
    "p6_texts": f"""
SELECT 'glossary' AS table_name, entry_id AS id, {_consistent('istilah')} AS istilah, {_consistent('pengertian')} AS text FROM glossary
UNION ALL SELECT 'corpus', global_id, NULL, {_consistent('content')} FROM corpus""",
    "p7_found": f"WITH RECURSIVE {_LINKS} SELECT k1 AS regulation_key, min(k2) AS group_key FROM r GROUP BY k1 HAVING count(*) > 1",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, case_id FROM found",
    "p9_cases": f"WITH {_LEAKS} SELECT case_id, count(*) AS documents FROM found GROUP BY case_id",
}
