"""Reference SQL of the core queries."""

from lontar.plans.sql_core import SQL as CORE

_KEY = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"


def _heavy(name: str) -> str:
    k = _KEY.format("regulation_key")
    return f"""SELECT '{name}' AS table_name, k AS regulation_key FROM (SELECT {k} AS k, count(*) AS n FROM {name} GROUP BY 1) x
    WHERE k IS NOT NULL AND n > 0.03 * (SELECT count(*) FROM {name})"""


def _totals(table: str, value: str) -> str:
    return f"""
f AS (SELECT {_KEY.format("regulation_key")} AS regulation_key, {value} AS v, count(*) AS n FROM {table} GROUP BY 1, 2),
m AS (SELECT regulation_key, v, n, row_number() OVER (PARTITION BY regulation_key ORDER BY n DESC, v) AS r FROM f WHERE v IS NOT NULL),
t AS (SELECT regulation_key, CAST(sum(n) AS BIGINT) AS "rows", count(v) AS distinct_values FROM f GROUP BY 1),
b AS (SELECT t.regulation_key, t."rows", t.distinct_values, m.v AS mode, m.n AS mode_rows
      FROM t LEFT JOIN m ON t.regulation_key IS NOT DISTINCT FROM m.regulation_key AND m.r = 1)"""


_CSV = r"""
lines AS (SELECT line_no, regexp_replace(raw_line, '\r?\n$|\r$', '') AS l FROM glossary_raw),
shaped AS (
    SELECT line_no, l,
        regexp_full_match(l, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoted_well,
        regexp_extract_all(l || ',', '("(?:[^"]|"")*"|[^",]*),', 1) AS raw
    FROM lines
),
cells AS (
    SELECT line_no, quoted_well, list_transform(raw, lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS c,
        len(list_filter(raw, lambda x: x NOT LIKE '"%' AND regexp_matches(x, '[\r\n]'))) AS breaks
    FROM shaped
),
named AS (SELECT line_no, quoted_well, len(c) = 6 AND breaks = 0 AS six, c, c[2] AS pengertian, c[4] AS uu, c[5] AS url FROM cells),
judged AS (
    SELECT *, CASE
        WHEN NOT quoted_well THEN 'quoting'
        WHEN NOT six THEN 'column_count'
        WHEN NOT regexp_matches(pengertian, '\p{L}{2}') OR regexp_matches(pengertian, '(?i)^\s*#(value|ref|name|div/0|n/a|num|null|spill|calc|getting_data|error)[!?]?')
            OR lower(trim(pengertian)) = 'pengertian' OR regexp_matches(pengertian, '[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x{84}\x{86}-\x{9f}\x{fffd}]') THEN 'value'
        WHEN uu <> '' AND (NOT regexp_matches(uu, '\p{L}{2}') OR regexp_matches(uu, '(?i)^\s*#(value|ref|name|div/0|n/a|num|null|spill|calc|getting_data|error)[!?]?')
            OR lower(trim(uu)) = 'uu' OR regexp_matches(uu, '^\s*=')) THEN 'value'
        WHEN NOT regexp_matches(url, '(?i)^https?://([^\s/?#@]*@)?([^\s/?#:@\[\]]+)(:\d*)?([/?#]\S*)?$') THEN 'value'
        END AS reason
    FROM named
)
"""

SQL = CORE | {
    "p1_found": f"{_heavy('qa_sft')} UNION ALL {_heavy('corpus')}",
    "p1_answers": " UNION ALL ".join(f"SELECT * FROM (WITH {_totals(t, _KEY.format(v))} SELECT '{t}' AS table_name, b.* FROM b) x" for t, v in (("qa_sft", "answer_hash"), ("corpus", "content_hash"))),
    "p1_keys": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {_totals(t, 'token_count')},
c AS (SELECT regulation_key, v, sum(n) OVER (PARTITION BY regulation_key ORDER BY v) AS upto, sum(n) OVER (PARTITION BY regulation_key) AS total FROM f WHERE v IS NOT NULL),
q AS (SELECT regulation_key, min(v) FILTER (upto >= ceil(0.5 * total)) AS p50, min(v) FILTER (upto >= ceil(0.9 * total)) AS p90 FROM c GROUP BY 1)
SELECT '{t}' AS table_name, b.*, q.p50, q.p90 FROM b LEFT JOIN q ON b.regulation_key IS NOT DISTINCT FROM q.regulation_key) x"""
        for t in ("qa_sft", "corpus")
    ),
    "p5_found": f"WITH {_CSV} SELECT line_no, reason FROM judged WHERE reason IS NOT NULL",
    "p5_reasons": f'WITH {_CSV} SELECT reason, count(*) AS "rows" FROM judged WHERE reason IS NOT NULL GROUP BY reason',
    "p5_loaded": f"""WITH {_CSV} SELECT line_no, c[1] AS istilah, c[2] AS pengertian, c[3] AS undang_undang, c[4] AS uu, c[5] AS url, c[6] AS status
FROM judged WHERE reason IS NULL""",
}
