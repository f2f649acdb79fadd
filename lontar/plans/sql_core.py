"""Reference SQL of the reference engine's own operators, written for DuckDB over the same tables.

DuckDB has no compatibility normal form: full-width ASCII forms and the ligature that occur are
translated instead, which is the same on these tables.
"""

from lontar.functions.tokens import ABSTENTIONS, CONTENT_STOPWORDS, TERM_STOPWORDS

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
RAW = ("istilah", "pengertian", "undang_undang", "uu", "url", "status")
SEED, CAP = "lontar", 3
QUOTAS = {"anchor": 3, "multi_sense": 8, "domain_focus": 4, "near_neighbor": 6, "alias": 9, "numeric": 9, "long_definition": 5, "typical_fill": 6}


def display(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(replace(translate(coalesce({x}, ''), '{_WIDE}', '{_ASCII}'), 'ﬁ', 'fi')), '{_SPACE}', ' ', 'g'))"


def key(x: str) -> str:
    return f"lower({display(x)})"


def bare(x: str) -> str:
    """A key trimmed and in lower case, null if empty."""
    return f"nullif(lower(regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')), '')"


def joined(*parts: str) -> str:
    return " || chr(31) || ".join(parts)


def ident(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256({joined(*parts)}), 1, 16)"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+')"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def content(x: str) -> str:
    return f"list_filter({words(x)}, lambda t: t NOT IN ({_listed(CONTENT_STOPWORDS)}) AND length(t) > 1)"


def _shown(source: str) -> str:
    return f"n AS (SELECT entry_id AS row, {', '.join(f'{display(c)} AS d_{c}' for c in RAW)}, {', '.join(f'{key(c)} AS k_{c}' for c in RAW)} FROM {source})"


N = _shown("glossary")
BOTH = _shown(f"(SELECT entry_id, {', '.join(RAW)} FROM glossary UNION ALL SELECT entry_id, {', '.join(f"payload ->> '$.{c}'" for c in RAW)} FROM glossary_feed) b")
_KEYS = ", ".join(f"k_{c}" for c in RAW)
U = f"u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY row) AS rn, count(*) OVER (PARTITION BY {_KEYS}) AS duplicate_count FROM n) x WHERE rn = 1)"


def regulation(x: str) -> str:
    both = r"(?i)\bnomor\s+(.+?)\s+tahun\s+((?:19|20)\d{2})\b"
    return rf"""{x} AS r_label,
        CASE WHEN regexp_extract({x}, '(?i)^(.+?)\s+nomor\b', 1) <> '' THEN trim(regexp_extract({x}, '(?i)^(.+?)\s+nomor\b', 1)) ELSE {x} END AS r_type,
        CASE WHEN regexp_extract({x}, '{both}', 2) <> '' THEN trim(regexp_extract({x}, '{both}', 1)) ELSE regexp_extract({x}, '(?i)\bnomor\s+([A-Za-z0-9./-]+)', 1) END AS r_number,
        CASE WHEN regexp_extract({x}, '{both}', 2) <> '' THEN regexp_extract({x}, '{both}', 2)
             WHEN regexp_extract({x}, '(?i)\btahun\s+((?:19|20)\d{{2}})\b', 1) <> '' THEN regexp_extract({x}, '(?i)\btahun\s+((?:19|20)\d{{2}})\b', 1)
             ELSE coalesce(regexp_extract_all({x}, '\b(?:19|20)\d{{2}}\b')[-1], '') END AS r_year"""


_KIND = "CASE {0} WHEN 'uu' THEN 'undangundang' WHEN 'pp' THEN 'peraturanpemerintah' WHEN 'perpu' THEN 'peraturanpemerintahpenggantiundangundang' ELSE {0} END"


def kind_key(k: str) -> str:
    return _KIND.format(f"regexp_replace({k}, '[^a-z0-9]+', '', 'g')")


def number_key(d: str) -> str:
    return rf"CASE WHEN regexp_extract({d}, '\d+') = '' THEN '' ELSE regexp_replace(regexp_extract({d}, '\d+'), '^0+(\d)', '\1') END"


_TAIL = r"regexp_replace(substr(d_pengertian, length(d_istilah) + 1), '(?i)^(?:\s*[,;:\-–—]\s*|\s+)(?:(?:adalah|merupakan)\s+)?', '')"
STRIPPED = rf"""(d_istilah <> '' AND lower(substr(d_pengertian, 1, length(d_istilah))) = lower(d_istilah)
    AND regexp_matches(substr(d_pengertian, length(d_istilah) + 1), '^(?:\s*[,;:\-–—]|\s)') AND trim({_TAIL}) <> '')"""
REASON = """CASE
    WHEN k_istilah = '' OR k_pengertian = '' OR k_undang_undang = '' THEN 'missing_required:' || concat_ws(',',
        CASE WHEN k_istilah = '' THEN 'istilah' END, CASE WHEN k_pengertian = '' THEN 'pengertian' END, CASE WHEN k_undang_undang = '' THEN 'undang_undang' END)
    WHEN k_status <> 'ok' THEN 'source_unverified' WHEN k_uu = '' THEN 'missing_regulation_title'
    WHEN r_number = '' OR r_year = '' THEN 'unparseable_regulation_identity' ELSE '' END"""
S = f"""s AS (SELECT *, {ident('term', 'k_istilah')} AS term_id, {ident('sense', 'k_istilah', 'k_pengertian', 'k_undang_undang', 'k_uu')} AS sense_id,
    {REASON} AS quarantine_reason, {STRIPPED} AS removed FROM (SELECT *, {regulation('d_undang_undang')} FROM u) x)"""
T = r"""c AS (SELECT * FROM s WHERE quarantine_reason = ''),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY d_istilah, r_label, sense_id) AS place FROM c) x WHERE place = 1),
agg AS (SELECT term_id, count(*) AS sense_count, string_agg(DISTINCT sense_id, '|' ORDER BY sense_id) AS sense_ids, string_agg(DISTINCT r_label, '|' ORDER BY r_label) AS source_labels,
    max(length(d_pengertian)) AS longest_definition, bool_or(regexp_matches(d_pengertian, '(?i)\bselanjutnya\s+(?:disebut|disingkat)\b')) AS has_alias,
    bool_or(regexp_matches(d_pengertian, '\d')) AS has_digits, bool_or(NOT removed) AS warned FROM c GROUP BY term_id),
t AS (SELECT agg.*, first.d_istilah AS canonical_term, first.k_istilah AS normalized_term, first.r_label AS primary_label, first.d_uu AS primary_title,
    first.d_pengertian AS definition, length(first.d_pengertian) AS definition_length, r_type, r_number, r_year, first.k_pengertian AS definition_key, first.k_uu AS title_key
    FROM agg JOIN first USING (term_id))"""
TERMS = f"{N}, {U}, {S}, {T}"


_NEAR = f"""
tt AS (SELECT term_id, normalized_term, list_distinct(list_filter(regexp_extract_all(normalized_term, '[a-z0-9ı]+'), lambda x: x NOT IN ({_listed(TERM_STOPWORDS)}) AND length(x) > 1)) AS tok FROM t WHERE NOT warned),
ex AS (SELECT term_id, len(tok) AS n, unnest(tok) AS w FROM tt),
near AS (SELECT a.term_id AS left_id, b.term_id AS right_id, count(*) AS shared FROM ex a JOIN ex b ON a.w = b.w AND a.term_id < b.term_id
    GROUP BY 1, 2, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5)"""
NEAR = f"{TERMS}, {_NEAR}"
_RANKED_PAIRS = f"""
sized AS (SELECT term_id, len(tok) AS size FROM tt),
scored_pairs AS (SELECT left_id, right_id, a.primary_label AS ls, b.primary_label AS rs, shared / (x.size + y.size - shared) AS score,
    sha256({joined(f"'{SEED}'", "'near_neighbor'", 'left_id || right_id')}) AS rank
    FROM near JOIN t a ON a.term_id = left_id JOIN t b ON b.term_id = right_id JOIN sized x ON x.term_id = left_id JOIN sized y ON y.term_id = right_id)"""


def _walk(name: str, where: str, sources: str, quota: int) -> str:
    """A recursive walk over the pairs, best first, that takes what is free and fits."""
    return f"""{name}_ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, rank) AS k FROM scored_pairs WHERE {where}),
{name}_walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, {sources} AS sources
    UNION ALL SELECT k, CASE WHEN ok THEN used || [left_id, right_id] ELSE used END, CASE WHEN ok THEN sources || [ls, rs] ELSE sources END
    FROM (SELECT w.used, w.sources, o.left_id, o.right_id, o.ls, o.rs, o.k, NOT list_contains(w.used, left_id) AND NOT list_contains(w.used, right_id)
        AND len(list_filter(w.sources || [ls, rs], lambda x: x = ls)) <= {CAP} AND len(list_filter(w.sources || [ls, rs], lambda x: x = rs)) <= {CAP} AS ok
        FROM {name}_walk w JOIN {name}_ordered o ON o.k = w.k + 1 WHERE len(w.used) < {quota}) x),
{name}_used AS (SELECT used FROM {name}_walk ORDER BY k DESC LIMIT 1),
{name}_pairs AS (SELECT used[2 * i - 1] AS a, used[2 * i] AS b FROM (SELECT used, unnest(range(1, len(used) // 2 + 1)) AS i FROM {name}_used) x),
{name}_related AS (SELECT a AS term_id, string_agg(DISTINCT canonical_term, '|' ORDER BY canonical_term) AS related_terms
    FROM (SELECT a, b FROM {name}_pairs UNION SELECT b, a FROM {name}_pairs) p JOIN t ON t.term_id = b GROUP BY a)"""


def _bucket(name: str, where: str, quota: str, before: str) -> str:
    return f"""{name}_open AS (SELECT term_id, primary_label AS source, sha256({joined(f"'{SEED}'", f"'{name}'", 'term_id')}) AS rank FROM t
    WHERE NOT warned AND {where} AND term_id NOT IN (SELECT term_id FROM {before})),
{name}_kept AS (SELECT o.* FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, term_id) AS number FROM {name}_open) o
    LEFT JOIN (SELECT source, count(*) AS n FROM {before} GROUP BY source) a USING (source) WHERE number + coalesce(a.n, 0) <= {CAP}),
{name}_chosen AS (SELECT * FROM {before} UNION ALL SELECT term_id, source, '{'typical_fill' if name == 'fallback' else name}' FROM
    (SELECT term_id, source, row_number() OVER (ORDER BY rank, term_id) AS place FROM {name}_kept) p WHERE place <= {quota})"""


def _selection() -> str:
    ranked = {"alias": "has_alias", "numeric": "has_digits", "long_definition": "longest_definition >= (SELECT x FROM p90)", "typical_fill": "true"}
    parts = [
        f"""lengths AS (SELECT list(longest_definition ORDER BY longest_definition) AS v, count(*) AS n FROM t WHERE NOT warned),
p90 AS (SELECT v[CAST(round_even((n - 1) * 0.9, 0) AS INT) + 1] AS x FROM lengths),
anchors AS (SELECT * FROM t WHERE NOT warned ORDER BY sha256({joined(f"'{SEED}'", "'anchor'", 'term_id')}), term_id LIMIT {QUOTAS['anchor']}),
anchor_chosen AS (SELECT term_id, primary_label AS source, 'anchor' AS bucket FROM anchors)""",
        _bucket("multi_sense", "sense_count > 1", str(QUOTAS["multi_sense"]), "anchor_chosen"),
        f"""focus_pool AS (SELECT *, sha256({joined(f"'{SEED}'", "'focus'", 'term_id')}) AS r FROM t WHERE NOT warned AND primary_label NOT IN (SELECT source FROM multi_sense_chosen)),
focus AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY primary_label ORDER BY r, term_id) AS k FROM focus_pool) p WHERE k = 1 ORDER BY r, term_id LIMIT {QUOTAS['domain_focus']}),
focus_chosen AS (SELECT * FROM multi_sense_chosen UNION ALL SELECT term_id, primary_label, 'domain_focus' FROM focus)""",
        _NEAR,
        _RANKED_PAIRS,
        _walk("near_", "left_id NOT IN (SELECT term_id FROM focus_chosen) AND right_id NOT IN (SELECT term_id FROM focus_chosen)", "(SELECT list(source) FROM focus_chosen)", QUOTAS["near_neighbor"]),
        "near_chosen AS (SELECT * FROM focus_chosen UNION ALL SELECT term_id, primary_label, 'near_neighbor' FROM t WHERE term_id IN (SELECT unnest(used) FROM near__used))",
    ]
    before = "near_chosen"
    for name, where in ranked.items():
        parts.append(_bucket(name, where, str(QUOTAS[name]), before))
        before = f"{name}_chosen"
    parts.append(_bucket("fallback", "true", f"({sum(QUOTAS.values())} - (SELECT count(*) FROM {before}))", before))
    parts.append("""chosen AS (SELECT * FROM fallback_chosen),
pilot AS (SELECT t.*, c.bucket, coalesce(r.related_terms, '') AS related_terms FROM t JOIN chosen c USING (term_id) LEFT JOIN near__related r USING (term_id))""")
    return ", ".join(parts)


SELECTED = f"{TERMS}, {_selection()}"
EVIDENCE = f"""{SELECTED},
p AS (SELECT t.*, {kind_key('lower(r_type)')} AS kind_key, {number_key('r_number')} AS number_key FROM t WHERE term_id IN (SELECT term_id FROM chosen)),
k AS (SELECT global_id, article, {kind_key(key('regulation_type'))} AS kind_key, {number_key(display('regulation_number'))} AS number_key, coalesce("year", '') AS year_key,
    {key('content')} AS content_key, {key('title')} AS corpus_title, {key('article')} AS article_key FROM corpus),
f AS (SELECT p.term_id, k.global_id, k.article_key, contains(content_key, normalized_term) AS term_present,
    definition_key <> '' AND contains(content_key, definition_key) AS exact_definition,
    CASE WHEN len(dt) > 0 THEN len(list_intersect(dt, list_distinct(regexp_extract_all(content_key, '[a-z0-9ı]+')))) / len(dt) ELSE 0.0 END AS coverage,
    CAST(title_key = corpus_title AS DOUBLE) AS title_similarity
    FROM (SELECT *, list_distinct(regexp_extract_all(definition_key, '[a-z0-9ı]+')) AS dt FROM p) p JOIN k ON p.kind_key = k.kind_key AND p.number_key = k.number_key AND p.r_year = k.year_key),
e AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY term_present DESC, exact_definition DESC, coverage DESC, title_similarity DESC,
    regexp_matches(article_key, '^pasal\\s+1\\b') DESC, global_id) AS candidate_rank
    FROM (SELECT *, max(term_present) OVER (PARTITION BY term_id) AS any_present FROM f) x WHERE term_present OR NOT any_present),
best AS (SELECT *, concat_ws('|', CASE WHEN title_similarity < 0.6 THEN 'low_title_similarity' END,
    CASE WHEN exact_definition AND NOT starts_with(article_key, 'pasal') THEN 'definition_found_in_non_article_metadata' END) AS metadata_warnings FROM e WHERE candidate_rank <= 3),
m AS (SELECT p.term_id, p.primary_label, coalesce(i.identity_rows, 0) AS identity_rows, coalesce(i.term_rows, 0) AS term_rows,
    CASE WHEN coalesce(identity_rows, 0) = 0 THEN 'regulation_not_found' WHEN coalesce(term_rows, 0) = 0 THEN 'term_not_found_in_regulation'
         WHEN b.exact_definition THEN 'candidate_exact_definition' WHEN b.coverage >= 0.8 THEN 'candidate_high_coverage' ELSE 'candidate_needs_review' END AS match_status,
    b.global_id AS top_global_id
    FROM p LEFT JOIN (SELECT term_id, count(*) AS identity_rows, count(*) FILTER (term_present) AS term_rows FROM f GROUP BY 1) i USING (term_id)
    LEFT JOIN best b ON b.term_id = p.term_id AND b.candidate_rank = 1)"""
_REGISTRY = f"""labels AS (SELECT DISTINCT k_undang_undang AS label_key FROM n),
registry AS (SELECT label_key, {ident('registry', 'label_key')} AS source_id,
    CASE WHEN substr(sha256({joined(f"'{SEED}'", "'signal'", 'label_key')}), 1, 1) < '3' THEN 'amended' ELSE 'status_not_reviewed' END AS signal FROM labels)"""
REVIEW = f"""{EVIDENCE}, {_REGISTRY},
indexed AS (SELECT row_number() OVER (ORDER BY list_position({list(QUOTAS)}, bucket), normalized_term, term_id) AS pilot_index, * FROM pilot),
best_articles AS (SELECT best.term_id, k.article, best.metadata_warnings FROM best JOIN k USING (global_id) WHERE candidate_rank = 1),
q AS (SELECT i.pilot_index, i.term_id, i.canonical_term, i.bucket, i.primary_label, i.primary_title, r.source_id, r.signal, m.match_status, m.top_global_id,
    coalesce(b.article, '') AS article, coalesce(b.metadata_warnings, '') AS metadata_warnings
    FROM indexed i JOIN m USING (term_id) JOIN registry r ON r.label_key = {key('i.primary_label')} LEFT JOIN best_articles b ON b.term_id = i.term_id),
reviews AS (SELECT {ident('source_review', 'term_id', 'source_id')} AS review_id, *, 'pending_human_review' AS review_status,
    concat_ws('|', 'official_document_and_definition_required', CASE match_status WHEN 'regulation_not_found' THEN 'dataset_regulation_unresolved'
        WHEN 'term_not_found_in_regulation' THEN 'dataset_term_unresolved' END, CASE WHEN metadata_warnings <> '' THEN 'dataset_metadata_warning' END,
        CASE WHEN signal <> 'status_not_reviewed' THEN 'official_status_signal_requires_review' END) AS attention_flags FROM q),
held AS (SELECT term_id FROM reviews ORDER BY sha256({joined(f"'{SEED}'", 'term_id')}), term_id LIMIT 20)"""
_SLOTS = f"""slots AS (SELECT {ident('gold_query', 'term_id', 'CAST(query_slot AS VARCHAR)')} AS query_id, term_id, review_id, query_slot, canonical_term,
    CASE WHEN term_id IN (SELECT term_id FROM held) THEN 'locked_test' ELSE 'development' END AS query_split, '' AS query_text FROM (SELECT *, unnest(range(1, 6)) AS query_slot FROM reviews) w)"""


def _d(n: int) -> str:
    return f"substr(h, {n}, 1)"


_REVIEWED = f"""{REVIEW}, {_SLOTS},
sources AS (SELECT review_id, term_id, CASE {_d(1)} WHEN '0' THEN '' WHEN '1' THEN 'http' WHEN '2' THEN 'other' ELSE 'official' END AS url, {_d(2)} AS sha, {_d(3)} AS art, {_d(4)} AS def, {_d(5)} AS cmp, {_d(6)} AS who,
    {_d(7)} AS time, CASE WHEN {_d(8)} = '0' THEN 'unknown' WHEN {_d(8)} < 'c' THEN 'verified' ELSE 'pending_human_review' END AS status FROM (SELECT *, sha256(review_id) AS h FROM reviews) x),
gold AS (SELECT query_id, CASE WHEN {_d(1)} = '0' THEN 'none' ELSE term_id END AS term, CASE WHEN {_d(2)} = '0' THEN 'none' ELSE term_id END AS expected, CASE WHEN {_d(3)} = '0' THEN 'none' ELSE review_id END AS review,
    {_d(4)} AS said, {_d(5)} AS author, {_d(6)} AS who, {_d(7)} AS time, CASE WHEN {_d(8)} = '0' THEN 'unknown' WHEN {_d(8)} < 'c' THEN 'approved' ELSE 'pending_human_review' END AS status
    FROM (SELECT *, sha256(query_id) AS h FROM slots) x),
checked AS (SELECT g.*, s.status AS source_status, g.term IN (SELECT term_id FROM sources) AS known FROM gold g LEFT JOIN sources s ON s.review_id = g.review)"""


def _codes(table: str, row: str, source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, {row} AS row, '{code}' AS code FROM {source} WHERE {broken}" for code, broken in rules.items())


_SOURCE_RULES = {
    "status_unknown": "status = 'unknown'", "document_url_missing": "status = 'verified' AND url = ''", "document_url_not_official": "status = 'verified' AND url IN ('http', 'other')",
    "document_sha256_invalid": "status = 'verified' AND sha IN ('0', '1')", "article_missing": "status = 'verified' AND art < '2'", "definition_missing": "status = 'verified' AND def < '2'",
    "comparison_not_accepted": "status = 'verified' AND cmp < '2'", "reviewer_missing": "status = 'verified' AND who < '2'", "reviewed_at_invalid": "status = 'verified' AND time IN ('0', '1')",
}
_GOLD_RULES = {
    "status_unknown": "status = 'unknown'", "term_unknown": "NOT known", "expected_term_differs": "expected <> term", "source_unknown": "status = 'approved' AND source_status IS NULL",
    "source_not_verified": "status = 'approved' AND source_status <> 'verified'", "text_missing": "status = 'approved' AND said = '0'", "text_leaks_term": "status = 'approved' AND said = '1'",
    "author_missing": "status = 'approved' AND author = '0'", "reviewer_missing": "status = 'approved' AND who = '0'", "reviewed_at_invalid": "status = 'approved' AND time = '0'",
}

_ARTICLE = r"nullif(regexp_extract({0}, 'pasal\s+(\d+[a-z]?)', 1), '')"
_PAIRS = f"""
ck AS (SELECT *, {key('regulation_key')} AS pair_key, {_ARTICLE.format(key('article'))} AS pair_article FROM corpus),
chunks AS (SELECT * FROM ck WHERE regexp_matches(pair_key, '^[^|]+\\|[^|]+\\|\\d{{4}}$') AND NOT starts_with(pair_key, 'answer:') AND pair_article IS NOT NULL)"""
CASES = f"""{_PAIRS},
qk AS (SELECT id, prompt, completion, {key('regulation_key')} AS pair_key, {_ARTICLE.format(key('prompt'))} AS pair_article FROM qa_sft WHERE split = 'test'),
asked AS (SELECT * FROM qk WHERE trim(coalesce(prompt, '')) <> '' AND length(trim(coalesce(completion, ''))) >= 20
    AND regexp_matches(pair_key, '^[^|]+\\|[^|]+\\|\\d{{4}}$') AND NOT starts_with(pair_key, 'answer:') AND pair_article IS NOT NULL),
pool AS (SELECT a.*, EXISTS (SELECT 1 FROM chunks c WHERE c.pair_key = a.pair_key AND c.pair_article = a.pair_article) AS available
    FROM (SELECT *, row_number() OVER (PARTITION BY pair_key, pair_article ORDER BY id) AS r FROM asked) a WHERE r = 1),
ranked AS (SELECT *, substr(sha256('{SEED}:' || CASE WHEN available THEN 'covered' ELSE 'missing' END || ':' || pair_key || ':' || pair_article), 1, 16) AS priority FROM pool),
few AS (SELECT *, row_number() OVER (PARTITION BY available ORDER BY priority, pair_key, pair_article) AS place FROM ranked),
cases AS (SELECT *, 'qa-' || CASE WHEN available THEN 'covered' ELSE 'missing' END || '-' || lpad(CAST(row_number() OVER (PARTITION BY available
    ORDER BY priority DESC, pair_key, pair_article) AS VARCHAR), 4, '0') AS case_id FROM few WHERE place <= CASE WHEN available THEN 100 ELSE 25 END)"""
_HITS = f"""
lastc AS (SELECT * FROM (SELECT k.case_id, {content(key('k.prompt'))} AS asked_words, c.*, row_number() OVER (PARTITION BY k.case_id, c.id ORDER BY global_id DESC) AS lr
    FROM cases k JOIN chunks c ON k.pair_key = c.pair_key AND k.pair_article = c.pair_article) x WHERE lr = 1),
scored AS (SELECT case_id, id, content, chunk_index, len(list_intersect(list_distinct(asked_words),
    list_distinct({content(key("concat_ws(' ', coalesce(title, ''), coalesce(article, ''), coalesce(content, ''))"))}))) AS overlap FROM lastc),
hits AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY overlap DESC, coalesce(chunk_index, 0), id) AS place, count(*) OVER (PARTITION BY case_id) AS candidates FROM scored)"""
HITS = f"{CASES}, {_HITS}"
#: The evaluation cases by what they expect, with the same retrieval.
ASKED_HITS = f"""{_PAIRS},
cases AS (SELECT *, {key("concat_ws('|', expected_regulation_type, expected_regulation_number, CAST(expected_year AS VARCHAR))")} AS pair_key,
    {_ARTICLE.format(key('expected_article'))} AS pair_article FROM eval_cases), {_HITS}"""
_NL = "chr(10)"
_LINES = f"{_NL} || {_NL}"
NO_CONTEXT = f"'[NO_CONTEXT]' || {_NL} || 'Tidak ada chunk dari candidate corpus untuk identitas peraturan dan pasal ini. Jangan menebak isi pasal.'"


def _c(column: str) -> str:
    return f"coalesce(CAST(l.{column} AS VARCHAR), '')"


_PACKED = f"""
blocks AS (SELECT h.case_id, h.place, '[C' || h.place || ']' || {_NL} || 'Candidate corpus record: ' || {_c('regulation_type')} || ' Nomor ' || {_c('regulation_number')} || ' Tahun ' || {_c('year')}
    || {_NL} || 'Judul: ' || {_c('title')} || {_NL} || 'Ketentuan: ' || {_c('article')} || {_NL} || 'Chunk: ' || {_c('chunk_index')} || ' dari ' || {_c('chunk_count')} || {_NL} || 'Teks: ' AS prefix,
    {_c('content')} AS body FROM hits h JOIN lastc l USING (case_id, id) WHERE h.place <= 4),
steps AS (
    SELECT case_id, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS listed, CAST(14000 AS BIGINT) AS room, false AS cut, false AS stop FROM (SELECT DISTINCT case_id FROM blocks) b
    UNION ALL
    SELECT s.case_id, b.place, CASE WHEN s.stop OR s.room <= length(prefix) + 20 THEN s.listed ELSE list_append(s.listed, prefix || substr(body, 1, CAST(least(5000, s.room - length(prefix) - 2) AS BIGINT))) END,
        CASE WHEN s.stop OR s.room <= length(prefix) + 20 THEN s.room ELSE s.room - length(prefix) - least(length(body), 5000, s.room - length(prefix) - 2) - 2 END,
        s.cut OR s.stop OR s.room <= length(prefix) + 20 OR length(body) > least(5000, s.room - length(prefix) - 2), s.stop OR s.room <= length(prefix) + 20
    FROM steps s JOIN blocks b ON b.case_id = s.case_id AND b.place = s.place + 1),
packed AS (SELECT case_id, array_to_string(CASE WHEN cut THEN list_append(listed, '[CONTEXT_TRUNCATED]') ELSE listed END, {_LINES}) AS context, cut AS truncated
    FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY place DESC) AS back FROM steps) x WHERE back = 1)"""


def _f1(source: str, r: str, a: str) -> str:
    """CTEs that score `a` against `r` (keys) of `source` (id, r, a)."""
    return f"""src AS ({source}),
sized AS (SELECT id, {words(r)} AS rw, {words(a)} AS aw FROM src),
rc AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(rw) AS w FROM sized) x GROUP BY 1, 2),
ac AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(aw) AS w FROM sized) x GROUP BY 1, 2),
shared AS (SELECT id, sum(least(rc.n, ac.n)) AS n FROM rc JOIN ac USING (id, w) GROUP BY id),
f1 AS (SELECT s.id, CASE WHEN len(rw) = 0 OR len(aw) = 0 THEN 0.0 ELSE coalesce(n, 0) / len(aw) END AS precision,
    CASE WHEN len(rw) = 0 OR len(aw) = 0 THEN 0.0 ELSE coalesce(n, 0) / len(rw) END AS recall,
    CASE WHEN len(rw) = 0 OR len(aw) = 0 OR coalesce(n, 0) = 0 THEN 0.0 ELSE 2.0 * n / (len(rw) + len(aw)) END AS f1, rw, aw
    FROM sized s LEFT JOIN shared USING (id))"""


def _markers(x: str) -> str:
    return rf"""list_distinct(list_concat(list_transform(regexp_extract_all({x}, '\bpasal\s+\d+[a-z]?(?:\s+ayat\s*\(\d+\))?'), lambda y: regexp_replace(y, '\s+', ' ', 'g')),
        regexp_extract_all({x}, '\b(?:19|20)\d{{2}}\b')))"""


def _repeated(w: str) -> str:
    grams = f"list_transform(range(1, len({w}) - 4), lambda i: array_to_string({w}[i : i + 5], ' '))"
    return f"CASE WHEN len({w}) < 12 THEN 0.0 ELSE (len({grams}) - len(list_distinct({grams}))) / len({grams}) END"


_ABSTAINS = "(" + " OR ".join(f"contains({{0}}, '{p}')" for p in ABSTENTIONS) + ")"
_QA = f"SELECT id, completion, {key('completion')} AS a, {key('prompt')} AS r FROM qa_sft"
METRICS = f"""{_f1(_QA, 'r', 'a')},
more AS (SELECT id, completion, a, {content('a')} AS acw, list_distinct({words('r')}) AS cw, {_markers('r')} AS em, {_markers('a')} AS fm FROM src)"""
_CONDITIONS = f"""{HITS},
two AS (SELECT case_id, available, reference, label, answer FROM (
    SELECT c.case_id, c.available, c.completion AS reference, 'without' AS label, c.prompt AS answer FROM cases c UNION ALL
    SELECT c.case_id, c.available, c.completion, 'with', coalesce(h.content, '') FROM cases c LEFT JOIN hits h ON h.case_id = c.case_id AND h.place = 1) x),
{_f1(f"SELECT case_id || '/' || label AS id, {key('answer')} AS a, {key('reference')} AS r FROM two", 'r', 'a')},
judged AS (SELECT t.case_id, t.available, t.label, f1.f1, {_repeated('f1.aw')} AS repeated, {_ABSTAINS.format('s.a')} AS abstains,
    CASE WHEN len({_markers('s.r')}) > 0 THEN len(list_intersect({_markers('s.r')}, {_markers('s.a')})) / len({_markers('s.r')}) END AS marker_recall
    FROM two t JOIN src s ON s.id = t.case_id || '/' || t.label JOIN f1 ON f1.id = s.id)"""
_BM25 = f"""
q AS (SELECT case_id AS query_id, unnest(list_distinct({content(key('prompt'))})) AS w FROM eval_cases),
d AS (SELECT global_id AS doc_id, {content(key('content'))} AS ws FROM corpus),
st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
po AS (SELECT doc_id, len_ AS size, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len_, unnest(ws) AS w FROM d) x GROUP BY 1, 2, 3),
dfs AS (SELECT w, count(*) AS df FROM po GROUP BY w),
sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM q JOIN po USING (w) JOIN dfs USING (w), st GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM sc)"""
_GOLD = f"""
gold AS (SELECT DISTINCT e.case_id AS query_id, c.global_id AS doc_id FROM eval_cases e JOIN corpus c
    ON {bare('c.regulation_key')} = lower(e.expected_regulation_type) || '|' || e.expected_regulation_number || '|' || e.expected_year
    AND {_ARTICLE.format(key('c.article'))} = {_ARTICLE.format(key('e.expected_article'))} WHERE NOT e.out_of_scope)"""
_ASK = r"(?i)(undang-undang|uu|peraturan pemerintah|pp)\s*(?:nomor|no\.?|#)?\s*(\d+)\s+tahun\s+(\d{4})"
_PART = r"(?i)pasal\s+(\d+[a-z]?)(?:\s+ayat\s*\((\d+)\))?(?:\s+huruf\s+([a-z]))?(?:\s+angka\s+(\d+))?"


def _rates(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) <> '' THEN 1 ELSE 0 END), 4) AS rate FROM {table}" for c in columns)


SQL = {
    "normalize_text": f"WITH {N} SELECT row AS entry_id, d_istilah, k_istilah, d_pengertian, k_pengertian FROM n",
    "stable_ids": f"""WITH {N} SELECT row AS entry_id, {ident('term', 'k_istilah')} AS term_id, {ident('source', 'k_undang_undang', 'k_uu', 'k_url')} AS source_id,
        sha256({joined(f"'{SEED}'", "'bucket'", 'k_istilah')}) AS rank, substr(sha256('{SEED}:bucket:' || k_istilah), 1, 16) AS priority FROM n""",
    "url_hosts": f"""WITH {N}, h AS (SELECT lower(regexp_extract(d_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, d_url FROM n)
        SELECT host, count(*) AS "rows", count(*) FILTER (regexp_matches(d_url, '(?i)^https://') AND host = 'kamus.example.invalid') AS official FROM h GROUP BY host""",
    "regulation_labels": f"""WITH {N}, l AS (SELECT DISTINCT d_undang_undang AS label FROM n), r AS (SELECT label, {regulation('label')} FROM l)
        SELECT label, r_type AS type, r_number AS number, r_year AS year, {kind_key('lower(r_type)')} AS kind_key, {number_key('r_number')} AS number_key FROM r""",
    "strip_prefixes": f"WITH {N} SELECT row AS entry_id, CASE WHEN {STRIPPED} THEN trim({_TAIL}) ELSE d_pengertian END AS retrieval_text, {STRIPPED} AS removed FROM n",
    "dedupe_exact": f"WITH {BOTH}, {U} SELECT row AS entry_id, duplicate_count FROM u",
    "duplicate_lineage": f"WITH {BOTH} SELECT row, duplicate_of FROM (SELECT row, min(row) OVER (PARTITION BY {_KEYS}) AS duplicate_of FROM n) x WHERE row <> duplicate_of",
    "quarantine_split": f"WITH {N}, {U}, {S} SELECT row AS entry_id, sense_id, quarantine_reason FROM s",
    "quarantine_counts": f"WITH {N}, {U}, {S} SELECT quarantine_reason, count(*) AS \"rows\" FROM s WHERE quarantine_reason <> '' GROUP BY 1",
    "multi_sense": f"WITH {N}, {U}, {S} SELECT term_id, count(DISTINCT sense_id) AS senses, arg_max(d_istilah, row) AS canonical_term FROM s GROUP BY term_id HAVING count(DISTINCT sense_id) > 1",
    "missing_profile": f"WITH {N} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (k_{c} = '') AS missing FROM n" for c in RAW),
    "coverage_profile": _rates("corpus", ["regulation_key", "title", "chapter", "article", "content", "year", "domain"]),
    "length_percentiles": f"""WITH l AS (SELECT {bare('regulation_type')} AS kind, length(content) AS length FROM corpus WHERE content IS NOT NULL),
        o AS (SELECT kind, list(length ORDER BY length) AS v, count(*) AS n, min(length) AS smallest, max(length) AS largest FROM l GROUP BY kind)
        SELECT kind, n, smallest, largest, v[CAST(round_even((n - 1) * 0.5, 0) AS INT) + 1] AS median, v[CAST(round_even((n - 1) * 0.9, 0) AS INT) + 1] AS p90 FROM o""",
    "frequency_tables": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS \"value\", count(*) AS \"rows\" FROM corpus GROUP BY {c}" for c in ("domain", "source_dataset", "source_revision")),
    "aggregate_terms": f"WITH {TERMS} SELECT term_id, canonical_term, sense_count, sense_ids, primary_label, source_labels, definition_length, longest_definition, has_alias, has_digits, warned FROM t",
    "near_neighbors": f"WITH {NEAR} SELECT left_id, right_id, shared, sha256({joined(f"'{SEED}'", "'near_neighbor'", 'left_id || right_id')}) AS rank FROM near",
    "fuzzy_terms": f"WITH {NEAR} SELECT left_id, right_id, levenshtein(a.normalized_term, b.normalized_term) AS edits FROM near JOIN t a ON a.term_id = left_id JOIN t b ON b.term_id = right_id WHERE levenshtein(a.normalized_term, b.normalized_term) <= 3",
    "quota_select": f"WITH RECURSIVE {SELECTED} SELECT term_id, source, bucket FROM chosen",
    "evidence_rank": f"WITH RECURSIVE {EVIDENCE} SELECT term_id, candidate_rank, global_id, term_present, exact_definition, coverage, title_similarity, metadata_warnings FROM best",
    "match_status": f"WITH RECURSIVE {EVIDENCE} SELECT term_id, identity_rows, term_rows, match_status, top_global_id FROM m",
    "review_queue": f"WITH RECURSIVE {REVIEW} SELECT * FROM reviews",
    "gold_slots": f"WITH RECURSIVE {REVIEW}, {_SLOTS} SELECT query_id, term_id, review_id, query_slot, query_split, query_text FROM slots",
    "registry_signals": f"WITH {N}, {_REGISTRY} SELECT signal, count(*) AS sources FROM registry GROUP BY signal",
    "validate_sources": f"WITH RECURSIVE {_REVIEWED} {_codes('sources', 'review_id', 'sources', _SOURCE_RULES)}",
    "validate_gold": f"WITH RECURSIVE {_REVIEWED} {_codes('gold', 'query_id', 'checked', _GOLD_RULES)}",
    "locked_split": f"WITH RECURSIVE {SELECTED} SELECT term_id FROM chosen ORDER BY sha256({joined(f"'{SEED}'", 'term_id')}), term_id LIMIT 20",
    "validate_rules": f"""
        SELECT 'corpus' AS table_name, CAST(global_id AS VARCHAR) AS row, 'content_missing' AS code FROM corpus WHERE {bare('content') + ' IS NULL'}
        UNION ALL SELECT 'corpus', CAST(global_id AS VARCHAR), 'key_missing' FROM corpus WHERE {bare('regulation_key')} IS NULL
        UNION ALL SELECT 'corpus', CAST(global_id AS VARCHAR), 'year_invalid' FROM corpus WHERE NOT regexp_full_match(coalesce("year", ''), '(19|20)\\d{{2}}')
        UNION ALL SELECT 'corpus', CAST(global_id AS VARCHAR), 'chunk_out_of_range' FROM corpus WHERE chunk_index >= chunk_count
        UNION ALL SELECT 'corpus', CAST(global_id AS VARCHAR), 'hash_invalid' FROM corpus WHERE NOT regexp_full_match(coalesce(content_hash, ''), '[0-9a-f]{{32}}')
        UNION ALL SELECT 'qa_sft', id, 'prompt_missing' FROM qa_sft WHERE {bare('prompt') + ' IS NULL'}
        UNION ALL SELECT 'qa_sft', id, 'completion_missing' FROM qa_sft WHERE {bare('completion') + ' IS NULL'}
        UNION ALL SELECT 'qa_sft', id, 'split_unknown' FROM qa_sft WHERE split NOT IN ('train', 'validation', 'test')
        UNION ALL SELECT 'qa_sft', id, 'regulation_not_in_corpus' FROM (SELECT id, {bare('regulation_key')} AS k FROM qa_sft) x WHERE k IS NOT NULL AND NOT starts_with(k, 'answer:')
            AND NOT EXISTS (SELECT 1 FROM corpus c WHERE {bare('c.regulation_key')} = k)
        UNION ALL SELECT 'corpus', CAST(global_id AS VARCHAR), 'content_repeated' FROM (SELECT global_id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY global_id) AS n FROM corpus) y
            WHERE n > 1 OR content_hash IS NULL OR content_hash = ''""",
    "set_ops": f"""WITH a AS (SELECT DISTINCT {bare('regulation_key')} AS k FROM qa_sft), b AS (SELECT DISTINCT {bare('regulation_key')} AS k FROM corpus)
        SELECT k AS regulation_key, 'left' AS side FROM a WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM b WHERE k IS NOT NULL)
        UNION ALL SELECT k, 'right' FROM b WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM a WHERE k IS NOT NULL)""",
    "union_queue": f"""WITH {N}, {U}, {S} SELECT DISTINCT term_id, quarantine_reason AS queue_reason FROM s WHERE quarantine_reason <> ''
        UNION SELECT term_id, 'several_senses' FROM s GROUP BY term_id HAVING count(DISTINCT sense_id) > 1""",
    "covered_missing": f"WITH {CASES} SELECT available, count(*) AS pairs FROM pool GROUP BY available",
    "priority_sample": f"WITH {CASES} SELECT case_id, id, pair_key, pair_article, available, priority FROM cases",
    "unique_sample": f"""WITH v AS (SELECT DISTINCT {bare('answer_hash')} AS value FROM qa_sft) SELECT value FROM v WHERE value IS NOT NULL
        ORDER BY sha256({joined(f"'{SEED}'", 'value')}), value LIMIT 200""",
    "retrieve_topk": f"WITH {HITS} SELECT case_id, place, id, overlap, candidates FROM hits WHERE place <= 4",
    "title_collisions": f"""WITH {_PAIRS}, sp AS (SELECT pair_key, pair_article, {key('title')} AS tk, arg_min(trim(title), global_id) AS title, count(*) AS n FROM chunks WHERE {key('title')} <> '' GROUP BY 1, 2, 3)
        SELECT pair_key, pair_article, count(*) AS titles, CAST(sum(n) AS BIGINT) AS chunks, array_to_string(list_sort(list_distinct(list(title)))[1:10], '|') AS examples FROM sp GROUP BY 1, 2 HAVING count(*) > 1""",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM top WHERE place <= 5",
    "ranking_quality": f"""WITH {_BM25}, {_GOLD}, h AS (SELECT query_id, min(place) AS place FROM top JOIN gold USING (query_id, doc_id) WHERE place <= 5 GROUP BY 1),
        j AS (SELECT g.query_id, place FROM (SELECT DISTINCT query_id FROM gold) g LEFT JOIN h USING (query_id))
        SELECT count(*) AS queries, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN place <= 5 THEN 1.0 / place ELSE 0.0 END), 6) AS mrr,
        (SELECT count(*) FROM eval_cases WHERE out_of_scope) AS no_answer_queries, (SELECT round(avg(CASE WHEN score >= 20 THEN 1.0 ELSE 0.0 END), 6) FROM eval_cases e
            LEFT JOIN top ON e.case_id = query_id AND place = 1 WHERE out_of_scope) AS false_positive_rate FROM j""",
    "delta_extremes": f"""WITH {_CONDITIONS}, d AS (SELECT a.case_id, b.f1 - a.f1 AS delta FROM judged a JOIN judged b USING (case_id) WHERE a.label = 'without' AND b.label = 'with' AND a.available),
        r AS (SELECT *, row_number() OVER (ORDER BY round(delta, 9) DESC, case_id) AS up, row_number() OVER (ORDER BY round(delta, 9), case_id) AS down FROM d)
        SELECT 'best' AS side, up AS place, case_id, round(delta, 6) AS delta FROM r WHERE up <= 5 UNION ALL SELECT 'worst', down, case_id, round(delta, 6) FROM r WHERE down <= 5""",
    "wide_conditions": f"""WITH {_CONDITIONS} SELECT a.case_id, a.available, round(a.f1, 6) AS without_f1, a.abstains AS without_abstains, round(b.f1, 6) AS with_f1, b.abstains AS with_abstains
        FROM judged a JOIN judged b USING (case_id) WHERE a.label = 'without' AND b.label = 'with'""",
    "vector_topk": """WITH p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS score
        FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM p) SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE place <= 5""",
    "answer_metrics": rf"""WITH {METRICS} SELECT f1.id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
        round(CASE WHEN len(em) > 0 THEN len(list_intersect(em, fm)) / len(em) END, 6) AS marker_recall,
        round(CASE WHEN len(acw) > 0 AND len(cw) > 0 THEN len(list_filter(acw, lambda t: list_contains(cw, t))) / len(acw) END, 6) AS grounded,
        round({_repeated('aw')}, 6) AS repeated, {_ABSTAINS.format('more.a')} AS abstains,
        regexp_matches(coalesce(completion, ''), '(?i)\[\s*c1\s*\]|\bc1\b') AS cites FROM f1 JOIN more USING (id)""",
    "anchor_hits": f"""SELECT case_id, round(CASE WHEN len(anchors) > 0 THEN len(list_filter(list_transform(anchors, lambda x: {key('x')}), lambda y: contains({key('reference_answer')}, y))) / len(anchors) END, 6) AS anchor_recall FROM eval_cases""",
    "asked_identities": rf"""SELECT id, CASE lower(regexp_extract(prompt, '{_ASK}', 1)) WHEN '' THEN NULL WHEN 'uu' THEN 'undang-undang' WHEN 'pp' THEN 'peraturan pemerintah'
        ELSE lower(regexp_extract(prompt, '{_ASK}', 1)) END AS kind, nullif(regexp_extract(prompt, '{_ASK}', 2), '') AS number, CAST(nullif(regexp_extract(prompt, '{_ASK}', 3), '') AS INT) AS year,
        CASE WHEN regexp_extract(prompt, '{_PART}', 1) <> '' THEN concat_ws(' ', 'pasal ' || regexp_extract(prompt, '{_PART}', 1), 'ayat(' || nullif(regexp_extract(prompt, '{_PART}', 2), '') || ')',
        'huruf ' || nullif(regexp_extract(prompt, '{_PART}', 3), ''), 'angka ' || nullif(regexp_extract(prompt, '{_PART}', 4), '')) END AS article FROM qa_sft""",
    "chat_messages": """SELECT id, 0 AS place, 'user' AS role, coalesce(prompt, '') AS content FROM qa_sft UNION ALL SELECT id, 1, 'assistant', coalesce(completion, '') FROM qa_sft""",
    "condition_summary": f"""WITH {_CONDITIONS} SELECT label, count(*) AS cases, 0 AS errors, round(avg(f1), 6) AS mean_f1, round(median(f1), 6) AS median_f1, round(avg(marker_recall), 6) AS mean_marker_recall,
        round(avg(repeated), 6) AS mean_repeated, round(count(*) FILTER (abstains) / count(*), 6) AS abstention_rate, count(*) FILTER (repeated >= 0.2) AS repetitive FROM judged GROUP BY label""",
    "paired_delta": f"""WITH {_CONDITIONS}, d AS (SELECT b.f1 - a.f1 AS d FROM judged a JOIN judged b USING (case_id) WHERE a.label = 'without' AND b.label = 'with' AND a.available)
        SELECT count(*) AS pairs, count(*) FILTER (d > 1e-9) AS wins, count(*) FILTER (d < -1e-9) AS losses, count(*) FILTER (abs(d) <= 1e-9) AS ties,
        round(count(*) FILTER (d > 1e-9) / count(*), 6) AS win_rate, round(avg(d), 6) AS mean_delta, round(median(d), 6) AS median_delta FROM d""",
    "selection_tags": f"""WITH RECURSIVE {SELECTED}
        SELECT row_number() OVER (ORDER BY list_position({list(QUOTAS)}, bucket), normalized_term, term_id) AS pilot_index, term_id, bucket, related_terms,
        concat_ws('|', CASE WHEN term_id IN (SELECT term_id FROM anchors) THEN 'anchor' END, CASE WHEN sense_count > 1 THEN 'multi_sense' END,
            CASE WHEN term_id IN (SELECT term_id FROM focus) THEN 'domain_focus' END, CASE WHEN has_alias THEN 'alias' END, CASE WHEN has_digits THEN 'numeric' END,
            CASE WHEN longest_definition >= (SELECT x FROM p90) THEN 'long_definition' END, CASE WHEN related_terms <> '' THEN 'near_neighbor' END) AS tags FROM pilot""",
    "cap_monitor": f"""WITH RECURSIVE {SELECTED}, per_source AS (SELECT source, count(*) AS n FROM chosen GROUP BY source)
        SELECT CAST(sum(n) AS BIGINT) AS selected, max(n) AS most_of_a_source, count(*) AS sources FROM per_source""",
    "scan_counters": f"""WITH q AS (SELECT completion, {key('regulation_key')} AS k, {_ARTICLE.format(key('prompt'))} AS a FROM qa_sft WHERE split = 'test'),
        g AS (SELECT *, regexp_matches(k, '^[^|]+\\|[^|]+\\|\\d{{4}}$') AND NOT starts_with(k, 'answer:') AS keyed FROM q)
        SELECT count(*) AS "rows", count(*) FILTER (keyed) AS with_key, count(*) FILTER (a IS NOT NULL) AS with_article,
        count(*) FILTER (keyed AND a IS NOT NULL AND length(trim(completion)) >= 20) AS kept FROM g""",
    "retrieval_coverage": f"""WITH {HITS}, r AS (SELECT case_id, count(*) AS hits, max(candidates) AS candidates FROM hits WHERE place <= 4 GROUP BY case_id)
        SELECT c.case_id, CASE WHEN r.hits > 0 THEN 'found' ELSE 'not_found' END AS status, coalesce(r.hits, 0) AS hits, coalesce(candidates, 0) AS candidates,
        coalesce(round(r.hits / candidates, 6), 0.0) AS coverage FROM cases c LEFT JOIN r USING (case_id)""",
    "context_pack": f"WITH RECURSIVE {HITS}, {_PACKED} SELECT c.case_id, coalesce(context, {NO_CONTEXT}) AS context, coalesce(truncated, false) AS truncated FROM cases c LEFT JOIN packed USING (case_id)",
    "context_render": f"""WITH {HITS}, b AS (SELECT h.case_id, string_agg('[S' || h.place || ']' || {_NL} || {_c('title')} || {_NL} || {_c('article')} || {_NL} || {_c('content')}, {_LINES} ORDER BY h.place) AS context
        FROM hits h JOIN lastc l USING (case_id, id) WHERE h.place <= 4 GROUP BY 1) SELECT c.case_id, coalesce(context, {NO_CONTEXT}) AS context FROM cases c LEFT JOIN b USING (case_id)""",
    "case_prompts": f"""WITH RECURSIVE {ASKED_HITS}, {_PACKED} SELECT case_id, 'Jawab hanya berdasarkan konteks; bila tidak memuat jawabannya, katakan demikian.' || {_LINES} || 'Konteks:' || {_NL}
        || coalesce(context, {NO_CONTEXT}) || {_LINES} || 'Pertanyaan:' || {_NL} || coalesce(prompt, '') AS instruction FROM cases LEFT JOIN packed USING (case_id)""",
    "case_scores": rf"""WITH {ASKED_HITS}, con AS (SELECT case_id, string_agg(coalesce(content, ''), {_NL} ORDER BY place) AS context FROM hits WHERE place <= 4 GROUP BY 1),
        {_f1(f"SELECT e.case_id AS id, reference_answer, out_of_scope, anchors, context IS NOT NULL AS hit, {key('reference_answer')} AS a, {key('prompt')} AS r, {key('context')} AS c FROM eval_cases e LEFT JOIN con USING (case_id)", 'r', 'a')},
        g AS (SELECT id, out_of_scope, hit, {_ABSTAINS.format('a')} AS abstains, regexp_matches(coalesce(reference_answer, ''), '(?i)\[\s*c1\s*\]|c1') AS cites, {content('a')} AS acw, list_distinct({words('c')}) AS cw,
            CASE WHEN len(anchors) > 0 THEN round(len(list_filter(list_transform(anchors, lambda x: {key('x')}), lambda y: contains(a, y))) / len(anchors), 6) ELSE 0.0 END AS anchored FROM src),
        gr AS (SELECT *, CASE WHEN len(acw) > 0 AND len(cw) > 0 THEN len(list_filter(acw, lambda t: list_contains(cw, t))) / len(acw) ELSE 0.0 END AS grounded FROM g)
        SELECT id AS case_id, hit, CASE WHEN out_of_scope THEN CASE WHEN abstains THEN 100.0 ELSE 0.0 END ELSE round(100 * (0.65 * anchored + 0.35 * f1), 2) END AS screening,
        CASE WHEN out_of_scope THEN CASE WHEN NOT hit AND abstains THEN 100.0 ELSE 0.0 END
            ELSE round(100 * (0.45 * grounded + 0.30 * CAST(hit AS INT) + 0.25 * CAST(cites AS INT)), 2) END AS grounding FROM gr JOIN f1 USING (id)""",
    "hybrid_topk": f"""WITH {_BM25}, {_GOLD}, both_ AS (SELECT query_id, doc_id, place FROM top UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) FROM gold),
        fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + place)) AS score FROM both_ GROUP BY 1, 2),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM fused)
        SELECT query_id, doc_id, place, round(score, 6) AS score FROM placed WHERE place <= 5""",
    "fuzzy_pairs": f"""WITH {TERMS}, w AS (SELECT term_id, normalized_term AS x FROM t WHERE NOT warned)
        SELECT a.term_id AS left_id, b.term_id AS right_id, levenshtein(a.x, b.x) AS edits FROM w a JOIN w b ON a.term_id < b.term_id AND abs(length(a.x) - length(b.x)) <= 3 AND levenshtein(a.x, b.x) <= 3""",
    "clean_answers": r"""WITH m AS (SELECT id, coalesce(completion, '') AS raw, replace(replace(replace(coalesce(completion, ''), '<|im_start|>', ''), '<|im_end|>', ''), '<|endoftext|>', '') AS t FROM qa_sft),
        h AS (SELECT id, raw, CASE WHEN contains(t, '</think>') THEN regexp_replace(t, '^.*?</think>', '', 's') ELSE regexp_replace(t, '<think>.*$', '', 's') END AS t FROM m)
        SELECT id, regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: lower(trim(x)) NOT IN ('assistant', 'user')), chr(10)), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS answer,
        (length(raw) - length(replace(raw, '<|im_start|>', ''))) // 12 + (length(raw) - length(replace(raw, '<|im_end|>', ''))) // 10 + (length(raw) - length(replace(raw, '<|endoftext|>', ''))) // 13
            + len(list_filter(string_split(raw, chr(10)), lambda x: lower(trim(x)) IN ('assistant', 'user'))) AS marks FROM h""",
    "pair_select": f"""WITH RECURSIVE {NEAR}, {_RANKED_PAIRS}, {_walk('p', 'true', 'CAST([] AS VARCHAR[])', 10)} SELECT * FROM p_related""",
    "uniqueness": """SELECT content_hash, count(*) AS "rows" FROM corpus GROUP BY content_hash HAVING count(*) > 1 OR content_hash IS NULL OR content_hash = ''""",
    "split_counts": f"""SELECT split, count(*) AS "rows", count(*) FILTER ({bare('regulation_key')} IS NULL) AS without_key, count(DISTINCT {bare('answer_hash')}) AS answers FROM qa_sft GROUP BY split""",
}
