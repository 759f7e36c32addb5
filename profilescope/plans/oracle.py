"""The same results in DuckDB's SQL, written from the definitions rather than from the Spark plans.

Texts are matched by brute force over token lists, where the Spark side uses folded texts.
"""

from __future__ import annotations

from profilescope.functions.text import ENGLISH_STOP_WORDS
from profilescope.plans.binding import experience_bucket

AS_OF = "TIMESTAMP '1995-06-01 00:00:00'"
VISIBLE = f"accepted AND batch_starts_at <= {AS_OF} AND batch_ends_at >= {AS_OF}"
STOPS = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)

PROFILES = f"""
bought AS (
  SELECT o_custkey, p_name, p_type, p_brand, n_name, s_nationkey, l_returnflag, l_linenumber,
         o_orderdate, o_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
roles AS (
  SELECT o_custkey, list(role ORDER BY role) AS role_names, list(experience ORDER BY role) AS role_years
  FROM (SELECT o_custkey, p_type AS role, {experience_bucket('count(*)')} AS experience
        FROM bought GROUP BY o_custkey, p_type) GROUP BY o_custkey),
things AS (
  SELECT o_custkey, list_sort(list(DISTINCT p_name)) AS skills, list_sort(list(DISTINCT p_brand)) AS brands,
         list_sort(list(DISTINCT n_name)) AS places,
         list_sort(list(DISTINCT s_nationkey) FILTER (l_linenumber = 1 AND l_returnflag = 'A')) AS met,
         list_sort(list(DISTINCT s_nationkey) FILTER (l_linenumber = 1 AND l_returnflag = 'R')) AS barred
  FROM bought GROUP BY o_custkey),
last_line AS (
  SELECT o_custkey, p_type AS latest_position FROM (
    SELECT o_custkey, p_type, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber, p_type DESC) AS rn FROM bought)
  WHERE rn = 1),
batches AS (
  SELECT o_custkey, min(o_orderdate) AS starts, max(o_orderdate) AS ends,
         min(o_orderdate) FILTER (o_orderstatus = 'F') AS added, count(*) AS n
  FROM orders GROUP BY o_custkey),
wages AS (
  SELECT o_custkey, list(o_orderpriority ORDER BY o_orderpriority) AS cities,
         list(low ORDER BY o_orderpriority) AS minimums
  FROM (SELECT o_custkey, o_orderpriority,
               min(CAST(floor(o_totalprice) AS BIGINT)) FILTER (o_orderstatus <> 'P') AS low
        FROM orders GROUP BY o_custkey, o_orderpriority) GROUP BY o_custkey),
tongues AS (
  SELECT doc_id % 25 AS place, list_sort(list(DISTINCT lang)) AS languages FROM documents GROUP BY 1),
profiles AS (
  SELECT c_custkey AS id, c_acctbal >= 0 AS accepted,
         coalesce(role_names, []) AS role_names, coalesce(role_years, []) AS role_years,
         {experience_bucket('coalesce(batches.n, 0)')} AS professional_experience,
         coalesce(places, []) AS work_locations, n_name AS current_location,
         CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unsure' END AS work_authorization,
         coalesce(skills, []) AS skills, coalesce(text, '') AS summary,
         c_mktsegment || ' buyer from ' || n_name AS headline,
         coalesce(met, []) AS contacted_company_ids, coalesce(barred, []) AS blocked_companies,
         starts AS batch_starts_at, ends AS batch_ends_at, added AS added_to_batch_at,
         c_nationkey - 12 AS weight, coalesce(brands, []) AS work_experiences,
         'https://images.example/' || c_custkey || '.png' AS avatar_url,
         coalesce(cities, []) AS cities, coalesce(minimums, []) AS minimums,
         coalesce(latest_position, '') AS latest_position,
         list_filter(coalesce(tongues.languages, []), lambda tongue, i: (c_custkey + i) % 3 <> 0) AS languages, [c_mktsegment] AS educations
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN tongues ON tongues.place = c_nationkey
  LEFT JOIN documents ON doc_id = c_custkey % (SELECT count(*) FROM documents)
  LEFT JOIN batches ON batches.o_custkey = c_custkey LEFT JOIN wages ON wages.o_custkey = c_custkey
  LEFT JOIN roles ON roles.o_custkey = c_custkey LEFT JOIN things ON things.o_custkey = c_custkey
  LEFT JOIN last_line ON last_line.o_custkey = c_custkey)"""

DAY = "strftime(batch_starts_at, '%Y-%m-%d')"
HIT = f"id, headline, latest_position, {DAY} AS batch_starts_at"
ORDER = "batch_starts_at DESC NULLS LAST, weight DESC, added_to_batch_at DESC NULLS LAST, id"


def hits(condition: str = "TRUE", visible: str = VISIBLE) -> str:
    return f"WITH {PROFILES} SELECT {HIT} FROM profiles WHERE ({visible}) AND ({condition})"


# Token lists by definition.
BLANKS = r"[ \t\n\x0B\f\r]+"
STANDARD = r"[\p{L}\p{M}\p{N}_]+(?:[.''][\p{L}\p{M}\p{N}_]+)*"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{BLANKS}'), lambda w: w <> '')"


def parts(token: str) -> str:
    bare = rf"regexp_replace({token}, '([\p{{L}}\p{{M}}])''s([^\p{{L}}\p{{M}}\p{{N}}]|\z)', '\1\2', 'g')"
    return rf"regexp_extract_all({bare}, '[\p{{L}}\p{{M}}]+|\p{{N}}+')"


def delimited(token: str) -> str:
    forms = f"[{token}] || {parts(token)} || [array_to_string({parts(token)}, '')]"
    return f"list_filter(list_distinct({forms}), lambda form: form <> '')"


def substring_tokens(text: str) -> str:
    return f"flatten(list_transform({words(f'lower({text})')}, lambda w: {delimited('w')}))"


def substring_positions(text: str) -> str:
    return f"list_sum(list_transform({words(f'lower({text})')}, lambda w: greatest(1, len({parts('w')}))))"


def strip_js(token: str) -> str:
    return rf"regexp_replace({token}, '^(.*?)\.?js$', '\1')"


def standard(text: str) -> str:
    return f"regexp_extract_all({text}, '{STANDARD}')"


def word_tokens(text: str) -> str:
    kept = f"list_filter({standard(f'lower({text})')}, lambda w: w NOT IN ({STOPS}))"
    return f"list_transform({kept}, lambda w: {strip_js('w')})"


TEXTS = """
fields AS (
  SELECT id, 'skills' AS field, 2.0 AS boost, array_to_string(skills, chr(10)) AS content, skills AS items FROM profiles
  UNION ALL SELECT id, 'summary', 2.0, summary, [summary] FROM profiles
  UNION ALL SELECT id, 'headline', 2.0, headline, [headline] FROM profiles
  UNION ALL SELECT id, 'desired_work_roles', 1.0, array_to_string(role_names, chr(10)), role_names FROM profiles
  UNION ALL SELECT id, 'work_experiences', 1.0, array_to_string(work_experiences, chr(10)), work_experiences FROM profiles
  UNION ALL SELECT id, 'educations', 1.0, array_to_string(educations, chr(10)), educations FROM profiles)"""

OCCURRENCES = (
    "len(list_filter(range(1, length(token) - length(q) + 2), lambda i: substring(token, i, length(q)) = q))"
)


def postings() -> str:
    """Occurrences of every query token in every field: ``mode, q, id, field, freq, norm``."""
    return f"""
wanted AS (SELECT DISTINCT mode, q FROM clauses),
sub_tokens AS (SELECT id, field, unnest({substring_tokens('content')}) AS token FROM fields),
sub_counts AS (SELECT id, field, token, count(*) AS n FROM sub_tokens GROUP BY ALL),
sub_vocabulary AS (SELECT DISTINCT token FROM sub_counts),
sub_found AS (
  SELECT q, token, {OCCURRENCES} AS times FROM sub_vocabulary JOIN wanted
  ON mode = 'substring' AND length(q) BETWEEN 2 AND 20 AND contains(token, q)),
word_rows AS (SELECT id, field, unnest({word_tokens('content')}) AS token FROM fields),
sizes AS (
  SELECT id, field, boost, coalesce({substring_positions('content')}, 0) AS sub_size,
         len({word_tokens('content')}) AS word_size FROM fields),
postings AS (
  SELECT 'substring' AS mode, q, id, field, sum(n * times) AS freq FROM sub_counts JOIN sub_found USING (token)
  GROUP BY q, id, field
  UNION ALL SELECT mode, q, id, field, count(*) FROM word_rows JOIN wanted ON mode = 'word' AND q = token
  GROUP BY ALL
  UNION ALL SELECT mode, q, id, field, count(*)
  FROM (SELECT id, field, unnest(items) AS token FROM fields) JOIN wanted ON mode = 'exact' AND q = token
  GROUP BY ALL),
weighted AS (
  SELECT p.mode, p.q, p.id, p.field, freq,
         CASE p.mode WHEN 'substring' THEN boost / sqrt(greatest(sub_size, 1))
                     WHEN 'word' THEN 2.0 / sqrt(greatest(word_size, 1)) ELSE 1.0 END AS norm,
         1 + ln((SELECT count(*) FROM profiles) / (count(*) OVER (PARTITION BY p.mode, p.q, p.field) + 1)) AS idf
  FROM postings p JOIN sizes USING (id, field)),
by_field AS (
  SELECT request_id, clause, occur, id, field, count(*) / any_value(k) * sum(sqrt(freq) * idf * idf) * any_value(norm) AS s
  FROM weighted JOIN clauses USING (mode, q) GROUP BY request_id, clause, occur, id, field),
by_clause AS (
  SELECT request_id, clause, occur, id, max(s) AS s FROM by_field GROUP BY request_id, clause, occur, id),
totals AS (
  SELECT request_id, count(DISTINCT clause) FILTER (occur <> 'must_not') AS positive,
         count(DISTINCT clause) FILTER (occur = 'must') AS musts FROM clauses GROUP BY request_id),
judged AS (
  SELECT request_id, id, count(*) FILTER (occur = 'must') AS must_hits, any_value(musts) AS musts,
         count(*) FILTER (occur = 'must_not') AS barred,
         round(count(*) FILTER (occur <> 'must_not') / any_value(positive) * sum(s) FILTER (occur <> 'must_not'), 9) AS score
  FROM by_clause JOIN totals USING (request_id) GROUP BY request_id, id),
keyword_hits AS (
  SELECT request_id, id, score FROM judged WHERE must_hits = musts AND barred = 0 AND score IS NOT NULL)"""


def clause_rows(mode: str, clauses: list[tuple[str, list[str]]]) -> str:
    """One request's clauses as a table ``request_id, mode, clause, occur, k, q``."""
    rows = [
        f"(0, '{mode}', {i}, '{occur}', {len(tokens)}, '{q}')"
        for i, (occur, tokens) in enumerate(clauses)
        for q in tokens
    ]
    return f"clauses(request_id, mode, clause, occur, k, q) AS (VALUES {', '.join(rows)})"


def keyword_search(mode: str, clauses: list[tuple[str, list[str]]], condition: str = "TRUE") -> str:
    return f"""WITH {PROFILES}, {TEXTS}, {clause_rows(mode, clauses)}, {postings()}
SELECT id, headline, round(score, 6) AS score FROM keyword_hits JOIN profiles USING (id)
WHERE ({VISIBLE}) AND ({condition})"""


def optional_keyword_search(mode: str, clauses: list[tuple[str, list[str]]]) -> str:
    return f"""WITH {PROFILES}, {TEXTS}, {clause_rows(mode, clauses)}, {postings()}
SELECT id, headline, round(coalesce(judged.score, 0), 6) AS score FROM profiles LEFT JOIN judged USING (id)
WHERE {VISIBLE}"""


REQUESTS = """
requests AS (
  SELECT s_suppkey AS request_id, s_suppkey AS k, s_nationkey AS n, p_name AS name, string_split(p_name, ' ')[1] AS adjective,
         string_split(p_name, ' ')[2] AS noun, make_timestamp(1995 + s_suppkey % 5, 6, 1, 0, 0, 0) AS as_of,
         CASE WHEN s_suppkey % 8 = 5 THEN make_timestamp(1995, 1, 1 + s_suppkey % 28, 0, 0, 0) END AS epoch,
         CASE WHEN s_suppkey % 8 IN (4, 5) THEN [2 * s_suppkey + 1, 3 * s_suppkey] ELSE [] END AS presented,
         s_suppkey % 3 AS skip, CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 10 END AS size,
         s_suppkey % 7 IN (2, 4) AND s_suppkey % 3 = 0 AS optional
  FROM supplier JOIN (SELECT p_partkey % (SELECT count(*) FROM supplier) AS slot, max(p_name) AS p_name FROM part GROUP BY ALL)
    ON s_suppkey % (SELECT count(*) FROM supplier) = slot)"""

PAIRS = """
pairs AS (
  SELECT request_id, id, headline, batch_starts_at, weight, added_to_batch_at, k, optional, skip, size
  FROM requests JOIN profiles ON (
    (accepted AND CASE WHEN epoch IS NOT NULL THEN batch_starts_at = epoch
     ELSE batch_starts_at <= as_of AND batch_ends_at >= as_of END) OR list_contains(presented, id))
  WHERE CASE k % 8
    WHEN 0 THEN list_has_any(work_locations, ['NATION_' || n, 'NATION_' || (n + 7) % 25])
                AND minimums[list_position(cities, '2-HIGH')] <= 20000 + 100 * k
    WHEN 1 THEN list_has_all(languages, ['en', 'fr']) AND NOT list_contains(contacted_company_ids, n)
                AND NOT list_contains(blocked_companies, n)
    WHEN 2 THEN list_contains(role_names, 'SMALL') OR (list_position(role_names, 'PROMO') > 0
                AND role_years[list_position(role_names, 'PROMO')] IN ('4..6', '6..8', '8+'))
    WHEN 3 THEN current_location = 'NATION_' || n
    WHEN 4 THEN id NOT IN (k, k + 1)
    WHEN 5 THEN work_authorization IN ('yes', 'no')
    WHEN 6 THEN list_contains(list_transform(range(1, 10), lambda i: i * k), id)
    ELSE professional_experience IN ('8+', '4..6') AND id NOT IN (k, k + 2) END)"""

REQUEST_CLAUSES = """
clauses AS (
  SELECT request_id, 'word' AS mode, 0 AS clause, 'should' AS occur, 1 AS k, adjective AS q FROM requests WHERE k % 7 = 2
  UNION ALL SELECT request_id, 'word', 1, 'should', 1, noun FROM requests WHERE k % 7 = 2
  UNION ALL SELECT request_id, 'exact', 0, 'should', 1, name FROM requests WHERE k % 7 = 3
  UNION ALL SELECT request_id, 'substring', 0, 'should', 1, substring(noun, 2, 3) FROM requests WHERE k % 7 = 4
  UNION ALL SELECT request_id, 'word', 0, 'must', 1, adjective FROM requests WHERE k % 7 = 5
  UNION ALL SELECT request_id, 'word', 1, 'must_not', 1, noun FROM requests WHERE k % 7 = 5
  UNION ALL SELECT request_id, 'word', 0, 'must_not', 1, 'automobile' FROM requests WHERE k % 7 = 6)"""


def request_keywords() -> str:
    return f"WITH {PROFILES}, {TEXTS}, {REQUESTS}, {REQUEST_CLAUSES}, {postings()}"


def saved_searches() -> str:
    """All pairs with their scores, as ``found``."""
    return f"""{request_keywords()}, {PAIRS},
found AS (
  SELECT pairs.*, CAST(NULL AS DOUBLE) AS score FROM pairs WHERE k % 7 IN (0, 1)
  UNION ALL SELECT pairs.*, coalesce(judged.score, 0) FROM pairs LEFT JOIN judged USING (request_id, id) WHERE optional
  UNION ALL SELECT pairs.*, keyword_hits.score FROM pairs JOIN keyword_hits USING (request_id, id)
  WHERE k % 7 IN (2, 3, 4, 5) AND NOT optional
  UNION ALL SELECT pairs.*, 0 FROM pairs WHERE k % 7 = 6
  AND (request_id, id) NOT IN (SELECT (request_id, id) FROM judged WHERE barred > 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST,
    CASE WHEN score IS NULL THEN batch_starts_at END DESC NULLS LAST, CASE WHEN score IS NULL THEN weight END DESC,
    CASE WHEN score IS NULL THEN added_to_batch_at END DESC NULLS LAST, id) AS place FROM found)"""
