"""The queries in SQL."""

from __future__ import annotations

from . import fixtures as X
from .catalog import QUERY, SUBSTRING, VOWELS


def _title(html: str) -> str:
    out = f"regexp_extract(coalesce({html}, ''), '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


def _greedy(table: str, col: str, q: str, name: str) -> str:
    """A chain of CTEs: the leftmost places of the query's characters in order, from 1, 0 for none."""
    steps = [f"{name}0 AS (SELECT *, lower({col}) AS {name}_t, 0 AS {name}_p0 FROM {table})"]
    for i, c in enumerate(q, 1):
        before = f"{name}_p{i - 1}"
        rest = f"strpos(substr({name}_t, {before} + 1), '{c}')"
        ok = "true" if i == 1 else f"{before} > 0"
        steps.append(f"{name}{i} AS (SELECT *, CASE WHEN {ok} AND {rest} > 0 THEN {before} + {rest} ELSE 0 END AS {name}_p{i} FROM {name}{i - 1})")
    return ", ".join(steps)


def _score(name: str, k: int) -> str:
    first, last = f"({name}_p1 - 1)", f"({name}_p{k} - 1)"
    return f"CASE WHEN {name}_p{k} > 0 THEN {100 * k} - ({last} - {first} + 1 - {k}) - {first} END"


ENTRIES = f"""entries AS (
  SELECT page_id AS entry_id, {_title("html")} AS title, url, CAST(coalesce(n, 0) AS BIGINT) AS access_count
  FROM pages LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = page_id)"""


def _fuzzy(q: str) -> str:
    """entries with _f, the better score."""
    k = len(q)
    return f"WITH {ENTRIES}, {_greedy('entries', 'title', q, 'a')}, {_greedy(f'a{k}', 'url', q, 'b')}, fuzzy AS (SELECT *, CAST(greatest({_score('a', k)}, {_score('b', k)}) AS BIGINT) AS _f FROM b{k})"


def _reading(q: str) -> str:
    """The reading score of a query that is matched by substring only (its units begin with two letters)."""
    return f"CASE WHEN strpos(lower(title), '{q}') > 0 THEN {100 * len(q)} + greatest(length(title) - strpos(lower(title), '{q}') + 1, 0) END"


def _ranked(source: str, score: str, order: str, limit: str = "") -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS rank, entry_id, CAST({score} AS BIGINT) AS score, access_count FROM {source} {limit}"


def _combined(q: str) -> str:
    """Fused scores; a query that decodes to a unit of two letters or more matches plain titles by substring only."""
    return f"""{_fuzzy(q)},
both_ AS (SELECT entry_id, access_count, _f, {_reading(q)} AS _r FROM fuzzy),
hit AS (SELECT * FROM both_ WHERE _f IS NOT NULL OR _r IS NOT NULL),
top AS (SELECT greatest(coalesce(max(greatest(_f, 0)), 1), 1) AS f, greatest(coalesce(max(greatest(_r, 0)), 1), 1) AS r, greatest(coalesce(max(access_count), 1), 1) AS a FROM hit),
fused AS (SELECT entry_id, access_count, CAST(round((coalesce(CAST(greatest(_f, 0) AS DOUBLE) / f, 0) + coalesce(CAST(greatest(_r, 0) AS DOUBLE) / r, 0) + CAST(access_count AS DOUBLE) / a) * 1e6) AS BIGINT) AS s FROM hit, top)"""


def _values(rows, names: str, table: str = "v") -> str:
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") {table}({names})"


_SHOWN = """CASE WHEN title <> '' THEN title WHEN strpos(url, '://') = 0 THEN url
  WHEN strpos(substr(url, strpos(url, '://') + 3), '/') > 0 THEN split_part(substr(url, strpos(url, '://') + 3), '/', 1)
  ELSE split_part(substr(url, strpos(url, '://') + 3), '?', 1) END"""


def _spans(col: str, name: str, extra: str = "false") -> str:
    """The number of runs of lit and unlit characters of a text, lit by its fuzzy places or by ``extra``."""
    lit = lambda i: "(" + " OR ".join([f"{i} = {name}_p{j}" for j in range(1, _K + 1)] + [extra.replace("?", i)]) + ")"
    return f"CAST(CASE WHEN length({col}) = 0 THEN 0 ELSE 1 + len(list_filter(range(2, length({col}) + 1), lambda i: {lit('i')} <> {lit('(i - 1)')})) END AS BIGINT)"


_K = len(QUERY)
_PLACE = f"strpos(lower(title), '{QUERY}')"
_AT = f"strpos(lower(title), '{SUBSTRING}')"
_N = len(SUBSTRING)
_ORDER_S, _ORDER_C = "_f DESC, access_count DESC, entry_id", "access_count DESC, _f DESC, entry_id"

SQL = {
    "extract_title": f"WITH {ENTRIES} SELECT entry_id, title FROM entries",
    "title_fallback": f"""WITH {ENTRIES}, u AS (SELECT 'page' AS "case", url, title FROM entries UNION ALL SELECT 'bare', url, '' FROM entries
      UNION ALL SELECT 'given', url, title FROM {_values([a[:2] for a in X.ADDRESSES], "url, title")}) SELECT "case", url, {_SHOWN} AS shown FROM u""",
    "empty_query_by_count": f"WITH {ENTRIES} " + _ranked("entries", "0", "access_count DESC, entry_id"),
    "substring_match_scored": f"WITH {ENTRIES} SELECT entry_id, CAST({_AT} - 1 AS BIGINT) AS start, CAST({_reading(SUBSTRING)} AS BIGINT) AS score FROM entries WHERE {_AT} > 0",
    "substring_highlight": f"WITH {ENTRIES} SELECT entry_id, array_to_string(range({_AT} - 1, least({_AT} - 1 + {_N}, length(title))), ',') AS lit FROM entries WHERE {_AT} > 0",
    "document_substring": f"""WITH h AS (SELECT doc_id, CAST({100 * _N} + greatest(length(text) - strpos(lower(text), '{SUBSTRING}') + 1, 0) AS BIGINT) AS score FROM documents WHERE strpos(lower(text), '{SUBSTRING}') > 0)
      SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank, doc_id, score FROM h ORDER BY rank LIMIT 100""",
    "ascii_index_morae": f"WITH {ENTRIES} SELECT entry_id, array_to_string(list_transform(string_split(title, ''), lambda c: lower(c)), ',') AS morae, CAST(length(title) AS BIGINT) AS n_segments FROM entries",
    "window_match_vowels": f"""WITH {ENTRIES}, q AS (SELECT * FROM {_values([(v,) for v in VOWELS], "query")})
      SELECT query, entry_id, CAST(strpos(lower(title), query) - 1 AS BIGINT) AS start, CAST(200 + greatest(length(title) - strpos(lower(title), query) + 1, 0) AS BIGINT) AS score
      FROM entries, q WHERE strpos(lower(title), query) > 0""",
    "fuzzy_membership": f"WITH {ENTRIES} SELECT entry_id FROM entries WHERE title ILIKE '%{'%'.join(QUERY)}%' OR url ILIKE '%{'%'.join(QUERY)}%'",
    "fuzzy_score_by_score": _fuzzy(QUERY) + _ranked("(SELECT * FROM fuzzy WHERE _f IS NOT NULL)", "_f", _ORDER_S),
    "fuzzy_score_by_count": _fuzzy(QUERY) + _ranked("(SELECT * FROM fuzzy WHERE _f IS NOT NULL)", "_f", _ORDER_C),
    "reading_mode_by_count": f"WITH {ENTRIES} " + _ranked(f"(SELECT * FROM entries WHERE {_AT} > 0)", "0", "access_count DESC, entry_id"),
    "combined_rank": _combined(SUBSTRING) + _ranked("fused", "s", "s DESC, access_count DESC, entry_id"),
    "combined_top_k": _combined(QUERY) + _ranked("fused", "s", "s DESC, access_count DESC, entry_id", "ORDER BY rank LIMIT 50"),
    "part_rank": f"WITH p AS (SELECT p_partkey AS entry_id, p_name AS title, p_type AS url, CAST(p_size AS BIGINT) AS access_count FROM part), {_greedy('p', 'title', 'an', 'a')}, {_greedy('a2', 'url', 'an', 'b')}, "
    f"fuzzy AS (SELECT *, CAST(greatest({_score('a', 2)}, {_score('b', 2)}) AS BIGINT) AS _f FROM b2) " + _ranked("(SELECT * FROM fuzzy WHERE _f IS NOT NULL)", "_f", _ORDER_S, "ORDER BY rank LIMIT 200"),
    "kana_to_morae": f"SELECT * FROM {_values(X.KANA.items(), 'kana, morae')}",
    "query_decode": f"SELECT * FROM {_values(X.QUERIES.items(), 'query, morae')}",
    "dictionary_first_wins": f"SELECT * FROM {_values(X.DICTIONARY.items(), 'word, morae')}",
    "longest_match": f"SELECT * FROM {_values([(r, w) for r, w in X.RUNS.items() if w], 'run, words')}",
    "reading_match_fixture": f"SELECT text, query, path, CAST(start AS BIGINT) AS start, CAST(score AS BIGINT) AS score FROM {_values([m[:5] for m in X.MATCHES], 'text, query, path, start, score')}",
    "highlight_fixture": f"SELECT * FROM {_values([(m[0], m[1], m[5]) for m in X.MATCHES], 'text, query, lit')}",
    "complete_rank": "SELECT leaf, kind, CAST(rank AS BIGINT) AS rank, candidate FROM "
    + _values(
        [("", "dir", 1, "d/Documents/"), ("", "dir", 2, "d/alpha/"), ("", "dir", 3, "d/app/"), ("", "dir", 4, "d/zeta/"), ("", "dir", 5, "d/アプリ/")]
        + [("ap", "dir", 1, "d/alpha/"), ("ap", "dir", 2, "d/app/"), ("ap", "dir", 3, "d/アプリ/"), ("ap", "dir", 4, "d/zeta/"), ("te", "any", 1, "d/test.txt"), ("te", "any", 2, "d/テスト.txt"), ("test", "any", 1, "d/test.txt"), ("test", "any", 2, "d/テスト.txt")]
        + [("", "file", 1, "d/apple.txt"), ("", "file", 2, "d/readme.txt"), ("", "file", 3, "d/test.txt"), ("", "file", 4, "d/テスト.txt")],
        "leaf, kind, rank, candidate",
    ),
    "complete_names": """WITH m AS (SELECT c_name, 200 + length(c_name) - strpos(c_name, '00') + 1 AS score FROM customer WHERE c_acctbal > 0 AND strpos(c_name, '00') > 0)
      SELECT CAST(row_number() OVER (ORDER BY score DESC, c_name) AS BIGINT) AS rank, 'c/' || c_name || '/' AS candidate FROM m ORDER BY rank LIMIT 50""",
    "split_token": f"SELECT * FROM {_values(X.TOKENS, 'token, prefix, leaf')}",
    "format_candidate": f"SELECT prefix, name, prefix || name || CASE WHEN is_dir THEN '/' ELSE '' END AS candidate FROM {_values([c[:3] for c in X.CANDIDATES], 'prefix, name, is_dir')}",
    "add_if_absent": f"""WITH {ENTRIES}, e AS (SELECT * FROM entries WHERE access_count > 0),
      f AS (SELECT p.url, min(coalesce(html, '')) AS html FROM pages p WHERE p.url IS NOT NULL AND p.url NOT IN (SELECT url FROM e WHERE url IS NOT NULL) GROUP BY p.url),
      g AS (SELECT url, {_title("html")} AS title FROM f)
      SELECT entry_id, title, url, access_count FROM e
      UNION ALL SELECT CAST((SELECT max(entry_id) FROM e) + row_number() OVER (ORDER BY url) AS BIGINT), {_SHOWN}, url, 0 FROM g""",
    "increment_counts": f"""WITH {ENTRIES} SELECT entry_id, CAST(access_count + coalesce(n, 0) AS BIGINT) AS access_count
      FROM entries LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) ON user_id = entry_id""",
    "delete_reindex": f"WITH {ENTRIES} SELECT CAST(row_number() OVER (ORDER BY entry_id) - 1 AS BIGINT) AS ordinal, entry_id FROM entries WHERE access_count <> 0",
    "highlight_spans": f"""WITH {ENTRIES}, c AS (SELECT entry_id, title, unnest(range(0, length(title))) AS i FROM entries),
      f AS (SELECT entry_id, i, {_AT} > 0 AND i >= {_AT} - 1 AND i < {_AT} - 1 + {_N} AS lit FROM c),
      g AS (SELECT *, i - row_number() OVER (PARTITION BY entry_id, lit ORDER BY i) AS grp FROM f)
      SELECT entry_id, CAST(min(i) AS BIGINT) AS start, CAST(max(i) + 1 AS BIGINT) AS "end", lit FROM g GROUP BY entry_id, lit, grp""",
    "display": f"""{_combined(QUERY)}, ranked AS (SELECT CAST(row_number() OVER (ORDER BY s DESC, access_count DESC, entry_id) AS BIGINT) AS rank, entry_id FROM fused ORDER BY rank LIMIT 50),
      lit AS (SELECT *, CASE WHEN a_p{_K} > 0 THEN 1 ELSE 0 END AS a_hit, CASE WHEN b_p{_K} > 0 THEN 1 ELSE 0 END AS b_hit FROM fuzzy)
      SELECT rank, entry_id, CASE WHEN access_count < 1000 THEN lpad(CAST(access_count AS VARCHAR), 4, ' ') ELSE CAST(access_count AS VARCHAR) END || ' ' AS prefix,
        {_spans("title", "a_hit * a", f"({_PLACE} > 0 AND ? >= {_PLACE} AND ? < {_PLACE} + {_K})")} AS n_title_spans, {_spans("url", "b_hit * b")} AS n_secondary_spans
      FROM ranked JOIN lit USING (entry_id)""",
    "complete_all_names": """WITH m AS (SELECT c_name, 100 + length(c_name) - strpos(c_name, '1') + 1 AS score FROM customer WHERE strpos(c_name, '1') > 0)
      SELECT CAST(row_number() OVER (ORDER BY score DESC, c_name) AS BIGINT) AS rank, c_name AS candidate FROM m""",
    "table_search": f"""WITH {ENTRIES}, q AS (SELECT DISTINCT query, query IN ('io', 'ai', 'on') AS by_unit FROM {_values([(q,) for q in X.ASKED], "query")} WHERE query <> '')
      SELECT query, entry_id, CASE WHEN by_unit THEN 'mora' ELSE 'plain' END AS path, CAST(strpos(lower(title), lower(query)) - 1 AS BIGINT) AS start,
        CAST(100 * length(query) + greatest(length(title) - strpos(lower(title), lower(query)) + 1, 0) AS BIGINT) AS score
      FROM entries, q WHERE strpos(lower(title), lower(query)) > 0""",
    "query_matrix": f"SELECT text, query, path, CAST(start AS BIGINT) AS start, CAST(score AS BIGINT) AS score FROM {_values([m[:5] for m in X.MATCHES], 'text, query, path, start, score')}",
    "index_add_remove": f"WITH {ENTRIES} SELECT entry_id, array_to_string(list_transform(string_split(title, ''), lambda c: lower(c)), ',') AS morae FROM entries WHERE entry_id % 3 <> 0",
    "dictionary_scan": f"SELECT * FROM {_values(X.DICTIONARY.items(), 'word, morae')}",
    "dictionary_compiled": f"SELECT * FROM {_values(X.DICTIONARY.items(), 'word, morae')}",
    "dictionary_cached": f"SELECT * FROM {_values(X.DICTIONARY.items(), 'word, morae')}",
    "dictionary_missing": "SELECT '' AS word, '' AS morae WHERE false",
    "store_file": f"SELECT CAST(entry_id AS BIGINT) AS entry_id, type, title, url, command, args, CAST(access_count AS BIGINT) AS access_count FROM {_values(X.STORE_ROWS, 'entry_id, type, title, url, command, args, access_count')}",
    "store_roundtrip": f"WITH {ENTRIES} SELECT entry_id, 'bookmark' AS type, title, url, access_count FROM entries",
    "folder_listing": f"SELECT * FROM {_values(X.LISTING, 'name, is_dir')}",
    "labels": f"SELECT * FROM {_values(X.LABELS, 'name, label')}",
    "shown_parts": f"SELECT CAST(n AS BIGINT) AS n, args, prefix, suffix FROM {_values([(n, ','.join(a), p, x) for n, a, p, x in X.SHOWN], 'n, args, prefix, suffix')}",
    "address_like": f"SELECT query, CAST(n AS BIGINT) AS n, is_address FROM {_values(X.ADDRESS_LIKE, 'query, n, is_address')}",
    "title_cases": f"SELECT * FROM {_values(X.TITLES, 'html, title')}",
    "hourly_opens": "SELECT date_trunc('hour', ts) AS window_start, user_id AS entry_id, count(*) AS opens FROM events GROUP BY 1, 2",
}
