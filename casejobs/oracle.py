"""The registered queries in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from . import constants as C
from .queries import CASES_SQL, FILES_SQL, PLACES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FILES = "fx_files AS (" + FILES_SQL.format(documents="documents") + ")"
CASES = "fx_cases AS (" + CASES_SQL.format(documents="documents", labels="labels") + ")"
PAGES = """fx_pages AS (SELECT doc_id, file_name, CAST(i AS INT) AS page_no, string_split(text, chr(10))[i] AS text
  FROM (SELECT doc_id, file_name, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM fx_files))"""
KIND = "CASE lower(string_split(file_name, '.')[-1]) WHEN 'pdf' THEN 'pdf' WHEN 'mp4' THEN 'video' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'png' THEN 'image' END"
ENGINE_ID = "'UAP-' || upper(substr(translate(file_name, ' _', '--'), 1, 20))"
BATCH_ID = "'UAP-' || upper(substr(translate(file_name, '._', '--'), 1, 30))"
CANDIDATES = f"cand AS (SELECT {ENGINE_ID} AS case_id, file_name, {KIND} AS kind FROM fx_files WHERE {KIND} IS NOT NULL)"
EXISTING = f"ex AS (SELECT DISTINCT {ENGINE_ID} AS case_id FROM fx_files WHERE doc_id % 5 = 0)"
STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
RAW = f"{CASES}, raw AS (SELECT * EXCLUDE (id, case_id), case_id AS id FROM fx_cases)"
CATALOG = f"""{CASES}, catalog AS (SELECT case_id AS id, title,
  coalesce(nullif(date, ''), '{C.BATCH_DATE}') AS date, coalesce(nullif(location, ''), {_q(C.BATCH_LOCATION)}) AS location,
  coalesce(nullif(status, ''), 'Unresolved') AS status, coalesce(nullif(translation_snippet, ''), {_q(C.DEFAULT_SNIPPET)}) AS translation_snippet,
  coalesce(nullif(original_text, ''), {_q(C.DEFAULT_TEXT)}) AS original_text,
  coalesce(nullif(latitude, 0), {C.DEFAULT_LAT}::DOUBLE) AS latitude, coalesce(nullif(longitude, 0), {C.DEFAULT_LON}::DOUBLE) AS longitude,
  coalesce(nullif(source_url, ''), '{C.PORTAL}') AS source_url FROM fx_cases)"""
KINDS = f"{CASES}, k AS (SELECT *, CASE id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'scanned' WHEN 2 THEN 'video' ELSE 'image' END AS kind, case_id || '.pdf' AS file_name FROM fx_cases)"


def _digest(expr: str) -> str:
    return f"length({expr})::BIGINT AS n, md5({expr}) AS md5"


def _assemble(separator: str, where: str, trim: bool) -> str:
    joined = f"string_agg(text, {separator} ORDER BY page_no)"
    return f"WITH {FILES}, {PAGES}, t AS (SELECT doc_id, {STRIP.format(joined) if trim else joined} AS text FROM fx_pages {where} GROUP BY doc_id) SELECT doc_id, {_digest('text')} FROM t"


def _year(text: str) -> str:
    return rf"regexp_extract({text}, '(^|[^\p{{L}}\p{{N}}_])(19\d{{2}}|20\d{{2}})($|[^\p{{L}}\p{{N}}_])', 2)"


def _half_even(x: str) -> str:
    """Hundredths of a positive decimal, ties to the even digit, as a double: exact decimals on both engines."""
    return f"(floor({x})::BIGINT + CASE WHEN {x} - floor({x}) > 0.5 OR ({x} - floor({x}) = 0.5 AND floor({x})::BIGINT % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100::DOUBLE"


def _stats(rows: str) -> str:
    total, resolved, unresolved, percent, rest = C.EMPTY_STATS
    return f"""c AS (SELECT count(*) AS t, count(*) FILTER (WHERE status = 'Unresolved') AS u FROM {rows}), p AS (SELECT t, u, round_even(u / t * 100, 1) AS pct FROM c)
SELECT CASE WHEN t = 0 THEN {total} ELSE t END::BIGINT AS total_cases, CASE WHEN t = 0 THEN {resolved} ELSE t - u END::BIGINT AS resolved_cases,
  CASE WHEN t = 0 THEN {unresolved} ELSE u END::BIGINT AS unresolved_cases, CASE WHEN t = 0 THEN {percent}::DOUBLE ELSE pct END AS unresolved_percentage,
  CASE WHEN t = 0 THEN {rest}::DOUBLE ELSE round_even(100 - pct, 1) END AS resolved_percentage FROM p"""


def _search_url() -> str:
    name = "trim(" + "regexp_replace(coalesce(title, ''), '" + "|".join(C.SEARCH_PREFIXES) + "', '', 'gi'))"
    coded = "url_encode(term)"
    for a, b in (("%21", "!"), ("%2A", "*"), ("%27", "''"), ("%28", "("), ("%29", ")")):
        coded = f"replace({coded}, '{a}', '{b}')"
    return rf"""WITH {RAW}, n AS (SELECT id, {name} AS name, CASE WHEN coalesce(date, '') IN ('', 'N/A', 'Unknown') THEN '' ELSE regexp_extract(date, '[0-9]{{4}}') END AS year FROM raw),
m AS (SELECT *, regexp_replace(name, '\.(pdf|mp4|jpg|png|avi|mov)$', '', 'i') AS clean FROM n),
s AS (SELECT *, string_split(clean, '_') AS parts FROM m),
t AS (SELECT id, CASE WHEN year <> '' THEN year WHEN regexp_matches(name, '(?i)^[0-9]+[A-Z]+[0-9]+(\.pdf)?$') THEN 'UAP'
  WHEN contains(clean, '_') THEN trim(replace(CASE WHEN len(parts) > 2 THEN parts[3] WHEN parts[2] <> '' THEN parts[2] ELSE parts[1] END, '-', ' ')) ELSE clean END AS term FROM s)
SELECT id, '{C.PORTAL}?search=' || {coded} AS url FROM t"""


def _answers() -> str:
    raw = """CASE id % 6 WHEN 0 THEN '{"translation_snippet": "s", "latitude": 1.5, "longitude": -2.25}' WHEN 1 THEN '{"translation_snippet": "s", "longitude": -2.25}'
    WHEN 2 THEN '{"latitude": null, "longitude": 3}' WHEN 3 THEN '{"translation_snippet": "x", "latitude": "40.7", "longitude": 3}' WHEN 5 THEN NULL ELSE 'nope' END"""
    default = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in C.ANSWER_DEFAULTS.items()) + " END"

    def part(name: str, cast: str, missing: str, broken: str, none: str) -> str:
        value = f"json_extract_string(raw, '$.{name}')"
        value = f"try_cast({value} AS DOUBLE)" if cast else value
        return f"CASE WHEN raw IS NULL THEN {none} WHEN NOT json_valid(raw) THEN {broken} WHEN list_contains(json_keys(CASE WHEN json_valid(raw) THEN raw END), '{name}') THEN {value} ELSE {missing} END AS {name}"

    lat, lon = f"{C.DEFAULT_LAT}::DOUBLE", f"{C.DEFAULT_LON}::DOUBLE"
    none = f"{_q(C.NO_SERVICE)} || substr(original_text, 1, 100) || '...'"
    return f"""WITH {KINDS}, a AS (SELECT *, {raw} AS raw FROM k)
SELECT case_id, {part("translation_snippet", "", default, _q(C.ANSWER_ERROR), none)}, {part("latitude", "d", lat, lat, lat)}, {part("longitude", "d", lon, lon, lon)} FROM a"""


def _requests() -> str:
    body = f"CASE kind WHEN 'pdf' THEN original_text WHEN 'scanned' THEN {_q(C.REQUEST_SCANNED)} ELSE {_q(C.REQUEST_MEDIA)} END"
    engine = f"{_q(C.REQUEST_FILE)} || file_name || chr(10) || chr(10) || 'Text spisu: ' || substr({body}, 1, {C.ENGINE_SENT_CHARS})"
    return f"""WITH {KINDS}, r AS (SELECT 'batch' AS profile, case_id, substr(original_text, 1, {C.BATCH_SENT_CHARS}) AS request FROM k
  UNION ALL SELECT 'engine', case_id, {engine} FROM k) SELECT profile, case_id, {_digest("request")} FROM r"""


def _repair(many: bool = False) -> str:
    patterns = [r[0] for r in C.REPAIR_RULES]
    prefix = "CASE id % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(patterns)) + " WHEN 6 THEN 'UTAH-1953 AUTO-FBI-' ELSE '' END"
    chain = lambda i, c: "CASE " + " ".join(f"WHEN contains(cid, '{r[0]}') THEN {_q(r[i])}" for r in C.REPAIR_RULES) + f" ELSE {c} END AS {c}"
    repaired = f"WITH {CASES}, r AS (SELECT *, {prefix} || case_id AS cid FROM fx_cases)"
    if many:
        return f"""{repaired}, u AS (SELECT doc_id::VARCHAR AS n, 'P-' || doc_id AS pattern FROM documents WHERE doc_id % 5 = 3),
f AS (SELECT r.id, u.n FROM r JOIN u ON contains(r.cid, u.pattern) QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY length(u.n) DESC, u.pattern) = 1)
SELECT cid AS case_id, coalesce('rule ' || f.n, title) AS title, {_digest("coalesce(f.n, translation_snippet)")} FROM r LEFT JOIN f ON r.id = f.id"""
    return f"{repaired} SELECT cid AS case_id, {chain(1, 'title')}, {chain(2, 'translation_snippet')} FROM r"


def _geotag() -> str:
    places = ", ".join(f"({_q(n)}, {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in PLACES)
    words = lambda text: rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return rf"""WITH w AS (SELECT doc_id::VARCHAR AS case_id, {words(f"substr(text, 1, {C.ENGINE_SENT_CHARS})")} AS words FROM documents),
l AS (SELECT lower(name) AS place, {words("name")} AS words, lat, lon FROM (VALUES {places}) AS v(name, lat, lon)),
p AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY words ORDER BY place, lat, lon) = 1),
k AS (SELECT DISTINCT len(words) AS k FROM p),
r AS (SELECT case_id, i AS pos, words[i : i + k - 1] AS words FROM w, unnest(range(1, len(words) + 1)) AS x(i), k WHERE i + k - 1 <= len(words)),
b AS (SELECT case_id, place, lat, lon FROM r JOIN p ON r.words = p.words QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY length(array_to_string(p.words, ' ')) DESC, pos) = 1)
SELECT w.case_id, b.place, coalesce(lat, {C.DEFAULT_LAT}::DOUBLE) AS latitude, coalesce(lon, {C.DEFAULT_LON}::DOUBLE) AS longitude FROM w LEFT JOIN b ON w.case_id = b.case_id"""


CRAWL = r"""crawl AS (SELECT page_id, url, replace(html, '</body>', '<a href="files/' || page_id || '.PDF?x=1">f</a><A class="m" HREF="http://h.example/' || (page_id % 50) || '.mp4#t">v</A><script>var s=''<a href="x.png">'';</script><!-- <a href="y.mov"> --></body>') AS html,
  CASE page_id % 10 WHEN 7 THEN 403 WHEN 8 THEN 500 ELSE 200 END AS http_status, CASE WHEN page_id % 10 = 9 THEN 'timeout ' || page_id END AS error FROM pages)"""
LINKS = (
    CRAWL
    + r""", plain AS (SELECT *, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?i)<a\s(?:[^>]*\s)?href="([^"]*)"', 1) AS hrefs FROM crawl),
links AS (SELECT page_id, http_status, error, (i - 1)::INT AS pos, replace(hrefs[i], '&amp;', '&') AS href FROM plain, unnest(range(1, len(hrefs) + 1)) AS x(i))"""
)
MEDIA = (
    LINKS
    + f""", media AS (SELECT *, CASE WHEN starts_with(href, 'http') THEN href ELSE '{C.PORTAL}' || href END AS url FROM links
  WHERE """
    + " OR ".join(f"contains(lower(href), '{e}')" for e in C.MEDIA_EXTENSIONS)
    + r"""), named AS (SELECT *, string_split(string_split(url, '?')[1], '/')[-1] AS file_name FROM media)"""
)
NEW = MEDIA + """, fresh AS (SELECT page_id, url, file_name FROM named WHERE error IS NULL AND http_status = 200
  AND file_name NOT IN (SELECT page_id || '.PDF' FROM pages WHERE page_id % 4 = 0) QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY page_id, pos) = 1)"""
FRAMES = "f AS (SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no FROM events)"
TASKS = """t AS (SELECT CASE event_id % 5 WHEN 0 THEN 'http://h/a.mp4' WHEN 1 THEN 'http://h/A.MP4' WHEN 2 THEN 'http://h/VIDEO/1' WHEN 3 THEN 'http://h/x.pdf' ELSE 'http://h/b.mov?x' END AS source_url,
  user_id::VARCHAR AS case_id, ts AS enqueued_at FROM events),
r AS (SELECT *, CASE WHEN contains(lower(source_url), 'video') OR suffix(source_url, '.mp4') OR suffix(source_url, '.avi') OR suffix(source_url, '.mov') THEN 'video' ELSE 'pdf' END AS route FROM t)"""
KNN = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 5)"""


def _ingest(profile: str) -> str:
    batch = profile == "batch"
    first = f"""new AS (SELECT case_id, min_by(file_name, file_name) AS file_name FROM ({"SELECT " + BATCH_ID + " AS case_id, file_name FROM fx_files" if batch else "SELECT case_id, file_name FROM cand"})
  WHERE case_id NOT IN (SELECT case_id FROM ex) GROUP BY case_id),
txt AS (SELECT file_name, {STRIP.format("string_agg(text, chr(10) ORDER BY page_no)")} AS text FROM fx_pages {"" if batch else "WHERE page_no <= 5"} GROUP BY file_name),
j AS (SELECT new.case_id, new.file_name, {KIND.replace("file_name", "new.file_name")} AS kind, CASE WHEN lower(string_split(new.file_name, '.')[-1]) = 'pdf' THEN coalesce(text, '') END AS full_text FROM new LEFT JOIN txt ON new.file_name = txt.file_name)"""
    head = f"WITH {FILES}, {PAGES}, {CANDIDATES}, {EXISTING}, {first}"
    if batch:
        before, after = C.BATCH_TEXT.split("{}")
        s_before, s_after = C.BATCH_SNIPPET.split("{}")
        return f"""{head}, o AS (SELECT *, CASE WHEN full_text <> '' THEN substr(full_text, 1, {C.BATCH_TEXT_CHARS}) ELSE {_q(before)} || file_name || {_q(after)} END AS stored FROM j)
SELECT case_id, {_q(C.TITLE_BATCH)} || file_name AS title, '{C.BATCH_DATE}' AS date, {_q(C.BATCH_LOCATION)} AS location, {C.DEFAULT_LAT}::DOUBLE AS latitude, {C.DEFAULT_LON}::DOUBLE AS longitude,
  'Unresolved' AS status, {_q(s_before)} || file_name || {_q(s_after)} AS translation_snippet, {_digest("stored")}, '{C.PORTAL}' AS source_url FROM o"""
    return f"""{head}, o AS (SELECT *, CASE WHEN full_text <> '' THEN substr(full_text, 1, {C.ENGINE_TEXT_CHARS}) WHEN kind = 'pdf' THEN {_q(C.SCANNED_TEXT)} ELSE 'Zdrojový soubor: ' || file_name END AS stored FROM j)
SELECT case_id, CASE kind WHEN 'video' THEN {_q(C.TITLE_VIDEO)} WHEN 'image' THEN {_q(C.TITLE_IMAGE)} ELSE {_q(C.TITLE_PDF)} END || file_name AS title,
  CASE WHEN full_text <> '' AND {_year("full_text")} <> '' THEN {_year("full_text")} || '-01-01' ELSE '{C.ENGINE_DATE}' END AS date, {_q(C.ENGINE_LOCATION)} AS location,
  {C.DEFAULT_LAT}::DOUBLE AS latitude, {C.DEFAULT_LON}::DOUBLE AS longitude, 'Unresolved' AS status,
  {_q(C.NO_SERVICE)} || substr(CASE WHEN full_text <> '' THEN stored WHEN kind = 'pdf' THEN {_q(C.REQUEST_SCANNED)} ELSE {_q(C.REQUEST_MEDIA)} END, 1, 100) || '...' AS translation_snippet,
  {_digest("stored")}, '{C.PORTAL}' AS source_url FROM o"""


def oracle_sql() -> dict[str, str]:
    before, after = C.BATCH_TEXT.split("{}")
    s_before, s_after = C.BATCH_SNIPPET.split("{}")
    truthy = lambda c: f"{c} IS NOT NULL AND {c} <> 0 AND NOT isnan({c})"
    title = f"CASE {KIND} WHEN 'video' THEN {_q(C.TITLE_VIDEO)} WHEN 'image' THEN {_q(C.TITLE_IMAGE)} ELSE {_q(C.TITLE_PDF)} END || file_name"
    capped = "' \n' || text || '\t'".replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
    padded = STRIP.format(f"CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE {capped} END")
    texts = f"SELECT doc_id, CASE WHEN {padded} <> '' THEN substr({padded}, 1, {C.BATCH_TEXT_CHARS}) ELSE {_q(before)} || file_name || {_q(after)} END AS text FROM fx_files"
    seeds = ", ".join(f"('empty', {_q(c[0])}, {_q(c[1])})" for c in C.SEED_CASES)
    years = "text || CASE doc_id % 4 WHEN 0 THEN ' seen 1953.' WHEN 1 THEN ' é2004' WHEN 2 THEN ' 20045 x1999' ELSE '' END"
    sink = "SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE 'c' || (id % 700) END AS case_id FROM fx_cases"
    return {
        "case_ids": f"WITH {FILES} SELECT file_name, {BATCH_ID} AS batch_id, {ENGINE_ID} AS engine_id, lower(string_split(file_name, '.')[-1]) AS ext, {KIND} AS kind, {title} AS title, {_q(C.TITLE_BATCH)} || file_name AS batch_title FROM fx_files",
        "supported_files": f"WITH {FILES} SELECT file_name, {KIND} AS kind FROM fx_files WHERE {KIND} IS NOT NULL",
        "existing_skip": f"WITH {FILES}, {CANDIDATES}, {EXISTING} SELECT case_id, file_name FROM cand ANTI JOIN ex USING (case_id)",
        "existing_stored": f"WITH {FILES}, {CANDIDATES}, {EXISTING} SELECT case_id, file_name FROM cand SEMI JOIN ex USING (case_id)",
        "first_wins": f"WITH {FILES}, {CANDIDATES} SELECT case_id, file_name FROM cand QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY file_name) = 1",
        "append_new": f"WITH {FILES}, {CANDIDATES}, {EXISTING} SELECT case_id FROM ex UNION ALL SELECT DISTINCT case_id FROM cand ANTI JOIN ex USING (case_id)",
        "ingest_report": f"WITH {FILES}, {CANDIDATES}, {EXISTING}, n AS (SELECT count(DISTINCT case_id) AS stored FROM cand ANTI JOIN ex USING (case_id)) SELECT (SELECT count(*) FROM fx_files) AS total, stored, (SELECT count(*) FROM cand) - stored AS skipped FROM n",
        "ingest_observed": f"WITH {FILES}, {CANDIDATES}, {EXISTING}, n AS (SELECT count(DISTINCT case_id) AS stored FROM cand ANTI JOIN ex USING (case_id)) SELECT (SELECT count(*) FROM fx_files) AS total, stored, (SELECT count(*) FROM cand) - stored AS skipped FROM n",
        "cap_text": f"WITH {FILES}, t AS ({texts}) SELECT doc_id, {_digest('text')} FROM t",
        "year_date": f"WITH d AS (SELECT doc_id, {_year(years)} AS y FROM documents) SELECT doc_id, CASE WHEN y <> '' THEN y || '-01-01' ELSE '{C.ENGINE_DATE}' END AS date FROM d",
        "catalog": f"WITH {CATALOG} SELECT * FROM catalog",
        "display": f"WITH {RAW} SELECT coalesce(nullif(id, ''), 'N/A') AS id, title, coalesce(nullif(status, ''), 'Unknown') AS status, CASE WHEN status = 'Resolved' THEN 'resolved' ELSE 'open' END AS badge, coalesce(nullif(original_text, ''), {_q(C.NO_ORIGINAL)}) AS original_text, coalesce(nullif(translation_snippet, ''), {_q(C.NO_ANALYSIS)}) AS translation_snippet FROM raw",
        "map_points": f"WITH {RAW} SELECT id, latitude, longitude, '<b>' || coalesce(id, '') || '</b><br/>' || coalesce(title, '') || '<br/>📍 ' || coalesce(location, '') AS popup FROM raw WHERE {truthy('latitude')} AND {truthy('longitude')}",
        "search_url": _search_url(),
        "search_cases": f"WITH {RAW} SELECT id, title, location FROM raw WHERE contains(lower(id), 'src1') OR coalesce(contains(lower(title), 'src1'), false) OR coalesce(contains(lower(location), 'src1'), false)",
        "search_many": f"""WITH {RAW}, terms AS (SELECT 'p-' || doc_id AS term FROM documents WHERE doc_id % 7 = 0 UNION VALUES ('sRc1'), ('_d1'), ('zz'), (''), ('no such term'), ('7_'))
SELECT term, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM terms JOIN raw ON CASE WHEN term = '' THEN coalesce(id, '') <> '' OR coalesce(title, '') <> '' OR coalesce(location, '') <> ''
  ELSE contains(lower(id), lower(term)) OR coalesce(contains(lower(title), lower(term)), false) OR coalesce(contains(lower(location), lower(term)), false) END GROUP BY term""",
        "status_filter": f"WITH {CASES} SELECT case_id, status FROM fx_cases WHERE status = 'Resolved'",
        "first_case": f"WITH {CATALOG} SELECT id, title FROM catalog ORDER BY id LIMIT 1",
        "stats_server": f"WITH {CASES}, {_stats('fx_cases')}",
        "stats_view": f"WITH {CATALOG}, c AS (SELECT count(*) AS t, count(*) FILTER (WHERE status = 'Resolved') AS r FROM catalog), p AS (SELECT *, CASE WHEN t > 0 THEN round((t - r) / t * 100, 1) ELSE 0.0 END AS pct FROM c) SELECT t AS total_cases, r AS resolved_cases, t - r AS unresolved_cases, pct AS unresolved_percentage, round(100 - pct, 1) AS resolved_percentage FROM p",
        "stats_empty": f"WITH {CASES}, {_stats('(SELECT * FROM fx_cases WHERE false)')}",
        "export_catalog": f"WITH {CATALOG} SELECT id, title, date, location, status, latitude, longitude, source_url FROM catalog",
        "append_cases": f"WITH {CASES}, s AS ({sink}) SELECT min(id) AS id, case_id, 'stored' AS result FROM s WHERE case_id IS NOT NULL GROUP BY case_id UNION ALL SELECT id, case_id, 'rejected' FROM s WHERE case_id IS NULL",
        "append_compacted": f"WITH {CASES}, s AS (SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE case_id END AS case_id, title FROM fx_cases) SELECT id, case_id, title, 'stored' AS result FROM s WHERE case_id IS NOT NULL UNION ALL SELECT id, case_id, title, 'rejected' FROM s WHERE case_id IS NULL AND id % 5 < 4",
        "list_incoming": "SELECT coalesce(lang, 'none') AS lang, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes, true AS all_texts FROM documents GROUP BY ALL",
        "seed": f"WITH {CASES} SELECT * FROM (VALUES {seeds}) AS v(was, case_id, title) UNION ALL SELECT 'full', case_id, title FROM fx_cases",
        "llm_requests": _requests(),
        "llm_answers": _answers(),
        "llm_fallback": f"WITH {FILES} SELECT doc_id, {_q(C.NO_SERVICE)} || substr(text, 1, 100) || '...' AS engine, {_q(s_before)} || file_name || {_q(s_after)} AS batch FROM fx_files",
        "geotag": _geotag(),
        "repair_fixed": _repair(),
        "repair_table": _repair(),
        "repair_many": _repair(many=True),
        "vector_upsert": "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS seq, (CASE WHEN vec_id % 3 = 0 THEN embedding[-1] ELSE embedding[1] END)::DOUBLE AS first, 'text ' || vec_id AS text, label::VARCHAR AS label FROM embeddings",
        "vector_store": "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS seq, (CASE WHEN vec_id % 3 = 0 THEN embedding[-1] ELSE embedding[1] END)::DOUBLE AS first, 'text ' || vec_id AS text, label::VARCHAR AS label FROM embeddings",
        "vector_check": "SELECT vec_id AS id, 63 AS dim FROM embeddings WHERE vec_id % 10 = 0",
        "vector_topk": "WITH s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings) SELECT id, round(score, 6) AS score, 'text ' || id AS text FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 5)",
        "vector_knn": f"WITH {KNN} SELECT query_id, id, rank, round(score, 6) AS score FROM h",
        "vector_index_knn": f"WITH {KNN} SELECT query_id, id, rank, round(score, 6) AS score FROM h",
        "vector_hits": f"WITH {CASES}, {KNN} SELECT query_id, rank, h.id, case_id, title FROM h JOIN fx_cases c ON h.id = c.id",
        "links": f"WITH {LINKS} SELECT page_id, pos, href FROM links",
        "media_links": f"WITH {MEDIA} SELECT page_id, pos, href, url, file_name FROM named",
        "new_downloads": f"WITH {NEW} SELECT * FROM fresh",
        "fetch_status": f"WITH {CRAWL} SELECT page_id, CASE WHEN error IS NOT NULL THEN 'offline_mode' WHEN http_status = 403 THEN 'fallback_mode' WHEN http_status <> 200 THEN 'error' ELSE 'success' END AS status, CASE WHEN error IS NOT NULL THEN error WHEN http_status <> 200 THEN 'HTTP ' || http_status END AS message FROM crawl",
        "crawl_report": f"WITH {NEW}, c AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'error' ELSE 'success' END AS status, file_name FROM fresh) SELECT status, file_name, count(*) OVER (PARTITION BY status) AS n FROM c",
        "reset": f"WITH {CASES} SELECT id, case_id FROM fx_cases WHERE id % 3 = 0",
        "frames_sampled": f"WITH {FRAMES} SELECT video_id, event_id, frame_no, printf('frame_%04d.jpg', frame_no) AS frame_name FROM f WHERE frame_no % 30 = 0",
        "frame_report": f"WITH {FRAMES} SELECT video_id, count(*) AS total_frames, count(*) FILTER (WHERE frame_no % 30 = 0) AS saved_frames FROM f GROUP BY video_id",
        "telemetry": f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_discount * 360 AS azimuth_deg,
    CAST(CAST(l_extendedprice * 0.3048::DOUBLE AS VARCHAR) AS DECIMAL(30, 14)) * 100 AS a, CAST(CAST(l_quantity::DOUBLE - l_quantity::DOUBLE * 0.05::DOUBLE AS VARCHAR) AS DECIMAL(30, 14)) * 100 AS s FROM lineitem)
  SELECT l_orderkey, l_linenumber, {_half_even("a")} AS altitude_m, azimuth_deg, {_half_even("s")} AS true_speed_knots, true AS parallax_anomaly, {_q(C.HUD_NOTE)} AS note FROM t""",
        "route_tasks": f"WITH {TASKS} SELECT source_url, route, count(*) AS n FROM r GROUP BY ALL",
        "stream_ingest": f"WITH {TASKS} SELECT case_id, source_url, route, enqueued_at FROM r QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY enqueued_at, source_url) = 1",
        "stream_dedupe": f"WITH {TASKS} SELECT case_id, source_url, enqueued_at FROM r QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY enqueued_at, source_url) = 1",
        "ingest_stats": f"WITH {FILES}, {CANDIDATES}, {EXISTING}, {CASES}, u AS (SELECT status FROM fx_cases UNION ALL SELECT 'Unresolved' FROM (SELECT DISTINCT case_id FROM cand ANTI JOIN ex USING (case_id))), {_stats('u')}",
        "assemble_all": _assemble("chr(10)", "", True),
        "assemble_first5": _assemble("chr(10)", "WHERE page_no <= 5", True),
        "assemble_plain": _assemble("''", "", False),
        "ingest_batch": _ingest("batch"),
        "ingest_engine": _ingest("engine"),
    }
