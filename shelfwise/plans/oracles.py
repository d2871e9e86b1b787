"""Expected results as SQL over the given tables.

Listing and product expectations come straight from `part`: the SQL never reads the derived HTML,
so extraction must give back what was put in.
"""

from __future__ import annotations

from shelfwise.operators.jobs import DEAD_LETTER_ERROR
from shelfwise.operators.summary import NO_PRODUCTS
from shelfwise.plans.derived import PAGE_LIMIT
from shelfwise.schemas import PRODUCT_COLUMNS
from shelfwise.site import DEFAULT_SITE as SITE

_PART = """
p AS (
  SELECT p_partkey AS k, p_name AS name, p_brand AS keyword, printf('%.2f', p_retailprice) AS money,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS seq,
         CASE WHEN p_partkey % 17 = 0 THEN ''
              WHEN p_partkey % 13 = 0 THEN CAST(p_partkey AS VARCHAR)
              ELSE CAST(p_partkey + 10000000 AS VARCHAR) END AS item
  FROM part),
q AS (
  SELECT *, CAST(1 + seq // 24 AS INTEGER) AS page_no,
         '/p/' || replace(name, ' ', '-') || '/-' ||
           CASE WHEN item = '' THEN '' ELSE '/A-' || item END AS path
  FROM p)"""

_LINKS = f"""{_PART},
both_links AS (
  SELECT *, 0 AS dup, path || CASE k % 5 WHEN 0 THEN '?ref=x' WHEN 1 THEN '#top' ELSE '' END AS href
  FROM q
  UNION ALL SELECT *, 1 AS dup, path || '?dup=1' AS href FROM q WHERE k % 11 = 0),
l AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY keyword, page_no ORDER BY k, dup) - 1 AS INTEGER) AS pos
  FROM both_links),
d AS (
  SELECT * FROM l
  QUALIFY row_number() OVER (PARTITION BY keyword, page_no, href ORDER BY pos) = 1),
last_pages AS (SELECT keyword, max(page_no) AS last_page FROM q GROUP BY keyword)"""

_TITLE_CASE = (
    "upper(split_part(name, ' ', 1)[1]) || split_part(name, ' ', 1)[2:] || ' ' || "
    "upper(split_part(name, ' ', 2)[1]) || split_part(name, ' ', 2)[2:]"
)
_CARD_TITLE = f"CASE WHEN k % 12 = 10 THEN {_TITLE_CASE} ELSE name END"
_CARD_PRICE = "CASE WHEN k % 12 IN (8, 10, 11) THEN '' ELSE '$' || money END"
_IMAGE = "CASE WHEN k % 4 = 3 THEN '' ELSE 'https://img.example/' || k || '.jpg' END"
_SITE_VALUES = {
    "marketplace": SITE.marketplace,
    "seller_name": SITE.seller_name,
    "seller_url": SITE.seller_url,
    "seller_business": SITE.seller_business,
    "seller_address": SITE.seller_address,
    "seller_email": SITE.seller_email,
    "seller_phone": SITE.seller_phone,
}


def _product_select(**values: str) -> str:
    known = {c: f"'{v}'" for c, v in _SITE_VALUES.items()} | values
    return ", ".join(f"{known.get(c, chr(39) * 2)} AS {c}" for c in PRODUCT_COLUMNS)


_PRODUCTS = f"""{_PART},
once AS (
  SELECT keyword, k AS pos, k, {_product_select(
      title="CASE WHEN k % 37 = 0 THEN repeat('x', 501) WHEN k % 23 = 0 THEN '' "
            "WHEN k % 19 = 0 THEN 'ab' ELSE name END",
      url=f"CASE WHEN k % 31 = 0 THEN 'https://shop.example' ELSE '{SITE.base_url}' END || path",
      image_url=_IMAGE,
      price=_CARD_PRICE,
      item_number="CASE WHEN k % 41 = 0 THEN '  ' ELSE item END",
  )} FROM q),
pr AS (
  SELECT * FROM once UNION ALL
  SELECT * REPLACE (pos + 1000000000000 AS pos) FROM once WHERE k % 11 = 0),
checked AS (
  SELECT *, list_filter([
    CASE WHEN trim(title) = '' THEN 'Missing required field: Listing Title*' END,
    CASE WHEN trim(url) = '' THEN 'Missing required field: Listings URL*' END,
    CASE WHEN trim(item_number) = '' THEN 'Missing required field: Item Number' END,
    CASE WHEN k % 31 = 0 THEN 'Invalid URL format: ' || url END,
    CASE WHEN item_number <> '' AND (length(item_number) < 8) THEN 'Invalid TCIN format: ' || item_number END,
    CASE WHEN length(title) BETWEEN 1 AND 2 THEN 'Title too short: ' || title END,
    CASE WHEN length(title) > 500 THEN 'Title too long: ' || title END], lambda x: x IS NOT NULL) AS errors
  FROM pr)"""

_FILLED = " + ".join(f"(CASE WHEN trim({c}) <> '' THEN 1 ELSE 0 END)" for c in PRODUCT_COLUMNS)

_DETAILS = f"""{_PART},
dp AS (SELECT *, '{SITE.base_url}' || path AS clean_url, k % 29 = 0 AS gone,
              CAST(k + 100000000000 AS VARCHAR) AS code FROM q WHERE k % 7 <> 0)"""

_JOBS = """
j AS (
  SELECT user_id AS job_id, ts, event_id,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
              WHEN 'click' THEN 'retrying' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
         CAST(CAST(floor(value) AS BIGINT) % 101 AS INTEGER) AS progress,
         'kw ' || (user_id % 40) AS keyword
  FROM events),
latest AS (
  SELECT *, min(ts) OVER (PARTITION BY job_id) AS created_at FROM j
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
failures AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS attempt
  FROM j WHERE status = 'failed'),
letters AS (SELECT * FROM failures WHERE attempt = 4)"""

_REQUESTS = """
r AS (
  SELECT event_id // 4 AS request_id, event_id % 4 + 1 AS attempt, event_id, ts, event_type AS endpoint,
         'search:kw ' || (user_id % 40) || ':pages:' || (1 + event_id % 20) AS key,
         1 + event_id % 20 AS max_pages,
         CASE event_id % 10 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 501 WHEN 3 THEN 404 ELSE 200 END AS status_code,
         event_id % 2 = 0 AS raised, epoch_us(ts) AS us
  FROM events),
classed AS (
  SELECT *, CASE WHEN raised AND status_code BETWEEN 400 AND 499 AND status_code <> 429 THEN 'fatal'
                 WHEN raised AND status_code >= 400 THEN 'retry'
                 WHEN NOT raised AND status_code IN (429, 500, 502, 503, 504) THEN 'retry'
                 ELSE 'success' END AS kind FROM r)"""

# Results of a run over all pages of every keyword; brands always have all their pages.
_RUN = f"""{_LINKS},
found AS (SELECT * FROM d),
kept AS (
  SELECT *, k % 7 <> 0 AND k % 29 <> 0 AS has_page FROM found WHERE length(item) >= 8
  QUALIFY row_number() OVER (PARTITION BY keyword, item ORDER BY page_no, pos) = 1),
final AS (
  SELECT *, CASE WHEN k % 12 IN (8, 10, 11) AND NOT has_page THEN '' ELSE '$' || money END AS price,
         CASE WHEN has_page THEN CAST(k + 100000000000 AS VARCHAR) ELSE '' END AS upc
  FROM kept),
raw AS (
  SELECT keyword, count(*) AS total_found, count(*) FILTER (WHERE length(item) >= 8) AS raw_valid
  FROM found GROUP BY keyword),
ends AS (
  SELECT keyword, last_page FROM last_pages
  UNION ALL SELECT 'none ' || p_name, max(CASE WHEN p_partkey % 200 = 0 THEN 1 ELSE 0 END)
  FROM part WHERE p_partkey % 100 = 0 GROUP BY p_name),
done AS (
  SELECT keyword, count(*) AS valid_products,
         sum(9 + CASE WHEN k % 4 <> 3 THEN 1 ELSE 0 END + CASE WHEN price <> '' THEN 1 ELSE 0 END
             + CASE WHEN upc <> '' THEN 1 ELSE 0 END) AS filled
  FROM final GROUP BY keyword),
runs AS (
  SELECT keyword, coalesce(valid_products, 0) AS valid_products, CAST(last_page AS INTEGER) AS pages_scraped,
         coalesce(total_found, 0) AS total_found, coalesce(raw_valid, 0) AS raw_valid, filled,
         coalesce(valid_products, 0) > 0 AS success
  FROM ends LEFT JOIN raw USING (keyword) LEFT JOIN done USING (keyword))"""

# Cards of a run break rules by their item number only.
_RUN_ERRORS = """wrong AS (
  SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY page_no, pos) - 1 AS nth, list_filter([
    CASE WHEN item = '' THEN 'Missing required field: Item Number' END,
    CASE WHEN item <> '' AND length(item) < 8 THEN 'Invalid TCIN format: ' || item END], lambda x: x IS NOT NULL) AS errors
  FROM found)"""
_STEM = "replace(lower(keyword), '#', '') || '_PRODUCTS'"
# Two runs: the second one replaces the artefacts of some keywords.
_CATALOGUE = """again AS (SELECT * FROM pr WHERE keyword LIKE '%1' AND pos % 2 = 0),
c AS (SELECT keyword, replace(lower(keyword), '#', '') || '_PRODUCTS.' || format AS output_name, format, count(*) AS products, run_id
  FROM (SELECT keyword, 'run-2' AS run_id FROM again
    UNION ALL SELECT keyword, 'run-1' FROM pr WHERE keyword NOT IN (SELECT keyword FROM again)), (VALUES ('csv'), ('json')) AS f(format)
  GROUP BY ALL)"""
_ASKED = """asked AS (SELECT p_brand AS keyword FROM part
  UNION ALL SELECT 'none ' || p_name FROM part WHERE p_partkey % 100 = 0)"""

_ANCHOR = r"<a\b[^>]*>.*?</a>"
_HIDDEN = (
    r"<!--.*?-->|<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>|</?[a-zA-Z!?][^>]*>"
)
# Character references that occur in the given pages; '&amp;' is decoded last.
_REFERENCES = {
    "&copy;": "©", "&middot;": "·", "&quot;": '"', "&#39;": "''", "&apos;": "''",
    "&lt;": "<", "&gt;": ">", "&amp;": "&",
}


def _decoded(text: str) -> str:
    for reference, char in _REFERENCES.items():
        text = f"replace({text}, '{reference}', '{char}')"
    return text


_TIGHT = _decoded(r"trim(regexp_replace(x, '\s*\x01[\s\x01]*', '', 'g'))")
_SPACED = _decoded(r"trim(regexp_replace(x, '\s*\x01[\s\x01]*', ' ', 'g'))")

ORACLES: dict[str, str] = {
    "scan_pages": "SELECT page_id, url, length(html) AS n_chars FROM pages",
    "envelope_decode": "SELECT page_id, html FROM pages WHERE page_id % 5 <> 0",
    "candidate_links": f"WITH {_LINKS} SELECT keyword, page_no, pos, href FROM l",
    "page_links": f"""
WITH a AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS block
           FROM (SELECT page_id, regexp_extract_all(html, '(?is){_ANCHOR}') AS x FROM pages))
SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(block, 'href="([^"]*)"', 1) AS href FROM a
WHERE starts_with(regexp_extract(block, 'href="([^"]*)"', 1), '/')""",
    "anchor_explode": f"""
WITH a AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS block
           FROM (SELECT page_id, regexp_extract_all(html, '(?is){_ANCHOR}') AS x FROM pages))
SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(block, 'href="([^"]*)"', 1) AS href, block FROM a""",
    "nearest_container": """
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<li><a ') AS x FROM pages)
SELECT page_id, CAST(unnest(range(len(x))) AS INTEGER) AS pos, 'li' AS container FROM a""",
    "dedup_links": f"""
WITH a AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS block
           FROM (SELECT page_id, regexp_extract_all(html, '(?is){_ANCHOR}') AS x FROM pages)),
h AS (SELECT page_id, pos, regexp_extract(block, 'href="([^"]*)"', 1) AS href FROM a)
SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM h
QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1""",
    "resolve_href": f"""
WITH a AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS href
           FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a href="([^"]*)"', 1) AS x FROM pages))
SELECT page_id, CAST(pos AS INTEGER) AS pos,
       CASE WHEN pos % 3 = 2 THEN 'http://other.example' || href ELSE '{SITE.base_url}' || href END AS url FROM a""",
    "clean_url": "SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS clean_url FROM pages",
    "visible_text": f"""
WITH m AS (SELECT page_id, regexp_replace(html, '(?is){_HIDDEN}', chr(1), 'g') AS x FROM pages)
SELECT page_id, {_TIGHT} AS tight, {_SPACED} AS spaced
FROM m""",
    "page_number": """
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN page_id % 7 + 1 ELSE 0 END AS page_number FROM pages""",
    "highest_page_link": f"""
WITH n AS (SELECT page_id, page_id % 5 + 1 AS a, page_id % 9 AS b FROM pages)
SELECT page_id, CASE WHEN a >= b AND a >= 4 THEN '{SITE.base_url}/s?page=' || a
                     WHEN b > a AND b >= 4 THEN '{SITE.base_url}/s?p=' || b
                     ELSE 'https://shop.example/page/4' END AS highest_url FROM n""",
    "valid_requests": """
WITH a AS (SELECT p_partkey AS request_id, p_partkey % 7 = 0 OR p_partkey % 13 = 0 AND p_partkey % 11 <> 0 AS blank,
                  CASE WHEN p_partkey % 11 = 0 THEN repeat(p_name, 20) ELSE p_name END AS keyword,
                  CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 2 END AS pad,
                  CAST(p_partkey % 23 AS INTEGER) AS max_pages FROM part)
SELECT request_id, keyword, max_pages FROM a
WHERE NOT blank AND max_pages BETWEEN 1 AND 20 AND length(keyword) + pad <= 100""",
    "extract_products": f"""
WITH {_LINKS} SELECT keyword, page_no, pos, {_product_select(
        title=_CARD_TITLE, url=f"'{SITE.base_url}' || path", image_url=_IMAGE, price=_CARD_PRICE,
        item_number="item")} FROM d""",
    "title_fallback": f"""
WITH {_LINKS} SELECT keyword, page_no, pos, {_CARD_TITLE} AS title,
  CASE k % 12 WHEN 0 THEN 'data-test' WHEN 1 THEN 'aria-label' WHEN 9 THEN 'text' WHEN 10 THEN 'url'
       WHEN 11 THEN 'parent' ELSE 'heading' END AS title_method FROM d""",
    "price_fallback": f"""
WITH {_LINKS} SELECT keyword, page_no, pos, {_CARD_PRICE} AS price,
  CASE k % 12 WHEN 0 THEN 'data-test' WHEN 1 THEN 'attribute' WHEN 2 THEN 'class' WHEN 3 THEN 'own-text'
       WHEN 4 THEN 'parent' WHEN 5 THEN 'link-text' WHEN 6 THEN 'link-text' WHEN 7 THEN 'json-ld'
       WHEN 9 THEN 'link-text' ELSE '' END AS price_method FROM d""",
    "image_url": f"WITH {_LINKS} SELECT keyword, page_no, pos, {_IMAGE} AS image_url FROM d",
    "item_number": f"WITH {_LINKS} SELECT keyword, page_no, pos, item AS item_number FROM l",
    "title_from_url": f"WITH {_LINKS} SELECT keyword, page_no, pos, {_TITLE_CASE} AS title FROM l",
    "clean_title": """
SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' with' WHEN 2 THEN p_name
  WHEN 3 THEN p_name || ' ' WHEN 4 THEN p_name || ' $8.49' WHEN 5 THEN '' WHEN 6 THEN 'Product'
  ELSE p_name || ' ' END AS title FROM part""",
    "next_page_url": f"""
WITH {_LINKS},
dups AS (SELECT keyword, page_no, min_by(href, pos) AS href FROM l WHERE dup = 1 GROUP BY keyword, page_no)
SELECT keyword, page_no, CASE WHEN page_no < last_page
    THEN '{SITE.base_url}/s?q=' || replace(keyword, '#', '%23') || '&page=' || (page_no + 1)
    ELSE '{SITE.base_url}' || dups.href END AS next_url
FROM (SELECT DISTINCT keyword, page_no FROM q) JOIN last_pages USING (keyword) LEFT JOIN dups USING (keyword, page_no)""",
    "has_more": f"""
WITH {_LINKS},
dups AS (SELECT DISTINCT keyword, page_no, true AS dup FROM l WHERE dup = 1)
SELECT keyword, page_no, page_no < last_page OR coalesce(dup, false) AS has_more
FROM (SELECT DISTINCT keyword, page_no FROM q) JOIN last_pages USING (keyword) LEFT JOIN dups USING (keyword, page_no)""",
    "page_prefix": f"""
WITH {_LINKS}, ends AS (
  SELECT keyword, CAST(CASE WHEN keyword LIKE '%3' AND last_page >= 2 THEN 1 ELSE last_page END AS INTEGER) AS last_page
  FROM last_pages)
SELECT DISTINCT keyword, page_no, ends.last_page FROM q JOIN ends USING (keyword) WHERE page_no <= ends.last_page""",
    "capped_page_prefix": f"""
WITH {_LINKS}, ends AS (
  SELECT keyword, CAST(CASE WHEN keyword LIKE '%3' AND last_page >= 2 THEN 1 ELSE least(last_page, {PAGE_LIMIT}) END AS INTEGER) AS last_page
  FROM last_pages)
SELECT DISTINCT keyword, page_no, ends.last_page FROM q JOIN ends USING (keyword) WHERE page_no <= ends.last_page""",
    "running_total": f"""
WITH {_LINKS}, n AS (SELECT keyword, page_no, count(*) AS found FROM d GROUP BY keyword, page_no)
SELECT keyword, page_no, found, CAST(sum(found) OVER (PARTITION BY keyword ORDER BY page_no) AS BIGINT) AS running_total FROM n""",
    "ordered_products": f"""
WITH {_LINKS} SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY page_no, pos) - 1 AS nth, href FROM d""",
    "union_pages": f"WITH {_LINKS} SELECT keyword, page_no, pos, href FROM d",
    "output_name": r"""
WITH k AS (
  SELECT 'part' AS source, p_partkey AS id, p_name || ' & Ñandú - ' || p_type || '!' AS keyword FROM part
  UNION ALL SELECT 'page', page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) FROM pages),
s AS (SELECT source, id, lower(trim(regexp_replace(regexp_replace(keyword, '[^\p{L}\p{N}_\s-]', '', 'g'), '[-\s]+', '_', 'g'), '_')) AS stem FROM k)
SELECT source, id, stem || '_PRODUCTS.csv' AS csv_name, stem || '_PRODUCTS.json' AS json_name FROM s""",
    "scan_details": f"WITH {_DETAILS} SELECT clean_url, NOT gone AS usable FROM dp",
    "usable_details": f"WITH {_DETAILS} SELECT clean_url FROM dp WHERE NOT gone",
    "upc_fallback": f"""
WITH {_DETAILS} SELECT clean_url, code AS upc, CASE k % 7 WHEN 1 THEN 'section' WHEN 2 THEN 'definition'
  WHEN 3 THEN 'meta' WHEN 4 THEN 'json-ld' WHEN 5 THEN 'text' ELSE 'attribute' END AS upc_method FROM dp WHERE NOT gone""",
    "detail_price": f"""
WITH {_DETAILS} SELECT clean_url, '$' || money AS detail_price,
  CASE WHEN k % 2 = 0 THEN 'data-test' ELSE 'text' END AS detail_price_method FROM dp WHERE NOT gone""",
    "spec_pairs": f"""
WITH {_DETAILS} SELECT clean_url, 'UPC' AS term, code AS definition FROM dp WHERE NOT gone AND k % 7 = 2""",
    "csv_roundtrip": f"""
WITH {_PRODUCTS} SELECT {_STEM} || '.csv' AS output_name, {', '.join(PRODUCT_COLUMNS)} FROM pr""",
    "json_roundtrip": f"""
WITH {_PRODUCTS} SELECT {_STEM} || '.json' AS output_name, {', '.join(PRODUCT_COLUMNS)} FROM pr""",
    "partitioned_sink": f"""
WITH {_PRODUCTS} SELECT {_STEM} || '.json' AS output_name, count(*) AS products FROM pr
WHERE NOT (keyword LIKE '%1') OR pos % 2 = 0 GROUP BY 1""",
    "valid_products": f"WITH {_PRODUCTS} SELECT keyword, pos, title, url, item_number FROM checked WHERE len(errors) = 0",
    "invalid_products": f"""
WITH {_PRODUCTS}, n AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY pos) - 1 AS nth FROM checked)
SELECT keyword, nth AS index, title, url, item_number, array_to_string(errors, '|') AS errors FROM n WHERE len(errors) > 0""",
    "validation_errors": f"WITH {_PRODUCTS} SELECT keyword, pos, array_to_string(errors, '|') AS errors FROM checked",
    "completeness": f"WITH {_PRODUCTS} SELECT keyword, pos, CAST({_FILLED} AS DOUBLE) / 18 AS completeness FROM pr",
    "validation_summary": f"""
WITH {_PRODUCTS} SELECT keyword, count(*) AS total, count(*) FILTER (WHERE len(errors) = 0) AS valid,
  count(*) FILTER (WHERE len(errors) > 0) AS invalid,
  CAST(count(*) FILTER (WHERE len(errors) = 0) AS DOUBLE) / count(*) AS valid_rate FROM checked GROUP BY keyword""",
    "error_list": f"""
WITH {_PRODUCTS} SELECT keyword, pos, CAST(generate_subscripts(errors, 1) - 1 AS INTEGER) AS error_no, unnest(errors) AS error FROM checked""",
    "quality_score": f"""
WITH {_PRODUCTS}, m AS (SELECT keyword, count(*) AS n, count(*) FILTER (WHERE len(errors) = 0) AS ok,
  sum({_FILLED}) FILTER (WHERE len(errors) = 0) AS filled FROM checked GROUP BY keyword)
SELECT keyword, coalesce(round(0.7::DOUBLE * (ok::DOUBLE / n) + 0.3::DOUBLE * coalesce(filled::DOUBLE / (nullif(ok, 0) * 18), 0), 3), 0) AS quality_score FROM m""",
    "dedup_products": f"""
WITH {_PRODUCTS} SELECT keyword, pos, item_number, url FROM pr
QUALIFY row_number() OVER (PARTITION BY keyword, CASE WHEN item_number <> '' THEN item_number ELSE url END ORDER BY pos) = 1""",
    "enrich_products": f"""
WITH {_RUN} SELECT keyword, page_no, item AS item_number, {_CARD_TITLE} AS title, '{SITE.base_url}' || path AS url, price, upc FROM final""",
    "run_summary": f"""
WITH {_RUN} SELECT keyword, success, pages_scraped, total_found, valid_products,
  coalesce(round(0.7::DOUBLE + 0.3::DOUBLE * (filled::DOUBLE / (valid_products * 18)), 3), 0) AS quality_score,
  total_found - raw_valid AS invalid_products, coalesce(raw_valid::DOUBLE / nullif(total_found, 0), 0) AS valid_rate,
  CASE WHEN success THEN {_STEM} || '.csv' END AS filename, CASE WHEN success THEN {_STEM} || '.json' END AS json_filename,
  CASE WHEN NOT success THEN '{NO_PRODUCTS}' END AS error FROM runs""",
    "run_errors": f"""
WITH {_RUN}, {_RUN_ERRORS}
SELECT keyword, page_no, pos, CAST(generate_subscripts(errors, 1) - 1 AS INTEGER) AS error_no, unnest(errors) AS error FROM wrong""",
    "run_invalid_products": f"""
WITH {_RUN}, {_RUN_ERRORS}
SELECT keyword, nth AS index, {_CARD_TITLE} AS title, '{SITE.base_url}' || path AS url, item AS item_number,
  array_to_string(errors, '|') AS errors FROM wrong WHERE len(errors) > 0""",
    "batch_results": f"""
WITH {_RUN}, {_ASKED} SELECT keyword, coalesce(success, false) AS success, coalesce(valid_products, 0) AS valid_products,
  CASE WHEN coalesce(success, false) THEN NULL ELSE '{NO_PRODUCTS}' END AS error
FROM (SELECT DISTINCT keyword FROM asked) LEFT JOIN runs USING (keyword)""",
    "batch_success": f"""
WITH {_RUN}, {_ASKED} SELECT (SELECT count(*) FROM runs WHERE success) AS succeeded,
  (SELECT count(DISTINCT keyword) FROM asked) AS distinct_keywords, (SELECT count(*) FROM asked) AS submitted""",
    "jobs_latest": f"""
WITH {_JOBS} SELECT job_id, status, progress, keyword, CASE WHEN status = 'failed' THEN 'HTTP error' END AS error,
  created_at, ts AS updated_at FROM latest""",
    "completed_jobs": f"WITH {_JOBS} SELECT job_id, status, progress FROM latest WHERE status = 'completed'",
    "terminal_jobs": f"WITH {_JOBS} SELECT job_id, status, progress FROM latest WHERE status IN ('completed', 'failed', 'dead_letter')",
    "progress_changes": f"""
WITH {_JOBS}, w AS (SELECT *, lag(progress) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM j)
SELECT job_id, event_id, status, progress FROM w WHERE progress IS DISTINCT FROM previous""",
    "retry_delay": f"""
WITH {_JOBS} SELECT job_id, event_id, attempt, CAST(CASE attempt WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 900 END AS INTEGER) AS delay_seconds FROM failures""",
    "retry_routing": f"""
WITH {_JOBS} SELECT job_id, event_id, keyword, attempt, least(attempt, 4) AS attempt_count, ts AS last_attempt,
  CASE WHEN attempt <= 3 THEN ts + to_seconds(CASE attempt WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 900 END) END AS next_retry_at,
  CASE WHEN attempt > 3 THEN 'failed' ELSE 'retrying' END AS status, attempt > 3 AS dead_lettered,
  CASE WHEN attempt > 3 THEN '{DEAD_LETTER_ERROR}' ELSE 'HTTP error' END AS error FROM failures""",
    "dead_letter_total": f"WITH {_JOBS} SELECT count(*) AS total FROM letters",
    "dead_letter_read": f"""
WITH {_JOBS} SELECT CAST(job_id AS VARCHAR) AS job_id, keyword, '{DEAD_LETTER_ERROR}' AS error, CAST(4 AS INTEGER) AS attempt_count,
  ts AS last_attempt, ts AS created_at, CAST(NULL AS TIMESTAMP) AS next_retry_at FROM letters""",
    "dead_letter_write": f"""
WITH {_JOBS}, t AS (SELECT *, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM letters)
SELECT CAST(job_id AS VARCHAR) AS job_id, keyword, '{DEAD_LETTER_ERROR}' AS error, CAST(4 AS INTEGER) AS attempt_count,
  iso AS last_attempt, iso AS created_at, CAST(NULL AS VARCHAR) AS next_retry_at FROM t""",
    "dead_letter_remove": f"""
WITH {_JOBS} SELECT CAST(job_id AS VARCHAR) AS job_id, keyword FROM letters
WHERE job_id NOT IN (SELECT job_id FROM latest WHERE status = 'completed')""",
    "job_products": f"""
WITH {_PRODUCTS}, {_JOBS.strip()}
SELECT job_id, replace(lower(pr.keyword), '#', '') || '_PRODUCTS.json' AS output_name, title, url, item_number, price
FROM latest JOIN pr ON pr.keyword = 'Brand#' || (job_id % 30) WHERE status = 'completed'""",
    "job_catalogue": f"""
WITH {_PRODUCTS}, {_JOBS.strip()}, {_CATALOGUE}
SELECT job_id, c.output_name, products, run_id
FROM latest JOIN c ON c.keyword = 'Brand#' || (job_id % 30) AND c.format = 'json' WHERE status = 'completed'""",
    "artifact_listing": f"""
WITH {_PRODUCTS}, {_CATALOGUE}
SELECT output_name, format, products, run_id, true AS has_files, true AS has_bytes, products AS held FROM c""",
    "envelope_rejects": """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'no results' ELSE 'unreadable' END AS reason FROM pages
WHERE page_id % 5 IN (0, 1, 2) OR page_id % 35 = 3""",
    "dead_letter_rejects": """
SELECT CASE p_partkey % 3 WHEN 0 THEN 'unreadable' ELSE 'no entry' END AS reason, count(*) AS rows
FROM part WHERE p_partkey % 3 <> 2 GROUP BY 1""",
    "run_job_events": f"""
WITH {_RUN}, asked AS (
  SELECT min(p_partkey) AS job_id, p_brand AS keyword FROM part GROUP BY p_brand
  UNION ALL SELECT p_partkey, 'none ' || p_name FROM part WHERE p_partkey % 100 = 0),
steps AS (SELECT job_id, keyword, success, pages_scraped, unnest(range(0, pages_scraped + 2)) AS event_id FROM asked JOIN runs USING (keyword))
SELECT job_id, event_id, keyword,
  CASE WHEN event_id <= pages_scraped THEN 'running' WHEN success THEN 'completed' ELSE 'failed' END AS status,
  CAST(CASE WHEN event_id = 0 THEN 5 WHEN event_id > pages_scraped THEN CASE WHEN success THEN 100 ELSE 0 END
    ELSE floor(event_id::DOUBLE / greatest(pages_scraped, 1) * 90) + 10 END AS INTEGER) AS progress,
  CASE WHEN event_id > pages_scraped AND NOT success THEN '{NO_PRODUCTS}' END AS error FROM steps""",
    "products_per_job": f"""
WITH {_PRODUCTS}, {_JOBS.strip()}, n AS (SELECT keyword, count(*) AS c FROM pr GROUP BY keyword)
SELECT job_id, 'Brand#' || (job_id % 30) AS keyword, coalesce(c, 0) AS products_count
FROM latest LEFT JOIN n ON n.keyword = 'Brand#' || (job_id % 30) WHERE status = 'completed'""",
    "job_artifacts": f"""
WITH {_JOBS}, f AS (SELECT replace(lower(p_brand), '#', '') || '_PRODUCTS.json' AS filename, max(p_partkey) AS modified FROM part GROUP BY p_brand)
SELECT job_id, arg_max(filename, modified) AS filename, max(modified) AS modified
FROM latest JOIN f ON contains(lower(filename), 'brand' || (job_id % 30)) GROUP BY job_id""",
    "attempt_class": f"WITH {_REQUESTS} SELECT event_id, kind AS attempt_class FROM classed",
    "cache_key": f"WITH {_REQUESTS} SELECT event_id, key FROM r",
    "progress_pct": f"""
WITH {_REQUESTS} SELECT event_id, CAST(CASE endpoint WHEN 'signup' THEN 5 WHEN 'click' THEN 50 WHEN 'purchase' THEN 100 WHEN 'error' THEN 0
  ELSE floor(least(attempt, max_pages)::DOUBLE / max_pages * 90) + 10 END AS INTEGER) AS progress_pct FROM r""",
    "backoff_delay": """
SELECT event_id, least(pow(2.0::DOUBLE, event_id % 9), 60.0::DOUBLE) AS delay_seconds FROM events""",
    "attempt_outcome": f"""
WITH {_REQUESTS}, e AS (SELECT request_id, min(attempt) FILTER (WHERE kind = 'success') AS s, min(attempt) FILTER (WHERE kind = 'fatal') AS f,
  max(attempt) AS last FROM classed GROUP BY request_id)
SELECT request_id, CASE WHEN s IS NULL AND f IS NULL THEN CASE WHEN last > 3 THEN 'exhausted' ELSE 'pending' END
  WHEN f IS NOT NULL AND (s IS NULL OR f < s) THEN 'non_retryable' ELSE 'success' END AS outcome,
  CAST(coalesce(least(s, f), last) AS INTEGER) AS attempts_used FROM e""",
    "cache_asof": f"""
WITH {_REQUESTS}, w AS (SELECT *, max(CASE WHEN status_code = 200 THEN ts END) OVER (PARTITION BY key ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM r)
SELECT event_id, key, coalesce(ts < s + INTERVAL 1 HOUR, false) AS hit, CASE WHEN ts < s + INTERVAL 1 HOUR THEN s END AS stored_at FROM w""",
    "cache_hits": f"""
WITH RECURSIVE {_REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS i FROM r),
walk AS (SELECT key, event_id, i, CASE WHEN status_code = 200 THEN us ELSE us - 3600000000 END AS stored, false AS hit FROM n WHERE i = 1
  UNION ALL SELECT n.key, n.event_id, n.i, CASE WHEN n.us >= w.stored + 3600000000 AND n.status_code = 200 THEN n.us ELSE w.stored END, n.us < w.stored + 3600000000
  FROM walk w JOIN n ON n.key = w.key AND n.i = w.i + 1)
SELECT event_id, key, hit FROM walk""",
    "pacing_wait": f"""
WITH RECURSIVE {_REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY us, event_id) AS i FROM r),
walk AS (SELECT endpoint, event_id, i, us + 1200000000 AS full_at, 0::BIGINT AS waited_micros FROM n WHERE i = 1
  UNION ALL SELECT n.endpoint, n.event_id, n.i, greatest(n.us, w.full_at) + 1200000000, greatest(0, w.full_at - 4800000000 - n.us)
  FROM walk w JOIN n ON n.endpoint = w.endpoint AND n.i = w.i + 1)
SELECT event_id, endpoint, waited_micros FROM walk""",
    "pacing_deny": f"""
WITH RECURSIVE {_REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY us, event_id) AS i FROM r),
walk AS (SELECT endpoint, event_id, i, us + 1200000000 AS full_at, true AS allowed FROM n WHERE i = 1
  UNION ALL SELECT n.endpoint, n.event_id, n.i,
    CASE WHEN w.full_at - n.us <= 4800000000 THEN greatest(n.us, w.full_at) + 1200000000 ELSE w.full_at END, w.full_at - n.us <= 4800000000
  FROM walk w JOIN n ON n.endpoint = w.endpoint AND n.i = w.i + 1)
SELECT event_id, endpoint, allowed FROM walk""",
}

# Streams give the results of their batch twins.
ORACLES |= {
    "stream_products": f"""
WITH {_LINKS} SELECT keyword, page_no, item AS item_number, {_CARD_TITLE} AS title, {_CARD_PRICE} AS price FROM d
WHERE length(item) >= 8 QUALIFY row_number() OVER (PARTITION BY keyword, item ORDER BY page_no, pos) = 1""",
    "stream_jobs": ORACLES["jobs_latest"].replace("created_at, ts AS updated_at", "ts AS updated_at"),
    "stream_progress": f"""
WITH {_JOBS}, w AS (
  SELECT *, lag(progress) OVER o AS previous,
         count(*) FILTER (WHERE status IN ('completed', 'failed')) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over
  FROM j WINDOW o AS (PARTITION BY job_id ORDER BY ts, event_id))
SELECT job_id, event_id, status, progress FROM w
WHERE over = 0 AND (progress IS DISTINCT FROM previous OR status IN ('completed', 'failed'))""",
    "stream_retry": f"""
WITH {_JOBS} SELECT job_id, event_id, CAST(attempt AS INTEGER) AS attempt,
  CASE WHEN attempt <= 3 THEN ts + to_seconds(CASE attempt WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 900 END) END AS next_retry_at,
  CASE WHEN attempt > 3 THEN 'dead_letter' ELSE 'retrying' END AS status FROM failures""",
    "stream_cache_hits": ORACLES["cache_hits"],
    "stream_pacing_deny": ORACLES["pacing_deny"],
}
