r"""The registered queries once more, as SQL for an engine without look-arounds.

Links are found by splitting the text in front of every link start; bounded addresses
by the loose pattern, which finds the same ones here, where no address is followed by
``_`` or a letter outside ASCII.
"""

from __future__ import annotations

from contactmine import fixed_values as X
from contactmine.operators.domains import DEFAULT_RULES
from contactmine.plans import tables as D
from contactmine.plans.catalog import CUSTOM_EMAIL, CUSTOM_URL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


# --- texts ---------------------------------------------------------------------------------

CARDS = f"SELECT {D.CARD_SOURCE} AS source_id, {D.CARD_TEXT} AS text FROM customer"
DOCUMENTS = "SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS source_id, text FROM documents"
HTML = "SELECT 'html-' || CAST(page_id AS VARCHAR) AS source_id, html AS text FROM pages"
CORPUS = f"""{CARDS}
 UNION ALL {DOCUMENTS}
 UNION ALL {HTML}
 UNION ALL SELECT 'page-' || CAST(page_id AS VARCHAR), url FROM pages
 UNION ALL SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations
 UNION ALL SELECT 'bench-' || CAST(item_id AS VARCHAR), text FROM benchmark"""

# --- finders: a SQL list of the raw hits of ``text`` -------------------------------------------


def _email_hits(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(text, {q(pattern)}, {group})"


STRICT = _email_hits(X.STRICT_EMAIL)
LOOSE = _email_hits(X.LOOSE_EMAIL)
CUSTOM = _email_hits(CUSTOM_EMAIL, 1)

SEGMENTS = r"(string_split(regexp_replace(text, '(https?://)', chr(1) || '\1', 'g'), chr(1)))[2:]"


def _trimmed(raw: str, trail: str, min_length: int) -> str:
    hits = f"list_transform({raw}, lambda u: rtrim(u, {q(trail)}))"
    if min_length:
        hits = f"list_filter({hits}, lambda u: length(u) >= {min_length} AND contains(u, '.'))"
    return hits


def _segment_hits(stops: str, repeat: str, trail: str, min_length: int = 0) -> str:
    pattern = q(f"^https?://[^{stops}]{repeat}")
    raw = f"list_transform({SEGMENTS}, lambda s: regexp_extract(s, {pattern}))"
    return _trimmed(f"list_filter({raw}, lambda u: u <> '')", trail, min_length)


SEGMENTED = _segment_hits(X.SEGMENTED_STOPS, "*", X.SEGMENTED_TRAIL)
SERVICE = _segment_hits(X.SERVICE_STOPS, "+", X.SERVICE_TRAIL, X.SERVICE_MIN_LENGTH)
OVERLAPPING = _trimmed(
    f"list_transform(range(1, len({SEGMENTS}) + 1), lambda i: regexp_extract("
    f"array_to_string(({SEGMENTS})[i:], ''), {q('^https?://[^' + X.OVERLAPPING_STOPS + ']*')}))",
    X.OVERLAPPING_TRAIL,
    X.OVERLAPPING_MIN_LENGTH,
)
CUSTOM_LINKS = _trimmed(_email_hits(CUSTOM_URL), X.SERVICE_TRAIL, X.SERVICE_MIN_LENGTH)


def hits(raw: str, kind: str, source: str = "corpus", keep: str = "source_id") -> str:
    """Rows ``keep, kind, pos, value``: first occurrences of each text, counted from 0."""
    return f"""SELECT {keep}, '{kind}' AS kind, unnest(range(len(f))) AS pos, unnest(f) AS value FROM (
  SELECT {keep}, list_filter(raw, lambda v, i: list_position(raw, v) = i) AS f FROM (
   SELECT {keep}, {raw} AS raw FROM {source}))"""


def _with(body: str, **ctes: str) -> str:
    parts = [f"corpus AS ({CORPUS})"] + [f"{name} AS ({sql})" for name, sql in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


# --- value expressions -------------------------------------------------------------------------

CLEAN = f"trim(value, {q(X.PUNCTUATION)})"
LOCAL = "split_part(lower(value), '@', 1)"
DOMAIN = "CASE WHEN contains(value, '@') THEN lower(substr(value, strpos(value, '@') + 1)) ELSE '' END"
BARE = f"split_part(split_part({DOMAIN}, ':', 1), '/', 1)"
NETLOC = "regexp_extract(value, '^https?://([^/?#]*)', 1)"
HOST_SLASH = "lower(regexp_extract(value, 'https?://([^/]+)', 1))"
WWW = rf"regexp_replace(lower({NETLOC}), '^www\.', '')"
LEGACY_WWW = f"ltrim(lower({NETLOC}), 'w.')"
VALID = f"({NETLOC} <> '' AND contains({NETLOC}, '[') = contains({NETLOC}, ']'))"
BASE = "regexp_extract(value, '^(https?://[^/?#]*)', 1)"


def _or(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


FILE = _or([f"ends_with({DOMAIN}, {q(e)})" for e in X.LOOKALIKE_EXTENSIONS])
DIGIT = "regexp_matches(value, '@[0-9]')"
IMAGE = rf"regexp_matches(value, '(?i)\.({'|'.join(X.IMAGE_EXTENSIONS)})$')"
FORBIDDEN = _or(
    [f"contains({p}, {q(w)})" for w in X.FORBIDDEN_WORDS for p in (LOCAL, DOMAIN)]
)
FORBIDDEN_LOCAL = _or([f"contains({LOCAL}, {q(w)})" for w in X.FORBIDDEN_LOCAL_WORDS])
DISPOSABLE = f"list_contains({_list(D.DISPOSABLE)}, {BARE})"
DISPOSABLE_END = _or([f"ends_with({DOMAIN}, {q(d)})" for d in D.DISPOSABLE])
PARTS = [b.lstrip("*.") for b in D.BLOCKED]
BLOCKED_PART = _or([f"contains({WWW}, {q(p)})" for p in PARTS])
LEGACY_PART = _or([f"contains({LEGACY_WWW}, {q(p)})" for p in PARTS])
BLOCKED_HOST = f"list_contains({_list(D.BLOCKED)}, {WWW})"
WILDCARD = _or(
    [
        f"regexp_matches({HOST_SLASH}, {q(w.replace('.', chr(92) + '.').replace('*', '.*'))}, 'i')"
        for w in D.WILDCARDS
    ]
)

STRICT_REASON = f"WHEN NOT contains(value, '@') THEN 'no_at' WHEN {FILE} THEN 'file_ext' WHEN {DIGIT} THEN 'digit'"
SIMPLE_REASON = f"CASE {STRICT_REASON} ELSE 'kept' END"
EMAIL_REASON = (
    f"CASE {STRICT_REASON} WHEN {FORBIDDEN} THEN 'forbidden' "
    f"WHEN {DISPOSABLE} THEN 'disposable' ELSE 'kept' END"
)
LINK_REASON = (
    f"CASE WHEN NOT {VALID} OR {WWW} = '' THEN 'invalid' WHEN {BLOCKED_PART} THEN 'blocked_part' "
    f"WHEN {BLOCKED_HOST} THEN 'blocked_host' ELSE 'kept' END"
)
REASON = f"CASE WHEN kind = 'email' THEN {EMAIL_REASON} ELSE {LINK_REASON} END"

ASCII_LABEL = "[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?"

# --- common tables -------------------------------------------------------------------------------

strict = {"strict": hits(STRICT, "email")}
loose = {"loose": hits(LOOSE, "email")}
links = {"links": hits(SEGMENTED, "url")}
overlapping = {"links": hits(OVERLAPPING, "url")}
service = {"links": hits(SERVICE, "url")}
cleaned = {**strict, "v": f"SELECT DISTINCT 'email' AS kind, {CLEAN} AS value FROM strict"}
bounded = {**loose, "v": "SELECT DISTINCT value FROM loose"}
link_values = {**links, "v": "SELECT DISTINCT 'url' AS kind, value FROM links"}
overlapping_values = {**overlapping, "v": "SELECT DISTINCT value FROM links"}
both = {
    **strict, **links,
    "c": f"""SELECT source_id, kind, pos, {CLEAN} AS value FROM strict
     UNION ALL SELECT source_id, kind, pos, value FROM links""",
    "v": "SELECT DISTINCT kind, value FROM c",
}

SCORED = f"""SELECT host, max(CASE WHEN list_contains(rules, '!' || e) THEN 1000000 - i
   WHEN list_contains(rules, e) OR list_contains(rules, '*.' || up) THEN -i END) AS score FROM (
  SELECT host, i, array_to_string(l[i + 1:], '.') AS e, array_to_string(l[i + 2:], '.') AS up,
   {_list(DEFAULT_RULES)} AS rules
  FROM (SELECT host, string_split(host, '.') AS l FROM hosted WHERE host <> ''
   AND NOT regexp_matches(host, '^(\\d{{1,3}}(\\.\\d{{1,3}}){{3}}|\\[.*)$') GROUP BY ALL) h, unnest(range(len(l))) AS t(i))
 GROUP BY host""".replace("\\\\", "\\")
HOSTED = rf"""SELECT value, regexp_replace(regexp_replace(regexp_replace(lower({NETLOC}),
   '^.*@', ''), ':.*$', ''), '\.+$', '') AS host FROM b"""
ROOTED = """SELECT value, host, CASE WHEN start > 0 THEN array_to_string((string_split(host, '.'))[start:], '.') END AS root
 FROM (SELECT value, host, CASE WHEN score > 0 THEN 1000001 - score ELSE -score END AS start
  FROM hosted LEFT JOIN scored USING (host))"""
bases = {
    **service,
    "b": f"SELECT DISTINCT {BASE} AS value FROM links WHERE {VALID}",
    "hosted": HOSTED,
    "scored": SCORED,
    "rooted": ROOTED,
    "d": "SELECT value, root, CASE WHEN root IS NOT NULL THEN host END AS subdomain FROM rooted",
}
service_emails = {**loose, "e": "SELECT DISTINCT value FROM loose"}
LEDGER = """SELECT DISTINCT 'cust-' || CAST(o_custkey AS VARCHAR) AS source_id FROM orders
 WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"""
STATUS = """SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base_url,
 CASE WHEN starts_with(url, 'https://') THEN 200 ELSE 404 END AS status FROM pages"""
FILES = f"SELECT {D.FILE_PATH} AS path FROM documents"
EXT = r"lower(regexp_extract(path, '[^/.][^/]*(\.[^./]*)$', 1))"
LINES = f"SELECT {D.LIST_LINE} AS line FROM pages"
STRIPPED = f"trim(line, {q(X.WHITESPACE)})"
SEGMENT_DOMAINS = "SELECT DISTINCT lower(c_mktsegment) || '.net' AS entry FROM customer"
PAGE_BLOCKLIST = """SELECT DISTINCT '*.' || upper(array_to_string((string_split(h, '.'))[-3:], '.')) AS entry
 FROM (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS h FROM pages WHERE contains(url, '#'))"""
PAGE_PARTS = "SELECT DISTINCT ltrim(lower(entry), '*.') AS entry FROM raw_entries"


def _exists(test: str) -> str:
    return f"EXISTS (SELECT 1 FROM entries WHERE {test})"


def _map(key: str, limit: int = 10_000) -> str:
    """``key, part, urls`` rows; groups over the limit are dealt out by hash."""
    return f"""SELECT key, CASE WHEN n > {limit} THEN CAST('0x' || substr(md5(url), 1, 8) AS BIGINT)
   % CAST(ceil(n / {limit}.0) AS BIGINT) ELSE 0 END AS part, url
 FROM (SELECT {key} AS key, value AS url, count(*) OVER (PARTITION BY {key}) AS n
  FROM d WHERE {key} IS NOT NULL)"""


def _map_query(key: str, limit: int = 10_000) -> str:
    return _with(
        "SELECT key, part, string_agg(url, '; ' ORDER BY url) AS urls FROM m GROUP BY key, part",
        **bases, m=_map(key, limit),
    )


_QUOTE = r"([ -)+-/:-@\[-^`{-~])"

ORACLES: dict[str, str] = {
    # scans
    "ext_allowlist": f"""SELECT path, {EXT} AS ext FROM ({FILES})
 WHERE list_contains({_list(X.COMPATIBLE_EXTENSIONS)}, {EXT})""",
    "ext_include_exclude": f"""SELECT path FROM ({FILES})
 WHERE {EXT} IN ('.txt', '.html', '.gz') AND {EXT} NOT IN ('.gz')""",
    "corpus_from_column": _with("SELECT source_id, length(text) AS n_chars FROM corpus"),
    "skip_processed": f"SELECT source_id FROM ({CARDS}) WHERE source_id NOT IN ({LEDGER})",
    "split_list": f"""SELECT source_id, len(p) AS n_parts, array_to_string(p, '|') AS parts FROM (
 SELECT source_id, list_filter(list_transform(string_split(text, ','),
  lambda s: trim(s, {q(X.WHITESPACE)})), lambda s: s <> '') AS p FROM ({DOCUMENTS}))""",
    # finders
    "email_extract_strict": _with("SELECT source_id, value FROM strict", **strict),
    "email_extract_bounded": _with("SELECT source_id, value FROM loose", **loose),
    "email_extract_loose": _with("SELECT source_id, value FROM loose", **loose),
    "email_extract_custom": _with("SELECT source_id, value FROM c", c=hits(CUSTOM, "email")),
    "url_extract_segmented": _with("SELECT source_id, value FROM links", **links),
    "url_extract_overlapping": _with("SELECT source_id, value FROM links", **overlapping),
    "url_extract_service": _with("SELECT source_id, value FROM links", **service),
    "url_extract_custom": _with("SELECT source_id, value FROM c", c=hits(CUSTOM_LINKS, "url")),
    "contacts_extract": _with(
        "SELECT source_id, kind, pos, value FROM strict UNION ALL SELECT source_id, kind, pos, value FROM links",
        **strict, **links,
    ),
    # scalar functions
    "email_clean": _with(f"SELECT DISTINCT value, {CLEAN} AS cleaned FROM strict", **strict),
    "email_parts": _with(
        f"SELECT DISTINCT value, {LOCAL} AS local, {DOMAIN} AS domain, {BARE} AS bare_domain FROM loose",
        **loose,
    ),
    "email_idna": _with(
        f"""SELECT head || label || host AS value,
 CASE WHEN label = '' OR coded IS NOT NULL AND regexp_full_match(host, '({ASCII_LABEL}[.])*{ASCII_LABEL}[.]?')
  AND NOT regexp_matches(host, '(^|[.])..--') AND length(coded || host) <= 253 THEN head || coded || host
  ELSE head || label || host END AS idna
 FROM (SELECT DISTINCT regexp_extract(value, '^(.*@)[^@]*$', 1, 's') AS head, regexp_extract(value, '([^@]*)$', 1) AS host FROM loose),
 (VALUES ('', ''), {", ".join(f"({q(k)}, {q(v) if v else 'NULL'})" for k, v in D.LABELS.items())}) AS l (label, coded)""",
        **loose,
    ),
    "url_netloc": _with(f"SELECT value, {NETLOC} AS netloc FROM v", **link_values),
    "url_host_slash": _with(f"SELECT value, {HOST_SLASH} AS host FROM v", **overlapping_values),
    "url_strip_www": _with(
        f"SELECT value, {WWW} AS host, {LEGACY_WWW} AS legacy_host FROM v", **link_values
    ),
    "url_base": _with(
        f"SELECT DISTINCT value, {BASE} AS base_url FROM links WHERE {VALID}", **service
    ),
    "url_root_domain": _with("SELECT value, root FROM d", **bases),
    "url_root_domain_join": _with("SELECT value, root FROM d", **bases),
    "url_subdomain": _with("SELECT value, subdomain FROM d", **bases),
    "normalize_blocklist": f"""SELECT DISTINCT line AS entry, ltrim(lower({STRIPPED}), '*.') AS normalized
 FROM ({LINES}) WHERE ltrim(lower({STRIPPED}), '*.') <> ''""",
    "list_entries": f"""SELECT DISTINCT lower({STRIPPED}) AS entry FROM ({LINES})
 WHERE {STRIPPED} <> '' AND NOT starts_with({STRIPPED}, '#')""",
    "wildcard_to_regex": rf"""SELECT DISTINCT {STRIPPED} AS entry,
 '(?idu)' || replace(regexp_replace({STRIPPED}, {q(_QUOTE)}, '\\\1', 'g'), '*', '.*') AS pattern
 FROM ({LINES}) WHERE {STRIPPED} <> '' AND NOT starts_with({STRIPPED}, '#')""",
    "throughput": """SELECT user_id, count(*) AS n_events, CASE WHEN max(ts) > min(ts)
 THEN (count(*) * 1e6::DOUBLE) / (epoch_us(max(ts)) - epoch_us(min(ts))) ELSE 0.0 END AS rate
 FROM events GROUP BY user_id""",
    # filters
    "email_not_file": _with(f"SELECT value FROM v WHERE NOT {FILE}", **cleaned),
    "email_not_image": _with(f"SELECT value FROM v WHERE NOT {IMAGE}", **bounded),
    "email_no_digit_domain": _with(f"SELECT value FROM v WHERE NOT {DIGIT}", **cleaned),
    "email_forbidden_any": _with(f"SELECT value FROM v WHERE NOT {FORBIDDEN}", **cleaned),
    "email_forbidden_local": _with(f"SELECT value FROM v WHERE NOT {FORBIDDEN_LOCAL}", **bounded),
    "email_disposable_exact": _with(f"SELECT value FROM v WHERE NOT {DISPOSABLE}", **cleaned),
    "email_disposable_exact_join": _with(
        f"SELECT value FROM v WHERE {BARE} NOT IN (SELECT entry FROM entries)",
        **cleaned, entries=SEGMENT_DOMAINS,
    ),
    "email_disposable_suffix": _with(f"SELECT value FROM v WHERE NOT {DISPOSABLE_END}", **bounded),
    "email_disposable_suffix_join": _with(
        f"SELECT value FROM v WHERE NOT {_exists(f'ends_with({DOMAIN}, entry)')}",
        **bounded, entries=SEGMENT_DOMAINS,
    ),
    "email_disposable_suffix_at_dot": _with(
        f"SELECT value, {_exists(f'''({DOMAIN}) = entry OR ends_with({DOMAIN}, '.' || entry)''')} AS hit FROM v",
        **bounded, entries=SEGMENT_DOMAINS,
    ),
    "url_block_substring": _with(f"SELECT value FROM v WHERE NOT {BLOCKED_PART}", **link_values),
    "url_block_substring_legacy": _with(
        f"SELECT value FROM v WHERE NOT {LEGACY_PART}", **link_values
    ),
    "url_block_substring_join": _with(
        f"SELECT value, {_exists(f'contains({WWW}, entry)')} AS hit FROM v",
        **link_values, raw_entries=PAGE_BLOCKLIST, entries=PAGE_PARTS,
    ),
    "url_block_wildcard": _with(f"SELECT value FROM v WHERE NOT {WILDCARD}", **overlapping_values),
    "url_block_wildcard_join": _with(
        f"SELECT value, {_exists(f'contains({HOST_SLASH}, entry)')} AS hit FROM v",
        **overlapping_values, raw_entries=PAGE_BLOCKLIST,
        entries="SELECT DISTINCT lower(substr(entry, 2)) AS entry FROM raw_entries",
    ),
    "url_block_exact": _with(f"SELECT value FROM v WHERE NOT {BLOCKED_HOST}", **link_values),
    "url_valid": _with(f"SELECT value FROM v WHERE {VALID}", **link_values),
    "email_classify": _with(
        f"""SELECT value, CASE WHEN {FORBIDDEN} THEN 'forbidden' WHEN {DISPOSABLE} THEN 'disposable'
 ELSE 'valid' END AS category FROM v""",
        **cleaned,
    ),
    "email_reason": _with(f"SELECT value, {EMAIL_REASON} AS reason FROM v", **cleaned),
    "url_reason": _with(f"SELECT value, {LINK_REASON} AS reason FROM v", **link_values),
    "url_live_only": _with(
        "SELECT value FROM b WHERE value IN (SELECT base_url FROM status WHERE status = 200)",
        **bases, status=STATUS,
    ),
    "url_dead_log": _with(
        "SELECT value FROM b WHERE value NOT IN (SELECT base_url FROM status WHERE status = 200)",
        **bases, status=STATUS,
    ),
    # distinct, first sightings, differences
    "emails_distinct": _with("SELECT DISTINCT value FROM strict", **strict),
    "emails_distinct_casefold": _with(
        "SELECT min(value) AS value FROM loose GROUP BY lower(value)", **loose
    ),
    "urls_distinct": _with("SELECT value FROM v", **link_values),
    "url_one_per_host": _with(
        f"""SELECT host, value, source_id FROM (SELECT {HOST_SLASH} AS host, value, source_id,
 row_number() OVER (PARTITION BY {HOST_SLASH} ORDER BY source_id, pos, value) AS rn FROM links) WHERE rn = 1""",
        **overlapping,
    ),
    "first_source": _with(
        "SELECT kind, value, min(source_id) AS source_id FROM c GROUP BY kind, value", **both
    ),
    "emails_union_sources": f"""WITH corpus AS ({CARDS} UNION ALL {DOCUMENTS} UNION ALL {HTML}),
loose AS ({loose['loose']}) SELECT DISTINCT value FROM loose""",
    "new_values_only": _with(
        """SELECT DISTINCT value FROM strict
 WHERE value NOT IN (SELECT value FROM strict WHERE source_id IN (SELECT source_id FROM ledger))""",
        **strict, ledger=LEDGER,
    ),
    "new_values_sorted": _with(
        """SELECT source_id, value FROM strict
 WHERE value NOT IN (SELECT value FROM strict WHERE source_id IN (SELECT source_id FROM ledger))
 ORDER BY source_id, value""",
        **strict, ledger=LEDGER,
    ),
    "sorted_values": _with("SELECT DISTINCT value FROM loose ORDER BY value", **loose),
    "recent_events": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    # maps
    "map_root_urls": _map_query("root"),
    "map_root_urls_split": _map_query("root", 3),
    "map_subdomain_urls": _map_query("subdomain"),
    "urls_without_root": _with(
        r"""SELECT CASE WHEN host = '' OR regexp_matches(host, '^(\d{1,3}(\.\d{1,3}){3}|\[.*)$') THEN ''
  ELSE list_last(string_split(host, '.')) END AS ending, count(*) AS n_values
 FROM rooted WHERE root IS NULL GROUP BY ALL""",
        **bases,
    ),
    "map_all_urls": _map_query("value"),
    "mapping_json": _with(
        """SELECT key, part, CAST(to_json(list(url ORDER BY url)) AS VARCHAR) AS json
 FROM m GROUP BY key, part""",
        **bases, m=_map("root"),
    ),
    "mapping_csv": _with(
        """SELECT key AS "Domain/Subdomain", part, string_agg(url, '; ' ORDER BY url) AS "URLs"
 FROM m GROUP BY key, part""",
        **bases, m=_map("subdomain"),
    ),
    "urls_mode_root": _with(
        "SELECT root, min(value) AS value FROM d WHERE root IS NOT NULL GROUP BY root", **bases
    ),
    "urls_mode_subdomain": _with(
        "SELECT subdomain, min(value) AS value FROM d WHERE subdomain IS NOT NULL GROUP BY subdomain",
        **bases,
    ),
    "urls_mode_all": _with("SELECT value FROM b", **bases),
    # summaries
    "summary_totals": _with(
        f"""SELECT kind, count(*) AS n_found, count(*) FILTER (WHERE {REASON} = 'kept') AS n_kept
 FROM v GROUP BY kind""",
        **both,
    ),
    "summary_by_reason": _with(
        f"SELECT {EMAIL_REASON} AS reason, count(*) AS n_values FROM v GROUP BY ALL", **cleaned
    ),
    "url_summary_by_reason": _with(
        f"SELECT {LINK_REASON} AS reason, count(*) AS n_values FROM v GROUP BY ALL", **link_values
    ),
    "sources_with_hits": _with("SELECT count(DISTINCT source_id) AS n_sources FROM c", **both),
    "sources_with_new_hits": _with(
        """SELECT count(DISTINCT s) AS n_sources FROM (
 SELECT min(source_id) AS s FROM c GROUP BY kind, value)""",
        **both,
    ),
    "file_counts": f"""SELECT count(*) AS n_files, count(*) FILTER (
 WHERE list_contains({_list(X.COMPATIBLE_EXTENSIONS)}, {EXT})) AS n_compatible FROM ({FILES})""",
    "metrics_table": _with(
        """SELECT 'texts' AS metric, count(*) AS value FROM corpus
 UNION ALL SELECT 'emails', count(DISTINCT value) FROM strict
 UNION ALL SELECT 'urls', count(DISTINCT value) FROM links""",
        **strict, **links,
    ),
    "hits_per_source": _with(
        """SELECT source_id, kind, CAST(0 AS BIGINT) AS part, string_agg(DISTINCT value, ' ' ORDER BY value) AS "values"
 FROM c GROUP BY source_id, kind""",
        **both,
    ),
    # the five variants
    "contacts_simple": _with(f"SELECT kind, value FROM v WHERE {SIMPLE_REASON} = 'kept'", **cleaned),
    "contacts_filtered": _with(f"SELECT kind, value FROM v WHERE {EMAIL_REASON} = 'kept'", **cleaned),
    "contacts_advanced": _with(f"SELECT kind, value FROM v WHERE {REASON} = 'kept'", **both),
    "contacts_advanced_join": _with(
        f"""SELECT kind, value, CASE
 WHEN kind = 'email' THEN CASE {STRICT_REASON} WHEN {FORBIDDEN} THEN 'forbidden'
  WHEN {BARE} IN (SELECT entry FROM disposable) THEN 'disposable' ELSE 'kept' END
 WHEN NOT {VALID} OR {WWW} = '' THEN 'invalid'
 WHEN {_exists(f'contains({WWW}, entry)')} THEN 'blocked_part' ELSE 'kept' END AS reason FROM v""",
        **both, disposable=SEGMENT_DOMAINS, raw_entries=PAGE_BLOCKLIST, entries=PAGE_PARTS,
    ),
    "contacts_advanced_summary": _with(
        f"SELECT kind, {REASON} AS reason, count(*) AS n_values FROM v GROUP BY ALL", **both
    ),
    "contacts_bounded": _with(
        f"""SELECT kind, value, source_id FROM (
 SELECT kind, value, source_id, row_number() OVER (PARTITION BY kind, key ORDER BY source_id, pos, value) AS rn FROM (
  SELECT kind, value, source_id, pos, value AS key FROM loose
   WHERE NOT {FORBIDDEN_LOCAL} AND NOT {DISPOSABLE_END} AND NOT {IMAGE}
  UNION ALL SELECT kind, value, source_id, pos, {HOST_SLASH} FROM links
   WHERE {HOST_SLASH} <> '' AND NOT {WILDCARD})) WHERE rn = 1""",
        **loose, **overlapping,
    ),
    "contacts_service_root": _with(
        """SELECT 'email' AS kind, value FROM e
 UNION ALL SELECT 'url', min(value) FROM d WHERE root IS NOT NULL GROUP BY root""",
        **service_emails, **bases,
    ),
    "contacts_service_subdomain": _with(
        """SELECT 'email' AS kind, value FROM e
 UNION ALL SELECT 'url', min(value) FROM d WHERE subdomain IS NOT NULL GROUP BY subdomain""",
        **service_emails, **bases,
    ),
    "contacts_service_all": _with(
        "SELECT 'email' AS kind, value FROM e UNION ALL SELECT 'url', value FROM b",
        **service_emails, **bases,
    ),
    "contacts_service_live": _with(
        f"""SELECT DISTINCT 'email' AS kind, value FROM loose WHERE source_id NOT IN (SELECT source_id FROM ledger)
 UNION ALL SELECT DISTINCT 'url', {BASE} FROM links
 WHERE {VALID} AND source_id NOT IN (SELECT source_id FROM ledger)
  AND {BASE} IN (SELECT base_url FROM status WHERE status = 200)""",
        **service_emails, **bases, status=STATUS, ledger=LEDGER,
    ),
}


def _cells(tables: dict[str, tuple[str, list[str]]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{t}-' || CAST({key} AS VARCHAR) AS source_id, '{c}' AS "column", {c} AS text FROM {t}"""
        for t, (key, columns) in tables.items()
        for c in columns
    )


_PAGE_CELLS = {"pages": ("page_id", ["url", "html"])}
_ALL_CELLS = {
    **_PAGE_CELLS,
    "documents": ("doc_id", ["text", "lang", "source"]),
    "customer": ("c_custkey", ["c_name", "c_mktsegment"]),
    "supplier": ("s_suppkey", ["s_name"]),
    "part": ("p_partkey", ["p_name", "p_brand", "p_type"]),
    "nation": ("n_nationkey", ["n_name"]),
    "region": ("r_regionkey", ["r_name"]),
    "orders": ("o_orderkey", ["o_orderstatus", "o_orderpriority"]),
    "lineitem": ("l_orderkey", ["l_returnflag", "l_linestatus"]),
    "events": ("event_id", ["event_type", "props"]),
    "conversations": ("conv_id", ["role", "text"]),
    "benchmark": ("item_id", ["text"]),
}


def _cell_query(tables: dict[str, tuple[str, list[str]]], columns: str) -> str:
    keep = '"table", source_id, "column"'
    emails = hits(LOOSE, "email", "cell_texts", keep)
    urls = hits(SEGMENTED, "url", "cell_texts", keep)
    return f"""WITH cell_texts AS ({_cells(tables)})
SELECT {columns}, kind, value FROM ({emails}) UNION ALL SELECT {columns}, kind, value FROM ({urls})"""


ORACLES["cell_scan"] = _cell_query(_PAGE_CELLS, 'source_id, "column"')
ORACLES["cell_scan_multi_table"] = _cell_query(_ALL_CELLS, '"table", source_id, "column"')
