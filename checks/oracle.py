"""SQL statements that DuckDB runs on the same tables, one per registered query.

Rule tables enter as VALUES lists.  A text is matched by wrapping every word of it
and of the term in marks, so that a plain substring test is a whole-word test.
"""

from __future__ import annotations

from newsweft.operators.enrich import UNGATED_KINDS
from newsweft.operators.language import CODES, HOME_LANGUAGES, MIN_CHARS, MIN_CONFIDENCE
from newsweft.plans import workload as w
from newsweft.plans.registry import CUT, LATE, RELOADED
from newsweft.rules import feeds, places, vocabulary
from newsweft.rules.book import RuleBook

_L, _R = "⟨", "⟩"
BOOK = RuleBook()
NOW = f"TIMESTAMP '{w.NOW}'"
CATS = [c for c, _, _ in vocabulary.CATEGORIES]


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


def strings(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def case(key: str, pairs: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items()) + " END"


def mark(term: str) -> str:
    import re

    return re.sub("([a-z0-9]+)", rf"{_L}\1{_R}", term.lower())


def marked(c: str) -> str:
    return rf"regexp_replace(lower({c}), '([a-z0-9]+)', '{_L}\1{_R}', 'g')"


def hit(text: str, term: str) -> str:
    return f"(contains({text}, {term}) AND contains(replace({text}, {term} || '{_L}', ''), {term}))"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def pick(items, index: str) -> str:
    return f"list_extract({strings(items)}, CAST(({index}) % {len(items)} AS INTEGER) + 1)"


NEWS = f"""news AS (
  SELECT event_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, user_id, event_type, value,
    CAST(event_id % {len(w.HEADLINES)} AS INTEGER) AS template,
    replace(replace(replace({pick(w.HEADLINES, 'event_id')}, '{{place}}', {pick(w.PLACES, 'user_id')}),
      '{{n}}', CAST(CAST(floor(value) AS BIGINT) % 90 + 1 AS VARCHAR)),
      '{{d}}', CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR)) AS title,
    ts AS published, {case('event_type', w.KINDS)} AS kind,
    CASE WHEN event_id % {len(w.HEADLINES)} = 14 AND event_type <> 'view' THEN 'usgs-' || CAST(user_id AS VARCHAR)
         WHEN event_id % {len(w.HEADLINES)} = 18 AND event_type = 'error' THEN 'gdacs-DR-' || CAST(user_id AS VARCHAR) END AS event_key
  FROM events)"""


def _rule_rows():
    n = 0
    for rule, (category, weight, words) in enumerate(BOOK.rules):
        for word in words:
            yield (n, rule, category, CATS.index(category), weight, mark(word))
            n += 1


def rule_ctes(texts: str) -> str:
    """Readings of distinct texts: needs a CTE ``texts(t, low, m)``; gives one row per text in ``readings``."""
    anchor_terms = [
        (i, a.id, a.category, strong, mark(t))
        for i, a in enumerate(BOOK.anchors)
        for strong, words in ((True, a.decisive), (False, a.supporting))
        for t in words
    ]
    return f"""texts AS MATERIALIZED ({texts}),
kw(kw, rule, category, cat_ord, weight, term) AS {values(_rule_rows())},
rule_hits AS (SELECT t, rule, category, cat_ord, weight, count(*) AS n FROM texts JOIN kw ON {hit('m', 'term')} GROUP BY ALL),
cat_scores AS (SELECT t, category, cat_ord, sum(weight * least(n, 3)) AS score FROM rule_hits GROUP BY ALL),
guesses AS (SELECT t, arg_max(category, score * 100 + cat_ord) AS category, max(score) AS score FROM cat_scores GROUP BY t),
anchor_terms(ord, anchor_id, category, strong, term) AS {values(anchor_terms)},
anchor_hits AS (
  SELECT t, ord, anchor_id, category, count(*) FILTER (WHERE strong) AS s, count(*) FILTER (WHERE NOT strong) AS w
  FROM texts JOIN anchor_terms ON {hit('m', 'term')} GROUP BY ALL),
anchored AS (
  SELECT t, arg_max(anchor_id, (2 * s + w) * 100 - ord) AS anchor_id, arg_max(category, (2 * s + w) * 100 - ord) AS category, max(2 * s + w) AS score
  FROM anchor_hits WHERE s >= 1 OR w >= 2 GROUP BY t),
noise_terms(term) AS {values([(mark(t),) for t in BOOK.noise])},
noisy AS (SELECT DISTINCT t FROM texts JOIN noise_terms ON {hit('m', 'term')}),
gaz(ord, name, lat, lon, radius, weight) AS {values([(p.ord, p.name, p.lat, p.lon, p.radius_deg, p.weight) for p in BOOK.gazetteer])},
aliases(ord, term, len) AS {values([(p.ord, mark(a), len(a)) for p in BOOK.gazetteer for a in p.aliases])},
place_hits AS (SELECT t, ord, strpos(m, term) AS pos, len FROM texts JOIN aliases ON {hit('m', 'term')}),
place_best AS (SELECT t, ord, min(pos) AS pos, arg_min(len, pos * 1000 - len) AS len FROM place_hits GROUP BY t, ord),
ranked_places AS (
  SELECT t, name, lat, lon, radius, row_number() OVER (PARTITION BY t ORDER BY weight DESC, pos, len DESC, ord) AS r
  FROM place_best JOIN gaz USING (ord)),
best_places AS (SELECT t, name AS place, lat, lon, radius FROM ranked_places WHERE r = 1),
readings AS (
  SELECT texts.t, coalesce(g.category, 'Other') AS category, CAST(coalesce(g.score, 0) AS BIGINT) AS score, a.anchor_id, a.category AS anchor_category,
    CAST(a.score AS BIGINT) AS anchor_score, n.t IS NOT NULL AS noise, p.place, p.lat, p.lon, p.radius
  FROM texts LEFT JOIN guesses g USING (t) LEFT JOIN anchored a USING (t) LEFT JOIN noisy n USING (t) LEFT JOIN best_places p USING (t))"""


NEWS_TEXTS = f"SELECT t, lower(t) AS low, {marked('t')} AS m FROM (SELECT DISTINCT title AS t FROM news)"


def severity(text: str, category: str) -> str:
    def says(terms):
        return f"regexp_matches(lower({text}), {lit('|'.join(terms))})"

    return f"""CASE WHEN {says(vocabulary.CRITICAL_TERMS)} THEN 4 WHEN {says(vocabulary.SEVERE_TERMS)} THEN 3
      WHEN {says(vocabulary.ELEVATED_TERMS)} THEN 2
      WHEN {category} IN ('UkraineWar', 'MiddleEast', 'ArmedConflict', 'Terrorism') THEN 2
      WHEN {category} IN ('Other', 'Politics', 'Economy') THEN 0 ELSE 1 END"""


LABELS = {level: label for level, label, _ in vocabulary.SEVERITIES}
WEIGHTS = {level: wt for level, _, wt in vocabulary.SEVERITIES}
TAGS = {n: t for n, _, t in vocabulary.CATEGORIES}


def toll(text: str) -> str:
    words = rf"string_split(trim(regexp_replace(lower({text}), '\s+', ' ', 'g')), ' ')"
    kind = "CASE " + " ".join(f"WHEN contains(tail, '{k}') THEN '{k}'" for k in vocabulary.TOLL_WORDS) + " END"
    number = r"regexp_replace(regexp_extract(word, '^[^0-9]*([0-9](?:.*[0-9])?)[^0-9]*$', 1), '^0+', '')"
    return f"""(SELECT arg_min(num || ' ' || kind, i) FROM (
      SELECT i, CASE WHEN regexp_full_match(num, '[0-9]{{1,10}}') AND TRY_CAST(num AS BIGINT) BETWEEN 1 AND 4294967295 THEN num END AS num, {kind} AS kind FROM (
        SELECT i, {number} AS num, array_to_string(list_slice(ws, i + 1, i + 3), ' ') AS tail
        FROM (SELECT ws, i, list_extract(ws, i) AS word FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT {words} AS ws)))
        WHERE regexp_matches(word, '[0-9]'))) WHERE num IS NOT NULL AND kind IS NOT NULL)"""


def tokens(text: str) -> str:
    """List of distinct tokens in order of first appearance."""
    stop = strings(dict.fromkeys(vocabulary.STOP_WORDS))
    raw = rf"list_transform(list_filter(string_split_regex({text}, '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: strlen(x) >= 3), lambda x: lower(x))"
    good = rf"list_filter({raw}, lambda x: NOT list_contains({stop}, x) AND NOT regexp_full_match(x, '[0-9]+'))"
    return good


def distinct_in_order(expr: str) -> str:
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT {expr} AS l))"


def kept_items(extra: str = "") -> str:
    """CTEs up to ``items``: news with readings, category after anchors, severity, place, story id."""
    return f"""WITH {NEWS}, {rule_ctes(NEWS_TEXTS)},
items AS (
  SELECT n.*, n.event_type AS source, coalesce(r.anchor_category, r.category) AS category, r.anchor_id, r.place, r.lat, r.lon, r.radius, r.score AS relevance,
    {severity('n.title', 'coalesce(r.anchor_category, r.category)')} AS severity, n.published + INTERVAL 5 MINUTE AS fetched,
    coalesce('ev-' || n.event_key, r.anchor_id, 's-' || n.event_type || '-' || CAST(n.template AS VARCHAR)) AS story_id
  FROM news n JOIN readings r ON n.title = r.t){extra}"""


ANCHOR_ROWS = [(a.id, a.title, a.category, BOOK.lookup(a.home).name, BOOK.lookup(a.home).lat, BOOK.lookup(a.home).lon, BOOK.lookup(a.home).radius_deg) for a in BOOK.anchors]

STORIES = f""",
anchors(story_id, title, category, home, lat, lon, radius) AS {values(ANCHOR_ROWS)},
seq AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY fetched, published, id) AS sn FROM items),
prior AS (SELECT *, max(published) OVER (PARTITION BY story_id ORDER BY sn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM seq),
renames AS (SELECT story_id, arg_max(title, published) AS retitle, max(published) AS retitled_at FROM prior
  WHERE kind = 'Alert' AND (top IS NULL OR published > top) GROUP BY story_id),
facts AS (
  SELECT story_id, arg_min(title, sn) AS first_title, arg_min(category, sn) AS first_category, min(published) AS first_seen, max(published) AS last_update,
    max(severity) AS severity, count(*) AS n_items, count(*) FILTER (WHERE kind = 'Video') AS n_videos, count(DISTINCT source) AS n_sources
  FROM seq GROUP BY story_id),
placed AS (
  SELECT story_id, place, count(*) AS n, max(published) AS lastp, arg_min(lat, sn) AS lat, arg_min(lon, sn) AS lon,
    arg_max(radius, (epoch_us(published), id)) AS radius FROM seq WHERE place IS NOT NULL GROUP BY story_id, place),
top_place AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, lastp DESC, place) AS r FROM placed) WHERE r = 1),
stories AS (
  SELECT f.story_id, coalesce(a.title, r.retitle, f.first_title) AS title, coalesce(a.category, f.first_category) AS category, a.story_id AS anchor_id,
    f.first_seen, f.last_update, f.severity, f.n_items, f.n_videos, f.n_sources, coalesce(a.home, p.place) AS focus,
    coalesce(a.lat, p.lat) AS lat, coalesce(a.lon, p.lon) AS lon, coalesce(a.radius, p.radius) AS radius
  FROM facts f LEFT JOIN renames r USING (story_id) LEFT JOIN top_place p USING (story_id) LEFT JOIN anchors a USING (story_id))"""


def live(items: str, n: int = 400) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY published DESC, id) AS rn FROM {items} QUALIFY rn <= {n})"


def minutes(later: str, earlier: str) -> str:
    return f"date_sub('minute', {earlier}, {later})"


HEAT = f""",
live AS {live('items')},
summary AS (
  SELECT story_id, count(*) AS n_live, count(*) FILTER (WHERE kind = 'Video') AS v_live, count(DISTINCT source) AS s_live,
    sum(CASE WHEN rn <= 60 THEN CASE WHEN {minutes(NOW, 'published')} < 0 THEN 1.0 ELSE 1.0 / (1.0 + {minutes(NOW, 'published')} / 60.0 / 6.0) END END) AS recency
  FROM live GROUP BY story_id),
view AS (
  SELECT s.* EXCLUDE (n_items, n_videos, n_sources), u.n_live AS n_items, u.v_live AS n_videos, u.s_live AS n_sources,
    u.recency * sqrt(u.s_live) * ({case('s.severity', WEIGHTS)}) / (1.0 + greatest({minutes(NOW, 's.last_update')} / 60.0 / 12.0, 0.0)) AS heat
  FROM stories s JOIN summary u USING (story_id)),
shown AS (SELECT * FROM view WHERE {NOW} <= last_update + INTERVAL 1440 HOUR)"""

VIEW = kept_items(STORIES + HEAT)


def zone(lat: str, lon: str) -> str:
    return f"""CASE WHEN {lat} IS NULL OR {lon} IS NULL THEN NULL WHEN {lat} BETWEEN 12 AND 42 AND {lon} BETWEEN 34 AND 63 THEN 'Middle East'
      WHEN {lat} BETWEEN 34 AND 72 AND {lon} BETWEEN -25 AND 45 THEN 'Europe' WHEN {lat} BETWEEN -36 AND 38 AND {lon} BETWEEN -20 AND 52 THEN 'Africa'
      WHEN {lon} BETWEEN -170 AND -30 THEN 'Americas' WHEN ({lon} >= 129 AND {lat} <= 10) OR {lon} <= -150 THEN 'Oceania'
      WHEN {lon} > 45 AND {lon} <= 180 THEN 'Asia' ELSE 'Other' END"""


def km(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    chord = f"""(pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2))"""
    return f"(2 * 6371.0 * asin(sqrt(CASE WHEN {chord} > 1 THEN 1.0 ELSE {chord} END)))"


def ago(now: str, then: str) -> str:
    s = f"date_sub('second', {then}, {now})"
    return f"""CASE WHEN {s} < 0 THEN 'now' WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN ({s} // 60) || 'm'
      WHEN {s} < 86400 THEN ({s} // 3600) || 'h' ELSE ({s} // 86400) || 'd' END"""


POINTS = """points AS (SELECT event_id, (event_id * 37) % 17000 / 100.0 - 85.0 AS lat, (event_id * 73) % 36000 / 100.0 - 180.0 AS lon FROM events)"""

USERS = f"""items AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS story_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, event_type AS source,
    {case('event_type', w.KINDS)} AS kind, ts AS published, ts + INTERVAL 5 MINUTE AS fetched,
    CASE WHEN value >= 100 THEN 4 WHEN value >= 50 THEN 3 WHEN value >= 20 THEN 2 WHEN value >= 5 THEN 1 ELSE 0 END AS severity FROM events)"""

USER_VIEW = f"""WITH {USERS}, live AS {live('items')},
summary AS (
  SELECT story_id, count(DISTINCT source) AS s_live,
    sum(CASE WHEN rn <= 60 THEN CASE WHEN {minutes(NOW, 'published')} < 0 THEN 1.0 ELSE 1.0 / (1.0 + {minutes(NOW, 'published')} / 60.0 / 6.0) END END) AS recency
  FROM live GROUP BY story_id),
facts AS (SELECT story_id, max(published) AS last_update, max(severity) AS severity FROM items GROUP BY story_id),
view AS (SELECT f.*, recency * sqrt(s_live) * ({case('f.severity', WEIGHTS)}) / (1.0 + greatest({minutes(NOW, 'last_update')} / 60.0 / 12.0, 0.0)) AS heat
  FROM facts f JOIN summary USING (story_id))"""

LOG = f"""log AS (
  SELECT {pick([s[0] for s in feeds.SOURCES], 'user_id')} AS source_id, ts AS fetched, event_type <> 'error' AS ok,
    CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) % 50 END AS n_items, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
    CASE WHEN event_type = 'error' THEN 'HTTP ' || CAST(CAST(floor(value) AS BIGINT) % 100 + 400 AS VARCHAR) END AS error FROM events),
sources(source_id, name, kind, url, parser, interval_s, force_category, opt_in) AS {values(feeds.SOURCES)},
status AS (
  SELECT source_id, count(*) AS fetches, count(*) FILTER (WHERE NOT ok) AS failures, CAST(coalesce(sum(n_items) FILTER (WHERE ok), 0) AS BIGINT) AS items_total,
    CASE WHEN arg_max(ok, fetched) THEN arg_max(n_items, fetched) ELSE 0 END AS last_items, max(fetched) FILTER (WHERE ok) AS last_ok,
    CASE WHEN NOT arg_max(ok, fetched) THEN arg_max(error, fetched) END AS last_error, arg_max(latency_ms, fetched) AS latency_ms, max(fetched) AS last_fetch
  FROM log GROUP BY source_id),
health AS (SELECT *, last_ok IS NOT NULL AND last_error IS NULL AS healthy FROM status)"""


def clean(c: str) -> str:
    """Tags to blanks, entities of the pages decoded with the ampersand last, white space collapsed."""
    tags = rf"translate(regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '<[^>]*$', ''), '>', ' ')"
    decoded = tags
    for name, text in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        decoded = f"replace({decoded}, {lit(name)}, {lit(text)})"
    return squeeze(decoded)


_WS = r"[\s\x{b}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"


def cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(left({c}, {n}), ' [^ ]*$', '') || '…' END"


def normal(c: str) -> str:
    return f"lower({squeeze(rf'''regexp_replace({c}, '[^\p{{L}}\p{{M}}\p{{N}}{_WS[1:-1]}]', '', 'g')''')})"


ORACLE: dict[str, str] = {}
R = f"WITH {NEWS}, {rule_ctes(NEWS_TEXTS)} "

ORACLE["category_counts"] = R + "SELECT r.category, count(*) AS n FROM news JOIN readings r ON title = t GROUP BY r.category"
ORACLE["category_scores"] = R + "SELECT event_id, r.category, r.score FROM news JOIN readings r ON title = t"
ORACLE["anchor_routing"] = R + f""", names(anchor_id, title, home) AS {values([(a.id, a.title, a.home) for a in BOOK.anchors])}
  SELECT r.anchor_id, count(*) AS n, CAST(sum(r.anchor_score) AS BIGINT) AS score, any_value(names.title) AS title, any_value(names.home) AS home
  FROM news JOIN readings r ON news.title = t JOIN names USING (anchor_id) GROUP BY r.anchor_id"""
ORACLE["noise_veto"] = R + "SELECT event_id, title FROM news JOIN readings r ON title = t WHERE event_key IS NULL AND noise"
ORACLE["relevance_gate"] = R + f"""SELECT event_type, r.category, count(*) AS n, CAST(sum(r.score) AS BIGINT) AS score FROM news JOIN readings r ON title = t
  WHERE {case('event_type', w.SOURCE_KINDS)} IN {UNGATED_KINDS} OR anchor_id IS NOT NULL OR r.score >= 4 GROUP BY ALL"""
ORACLE["locate_best"] = R + "SELECT event_id, place FROM news JOIN readings r ON title = t WHERE place IS NOT NULL"
ORACLE["locate_all_rank"] = R + """SELECT event_id, coalesce(l.places, '') AS places FROM news
  LEFT JOIN (SELECT t, string_agg(name, '|' ORDER BY r) AS places FROM ranked_places GROUP BY t) l ON title = l.t"""

_NAME_KEYS = f"""gaz(ord, name) AS {values([(p.ord, p.name) for p in BOOK.gazetteer])},
  keys AS (SELECT k, arg_min(name, ord) AS place FROM (SELECT ord, name, lower(name) AS k FROM gaz
    UNION SELECT a.ord, gaz.name, a.alias FROM {values([(p.ord, a) for p in BOOK.gazetteer for a in p.aliases])} a(ord, alias) JOIN gaz USING (ord)) GROUP BY k)"""
ORACLE["name_lookup"] = f"""WITH {_NAME_KEYS}, named AS (SELECT event_type, {pick(w.NAMES, 'event_id')} AS name FROM events)
  SELECT name, place, event_type, count(*) AS n FROM named LEFT JOIN keys ON lower(trim(name)) = k GROUP BY ALL"""
ORACLE["name_lookup_join"] = ORACLE["name_lookup"]
_GAZ = f"gaz(ord, name, lat, lon, radius) AS {values([(p.ord, p.name, p.lat, p.lon, p.radius_deg) for p in BOOK.gazetteer])}"
ORACLE["nearest_place"] = f"""WITH {POINTS}, {_GAZ}, d AS (SELECT event_id, name, radius, row_number() OVER (PARTITION BY event_id
    ORDER BY {km('g.lat', 'g.lon', 'p.lat', 'p.lon')}, ord) AS r FROM points p CROSS JOIN gaz g)
  SELECT event_id, name AS place, least(CAST(radius AS DOUBLE), 2.0) AS radius_deg FROM d WHERE r = 1"""

_DOC_TERMS = values([(t, mark(t)) for t in w.DOCUMENT_TERMS])
ORACLE["dict_hits_documents"] = f"""WITH d AS (SELECT doc_id, {marked('text')} AS m FROM documents), k(term, x) AS {_DOC_TERMS}
  SELECT doc_id, term, CAST((length(m) - length(replace(m, x, ''))) / length(x) AS BIGINT) AS n FROM d JOIN k ON contains(m, x)"""
ORACLE["dict_pattern_documents"] = f"""WITH d AS (SELECT doc_id, {marked('text')} AS m FROM documents), k(term, x) AS {_DOC_TERMS}
  SELECT doc_id, term FROM d JOIN k ON contains(m, x)"""
ORACLE["rules_on_documents"] = f"""WITH {rule_ctes(f"SELECT doc_id AS t, lower(text) AS low, {marked('text')} AS m FROM documents")}
  SELECT doc_id, noise, r.category, r.score, r.anchor_id AS anchor, r.place, {case(severity('text', 'r.category'), LABELS)} AS severity
  FROM documents JOIN readings r ON doc_id = t"""
ORACLE["explain_news"] = R + f""", also AS (SELECT t, string_agg(name, ', ' ORDER BY r) AS names FROM ranked_places WHERE r BETWEEN 2 AND 6 GROUP BY t),
  per AS (SELECT t, {toll('t')} AS toll, array_to_string({distinct_in_order(tokens('t'))}, ' ') AS tokens FROM texts)
  SELECT event_id, noise, r.category, r.score, anchor_id AS anchor, anchor_score, {case(severity('title', 'r.category'), LABELS)} AS severity, place,
    coalesce(also.names, '') AS also, per.toll, per.tokens
  FROM news JOIN readings r ON title = r.t JOIN per ON title = per.t LEFT JOIN also ON title = also.t"""

ORACLE["severity_documents"] = f"SELECT doc_id, {severity('text', chr(39) + 'Other' + chr(39))} AS severity FROM documents"
ORACLE["severity_news"] = R + f""", s AS (SELECT {severity('title', 'coalesce(anchor_category, r.category)')} AS severity FROM news JOIN readings r ON title = t)
  SELECT severity, {case('severity', LABELS)} AS label, count(*) AS n FROM s GROUP BY severity"""
ORACLE["toll_news"] = f"""WITH {NEWS}, per AS (SELECT t, {toll('t')} AS toll FROM (SELECT DISTINCT title AS t FROM news))
  SELECT event_id, toll FROM news JOIN per ON title = t WHERE toll IS NOT NULL"""
ORACLE["toll_documents"] = f"""WITH d AS (SELECT doc_id, text || ' (' || CAST(n_chars AS VARCHAR) || ') people missing or dead' AS t FROM documents)
  SELECT doc_id, {toll('t')} AS toll FROM d"""
ORACLE["tokens_per_doc"] = f"SELECT doc_id, CAST(len(list_distinct({tokens('text')})) AS INTEGER) AS n_tokens FROM documents"
ORACLE["top_tokens"] = f"""SELECT token, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct({tokens('text')})) AS token FROM documents)
  GROUP BY token ORDER BY n DESC, token LIMIT 100"""
ORACLE["item_id_fnv"] = """WITH h AS (SELECT page_id, list_reduce(list_prepend(14695981039346656037::HUGEINT,
    list_transform(range(0, strlen(url)), lambda i: ('0x' || substr(hex(encode(url)), 2 * i + 1, 2))::HUGEINT)),
    lambda acc, b: (xor(acc::HUGEINT, b::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS v FROM pages)
  SELECT page_id, lpad(lower(printf('%x', (v // 4294967296)::BIGINT)), 8, '0') || lpad(lower(printf('%x', (v % 4294967296)::BIGINT)), 8, '0') AS id FROM h"""
ORACLE["clean_pages"] = f"SELECT page_id, md5({clean('html')}) AS digest FROM pages"
ORACLE["page_snippets"] = f"WITH c AS (SELECT page_id, {clean('html')} AS t FROM pages), s AS (SELECT page_id, {cut('t', 420)} AS s FROM c) SELECT page_id, CAST(length(s) AS INTEGER) AS n, md5(s) AS digest FROM s"
ORACLE["page_restatements"] = f"""WITH p AS (SELECT page_id, {clean("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
    {clean("regexp_extract(html, '(?s)<h1>(.*?)</article>', 1)")} AS body FROM pages),
  q AS (SELECT page_id, body, {normal('title')} AS t, {normal('body')} AS s FROM p)
  SELECT page_id, CASE WHEN trim(body) = '' THEN TRUE WHEN t = '' THEN FALSE ELSE starts_with(s, t) OR starts_with(t, s) END AS restates FROM q"""

_KEEP = r"[^\p{L}\p{M}\p{N}!-/:-@\[-`{-~\x{C0}-\x{24F}\x{400}-\x{4FF}…—–\x{2018}-\x{201F}]"
_SENTENCE = r"(?s)^(.{40,159}?[.!?])(.+)$"
_TIDY = rf"""trim(regexp_replace(array_to_string(list_filter(list_transform(list_filter(string_split({squeeze('text')}, ' '),
    lambda x: NOT (starts_with(x, 'http://') OR starts_with(x, 'https://') OR starts_with(x, 'www.'))), lambda x: regexp_replace(x, '{_KEEP}', '', 'g')),
    lambda x: x NOT IN ('', '#', '-', '|')), ' '), '((^| )#[^ ]*)+$', ''))"""
ORACLE["social_posts"] = rf"""WITH c AS (SELECT conv_id, turn, {_TIDY} AS s FROM conversations),
  h AS (SELECT *, regexp_replace(left(s, 160), ' [^ ]*$', '') AS head, regexp_matches(s, '{_SENTENCE}') AS broken FROM c)
  SELECT conv_id, turn,
    md5(CASE WHEN broken THEN trim(regexp_extract(s, '{_SENTENCE}', 1)) WHEN length(s) > 160 THEN head || '…' ELSE s END) AS title,
    md5(CASE WHEN broken THEN trim(regexp_extract(s, '{_SENTENCE}', 2)) WHEN length(s) > 160 THEN trim(substr(s, length(head) + 1)) ELSE '' END) AS snippet FROM h"""
ORACLE["parsed_dates"] = f"""SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 = 5 THEN {stamp('ts + INTERVAL 5 HOUR')} ELSE {stamp('ts')} END AS parsed FROM events"""
ORACLE["ages"] = f"SELECT event_id, {ago(NOW, 'ts')} AS age FROM events"
ORACLE["short_errors"] = f"""WITH {LOG}, e AS (SELECT CASE WHEN latency_ms % 2 = 0 THEN error || ': error sending request for url (https://' || source_id || '.example/a/long/path/to/a/feed.xml)'
    ELSE 'E: error sending request for url (https://' || source_id || '.example/a/long/path/to/a/feed.xml)' END AS e FROM log WHERE error IS NOT NULL),
  s AS (SELECT replace(CASE WHEN strlen(split_part(e, ':', 1)) < 4 THEN e ELSE trim(split_part(e, ':', 1)) END, 'error sending request for url', 'request failed') AS s FROM e)
  SELECT CASE WHEN length(s) > 48 THEN left(s, 48) || '…' ELSE s END AS error, count(*) AS n FROM s GROUP BY 1"""

ORACLE["zone_counts"] = f"WITH {POINTS} SELECT {zone('lat', 'lon')} AS zone, count(*) AS n FROM points GROUP BY 1"
ORACLE["region_counts"] = f"""WITH {POINTS}, r(region, x0, x1, y0, y1) AS {values(places.REGIONS)}
  SELECT region, count(*) AS n FROM points JOIN r ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY region"""
ORACLE["density_grid"] = f"""WITH {POINTS} SELECT CAST(least(greatest(floor((lon + 180.0) / 360.0 * 36), 0), 35) AS INTEGER) AS cx,
  CAST(least(greatest(floor((90.0 - lat) / 180.0 * 18), 0), 17) AS INTEGER) AS cy, count(*) AS n FROM points GROUP BY 1, 2"""
ORACLE["nearest_marker"] = f"""WITH {POINTS}, m AS (SELECT c_custkey, (c_custkey * 911) % 17000 / 100.0 - 85.0 AS y, (c_custkey * 577) % 36000 / 100.0 - 180.0 AS x FROM customer),
  d AS (SELECT event_id, c_custkey AS marker_id, (x - lon) * (x - lon) + (y - lat) * 2 * (y - lat) * 2 AS d2 FROM points JOIN m ON abs(x - lon) <= 4 AND abs(y - lat) <= 4)
  SELECT event_id, arg_min(marker_id, (d2, marker_id)) AS marker_id, round(min(d2), 4) AS d2 FROM d WHERE d2 <= 16 GROUP BY event_id"""
ORACLE["view_windows"] = f"""WITH {POINTS}, p AS (SELECT event_id, least(greatest(lon - 19.5, -180.0), 180.0 - 39.0) AS x, least(greatest(lat - 19.5, -85.0), 85.0 - 39.0) AS y FROM points)
  SELECT event_id, round(CAST(x AS DOUBLE), 4) AS west, round(CAST(x + 39.0 AS DOUBLE), 4) AS east, round(CAST(y AS DOUBLE), 4) AS south, round(CAST(y + 39.0 AS DOUBLE), 4) AS north FROM p"""

ORACLE["dedupe_new_items"] = f"""SELECT event_type, count(*) AS n, {stamp('min(ts)')} AS first, {stamp('max(ts)')} AS last FROM events WHERE ts >= TIMESTAMP '{CUT}' GROUP BY event_type"""
ORACLE["age_gate"] = kept_items() + f"""SELECT anchor_id IS NOT NULL AS anchored, count(*) AS n, {stamp('min(published)')} AS oldest FROM items
  WHERE anchor_id IS NOT NULL OR date_sub('hour', published, TIMESTAMP '{LATE}') <= 1440 GROUP BY 1"""
ORACLE["assign_exact_tiers"] = kept_items() + """SELECT CASE WHEN event_key IS NOT NULL THEN 'event' WHEN anchor_id IS NOT NULL THEN 'anchor' ELSE 'free' END AS tier,
  CASE WHEN event_key IS NOT NULL THEN 'ev-' || event_key ELSE anchor_id END AS story_id, count(*) AS n FROM items GROUP BY ALL"""
_SOURCE_NAME = {"view": "BBC World", "click": "Bluesky · AP", "signup": "UN News", "purchase": "YouTube · AP", "error": "USGS earthquakes"}
ORACLE["enriched_items"] = f"""WITH {NEWS}, {rule_ctes(f"SELECT t, lower(t) AS low, {marked('t')} AS m FROM (SELECT DISTINCT title || ' ' || title || ', a spokesperson adds' AS t FROM news)")},
  per AS (SELECT t, {toll('t')} AS toll FROM texts)
  SELECT 'https://news.example/' || CAST(event_id AS VARCHAR) AS url, {case('event_type', _SOURCE_NAME)} AS source, title, '' AS snippet,
    {stamp('least(published, published - INTERVAL 1 HOUR + INTERVAL 5 MINUTE)')} AS published,
    CASE WHEN event_type = 'error' THEN 'Earthquake' ELSE coalesce(anchor_category, r.category) END AS category,
    {severity('r.t', "CASE WHEN event_type = 'error' THEN 'Earthquake' ELSE coalesce(anchor_category, r.category) END")} AS severity,
    place, toll, anchor_id, r.score AS relevance
  FROM news JOIN readings r ON title || ' ' || title || ', a spokesperson adds' = r.t JOIN per ON per.t = r.t
  WHERE (event_key IS NOT NULL OR NOT noise) AND (event_type IN ('error', 'signup') OR anchor_id IS NOT NULL OR r.score >= 4)"""

ORACLE["story_table"] = kept_items(STORIES) + f"""SELECT story_id, title, category, severity, n_items, n_videos, n_sources, {stamp('first_seen')} AS first_seen, {stamp('last_update')} AS last_update FROM stories
  UNION ALL SELECT story_id, title, category, 0, 0, 0, 0, NULL, NULL FROM anchors WHERE story_id NOT IN (SELECT story_id FROM items)"""
ORACLE["retitle"] = kept_items(STORIES) + f"""SELECT story_id, retitle, {stamp('retitled_at')} AS retitled_at FROM facts LEFT JOIN renames USING (story_id)"""
ORACLE["story_centroids"] = kept_items(f""", per AS MATERIALIZED (SELECT t, list_distinct({tokens('t')}) AS toks FROM texts)
""") + "SELECT story_id, token, count(*) AS n FROM (SELECT story_id, unnest(toks) AS token FROM items JOIN per ON title = t) GROUP BY ALL"
ORACLE["focus_place"] = kept_items(STORIES) + """SELECT story_id, focus AS place, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CAST(radius AS DOUBLE) AS radius_deg FROM stories WHERE focus IS NOT NULL"""
ORACLE["focus_edges"] = kept_items(STORIES) + """SELECT p.story_id, p.place AS name, p.n FROM placed p JOIN stories s USING (story_id)
  WHERE s.focus IS NOT NULL AND (abs(p.lat - s.lat) >= 0.01 OR abs(p.lon - s.lon) >= 0.01)"""
_ALERT = f"""SELECT story_id, id AS item_id, title, coalesce(place, 'unlocated') AS place, severity, reason FROM (
  SELECT *, CASE WHEN event_key LIKE 'gdacs-DR-%' THEN NULL WHEN severity >= 4 THEN 'Critical' WHEN severity >= 2 AND {zone('lat', 'lon')} = 'Europe' THEN 'Europe' END AS reason
  FROM first) WHERE reason IS NOT NULL"""
_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY fetched, published, id) AS sn FROM {src}) WHERE sn = 1)"
ORACLE["first_report_alerts"] = kept_items(", later AS (SELECT * FROM items WHERE published >= TIMESTAMP '2024-01-01 06:00:00' AND story_id NOT IN (SELECT story_id FROM items WHERE published < TIMESTAMP '2024-01-01 06:00:00')), " + _FIRST.format(src="later")) + _ALERT
ORACLE["first_reports_all"] = kept_items(", " + _FIRST.format(src="items")) + _ALERT
ORACLE["visible_filtered"] = VIEW + f"""SELECT story_id, category, severity, round(heat, 4) AS heat FROM shown WHERE severity >= 2 AND {zone('lat', 'lon')} = 'Europe'"""
ORACLE["story_search"] = VIEW + f""", forty AS {live('items', 40)}
  SELECT story_id, title FROM shown WHERE contains(lower(title), 'greece') OR story_id IN (SELECT story_id FROM forty WHERE contains(lower(title), 'greece') OR contains(lower(place), 'greece'))"""


def plain(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {n - 1}) || '…' END"


def short(c: str, n: int) -> str:
    return f"CASE WHEN length(trim({c})) <= {n} THEN trim({c}) ELSE regexp_replace(left(trim({c}), {n - 1}), ' [^ ]*$', '') || '…' END"


ORACLE["story_list"] = VIEW + f""", seen AS (SELECT story_id, min(fetched) AS seen_at FROM items GROUP BY story_id),
  unread AS (SELECT story_id, count(*) FILTER (WHERE fetched > seen_at) AS unread FROM items JOIN seen USING (story_id) GROUP BY story_id)
  SELECT story_id, CASE WHEN heat > 14 THEN 4 WHEN heat > 7 THEN 3 WHEN heat > 3 THEN 2 WHEN heat > 1 THEN 1 ELSE 0 END AS band, {case('category', TAGS)} AS tag,
    {short('title', 60)} AS title, unread, {plain("coalesce(focus, 'unlocated')", 18)} AS place, n_items, CAST(n_sources AS INTEGER) AS n_sources, {ago(NOW, 'last_update')} AS age, n_videos,
    {case('severity', LABELS)} AS severity, round(heat, 4) AS heat FROM shown JOIN unread USING (story_id)"""
_ORD = case("category", {c: i for i, c in enumerate(CATS)})
ORACLE["category_header"] = VIEW + f"SELECT category, count(*) AS n FROM shown GROUP BY category ORDER BY n DESC, {_ORD} LIMIT 9"
ORACLE["overview"] = kept_items(STORIES + HEAT + ", " + LOG) + f"""SELECT (SELECT count(*) FROM shown) AS active, (SELECT count(*) FROM shown WHERE severity >= 3) AS severe,
  CAST((SELECT sum(n_items) FROM view) AS BIGINT) AS items, coalesce((SELECT max(severity) FROM view WHERE {NOW} <= last_update + INTERVAL 12 HOUR), 0) AS worst,
  (SELECT {ago(NOW, 'max(last_update)')} FROM view) AS last_age, (SELECT count(*) FROM health WHERE healthy) AS sources_ok, (SELECT count(*) FROM health) AS sources_total"""
ORACLE["map_markers"] = VIEW + """, top AS (SELECT * FROM shown ORDER BY round(heat, 9) DESC, last_update DESC, story_id LIMIT 60)
  SELECT story_id, category, severity, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM top WHERE focus IS NOT NULL
  UNION SELECT story_id, category, severity, CAST(lat AS DOUBLE), CAST(lon AS DOUBLE) FROM shown WHERE story_id = 'ukraine-war' AND focus IS NOT NULL"""
ORACLE["probe_funnel"] = VIEW + """SELECT (SELECT count(*) FROM events) AS seen, (SELECT count(DISTINCT i.id) FROM items i JOIN readings r ON i.title = r.t
    WHERE (i.event_key IS NOT NULL OR NOT r.noise) AND (i.event_type IN ('error', 'signup') OR i.anchor_id IS NOT NULL OR i.relevance >= 4)) AS kept, (SELECT count(*) FROM view) AS stories,
  (SELECT count(*) FROM view WHERE focus IS NOT NULL) AS located, CAST((SELECT sum(n_videos) FROM view) AS BIGINT) AS videos"""
ORACLE["probe_stories"] = VIEW + f"""SELECT story_id, {case('category', TAGS)} AS tag, {plain('title', 44)} AS title, n_items, CAST(n_sources AS INTEGER) AS n_sources,
  {plain("coalesce(focus, '—')", 20)} AS place, {case('severity', LABELS)} AS severity FROM shown ORDER BY last_update DESC, story_id LIMIT 18"""
ORACLE["probe_timeline"] = VIEW + f"""SELECT story_id, {ago(NOW, 'published')} AS age, kind, {plain('source', 24)} AS source, {plain('title', 78)} AS title, id FROM items
  WHERE story_id = (SELECT story_id FROM shown ORDER BY last_update DESC, story_id LIMIT 1) ORDER BY published DESC, id LIMIT 8"""
ORACLE["story_timeline"] = kept_items(f", per AS (SELECT t, {toll('t')} AS toll FROM texts)") + f"""SELECT id, {ago(NOW, 'published')} AS age, kind, {plain('source', 22)} AS source,
  CASE WHEN severity >= 3 THEN {case('severity', LABELS)} END AS severity, title, place, CASE WHEN toll IS NULL THEN '' ELSE 'toll: ' || toll END AS facts
  FROM (SELECT * FROM items WHERE story_id = 'ukraine-war' ORDER BY published DESC, id LIMIT 400) JOIN per ON title = t WHERE kind = 'Article'"""

ORACLE["visible_by_category"] = VIEW + "SELECT story_id, title, severity FROM shown WHERE category = 'NaturalDisaster'"
ORACLE["zone_places"] = kept_items(STORIES) + "SELECT story_id, place AS name, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, n FROM placed"
ORACLE["zone_of_gazetteer"] = f"WITH {_GAZ} SELECT name, {zone('lat', 'lon')} AS zone, count(*) AS n FROM events JOIN gaz ON event_id % 229 = ord GROUP BY ALL"
ORACLE["item_detail"] = kept_items() + f"""SELECT id, story_id, title, kind, category, severity, {stamp('published')} AS published, place FROM items
  WHERE id IN (SELECT arg_max(id, (published, id)) FROM items GROUP BY kind)"""
ORACLE["alert_sink"] = ORACLE["first_reports_all"]
ORACLE["retired_state"] = kept_items(STORIES) + f"""SELECT f.story_id, {stamp('f.last_update')} AS last_update FROM facts f LEFT JOIN anchors a USING (story_id)
  WHERE a.story_id IS NOT NULL OR TIMESTAMP '{LATE}' <= f.last_update + INTERVAL 1440 HOUR"""

_RANK = "SELECT story_id, round(heat, 4) AS heat, severity, " + stamp("last_update") + " AS last_update FROM view ORDER BY {} LIMIT 100"
ORACLE["heat_rank"] = USER_VIEW + _RANK.format("heat DESC, view.last_update DESC, story_id")
ORACLE["latest_rank"] = USER_VIEW + _RANK.format("view.last_update DESC, story_id")
ORACLE["severity_rank"] = USER_VIEW + _RANK.format("severity DESC, view.last_update DESC, story_id")
ORACLE["rank_position"] = USER_VIEW + "SELECT * FROM (SELECT story_id, row_number() OVER (ORDER BY heat DESC, last_update DESC, story_id) AS position FROM view) WHERE story_id = '000042'"
ORACLE["trim_story_items"] = f"WITH {USERS}, k AS {live('items', 25)} SELECT story_id, count(*) AS n, min(id) AS oldest_id, {stamp('min(published)')} AS oldest FROM k GROUP BY story_id"
ORACLE["ticker"] = f"""WITH {USERS}, k AS {live('items', 3)} SELECT id, story_id, {stamp('published')} AS published FROM k
  WHERE k.published > {NOW} - INTERVAL 6 HOUR ORDER BY k.published DESC, id LIMIT 40"""
ORACLE["timeline_days"] = f"""WITH {USERS}, k AS (SELECT *, CAST(published AS DATE) AS d, row_number() OVER (PARTITION BY story_id, CAST(published AS DATE) ORDER BY published DESC, id DESC) AS r FROM items)
  SELECT story_id, CAST(d AS VARCHAR) AS day, max(CASE WHEN r = 1 THEN id END) AS first_id, count(*) AS n_items FROM k GROUP BY ALL"""
ORACLE["unread_counts"] = f"""WITH {USERS}, b AS (SELECT story_id, max(fetched) AS seen_at FROM items WHERE kind = 'Video' GROUP BY story_id)
  SELECT story_id, count(*) FILTER (WHERE seen_at IS NULL OR fetched > seen_at) AS unread FROM items LEFT JOIN b USING (story_id) GROUP BY story_id"""
ORACLE["snapshot_rows"] = f"""WITH {USERS}, f AS (SELECT story_id, max(published) AS u FROM items GROUP BY story_id HAVING {NOW} <= max(published) + INTERVAL 1440 HOUR ORDER BY u DESC, story_id LIMIT 400),
  k AS {live('(SELECT items.* FROM items JOIN f USING (story_id))', 250)} SELECT story_id, count(*) AS n, min(id) AS oldest_id FROM k GROUP BY story_id"""
ORACLE["snapshot_reload"] = f"""WITH {USERS}, f AS (SELECT story_id, max(published) AS u FROM items GROUP BY story_id HAVING {NOW} <= max(published) + INTERVAL 1440 HOUR ORDER BY u DESC, story_id LIMIT 400),
  k AS {live('(SELECT items.* FROM items JOIN f USING (story_id) WHERE TIMESTAMP ' + chr(39) + RELOADED + chr(39) + ' <= f.u + INTERVAL 1440 HOUR)', 250)} SELECT story_id, count(*) AS n, min(id) AS oldest_id FROM k GROUP BY story_id"""
ORACLE["restore_merge"] = f"WITH {USERS} SELECT story_id, count(*) AS n, count(DISTINCT id) AS ids FROM items GROUP BY story_id"

_FREE = f""", per AS MATERIALIZED (SELECT t, list_distinct({tokens('t')}) AS toks FROM texts),
free AS (SELECT i.*, p.toks FROM items i JOIN per p ON i.title = p.t WHERE event_key IS NULL AND anchor_id IS NULL)"""


def similarity(i: str, s: str, lexical: str) -> str:
    d = km(f"{i}.lat", f"{i}.lon", f"{s}.lat", f"{s}.lon")
    gap = f"abs(date_sub('hour', {s}.last_update, {i}.published))"
    both = f"{i}.category IN ('Earthquake', 'NaturalDisaster') AND {s}.category IN ('Earthquake', 'NaturalDisaster')"
    return f"""CASE WHEN {both} AND coalesce({d} > 600, FALSE) THEN 0.0 ELSE greatest(0.0, least(1.0, {lexical}
      + CASE WHEN {i}.category = {s}.category THEN 0.12 WHEN {i}.category = 'Other' THEN 0.0 ELSE -0.15 END
      + CASE WHEN {d} < 150 THEN 0.16 WHEN {d} < 600 THEN 0.08 WHEN {d} > 3000 THEN -0.12 ELSE 0.0 END
      + CASE WHEN {gap} > 72 THEN -0.20 WHEN {gap} > 36 THEN -0.08 ELSE 0.0 END)) END"""


_SIM = kept_items(_FREE + f""",
older AS (SELECT * FROM free WHERE published < TIMESTAMP '{CUT}'),
newer AS (SELECT * FROM free WHERE published >= TIMESTAMP '{CUT}')""" + STORIES.replace("FROM items)", "FROM older)", 1).replace("seq AS (SELECT *,", "seq AS (SELECT * EXCLUDE (toks),") + """,
words AS (SELECT story_id, token, count(*) AS n FROM (SELECT story_id, unnest(toks) AS token FROM older) GROUP BY ALL),
sizes AS (SELECT story_id, count(*) AS k FROM words GROUP BY story_id),
iw AS (SELECT id, unnest(toks) AS token FROM newer),
shared AS (SELECT id, story_id, sum(1 + ln(1 + n)) AS w FROM iw JOIN words USING (token) GROUP BY ALL),
scored AS (SELECT i.id, s.story_id, s.last_update, round(""" + similarity("i", "s", "least(1.0, h.w / (len(i.toks) + sqrt(z.k)))") + """, 9) AS score
  FROM shared h JOIN newer i ON h.id = i.id JOIN stories s ON h.story_id = s.story_id JOIN sizes z ON z.story_id = s.story_id),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, last_update DESC, story_id) AS r FROM scored WHERE score >= 0.34)
""")
ORACLE["similarity_best"] = _SIM + "SELECT id, story_id, round(score, 6) AS score FROM best WHERE r = 1"
ORACLE["similarity_best_pruned"] = ORACLE["similarity_best"]

# One batch: event ids and anchors first, then the best anchor story, then earlier founders in order of arrival.
# Copies (same words, category, place, day) go where the first of them goes; the recursion walks the firsts one by one.
_BATCH = _FREE + f""",
gated AS (SELECT * FROM items WHERE anchor_id IS NOT NULL OR date_sub('hour', published, {NOW}) <= 1440),
exact AS (SELECT * FROM gated WHERE event_key IS NOT NULL OR anchor_id IS NOT NULL),
copies AS MATERIALIZED (SELECT f.*, first_value(id) OVER (PARTITION BY CASE WHEN len(toks) = 0 THEN id END, list_sort(toks), category, lat, lon, CAST(published AS DATE)
    ORDER BY fetched, published, id) AS rep FROM free f WHERE id IN (SELECT id FROM gated)),
reps AS MATERIALIZED (SELECT *, published AS last_update, row_number() OVER (ORDER BY fetched, published, id) AS k FROM copies WHERE id = rep)"""
ORACLE["story_assignment"] = kept_items(_BATCH + STORIES.replace("FROM items)", "FROM exact)", 1)).replace("WITH news AS", "WITH RECURSIVE news AS", 1) + f""",
words AS (SELECT story_id, token, count(*) AS n FROM (SELECT story_id, unnest(toks) AS token FROM exact JOIN per ON title = t WHERE event_key IS NULL) GROUP BY ALL),
sizes AS (SELECT story_id, count(*) AS z FROM words GROUP BY story_id),
rep_words AS MATERIALIZED (SELECT k, unnest(toks) AS token FROM reps),
known AS (SELECT k, story_id, sum(1 + ln(1 + n)) AS w FROM rep_words JOIN words USING (token) GROUP BY ALL),
to_known AS (SELECT i.k, s.story_id, s.last_update, round({similarity("i", "s", "least(1.0, h.w / (len(i.toks) + sqrt(z.z)))")}, 9) AS score
  FROM known h JOIN reps i ON h.k = i.k JOIN stories s ON h.story_id = s.story_id JOIN sizes z ON z.story_id = s.story_id),
matched AS MATERIALIZED (SELECT * FROM to_known WHERE score >= 0.34 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, last_update DESC, story_id) = 1),
rest AS MATERIALIZED (SELECT * EXCLUDE (k), row_number() OVER (ORDER BY k) AS k, k AS rep_k FROM reps WHERE k NOT IN (SELECT k FROM matched)),
rest_words AS MATERIALIZED (SELECT k, unnest(toks) AS token FROM rest),
met AS (SELECT a.k AS later, b.k AS earlier, count(*) * (1 + ln(2)) AS w FROM rest_words a JOIN rest_words b ON a.token = b.token AND b.k < a.k GROUP BY ALL),
edges AS MATERIALIZED (SELECT * FROM (SELECT h.later, h.earlier, round({similarity("i", "s", "least(1.0, h.w / (len(i.toks) + sqrt(len(s.toks))))")}, 9) AS score
  FROM met h JOIN rest i ON h.later = i.k JOIN rest s ON h.earlier = s.k) WHERE score >= 0.34),
mates AS MATERIALIZED (SELECT k, coalesce(list(earlier) FILTER (WHERE earlier IS NOT NULL), []) AS earlier FROM rest LEFT JOIN edges ON later = k GROUP BY k),
walk(k, founders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT m.k, CASE WHEN list_has_any(w.founders, m.earlier) THEN w.founders ELSE list_append(w.founders, m.k) END FROM walk w JOIN mates m ON m.k = w.k + 1),
founders AS MATERIALIZED (SELECT unnest(founders) AS k FROM (SELECT founders FROM walk ORDER BY k DESC LIMIT 1)),
joined AS (SELECT e.later AS k, f.id AS founder, e.score FROM edges e JOIN rest f ON f.k = e.earlier WHERE e.earlier IN (SELECT k FROM founders)
  AND e.later NOT IN (SELECT k FROM founders) QUALIFY row_number() OVER (PARTITION BY e.later ORDER BY e.score DESC, f.published DESC, f.id) = 1),
decided AS (SELECT r.id AS rep, coalesce(m.story_id, 's-' || coalesce(j.founder, r.id)) AS story_id, coalesce(m.score, j.score) AS score
  FROM reps r LEFT JOIN matched m ON m.k = r.k LEFT JOIN rest t ON t.id = r.id LEFT JOIN joined j ON j.k = t.k)
SELECT id, story_id, CASE WHEN event_key IS NOT NULL THEN 'event' ELSE 'anchor' END AS tier, CAST(NULL AS DOUBLE) AS score FROM exact
UNION ALL SELECT c.id, d.story_id, CASE WHEN d.story_id = 's-' || c.id THEN 'new' ELSE 'similar' END, round(d.score, 6) FROM copies c JOIN decided d USING (rep)"""

_WEEK = _FREE + """,
weekly AS (SELECT * REPLACE ('w-' || source || '-' || CAST(template AS VARCHAR) || '-' || CAST(day(published) // 8 AS VARCHAR) AS story_id) FROM free)"""
_PAIRS = kept_items(_WEEK + STORIES.replace("FROM items)", "FROM weekly)", 1).replace("seq AS (SELECT *,", "seq AS (SELECT * EXCLUDE (toks),") + f""",
words AS (SELECT story_id, token, count(*) AS n FROM (SELECT story_id, unnest(toks) AS token FROM weekly) GROUP BY ALL),
totals AS (SELECT story_id, sum(n) AS total FROM words GROUP BY story_id),
pairs AS (SELECT a.story_id AS a, b.story_id AS b, sum(least(a.n, b.n)) AS shared FROM words a JOIN words b USING (token)
  JOIN stories sa ON sa.story_id = a.story_id JOIN stories sb ON sb.story_id = b.story_id
  WHERE sa.category = sb.category AND (sa.first_seen, sa.story_id) < (sb.first_seen, sb.story_id)
    AND coalesce({km('sa.lat', 'sa.lon', 'sb.lat', 'sb.lon')} < CASE WHEN sa.category IN ('Earthquake', 'NaturalDisaster') THEN 400 ELSE 800 END, TRUE) GROUP BY ALL)
""")
_ALIKE = """SELECT a, b, round(CAST(2.0 * shared / (x.total + y.total) AS DOUBLE), 6) AS overlap FROM pairs JOIN totals x ON x.story_id = a JOIN totals y ON y.story_id = b
  WHERE 2.0 * shared / (x.total + y.total) > 0.55"""
ORACLE["merge_pairs"] = _PAIRS + _ALIKE
# Transitive closure of the pairs; every story of a component moves to its oldest member.
ORACLE["merge_moves"] = _PAIRS.replace("WITH news AS", "WITH RECURSIVE news AS", 1) + f""", alike AS MATERIALIZED ({_ALIKE}),
  edges AS (SELECT a AS x, b AS y FROM alike UNION SELECT b, a FROM alike),
  reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
  targets AS (SELECT r.x AS story_id, arg_min(s.story_id, (s.first_seen, s.story_id)) AS target_id FROM reach r JOIN stories s ON s.story_id = r.y GROUP BY r.x)
  SELECT story_id, target_id FROM targets WHERE story_id <> target_id"""

ORACLE["merged_state"] = ORACLE["merge_moves"].rsplit("SELECT story_id, target_id FROM targets", 1)[0] + f"""SELECT coalesce(t.target_id, f.story_id) AS story_id, CAST(sum(n_items) AS BIGINT) AS n_items,
  CAST(sum(n_videos) AS BIGINT) AS n_videos, max(severity) AS severity, {stamp('min(first_seen)')} AS first_seen, {stamp('max(last_update)')} AS last_update
  FROM facts f LEFT JOIN targets t USING (story_id) GROUP BY 1"""
ORACLE["index_lookup"] = kept_items(f""", per AS MATERIALIZED (SELECT t, list_distinct({tokens('t')}) AS toks FROM texts),
  postings AS MATERIALIZED (SELECT story_id, token, count(*) AS n FROM (SELECT story_id, unnest(toks) AS token FROM items JOIN per ON title = t) GROUP BY ALL)
""") + """SELECT story_id, token, n, df, n_tokens, CAST(n_total AS BIGINT) AS n_total FROM postings JOIN (SELECT token, count(*) AS df FROM postings GROUP BY token) USING (token)
  JOIN (SELECT story_id, count(*) AS n_tokens, sum(n) AS n_total FROM postings GROUP BY story_id) USING (story_id)
  WHERE token IN (SELECT unnest(toks) FROM items JOIN per ON title = t WHERE template < 6)"""

ORACLE["source_health"] = f"WITH {LOG} SELECT source_id, fetches, failures, items_total, last_items, {stamp('last_ok')} AS last_ok, last_error, latency_ms, healthy FROM health"
_FACTOR = "CASE WHEN last_error IS NULL THEN 1 WHEN failures / fetches > 0.8 THEN 8 WHEN failures / fetches > 0.5 THEN 4 ELSE 2 END"
ORACLE["poll_plan"] = f"""WITH {LOG} SELECT source_id, {_FACTOR} AS factor, interval_s * {_FACTOR} AS wait_s,
  {stamp(f'last_fetch + to_seconds(interval_s * {_FACTOR})')} AS next_poll_at FROM health JOIN sources USING (source_id)"""
ORACLE["health_by_kind"] = f"WITH {LOG} SELECT kind, count(*) FILTER (WHERE healthy) AS ok, count(*) AS total FROM health JOIN sources USING (source_id) GROUP BY kind"
ORACLE["source_table"] = f"""WITH {LOG} SELECT source_id, name, lower(kind) AS kind, CASE WHEN last_error IS NOT NULL THEN last_error WHEN last_ok IS NOT NULL THEN 'ok' ELSE 'starting' END AS state,
  coalesce({ago(NOW, 'last_ok')}, '—') AS age, last_items, items_total, failures || '/' || fetches AS failed, latency_ms FROM health JOIN sources USING (source_id)"""
ORACLE["source_selection"] = f"WITH {LOG} SELECT source_id, name, count(*) AS fetches FROM log JOIN sources USING (source_id) WHERE NOT opt_in GROUP BY ALL"

_URL = "'https://news.example/' || CAST(event_id AS VARCHAR)"
_AT = stamp("published")
ORACLE["feed_parse_rss"] = f"""WITH {NEWS} SELECT CASE WHEN contains({_URL}, 'youtube') THEN 'Video' ELSE 'Article' END AS kind, title, 'Report & photos: ' || event_type AS snippet, {_URL} AS url, {_AT} AS published,
  'https://img.example/' || CAST(event_id AS VARCHAR) || '.png' AS thumbnail, 'feed-category=' || event_type AS facts FROM news"""
ORACLE["feed_parse_atom"] = f"""WITH {NEWS} SELECT 'Video' AS kind, title, 'Clip' AS snippet, 'https://www.youtube.com/watch?v=' || CAST(event_id AS VARCHAR) AS url, {_AT} AS published,
  'https://i.ytimg.com/vi/v' || CAST(event_id AS VARCHAR) || '/hqdefault.jpg' AS thumbnail, 'channel=Desk ' || event_type AS facts FROM news"""
_LAT, _LON = "(event_id * 37) % 17000 / 100.0 - 85.0", "(event_id * 73) % 36000 / 100.0 - 180.0"
_CODE = pick(w.HAZARD_CODES, "event_id")
_HAZARD = "CASE event_id % 8 WHEN 0 THEN 'earthquake' WHEN 1 THEN 'tropical cyclone' WHEN 2 THEN 'flood' WHEN 3 THEN 'volcano' WHEN 4 THEN 'drought' WHEN 5 THEN 'wildfire' WHEN 6 THEN 'tsunami' ELSE 'hazard' END"
ORACLE["feed_parse_hazards"] = f"""WITH {NEWS} SELECT title, {_URL} AS url, {_AT} AS published, CASE WHEN value >= 60 THEN 4 ELSE 3 END AS severity,
  CASE WHEN event_id % 8 = 0 THEN 'Earthquake' ELSE 'NaturalDisaster' END AS category_override,
  'gdacs-' || {_CODE} || '-' || CAST(event_id AS VARCHAR) AS event_key, 'Chile' AS place, CAST({_LAT} AS DOUBLE) AS lat, CAST({_LON} AS DOUBLE) AS lon,
  CAST(CASE WHEN event_id % 4 = 2 THEN least(greatest(event_id % 15, 1), 12) ELSE 1.5 END AS DOUBLE) AS radius_deg,
  'alert=' || CASE WHEN value >= 60 THEN 'Red' ELSE 'Orange' END || ';event=' || {_HAZARD} || ';country=Chile, Peru' AS facts FROM news WHERE value >= 20"""
_MAG = "CAST(CAST(floor(value) AS BIGINT) % 80 AS DOUBLE) / 10.0"
ORACLE["feed_parse_quakes"] = f"""WITH {NEWS}, q AS (SELECT *, {_MAG} AS mag FROM news)
  SELECT title, 'Magnitude ' || printf('%.1f', mag) || ' earthquake at 10 km depth.' AS snippet, {_URL} AS url, {_AT} AS published,
  CASE WHEN mag >= 7 THEN 4 WHEN mag >= 6 THEN 3 WHEN mag >= 5 THEN 2 ELSE 1 END AS severity, 'usgs-' || CAST(event_id AS VARCHAR) AS event_key, 'Chile' AS place,
  round(least(greatest(mag / 3.0, 0.4), 4.0), 4) AS radius_deg, 'magnitude=' || printf('%.1f', mag) || ';depth=10 km' AS facts FROM q"""
ORACLE["feed_parse_natural"] = f"""WITH {NEWS} SELECT title, 'Wildfires tracked by NASA EONET.' AS snippet, {_URL} AS url, {_AT} AS published, 2 AS severity,
  'eonet-' || CAST(event_id AS VARCHAR) AS event_key, CAST({_LAT} AS DOUBLE) AS lat, CAST({_LON} AS DOUBLE) AS lon, 'event=wildfires' AS facts FROM news"""
ORACLE["feed_parse_index"] = f"""WITH {_NAME_KEYS}, {NEWS}, x AS (SELECT *, {pick(w.NAMES, 'event_id')} AS country FROM news)
  SELECT title, {_URL} AS url, {_AT} AS published, place, 'outlet=' || event_type || '.example;source country=' || country AS facts FROM x LEFT JOIN keys ON lower(trim(country)) = k"""


def post_split(text: str) -> str:
    """Headline and rest of ``s`` for posts whose words hold no links or pictographs any more."""
    return rf"""split AS (SELECT *, regexp_matches(s, '{_SENTENCE}') AS broken, regexp_replace(left(s, 160), ' [^ ]*$', '') AS head FROM (SELECT *, {text} AS s FROM news)),
  posts AS (SELECT *, CASE WHEN broken THEN trim(regexp_extract(s, '{_SENTENCE}', 1)) WHEN length(s) > 160 THEN head || '…' ELSE s END AS headline,
    CASE WHEN broken THEN trim(regexp_extract(s, '{_SENTENCE}', 2)) WHEN length(s) > 160 THEN trim(substr(s, length(head) + 1)) ELSE '' END AS rest FROM split)"""


_LONG = "length(headline) >= 25"
ORACLE["feed_parse_author"] = f"""WITH {NEWS}, {post_split("title || '. Read the full report at'")}
  SELECT headline AS title, rest AS snippet, 'https://bsky.app/profile/' || event_type || '.example/post/' || CAST(event_id AS VARCHAR) AS url, {_AT} AS published,
  'handle=@' || event_type || '.example;post=https://bsky.app/profile/' || event_type || '.example/post/' || CAST(event_id AS VARCHAR) AS facts FROM posts WHERE event_type <> 'click' AND {_LONG}"""
ORACLE["feed_parse_hashtag"] = f"""WITH {NEWS}, {post_split("title || '. More to follow'")}
  SELECT headline AS title, rest AS snippet, {_URL} AS url, {_AT} AS published, 'account=@' || event_type || ';post=' || {_URL} AS facts FROM posts WHERE event_type <> 'click' AND {_LONG}"""
ORACLE["feed_parse_channel"] = f"""WITH {NEWS}, {post_split("title || '. Stay tuned'")}
  SELECT 'Article' AS kind, headline AS title, rest AS snippet, 'https://t.me/desk/' || CAST(event_id AS VARCHAR) AS url, {_AT} AS published, 'channel=t.me/disclosetv' AS facts FROM posts WHERE {_LONG}"""
_PARTS = [("bbc", "rss"), ("yt-bbc", "atom"), ("gdacs", "hazards"), ("usgs", "quakes"), ("eonet", "natural"), ("gdelt-conflict", "index"), ("bsky-reuters", "author"),
          ("masto-gaza", "hashtag"), ("tg-disclosetv", "channel")]
_KIND_OF = {"rss": "kind", "atom": "kind", "channel": "kind", "hazards": "'Alert'", "quakes": "'Alert'", "natural": "'Alert'"}
ORACLE["feed_union"] = " UNION ALL ".join(
    f"SELECT '{source}' AS source_id, {_KIND_OF.get(fmt, chr(39) + 'Article' + chr(39))} AS kind, count(*) AS n FROM ({ORACLE['feed_parse_' + fmt]}) GROUP BY ALL" for source, fmt in _PARTS)
ORACLE["payload_log"] = f"""WITH p AS (SELECT event_id // {w.PER_PAYLOAD} AS n FROM events GROUP BY 1)
  SELECT 'gdelt-conflict' AS source_id, n % 4 = 3 AS ok, CASE n % 4 WHEN 0 THEN 'rate limited' WHEN 1 THEN 'empty body' WHEN 2 THEN 'HTTP 503' END AS error, count(*) AS n FROM p GROUP BY 1, 2, 3"""

_TRI = r"(SELECT list_transform(range(1, length(z) - 1), lambda i: substr(z, i, 3)) FROM (SELECT ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{M}]+', ' ', 'g')) || ' ' AS z))"
ORACLE["language_flag"] = f"""WITH marks AS MATERIALIZED (SELECT doc_id, coalesce({case('lang', CODES)}, upper(lang)) AS lang, length(text) AS chars, unnest({_TRI}) AS g FROM documents),
  counts AS (SELECT lang, g, count(*) AS n FROM marks GROUP BY ALL),
  totals AS (SELECT lang, sum(n) + 0.5 * (count(*) + 1) AS mass FROM counts GROUP BY lang),
  model AS (SELECT lang, g, ln((n + 0.5) / mass) AS wt FROM counts JOIN totals USING (lang)),
  per AS (SELECT doc_id, g, count(*) AS n FROM marks WHERE chars >= {MIN_CHARS} GROUP BY ALL),
  sums AS (SELECT doc_id, t.lang, sum(n * coalesce(m.wt, ln(0.5 / t.mass))) / 3.0 AS s FROM per CROSS JOIN totals t LEFT JOIN model m ON m.g = per.g AND m.lang = t.lang GROUP BY ALL),
  best AS (SELECT doc_id, arg_max(lang, (s, lang)) AS lang, max(s) AS top FROM sums GROUP BY doc_id),
  conf AS (SELECT b.doc_id, b.lang, 1.0 / sum(exp(s - top)) AS c FROM best b JOIN sums USING (doc_id) GROUP BY ALL)
  SELECT doc_id, lang AS language FROM conf WHERE lang NOT IN {HOME_LANGUAGES} AND c >= {MIN_CONFIDENCE}"""
