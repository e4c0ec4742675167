"""DuckDB SQL that computes the same results as the queries of the catalogue."""

from __future__ import annotations

from quillspark import fixed_values as fixed
from quillspark.functions.render import DEFAULT_COMMAND
from quillspark.plans import catalogue as q


def lit(value: str) -> str:
    parts = value.split("\n")
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) + ")"


def chained(expression: str, pairs) -> str:
    for old, new in pairs:
        expression = f"replace({expression}, {lit(old)}, {lit(new)})"
    return expression


PAPERS = """
dated AS (
  SELECT *, DATE '2008-01-01' + CAST(doc_id * 37 % 6570 AS INTEGER) AS day,
         CAST(n_chars % 3 + 1 AS INTEGER) AS version
  FROM documents),
papers AS (
  SELECT CASE WHEN doc_id < 100000
              THEN strftime(day, '%y%m') || '.' || lpad(CAST(doc_id AS VARCHAR), 5, '0')
              ELSE 'x' || (doc_id // 10000000) || '/' || lpad(CAST(doc_id % 10000000 AS VARCHAR), 7, '0')
         END AS id,
         version, split_part(text, chr(10), 1) AS title, text AS abstract,
         CAST(day AS VARCHAR) || 'T00:00:00Z' AS published,
         CAST(day + (version - 1) * 30 AS VARCHAR) || 'T00:00:00Z' AS updated,
         ['Desk ' || source, 'Room & ' || lang] AS authors,
         CASE WHEN lang <> 'en' THEN ['cs.' || source, 'physics.' || lang] ELSE ['cs.' || source] END
           AS categories,
         'cs.' || source AS primary_category, '' AS comment,
         CASE WHEN lang = 'de' THEN '10.5555/' || doc_id ELSE '' END AS doi, '' AS journal_ref,
         'https://arxiv.org/abs/' || id || 'v' || version AS abs_url,
         'https://arxiv.org/pdf/' || id || 'v' || version AS pdf_url,
         substr(CAST(day AS VARCHAR), 1, 7) AS year_month,
         source <> 'src17' AS in_latest_search, doc_id, lang, source
  FROM dated)"""

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def words(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
    expanded = chained(f"lower({x})", [(k, f" {v} ") for k, v in fixed.QUERY_ALIASES])
    return (f"list_filter(regexp_extract_all({expanded}, '[a-z0-9]+'), "
            f"lambda w: NOT list_contains([{stops}], w))")


def tokens(x: str) -> str:
    irregular = " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in fixed.IRREGULAR_PLURALS)
    return (f"list_transform({words(x)}, lambda w: CASE {irregular} WHEN length(w) > 4 AND w LIKE '%s' "
            f"AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)")


def escape(x: str) -> str:
    return chained(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "&#124;"), ("[", "&#91;"),
                       ("]", "&#93;"), ("\n", " ")])


def topics(rules, abstract: str = "abstract") -> str:
    text = f"lower(title || ' ' || {abstract})"
    word = r"[^\pL\pN_]"
    cases = []
    for topic, _, terms in rules:
        if terms:
            tests = " OR ".join(
                f"regexp_matches({text}, '(^|{word})' || regexp_escape('{t}') || '($|{word})')" for t in terms)
            cases.append(f"CASE WHEN {tests} THEN '{topic}' END")
    found = f"list_filter([{', '.join(cases)}], lambda t: t IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['other'] END"


TERMS = sorted(set(q.QUERY.split()))


def bm25(where: str) -> str:
    """CTEs ``stats`` (per paper), ``corpus`` (one row) and ``hits`` (scored papers)."""
    counts, totals, score = [], [], []
    for i, t in enumerate(TERMS):
        counts.append(
            f"CAST(3 * len(list_filter(tt, lambda w: w = '{t}')) + len(list_filter(ta, lambda w: w = '{t}'))"
            f" AS INTEGER) AS tf_{i}, list_contains(tt, '{t}') AS in_title_{i}")
        totals.append(f"count(*) FILTER (tf_{i} > 0) AS df_{i}")
        idf = f"ln(1 + (n - df_{i} + 0.5::DOUBLE) / (df_{i} + 0.5::DOUBLE))"
        score.append(
            f"(CASE WHEN tf_{i} > 0 THEN {idf} * tf_{i} * 2.5::DOUBLE / (tf_{i} + 1.5::DOUBLE * "
            f"(0.25::DOUBLE + 0.75::DOUBLE * doc_length / avg_length)) ELSE 0.0::DOUBLE END"
            f" + CASE WHEN in_title_{i} THEN 2 * {idf} ELSE 0.0::DOUBLE END)")
    any_hit = " OR ".join(f"tf_{i} > 0" for i in range(len(TERMS)))
    return f"""
tokenised AS (
  SELECT *, {tokens('title')} AS tt, {tokens('abstract')} AS ta FROM papers WHERE {where}),
stats AS (
  SELECT *, CAST(3 * len(tt) + len(ta) AS INTEGER) AS doc_length, {', '.join(counts)} FROM tokenised),
corpus AS (SELECT count(*) AS n, avg(doc_length) AS avg_length, {', '.join(totals)} FROM stats),
hits AS (SELECT stats.*, {' + '.join(score)} AS score FROM stats, corpus WHERE {any_hit})"""


CURRENT = "in_latest_search"
RANKED = "row_number() OVER (ORDER BY score DESC, published DESC, id DESC)"


def ranked(where: str, limit: int) -> str:
    return f"""WITH {PAPERS}, {bm25(where)}
SELECT CAST({RANKED} AS INTEGER) AS rank, id, published, score FROM hits
ORDER BY score DESC, published DESC, id DESC LIMIT {limit}"""


def card(topic_column: str = "topics") -> str:
    label = fixed.CARD_LABELS
    parts = [
        lit("# "), escape("title"), lit("\n\n- arXiv: ["), "id || 'v' || version", lit("]("), "abs_url",
        lit(f")\n- {label['first']}: "), "year_month", lit(f"；{label['submitted']}: "), "published",
        lit(f"\n- {label['revised']}: "), "updated", lit(f"\n- {label['authors']}: "),
        escape("array_to_string(authors, '; ')"), lit(f"\n- {label['categories']}: "),
        "array_to_string(categories, ', ')", lit(f"\n- {label['current']}: "),
        "CASE WHEN in_latest_search THEN 'True' ELSE 'False' END", lit(f"\n- {label['topics']}: "),
        f"array_to_string({topic_column}, ', ')", lit("\n- PDF: "), "pdf_url", lit("\n- DOI: "),
        f"CASE WHEN doi = '' THEN '{label['no_doi']}' ELSE doi END",
        lit(f"\n\n## {label['abstract']}\n\n"), "abstract", lit(f"\n\n## {label['read_on']}\n\n"),
        lit(fixed.CARD_FETCH_HINT[0] + DEFAULT_COMMAND + " fetch "), "id",
        lit(fixed.CARD_FETCH_HINT[1] + "\n" + fixed.CARD_READ_HINT[0]),
        "replace(id, '/', '_') || '/' || replace(id, '/', '_') || 'v' || version",
        lit(fixed.CARD_READ_HINT[1] + "\n" + fixed.CARD_NOTICE + "\n")]
    return " || ".join(parts)


MEMBERS = f"""
routed AS (SELECT *, {topics(q.RULES)} AS topics FROM papers),
members AS (
  SELECT unnest(list_transform(topics, lambda t: 'topics/' || t) || ['years/' || left(year_month, 4)])
         AS grp, id, version, title, year_month, published
  FROM routed WHERE {CURRENT})"""
HEADING = ("CASE " + " ".join(f"WHEN grp = 'topics/{r[0]}' THEN '{r[1]}'" for r in q.RULES)
           + " ELSE split_part(grp, '/', 2) END")
PLACED = f"""{MEMBERS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY published DESC, id DESC) - 1 AS position
  FROM members),
paged AS (SELECT *, CAST(position // {q.PAGE_SIZE} + 1 AS BIGINT) AS page FROM placed),
menu AS (
  SELECT grp, page, CAST(count(*) AS INTEGER) AS papers, arg_min(year_month, position) AS first_month,
         arg_max(year_month, position) AS last_month
  FROM paged GROUP BY grp, page)"""
PAGE_NAME = "CASE WHEN page < 1000 THEN lpad(CAST(page AS VARCHAR), 3, '0') ELSE CAST(page AS VARCHAR) END"
SHARD_ROW = ("'| ' || year_month || ' | ' || id || 'v' || version || ' | [' || " + escape("title")
             + " || '](../../../cards/' || replace(id, '/', '_') || '.md) |'")

CSV_VALUES = {
    "arxiv_id": "id", "version": "CAST(version AS VARCHAR)", "year_month": "year_month",
    "title": "title", "abstract": "abstract", "published": "published", "updated": "updated",
    "categories": "array_to_string(categories, ';')", "url": "abs_url",
    "in_latest_search": "CASE WHEN in_latest_search THEN 'True' ELSE 'False' END"}


def csv_field(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '[,\"\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' "
            f"ELSE {x} END")


PAIR = """
old AS (
  SELECT * REPLACE ('c0' AS comment), 's1' AS first_seen, 's1' AS last_seen
  FROM papers WHERE primary_category <> 'cs.src3'),
incoming AS (
  SELECT * EXCLUDE (in_latest_search) REPLACE (
    CAST(CASE WHEN length(abstract) % 3 = 0 THEN version + 1
              WHEN length(abstract) % 11 = 0 THEN version - 1 ELSE version END AS INTEGER) AS version,
    CASE WHEN length(abstract) % 13 = 0 THEN 'c1' ELSE 'c0' END AS comment)
  FROM papers WHERE NOT list_contains(categories, 'physics.de'))"""
# All other incoming columns are equal for equal ids, except where the id is a text digest.
COMPARED = ["version", "title", "abstract", "published", "updated", "authors", "categories",
            "primary_category", "comment", "doi", "journal_ref", "abs_url", "pdf_url", "year_month"]
STATE = ("CASE WHEN n.id IS NULL THEN 'not_in_latest_search' WHEN o.id IS NULL THEN 'added' "
         "WHEN n.version < o.version OR (n.version = o.version AND n.updated < o.updated) OR ("
         + " AND ".join(f"n.{c} IS NOT DISTINCT FROM o.{c}" for c in COMPARED)
         + ") THEN 'unchanged' ELSE 'updated' END")
STALE = ("(o.id IS NOT NULL AND n.id IS NOT NULL AND "
         "(n.version < o.version OR (n.version = o.version AND n.updated < o.updated)))")
JOINED = f"""{PAIR},
joined AS (
  SELECT coalesce(n.id, o.id) AS id, {STATE} AS state, n.id IS NULL AS unseen,
         n.id IS NULL OR {STALE} AS keep, o.first_seen, o.last_seen,
         {', '.join(f'n.{c} AS n_{c}, o.{c} AS o_{c}' for c in ('version', 'title', 'updated', 'comment'))}
  FROM incoming n FULL OUTER JOIN old o ON n.id = o.id)"""
COUNTERS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in (
    "added", "updated", "unchanged", "not_in_latest_search"))
REPEATS = f"""{PAIR},
stored AS (
  SELECT sha256(abstract) AS key, arg_max(o, o.id) AS o FROM old o GROUP BY key),
copies AS (SELECT sha256(abstract) AS key, id AS seq, n FROM incoming n),
judged AS (
  SELECT c.key, c.seq, c.n AS n, s.o AS o, s.key IS NOT NULL AS known,
         s.key IS NOT NULL AND (n.version < o.version OR (n.version = o.version AND n.updated < o.updated))
           AS stale,
         {' AND '.join(f'n.{c} IS NOT DISTINCT FROM o.{c}' for c in COMPARED)} AS same
  FROM copies c LEFT JOIN stored s ON c.key = s.key),
states AS (
  SELECT CASE WHEN NOT known THEN 'added' WHEN stale OR same THEN 'unchanged' ELSE 'updated' END AS state
  FROM judged
  UNION ALL
  SELECT 'not_in_latest_search' FROM stored WHERE key NOT IN (SELECT key FROM copies)),
latest AS (
  SELECT key, arg_max(n, seq) FILTER (NOT stale) AS n, any_value(o) AS o, bool_or(known) AS known
  FROM judged GROUP BY key)"""

SCAN = f"""
placed AS (
  SELECT *, row_number() OVER (ORDER BY published DESC, id DESC) - 1 AS rank FROM papers),
entries AS (
  SELECT * REPLACE (sha256(abstract) AS id, substr(abstract, length(title) + 2) AS abstract),
         CAST(rank // {q.SCAN_PAGE} * {q.SCAN_PAGE} AS INTEGER) AS "offset"
  FROM placed),
pages AS (
  SELECT "offset",
         CAST({{total}} AS INTEGER) AS total,
         CAST({{start}} AS INTEGER) AS start,
         CAST(count(*) AS INTEGER) AS n_papers,
         {{error}} AS error
  FROM entries GROUP BY "offset"),
judged AS (
  SELECT "offset", total, CASE WHEN error IS NOT NULL THEN error
    WHEN total < 0 OR start < 0 THEN 'Invalid pagination values'
    WHEN total > 30000 THEN 'Search exceeds the API result window'
    WHEN start <> "offset" OR (n_papers = 0 AND "offset" < total) OR n_papers > {q.SCAN_PAGE}
      THEN 'Unexpected or empty page' END AS problem
  FROM pages)"""
SCAN = SCAN.format(total=q.SCAN_TOTAL_SQL, start=q.SCAN_START_SQL.replace("offset", '"offset"'), error=q.SCAN_ERROR_SQL)
IN_SCOPE = "len(list_filter(categories, lambda c: split_part(c, '.', 1) = 'physics')) > 0"
METADATA = ("CASE WHEN version IS NULL THEN 'Version missing' WHEN title = '' OR abstract = '' "
            "OR len(categories) = 0 THEN 'Incomplete metadata' "
            "WHEN try_cast(published AS TIMESTAMPTZ) IS NULL OR try_cast(updated AS TIMESTAMPTZ) IS NULL "
            "THEN 'Malformed timestamp' END")


def cut(rest: str, room: str) -> str:
    """The leading piece of ``rest`` that goes into ``room`` characters."""
    head = f"left({rest}, {room})"
    boundary = f"length(regexp_extract({head}, '(?s)^(.*)[ \\n]', 1))"
    return (f"CASE WHEN length({rest}) <= {room} THEN {rest} "
            f"WHEN {boundary} > ({room}) // 2 THEN left({rest}, {boundary}) ELSE {head} END")


def after(rest: str, piece: str) -> str:
    return f"regexp_replace(substr({rest}, length({piece}) + 1), '^{SPACE}+', '')"


BODY = ("'Source: ' || source_url || chr(10) || 'Chunk: ' || chunk_no || chr(10) || 'Section/page: ' || "
        "primary_category || chr(10) || chr(10) || piece || chr(10)")
CHUNKS = f"""
steps AS (
  SELECT id, version, title, abstract, primary_category,
         'https://arxiv.org/html/' || id || 'v' || version AS source_url, 1 AS chunk_no,
         {cut('abstract', str(q.CHUNK_CHARS))} AS piece, abstract AS rest
  FROM papers
  UNION ALL
  SELECT id, version, title, abstract, primary_category, source_url, chunk_no + 1,
         {cut('tail', str(q.CHUNK_CHARS))}, tail
  FROM (SELECT *, {after('rest', 'piece')} AS tail FROM steps) WHERE tail <> ''),
files AS (
  SELECT id, version, title, abstract, primary_category, source_url, chunk_no,
         'chunks/' || lpad(CAST(chunk_no AS VARCHAR), 4, '0') || '.md' AS path,
         CAST(length(piece) AS INTEGER) AS chars, {BODY} AS body, sha256({BODY}) AS sha256
  FROM steps)"""
STORED = f"""{CHUNKS},
stored AS (
  SELECT id, version, path, CASE WHEN primary_category = 'cs.src7' AND chars > 900 THEN upper(body)
                                 ELSE body END AS body
  FROM files WHERE NOT (primary_category = 'cs.src8' AND contains(body, ' ti '))),
checked AS (
  SELECT f.*, s.body AS kept, coalesce(sha256(s.body) = f.sha256, false) AS intact
  FROM files f LEFT JOIN stored s USING (id, version, path)),
states AS (SELECT id, version, bool_and(intact) AS valid FROM checked GROUP BY id, version)"""

TURNS = f"""
blocks AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text,
         CASE conv_id % 3 WHEN 0 THEN role WHEN 1 THEN 'Part | ' || (turn // 3)
                          ELSE repeat('Long | ', 30) || (turn // 3) END AS label
  FROM conversations WHERE text <> ''),
steps AS (
  SELECT conv_id, 1 AS n, k, label, 1 AS chunk_no, {cut('text', str(q.TURN_CHARS))} AS piece,
         length({cut('text', str(q.TURN_CHARS))}) AS size, text AS rest
  FROM blocks WHERE k = 1
  UNION ALL
  SELECT conv_id, n, k, label, chunk_no, {cut('rest', 'room')},
         {q.TURN_CHARS} - room + length({cut('rest', 'room')}), rest
  FROM (
    SELECT s.conv_id, s.n + 1 AS n, CASE WHEN tail <> '' THEN s.k ELSE b.k END AS k,
           CASE WHEN tail <> '' THEN s.label ELSE b.label END AS label,
           CASE WHEN tail <> '' THEN tail ELSE b.text END AS rest,
           CASE WHEN tail = '' AND b.label = s.label AND s.size + 2 < {q.TURN_CHARS} THEN s.chunk_no
                ELSE s.chunk_no + 1 END AS chunk_no,
           CASE WHEN tail = '' AND b.label = s.label AND s.size + 2 < {q.TURN_CHARS} THEN {q.TURN_CHARS} - s.size - 2
                ELSE {q.TURN_CHARS} END AS room
    FROM (SELECT *, {after('rest', 'piece')} AS tail FROM steps) s
    LEFT JOIN blocks b ON b.conv_id = s.conv_id AND b.k = s.k + 1 WHERE tail <> '' OR b.k IS NOT NULL)),
files AS (
  SELECT id, chunk_no, sections, CAST(length(t) AS INTEGER) AS chars, 'Source: https://example.org/' || id || chr(10)
         || 'Chunk: ' || chunk_no || chr(10) || 'Section/page: ' || sections || chr(10) || chr(10) || t || chr(10) AS body
  FROM (SELECT CAST(conv_id AS VARCHAR) AS id, chunk_no, any_value(label) AS sections,
               string_agg(piece, chr(10) || chr(10) ORDER BY n) AS t FROM steps GROUP BY conv_id, chunk_no))"""

BENCHMARK = f"""
lengths AS (SELECT id, published, {tokens('title')} AS tt, {tokens('abstract')} AS ta FROM papers WHERE in_latest_search),
corpus AS (SELECT count(*) AS n, avg(3 * len(tt) + len(ta)) AS avg_length FROM lengths),
occurrences AS (
  SELECT id, unnest(tt) AS term, 3 AS w, 1 AS t FROM lengths UNION ALL SELECT id, unnest(ta), 1, 0 FROM lengths),
counted AS (SELECT id, term, sum(w) AS tf, max(t) = 1 AS in_title FROM occurrences GROUP BY id, term),
asked AS (SELECT DISTINCT item_id, unnest({tokens('text')}) AS term FROM benchmark),
idfs AS (SELECT term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf
         FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus),
parts AS (
  SELECT item_id, id, term, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (
           0.25::DOUBLE + 0.75::DOUBLE * (3 * len(tt) + len(ta)) / avg_length))
         + CASE WHEN in_title THEN 2 * idf ELSE 0.0::DOUBLE END AS s, published
  FROM asked JOIN counted USING (term) JOIN idfs USING (term) JOIN lengths USING (id), corpus),
scores AS (SELECT item_id, id, published, list_reduce(list(s ORDER BY term), lambda a, b: a + b) AS score
           FROM parts GROUP BY item_id, id, published),
best AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, published DESC, id DESC) AS INTEGER) AS rank FROM scores) WHERE rank <= 12)"""

ARTICLES = r"""
articles AS (
  SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
halves AS (
  SELECT page_id, regexp_extract(body, '(?s)<h1>(.*?)</h1>(.*)', 1) AS h,
         regexp_extract(body, '(?s)<h1>(.*?)</h1>(.*)', 2) AS tail FROM articles),
texts AS (
  SELECT page_id, trim(ENT_H) AS label,
         array_to_string(list_filter(list_transform(
           string_split_regex(tail, '<[^>]*>'), lambda s: trim(ENT_S, chr(10) || ' ')),
           lambda s: s <> ''), ' ') AS text
  FROM halves),
usable AS (SELECT *, length(label) + 2 + length(text) >= 500 AS ok FROM texts)"""
ENTITIES = [("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")]


def unescaped(x: str) -> str:
    """Entities decoded; one that a cut headline left without its semicolon still counts."""
    for name, char in ENTITIES:
        x = f"regexp_replace({x}, '&{name}(;|$)', {lit(char)}, 'g')"
    return x


ARTICLES = ARTICLES.replace("ENT_H", unescaped("h")).replace("ENT_S", unescaped("s"))


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(p.strip() for p in parts) + "\n"


def _statements() -> dict[str, str]:
    p = with_(PAPERS)
    paper_version = "id || 'v' || version"
    csv_record = " || ',' || ".join(csv_field(CSV_VALUES[n]) for n in fixed.CSV_HEADER)
    term_columns = ", ".join(f"tf_{i}, in_title_{i}" for i in range(len(TERMS)))
    search_text = (
        "chr(10) || '- ' || id || 'v' || version || ' | ' || year_month || ' | ' || title || chr(10) || "
        "'  card: cards/' || replace(id, '/', '_') || '.md | score: ' || format('{:.2f}', score) || chr(10)"
        f" || '{fixed.SEARCH_ABSTRACT_LABEL}' || abstract || chr(10)")
    asked = r"""
asked AS (
  SELECT CASE WHEN lang = 'fr' THEN pdf_url || '.pdf'
              WHEN lang = 'de' THEN 'http://export.arxiv.org/html/' || id || 'v' || version
              WHEN lang = 'es' THEN ' ' || id || chr(10) ELSE abs_url END AS value FROM papers
  UNION ALL SELECT 'Math.GT/' || lpad(CAST(strlen(abstract) % 10000000 AS VARCHAR), 7, '0') || 'V' || (version + 10) FROM papers
  UNION ALL SELECT id || 'v1' || repeat('0', 17 + version) FROM papers
  UNION ALL SELECT url FROM pages)"""
    # Written from the published rule: the identifier without regard to case; a version of over 18 digits is none.
    bare = (r"regexp_replace(regexp_replace(trim(value, ' ' || chr(10)), "
            r"'^https?://(export\.)?arxiv\.org/(abs|pdf|html)/', ''), '\.pdf$', '')")
    shape = r"'^(\d{4}\.\d{4,5}|[a-z][a-z0-9.-]*/\d{7})(v([1-9]\d{0,17}))?$'"
    base = f"nullif(regexp_extract({bare}, {shape}, 1, 'i'), '')"
    number = f"nullif(regexp_extract({bare}, {shape}, 3, 'i'), '')"
    contents_head = (
        f"'# ' || title || {lit(chr(10) * 2 + 'arXiv: ')} || id || 'v' || version || {lit(chr(10) + 'Source: ')}"
        f" || source_url || " + lit(
            f"\nExtracted: {q.STAMP}\n\n{fixed.CONTENTS_NOTICE}\n\n## Extraction notes\n\n- note one\n- note two"
            f"\n\n## Chunks\n\n{fixed.CONTENTS_TABLE_HEAD}\n"))
    contents_row = ("'| [' || lpad(CAST(chunk_no AS VARCHAR), 4, '0') || '](' || path || ') | ' || "
                    "primary_category || ' | ' || chars || ' |'")
    told = (f"abstract || ' ' || [{', '.join(lit(s) for s in q.DEFAULT_PHRASES)}]"
            f"[strlen(abstract) % {len(q.DEFAULT_PHRASES)} + 1]")
    sql = {
        "clean_text": p + f"SELECT id, {clean('abstract')} AS cleaned FROM papers",
        "parse_ids": with_(PAPERS, asked) + f"""
SELECT value, {base} AS base, CAST({number} AS BIGINT) AS version,
       replace({base}, '/', '_') || coalesce('v' || {number}, '') AS safe FROM asked""",
        "year_months": p + """
SELECT id, CASE lang WHEN 'fr' THEN substr(published, 1, 4) || '-13' ELSE substr(published, 1, 7) END AS month,
       lang NOT IN ('fr', 'es') AS valid,
       split_part(categories[1], '.', 1) AS subject,
       CASE WHEN length(title) > 9999 THEN CAST(length(title) AS VARCHAR)
            ELSE lpad(CAST(length(title) AS VARCHAR), 4, '0') END AS padded FROM papers""",
        "token_lists": p + f"SELECT id, array_to_string({tokens('abstract')}, ' ') AS tokens FROM papers",
        "alias_expand": f"""
SELECT doc_id, array_to_string({tokens('phrase')}, ' ') AS tokens FROM (
  SELECT doc_id, CASE lang WHEN 'en' THEN '本体对齐 大语言模型' WHEN 'fr' THEN '大模型推理'
    WHEN 'de' THEN '知识图谱抽取' ELSE '分类体系的构建与评测综述' END || ' ' || text AS phrase FROM documents)""",
        "escape_titles": p + f"SELECT id, {escape('abstract')} AS escaped FROM papers",
        "term_stats": with_(PAPERS, bm25("true")) + f"SELECT id, doc_length, {term_columns} FROM stats",
        "corpus_stats": with_(PAPERS, bm25(CURRENT)) + "SELECT * FROM corpus",
        "bm25_search": ranked(CURRENT, 12),
        "bm25_scores": with_(PAPERS, bm25(CURRENT)) + "SELECT id, score FROM hits",
        "bm25_topic": ranked(f"{CURRENT} AND list_contains({topics(q.RULES)}, 'alignment')", 12),
        "bm25_year": ranked(f"{CURRENT} AND year_month LIKE '201%'", 12),
        "bm25_include_missing": ranked("true", 50),
        "bm25_indexed": ranked(f"{CURRENT} AND list_contains({topics(q.RULES)}, 'alignment')", 12),
        "search_budget": with_(PAPERS, bm25(CURRENT)) + f"""
, top AS (SELECT *, CAST({RANKED} AS INTEGER) AS rank FROM hits
          ORDER BY score DESC, published DESC, id DESC LIMIT 50),
blocks AS (SELECT rank, id, {search_text} AS block FROM top)
SELECT *, CAST({len(fixed.SEARCH_HEAD)} + sum(length(block)) OVER (ORDER BY rank) AS BIGINT) AS used,
       {len(fixed.SEARCH_HEAD)} + sum(length(block)) OVER (ORDER BY rank) <= 49900 AS shown FROM blocks""",
        "score_display": with_(PAPERS, bm25(CURRENT)) + "SELECT id, format('{:.2f}', score) AS shown FROM hits",
        "posting_lists": p + f"""
, terms AS (
  SELECT id, unnest({tokens('title')}) AS term, 3 AS weight, true AS t FROM papers
  UNION ALL SELECT id, unnest({tokens('abstract')}), 1, false FROM papers)
SELECT term, id, CAST(sum(weight) AS INTEGER) AS tf, bool_or(t) AS in_title FROM terms GROUP BY term, id""",
        "document_frequency": p + f"""
, terms AS (
  SELECT id, unnest({tokens('title')}) AS term, 3 AS weight FROM papers
  UNION ALL SELECT id, unnest({tokens('abstract')}), 1 FROM papers)
SELECT term, count(DISTINCT id) AS df, CAST(sum(weight) AS BIGINT) AS total_tf FROM terms GROUP BY term""",
        "topic_route": p + f"SELECT id, array_to_string({topics(q.RULES)}, ',') AS topics FROM papers",
        "topic_route_default": p + f"""
SELECT id, array_to_string({topics(fixed.TOPIC_RULES, told)}, ',') AS topics FROM papers""",
        "group_counts": with_(PAPERS, MEMBERS) + "SELECT grp, count(*) AS papers FROM members GROUP BY grp",
        "current_papers": p + f"SELECT id, version, year_month FROM papers WHERE {CURRENT}",
        "total_order": p + """
SELECT id, published, row_number() OVER (ORDER BY published DESC, id DESC) - 1 AS position FROM papers""",
        "running_length": p + """
SELECT primary_category, published, id, length(title) AS chars, CAST(sum(length(title)) OVER (
  PARTITION BY primary_category ORDER BY published DESC, id DESC) AS BIGINT) AS running_total FROM papers""",
        "shard_pages": with_(PAPERS, PLACED) + f"""
SELECT 'index/' || grp || '/' || {PAGE_NAME} || '.md' AS path,
       '# ' || {HEADING} || ' / ' || page || {lit(chr(10) * 2 + fixed.SHARD_TABLE_HEAD + chr(10))}
       || string_agg({SHARD_ROW}, chr(10) ORDER BY position) || chr(10) AS content
FROM paged GROUP BY grp, page""",
        "shard_menu": with_(PAPERS, PLACED) + "SELECT * FROM menu",
        "menu_text": with_(PAPERS, PLACED) + f"""
SELECT 'index/' || grp || '/README.md' AS path, CAST(0 AS BIGINT) AS line_no,
       '# ' || {HEADING} || chr(10) || chr(10) || sum(papers)
       || {lit(fixed.MENU_COUNT_LINE[0] + str(q.PAGE_SIZE) + fixed.MENU_COUNT_LINE[1] + chr(10) * 2)} AS text
FROM menu GROUP BY grp
UNION ALL
SELECT 'index/' || grp || '/README.md', page,
       {lit(fixed.MENU_PAGE_LINE[0])} || page || {lit(fixed.MENU_PAGE_LINE[1])} || {PAGE_NAME}
       || {lit(fixed.MENU_PAGE_LINE[2])} || first_month || {lit(fixed.MENU_PAGE_LINE[3])} || last_month || chr(10)
FROM menu""",
        "cards": with_(PAPERS, MEMBERS) + f"""
SELECT id, 'cards/' || replace(id, '/', '_') || '.md' AS path, {card()} AS content FROM routed""",
        "catalog_csv": p + "SELECT " + ", ".join(
            f"{CSV_VALUES[n]} AS {n}" for n in fixed.CSV_HEADER) + " FROM papers",
        "csv_text": p + f"SELECT id, {csv_record} || chr(13) || chr(10) AS text FROM papers",
        "show_budget": with_(PAPERS, MEMBERS) + f"""
, priced AS (SELECT id, published, length({card()}) + 1 AS cost FROM routed),
running AS (SELECT id, CAST(sum(cost) OVER (ORDER BY published DESC, id DESC) AS BIGINT) AS used FROM priced)
SELECT * FROM running WHERE used - 1 <= {100_000 - len(fixed.SHOW_OVERFLOW) - 1}""",
        "merge_catalog": with_(PAPERS, JOINED) + f"""
SELECT id, {', '.join(f'CASE WHEN keep THEN o_{c} ELSE n_{c} END AS {c}'
                      for c in ('version', 'title', 'updated', 'comment'))},
       coalesce(first_seen, '{q.STAMP}') AS first_seen,
       CASE WHEN unseen THEN last_seen ELSE '{q.STAMP}' END AS last_seen,
       NOT unseen AS in_latest_search, state FROM joined""",
        "merge_counts": with_(PAPERS, JOINED) + f"SELECT {COUNTERS} FROM joined",
        "merge_repeats": with_(PAPERS, REPEATS) + f"""
SELECT key AS id, coalesce(n.version, o.version) AS version, coalesce(n.updated, o.updated) AS updated,
       coalesce(n.comment, o.comment) AS comment, CASE WHEN known THEN o.first_seen ELSE '{q.STAMP}' END AS first_seen,
       '{q.STAMP}' AS last_seen, true AS in_latest_search FROM latest
UNION ALL
SELECT key, o.version, o.updated, o.comment, o.first_seen, o.last_seen, false FROM stored
WHERE key NOT IN (SELECT key FROM copies)""",
        "merge_repeat_counts": with_(PAPERS, REPEATS) + f"SELECT {COUNTERS} FROM states",
        "page_validation": with_(PAPERS, SCAN) + 'SELECT "offset", problem FROM judged WHERE problem IS NOT NULL',
        "scan_validation": with_(PAPERS, SCAN) + f"""
, page_side AS (
  SELECT count(*) AS pages, count(problem) AS bad_pages, min(total) = max(total) AS total_is_stable,
         max(total) AS total FROM judged),
by_id AS (
  SELECT id, count(*) AS copies, count({METADATA}) AS incomplete,
         count(*) FILTER (NOT ({IN_SCOPE})) AS out_of_scope FROM entries GROUP BY id),
entry_side AS (
  SELECT count(*) AS unique_ids, count(*) FILTER (copies > 1) AS duplicate_ids,
         CAST(sum(incomplete) AS BIGINT) AS incomplete, CAST(sum(out_of_scope) AS BIGINT) AS out_of_scope
  FROM by_id)
SELECT page_side.*, entry_side.*, unique_ids = total AS unique_matches_total FROM page_side, entry_side""",
        "dup_across_pages": with_(PAPERS, SCAN) + """
SELECT id, count(*) AS copies FROM entries GROUP BY id HAVING count(*) > 1""",
        "scope_check": p + f"SELECT id, primary_category FROM papers WHERE NOT ({IN_SCOPE})",
        "mandatory_fields": p + f"""
SELECT id, {METADATA} AS problem FROM (
  SELECT * REPLACE (substr(abstract, length(title) + 2) AS abstract) FROM papers)""",
        "feed_parse": p + f"""
, placed AS (SELECT *, row_number() OVER (ORDER BY published DESC, id DESC) - 1 AS rank FROM papers)
SELECT CAST(rank // {q.SCAN_PAGE} * {q.SCAN_PAGE} AS INTEGER) AS "offset",
       CAST(rank % {q.SCAN_PAGE} AS INTEGER) AS position, id, version, {clean('title')} AS title,
       {clean('abstract')} AS abstract, published, updated, array_to_string(authors, ';') AS authors,
       array_to_string(list_sort(categories), ';') AS categories, primary_category, comment, doi,
       journal_ref, abs_url, pdf_url, year_month FROM placed""",
        "feed_pages_parsed": f"""
SELECT CAST(p * {q.SCAN_PAGE} AS INTEGER) AS "offset", CAST(n AS INTEGER) AS total,
       CAST(p * {q.SCAN_PAGE} AS INTEGER) AS start,
       CAST(least({q.SCAN_PAGE}, n - p * {q.SCAN_PAGE}) AS INTEGER) AS n_papers, CAST(NULL AS VARCHAR) AS error
FROM (SELECT n, unnest(range((n + {q.SCAN_PAGE} - 1) // {q.SCAN_PAGE})) AS p
      FROM (SELECT count(*) AS n FROM documents))""",
        "lookup_ids": p + """
, asked AS (
  SELECT CASE WHEN primary_category < 'cs.src2' THEN 'https://arxiv.org/abs/' || id || 'v2' ELSE abs_url END
         AS value, CAST(strlen(abstract) AS BIGINT) AS position, id,
         CASE WHEN primary_category < 'cs.src2' THEN 2 ELSE version END AS wanted
  FROM papers JOIN labels USING (doc_id)
  UNION ALL SELECT url, page_id, NULL, NULL FROM pages
  UNION ALL SELECT '9912.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0'), page_id,
         '9912.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0'), NULL FROM pages),
known AS (SELECT id, version, title FROM papers)
SELECT value, position, a.id AS id, k.version AS version, k.title AS title,
       CASE WHEN a.id IS NULL THEN 'invalid identifier' WHEN k.id IS NULL THEN 'not in this catalog'
            WHEN wanted <> k.version THEN 'catalog describes another version' END AS problem
FROM asked a LEFT JOIN known k ON a.id = k.id""",
        "status_counts": p + f"""
, cached AS (
  SELECT DISTINCT id, CASE WHEN primary_category < 'cs.src2' THEN 2 ELSE version END AS version
  FROM papers JOIN labels USING (doc_id))
SELECT count(*) AS papers_stored, count(*) FILTER (in_latest_search) AS papers_in_latest_search,
       count(*) FILTER (in_latest_search AND c.id IS NOT NULL) AS current_fulltexts_cached
FROM papers p LEFT JOIN cached c ON p.id = c.id AND p.version = c.version""",
        "chunks": with_(PAPERS, CHUNKS, recursive=True) + """
SELECT id, version, chunk_no, path, primary_category AS sections, chars, body, sha256 FROM files""",
        "manifest": with_(PAPERS, CHUNKS, recursive=True) + f"""
SELECT id, version, {contents_head} || string_agg({contents_row}, chr(10) ORDER BY chunk_no) || chr(10) AS contents,
       source_url, '{q.STAMP}' AS fetched_at, sha256(abstract) AS source_sha256,
       CAST(count(*) AS INTEGER) AS n_chunks, string_agg(path, ' ' ORDER BY chunk_no) AS paths,
       string_agg(sha256, ' ' ORDER BY chunk_no) AS hashes,
       string_agg(CAST(chars AS VARCHAR), ' ' ORDER BY chunk_no) AS sizes
FROM files GROUP BY id, version, title, abstract, source_url""",
        "cache_valid": with_(PAPERS, STORED, recursive=True) + "SELECT * FROM states",
        "cache_missing": with_(PAPERS, STORED, recursive=True) + """
SELECT id, version FROM papers WHERE (id, version) NOT IN (SELECT (id, version) FROM states WHERE valid)""",
        "cached_current": with_(PAPERS, CHUNKS, recursive=True) + f"""
SELECT id, version FROM papers WHERE {CURRENT} AND (id, version) IN (SELECT (id, version) FROM files)""",
        "bm25_segments": ranked(CURRENT, 12),
        "bm25_blocks": ranked(CURRENT, 12),
        "bm25_benchmark": with_(PAPERS, BENCHMARK) + "SELECT item_id, rank, id, published, score FROM best",
        "benchmark_budget": with_(PAPERS, BENCHMARK) + f"""
, blocks AS (SELECT item_id, rank, id, length({search_text.replace(
    f" || '{fixed.SEARCH_ABSTRACT_LABEL}' || abstract || chr(10)", '')}) AS length FROM best JOIN papers USING (id)),
running AS (SELECT item_id, rank, id,
  CAST({len(fixed.SEARCH_HEAD)} + sum(length) OVER (PARTITION BY item_id ORDER BY rank) AS BIGINT) AS used FROM blocks)
SELECT *, used <= 1400 AS shown FROM running""",
        "topic_rules_table": p + f"SELECT id, array_to_string({topics(q.RULES)}, ',') AS topics FROM papers",
        "topic_many_rules": p + r"""
, rules AS (
  SELECT term, min(doc_id) AS position FROM (
    SELECT doc_id, regexp_extract(lower(text), '[\pL\pN_]+[^\pL\pN_]+[\pL\pN_]+') AS term FROM documents)
  WHERE term <> '' GROUP BY term),
texts AS (SELECT id, regexp_replace(lower(title || ' ' || abstract), '^[^\pL\pN_]+', '') || ' ' AS t FROM papers),
split AS (SELECT id, regexp_extract_all(t, '[\pL\pN_]+') AS w, regexp_extract_all(t, '[^\pL\pN_]+') AS g FROM texts),
grams AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || g[i] || w[i + 1])) AS term FROM split),
found AS (SELECT id, position FROM grams JOIN rules USING (term))
SELECT id, coalesce(string_agg('t' || position, ',' ORDER BY position), 'other') AS topics
FROM texts LEFT JOIN found USING (id) GROUP BY id""",
        "conversation_chunks": with_(TURNS, recursive=True) + """
SELECT id, chunk_no, sections, chars, body, sha256(body) AS sha256 FROM files""",
        "conversation_contents": with_(TURNS, recursive=True) + f"""
SELECT id, '# Conversation ' || id || {lit(chr(10) * 2 + 'arXiv: ')} || id || 'v1' || {lit(chr(10) + 'Source: ')}
  || 'https://example.org/' || id || {lit(
      f"{chr(10)}Extracted: {q.STAMP}{chr(10) * 2}{fixed.CONTENTS_NOTICE}{chr(10) * 2}## Extraction notes{chr(10) * 2}"
      f"- turns in order{chr(10) * 2}## Chunks{chr(10) * 2}{fixed.CONTENTS_TABLE_HEAD}{chr(10)}")}
  || string_agg('| [' || lpad(CAST(chunk_no AS VARCHAR), 4, '0') || '](chunks/' || lpad(CAST(chunk_no AS VARCHAR), 4, '0')
     || '.md) | ' || replace(left(sections, 160), '|', '&#124;') || ' | ' || chars || ' |', chr(10) ORDER BY chunk_no)
  || chr(10) AS contents
FROM files GROUP BY id""",
        "read_chunk": with_(PAPERS, STORED, recursive=True) + f"""
, counts AS (SELECT id, version, count(*) AS n FROM files GROUP BY id, version),
wanted AS (
  SELECT id, version, n, CASE WHEN lang = 'fr' THEN 2 WHEN lang = 'de' THEN 0 ELSE 1 END AS chunk_no
  FROM papers JOIN counts USING (id, version)),
found AS (
  SELECT w.*, kept, CASE WHEN w.chunk_no < 1 OR w.chunk_no > n THEN 'chunk must be between 1 and ' || n
                         WHEN NOT intact THEN 'cache missing or corrupt' END AS problem
  FROM wanted w LEFT JOIN checked c USING (id, version, chunk_no))
SELECT id, version, chunk_no, CASE WHEN problem IS NULL THEN
         CASE WHEN length(kept) > {q.READ_CHARS}
              THEN left(kept, {q.READ_CHARS - len(fixed.READ_OVERFLOW)}) || {lit(fixed.READ_OVERFLOW)}
              ELSE kept END END AS text, problem FROM found""",
        "html_block_rows": with_(ARTICLES) + """
SELECT page_id, CAST(NULL AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS text,
       'HTML text is implausibly short for a full text' AS error FROM usable WHERE NOT ok
UNION ALL SELECT page_id, 0, label, '# ' || label, NULL FROM usable WHERE ok
UNION ALL SELECT page_id, 1, label, text, NULL FROM usable WHERE ok AND text <> ''""",
        "html_chunk_rows": with_(ARTICLES, f"""
steps AS (
  SELECT page_id, 0 AS pos, label, text AS rest, {cut('text', f'({q.CHUNK_CHARS} - 4 - length(label))')} AS piece,
         '# ' || label || chr(10) || chr(10) AS lead
  FROM usable WHERE ok
  UNION ALL
  SELECT page_id, pos + 1, label, tail, {cut('tail', str(q.CHUNK_CHARS))}, ''
  FROM (SELECT *, {after('rest', 'piece')} AS tail FROM steps) WHERE tail <> '')""", recursive=True) + """
SELECT page_id, pos, label AS sections, lead || piece AS text FROM steps""",
        "scan_stream": f"""
WITH placed AS (
  SELECT source AS scan, sha256(text) AS id, n_chars, count(*) OVER (PARTITION BY source) AS size,
         (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {q.STREAM_PAGE} AS page,
         coalesce(try_cast(substr(source, 4) AS BIGINT), 0) * 60 AS begun FROM documents),
landed AS (
  SELECT scan, page, begun, max(n_chars) AS longest, count(*) AS papers, begun + {q.STREAM_MINUTES} * (page + 1) AS minute,
         max(size) + CASE WHEN max(n_chars) % 11 = 0 THEN 1 ELSE 0 END AS total
  FROM placed GROUP BY scan, page, begun HAVING max(n_chars) % 7 > 0),
timely AS (SELECT * FROM landed WHERE minute < begun + 360),
scans AS (
  SELECT scan, any_value(begun) AS begun, CAST(sum(papers) AS BIGINT) AS n, max(total) AS total, min(total) AS low,
         list(page) AS pages, max(page * {q.STREAM_PAGE} + papers) AS reach FROM timely GROUP BY scan),
judged AS (
  SELECT *, list_filter(range(0, total // {q.STREAM_PAGE} + 2), lambda p: NOT list_contains(pages, p))[1]
            * {q.STREAM_PAGE} AS missing FROM scans)
SELECT scan, CASE WHEN low < total THEN 'drift' WHEN n = total THEN 'complete' ELSE 'expired' END AS kind, '' AS id, n, total,
       CASE WHEN n < total THEN least(missing, CASE WHEN missing > reach THEN reach ELSE missing END) END AS first_gap
FROM judged WHERE n = total OR begun + 360 <= (SELECT max(minute) - 10 FROM landed)
UNION ALL
SELECT scan, 'repeated', id, count(*), NULL, NULL
FROM placed JOIN timely USING (scan, page) GROUP BY scan, id HAVING count(*) > 1""",
        "stream_merge": """
SELECT CAST(user_id AS VARCHAR) AS id, 1 AS version, max(stamp) AS updated,
       arg_max(event_type, stamp) AS event_type, arg_max(value, stamp) AS value, true AS in_latest_search
FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '#' || lpad(CAST(event_id AS VARCHAR), 20, '0') AS stamp
      FROM events) GROUP BY user_id
UNION ALL
SELECT 'stored-' || user_id, 1, '', 'none', NULL, user_id % 2 = 0
FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 = 0)""",
    }
    return sql


ORACLE: dict[str, str] = _statements()
