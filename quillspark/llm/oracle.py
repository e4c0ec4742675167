"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SUBSTRING = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM docs WHERE len(ws) >= 35),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM places),
repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM windows SEMI JOIN repeated USING (g)),
words AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS w FROM docs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _em(rules: dict[str, int], steps: int) -> str:
    """The steps of expectation-maximisation as one table each; rules: name to the vote that it can cast."""
    tables = [f"m0 AS (SELECT {', '.join(f'CAST(0.8 AS DOUBLE) AS {n}' for n in rules)})"]
    for k in range(1, steps + 1):
        odds = " + ".join(f"v.{n} * ln(m.{n} / (1 - m.{n}))" for n in rules)
        new = ", ".join(
            f"coalesce(greatest(0.55, least(0.99, sum(CASE WHEN v_{n} = {vote} THEN c * {'p' if vote > 0 else '(1 - p)'} END)"
            f" / sum(CASE WHEN v_{n} <> 0 THEN c END))), max(m_{n})) AS {n}" for n, vote in rules.items())
        columns = ", ".join(f"v.{n} AS v_{n}, m.{n} AS m_{n}" for n in rules)
        tables.append(f"m{k} AS (SELECT {new} FROM (SELECT c, 1 / (1 + exp(-({odds}))) AS p, {columns}"
                      f" FROM patterns v CROSS JOIN m{k - 1} m))")
    return ",\n".join(tables)


_VOTES = {"symbols": -1, "bangs": -1, "capitals": -1, "repeats": -1, "lines": -1, "sentences": 1, "varied": 1}
_ODDS = " + ".join(f"r.{n} * ln(m.{n} / (1 - m.{n}))" for n in _VOTES)

RULES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
    SELECT doc_id, i, ws[i:i + 2] AS g FROM (
        SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM docs WHERE len(ws) >= 3))),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
          FROM docs),
counts AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(ls) AS n_lines, length(regexp_replace(d.t, '[^.,]', '', 'g')) AS n_stops,
    length(regexp_replace(d.t, '[^!]', '', 'g')) AS n_bangs,
    length(regexp_replace(d.t, '\P{{Lu}}', '', 'g')) AS n_capitals
    FROM docs d JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id),
shares AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbol, n_bangs / greatest(n_words, 1) AS bang,
    n_capitals / greatest(word_chars, 1) AS capital, n_repeat_words / greatest(n_words, 1) AS repeated,
    n_stops / greatest(n_words, 1) AS stops FROM counts),
calm AS (SELECT *, symbol < 0.02 AND bang < 0.01 AND capital < 0.15 AS calm FROM shares),
r AS (SELECT *, CASE WHEN symbol > 0.08 THEN -1 ELSE 0 END AS symbols, CASE WHEN bang > 0.05 THEN -1 ELSE 0 END AS bangs,
    CASE WHEN capital > 0.2 THEN -1 ELSE 0 END AS capitals, CASE WHEN repeated > 0.3 THEN -1 ELSE 0 END AS repeats,
    CASE WHEN n_dup_lines > 2 AND n_dup_lines > 0.2 * n_lines THEN -1 ELSE 0 END AS lines,
    CASE WHEN calm AND stops > 0.02 AND stops < 0.6 THEN 1 ELSE 0 END AS sentences,
    CASE WHEN calm AND repeated < 0.1 AND n_dup_lines <= 1 THEN 1 ELSE 0 END AS varied FROM calm),
patterns AS (SELECT {', '.join(_VOTES)}, count(*) AS c FROM r GROUP BY ALL),
{_em(_VOTES, 10)},
verdict AS (SELECT r.*, 1 / (1 + exp(-({_ODDS}))) AS p,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM r CROSS JOIN m10 m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
       NOT failed AND p >= 0.5 AS kept, round(p, 6) AS p_good
FROM verdict
"""


def _level(depth: int, path: Sequence[str]) -> str:
    """Each parent's budget split among its children at one depth, fullest first."""
    names, parent = ", ".join(path[:depth]), ", ".join(path[:depth - 1])
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"ORDER BY c / w, {path[depth - 1]}"
    using = f"USING ({names})"
    return f"""
l{depth} AS (SELECT {names}, sum(cap) AS c, max(greatest(w{depth}, 1)) AS w, max(g{depth - 1}) AS g FROM t{depth - 1}
    GROUP BY {names}),
o{depth} AS (SELECT *, coalesce(sum(c) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS spent, sum(w) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM l{depth}),
f{depth} AS (SELECT *, greatest(g - spent, 0) * w // rest >= c AS filled FROM o{depth}),
b{depth} AS (SELECT {parent + ',' if parent else ''} min(spent) AS spent, arg_min(rest, spent) AS rest FROM f{depth}
    WHERE NOT filled {'GROUP BY ' + parent if parent else ''}),
s{depth} AS (SELECT {names}, CASE WHEN filled THEN c ELSE least(c, greatest(g - b.spent, 0) * w // b.rest) END AS g{depth}
    FROM f{depth} f LEFT JOIN b{depth} b {'USING (' + parent + ')' if parent else 'ON true'}),
t{depth} AS (SELECT * FROM t{depth - 1} JOIN s{depth} {using})"""


def mixture(path: Sequence[str], domains: Sequence[str], weights: Sequence[tuple], share: float, epochs: int,
            seed: int) -> str:
    def weight(depth: int) -> str:
        cases = []
        for *node, w in weights:
            if node[depth - 1] is not None and (depth == len(path) or node[depth] is None):
                test = " AND ".join(f"{c} = '{v}'" for c, v in zip(path[:depth], node))
                cases.append(f"WHEN {test} THEN {w}")
        return f"CASE {' '.join(cases)} ELSE 1 END AS w{depth}" if cases else f"1 AS w{depth}"

    names = ", ".join(path)
    listed = ", ".join(f"'{d}'" for d in domains)
    return rf"""
WITH docs AS (SELECT doc_id, [{listed}][CAST(coalesce(TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT), 0)
        % {len(domains)} AS BIGINT) + 1] AS domain, lang, source, CAST(len({_WORDS}) AS BIGINT) AS n_tokens
    FROM documents),
budget AS (SELECT CAST(floor(sum(n_tokens) * CAST({share} AS DOUBLE)) AS BIGINT) AS b FROM docs),
leaves AS (SELECT {names}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY {names}),
t0 AS (SELECT *, tokens * {epochs} AS cap, {', '.join(weight(d + 1) for d in range(len(path)))},
    (SELECT b FROM budget) AS g0 FROM leaves),
{','.join(_level(d + 1, path) for d in range(len(path)))},
q AS (SELECT {names}, tokens AS leaf_tokens, CAST(g{len(path)} AS BIGINT) AS quota,
    CASE WHEN tokens > 0 THEN CAST(g{len(path)} // tokens AS BIGINT) ELSE 0 END AS epochs FROM t{len(path)}),
dealt AS (SELECT *, CAST('0x' || substr(md5(concat({seed}, ':', epochs, ':', doc_id)), 1, 15) AS BIGINT) AS o
    FROM docs JOIN q USING ({names})),
running AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {names} ORDER BY o, doc_id, n_tokens
    ROWS UNBOUNDED PRECEDING) - n_tokens AS begins FROM dealt)
SELECT doc_id, {names}, n_tokens, leaf_tokens, quota,
    CAST(epochs + CASE WHEN begins < quota - epochs * leaf_tokens THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM running
"""


FILTER_AUDIT = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (
  SELECT doc_id, part, [
    len(w) < 200,
    100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS failed FROM split),
marked AS (
  SELECT part, failed, coalesce(max(l.quality) = 1, false) AS good, coalesce(max(l.toxic) = 1, false) AS toxic
  FROM (SELECT row_number() OVER () AS n, * FROM judged) j LEFT JOIN labels l USING (doc_id) GROUP BY n, part, failed),
cells AS (
  SELECT part, failed, count(*) AS documents, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM marked GROUP BY part, failed),
letters AS (SELECT unnest(string_split('ABCDE', '')) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
seen AS (
  SELECT part, filter_order, step, documents, good, toxic, failed,
         failed[instr('ABCDE', substr(filter_order, step, 1))] AS own,
         len(list_filter(range(1, step), lambda i: failed[instr('ABCDE', substr(filter_order, i, 1))])) > 0 AS gone
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step,
         coalesce(sum(documents) FILTER (NOT own AND NOT gone), 0) AS kept,
         coalesce(sum(documents) FILTER (own AND NOT gone), 0) AS removed,
         coalesce(sum(documents) FILTER (own AND gone), 0) AS redundant,
         coalesce(sum(documents) FILTER (own AND len(list_filter(failed, lambda f: f)) = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (own AND NOT gone), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM counted"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digits(text: str) -> str:
    """The list of values of the hex digits of a text."""
    return (f"list_transform(range(1, length({text}) + 1), "
            f"lambda k: CAST(instr('0123456789abcdef', lower(substr({text}, k, 1))) - 1 AS BIGINT))")


def importance(buckets: int, percent: int, least_words: int, seed: str) -> str:
    """Runs of one word; the checksum is taken byte by byte, for each distinct word."""
    found = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    bytes_ = "list_transform(range(1, len(h) // 2 + 1), lambda k: h[2 * k - 1] * 16 + h[2 * k])"
    step = "xor(c >> 8, steps[(xor(c, b) & 255) + 1])"
    return f"""
WITH bit_steps AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
docs AS (SELECT row_number() OVER () AS n, doc_id, {found} AS ws FROM documents),
source_words AS (SELECT n, unnest(ws) AS w FROM docs),
target_words AS (SELECT unnest({found}) AS w FROM benchmark),
vocabulary AS (SELECT w, {_digits('hex(w)')} AS h FROM (
  SELECT w FROM source_words UNION SELECT w FROM target_words)),
sums AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: {step}), 4294967295)
         % {buckets} AS b
  FROM vocabulary, bit_steps),
s AS (SELECT b, count(*) AS s FROM source_words JOIN sums USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM target_words JOIN sums USING (w) GROUP BY b),
gained AS (
  SELECT w, CAST(floor(1000 * ln(
    (coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {buckets})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM t) + {buckets})::DOUBLE))) AS BIGINT) AS gain
  FROM sums LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (SELECT n, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
            FROM source_words JOIN gained USING (w) GROUP BY n),
drawn AS (
  SELECT n, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         list_reduce({_digits(f"substr(sha256('{seed}:' || doc_id), 1, 8)")}, lambda a, b: a * 16 + b) AS h
  FROM docs LEFT JOIN weights USING (n)),
scored AS (
  SELECT doc_id, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score,
         n_features >= {least_words} AS usable FROM drawn),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY usable ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (usable) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN usable AND place <= {percent} * n // 100 THEN place END AS rank
FROM placed"""
