"""DuckDB twins of the queries that SQL can express, over the same tables."""

from __future__ import annotations

import string

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def near_duplicates(k: int, percent: int) -> str:
    """op2: all pairs that share a shingle, then reachability."""
    run = f"array_to_string(w[i:i + {k - 1}], chr(1))"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {run} AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * m >= {percent} * (na.n + nb.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""


def decontaminated(size: int) -> str:
    """op7: every window of every item against every run of a document's words of its length."""
    words = f"regexp_extract_all({LOWER}, '{PLAIN}')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {size}) AS k, array_to_string(w[i:i + least(len(w), {size}) - 1], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
runs AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT r.doc_id, r.i, r.k, win.item FROM runs r JOIN win ON r.k = win.k AND r.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""


def nearest(k: int, scale: int) -> str:
    """op8: every query against every other row."""
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
o AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= {k}"""


def conversations() -> str:
    """op10: digests straight from the rows; lengths from the template's marks and the control strings to escape."""
    control = r"([\[<])(\\*)(/?INST\]|ASST\]|/?SYS\]|/?ROLE\]|/TURN\]|/?s>|\|[a-z_]{1,40}\|>)"
    count = lambda c: f"len(regexp_extract_all({c}, '{control}'))"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
l AS (SELECT *, len(text) + {count('text')} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 12 WHEN 'system' THEN 13
             ELSE 23 + len(role) + {count('role')} END AS n,
             CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(len(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars FROM l GROUP BY conv_id"""


def mixture(domains: dict, weights: dict, epochs: int, seed: int, budget: str) -> str:
    """op1: the same water-filling by levels, and one running sum per leaf."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    domain = "CASE " + " ".join(f"WHEN source IN ({quoted(s)}) THEN '{d}'" for d, s in domains.items()) + " ELSE 'other' END"

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in weights.get(level, {}).items())
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    def filled(name: str, parent: str, keys: list[str], level: str) -> str:
        here = ", ".join([*keys, level])
        part = ", ".join(["root", *keys])
        order = f"PARTITION BY {part} ORDER BY CAST(cap AS HUGEINT) * 1000000000 // w, cap, {level}"
        return f"""
{name}_c AS (SELECT 0 AS root, {here}, sum(cap) AS cap, CAST({weight(level)} AS HUGEINT) AS w FROM leaf GROUP BY {here}),
{name}_b AS (SELECT c.*, p.budget FROM {name}_c c JOIN {parent} p USING ({part})),
{name}_r AS (SELECT *, budget - coalesce(sum(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                    sum(w) OVER (PARTITION BY {part}) - coalesce(sum(w) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest,
                    row_number() OVER x AS nth FROM {name}_b WINDOW x AS ({order})),
{name}_s AS (SELECT *, min(CASE WHEN NOT (rest > 0 AND cap * w_rest <= rest * w) THEN nth END) OVER (PARTITION BY {part}) AS stop FROM {name}_r),
{name}_l AS (SELECT *, max(CASE WHEN nth = stop THEN rest END) OVER (PARTITION BY {part}) AS rest_at,
                    max(CASE WHEN nth = stop THEN w_rest END) OVER (PARTITION BY {part}) AS w_at FROM {name}_s),
{name} AS (SELECT root, {here}, CAST(CASE WHEN stop IS NULL OR nth < stop THEN cap ELSE greatest(rest_at, 0) * w // w_at END AS HUGEINT) AS budget
           FROM {name}_l)"""

    return f"""
WITH d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, 'null') AS lang, coalesce(source, 'null') AS source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS n_words FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_words) AS HUGEINT) AS words, CAST(sum(n_words) * {epochs} AS HUGEINT) AS cap FROM d WHERE n_words > 0 GROUP BY ALL),
total AS (SELECT 0 AS root, least(sum(cap), {budget.replace(' div ', ' // ')}) AS budget FROM leaf),
{filled('a', 'total', [], 'domain')}, {filled('b', 'a', ['domain'], 'lang')}, {filled('c', 'b', ['domain', 'lang'], 'source')},
g AS (SELECT d.*, c.budget // leaf.words AS full_epochs, c.budget % leaf.words AS rest
      FROM d JOIN leaf USING (domain, lang, source) JOIN c USING (domain, lang, source) WHERE n_words > 0),
k AS (SELECT *, md5('{seed}:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM g),
r AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY domain, lang, source ORDER BY key, n_words
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
p AS (SELECT *, greatest(0, least(n_words, rest - start)) AS part FROM r)
SELECT doc_id, domain, lang, source, n_words, CAST(full_epochs AS BIGINT) AS full_epochs, CAST(part AS BIGINT) AS part_words,
       CAST(n_words * full_epochs + part AS BIGINT) AS taken_words FROM p WHERE n_words * full_epochs + part > 0"""


def filtered_urls(rules: list[tuple[str, str]]) -> str:
    """op12: every rule against every url."""
    rows = ", ".join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{v}')" for r, v in rules)
    return f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rule(rule, rule_host, rule_path, verdict) AS (VALUES {rows}),
fit AS (SELECT u.r, arg_max(rule.rule, length(rule.rule)) AS rule, arg_max(rule.verdict, length(rule.rule)) AS verdict FROM u JOIN rule
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT page_id, host, path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (r)"""


def ranked(top: int, norm: int) -> str:
    """op13: every document that shares a term with an item."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '{term}') AS w FROM documents),
n AS (SELECT r, doc_id, CAST(len(w) AS HUGEINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS nn, sum(n) AS ll FROM n),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
item AS (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{term}')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t, nn),
m AS (SELECT r, doc_id, CAST({100 - norm} + ({norm} * n * nn) // ll AS BIGINT) AS m FROM n, total),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM item JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
      FROM s JOIN n USING (r) WHERE score > 0)
SELECT * FROM k WHERE rank <= {top}"""


def repaired() -> str:
    """op11: crc32 by bits, and the least (cost, audit) of every state line by line."""
    crc = ("xor(list_reduce(list_transform(range(length(k)), lambda i: CAST(ascii(k[i + 1]) AS BIGINT)), lambda c, b: "
           "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295), 4294967295)")
    blank = r"[\x20\x09-\x0D]"
    # (from state, initial, to state)
    steps = "(VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3))"
    # up to two insertions lead from a state to any state that one line more can't reach for less
    inserts = ("(VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, 'u'), (1, 2, 1, 'u'), (3, 2, 1, 'u'), (2, 3, 1, 'a'), "
               "(0, 3, 2, 'ua'), (1, 3, 2, 'ua'))")
    name = lambda c: f"CASE {c} WHEN 'u' THEN 'user' ELSE 'assistant' END"
    return f"""
WITH RECURSIVE step(f, x, t) AS {steps}, ins(f, t, n, xs) AS {inserts},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
z AS (SELECT * EXCLUDE (k), {crc} % 20 AS kind FROM c),
g AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS before,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
             regexp_replace(text, '{blank}+$', '') AS body FROM g),
l AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault FROM o),
ends AS (SELECT c, max(i) AS n FROM l GROUP BY c),
e AS (SELECT c, i, f, t, 3 AS cost, 'D' AS letter, NULL AS line FROM l, (SELECT f, f AS t FROM (VALUES (0), (1), (2), (3)) s(f))
      UNION ALL SELECT c, i, f, t, CASE fault WHEN 't' THEN 1 ELSE 0 END, 'K', role || ':' || text FROM l JOIN step ON left(role, 1) = x WHERE fault IN ('t', '-')
      UNION ALL SELECT c, i, f, t, CASE fault WHEN 't' THEN 3 ELSE 2 END, 'R', {name('x')} || ':' || text FROM l JOIN step ON x <> 's' WHERE fault IN ('t', '-')),
dp AS (
  SELECT c, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'out': CAST([] AS VARCHAR[])}} AS v FROM ends
  UNION ALL
  SELECT c, i, q, min(v) FROM (
    SELECT dp.c, dp.i + 1 AS i, e.t AS q, {{'cost': CAST(dp.v.cost + 2 * ins.n + e.cost AS BIGINT), 'audit': dp.v.audit || repeat('I', ins.n) || e.letter,
           'out': list_concat(dp.v.out, list_transform(range(ins.n), lambda j: {name('ins.xs[j + 1]')} || ':'), CASE WHEN e.line IS NULL THEN CAST([] AS VARCHAR[]) ELSE [e.line] END)}} AS v
    FROM dp JOIN ins ON ins.f = dp.q JOIN e ON e.c = dp.c AND e.i = dp.i + 1 AND e.f = ins.t) GROUP BY c, i, q),
goal AS (SELECT dp.c, min({{'cost': CAST(dp.v.cost + 2 * ins.n AS BIGINT), 'audit': dp.v.audit || repeat('I', ins.n),
                'out': list_concat(dp.v.out, list_transform(range(ins.n), lambda j: {name('ins.xs[j + 1]')} || ':'))}}) AS v
         FROM dp JOIN ends ON dp.c = ends.c AND dp.i = ends.n JOIN ins ON ins.f = dp.q AND ins.t IN (0, 3) GROUP BY dp.c),
facts AS (SELECT c, any_value(conv_id) AS conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
                 count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
                 count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY c),
done AS (SELECT facts.*, v FROM facts JOIN goal USING (c))
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v.cost, 0) AS cost, coalesce(v.audit, '') AS audit,
       sha256(coalesce(array_to_string(v.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN done ON a.conv_id IS NOT DISTINCT FROM done.conv_id"""
