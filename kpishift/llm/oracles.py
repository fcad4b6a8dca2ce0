"""DuckDB statements of the queries that SQL can express, written from the definitions (not from the methods)."""

from __future__ import annotations

from .licenses import NOTICES, PHRASES, TEMPLATES, split_words

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


#: Runs of ASCII letters and digits and of everything beyond ASCII.
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def search(k: int = 10, k1: float = 1.2, b: float = 0.75) -> str:
    """All common words of every query and document, added up."""
    return f"""
WITH w AS (SELECT doc_id, unnest({_WORDS.format(_low('text'))}) AS term FROM documents),
bag AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS dl FROM bag GROUP BY doc_id),
stat AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM bag, stat GROUP BY term),
hit AS (SELECT q.doc_id AS query_id, d.doc_id,
  round(sum(q.tf * idf * d.tf * {k1 + 1} / (d.tf + {k1} * ({1 - b} + {b} * dl / mean))), 6) AS score
  FROM bag q JOIN bag d USING (term) JOIN idf USING (term) JOIN len ON len.doc_id = d.doc_id, stat
  WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM hit WHERE score > 0 QUALIFY rank <= {k}
"""


def licenses(threshold: float = 0.8) -> str:
    """Places of the phrases, notices and marks by their words, and blocks counted against every template."""
    orders = [(p, label, "base") for p, label in PHRASES.items()] + [(p, label, "notice") for p, label in NOTICES.items()]
    orders += [(mark, str(i), "mark") for i, (_, mark, _) in enumerate(TEMPLATES)]
    phrase_rows = ", ".join(f"({i}, '{label}', '{kind}', {j}, '{w}', {len(split_words(p))})"
                            for i, (p, label, kind) in enumerate(orders) for j, w in enumerate(split_words(p)))
    template_rows = ", ".join(f"({i}, '{label}', '{w}', {len(set(split_words(t)))}, {len(split_words(t))})"
                              for i, (label, _, t) in enumerate(TEMPLATES) for w in sorted(set(split_words(t))))
    return f"""
WITH phrase(p, label, kind, j, word, size) AS (VALUES {phrase_rows}),
template(t, label, word, size, span) AS (VALUES {template_rows}),
d AS (SELECT doc_id, {_WORDS.format(_low('text'))} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
place AS (SELECT doc_id, label, kind, size, pos - j AS start FROM w JOIN phrase USING (word)
  GROUP BY doc_id, p, label, kind, size, pos - j HAVING count(*) = any_value(size)),
hit AS (SELECT doc_id, t, label, size, span, word, pos // span AS blk FROM w JOIN template USING (word)),
block AS (SELECT * FROM hit UNION ALL SELECT doc_id, t, label, size, span, word, blk - 1 FROM hit WHERE blk >= 1),
near AS (SELECT doc_id, t, label, blk, any_value(span) AS span, count(DISTINCT word)::DOUBLE / any_value(size) AS share FROM block
  GROUP BY doc_id, blk, t, label HAVING count(DISTINCT word) >= {threshold} * any_value(size) - 1e-9),
found AS (SELECT n.doc_id, n.label, share FROM near n JOIN place m ON m.doc_id = n.doc_id AND m.kind = 'mark' AND m.label = CAST(t AS VARCHAR)
  AND m.start >= blk * span AND m.start + m.size <= (blk + 2) * span),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place WHERE kind = 'base' GROUP BY doc_id),
every AS (SELECT doc_id, label, share FROM found UNION ALL SELECT doc_id, label, 1.0 FROM place WHERE kind <> 'mark'),
lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM every GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id)
"""


def _components(edges: str) -> str:
    """CTEs reach(x, y) over ``edges`` (x, y), both directions; ``comp`` (x, c) with the least node."""
    return f"""both_ways AS (SELECT x, y FROM {edges} UNION SELECT y, x FROM {edges}),
reach AS (SELECT x, x AS y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)"""


def lines(min_bytes: int = 20) -> str:
    """Edit distances, at most 1, of distinct lines that begin or end alike (one edit leaves one half as it is); shorter lines
    have exact repeats only."""
    max_edits = 1
    return f"""
WITH RECURSIVE raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(range(len(ls))) AS line, trim(unnest(ls), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x FROM raw),
used AS (SELECT * FROM line WHERE strlen(x) >= 1),
one AS (SELECT x, strlen(x) AS n, row_number() OVER (ORDER BY x) AS id FROM (SELECT DISTINCT x FROM used)),
near AS (SELECT a.id AS x, b.id AS y FROM one a JOIN one b ON b.n BETWEEN a.n AND a.n + {max_edits} AND a.id <> b.id AND a.n >= {min_bytes}
  AND (a.n < b.n OR a.id < b.id)
  AND (left(a.x, CAST(length(a.x) // 2 - 1 AS BIGINT)) = left(b.x, CAST(length(a.x) // 2 - 1 AS BIGINT))
    OR right(a.x, CAST(length(a.x) // 2 - 1 AS BIGINT)) = right(b.x, CAST(length(a.x) // 2 - 1 AS BIGINT)))
  WHERE levenshtein(a.x, b.x) <= {max_edits}),
{_components('near')},
placed AS (SELECT doc_id, line, coalesce(c, id) AS class FROM used JOIN one ON one.x = used.x LEFT JOIN comp ON comp.x = one.id),
head AS (SELECT class, min(struct_pack(d := doc_id, l := line)) AS h, count(*) AS n FROM placed GROUP BY class)
SELECT doc_id, CAST(line AS INTEGER) AS line, h.d AS class_doc, CAST(h.l AS INTEGER) AS class_line, (doc_id = h.d AND line = h.l) AS kept
FROM placed JOIN head USING (class) WHERE n > 1
"""


def near_duplicates(percent: int = 75) -> str:
    """Common shingles of all pairs of different texts' sets."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low('text')}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
  ELSE [ws[i:i + 4] for i in range(1, len(ws) - 3)] END AS ss FROM d),
item AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(ss) AS g FROM s)),
size AS (SELECT doc_id, count(*) AS n, bit_xor(g) AS print FROM item GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, print) AS rep FROM size),
small AS (SELECT g, doc_id, n FROM item JOIN size USING (doc_id) JOIN class USING (doc_id) WHERE doc_id = rep),
near AS (SELECT a.doc_id AS x, b.doc_id AS y FROM small a JOIN small b ON a.g = b.g AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
{_components('near')},
done AS (SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, rep, documents.doc_id) AS component_id
  FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN class USING (doc_id) LEFT JOIN comp ON comp.x = rep)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM done
"""


def repetition(min_words: int = 5, window: int = 8, fewest_words: int = 20, most_repeated: int = 30, most_covered: int = 30,
               longest: int = 100, longest_share: int = 20) -> str:
    """Windows of words counted; a repeat is too long if a window of the first length not allowed stands twice."""
    def windows(n):
        return f"""SELECT id, pos FROM (SELECT id, pos, count(*) OVER (PARTITION BY id, h) AS c FROM (
  SELECT id, unnest([hash(ws[i:i + {n - 1}]) FOR i IN range(1, len(ws) - {n - 2})]) AS h, unnest(range(len(ws) - {n - 1})) AS pos
  FROM d WHERE len(ws) >= {n})) WHERE c > 1"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
chars AS (SELECT id, sum(length(word)) AS n FROM w GROUP BY id),
wide AS (SELECT DISTINCT id, pos + unnest(range({window})) AS pos FROM ({windows(window)})),
narrow AS (SELECT DISTINCT id, pos + unnest(range({min_words})) AS pos FROM ({windows(min_words)})),
rep AS (SELECT id, count(*) AS n FROM wide GROUP BY id),
cov AS (SELECT id, sum(length(word)) AS n FROM w JOIN narrow USING (id, pos) GROUP BY id),
line AS (SELECT id, x FROM (SELECT id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT id, count(*) - count(DISTINCT x) AS n FROM line GROUP BY id),
far AS (SELECT id, ws, greatest({longest + 1}, len(ws) * {longest_share} // 100 + 1) AS m FROM d),
too AS (SELECT id, len(h) > len(list_distinct(h)) AS long FROM (
  SELECT id, [hash(ws[i:i + m - 1]) FOR i IN range(1, len(ws) - m + 2)] AS h FROM far WHERE len(ws) > m)),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(chars.n, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS covered_chars, coalesce(too.long, false) AS too_long
  FROM d LEFT JOIN chars USING (id) LEFT JOIN dup USING (id) LEFT JOIN rep USING (id) LEFT JOIN cov USING (id) LEFT JOIN too USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_chars,
  (n_words < {fewest_words} OR 100 * n_repeat_words > {most_repeated} * n_words) AS base_failed,
  NOT base_failed AND NOT 100 * covered_chars > {most_covered} * word_chars AND NOT too_long AS kept FROM c
"""


def codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Every part compared with every entry of its codebook."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT r, part, arg_min(entry, {{d: d, e: entry}}) AS entry, min(d) AS d FROM (
  SELECT r, p.part, entry, list_sum(list_transform(range(1, len(w) + 1), lambda i: (w[i] - b[i]) * (w[i] - b[i]))) AS d
  FROM piece p JOIN book{k} USING (part)) GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (
  SELECT part, a.entry, unnest(w) AS x, unnest(range(len(w))) AS i FROM a{k} a JOIN piece USING (r, part)) GROUP BY part, entry, i),
n{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS b FROM m{k} GROUP BY part, entry),
book{k + 1} AS (SELECT part, entry, coalesce(n{k}.b, book{k}.b) AS b FROM book{k} LEFT JOIN n{k} USING (part, entry))""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS w FROM kept, range({parts}) t(part)),
book0 AS (SELECT part, r - 1 AS entry, w AS b FROM piece WHERE r <= {entries}),
{", ".join(steps)},
print AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(b) AS x, unnest(range(len(b))) AS i FROM book{rounds})),
coded AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (r), print
"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), "
            f"lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))")


def conversations() -> str:
    """Values are twelve digits of cost and the audit behind them: the least text is the cheapest and least audit."""
    def arc(value, cost, letter):
        return f"printf('%012d', CAST(left({value}, 12) AS BIGINT) + {cost}) || '{letter}' || substr({value}, 13)"

    def step(q, keeps):
        keep = "".join(f" WHEN ini = '{i}' THEN {arc(f'v{t}', 'extra', 'K')}" for i, t in keeps.items())
        goal = {0: 2, 1: 2, 2: 3, 3: 2}[q]
        return (f"least({arc(f'v{q}', 4, 'D')}, CASE WHEN bad THEN NULL{keep} END, CASE WHEN NOT bad THEN {arc(f'v{goal}', '3 + extra', 'R')} END) AS h{q}")

    zero = "'000000000000'"
    moves = ", ".join(step(q, k) for q, k in enumerate(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})))
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
conv AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM raw)),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE kind <> 0),
placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS ini,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM hurt JOIN conv ON hurt.conv_id IS NOT DISTINCT FROM conv.conv_id),
judged AS (SELECT *, final = '' AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
  lag(ini) OVER (PARTITION BY c ORDER BY i) AS ini_before FROM placed),
line AS (SELECT *, blank OR again AS bad, CASE WHEN NOT blank AND NOT again AND final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra FROM judged),
counts AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
  count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE extra > 0) AS truncated,
  count(*) FILTER (WHERE ini_before IS NOT NULL AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM line GROUP BY c),
best AS (SELECT c, n AS i, {zero} AS v0, '000000000006II' AS v1, '000000000003I' AS v2, {zero} AS v3 FROM counts
  UNION ALL SELECT c, i, least(h0, {arc('u', 3, 'I')}), least(h1, {arc('u', 3, 'I')}), u, least(h3, {arc('h2', 3, 'I')}) FROM (
    SELECT *, least(h2, {arc('h3', 3, 'I')}) AS u FROM (SELECT best.c, best.i - 1 AS i, {moves} FROM best JOIN line ON line.c = best.c AND line.i = best.i))),
audit AS (SELECT c, CAST(left(v0, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM best WHERE i = 0),
letter AS (SELECT c, unnest(string_split(audit, '')) AS l, unnest(range(length(audit))) AS o FROM audit WHERE audit <> ''),
used AS (SELECT c, o, l, 1 + count(*) FILTER (WHERE l <> 'I') OVER (PARTITION BY c ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - CASE WHEN l <> 'I' THEN 1 ELSE 0 END AS i FROM letter),
stay AS (SELECT used.c, o, l, role, text, row_number() OVER (PARTITION BY used.c ORDER BY o) AS m,
  first_value(l = 'K' AND ini = 's') OVER (PARTITION BY used.c ORDER BY o) AS led FROM used LEFT JOIN line ON line.c = used.c AND line.i = used.i WHERE l <> 'D'),
told AS (SELECT c, sha256(string_agg(CASE WHEN l = 'K' THEN role ELSE CASE WHEN (m - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END
  || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY o)) AS h FROM stay GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(h, sha256('')) AS repaired_sha256
FROM conv LEFT JOIN counts USING (c) LEFT JOIN audit USING (c) LEFT JOIN told USING (c)
"""


ORACLES = {
    "op2_search": search(),
    "op11_conversations": conversations(),
    "op12_repetition": repetition(),
    "op13_codes": codes(),
    "op3_licenses": licenses(),
    "op4_lines": lines(),
    "op10_minhash": near_duplicates(),
}
