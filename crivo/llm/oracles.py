"""DuckDB SQL that checks the corpus queries; literals stand here on their own."""

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DOCS = f"docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS w FROM documents)"

OP2 = f"""
WITH {_DOCS},
templates(tid, label, notice, key, least, base) AS (VALUES
  (1, 'cc-by', 'cc by', 'cc by', 1.0, true),
  (2, 'gpl', 'general public license', 'general public license', 1.0, true),
  (3, 'reserved', 'all rights reserved', 'all rights reserved', 1.0, true),
  (4, 'agpl', 'gnu affero general public license version 3', 'affero general public license', 0.5, false),
  (5, 'apache-2.0', 'licensed under the apache license version 2 0', 'apache license version 2 0', 0.5, false),
  (6, 'bsd', 'released under the bsd license', 'bsd license', 0.5, false),
  (7, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted',
   'redistribution and use in source and binary forms', 0.5, false),
  (8, 'cc-by-nc', 'licensed under cc by nc 4 0', 'cc by nc', 0.5, false),
  (9, 'cc-by-nd', 'licensed under cc by nd 4 0', 'cc by nd', 0.5, false),
  (10, 'cc-by-sa', 'licensed under cc by sa 4 0', 'cc by sa', 0.5, false),
  (11, 'cc0', 'cc0 1 0 universal', 'cc0', 0.5, false),
  (12, 'gpl-2', 'licensed under the gnu general public license version 2', 'general public license version 2', 0.5, false),
  (13, 'gpl-3', 'licensed under the gnu general public license version 3', 'general public license version 3', 0.5, false),
  (14, 'isc', 'released under the isc license', 'isc license', 0.5, false),
  (15, 'lgpl', 'gnu lesser general public license', 'lesser general public license', 0.5, false),
  (16, 'mit', 'released under the mit license', 'mit license', 0.5, false),
  (17, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy',
   'hereby granted free of charge', 0.5, false),
  (18, 'mpl-2.0', 'subject to the terms of the mozilla public license v 2 0', 'mozilla public license', 0.5, false),
  (19, 'unlicense', 'this is free and unencumbered software released into the public domain',
   'unencumbered software released into the public domain', 0.5, false)),
entries AS (
  SELECT tid, unnest(string_split(notice, ' ')) AS word, unnest(range(len(string_split(notice, ' ')))) AS at
  FROM templates),
keys AS (
  SELECT *, len(string_split(key, ' ')) AS size,
         CASE WHEN position(key IN notice) = 1 THEN 0
              ELSE len(string_split(trim(substr(notice, 1, position(key IN notice) - 1)), ' ')) END AS key_at
  FROM templates),
held AS (SELECT DISTINCT rid, unnest(w) AS word FROM docs),
idf AS (
  SELECT word, ln(((SELECT count(*) FROM docs) + 1) / ((SELECT count(*) FROM held h WHERE h.word = e.word) + 0.5)) + 1 AS idf
  FROM (SELECT DISTINCT word FROM entries) e),
totals AS (SELECT tid, sum(idf) AS total FROM entries JOIN idf USING (word) GROUP BY tid),
spots AS (SELECT rid, w, unnest(range(len(w))) AS at FROM docs),
places AS (
  SELECT s.rid, s.w, k.tid, s.at AS first, s.at - k.key_at AS start
  FROM spots s JOIN keys k ON s.w[s.at + 1] = string_split(k.key, ' ')[1]
                          AND array_to_string(s.w[s.at + 1 : s.at + k.size], ' ') = k.key),
scored AS (
  SELECT p.rid, p.tid, p.first, sum(CASE WHEN p.start + e.at >= 0 AND p.w[p.start + e.at + 1] = e.word THEN idf ELSE 0 END) / any_value(total) AS score
  FROM places p JOIN entries e USING (tid) JOIN idf USING (word) JOIN totals USING (tid)
  GROUP BY p.rid, p.tid, p.first),
kept AS (SELECT s.*, label, base FROM scored s JOIN templates USING (tid) WHERE score >= least - 1e-9),
found AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(least(score, 1)) AS score
  FROM kept GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM docs LEFT JOIN found USING (rid)
"""

def _sized(column):
    text = f"cast({column} AS varchar)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


OP3 = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
steps AS (SELECT source, greatest(ceil(rate / 16), 1)::INT AS steps, rate / greatest(ceil(rate / 16), 1) AS mean FROM rates),
terms AS (
  SELECT source, steps, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM steps
  UNION ALL
  SELECT source, steps, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < 63),
turns AS (SELECT source, unnest(range(1, steps + 1)) AS j FROM steps),
numbered AS (
  SELECT *, md5({_sized('doc_id')} || {_sized('text')} || {_sized('lang')} || {_sized('source')} || {_sized('n_chars')}) AS digest,
         row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1 AS number
  FROM documents),
draws AS (
  SELECT d.doc_id, d.source, d.text, d.digest, d.number, j,
         ('0x' || substr(md5('42:' || digest || ':' || number || ':' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM numbered d JOIN turns t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, source, text, digest, number,
         (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.c <= d.u) AS n
  FROM draws d),
every AS (SELECT doc_id, source, text, sum(n)::INT AS n FROM copies GROUP BY doc_id, source, text, digest, number)
SELECT doc_id, unnest(range(n))::INT AS copy, source, md5(coalesce(text, '')) AS text_md5 FROM every
"""

OP5 = f"""
WITH {_DOCS},
bench AS (SELECT item_id::VARCHAR AS item, {_WORDS.format('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[pos : pos + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM bench WHERE len(w) > 0)),
spots AS (
  SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS pos
  FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
hits AS (
  SELECT s.rid, s.pos, s.size, v.item FROM spots s JOIN windows v
  ON v.size = s.size AND v.win = array_to_string(s.w[s.pos : s.pos + s.size - 1], ' ')),
words AS (SELECT rid, count(DISTINCT word) AS n FROM (SELECT rid, unnest(range(pos, pos + size)) AS word FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS every FROM hits GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(every, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

# Bigram scores (order 2) of the same operator, for tests; the registered query has order 3.
OP6 = f"""
WITH {_DOCS},
words AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs),
pairs AS (SELECT rid, pos, lag(word) OVER (PARTITION BY rid ORDER BY pos) AS before, word FROM words),
one AS (SELECT word, count(*) AS n FROM words GROUP BY word),
two AS (SELECT before, word, count(*) AS n FROM pairs WHERE before IS NOT NULL GROUP BY before, word HAVING count(*) >= 2),
scored AS (
  SELECT rid, CASE WHEN two.n IS NOT NULL THEN ln(two.n / h.n)
                   WHEN p.before IS NOT NULL THEN ln(0.4) + ln(o.n / (SELECT count(*) FROM words))
                   ELSE ln(o.n / (SELECT count(*) FROM words)) END AS s
  FROM pairs p JOIN one o ON o.word = p.word LEFT JOIN one h ON h.word = p.before
  LEFT JOIN two ON two.before = p.before AND two.word = p.word),
sums AS (SELECT rid, sum(s) AS s FROM scored GROUP BY rid)
SELECT doc_id, len(w) AS n_words, round(coalesce(s, 0.0), 6) AS log_score,
       CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_score
FROM docs LEFT JOIN sums USING (rid)
"""

OP6_ORDER3 = f"""
WITH {_DOCS},
words AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs),
grams AS (SELECT rid, lag(word, 2) OVER (PARTITION BY rid ORDER BY pos) AS first,
                 lag(word) OVER (PARTITION BY rid ORDER BY pos) AS before, word FROM words),
one AS (SELECT word, count(*) AS n FROM words GROUP BY word),
two AS (SELECT before, word, count(*) AS n FROM grams WHERE before IS NOT NULL GROUP BY before, word),
three AS (SELECT first, before, word, count(*) AS n FROM grams WHERE first IS NOT NULL GROUP BY first, before, word),
scored AS (
  SELECT rid, CASE WHEN t.n >= 2 THEN ln(t.n / p.n)
                   WHEN b.n >= 2 THEN ln(b.n / h.n) + CASE WHEN g.first IS NULL THEN 0 ELSE ln(0.4) END
                   ELSE ln(o.n / (SELECT count(*) FROM words))
                        + ln(0.4) * CASE WHEN g.first IS NOT NULL THEN 2 WHEN g.before IS NOT NULL THEN 1 ELSE 0 END
              END AS s
  FROM grams g JOIN one o ON o.word = g.word LEFT JOIN one h ON h.word = g.before
  LEFT JOIN two b ON b.before = g.before AND b.word = g.word
  LEFT JOIN two p ON p.before = g.first AND p.word = g.before
  LEFT JOIN three t ON t.first = g.first AND t.before = g.before AND t.word = g.word),
sums AS (SELECT rid, sum(s) AS s FROM scored GROUP BY rid)
SELECT doc_id, len(w) AS n_words, round(coalesce(s, 0.0), 6) AS log_score,
       CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_score
FROM docs LEFT JOIN sums USING (rid)
"""

_BITS = "('0x' || substr(h, {at}, 5))::INT"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_BITS.format(at=at)} >> {shift}) & 31) + 1, 1)"
    for at in range(1, 41, 5)
    for shift in (15, 10, 5, 0)
)

OP9 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha1(raw) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS original FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM g
"""

OP10 = f"""
WITH d AS (SELECT doc_id, sha256({_FOLD.format('text')}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

# CRC-32 of ASCII text, by its table of 256 remainders; the query joins crc_table.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS remainders)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length({0}) + 1), lambda i: ascii(({0})[i])::BIGINT)),
    lambda a, b: xor(a >> 8, remainders[(xor(a, b) & 255) + 1])), 4294967295)"""


def _leaf(n_chars):
    return "sha256(" + " || ".join(_sized(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
         CASE WHEN {_CRC.format('cast(doc_id AS varchar)')} % 7 = 0 AND n_chars IS NOT NULL
              THEN {_leaf('(n_chars + 1)')} END AS wrong
  FROM documents, crc_table),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM docs),
up AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (
  SELECT 0 AS lvl, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM over WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT l.doc_id, l.leaf, t.lvl AS step, (l.pos >> t.lvl) % 2 = 1 AS is_right, s.h
  FROM leaves l JOIN (SELECT DISTINCT lang, lvl, n FROM up WHERE n > 1) t ON l.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = t.lvl AND s.pos = xor(l.pos >> t.lvl, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, 1000 + t.lvl, (r.pos >> t.lvl) % 2 = 1, s.h
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang
  CROSS JOIN (SELECT DISTINCT lvl, n FROM over WHERE n > 1) t
  LEFT JOIN over s ON s.lvl = t.lvl AND s.pos = xor(r.pos >> t.lvl, 1)),
proofs AS (
  SELECT doc_id, leaf, coalesce(string_agg(h, '' ORDER BY step), '') AS proof,
         list({{'h': h, 'is_right': is_right}} ORDER BY step) AS path
  FROM steps GROUP BY doc_id, leaf),
folded AS (
  SELECT l.doc_id, l.leaf, r.h AS subroot, (SELECT h FROM over WHERE n = 1) AS root,
         sha256(coalesce(p.proof, '')) AS proof_sha256,
         list_reduce(list_prepend({{'h': coalesce(l.wrong, l.leaf), 'is_right': false}}, p.path),
           lambda a, b: {{'h': sha256(CASE WHEN b.h IS NULL THEN a.h WHEN b.is_right THEN b.h || a.h ELSE a.h || b.h END),
                          'is_right': false}}).h AS folded_root
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang
  JOIN proofs p ON p.doc_id IS NOT DISTINCT FROM l.doc_id AND p.leaf = l.leaf)
SELECT *, folded_root = root AS verified FROM folded
"""

_GIVEN = "coalesce(cast({} AS varchar), ' ')"


def _edit(state, letter, cost, piece=None):
    """A state's cheapest path so far with one more edit; `piece` is what the edit leaves standing."""
    kept = f"{state}.r" if piece is None else f"({state}.r || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) END || {piece})"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {kept}}}"


_NEVER = "{'c': 1000000000, 'a': '', 'r': ''}"
_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def _least(*paths):
    return "list_min([" + ", ".join(paths) + "])"


def _insert(state, number):
    return _edit(state, "I", 3, f"'{_ROLE[number]}:'")


def _stay(letter, number, states, initial=None):
    """Keeping or reroling from one of several states."""
    piece = "(role || ':' || text)" if initial else f"('{_ROLE[number]}:' || text)"
    fits = f"fault <> 'dead' AND initial = '{initial}'" if initial else "fault <> 'dead'"
    cost = ("0" if initial else "3") + " + CASE WHEN fault = 'cut' THEN 3 ELSE 0 END"
    return [f"CASE WHEN {fits} THEN {_edit(s, letter, f'({cost})', piece)} ELSE {_NEVER} END" for s in states]


OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
dealt AS (
  SELECT conv_id, turn, {_GIVEN.format('role')} AS role, {_GIVEN.format('text')} AS text,
         {_CRC.format("(" + _GIVEN.format('conv_id') + " || ':' || " + _GIVEN.format('turn') + ")")} % 20 AS sort
  FROM conversations, crc_table),
broken AS (
  SELECT conv_id, turn, CASE WHEN sort = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN sort = 1 THEN '' WHEN sort = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt CROSS JOIN range(2) AS copy(k) WHERE sort <> 0 AND (k = 0 OR sort = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM broken),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS initial,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
  FROM numbered),
kinds AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'cut' ELSE '' END AS kind
  FROM judged),
faulty AS (
  SELECT *, CASE WHEN kind IN ('blank', 'duplicate') THEN 'dead' ELSE kind END AS fault FROM kinds),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': ''}} AS s0, {_NEVER} AS s1, {_NEVER} AS s2, {_NEVER} AS s3
  FROM faulty
  UNION ALL
  SELECT conv_id, i, {_edit('s0', 'D', 4)},
         {_least(_edit('s1', 'D', 4), *_stay('K', 0, ['s0'], 's'))},
         {_least(_edit('y2', 'D', 4), *_stay('K', 0, ['s0', 's1', 'y3'], 'u'), *_stay('R', 0, ['s0', 's1', 'y3']))},
         {_least(_edit('y3', 'D', 4), *_stay('K', 2, ['y2'], 'a'), *_stay('R', 2, ['y2']))}
  FROM (
    SELECT *, {_least('x2', _insert('x3', 3))} AS y2, {_least('x3', _insert('x2', 2))} AS y3
    FROM (
      SELECT f.conv_id, f.i, f.role, f.text, f.initial, f.fault, s0, s1,
             {_least('s2', _insert('s0', 0), _insert('s1', 1), _insert('s3', 3))} AS x2,
             {_least('s3', _insert('s2', 2))} AS x3
      FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
ends AS (
  SELECT conv_id, {_least('s0', 's3', _insert('s2', 2), _insert(f"({_insert('s1', 1)})", 2))} AS best
  FROM walk w WHERE i = (SELECT max(i) FROM faulty f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id)),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE kind = 'blank') AS blank, count(*) FILTER (WHERE kind = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE kind = 'cut') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

#: Not here: fingerprint links (1), the learned scores (4, 8), random shards (7) and packing by
#: tokenizer ids (13) have no SQL twin.
ORACLES = {
    "op2_licenses": OP2,
    "op3_mix": OP3,
    "op5_decontaminate": OP5,
    "op6_lm_order3": OP6_ORDER3,
    "op9_warc": OP9,
    "op10_exact": OP10,
    "op11_merkle": OP11,
    "op12_repair": OP12,
}
