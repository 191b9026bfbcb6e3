"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .license_scan import BASE, LEAST_TENTHS, LOOKED_UP, NEEDED, TEMPLATES
from .quality_rules import FEATURES, PRIOR, REACH

SPACES = r"[\x20\x09-\x0D]+"
WORDS = rf"list_filter(string_split_regex({{}}, '{SPACES}'), lambda w: w <> '')"

_FEATURE_SQL = {
    "symbols": "n_symbols * 1000 // greatest(word_chars, 1)",
    "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)",
    "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)",
    "word_length": "word_chars * 100 // greatest(n_words, 1)",
    "capitals": "n_capitals * 1000 // greatest(word_chars, 1)",
}
_LONG = " UNION ALL ".join(f"SELECT lang, source, {k} AS feature, {name} AS value FROM features WHERE NOT base_failed" + (f" AND {name} > 0" if some else "") for k, (name, (some, _)) in enumerate(FEATURES.items()))
_INSIDE = " AND ".join(
    f"coalesce(f.{name} <= q3_{k} + reach_{k}, true)" + (f" AND coalesce(f.{name} >= q1_{k} - reach_{k}, true)" if below else "")
    for k, (name, (_, below)) in enumerate(FEATURES.items())
)
_WIDE = ", ".join(f"max(CASE WHEN feature = {k} THEN {c} END) AS {c}_{k}" for k in range(len(FEATURES)) for c in ("q1", "q3", "reach"))
_FEATURE_LIST = ", ".join(f"({k})" for k in range(len(FEATURES)))


QUALITY = f"""
WITH docs AS (SELECT doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, unnest({WORDS.format('text')}) AS w, generate_subscripts({WORDS.format('text')}, 1) AS i FROM docs),
windows AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS a, lead(w, 2) OVER o AS b FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, a, b) AS c FROM windows WHERE b IS NOT NULL) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (SELECT d.doc_id, d.lang, d.source, len({WORDS.format('text')}) AS n_words, length(regexp_replace(text, '{SPACES}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals FROM docs d LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
features AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _FEATURE_SQL.items())}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
long AS (SELECT lang, source, feature, CASE WHEN value < 32 THEN value ELSE (value >> (length(bin(value)) - 5)) << (length(bin(value)) - 5) END AS bucket FROM ({_LONG})),
own AS (SELECT lang, source, feature, bucket, count(*) AS n FROM long GROUP BY ALL),
by_lang AS (SELECT lang, feature, bucket, sum(n) AS n FROM own GROUP BY ALL),
by_all AS (SELECT feature, bucket, sum(n) AS n FROM own GROUP BY ALL),
in_lang AS (SELECT lang, feature, sum(n) AS lang_n FROM by_lang GROUP BY ALL),
in_all AS (SELECT feature, sum(n) AS all_n FROM by_all GROUP BY ALL),
groups AS (SELECT lang, source, feature FROM (SELECT DISTINCT lang, source FROM own), (VALUES {_FEATURE_LIST}) v(feature)),
weights AS (SELECT o.lang, o.source, feature, bucket, o.n::HUGEINT * (lang_n + {PRIOR})::HUGEINT * all_n::HUGEINT AS w FROM own o JOIN in_lang USING (lang, feature) JOIN in_all USING (feature)
  UNION ALL SELECT g.lang, g.source, feature, bucket, n::HUGEINT * {PRIOR} * all_n::HUGEINT FROM groups g JOIN by_lang USING (lang, feature) JOIN in_all USING (feature)
  UNION ALL SELECT g.lang, g.source, feature, bucket, n::HUGEINT * {PRIOR * PRIOR} FROM groups g JOIN by_all USING (feature)),
summed AS (SELECT lang, source, feature, bucket, sum(w)::HUGEINT AS w FROM weights GROUP BY ALL),
ranked AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, feature ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY lang, source, feature) AS total FROM summed),
quartiles AS (SELECT lang, source, feature, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3 FROM ranked GROUP BY ALL),
reaching AS (SELECT *, {REACH} * (q3 - q1 + CASE WHEN q3 < 32 THEN 1 ELSE 1 << (length(bin(q3)) - 5) END) AS reach FROM quartiles),
chosen AS (SELECT lang, source, {_WIDE} FROM reaching GROUP BY lang, source)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, NOT f.base_failed AND {_INSIDE} AS kept, {', '.join(f'f.{n}' for n in FEATURES)}
FROM features f LEFT JOIN chosen c ON c.lang = f.lang AND c.source = f.source
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NGRAMS = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS.format(_LOWER)} AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.i >= 80 * (x.n + y.n - c.i)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f
"""

CHAT = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body, replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '%', '%25'), chr(10), '%0A') AS head FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(17 + length(head) + length(body)) AS BIGINT) AS formatted_chars FROM escaped GROUP BY conv_id
"""

_TEMPLATE_WORDS = ", ".join(f"({t}, '{label}', {len(text.split())}, {k}, '{w}')" for t, (label, text, _) in enumerate(TEMPLATES) for k, w in enumerate(text.split()))
_MUST = ", ".join(f"({t}, {k})" for t, (_, text, phrases) in enumerate(TEMPLATES) for p in phrases for at in [text.split(p)[0].count(" ")] for k in range(at, at + len(p.split())))
_BASE_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i AS place, '{label}' AS label FROM words WHERE " + " AND ".join(f"{('w', 'a', 'b')[k]} = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in BASE
)
LICENSES = f"""
WITH listed AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
each AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM listed),
words AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS a, lead(w, 2) OVER o AS b FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
base AS ({_BASE_PLACES}),
posted(t, label, size, p, w) AS (VALUES {_TEMPLATE_WORDS}),
must(t, p) AS (VALUES {_MUST}),
vocabulary AS (SELECT w, row_number() OVER (ORDER BY coalesce(n, 0), w) AS rank FROM (SELECT DISTINCT w FROM posted) LEFT JOIN (SELECT w, count(DISTINCT doc_id) AS n FROM each WHERE w IN (SELECT w FROM posted) GROUP BY w) USING (w)),
present AS (SELECT DISTINCT doc_id, w, rank FROM each JOIN vocabulary USING (w)),
covered AS (SELECT doc_id, t FROM present JOIN posted USING (w) GROUP BY doc_id, t, size HAVING count(*) * 10 >= size * {LEAST_TENTHS}),
top AS (SELECT doc_id, t, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY rank) AS k FROM (SELECT DISTINCT doc_id, t, w, rank FROM covered JOIN present USING (doc_id) JOIN posted USING (t, w))) WHERE k <= {LOOKED_UP}),
candidates AS (SELECT doc_id, t, e.i - p.p AS place FROM top JOIN each e USING (doc_id, w) JOIN posted p USING (t, w) GROUP BY ALL HAVING count(*) >= {NEEDED}),
stands AS (SELECT c.doc_id, c.t, c.place, p.label, p.size, p.p FROM candidates c JOIN posted p USING (t) JOIN each e ON e.doc_id = c.doc_id AND e.i = c.place + p.p AND e.w = p.w),
judged AS (SELECT doc_id, t, place, s.label, count(*) / s.size AS share, count(*) * 10 >= s.size * {LEAST_TENTHS} AND count(m.p) = (SELECT count(*) FROM must x WHERE x.t = s.t) AS verified FROM stands s LEFT JOIN must m USING (t, p) GROUP BY doc_id, t, place, s.label, s.size),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM judged WHERE verified) GROUP BY doc_id),
bases AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM judged GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM listed LEFT JOIN bases b USING (doc_id) LEFT JOIN labelled l USING (doc_id) LEFT JOIN best USING (doc_id)
"""

#: CRC-32 bit by bit; DuckDB has no function for it.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"
TRIE = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (SELECT c.conv_id, 0 AS part, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE i <= h UNION ALL SELECT conv_id, 1, i, role, text FROM convs JOIN turns USING (conv_id) WHERE i > h),
numbered AS (SELECT conv_id, row_number() OVER o AS d, len(list_filter(string_split_regex(text, '{SPACES}'), lambda w: w <> '')) AS words, string_agg(sha256(length(role) || ':' || role || text), '') OVER o AS key FROM built WINDOW o AS (PARTITION BY conv_id ORDER BY part, i)),
paths AS (SELECT conv_id, 0 AS d, 0 AS words, '' AS key, NULL AS parent FROM convs UNION ALL SELECT conv_id, d, words, sha256(key), CASE WHEN d = 1 THEN '' ELSE sha256(left(key, length(key) - 64)) END FROM numbered),
nodes AS (SELECT key, min(conv_id) AS conv_id, any_value(d) AS depth, any_value(parent) AS parent, any_value(words) AS words, count(*) AS n_convs FROM paths GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT p.key, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n_convs - 1) * x.words) AS saved FROM nodes x LEFT JOIN children c USING (key) JOIN paths p ON p.conv_id = x.conv_id AND p.d <= x.depth GROUP BY p.key),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(key, d) AS key FROM paths GROUP BY conv_id) GROUP BY key)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (key) LEFT JOIN children c USING (key) LEFT JOIN nodes up ON up.key = n.parent LEFT JOIN ends e ON e.key = n.key
"""

SQL = {"op2_quality_rules": QUALITY, "op4_ngram_join": NGRAMS, "op5_warc": WARC, "op7_chat_formatting": CHAT, "op11_license_scan": LICENSES, "op13_prefix_trie": TRIE}
