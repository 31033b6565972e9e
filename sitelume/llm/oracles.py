"""DuckDB SQL for the operators that SQL can express. Each is written from the operator's contract; what the
contract leaves to the method (added kinds, thresholds, phrases) is a parameter taken from the operator."""

from __future__ import annotations

from sitelume.llm import chat, pii, quality_rules, secrets

_SPACE = r"[\x20\x09-\x0D]+"
_quoted = lambda x: x.replace("'", "''")
_BARE_LINE = r"regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
_LINE_WORDS = f"len(string_split_regex({_BARE_LINE}, '{_SPACE}'))"
_PHRASE = rf"(^|[^\pL\pN_])({'|'.join(map(_quoted, quality_rules.PHRASES))})([^\pL\pN_]|$)"
_FAILS = rf"""({_BARE_LINE} <> '' AND (length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) > {quality_rules.MOST_SYMBOLS}::DOUBLE * length(regexp_replace(x, '{_SPACE}', '', 'g'))
  OR regexp_matches({_BARE_LINE}, '(\.\.\.|…)$')
  OR (NOT contains('{_quoted(quality_rules.ENDS)}', right({_BARE_LINE}, 1)) AND (regexp_matches({_BARE_LINE}, '{quality_rules.BULLET}') OR {_LINE_WORDS} <= {quality_rules.MOST_FRAGMENT_WORDS}))
  OR len(string_split_regex(x, '[{quality_rules.BARS}]')) > 3
  OR (regexp_matches(lower({_BARE_LINE}), '{_PHRASE}') AND length({_BARE_LINE}) <= {quality_rules.MOST_BOILERPLATE_CHARS})))"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM h WHERE n > 1) GROUP BY 1),
f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines, length(regexp_replace(array_to_string(list_filter(l, lambda x: NOT {_FAILS}), chr(10)), '{_SPACE}', '', 'g')) AS clean_chars FROM d),
q AS (SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM f LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND word_chars - clean_chars <= {quality_rules.MOST_REMOVED}::DOUBLE * word_chars AS kept, CAST(word_chars - clean_chars AS BIGINT) AS removed_chars FROM q"""

_ESC = lambda c: rf"replace({c}, '\', '\\')"

CHAT = rf"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.TURN) + 2 + len(chat.CLOSE)} + length({_ESC("r")}) + length({_ESC("t")}) + CASE WHEN r = 'assistant' THEN {len(chat.LOSS) + len(chat.END_LOSS)} ELSE 0 END) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens  -- plain texts have none
FROM c GROUP BY conv_id, own"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
i AS (SELECT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM i),
p AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
o AS (SELECT doc_id, k, p.n, item FROM p JOIN i ON p.n = i.n AND p.g = i.g),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM o) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _rule_spans(k: int, rule: secrets.Rule) -> str:
    """SQL list of (start, rule number, end) of a rule's accepted spans in t."""
    pattern = (("(?i)" if rule.ignore_case else "") + rule.pattern).replace("'", "''")
    group = 1 if rule.kind == "assign" else 0
    gaps, hits = f"string_split_regex(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}')"
    sized = f"list_transform(range(1, len(h) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'k': {k}, 'h': h[i]}})"
    kept = f"list_filter({sized}, lambda x: length(regexp_extract(x.h, '{pattern}', {group})) >= {rule.least})"
    return f"(SELECT list_transform({kept}, lambda x: {{'s': x.s, 'k': x.k, 'e': x.s + length(x.h)}}) FROM (SELECT {gaps} AS p, {hits} AS h))"


_KINDS = [r.kind for r in secrets.RULES]
_WRITTEN = lambda c: f"array_to_string(list_transform(list_sort({c}), lambda x: {_KINDS!r}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {" || ".join(_rule_spans(k, r) for k, r in enumerate(secrets.RULES))} AS s FROM d),
g AS (SELECT doc_id, s, list_filter(s, lambda x: x.k < {len(secrets.BASE_KINDS)}) AS b FROM f)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(b, lambda x: x.k = {k})) AS BIGINT) AS n_{kind}" for k, kind in enumerate(secrets.BASE_KINDS))}, sha256({_WRITTEN("b")}) AS base_sha256, {_WRITTEN("s")} AS spans FROM g"""

_DIGITS = "regexp_replace(h[i], '[^0-9]+', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CAST({_DIGITS}[length({_DIGITS}) - j + 1] AS BIGINT) * (1 + (j - 1) % 2) - CASE WHEN CAST({_DIGITS}[length({_DIGITS}) - j + 1] AS BIGINT) * (1 + (j - 1) % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"
_BARE = "replace(h[i], ' ', '')"
_MOD97 = f"list_reduce(list_transform(string_split(array_to_string(list_transform(string_split({_BARE}[5:] || {_BARE}[1:4], ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), ''), ''), lambda c: CAST(c AS BIGINT)), lambda a, c: (a * 10 + c) % 97) = 1"
_VALID = {
    "email": "true",
    "ip": rf"regexp_matches(h[i], '^{pii._PART}(\.{pii._PART}){{3}}$')",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": f"length({_BARE}) BETWEEN 15 AND 34 AND {_MOD97}",
    "short_card": f"length({_DIGITS}) BETWEEN 13 AND 15 AND {_LUHN}",
    "national_id": f"regexp_matches(h[i], '{pii.NATIONAL_ID}') AND NOT regexp_matches(h[i], '^(000|666|9..)|-00-|-0000$')",
}


def _detected(k: int, d: pii.Detector) -> str:
    """SQL list of (kind number, start, end) of a detector's kept spans in t."""
    pattern = d.pattern.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace("(?<![0-9])", "").replace("++", "+")
    start = "CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    near = "0"
    if d.context:  # the text before and behind the match, each with a character more at its far end
        other = r"[^\pL\pN_]"
        before = f"substring(' ' || t, greatest({start} - {pii.CONTEXT_CHARS}, 0) + 1, least({start}, {pii.CONTEXT_CHARS}) + 1)"
        end = f"({start} + length(h[i]))"
        behind = f"substring(t, {end} + 1, {pii.BEHIND_CHARS + 1}) || CASE WHEN length(t) - {end} <= {pii.BEHIND_CHARS} THEN ' ' ELSE '' END"
        near = f"CASE WHEN regexp_matches(lower({before}), '{other}({d.context})({other}|$)') OR regexp_matches(lower({behind}), '(^|{other})({d.context}){other}') THEN {d.bonus}::DOUBLE ELSE 0 END"
    kept = f"list_filter(range(1, len(h) + 1), lambda i: {_VALID[d.kind]} AND {d.score}::DOUBLE + {near} >= {pii.THRESHOLD})"
    return f"(SELECT list_transform({kept}, lambda i: {{'k': {k}, 's': {start}, 'e': {start} + length(h[i])}}) FROM (SELECT string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS h))"


_PII_KINDS = [d.kind for d in pii.DETECTORS]
_PII_WRITTEN = lambda c: f"array_to_string(list_transform(list_sort({c}), lambda x: {_PII_KINDS!r}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"

PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {" || ".join(_detected(k, d) for k, d in enumerate(pii.DETECTORS))} AS s FROM d),
g AS (SELECT doc_id, s, list_filter(s, lambda x: x.k < {len(pii.BASE_KINDS)}) AS b FROM f)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(b, lambda x: x.k = {k})) AS BIGINT) AS n_{kind}" for k, kind in enumerate(pii.BASE_KINDS))}, sha256({_PII_WRITTEN("b")}) AS base_sha256, {_PII_WRITTEN("s")} AS spans FROM g"""

#: crc32 of a list of bytes, by the polynomial's table (column t of the relation crc).
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), i) ORDER BY i) AS t FROM range(256) r(i))"""
_CRC = lambda bytes: f"xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"  # noqa: E731, A002
_BYTES = lambda text: f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), 128 + ord(x) % 64] END))"  # noqa: E731  below U+0800

LINES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_UPPER.lower()}') AS key FROM x),
g AS (SELECT key, min(doc) AS first FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc) >= 2),
j AS (SELECT r, i, line, first IS NOT NULL AND doc <> first AS lost FROM k LEFT JOIN g USING (key)),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '') AS kept FROM j GROUP BY 1)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM s JOIN d USING (r)"""

_PART = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda text: f"sha256({_PART('doc_id')} || {_PART('source')} || {_PART('lang')} || {_PART('n_chars')} || {_PART(text)})"
_UP = "list_transform(range(0, len(l), 8), lambda i: sha256(array_to_string(l[i + 1:i + 8], '')))"
_LEFT, _RIGHT = (f"array_to_string(l[{a}:{z}], '')" for a, z in (("i - i % 8 + 1", "i"), ("i + 2", "i - i % 8 + 8")))

MERKLE = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF("text")} AS leaf, CASE WHEN {_CRC(_BYTES("CAST(doc_id AS VARCHAR)"))} % 3 = 0 THEN {_LEAF(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS changed FROM documents, crc),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
lv AS (SELECT lang, 0 AS k, list(leaf ORDER BY i) AS l FROM e GROUP BY lang UNION ALL SELECT lang, k + 1, {_UP} FROM lv WHERE len(l) > 1),
sub AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM lv WHERE len(l) = 1),
top AS (SELECT 0 AS k, list(subroot ORDER BY i) AS l FROM sub UNION ALL SELECT k + 1, {_UP} FROM top WHERE len(l) > 1),
low AS (SELECT r, lang, 0 AS k, i, coalesce(changed, leaf) AS cur, '' AS proof FROM e
  UNION ALL SELECT r, lv.lang, low.k + 1, i // 8, sha256({_LEFT} || cur || {_RIGHT}), proof || {_LEFT} || {_RIGHT} FROM low JOIN lv ON lv.lang IS NOT DISTINCT FROM low.lang AND lv.k = low.k WHERE len(l) > 1),
joined AS (SELECT r, low.cur, low.proof, sub.i, sub.subroot FROM (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY r ORDER BY k DESC) = 1) low JOIN sub ON sub.lang IS NOT DISTINCT FROM low.lang),
high AS (SELECT r, subroot, 0 AS k, i, cur, proof FROM joined
  UNION ALL SELECT r, subroot, high.k + 1, i // 8, sha256({_LEFT} || cur || {_RIGHT}), proof || {_LEFT} || {_RIGHT} FROM high JOIN top ON top.k = high.k WHERE len(l) > 1),
done AS (SELECT * FROM high QUALIFY row_number() OVER (PARTITION BY r ORDER BY k DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM e JOIN done USING (r), (SELECT l[1] AS root FROM top WHERE len(l) = 1)"""

SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
t AS (SELECT doc_id, translate(x, '{_UPPER}', '{_UPPER.lower()}') AS x FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents)),
c AS (SELECT doc_id, x, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT x, n, {_CRC(_BYTES("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || x"))} AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substring(x, 1, CAST(h % length(x) AS BIGINT)) || substring(x, CAST(h % length(x) AS BIGINT) + 2) ELSE x END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
s AS (SELECT word, n, substring(word, 1, i - 1) || '?' || substring(word, i + 1) AS wild, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM p),
l AS (SELECT DISTINCT s.word, s.n, v.word AS other, v.n AS m FROM s JOIN v ON v.word = s.less),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM s a JOIN s b ON a.wild = b.wild AND a.word <> b.word UNION ALL SELECT word, other, m FROM l UNION ALL SELECT other, word, n FROM l),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.up)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN r ON r.word = f.word AND r.up IS NULL"""

ORACLE = {"op2_pii": PII, "op3_secret_scan": SECRETS, "op4_decontamination": DECONTAMINATION, "op6_chat_formatting": CHAT, "op7_quality_rules": QUALITY, "op11_spelling_variants": SPELLING, "op12_merkle_manifest": MERKLE, "op13_line_dedup": LINES}
