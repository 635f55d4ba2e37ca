"""DuckDB SQL for the native operators, written without their filters and shuffles."""

from __future__ import annotations

from criterium.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, WORD, pairs_of

SPAN = max(len(pairs_of(t)) for _, t in TEMPLATES)


def _template_rows() -> str:
    return ", ".join(f"({k}, '{label}', {sorted(set(pairs_of(text)))!r})" for k, (label, text) in enumerate(TEMPLATES))


def _phrase_rows() -> str:
    return ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES.items())


LICENSES = rf"""
WITH t AS (SELECT * FROM (VALUES {_template_rows()}) AS t(template, label, members)),
p AS (SELECT * FROM (VALUES {_phrase_rows()}) AS p(label, parts)),
d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
b AS (SELECT w.row, p.label, unnest(list_filter(range(len(w.words)), lambda i: w.words[i + 1 : i + len(p.parts)] = p.parts)) AS place
      FROM w CROSS JOIN p WHERE contains(w.text, 'license')),
s AS (SELECT row, CAST(count(*) AS BIGINT) AS n_base, CAST(min(place) AS BIGINT) AS first_word, CAST(max(place) AS BIGINT) AS last_word, list_sort(list_distinct(list(label))) AS base FROM b GROUP BY row),
q AS (SELECT row, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs FROM w),
l AS (SELECT row, list_distinct(pairs[k * {SPAN} + 1 : (k + 2) * {SPAN}]) AS pairs FROM (SELECT row, pairs, unnest(range(0, (len(pairs) - 1) // {SPAN} + 1)) AS k FROM q WHERE len(pairs) > 0)),
m AS (SELECT l.row, t.label, len(list_intersect(l.pairs, t.members)) / len(t.members)::DOUBLE AS containment FROM l CROSS JOIN t),
f AS (SELECT row, list_distinct(list(label)) AS found, max(containment) AS containment FROM m WHERE containment >= {THRESHOLD} GROUP BY row)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(s.n_base, 0) AS n_base, s.first_word, s.last_word,
       coalesce(array_to_string(s.base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(s.base, []), coalesce(f.found, [])))), ','), '') AS labels,
       CASE WHEN s.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(f.containment, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN s ON s.row = w.row LEFT JOIN f ON f.row = w.row"""

_LEAVES = r"[ \t\r\f]*(?:[^ \t\r\f]+[ \t\r\f]*){1,8}|[ \t\r\f]+"


def _tree(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{_LEAVES}'), lambda x: md5(x))))"


def _print(tree: str) -> str:
    root = f"sha256(array_to_string(list_transform({tree}, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))), ''))"
    leaf = "array_to_string(list_transform(p, lambda x: x[1:8]), '')"
    branch = f"'P' || left(md5(array_to_string(p, '')), 8) || {leaf}"
    whole = f"'S' || left(md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), '')), 8) || array_to_string(list_transform(s, lambda p: {branch}), ',')"
    short = f"array_to_string(list_transform({tree}, lambda s: {whole}), ';')"
    return f"{root} || ':' || {short}"


def _leaves(tree: str) -> str:
    return f"list_distinct(list_transform(flatten(flatten({tree})), lambda x: x[1:8]))"


def _near(a: str, b: str) -> str:
    return f"""CASE WHEN split_part({a}, ':', 1) = split_part({b}, ':', 1) THEN 1.0::DOUBLE WHEN len({a}_l) + len({b}_l) = 0 THEN 0.0::DOUBLE
        ELSE 2.0::DOUBLE * len(list_intersect({a}_l, {b}_l)) / (len({a}_l) + len({b}_l)) END"""


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt FROM documents
           WINDOW w AS (ORDER BY doc_id ASC NULLS FIRST, coalesce(text, ''))),
e AS (SELECT *, length(text) AS n, left(text, length(text) - length(text) // 4) || left(nxt, length(text) // 4) AS edited FROM d),
t AS (SELECT *, {_tree('text')} AS tt, {_tree('edited')} AS te, {_tree('nxt')} AS tn FROM e),
f AS (SELECT *, {_print('tt')} AS a, {_print('te')} AS b, {_print('tn')} AS c, {_leaves('tt')} AS a_l, {_leaves('te')} AS b_l, {_leaves('tn')} AS c_l FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
       {_near('a', 'b')} AS near_edited, {_near('a', 'c')} AS near_next FROM f"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS every FROM d WHERE len(terms) > 0),
i AS (SELECT row, item_id, term, CAST(count(*) AS BIGINT) AS times
      FROM (SELECT row, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS row, item_id, {_TERMS} AS terms FROM benchmark)) GROUP BY ALL),
p AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term) CROSS JOIN c),
s AS (SELECT i.row, i.item_id, p.row AS doc, p.doc_id, CAST(sum(i.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * c.docs) // c.every)))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN w USING (term) CROSS JOIN c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
