"""The named queries in SQL for another engine, from the table that ``docs`` names."""

from __future__ import annotations

from threadloom.llm.chat_format import MARKS
from threadloom.llm.decontaminate import LEAST_SCORE, MASKS, SPAN
from threadloom.llm.lexical_search import TOP
from threadloom.llm.licenses import BASE, TEMPLATES
from threadloom.llm.mixing import MOST_TIMES, SHARE, WEIGHTS
from threadloom.llm.near_dedup import PERCENT
from threadloom.llm.quality_rules import RULES, STOP_WORDS
from threadloom.llm.substring_dedup import WINDOW

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SPACE_CHARS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_rules(docs: str) -> str:
    """CTEs up to ``q_out``."""
    figures = {
        "chars_per_word": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_word_share": "n_stop / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    }
    tests = []
    for r in RULES:
        if r.low is not None:
            tests.append(f"{figures[r.figure]} >= {r.low}")
        if r.high is not None:
            tests.append(f"{figures[r.figure]} <= {r.high}")
    stop = ", ".join(f"'{s}'" for s in STOP_WORDS)
    return rf"""
q_words AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM {docs}),
q_windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM q_words)),
q_repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM q_windows) WHERE c > 1) GROUP BY doc_id),
q_counts AS (
  SELECT q.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop,
    list_filter(string_split(text, chr(10)), lambda x: trim(x, {SPACE_CHARS}) <> '') AS l,
    coalesce(r.n, 0) AS n_repeat_words
  FROM q_words q LEFT JOIN q_repeated r USING (doc_id)),
q_lines AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM q_counts),
q_out AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {' AND '.join(tests)} AS kept
  FROM q_lines)"""


def line_dedup(docs: str) -> str:
    """CTEs up to ``l_out``."""
    return rf"""
l_lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs})),
l_keys AS (SELECT *, {LOWER.format(f"trim(line, {SPACE_CHARS})")} AS k FROM l_lines),
l_firsts AS (SELECT k, min(doc_id) AS first_doc FROM l_keys WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
l_marked AS (SELECT l.*, coalesce(f.first_doc <> l.doc_id, false) AS gone FROM l_keys l LEFT JOIN l_firsts f USING (k)),
l_out AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM l_marked GROUP BY doc_id)"""


def near_dedup(docs: str) -> str:
    """CTEs up to ``n_out``; the first is recursive."""
    return rf"""
n_words AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
n_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM n_words WHERE len(w) > 0)),
n_sizes AS (SELECT doc_id, count(*) AS n FROM n_shingles GROUP BY doc_id),
n_common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM n_shingles a JOIN n_shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
n_links AS (
  SELECT a, b FROM n_common JOIN n_sizes x ON x.doc_id = a JOIN n_sizes y ON y.doc_id = b
  WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
n_reach AS (SELECT a AS root, a AS node FROM n_links UNION SELECT r.root, l.b FROM n_reach r JOIN n_links l ON l.a = r.node),
n_least AS (SELECT node, min(root) AS root FROM n_reach GROUP BY node),
n_out AS (
  SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.root, d.doc_id) AS component_id,
    d.doc_id = coalesce(l.root, d.doc_id) AS kept
  FROM {docs} d LEFT JOIN n_sizes s USING (doc_id) LEFT JOIN n_least l ON l.node = d.doc_id)"""


def overlaps(docs: str) -> str:
    """CTEs up to ``b_out``."""
    words = rf"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    seeds = " UNION ALL ".join(
        "SELECT id, pos, {m} AS mask, concat_ws(' ', {k}) AS seed FROM {t}_at".format(m=m, t="{t}", k=", ".join(f"w[pos + {o + 1}]" for o in mask))
        for m, mask in enumerate(MASKS)
    )
    return rf"""
b_doc AS (SELECT doc_id AS id, {words} AS w FROM {docs}),
b_item AS (SELECT item_id AS id, {words} AS w FROM benchmark),
b_doc_at AS (SELECT id, w, unnest(range(0, len(w) - {SPAN - 1})) AS pos FROM b_doc),
b_item_at AS (SELECT id, w, unnest(range(0, len(w) - {SPAN - 1})) AS pos FROM b_item),
b_hits AS (
  SELECT DISTINCT d.id AS doc, i.id AS item, d.pos - i.pos AS diagonal
  FROM ({seeds.format(t="b_doc")}) d JOIN ({seeds.format(t="b_item")}) i USING (mask, seed)),
b_cells AS (
  SELECT doc, item, diagonal, len(i.w) AS n, unnest(range(0, len(i.w))) AS j, d.w AS dw, i.w AS iw
  FROM b_hits JOIN b_doc d ON d.id = doc JOIN b_item i ON i.id = item),
b_marks AS (
  SELECT doc, item, diagonal, n, j,
    CASE WHEN diagonal + j >= 0 AND diagonal + j < len(dw) AND dw[diagonal + j + 1] = iw[j + 1] THEN 1 ELSE -1 END AS m
  FROM b_cells),
b_sums AS (SELECT *, sum(m) OVER (PARTITION BY doc, item, diagonal ORDER BY j) AS s FROM b_marks),
b_best AS (
  SELECT doc, item, n, s - least(0, coalesce(min(s) OVER (PARTITION BY doc, item, diagonal ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score
  FROM b_sums),
b_out AS (
  SELECT doc AS doc_id, item AS item_id, max(score)::BIGINT AS score, max(n) AS item_words FROM b_best
  GROUP BY doc, item HAVING max(score) >= least({LEAST_SCORE}, max(n)))"""


def mixing(docs: str) -> str:
    """CTEs up to ``m_out``."""
    weights = "CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {} {} END".format(
        len(WEIGHTS), " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    )
    return rf"""
m_sizes AS (
  SELECT doc_id, source, coalesce('s' || source, '-') AS k, len({WORDS}) AS size,
    (('0x' || substr(md5(concat_ws(':', '0', coalesce(doc_id::VARCHAR, '-'))), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(16**12)}::DOUBLE AS u
  FROM {docs}),
m_sources AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM m_sizes GROUP BY k),
m_limits AS (SELECT *, {weights} AS wt, source_size * {MOST_TIMES}::DOUBLE AS lim FROM m_sources),
m_levels AS (
  SELECT *, ((SELECT sum(source_size) FROM m_sources) * {SHARE}::DOUBLE
      - coalesce(sum(lim) OVER (ORDER BY lim / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(wt) OVER (ORDER BY lim / wt, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM m_limits),
m_level AS (SELECT max(lev) AS lev FROM m_levels),
m_targets AS (SELECT k, source_size, n_docs, least(lim, wt * (SELECT lev FROM m_level))::DOUBLE AS target FROM m_levels),
m_rates AS (
  SELECT s.*, t.source_size, t.target, 500 + (500 * size) // greatest(size + source_size // n_docs, 1) AS pull, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM m_sizes s JOIN m_targets t USING (k)),
m_pulls AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS p, sum(size * pull) OVER (PARTITION BY k)::BIGINT AS pulls FROM m_rates),
m_odds AS (SELECT *, CASE WHEN pulls > 0 THEN least(p * pull * source_size / pulls, 1) ELSE 0 END AS q FROM m_pulls),
m_order AS (SELECT *, CASE WHEN q > 0 THEN (u / (1 - u)) * (1 - q) / q ELSE 0 END AS odds FROM m_odds),
m_before AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY k ORDER BY odds, coalesce(doc_id::VARCHAR, '-'), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before
  FROM m_order),
m_out AS (
  SELECT doc_id, size, source_size, target,
    (whole + CASE WHEN p > 0 AND words_before + size / 2 < p * source_size THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM m_before)"""


def _license_words() -> str:
    lowered = LOWER.format("coalesce(text, '')")
    return rf"list_filter(regexp_split_to_array({lowered}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _licenses() -> str:
    parts = []
    for n, t in enumerate((*BASE, *TEMPLATES)):
        key = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(t.key_words))
        share = " + ".join(
            f"(CASE WHEN i + {j - t.key_at} >= 0 AND i + {j - t.key_at} < len(w) AND w[greatest(i + {j - t.key_at + 1}, 1)] = '{x}' THEN 1 ELSE 0 END)"
            for j, x in enumerate(t.all)
        )
        room = " + ".join(f"(i + {j - t.key_at} BETWEEN 0 AND len(w) - 1)::INT" for j in range(len(t.all)))
        parts.append(
            f"SELECT doc_id, '{t.label}' AS label, {n < len(BASE)} AS base, i, ({share}) / ({room})::DOUBLE AS share, {t.share}::DOUBLE AS least FROM c_at WHERE {key}"
        )
    return rf"""WITH
c_words AS (SELECT doc_id, {_license_words()} AS w FROM documents),
c_at AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM c_words),
c_all AS ({' UNION ALL '.join(parts)}),
c_found AS (SELECT * FROM c_all WHERE share >= least)
SELECT d.doc_id, any_value(len(d.w))::BIGINT AS n_words, count(*) FILTER (f.base) AS n_base,
  min(i) FILTER (f.base) AS first_word, max(i) FILTER (f.base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (f.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(share), 0)::DOUBLE AS score
FROM c_words d LEFT JOIN c_found f USING (doc_id) GROUP BY d.doc_id"""


_URLS = r"""WITH
u_rest AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u_parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u_rest),
u_rules(verdict, h, p) AS (VALUES {rules}),
u_fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM u_parts JOIN u_rules ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM u_parts u LEFT JOIN u_fits USING (page_id)"""

_SUBSTRINGS = rf"""WITH
r_words AS (SELECT doc_id, {WORDS} AS w FROM documents),
r_windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM r_words)),
r_hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM r_windows) WHERE c > 1),
r_gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r_hits),
r_left AS (
  SELECT d.doc_id, string_agg(d.x, ' ' ORDER BY d.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM r_words) d
  LEFT JOIN r_gone g ON g.doc_id = d.doc_id AND g.p = d.p WHERE g.p IS NULL GROUP BY d.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(w.w) - coalesce(l.n, 0) AS n_removed, sha256(coalesce(l.text, '')) AS kept_sha256
FROM r_words w LEFT JOIN r_left l USING (doc_id)"""


_SAYS = "'<|im_end|><|im_start|>assistant ok'"
_MARKS = sum(map(len, MARKS))
_CHATS = rf"""WITH
f_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {_SAYS}), (-1, 1, 'assistant', {_SAYS})),
f_long AS (
  SELECT *, {_MARKS} + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars
  FROM f_turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f_long GROUP BY conv_id""".replace("\\", "\\")

_TERMS = rf"list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SEARCH = rf"""WITH
s_docs AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s_all AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM s_docs WHERE len(w) > 0),
s_items AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
s_wanted AS (SELECT DISTINCT t FROM s_items),
s_tf AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM s_docs)
  WHERE t IN (SELECT t FROM s_wanted) GROUP BY ALL),
s_weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM s_tf, s_all GROUP BY t),
s_impacts AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) AS s
  FROM s_tf JOIN s_weights USING (t), s_all),
s_scores AS (SELECT item_id, doc_id, sum(s * times)::BIGINT AS score FROM s_items JOIN s_impacts USING (t) GROUP BY ALL HAVING sum(s * times) > 0)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s_scores) WHERE rank <= {TOP}"""


def sql(rules) -> dict[str, str]:
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return {
        "op2_quality_rules": f"WITH {quality_rules('documents')} SELECT * FROM q_out",
        "op3_near_dedup": f"WITH RECURSIVE {near_dedup('documents')} SELECT * FROM n_out",
        "op4_url_filters": _URLS.replace("{rules}", listed),
        "op5_decontamination": f"WITH {overlaps('documents')} SELECT * FROM b_out",
        "op6_license_scan": _licenses(),
        "op8_line_dedup": f"WITH {line_dedup('documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM l_out",
        "op9_source_mixing": f"WITH {mixing('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM m_out",
        "op10_substring_dedup": _SUBSTRINGS,
        "op11_chat_format": _CHATS,
        "op13_lexical_search": _SEARCH,
    }
