"""DuckDB SQL for those queries of this subpackage that SQL can express; each counts and joins plainly, by another way."""

from __future__ import annotations

from . import quality, search, urls
from .queries import ORACLES, URL_RULES

_WORD = r"[^\x20\x09-\x0D]+"
_LIST = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"

ORACLES["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
grams AS (SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 9)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM grams) WHERE n > 1),
reps AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY k),
lines AS (SELECT k, l, regexp_extract_all(l, '{_WORD}') AS lw, regexp_extract_all(lower(l), '{quality.HINTS}') AS hints FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (SELECT k, l, len(lw) AS n,
  100 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > 15 * list_sum([length(x) FOR x IN lw])
  OR 2 * (length(l) - length(replace(l, '!', ''))) > len(lw)
  OR ((len(lw) < 5 OR 5 * len([x FOR x IN lw IF list_contains({_LIST(quality.BARS)}, x)]) >= len(lw)) AND NOT list_contains({_LIST(quality.TERMINALS)}, right(lw[-1], 1)))
  OR (len(lw) <= {quality.LONG_LINE} AND (regexp_matches(lower(l), '{quality.BOILERPLATE}') OR len(list_distinct(hints)) > 1 OR 2 * list_sum([len(string_split(h, ' ')) FOR h IN hints]) >= len(lw)
    OR (len(hints) > 0 AND len(lw) <= {quality.SHORT_LINE} AND NOT list_contains({_LIST(quality.TERMINALS)}, right(lw[-1], 1)))))
  OR (len(lw) >= 8 AND 3 * list_sum([(lw[i] = lw[i + 1])::INTEGER FOR i IN range(1, len(lw))]) > len(lw))
  OR NOT regexp_matches(l, '\p{{L}}') AS fails FROM lines WHERE len(lw) > 0),
per AS (SELECT k, count(*) - count(DISTINCT l) AS dups, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY k),
base AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost FROM w LEFT JOIN per USING (k) LEFT JOIN reps USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= 50 * n_words AS kept FROM base"""

ORACLES["op4_topk_search"] = rf"""
WITH words AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[\x00-/:-`{{-\x7F]+', ' ', 'g')), ' ') AS ws FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, [x FOR x IN ws IF x <> ''] AS ws FROM words),
size AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM docs),
tf AS (SELECT doc_id, len(ws) AS length, w, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM docs) GROUP BY ALL),
idf AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, size GROUP BY w, n),
asked AS (SELECT doc_id AS query_id, w, idf FROM tf JOIN idf USING (w) WHERE doc_id % 20 = 0),
scored AS (SELECT query_id, doc_id AS row_id, sum(idf * tf * ({search.K1} + 1) / (tf + {search.K1} * (1 - {search.B} + {search.B} * length / mean))) AS score FROM asked JOIN tf USING (w), size GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) AS rank FROM scored)
SELECT query_id, row_id, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10"""

_RULES = ", ".join(f"('{says}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for says, r in URL_RULES)


def _orders() -> str:
    """P of a symbol after contexts of 0 to 3 symbols, one CTE an order."""
    out = "p0 AS (SELECT DISTINCT g, 1 / 32.0::DOUBLE AS py, 1 / 32.0::DOUBLE AS pn FROM grams)"
    for k in range(1, 5):
        out += f""",
n{k} AS (SELECT right(g, {k}) AS gram, sum(yes) AS yes, sum(no) AS no FROM counts GROUP BY 1),
x{k} AS (SELECT left(gram, {k - 1}) AS x, sum(yes) AS ya, count(*) FILTER (yes > 0) AS yk, sum(no) AS na, count(*) FILTER (no > 0) AS nk FROM n{k} GROUP BY 1),
p{k} AS (SELECT g, CASE WHEN ya >= {urls.LEAST_SEEN} THEN (coalesce(yes, 0) + yk * py) / (ya + yk)::DOUBLE ELSE py END AS py, CASE WHEN na >= {urls.LEAST_SEEN} THEN (coalesce(no, 0) + nk * pn) / (na + nk)::DOUBLE ELSE pn END AS pn
  FROM p{k - 1} LEFT JOIN x{k} ON x = left(right(g, {k}), {k - 1}) LEFT JOIN n{k} ON gram = right(g, {k}))"""
    return out


ORACLES["op8_url_filters"] = rf"""
WITH pages_ AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
cut AS (SELECT DISTINCT u, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM pages_),
hosts AS (SELECT u, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM cut),
urls AS (SELECT u, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM hosts),
rules(says, rule, rhost, rpath) AS (VALUES {_RULES}),
ruled AS (SELECT u, arg_max(rule, (length(rule), rule)) AS rule, arg_max(says, (length(rule), rule)) AS says FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY u),
marked AS (SELECT urls.*, rule, says, md5(u)[1] < '4' AS held FROM urls LEFT JOIN ruled USING (u)),
apart AS (SELECT count(DISTINCT (says, held)) = 4 AS apart FROM marked WHERE says IS NOT NULL),
sym AS (SELECT u, says, held, '^^^' || regexp_replace(translate(lower(regexp_replace(u, '^[^:/?#]*://', '')), '123456789', '000000000'), '[^a-z0/.\-]', '~', 'g') || '^' AS s FROM marked),
grams AS (SELECT u, says, held, substr(s, i - 3, 4) AS g FROM (SELECT *, unnest(range(4, length(s) + 1)) AS i FROM sym)),
counts AS (SELECT g, count(*) FILTER (says = 'allow') AS yes, count(*) FILTER (says = 'block') AS no FROM grams, apart WHERE says IS NOT NULL AND NOT (held AND apart) GROUP BY g),
{_orders()},
scored AS (SELECT u, says, held, floor(sum(round((ln(py) - ln(pn)) * {urls.UNIT})::BIGINT) * 1000 / count(*) / {urls.UNIT})::BIGINT AS score FROM grams JOIN p4 USING (g) GROUP BY u, says, held),
bins AS (SELECT greatest(-20000, least(20000, score)) AS bin, count(*) FILTER (says = 'allow') AS yes, count(*) FILTER (says = 'block') AS no FROM scored, apart WHERE says IS NOT NULL AND (held OR NOT apart) GROUP BY 1),
total AS (SELECT sum(yes) AS a, sum(no) AS r FROM bins),
run AS (SELECT bin, sum(yes) OVER (ORDER BY bin) - yes AS missed, r - (sum(no) OVER (ORDER BY bin) - no) AS passed, a, r FROM bins, total),
limits AS (SELECT (SELECT bin FROM run WHERE a > 0 AND r > 0 ORDER BY missed / a + passed / r, bin LIMIT 1) AS threshold)
SELECT page_id, host, path, rule, coalesce(m.says, CASE WHEN threshold IS NULL OR score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, score FROM pages_ JOIN marked m USING (u) JOIN scored USING (u), limits"""

ORACLES["op11_substring_dedup"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (SELECT k, doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS w FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
gone AS (SELECT k, list(i ORDER BY i) AS starts FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id GROUP BY k),
places AS (SELECT k, list_distinct(flatten([range(i, i + 50) FOR i IN starts])) AS p FROM gone),
edges AS (SELECT k, i AS s, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM (SELECT k, unnest(starts) AS i FROM gone)),
spans AS (SELECT k, (min(s) - 1)::INTEGER AS start, (max(s) + 49)::INTEGER AS stop FROM (SELECT *, count(*) FILTER (before IS NULL OR s > before + 50) OVER (PARTITION BY k ORDER BY s) AS run FROM edges) GROUP BY k, run),
per AS (SELECT k, string_agg(start || '-' || stop, ' ' ORDER BY start) AS removed FROM spans GROUP BY k),
kept AS (SELECT k, sha256(array_to_string([x FOR x, i IN ws IF NOT list_contains(coalesce(p, []), i)], ' ')) AS h, coalesce(len(p), 0) AS n FROM d LEFT JOIN places USING (k))
SELECT doc_id, len(ws)::BIGINT AS n_words, n::BIGINT AS n_removed, h AS kept_sha256, coalesce(removed, '') AS removed FROM d JOIN kept USING (k) LEFT JOIN per USING (k)"""

ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _tree(name: str, levels: int) -> str:
    """CTEs over {name}0 (tree, i, d): nodes by level, and of each node what stands before and after it among its siblings.

    A tree of one node stays as it is. Unrolled: 8**levels leaves at most.
    """
    out = ""
    for k in range(levels):
        out += f""",
{name}m{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}),
{name}s{k} AS (SELECT tree, i, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
  CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM {name}m{k}),
{name}{k + 1} AS (SELECT tree, i // 8 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {name}m{k} GROUP BY tree, i // 8)"""
    return out


def _way(name: str, of: str, levels: int) -> str:
    """CTEs that take {of} (i, tree, proof, f) up the tree: proofs grow, and f becomes the folded digest."""
    out = ""
    for k in range(levels):
        out += f""",
{name}w{k} AS (SELECT w.* REPLACE (proof || coalesce(l, '') || coalesce(r, '') AS proof, CASE WHEN l IS NULL THEN f ELSE sha256(l || f || r) END AS f, w.i // 8 AS i) FROM {of if k == 0 else f"{name}w{k - 1}"} w JOIN {name}s{k} s ON w.tree = s.tree AND w.i = s.i)"""
    return out


_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
#: crc32 of a decimal id, bit by bit over the polynomial 0xEDB88320.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT FOR _ IN range(8)]), lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""

ORACLES["op13_merkle_manifest"] = rf"""
WITH d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, xor({_CRC}, 4294967295) AS crc FROM documents),
leaves AS (SELECT doc_id, lang, {_LEAF("text")} AS leaf, CASE WHEN crc % 3 = 0 THEN {_LEAF("low")} ELSE {_LEAF("text")} END AS claimed FROM d),
ranked AS (SELECT *, coalesce('+' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
a0 AS (SELECT tree, i, leaf AS d FROM ranked){_tree("a", 9)},
b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, tree AS own FROM a9),
b00 AS (SELECT * FROM b0){_tree("b", 3).replace("FROM b0)", "FROM (SELECT tree, i, d FROM b00))", 1)},
start AS (SELECT *, '' AS proof, claimed AS f FROM ranked){_way("a", "start", 9)},
then_ AS (SELECT w.* REPLACE (b.i AS i, 0 AS tree), b.d AS subroot FROM aw8 w JOIN b00 b ON b.own = w.tree){_way("b", "then_", 3)}
SELECT doc_id, leaf, subroot, b3.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b3.d AS verified FROM bw2, b3"""
