"""SQL of the registered queries, where SQL can tell them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keep AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank,
         vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

URL_FILTER = f"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'),
  ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
own AS (
  SELECT p.page_id, p.url, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule,
         arg_max(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT DISTINCT * FROM parts) p LEFT JOIN rules r
    ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))
  GROUP BY ALL),
forms AS (
  SELECT *, CASE WHEN strpos(url, '://') > 0 THEN host || regexp_replace(path, '(/index\\.html?|/)$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
         string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
         lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), ''), '') END AS form
  FROM own)
SELECT f.page_id, f.host, f.path, f.rule,
       coalesce(f.verdict, CASE WHEN f.form IN
         (SELECT form FROM forms WHERE verdict = 'block' AND form IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM forms f JOIN pages p ON p.page_id = f.page_id AND p.url IS NOT DISTINCT FROM f.url
"""

# CRC-32 of UTF-8 text, a byte at a time over the table of the reversed polynomial.
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t"""


def _crc32(text: str) -> str:
    byte_at = f"(('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT)"
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte_at})"
    step = "xor(c // 256, t[(xor(c, b) % 256 + 1)::INT])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}), 4294967295)"


RESAMPLING = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
words AS MATERIALIZED (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') FROM benchmark),
long AS MATERIALIZED (SELECT side, id, unnest(w) AS word FROM words),
named AS MATERIALIZED (
  SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM long), crc),
counted AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t
  FROM long JOIN named USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE)))::BIGINT AS g FROM counted),
weights AS (
  SELECT id, sum(g)::BIGINT AS weight FROM long JOIN named USING (word) JOIN gain USING (bucket)
  WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 'd'),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, r.place AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id AND r.place <= r.n * 10 // 100
"""

LEVELS_OF_A_SOURCE, LEVELS_OF_SOURCES = 6, 4


def _levels(name: str, first: str, levels: int) -> str:
    """CTEs name_0 .. name_levels: nodes (tree, idx, n, digest) of each level; a tree of one node stays as it is."""
    out = [f"{name}_0 AS MATERIALIZED ({first})"]
    for i in range(levels):
        out.append(f"""{name}_{i + 1} AS MATERIALIZED (
  SELECT tree, idx // 16 AS idx, any_value((n + 15) // 16) AS n,
         CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest
  FROM {name}_{i} GROUP BY tree, idx // 16)""")
    return ",\n".join(out)


def _steps(name: str, levels: int, node: str, tree: str) -> str:
    """The siblings before and after a leaf's node on each level, as a list from the leaf up."""
    def side(i: int, sign: str) -> str:
        power = 16**i
        return f"""coalesce((SELECT string_agg(s.digest, '' ORDER BY s.idx) FROM {name}_{i} s
    WHERE s.tree = {tree} AND s.idx // 16 = {node} // {16 * power} AND s.idx {sign} {node} // {power}), '')"""
    # A tree that has ended has no siblings; its one node is not hashed again.
    return ", ".join(
        f"{{'more': (SELECT any_value(s.n) > 1 FROM {name}_{i} s WHERE s.tree = {tree}), 'before': {side(i, '<')}, 'after': {side(i, '>')}}}"
        for i in range(levels)
    )


def _framed(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields)


MERKLE = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
rows_ AS MATERIALIZED (
  SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({_framed("text")}) AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0
              THEN sha256({_framed(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS changed
  FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n FROM rows_),
{_levels("low", "SELECT tree, idx, n, leaf AS digest FROM leaves", LEVELS_OF_A_SOURCE)},
tops AS MATERIALIZED (
  SELECT tree AS source_tree, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n, digest
  FROM low_{LEVELS_OF_A_SOURCE}),
{_levels("high", "SELECT tree, idx, n, digest FROM tops", LEVELS_OF_SOURCES)},
paths AS (
  SELECT l.doc_id, l.leaf, l.changed, t.digest AS subroot, (SELECT digest FROM high_{LEVELS_OF_SOURCES}) AS root,
         [{_steps("low", LEVELS_OF_A_SOURCE, "l.idx", "l.tree")},
          {_steps("high", LEVELS_OF_SOURCES, "t.idx", "t.tree")}] AS path
  FROM leaves l JOIN tops t ON t.source_tree = l.tree),
folded AS (
  SELECT *, list_reduce(list_prepend({{'more': true, 'before': '', 'after': coalesce(changed, leaf)}}, path),
           lambda acc, s: {{'more': true, 'before': '',
             'after': CASE WHEN s.more THEN sha256(s.before || acc.after || s.after) ELSE acc.after END}}).after AS folded_root
  FROM paths)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(path, lambda s: s.before || s.after), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

ORACLE = {
    "op1_redirect_url_filter": URL_FILTER,
    "op5_exact_top_k": TOP_K,
    "op6_line_dedup": LINE_DEDUP,
    "op11_importance_resampling": RESAMPLING,
    "op13_merkle_manifest": MERKLE,
}
