"""DuckDB SQL that gives the rows of op11, op12 and op13, from the texts themselves: n-grams as strings, lines in one table, prefixes as joined texts."""

from __future__ import annotations


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: The table of CRC-32, by its rule.
CRC = "t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"


def _crc(numbers: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])))"


def _runs(w: str = "w") -> str:
    """All runs of one to three of some words."""
    two, three = f"{w}[i] || ' ' || {w}[i + 1]", f"{w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]"
    return f"unnest(list_concat({w}, list_transform(range(1, len({w})), lambda i: {two}), list_transform(range(1, len({w}) - 1), lambda i: {three})))"


_WORDS = rf"""regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_BYTES = "list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))"
_DIGITS = "list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

RESAMPLING = f"""WITH {CRC}, d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
      b AS (SELECT {_WORDS} AS w FROM benchmark),
      df AS (SELECT r, {_runs()} AS f FROM d),
      bf AS (SELECT {_runs()} AS f FROM b),
      v AS (SELECT f, {_crc(_BYTES)} % 10000 AS k FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)), t),
      dk AS (SELECT r, k FROM df JOIN v ON v.f = df.f), s AS (SELECT k, count(*) AS n FROM dk GROUP BY k), g AS (SELECT k, count(*) AS n FROM bf JOIN v ON v.f = bf.f GROUP BY k),
      a AS (SELECT (SELECT coalesce(sum(n), 0) + 10000 FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) + 10000 FROM g)::DOUBLE AS t),
      gain AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(g.n, 0) + 1) * a.s / ((s.n + 1) * a.t))) AS BIGINT) AS gain FROM s LEFT JOIN g ON g.k = s.k CROSS JOIN a),
      w AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dk JOIN gain ON gain.k = dk.k GROUP BY r),
      x AS (SELECT d.r, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON w.r = d.r),
      y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
      z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE able QUALIFY rank <= 5 * count(*) OVER () // 100)
      SELECT doc_id, n_features, weight, score, rank FROM y LEFT JOIN z ON z.r = y.r"""

LINES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
      k AS (SELECT *, {_lower(f"trim(line, {_SPACES})")} AS key, coalesce(doc_id, -9223372036854775807 - 1) AS id FROM l),
      p AS (SELECT key, max(id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT id) >= 5), g AS (SELECT k.*, coalesce(top <> id, false) AS gone FROM k LEFT JOIN p ON p.key = k.key)
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY r, doc_id"""

TRIE = f"""WITH {CRC}, o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
      n AS (SELECT c, c - c % 5 AS base, count(*) AS n, {_crc(_DIGITS)} % 9 AS h FROM o, t GROUP BY c, t.t),
      m AS (SELECT n.*, least(h, coalesce(b.n, 0)) AS shared FROM n LEFT JOIN (SELECT c, n FROM n) b ON b.c = n.base),
      s AS (SELECT m.c, i AS d, role, text FROM m JOIN o ON o.c = m.base AND i <= h UNION ALL SELECT m.c, i - h + shared, role, text FROM m JOIN o ON o.c = m.c AND i > h),
      p AS (SELECT c, d, text, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '/' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS node FROM s),
      q AS (SELECT c, d, text, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY d), '') AS up FROM p UNION ALL SELECT c, 0, '', '', NULL FROM m),
      e AS (SELECT c, max(d) AS len FROM q GROUP BY c),
      v AS (SELECT node, q.d, any_value(up) AS up, min(q.c) AS conv_id, count(*) AS n_convs, octet_length(encode(any_value(text))) AS bytes, sha256(coalesce(string_agg(q.c, ',' ORDER BY q.c) FILTER (WHERE q.d = len), '')) AS ends_sha256 FROM q JOIN e ON e.c = q.c GROUP BY node, q.d),
      k AS (SELECT up, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up), x AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN k ON k.up = v.node),
      b AS (SELECT DISTINCT a.node, a.d, z.node AS below, z.d AS depth FROM q a JOIN q z ON z.c = a.c AND z.d >= a.d),
      r AS (SELECT b.node, b.d, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, CAST(sum((x.n_convs - 1) * x.bytes) AS BIGINT) AS saved_tokens FROM b JOIN x ON x.node = b.below AND x.d = b.depth GROUP BY b.node, b.d)
      SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256 FROM x JOIN r ON r.node = x.node AND r.d = x.d LEFT JOIN x u ON u.node = x.up AND u.d = x.d - 1"""
