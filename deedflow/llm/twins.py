"""DuckDB twins of the training-data queries."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"


def crc32(column: str) -> str:
    """crc32 of an integer's decimal text, bit by bit."""
    bytes_ = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda a, b: {step}), 4294967295)"


def merkle(levels: int = 6, upper: int = 3) -> str:
    """Levels of eight up to 8 ** ``levels`` leaves a language and 8 ** ``upper`` languages."""
    fields = " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    text = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"
    out = f"""WITH d AS (
        SELECT doc_id, lang, sha256({fields} || {text.format("text")}) AS leaf,
               CASE WHEN {crc32("doc_id")} % 3 = 0 THEN sha256({fields} || {text.format(f"translate(text, {letters})")}) END AS changed FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        a0 AS (SELECT lang, i, leaf AS h FROM l),
        f0 AS (SELECT doc_id, lang, i, leaf, coalesce(changed, leaf) AS f, '' AS p FROM l)"""

    def level(a: str, f: str, k: int, group: str, last: str, carried: str) -> str:
        # a node's siblings stand to its left and right in its run; a level of one node is carried up as it is
        run = f"PARTITION BY {group}, i // 8 ORDER BY i ROWS BETWEEN"
        return f""",
        {a}n{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {group}) AS n,
               coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}{k}),
        {a}{k + 1} AS MATERIALIZED (SELECT {group}, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {a}n{k} GROUP BY {group}, i // 8),
        {f}{k + 1} AS MATERIALIZED (SELECT {carried}, {last} x.i // 8 AS i, CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f, p || l || r AS p
               FROM {f}{k} x JOIN {a}n{k} y ON x.{group} IS NOT DISTINCT FROM y.{group} AND x.i = y.i)"""

    for k in range(levels):
        out += level("a", "f", k, "lang", "", "doc_id, x.lang, leaf")
    out += f""",
        b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, lang FROM a{levels}),
        e0 AS (SELECT doc_id, leaf, 0 AS g, b0.i AS i, b0.h AS subroot, f, p FROM f{levels} x JOIN b0 ON x.lang IS NOT DISTINCT FROM b0.lang)"""
    for k in range(upper):
        out += level("b", "e", k, "g", "subroot,", "doc_id, x.g, leaf")
    return (
        out
        + f""" SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM e{upper} CROSS JOIN b{upper}"""
    )


TRIE = f"""WITH t AS (
        SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    m AS (SELECT conv_id AS c, {crc32("conv_id")} % 4 AS h, count(*) AS n FROM conversations GROUP BY conv_id),
    s AS (SELECT m.c, i AS place, role, text FROM m JOIN t ON t.c = m.c - m.c % 20 AND i < h
          UNION ALL SELECT m.c, 4 + i, role, text FROM m JOIN t ON t.c = m.c AND i >= h),
    r AS MATERIALIZED (SELECT c, row_number() OVER w AS d, len(regexp_extract_all(text, '{WORDS}')) AS words, list({{'role': role, 'text': text}}) OVER w AS k
          FROM s WINDOW w AS (PARTITION BY c ORDER BY place)),
    z AS MATERIALIZED (SELECT c, 0 AS d, 0 AS words, [] AS k FROM m UNION ALL SELECT c, d, words, k FROM r),
    l AS (SELECT c, max(d) AS length FROM z GROUP BY c),
    n AS MATERIALIZED (SELECT d, k, min(z.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
          coalesce(string_agg(CASE WHEN d = length THEN CAST(z.c AS VARCHAR) END, ',' ORDER BY z.c), '') AS ends
          FROM z JOIN l ON l.c = z.c GROUP BY d, k),
    u AS MATERIALIZED (SELECT n.d, n.conv_id, p.conv_id AS parent FROM n LEFT JOIN z ON z.c = n.conv_id AND z.d = n.d - 1 LEFT JOIN n p ON p.d = z.d AND p.k = z.k),
    o AS MATERIALIZED (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n FROM u WHERE d > 0 GROUP BY ALL),
    b AS (SELECT v.d, v.k, sum(n.own) AS saved, count(*) FILTER (WHERE o.n IS NULL) AS leaves
          FROM n LEFT JOIN o ON o.d = n.d AND o.conv_id = n.conv_id JOIN z ON z.c = n.conv_id AND z.d <= n.d JOIN n v ON v.d = z.d AND v.k = z.k GROUP BY v.d, v.k)
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.parent AS parent_conv_id, n.n_convs, coalesce(o.n, 0) AS n_children, b.leaves AS n_leaves,
           CAST(b.saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
    FROM n JOIN u ON u.d = n.d AND u.conv_id = n.conv_id LEFT JOIN o ON o.d = n.d AND o.conv_id = n.conv_id JOIN b ON b.d = n.d AND b.k = n.k
"""

ORACLE_SQL: dict[str, str] = {
    "op6_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM s)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM r
    """,
    "op11_merkle_manifest": merkle(),
    "op12_prefix_trie": TRIE,
    "op13_exact_duplicates": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
}
