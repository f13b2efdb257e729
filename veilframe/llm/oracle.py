"""SQL for the registered queries that SQL can express."""

from veilframe.llm.mixing import oracle_sql

def _words(text: str) -> str:
    """Words of letters, digits and characters beyond ASCII, A-Z in lower case."""
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"coalesce(regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


def _crc_table() -> list[int]:
    """The 256 steps of the reflected CRC-32 polynomial."""
    steps = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    return steps


def _crc32(text: str) -> str:
    """CRC-32 of a text whose characters lie below U+0800, in UTF-8."""
    octets = f"""flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
                 ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END))"""
    step = f"xor(crc >> 8, {_crc_table()}[(xor(crc, octet) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda crc, octet: {step}), 4294967295)"


ORACLE: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_mixing": oracle_sql(),
    "op12_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS words FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_words("text")} AS words FROM benchmark),
        w AS (SELECT DISTINCT item, list_slice(words, i, i + least(10, len(words)) - 1) AS w
              FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM b WHERE len(words) > 0)),
        k AS (SELECT DISTINCT len(w) AS k FROM w),
        o AS (SELECT r, i, k, item
              FROM (SELECT r, i, k, list_slice(words, i, i + k - 1) AS w
                    FROM (SELECT r, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM d, k)) JOIN w USING (w)),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM o) GROUP BY r),
        n AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)""",
    "op13_variants": f"""
        WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
                unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00c0-\u00ff]+')) AS run
              FROM documents),
        r AS MATERIALIZED (SELECT run, count, {_crc32("id || ':' || run")} AS h FROM (SELECT id, run, count(*) AS count FROM t GROUP BY ALL)),
        v AS MATERIALIZED (SELECT word, sum(count)::BIGINT AS n
              FROM (SELECT count, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM r)
              WHERE length(word) >= 6 GROUP BY word HAVING sum(count) >= 5),
        d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
              FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
        p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b USING (i, rest) WHERE a.word <> b.word
              UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
              UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
        f AS MATERIALIZED (SELECT word, v.n, count(other) AS n_near, max(other_n) AS top, arg_max(other, (other_n, -rank)) AS best
              FROM v LEFT JOIN (SELECT p.*, row_number() OVER (ORDER BY other) AS rank FROM p) USING (word) GROUP BY ALL),
        g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN top >= 5 * n THEN best END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM f),
        c AS (SELECT word, word AS root FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL)
        SELECT g.word, form, root, n, n_near, form_n
        FROM g JOIN (SELECT c.word, c.root FROM c JOIN g ON g.word = c.root WHERE g.form IS NULL) USING (word)""",
}
