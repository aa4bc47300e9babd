"""The registered queries as SQL, where SQL can express them on whole tables."""

from __future__ import annotations

_CONTROL = r"<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]|\[ROLE\]|\[/ROLE\]|\[/TURN\]"

ORACLE: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH numbered AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
        split AS (
            SELECT k, doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM numbered
        ), windows AS (
            SELECT k, i, array_to_string(w[i : i + 34], ' ') AS s
            FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM split)
        ), repeated AS (
            SELECT k, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)
        ), words AS (
            SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split
        ), marked AS (
            SELECT k, i, word, count(r.i) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
            FROM words LEFT JOIN repeated r USING (k, i)
        ), kept AS (
            SELECT k, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS line
            FROM marked GROUP BY k
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (k)
    """,
    "op6_chat_format": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, length(regexp_replace(replace(text, '\', '\\'), '({_CONTROL})', '_\1', 'g'))
                + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 18 WHEN 'assistant' THEN 9
                       ELSE 20 + length(regexp_replace(replace(role, '\', '\\'), '({_CONTROL})', '_\1', 'g')) END AS size,
                lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after
            FROM turns
        ), loss AS (
            SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS trained,
                coalesce(before, 'start') || '>' || role IN
                    ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS known
            FROM sized
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(length(trained)) AS BIGINT) AS loss_chars,
            sha256(string_agg(trained, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(size) AS BIGINT) AS formatted_chars,
            bool_and(known) AND bool_or(after IS NULL AND role IN ('user', 'assistant')) AS valid_order
        FROM loss GROUP BY conv_id
    """,
    "op7_warc_chunks": """
        WITH sized AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), linked AS (
            SELECT *, CASE WHEN payload_bytes >= 100
                THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first
            FROM sized
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to
        FROM linked
    """,
    "op11_lexical_search": r"""
        WITH split AS (
            SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), total AS (
            SELECT count(*) FILTER (len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM split
        ), sized AS (
            SELECT k, doc_id, terms, 75 + (25 * len(terms) * n) // l AS m FROM split, total WHERE len(terms) > 0
        ), posted AS (
            SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM split) GROUP BY k, term
        ), weighed AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM posted, total GROUP BY term
        ), asked AS (
            SELECT item_id, term, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark
            ) GROUP BY item_id, term
        ), scored AS (
            SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM asked JOIN posted USING (term) JOIN weighed USING (term) JOIN sized USING (k) GROUP BY item_id, k, doc_id
        ), ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
            FROM scored WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_line_dedup": """
        WITH split AS (
            SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), single AS (
            SELECT k, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM split
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM single
        ), repeated AS (
            SELECT key, max(doc_id) AS largest FROM keyed
            WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT k, doc_id, i, line, coalesce(doc_id <> largest, false) AS gone
            FROM keyed LEFT JOIN repeated USING (key)
        )
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY k
    """,
    "op13_hard_negatives": """
        WITH given AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM given a JOIN given b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), negatives AS (
            SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM positives JOIN scored USING (anchor_id)
            WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM negatives WHERE rank <= 10
    """,
}
