"""SQL for DuckDB of those training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_REACH = """reach AS (SELECT DISTINCT a AS start, a AS node FROM links UNION SELECT r.start, l.b FROM reach r JOIN links l ON r.node = l.a),
    names AS (SELECT start AS id, min(node) AS name FROM reach GROUP BY start)"""

ORACLES = {
    "op2_minhash": rf"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
    sets AS (SELECT doc_id, CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words WHERE len(w) > 0),
    flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) + any_value(y.n) AS total, count(*) AS n_both
        FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared WHERE 100 * n_both >= 80 * (total - n_both)), {_REACH}
    SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(m.name, d.doc_id) AS component_id,
           coalesce(m.name, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN names m ON d.doc_id = m.id""",
    "op6_spherical_caps": f"""
    WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
        WHERE list_cosine_similarity(x.e, y.e) >= 0.98), {_REACH},
    degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT v.vec_id, coalesce(d.n, 0) AS n_links, coalesce(m.name, v.vec_id) AS component_id, coalesce(m.name, v.vec_id) = v.vec_id AS kept
    FROM embeddings v LEFT JOIN degrees d ON v.vec_id = d.a LEFT JOIN names m ON v.vec_id = m.id""",
    "op10_chat_formatting": r"""
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    parts AS (SELECT *, 2 + length(role) + 3 + 10
        + length(regexp_replace(text, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')) AS size FROM turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(size) AS BIGINT) AS formatted_chars
    FROM parts GROUP BY conv_id""",
    "op13_merkle_manifest": r"""
    WITH RECURSIVE rows AS (SELECT doc_id, lang, n_chars,
            coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
            coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents),
    crc AS (SELECT i AS byte, i AS c FROM range(256) t(i)),
    steps AS (SELECT byte, c, 0 AS k FROM crc UNION ALL
        SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
    sums AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS d, 0 AS place, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL UNION ALL
        SELECT doc_id, d, place + 1, xor(c >> 8, t[CAST(xor(c, CAST(ascii(substr(d, place + 1, 1)) AS BIGINT)) & 255 AS BIGINT) + 1]) FROM sums, crc_table WHERE place < length(d)),
    sevenths AS (SELECT doc_id FROM sums WHERE place = length(d) AND xor(c, 4294967295) % 7 = 0),
    leaves AS (SELECT r.doc_id, lang, sha256(head || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || tail) AS leaf,
            sha256(head || coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') || tail) AS other, s.doc_id IS NOT NULL AS hit
        FROM rows r LEFT JOIN sevenths s ON r.doc_id = s.doc_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
            dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
    tree AS (SELECT 0 AS level, g, i, n, leaf AS h FROM placed UNION ALL
        SELECT a.level + 1, a.g, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, '')) FROM tree a LEFT JOIN tree b ON a.g = b.g AND b.i = a.i + 1
        WHERE a.i % 2 = 0 AND a.n > 1),
    tops AS (SELECT g, h, count(*) OVER () AS n FROM tree WHERE n = 1),
    crown AS (SELECT 0 AS level, g AS i, n, h FROM tops UNION ALL
        SELECT a.level + 1, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, '')) FROM crown a LEFT JOIN crown b ON b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.n > 1),
    climb AS (SELECT g, i AS own, i, 0 AS level, n, CASE WHEN hit THEN other ELSE leaf END AS h, '' AS proof FROM placed UNION ALL
        SELECT c.g, c.own, c.i // 2, c.level + 1, (c.n + 1) // 2,
            sha256(CASE WHEN c.i % 2 = 1 THEN t.h || c.h ELSE c.h || coalesce(t.h, '') END), c.proof || coalesce(t.h, '')
        FROM climb c LEFT JOIN tree t ON t.level = c.level AND t.g = c.g AND t.i = xor(c.i, 1) WHERE c.n > 1),
    over AS (SELECT c.g, c.own, c.g AS i, 0 AS level, t.n, c.h, c.proof FROM climb c JOIN tops t ON c.g = t.g WHERE c.n = 1 UNION ALL
        SELECT c.g, c.own, c.i // 2, c.level + 1, (c.n + 1) // 2,
            sha256(CASE WHEN c.i % 2 = 1 THEN t.h || c.h ELSE c.h || coalesce(t.h, '') END), c.proof || coalesce(t.h, '')
        FROM over c LEFT JOIN crown t ON t.level = c.level AND t.i = xor(c.i, 1) WHERE c.n > 1),
    root AS (SELECT h FROM crown WHERE n = 1)
    SELECT p.doc_id, p.leaf, t.h AS subroot, root.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = root.h AS verified
    FROM placed p JOIN tops t ON p.g = t.g JOIN over o ON o.g = p.g AND o.own = p.i AND o.n = 1 CROSS JOIN root""",
    "op12_ranked_search": rf"""
    WITH words AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents WHERE text IS NOT NULL),
    sized AS (SELECT row, doc_id, len(w) AS n FROM words WHERE len(w) > 0),
    totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM sized),
    items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
    counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(documents) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM counts, totals GROUP BY term),
    scores AS (SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // length)))) AS BIGINT) AS score
        FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN sized USING (row), totals GROUP BY item_id, row)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 10""",
}
