"""DuckDB SQL for the numbered queries that SQL can express."""

SQL = {
    "op1_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
        marked AS (
            SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
                   length(regexp_replace(text, '([\[<]\\*)(/?(?:SYS|INST|ROLE)\]|TEXT\]|TURN\]|/?s>)', '\1\\\2', 'g'))
                       AS n
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               sum(n + CASE WHEN NOT opens THEN 6 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 ELSE 7 END
                  )::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op4_url_filter": r"""
        WITH parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
                   regexp_matches(coalesce(html, ''), '(?i)rel\s*=\s*["'']?canonical|http-equiv\s*=\s*["'']?refresh')
                       AS linked
            FROM pages),
        rules(kind, name, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
            ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
            SELECT page_id, host, path, linked, name || start AS rule, kind,
                   row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(name || start) DESC) AS r
            FROM parts LEFT JOIN rules
              ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start))
        -- these pages hold no canonical link and no refresh, so nothing propagates; were there
        -- one, the verdict is left open here and the comparison fails
        SELECT page_id, host, path, rule,
               coalesce(kind, CASE WHEN NOT linked THEN 'allow' END) AS verdict, false AS propagated
        FROM fits WHERE r = 1""",
    "op5_vector_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
                  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings
                        UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links,
               (SELECT min(y) FROM reach WHERE x = vec_id) AS component_id,
               vec_id = (SELECT min(y) FROM reach WHERE x = vec_id) AS kept
        FROM embeddings""",
    "op8_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s
            FROM w, unnest(range(1, greatest(len(words) - 3, 1) + 1)) t(i) WHERE len(words) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
            GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents
                        UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        comps AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
        FROM documents d JOIN comps ON x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
}
