"""The operators' queries in SQL, where SQL can express them."""

ORACLE = {
    "op4_decontaminate": r"""
        WITH doc AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
            FROM documents
        ),
        item AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
            FROM benchmark
        ),
        windows AS (
            SELECT DISTINCT item_id, least(13, len(words)) AS n,
                array_to_string(words[i : i + least(13, len(words)) - 1], ' ') AS w
            FROM (SELECT item_id, words,
                    unnest(generate_series(1, greatest(1, len(words) - 12))) AS i
                  FROM item WHERE len(words) > 0)
        ),
        places AS (
            SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS w
            FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i
                  FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)
        ),
        found AS (SELECT doc_id, i, places.n, item_id FROM places JOIN windows USING (n, w)),
        hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found)
            GROUP BY doc_id
        ),
        owners AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
    """,
    "op6_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        part AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM whole),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
            FROM part AS q JOIN part AS c USING (d)
            WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
            GROUP BY q.vec_id, c.vec_id
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 20
    """,
    "op10_substring": r"""
        WITH doc AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''),
                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ),
        windows AS (
            SELECT doc_id, i, sha256(array_to_string(words[i : i + 34], ' ')) AS w
            FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS i
                  FROM doc WHERE len(words) >= 35)
        ),
        again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p
            FROM windows SEMI JOIN again USING (w)
        ),
        word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM doc),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
            FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (doc_id)
    """,
    "op11_lexical": r"""
        WITH term AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM documents
        ),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark
        ),
        size AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
        corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
        held AS (SELECT doc_id, t, count(*) AS tf FROM term SEMI JOIN asked USING (t) GROUP BY doc_id, t),
        weight AS (
            SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM held, corpus GROUP BY t
        ),
        impact AS (
            SELECT doc_id, t,
                (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)) AS x
            FROM held JOIN size USING (doc_id), corpus
        ),
        scored AS (
            SELECT item_id, doc_id, sum(w * x)::BIGINT AS score
            FROM asked JOIN weight USING (t) JOIN impact USING (t) GROUP BY item_id, doc_id
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
              FROM scored WHERE score > 0)
        WHERE rank <= 50
    """,
    "op13_collocations": r"""
        WITH piece AS (
            SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'),
                lambda w: w <> '') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]')) AS piece
                  FROM documents)
        ),
        word AS (SELECT p, lang, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM piece),
        place AS (
            SELECT lang, t AS t1, lead(t) OVER piece AS t2, lead(t, 2) OVER piece AS t3
            FROM word WINDOW piece AS (PARTITION BY p ORDER BY i)
        ),
        found AS MATERIALIZED (
            SELECT lang, 1 AS size, t1 AS phrase, count(*) AS f FROM place GROUP BY ALL
            UNION ALL SELECT lang, 2, t1 || ' ' || t2, count(*) FROM place WHERE t2 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 3, t1 || ' ' || t2 || ' ' || t3, count(*) FROM place WHERE t3 IS NOT NULL GROUP BY ALL
        ),
        total AS (SELECT lang, sum(f)::BIGINT AS n FROM found WHERE size = 1 GROUP BY lang),
        candidate AS (SELECT * FROM found WHERE size > 1 AND f >= 10),
        part AS MATERIALIZED (
            SELECT lang, phrase, size, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS p1,
                array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS p2
            FROM candidate, (VALUES (1), (2)) AS cuts(k) WHERE k < size
        ),
        cut AS (
            SELECT part.lang, part.phrase, part.size, a, k, l.f AS l, r.f AS r,
                ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM part JOIN found AS l ON l.lang = part.lang AND l.phrase = p1
            JOIN found AS r ON r.lang = part.lang AND r.phrase = p2
        ),
        best AS (
            SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ),
        inside AS (
            SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase, max(f) AS longer
            FROM candidate, (VALUES (1), (2)) AS spots(i) WHERE size = 3 GROUP BY ALL
        )
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT b.*, row_number() OVER (
                PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
              FROM best AS b LEFT JOIN inside AS i ON i.lang = b.lang AND i.phrase = b.phrase
              WHERE longer IS NULL OR 100 * longer < 50 * a)
        JOIN total USING (lang)
        WHERE rank <= 2000
    """,
}
