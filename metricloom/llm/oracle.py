"""DuckDB SQL of the queries that SQL can express."""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: crc32 of the decimal digits of conv_id, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT),
      lambda r, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)),
        xor(r, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""

SQL = {
    "op1_exact_dedup": """SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
    doc_id = max(doc_id) OVER copies AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW copies AS (PARTITION BY coalesce(text, ''))""",
    "op6_decontamination": f"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    windows AS (SELECT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS words
      FROM items, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
    docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    places AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS words
      FROM docs, (SELECT DISTINCT n FROM windows), unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
    found AS (SELECT DISTINCT doc_id, item_id, n, i FROM places JOIN windows USING (n, words)),
    hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM
      (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY 1),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_hard_negatives": """WITH vectors AS (SELECT vec_id,
      CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
      list_inner_product(a.v, b.v)::BIGINT AS score
      FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10""",
    "op13_prefix_trie": f"""WITH given AS (SELECT conv_id, turn, coalesce(text, '') AS text,
      sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS h
      FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS place FROM given),
    lengths AS (SELECT conv_id AS base, count(*) AS n FROM turns GROUP BY 1),
    convs AS (SELECT conv_id, ({_CRC} % 6)::BIGINT AS taken, conv_id - conv_id % 100 AS base
      FROM (SELECT DISTINCT conv_id FROM turns)),
    rebuilt AS (SELECT c.conv_id, place AS d, text, h FROM convs c JOIN turns t ON t.conv_id = base AND place <= taken
      UNION ALL SELECT c.conv_id, place - taken + least(taken, coalesce(n, 0)), text, h
      FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > taken LEFT JOIN lengths l ON l.base = c.base),
    prefixes AS (SELECT conv_id, 0 AS d, '' AS k, 0 AS chars FROM convs UNION ALL
      SELECT conv_id, d, sha256(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY d)), length(text) FROM rebuilt),
    linked AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS parent,
      lead(d) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS is_end FROM prefixes),
    counted AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
      any_value(parent) AS parent,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
      FROM linked GROUP BY k, d),
    below AS (SELECT parent AS k, count(*) AS n_children FROM counted GROUP BY 1),
    nodes AS (SELECT c.*, coalesce(n_children, 0) AS n_children FROM counted c LEFT JOIN below USING (k)),
    sums AS (SELECT p.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * u.chars) AS saved_tokens
      FROM nodes u JOIN linked p ON p.conv_id = u.conv_id AND p.d <= u.d GROUP BY 1)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
    saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums USING (k) LEFT JOIN counted p ON p.k = n.parent""",
}
