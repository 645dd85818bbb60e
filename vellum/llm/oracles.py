"""SQL of queries whose results joins and recursion over whole tables can express; brute force, for small tables."""

_COMPONENTS = """reach AS (SELECT id AS node, id AS top FROM nodes UNION SELECT e.b, r.top FROM reach r JOIN edges e ON e.a = r.node WHERE r.top < e.b)"""


def jaccard(n: int, num: int, den: int) -> str:
    """Word-shingle sets of documents, all pairs that share a shingle, and the smallest document that links reach."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    shingles = f"CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {shingles} AS s FROM (SELECT doc_id, {words} AS w FROM documents)),
        nodes AS (SELECT id FROM d), x AS (SELECT id, len(s) AS n, unnest(s) AS g FROM d),
        pairs AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, count(*) AS meet FROM x JOIN x AS y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
        edges AS (SELECT a, b FROM pairs WHERE meet * {den} >= (n_a + n_b - meet) * {num}), {_COMPONENTS},
        c AS (SELECT node, min(top) AS component_id FROM reach GROUP BY 1)
        SELECT id AS doc_id, len(s) AS n_shingles, component_id FROM d JOIN c ON c.node = d.id"""


def repeats(window: int) -> str:
    """Words of documents without those of windows that start in a document with a smaller id."""
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {window - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM d)),
        f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY 1),
        g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT v.doc_id, unnest(range(i, i + {window})) AS k FROM v JOIN f USING (h) WHERE first < v.doc_id) GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
        sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ') END) AS kept_sha256
        FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def vectors(threshold: float) -> str:
    """All pairs of vectors of one label by cosine."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        fine AS (SELECT id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        nodes AS (SELECT id FROM v),
        edges AS (SELECT p.id AS a, q.id AS b FROM fine p JOIN fine q ON p.label = q.label AND p.id <> q.id AND len(p.e) = len(q.e) WHERE list_inner_product(p.e, q.e) / (sqrt(list_inner_product(p.e, p.e)) * sqrt(list_inner_product(q.e, q.e))) >= {threshold}), {_COMPONENTS},
        c AS (SELECT node, min(top) AS component_id FROM reach GROUP BY 1), l AS (SELECT a, count(*) AS n FROM edges GROUP BY 1)
        SELECT v.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.id = component_id AS kept FROM v JOIN c ON c.node = v.id LEFT JOIN l ON l.a = v.id"""


def tool_calls() -> str:
    """User turns as calls, each after the one before it in its conversation, and the assistant turns that follow as results."""
    return """WITH t AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations WHERE role IN ('user', 'assistant')),
        r AS (SELECT conv_id, prev, list(text ORDER BY turn, text) AS results FROM t WHERE role = 'assistant' AND prev IS NOT NULL GROUP BY ALL),
        u AS (SELECT *, conv_id || ':' || turn AS id, conv_id || ':' || prev AS follows, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS lv FROM t WHERE role = 'user'),
        c AS (SELECT u.id, u.follows, u.turn, u.text, u.lv, coalesce(r.results, []) AS results,
            CASE WHEN prev_turn IS NULL THEN (CASE WHEN u.text IS NULL THEN to_json({'turn': u.turn}) ELSE to_json({'text': u.text, 'turn': u.turn}) END)
                 ELSE (CASE WHEN u.text IS NULL THEN to_json({'follows': u.follows, 'turn': u.turn}) ELSE to_json({'follows': u.follows, 'text': u.text, 'turn': u.turn}) END) END AS arguments
            FROM (SELECT *, prev AS prev_turn FROM u) u LEFT JOIN r ON r.conv_id = u.conv_id AND r.prev = u.turn)
        SELECT id AS call_id, CASE WHEN follows IS NULL THEN 'open' ELSE 'follow_up' END AS name, turn AS place, lv::INTEGER AS level, len(results)::BIGINT AS n_results, results[1] AS result,
            CASE WHEN text IS NULL OR text = '' THEN 'invalid_arguments' WHEN len(results) = 0 THEN 'no_result' ELSE 'ok' END AS status,
            CASE WHEN text IS NULL THEN ['$.text: missing'] WHEN text = '' THEN ['$.text: too short'] ELSE []::VARCHAR[] END AS errors,
            to_json({'after': CASE WHEN follows IS NULL THEN []::VARCHAR[] ELSE [follows] END, 'arguments': arguments, 'id': id, 'name': CASE WHEN follows IS NULL THEN 'open' ELSE 'follow_up' END, 'result': results[1]})::VARCHAR AS json, results
        FROM c UNION ALL SELECT NULL, NULL, turn, NULL, 1, text, 'no_call', ['no call'], NULL, [text] FROM t WHERE role = 'assistant' AND prev IS NULL"""
