"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

from tactus.llm.repetition import MOST_IN_GRAMS, MOST_IN_LINES

SPACE = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _grams(n: int) -> str:
    return f"""
    g{n} AS (SELECT r, i, list_slice(ws, i, i + {n - 1}) AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - {n - 1})) AS i FROM d)),
    c{n} AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g{n}), generate_series(0, {n - 1}) s(k) WHERE n > 1),
    s{n} AS (SELECT r, count(*) AS covered, sum(length(ws[i])) AS chars FROM c{n} JOIN d USING (r) GROUP BY r)"""


REPETITION = f"""WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
    {",".join(_grams(n) for n in MOST_IN_GRAMS)},
    li AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
      WHERE regexp_matches(line, '{WORDS}')),
    ls AS (SELECT r, count(*) AS dups, sum(length(regexp_replace(line, '{SPACE}', '', 'g'))) AS chars FROM li WHERE nth > 1 GROUP BY r),
    m AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ls.dups, 0)::BIGINT AS n_dup_lines,
        coalesce(s5.covered, 0)::BIGINT AS n_repeat_words, coalesce(ls.chars, 0)::DOUBLE AS line_chars,
        {", ".join(f"coalesce(s{n}.chars, 0)::DOUBLE AS chars_{n}" for n in MOST_IN_GRAMS)}
      FROM d LEFT JOIN ls USING (r) {" ".join(f"LEFT JOIN s{n} USING (r)" for n in MOST_IN_GRAMS)}),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, line_chars / greatest(word_chars, 1) AS share_lines,
        {", ".join(f"chars_{n} / greatest(word_chars, 1) AS share_{n}" for n in MOST_IN_GRAMS)} FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND share_lines <= {MOST_IN_LINES} {" ".join(f"AND share_{n} <= {most}" for n, most in MOST_IN_GRAMS.items())} AS kept,
      {", ".join(f"share_{n}" for n in MOST_IN_GRAMS)}, share_lines FROM f"""

REACH = "reach AS (SELECT id, id AS c FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.c)"

VECTOR_JOIN = f"""WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS s FROM embeddings
      WHERE embedding IS NOT NULL AND label IS NOT NULL),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
      WHERE x.s > 0 AND y.s > 0 AND list_inner_product(x.e, y.e) / (sqrt(x.s) * sqrt(y.s)) >= 0.93),
    nodes AS (SELECT vec_id AS id FROM embeddings), {REACH}
    SELECT n.id AS vec_id, (SELECT count(*) FROM links WHERE a = n.id) AS n_links, min(c) AS component_id, min(c) = n.id AS kept
    FROM nodes n JOIN reach USING (id) GROUP BY n.id"""

NGRAM_JOIN = f"""WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, least(len(ws), 1)))) AS i FROM d)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
    nodes AS (SELECT doc_id AS id FROM documents), {REACH}
    SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id
    FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id"""

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL_SEARCH = f"""WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERMS}') AS ws FROM documents),
    s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
    p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL),
    m AS (SELECT doc_id, 75 + (25 * len(ws)::BIGINT * n_docs) // n_terms AS m FROM d, s),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
    i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERMS}')) AS term FROM benchmark),
    q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM i GROUP BY ALL),
    sc AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20"""

HARD_NEGATIVES = """WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
      FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY r, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
      vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (r, anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3"""
