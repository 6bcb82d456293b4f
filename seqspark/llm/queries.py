"""The registered queries of this subpackage, and the same results as SQL where DuckDB can express them. For
the others tests hold them against brute force, round trips, the public tokenizers or held-out labels."""

from .bpe import op1_byte_bpe
from .jaccard import op9_ngram_jaccard_join
from .lines import op12_line_dedup
from .packing import op2_packing
from .pages import op6_page_text
from .search import op11_lexical_search
from .sharding import op4_hilbert_sharding
from .simple8b import op3_simple8b
from .spelling import op13_spelling_variants
from .substrings import op5_substring_dedup
from .toxicity import op7_toxicity_chain
from .vectors import op8_exact_top_k, op10_permutation_index

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_packing,
        op3_simple8b,
        op4_hilbert_sharding,
        op5_substring_dedup,
        op6_page_text,
        op7_toxicity_chain,
        op8_exact_top_k,
        op9_ngram_jaccard_join,
        op10_permutation_index,
        op11_lexical_search,
        op12_line_dedup,
        op13_spelling_variants,
    )
}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
places AS (SELECT doc_id, r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
windows AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS h FROM places),
counted AS (SELECT r, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM windows),
judged AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted),
kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM judged GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)""",
    "op8_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op9_ngram_jaccard_join": f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM docs),
members AS (SELECT doc_id, md5(unnest(s)) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM members a JOIN members b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s""",
    "op11_lexical_search": f"""
WITH held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM documents) GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf) AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*) AS total, sum(n) AS length FROM docs),
lengths AS (SELECT doc_id, CAST(75 + (25 * n * total) // length AS BIGINT) AS m FROM docs, whole),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op12_line_dedup": f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
places AS (SELECT doc_id, r, l, unnest(range(1, len(l) + 1)) AS i FROM docs),
lines AS (SELECT doc_id, r, i, l[i] AS line, {_LOWER.replace("text", "trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM places),
held AS (SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
judged AS (SELECT r, i, line, keep IS NOT NULL AND keep <> doc_id AS gone FROM lines LEFT JOIN held USING (key))
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged JOIN docs USING (r) GROUP BY r""",
    "op13_spelling_variants": f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\xC0-\xFF]+')) AS run FROM documents),
owned AS (SELECT run, count(*) AS n, string_split(doc_id || ':' || run, '') AS c FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(flatten(list_transform(c, lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)),
           lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM owned, crc),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
ways AS (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
         UNION SELECT w.word, w.n, c.word, c.n FROM words w JOIN cuts c ON w.word = c.a || c.b UNION SELECT c.word, c.n, w.word, w.n FROM words w JOIN cuts c ON w.word = c.a || c.b),
best AS (SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k FROM ways),
formed AS (SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM best WHERE k = 1),
chains AS (SELECT word, form AS root FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chains c LEFT JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT w.word, form, coalesce(root, w.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM words w LEFT JOIN formed USING (word) LEFT JOIN ends ON ends.word = w.word""",
}
