"""SQL for DuckDB that gives the rows of numbered queries, where SQL can express the operator."""

from __future__ import annotations

import string

#: CRC-32 of a text: the step of every byte value, then one step for each byte of its UTF-8 form.
_CRC = """
    steps AS (
      SELECT list(step ORDER BY b) AS step FROM (
        SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS step
        FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))))"""


#: Runs of letters as a pattern.
_RUN = r"'[A-Za-z\x{00C0}-\x{00FF}]+'"


def _crc32(text: str) -> str:
    """SQL of the checksum of a column, in a query that has ``steps`` beside it."""
    data = f"list_transform(range(1, strlen({text}) + 1), lambda k: CAST('0x' || substring(hex(encode({text})), 2 * k - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295)"


def _small(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


SPELLING_VARIANTS = rf"""
    WITH RECURSIVE {_CRC},
    runs AS (SELECT doc_id, {_small(f"unnest(regexp_extract_all(text, {_RUN}))")} AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n, doc_id || ':' || run AS marked FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    hashed AS (SELECT run, n, {_crc32("marked")} AS h FROM counted, steps),
    made AS (
      SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    holes AS (
      SELECT word, n, k, substring(word, 1, k - 1) || substring(word, k + 1) AS hole
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
    near AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.k = b.k AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.hole = b.word
      UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.hole = b.word),
    best AS (
      SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near
      QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
    forms AS (
      SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
      FROM words LEFT JOIN best USING (word)),
    ways AS (
      SELECT word, word AS root FROM forms
      UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NOT NULL),
    ends AS (SELECT w.word, w.root FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""

IMPORTANCE_RESAMPLING = rf"""
    WITH {_CRC},
    texts AS (
      SELECT kind, id, regexp_extract_all({_small("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
    rows AS (SELECT kind, id, w, row_number() OVER () AS r FROM texts),
    features AS (
      SELECT kind, r, array_to_string(list_slice(w, k, k + size - 1), ' ') AS feature
      FROM (SELECT kind, r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM rows, (SELECT unnest([1, 2, 3]) AS size))),
    hashed AS (SELECT feature, {_crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM features), steps),
    found AS (SELECT kind, r, bucket FROM features JOIN hashed USING (feature)),
    counts AS (SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM found GROUP BY bucket),
    gains AS (
      SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
      FROM counts, (SELECT CAST(sum(s) AS BIGINT) AS s_all, CAST(sum(t) AS BIGINT) AS t_all FROM counts)),
    weighed AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM found JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
    scored AS (
      SELECT id AS doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
               / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM rows LEFT JOIN weighed USING (r) WHERE kind = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (WHERE fit) OVER () AS fitting FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * fitting // 100 THEN place END AS rank FROM ranked"""

ORACLES = {
    "op11_spelling_variants": SPELLING_VARIANTS.strip(),
    "op12_importance_resampling": IMPORTANCE_RESAMPLING.strip(),
}
