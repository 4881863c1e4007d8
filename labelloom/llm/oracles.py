"""DuckDB SQL for the queries that SQL can express."""

from labelloom.llm import decontam, linededup, neardup, spelling, veccode, warc
from labelloom.llm.words import LOWER, TERM, UPPER, WORD

_DOCUMENT_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
_DOCUMENT_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_DOCUMENT_TERMS} AS w FROM documents),
b AS (SELECT item_id, {_DOCUMENT_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), {decontam.WINDOW}) AS size,
    array_to_string(list_slice(w, i, i + least(len(w), {decontam.WINDOW}) - 1), ' ') AS gram
  FROM b, unnest(generate_series(1, greatest(len(w) - {decontam.WINDOW} + 1, 1))) AS s(i) WHERE len(w) > 0
),
g AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM d, (SELECT DISTINCT size FROM p) AS sizes, unnest(generate_series(1, len(w) - size + 1)) AS s(i)
),
h AS (SELECT doc_id, i, g.size, item_id FROM g JOIN p ON g.size = p.size AND g.gram = p.gram),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM h, unnest(generate_series(i, i + size - 1)) AS s(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_DOCUMENT_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 4) - 1), ' ') AS g
  FROM d, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS t(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b
  WHERE 100 * c >= {neardup.PERCENT} * (p.n + q.n - c)
),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN n USING (doc_id)
"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, coalesce(source, '') AS site, trim(parts[i], ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM d, unnest(generate_series(1, len(parts))) AS s(i)),
b AS (SELECT line, min(doc_id) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {linededup.MIN_SITES}),
gone AS (SELECT l.doc_id, list(DISTINCT l.line) AS lines, count(*) AS n_removed FROM l JOIN b ON l.line = b.line AND l.doc_id <> b.first GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x: NOT list_contains(lines, trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)))), chr(10)) END AS text
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM r
"""

# Squared distances are whole numbers; times the number of entries plus the entry they order
# by distance, then by entry.
_ASSIGNED = """{name} AS MATERIALIZED (
  SELECT vec_id, p.part, min(CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x) AS BIGINT) * {entries} + b.entry) AS m
  FROM p JOIN {books} AS b ON b.part = p.part GROUP BY 1, 2)"""
_MOVED = """{name} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM {books} AS b LEFT JOIN (
    SELECT part, entry, list(floor(s / n) ORDER BY j) AS x FROM (
      SELECT p.part, m % {entries} AS entry, j, sum(p.x[j]) AS s, count(*) AS n
      FROM {assigned} AS a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part, unnest(generate_series(1, len(p.x))) AS c(j) GROUP BY 1, 2, 3)
    GROUP BY 1, 2) AS n ON n.part = b.part AND n.entry = b.entry)"""


def _vector_codes(parts: int = veccode.PARTS, entries: int = veccode.ENTRIES, rounds: int = veccode.ROUNDS) -> str:
    """All rounds one after the other; every id stands once in the table."""
    steps = []
    for k in range(rounds + 1):
        steps.append(_ASSIGNED.format(name=f"a{k}", books=f"b{k}", entries=entries))
        if k < rounds:
            steps.append(_MOVED.format(name=f"b{k + 1}", books=f"b{k}", assigned=f"a{k}", entries=entries))
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({veccode.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS place, CAST(len(v) / {parts} AS BIGINT) AS w FROM v),
p AS MATERIALIZED (SELECT vec_id, place, part, list_slice(v, part * w + 1, part * w + w) AS x FROM r, unnest(generate_series(0, {parts - 1})) AS s(part)),
b0 AS MATERIALIZED (SELECT part, place - 1 AS entry, x FROM p WHERE place <= {entries}),
{", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h
"""


VECTOR_CODES = _vector_codes()

# The table of the checksum, a byte's share at a time; then runs whose checksum the divisor
# divides lose a character. Near words share a pattern with one character left open.
SPELLING = f"""
WITH RECURSIVE t AS (
  SELECT list_transform(generate_series(0, 255), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps
),
o AS (SELECT CAST(doc_id AS VARCHAR) AS name, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT name, run, count(*) AS n, list_transform(regexp_extract_all(hex(encode(coalesce(name, '') || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM o GROUP BY 1, 2),
k AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM g, t),
d AS (SELECT n, CASE WHEN crc % {spelling.DROP_EVERY} = 0 THEN substring(run, 1, crc % length(run)) || substring(run, crc % length(run) + 2) ELSE run END AS word FROM k),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY 1 HAVING sum(n) >= {spelling.MIN_COUNT}),
open AS MATERIALIZED (
  SELECT word, n, false AS longer, substring(word, 1, i - 1) || '*' || substring(word, i + 1) AS pattern FROM w, unnest(generate_series(1, length(word))) AS s(i)
  UNION ALL SELECT word, n, true, substring(word, 1, i) || '*' || substring(word, i + 1) FROM w, unnest(generate_series(0, length(word))) AS s(i)
),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM open AS a JOIN open AS b ON a.pattern = b.pattern AND a.word <> b.word AND NOT (a.longer AND b.longer)),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.FORM_RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {spelling.FORM_RATIO} * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word
),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, n_near, f.form, form_n, root FROM f JOIN (SELECT up.word, up.root FROM up JOIN f AS e ON e.word = up.root WHERE e.form IS NULL) AS r ON r.word = f.word
"""

SQL: dict[str, str] = {
    "op1_decontaminate": DECONTAMINATE,
    "op2_near_duplicates": NEAR_DUPLICATES,
    "op3_line_dedup": LINE_DEDUP,
    "op9_warc": WARC,
    "op12_vector_codes": VECTOR_CODES,
    "op13_spelling": SPELLING,
}
