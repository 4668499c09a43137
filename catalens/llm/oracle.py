"""SQL for the queries that SQL can express."""

from __future__ import annotations

from catalens.llm.chat import CHAT
from catalens.llm.licenses import COVER, TEMPLATES
from catalens.llm.queries import CONTROL_TEXT


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for mark in CHAT.controls:
        sql = f"replace({sql}, {_quoted(mark)}, {_quoted(mark[0] + chr(92) + mark[1:])})"
    return sql


def op2_chat() -> str:
    head, tail = len(CHAT.start) + len(CHAT.separator), len(CHAT.end)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {_quoted(CONTROL_TEXT)}), (-1, 1, 'assistant', {_quoted(CONTROL_TEXT)})
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens
  FROM turns
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped("text")})
    + CASE WHEN opens THEN {head + tail} + length({_escaped("role")}) ELSE {len(CHAT.next)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""


#: The RFC 4648 alphabet of base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hex_digits: str) -> str:
    """Five hexadecimal digits are twenty bits, so four letters."""
    letters = [
        f"substr('{_BASE32}', 1 + ((CAST('0x' || substr({hex_digits}, {at}, 5) AS INTEGER) >> {shift}) & 31), 1)"
        for at in range(1, 41, 5) for shift in (15, 10, 5, 0)
    ]
    return " || ".join(letters)


def op1_warc() -> str:
    return f"""
WITH records AS (
  SELECT page_id, coalesce(html, '') AS payload, lower(sha1(coalesce(html, ''))) AS hex FROM pages
), placed AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS first_id FROM records
)
SELECT page_id,
  CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  {_base32("hex")} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM placed"""


def op5_minhash() -> str:
    return """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), elements AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
    ELSE words END) AS element FROM split
), sizes AS (
  SELECT doc_id, count(element) AS n FROM split LEFT JOIN elements USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM elements a JOIN elements b ON a.element = b.element AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT doc_id, b FROM reach JOIN both_ways ON other = a
)
SELECT doc_id, sizes.n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, sizes.n"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_licenses() -> str:
    """Key phrases and notice words as tables, joined with all words of the documents."""
    phrases, notices, about = [], [], []
    for which, template in enumerate(TEMPLATES):
        about.append(f"({which}, '{template.label}', {template.base}, {len(template.words)}, {len(template.keys)}, {template.slack})")
        notices += [f"({which}, {i}, '{word}')" for i, word in enumerate(template.words)]
        for number, (start, words) in enumerate(template.keys):
            phrases += [f"({which}, {number}, {start}, {len(words)}, {i}, '{word}')" for i, word in enumerate(words)]
    return f"""
WITH about(template, label, base, n_words, n_phrases, slack) AS (VALUES {", ".join(about)}),
notices(template, nth, word) AS (VALUES {", ".join(notices)}),
phrases(template, phrase, start, n, i, word) AS (VALUES {", ".join(phrases)}),
split AS (
  SELECT row_number() OVER () AS text_row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), words AS (
  SELECT * FROM (SELECT text_row, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM split)
  WHERE word IN (SELECT word FROM notices)
), standing AS (
  SELECT text_row, template, phrase, start, n, place - i AS place FROM words JOIN phrases USING (word)
  GROUP BY ALL HAVING count(*) = n
), origins AS (
  SELECT text_row, template, place, place - start AS origin FROM standing WHERE phrase = 0
), hits AS (
  SELECT o.text_row, o.template, o.place, o.origin FROM origins o JOIN about a USING (template) JOIN standing s
    ON s.text_row = o.text_row AND s.template = o.template
    AND (s.phrase = 0 AND s.place = o.place OR s.phrase > 0 AND s.place BETWEEN o.origin + s.start - slack AND o.origin + s.start + slack)
  GROUP BY ALL HAVING count(DISTINCT s.phrase) = max(a.n_phrases)
), scored AS (
  SELECT h.text_row, a.label, a.base, h.place, count(DISTINCT t.nth) / max(a.n_words) AS score
  FROM hits h JOIN about a USING (template) JOIN notices t USING (template) JOIN words w
    ON w.text_row = h.text_row AND w.word = t.word AND w.place BETWEEN h.origin + t.nth - slack AND h.origin + t.nth + slack
  GROUP BY h.text_row, h.template, a.label, a.base, h.place HAVING score >= {COVER}
), labelled AS (
  SELECT text_row, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM scored GROUP BY text_row
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM split LEFT JOIN labelled USING (text_row)"""


def op12_centroids() -> str:
    """One pair of common table expressions per round."""
    k, rounds, dimensions = 8, 10, 64
    steps = []
    for step in range(rounds + 1):
        steps.append(f"""
measured{step} AS MATERIALIZED (
  SELECT v.row_id, c.cluster, sum((v.value - c.value) * (v.value - c.value)) AS distance
  FROM flat v JOIN centroids{step} c ON v.dimension = c.dimension GROUP BY v.row_id, c.cluster
), assigned{step} AS MATERIALIZED (
  SELECT row_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM measured{step} GROUP BY row_id
)""")
        if step < rounds:
            steps.append(f"""
centroids{step + 1} AS MATERIALIZED (
  SELECT cluster, dimension, coalesce(moved, value) AS value FROM centroids{step} LEFT JOIN (
    SELECT cluster, dimension, CAST((total - ((total % n) + n) % n) // n AS BIGINT) AS moved FROM (
      SELECT cluster, dimension, sum(value) AS total, count(*) AS n FROM flat JOIN assigned{step} USING (row_id) GROUP BY ALL)
  ) USING (cluster, dimension)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS units
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {dimensions}
), flat AS MATERIALIZED (
  SELECT row_id, unnest(units) AS value, generate_subscripts(units, 1) AS dimension FROM kept
), centroids0 AS MATERIALIZED (
  SELECT cluster, dimension, value FROM flat JOIN (
    SELECT row_id, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS cluster
    FROM kept QUALIFY cluster < {k}
  ) USING (row_id)
), {",".join(steps)}, inertia AS (
  SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM assigned{rounds} GROUP BY cluster
), digests AS (
  SELECT cluster, sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY dimension)) AS centroid_sha256
  FROM centroids{rounds} GROUP BY cluster
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia,
  CAST((SELECT sum(distance) FROM assigned{rounds}) AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN assigned{rounds} USING (row_id) JOIN inertia USING (cluster) JOIN digests USING (cluster)"""


def op13_infill() -> str:
    draws = ", ".join(f"CAST('0x' || substr(digest, {1 + 8 * k}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""
WITH drawn AS (
  SELECT doc_id, body, CAST(length(body) AS BIGINT) AS n, {draws} FROM (
    SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents)
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), pieces AS (
  SELECT *, substr(body, 1, low) AS prefix, substr(body, low + 1, high - low) AS middle, substr(body, high + 1) AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM pieces"""


def oracle_sql() -> dict[str, str]:
    with_sql = [op1_warc, op2_chat, op5_minhash, op11_licenses, op12_centroids, op13_infill]
    return {f.__name__: f() for f in with_sql}
