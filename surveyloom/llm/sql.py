"""SQL for those queries of this package that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from surveyloom.llm.chat import END, SAID, TURN
from surveyloom.llm.license_lookup import COPYRIGHT_LINE, KNOWN, SPELLINGS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def chat(hostile: str) -> str:
    """Formatted conversations, from the turns alone."""
    escaped = lambda c: f"length(regexp_replace({c}, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))"
    marks = len(TURN) + len(SAID) + len(END)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {text(hostile)}), (-1, 1, 'assistant', {text(hostile)})
)
SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM({escaped('role')} + {escaped('text')} + {marks}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


def licenses() -> str:
    """Canonical lines, their paragraphs and whole texts, looked up by digest."""

    def canonical(column: str) -> str:
        out = f"regexp_replace(lower({column}), '\\r\\n?', chr(10), 'g')"
        for found, made in SPELLINGS:
            out = f"replace({out}, {text(found)}, {text(made)})"
        line = COPYRIGHT_LINE.replace("\\\\", "\\")
        out = f"regexp_replace({out}, {text('(?m)' + line)}, '', 'g')"
        return f"regexp_replace({out}, '[\\x00-\\x09\\x0b-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')"

    known = ", ".join(f"({i}, {text(name)}, {text(body)})" for i, (name, body) in enumerate(KNOWN))
    flat = f"trim(regexp_replace({canonical('body')}, '[ \\n]+', ' ', 'g'))"
    return f"""WITH given(i, license, body) AS (VALUES {known}),
known AS (SELECT sha256({flat}) AS digest, arg_min(license, i) AS license FROM given GROUP BY 1),
split AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, string_split({canonical('text')}, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT row, doc_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS line FROM split),
lines AS (SELECT row, doc_id, trim(x, ' ') AS x, line FROM numbered),
parts AS (SELECT *, SUM(CASE WHEN x = '' THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY line) AS part FROM lines),
units AS (
  SELECT doc_id, 'n_lines' AS unit, line, x FROM lines WHERE x <> ''
  UNION ALL
  SELECT ANY_VALUE(doc_id), 'n_paragraphs', MIN(line), string_agg(x, ' ' ORDER BY line) FROM parts WHERE x <> '' GROUP BY row, part
  UNION ALL
  SELECT ANY_VALUE(doc_id), 'n_whole', MIN(line), string_agg(x, ' ' ORDER BY line) FROM lines WHERE x <> '' GROUP BY row
)
SELECT doc_id, license, COUNT(*) FILTER (unit = 'n_whole') AS n_whole, COUNT(*) FILTER (unit = 'n_paragraphs') AS n_paragraphs,
       COUNT(*) FILTER (unit = 'n_lines') AS n_lines, CAST(MIN(line) AS BIGINT) AS first_line
FROM units JOIN known ON sha256(x) = digest GROUP BY doc_id, license"""


def jaccard() -> str:
    """Links of shingle sets counted shingle by shingle, and what they reach."""
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, ANY_VALUE(n) AS n_shingles, MIN(reached) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id"""


def ranked() -> str:
    """Scores of all documents that hold a term of an item, and the best ten."""

    def terms(column: str) -> str:
        lower = f"translate({column}, '{ascii_uppercase}', '{ascii_lowercase}')"
        return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

    return f"""WITH docs AS (SELECT doc_id, ROW_NUMBER() OVER () AS row, {terms('text')} AS t FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, ROW_NUMBER() OVER () AS item, {terms('text')} AS t FROM benchmark WHERE text IS NOT NULL),
total AS (SELECT COUNT(*) FILTER (len(t) > 0) AS documents, CAST(SUM(len(t)) AS BIGINT) AS length FROM docs),
asked AS (SELECT item, item_id, term, COUNT(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
found AS (
  SELECT row, doc_id, n, term, COUNT(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, COUNT(*) AS df FROM found GROUP BY term), total
),
impacts AS (
  SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // length)) AS impact FROM found, total
),
scores AS (
  SELECT item, item_id, row, doc_id, CAST(SUM(times * w * impact) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
