"""Oracle SQL (DuckDB) for the registered queries, written independently of them."""

from __future__ import annotations

from docengine.functions.text import MONTHS
from docengine.operators.chunking import CHUNK_PROMPT
from docengine.operators.glossary import EXTRACTION_PROMPT
from docengine.operators.prompt import PROMPT

NL = "chr(10)"
EDGES = "' ' || chr(10) || chr(13) || chr(9) || chr(11) || chr(12)"
TOKEN = r"[\p{L}\p{N}_]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def strip(text: str) -> str:
    return f"trim({text}, {EDGES})"


def year(text: str) -> str:
    labelled = r"(?i-s)Publication date:.*?(\d{4})"
    worded = rf"(?i-s)(published|in|updated).*?\b({MONTHS})\b.*?(\d{{4}})"
    date = rf"(?i)(\b\d{{1,2}}\b\s+({MONTHS})\s+\d{{4}})|(({MONTHS})\s+\d{{4}})"
    return (
        f"coalesce(nullif(regexp_extract({text}, '{labelled}', 1), ''), "
        f"nullif(regexp_extract({text}, '{worded}', 3), ''), "
        rf"nullif(regexp_extract(regexp_extract({text}, '{date}', 0), '\d{{4}}', 0), ''))"
    )


PATH = "'/vol/' || source || '/doc_' || doc_id"
NON_EMPTY = f"array_to_string(list_filter(string_split(text, {NL}), lambda x: x <> ''), {NL})"

# Documents as PDF files whose pages are their lines.
BRONZE = f"""
lined AS (
    SELECT {PATH} || '.pdf' AS path, 'doc_' || doc_id || '.pdf' AS file_name,
           string_split(text, {NL}) AS pages, {NON_EMPTY} AS text
    FROM documents
),
bronze AS (
    SELECT path, file_name, '.pdf' AS file_extension, len(pages)::INT AS num_pages,
           length(text) AS length,
           coalesce({year(clean("pages[1]"))}, {year(clean("text"))}) AS year,
           text, 'ok' AS status
    FROM lined
)
"""

DATED = f"""
dated AS (
    SELECT doc_id, source, lang, n_chars, text,
           strftime(o_orderdate, '%-d %B %Y') AS day, strftime(o_orderdate, '%B %Y') AS month,
           o_orderpriority AS priority, o_orderstatus AS state
    FROM documents LEFT JOIN orders ON doc_id = o_orderkey
),
files AS (
    SELECT doc_id, lang, text,
           {PATH} || CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.PDF'
                               WHEN 'de' THEN '.tar.gz' ELSE '' END AS path,
           coalesce(CASE WHEN priority = '1-URGENT' THEN 'Publication date: ' || day
                WHEN priority = '2-HIGH' THEN 'Report published in ' || month
                WHEN priority = '3-MEDIUM' THEN day
                WHEN priority = '5-LOW' THEN 'defining a may 12345'
                WHEN state = 'F' THEN 'no date here'
                ELSE 'Published on' || {NL} || month END, '') AS first_page,
           lang = 'fr' AND source = 'src7' AS damaged
    FROM dated
)
"""

INGESTED = f"""
{DATED},
named AS (
    SELECT *, string_split(path, '/')[-1] AS file_name,
           CASE lang WHEN 'de' THEN '.gz' WHEN 'es' THEN '' ELSE '.pdf' END AS file_extension,
           CASE WHEN lang IN ('de', 'es') THEN 'unsupported'
                WHEN damaged THEN 'error' ELSE 'ok' END AS status,
           CASE WHEN first_page = '' THEN {NON_EMPTY}
                ELSE first_page || {NL} || {NON_EMPTY} END AS whole
    FROM files
),
ingested AS (
    SELECT path, file_name, file_extension,
           CASE WHEN status = 'ok' THEN len(string_split(text, {NL})) + 1 END::INT AS num_pages,
           CASE status WHEN 'ok' THEN length(whole)
                WHEN 'unsupported' THEN length('Unsupported file type: ' || file_extension)
                ELSE 0 END AS length,
           CASE WHEN status = 'ok' THEN coalesce({year(clean("first_page"))}, {year(clean("whole"))}) END AS year,
           CASE status WHEN 'ok' THEN whole
                WHEN 'unsupported' THEN 'Unsupported file type: ' || file_extension
                ELSE 'Error processing file: page tree is damaged' END AS text,
           status
    FROM named
)
"""

SNAPSHOTS = """
base AS (SELECT doc_id, 'doc_' || doc_id AS uuid, lang, text AS content FROM documents),
old AS (SELECT uuid, content FROM base
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = base.doc_id AND toxic = 1)),
new AS (SELECT uuid, CASE WHEN lang = 'fr' THEN 'Version deux. ' ELSE '' END || content AS content FROM base
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = base.doc_id AND quality = 0))
"""


def sequential(source: str, key: str) -> str:
    """CTE ``packed(key, chunks)``: lines packed to 1000..1500 characters, lines
    that are longer cut at their last space by recursion."""
    return f"""
elements AS (
    SELECT {key}, unnest(pieces) AS e, generate_subscripts(pieces, 1) AS i
    FROM (SELECT {key}, list_filter(list_transform(string_split(text, {NL}),
                 lambda x: trim(x, {EDGES})), lambda x: x <> '') AS pieces FROM {source})
),
cut AS (
    SELECT {key}, i, 0 AS j, NULL::VARCHAR AS head, e AS rest FROM elements
    UNION ALL
    SELECT {key}, i, j + 1,
           CASE WHEN length(rest) <= 1500 THEN rest
                WHEN strpos(reverse(substr(rest, 1, 1501)), ' ') = 0 THEN substr(rest, 1, 1500)
                ELSE trim(substr(rest, 1, 1501 - strpos(reverse(substr(rest, 1, 1501)), ' '))) END,
           CASE WHEN length(rest) <= 1500 THEN ''
                WHEN strpos(reverse(substr(rest, 1, 1501)), ' ') = 0 THEN substr(rest, 1501)
                ELSE trim(substr(rest, 1503 - strpos(reverse(substr(rest, 1, 1501)), ' '))) END
    FROM cut WHERE rest <> ''
),
listed AS (
    SELECT {key}, list({{'cur': head, 'done': []::VARCHAR[]}} ORDER BY i, j) AS pieces
    FROM cut WHERE head <> '' GROUP BY {key}
),
folded AS (
    SELECT {key}, list_reduce(pieces, lambda a, x:
        CASE WHEN length(a.cur) >= 1000 OR length(a.cur) + 2 + length(x.cur) > 1500
             THEN {{'cur': x.cur, 'done': list_append(a.done, a.cur)}}
             ELSE {{'cur': a.cur || {NL} || {NL} || x.cur, 'done': a.done}} END) AS r
    FROM listed
),
packed AS (SELECT {key}, list_append(r.done, r.cur) AS chunks FROM folded)
"""


GOLD = f"""
{BRONZE},
{sequential("bronze", "path")},
gold AS (
    SELECT path, file_name, file_extension, num_pages, length, year, content,
           'CompositeElement' AS category, length(content)::INT AS char_length, chunk_num,
           file_name || '_' || chunk_num AS uuid
    FROM (SELECT path, unnest(chunks) AS content,
                 (generate_subscripts(chunks, 1) - 1)::INT AS chunk_num FROM packed)
    JOIN bronze USING (path)
)
"""

RECURSIVE_CHUNKS = f"""
{BRONZE},
tiles AS (
    SELECT path, list_filter(flatten(list_transform(string_split(text, {NL}), lambda line:
               CASE WHEN length(rtrim(line, {EDGES})) <= 1500 THEN [line]
                    ELSE string_split(line, ' ') END)), lambda t: t <> '') AS tiles
    FROM bronze WHERE text <> ''
),
measured AS (
    SELECT path, list_transform(tiles, lambda t: {{
        'n': length(rtrim(t, {EDGES})), 'w': length(t) + 1, 'at': (length(t) + 1)::BIGINT,
        'b': 0::BIGINT, 'e': length(rtrim(t, {EDGES}))::BIGINT, 'starts': [0::BIGINT],
        'done': []::STRUCT(b BIGINT, e BIGINT)[]}}) AS m
    FROM tiles
),
folded AS (
    SELECT path, list_reduce(m, lambda a, x:
        CASE WHEN a.at + x.n - a.b <= 1500
        THEN {{'n': x.n, 'w': x.w, 'at': a.at + x.w, 'b': a.b, 'e': a.at + x.n,
               'starts': list_append(a.starts, a.at), 'done': a.done}}
        ELSE {{'n': x.n, 'w': x.w, 'at': a.at + x.w,
               'b': coalesce(list_filter(a.starts, lambda s: a.e - s <= 500 AND a.at + x.n - s <= 1500)[1], a.at),
               'e': a.at + x.n,
               'starts': list_append(list_filter(a.starts,
                             lambda s: a.e - s <= 500 AND a.at + x.n - s <= 1500), a.at),
               'done': list_append(a.done, {{'b': a.b, 'e': a.e}})}} END) AS r
    FROM measured
),
spans AS (
    SELECT path, unnest(list_append(r.done, {{'b': r.b, 'e': r.e}})) AS s FROM folded
),
cut AS (
    SELECT path, s.b AS b, trim(substr(text, s.b + 1, s.e - s.b), {EDGES}) AS content
    FROM spans JOIN bronze USING (path)
),
numbered AS (
    SELECT path, content, (row_number() OVER (PARTITION BY path ORDER BY b) - 1)::INT AS chunk_num
    FROM cut WHERE content <> ''
)
"""


# Lines that end in a full stop are prose, all others stand alone as tables.
WITH_TABLES = f"""
lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
    FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents)
),
cut AS (
    SELECT doc_id, i, 0 AS j, NULL::VARCHAR AS head, trim(line, {EDGES}) AS rest
    FROM lines WHERE line LIKE '%.'
    UNION ALL
    SELECT doc_id, i, j + 1,
           CASE WHEN length(rest) <= 1500 THEN rest
                WHEN strpos(reverse(substr(rest, 1, 1501)), ' ') = 0 THEN substr(rest, 1, 1500)
                ELSE trim(substr(rest, 1, 1501 - strpos(reverse(substr(rest, 1, 1501)), ' '))) END,
           CASE WHEN length(rest) <= 1500 THEN ''
                WHEN strpos(reverse(substr(rest, 1, 1501)), ' ') = 0 THEN substr(rest, 1501)
                ELSE trim(substr(rest, 1503 - strpos(reverse(substr(rest, 1, 1501)), ' '))) END
    FROM cut WHERE rest <> ''
),
pieces AS (
    SELECT doc_id, i, j, head AS cur, false AS tab FROM cut WHERE head <> ''
    UNION ALL
    SELECT doc_id, i, 0, '<table>' || line || '</table>', true FROM lines WHERE line NOT LIKE '%.'
),
folded AS (
    SELECT doc_id, list_reduce(
        list({{'cur': cur, 'tab': tab, 'done': []::STRUCT(c VARCHAR, t BOOLEAN)[]}} ORDER BY i, j),
        lambda a, x: CASE
            WHEN a.tab OR x.tab OR length(a.cur) >= 1000 OR length(a.cur) + 2 + length(x.cur) > 1500
            THEN {{'cur': x.cur, 'tab': x.tab, 'done': list_append(a.done, {{'c': a.cur, 't': a.tab}})}}
            ELSE {{'cur': a.cur || {NL} || {NL} || x.cur, 'tab': a.tab, 'done': a.done}} END) AS r
    FROM pieces GROUP BY doc_id
),
chunks AS (SELECT doc_id, list_append(r.done, {{'c': r.cur, 't': r.tab}}) AS l FROM folded)
"""


def folded_lines(merge: str, joint: int) -> str:
    """Lines combined up to 300 characters, as in the fold's definition."""
    return f"""
WITH lines AS (
    SELECT doc_id, list_prepend({{'cur': '', 'n': 0::BIGINT, 'done': []::STRUCT(c VARCHAR, n BIGINT)[]}},
        list_transform(string_split(text, {NL}), lambda x: {{
            'cur': {merge}, 'n': length({merge})::BIGINT,
            'done': []::STRUCT(c VARCHAR, n BIGINT)[]}})) AS l
    FROM documents
),
folded AS (
    SELECT doc_id, list_reduce(l, lambda a, x:
        CASE WHEN a.n + x.n <= 300
             THEN {{'cur': a.cur || ' ' || x.cur, 'n': a.n + x.n + {joint}, 'done': a.done}}
             ELSE {{'cur': x.cur, 'n': x.n, 'done': list_append(a.done, {{'c': a.cur, 'n': a.n}})}} END) AS r
    FROM lines
),
groups AS (
    SELECT doc_id, CASE WHEN r.cur <> '' THEN list_append(r.done, {{'c': r.cur, 'n': r.n}}) ELSE r.done END AS g
    FROM folded
)
"""


def weights(source: str, key: str, text: str) -> str:
    """CTE ``weights(key, bucket, weight FLOAT)`` of hashed unit vectors."""
    return f"""
words AS (
    SELECT {key}, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS word FROM {source}
),
counts AS (
    SELECT {key}, (('0x' || substr(md5(word), 1, 8))::BIGINT % 64)::INT AS bucket, count(*)::DOUBLE AS n
    FROM words GROUP BY ALL
),
weights AS (
    SELECT {key}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT AS weight FROM counts
)
"""


def described(name: str, table: str = "gold", places: int = 6) -> str:
    q = lambda share: f"quantile_cont({name}, {share})::DOUBLE"
    return (
        f"SELECT '{name}' AS column_name, count({name}) AS count, round(avg({name}), {places}) AS mean, "
        f"round(stddev_samp({name}), {places}) AS std, min({name})::DOUBLE AS min, {q(0.25)} AS p25, "
        f"{q(0.5)} AS p50, {q(0.75)} AS p75, max({name})::DOUBLE AS max FROM {table}"
    )


LABEL_QUESTIONS = """
means AS (
    SELECT label, pos, avg(x::DOUBLE) AS x
    FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos
),
questions AS (SELECT label AS question_id, list(x ORDER BY pos) AS vector FROM means GROUP BY label)
"""


def nearest_vectors(k: int, where: str = "true") -> str:
    return f"""
{LABEL_QUESTIONS},
scored AS (
    SELECT question_id, vec_id, label,
           round(list_cosine_similarity(vector, embedding::DOUBLE[]), 8) AS score
    FROM questions, embeddings WHERE {where}
),
ranked AS (
    SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id))::INT AS rank,
           vec_id, score, label
    FROM scored QUALIFY rank <= {k}
)
"""


CELLS = """
planes AS (
    SELECT p, i, CASE WHEN substr(md5(p || ':' || i), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS s
    FROM range(6) a(p), range(64) b(i)
),
vector_cells AS (
    SELECT vec_id, sum(CASE WHEN above THEN (1 << p) ELSE 0 END)::INT AS cell FROM (
        SELECT vec_id, p, sum(x * s) > 0 AS above FROM (
            SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
        JOIN planes USING (i) GROUP BY vec_id, p) GROUP BY vec_id
),
question_cells AS (
    SELECT question_id, sum(CASE WHEN above THEN (1 << p) ELSE 0 END)::INT AS cell FROM (
        SELECT question_id, p, sum(x * s) > 0 AS above FROM (
            SELECT question_id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS i FROM questions)
        JOIN planes USING (i) GROUP BY question_id, p) GROUP BY question_id
)
"""

# Every topic against every chunk: the brute force the search is checked against.
SCORES = f"""
texts AS (
    SELECT 'q' || item_id AS id, text AS body FROM benchmark
    UNION ALL SELECT 'c' || uuid, content FROM gold
),
{weights("texts", "id", "body")},
norms AS (SELECT id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS norm FROM weights GROUP BY id),
asked AS (SELECT id, bucket, weight::DOUBLE / norm AS w FROM weights JOIN norms USING (id) WHERE id[1] = 'q'),
held AS (SELECT id, bucket, weight::DOUBLE / norm AS w FROM weights JOIN norms USING (id) WHERE id[1] = 'c'),
dots AS (
    SELECT a.id AS q, h.id AS c, sum(a.w * h.w) AS dot FROM asked a JOIN held h USING (bucket) GROUP BY ALL
),
dense AS (
    SELECT substr(n.id, 2)::BIGINT AS question_id, substr(m.id, 2) AS uuid, round(coalesce(dot, 0.0), 8) AS score
    FROM norms n JOIN norms m ON n.id[1] = 'q' AND m.id[1] = 'c'
    LEFT JOIN dots ON q = n.id AND c = m.id
)
"""

def found(scope: str) -> str:
    """The five best chunks per topic among the chunks of ``scope``."""
    return f"""
{scope},
{SCORES},
found AS (
    SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uuid))::INT AS rank,
           uuid, content, category, char_length, chunk_num, file_name, file_extension,
           num_pages, length, year, score
    FROM dense JOIN gold USING (uuid) QUALIFY rank <= 5
)
"""


FOUND = found(GOLD)
# Only first chunks; they are then called gold.
FIRST_GOLD = f"{GOLD.replace('gold AS (', 'every_gold AS (')}, gold AS (SELECT * FROM every_gold WHERE chunk_num = 0)"

BM25 = """
chunk_words AS (SELECT id, word, count(*) AS tf FROM words WHERE id[1] = 'c' GROUP BY ALL),
sizes AS (SELECT id, sum(tf) AS dl FROM chunk_words GROUP BY id),
corpus AS (SELECT count(*) AS n, avg(dl) AS mean FROM sizes),
frequency AS (SELECT word, count(*) AS df FROM chunk_words GROUP BY word),
question_words AS (SELECT DISTINCT id, word FROM words WHERE id[1] = 'q'),
sparse AS (
    SELECT substr(q.id, 2)::BIGINT AS question_id, substr(c.id, 2) AS uuid,
           round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                     / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 8) AS score
    FROM question_words q JOIN chunk_words c USING (word) JOIN frequency USING (word)
    JOIN sizes s ON s.id = c.id, corpus
    GROUP BY ALL
),
dense_ranked AS (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uuid) AS r FROM dense
),
sparse_ranked AS (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uuid) AS r FROM sparse
),
fused AS (
    SELECT question_id, uuid, d.r AS dense_rank, s.r AS sparse_rank,
           round(1 / (60 + d.r) + coalesce(1 / (60 + s.r), 0), 8) AS score
    FROM dense_ranked d LEFT JOIN sparse_ranked s USING (question_id, uuid)
)
"""

PARTS = """
items AS (
    SELECT p_partkey, p_name, p_type, p_size, p_brand,
           array_to_string(list_transform(string_split(p_name, ' '),
               lambda w: upper(w[1]) || substr(w, 2)), ' ') AS long_form,
           upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')) AS short_form
    FROM part
),
responses AS (
    SELECT 'part_' || p_partkey || '.pdf' AS file_name, p_type, p_brand, p_size, short_form, long_form,
           '{"acronym": "' || short_form || '", "definition": "' || long_form || '", "certainty": '
               || (p_size + 50) || '}' AS item
    FROM items
),
glossary AS (
    SELECT file_name, short_form AS acronym, long_form AS definition,
           CASE WHEN p_type <> 'LARGE' THEN p_size + 50 END::INT AS certainty
    FROM responses WHERE p_type IN ('ECONOMY', 'MEDIUM', 'SMALL', 'LARGE')
    UNION ALL
    SELECT file_name, 'BR', p_brand, p_size FROM responses WHERE p_type = 'MEDIUM'
)
"""


def filled(template: str, **values: str) -> str:
    """Template text as an SQL concatenation."""
    sql = quoted(template)
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


MESSAGE_OBJECT = "{'role': role, 'content': text}"

METRICS = f"""{nearest_vectors(10)},
hits AS (
    SELECT question_id, count(*) AS hits, min(rank) AS first_hit
    FROM ranked WHERE label = question_id GROUP BY question_id
),
totals AS (SELECT label AS question_id, count(*) AS relevant FROM embeddings GROUP BY label),
metrics AS (
    SELECT question_id, relevant, coalesce(hits, 0) AS hits, coalesce(hits, 0) / relevant AS recall,
           coalesce(hits, 0) / 10 AS precision, coalesce(1 / first_hit, 0) AS reciprocal_rank
    FROM totals LEFT JOIN hits USING (question_id)
)"""


PLACED = f"""
responses AS (
    SELECT doc_id, text, CASE lang WHEN 'de' THEN l[2:] WHEN 'fr' THEN list_concat(l, [l[-1], 'Nulle part; ☠']) ELSE l END AS l
    FROM (SELECT doc_id, text, lang, string_split(text, {NL}) AS l FROM documents WHERE text IS NOT NULL)
),
steps AS (
    SELECT doc_id, 0 AS chunk_number, 0 AS begun, 1 AS ended, 1 AS reach, NULL::INT AS start, NULL::INT AS stop, NULL::INT AS gap
    FROM responses
    UNION ALL
    SELECT doc_id, chunk_number + 1, coalesce(here, begun), coalesce(here + n, ended), greatest(reach, coalesce(here + n, 0)),
           here, here + n, here - reach
    FROM (
        SELECT doc_id, chunk_number, begun, ended, reach, length(l[chunk_number + 1])::INT AS n,
               CASE WHEN l[chunk_number + 1] <> '' THEN coalesce(
                   ended - 1 + nullif(instr(substr(text, ended), l[chunk_number + 1]), 0),
                   begun + nullif(instr(substr(text, begun + 1), l[chunk_number + 1]), 0)) END::INT AS here
        FROM steps JOIN responses USING (doc_id) WHERE chunk_number < len(l)
    )
),
placed AS (
    SELECT doc_id, length(text) AS text_length, chunk_number, l[chunk_number] AS content, start, stop, gap
    FROM steps JOIN responses USING (doc_id) WHERE chunk_number > 0
)
"""

DIFFERENCE = f"""
        WITH {SNAPSHOTS}
        SELECT uuid, content, 'insert' AS _change_type FROM new ANTI JOIN old USING (uuid)
        UNION ALL SELECT uuid, content, 'delete' FROM old ANTI JOIN new USING (uuid)
        UNION ALL SELECT uuid, o.content, 'update_preimage' FROM old o JOIN new n USING (uuid)
                  WHERE o.content IS DISTINCT FROM n.content
        UNION ALL SELECT uuid, n.content, 'update_postimage' FROM old o JOIN new n USING (uuid)
                  WHERE o.content IS DISTINCT FROM n.content
    """

ORACLE: dict[str, str] = {
    "file_scan": """
        SELECT doc_id, 'lang=' || lang || '/source=' || source AS folder, length(text)::INT AS length
        FROM documents
    """,
    "file_listing": r"""
        SELECT lower(string_split(url, '/')[-1]) AS file_name, url AS full_path,
               lower(regexp_extract(string_split(url, '/')[-1], '(?s)^\.*[^.].*(\.[^.]*)$', 1)) AS file_extension
        FROM pages
    """,
    "ingest": f"WITH {INGESTED} SELECT * FROM ingested",
    "ingest_counters": f"""
        WITH {INGESTED}
        SELECT status, count(*) AS files, sum(length)::BIGINT AS characters FROM ingested GROUP BY status
    """,
    "incremental_new": f"""
        SELECT 'doc_' || doc_id || '.pdf' AS file_name, {PATH} || '.pdf' AS full_path, '.pdf' AS file_extension
        FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    """,
    "incremental_ingest": f"""
        WITH {BRONZE.replace("SELECT path, file_name, '.pdf'", "SELECT path, doc_id, pages, file_name, '.pdf'").replace("SELECT " + PATH, "SELECT doc_id, " + PATH)}
        SELECT path, file_name, file_extension, num_pages, length,
               CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = bronze.doc_id) THEN year
                    ELSE coalesce({year(strip("pages[1]"))}, {year(strip("text"))}) END AS year,
               text, status
        FROM bronze
    """,
    "write_overwrite_append": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "schema_merge": """
        SELECT doc_id, text, source FROM documents WHERE lang IS NOT DISTINCT FROM 'en'
        UNION ALL BY NAME SELECT doc_id, lang, text, n_chars FROM documents WHERE lang IS DISTINCT FROM 'en'
    """,
    "snapshot_diff": DIFFERENCE,
    "apply_changes": f"WITH {SNAPSHOTS} SELECT uuid, content FROM new",
    "change_feed": DIFFERENCE,
    "change_log": f"""
        WITH {SNAPSHOTS}
        SELECT uuid, sha256(o.content) AS content_sha256, 'update_preimage' AS _change_type, 1::INT AS _commit_version
        FROM old o JOIN new n USING (uuid) WHERE o.content <> n.content
        UNION ALL SELECT uuid, sha256(n.content), 'update_postimage', 1 FROM old o JOIN new n USING (uuid)
                  WHERE o.content <> n.content
        UNION ALL SELECT uuid, sha256(content), 'insert', 1 FROM new ANTI JOIN old USING (uuid)
                  WHERE starts_with(content, 'Version deux. ')
        UNION ALL SELECT uuid, sha256(content), 'delete', 2 FROM old ANTI JOIN new USING (uuid)
    """,
    "table_versions": f"""
        WITH {SNAPSHOTS}
        SELECT uuid, content, 0::INT AS version FROM old UNION ALL SELECT uuid, content, 3 FROM new
    """,
    "index_sync": f"""
        WITH {SNAPSHOTS}, {weights("new", "uuid", "content")}
        SELECT uuid, bucket, round(weight::DOUBLE, 6) AS weight FROM weights
    """,
    "stored_index": f"""
        WITH {SNAPSHOTS}, {weights("new", "uuid", "content")}
        SELECT uuid, bucket, round(weight::DOUBLE, 6) AS weight FROM weights
    """,
    "chunk_recursive": f"""
        WITH {RECURSIVE_CHUNKS}
        SELECT path, file_name, file_extension, num_pages, length, year, content,
               length(content)::INT AS char_length, chunk_num, file_name || '_' || chunk_num AS uuid
        FROM numbered JOIN bronze USING (path)
    """,
    "chunk_sequential": f"WITH RECURSIVE {GOLD} SELECT * FROM gold",
    "chunk_sequential_tables": f"""
        WITH RECURSIVE {WITH_TABLES}
        SELECT doc_id, c.c AS content, CASE WHEN c.t THEN 'Table' ELSE 'CompositeElement' END AS category,
               length(c.c)::INT AS char_length, chunk_num
        FROM (SELECT doc_id, unnest(l) AS c, (generate_subscripts(l, 1) - 1)::INT AS chunk_num FROM chunks)
    """,
    "combine_elements": folded_lines(f"trim(x, {EDGES})", 1)
    + f"""
        SELECT doc_id, (generate_subscripts(g, 1) - 1)::INT AS element_num,
               unnest(list_transform(g, lambda c: trim(c.c, {EDGES}))) AS content
        FROM groups
    """,
    "combine_small_chunks": folded_lines("x", 0)
    + """
        SELECT doc_id, (generate_subscripts(g, 1) - 1)::INT AS chunk_num,
               unnest(list_transform(g, lambda c: c.c)) AS content,
               unnest(list_transform(g, lambda c: c.n))::INT AS char_length
        FROM groups
    """,
    "chunk_key_check": f"""
        WITH RECURSIVE {GOLD}
        SELECT source || '.pdf_' || chunk_num AS uuid, count(*) AS rows
        FROM (SELECT string_split(path, '/')[3] AS source, chunk_num FROM gold)
        GROUP BY ALL HAVING count(*) > 1
    """,
    "chunk_profile": f"WITH RECURSIVE {GOLD} "
    + " UNION ALL ".join(described(n) for n in ("num_pages", "length", "char_length", "chunk_num")),
    "recursive_profile": f"WITH {RECURSIVE_CHUNKS}, "
    "gold AS (SELECT length(content)::INT AS char_length, chunk_num FROM numbered) "
    + " UNION ALL ".join(described(n) for n in ("char_length", "chunk_num")),
    "chunk_requests": f"""
        WITH {BRONZE}
        SELECT file_name, {filled(CHUNK_PROMPT, document="text")} AS prompt FROM bronze
    """,
    "order_profile": """
        SELECT column_name, count, round(mean, 3) AS mean, round(std, 3) AS std, min,
               round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, max
        FROM (
    """ + " UNION ALL ".join(described(n, "orders", 9) for n in ("o_totalprice", "o_custkey")) + ")",
    "parse_chunk_response": f"""
        SELECT doc_id, generate_subscripts(l, 1)::INT AS chunk_number, unnest(l) AS content, true AS verbatim
        FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents WHERE lang <> 'es')
    """,
    "clean": f"SELECT doc_id, {clean('text')} AS cleaned, {strip('text')} AS stripped FROM documents",
    "publication_year": f"""
        WITH {DATED},
        whole AS (SELECT *, first_page || {NL} || text AS w FROM files)
        SELECT doc_id, {year(clean("first_page"))} AS year_clean, {year(strip("first_page"))} AS year_stripped,
               CASE WHEN NOT damaged THEN {year(clean("w"))} END AS year_whole_clean,
               CASE WHEN NOT damaged THEN {year(strip("w"))} END AS year_whole_stripped
        FROM whole
    """,
    "text_windows": """
        SELECT doc_id, ((start - 1) // 1000)::INT AS window_num, start::INT AS start,
               substr(text, start, 1000) AS content
        FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, 1000)) AS start FROM documents)
    """,
    "text_windows_overlapping": """
        SELECT doc_id, ((start - 1) // 600)::INT AS window_num, start::INT AS start,
               substr(text, start, 1000) AS content
        FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, 600)) AS start FROM documents)
    """,
    "hashed_embedding": f"""
        WITH {weights("documents", "doc_id", "text")}
        SELECT doc_id, bucket, round(weight::DOUBLE, 6) AS weight FROM weights
    """,
    "topk_similarity": f"WITH {nearest_vectors(10)} SELECT * FROM ranked",
    "topk_filtered": f"WITH {nearest_vectors(5, 'label IN (1, 2, 3)')} SELECT * FROM ranked",
    "topk_lsh": f"""
        WITH {LABEL_QUESTIONS}, {CELLS},
        scored AS (
            SELECT question_id, e.vec_id, label,
                   round(list_cosine_similarity(vector, embedding::DOUBLE[]), 8) AS score
            FROM questions q JOIN question_cells qc USING (question_id),
                 embeddings e JOIN vector_cells vc USING (vec_id)
            WHERE bit_count(xor(qc.cell, vc.cell)) <= 2
        )
        SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id))::INT AS rank,
               vec_id, score, label
        FROM scored QUALIFY rank <= 10
    """,
    "search": f"WITH RECURSIVE {FOUND} SELECT * FROM found",
    "search_filtered": f"WITH RECURSIVE {found(FIRST_GOLD)} SELECT * FROM found",
    "search_function": f"""
        WITH RECURSIVE {GOLD},
        texts AS (SELECT uuid AS id, content AS body FROM gold UNION ALL SELECT '?', 'The price of the plan'),
        {weights("texts", "id", "body")},
        norms AS (SELECT id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS norm FROM weights GROUP BY id),
        scored AS (
            SELECT n.id AS uuid, round(coalesce(sum(w.weight::DOUBLE * q.n), 0.0)
                       / any_value(norm * (SELECT sqrt(sum(n * n)) FROM counts WHERE id = '?')), 8) AS score
            FROM norms n JOIN weights w USING (id)
            LEFT JOIN (SELECT * FROM counts WHERE id = '?') q ON q.bucket = w.bucket
            WHERE n.id <> '?' GROUP BY n.id
        )
        SELECT uuid, content, category, char_length, chunk_num, file_name, file_extension,
               num_pages, length, year, score
        FROM scored JOIN gold USING (uuid) ORDER BY score DESC, uuid LIMIT 5
    """,
    "search_hybrid": f"""
        WITH RECURSIVE {GOLD}, {SCORES}, {BM25},
        best AS (
            SELECT question_id, uuid, score,
                   (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uuid))::INT AS rank
            FROM fused QUALIFY rank <= 5
        )
        SELECT question_id, rank, uuid, content, category, char_length, chunk_num, file_name,
               file_extension, num_pages, length, year, score
        FROM best JOIN gold USING (uuid)
    """,
    "search_records": f"""
        WITH RECURSIVE {FOUND}
        SELECT to_json({{'question_id': question_id, 'rank': rank, 'uuid': uuid, 'char_length': char_length,
                         'chunk_num': chunk_num, 'file_name': file_name, 'year': year}})::VARCHAR AS record
        FROM found
    """,
    "hybrid": f"""
        WITH RECURSIVE {GOLD}, {SCORES}, {BM25}
        SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uuid))::INT AS rank,
               uuid, score, dense_rank, sparse_rank
        FROM fused QUALIFY rank <= 5
    """,
    "hybrid_filtered": f"""
        WITH RECURSIVE {FIRST_GOLD}, {SCORES}, {BM25}
        SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uuid))::INT AS rank,
               uuid, score, dense_rank, sparse_rank
        FROM fused QUALIFY rank <= 5
    """,
    "hybrid_synced": f"""
        WITH RECURSIVE {SNAPSHOTS}, gold AS (SELECT uuid, content FROM new), {SCORES}, {BM25}
        SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uuid))::INT AS rank,
               uuid, score, dense_rank, sparse_rank
        FROM fused QUALIFY rank <= 5
    """,
    "prompt_context": f"""
        WITH RECURSIVE {FOUND},
        contexts AS (
            SELECT question_id, string_agg('Passage: ' || content || {NL}, '' ORDER BY rank) AS context
            FROM found GROUP BY question_id
        )
        SELECT item_id AS question_id, context,
               {filled(PROMPT, chat_history="'none'", context="coalesce(context, '')", question="text")} AS prompt
        FROM benchmark LEFT JOIN contexts ON item_id = question_id
    """,
    "retrieval_metrics": f"""
        WITH {METRICS}
        SELECT question_id, relevant, hits, round(recall, 6) AS recall, round(precision, 6) AS precision,
               round(reciprocal_rank, 6) AS reciprocal_rank
        FROM metrics
    """,
    "retrieval_summary": f"""
        WITH {METRICS}
        SELECT count(*) AS questions, round(avg(recall), 6) AS mean_recall,
               round(avg(precision), 6) AS mean_precision, round(avg(reciprocal_rank), 6) AS mrr
        FROM metrics
    """,
    "glossary_requests": f"""
        WITH {BRONZE},
        starts AS (SELECT file_name, text, unnest(range(1, length(text) + 1, 5000)) AS start FROM bronze)
        SELECT file_name, ((start - 1) // 5000)::INT AS window_num, start::INT AS start,
               {filled(EXTRACTION_PROMPT, content="substr(text, start, 5000)")} AS prompt
        FROM starts WHERE file_name LIKE 'doc_%.pdf'
    """,
    "glossary_flatten": f"WITH {PARTS} SELECT * FROM glossary",
    "glossary_table": f"WITH {PARTS} SELECT * FROM glossary",
    "glossary_rejects": f"""
        WITH {PARTS}
        SELECT file_name, 'Sure, here it is: ' || item AS glossary_json FROM responses WHERE p_type = 'PROMO'
    """,
    "lookup_glossary": f"""
        WITH {PARTS}
        SELECT definition, certainty FROM glossary WHERE acronym ILIKE trim('sR ') AND certainty >= 80
    """,
    "lookup_batch": f"""
        WITH {PARTS},
        terms AS (
            SELECT ' ' || lower(short_form) || ' ' AS term FROM items
            UNION SELECT n_name[1] || '%' FROM nation
            UNION SELECT '_' || n_name[2] FROM nation
            UNION SELECT r_name FROM region
        )
        SELECT term, definition, certainty,
               row_number() OVER (PARTITION BY term ORDER BY certainty DESC, definition)::INT AS rank
        FROM terms JOIN glossary ON acronym ILIKE trim(term) WHERE certainty >= 80
    """,
    "mine_acronyms": f"""
        WITH {PARTS},
        found AS (
            SELECT p_partkey, short_form AS acronym, long_form AS definition, 100 AS certainty FROM items
            UNION ALL
            SELECT p_partkey, upper(substr(p_name, 1, 2)), p_type || ' item',
                   CASE WHEN p_name[1] = lower(p_type[1]) THEN 50 ELSE 0 END
                   + CASE WHEN p_name[2] = 'i' THEN 50 ELSE 0 END FROM items
        )
        SELECT p_partkey, acronym, definition, certainty::INT AS certainty FROM found WHERE certainty >= 1
    """,
    "system_prepend": """
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL
        SELECT conv_id, least(min(turn), 0) - 1, 'system', 'You answer questions about the documents.'
        FROM conversations GROUP BY conv_id
    """,
    "render_messages": f"""
        SELECT conv_id, string_agg(
            CASE WHEN role = 'user' AND turn > 1 THEN
                     '<tool_call_result>{{' || {NL} || '  "id": "call_' || conv_id || '_' || (turn - 1) || '",' || {NL}
                     || '  "content": ' || to_json(text)::VARCHAR || {NL} || '}}</tool_call_result>'
                 WHEN role = 'assistant' AND length(text) > 150 THEN
                     '<tool_call>{{' || {NL} || '  "id": "call_' || conv_id || '_' || turn || '",' || {NL}
                     || '  "name": "lookup_glossary",' || {NL} || '  "arguments": '
                     || to_json('{{"input_acronym":' || to_json(substr(text, 1, 3))::VARCHAR || '}}')::VARCHAR
                     || {NL} || '}}</tool_call>'
                 ELSE text END || {NL} || {NL}, '' ORDER BY turn) AS transcript
        FROM conversations GROUP BY conv_id
    """,
    "finished_flag": """
        SELECT conv_id, NOT arg_max(role = 'assistant' AND length(text) > 150, turn) AS finished
        FROM conversations GROUP BY conv_id
    """,
    "chat_history": f"""
        SELECT conv_id, turn, string_agg(role || ': ' || text, {NL}) OVER (
            PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS history
        FROM conversations
    """,
    "evaluation_records": f"""
        SELECT conv_id, turn, to_json({{'request': {{'messages': list({MESSAGE_OBJECT}) OVER (
            PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)}}, 'expected_response': NULL}})::VARCHAR AS record
        FROM conversations
    """,
    "tool_calls": """
        SELECT u.conv_id, 'call_' || u.turn AS call_id, u.turn, 'search_documentation' AS name,
               to_json({'topic': u.text})::VARCHAR AS arguments, a.text AS result
        FROM conversations u LEFT JOIN conversations a
            ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        WHERE u.role = 'user'
    """,
    "evaluation_source": f"""
        WITH {BRONZE}
        SELECT file_name AS doc_uri, text AS content, num_pages, length FROM bronze ORDER BY file_name, path LIMIT 20
    """,
    "stream_ingest": f"WITH {BRONZE} SELECT * FROM bronze",
    "stream_sync": f"WITH RECURSIVE {GOLD} SELECT uuid, content, char_length FROM gold",
    "stream_containers": f"WITH {BRONZE} SELECT * FROM bronze",
    "align_acronyms": f"""
        WITH RECURSIVE {PARTS},
        asked AS (
            SELECT p_partkey, 1 AS nth, short_form AS acronym, 'We list the ' || long_form AS before FROM items
            UNION ALL
            SELECT p_partkey, 2, upper(p_name[1] || p_type[3]), 'then the ' || p_name || ' ' || lower(p_type) FROM items
        ),
        cut AS (
            SELECT p_partkey, nth, acronym, list_filter(string_split(before, ' '), lambda w: w <> '') AS words FROM asked
        ),
        candidates AS (
            SELECT p_partkey, nth, acronym,
                   array_to_string(words[-least(length(acronym) + 5, 2 * length(acronym), len(words)):], ' ') AS form
            FROM cut
        ),
        -- From the last letter to the first: the last place before the one matched before.
        steps AS (
            SELECT p_partkey, nth, length(acronym) AS letter, length(form) + 1 AS place FROM candidates
            UNION ALL
            SELECT p_partkey, nth, letter - 1, coalesce((
                       SELECT max(i) FROM range(1, place) t(i)
                       WHERE lower(form[i]) = lower(acronym[letter])
                         AND (letter > 1 OR i = 1 OR NOT regexp_matches(form[i - 1], '[\\p{{L}}\\p{{N}}]'))), 0)
            FROM steps JOIN candidates USING (p_partkey, nth) WHERE letter > 0 AND place > 0
        )
        SELECT p_partkey, acronym, substr(form, place) AS definition
        FROM steps JOIN candidates USING (p_partkey, nth)
        WHERE letter = 0 AND place > 0 AND length(form) - place + 1 > length(acronym)
          AND NOT list_contains(string_split_regex(substr(form, place), '[ -]'), acronym)
    """,
    "stream_changes": f"""
        WITH lines AS (SELECT doc_id, lang, string_split(text, {NL}) AS l FROM documents),
        later AS (
            SELECT doc_id, CASE lang WHEN 'fr' THEN list_concat(['Version deux. ' || l[1]], l[2:])
                                     WHEN 'de' THEN l[1:len(l) - 1] ELSE l END AS l
            FROM lines
        ),
        old AS (SELECT doc_id || '_' || (i - 1) AS uuid, l[i] AS content
                FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines)),
        new AS (SELECT doc_id || '_' || (i - 1) AS uuid, l[i] AS content
                FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM later))
        SELECT uuid, n.content AS content, 'update' AS _change_type
        FROM old o JOIN new n USING (uuid) WHERE o.content <> n.content
        UNION ALL SELECT uuid, NULL, 'delete' FROM old ANTI JOIN new USING (uuid)
    """,
    "chunk_places": f"""
        WITH RECURSIVE {PLACED}
        SELECT doc_id, chunk_number, content, start, stop AS "end", gap FROM placed
    """,
    "chunk_coverage": f"""
        WITH RECURSIVE {PLACED}
        SELECT doc_id, count(*) AS chunks, count(start) AS placed,
               coalesce(sum(greatest(stop - start + least(gap, 0), 0)), 0)::BIGINT AS covered,
               coalesce(sum(greatest(gap, 0)), 0)::BIGINT AS in_gaps,
               coalesce(sum(greatest(-gap, 0)), 0)::BIGINT AS in_overlaps,
               round(coalesce(sum(greatest(stop - start + least(gap, 0), 0)), 0) / any_value(nullif(text_length, 0)), 6) AS share
        FROM placed GROUP BY doc_id
    """,
    "letter_embedding": """
        SELECT doc_id, bucket, n::DOUBLE AS weight
        FROM (SELECT doc_id, b::INT AS bucket,
                     length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), chr(97 + b::INT), '')) AS n
              FROM documents, range(26) t(b))
        WHERE n > 0
    """,
    "glossary_requests_of_some": f"""
        WITH windows AS (
            SELECT 'doc_' || doc_id || '.pdf' AS file_name, unnest(range(1, length(text) + 1, 5000)) AS start FROM documents
        )
        SELECT file_name, ((start - 1) // 5000)::INT AS window_num, start::INT AS start
        FROM windows WHERE file_name LIKE 'doc_1_%.pdf'
    """,
    "lookup_lateral": f"""
        WITH {PARTS},
        terms AS (
            SELECT ' ' || lower(short_form) || ' ' AS term FROM items
            UNION SELECT n_name[1] || '%' FROM nation
            UNION SELECT '_' || n_name[2] FROM nation
            UNION SELECT r_name FROM region
        )
        SELECT term, definition, certainty
        FROM terms LEFT JOIN (SELECT * FROM glossary WHERE certainty >= 80) ON acronym ILIKE trim(term)
    """,
}
