"""The same queries as DuckDB SQL, written from the rules and not from the Spark code."""

from __future__ import annotations

# Fixed values, spelled out here so that a slip in the code under test does not pass on both sides.
KEPT_LOWER = "áàâãéèêíïóôõúüçñ"
KEPT_UPPER = "ÁÀÂÃÉÈÊÍÏÓÔÕÚÜÇÑ"
EXTENSIONS = [".txt", ".pdf", ".docx", ".xlsx", ".pptx", ".ppt", ".PDF", ".csv"]

FOLDER = "application/vnd.google-apps.folder"


def _clean(text: str) -> str:
    return f"regexp_replace({text}, '[^a-zA-Z0-9{KEPT_LOWER}{KEPT_UPPER}\\s\\-'']', '', 'g')"


# Word rules that RE2 can state, in order; none of them looks ahead.
_RULES = [
    (" ('')".replace("'", "''"), " `` "),
    (f"''([abcefghijklopqruvwxyz0-9])([^a-z0-9{KEPT_LOWER}]|$)", "'' \\1\\2"),
    ("([^''])'' ", "\\1 '' "),
    ("--", " -- "),
    ("''''", " '''' "),
    ("\\s+", " "),
    ("([^'' ])(''[smd]|'') ", "\\1 \\2 "),
    ("([^'' ])(''ll|''re|''ve|n''t) ", "\\1 \\2 "),
    ("\\b(can)(not)\\b", " \\1 \\2 "),
    ("\\b(gim)(me)\\b", " \\1 \\2 "),
    ("\\b(gon)(na)\\b", " \\1 \\2 "),
    ("\\b(got)(ta)\\b", " \\1 \\2 "),
    ("\\b(lem)(me)\\b", " \\1 \\2 "),
    ("\\b(wan)(na)(\\s)", " \\1 \\2 \\3"),
]


def _tokens(text: str) -> str:
    sql = f"lower({_clean(text)}) || ' '"
    for pattern, by in _RULES:
        sql = f"regexp_replace({sql}, '{pattern}', '{by}', 'g')"
    return f"list_filter(regexp_split_to_array({sql}, '\\s+'), lambda t: t <> '')"


def _with(*names: str) -> str:
    return "WITH " + ", ".join(_CTES[n] for n in names) + " "


def _chunks(name: str, table: str, key: str) -> str:
    return f"""{name}_tokens AS (SELECT {key} AS doc_id, {_tokens('text')} AS tokens FROM {table}),
{name} AS (SELECT doc_id, c::INT AS chunk_id, tokens[c * 50 + 1 : c * 50 + 50] AS tokens
  FROM (SELECT doc_id, tokens, unnest(range((len(tokens) + 49) // 50)) AS c FROM {name}_tokens))"""


def _vectors(name: str, chunks: str) -> str:
    return f"""{name}_weights AS (
  SELECT doc_id, chunk_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS bucket,
    sum(CASE WHEN substr(md5(t), 9, 1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE -1 END) AS w
  FROM (SELECT doc_id, chunk_id, unnest(tokens) AS t FROM {chunks}) GROUP BY ALL),
{name} AS (
  SELECT k.doc_id, k.chunk_id, list(coalesce(w, 0)::DOUBLE ORDER BY b) AS embedding
  FROM (SELECT doc_id, chunk_id, unnest(range(64)) AS b FROM {chunks}) k
  LEFT JOIN {name}_weights v ON v.doc_id = k.doc_id AND v.chunk_id = k.chunk_id AND v.bucket = k.b
  GROUP BY ALL)"""


def _distance(a: str, b: str) -> str:
    pairs = f"list_zip({a}::DOUBLE[], {b}::DOUBLE[])"
    return f"list_sum(list_transform({pairs}, lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


_EXTENSIONS = ", ".join(f"'{e}'" for e in EXTENSIONS)
_CTES = {
    "items": f"""items AS (
  SELECT DISTINCT 'f:' || lang AS id, lang AS name, '{FOLDER}' AS mime_type, 'root' AS parent_id FROM documents
  UNION ALL
  SELECT DISTINCT 'f:' || lang || '/' || source, source, '{FOLDER}', 'f:' || lang FROM documents
  UNION ALL
  SELECT doc_id::VARCHAR, 'doc_' || doc_id || '.txt', 'text/plain', 'f:' || lang || '/' || source FROM documents)""",
    "paths": f"""paths AS (
  SELECT lang || '/' || source || '/doc_' || doc_id || e AS path, e, text
  FROM (SELECT *, unnest([{_EXTENSIONS}]) AS e FROM documents))""",
    "texts": """texts AS (
  SELECT path,
    CASE e WHEN '.txt' THEN 'txt' WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.xlsx' THEN 'xlsx'
      WHEN '.pptx' THEN 'pptx' WHEN '.ppt' THEN 'pptx' ELSE 'unsupported' END AS route,
    CASE WHEN e IN ('.txt', '.pdf') AND text = '' THEN 'empty'
      WHEN e = '.ppt' THEN 'error' WHEN e IN ('.PDF', '.csv') THEN 'unsupported' ELSE 'ok' END AS status,
    CASE WHEN e IN ('.txt', '.pdf') THEN text WHEN e IN ('.docx', '.xlsx') THEN text || chr(10)
      WHEN e = '.pptx' THEN replace(text || chr(10), chr(10), ' ' || chr(10)) ELSE '' END AS text
  FROM paths)""",
    "chunks": _chunks("chunks", "documents", "doc_id"),
    "vectors": _vectors("vectors", "chunks"),
    "index": """placed AS (
  SELECT row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS vec_id, * FROM vectors)""",
    "file_chunks": _chunks("file_chunks", "texts", "path"),
    "file_vectors": _vectors("file_vectors", "file_chunks"),
    "questions": _chunks("q_chunks", "benchmark", "item_id") + ", " + _vectors("questions", "q_chunks"),
    "neighbours": f"""pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id, {_distance('e.embedding', 'q.embedding')} AS distance
  FROM embeddings e, embeddings q),
neighbours AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance
  FROM pairs QUALIFY rank <= 5)""",
}

_WORDS = "array_to_string(tokens, ' ')"
_NUMBERS = "array_to_string(list_transform(embedding, lambda x: x::INT), ' ')"


def _nearest(query: str, k: int) -> str:
    return f"""SELECT e.vec_id, {_distance('e.embedding', 'q.embedding')} AS distance
FROM embeddings e, ({query}) q ORDER BY distance, e.vec_id LIMIT {k}"""


ORACLES: dict[str, str] = {
    "list_folder": _with("items")
    + f"""SELECT id, name FROM items WHERE parent_id = 'f:en/src0' AND mime_type <> '{FOLDER}'
ORDER BY id LIMIT 100""",
    "list_every_folder": _with("items")
    + f"""SELECT parent_id, id, name, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS place
FROM items WHERE mime_type <> '{FOLDER}' QUALIFY place <= 100""",
    "walk_folders": "WITH RECURSIVE "
    + _CTES["items"]
    + f""", reached AS (
  SELECT 'root' AS id UNION
  SELECT items.id FROM items JOIN reached ON items.parent_id = reached.id WHERE mime_type = '{FOLDER}')
SELECT DISTINCT items.id, name FROM items JOIN reached ON parent_id = reached.id WHERE mime_type <> '{FOLDER}'""",
    "valid_file_refs": """SELECT labels.doc_id::VARCHAR AS id, lang || '_' || documents.doc_id AS name
FROM documents JOIN labels USING (doc_id)""",
    "route_by_extension": _with("paths", "texts") + "SELECT path, route FROM texts",
    "extract_text": _with("paths", "texts") + "SELECT path, route, status, md5(text) AS text_md5 FROM texts",
    "nonempty_text": _with("paths", "texts")
    + "SELECT path, length(text)::BIGINT AS n_chars FROM texts WHERE text <> ''",
    "strip_special": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "lowercase_text": f"SELECT doc_id, lower({_clean('text')}) AS text FROM documents",
    "tokenize": f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents",
    "tokenize_turns": f"SELECT conv_id, turn, array_to_string({_tokens('text')}, ' ') AS tokens FROM conversations",
    "tokenize_pages": f"SELECT page_id, array_to_string({_tokens('html')}, ' ') AS tokens FROM pages",
    "tokenize_file": f"""SELECT 'doc_' || doc_id || '.txt' AS file_name,
  CASE WHEN text <> '' THEN array_to_string({_tokens('text')}, ' ') END AS tokens FROM documents""",
    "token_preview": f"SELECT doc_id, array_to_string({_tokens('text')}[1:20], ' ') AS preview FROM documents",
    "chunk_counts": f"""SELECT doc_id, ceil(len({_tokens('text')}) / 50)::BIGINT AS n_chunks FROM documents""",
    "chunk_documents": _with("chunks") + f"SELECT doc_id, chunk_id, {_WORDS} AS tokens FROM chunks",
    "chunk_labels": _with("chunks")
    + "SELECT doc_id, chunk_id, 'doc_' || doc_id || '.v1_part_' || chunk_id AS label FROM chunks",
    "encoder_input": _with("chunks")
    + f"SELECT doc_id, chunk_id, '[CLS] ' || {_WORDS} || ' [SEP]' AS input FROM chunks",
    "label_collisions": _with("chunks")
    + """SELECT source || '_part_' || chunk_id AS label, count(*) AS n
FROM chunks JOIN documents USING (doc_id) GROUP BY ALL HAVING n > 1""",
    "encode_chunks": _with("chunks", "vectors") + f"SELECT doc_id, chunk_id, {_NUMBERS} AS embedding FROM vectors",
    "encode_with_plugin": _with("chunks")
    + """SELECT doc_id, chunk_id, len(tokens) || ' ' || list_sum(list_transform(tokens, lambda t: length(t))) || ' '
  || list_max(list_transform(tokens, lambda t: length(t))) AS embedding FROM chunks""",
    "encode_with_failures": _with("chunks") + "SELECT doc_id, chunk_id FROM chunks WHERE len(tokens) = 50",
    "dimension_check": "SELECT len(embedding) AS dimension, count(*) AS n FROM embeddings GROUP BY ALL",
    "missing_vectors": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "listed_vectors": """SELECT doc_id, len(embedding) AS dimension
FROM documents JOIN embeddings ON doc_id = vec_id""",
    "index_positions": _with("chunks")
    + "SELECT row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS vec_id, doc_id, chunk_id FROM chunks",
    "build_index": _with("chunks", "vectors", "index")
    + f"SELECT vec_id, doc_id, chunk_id, {_NUMBERS} AS embedding FROM placed",
    "append_vectors": _with("chunks")
    + """SELECT vec_id, vec_id AS doc_id, 0 AS chunk_id FROM embeddings
UNION ALL
SELECT (SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY doc_id, chunk_id) - 1, doc_id, chunk_id
FROM chunks WHERE NOT (chunk_id = 0 AND doc_id IN (SELECT vec_id FROM embeddings))""",
    "l2_distance": f"""SELECT a.vec_id, {_distance('a.embedding', 'b.embedding')} AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "search_topk": _nearest("SELECT embedding FROM embeddings ORDER BY vec_id DESC LIMIT 1", 5),
    "self_query": _nearest("SELECT embedding FROM embeddings WHERE vec_id = 0", 3),
    "knn_join": _with("neighbours") + "SELECT * FROM neighbours",
    "hits_with_metadata": _with("neighbours")
    + """SELECT vec_id, query_id, rank, distance, quality, toxic,
  quality IS NOT NULL AND toxic IS NOT NULL AS meta_complete
FROM neighbours LEFT JOIN labels ON doc_id = vec_id""",
    "document_search": _with("chunks", "vectors", "index")
    + f"""SELECT p.vec_id, p.doc_id, 'doc_' || p.doc_id || '.txt' AS file_name, p.chunk_id,
  {_distance('p.embedding', 'q.embedding')} AS distance
FROM placed p, (SELECT embedding FROM placed WHERE vec_id = 0) q ORDER BY distance, p.vec_id LIMIT 3""",
    "index_files": _with("paths", "texts", "file_chunks", "file_vectors")
    + f"""SELECT row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS vec_id, doc_id, chunk_id, {_NUMBERS} AS embedding
FROM file_vectors""",
    "passage_search": _with("chunks", "vectors", "index", "questions")
    + f"""SELECT q.doc_id * 4294967296 + q.chunk_id AS query_id,
  row_number() OVER (PARTITION BY q.doc_id, q.chunk_id
    ORDER BY {_distance('p.embedding', 'q.embedding')}, p.vec_id) AS rank,
  p.vec_id, {_distance('p.embedding', 'q.embedding')} AS distance, p.doc_id, p.chunk_id, true AS meta_complete
FROM placed p, questions q QUALIFY rank <= 3""",
    "file_stats": f"""SELECT doc_id, len({_tokens('text')}) AS n_tokens,
  ceil(len({_tokens('text')}) / 50)::BIGINT AS n_chunks FROM documents""",
    "run_report": f"""WITH t AS (SELECT len({_tokens('text')}) AS n FROM documents)
SELECT count(*) AS files, count(*) FILTER (n = 0) AS skipped, sum(n)::BIGINT AS tokens,
  sum((n + 49) // 50)::BIGINT AS chunks, sum((n + 49) // 50)::BIGINT AS vectors, 64 AS dimension FROM t""",
}
ORACLES["knn_join_in_cells"] = ORACLES["knn_join"]
ORACLES["saved_index"] = ORACLES["build_index"]
ORACLES["append_after_lost_run"] = _with("chunks") + """, parts AS (
  SELECT doc_id, chunk_id, doc_id % 2 AS late FROM chunks)
SELECT row_number() OVER (ORDER BY late, doc_id, chunk_id) - 1 AS vec_id, doc_id, chunk_id FROM parts"""
ORACLES["resaved_index"] = ORACLES["append_after_lost_run"]
ORACLES["append_to_empty_index"] = _with("chunks") + """SELECT row_number() OVER (ORDER BY name, chunk_id) - 1 AS vec_id,
  name AS doc_id, chunk_id FROM (SELECT 'f' || doc_id AS name, chunk_id FROM chunks)"""
ORACLES["list_folder_pages"] = f"""SELECT place, id FROM (
  SELECT 'd' || doc_id AS id, row_number() OVER (ORDER BY 'd' || doc_id) AS place FROM documents WHERE lang = 'en')
WHERE place > 100 AND place <= 200"""
ORACLES["walk_deep_tree"] = """SELECT 'file' || doc_id AS id, 'doc_' || doc_id AS name FROM documents"""
ORACLES["knn_join_with_bad_vectors"] = f"""WITH good AS (SELECT * FROM embeddings WHERE vec_id % 7 <> 0)
SELECT q.vec_id AS query_id, e.vec_id, {_distance('e.embedding', 'q.embedding')} AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_distance('e.embedding', 'q.embedding')}, e.vec_id) AS rank
FROM good e, good q QUALIFY rank <= 5"""


def _by_remainder(n: int) -> str:
    return _with("chunks") + f"""SELECT row_number() OVER (ORDER BY doc_id % {n}, doc_id, chunk_id) - 1 AS vec_id, doc_id, chunk_id
FROM chunks"""


ORACLES["append_by_two_writers"] = _by_remainder(3)
ORACLES["compacted_index"] = _by_remainder(7)
ORACLES["read_while_saved"] = _with("chunks") + """SELECT CASE doc_id % 2 WHEN 0 THEN 'before' ELSE 'after' END AS opened,
  row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id, chunk_id) - 1 AS vec_id, doc_id, chunk_id FROM chunks"""
ORACLES["lookup_positions"] = f"SELECT * FROM ({ORACLES['index_positions']}) WHERE vec_id % 11 = 0"
ORACLES["list_folder_by_token"] = """SELECT (place - 1) // 100 + 1 AS page, id FROM (
  SELECT 'd' || doc_id AS id, row_number() OVER (ORDER BY 'd' || doc_id) AS place FROM documents WHERE lang = 'es')
WHERE place > 100"""
ORACLES["folder_cycles"] = """WITH RECURSIVE edges AS (
  SELECT doc_id AS n, CASE doc_id % 8 WHEN 7 THEN doc_id - 7 ELSE doc_id + 1 END AS up FROM documents WHERE doc_id % 16 <> 3),
ways AS (SELECT n, up, 1 AS steps FROM edges UNION ALL
  SELECT ways.n, edges.up, steps + 1 FROM ways JOIN edges ON ways.up = edges.n WHERE steps < 8)
SELECT 'level' || n AS id, min('level' || up) AS cycle FROM ways GROUP BY n HAVING bool_or(up = n)"""
_CTES["tree"] = _CTES["paths"].replace("paths AS", "all_paths AS") + f""", paths AS (
  SELECT path, e, text FROM all_paths WHERE e = [{_EXTENSIONS}][regexp_extract(path, 'doc_([0-9]+)', 1)::BIGINT % 8 + 1])"""
_NAME = "regexp_extract(path, '[^/]+$')"
ORACLES["index_tree"] = _with("tree", "texts", "file_chunks", "file_vectors") + f"""SELECT
  row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS vec_id, doc_id, regexp_extract(doc_id, '[^/]+$') AS file_name, chunk_id,
  {_NUMBERS} AS embedding FROM file_vectors"""
ORACLES["file_status"] = _with("tree", "texts") + f"""SELECT path AS doc_id, {_NAME} AS file_name, status,
  len({_tokens('text')}) AS n_tokens FROM texts"""
ORACLES["file_run_report"] = _with("tree", "texts") + f""", t AS (SELECT status, len({_tokens('text')}) AS n FROM texts)
SELECT count(*) AS files, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty,
  count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'unsupported') AS unsupported, 0::BIGINT AS no_parser,
  0::BIGINT AS too_large, 0::BIGINT AS missing, 0::BIGINT AS unreadable, sum(n)::BIGINT AS tokens,
  sum((n + 49) // 50)::BIGINT AS chunks, 0::BIGINT AS failed_chunks, sum((n + 49) // 50)::BIGINT AS vectors, 64 AS dimension FROM t"""
ORACLES["encode_windows"] = f"""WITH t AS (SELECT doc_id, len({_tokens('text')}) AS n FROM documents)
SELECT doc_id, ceil(n / 510)::INT AS n_windows, 0 AS n_failed, CASE WHEN n > 0 THEN 2.0::DOUBLE END AS marks,
  CASE WHEN n > 0 THEN ((n // 510 * 510) / n)::FLOAT::DOUBLE END AS in_full_windows FROM t"""
ORACLES["search_pruned"] = ORACLES["search_topk"]
