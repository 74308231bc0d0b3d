"""A query per operator, over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.engine import Engine
from scriptorium.functions import files, payload, text
from scriptorium.operators import catalog, chunks, everywhere, grams, intervals, ranking, retention, search, vectors
from scriptorium.scratch import materialize, new_folder, text_batches
from scriptorium.sources import uploads
from scriptorium.sources.extract import docx_of, pdf_files, pdf_page_rows
from scriptorium.sources.store import TextStore, tables
from scriptorium.streaming import expiry

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SMALL_CHUNK = 4096
SMALL_PREVIEW = 256
AS_OF = "2024-01-15 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# --- SQL pieces -------------------------------------------------------------------------------------------------------

_LINES = """
    SELECT doc_id, i AS line_no, trim(parts[i]) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), range(1, len(parts) + 1) AS r(i)
    WHERE trim(parts[i]) <> ''
"""


def _hits_sql(words: list[str]) -> str:
    met = " AND ".join([f"contains(lower(line), '{w}')" for w in words] or ["TRUE"])
    return f"SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS hit_no, line FROM ({_LINES}) WHERE {met}) WHERE hit_no <= 8"


def _search_sql(words: list[str]) -> str:
    return f"SELECT doc_id, CAST(hit_no AS INTEGER) AS hit_no, line FROM ({_hits_sql(words)})"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _answer_sql(words: list[str]) -> str:
    return f"""
    SELECT d.doc_id, CASE WHEN h.body IS NULL THEN {_quoted(search.NO_HIT)} ELSE {_quoted(search.HEADING)} || h.body END AS answer
    FROM documents d LEFT JOIN (SELECT doc_id, string_agg('• ' || line, chr(10) ORDER BY hit_no) AS body FROM ({_hits_sql(words)}) GROUP BY doc_id) h USING (doc_id)
    """


_FILENAMES = "SELECT doc_id, source || '.' || CASE doc_id % 8 WHEN 0 THEN 'PDF' WHEN 1 THEN 'txt' WHEN 2 THEN 'tar.gz' WHEN 3 THEN 'md' WHEN 4 THEN 'exe' WHEN 5 THEN '' WHEN 6 THEN 'Docx' ELSE 'csv' END AS filename FROM documents"


def filenames(docs: DataFrame) -> DataFrame:
    """File names made of the source and an ending that goes with the id."""
    endings = ["PDF", "txt", "tar.gz", "md", "exe", "", "Docx", "csv"]
    ending = F.get(F.array(*map(F.lit, endings)), (F.col("doc_id") % 8).cast("int"))
    return docs.select("doc_id", F.concat("source", F.lit("."), ending).alias("filename"))


# --- search -----------------------------------------------------------------------------------------------------------


@query(_search_sql(["the", "and"]))
def search_lines_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_lines(documents(spark, sf_dir), "the and")


@query(_search_sql(["the", "and"]))
def search_lines_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_lines_ranked(documents(spark, sf_dir), "the and")


@query(_search_sql([]))
def search_empty_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_lines(documents(spark, sf_dir), "of to")


@query(_search_sql(["license"]))
def search_single_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_lines(documents(spark, sf_dir), "License")


@query(_search_sql(["the", "with"]))
def search_short_word_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_lines(documents(spark, sf_dir), "The WITH by")


@query(_answer_sql(["zzzz"]))
def search_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_answers(documents(spark, sf_dir), "zzzz")


@query(_answer_sql(["the", "and"]))
def search_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_answers(documents(spark, sf_dir), "the and")


@query(f"SELECT doc_id, line FROM ({_LINES}) WHERE contains(lower(line), 'license')")
def search_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of a word: texts without it are dropped at the scan."""
    docs = documents(spark, sf_dir)
    found = docs.where(search.may_match(F.col("text"), "license"))
    return found.select("doc_id", F.explode(search.hits(F.col("text"), "license", 2**31 - 1)).alias("line"))


_QUESTIONS = ["the and", "License", "The WITH by", "zzzz", "rights reserved."]


@query(" UNION ALL ".join(f"SELECT '{q}' AS question, * FROM ({_search_sql(search.words_of(q))})" for q in _QUESTIONS))
def search_by_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several searches through an index of all texts: common, rare and absent words."""
    docs = documents(spark, sf_dir)
    index = grams.indexed(docs)
    found = [index.search_lines(docs, q).select(F.lit(q).alias("question"), "doc_id", "hit_no", "line") for q in _QUESTIONS]
    return reduce(DataFrame.unionByName, found)


@query(
    f"""
    WITH asked AS (SELECT conv_id, turn, string_split(text, ' ')[-1] AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL),
    words AS (SELECT DISTINCT question, list_filter(string_split(replace(lower(question), chr(10), ' '), ' '), lambda w: length(w) > 2) AS ws FROM asked),
    met AS (SELECT question, row_number() OVER (PARTITION BY question ORDER BY doc_id, line_no) AS n, doc_id, line FROM words, ({_LINES}) l WHERE len(list_filter(ws, lambda w: NOT contains(lower(line), w))) = 0)
    SELECT conv_id, turn, CAST(n AS INT) AS hit_no, doc_id, line FROM asked JOIN met USING (question) WHERE n <= 8
    """
)
def ask_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of every user turn, asked of all documents: the first eight hits of each."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    asked = turns.select("conv_id", "turn", F.substring_index("text", " ", -1).alias("question"))
    return everywhere.ask_everywhere(asked, documents(spark, sf_dir)).select("conv_id", "turn", "hit_no", "doc_id", "line")


_RANKED = ["license rights reserved", "the river and the stone", "zzzz"]


def _bm25_sql(question: str) -> str:
    words = ", ".join(f"'{w}'" for w in sorted(set(question.split(" "))))
    return f"""
    SELECT '{question}' AS question, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, round(score, 6) AS score FROM (
      SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
      FROM tf JOIN df USING (term) JOIN sizes USING (doc_id), corpus WHERE term IN ({words}) GROUP BY doc_id) QUALIFY rank <= 10
    """


@query(
    r"""
    WITH words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
    sizes AS (SELECT doc_id, len(ws) AS size FROM words), corpus AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM words) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    """
    + " UNION ALL ".join(f"SELECT * FROM ({_bm25_sql(q)})" for q in _RANKED)
)
def rank_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most relevant documents of several questions, by an index of all texts."""
    index = ranking.indexed(documents(spark, sf_dir))
    found = [index.search(q, 10).select(F.lit(q).alias("question"), "rank", "doc_id", F.round("score", 6).alias("score")) for q in _RANKED]
    return reduce(DataFrame.unionByName, found)


_UNITS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"


@query(
    f"""
    SELECT asked, CAST(rank AS INT) AS rank, vec_id, score, 'c' || vec_id AS chunk_id FROM (
      SELECT asked, vec_id, score, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS rank
      FROM (SELECT q.vec_id AS asked, d.vec_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM {_UNITS} q JOIN {_UNITS} d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 5
    """
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every twentieth, among all, with the chunks that point to them."""
    rows = table(spark, sf_dir, "embeddings")
    engine = Engine(spark, new_folder(spark))
    engine.map_embeddings(rows.select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("vec_id").alias("vector_index")))
    found = vectors.VectorIndex.build(rows).search(rows.where("vec_id % 20 = 0"), 5)
    return vectors.chunks_of(found, engine.embeddings_map.read()).select("asked", "rank", "vec_id", "score", "chunk_id")


@query()
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten nearest vectors of every twentieth the index finds when it probes a part of its lists."""
    rows = table(spark, sf_dir, "embeddings")
    index = vectors.VectorIndex.build(rows)
    asked = rows.where("vec_id % 20 = 0")
    near, exact = index.search(asked, 10, vectors.PROBES), index.search(asked, 10)
    return exact.join(near.select("asked", "vec_id", F.lit(1).alias("found")), ["asked", "vec_id"], "left").groupBy("asked").agg(F.count(F.lit(1)).alias("n_exact"), F.count("found").alias("n_found"))


_ASKED_SQL = """
    SELECT q.conv_id, q.turn, trim(coalesce(q.text, '')) AS question, coalesce(d.text, '') AS text
    FROM (SELECT conv_id, turn, {question} AS text FROM conversations WHERE role = 'user') q
    LEFT JOIN documents d ON d.doc_id = q.conv_id
"""


def _ask_sql(question: str) -> str:
    return f"""
    WITH asked AS ({_ASKED_SQL.format(question=question)}),
    words AS (SELECT conv_id, turn, list_filter(string_split(replace(lower(question), chr(10), ' '), ' '), lambda w: length(w) > 2) AS ws FROM asked),
    lines AS (SELECT conv_id, turn, i AS line_no, trim(parts[i]) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM asked), range(1, len(parts) + 1) AS r(i) WHERE trim(parts[i]) <> ''),
    met AS (SELECT l.*, row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS n FROM lines l JOIN words USING (conv_id, turn) WHERE len(list_filter(ws, lambda w: NOT contains(lower(line), w))) = 0),
    best AS (SELECT conv_id, turn, string_agg('• ' || line, chr(10) ORDER BY n) AS body FROM met WHERE n <= 8 GROUP BY ALL)
    SELECT conv_id, turn, question <> '' AND text <> '' AS ok,
      CASE WHEN question = '' THEN {_quoted(search.NO_QUESTION)} WHEN text = '' THEN {_quoted(search.NO_TEXT)} WHEN body IS NULL THEN {_quoted(search.NO_HIT)} ELSE {_quoted(search.HEADING)} || body END AS answer
    FROM asked LEFT JOIN best USING (conv_id, turn)
    """


def asked_turns(spark: SparkSession, sf_dir: str, question: Column) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = turns.select("conv_id", "turn", F.col("conv_id").alias("doc_id"), question.alias("question"))
    return search.ask(asked, documents(spark, sf_dir)).select("conv_id", "turn", "ok", "answer")


@query(_ask_sql("text"))
def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn, asked of the document with the number of the conversation."""
    return asked_turns(spark, sf_dir, F.col("text"))


@query(_ask_sql("string_split(text, ' ')[-1]"))
def ask_batch_last_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of one word, the last of every user turn, which have hits."""
    return asked_turns(spark, sf_dir, F.substring_index("text", " ", -1))


@query(
    f"""
    SELECT doc_id, k, q <> '' AND t <> '' AS ok, CASE WHEN q = '' THEN {_quoted(search.NO_QUESTION)} WHEN t = '' THEN {_quoted(search.NO_TEXT)} ELSE {_quoted(search.NO_HIT)} END AS answer
    FROM (SELECT doc_id, k, CASE k WHEN 2 THEN 'zzzz' ELSE '' END AS q, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS t FROM documents, range(3) AS r(k))
    """
)
def ask_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null, a blank and a vain question to every document, a third of them without text."""
    docs = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"))
    asked = docs.select("doc_id", F.posexplode(F.array(F.lit(None).cast("string"), F.lit(" \t "), F.lit("zzzz"))).alias("k", "question"))
    return search.ask(asked, docs).select("doc_id", F.col("k").cast("long").alias("k"), "ok", "answer")


@query(
    """
    SELECT conv_id, turn, coalesce(array_to_string(list_filter(string_split(replace(lower(text), chr(10), ' '), ' '), lambda w: length(w) > 2), ' '), '') AS words FROM conversations
    """
)
def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.query_words(F.col("text")), " ").alias("words"))


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS line_no, line FROM ({_LINES})")
def line_split_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.posexplode(text.lines(F.col("text"))).alias("k", "line")
    return documents(spark, sf_dir).select("doc_id", at).select("doc_id", (F.col("k") + 1).alias("line_no"), "line")


# --- previews and sizes -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, left(coalesce(text, ''), 2000) AS preview FROM documents")
def preview_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.char_preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(length(text) AS BIGINT) AS n_points FROM documents")
def doc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"), F.length("text").cast("long").alias("n_points"))


@query(
    """
    SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f bytes', CAST(n_chars AS DOUBLE)) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0::DOUBLE) ELSE printf('%.1f MB', n_chars / 1048576.0::DOUBLE) END AS size FROM documents
    """
)
def human_size_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", files.human_size(F.col("n_chars")).alias("size"))


@query(
    f"""
    SELECT doc_id, filename, ext, ext IN ('pdf','docx','png','jpg','jpeg','webp','bmp','tiff','txt','csv','md') AS allowed
    FROM (SELECT doc_id, filename, lower(string_split(filename, '.')[-1]) AS ext FROM ({_FILENAMES}))
    """
)
def ext_and_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("filename")
    return filenames(documents(spark, sf_dir)).select("doc_id", "filename", files.extension(name).alias("ext"), files.is_allowed(name).alias("allowed"))


@query(
    f"""
    SELECT doc_id, filename, CASE WHEN NOT ext IN ('pdf','docx','png','jpg','jpeg','webp','bmp','tiff','txt','csv','md') THEN 'unsupported file type: ' || ext END AS error
    FROM (SELECT doc_id, regexp_replace(filename, '\\.$', '') AS filename, CASE WHEN regexp_replace(filename, '\\.$', '') LIKE '%.%' THEN lower(string_split(regexp_replace(filename, '\\.$', ''), '.')[-1]) ELSE '' END AS ext FROM ({_FILENAMES}))
    """
)
def upload_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which uploads are taken, and why the others are not."""
    named = filenames(documents(spark, sf_dir)).withColumn("filename", files.secure_filename(F.col("filename")))
    ext = files.extension(F.col("filename"))
    return named.select("doc_id", "filename", F.when(~ext.isin(*files.ALLOWED), F.concat(F.lit("unsupported file type: "), ext)).alias("error"))


# --- chunks -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, strlen(text) >= 32768 AS compressed FROM documents")
def compressed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", chunks.is_compressed(F.col("text")).alias("compressed"))


@query(
    """
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 4096 AS BIGINT) AS start_offset, CAST(least((i + 1) * 4096, strlen(text)) AS BIGINT) AS end_offset, 'doc:' || doc_id || ':chunk:' || i AS storage_key
    FROM documents, range(0, CAST(ceil(strlen(text) / 4096.0) AS BIGINT)) AS r(i)
    """
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = chunks.split_chunks(documents(spark, sf_dir), SMALL_CHUNK)
    return plan.select("doc_id", "chunk_index", "start_offset", "end_offset", chunks.storage_key(F.col("doc_id"), F.col("chunk_index")).alias("storage_key"))


@query(
    r"""
    WITH parts AS (SELECT doc_id, i, strlen(text) AS size, hex(encode(text)) AS h FROM documents, range(0, CAST(ceil(strlen(text) / 4096.0) AS BIGINT)) AS r(i)),
    heads AS (SELECT doc_id, i, size, substr(h, CAST(8192 * i + 1 AS BIGINT), least(512, 2 * (size - 4096 * i))) AS head FROM parts),
    cut AS (SELECT *, regexp_replace(head, '^(?:[89AB][0-9A-F])+', '') AS rest FROM heads),
    kept AS (SELECT *, regexp_replace(rest, '(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$', '') AS body FROM cut),
    shown AS (SELECT *, decode(unhex(body)) AS preview FROM kept),
    marked AS (SELECT *, CASE WHEN rest <> head THEN '?' ELSE '' END || preview || CASE WHEN body <> rest THEN '?' ELSE '' END AS all_of FROM shown)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, 'doc:' || doc_id || CASE WHEN size > 4096 THEN ':chunk:' || i ELSE '' END AS storage_key, CAST(least(4096, size - 4096 * i) AS BIGINT) AS stored_bytes,
      preview, CAST(len(list_filter(string_split(replace(all_of, chr(10), ' '), ' '), lambda w: w <> '')) AS INTEGER) AS token_count
    FROM marked
    """
)
def chunk_preview_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte previews and their tokens; what is left of a character that the cut divides is not shown here, but counts as text."""
    rows = chunks.chunk_rows(documents(spark, sf_dir), SMALL_CHUNK, SMALL_CHUNK, SMALL_PREVIEW)
    return rows.select("doc_id", "chunk_index", "storage_key", "stored_bytes", F.regexp_replace("text_preview", "^�+|�+$", "").alias("preview"), "token_count")


@query("SELECT doc_id, text FROM documents")
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    expected = docs.select("doc_id", chunks.chunk_count(F.octet_length("text"), SMALL_CHUNK).alias("chunks"))
    return chunks.join_chunks(chunks.split_chunks(docs, SMALL_CHUNK), expected)


@query("SELECT doc_id, CASE WHEN strlen(text) <= 4096 THEN text ELSE '' END AS text FROM documents")
def chunk_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every second chunk (those of odd numbers) lost, a text of several chunks is empty as a whole."""
    docs = documents(spark, sf_dir)
    expected = docs.select("doc_id", chunks.chunk_count(F.octet_length("text"), SMALL_CHUNK).alias("chunks"))
    return chunks.join_chunks(chunks.split_chunks(docs, SMALL_CHUNK).where(F.col("chunk_index") % 2 == 0), expected)


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4194304.0) AS INTEGER) AS chunks, CAST(strlen(text) AS BIGINT) AS orig_bytes, strlen(text) >= 32768 AS compressed FROM documents")
def chunk_meta_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written as JSON and read again."""
    written = documents(spark, sf_dir).select("doc_id", F.to_json(chunks.chunk_meta(F.col("text"))).alias("meta"))
    read = written.select("doc_id", F.from_json("meta", "chunks int, orig_bytes long, stored_bytes long, compressed boolean").alias("m"))
    return read.select("doc_id", "m.chunks", "m.orig_bytes", "m.compressed")


@query("SELECT doc_id, text, strlen(text) >= 4096 AS marked FROM documents")
def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as stored bytes, the larger ones compressed, and back."""
    stored = documents(spark, sf_dir).select("doc_id", payload.payload(F.col("text"), SMALL_CHUNK).alias("stored"))
    marked = F.substring("stored", 1, 5) == F.lit(payload.MARKER)
    return stored.select("doc_id", payload.text_of(F.col("stored")).alias("text"), marked.alias("marked"))


# --- catalog ----------------------------------------------------------------------------------------------------------


def _as_uploads(docs: DataFrame) -> DataFrame:
    """Documents as uploads of a hundred ids, in the order of doc_id; sizes are sometimes unknown."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return docs.select(
        (F.col("doc_id") % 100).cast("string").alias("doc_id"), F.col("lang").alias("user_id"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("filename"), F.lit("store").alias("storage"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("size_bytes"), F.lit("uploaded").alias("status"), (F.col("doc_id") % 11).cast("int").alias("total_pages"), at.alias("created_at"), at.alias("updated_at"), F.col("doc_id").alias("seq"),
    )


@query(
    """
    SELECT CAST(doc_id % 100 AS VARCHAR) AS doc_id, first(lang ORDER BY doc_id) AS user_id, last(source || '-' || doc_id ORDER BY doc_id) AS filename, 'uploaded' AS status,
      arg_max_null(CASE WHEN doc_id % 7 <> 0 THEN n_chars END, doc_id) AS size_bytes, CAST(last(doc_id % 11 ORDER BY doc_id) AS INTEGER) AS total_pages,
      min(1700000000 + doc_id) AS created_s, max(1700000000 + doc_id) AS updated_s
    FROM documents GROUP BY doc_id % 100
    """
)
def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred uploads exist already, the others come in, folded into the buckets of their ids."""
    rows = _as_uploads(documents(spark, sf_dir))
    engine = Engine(spark, new_folder(spark))
    engine.upsert(rows.where("seq < 100"))
    engine.upsert(rows.where("seq >= 100"))
    return engine.catalog().select("doc_id", "user_id", "filename", "status", "size_bytes", "total_pages", F.unix_seconds("created_at").alias("created_s"), F.unix_seconds("updated_at").alias("updated_s"))


@query("SELECT doc_id, CASE WHEN doc_id = 7 THEN 'indexed' ELSE 'uploaded' END AS status FROM documents")
def doc_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.update_status(documents(spark, sf_dir).select("doc_id", F.lit("uploaded").alias("status")), 7, "indexed")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def doc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lookup(documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), 7)


@query(
    """
    SELECT k AS chunk_id, first(doc_id ORDER BY doc_id) AS doc_id FROM (SELECT doc_id // 2 AS k, doc_id FROM documents) WHERE k NOT IN (SELECT doc_id FROM labels) GROUP BY k
    """
)
def chunk_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two incoming rows per key; keys that are labelled exist already."""
    incoming = documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).alias("chunk_id"), "doc_id", F.col("doc_id").alias("seq"))
    existing = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return catalog.insert_absent(existing, incoming).select("chunk_id", "doc_id")


@query(
    """
    SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(vec_id AS INTEGER) AS vector_index, 'first' AS model_name FROM embeddings
    UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(vec_id AS INTEGER), 'second' FROM embeddings WHERE label = 1
    """
)
def embedding_map_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").cast("int").alias("vector_index"), "label")
    return catalog.append(rows.drop("label").withColumn("model_name", F.lit("first")), rows.where("label = 1").drop("label").withColumn("model_name", F.lit("second")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def doc_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.clear(documents(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels"))


@query(f"SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 86400 SECOND")
def ttl_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.where(retention.alive(F.col("ts"), F.lit(AS_OF).cast(events.schema["ts"].dataType))).select("event_id", "user_id", "event_type")


@query("SELECT user_id, max(ts) IS NOT NULL AS found, arg_max(event_type, event_id) AS event_type FROM (SELECT *, event_id FROM events) GROUP BY user_id")
def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row stored for each key."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("stored_at"))
    return retention.latest(rows, "user_id").select("user_id", F.lit(True).alias("found"), "event_type")


@query("SELECT d.doc_id, CASE WHEN coalesce(s.text, '') <> '' THEN s.text ELSE coalesce(d.lang, '') END AS text FROM documents d LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0) s USING (doc_id)")
def session_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stored text where there is some, else the session's own."""
    engine = Engine(spark, new_folder(spark))
    docs = documents(spark, sf_dir)
    engine.store.put(docs.where(F.col("doc_id") % 2 == 0))
    return engine.index(docs.select("doc_id", F.col("lang").alias("extracted_text"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


_LOCATED = """
    SELECT *, coalesce(CAST(strlen(array_to_string(parts[1:line_no - 1], chr(10))) AS BIGINT) + CASE WHEN line_no > 1 THEN 1 ELSE 0 END, 0) AS line_start
    FROM (SELECT doc_id, i AS line_no, parts, parts[i] AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), range(1, len(parts) + 1) AS r(i) WHERE trim(parts[i]) <> '')
"""


@query(
    f"""
    WITH hits AS (
      SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS hit_no, line_start, line_start + strlen(raw) AS line_end FROM ({_LOCATED}) WHERE contains(lower(raw), 'the') AND contains(lower(raw), 'and')) WHERE hit_no <= 8),
    pieces AS (SELECT doc_id, k AS chunk_index, k * 512 AS a, least((k + 1) * 512, strlen(text)) AS b FROM documents, range(0, CAST(ceil(strlen(text) / 512) AS BIGINT)) AS r(k))
    SELECT doc_id, CAST(hit_no AS INT) AS hit_no, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, CAST(chunk_index AS INT) AS chunk_index FROM hits JOIN pieces USING (doc_id) WHERE line_start < b AND a < line_end
    """
)
def hits_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of 512 bytes in which each hit's line lies."""
    docs = documents(spark, sf_dir)
    hits = intervals.located_hits(docs, "the and")
    pieces = chunks.chunk_spans(docs, 512)
    return intervals.chunks_of_hits(hits, pieces, 512).select("doc_id", "hit_no", "line_start", "line_end", "chunk_index")


@query(
    r"""
    WITH w AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
    own AS (SELECT doc_id, ws, len(ws) AS n, k AS chunk_index, k * 48 AS own FROM w, range(0, CAST(ceil(len(ws) / 48) AS BIGINT)) AS r(k)),
    looked AS (
      SELECT *, list_position(list_reverse(list_transform(ws[greatest(own - 15, 1) : own], lambda x: regexp_matches(x, '[.!?…]["''”’»)\]]*$'))), TRUE) AS behind, least(n, own + 64) AS least FROM own),
    ahead AS (SELECT *, CASE WHEN least < n THEN list_position(list_transform(ws[least : least + 16], lambda x: regexp_matches(x, '[.!?…]["''”’»)\]]*$')), TRUE) END AS more FROM looked),
    cut AS (
      SELECT doc_id, chunk_index, ws, CASE WHEN own > 0 AND behind > 0 THEN own - behind + 1 WHEN own <= 16 THEN 0 ELSE own END AS a, CASE WHEN more > 0 THEN least + more - 1 ELSE least END AS b FROM ahead)
    SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, a AS start_offset, b AS end_offset, CAST(b - a AS INT) AS token_count, array_to_string(ws[a + 1 : b], ' ') AS text FROM cut
    """
)
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 64 words that share 16, by sentences where these are near."""
    return intervals.sentence_chunks(documents(spark, sf_dir), 64, 16)


@query(
    """
    WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events),
    numbered AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS end_us, count(*) AS n FROM numbered GROUP BY user_id, k
    """
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = expiry.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "2 hours")
    return found.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


#: Seconds that a text of the stream lives, and the parts in which its events come.
_STREAM_TTL, _PARTS = 21_600, 3


@query(
    f"""
    WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events),
    mark AS (SELECT epoch_us(max(ts)) - 600000000 AS m FROM events)
    SELECT user_id AS doc_id, t AS at_us, CASE WHEN t - before <= {_STREAM_TTL}000000 THEN 'renewed' ELSE 'put' END AS what FROM e
    UNION ALL SELECT user_id, t + {_STREAM_TTL}000000, 'expired' FROM e, mark WHERE after - t > {_STREAM_TTL}000000 OR after IS NULL AND (t + {_STREAM_TTL}000000) // 1000 + 1 <= m // 1000
    """
)
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of puts in three parts, of which the others come after the query has been stopped: puts, renewals and expiries."""
    folder = new_folder(spark, "stream")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("stored_at"))
    low, high = events.agg(F.min("stored_at"), F.max("stored_at")).first()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", expiry.STATE_STORE)

    def run() -> DataFrame:
        puts = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        return expiry.run_to_end(expiry.lifetimes(puts, _STREAM_TTL), f"{folder}/out", f"{folder}/mark")

    part = F.least(F.lit(_PARTS - 1), F.floor((F.unix_micros("stored_at") - F.unix_micros(F.lit(low))) * _PARTS / F.greatest(F.lit(1), F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)))))
    for k in range(_PARTS):
        # as many files as tasks write; what a run finds is one batch, so that no file of a part is late
        events.where(part == k).write.mode("append").parquet(f"{folder}/in")
        if k != _PARTS - 2:
            found = run()
    return found.select("doc_id", F.unix_micros("at").alias("at_us"), "what")


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events")
def chunk_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows made at the times of events, in whole seconds."""
    events = table(spark, sf_dir, "events")
    rows = catalog.chunk_table_rows(events.withColumn("chunk_id", F.col("event_id").cast("string")), F.col("ts"))
    return rows.select(F.col("chunk_id").cast("long").alias("event_id"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("SELECT doc_id || '.txt' AS filename, CASE WHEN strlen(text) > 4096 THEN 'file too large' END AS error FROM documents WHERE text IS NOT NULL")
def upload_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are over a limit of 4 KiB."""
    rows = documents(spark, sf_dir).where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    accepted, rejected = uploads.within_limit(rows, 4096)
    return accepted.select("filename", F.lit(None).cast("string").alias("error")).unionByName(rejected)


@query("SELECT doc_id, replace(url_encode(text), '%20', '+') AS quoted FROM documents")
def url_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.quote_plus(F.col("text")).alias("quoted"))


@query("SELECT count(*) AS n, count(*) AS n_ids, count(*) AS n_formed FROM documents")
def upload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that uploads get: as many as there are, and all of the one form."""
    rows = documents(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")
    ids = materialize(uploads.as_documents(rows).select("doc_id"), "upload-ids")
    formed = F.col("doc_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"), F.count_if(formed).alias("n_formed"))


@query("SELECT TRUE AS ok, TRUE AS store, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS texts")
def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a store of all documents can be read, and how many texts it holds."""
    engine = Engine(spark, new_folder(spark))
    engine.store.put(documents(spark, sf_dir))
    return engine.health().crossJoin(engine.store.versions().agg(F.count(F.lit(1)).alias("texts")))  # a row each


_LISTED = ["documents", "embeddings", "events", "pages"]


@query(" UNION ALL ".join(f"SELECT 'listed_{t}' AS name, TRUE AS is_temporary, count(*) AS n FROM {t}" for t in _LISTED))
def table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of the session that were made of tables, and their rows."""
    for t in _LISTED:
        table(spark, sf_dir, t).createOrReplaceTempView(f"listed_{t}")
    sizes = reduce(DataFrame.unionByName, [spark.table(f"listed_{t}").agg(F.lit(f"listed_{t}").alias("name"), F.count(F.lit(1)).alias("n")) for t in _LISTED])
    return tables(spark).join(sizes, "name")


# --- sources, store and flow ------------------------------------------------------------------------------------------


@query("SELECT doc_id || '.md' AS filename, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[^\\x{00}-\\x{FF}]', '', 'g') ELSE text END AS text FROM documents WHERE text IS NOT NULL")
def read_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files, every third in Latin-1 instead of UTF-8."""
    docs = documents(spark, sf_dir).where("text is not null")
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", ""), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 3 == 0, latin).otherwise(F.encode("text", "UTF-8"))
    return uploads.accept(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), content.alias("content")))[0].select("filename", "text")


@query("SELECT doc_id || '.docx' AS filename, text FROM documents WHERE text IS NOT NULL")
def read_docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as DOCX, a paragraph a line, and read again."""
    rows = documents(spark, sf_dir).where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("filename"), docx_of(F.col("text")).alias("content"))
    return uploads.accept(rows)[0].select("filename", "text")


#: The lines of a text that hold anything but white space, stripped.
_PDF_LINES = """(SELECT doc_id, string_agg(trim(line), chr(10) ORDER BY k) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE trim(line) <> '' GROUP BY doc_id)"""


def _as_pdf(docs: DataFrame) -> DataFrame:
    with text_batches(docs.sparkSession):
        return materialize(pdf_files(docs.where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "text")), "pdfs")


@query(
    f"""
    SELECT d.doc_id || '.pdf' AS filename, coalesce(l.text, '') AS lines, CAST(ceil(len(string_split(d.text, chr(10))) / 50) AS INT) AS total_pages, CAST(NULL AS VARCHAR) AS extract_error
    FROM documents d LEFT JOIN {_PDF_LINES} l USING (doc_id) WHERE d.text IS NOT NULL
    """
)
def read_pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as PDFs (packed objects, reference streams, compressed pages, a font with its own codes), and read again as uploads."""
    read = uploads.accept(_as_pdf(documents(spark, sf_dir)))[0]
    return read.select("filename", F.array_join(text.lines(F.col("text")), "\n").alias("lines"), "total_pages", "extract_error")


@query(
    """
    SELECT filename, CAST(k // 50 AS INT) + 1 AS page_no, coalesce(string_agg(trim(line), chr(10) ORDER BY k) FILTER (trim(line) <> ''), '') AS lines
    FROM (SELECT doc_id || '.pdf' AS filename, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL)
    GROUP BY filename, k // 50
    """
)
def read_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, a row a page."""
    return pdf_page_rows(_as_pdf(documents(spark, sf_dir))).select("filename", "page_no", F.array_join(text.lines(F.col("page_text")), "\n").alias("lines"))


_BODIES = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE source || '.txt' END AS filename, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM documents"


def _bodies(docs: DataFrame) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.concat("source", F.lit(".txt")))
    return docs.select("doc_id", F.lit("u").alias("user_id"), name.alias("filename"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("text"))


@query(f"SELECT doc_id, coalesce(nullif(filename, ''), 'payload.txt') AS filename, text FROM ({_BODIES}) WHERE text <> ''")
def upload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as JSON bodies, some without a name or a text."""
    bodies = _bodies(documents(spark, sf_dir)).select("doc_id", F.to_json(F.struct("user_id", "filename", "text")).alias("body"))
    return uploads.parse_json(bodies)[0].select("doc_id", "filename", "text")


@query(f"SELECT doc_id, coalesce(nullif(filename, ''), 'form.txt') AS filename, text FROM ({_BODIES}) WHERE text <> ''")
def upload_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.read_forms(_bodies(documents(spark, sf_dir)))[0].select("doc_id", "filename", "text")


_NAMES = ["a.txt", "b.md", "c.csv", "d.exe", "e", ""]


@query(
    """
    SELECT doc_id || name AS filename, CASE WHEN name IN ('a.txt', 'b.md', 'c.csv') THEN text END AS text, CASE name WHEN 'd.exe' THEN 'unsupported file type: exe' WHEN 'e' THEN 'unsupported file type: ' WHEN '' THEN 'unsupported file type: ' END AS error
    FROM (SELECT *, ['a.txt', 'b.md', 'c.csv', 'd.exe', 'e', ''][doc_id % 6 + 1] AS name FROM documents)
    """
)
def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of accepted and of other types: texts, and why there is none."""
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 6).cast("int"))
    rows = documents(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), name).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    accepted, rejected = uploads.accept(rows)
    return accepted.select("filename", "text", F.lit(None).cast("string").alias("error")).unionByName(rejected.select("filename", F.lit(None).cast("string").alias("text"), "error"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 2 = 0 THEN lang ELSE CASE WHEN doc_id * 100 <= 86400 THEN text ELSE '' END END AS text FROM documents")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put at different times, every second put anew, every seventh cleared; read at a time at which the oldest have expired."""
    docs = documents(spark, sf_dir)
    now = F.lit(AS_OF).cast("timestamp")
    store = TextStore(spark, new_folder(spark))
    store.put(docs.select("doc_id", "text", (now - F.make_dt_interval(secs=(F.col("doc_id") * 100).cast("decimal(18,6)"))).alias("stored_at")))
    store.put(docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("text"), (now - F.expr("interval 1 second")).alias("stored_at")))
    store.clear(docs.where("doc_id % 7 = 0"), at=AS_OF)
    return store.get(docs.select(F.col("doc_id").cast("string").alias("doc_id")), AS_OF).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


_TTL = 7200


@query(
    f"""
    WITH stored AS (SELECT user_id, ts, CASE WHEN event_type <> 'purchase' THEN event_id || ' ' || event_type ELSE '' END AS text FROM events WHERE event_type IN ('signup', 'view', 'purchase')),
    asked AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
    SELECT event_id, CASE WHEN s.ts >= a.ts - INTERVAL {_TTL} SECOND THEN s.text ELSE '' END AS text FROM asked a ASOF LEFT JOIN stored s ON a.user_id = s.user_id AND a.ts >= s.ts
    """
)
def as_of_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored and cleared at the times of events, and read at the times of others; two hours is how long they live."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("stored_at"), "event_type")
    store = TextStore(spark, new_folder(spark), _TTL)
    body = F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))
    store.put(events.where("event_type in ('signup', 'view')").withColumn("text", body))
    store.put(events.where("event_type = 'purchase'").withColumn("text", F.lit("")))
    asked = events.where("event_type = 'click'").select("event_id", "doc_id", F.col("stored_at").alias("asked_at"))
    return store.texts_as_of(asked).select("event_id", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT doc_id || '.txt' AS filename, 'store' AS storage, CAST(strlen(text) AS BIGINT) AS size_bytes, 'uploaded' AS status, CAST(strlen(text) AS BIGINT) AS stored_bytes FROM documents WHERE text <> ''")
def ingest_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads through the whole flow: texts, then metadata, then chunk rows."""
    engine = Engine(spark, new_folder(spark))
    docs = documents(spark, sf_dir).where("text != ''").select(F.lit("u").alias("user_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")
    engine.ingest(uploads.read_forms(docs)[0])
    return engine.catalog().join(engine.chunks.read().select("doc_id", "stored_bytes"), "doc_id").select("filename", "storage", "size_bytes", "status", "stored_bytes")


@query(
    """
    SELECT r.n, left(coalesce(d.text, ''), 2000) AS preview
    FROM (SELECT doc_id AS n, CASE doc_id % 3 WHEN 0 THEN doc_id WHEN 1 THEN doc_id + 1 ELSE doc_id + 2 END AS wanted FROM documents) r LEFT JOIN documents d ON d.doc_id = r.wanted
    """
)
def chat_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews for requests whose id is in the path, in the query or in the session."""
    docs = documents(spark, sf_dir)
    engine = Engine(spark, new_folder(spark))
    engine.store.put(docs)
    of = lambda k: (F.col("doc_id") + k).cast("string")
    kind = F.col("doc_id") % 3
    requests = docs.select(F.col("doc_id").alias("n"), F.when(kind == 0, of(0)).otherwise("").alias("path_id"), F.when(kind == 1, of(1)).alias("query_id"), of(2).alias("session_id"))
    return engine.chat(requests).select("n", "preview")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'indexed' ELSE 'uploaded' END AS status FROM documents")
def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses set one after the other, of which the last counts, without writing the documents again."""
    docs = documents(spark, sf_dir).select("doc_id", F.lit("uploaded").alias("status"), F.timestamp_seconds(F.lit(0)).alias("updated_at"))
    changed = docs.where("doc_id % 10 = 3").select("doc_id", F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.timestamp_seconds(F.lit(t)).alias("updated_at")) for s, t in (("indexed", 2), ("failed", 1))))).alias("x"))
    return catalog.with_statuses(docs, changed.select("doc_id", "x.*")).select("doc_id", "status")


@query("SELECT doc_id, CASE WHEN n_chars < 1048576 THEN CAST(round_even(n_chars / 1024.0::DOUBLE, 1) AS VARCHAR) || ' KB' ELSE CAST(round_even(n_chars / 1048576.0::DOUBLE, 2) AS VARCHAR) || ' MB' END AS size FROM documents")
def display_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", files.display_size(F.col("n_chars")).alias("size"))
