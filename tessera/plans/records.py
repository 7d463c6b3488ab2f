"""Queries of ingestion, record keeping and text functions over the test tables, each with its SQL beside it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as tx
from tessera.operators import citations, conversations, graph, mutation
from tessera.plans import ask
from tessera.plans.oracle import _LINKS, _MESSAGES, NORMAL, SPACES
from tessera.plans.tools import tagged_text
from tessera.session import table
from tessera.sources import extract, stores
from tessera.streaming import turns

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
_RELATIONS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _query(sql: str | None = None):
    def keep(f: Callable) -> Callable:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def statements() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversation_messages")
    return m.groupBy("message_id").agg(F.min(F.struct("conversation_id", "parent_id", "role", "content", "created_at")).alias("m")).select("message_id", "m.*")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_files").select("file_id", "filename", "sha256", "batch_no", "created_at", "captioned_at")


def _links(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.registry import fact_links

    return fact_links(spark, d)


# ---- files


def _zipped(parts: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return data.getvalue()


def _docx(text: str) -> bytes:
    return _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:body></w:document>'})


def _pptx(text: str) -> bytes:
    relation = lambda target: f'<Relationships><Relationship Id="r1" Target="{target}"/></Relationships>'
    return _zipped({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {_RELATIONS}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": relation("slides/slide1.xml"),
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sld>',
    })


def _xlsx(text: str) -> bytes:
    return _zipped({
        "xl/workbook.xml": f'<workbook {_RELATIONS}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>{escape(text)}</t></is></c><c r="B1"><v>{len(text)}</v></c></row></sheetData></worksheet>',
    })


def _written_and_read(spark: SparkSession, d: str, kind: str, make: Callable[[str], bytes]) -> DataFrame:
    """Every document's text, its white space collapsed, written as a file of a kind and read again."""
    one_line = F.trim(F.regexp_replace("text", tx.SPACES, " "))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.coalesce(one_line, F.lit("")).alias("text"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"filename": b.filename, "format": kind, "data": [make(t) for t in b.text]})

    found = extract.extract(docs.mapInPandas(pack, "filename string, format string, data binary"))
    return found.select(F.col("filename").cast("long").alias("doc_id"), "page_number", "source_type", "content", "error")


_ONE_LINE = f"trim(regexp_replace(text, '{SPACES}', ' ', 'g'), ' ')"


@_query(f"SELECT doc_id, CAST(NULL AS INTEGER) AS page_number, 'text' AS source_type, {_ONE_LINE} AS content, CAST(NULL AS VARCHAR) AS error FROM documents WHERE {_ONE_LINE} <> ''")
def read_text_files(spark: SparkSession, d: str) -> DataFrame:
    return _written_and_read(spark, d, "txt", lambda t: t.encode())


@_query(f"SELECT doc_id, 0 AS page_number, 'text' AS source_type, {_ONE_LINE} AS content, CAST(NULL AS VARCHAR) AS error FROM documents WHERE {_ONE_LINE} <> ''")
def read_word_files(spark: SparkSession, d: str) -> DataFrame:
    return _written_and_read(spark, d, "docx", _docx)


@_query(f"SELECT doc_id, 1 AS page_number, 'text' AS source_type, {_ONE_LINE} AS content, CAST(NULL AS VARCHAR) AS error FROM documents WHERE {_ONE_LINE} <> ''")
def read_slide_files(spark: SparkSession, d: str) -> DataFrame:
    return _written_and_read(spark, d, "pptx", _pptx)


@_query(
    f"""WITH t AS (SELECT doc_id, coalesce({_ONE_LINE}, '') AS t FROM documents)
    SELECT doc_id, 1 AS page_number, 'text' AS source_type, 'Sheet: S' || chr(10) || '| ' || replace(t, '|', '\\|') || ' | ' || length(t) || ' |' || chr(10) || '| --- | --- |' AS content, CAST(NULL AS VARCHAR) AS error FROM t"""
)
def read_sheet_files(spark: SparkSession, d: str) -> DataFrame:
    return _written_and_read(spark, d, "xlsx", _xlsx)


@_query("""SELECT file_id, CASE WHEN k IN ('pdf', 'docx', 'pptx', 'xlsx', 'txt', 'md') THEN k WHEN k = '' THEN 'txt' END AS format
    FROM (SELECT file_id, lower(regexp_extract(list_last(string_split(filename, '/')), '\\.([^.]*)$', 1)) AS k FROM document_files)""")
def dispatch_formats(spark: SparkSession, d: str) -> DataFrame:
    """Formats by file type, by MIME type where there is none."""
    return _files(spark, d).select("file_id", extract.dispatch("filename", F.lit("text/plain")).alias("format"))


@_query("SELECT doc_id, sha256(text) AS sha256, length(text) AS chars FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 over the bytes of each text."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.length("text").alias("chars"))


# ---- passages as models and readers see them


@_query("""SELECT chunk_id, CASE WHEN source_type = 'image_caption' AND length(filename) > 0 THEN '[image_path=' || filename || '] ' ELSE '' END || content AS tagged FROM chunks""")
def tagged_captions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", tagged_text("source_type", "filename", "content").alias("tagged"))


@_query("""SELECT chunk_id, CASE WHEN source_type = 'image_caption' THEN 'description of a figure' || coalesce(', page ' || page_number, '') WHEN source_type = 'chart_data' THEN 'data behind a chart' || coalesce(', page ' || page_number, '')
    WHEN page_number IS NOT NULL THEN 'page ' || page_number ELSE 'text' END AS label, left(content, 6000) AS excerpt FROM chunks""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", tx.excerpt_label("source_type", "page_number").alias("label"), tx.excerpt("content").alias("excerpt"))


@_query("""WITH t AS (SELECT message_id, trim(content, ' ') AS c FROM (SELECT message_id, min(content) AS content FROM conversation_messages GROUP BY message_id))
    SELECT message_id, CASE WHEN length(c) > 500 THEN left(c, 500) || '...' ELSE c END AS history, CASE WHEN length(c) > 200 THEN left(c, 200) || '...' ELSE c END AS preview, left(c, 60) AS title FROM t""")
def shortened_messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversation_messages").groupBy("message_id").agg(F.min("content").alias("content"))
    return m.select("message_id", *(tx.shorten("content", k).alias(k) for k in ("history", "preview", "title")))


@_query(f"""WITH RECURSIVE files AS (SELECT *, lower(filename) AS low FROM (SELECT DISTINCT filename FROM chunks WHERE filename IS NOT NULL)),
    named AS (SELECT doc_id AS query_id, upper(list_last(string_split(filename, '/'))) AS name FROM documents WHERE doc_id % 50 = 0 AND filename IS NOT NULL),
    exact AS (SELECT query_id, name, min(f.filename) AS filename FROM named JOIN files f ON f.low = lower(name) WHERE name <> '' GROUP BY ALL)
    SELECT * FROM exact UNION ALL
    SELECT query_id, name, min(f.filename) AS filename FROM named JOIN files f ON contains(f.low, lower(name)) WHERE name <> '' AND (query_id, name) NOT IN (SELECT query_id, name FROM exact) GROUP BY ALL""")
def named_documents(spark: SparkSession, d: str) -> DataFrame:
    """Files as a plan names them: by their base names in capitals."""
    named = table(spark, d, "documents").filter("doc_id % 50 = 0 and filename is not null").select(F.col("doc_id").alias("query_id"), F.upper(tx.basename("filename")).alias("name"))
    return ask.resolve_documents(named, table(spark, d, "chunks").select("filename"))


@_query("""WITH RECURSIVE t AS (SELECT filename, content, row_number() OVER (PARTITION BY filename ORDER BY chunk_index, chunk_id) AS place, CAST(floor(length(content) / 1.5) AS BIGINT) + 1 AS cost
        FROM chunks WHERE source_type = 'text' AND content IS NOT NULL),
    fold AS (SELECT filename, place, content, 1 AS batch_no, cost AS used FROM t WHERE place = 1
        UNION ALL SELECT t.filename, t.place, t.content, CASE WHEN f.used + t.cost <= 4000 THEN f.batch_no ELSE f.batch_no + 1 END, CASE WHEN f.used + t.cost <= 4000 THEN f.used + t.cost ELSE t.cost END
        FROM fold f JOIN t ON t.filename IS NOT DISTINCT FROM f.filename AND t.place = f.place + 1)
    SELECT filename, batch_no, string_agg(content, chr(10) || chr(10) ORDER BY place) AS section FROM fold GROUP BY filename, batch_no""")
def summary_sections(spark: SparkSession, d: str) -> DataFrame:
    return ask.group_sections(table(spark, d, "chunks"))


# ---- the graph


@_query(f"""WITH {_LINKS}, n AS (SELECT chunk_id, {{}} FROM links JOIN graph_facts USING (fact_id))
    SELECT DISTINCT chunk_id, subject, relation, object FROM n WHERE subject <> '' AND relation <> '' AND object <> '' AND subject <> object""".replace("{}", ", ".join(
    rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}_ ]+', ' ', 'g'), ' +', ' ', 'g')) AS {c}" for c in ("subject", "relation", "object"))))
def parsed_triples(spark: SparkSession, d: str) -> DataFrame:
    """Facts as replies of a model, one JSON list a passage, parsed again."""
    stated = _links(spark, d).join(table(spark, d, "graph_facts"), "fact_id")
    replies = stated.groupBy("chunk_id").agg(F.to_json(F.collect_list(F.array("subject", "relation", "object"))).alias("reply"))
    return graph.parse_triples(replies)


@_query("""WITH t AS (SELECT DISTINCT subject, relation, object FROM graph_facts WHERE subject IS NOT NULL AND relation IS NOT NULL AND object IS NOT NULL)
    SELECT substr(sha256(subject || chr(31) || relation || chr(31) || object), 1, 16) AS fact_id, substr(sha256(subject), 1, 16) AS subject_id, substr(sha256(object), 1, 16) AS object_id, subject, relation, object FROM t""")
def built_facts(spark: SparkSession, d: str) -> DataFrame:
    triples = table(spark, d, "graph_facts").filter("subject is not null and relation is not null and object is not null").select(F.col("fact_id").alias("chunk_id"), "subject", "relation", "object")
    return graph.build_graph(triples)[1]


@_query("""WITH known AS (SELECT DISTINCT filename, sha256 FROM document_files WHERE batch_no < 6), asked AS (SELECT DISTINCT filename FROM document_files WHERE batch_no >= 6)
    SELECT filename, filename NOT IN (SELECT filename FROM known) AS inserted FROM asked""")
def inserted_or_got(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return mutation.insert_or_get(f.filter("batch_no < 6").select("filename"), f.filter("batch_no >= 6").select("filename"), ["filename"])[1]


# ---- answers


@_query(f"""WITH {_MESSAGES}, claims AS (SELECT message_id AS answer_id, parent_id, content AS text, list_distinct(list_transform(regexp_extract_all(content, '\\[([0-9]{{1,6}})\\]', 1), lambda x: CAST(x AS INTEGER))) AS k
        FROM messages WHERE lower(trim(role)) IN ('assistant', 'bot') AND length(trim(content, ' ')) > 0),
    cited AS (SELECT c.answer_id, c.text, string_agg(left(p.content, CAST(least(6000, floor(12000 / len(k))) AS INTEGER)), chr(10) || chr(10)) AS evidence FROM claims c JOIN messages p ON p.message_id = c.parent_id AND list_contains(k, 1) AND p.content IS NOT NULL GROUP BY ALL)
    SELECT answer_id, 1 AS segment_no, 'no source' AS reason FROM claims WHERE len(k) = 0
    UNION ALL SELECT answer_id, 1, 'not supported' FROM cited WHERE NOT contains(lower(evidence), lower(split_part(text, ' ', 1)))""")
def verified_claims(spark: SparkSession, d: str) -> DataFrame:
    """Answers as claims; their one source is the message before, and it supports them if it holds their first word."""
    m = _messages(spark, d)
    said = m.filter(F.lower(F.trim("role")).isin("assistant", "bot") & F.col("content").isNotNull())
    claims = said.select(F.col("message_id").alias("answer_id"), F.lit(1).alias("segment_no"), F.col("content").alias("text"), F.array_distinct(tx.citation_numbers("content")).alias("source_indices"))
    sources = said.select(F.col("message_id").alias("answer_id"), "parent_id").join(m.select(F.col("message_id").alias("parent_id"), "content"), "parent_id").filter("content is not null").select("answer_id", F.lit(1).alias("source_no"), "content")
    return citations.verify(claims, sources, _first_word_in)


def _first_word_in(claim: pd.Series, evidence: pd.Series) -> pd.Series:
    return pd.Series([c.split(" ", 1)[0].lower() in e.lower() for c, e in zip(claim, evidence)])


@_query(f"""WITH {_MESSAGES}, said AS (SELECT message_id AS chart_id, parent_id, list_transform(regexp_extract_all(content, '(-?[0-9][0-9,]*(?:\\.[0-9]+)?|-?\\.[0-9]+)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS v
        FROM messages WHERE lower(trim(role)) IN ('assistant', 'bot')),
    shown AS (SELECT s.chart_id, list_transform(regexp_extract_all(p.content, '(-?[0-9][0-9,]*(?:\\.[0-9]+)?|-?\\.[0-9]+)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS f FROM said s JOIN messages p ON p.message_id = s.parent_id)
    SELECT DISTINCT chart_id, value FROM (SELECT chart_id, unnest(v) AS value FROM said) LEFT JOIN shown USING (chart_id)
    WHERE coalesce(len(list_filter(f, lambda x: abs(x - value) <= 1e-9 * greatest(1, abs(x), abs(value)))), 0) = 0""")
def chart_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Figures of answers, as values of a chart, that the message before does not state."""
    from tessera.operators.charts import unverified

    m = _messages(spark, d)
    said = m.filter(F.lower(F.trim("role")).isin("assistant", "bot"))
    charts = said.select(F.col("message_id").alias("chart_id"), F.transform(tx.numbers("content"), lambda x: x.try_cast("double")).alias("values"), F.array(F.lit(1)).alias("sources"))
    before = m.select(F.col("message_id").alias("parent_id"), "content")
    return unverified(charts, said.select(F.col("message_id").alias("chart_id"), "parent_id").join(before, "parent_id").select("chart_id", F.lit(1).alias("source_no"), "content"))


@_query("""SELECT event_type AS mode, count(*) AS answers, count(*) FILTER (WHERE value > 50) AS correct, count(*) FILTER (WHERE user_id % 3 > 0) AS flagged, round(avg(value), 3) AS seconds FROM events GROUP BY event_type""")
def scored_modes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return ask.score_answers(e.select(F.col("event_type").alias("mode"), (F.col("value") > 50).alias("correct"), (F.col("user_id") % 3).alias("warnings"), F.col("value").alias("seconds")))


# ---- streams


@_query("""SELECT user_id AS turn_id, coalesce(string_agg(CAST(event_id AS VARCHAR), '' ORDER BY event_id) FILTER (WHERE event_id % 3 = 0), '') AS thinking, coalesce(string_agg(CAST(event_id AS VARCHAR), '' ORDER BY event_id) FILTER (WHERE event_id % 3 = 1), '') AS answer
    FROM events GROUP BY user_id HAVING bool_or(event_id % 3 = 2)""")
def split_turns(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("thinking"), F.lit("answer"), F.lit("done")), (F.col("event_id") % 3 + 1).cast("int"))
    return turns.split_turns(table(spark, d, "events").select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_id").cast("string").alias("text")))


@_query("""WITH n AS (SELECT event_type AS job, event_id AS item, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY event_type) AS total FROM events)
    SELECT job, item, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total, round(done / total, 6) AS share FROM n""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    return turns.progress(table(spark, d, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("item"), F.col("ts").alias("at")))


@_query("""WITH n AS (SELECT event_type AS stage, count(*) AS done, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM events GROUP BY event_type)
    SELECT stage, done, round(done / nullif(seconds, 0), 6) AS per_second, round(greatest(1000000 - done, 0) * seconds / done, 3) AS seconds_left FROM n""")
def time_left(spark: SparkSession, d: str) -> DataFrame:
    return turns.time_left(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("ts").alias("at")), 1_000_000)


# ---- records


@_query("""WITH f AS (SELECT file_id, filename, sha256 FROM document_files WHERE batch_no >= 6 AND sha256 IS NOT NULL),
    held AS (SELECT sha256, min(filename) AS old FROM document_files WHERE batch_no < 6 AND sha256 IS NOT NULL GROUP BY sha256), first AS (SELECT sha256, arg_min(filename, file_id) AS new FROM f GROUP BY sha256)
    SELECT file_id, filename, coalesce(old, new) AS holder FROM f JOIN first USING (sha256) LEFT JOIN held USING (sha256) WHERE filename <> coalesce(old, new)""")
def rejected_uploads(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return mutation.reject_duplicates(f.filter("batch_no >= 6").select("file_id", "filename", "sha256"), f.filter("batch_no < 6").select("filename", "sha256"))


@_query("""WITH c AS (SELECT DISTINCT conversation_id, conversation_id % 7 AS owner_id FROM conversation_messages WHERE conversation_id IS NOT NULL)
    SELECT count(*) AS messages, count(DISTINCT conversation_id) AS conversations, (SELECT count(DISTINCT owner_id) FROM c WHERE owner_id <> 3) AS users FROM conversation_messages WHERE conversation_id IS NULL OR conversation_id % 7 <> 3""")
def deleted_owner(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversation_messages").select("message_id", "conversation_id")
    talks = m.filter("conversation_id is not null").select("conversation_id", (F.col("conversation_id") % 7).alias("owner_id")).distinct()
    users, talks, m = mutation.delete_owner(talks.select("owner_id").distinct(), talks, m, spark.range(3, 4).select(F.col("id").alias("owner_id")))
    return m.agg(F.count("*").alias("messages"), F.count_distinct("conversation_id").alias("conversations")).crossJoin(users.agg(F.count("*").alias("users")))  # one row each


@_query("""WITH e AS (SELECT user_id AS owner_id, event_type AS name, ts AS seen_at, event_id % 2 = 0 AS old FROM events),
    users AS (SELECT owner_id, max(struct_pack(s := seen_at, n := name)) AS u FROM e WHERE old GROUP BY owner_id), news AS (SELECT owner_id, max(struct_pack(s := seen_at, n := name)) AS n FROM e WHERE NOT old GROUP BY owner_id),
    j AS (SELECT owner_id, u, n, n IS NOT NULL AND (u IS NULL OR epoch(date_trunc('second', n.s)) - epoch(date_trunc('second', u.s)) > 300 OR n.n IS DISTINCT FROM u.n) AS change FROM users FULL JOIN news USING (owner_id))
    SELECT owner_id, CASE WHEN change THEN n.n ELSE u.n END AS name, CASE WHEN change THEN n.s ELSE u.s END AS seen_at FROM j""")
def touched_users(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("owner_id"), F.col("event_type").alias("name"), F.col("ts").alias("seen_at"), (F.col("event_id") % 2 == 0).alias("old"))
    known = e.filter("old").groupBy("owner_id").agg(F.max(F.struct("seen_at", "name")).alias("u")).select("owner_id", "u.name", "u.seen_at")
    return mutation.touch_users(known, e.filter("not old").drop("old"))


@_query(f"""WITH {_MESSAGES}, leaf AS (SELECT conversation_id, message_id AS active_id FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, message_id DESC) = 1)
    SELECT -2 * conversation_id - 1 AS message_id, conversation_id, CASE WHEN conversation_id % 3 = 0 THEN NULL WHEN conversation_id % 3 = 1 THEN active_id ELSE conversation_id END AS parent_id, 'user' AS role FROM leaf
    UNION ALL SELECT -2 * conversation_id - 2, conversation_id, -2 * conversation_id - 1, 'assistant' FROM leaf""")
def appended_turns(spark: SparkSession, d: str) -> DataFrame:
    """A turn more in every conversation: at its root, behind its last message, or as a fork."""
    m = _messages(spark, d)
    talks = conversations.active_leaves(m).withColumn("updated_at", F.lit(None).cast("timestamp"))
    c = F.col("conversation_id")
    parent = F.when(c % 3 == 0, F.lit(-1)).when(c % 3 == 1, F.lit(None)).otherwise(c)
    turn = talks.select(c, (-2 * c - 1).alias("question_id"), (-2 * c - 2).alias("answer_id"), parent.cast("long").alias("parent"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit(None).cast("timestamp").alias("created_at"))
    return conversations.append_turn(m, talks, turn)[0].filter("message_id < 0").select("message_id", "conversation_id", "parent_id", "role")


@_query("SELECT conversation_id, CASE WHEN conversation_id % 7 = 3 THEN 'renamed' ELSE 'old' END AS title FROM (SELECT DISTINCT conversation_id FROM conversation_messages WHERE conversation_id IS NOT NULL AND conversation_id % 5 <> 1)")
def renamed_and_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of owner 3 renamed, every fifth deleted by its owner; what others ask for is left alone."""
    talks = table(spark, d, "conversation_messages").filter("conversation_id is not null").select("conversation_id", F.concat(F.lit("o"), F.col("conversation_id") % 7).alias("owner_id"), F.lit("old").alias("title")).distinct()
    new = conversations.rename_all(talks, talks.select("conversation_id", F.lit("o3").alias("owner_id"), F.lit("renamed").alias("title")))
    gone = talks.filter("conversation_id % 5 = 1").select("conversation_id", "owner_id").unionByName(talks.filter("conversation_id % 5 = 2").select("conversation_id", F.lit("nobody").alias("owner_id")))
    return conversations.delete_conversations(talks.select("conversation_id"), new, gone)[1].select("conversation_id", "title")


@_query(f"""WITH {_MESSAGES} SELECT message_id, conversation_id IS NOT NULL AND conversation_id % 7 = 3 AS mine FROM messages""")
def owned_messages(spark: SparkSession, d: str) -> DataFrame:
    """Whether each message's conversation exists for owner 3; another's cannot be told from one that is missing."""
    m = _messages(spark, d)
    talks = m.filter("conversation_id is not null").select("conversation_id", (F.col("conversation_id") % 7).cast("string").alias("owner_id")).distinct()
    return conversations.exists_for(m.select("message_id", "conversation_id"), talks, "3").select("message_id", "mine")


@_query("""WITH kept AS (SELECT filename, chunk_index, content, source_type FROM chunks WHERE source_type IS DISTINCT FROM 'image_caption' OR filename NOT IN (SELECT filename FROM chunks WHERE source_format = 'pptx' AND filename IS NOT NULL)),
    base AS (SELECT f.filename, coalesce(max(k.chunk_index), -1) + 1 AS base FROM (SELECT DISTINCT filename FROM chunks WHERE source_format = 'pptx') f LEFT JOIN kept k USING (filename) GROUP BY f.filename)
    SELECT filename, chunk_index, content, source_type FROM kept
    UNION ALL SELECT filename, CAST(base + i AS INTEGER), 'caption ' || (i + 1) || ' of ' || filename, 'image_caption' FROM base, unnest([0, 1]) AS u(i)""")
def replaced_captions(spark: SparkSession, d: str) -> DataFrame:
    """Two new captions for every file of slides, numbered behind its other rows."""
    c = table(spark, d, "chunks").select("chunk_id", "filename", "chunk_index", "content", "source_type")
    slides = table(spark, d, "chunks").filter("source_format = 'pptx'").select("filename").distinct()
    new = slides.select("filename", F.explode(F.array(F.lit(1), F.lit(2))).alias("caption_no")).withColumn("content", F.format_string("caption %d of %s", "caption_no", "filename"))
    return mutation.replace_captions(c, new).select("filename", "chunk_index", "content", "source_type")


@_query("""WITH n AS (SELECT filename, count(*) AS text_chunks, max(chunk_index) AS last FROM chunks WHERE source_type = 'text' GROUP BY filename), o AS (SELECT filename, min(chunk_index) AS first_other FROM chunks WHERE source_type <> 'text' GROUP BY filename)
    SELECT filename, text_chunks, coalesce(last < first_other, true) AS safe FROM n LEFT JOIN o USING (filename)""")
def rechunk_guard(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return mutation.rechunk_guard(c, c.filter("source_type = 'text'").select("filename", "chunk_index"))


@_query("""SELECT file_id, CASE WHEN filename IN (SELECT filename FROM document_files WHERE batch_no = 11) THEN TIMESTAMP '2026-01-01 00:00:00' ELSE captioned_at AT TIME ZONE 'UTC' END AS captioned_at FROM document_files""")
def stamped_files(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    when = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return mutation.stamp(f, f.filter("batch_no = 11"), "filename", "captioned_at", when).select("file_id", "captioned_at")


@_query("""SELECT file_id, filename AS name, batch_no AS batch, [batch_no, file_id] AS box FROM document_files""")
def metadata_documents(spark: SparkSession, d: str) -> DataFrame:
    """Metadata and boxes kept as JSON text, read again."""
    kept = _files(spark, d).select("file_id", F.to_json(F.struct(F.struct(F.col("filename").alias("name"), F.col("batch_no").alias("batch")).alias("source"), F.array("batch_no", "file_id").alias("box"))).alias("metadata"))
    parsed = kept.select("file_id", F.from_json("metadata", "source struct<name: string, batch: int>, box array<long>").alias("m"))
    return parsed.select("file_id", "m.source.name", "m.source.batch", "m.box")


@_query("""WITH h AS (SELECT file_id, md5(filename || chr(31) || file_id) AS h FROM document_files), u AS (SELECT file_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uid FROM h)
    SELECT file_id, uid, true AS good, false AS hash_is_one FROM u""")
def made_uuids(spark: SparkSession, d: str) -> DataFrame:
    made = _files(spark, d).select("file_id", "sha256", stores.made_uuid("filename", "file_id").alias("uid"))
    return made.select("file_id", "uid", stores.is_uuid("uid").alias("good"), stores.is_uuid("sha256").alias("hash_is_one"))


@_query(f"""WITH {_MESSAGES} SELECT message_id, CASE WHEN created_at IS NOT NULL THEN strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS stamp, CASE WHEN created_at IS NOT NULL THEN CAST(message_id AS VARCHAR) END AS key, false AS bad FROM messages""")
def page_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Cursors written and read again; what is no cursor gives none."""
    m = _messages(spark, d)
    made = m.select("message_id", "content", tx.cursor_encode(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), "message_id").alias("cursor"))
    read = made.select("message_id", tx.cursor_decode("cursor").alias("c"), tx.cursor_decode("content").isNotNull().alias("bad"))
    return read.select("message_id", "c.stamp", "c.key", "bad")


@_query(f"SELECT chunk_id, length({NORMAL('content')}) AS chars, len(string_split({NORMAL('content')}, ' ')) AS words FROM chunks")
def text_sizes(spark: SparkSession, d: str) -> DataFrame:
    normal = tx.normalise_text("content")
    return table(spark, d, "chunks").select("chunk_id", F.length(normal).alias("chars"), F.size(F.split(normal, " ")).alias("words")).withColumn("words", F.when(F.col("chars").isNotNull(), F.col("words")))
