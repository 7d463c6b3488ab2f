"""SQL equivalents of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

from tessera.functions.text import STOP_WORDS

SPACES = r"[ \t\n\r\x0b\x0c\x{85}\x{a0}\x{2003}]+"
TERMS = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def NORMAL(c: str) -> str:  # noqa: N802
    return f"lower(trim(regexp_replace({c}, '{SPACES}', ' ', 'g'), ' '))"


TOKENS = "CAST(floor(length({c}) / 1.5) AS INTEGER) + 1"

_QUERIES = """
    q AS (SELECT doc_id AS query_id, text, CAST(embedding AS DOUBLE[]) AS vec
          FROM documents JOIN embeddings ON doc_id % 500 = vec_id WHERE doc_id % 50 = 0),
    vectors AS (SELECT chunk_id, filename, CAST(embedding AS DOUBLE[]) AS e FROM chunks
                WHERE embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
    sims AS (SELECT query_id, chunk_id, filename, round(list_cosine_similarity(vec, e), 9) AS similarity FROM q, vectors)"""


def _text() -> str:
    return f"""
    asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TERMS.format(c='text')}) AS term FROM q)
              WHERE term NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})),
    counts AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({TERMS.format(c='content')}) AS term FROM chunks) GROUP BY ALL),
    matches AS (SELECT query_id, chunk_id, round(sum(tf / (tf + CAST(1 AS DOUBLE))), 9) AS score FROM asked JOIN counts USING (term) GROUP BY ALL)"""


def _ranks(pool: int = 40) -> str:
    return f"""{_QUERIES}, {_text()},
    v AS (SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
          FROM sims QUALIFY rank <= {pool}),
    t AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM matches QUALIFY rank <= {pool}),
    both_lists AS (SELECT query_id, chunk_id, round(coalesce(1 / (CAST(60 AS DOUBLE) + v.rank), 0) + coalesce(1 / (CAST(60 AS DOUBLE) + t.rank), 0), 9) AS score
             FROM v FULL JOIN t USING (query_id, chunk_id)),
    fused AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
              FROM both_lists QUALIFY rank <= {pool})"""


_LISTS = """
    lists AS (SELECT query_id, 0 AS list_no, rank, CAST(1 AS DOUBLE) AS weight, chunk_id FROM v
              UNION ALL SELECT query_id, 1, rank, 0.5, chunk_id FROM t)"""

_SUMMARIES = """
    first_vectors AS (SELECT filename, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE embedding IS NOT NULL
                      QUALIFY row_number() OVER (PARTITION BY filename ORDER BY chunk_index, chunk_id) = 1),
    s AS (SELECT query_id, filename, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vec, e), 9) DESC, filename) AS rank
          FROM q, first_vectors WHERE list_dot_product(e, e) > 0 QUALIFY rank <= 60)"""


def _documents() -> str:
    return f"""{_ranks(60)}, {_SUMMARIES},
    scanned AS (SELECT query_id, filename, max(score) AS best, min(rank) AS first FROM fused JOIN chunks USING (chunk_id) GROUP BY ALL),
    by_chunk AS (SELECT query_id, filename, 0 AS list, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, filename) AS rank FROM scanned),
    united AS (SELECT * FROM by_chunk UNION ALL SELECT query_id, filename, 1, rank FROM s),
    scored AS (SELECT query_id, filename, round(sum(1 / (CAST(60 AS DOUBLE) + rank)), 9) AS score, min(list * 1000 + rank) AS seen FROM united GROUP BY ALL),
    top AS (SELECT query_id, filename, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, filename) AS rank FROM scored QUALIFY rank <= 3)"""


def _within() -> str:
    return f"""{_documents()},
    wv AS (SELECT query_id, filename, chunk_id, row_number() OVER (PARTITION BY query_id, filename ORDER BY similarity DESC, chunk_id) AS r
           FROM sims JOIN top USING (query_id, filename) QUALIFY r <= 24),
    wt AS (SELECT query_id, filename, chunk_id, row_number() OVER (PARTITION BY query_id, filename ORDER BY matches.score DESC, chunk_id) AS r
           FROM matches JOIN chunks USING (chunk_id) JOIN top USING (query_id, filename) QUALIFY r <= 24),
    wboth AS (SELECT query_id, filename, chunk_id, round(coalesce(1 / (CAST(60 AS DOUBLE) + wv.r), 0) + coalesce(1 / (CAST(60 AS DOUBLE) + wt.r), 0), 9) AS score
              FROM wv FULL JOIN wt USING (query_id, filename, chunk_id))"""


def _collapsed(ranked: str | None = None, source: str = "fused") -> str:
    return f"""{ranked or _ranks()},
    found AS (SELECT query_id, chunk_id, rank, filename, chunk_index, source_type, content FROM {source} JOIN chunks USING (chunk_id)
              QUALIFY row_number() OVER (PARTITION BY query_id, {NORMAL('content')} ORDER BY rank, chunk_id) = 1),
    marked AS (SELECT *, CASE WHEN chunk_index - lag(chunk_index) OVER w > 2 THEN 1 WHEN lag(chunk_index) OVER w IS NULL THEN 1 ELSE 0 END AS new
               FROM found WHERE source_type = 'text' AND chunk_index IS NOT NULL WINDOW w AS (PARTITION BY query_id, filename ORDER BY chunk_index, chunk_id)),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY query_id, filename ORDER BY chunk_index, chunk_id) AS island FROM marked),
    folded AS (SELECT query_id, arg_min(chunk_id, rank) AS chunk_id, min(rank) AS rank, min(chunk_index) - 1 AS span_start, max(chunk_index) + 1 AS span_end
               FROM islands GROUP BY query_id, filename, island
               UNION ALL
               SELECT query_id, chunk_id, rank, NULL, NULL FROM found WHERE source_type <> 'text' OR chunk_index IS NULL OR source_type IS NULL)"""


def _picks(source: str, group: list[str], limit: int) -> str:
    """Greedy diversification of ``source`` (*group, chunk_id, score, rank), one step a pick."""
    keys = ", ".join(group)
    same = " AND ".join(f"p.{g} = c.{g}" for g in group)
    parts = [f"""cand AS MATERIALIZED (SELECT {', '.join(f's.{g}' for g in group)}, chunk_id, s.score, s.rank, s.score / nullif(max(s.score) OVER (PARTITION BY {', '.join(f's.{g}' for g in group)}), 0) AS rel, CAST(embedding AS DOUBLE[]) AS e FROM {source} s JOIN chunks USING (chunk_id))"""]
    for i in range(1, limit + 1):
        if i == 1:
            parts.append(f"""pick1 AS MATERIALIZED (SELECT {keys}, chunk_id, score, rel, e, 1 AS n FROM cand c QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(0.7 * coalesce(rel, 1), 12) DESC, rank) = 1)""")
            continue
        before = " UNION ALL ".join(f"SELECT * FROM pick{j}" for j in range(1, i))
        parts.append(f"""pick{i} AS MATERIALIZED (WITH p AS ({before}),
            v AS (SELECT {', '.join(f'c.{g}' for g in group)}, c.chunk_id, c.score, c.rel, c.e, c.rank, greatest(max(CASE WHEN isnan(list_cosine_similarity(c.e, p.e)) THEN 0 ELSE coalesce(list_cosine_similarity(c.e, p.e), 0) END), 0) AS near FROM cand c JOIN p ON {same} GROUP BY ALL HAVING NOT bool_or(c.chunk_id = p.chunk_id))
            SELECT {keys}, chunk_id, score, rel, e, {i} AS n FROM v QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(0.7 * coalesce(rel, 1) - (1 - CAST(0.7 AS DOUBLE)) * near, 12) DESC, rank) = 1)""")
    every = " UNION ALL ".join(f"SELECT {keys}, chunk_id, score, n FROM pick{j}" for j in range(1, limit + 1))
    return f"{', '.join(parts)}, picked AS (SELECT {keys}, chunk_id, score, n AS rank FROM ({every}))"


def _mmr_of_fused() -> str:
    return f"{_ranks()}, {_picks('fused', ['query_id'], 10)}"


def _mmr_within() -> str:
    ranked = "inside AS (SELECT query_id, filename, chunk_id, score, row_number() OVER (PARTITION BY query_id, filename ORDER BY score DESC, chunk_id) AS rank FROM wboth QUALIFY rank <= 24)"
    return f"{_within()}, {ranked}, {_picks('inside', ['query_id', 'filename'], 6)}"


_COVERED = """
    near AS (SELECT DISTINCT filename, chunk_index + o AS chunk_index FROM chunks, unnest([-1, 0, 1]) AS u(o) WHERE (chunk_index = 0 OR source_type <> 'text') AND (o = 0 OR source_type = 'text')),
    whole AS (SELECT DISTINCT filename FROM chunks WHERE source_format = 'xlsx')"""

_LINKS = """
    links AS (SELECT fact_id, chunk_id FROM graph_facts f
              JOIN (SELECT chunk_id, CAST('0x' || substr(chunk_id, 1, 12) AS BIGINT) % (SELECT count(*) FROM chunks) AS k FROM chunks) c
                ON CAST('0x' || substr(fact_id, 1, 12) AS BIGINT) % (SELECT count(*) FROM chunks) = c.k),
    stated AS (SELECT chunk_id, subject_id AS phrase_id FROM links JOIN graph_facts USING (fact_id) WHERE subject_id IS NOT NULL
               UNION SELECT chunk_id, object_id FROM links JOIN graph_facts USING (fact_id) WHERE object_id IS NOT NULL)"""

_GRAPH = f"""{_LINKS},
    named AS (SELECT least(subject_id, object_id) AS x, greatest(subject_id, object_id) AS y, CAST(2 AS DOUBLE) AS weight FROM links JOIN graph_facts USING (fact_id)
              WHERE subject_id IS NOT NULL AND object_id IS NOT NULL AND subject_id <> object_id
              UNION ALL SELECT least(phrase_a, phrase_b), greatest(phrase_a, phrase_b), 2 * CAST(weight AS DOUBLE) FROM graph_edges
              WHERE weight IS NOT NULL AND NOT isnan(weight) AND NOT isinf(weight) AND phrase_a <> phrase_b),
    edges AS MATERIALIZED (SELECT 'p:' || x AS a, 'p:' || y AS b, sum(weight) AS weight FROM named GROUP BY x, y
              UNION ALL SELECT 'c:' || chunk_id, 'p:' || phrase_id, 1 FROM stated)"""

_SEEDS = f"""
    fact_sims AS MATERIALIZED (SELECT query_id, fact_id, round(list_cosine_similarity(vec, e), 9) AS similarity
              FROM q, (SELECT fact_id, CAST(embedding AS DOUBLE[]) AS e FROM graph_facts JOIN graph_phrases ON phrase_id = subject_id WHERE embedding IS NOT NULL) WHERE list_dot_product(e, e) > 0),
    floors AS (SELECT query_id, min(similarity) AS low FROM fact_sims GROUP BY query_id),
    close AS (SELECT query_id, fact_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fact_id) AS rank FROM fact_sims QUALIFY rank <= 5),
    scored_facts AS (SELECT query_id, fact_id, rank, CASE WHEN max(similarity) OVER (PARTITION BY query_id) > low THEN (similarity - low) / (max(similarity) OVER (PARTITION BY query_id) - low) ELSE 1 END AS s FROM close JOIN floors USING (query_id)),
    ends AS (SELECT query_id, rank, s, unnest([subject_id, object_id]) AS phrase_id FROM scored_facts JOIN graph_facts USING (fact_id)),
    linking AS (SELECT query_id, phrase_id, arg_max(s, rank) AS last, avg(s) AS mean FROM ends WHERE phrase_id IS NOT NULL GROUP BY ALL),
    seeds AS (SELECT query_id, 'p:' || l.phrase_id AS vertex, last / greatest(coalesce((SELECT count(*) FROM stated WHERE stated.phrase_id = l.phrase_id), 0), 1) AS weight FROM linking l
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(mean, 9) DESC, l.phrase_id) <= 5)"""

_MESSAGES = """
    m AS (SELECT message_id, min(struct_pack(a := conversation_id, b := parent_id, c := role, d := content, e := created_at)) AS r FROM conversation_messages GROUP BY message_id),
    messages AS (SELECT message_id, r.a AS conversation_id, r.b AS parent_id, r.c AS role, r.d AS content, r.e AS created_at FROM m)"""

_PAGE = """WITH {messages},
    valid AS (SELECT * FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL),
    asked AS (SELECT * FROM valid WHERE lower(trim(role)) IN ('user', 'human') AND content IS NOT NULL),
    titles AS (SELECT conversation_id, content AS title FROM asked QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, message_id) = 1),
    page AS (SELECT conversation_id, max(created_at) AS updated_at FROM valid GROUP BY conversation_id)
    SELECT conversation_id, updated_at AT TIME ZONE 'UTC' AS updated_at, title FROM page JOIN titles USING (conversation_id) WHERE {condition}
    ORDER BY page.updated_at DESC, conversation_id DESC LIMIT 21"""


def _expanded(collapsed: str) -> str:
    return f"""WITH {collapsed}, around AS (
        SELECT f.query_id, f.chunk_id, string_agg(n.content, chr(10) ORDER BY n.chunk_index, n.content) AS expanded
        FROM folded f JOIN chunks c ON c.chunk_id = f.chunk_id JOIN chunks n ON n.filename = c.filename AND n.source_type = 'text' AND n.content IS NOT NULL
         AND n.chunk_index BETWEEN f.span_start AND f.span_end GROUP BY ALL)
        SELECT f.query_id, f.chunk_id, CAST(f.rank AS INTEGER) AS rank, c.filename, coalesce(i.expanded, c.content) AS content
        FROM folded f JOIN chunks c USING (chunk_id) LEFT JOIN around i ON i.query_id = f.query_id AND i.chunk_id = f.chunk_id"""


def statements() -> dict[str, str]:
    fused = _ranks()
    content = f"WITH {fused}, c AS (SELECT query_id, chunk_id, rank, filename, content FROM fused JOIN chunks USING (chunk_id))"
    normal = NORMAL("content")
    return {
        "vector_topk": f"WITH {_ranks()} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM v",
        "text_topk": f"WITH {_ranks()} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM t",
        "hybrid_candidates": f"WITH {fused} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fused",
        "summary_rank": f"WITH {_QUERIES}, {_SUMMARIES} SELECT query_id, filename, CAST(rank AS INTEGER) AS rank FROM s",
        "document_rank": f"WITH {_documents()} SELECT query_id, filename, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top",
        "within_document": f"""WITH {_within()} SELECT query_id, filename, chunk_id, round(score, 6) AS score,
            CAST(row_number() OVER (PARTITION BY query_id, filename ORDER BY wboth.score DESC, chunk_id) AS INTEGER) AS rank FROM wboth QUALIFY rank <= 24""",
        "collapse_duplicates": f"WITH {_collapsed()} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, span_start, span_end FROM folded",
        "expand_context": _expanded(_collapsed()),
        "hybrid_search": _expanded(_collapsed(_mmr_of_fused(), "picked")),
        "mmr_rerank": f"WITH {_mmr_of_fused()} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS mmr_rank FROM picked",
        "search_within_mmr": f"WITH {_mmr_within()} SELECT query_id, filename, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS mmr_rank FROM picked",
        "routed_search": f"""WITH {_mmr_within()}, one AS (SELECT p.query_id, chunk_id, p.score, p.rank, top.rank AS doc_rank FROM picked p JOIN top USING (query_id, filename)
                QUALIFY row_number() OVER (PARTITION BY p.query_id, chunk_id ORDER BY top.rank, p.rank) = 1)
            SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_rank, one.rank, chunk_id) AS INTEGER) AS rank FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_rank, one.rank, chunk_id) <= 15""",
        "text_topk_scan": f"WITH {_ranks()} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM t",
        "multi_query_union": f"""WITH {fused}, {_LISTS}, kept AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list_no, rank) = 1)
            SELECT query_id, chunk_id, list_no, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank, chunk_id) AS INTEGER) AS place FROM kept QUALIFY place <= 60""",
        "interleave_lists": f"""WITH {fused}, {_LISTS}, kept AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, list_no) = 1)
            SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no, chunk_id) AS INTEGER) AS place FROM kept QUALIFY place <= 12""",
        "council_fusion": f"""WITH {fused}, {_LISTS}, scored AS (
            SELECT query_id, chunk_id, round(sum(1 / (CAST(60 AS DOUBLE) + rank)), 9) AS score, min(list_no * 1000 + rank) AS seen FROM lists GROUP BY ALL)
            SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY scored.score DESC, seen, chunk_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 20""",
        "weighted_fusion": f"WITH {fused}, {_LISTS} SELECT query_id, chunk_id, round(round(sum(weight / (CAST(60 AS DOUBLE) + rank)), 9), 6) AS score FROM lists GROUP BY ALL",
        "research_gather": f"""WITH {fused}, {_LISTS}, {_COVERED},
            scored AS (SELECT query_id, chunk_id, round(sum(weight / (CAST(60 AS DOUBLE) + rank)), 9) AS score FROM lists GROUP BY ALL),
            fresh AS (SELECT s.*, c.filename, c.chunk_index FROM scored s JOIN chunks c USING (chunk_id)
                      WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.filename = c.filename AND n.chunk_index = c.chunk_index) AND c.filename NOT IN (SELECT filename FROM whole)),
            kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM fresh QUALIFY n <= 20),
            docs AS (SELECT query_id, filename, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 9) DESC, min(n)) AS doc_rank FROM kept GROUP BY query_id, filename)
            SELECT query_id, chunk_id, CAST(doc_rank AS INTEGER) AS doc_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_rank, chunk_index, chunk_id) AS INTEGER) AS position
            FROM kept JOIN docs USING (query_id, filename)""",
        "coverage_antijoin": f"""WITH {fused}, {_COVERED} SELECT query_id, chunk_id FROM fused JOIN chunks c USING (chunk_id)
            WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.filename = c.filename AND n.chunk_index = c.chunk_index) AND c.filename NOT IN (SELECT filename FROM whole)""",
        "document_sizes": "SELECT filename, CAST(coalesce(sum(length(content)) FILTER (WHERE source_type = 'text'), 0) AS BIGINT) AS chars FROM chunks GROUP BY filename",
        "whole_documents": """WITH small AS (SELECT filename FROM chunks WHERE source_type = 'text' GROUP BY filename HAVING sum(length(content)) BETWEEN 1 AND 16000),
            rows AS (SELECT filename, chunk_id, chunk_index, content, CAST(floor((row_number() OVER (PARTITION BY filename ORDER BY chunk_index, chunk_id) - 1) / 3) AS INTEGER) AS part
                     FROM chunks WHERE source_type = 'text' AND content IS NOT NULL AND filename IN (SELECT filename FROM small))
            SELECT filename, part, min(chunk_index) AS chunk_index, string_agg(content, chr(10) ORDER BY chunk_index, chunk_id) AS content FROM rows GROUP BY filename, part""",
        "budget_cut": f"""{content} SELECT query_id, chunk_id, CAST(sum({TOKENS.format(c='content')}) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
            FROM c QUALIFY used <= 2000""",
        "pack_batches": f"""WITH RECURSIVE {fused}, sized AS (SELECT query_id, rank, {TOKENS.format(c='content')} AS cost FROM fused JOIN chunks USING (chunk_id)),
            fold AS (SELECT query_id, rank, 1 AS batch_no, cost + 20 AS used FROM sized WHERE rank = 1
                     UNION ALL
                     SELECT s.query_id, s.rank, CASE WHEN f.used + s.cost + 20 <= 1000 THEN f.batch_no ELSE f.batch_no + 1 END,
                            CASE WHEN f.used + s.cost + 20 <= 1000 THEN f.used + s.cost + 20 ELSE s.cost + 20 END
                     FROM fold f JOIN sized s ON s.query_id = f.query_id AND s.rank = f.rank + 1)
            SELECT query_id, rank, batch_no FROM fold""",
        "number_sources": f"""{content}, keyed AS (SELECT *, min(rank) OVER (PARTITION BY query_id, filename, {normal}) AS first FROM c)
            SELECT query_id, chunk_id, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS number, rank <> first AS pointer FROM keyed""",
        "render_notes": f"""WITH {fused}, n AS (SELECT query_id, rank AS note_no, filename, chunk_id AS excerpt, chunk_index AS position, left({normal}, 200) AS claim,
                CASE WHEN source_type = 'image_caption' THEN 'description of a figure' || coalesce(', page ' || page_number, '') WHEN source_type = 'chart_data' THEN 'data behind a chart' || coalesce(', page ' || page_number, '')
                     WHEN page_number IS NOT NULL THEN 'page ' || page_number ELSE 'text' END AS label FROM fused JOIN chunks USING (chunk_id)),
            files AS (SELECT query_id, filename, count(*) AS notes, min(note_no) AS first FROM n GROUP BY ALL),
            ranked AS (SELECT query_id, filename, notes, row_number() OVER (PARTITION BY query_id ORDER BY notes DESC, first, filename) AS number FROM files),
            cited AS (SELECT n.*, notes, number, row_number() OVER (PARTITION BY query_id ORDER BY number, position, note_no) AS cite FROM n JOIN ranked USING (query_id, filename)),
            blocks AS (SELECT query_id, number, filename, notes, '## ' || filename || chr(10) || string_agg('- [' || cite || '] (' || label || ') ' || coalesce(claim, ''), chr(10) ORDER BY position, note_no) AS block FROM cited GROUP BY query_id, number, filename, notes),
            summed AS (SELECT *, sum(CAST(floor(length(block) / 1.5) AS BIGINT) + 1) OVER (PARTITION BY query_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS used FROM blocks)
            SELECT query_id, filename, notes, CAST(number AS INTEGER) AS number, CAST(used AS BIGINT) AS used, block FROM summed WHERE used <= 1500""",
        "number_within": f"""{content}, keyed AS (SELECT *, min(rank) OVER (PARTITION BY query_id, filename, {normal}) AS first FROM c),
            numbered AS (SELECT query_id, rank, content, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS number, rank <> first AS pointer FROM keyed),
            lines AS (SELECT query_id, rank, number, pointer, CASE WHEN pointer THEN '[' || number || '] (same passage as [' || number || '] above)' ELSE '[' || number || '] ' || coalesce(content, '') END AS line FROM numbered),
            cut AS (SELECT *, sum(CAST(floor(length(line) / 1.5) AS BIGINT) + 4) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM lines)
            SELECT query_id, CAST(place AS INTEGER) AS place, CAST(number AS INTEGER) AS number, pointer, line FROM cut WHERE used <= 3000
            UNION ALL SELECT query_id, CAST(min(place) AS INTEGER), NULL, NULL, '(' || count(*) || ' more results did not fit and were left out.)' FROM cut WHERE used > 3000 GROUP BY query_id""",
        "spreadsheet_sample": """WITH t AS (SELECT filename, chunk_id, chunk_index, source_format, row_number() OVER (PARTITION BY filename, page_number ORDER BY chunk_index, chunk_id) = 1 AS first FROM chunks WHERE source_type = 'text'),
            sizes AS (SELECT filename, count(*) AS n, count(*) FILTER (WHERE first) AS heads, bool_or(source_format = 'xlsx') AS sheet FROM t GROUP BY filename),
            big AS (SELECT * FROM sizes WHERE n > 40 AND sheet),
            rest AS (SELECT t.*, n, heads, row_number() OVER (PARTITION BY filename ORDER BY chunk_index, chunk_id) - 1 AS i FROM t JOIN big USING (filename) WHERE NOT first),
            spread AS (SELECT DISTINCT filename, CAST(floor(k * ((n - heads) / CAST(40 - heads AS DOUBLE))) AS BIGINT) AS i FROM big, unnest(range(0, greatest(40 - heads, 0))) AS u(k) WHERE n > heads),
            kept AS (SELECT filename, chunk_id, chunk_index FROM t WHERE filename NOT IN (SELECT filename FROM big) UNION ALL SELECT filename, chunk_id, chunk_index FROM t JOIN big USING (filename) WHERE first
                UNION ALL SELECT filename, chunk_id, chunk_index FROM rest JOIN spread USING (filename, i))
            SELECT filename, chunk_id, CAST(row_number() OVER (PARTITION BY filename ORDER BY chunk_index, chunk_id) AS INTEGER) AS place FROM kept""",
        "chunk_text": r"""WITH p AS (SELECT doc_id, unnest(s) AS paragraph, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r\x0b\x0c]*\n[ \t\r\n\x0b\x0c]*') AS s FROM documents)),
            w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(paragraph, '__SPACES__'), lambda x: x <> '') AS w FROM p),
            c AS (SELECT doc_id, i, k, array_to_string(w[k + 1 : k + 500], ' ') AS chunk FROM w, unnest(range(0, len(w), 500)) AS u(k) WHERE len(w) > 0)
            SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS chunk_no, chunk FROM c""".replace("__SPACES__", SPACES),
        "delete_documents": f"""WITH {_LINKS}, gone AS (SELECT DISTINCT filename FROM chunks WHERE source_format = 'xlsx'), kept AS (SELECT * FROM chunks WHERE filename IS NULL OR filename NOT IN (SELECT filename FROM gone WHERE filename IS NOT NULL)),
            l AS (SELECT * FROM links WHERE chunk_id IN (SELECT chunk_id FROM kept)), f AS (SELECT * FROM graph_facts WHERE fact_id IN (SELECT fact_id FROM l)),
            p AS (SELECT phrase_id FROM graph_phrases WHERE phrase_id IN (SELECT subject_id FROM f) OR phrase_id IN (SELECT object_id FROM f))
            SELECT 'chunks' AS kept, count(*) AS rows FROM kept
            UNION ALL SELECT 'summaries', count(DISTINCT filename) FROM chunks WHERE embedding IS NOT NULL AND filename NOT IN (SELECT filename FROM gone)
            UNION ALL SELECT 'files', count(*) FROM document_files WHERE filename NOT IN (SELECT filename FROM gone)
            UNION ALL SELECT 'facts', count(*) FROM f UNION ALL SELECT 'phrases', count(*) FROM p UNION ALL SELECT 'links', count(*) FROM l
            UNION ALL SELECT 'edges', count(*) FROM graph_edges WHERE phrase_a IN (SELECT phrase_id FROM p) AND phrase_b IN (SELECT phrase_id FROM p)
            UNION ALL SELECT 'deleted', count(*) FROM chunks WHERE filename IN (SELECT filename FROM gone)""",
        "list_documents": "SELECT filename, count(*) AS chunks FROM chunks WHERE starts_with(filename, 'Projects/') AND lower(filename) LIKE '%.pdf' GROUP BY filename",
        "list_documents_page": "SELECT filename, count(*) AS chunks FROM chunks WHERE filename ILIKE '%re_ort%p%' GROUP BY filename ORDER BY filename LIMIT 5 OFFSET 2",
        "list_documents_literal": "SELECT filename, count(*) AS chunks FROM chunks WHERE contains(lower(filename), 'team 100%') GROUP BY filename",
        "include_exclude": "SELECT filename, count(*) AS chunks FROM chunks WHERE filename ILIKE '%report%' AND NOT filename ILIKE '%draft%' AND NOT filename ILIKE '%inbox%' GROUP BY filename",
        "count_documents": "SELECT count(DISTINCT filename) AS documents FROM chunks",
        "list_folders": "SELECT split_part(filename, '/', 1) AS folder, count(DISTINCT filename) AS files FROM chunks WHERE contains(filename, '/') GROUP BY 1",
        "list_subfolders": "SELECT split_part(substr(filename, 10), '/', 1) AS folder, count(DISTINCT filename) AS files FROM chunks WHERE starts_with(filename, 'Projects/') AND contains(substr(filename, 10), '/') GROUP BY 1",
        "first_ingested": "SELECT filename, min(created_at) AT TIME ZONE 'UTC' AS first_at FROM document_files GROUP BY filename",
        "filtered_aggregates": """SELECT filename, count(*) FILTER (WHERE source_type = 'text') AS text_chunks, count(*) FILTER (WHERE source_type <> 'text') AS other_chunks,
            min(chunk_index) FILTER (WHERE source_type <> 'text') AS first_other_index, first(source_format ORDER BY chunk_index, chunk_id) AS format FROM chunks GROUP BY filename""",
        "next_index": "SELECT filename, coalesce(max(chunk_index), -1) + 1 AS next_index FROM chunks GROUP BY filename",
        "corpus_stamp": """SELECT (SELECT count(*) FROM graph_facts) AS facts_rows, (SELECT max(created_at) AT TIME ZONE 'UTC' FROM graph_facts) AS facts_latest,
            (SELECT count(*) FROM graph_phrases) AS phrases_rows, (SELECT max(created_at) AT TIME ZONE 'UTC' FROM graph_phrases) AS phrases_latest,
            (SELECT count(*) FROM graph_edges) AS edges_rows, CAST(NULL AS TIMESTAMP) AS edges_latest""",
        "pending_summaries": "SELECT DISTINCT filename FROM chunks WHERE filename NOT IN (SELECT filename FROM chunks WHERE source_format = 'pdf')",
        "pending_captions": "SELECT DISTINCT filename FROM document_files WHERE captioned_at IS NULL AND filename ILIKE '%report%' AND NOT filename ILIKE '%inbox%'",
        "format_backfill": r"""SELECT chunk_id, CASE WHEN k IN ('pdf', 'docx', 'pptx', 'xlsx', 'txt', 'md') THEN k ELSE 'pdf' END AS source_format
            FROM (SELECT chunk_id, lower(regexp_extract(filename, '\.([^./]*)$', 1)) AS k FROM chunks)""",
        "dedupe_rows": "SELECT min(chunk_id) AS chunk_id, count(*) AS copies FROM chunks GROUP BY filename, chunk_index, content",
        "duplicate_files": """WITH n AS (SELECT sha256, filename, min(created_at) AS first_at FROM document_files WHERE sha256 IS NOT NULL GROUP BY ALL)
            SELECT sha256, first(filename ORDER BY length(filename), first_at, filename) AS kept, count(*) AS names FROM n GROUP BY sha256 HAVING count(*) > 1""",
        "exact_hash": """WITH n AS (SELECT batch_no >= 6 AS fresh, filename, min(sha256) AS sha256 FROM document_files GROUP BY ALL), held AS (SELECT sha256, min(filename) AS old FROM n WHERE NOT fresh AND sha256 IS NOT NULL GROUP BY sha256),
            f AS (SELECT filename, sha256, min(filename) OVER (PARTITION BY sha256) AS first FROM n WHERE fresh AND sha256 IS NOT NULL)
            SELECT filename, coalesce(old, first) AS holder FROM f LEFT JOIN held USING (sha256) WHERE coalesce(old, first) <> filename""",
        "caption_cache": """SELECT file_id AS image_id, sha256, caption FROM document_files LEFT JOIN
            (SELECT sha256, max(filename) AS caption FROM document_files WHERE captioned_at IS NOT NULL GROUP BY sha256) USING (sha256)""",
        "stage_shares": "SELECT event_type AS stage, count(*) AS n, round(sum(value), 6) AS seconds, round(round(sum(value), 6) / sum(round(sum(value), 6)) OVER (), 6) AS share FROM events GROUP BY event_type",
        "normalise_text": f"SELECT chunk_id, {normal} AS normal FROM chunks",
        "normalise_phrase": r"""SELECT phrase_id, trim(regexp_replace(regexp_replace(lower(phrase), '[^\p{L}\p{M}\p{N}_ ]+', ' ', 'g'), ' +', ' ', 'g')) AS normal,
            length(regexp_replace(phrase, '[^\p{L}\p{N}_]', '', 'g')) AS characters FROM graph_phrases""",
        "passage_text": """SELECT chunk_id, 'Document: ' || list_last(string_split(filename, '/')) || coalesce(' (page ' || page_number || ')', '') ||
            CASE source_type WHEN 'image_caption' THEN ' [figure]' WHEN 'chart_data' THEN ' [chart]' ELSE '' END || chr(10) || content AS passage FROM chunks""",
        "token_estimate": f"SELECT doc_id, {TOKENS.format(c='text')} AS tokens FROM documents",
        "number_extraction": f"""WITH {_MESSAGES} SELECT message_id, len(regexp_extract_all(content, '(-?[0-9][0-9,]*(?:\\.[0-9]+)?|-?\\.[0-9]+)', 1)) AS figures
            FROM messages WHERE lower(trim(role)) IN ('assistant', 'bot') AND len(regexp_extract_all(content, '(-?[0-9][0-9,]*(?:\\.[0-9]+)?|-?\\.[0-9]+)', 1)) > 0""",
        "cited_sources": f"""WITH {_MESSAGES}, n AS (SELECT message_id, list_sort(list_distinct(list_transform(regexp_extract_all(content, '\\[([0-9]{{1,6}})\\]', 1), lambda x: CAST(x AS INTEGER)))) AS k
            FROM messages WHERE lower(trim(role)) IN ('assistant', 'bot') AND content IS NOT NULL)
            SELECT message_id, array_to_string(list_filter(k, lambda x: x BETWEEN 1 AND 4), ',') AS cited, array_to_string(list_filter(k, lambda x: x < 1 OR x > 4), ',') AS dangling FROM n WHERE len(k) > 0""",
        "fact_edges": f"""WITH {_LINKS} SELECT least(subject_id, object_id) AS phrase_a, greatest(subject_id, object_id) AS phrase_b, count(*) AS facts FROM links JOIN graph_facts USING (fact_id)
            WHERE subject_id IS NOT NULL AND object_id IS NOT NULL AND subject_id <> object_id GROUP BY 1, 2""",
        "passage_edges": f"WITH {_LINKS} SELECT chunk_id, phrase_id FROM stated",
        "graph_edges_weighted": f"WITH {_GRAPH} SELECT a, b, round(weight, 4) AS weight FROM edges",
        "synonym_edges": """WITH p AS (SELECT phrase_id, CAST(embedding AS DOUBLE[]) AS e FROM graph_phrases
                WHERE embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
            pairs AS (SELECT n.phrase_id AS a, o.phrase_id AS b, round(list_cosine_similarity(n.e, o.e), 9) AS s FROM p n, p o
                WHERE n.phrase_id <> o.phrase_id AND CAST('0x' || substr(n.phrase_id, 1, 12) AS BIGINT) % 50 = 0),
            kept AS (SELECT * FROM pairs WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 100)
            SELECT least(a, b) AS phrase_a, greatest(a, b) AS phrase_b, round(max(s), 6) AS weight FROM kept GROUP BY 1, 2""",
        "phrase_facts": "SELECT DISTINCT phrase_id, fact_id FROM graph_phrases JOIN graph_facts ON phrase_id = subject_id OR phrase_id = object_id",
        "orphan_phrases": """SELECT phrase_id, phrase FROM graph_phrases p WHERE NOT EXISTS (SELECT 1 FROM graph_facts WHERE subject_id = p.phrase_id)
            AND NOT EXISTS (SELECT 1 FROM graph_facts WHERE object_id = p.phrase_id)""",
        "usable_phrases": r"""SELECT phrase_id FROM graph_phrases WHERE length(regexp_replace(phrase, '[^\p{L}\p{N}_]', '', 'g')) > 2
            AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0""",
        "graph_totals": f"""WITH {_LINKS} SELECT (SELECT count(*) FROM graph_phrases) AS phrases, (SELECT count(*) FROM graph_facts) AS facts, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM graph_edges) AS edges,
            (SELECT count(*) FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM links)) AS extracted, (SELECT count(*) FROM chunks) AS chunks""",
        "fact_floor": f"WITH {_LINKS}, {_QUERIES}, {_SEEDS} SELECT query_id, round(low, 6) AS low FROM floors",
        "graph_search": _graph_search_sql(),
        "closest_facts": f"""WITH {_QUERIES}, f AS (SELECT fact_id, CAST(embedding AS DOUBLE[]) AS e FROM graph_facts JOIN graph_phrases ON phrase_id = subject_id WHERE embedding IS NOT NULL)
            SELECT query_id, fact_id, round(round(list_cosine_similarity(vec, e), 9), 6) AS similarity,
                CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vec, e), 9) DESC, fact_id) AS INTEGER) AS rank
            FROM q, f WHERE list_dot_product(e, e) > 0 QUALIFY rank <= 5""",
        "backfill_parents": f"""WITH {_MESSAGES} SELECT message_id, coalesce(parent_id, lag(message_id) OVER (PARTITION BY conversation_id ORDER BY created_at, message_id)) AS parent_id
            FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL""",
        "active_leaves": f"""WITH {_MESSAGES} SELECT conversation_id, message_id AS active_id FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, message_id DESC) = 1""",
        "conversation_path": f"""WITH RECURSIVE {_MESSAGES}, up AS (
            SELECT message_id AS leaf_id, message_id, parent_id, 0 AS depth FROM messages WHERE message_id % 50 = 0
            UNION ALL SELECT u.leaf_id, p.message_id, p.parent_id, u.depth + 1 FROM up u JOIN messages p ON p.message_id = u.parent_id WHERE u.parent_id <> u.message_id)
            SELECT leaf_id, message_id, min(depth) AS depth FROM up GROUP BY ALL""",
        "list_conversations": _PAGE.format(messages=_MESSAGES, condition="true"),
        "list_conversations_next": _PAGE.format(messages=_MESSAGES, condition="(page.updated_at, conversation_id) < (TIMESTAMPTZ '2025-06-01 00:00:00+00', 0)"),
        "search_conversations": _PAGE.format(messages=_MESSAGES, condition="conversation_id IN (SELECT conversation_id FROM asked WHERE contains(lower(content), 'backup schedule'))"),
        "replace_documents": """SELECT chunk_id, filename, chunk_index, content FROM chunks WHERE filename NOT IN (SELECT filename FROM chunks WHERE chunk_index = 0)
            UNION ALL SELECT 'n-' || chunk_id, filename, chunk_index, upper(content) FROM chunks WHERE chunk_index = 0""",
        "upsert_files": """SELECT filename, file_id, sha256, batch_no FROM document_files WHERE filename IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY filename ORDER BY batch_no >= 6 DESC, file_id DESC) = 1""",
        "assemble_calls": """SELECT user_id AS turn_id, 0 AS call_index, first(event_type ORDER BY event_id) AS call_id, first(event_type ORDER BY event_id) AS name,
            string_agg(CAST(event_id AS VARCHAR), '' ORDER BY event_id) AS arguments FROM events GROUP BY user_id""",
        "event_rates": """SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL""",
        "personalised_pagerank": _pagerank_sql(),
    }


def _walks(reset: str, rounds: int = 20) -> str:
    """The same rounds, unrolled, from ``reset`` (query_id, vertex, weight)."""
    head = f"""walked AS (SELECT * FROM edges WHERE weight > 0 AND a <> b),
        two AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM walked UNION ALL SELECT b, a, weight FROM walked),
        step AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM two),
        r0 AS MATERIALIZED (SELECT query_id, vertex, weight / sum(weight) OVER (PARTITION BY query_id) AS score FROM (SELECT query_id, vertex, sum(weight) AS weight FROM {reset} WHERE weight > 0 GROUP BY ALL))"""
    parts = [head]
    for i in range(rounds):
        parts.append(f"""m{i} AS MATERIALIZED (SELECT query_id, dst AS vertex, sum(score * share) * 0.5 AS score FROM r{i} JOIN step ON src = vertex GROUP BY ALL),
        g{i} AS MATERIALIZED (SELECT query_id, sum(score) AS moved FROM m{i} GROUP BY query_id),
        r{i + 1} AS MATERIALIZED (SELECT query_id, vertex, sum(score) AS score FROM (SELECT * FROM m{i} UNION ALL
            SELECT query_id, vertex, score * (1 - coalesce(moved, 0)) FROM r0 LEFT JOIN g{i} USING (query_id)) GROUP BY ALL)""")
    return f"{', '.join(parts)}, ranks AS (SELECT * FROM r{rounds})"


def _pagerank_sql() -> str:
    return f"WITH {_GRAPH}, {_QUERIES}, {_SEEDS}, {_walks('seeds')} SELECT query_id, vertex, round(score, 6) AS score FROM ranks WHERE round(score, 6) > 0"


def _graph_search_sql() -> str:
    return f"""WITH {_GRAPH}, {_QUERIES}, {_SEEDS}, seeded AS (SELECT DISTINCT query_id FROM seeds WHERE weight > 0),
        scaled AS (SELECT query_id, 'c:' || chunk_id AS vertex, 0.05 * CASE WHEN max(similarity) OVER w = min(similarity) OVER w THEN 1 ELSE (similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w) END AS weight
                   FROM sims WINDOW w AS (PARTITION BY query_id)),
        reset AS (SELECT * FROM seeds UNION ALL SELECT * FROM scaled WHERE query_id IN (SELECT query_id FROM seeded)), {_walks('reset')},
        found AS (SELECT query_id, substr(vertex, 3) AS chunk_id, round(score, 9) AS score FROM ranks WHERE starts_with(vertex, 'c:')
                  UNION ALL SELECT query_id, chunk_id, similarity FROM sims WHERE query_id NOT IN (SELECT query_id FROM seeded))
        SELECT query_id, chunk_id, round(found.score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY found.score DESC, chunk_id) AS INTEGER) AS rank FROM found
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY found.score DESC, chunk_id) <= 15"""
