"""The catalogue's results in SQL (DuckDB's dialect), for comparison."""

from __future__ import annotations

from siltstone.operators import chunking, prompting
from siltstone.plans import catalog

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
STRIP = rf"^{SPACE}+|{SPACE}+$"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '{SPACE}+'), lambda x: x <> '')"


def strip(expression: str) -> str:
    return f"regexp_replace({expression}, '{STRIP}', '', 'g')"


CHUNKS = "SELECT *, source AS company, lang AS section FROM documents"
QUESTIONS = "SELECT item_id AS query_id, text AS query, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id"

TERMS = f"""
docs AS ({CHUNKS}),
asked AS ({QUESTIONS}),
split AS MATERIALIZED (SELECT doc_id, company, section, {words('text')} AS words FROM docs),
stats AS (SELECT count(*) AS n_docs, avg(len(words)) AS avg_dl FROM split),
freqs AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS term FROM split) GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM freqs, stats),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""


def bm25(where: str = "true", k: int = 20, asked: str = "asked") -> str:
    """CTEs up to ``bm25(query_id, doc_id, score, rank)``."""
    base = TERMS.replace(f"docs AS ({CHUNKS})", f"docs AS ({CHUNKS} WHERE {where})")
    return f"""{base},
posts AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM split) GROUP BY ALL),
wanted AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({words('query')}) AS term FROM {asked}) GROUP BY ALL),
parts AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS score
  FROM wanted JOIN posts USING (term) JOIN idfs USING (term), stats GROUP BY ALL),
every AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT query_id FROM {asked}) CROSS JOIN (SELECT doc_id FROM docs) LEFT JOIN parts USING (query_id, doc_id)),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC)::INT AS rank FROM every) WHERE rank <= {k})"""


def vectors(k: int = 20) -> str:
    return f"""
pairs AS (SELECT query_id, v.vec_id AS doc_id, 1 - list_inner_product(v.embedding::DOUBLE[], a.embedding::DOUBLE[]) / (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))) AS score
  FROM asked a JOIN embeddings v ON a.embedding IS NOT NULL AND v.vec_id IN (SELECT vec_id FROM searched)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id)::INT AS rank FROM pairs) WHERE rank <= {k})"""


def channels(where: str | None = None, k: int = 20) -> str:
    searched = "searched AS (SELECT vec_id FROM embeddings)" if where is None else "searched AS (SELECT doc_id AS vec_id FROM docs)"
    return f"{bm25(where or 'true', k)},\n{searched},{vectors(k)}"


def fused(k: int, weights: tuple[str, str] = ("1.0", "1.0"), name: str = "fused") -> str:
    return f"""
{name}_pairs AS (SELECT query_id, doc_id, b.rank AS bm25_rank, b.score AS bm25_score, v.rank AS vector_rank, v.score AS vector_score,
    coalesce({weights[0]}::DOUBLE / (b.rank + 60), 0) + coalesce({weights[1]}::DOUBLE / (v.rank + 60), 0) AS rrf
  FROM bm25 b FULL JOIN near v USING (query_id, doc_id)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST)::INT AS rank FROM {name}_pairs) WHERE rank <= {k})"""


GOLD = """
held AS (SELECT query_id, min_by(d.company, d.doc_id) AS target_company, min_by(d.section, d.doc_id) AS target_section
  FROM asked JOIN docs d ON contains(d.text, query) GROUP BY query_id),
gold AS (SELECT query_id, target_company, target_section, CASE WHEN target_company IS NULL THEN 'retrieval-impossible' ELSE 'normal' END AS tag FROM asked LEFT JOIN held USING (query_id))"""


def evaluated(k: int = 20) -> str:
    firsts = ",\n".join(
        f"first_{n} AS (SELECT query_id, min(rank)::INT AS r FROM {t} JOIN docs USING (doc_id) JOIN gold USING (query_id) WHERE company = target_company AND section = target_section GROUP BY query_id)"
        for n, t in (("bm25", "bm25"), ("vector", "near"), ("fused", "fused"))
    )
    columns = ", ".join(f"{n}.r AS rank_{n}, CASE WHEN {n}.r <= 5 THEN 1 ELSE 0 END AS hit_{n}" for n in ("bm25", "vector", "fused"))
    joins = " ".join(f"LEFT JOIN first_{n} {n} USING (query_id)" for n in ("bm25", "vector", "fused"))
    return f"{channels(k=k)},{fused(max(5, k))},{GOLD},\n{firsts},\nresults AS (SELECT query_id, target_company, target_section, tag, {columns} FROM gold {joins})"


MEAN = "coalesce(round(avg({x}), 4), 0.0::DOUBLE)"
SENTENCES = rf"""
safe AS (SELECT *, {{protected}} AS safe FROM ({CHUNKS})),
cut AS (SELECT *, string_split(regexp_replace(regexp_replace(safe, '([.!?]){SPACE}+([A-Z])', '\1' || chr(30) || '\2', 'g'), '\n\n+', chr(10) || chr(30), 'g'), chr(30)) AS raw FROM safe),
sentences AS (SELECT *, list_filter(list_transform(raw, lambda x: {strip("replace(x, '__DOT__', '.')")}), lambda x: x <> '') AS ss FROM cut)"""


def _protected() -> str:
    out = "text"
    for a in chunking.ABBREVIATIONS:
        out = f"replace({out}, '{a}', '{a.replace('.', '__DOT__')}')"
    return out


SENTENCES = SENTENCES.replace("{protected}", _protected())
FLUSH = f"(CASE WHEN length({strip(chr(123) + '0' + chr(125))}) >= 100 THEN [{strip(chr(123) + '0' + chr(125))}] ELSE []::VARCHAR[] END)"


def flush(cur: str) -> str:
    return FLUSH.replace("{0}", f"array_to_string({cur}, ' ')")


def windows(x: str) -> str:
    return f"list_filter(list_transform(range(0, length({x}), 650), lambda i: {strip(f'substring({x}, (i + 1)::INT, 800)')}), lambda w: length(w) >= 100)"


CHUNKED = f"""{SENTENCES},
fold(doc_id, company, section, ss, i, done, cur, used) AS (
  SELECT doc_id, company, section, ss, 0, []::VARCHAR[], []::VARCHAR[], 0::BIGINT FROM sentences
  UNION ALL
  SELECT doc_id, company, section, ss, i + 1,
    CASE WHEN n > 800 THEN done || (CASE WHEN len(cur) > 0 THEN {flush('cur')} ELSE []::VARCHAR[] END) || {windows('s')} WHEN used + n + 1 > 800 AND len(cur) > 0 THEN done || {flush('cur')} ELSE done END,
    CASE WHEN n > 800 THEN []::VARCHAR[] WHEN used + n + 1 > 800 AND len(cur) > 0 THEN
      list_transform(list_filter(range(1, len(cur) + 1), lambda k: list_sum(list_transform(cur[k:], lambda y: length(y) + 1)) <= 150), lambda k: cur[k]) || [s] ELSE cur || [s] END,
    CASE WHEN n > 800 THEN 0 WHEN used + n + 1 > 800 AND len(cur) > 0 THEN 150 + n + 1 ELSE used + n + 1 END
  FROM (SELECT *, ss[i + 1] AS s, length(ss[i + 1]) AS n FROM fold WHERE i < len(ss))),
packed AS (SELECT doc_id, company, section, done || {flush('cur')} AS chunks FROM fold WHERE i = len(ss)),
chunked AS (SELECT doc_id, company, section, len(chunks)::INT AS total_chunks, (k - 1)::INT AS chunk_index, chunks[k] AS text FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS k FROM packed))"""

HTML = "html"
for _pattern, _new, _flags in (
    ("<!--.*?-->", " ", "gs"), ("<![^>]*>", " ", "g"), (r"<script\b.*?</script\s*>", " ", "gsi"), (r"<style\b.*?</style\s*>", " ", "gsi"), (r"<table\b.*?</table\s*>", " ", "gsi"),
    (r"<(p|div|br|tr)(\s[^>]*)?/?>", " \n ", "gi"), (r"</?[a-zA-Z][^>]*>", " ", "g"),
):
    HTML = f"regexp_replace({HTML}, '{_pattern}', '{_new}', '{_flags}')"
for _entity, _new in (("&nbsp;", "\xa0"), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_entity}', '{_new}')"
HTML = strip(rf"regexp_replace(regexp_replace(regexp_replace({HTML}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' \n', chr(10), 'g')")

#: The sections of the catalogue; their patterns run on a linear-time engine too.
SECTION_PATTERNS = [(x.name, x.patterns, x.limit) for x in catalog.WORD_SECTIONS]


def _start(patterns: tuple[str, ...]) -> str:
    wide = lambda p: p.replace(r"\s", SPACE)
    each = [f"CASE WHEN regexp_matches(rest, '(?s){wide(p)}') THEN length(regexp_extract(rest, '(?s)^(.*?)(?:{wide(p)})', 1)) END" for p in patterns]
    return f"(least({', '.join(each)}) + skip)::INT"


SECTIONS = f"""
rests AS (SELECT doc_id, text, (length(text) // 20)::INT AS skip, substring(lower(text), (length(text) // 20)::INT + 1) AS rest FROM documents),
starts AS (SELECT doc_id, text, {', '.join(f'{_start(p)} AS s{i}' for i, (_, p, _) in enumerate(SECTION_PATTERNS))} FROM rests),
rows_ AS ({' UNION ALL '.join(f"SELECT doc_id, text, {i} AS section_no, '{n}' AS section, s{i} AS start, {limit} AS most FROM starts WHERE s{i} IS NOT NULL" for i, (n, _, limit) in enumerate(SECTION_PATTERNS))}),
kept AS (SELECT * FROM (SELECT *, max(start) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rows_) WHERE before IS NULL OR start > before),
bounds AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY section_no), length(text))::INT AS stop FROM kept),
bodies AS (SELECT doc_id, section_no, section, body FROM (SELECT *, {strip('substring(text, start + 1, least(stop - start, most))')} AS body FROM bounds) WHERE length(body) > 200)"""

ANY_ITEM = rf"\n{SPACE}*item{SPACE}+[0-9]+[a-c]?\b"

INDEXED = "indexed AS (SELECT doc_id, source AS company, lang AS section, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1)::INT AS chunk_index FROM documents)"
CONTEXT = r"""
blocks AS (SELECT query_id, rank, regexp_replace('[' || rank || '] ' || coalesce(company, 'Unkown') || ' — ' || coalesce(section, ''), '[ —]+$', '') || chr(10) || coalesce(text, '') AS block FROM bm25 JOIN docs USING (doc_id)),
contexts AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY query_id)"""
ONE_VECTOR = "sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))"

SQL = {
    "tokenize_counts": f"SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct FROM (SELECT doc_id, {words('text')} AS w FROM documents)",
    "term_stats": f"WITH {TERMS} SELECT term, df, round(idf, 6) + 0 AS idf FROM idfs",
    "corpus_stats": f"WITH {TERMS} SELECT n_docs, round(avg_dl, 6) AS avg_dl FROM stats",
    "bm25_topk": f"WITH one AS (SELECT 0::BIGINT AS query_id, '{catalog.QUESTION}' AS query), {bm25(asked='one')} SELECT query_id, doc_id, round(score, 6) + 0 AS score, rank FROM bm25",
    "bm25_batch_topk": f"WITH {bm25()} SELECT query_id, doc_id, round(score, 6) + 0 AS score, rank FROM bm25",
    "metadata_lookup": f"WITH {bm25(k=5)} SELECT query_id, doc_id, rank, company, section FROM bm25 JOIN docs USING (doc_id)",
    "l2_normalize": f"SELECT vec_id, len(embedding)::INT AS dim, round({ONE_VECTOR}, 6) AS norm, 1.0::DOUBLE AS unit_norm, round(embedding[1]::DOUBLE / {ONE_VECTOR}, 6) + 0 AS first FROM embeddings",
    "vector_topk": f"WITH asked AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id = 0), searched AS (SELECT vec_id FROM embeddings), {vectors()} SELECT doc_id, round(score, 6) + 0 AS score FROM near",
    "vector_batch_topk": f"WITH asked AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0), searched AS (SELECT vec_id FROM embeddings), {vectors()} SELECT query_id, doc_id, round(score, 6) + 0 AS score, rank FROM near",
    "ivf_lists": "SELECT count(*) AS n, greatest(16, count(*) // 1000)::BIGINT AS lists FROM embeddings",
    "rrf_fuse": f"""WITH {channels()},
lists AS (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM near),
summed AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (rank + 60)) AS rrf, min(rank) AS best FROM lists GROUP BY ALL)
SELECT query_id, doc_id, rank, round(rrf, 6) AS rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best, doc_id)::INT AS rank FROM summed) WHERE rank <= 20""",
    "hybrid_search": f"WITH {channels()},{fused(5)} SELECT query_id, doc_id, rank, round(rrf, 6) AS rrf_score, round(coalesce(bm25_score, vector_score), 6) + 0 AS score, bm25_rank, vector_rank, company, section FROM fused LEFT JOIN docs USING (doc_id)",
    "weighted_rrf": f"WITH {channels(k=30)},{fused(5, ('0.3', '0.7'))} SELECT query_id, doc_id, rank, round(rrf, 6) AS rrf_score, bm25_rank, vector_rank FROM fused",
    "normalized_score_fusion": f"""WITH {channels()},{fused(40)},
scaled AS (SELECT *, min(bm25_score) OVER q AS bl, max(bm25_score) OVER q AS bh, min(vector_score) OVER q AS vl, max(vector_score) OVER q AS vh FROM fused_pairs WINDOW q AS (PARTITION BY query_id)),
mixed AS (SELECT *, round(0.5::DOUBLE * coalesce(CASE WHEN bh > bl THEN (bm25_score - bl) / (bh - bl) WHEN bm25_score IS NOT NULL THEN 1.0 END, 0.0)
  + 0.5::DOUBLE * coalesce(CASE WHEN vh > vl THEN (vh - vector_score) / (vh - vl) WHEN vector_score IS NOT NULL THEN 1.0 END, 0.0), 9) AS score FROM scaled)
SELECT query_id, doc_id, rank, round(score, 6) AS fused_score, bm25_rank, vector_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST)::INT AS rank FROM mixed) WHERE rank <= 5""",
    "filtered_search": f"""WITH {channels("lang = 'en'")},{fused(5)} SELECT query_id, doc_id, rank, round(rrf, 6) AS rrf_score, bm25_rank, vector_rank FROM fused""",
    "first_hit_rank": f"WITH {evaluated()} SELECT * FROM results",
    "hit_at_k_summary": f"WITH {evaluated()} SELECT count(*) AS n_total, count(*) FILTER (WHERE tag = 'normal') AS n_normal, count(*) FILTER (WHERE tag <> 'normal') AS n_impossible, "
    + ", ".join(MEAN.format(x=f"CASE WHEN {w} THEN hit_{c} END") + f" AS {p}_{c}" for p, w in (("normal", "tag = 'normal'"), ("impossible", "tag <> 'normal'"), ("all", "true")) for c in ("bm25", "vector", "fused"))
    + " FROM results",
    "hit_at_k_by_tag": f"WITH {evaluated()} SELECT tag, count(*) AS n, " + ", ".join(MEAN.format(x=f"hit_{c}") + f" AS {c}" for c in ("bm25", "vector", "fused")) + " FROM results GROUP BY ROLLUP (tag)",
    "generic_chunk_fp_rate": f"""WITH {channels()},{fused(5)},{GOLD},
shown AS (SELECT doc_id, company, section, count(*) FILTER (WHERE NOT coalesce(company = target_company AND section = target_section, false)) AS wrong
  FROM fused JOIN docs USING (doc_id) JOIN gold USING (query_id) GROUP BY ALL),
rated AS (SELECT doc_id, wrong, (SELECT count(*) FROM gold) - (SELECT count(*) FROM gold WHERE target_company = company AND target_section = section) AS others FROM shown)
SELECT doc_id, wrong, others, coalesce(round(wrong / nullif(others, 0)::DOUBLE, 6), 0) AS fp_rate FROM rated""",
    "channel_diagnostic": f"""WITH {channels()},{fused(20)},{GOLD},
lists AS (SELECT 'bm25' AS channel, query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'vector', query_id, doc_id, rank FROM near UNION ALL SELECT 'fused', query_id, doc_id, rank FROM fused)
SELECT query_id, channel, count(*) AS results, coalesce(list(rank ORDER BY rank) FILTER (WHERE company = target_company AND section = target_section), []) AS target_ranks
FROM lists JOIN docs USING (doc_id) JOIN gold USING (query_id) GROUP BY ALL""",
    "config_comparison": f"SELECT query_id, {', '.join(f'a.rank_{c} AS before_{c}, b.rank_{c} AS after_{c}, b.hit_{c} - a.hit_{c} AS change_{c}' for c in ('bm25', 'vector', 'fused'))} FROM (WITH {evaluated(5)} SELECT * FROM results) a FULL JOIN (WITH {evaluated(20)} SELECT * FROM results) b USING (query_id)",
    "section_counts": "SELECT source AS company, lang AS section, count(*) AS n FROM documents GROUP BY ALL",
    "section_rollup": "SELECT source AS company, lang AS section, count(*) AS total_chunks FROM documents GROUP BY ROLLUP (source, lang)",
    "target_samples": "SELECT company, section, doc_id, sample, place, n FROM (SELECT source AS company, lang AS section, doc_id, left(text, 220) AS sample, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::INT AS place, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) WHERE place <= 2",
    "tail_samples": f"WITH {INDEXED} SELECT doc_id, company, section, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY company, section ORDER BY chunk_index DESC) AS place FROM indexed) WHERE place <= 3",
    "ilike_bounds": f"WITH {INDEXED} SELECT company, min(chunk_index) AS first_index, max(chunk_index) + 1 AS total FROM indexed WHERE doc_id IN (SELECT doc_id FROM documents WHERE text ILIKE '%THE OF%') GROUP BY company",
    "preview": "SELECT doc_id, replace(left(text, 300), chr(10), ' ') AS preview FROM documents",
    "safe_name": "SELECT c_custkey, replace(replace(replace(lower(c_name || ' (Ltd)'), ' ', '_'), '(', ''), ')', '') AS slug FROM customer",
    "html_to_text": f"SELECT page_id, {HTML} AS text FROM pages",
    "html_detect": "SELECT id, kind, regexp_matches(lower(raw), '<html|<body|<div') AS is_html, length(raw) > 10000 AS usable FROM (SELECT page_id AS id, 'page' AS kind, html AS raw FROM pages UNION ALL SELECT doc_id, 'document', text FROM documents)",
    "page_links": """WITH raw AS (SELECT page_id, html || CASE WHEN page_id % 2 = 0 THEN '<a HREF="/p' || page_id || '.html">p</a>' ELSE '' END || '<a href="/t' || page_id || '.txt">t</a>' AS html FROM pages)
SELECT page_id, (k - 1)::INT AS place, found[k] AS link FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (SELECT page_id, CASE WHEN len(a) > 0 THEN a ELSE b END AS found FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]+\\.html?)"', 1) AS a, regexp_extract_all(html, '(?i)href="([^"]+\\.txt)"', 1) AS b FROM raw)))""",
    "section_bounds": f'WITH {SECTIONS} SELECT doc_id, section_no, section, start, stop AS "end" FROM bounds',
    "section_bounds_any_item": f"""WITH documents AS (SELECT doc_id, replace(text, ' and ', chr(10) || ' item 7a and ') AS text FROM main.documents), {SECTIONS},
inner_ AS (SELECT *, lower(substring(text, start + 2, stop - start - 1)) AS inside FROM bounds)
SELECT doc_id, section_no, section, start, (CASE WHEN regexp_matches(inside, '{ANY_ITEM}') THEN start + 1 + length(regexp_extract(inside, '(?s)^(.*?)(?:{ANY_ITEM})', 1)) ELSE stop END)::INT AS "end" FROM inner_""",
    "page_headers": """SELECT doc_id, regexp_replace('Table of Contents' || chr(10) || replace(text, '. ', '.' || chr(10) || '  12 ' || chr(10)), '(?im)^[ \\t]*(table of contents|[0-9]{1,4})[ \\t]*\\n', '', 'g') AS text FROM documents""",
    "section_extract": f"WITH {SECTIONS} SELECT * FROM bodies",
    "filing_summary": f"WITH {SECTIONS} SELECT doc_id, list(section ORDER BY section_no) AS sections_found, sum(length(body))::BIGINT AS total_chars FROM bodies GROUP BY doc_id",
    "sentence_split": f"WITH {SENTENCES} SELECT doc_id, (k - 1)::INT AS place, ss[k] AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS k FROM sentences)",
    "hard_split_windows": f"SELECT doc_id, (k - 1)::INT AS place, w[k] AS piece FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, {windows('text')} AS w FROM documents))",
    "chunk_pack": f"WITH RECURSIVE {CHUNKED} SELECT sha256(concat_ws('|', company, section, doc_id, chunk_index, text)) AS chunk_id, company, section, doc_id, chunk_index, total_chunks, text, length(text)::INT AS char_count FROM chunked",
    "chunk_stats": f"WITH RECURSIVE {CHUNKED} SELECT company, section, count(*) AS total_chunks FROM chunked GROUP BY ROLLUP (company, section)",
    "chunk_stats_by_company": f"WITH RECURSIVE {CHUNKED} SELECT company, sum(n)::BIGINT AS total_chunks, '{{' || string_agg('\"' || section || '\":' || n, ',' ORDER BY section) || '}}' AS by_section FROM (SELECT company, section, count(*) AS n FROM chunked GROUP BY ALL) GROUP BY company",
    "latest_filing": "SELECT * FROM (VALUES ('Alpha Co', '0000019617', '0001-24-7', '0001247', '2024-02-01', 'c.htm', 'https://www.sec.gov/Archives/edgar/full-indexdata/19617/0001247/c.htm'), ('Gamma (X)', '12345678901', '7-7-7', '777', '2022-03-03', 'g.htm', 'https://www.sec.gov/Archives/edgar/full-indexdata/12345678901/777/g.htm')) t(company, cik, accession_number, accession_flat, filing_date, primary_doc, doc_url)",
    "manifest_parse": f"SELECT 'Site ' || page_id AS company, '2024' AS filing_date, 'raw/site_' || page_id || '.html' AS source_file, {HTML} AS text FROM pages WHERE page_id - 3 IN (SELECT page_id FROM pages)",
    "upsert_chunks": """WITH docs AS (SELECT doc_id, doc_id::VARCHAR AS chunk_id, source AS company, lang AS section, text FROM documents),
new AS (SELECT chunk_id, company, 'moved' AS section, 'new ' || text AS text FROM docs WHERE doc_id % 3 = 0 OR doc_id % 5 = 0),
old AS (SELECT chunk_id, company, section, text FROM docs WHERE doc_id % 5 <> 0)
SELECT chunk_id, coalesce(o.company, n.company) AS company, CASE WHEN o.chunk_id IS NULL THEN n.section ELSE o.section END AS section, coalesce(n.text, o.text) AS text FROM old o FULL JOIN new n USING (chunk_id)""",
    "json_round_trip": "SELECT source AS company, count(*) AS chunks, sum(length(text))::BIGINT AS characters, count(*) AS in_own_file FROM documents GROUP BY source",
    "context_format": f"WITH {bm25(k=3)},{CONTEXT} SELECT query_id, context FROM contexts",
    "prompt_assembly": f"WITH {bm25(k=2)},{CONTEXT}, prompts AS (SELECT query_id, {text(prompting.INSTRUCTION)} || chr(10) || chr(10) || 'Context from SEC 10-K filings:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Answer:' AS p FROM contexts JOIN asked USING (query_id)) SELECT query_id, sha256(p) AS prompt_sha256, length(p)::INT AS prompt_chars FROM prompts",
    "valid_questions": "SELECT conv_id, turn, coalesce(length(text) BETWEEN 1 AND 2000, false) AS valid FROM conversations WHERE role = 'user'",
    "ask_projection": f"WITH {channels()},{fused(5)}, {INDEXED} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1)::INT AS place, doc_id::VARCHAR AS chunk_id, i.company, i.section, chunk_index, round(rrf, 6) AS rrf_score FROM fused JOIN indexed i USING (doc_id)",
}
SQL["ivf_all_probes_topk"] = SQL["vector_batch_topk"]
