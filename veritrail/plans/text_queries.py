"""Queries over documents, pages and benchmark, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import ids, text
from veritrail.operators import pages, search, segments
from veritrail.operators.index import SearchIndex
from veritrail.sources.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _segs(spark: SparkSession, d: str) -> DataFrame:
    return segments.segments(table(spark, d, "documents"))


_INDEXES: dict[tuple[str, ...], SearchIndex] = {}


def index(spark: SparkSession, d: str) -> SearchIndex:
    """The stored index over the documents' segments: built by an application's first query that asks for it."""
    documents = table(spark, d, "documents")
    key = (spark.sparkContext.applicationId, *sorted(documents.inputFiles()))
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex.build(segments.segments(documents), fresh_path(spark, "search-index"))
    return _INDEXES[key]


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


SEG = "seg AS (SELECT doc_id, unnest(range(len(l))) AS seq, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_FOLD = "strip_accents(replace(replace(replace(lower(text), 'ß', 'ss'), 'º', 'o'), 'ª', 'a'))"
_TOK = rf"regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+')"
_BM25 = rf"""{SEG}, tok AS (SELECT doc_id, seq, {_TOK} AS t FROM seg), corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
q0 AS (SELECT item_id AS query_id, u.term AS term, u.pos AS pos FROM benchmark, LATERAL (SELECT unnest(x) AS term, unnest(range(len(x))) AS pos FROM (SELECT {_TOK}[:64] AS x)) u),
q1 AS (SELECT query_id, term, min(pos) AS pos FROM q0 WHERE regexp_full_match(term, '[0-9]+') OR length(term) >= 3 GROUP BY ALL),
q AS (SELECT query_id, term FROM q1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 18),
post AS (SELECT doc_id, seq, len(t) AS length, term, count(*) AS tf FROM (SELECT doc_id, seq, t, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT query_id, doc_id, seq, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS terms FROM post JOIN q USING (term) JOIN df USING (term), corpus GROUP BY query_id, doc_id, seq)"""

_SIG = f"(regexp_full_match({{0}}, '[0-9]+') OR (length({{0}}) >= 3 AND {{0}} NOT IN {text.STOPWORDS}))"
_OTHER = "CASE WHEN regexp_full_match({0}, '[0-9]+') OR length({0}) < 4 THEN {0} WHEN length({0}) > 4 AND ends_with({0}, 'es') THEN {0}[:-3] WHEN length({0}) > 4 AND ends_with({0}, 's') THEN {0}[:-2] WHEN regexp_matches({0}, '[aeiou]$') THEN {0} || 's' ELSE {0} || 'es' END"
_VARIANTS = f"list_distinct([{{0}}, {_OTHER}])"
_THEMATIC = rf"""WITH {SEG}, tok AS (SELECT doc_id, seq, text, {_TOK} AS t FROM seg), corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok), qt AS (SELECT item_id AS query_id, {_TOK}[:64] AS t FROM benchmark),
qs AS (SELECT query_id, term, pos FROM (SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM qt) WHERE {_SIG.format('term')}),
g AS (SELECT query_id, term, {_VARIANTS.format('term')} AS vars FROM (SELECT query_id, term, min(pos) AS first FROM qs GROUP BY query_id, term QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first) <= 18)),
w0 AS (SELECT query_id, pos, lead(pos) OVER (PARTITION BY query_id ORDER BY pos) AS b FROM qs), w1 AS (SELECT query_id, list_slice(t, pos + 1, b + 1) AS raw, min(pos) AS first FROM w0 JOIN qt USING (query_id) WHERE b - pos <= 4 GROUP BY query_id, list_slice(t, pos + 1, b + 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first) <= 12),
w AS (SELECT query_id, raw, {_VARIANTS.format('raw[1]')} AS lv, {_VARIANTS.format('raw[-1]')} AS rv FROM w1), wl AS (SELECT query_id, list({{'l': lv, 'r': rv, 'raw': raw}}) AS ws FROM w GROUP BY query_id), gl AS (SELECT query_id, list({{'term': term, 'vars': vars}}) AS gs FROM g GROUP BY query_id),
q AS (SELECT DISTINCT query_id, unnest(vars) AS term FROM g), post AS (SELECT doc_id, seq, len(t) AS length, term, count(*) AS tf, bool_or(pos < 512) AS early FROM (SELECT doc_id, seq, t, unnest(t) AS term, unnest(range(len(t))) AS pos FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT query_id, doc_id, seq, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, list(term) FILTER (early) AS matched FROM post JOIN q USING (term) JOIN df USING (term), corpus GROUP BY query_id, doc_id, seq),
own AS (SELECT s.*, tok.text, tok.t, coalesce(ws, []) AS ws, gs FROM scored s JOIN tok USING (doc_id, seq) JOIN gl USING (query_id) LEFT JOIN wl USING (query_id)),
st AS (SELECT *, CASE WHEN len(list_filter(ws, lambda x: contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(x.raw, ' ') || ' '))) > 0 AND len(list_filter(ws, lambda x: list_has_any(matched, list_filter(x.raw, lambda y: {_SIG.format('y')})))) > 0 THEN 0 WHEN len(list_filter(ws, lambda x: list_has_any(matched, x.l) AND list_has_any(matched, x.r))) > 0 THEN 1 WHEN len(matched) > 0 THEN 2 END AS stage FROM own),
one AS (SELECT * FROM st WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, text ORDER BY stage, score DESC, seq) = 1), p0 AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query_id, stage ORDER BY score DESC, doc_id, seq) <= 20), pool AS (SELECT * FROM (SELECT *, count(*) FILTER (stage < 2) OVER (PARTITION BY query_id) AS filled FROM p0) WHERE stage < 2 OR filled < 10),
f AS (SELECT *, list_filter(t, lambda y: {_SIG.format('y')}) AS s FROM pool), r AS (SELECT query_id, doc_id, seq, stage, score, len(list_filter(ws, lambda x: len(list_filter(range(1, len(s)), lambda i: list_contains(x.l, s[i]) AND list_contains(x.r, s[i + 1]))) > 0)) AS concepts, len(list_filter(gs, lambda x: list_has_any(t, x.vars))) AS found, len(list_filter(gs, lambda x: regexp_full_match(x.term, '[0-9]+') AND list_contains(t, x.term))) AS numbers FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY concepts DESC, found DESC, numbers DESC, stage, score DESC, doc_id, seq) AS rank FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS c FROM k)
SELECT query_id, doc_id, CAST(seq AS INT) AS seq, CAST(stage AS BIGINT) AS stage, CAST(concepts AS BIGINT) AS concepts, CAST(found AS BIGINT) AS found, row_number() OVER (PARTITION BY query_id ORDER BY c > 1, rank) AS place FROM n QUALIFY place <= 10"""


def q_segments(spark, d):
    out = segments.offsets(_segs(spark, d))
    return out.select("doc_id", "seq", "char_start", F.col("char_end").cast("long").alias("char_end"), "text_sha256")


def q_segment_types(spark, d):
    return segments.classify(_segs(spark, d)).groupBy("segment_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


_TYPE = r"""CASE WHEN contains(text, ' | ') THEN 'table_row' WHEN regexp_matches(text, '^[0-9]+[.)] ') THEN 'numeral'
 WHEN length(text) <= 120 AND regexp_matches(text, '\p{L}') AND length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) >= 0.8 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) THEN 'structural_heading'
 WHEN length(text) <= 60 AND NOT regexp_matches(text, '[.;:]$') THEN 'section_heading' WHEN regexp_matches(text, '^\s*$') THEN 'text' ELSE 'paragraph' END"""


def q_carry_section(spark, d):
    out = segments.carry_section(segments.classify(_segs(spark, d)))
    return out.select("doc_id", "seq", "segment_type", F.sha2("section_path", 256).alias("section_sha"))


def q_consecutive_duplicates(spark, d):
    return segments.drop_consecutive(_segs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


def q_repeat_groups(spark, d):
    out = segments.repeat_groups(_segs(spark, d)).where("copies > 1")
    return out.select("doc_id", "text_sha256", "first_seq", "copies", F.array_join(F.transform("other_seqs", lambda x: x.cast("string")), ",").alias("other_seqs"))


def q_postings_stats(spark, d):
    return index(spark, d).statistics()


def q_bm25_topk(spark, d):
    out = search.best(search.bm25(index(spark, d), _questions(spark, d), k=10), 10)
    return out.select("query_id", "doc_id", "seq", F.round(F.col("score") * 1e4).cast("long").alias("score_e4"), "terms", F.col("rank").cast("long").alias("rank"))


def q_diversified_topk(spark, d):
    out = search.diversify(search.best(search.collapsed(index(spark, d), _questions(spark, d)), 40), 10)
    return out.select("query_id", "doc_id", "seq", "copies", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


def q_staged_search(spark, d):
    out = search.staged(index(spark, d), _questions(spark, d), 10)
    return out.select("query_id", "doc_id", "seq", F.col("stage").cast("long").alias("stage"), F.col("rank").cast("long").alias("rank"))


def q_exact_support(spark, d):
    return search.exact_support(table(spark, d, "documents"), table(spark, d, "benchmark"))


def q_concept_windows(spark, d):
    """Adjacent significant terms of every segment with at most three fillers between them."""
    return search.concept_windows(_segs(spark, d)).select("doc_id", "seq", "pos", "term", "next_term")


def q_thematic_search(spark, d):
    """Staged retrieval for the benchmark's questions: phrases, variants, then any term."""
    out = search.thematic(index(spark, d), _questions(spark, d), 10)
    return out.select("query_id", "doc_id", "seq", F.col("stage").cast("long").alias("stage"), F.col("concepts").cast("long").alias("concepts"), F.col("found").cast("long").alias("found"), F.col("place").cast("long").alias("place"))


def q_uppercase_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.uppercase_ratio(F.col("text")) * 1e6).cast("long").alias("ratio_e6"))


def q_unique_offset(spark, d):
    quote = F.substring("text", 11, 12)
    return table(spark, d, "documents").select("doc_id", text.only_offset(F.col("text"), quote).cast("long").alias("at"))


def q_page_links(spark, d):
    return pages.links(table(spark, d, "pages"))


def q_page_states(spark, d):
    return pages.classify(table(spark, d, "pages"))


def q_url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", pages.canonical_url(F.col("url")).alias("canonical"), pages.extension(F.col("url")).alias("extension"), pages.host_allowed(F.col("url"), ["example.com", "example.net"]).alias("allowed"))


def q_corpus_digest(spark, d):
    """Order-sensitive digests over runs of a thousand ids: each run is bounded, so nothing large is gathered."""
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    runs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 1000).alias("run"), "doc_id", line.alias("line"))
    return runs.groupBy("run").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), ""), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def q_raw_addresses(spark, d):
    """Content addresses of raw pages and how many pages share them."""
    raw = table(spark, d, "pages").select(F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("byte_size"))
    return raw.groupBy("sha256", "byte_size").agg(F.count(F.lit(1)).alias("pages")).withColumn("path", F.concat(F.lit("raw/sha256/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256"))


def q_document_ids(spark, d):
    """Deterministic ids of documents (version-5 UUIDs) and stable references from canonical JSON."""
    docs = table(spark, d, "documents")
    ref = ids.stable_ref("doc", ids.canonical_json(doc_id=F.col("doc_id"), source=F.col("source")))
    return docs.select("doc_id", F.sha1(F.concat(F.lit("veritrail:"), F.col("doc_id").cast("string"))).alias("material_sha1"), ref.alias("ref"))


def q_page_uuid(spark, d):
    return table(spark, d, "pages").select("page_id", ids.prefixed_id("SRC", F.lit("page"), F.col("url")).alias("source_id"))


def q_same_language_runs(spark, d):
    return segments.same_value_runs(table(spark, d, "documents").select("source", "doc_id", "lang").withColumn("doc_id", F.col("doc_id")), "source", "doc_id", "lang").select("source", F.col("run").cast("long").alias("run"), "lang", "first", "last", "n")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

ORACLES = {
    "segments": f"WITH {SEG} SELECT doc_id, CAST(seq AS INT) AS seq, CAST(coalesce(sum(length(text) + 2) OVER w, 0) AS BIGINT) AS char_start, CAST(coalesce(sum(length(text) + 2) OVER w, 0) + length(text) AS BIGINT) AS char_end, sha256(text) AS text_sha256 FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "segment_types": f"WITH {SEG} SELECT {_TYPE} AS segment_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM seg GROUP BY 1",
    "carry_section": f"WITH {SEG}, t AS (SELECT *, {_TYPE} AS segment_type FROM seg) SELECT doc_id, CAST(seq AS INT) AS seq, segment_type, sha256(last_value(CASE WHEN segment_type IN ('structural_heading', 'section_heading') THEN left(text, 500) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS section_sha FROM t",
    "consecutive_duplicates": f"WITH {SEG} SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, text, lag(text) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM seg) WHERE b IS NULL OR b <> text GROUP BY doc_id",
    "repeat_groups": f"WITH {SEG} SELECT doc_id, sha256(text) AS text_sha256, CAST(min(seq) AS INT) AS first_seq, count(*) AS copies, array_to_string(list_sort(list(seq))[2:], ',') AS other_seqs FROM seg GROUP BY doc_id, text HAVING count(*) > 1",
    "postings_stats": f"WITH {SEG}, tok AS (SELECT doc_id, seq, unnest({_TOK}) AS term FROM seg), p AS (SELECT term, doc_id, seq, count(*) AS tf FROM tok GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, CAST(seq AS INT) AS seq, CAST(round(score * 1e4) AS BIGINT) AS score_e4, terms, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, seq) AS rank FROM scored QUALIFY rank <= 10",
    "diversified_topk": f"""WITH {_BM25}, one AS (SELECT s.*, count(*) OVER (PARTITION BY query_id, doc_id, text) AS copies, row_number() OVER (PARTITION BY query_id, doc_id, text ORDER BY s.seq) AS r FROM scored s JOIN seg g USING (doc_id, seq)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, seq) AS rank FROM one WHERE r = 1 QUALIFY rank <= 40), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS k FROM b)
SELECT query_id, doc_id, CAST(seq AS INT) AS seq, copies, rank, row_number() OVER (PARTITION BY query_id ORDER BY k > 1, rank) AS place FROM n QUALIFY place <= 10""",
    "staged_search": rf"""WITH {_BM25}, qt AS (SELECT item_id AS query_id, {_TOK} AS t FROM benchmark), qr AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(t[i:i+2], ' '))) AS run FROM qt),
sr AS (SELECT DISTINCT doc_id, seq, unnest(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(t[i:i+2], ' '))) AS run FROM tok), ph AS (SELECT DISTINCT query_id, doc_id, seq FROM sr JOIN qr USING (run))
SELECT query_id, doc_id, CAST(seq AS INT) AS seq, CAST(CASE WHEN ph.doc_id IS NULL THEN 2 ELSE 0 END AS BIGINT) AS stage, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ph.doc_id IS NULL THEN 2 ELSE 0 END, score DESC, doc_id, seq) AS rank FROM scored LEFT JOIN ph USING (query_id, doc_id, seq) QUALIFY rank <= 10""",
    "exact_support": rf"WITH b AS (SELECT item_id, text, {_TOK} AS t FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS body FROM documents) SELECT item_id, doc_id FROM b, d WHERE length(text) >= 40 AND len(t) >= 6 AND contains(body, ' ' || array_to_string(t, ' ') || ' ')",
    "concept_windows": rf"""WITH {SEG}, t AS (SELECT doc_id, seq, unnest(x) AS term, unnest(range(len(x))) AS pos FROM (SELECT doc_id, seq, {_TOK} AS x FROM seg)),
s AS (SELECT * FROM t WHERE regexp_full_match(term, '[0-9]+') OR (length(term) >= 3 AND term NOT IN {text.STOPWORDS})), n AS (SELECT doc_id, seq, pos, term, lead(pos) OVER w AS next_pos, lead(term) OVER w AS next_term FROM s WINDOW w AS (PARTITION BY doc_id, seq ORDER BY pos))
SELECT doc_id, CAST(seq AS INT) AS seq, CAST(pos AS INT) AS pos, term, next_term FROM n WHERE next_pos - pos <= 4""",
    "uppercase_ratio": r"SELECT doc_id, CAST(round(CASE WHEN l > 0 THEN u / l ELSE 0 END * 1e6) AS BIGINT) AS ratio_e6 FROM (SELECT doc_id, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS u, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS l FROM documents)",
    "unique_offset": "SELECT doc_id, CAST(CASE WHEN trim(q) <> '' AND strpos(text, q) > 0 AND strpos(substr(text, strpos(text, q) + 1), q) = 0 THEN strpos(text, q) - 1 END AS BIGINT) AS at FROM (SELECT doc_id, text, substr(text, 11, 12) AS q FROM documents)",
    "page_links": r"""WITH p AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) END AS url, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages),
l AS (SELECT page_id, url, regexp_extract(url, '^(https://[^/]+)', 1) || regexp_extract(href, '^([^?#]*)', 1) AS link FROM p WHERE starts_with(href, '/')) SELECT DISTINCT page_id, url, link FROM l WHERE link <> url""",
    "page_states": r"""WITH p AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) END AS url, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages),
l AS (SELECT DISTINCT page_id, url, regexp_extract(url, '^(https://[^/]+)', 1) || regexp_extract(href, '^([^?#]*)', 1) AS link FROM p WHERE starts_with(href, '/')), c AS (SELECT page_id, count(*) AS links, count(*) FILTER (regexp_matches(link, '/[a-z][^/]*$')) AS document_links FROM l WHERE link <> url GROUP BY page_id),
b AS (SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<a [^>]*>.*?</a>', '', 'gs'), '<[^>]*>', '', 'g')) AS text_chars FROM pages)
SELECT page_id, text_chars, coalesce(links, 0) AS links, coalesce(document_links, 0) AS document_links, CASE WHEN coalesce(links, 0) >= 4 AND coalesce(document_links, 0) >= 4 AND document_links >= 0.6 * links AND text_chars <= 2000 THEN 'confirmed_index' ELSE 'ambiguous' END AS state FROM b LEFT JOIN c USING (page_id)""",
    "url_parts": r"""SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) END AS canonical,
CASE WHEN e = '' THEN '.bin' ELSE e END AS extension, (h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.net' OR h LIKE '%.example.net') AS allowed FROM (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h, lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(\.[A-Za-z0-9]{1,9})$', 1)) AS e FROM pages)""",
    "corpus_digest": "SELECT doc_id // 1000 AS run, sha256(string_agg(doc_id || ':' || sha256(text), '' ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY 1",
    "raw_addresses": "SELECT sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS byte_size, count(*) AS pages, 'raw/sha256/' || left(sha256(html), 2) || '/' || sha256(html) AS path FROM pages GROUP BY html",
    "document_ids": """SELECT doc_id, sha1('veritrail:' || doc_id) AS material_sha1, 'doc:' || left(sha256('{"doc_id":' || doc_id || ',"source":"' || source || '"}'), 32) AS ref FROM documents""",
    "thematic_search": _THEMATIC,
    "page_uuid": "WITH h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('page:' || url)) AS h FROM pages) SELECT page_id, 'SRC-' || h[1:12] || '5' || h[14:16] || substr('89ab', 1 + (strpos('0123456789abcdef', h[17]) - 1) % 4, 1) || h[18:32] AS source_id FROM h",
    "same_language_runs": "WITH s AS (SELECT *, CASE WHEN doc_id - lag(doc_id) OVER w = 1 AND lang IS NOT DISTINCT FROM lag(lang) OVER w THEN 0 ELSE 1 END AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)), r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS run FROM s) SELECT source, run, lang, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM r GROUP BY source, run, lang",
}
