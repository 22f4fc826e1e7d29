"""Plans for text cleaning, chunking, query formulation, duplicates, search and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import portfolio as pf
from barloom.operators import retrieval as rt
from barloom.operators import text as tx
from barloom.plans.portfolio import PM, PS
from barloom.registry import query
from barloom.sources import upsert
from barloom.sources.tables import Tables

Q = "questions"
GAP = r"[^\p{L}\p{N}_]+"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_map(table) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


# ---- scalar text ----

@query("md5_id", "SELECT doc_id, md5(title || link) AS id FROM articles", "articles")
def _(t: Tables):
    return t.articles.select("doc_id", tx.md5_id("title", "link").alias("id"))


@query("clean_whitespace", r"SELECT doc_id, trim(regexp_replace(title || chr(10) || chr(10) || content, '\s+', ' ', 'g')) AS clean FROM articles", "articles")
def _(t: Tables):
    return t.articles.select("doc_id", tx.clean_whitespace(F.concat_ws("\n\n", "title", "content"), None).alias("clean"))


REFS = "regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for ref, ch in tx.REFERENCES.items():
    REFS = f"replace({REFS}, '{ref}', '{ch.replace(chr(39), chr(39) * 2)}')"


@query("html_to_text", f"SELECT page_id, trim(regexp_replace({REFS}, '\\s+', ' ', 'g')) AS text FROM pages")
def _(t: Tables):
    return t.raw("pages").select("page_id", tx.html_to_text("html").alias("text"))


LEX = {"positive": ["the", "and", "for"], "negative": ["der", "und", "nicht"], "neutral": ["le", "la", "of"]}
LEX_ROWS = ", ".join(f"('{w}', '{k}', {i})" for i, (w, k) in enumerate((w, k) for k, ws in LEX.items() for w in ws))


@query("keyword_counts", f"""WITH lx AS (SELECT * FROM (VALUES {LEX_ROWS}) t(keyword, sentiment, i)), tk AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{GAP}')) AS keyword FROM documents),
c AS (SELECT doc_id, keyword, sentiment, i, count(*) AS count FROM tk JOIN lx USING (keyword) GROUP BY ALL)
SELECT doc_id, keyword, sentiment, count, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, i) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""")
def _(t: Tables):
    return tx.keyword_counts(t.raw("documents"), "doc_id", "text", LEX, 5)


TK = f"list_filter(regexp_split_to_array(query, '{GAP}'), lambda w: regexp_full_match(w, '[A-Z]{{1,5}}'))"
TICK = f"list_filter({TK}, lambda w: list_contains({sql_list(tx.SYMBOLS)}, w))"
TERM = f"list_filter({sql_list(tx.TERMS)}, lambda w: contains(lower(query), w))"
EN = f"e AS (SELECT *, {TICK} AS tick, {TERM} AS term FROM questions)"
PARTS = f"list_concat(list_transform(tick, lambda s: s || ' (' || {sql_map(tx.SYMBOLS)}[s] || ')'), list_transform(term, lambda s: s || ' (' || {sql_map(tx.TERMS)}[s] || ')'))"
XP = f"""{EN}, p AS (SELECT *, array_to_string({PARTS}, ', ') AS ps FROM e),
x AS (SELECT *, CASE WHEN ps = '' THEN query ELSE query || ' | Context: ' || CASE WHEN length(ps) > 300 THEN substr(ps, 1, 300) || '...' ELSE ps END END AS expanded FROM p),
rw AS (SELECT *, array_to_string(list_filter(string_split_regex(expanded, '\\s+'), lambda w: w <> ''), ' ') AS flat FROM x),
r AS (SELECT *, CASE WHEN length(flat) < length(expanded) * 0.8 THEN flat ELSE expanded END AS rewritten, len(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')) AS nw FROM rw),
v AS (SELECT *, list_filter([query, CASE WHEN rewritten <> query THEN rewritten END, 'financial implications of ' || query, 'market impact of ' || query, 'stock performance related to ' || query, 'investor perspective on ' || query], lambda w: w IS NOT NULL)[1:3] AS variations,
  string_split_regex(query, '(?i)\\s+compared\\s+to\\s+|\\s+vs\\.?\\s+') AS sides FROM r),
d AS (SELECT *, list_concat(list_concat([query], CASE WHEN (contains(lower(query), 'compared to') OR contains(lower(query), 'vs')) AND len(sides) >= 2 THEN [trim(sides[1]), trim(sides[2])] ELSE [] END),
  CASE WHEN regexp_matches(query, '(?i)(what|how|why).+?\\band\\b.+?(what|how|why)') THEN list_filter(list_transform(string_split_regex(query, '(?i)\\band\\b'), lambda w: trim(w)), lambda w: len(list_filter(string_split_regex(w, '\\s+'), lambda y: y <> '')) >= 3) ELSE [] END) AS parts FROM v)"""


@query("entities", f", {EN} SELECT query_id, tick AS stock_symbols, list_transform(tick, lambda s: {sql_map(tx.SYMBOLS)}[s]) AS company_names, term AS financial_terms FROM e", Q)
def _(t: Tables):
    return t.questions.select("query_id", *[c.alias(n) for n, c in tx.entities("query").items()])


@query("expand_query", f", {XP} SELECT query_id, expanded FROM x", Q)
def _(t: Tables):
    return t.questions.select("query_id", tx.expand_query("query").alias("expanded"))


@query("rewrite_query", f", {XP} SELECT query_id, rewritten FROM r", Q)
def _(t: Tables):
    return t.questions.select("query_id", tx.rewrite_query("query").alias("rewritten"))


@query("query_variations", f", {XP} SELECT query_id, variations FROM v", Q)
def _(t: Tables):
    return t.questions.select("query_id", tx.query_variations("query").alias("variations"))


@query("decompose_query", f", {XP} SELECT query_id, parts FROM d", Q)
def _(t: Tables):
    return t.questions.select("query_id", tx.decompose_query("query").alias("parts"))


@query("optimize_query", f", {XP} SELECT query_id, CASE WHEN nw <= 5 THEN [expanded] WHEN nw <= 15 THEN [rewritten] WHEN len(parts) > 1 THEN parts ELSE variations END AS queries FROM d", Q)
def _(t: Tables):
    return t.questions.select("query_id", tx.optimize_query("query").alias("queries"))


QT = f"CASE WHEN len({TK}) > 0 THEN 'stock_performance' " + " ".join(f"WHEN regexp_matches(lower(query), '{p}') THEN '{n}'" for n, p in tx.ROUTES) + " ELSE 'general' END"


@query("query_type", f"SELECT query_id, {QT} AS query_type FROM questions", Q)
def _(t: Tables):
    return t.questions.select("query_id", tx.query_type("query").alias("query_type"))


# ---- chunking ----

@query("chunk_fixed", """WITH n AS (SELECT doc_id, text, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 512 THEN 1 ELSE CAST(ceil((length(text) - 512) / 384.0) AS INTEGER) + 1 END AS chunk_count FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, chunk_count, substr(text, i * 384 + 1, 512) AS chunk FROM n, LATERAL (SELECT unnest(range(chunk_count)) AS i)""")
def _(t: Tables):
    return tx.chunk_fixed(t.raw("documents").select("doc_id", "text"), "text").drop("text")


@query("chunk_words", r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, text, i, w[i * 400 + 1 : i * 400 + 500] AS cw, len(w) AS n FROM w, LATERAL (SELECT unnest(range(greatest((len(w) - 1) // 400, 0) + 1)) AS i))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS chunk_count, CASE WHEN n <= 500 THEN text ELSE array_to_string(cw, ' ') END AS chunk
FROM c WHERE CASE WHEN n <= 500 THEN i = 0 ELSE i = 0 OR len(cw) >= 250 END""")
def _(t: Tables):
    return tx.chunk_words(t.raw("documents").select("doc_id", "text"), "text", 500, 100).drop("text")


def sentence_pack(src: str, keys: str) -> str:
    """Recursive check of greedy sentence packing (512, 128): one step per sentence of every text in ``src``."""
    on = " AND ".join(f"sn.{k} = sr.{k}" for k in keys.split(", "))
    own = ", ".join(f"sr.{k}" for k in keys.split(", "))
    split = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda w: w <> '')"
    return f"""ss AS (SELECT {keys}, {split} AS s FROM {src}),
sn AS (SELECT {keys}, CAST(unnest(generate_series(1, len(s))) AS INTEGER) AS j, unnest(s) AS p FROM ss),
sr AS (SELECT {keys}, 0 AS j, CAST([] AS VARCHAR[]) AS cur, CAST(NULL AS VARCHAR) AS out FROM ss
UNION ALL SELECT {keys}, j, list_append(CASE WHEN flush THEN cur[len(cur) - k + 1:] ELSE cur END, p), CASE WHEN flush THEN array_to_string(cur, ' ') END FROM (
  SELECT {own}, sn.j, sn.p, cur, coalesce(list_sum(list_transform(cur, lambda w: length(w))), 0) + length(sn.p) > 512 AND len(cur) > 0 AS flush,
    len(list_filter(range(1, len(cur) + 1), lambda k: list_sum(list_transform(cur[len(cur) - k + 1:], lambda w: length(w))) <= 128)) AS k
  FROM sr JOIN sn ON {on} AND sn.j = sr.j + 1)),
se AS (SELECT {keys}, j, out AS chunk FROM sr WHERE out IS NOT NULL
  UNION ALL SELECT {keys}, 1000000000, array_to_string(arg_max(cur, j), ' ') FROM sr GROUP BY {keys} HAVING len(arg_max(cur, j)) > 0)"""


NUMBERED = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {o}) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS chunk_count, chunk"


@query("chunk_sentences", f"WITH RECURSIVE {sentence_pack('documents', 'doc_id')} SELECT doc_id, {NUMBERED.format(o='j')} FROM se")
def _(t: Tables):
    return tx.chunk_sentences(t.raw("documents").select("doc_id", "text"), "text").drop("text")


@query("chunk_paragraphs", rf"""WITH RECURSIVE pp AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda w: regexp_replace(w, '^\s+|\s+$', '', 'g')), lambda w: w <> '') AS ps FROM documents),
pn AS (SELECT doc_id, CAST(unnest(generate_series(1, len(ps))) AS INTEGER) AS i, unnest(ps) AS p FROM pp), lg AS (SELECT doc_id, i, p AS text FROM pn WHERE length(p) > 512),
{sentence_pack('lg', 'doc_id, i')}, lc AS (SELECT doc_id, i, list(chunk ORDER BY j) AS cs FROM se GROUP BY 1, 2),
pr AS (SELECT doc_id, 0 AS i, CAST([] AS VARCHAR[]) AS cur, CAST([] AS VARCHAR[]) AS out FROM pp
UNION ALL SELECT doc_id, i, CASE WHEN cs IS NOT NULL THEN cur WHEN flush THEN [p] ELSE list_append(cur, p) END, CASE WHEN cs IS NOT NULL THEN cs WHEN flush THEN [array_to_string(cur, chr(10) || chr(10))] ELSE [] END FROM (
  SELECT pr.doc_id, q.i, q.p, cur, q.cs, coalesce(list_sum(list_transform(cur, lambda w: length(w))), 0) + length(q.p) > 512 AND len(cur) > 0 AS flush
  FROM pr JOIN (SELECT pn.*, lc.cs FROM pn LEFT JOIN lc USING (doc_id, i)) q ON q.doc_id = pr.doc_id AND q.i = pr.i + 1)),
pe AS (SELECT doc_id, i, generate_subscripts(out, 1) AS o, unnest(out) AS chunk FROM pr WHERE len(out) > 0
  UNION ALL SELECT doc_id, 1000000000, 1, array_to_string(arg_max(cur, i), chr(10) || chr(10)) FROM pr GROUP BY 1 HAVING len(arg_max(cur, i)) > 0)
SELECT doc_id, {NUMBERED.format(o='i, o')} FROM pe""")
def _(t: Tables):
    # the documents break lines once, so every line is taken as a paragraph
    docs = t.raw("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return tx.chunk_paragraphs(docs, "text").drop("text")


@query("chunk_metadata", r""", f AS (SELECT id, source, title || chr(10) || chr(10) || content AS full FROM articles), n AS (SELECT *, CASE WHEN length("full") <= 512 THEN 1 ELSE CAST(ceil((length("full") - 512) / 384.0) AS INTEGER) + 1 END AS cc FROM f),
c AS (SELECT id, source, i, cc, substr("full", i * 384 + 1, 512) AS chunk FROM n, LATERAL (SELECT unnest(range(cc)) AS i))
SELECT md5(id || '|' || i) AS id, CAST(i AS VARCHAR) AS chunk_index, CAST(cc AS VARCHAR) AS chunk_count, CAST(length(chunk) AS VARCHAR) AS char_count,
  CAST(len(list_filter(string_split_regex(chunk, '\s+'), lambda w: w <> '')) AS VARCHAR) AS word_count, source AS article_source FROM c""", "articles")
def _(t: Tables):
    m = F.col("metadata")
    return tx.process_articles(t.articles, "fixed").select("id", *[m[k].alias(k) for k in ("chunk_index", "chunk_count", "char_count", "word_count", "article_source")])


# ---- duplicates ----

ORD = ["published", "id"]


@query("dedup_exact", "SELECT id, title FROM articles QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY published, id) = 1", "articles")
def _(t: Tables):
    return rt.dedup_exact(t.articles, F.lower("title"), ORD).select("id", "title")


NEAR = r""", s AS (SELECT id, published, lower(title) AS lt, list_distinct(list_filter(string_split_regex(lower(title), '\s+'), lambda w: w <> '')) AS ws FROM articles),
dup AS (SELECT DISTINCT a.id FROM s a JOIN s b ON (b.published, b.id) < (a.published, a.id) AND (a.lt = b.lt OR (len(a.ws) > 3 AND len(b.ws) > 3 AND len(list_intersect(a.ws, b.ws)) > 0.8 * greatest(len(a.ws), len(b.ws)))))"""


@query("dedup_near", f"{NEAR} SELECT id, title FROM articles WHERE id NOT IN (SELECT id FROM dup)", "articles")
def _(t: Tables):
    return rt.dedup_near(t.articles, "id", "title", ORD).select("id", "title")


@query("dup_semi", f"{NEAR} SELECT id FROM dup", "articles")
def _(t: Tables):
    return rt.near_duplicates(t.articles, "id", "title", ORD)


# ---- vectors ----

@query("vectorize_text")
def _(t: Tables):
    docs = t.raw("documents").select("doc_id", "text")
    return rt.vectorize(rt.vectorizer().fit(docs), docs).select("doc_id", "embedding")


@query("embed_hook", r"""SELECT doc_id, [length(text)::DOUBLE, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::DOUBLE, (length(text) - length(replace(text, chr(10), '')))::DOUBLE] AS embedding FROM documents""")
def _(t: Tables):
    docs = t.raw("documents").select("doc_id", "text")
    return rt.embed_hook(docs, "text", lambda s: [len(s), len(s.split()), s.count("\n")]).select("doc_id", "embedding")


@query("cosine_similarity", """WITH m AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1))
SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS similarity FROM embeddings, m""", r6="similarity")
def _(t: Tables):
    cells = t.vectors.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"])).scalar()
    return rt.cosine_similarity(t.vectors, "embedding", mean).select("id", "similarity")


KNN = """kn AS (SELECT query_id, id, d AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INTEGER) AS rank FROM (
  SELECT q.query_id, c.id, pow(list_distance(c.embedding::DOUBLE[], q.embedding), 2) AS d FROM centroids q CROSS JOIN {src} c {where}) QUALIFY rank <= {k})"""


@query("knn_l2", ", " + KNN.format(src="(SELECT vec_id AS id, embedding FROM embeddings)", where="", k=5) + " SELECT * FROM kn", "centroids", r6="distance")
def _(t: Tables):
    return rt.knn(t.vectors, t.centroids, 5)


@query("knn_cross", ", " + KNN.format(src="(SELECT vec_id AS id, embedding FROM embeddings)", where="", k=10) + " SELECT * FROM kn", "centroids", r6="distance")
def _(t: Tables):
    return rt.knn(t.vectors, t.centroids, 10, block=(4, 128))


FILT = KNN.format(src="vector_articles", where="WHERE c.lang = 'en' AND c.published >= DATE '2024-01-15'", k=5)
RELEVANT = "hits AS (SELECT kn.*, round(1 - coalesce(distance / nullif(max(distance) OVER (PARTITION BY query_id), 0), 0), 3) AS relevance FROM kn)"
HITS = f"{KNN.format(src='vector_articles', where='', k=5)}, {RELEVANT}"


@query("knn_filtered", f", {FILT}, {RELEVANT} SELECT * FROM hits", "centroids vector_articles", r6="distance")
def _(t: Tables):
    return rt.knn_filtered(t.vector_articles, t.centroids, 5, (F.col("lang") == "en") & (F.col("published") >= F.lit("2024-01-15").cast("date")))


@query("collection_stats", "SELECT count(*) AS documents, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings")
def _(t: Tables):
    return rt.collection_stats(t.vectors)


@query("vector_upsert", "SELECT vec_id AS id, CASE WHEN label = 3 THEN list_transform(embedding, lambda x: (x * 2)::FLOAT) ELSE embedding END AS embedding FROM embeddings")
def _(t: Tables):
    stored = t.vectors.select("id", "embedding")
    newer = t.vectors.where("label = 3").select("id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"))
    return upsert.upsert(stored, newer, ["id"])


@query("news_to_documents", "SELECT 'news_' || md5(link) AS id, title || chr(10) || chr(10) || content AS text, source, 'news' AS type FROM articles", "articles")
def _(t: Tables):
    items = t.articles.select("title", F.col("content").alias("summary"), F.col("link").alias("url"), "source", F.col("published").alias("published_at"))
    m = F.col("metadata")
    return rt.news_to_documents(items).select("id", "text", m["source"].alias("source"), m["type"].alias("type"))


def found(t: Tables):
    facts = t.vector_articles.select("id", "title", F.col("content").alias("text"), "source", "published")
    return rt.knn_filtered(t.vector_articles, t.centroids, 5).join(facts, "id")


FD = "fd AS (SELECT hits.*, title, content AS text, source, published FROM hits JOIN vector_articles USING (id))"


@query("markdown_context", f"""{', ' + HITS}, {FD} SELECT query_id, '## Retrieved Information' || chr(10) || chr(10) || string_agg('### Document ' || rank || ': ' || source || ' (news)' || chr(10) || chr(10) || 'Date: ' || published || chr(10) || chr(10) || text || chr(10) || chr(10) || '---', chr(10) || chr(10) ORDER BY rank) AS context FROM fd GROUP BY 1""", "centroids vector_articles")
def _(t: Tables):
    return rt.markdown_context(found(t).withColumns({"type": F.lit("news"), "published_at": F.col("published")}))


BC = f"""{', ' + HITS}, {FD}, g AS (SELECT * FROM fd QUALIFY relevance >= 0.5 OR max(relevance) OVER (PARTITION BY query_id) < 0.5), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS i FROM g),
en AS (SELECT *, '[Article ' || i || ' - ' || source || ' - ' || strftime(published, '%B %d, %Y') || ']' || chr(10) || 'Title: ' || title || chr(10) || CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '...' ELSE text END || chr(10) || chr(10) AS e FROM i),
u AS (SELECT *, sum(length(e)) OVER (PARTITION BY query_id ORDER BY i) AS used FROM en), ctx AS (SELECT query_id, string_agg(e, '' ORDER BY i) AS context, count(*) AS articles FROM u WHERE used <= 4000 GROUP BY 1)"""


@query("build_context", f"{BC} SELECT * FROM ctx", "centroids vector_articles")
def _(t: Tables):
    return rt.build_context(found(t))


SENT = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: true)"
MARKED = ["the", "und ", "des"]


def first_sql(test: str) -> str:
    return f"trim(list_filter(s, lambda x: {test})[1])"


def words_sql(ws) -> str:
    return f"regexp_matches(lower(x), '{'|'.join(ws)}')"


LONG = r"len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) >= 8"


@query("extract_sentences", f"""WITH s AS (SELECT doc_id, {SENT} AS s FROM documents)
SELECT doc_id, coalesce({first_sql(words_sql(rt.TOPICS['performance']))}, '{rt.NONE['performance']}') AS key_point,
  coalesce({first_sql(words_sql(rt.MARKS))}, {first_sql(LONG)}, '{rt.NONE['main']}') AS main_insight,
  coalesce({first_sql(f"regexp_matches(x, '{rt.FIGURE}')")}, {first_sql(words_sql(rt.FINANCE))}, '{rt.NONE['second']}') AS secondary_point,
  coalesce({first_sql(words_sql(rt.AHEAD))}, {first_sql(words_sql(rt.ANALYST))}, '{rt.NONE['third']}') AS additional_point,
  CASE WHEN len(list_filter(s, lambda x: {words_sql(rt.RECENT)})) > 0 THEN array_to_string(list_transform(list_filter(s, lambda x: {words_sql(rt.RECENT)})[1:3], lambda x: '• ' || trim(x)), chr(10)) ELSE '{rt.NONE['recent']}' END AS recent_developments FROM s""")
def _(t: Tables):
    return rt.extract_sentences(t.raw("documents").select("doc_id", F.col("text").alias("context"))).drop("context")


@query("template_answer")
def _(t: Tables):
    return rt.answer_questions(t.articles, t.questions)


@query("retrieval_report", f"""{', ' + HITS}, {FD}, tm AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'general' ELSE 'market_analysis' END AS query_type, 0.25 * (query_id + 1) AS seconds FROM centroids),
p AS (SELECT source, count(*) AS n FROM fd GROUP BY 1)
SELECT count(*) AS unique_sources, string_agg(source || '=' || n, ',' ORDER BY source || '=' || n) AS source_distribution, (SELECT count(*) FROM tm) AS queries_processed, (SELECT sum(seconds)::DOUBLE FROM tm) AS total_seconds, (SELECT avg(seconds)::DOUBLE FROM tm) AS mean_seconds,
  (SELECT string_agg(query_type || '=' || n, ',' ORDER BY query_type) FROM (SELECT query_type, count(*) AS n FROM tm GROUP BY 1)) AS query_types FROM p""", "centroids vector_articles", r6="total_seconds mean_seconds")
def _(t: Tables):
    times = t.centroids.select("query_id", F.when(F.col("query_id") % 2 == 0, "general").otherwise("market_analysis").alias("query_type"), (0.25 * (F.col("query_id") + 1)).alias("seconds"))
    return rt.retrieval_report(found(t), times)


@query("text_report", f"""{PM} SELECT portfolio_id, 'Portfolio ' || portfolio_id || ': return ' || printf('%.2f%%', total_return * 100) || ', volatility ' || printf('%.2f%%', volatility * 100) || ', Sharpe ' || printf('%.2f', sharpe_ratio) || ', worst fall ' || printf('%.2f%%', max_drawdown * 100) AS report FROM pm""", PS)
def _(t: Tables):
    m = pf.portfolio_metrics(pf.portfolio_returns(t.returns, t.weights))
    return rt.text_report(m, F.concat(F.lit("Portfolio "), F.col("portfolio_id").cast("string")))
