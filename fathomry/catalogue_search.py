"""Queries on ranked and structured text: functions, headings and chunks, top-k orders, graph context, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import BM25, COS, QV, TERMS, C, E, M, S, V, _bm25, _q, query
from .functions import chunking
from .functions import text as fx
from .operators import aggregates as agg
from .operators import graph, lookup, ranking, resolution, vector
from .plans import projections as p
from .sources import readers

# functions on text


@query(S, "SELECT id, regexp_replace(regexp_replace(name, '(?i)(widget|red)', '**\\1**', 'g'), '\\*\\*([ \\t]*)\\*\\*', '\\1', 'g') AS marked FROM symbols")
def fn_highlight(spark, sf):
    return p.symbols(spark, sf).select("id", fx.highlight(F.col("name"), ["widget", "red"]).alias("marked"))


@query(S, "SELECT id, url_decode(replace(name, ' ', '%20') || '%2Fé') AS decoded FROM symbols")
def fn_url_decode(spark, sf):
    return p.symbols(spark, sf).select("id", F.try_url_decode(F.concat(F.replace("name", F.lit(" "), F.lit("%20")), F.lit("%2Fé"))).alias("decoded"))


@query(C, "SELECT chunk_id, unnest(list_transform(list_filter(regexp_split_to_array(content, '\\n[ \\t]*\\n'), lambda x: regexp_matches(x, '\\S')), lambda x: sha256(x))) AS hash FROM chunks")
def fn_paragraphs(spark, sf):
    parts = F.filter(F.split("content", r"\n[ \t]*\n"), lambda x: x.rlike(r"\S"))
    return p.chunks(spark, sf).select("chunk_id", F.explode(F.transform(parts, lambda x: F.sha2(x, 256))).alias("hash"))


@query(S, "SELECT DISTINCT path, replace(regexp_replace(regexp_replace(lower(path) || '.rs', '\\.[a-z]+$', ''), '^brand#', 'crate/'), '/', '::') AS module FROM symbols")
def fn_module_path(spark, sf):
    return p.symbols(spark, sf).select("path", fx.module_path(F.concat(F.lower("path"), F.lit(".rs")), "brand#", "crate/", "::").alias("module")).distinct()


SIGNATURE = "g AS (SELECT id, 'fn ' || replace(name, ' ', '_') || '(line: int, part: &' || lower(kind) || ', rest: str)' AS signature, 'class ' || upper(replace(name, ' ', '')) || '(' || lower(kind) || '.Base, ' || replace(language, '#', '') || ', metaclass=M):' AS class FROM symbols)"


def _signatures(spark, sf):
    name = F.col("name")
    function = F.concat(F.lit("fn "), F.replace(name, F.lit(" "), F.lit("_")), F.lit("(line: int, part: &"), F.lower("kind"), F.lit(", rest: str)"))
    cls = F.concat(F.lit("class "), F.upper(F.replace(name, F.lit(" "), F.lit(""))), F.lit("("), F.lower("kind"), F.lit(".Base, "), F.replace("language", F.lit("#"), F.lit("")), F.lit(", metaclass=M):"))
    return p.symbols(spark, sf).select("id", "name", "kind", function.alias("signature"), cls.alias("class"))


@query(S, SIGNATURE, "SELECT id, regexp_extract(signature, '[(,]\\s*part\\s*:\\s*&?\\s*([A-Za-z_][A-Za-z0-9_]*)', 1) AS type FROM g")
def fn_param_type(spark, sf):
    return _signatures(spark, sf).select("id", fx.parameter_type(F.col("signature"), "part").alias("type"))


@query(S, SIGNATURE, "SELECT id, array_to_string(list_filter(list_transform(string_split(regexp_extract(class, '^\\s*class\\s+\\w+\\s*\\(([^)]*)\\)', 1), ','), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, '=')), '|') AS bases FROM g")
def fn_declared_bases(spark, sf):
    return _signatures(spark, sf).select("id", F.array_join(fx.declared_bases(F.col("class")), "|").alias("bases"))


@query(S, "x AS (SELECT id, 'receiver:' || replace(name, ' ', '_') || ',static:' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS context FROM symbols)", "SELECT id, regexp_extract(context, '^receiver:([^,]*),static:(true|false)$', 1) AS receiver, regexp_extract(context, '^receiver:([^,]*),static:(true|false)$', 2) = 'true' AS is_static, regexp_extract(context, '^receiver:([^,]*),', 1) || CASE WHEN id % 2 = 0 THEN '::' ELSE '.' END || 'call' AS display FROM x")
def fn_receiver(spark, sf):
    context = F.concat(F.lit("receiver:"), F.replace("name", F.lit(" "), F.lit("_")), F.lit(",static:"), F.when(F.col("id") % 2 == 0, "true").otherwise("false"))
    receiver, static = fx.receiver(context)
    shown = F.concat(receiver, F.when(static, "::").otherwise("."), F.lit("call"))
    return p.symbols(spark, sf).select("id", receiver.alias("receiver"), static.alias("is_static"), shown.alias("display"))


@query(S, "SELECT DISTINCT kind, CASE lower(kind) WHEN 'economy' THEN 'Function' WHEN 'promo' THEN 'Class' WHEN 'small' THEN 'Method' WHEN 'large' THEN 'Struct' ELSE 'Function' END AS parsed FROM symbols")
def fn_kind_parse(spark, sf):
    known = {"economy": "Function", "promo": "Class", "small": "Method", "large": "Struct"}
    return p.symbols(spark, sf).select("kind", fx.parsed_kind(F.col("kind"), known, "Function").alias("parsed")).distinct()


@query(S, "SELECT id, CASE WHEN visibility = 'Crate' THEN 'ClassMember' ELSE 'Module' END AS tag, CASE WHEN visibility = 'Crate' THEN module END AS class_name FROM symbols")
def fn_json_scope(spark, sf):
    member = F.col("visibility") == "Crate"
    encoded = F.to_json(F.struct(F.when(member, "ClassMember").otherwise("Module").alias("tag"), F.when(member, F.col("module")).alias("class_name")))
    return p.symbols(spark, sf).select("id", F.from_json(encoded, "tag string, class_name string").alias("x")).select("id", "x.tag", "x.class_name")


@query(C, "x AS (SELECT chunk_id, CAST(octet_length(encode(content)) AS BIGINT) AS n FROM chunks)", "SELECT chunk_id, unnest(range(0, n, 900)) AS first, least(n, unnest(range(0, n, 900)) + 900) AS last FROM x")
def fn_token_ranges(spark, sf):
    n = F.octet_length("content").cast("long")
    first = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(900).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return p.chunks(spark, sf).select("chunk_id", n.alias("n"), F.explode(first).alias("first")).select("chunk_id", "first", F.least(F.col("n"), F.col("first") + 900).alias("last"))


@query(C, "x AS (SELECT chunk_id, CAST(ceil(length(content) / 300.0) AS INT) AS n FROM chunks WHERE length(content) > 0)", "SELECT chunk_id, array_to_string(list_distinct([n // 2, 0, n - 1, (n - 1) * 1 // 7, (n - 1) * 2 // 7, (n - 1) * 3 // 7, (n - 1) * 4 // 7, (n - 1) * 5 // 7, (n - 1) * 6 // 7][1:9]).list_sort()[1:8], ',') AS segments FROM x")
def fn_segment_select(spark, sf):
    n = F.ceil(F.length("content") / 300.0).cast("int")
    return p.chunks(spark, sf).where(F.length("content") > 0).select("chunk_id", F.array_join(fx.segments(n), ",").alias("segments"))


@query(S, SIGNATURE, "SELECT s.id, lower(kind) || ' ' || name || ' ' || signature AS text FROM symbols s JOIN g ON g.id = s.id")
def fn_symbol_text(spark, sf):
    return _signatures(spark, sf).select("id", F.concat_ws(" ", F.lower("kind"), "name", "signature").alias("text"))


@query(C, "SELECT chunk_id, sha256(collection || ' > ' || source_path || chr(10) || chr(10) || content) AS hash FROM chunks")
def fn_embed_input(spark, sf):
    return p.chunks(spark, sf).select("chunk_id", F.sha2(fx.embedding_input(F.array("collection", "source_path"), F.col("content")), 256).alias("hash"))


@query(M, "SELECT id, sha256(role || chr(10) || text) AS hash FROM messages")
def fn_message_text(spark, sf):
    block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    content = F.to_json(F.array(block(F.col("role")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), block(F.col("text"))))
    return p.messages(spark, sf).select("id", F.sha2(readers.message_text(content), 256).alias("hash"))


@query(p.MARKDOWN, "SELECT page_id, unnest(regexp_extract_all(md, '(?m)^(#{1,6} +\\S.*)$', 1)) AS heading FROM markdown")
def fn_md_headings(spark, sf):
    return p.markdown(spark, sf).select("page_id", F.explode(fx.headings(F.col("md"))).alias("heading"))


@query(S, "x AS (SELECT id, 'a `' || replace(name, ' ', '_') || '` b `' || lower(kind) || '` `' || lower(kind) || '` `9x` ``' AS t FROM symbols)", "SELECT id, replace(unnest([replace(regexp_extract_all(t, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)[1], '`', ''), regexp_extract_all(t, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)[2]]), '`', '') AS anchor FROM x")
def fn_backtick_anchors(spark, sf):
    kind = F.lower("kind")
    text = F.concat(F.lit("a `"), F.replace("name", F.lit(" "), F.lit("_")), F.lit("` b `"), kind, F.lit("` `"), kind, F.lit("` `9x` ``"))
    return p.symbols(spark, sf).select("id", F.explode(fx.backticks(text)).alias("anchor"))


@query(S, "SELECT id, name AS text FROM symbols")
def fn_comment_text(spark, sf):
    mark = F.element_at(F.array(*map(F.lit, ("  /// ", "# ", "\t// ", " * "))), (F.col("id") % 4 + 1).cast("int"))
    return p.symbols(spark, sf).select("id", fx.comment_text(F.concat(mark, "name")).alias("text"))


@query(S, "w AS (SELECT id, string_split(name, ' ') AS n, regexp_split_to_array(lower(path), '[^a-z0-9]+') AS t, [lower(kind)] AS b FROM symbols)", "SELECT id, (list_contains(n, 'red') OR list_contains(t, 'red') OR list_contains(b, 'red'))::INT + (list_contains(n, 'promo') OR list_contains(t, 'promo') OR list_contains(b, 'promo'))::INT AS terms, 4 * (list_contains(n, 'red')::INT + list_contains(n, 'promo')::INT) + 2 * (list_contains(b, 'red')::INT + list_contains(b, 'promo')::INT) + list_contains(t, 'red')::INT + list_contains(t, 'promo')::INT AS weight FROM w")
def fn_lexical_score(spark, sf):
    fields = [(F.split("name", " "), 4), (F.array(F.lower("kind")), 2), (F.split(F.lower("path"), "[^a-z0-9]+"), 1)]
    terms, weight = fx.lexical_score(fields, ["red", "promo"])
    return p.symbols(spark, sf).select("id", terms.alias("terms"), weight.alias("weight"))


@query()
def fn_local_target(spark, sf):
    links = p.table(spark, sf, "pages").select("page_id", "url", F.explode(fx.links(F.col("html"))).alias("target"))
    path, fragment = fx.local_target(F.lit("docs/guide/index.md"), F.concat(F.lit(".."), "target"))
    return links.select("page_id", "target", path.alias("path"), fragment.alias("fragment"))


@query()
def fn_normalized_words(spark, sf):
    from .functions.stemming import normalized_words

    return normalized_words(p.messages(spark, sf).select("id", "text"))


@query(C, "SELECT chunk_id, len(list_intersect(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), ['the', 'license', 'public', 'version'])) AS literal, len(list_intersect(list_transform(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: substring(x, 1, 5)), ['the', 'licen', 'publi', 'versi'])) AS rooted FROM chunks")
def agg_lexical_coverage(spark, sf):
    words = agg.terms_of(F.col("content"))
    count = lambda w, q: F.size(F.array_intersect(w, F.array(*map(F.lit, q)))).cast("long")
    rooted = F.transform(words, lambda x: F.substring(x, 1, 5))
    return p.chunks(spark, sf).select("chunk_id", count(words, TERMS).alias("literal"), count(rooted, [t[:5] for t in TERMS]).alias("rooted"))


# headings and chunks

LINES = f"{p.MARKDOWN}, l AS (SELECT page_id, unnest(string_split(md, chr(10))) AS line, unnest(range(len(string_split(md, chr(10))))) AS n FROM markdown), h AS (SELECT page_id, n, line, CAST(length(regexp_extract(line, '^(#+) ', 1)) AS INT) AS level FROM l WHERE regexp_matches(line, '^#{{1,6}} +\\S'))"


def _headings(spark, sf):
    lines = p.markdown(spark, sf).select("page_id", F.posexplode(F.split("md", "\n")).alias("n", "line"))
    found = lines.where(F.col("line").rlike(r"^#{1,6} +\S"))
    return found.withColumn("level", F.length(F.regexp_extract("line", "^(#+) ", 1)))


@query(LINES, "e AS (SELECT page_id, max(n) AS last FROM l GROUP BY page_id)", "SELECT h.page_id, CAST(h.n AS INT) AS first, CAST(coalesce(lead(h.n) OVER (PARTITION BY h.page_id ORDER BY h.n) - 1, last) AS INT) AS last FROM h JOIN e ON e.page_id = h.page_id")
def win_section_end(spark, sf):
    lines = p.markdown(spark, sf).select("page_id", (F.size(F.split("md", "\n")) - 1).alias("end"))
    after = F.lead("n").over(Window.partitionBy("page_id").orderBy("n")) - 1
    return _headings(spark, sf).join(lines, "page_id").select("page_id", F.col("n").alias("first"), F.coalesce(after, "end").alias("last"))


@query(
    LINES,
    "a AS (SELECT page_id, n, line, max(CASE WHEN level = 1 THEN n END) OVER w AS p1, max(CASE WHEN level = 2 THEN n END) OVER w AS p2, max(CASE WHEN level = 3 THEN n END) OVER w AS p3 FROM h WINDOW w AS (PARTITION BY page_id ORDER BY n))",
    "SELECT page_id, CAST(n AS INT) AS n, CAST(p1 AS INT) AS h1, CAST(CASE WHEN p2 > coalesce(p1, -1) THEN p2 END AS INT) AS h2, CAST(CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN p3 END AS INT) AS h3 FROM a",
)
def win_heading_stack(spark, sf):
    return ranking.heading_stack(_headings(spark, sf), "page_id", "n", "level").select("page_id", "n", "h1", "h2", "h3")


@query()
def chunk_documents(spark, sf):
    texts = p.markdown(spark, sf).select(F.col("page_id").alias("id"), F.col("md").alias("text"))
    return chunking.chunk_documents(texts, 200, 1500, 100).select("id", "n", "start", F.array_join("headings", " > ").alias("headings"), F.sha2("content", 256).alias("hash"))


@query()
def win_merge_small(spark, sf):
    texts = p.markdown(spark, sf).select(F.col("page_id").alias("id"), F.col("md").alias("text"))
    return chunking.chunk_documents(texts, 400, 1 << 30, 0).select("id", "n", "start", F.length("content").alias("size"))


# orders and pages


@query(S, "SELECT id, name FROM symbols WHERE contains(name, 'widget')")
def topk_all(spark, sf):
    return p.symbols(spark, sf).where(F.col("name").contains("widget")).select("id", "name")


@query(V, QV, f"SELECT id, round({COS}, 6) AS score FROM vectors, q ORDER BY {COS} DESC, id LIMIT 40")
def topk_chunks(spark, sf):
    return vector.top(vector.scored(p.vectors(spark, sf), _q(spark, sf)), 4 * 10).withColumn("score", F.round("score", 6))


@query(S, "SELECT id, path FROM symbols WHERE name = 'red widget' ORDER BY path, line, id LIMIT 3 OFFSET 1")
def topk_heap_page(spark, sf):
    return p.symbols(spark, sf).where("name = 'red widget'").orderBy("path", "line", "id").offset(1).limit(3).select("id", "path")


@query(E, "o AS (SELECT DISTINCT dst FROM edges WHERE src = 5 AND kind = 'Calls')", "SELECT dst AS id, (SELECT count(*) FROM o) AS total FROM o ORDER BY dst LIMIT 5")
def topk_preview(spark, sf):
    near = graph.neighbours(p.edges(spark, sf), 5, ("Calls",)).select("id").distinct()
    return near.orderBy("id").limit(5).crossJoin(F.broadcast(near.agg(F.count("*").alias("total"))))


@query(S, "SELECT id, name FROM symbols WHERE contains(name, 'widget') ORDER BY name = 'red widget' DESC, weight DESC, path, line, id LIMIT 20")
def topk_exact_first(spark, sf):
    exact = F.col("name") == "red widget"
    return p.symbols(spark, sf).where(F.col("name").contains("widget")).orderBy(exact.desc(), F.desc("weight"), "path", "line", "id").limit(20).select("id", "name")


@query(S, "SELECT id, CASE kind WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END AS tier FROM symbols ORDER BY tier, weight DESC, id LIMIT 30")
def topk_profile(spark, sf):
    tier = F.when(F.col("kind") == "PROMO", 0).when(F.col("kind") == "SMALL", 1).otherwise(2)
    return p.symbols(spark, sf).select("id", tier.alias("tier"), "weight").orderBy("tier", F.desc("weight"), "id").limit(30).select("id", "tier")


CHUNK_VECTORS = f"x AS (SELECT chunk_id, source_path, collection, {COS} AS score, len(list_intersect(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), ['the', 'license', 'public', 'version'])) AS coverage FROM chunks JOIN vectors ON vectors.id = chunk_id, q)"


def _chunk_scores(spark, sf):
    scores = vector.scored(p.vectors(spark, sf), _q(spark, sf)).withColumnRenamed("id", "chunk_id")
    return ranking.coverage(p.chunks(spark, sf), "content", TERMS).join(scores, "chunk_id").select("chunk_id", "source_path", "collection", "score", F.col("coverage").cast("long").alias("coverage"))


@query(C, V, QV, CHUNK_VECTORS, "SELECT chunk_id, coverage, round(score, 6) AS score FROM x ORDER BY coverage DESC, CASE WHEN collection = 'en' THEN 1 ELSE 0 END DESC, x.score DESC, chunk_id LIMIT 25")
def topk_authority(spark, sf):
    authority = F.when(F.col("collection") == "en", 1).otherwise(0)
    best = _chunk_scores(spark, sf).orderBy(F.desc("coverage"), authority.desc(), F.desc("score"), "chunk_id").limit(25)
    return best.select("chunk_id", "coverage", F.round("score", 6).alias("score"))


@query(S, "r AS (SELECT id, row_number() OVER (ORDER BY weight DESC, id) AS position FROM symbols ORDER BY position LIMIT 500)", "t AS (SELECT sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY position)) AS token FROM r)", "SELECT id, CAST(position AS INT) AS position, token FROM r, t WHERE position BETWEEN 21 AND 40")
def topk_coverage_page(spark, sf):
    ranked = p.symbols(spark, sf).orderBy(F.desc("weight"), "id").limit(500)
    return ranking.token_page(ranked, (F.desc("weight"), F.col("id")), 20, 20).select("id", "position", "token")


@query(S, "f AS (SELECT * FROM symbols WHERE name = 'red widget')", "SELECT count(*) AS total, CAST(CASE WHEN count(*) > 2 THEN 2 END AS BIGINT) AS next_offset FROM f")
def page_total(spark, sf):
    return lookup.page_total(p.symbols(spark, sf).where("name = 'red widget'"), 2, 0)


# graph


def _both_ways(spark, sf, node, kind):
    e = p.edges(spark, sf)
    out, back = graph.neighbours(e, node, (kind,)), graph.neighbours(e, node, (kind,), True)
    return out.select("id", "line", F.lit("out").alias("direction")).union(back.select("id", "line", F.lit("in")))


@query(E, "SELECT dst AS id, line, 'out' AS direction FROM edges WHERE src = 9 AND kind = 'Extends' UNION ALL SELECT src, line, 'in' FROM edges WHERE dst = 9 AND kind = 'Extends'")
def graph_extends(spark, sf):
    return _both_ways(spark, sf, 9, "Extends")


@query(E, "SELECT dst AS id, line, 'out' AS direction FROM edges WHERE src = 9 AND kind = 'Uses' UNION ALL SELECT src, line, 'in' FROM edges WHERE dst = 9 AND kind = 'Uses'")
def graph_uses(spark, sf):
    return _both_ways(spark, sf, 9, "Uses")


@query(E, "r AS (SELECT src, dst, kind, line, row_number() OVER (PARTITION BY src ORDER BY dst, kind, line) AS n, count(*) OVER (PARTITION BY src) AS total FROM edges WHERE src <= 64 AND kind IN ('Calls', 'References'))", "SELECT src, dst, kind, line, greatest(total - 4, 0) AS omitted FROM r WHERE n <= 4")
def graph_expand(spark, sf):
    near = p.edges(spark, sf).where("src <= 64 and kind in ('Calls', 'References')")
    return ranking.first_per_key(near, "src", 4, "dst", "kind", "line").select("src", "dst", "kind", "line", "omitted")


@query(E, S, "d AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'Calls' AND src IN (11, 12, 13) AND dst NOT IN (11, 12, 13))", "o AS (SELECT d.src, d.dst, row_number() OVER (ORDER BY d.src, path, line, name, d.dst) AS n, count(*) OVER () AS total FROM d JOIN symbols s ON s.id = d.dst)", "SELECT src, dst, greatest(total - 6, 0) AS omitted FROM o WHERE n <= 6")
def graph_related(spark, sf):
    direct = [11, 12, 13]
    near = p.edges(spark, sf).where((F.col("kind") == "Calls") & F.col("src").isin(direct) & ~F.col("dst").isin(direct)).select("src", "dst").distinct()
    near = ranking.within_budget(near, 32 * 1000).join(p.symbols(spark, sf).select(F.col("id").alias("dst"), "path", "line", "name"), "dst")
    omitted = near.agg(F.greatest(F.count("*") - 6, F.lit(0)).alias("omitted"))
    return near.orderBy("src", "path", "line", "name", "dst").limit(6).select("src", "dst").crossJoin(F.broadcast(omitted))


@query()
def graph_communities(spark, sf):
    return resolution.propagated(p.edges(spark, sf).where("kind = 'Implements'"), 20)


@query(
    E,
    S,
    "m AS (SELECT a.module AS am, b.module AS bm FROM edges e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst WHERE e.kind <> 'DispatchCandidate')",
    "b AS (SELECT am AS module, am = bm AS inside FROM m UNION ALL SELECT bm, FALSE FROM m WHERE am <> bm)",
    "n AS (SELECT module, count(*) AS members, count(DISTINCT language) AS repos FROM symbols GROUP BY module)",
    "SELECT module, members, repos, count(*) FILTER (inside) AS internal, count(*) FILTER (NOT inside) AS boundary FROM n JOIN b USING (module) GROUP BY module, members, repos",
)
def agg_community_stats(spark, sf):
    s = p.symbols(spark, sf).select("id", F.col("module").alias("community"), F.col("language").alias("repo"))
    return agg.community_stats(p.edges(spark, sf).where("kind <> 'DispatchCandidate'"), s).withColumnRenamed("community", "module")


@query(E, "SELECT dst AS id, count(DISTINCT src) AS seeds FROM edges WHERE src <= 50 AND kind <> 'Defines' GROUP BY dst")
def agg_nonempty_distinct_seed(spark, sf):
    return p.edges(spark, sf).where("src <= 50 and kind <> 'Defines'").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("seeds"))


@query(E, "x AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'Extends')", "r(id, d) AS (SELECT dst, 1 FROM x WHERE src = 7 UNION SELECT x.dst, d + 1 FROM r JOIN x ON x.src = r.id WHERE d < 3)", "SELECT id, CAST(min(d) AS INT) AS distance FROM r WHERE id <> 7 GROUP BY id")
def graph_inherit_chain(spark, sf):
    start = spark.createDataFrame([(7,)], "id long")
    return graph.reach(p.edges(spark, sf).where("kind = 'Extends'"), start, 3).where("id <> 7").select("id", F.col("depth").alias("distance"))


@query(
    E,
    S,
    "seeds AS (SELECT id FROM symbols WHERE contains(name, 'widget') ORDER BY name = 'red widget' DESC, weight DESC, id LIMIT 12)",
    "u AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE kind = 'Calls' UNION SELECT dst, src FROM edges WHERE kind = 'Calls')",
    "n AS (SELECT id, 0 AS depth FROM seeds UNION ALL SELECT DISTINCT b, 1 FROM u WHERE a IN (SELECT id FROM seeds) AND b NOT IN (SELECT id FROM seeds))",
    "SELECT id, CAST(depth AS INT) AS depth FROM n ORDER BY depth, id LIMIT 40",
)
def graph_context(spark, sf):
    found = p.symbols(spark, sf).where(F.col("name").contains("widget")).orderBy((F.col("name") == "red widget").desc(), F.desc("weight"), "id").limit(12).select("id")
    calls = p.edges(spark, sf).where("kind = 'Calls'").select("src", "dst")
    return graph.reach(calls.union(calls.select("dst", "src")), found, 1).orderBy("depth", "id").limit(40)


@query(
    E,
    S,
    "SELECT 'file' AS kind, path AS a, '' AS b FROM symbols GROUP BY path UNION ALL SELECT 'symbol', CAST(id AS VARCHAR), name FROM symbols UNION ALL SELECT 'contains', path, CAST(id AS VARCHAR) FROM symbols UNION ALL SELECT DISTINCT 'defines', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM edges WHERE kind = 'Defines'",
)
def graph_build(spark, sf):
    s, text = p.symbols(spark, sf), lambda c: F.col(c).cast("string")
    parts = [
        s.select(F.lit("file").alias("kind"), F.col("path").alias("a"), F.lit("").alias("b")).distinct(),
        s.select(F.lit("symbol"), text("id"), "name"),
        s.select(F.lit("contains"), "path", text("id")),
        p.edges(spark, sf).where("kind = 'Defines'").select(F.lit("defines"), text("src"), text("dst")).distinct(),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


# retrieval


@query(C, "f AS (SELECT chunk_id, source_path, row_number() OVER (PARTITION BY source_path ORDER BY chunk_id) AS n FROM chunks WHERE contains(content, 'License'))", "SELECT chunk_id, source_path FROM f ORDER BY CASE WHEN n > 3 THEN 1 ELSE 0 END, chunk_id LIMIT 30")
def search_documents_literal(spark, sf):
    hits = p.chunks(spark, sf).where(F.col("content").contains("License")).select(F.col("chunk_id").alias("id"), F.col("source_path").alias("source"), F.lit(1.0).alias("score"))
    return ranking.diversify(hits, 30, 3).select(F.col("id").alias("chunk_id"), F.col("source").alias("source_path"))


@query(
    C, V, QV, CHUNK_VECTORS,
    "t AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM x WHERE collection = 'en' AND score >= 0.0)",
    "k AS (SELECT min(score) AS kth FROM t WHERE r <= 10)",
    "g AS (SELECT * FROM t, k WHERE r <= 40 AND score >= CASE WHEN kth > 0 THEN 0.9 * kth ELSE kth END)",
    "d AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY score DESC, chunk_id) AS n FROM g)",
    "SELECT chunk_id, source_path, round(score, 6) AS score FROM d ORDER BY CASE WHEN n > 2 THEN 1 ELSE 0 END, d.score DESC, chunk_id LIMIT 10",
)
def search_documents_semantic(spark, sf):
    found = _chunk_scores(spark, sf).where("collection = 'en' and score >= 0.0").select(F.col("chunk_id").alias("id"), F.col("source_path").alias("source"), "score")
    near = vector.relative_cutoff(vector.top(found, 40), 10)
    return ranking.diversify(near, 10, 2).select(F.col("id").alias("chunk_id"), F.col("source").alias("source_path"), F.round("score", 6).alias("score"))


@query(
    C, BM25,
    "p AS (SELECT id, source_path, s.score, len(list_intersect(t, ['the', 'license', 'public', 'version'])) AS coverage FROM (SELECT * FROM scores ORDER BY score DESC, id LIMIT 40) s JOIN w ON w.chunk_id = id JOIN chunks ON chunks.chunk_id = id)",
    "d AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY coverage DESC, score DESC, id) AS n FROM p)",
    "SELECT id, source_path, coverage FROM d ORDER BY CASE WHEN n > 2 THEN 1 ELSE 0 END, coverage DESC, score DESC, id LIMIT 10",
)
def search_documents_lexical(spark, sf):
    best = vector.top(_bm25(spark, sf), 40).withColumnRenamed("id", "chunk_id")
    covered = ranking.coverage(p.chunks(spark, sf).join(F.broadcast(best), "chunk_id"), "content", TERMS)  # forty rows
    rows = covered.select(F.col("chunk_id").alias("id"), "source_path", "score", F.col("coverage").cast("long").alias("coverage"))
    n = F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("coverage"), F.desc("score"), "id"))
    return rows.withColumn("late", F.when(n > 2, 1).otherwise(0)).orderBy("late", F.desc("coverage"), F.desc("score"), "id").limit(10).select("id", "source_path", "coverage")


@query(
    C, BM25, S, M,
    "a AS (SELECT 'code' AS section, id, CAST(row_number() OVER (ORDER BY name = 'red widget' DESC, weight DESC, id) AS INT) AS rank FROM symbols WHERE contains(name, 'widget') QUALIFY rank <= 10)",
    "b AS (SELECT 'document' AS section, id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM scores QUALIFY rank <= 10)",
    "c2 AS (SELECT 'conversation' AS section, id, CAST(row_number() OVER (ORDER BY CASE WHEN role = 'user' THEN 2 ELSE 1 END DESC, id) AS INT) AS rank FROM messages WHERE contains(lower(text), 'license') QUALIFY rank <= 10)",
    "SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c2",
)
def search_context(spark, sf):
    s = p.symbols(spark, sf).where(F.col("name").contains("widget"))
    code = s.select("id", ((F.col("name") == "red widget").cast("int") * 1e9 + F.col("weight")).alias("score"))
    talk = p.messages(spark, sf).where(F.lower("text").contains("license")).select("id", F.when(F.col("role") == "user", 2.0).otherwise(1.0).alias("score"))
    sections = {"code": code, "document": _bm25(spark, sf), "conversation": talk}
    out = None
    for name, scores in sections.items():
        part = ranking.ranked(scores, name, 10).select(F.col("source").alias("section"), "id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


@query(V, QV, S, E, f"t AS (SELECT id, {COS} AS score FROM vectors, q ORDER BY score DESC, id LIMIT 10)", "SELECT t.id, name, round(score, 6) AS score, (SELECT count(*) FROM edges e WHERE e.src = t.id AND e.kind = 'Calls') AS calls, (SELECT count(*) FROM edges e WHERE e.dst = t.id AND e.kind = 'Calls') AS callers FROM t JOIN symbols s ON s.id = t.id")
def search_semantic_context(spark, sf):
    hits = F.broadcast(vector.top(vector.scored(p.vectors(spark, sf), _q(spark, sf)), 10))  # ten rows
    e = p.edges(spark, sf).where("kind = 'Calls'")
    count = lambda end, name: e.join(hits.select(F.col("id").alias(end)), end).groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
    out = p.symbols(spark, sf).select("id", "name").join(hits, "id").join(count("src", "calls"), "id", "left").join(count("dst", "callers"), "id", "left")
    return out.select("id", "name", F.round("score", 6).alias("score"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("callers", F.lit(0)).alias("callers"))


MULTI = """f AS (SELECT id, 'name' AS field, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: len(x) > 0) AS t FROM symbols UNION ALL SELECT id, 'path', list_filter(regexp_split_to_array(lower(path), '[^\\p{L}\\p{N}]+'), lambda x: len(x) > 0) FROM symbols),
st AS (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM f GROUP BY field),
q AS (SELECT id, field, len(t) AS dl, unnest(['red', 'widget', 'promo']) AS q, t FROM f), c AS (SELECT id, field, dl, q, len(list_filter(t, lambda x: x = q)) AS tf FROM q),
df AS (SELECT field, q, count(*) FILTER (tf > 0) AS df FROM c GROUP BY field, q),
multi AS (SELECT id, sum(CASE WHEN field = 'name' THEN 2.0 ELSE 1.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM c JOIN df USING (field, q) JOIN st USING (field) WHERE tf > 0 GROUP BY id)"""


@query(S, MULTI, "SELECT id, round(score, 6) AS score FROM multi")
def search_symbols_fields(spark, sf):
    from .operators.storage import built

    fields = {"name": "name", "path": "path"}
    stored = built(spark, f"{sf}/symbol_postings", lambda: agg.postings(p.symbols(spark, sf), "id", fields), ("folder",))
    sizes = built(spark, f"{sf}/symbol_lengths", lambda: agg.lengths(p.symbols(spark, sf), fields))
    return agg.bm25_of(stored, sizes, ["red", "widget", "promo"], {"name": 2.0, "path": 1.0}).withColumn("score", F.round("score", 6))
