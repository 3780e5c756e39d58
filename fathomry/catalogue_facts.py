"""Queries on facts: sources, sinks, predicates, resolution, change detection, streams as batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import LIVE, OLD, C, E, M, S, V, _snapshots, query
from .operators import graph, joins, ranking, resolution, vector
from .plans import projections as p
from .sources import readers, sinks

Q = "'"

# sources


@query("SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS dir FROM pages")
def scan_fs_dirs(spark, sf):
    return readers.directories(p.table(spark, sf, "pages").select(F.col("url").alias("path")))


@query("SELECT url AS path, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages")
def scan_fs_snapshot(spark, sf):
    files = p.table(spark, sf, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("bytes"))
    return readers.snapshot(files, 10_000_000, 1 << 40)


GLOBS = ["**/*1", "http*://*/**/?[0-9]*", "**/a*"]


@query(f"SELECT DISTINCT url AS path FROM pages WHERE regexp_matches(url, '{'|'.join(map(readers.glob_pattern, GLOBS)).replace(Q, Q + Q)}')")
def scan_doc_collection(spark, sf):
    return readers.collection(p.table(spark, sf, "pages").select(F.col("url").alias("path")), GLOBS)


@query(S, "SELECT path AS file, name, id FROM symbols WHERE visibility = 'Public'")
def scan_exports(spark, sf):
    return readers.exports_of(readers.store_exports(p.symbols(spark, sf)))


MOCK = ["license", "version", "public"]


@query(C, "w AS (SELECT chunk_id, [CASE WHEN contains(lower(content), 'license') THEN 0.9 ELSE 0.1 END, CASE WHEN contains(lower(content), 'version') THEN 0.9 ELSE 0.1 END, CASE WHEN contains(lower(content), 'public') THEN 0.9 ELSE 0.1 END, 0.1]::DOUBLE[] AS v FROM chunks)", "SELECT chunk_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[4] / sqrt(list_dot_product(v, v)), 6) AS last FROM w")
def scan_embedding_mock(spark, sf):
    v = readers.mock_vectors(p.chunks(spark, sf), "chunk_id", "content", MOCK, 4)
    return v.select("chunk_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[3], 6).alias("last"))


# sinks: what is written is read back


@query(S, "SELECT language, count(*) AS n, max(id) AS last FROM symbols GROUP BY language")
def sink_symbol(spark, sf):
    return sinks.written(p.symbols(spark, sf), "language").groupBy("language").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query(E, "SELECT src, dst, kind, line FROM edges WHERE kind = 'Implements'")
def sink_edge(spark, sf):
    return sinks.written(p.edges(spark, sf), "kind").where("kind = 'Implements'")


@query("SELECT url AS path, sha256(html) AS hash FROM pages")
def sink_file(spark, sf):
    return sinks.written(p.table(spark, sf, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("hash")))


@query(p.IMPORTS, "SELECT file, path, alias, is_glob FROM imports WHERE is_glob")
def sink_import_export(spark, sf):
    return sinks.written(p.imports(spark, sf)).where("is_glob")


@query(S, "SELECT id, name FROM symbols WHERE path <> 'Brand#2/promo/f1'")
def sink_delete_file(spark, sf):
    gone = p.symbols(spark, sf).where("path = 'Brand#2/promo/f1'").select("path").distinct()
    return sinks.written(p.symbols(spark, sf).join(gone, "path", "left_anti").select("id", "name"))


@query(S, "SELECT id, name FROM symbols WHERE id % 3 = 0")
def sink_batch_txn(spark, sf):
    s, table = p.symbols(spark, sf).select("id", "name"), sinks.Generations(spark)
    table.publish(table.stage(s.where("id % 2 = 0")))
    table.publish(table.stage(s.where("id % 3 = 0")))
    table.stage(s.where("id % 5 = 0"))  # never published: rolled back
    return table.current()


@query(C, "SELECT collection, count(*) AS n FROM chunks GROUP BY collection")
def sink_doc_generation(spark, sf):
    table = sinks.Generations(spark)
    table.publish(table.stage(p.chunks(spark, sf).groupBy("collection").agg(F.count("*").alias("n"))))
    return table.current()


@query(V, "SELECT id, round(CASE WHEN id % 4 = 0 THEN 2 * v[1] ELSE v[1] END, 6) AS head FROM vectors")
def sink_vectors(spark, sf):
    v = p.vectors(spark, sf).select("id", F.col("v")[0].alias("head"))
    kept, replaced = v.where("id % 4 <> 0"), v.where("id % 4 = 0").withColumn("head", 2 * F.col("head"))
    return sinks.written(kept.union(replaced)).select("id", F.round("head", 6).alias("head"))


@query(V, "SELECT id, round(CASE WHEN id % 3 = 0 THEN v[1] + 1 ELSE v[1] END, 6) AS head FROM vectors WHERE id % 7 <> 0 UNION ALL SELECT id + 1000000, round(v[1], 6) FROM vectors WHERE id % 100 = 1")
def sink_journal(spark, sf):
    v = p.vectors(spark, sf).select("id", F.col("v")[0].alias("head"))
    change = lambda rows, seq, gone: rows.withColumns({"seq": F.lit(seq), "deleted": F.lit(gone)})
    deltas = change(v.where("id % 3 = 0").withColumn("head", F.col("head") + 1), 1, False).union(change(v.where("id % 7 = 0"), 2, True))
    deltas = deltas.union(change(v.where("id % 100 = 1").withColumn("id", F.col("id") + 1000000), 3, False))
    return sinks.journal(v, sinks.written(deltas), "id").select("id", F.round("head", 6).alias("head"))


@query(C, "SELECT DISTINCT sha256(content) AS hash FROM chunks WHERE sha256(content) NOT IN (SELECT sha256(content) FROM chunks WHERE chunk_id % 2 = 0)")
def sink_embedding_cache(spark, sf):
    c = p.chunks(spark, sf).select("chunk_id", F.sha2("content", 256).alias("hash"))
    return sinks.misses(c, c.where("chunk_id % 2 = 0"))


@query(S, "SELECT language, CAST(json_object('status', 'ok', 'entity', 'symbol', 'count', count(*)) AS VARCHAR) AS envelope FROM symbols GROUP BY language")
def sink_envelope(spark, sf):
    counts = p.symbols(spark, sf).groupBy("language").agg(F.count("*").alias("n"))
    return counts.select("language", sinks.envelope(status=F.lit("ok"), entity=F.lit("symbol"), count=F.col("n")).alias("envelope"))


@query(C, "f AS (SELECT chunk_id, length(content) AS n FROM chunks ORDER BY n DESC, chunk_id LIMIT 1000)", "u AS (SELECT *, sum(n) OVER (ORDER BY n DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM f)", "SELECT chunk_id, CAST(n AS INT) AS n FROM u WHERE used <= 200000")
def sink_bounded_output(spark, sf):
    rows = p.chunks(spark, sf).select("chunk_id", F.length("content").alias("n"))
    return sinks.bounded_output(rows, F.col("n"), 200_000, F.desc("n"), "chunk_id")


# predicates and projections


@query(S, C, "SELECT 'symbol' AS entity, count(*) AS n FROM symbols WHERE name = 'red widget' UNION ALL SELECT 'chunk', count(*) FROM chunks WHERE collection = 'en'")
def filter_doc_type(spark, sf):
    s = p.symbols(spark, sf).where("name = 'red widget'").agg(F.count("*").alias("n")).select(F.lit("symbol").alias("entity"), "n")
    return s.union(p.chunks(spark, sf).where("collection = 'en'").agg(F.count("*")).select(F.lit("chunk"), "count(1)"))


ALLOWED = [("Calls", "ECONOMY", "SMALL"), ("Calls", "SMALL", "SMALL"), ("Calls", "PROMO", "MEDIUM"), ("Extends", "LARGE", "LARGE"), ("Uses", "STANDARD", "ECONOMY")]


@query(E, S, f"ok(relation, a, b) AS (VALUES {', '.join(map(str, ALLOWED))})", "SELECT src, dst, e.kind, e.line FROM edges e JOIN symbols x ON x.id = src JOIN symbols y ON y.id = dst JOIN ok ON relation = e.kind AND ok.a = x.kind AND ok.b = y.kind")
def pred_kind_compat(spark, sf):
    allowed = F.broadcast(spark.createDataFrame(ALLOWED, "kind string, a string, b string"))
    s = p.symbols(spark, sf)
    a, b = s.select(F.col("id").alias("src"), F.col("kind").alias("a")), s.select(F.col("id").alias("dst"), F.col("kind").alias("b"))
    return p.edges(spark, sf).join(a, "src").join(b, "dst").join(allowed, ["kind", "a", "b"], "left_semi").select("src", "dst", "kind", "line")


@query(S, "SELECT id, kind IN ('SMALL', 'MEDIUM') OR visibility = 'Crate' AS is_member FROM symbols")
def pred_member(spark, sf):
    return p.symbols(spark, sf).select("id", (F.col("kind").isin("SMALL", "MEDIUM") | (F.col("visibility") == "Crate")).alias("is_member"))


@query(S, "SELECT id, kind IN ('ECONOMY', 'PROMO', 'LARGE') AND weight > 1000 AS eligible FROM symbols")
def pred_embed_eligible(spark, sf):
    return p.symbols(spark, sf).select("id", (F.col("kind").isin("ECONOMY", "PROMO", "LARGE") & (F.col("weight") > 1000)).alias("eligible"))


@query(OLD, LIVE, "SELECT o.path, CASE WHEN o.path % 2 = l.path % 2 AND o.path % 3 <> 0 THEN FALSE ELSE o.hash <> l.hash END AS modified FROM old o JOIN live l ON o.path = l.path")
def pred_modified(spark, sf):
    old, live = _snapshots(spark, sf)
    # a time that is equal and not of a whole second needs no hash
    timed = lambda df: df.withColumn("mtime", F.col("path") % 2 * 1000 + F.col("path") % 3)
    a, b = timed(old), timed(live).select("path", F.col("hash").alias("now"), F.col("mtime").alias("seen"))
    sure = (F.col("mtime") == F.col("seen")) & (F.col("path") % 3 != 0)
    return a.join(b, "path").select("path", F.when(sure, False).otherwise(F.col("hash") != F.col("now")).alias("modified"))


@query(S, "SELECT id, name, lower(kind) AS kind, CASE WHEN starts_with(path, 'Brand#1/') THEN substring(path, 9) ELSE path END AS path, line + 1 AS line FROM symbols")
def proj_symbol(spark, sf):
    from .functions import text as fx

    return p.symbols(spark, sf).select("id", "name", F.lower("kind").alias("kind"), fx.portable_path(F.col("path"), "Brand#1").alias("path"), (F.col("line") + 1).alias("line"))


@query(E, "SELECT src, dst, kind, line, CASE WHEN line > 2 OR kind = 'Calls' THEN json_object('line', CASE WHEN line > 2 THEN line END, 'context', CASE WHEN kind = 'Calls' THEN 'call' END)::VARCHAR END AS metadata FROM edges")
def proj_edge_meta(spark, sf):
    line, context = F.when(F.col("line") > 2, F.col("line")), F.when(F.col("kind") == "Calls", "call")
    meta = F.when(line.isNotNull() | context.isNotNull(), F.to_json(F.struct(line.alias("line"), context.alias("context")), {"ignoreNullFields": "false"}))
    return p.edges(spark, sf).select("src", "dst", "kind", "line", meta.alias("metadata"))


@query(S, "SELECT id, json_object('name', name, 'path', path)::VARCHAR AS fields FROM symbols")
def proj_fields(spark, sf):
    return p.symbols(spark, sf).select("id", F.to_json(F.struct("name", "path")).alias("fields"))


# resolution

CALL = "calls AS (SELECT id AS call_id, name, path, module, language, CAST((line * 7) % 50 AS INT) AS line FROM symbols)"


def _calls(spark, sf):
    return p.symbols(spark, sf).select(F.col("id").alias("call_id"), "name", "path", "module", "language", (F.col("line") * 7 % 50).alias("line"))


@query(
    p.IMPORTS,
    CALL,
    "i AS (SELECT file, path AS wanted, coalesce(alias, string_split(path, '.')[-1]) AS name FROM imports)",
    "cand AS (SELECT DISTINCT c.call_id, s.id AS target FROM calls c JOIN i ON i.file = c.path AND i.name = c.name JOIN symbols s ON s.module = i.wanted AND s.name = c.name)",
    "SELECT call_id, min(target) AS target FROM cand GROUP BY call_id HAVING count(*) = 1",
)
def join_import_tier(spark, sf):
    return resolution.import_tier(_calls(spark, sf), p.imports(spark, sf), p.symbols(spark, sf))


@query(S, CALL, "r AS (SELECT c.call_id, c.line, s.line AS def_line, s.kind, row_number() OVER (PARTITION BY c.call_id ORDER BY s.line DESC, s.id) AS k FROM calls c JOIN symbols s ON s.path = c.path AND s.name = c.name AND s.line <= c.line)", "SELECT call_id, kind AS type FROM r WHERE k = 1 AND def_line >= line - 20")
def join_asof_binding(spark, sf):
    place = F.struct("path", "name").alias("place")
    s = p.symbols(spark, sf).select("id", "line", "kind", place)
    last = joins.asof_closest(_calls(spark, sf).select("call_id", "line", place), s, "place")
    inside = last.join(_calls(spark, sf).select("call_id", "line"), "call_id").where("def_line >= line - 20")  # in the caller's span
    return inside.join(s.select(F.col("id").alias("target"), "kind"), "target").select("call_id", F.col("kind").alias("type"))


@query(S, CALL, "u AS (SELECT module, name, min(id) AS target FROM symbols GROUP BY module, name HAVING count(*) = 1)", "SELECT call_id, target FROM calls JOIN u USING (module, name)")
def join_member_of_class(spark, sf):
    only = joins.exactly_one(p.symbols(spark, sf).select("module", "name", F.col("id").alias("target")), "module", "name")
    return _calls(spark, sf).join(only, ["module", "name"]).select("call_id", "target")


@query(
    S,
    CALL,
    "f AS (SELECT c.call_id, count(*) AS n2, min(s.id) AS t2, count(*) FILTER (s.path = c.path AND s.line = c.line) AS n1, min(s.id) FILTER (s.path = c.path AND s.line = c.line) AS t1, count(*) FILTER (s.path = c.path AND s.line BETWEEN c.line - 10 AND c.line + 10) AS n3, min(s.id) FILTER (s.path = c.path AND s.line BETWEEN c.line - 10 AND c.line + 10) AS t3 FROM calls c JOIN symbols s USING (name, module) GROUP BY c.call_id)",
    "SELECT call_id, CASE WHEN n1 = 1 THEN t1 WHEN n2 = 1 THEN t2 ELSE t3 END AS target, CASE WHEN n1 = 1 THEN 'site' WHEN n2 = 1 THEN 'class' ELSE 'span' END AS evidence FROM f WHERE n1 = 1 OR n2 = 1 OR n3 = 1",
)
def join_defines_containment(spark, sf):
    return resolution.containment(_calls(spark, sf), p.symbols(spark, sf), 10)


CHAIN = "x AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'Extends'), a1 AS (SELECT src AS id, dst AS ancestor, 1 AS distance FROM x), a2 AS (SELECT DISTINCT a1.id, x.dst AS ancestor, 2 AS distance FROM a1 JOIN x ON x.src = a1.ancestor), chain AS (SELECT id, ancestor, min(distance) AS distance FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2) GROUP BY id, ancestor)"


def _extends(spark, sf):
    return p.edges(spark, sf).where("kind = 'Extends'")


@query(
    E,
    S,
    CHAIN,
    "m AS (SELECT DISTINCT src AS ancestor, dst AS target, name FROM edges e JOIN symbols s ON s.id = dst WHERE e.kind = 'Defines')",
    "found AS (SELECT DISTINCT c.id AS call_id, m.target, k.distance FROM symbols c JOIN chain k ON k.id = c.id JOIN m ON m.ancestor = k.ancestor AND m.name = c.name)",
    "least AS (SELECT call_id, min(distance) AS distance FROM found GROUP BY call_id)",
    "SELECT call_id, min(target) AS target FROM found JOIN least USING (call_id, distance) GROUP BY call_id HAVING count(DISTINCT target) = 1",
)
def join_typed_receiver(spark, sf):
    s = p.symbols(spark, sf)
    members = p.edges(spark, sf).where("kind = 'Defines'").join(s.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("owner"), F.col("dst").alias("target"), "name").distinct()
    calls = s.select(F.col("id").alias("call_id"), F.col("id").alias("receiver"), "name")
    return resolution.typed_receiver(calls, resolution.ancestors(_extends(spark, sf), 2), members)


@query()
def join_super_mro(spark, sf):
    parents = _extends(spark, sf).where("src < dst").groupBy("src", "dst").agg(F.min("line").alias("position"))
    return resolution.mro(parents, 2).where("position = 1").select("id", F.col("ancestor").alias("next"))


@query(
    S,
    CALL,
    "l AS (SELECT path, name, min(id) AS t FROM symbols GROUP BY path, name HAVING count(*) = 1)",
    "m AS (SELECT module, name, min(id) AS t FROM symbols GROUP BY module, name HAVING count(*) = 1)",
    "g AS (SELECT language, name, min(id) AS t FROM symbols GROUP BY language, name HAVING count(*) = 1)",
    "SELECT call_id, coalesce(l.t, m.t, g.t) AS parent FROM calls c LEFT JOIN l ON l.path = c.path AND l.name = c.name LEFT JOIN m ON m.module = c.module AND m.name = c.name LEFT JOIN g ON g.language = c.language AND g.name = c.name WHERE coalesce(l.t, m.t, g.t) IS NOT NULL",
)
def join_parent_class(spark, sf):
    s, out = p.symbols(spark, sf), _calls(spark, sf)
    for scope in ("path", "module", "language"):
        only = joins.exactly_one(s.select(scope, "name", F.col("id").alias(f"by_{scope}")), scope, "name")
        out = out.join(only, [scope, "name"], "left")
    return out.select("call_id", F.coalesce("by_path", "by_module", "by_language").alias("parent")).where("parent is not null")


@query(E, S, "x AS (SELECT path AS file, name, count(*) AS n FROM symbols WHERE visibility = 'Public' GROUP BY path, name)", "r AS (SELECT DISTINCT s.path AS file, s.name FROM edges e JOIN symbols s ON s.id = e.dst WHERE e.kind = 'Uses')", "SELECT file, name, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM r LEFT JOIN x USING (file, name)")
def join_export_resolve(spark, sf):
    s = p.symbols(spark, sf)
    wanted = p.edges(spark, sf).where("kind = 'Uses'").join(s.select(F.col("id").alias("dst"), F.col("path").alias("file"), "name"), "dst")
    return resolution.export_status(wanted, s.where("visibility = 'Public'").select(F.col("path").alias("file"), "name"))


IDENTITY = ("path", "name", "kind")


@query(E, S, "n AS (SELECT id + 1000000 AS fresh, path, name, kind FROM symbols WHERE id % 9 <> 0)", "u AS (SELECT path, name, kind, min(fresh) AS fresh FROM n GROUP BY path, name, kind HAVING count(*) = 1)", "SELECT e.src, u.fresh AS dst, e.kind, e.line FROM edges e JOIN symbols s ON s.id = e.dst JOIN u ON u.path = s.path AND u.name = s.name AND u.kind = s.kind")
def join_rebind(spark, sf):
    s = p.symbols(spark, sf)
    old, new = s.withColumnRenamed("kind", "sort"), s.where("id % 9 <> 0").withColumns({"id": F.col("id") + 1000000}).withColumnRenamed("kind", "sort")
    return resolution.rebound(p.edges(spark, sf), old, new, ("path", "name", "sort"))


@query(
    p.IMPORTS,
    "f AS (SELECT DISTINCT path AS file, module FROM symbols)",
    "r(id) AS (SELECT module FROM f WHERE file = 'Brand#2/promo/f1' UNION SELECT f.module FROM r JOIN imports i ON i.path = r.id JOIN f ON f.file = i.file)",
    "SELECT DISTINCT i.file FROM imports i JOIN r ON r.id = i.path WHERE i.file <> 'Brand#2/promo/f1'",
)
def join_import_dependents(spark, sf):
    modules = p.symbols(spark, sf).select(F.col("path").alias("file"), "module").distinct()
    return resolution.import_dependents(p.imports(spark, sf), modules, "Brand#2/promo/f1")


@query(
    OLD,
    LIVE,
    S,
    "SELECT 'source_missing' AS finding, CAST(path AS VARCHAR) AS subject FROM old WHERE path NOT IN (SELECT path FROM live) UNION ALL SELECT 'source_changed', CAST(o.path AS VARCHAR) FROM old o JOIN live l ON l.path = o.path AND l.hash <> o.hash UNION ALL SELECT 'ambiguous_reference', name FROM symbols GROUP BY name HAVING count(*) > 1",
)
def join_kdrift(spark, sf):
    old, live = _snapshots(spark, sf)
    status = joins.detect_changes(old, live).where("status in ('removed', 'changed')")
    findings = status.select(F.when(F.col("status") == "removed", "source_missing").otherwise("source_changed").alias("finding"), F.col("path").cast("string").alias("subject"))
    several = p.symbols(spark, sf).groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    return findings.union(several.select(F.lit("ambiguous_reference"), "name"))


ANCHORED = "d AS (SELECT id AS doc, 'see `' || replace(name, ' ', '_') || '` and `nothing_here`, `' || replace(name, ' ', '_') || '`' AS text FROM symbols WHERE id % 5 = 0)"


@query(S, ANCHORED, "a AS (SELECT DISTINCT doc, unnest(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)) AS anchor FROM d)", "SELECT doc, s.id FROM a JOIN symbols s ON replace(s.name, ' ', '_') = anchor")
def join_anchor_symbols(spark, sf):
    from .functions import text as fx

    s = p.symbols(spark, sf).select("id", F.replace("name", F.lit(" "), F.lit("_")).alias("anchor"))
    docs = s.where("id % 5 = 0").select(F.col("id").alias("doc"), F.concat(F.lit("see `"), "anchor", F.lit("` and `nothing_here`, `"), "anchor", F.lit("`")).alias("text"))
    return joins.pairs(docs.select("doc", F.explode(fx.backticks(F.col("text"))).alias("anchor")), s, "anchor").select("doc", "id")


@query(S, E, "h AS (SELECT DISTINCT language, path FROM symbols WHERE starts_with(path, 'Brand#3/'))", "SELECT e.src, e.dst, 'describes' AS relation FROM edges e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst WHERE e.kind IN ('References', 'Implements') AND a.path IN (SELECT path FROM h) AND b.name IN (SELECT name FROM symbols GROUP BY name, language, line HAVING count(*) = 1)")
def join_knowledge_links(spark, sf):
    s = p.symbols(spark, sf)
    sources = s.where(F.col("path").startswith("Brand#3/")).select(F.col("id").alias("src"))
    unique = joins.exactly_one(s.select("name", "language", "line"), "name", "language", "line").select("name").distinct()
    targets = s.join(unique, "name", "left_semi").select(F.col("id").alias("dst"))
    links = p.edges(spark, sf).where("kind in ('References', 'Implements')").join(sources, "src", "left_semi").join(targets, "dst", "left_semi")
    return links.select("src", "dst", F.lit("describes").alias("relation"))


# sets, changes, streams


@query(S, "h AS (SELECT id, 2.0 AS s FROM symbols WHERE name = 'red widget' UNION ALL SELECT id, 1.0 FROM symbols WHERE contains(name, 'wid') UNION ALL SELECT id, 0.5 FROM symbols WHERE levenshtein(name, 'red widget') <= 1)", "SELECT id, CAST(sum(s) AS DOUBLE) AS score FROM h GROUP BY id")
def set_union_queries(spark, sf):
    s = p.symbols(spark, sf)
    hits = [(s.where("name = 'red widget'"), 2.0), (s.where(F.col("name").contains("wid")), 1.0), (s.where(F.levenshtein("name", F.lit("red widget")) <= 1), 0.5)]
    every = None
    for rows, score in hits:
        part = rows.select("id", F.lit(score).alias("s"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.sum("s").alias("score"))


@query(S, "SELECT id, language AS repo FROM symbols WHERE language IN ('Brand#1', 'Brand#2')")
def set_union_graphs(spark, sf):
    graphs = [p.symbols(spark, sf).where(F.col("language") == r).select("id", F.col("language").alias("repo")) for r in ("Brand#1", "Brand#2")]
    both = graphs[0].unionByName(graphs[1])
    if not both.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a node is in two graphs")
    return both


@query(C, "SELECT chunk_id, list_sort(list_distinct(list_intersect(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), ['the', 'license', 'of', 'version'])))::VARCHAR AS shared FROM chunks WHERE len(list_intersect(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), ['the', 'license', 'of', 'version'])) >= 2")
def set_intersect_terms(spark, sf):
    from .operators.aggregates import terms_of

    shared = F.array_sort(F.array_intersect(terms_of(F.col("content")), F.array(*map(F.lit, ("the", "license", "of", "version")))))
    text = F.concat(F.lit("["), F.array_join(shared, ", "), F.lit("]"))
    return p.chunks(spark, sf).select("chunk_id", shared.alias("s"), text.alias("shared")).where(F.size("s") >= 2).select("chunk_id", "shared")


@query(E, "h AS (SELECT DISTINCT src, dst FROM edges)", "r(id, d) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT h.dst, d + 1 FROM r JOIN h ON h.src = r.id WHERE d < 2)", "SELECT DISTINCT id FROM r")
def set_distinct_visited(spark, sf):
    return graph.reach(p.edges(spark, sf), spark.createDataFrame([(3,)], "id long"), 2).select("id")


@query(E, "SELECT DISTINCT src, dst, kind FROM edges")
def sort_normalize(spark, sf):
    return p.edges(spark, sf).select("src", "dst", "kind").dropDuplicates().orderBy("src", "dst", "kind")


@query(S, "SELECT id FROM symbols WHERE kind = 'PROMO'")
def limit_budget(spark, sf):
    return ranking.within_budget(p.symbols(spark, sf).where("kind = 'PROMO'").select("id"), 10_000_000)


@query(E, "o AS (SELECT src, dst, kind, line, row_number() OVER (ORDER BY src, dst, kind, line) AS n FROM edges WHERE src <= 50)", "SELECT src, dst, kind, line, (SELECT count(*) FROM o) > 100 AS truncated FROM o WHERE n <= 100")
def limit_examined(spark, sf):
    near = p.edges(spark, sf).where("src <= 50")
    first = near.orderBy("src", "dst", "kind", "line").limit(100)
    return first.crossJoin(F.broadcast(near.agg((F.count("*") > 100).alias("truncated"))))


@query(OLD, LIVE, "s AS (SELECT CASE WHEN o.path IS NULL THEN 'created' WHEN l.path IS NULL THEN 'removed' WHEN o.hash = l.hash THEN 'skipped' ELSE 'processed' END AS status FROM old o FULL JOIN live l ON o.path = l.path)", "SELECT count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'removed') AS removed FROM s")
def agg_index_stats(spark, sf):
    status = joins.detect_changes(*_snapshots(spark, sf))
    n = lambda s: F.count_if(F.col("status") == s)
    return status.agg(n("changed").alias("processed"), n("unchanged").alias("skipped"), n("new").alias("created"), n("removed").alias("removed"))


@query(S, V, "SELECT (SELECT count(*) FROM symbols s WHERE visibility = 'Public' AND s.id IN (SELECT id FROM vectors)) AS live, (SELECT count(*) FROM vectors) AS stored, (SELECT count(*) FROM symbols WHERE visibility = 'Public' AND id NOT IN (SELECT id FROM vectors)) AS missing, (SELECT count(*) FROM vectors WHERE id NOT IN (SELECT id FROM symbols)) AS orphaned")
def agg_embedding_diag(spark, sf):
    s = p.symbols(spark, sf).select("id", (F.col("visibility") == "Public").alias("public"))
    both = s.join(p.vectors(spark, sf).select("id", F.lit(True).alias("vector")), "id", "full")
    public, stored = F.coalesce("public", F.lit(False)), F.col("vector").isNotNull()
    return both.agg(F.count_if(public & stored).alias("live"), F.count_if(stored).alias("stored"), F.count_if(public & ~stored).alias("missing"), F.count_if(F.col("public").isNull()).alias("orphaned"))


@query(C, S, "SELECT (SELECT count(*) FROM chunks) AS files, (SELECT count(DISTINCT sha256(content)) FROM chunks) AS inputs, (SELECT CAST(sum(octet_length(encode(content))) AS BIGINT) FROM chunks) AS bytes, (SELECT count(*) FROM symbols) AS symbols")
def agg_plan_counts(spark, sf):
    c = p.chunks(spark, sf).agg(F.count("*").alias("files"), F.count_distinct(F.sha2("content", 256)).alias("inputs"), F.sum(F.octet_length("content")).alias("bytes"))
    return c.crossJoin(p.symbols(spark, sf).agg(F.count("*").alias("symbols")))


@query(OLD, LIVE, "SELECT path, 'add' AS action FROM live WHERE path NOT IN (SELECT path FROM old) UNION ALL SELECT path, 'remove' FROM old WHERE path NOT IN (SELECT path FROM live)")
def inc_sync_config(spark, sf):
    old, live = (df.select("path") for df in _snapshots(spark, sf))
    return live.join(old, "path", "left_anti").withColumn("action", F.lit("add")).union(old.join(live, "path", "left_anti").withColumn("action", F.lit("remove")))


@query(OLD, LIVE, "SELECT path FROM (SELECT o.path FROM old o JOIN live l ON l.path = o.path AND l.hash <> o.hash UNION SELECT path FROM live WHERE path NOT IN (SELECT path FROM old)) WHERE path % 4 <> 0")
def inc_pending(spark, sf):
    marked = joins.detect_changes(*_snapshots(spark, sf)).where("status in ('new', 'changed')").select("path")
    resolved = marked.where("path % 4 = 0")
    return sinks.written(marked).join(resolved, "path", "left_anti")


@query(M, "SELECT id, role, sha256(text) AS hash FROM messages")
def inc_recall_import(spark, sf):
    m = p.messages(spark, sf).select("id", "role", F.sha2("text", 256).alias("hash"))
    held = m.where("id % 3 <> 0").withColumn("hash", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("hash")))
    fresh = m.join(held.select("id", "hash"), ["id", "hash"], "left_anti")  # unchanged ones are left alone
    return held.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


WINDOWS = "w AS (SELECT path, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 1500) / 1400.0) AS INT)) + 1)) AS n FROM t)"


@query("t AS (SELECT CASE WHEN doc_id % 13 = 0 THEN doc_id + 1000000 ELSE doc_id END AS path, CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)", WINDOWS, "SELECT path, CAST(n AS INT) AS n, sha256(substring(text, CAST(n * 1400 + 1 AS BIGINT), 1500)) AS hash FROM w")
def index_collection(spark, sf):
    d, n = p.table(spark, sf, "documents"), F.col("doc_id")
    before = d.where("doc_id % 11 <> 0").select(n.alias("path"), "text")
    now = d.where("doc_id % 7 <> 0").select(F.when(n % 13 == 0, n + 1000000).otherwise(n).alias("path"), F.when(n % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    hashed = lambda df: df.select("path", F.sha2("text", 256).alias("hash"))
    status = joins.detect_changes(hashed(before), hashed(now))
    cut = lambda df: ranking.sliding_chunks(df, "path", "text", 1500, 100)
    stored = cut(before).join(status.where("status = 'unchanged'").select("path"), "path", "left_semi")
    fresh = cut(now.join(status.where("status in ('new', 'changed')").select("path"), "path", "left_semi"))
    return stored.union(fresh).select("path", "n", F.sha2("content", 256).alias("hash"))


@query("t AS (SELECT doc_id AS path, CASE WHEN doc_id = 5 THEN text || ' more' ELSE text END AS text FROM documents)", WINDOWS, "SELECT path, CAST(n AS INT) AS n, sha256(substring(text, CAST(n * 1400 + 1 AS BIGINT), 1500)) AS hash FROM w")
def inc_reindex_doc(spark, sf):
    d = p.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    cut = lambda df: ranking.sliding_chunks(df, "path", "text", 1500, 100)
    again = d.where("path = 5").withColumn("text", F.concat("text", F.lit(" more")))
    return cut(d).where("path <> 5").union(cut(again)).select("path", "n", F.sha2("content", 256).alias("hash"))


@query(
    "g AS (SELECT event_type, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))",
    "n AS (SELECT event_type, ts, sum(s) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)",
    "f AS (SELECT event_type, k, ts, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY event_type, k)) AS age FROM n)",
    "SELECT event_type AS collection, epoch_us(min(ts)) AS first, count(*) AS n FROM f GROUP BY event_type, k, age // 7200000000",
)
def stream_doc_batch(spark, sf):
    from .streaming import changes

    e = p.events(spark, sf).select(F.col("event_type").alias("collection"), "ts")
    return changes.bounded_bursts(e, "collection", 30 * 60, 2 * 3600).select("collection", F.unix_micros(F.col("first").cast("timestamp")).alias("first"), "n")


@query(
    "g AS (SELECT user_id, event_type, ts, CASE WHEN lag(ts) OVER (ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (ORDER BY ts, event_id) >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS s FROM events)",
    "n AS (SELECT user_id, event_type, ts, sum(s) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)",
    "SELECT epoch_us(min(ts)) AS first, count(DISTINCT user_id) AS paths, count(*) FILTER (event_type = 'error') AS removals FROM n GROUP BY k",
)
def stream_burst(spark, sf):
    e = p.events(spark, sf)
    settled = e.groupBy(F.session_window("ts", "10 minutes")).agg(F.min("ts").alias("first"), F.count_distinct("path").alias("paths"), F.count_if(F.col("event_type") == "error").alias("removals"))
    return settled.select(F.unix_micros(F.col("first").cast("timestamp")).alias("first"), "paths", "removals")


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS ready, count(DISTINCT user_id) AS paths, CASE WHEN count(DISTINCT user_id) >= 32 THEN 'wave' ELSE 'single' END AS work FROM events GROUP BY time_bucket(INTERVAL 6 HOUR, ts)")
def stream_threshold(spark, sf):
    ready = p.events(spark, sf).groupBy(F.window("ts", "6 hours")).agg(F.count_distinct("path").alias("paths"))
    return ready.select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("ready"), "paths", F.when(F.col("paths") >= 32, "wave").otherwise("single").alias("work"))


@query(S, "SELECT id AS old_id, CAST(row_number() OVER (ORDER BY path, line, id) AS BIGINT) AS id FROM symbols")
def collect_ids(spark, sf):
    s = p.symbols(spark, sf).select(F.col("id").alias("old_id"), "path", "line")
    # numbers within a file, and how many stand in the files before it: no table in one task but that of the files
    within = s.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line", "old_id")))
    files = s.groupBy("path").agg(F.count("*").alias("size"))
    before = files.select("path", (F.sum("size").over(Window.orderBy("path")) - F.col("size")).alias("before"))
    return within.join(before, "path").select("old_id", (F.col("before") + F.col("n")).alias("id"))


@query()
def ann_kmeans(spark, sf):
    return vector.kmeans(p.vectors(spark, sf), 10, 7).select("id", "cluster")
