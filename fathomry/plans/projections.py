"""Projections of the driver's tables to the engine's: symbols, edges, chunks, messages, vectors, events; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["Calls", "Uses", "Implements", "Extends", "References", "Defines", "DispatchCandidate"]

#: The same projections as CTEs for the oracle.
SYMBOLS = """symbols AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS language, p_size AS line,
  p_brand || '/' || lower(p_type) || '/f' || CAST(p_partkey % 7 AS VARCHAR) AS path, lower(p_type) || '.' || CAST(p_partkey % 7 AS VARCHAR) AS module,
  CASE p_partkey % 4 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private' WHEN 2 THEN 'Module' ELSE 'Crate' END AS visibility, p_retailprice AS weight FROM part)"""
EDGES = """edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst,
  CASE a.l_suppkey % 7 WHEN 0 THEN 'Calls' WHEN 1 THEN 'Uses' WHEN 2 THEN 'Implements' WHEN 3 THEN 'Extends' WHEN 4 THEN 'References' WHEN 5 THEN 'Defines' ELSE 'DispatchCandidate' END AS kind,
  a.l_linenumber AS line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey)"""
#: What a file (a path of symbols) imports: the module of the symbol an edge leads to; an alias for every third, a glob for every fifth.
IMPORTS = f"""{EDGES}, {SYMBOLS}, imports AS (SELECT DISTINCT a.path AS file, b.module AS path, CASE WHEN b.id % 3 = 0 THEN b.name END AS alias, b.id % 5 = 0 AS is_glob
  FROM edges e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst WHERE e.kind = 'Uses')"""
#: Pages as Markdown: links become inline links, headings lines of hashes, other tags go.
MARKDOWN = """markdown AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', '[\\2](\\1)', 'g'), '<h([1-3])[^>]*>([^<]*)</h[1-3]>', chr(10) || '# \\2' || chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS md FROM pages)"""
CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, lang AS collection, source AS source_path, text AS content FROM documents)"
MESSAGES = "messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS thread, turn AS line, role, text FROM conversations)"
VECTORS = "vectors AS (SELECT vec_id AS id, label AS segment, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    group = (n % 7).cast("string")
    kind = F.lower("p_type")
    return p.select(
        n.alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        F.col("p_brand").alias("language"),
        F.col("p_size").alias("line"),
        F.concat("p_brand", F.lit("/"), kind, F.lit("/f"), group).alias("path"),
        F.concat(kind, F.lit("."), group).alias("module"),
        F.element_at(F.array(*map(F.lit, ("Public", "Private", "Module", "Crate"))), (n % 4 + 1).cast("int")).alias("visibility"),
        F.col("p_retailprice").alias("weight"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("src"), "l_suppkey")
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("line"), F.col("l_partkey").alias("dst"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_suppkey") % 7 + 1).cast("int"))
    return a.join(b, ["l_orderkey", "line"]).where("src <> dst").select("src", "dst", kind.alias("kind"), "line").distinct()


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    a = s.select(F.col("id").alias("src"), F.col("path").alias("file"))
    b = s.select(F.col("id").alias("dst"), F.col("module").alias("path"), F.when(F.col("id") % 3 == 0, F.col("name")).alias("alias"), (F.col("id") % 5 == 0).alias("is_glob"))
    return edges(spark, sf_dir).where("kind = 'Uses'").join(a, "src").join(b, "dst").select("file", "path", "alias", "is_glob").distinct()


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.regexp_replace("html", '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)")
    md = F.regexp_replace(F.regexp_replace(md, "<h([1-3])[^>]*>([^<]*)</h[1-3]>", "\n# $2\n"), "<[^>]*>", "\n")
    return table(spark, sf_dir, "pages").select("page_id", "url", md.alias("md"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("collection"), F.col("source").alias("source_path"), F.col("text").alias("content"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("thread"), F.col("turn").alias("line"), "role", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("segment"), F.col("embedding").cast("array<double>").alias("v"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("path"), "event_type", "props")
