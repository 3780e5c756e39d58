"""Sources and sinks: file trees, JSON-Lines dumps, transcripts, manifests, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content, hash, mtime) of the files under a folder; folders and files that begin with a dot are skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    visible = ~F.col("path").rlike(r"/\.[^/]*$")
    return raw.where(visible).select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("mtime"))


def write_dump(symbols: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as JSON lines: a begin row, symbols, relationships, and a summary with the numbers of both."""
    begin = symbols.sparkSession.range(1).select(F.lit(0).alias("k"), F.to_json(F.struct(F.lit("begin").alias("type"))).alias("value"))
    rows = symbols.select(F.lit(1).alias("k"), F.to_json(F.struct(F.lit("symbol").alias("type"), F.struct("*").alias("symbol"))).alias("value"))
    links = edges.select(F.lit(2).alias("k"), F.to_json(F.struct(F.lit("relationship").alias("type"), F.struct("*").alias("relationship"))).alias("value"))
    n = symbols.agg(F.count("*").alias("symbols")).crossJoin(edges.agg(F.count("*").alias("relationships")))
    end = n.select(F.lit(3).alias("k"), F.to_json(F.struct(F.lit("summary").alias("type"), "symbols", "relationships")).alias("value"))
    begin.union(rows).union(links).union(end).repartitionByRange("k").sortWithinPartitions("k").select("value").write.text(path)


def read_dump(spark: SparkSession, path: str, symbol_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and relationships of a dump; its summary must agree."""
    parsed = spark.read.text(path).select(F.from_json("value", f"type string, symbol struct<{symbol_schema}>, relationship struct<{edge_schema}>, symbols long, relationships long").alias("r")).select("r.*")
    symbols, edges = parsed.where("type = 'symbol'").select("symbol.*"), parsed.where("type = 'relationship'").select("relationship.*")
    told = parsed.where("type = 'summary'").select("symbols", "relationships").first()
    if told is None or (told["symbols"], told["relationships"]) != (symbols.count(), edges.count()):
        raise ValueError("the dump's summary doesn't agree with its rows")
    return symbols, edges


def transcripts(lines: DataFrame) -> DataFrame:
    """(id, role, text, provider) of transcript lines (value) in either dialect; meta and side rows and repeats go."""
    block = "array<struct<type: string, text: string>>"
    schema = f"type string, uuid string, sessionId string, isMeta boolean, isSidechain boolean, message struct<role: string, content: {block}>, payload struct<type: string, role: string, content: {block}>"
    r = lines.select(F.from_json("value", schema).alias("r")).select("r.*").where("not coalesce(isMeta, false) and not coalesce(isSidechain, false)")
    text = lambda c: F.array_join(F.transform(F.filter(c, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    a = r.where("type = 'response_item' and payload.type = 'message'").select(F.col("payload.role").alias("role"), text(F.col("payload.content")).alias("text"), F.lit("a").alias("provider"))
    b = r.where("type in ('user', 'assistant') and message is not null").select(F.col("message.role").alias("role"), text(F.col("message.content")).alias("text"), F.lit("b").alias("provider"))
    both = a.union(b).where("text <> ''")
    return both.withColumn("id", F.sha2(F.concat_ws("\u0000", "provider", "role", "text"), 256)).dropDuplicates(["id"])


def package_manifests(manifests: DataFrame) -> DataFrame:
    """(path, package, dependency, version) of package.json contents (path, content)."""
    schema = "name string, dependencies map<string, string>, devDependencies map<string, string>"
    r = manifests.select("path", F.from_json("content", schema).alias("m"))
    every = F.map_concat(F.coalesce("m.dependencies", F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce("m.devDependencies", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("m.dependencies", F.create_map().cast("map<string,string>"))), k)))
    return r.select("path", F.col("m.name").alias("package"), F.explode(every).alias("dependency", "version"))


def api_operations(specs: DataFrame) -> DataFrame:
    """(source, path, method, operation) of OpenAPI documents in JSON (path, content)."""
    r = specs.select(F.col("path").alias("source"), F.explode(F.from_json("content", "paths map<string, map<string, struct<operationId: string>>>")["paths"]).alias("path", "methods"))
    return r.select("source", "path", F.explode("methods").alias("method", "op")).select("source", "path", "method", F.coalesce("op.operationId", F.concat_ws(" ", "method", "path")).alias("operation"))


def mock_vectors(texts: DataFrame, key: str, text: str, words: list[str], size: int) -> DataFrame:
    """(key, v): 0.1 everywhere, 0.9 where the component's word is in the text, normalised."""
    from ..operators.vector import normalized

    parts = F.array(*[F.when(F.lower(text).contains(words[i]), 0.9).otherwise(0.1) if i < len(words) else F.lit(0.1) for i in range(size)])
    return texts.select(key, normalized(parts).alias("v"))


def compact_vectors(segments: DataFrame, live: DataFrame) -> DataFrame:
    """Live ids of segments (segment, id, v) once each: the first segment that holds an id wins."""
    first = segments.groupBy("id").agg(F.min_by("v", "segment").alias("v"))
    return first.join(live.select("id").distinct(), "id", "left_semi")


def directories(paths: DataFrame) -> DataFrame:
    """(dir): the distinct folders of files (path)."""
    return paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).distinct()


def snapshot(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Files (path, bytes), or an error where there are more files or bytes than may be."""
    n, size = files.agg(F.count("*"), F.sum("bytes")).first()
    if n > max_files or (size or 0) > max_bytes:
        raise ValueError(f"{n} files of {size} bytes are more than {max_files} of {max_bytes}")
    return files


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? stay in one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c), i + 1
    return f"^{out}$"


def collection(paths: DataFrame, globs: list[str]) -> DataFrame:
    """Distinct paths that match one of the globs."""
    return paths.select("path").where(F.col("path").rlike("|".join(map(glob_pattern, globs)))).distinct()


def exports_of(stored: DataFrame) -> DataFrame:
    """(file, name, id) of exports stored as one JSON list a file (file, exports)."""
    return stored.select("file", F.explode(F.from_json("exports", "array<struct<name: string, id: bigint>>")).alias("x")).select("file", "x.name", "x.id")


def store_exports(symbols: DataFrame) -> DataFrame:
    """(file, exports): the public symbols of each file as a JSON list."""
    public = symbols.where("visibility = 'Public'")
    return public.groupBy(F.col("path").alias("file")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "id")))).alias("exports"))


def message_text(content: Column) -> Column:
    """The texts of a JSON list of typed blocks, one a line."""
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
