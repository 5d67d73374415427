"""Sources of documents: exports of services, folders, tables of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions import text as tx

COLUMNS = ["source_id", "file_id", "text", "metadata"]


def _documents(rows: DataFrame, source: Column, file_id: Column, text: Column, metadata: dict[str, Column]) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(source.alias("source_id"), file_id.alias("file_id"), text.alias("text"), F.create_map(*pairs).alias("metadata"))


def repository_export(spark: SparkSession, path: str) -> DataFrame:
    """JSON {repo, files: [{path, content}]} as documents."""
    rows = spark.read.schema("repo string, files array<struct<path:string,content:string>>").json(path, multiLine=True).select("repo", F.explode("files").alias("f"))
    return _documents(rows, F.col("repo"), F.concat(F.lit("github-"), tx.sanitize_segment(F.concat("repo", F.lit("-"), "f.path"))), F.col("f.content"), {"path": F.col("f.path"), "repo": F.col("repo")})


def bucket_export(spark: SparkSession, path: str) -> DataFrame:
    """JSON {bucket, objects: [{key, body}]} as documents."""
    rows = spark.read.schema("bucket string, objects array<struct<key:string,body:string>>").json(path, multiLine=True).select("bucket", F.explode("objects").alias("o"))
    return _documents(rows, F.col("bucket"), F.concat(F.lit("s3-"), tx.sanitize_segment(F.concat("bucket", F.lit("-"), "o.key"))), F.col("o.body"), {"key": F.col("o.key"), "bucket": F.col("bucket")})


def channel_export(spark: SparkSession, path: str) -> DataFrame:
    """JSON {channels: [{name, messages: [{ts, user, text}]}]}: a transcript a channel, messages by time."""
    rows = spark.read.schema("channels array<struct<name:string,messages:array<struct<ts:string,user:string,text:string>>>>").json(path, multiLine=True).select(F.explode("channels").alias("c"))
    line = lambda m: F.format_string("[%s] %s: %s", m["ts"], m["user"], m["text"])
    return _documents(rows, F.lit("slack"), F.concat(F.lit("slack-"), tx.sanitize_segment(F.col("c.name"))), F.array_join(F.transform(F.array_sort("c.messages"), line), "\n"), {"channel": F.col("c.name")})


def page_documents(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages as documents keyed by host and path, tags stripped."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " "), r"\s+", " "))
    host = F.try_parse_url(F.col(url), F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))
    return _documents(pages, host, F.concat(F.lit("web-"), tx.sanitize_segment(F.concat(host, path))), plain, {"url": F.col(url)})


def folder(spark: SparkSession, path: str, include: str = "*", recursive: bool = True) -> DataFrame:
    """Whole text files of a folder as documents."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=include).select(F.input_file_name().alias("p"), "value")
    return _documents(rows, F.lit("folder"), tx.sanitize_segment(F.regexp_extract("p", "([^/]+)$", 1)), F.col("value"), {"path": F.col("p")})


def valid(docs: DataFrame, least: int = 20, most: int = 1 << 20, text: str = "text") -> DataFrame:
    """``docs`` with ``error``: blank, too short or too large; null where the text may be taken in."""
    t = F.col(text)
    error = F.when(t.isNull() | (F.trim(t) == ""), "blank").when(F.length(t) < least, "too short").when(F.octet_length(t) > most, "too large")
    return docs.withColumn("error", error)


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, position, title, slug, body) of sections that begin with a heading."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.filter(F.split(F.col(text), r"(?m)(?=^#{1,6} )"), lambda s: F.trim(s) != "")).alias("position", "body"))
    title = F.coalesce(F.nullif(tx.heading_text(F.col("body")), F.lit("")), F.lit("untitled"))
    return rows.select("id", "position", title.alias("title"), tx.slugify(title).alias("slug"), "body")


def structured_kind(text: Column) -> Column:
    """json_array, json_object, jsonl, csv or null."""
    parsed = tx.json_value(text)
    first = F.substring(F.ltrim(text), 1, 1)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    jsonl = (F.size(lines) >= 2) & F.forall(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("{", "[") & tx.json_value(x).isNotNull())
    width = F.size(F.split(F.get(lines, F.lit(0)), ","))
    csv = (F.size(lines) >= 2) & (width >= 2) & F.forall(lines, lambda x: F.size(F.split(x, ",")) == width) & ~text.contains('"')
    return F.when(jsonl, "jsonl").when(parsed.isNotNull() & (first == "["), "json_array").when(parsed.isNotNull() & (first == "{"), "json_object").when(csv, "csv")
