"""Readers of chat exports and session logs: one row for each turn (thread, title, turn, role, text, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Roles of the sources and those of the model.
ROLES = {"human": "user", "user": "user", "you": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "bot": "assistant"}
_PARTS = "array<struct<type:string,text:string>>"


def _role(c):
    out = F.lit(None).cast("string")
    for old, new in ROLES.items():
        out = F.when(F.lower(c) == old, new).otherwise(out)
    return out


def tree_export(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of threads with a mapping of nodes; turns by time, nulls first."""
    node = "struct<message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>>>"
    raw = spark.read.schema(f"title string, create_time double, mapping map<string,{node}>").option("multiLine", True).json(path)
    m = F.explode(F.map_values("mapping")).alias("n")
    rows = raw.select(F.col("title").alias("thread"), m).select("thread", F.col("n.message.author.role").alias("role"), F.array_join("n.message.content.parts", "\n").alias("text"), F.coalesce("n.message.create_time", F.lit(0.0)).alias("ts"))
    return _numbered(rows.where("role IN ('user', 'assistant') AND text <> ''"))


def list_export(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of threads with chat_messages, messages or entries; text as a string or as typed parts."""
    message = f"array<struct<sender:string,role:string,text:string,content:string,parts:{_PARTS},created_at:string>>"
    raw = spark.read.schema(f"name string, title string, chat_messages {message}, messages {message}, entries {message}").option("multiLine", True).json(path)
    rows = raw.select(F.coalesce("name", "title").alias("thread"), F.posexplode(F.coalesce("chat_messages", "messages", "entries")).alias("p", "m"))
    parts = F.array_join(F.transform(F.filter("m.parts", lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")
    rows = rows.select("thread", _role(F.coalesce("m.sender", "m.role")).alias("role"), F.coalesce("m.text", "m.content", parts).alias("text"), F.col("p").cast("double").alias("ts"))
    return _numbered(rows.where("role IS NOT NULL AND text <> ''"))


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """Plain text: a line that starts with a speaker opens a turn, the lines after it belong to it."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("thread"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    head = F.regexp_extract("value", r"^(\w+):", 1)
    lines = lines.withColumn("role", _role(head))
    lines = lines.withColumn("ts", F.sum(F.col("role").isNotNull().cast("int")).over(Window.partitionBy("thread").orderBy("line")).cast("double")).where("ts > 0")
    said = F.when(F.col("role").isNotNull(), F.regexp_replace("value", r"^\w+:\s*", "")).otherwise(F.col("value"))
    rows = lines.groupBy("thread", "ts").agg(F.max("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", said.alias("s")))), lambda x: x["s"]), "\n").alias("text"))
    return _numbered(rows.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")))


def session_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; bad lines and rows that aren't messages are skipped."""
    raw = spark.read.schema(f"type string, session string, role string, text string, parts {_PARTS}, timestamp string").option("mode", "PERMISSIVE").json(path)
    parts = F.array_join(F.transform(F.filter("parts", lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")
    rows = raw.where("type = 'message'").select(F.col("session").alias("thread"), _role(F.col("role")).alias("role"), F.coalesce("text", parts).alias("text"), F.unix_millis(F.try_to_timestamp("timestamp")).cast("double").alias("ts"))
    return _numbered(rows.where("role IS NOT NULL"))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("thread").orderBy("ts", "text")))


def unprocessed(turns: DataFrame, processed: DataFrame) -> DataFrame:
    """Resume an import: turns of threads that aren't in processed (thread)."""
    return turns.join(processed.select("thread"), "thread", "left_anti")


def newest_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(folder, path, modified): the file of each folder that changed last, of equal ones the last by name; only listings are read."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    last = files.groupBy(folder.alias("folder")).agg(F.max(F.struct("modificationTime", "path")).alias("m"))
    return last.select("folder", F.col("m.path").alias("path"), F.col("m.modificationTime").alias("modified"))


def detected(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, format) of files: by extension, and JSON by the keys that its first 64 kB show: tree, list, session, transcript or unknown."""
    head = F.substring(F.col("content").cast("string"), 1, 1 << 16)
    files = spark.read.format("binaryFile").load(pattern)
    extension = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    kind = F.when(extension == "jsonl", "session").when(extension.isin("txt", "md"), "transcript").when((extension == "json") & F.contains(head, F.lit('"mapping"')), "tree")
    return files.select("path", kind.when((extension == "json") & F.regexp_like(head, F.lit('"(chat_messages|messages|entries)"')), "list").otherwise("unknown").alias("format"))
