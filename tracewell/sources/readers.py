"""Readers of transcripts, corpora, notes and graph outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import has_error
from tracewell.functions.times import parse_time

#: Event lines of a transcript.
TRANSCRIPT = "entrypoint string, type string, uuid string, timestamp string, sessionId string, cwd string, gitBranch string, isMeta boolean, message struct<role: string, content: string>"
BLOCKS = "array<struct<type: string, text: string, name: string, input: string>>"


def read_lines(spark: SparkSession, path: str, glob: str | None = None, since: str | None = None, without: list[str] | None = None) -> DataFrame:
    """(file, line, pos) of all text files below ``path``; optional name pattern, least modification time, and parts of
    paths that leave a file out."""
    r = spark.read.option("recursiveFileLookup", "true")
    for k, v in (("pathGlobFilter", glob), ("modifiedAfter", since)):
        r = r.option(k, v) if v else r
    rows = r.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("pos"))
    for part in without or []:
        rows = rows.filter(~F.col("file").contains(part))
    return rows


def read_transcripts(spark: SparkSession, path: str, entrypoint: str = "cli", glob: str = "*.jsonl") -> DataFrame:
    """Event lines of the files whose first known entrypoint is the given one. Lines that are no JSON are skipped."""
    rows = read_lines(spark, path, glob).select("file", "pos", F.from_json("line", TRANSCRIPT, {"mode": "PERMISSIVE"}).alias("e")).filter("e.type is not null")
    first = rows.filter("e.entrypoint != ''").groupBy("file").agg(F.min_by("e.entrypoint", "pos").alias("how"))
    return rows.join(first.filter(F.col("how") == entrypoint).select("file"), "file", "left_semi").select("file", "pos", "e.*").withColumn("ts", parse_time(F.col("timestamp")))


def flatten_content(content: Column) -> Column:
    """Text of a message: itself, or the text parts of its content blocks, tools as ``[tool:name]``."""
    blocks = F.from_json(content, BLOCKS)
    parts = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "tool_use")), lambda b: F.when(b["type"] == "text", b["text"]).otherwise(F.concat(F.lit("[tool:"), b["name"], F.lit("]"))))
    return F.when(content.startswith("[") & blocks.isNotNull(), F.array_join(parts, "\n")).otherwise(content)


def read_corpus(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """(file, pos, role, text, ts) of user and assistant lines with at least ``least`` characters of text."""
    schema = "role string, type string, text string, content string, timestamp string"
    rows = read_lines(spark, path, "*.jsonl").select("file", "pos", F.from_json("line", schema).alias("e"))
    out = rows.select("file", "pos", F.coalesce("e.role", "e.type").alias("role"), flatten_content(F.coalesce("e.text", "e.content")).alias("text"), parse_time(F.col("e.timestamp")).alias("ts"))
    return out.filter(F.col("role").isin("user", "assistant") & (F.length("text") >= least))


def project_of(file: Column) -> Column:
    """Project name from a directory name in which slashes became dashes."""
    return F.regexp_extract(file, r"/-?(?:[^/]*-)?([^/-]+)/[^/]+$", 1)


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, text): each file whole."""
    r = spark.read.option("recursiveFileLookup", "true")
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def frontmatter(text: Column) -> Column:
    """Map of ``key: value`` lines between a leading ``---`` and the next; quotes are taken off; empty without one."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\n---", 1)
    keys = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*)$"), 1)
    values = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*)$"), 2)
    entries = F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: F.regexp_replace(F.trim(v), r"^[\"']|[\"']$", "")).alias("v"))
    last = F.aggregate(entries, F.expr("cast(map() as map<string, string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))
    return last


def body(text: Column) -> Column:
    """Text behind the frontmatter."""
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\n---\r?\n?", "")


def sections(docs: DataFrame, key: str, text: str, least: int = 30) -> DataFrame:
    """(key, ordinal, heading, content, char_start, char_end): with three headings or more the text before the first
    and each headed part, else blocks between blank lines; parts shorter than ``least`` characters are dropped.

    Offsets are found from the lengths of the parts, inside the engine.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    headings = F.size(F.regexp_extract_all(t, F.lit(r"(?m)^(#{1,6} .*)$"), 1))
    cut = F.when(headings >= 3, F.split(t, r"(?m)(?=^#{1,6} )", -1)).otherwise(F.split(t, r"(?<=\n)(?=[ \t]*\n)", -1))
    rows = docs.select(key, cut.alias("parts")).withColumn("ends", F.aggregate("parts", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p)))))
    rows = rows.select(key, F.posexplode("parts").alias("ordinal", "content"), "ends")
    rows = rows.select(key, "ordinal", F.regexp_extract("content", r"\A#{1,6} ([^\n]*)", 1).alias("heading"), "content", F.col("ends")[F.col("ordinal")].alias("char_start"), F.col("ends")[F.col("ordinal") + 1].alias("char_end"))
    return rows.filter(F.length(F.trim("content")) >= least)


def char_chunks(docs: DataFrame, key: str, text: str, size: int = 3000) -> DataFrame:
    """(key, chunk_no, content): pieces of ``size`` characters, cut at the last blank line if that lies beyond half."""
    step = F.aggregate(
        F.sequence(F.lit(0), F.floor(F.length(text) * 2 / size).cast("int")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, _: F.when(acc["at"] >= F.length(text), acc).otherwise(_next_chunk(acc, F.col(text), size)),
        lambda acc: acc["out"],
    )
    return docs.filter(F.length(text) > 0).select(key, F.posexplode(step).alias("chunk_no", "content"))


def _next_chunk(acc: Column, text: Column, size: int) -> Column:
    piece = F.substr(text, acc["at"] + 1, F.lit(size))
    back = F.length(piece) - F.locate("\n\n", F.reverse(piece)) - 1
    whole = (F.length(piece) < size) | (F.locate("\n\n", F.reverse(piece)) == 0) | (back <= size // 2)
    used = F.when(whole, F.length(piece)).otherwise(back)
    return F.struct((acc["at"] + used).cast("int").alias("at"), F.concat(acc["out"], F.array(F.substr(piece, F.lit(1), used.cast("int")))).alias("out"))


def pull_sections(chunks: DataFrame, key: str, chunk: str, wanted: DataFrame, context: int = 0) -> DataFrame:
    """Rows of ``chunks`` (key, chunk number, ...) within ``context`` of a wanted one (key, chunk), each once."""
    near = wanted.select(key, F.explode(F.sequence(F.col(chunk) - context, F.col(chunk) + context)).alias(chunk)).distinct()
    return chunks.join(near, [key, chunk], "left_semi")


def document_rows(files: DataFrame, project: str | None = None) -> DataFrame:
    """(source_id, kind, project, title, text, source_time) of read files (file, text): title and project from the
    frontmatter, else the first heading or the file's name, and ``project`` or the directory's. Empty texts are left out."""
    head = frontmatter(F.col("text"))
    name = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    first = F.regexp_extract(F.col("text"), r"(?m)^#{1,6} (.+)$", 1)
    title = F.coalesce(head["title"], F.when(first != "", first), name)
    where = F.coalesce(head["project"], F.lit(project), project_of(F.col("file")))
    rows = files.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.select(F.substring(F.sha2(F.col("file"), 256), 1, 32).alias("source_id"), F.lit("document").alias("kind"), where.alias("project"), title.alias("title"), body(F.col("text")).alias("text"), parse_time(head["date"]).alias("source_time"))


def note_row(spark: SparkSession, text: str, project: str, title: str = "") -> DataFrame:
    """One note in the form of ``document_rows``. A blank note is an error."""
    if not text.strip():
        raise ValueError("the note is empty")
    rows = spark.createDataFrame([(text, project, title or text.strip().splitlines()[0][:80])], "text string, project string, title string")
    return rows.select(F.substring(F.sha2(F.concat_ws("|", "project", "text"), 256), 1, 32).alias("source_id"), F.lit("note").alias("kind"), "project", "title", "text", F.lit(None).cast("timestamp").alias("source_time"))


def hook_events(lines: DataFrame, line: str) -> DataFrame:
    """(session_id, project, tool, input, input_hash, had_error, ts) of hook payloads, one JSON object a line; lines that are
    no JSON or name no session are skipped, and inputs are kept to 400 characters beside their full hash."""
    e = F.from_json(line, "session_id string, cwd string, tool_name string, tool_input string, tool_response string, timestamp string")
    rows = lines.select(e.alias("e")).filter("e.session_id is not null")
    return rows.select(
        "e.session_id", F.regexp_extract("e.cwd", r"([^/]+)/?$", 1).alias("project"), F.col("e.tool_name").alias("tool"), F.substring("e.tool_input", 1, 400).alias("input"),
        F.substring(F.sha1("e.tool_input"), 1, 16).alias("input_hash"), F.coalesce(has_error(F.col("e.tool_response")), F.lit(False)).alias("had_error"), parse_time(F.col("e.timestamp")).alias("ts"),
    )


def read_map_file(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value fields) of a JSON object of objects, kept in one file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "v")).select("key", "v.*")


def read_graph_outputs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parquet tables of a graph workspace that are there."""
    found = {}
    for name in ("entities", "relationships", "communities", "community_reports", "text_units", "documents"):
        try:
            found[name] = spark.read.parquet(f"{path}/{name}.parquet")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return found
