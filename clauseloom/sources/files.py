"""Files in, files out: folder scans, extractor output, event logs, sessions, logs, chunks.

Spark lists no file whose name starts with ``_`` or ``.``, and an image map comes back ordered by its
keys, because variants keep object keys sorted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import ids
from clauseloom.functions.text import strip
from clauseloom.plans.ordered import ordinal
from clauseloom.plans.stage import discard, stage
from clauseloom.schemas import SESSIONS

# The file types taken, and the message for a folder without any.
SUPPORTED = ("pdf", "docx", "txt", "md")
NO_FILES = "No supported files found (PDF, DOCX, TXT, MD)"


def _status(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(hadoop) if fs.exists(hadoop) else None


def scan_files(spark: SparkSession, root: str, exts=SUPPORTED) -> DataFrame:
    """All files below a folder with size, type and whether the type is taken. Contents are not read
    unless ``content`` is used."""
    listed = ", ".join(f"'{e}'" for e in exts)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.selectExpr(
        "path", r"regexp_extract(path, r'([^/]+)$', 1) AS filename", "length AS file_size",
        r"lower(regexp_extract(path, r'[^/]\.([^./]+)$', 1)) AS file_type", "content",
    ).selectExpr("path", "filename", "file_size", "file_type", f"file_type IN ({listed}) AS supported", "content")


def source_summary(files: DataFrame) -> DataFrame:
    """Counts and bytes of a scan. A valid folder counts its supported files as the total, another one all."""
    return files.agg(
        F.expr("count_if(supported)").alias("supported_count"),
        F.expr("count_if(NOT supported)").alias("unsupported_count"),
        F.expr("coalesce(sum(file_size) FILTER (WHERE supported), 0)").alias("total_size"),
    ).selectExpr(
        "supported_count > 0 AS valid",
        "CASE WHEN supported_count > 0 THEN supported_count ELSE supported_count + unsupported_count END AS total_files",
        "supported_count", "unsupported_count", "total_size",
        f"CASE WHEN supported_count = 0 THEN '{NO_FILES}' END AS error_message",
    )


def validate_folder(spark: SparkSession, root: str, exts=SUPPORTED) -> DataFrame:
    """One row like :func:`source_summary`, also for a path that is missing or no folder."""
    status = _status(spark, root)
    # The messages.
    problem = "Path does not exist" if status is None else None if status.isDirectory() else "Path is not a directory"
    if problem is None:
        return source_summary(scan_files(spark, root, exts))
    return spark.range(1).selectExpr(
        "false AS valid", "0L AS total_files", "0L AS supported_count", "0L AS unsupported_count", "0L AS total_size",
        f"'{problem}' AS error_message",
    )


def hashed_files(files: DataFrame) -> DataFrame:
    """Supported files with the SHA-256 of their bytes; the bytes are dropped."""
    return files.filter("supported").selectExpr("path", "filename", "file_size", "file_type", f"{ids.content_hash('content')} AS content_hash")


def parse_block_trees(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(trees, rejects)``: extractor JSON as a variant per document, and the documents that do not parse, with their text."""
    parsed = df.selectExpr(f"CAST({key} AS STRING) AS document_id", f"try_parse_json({text}) AS tree", f"{text} AS _text")
    rejects = parsed.filter("tree IS NULL").selectExpr("document_id", "_text AS text", "'invalid JSON' AS error")
    return parsed.filter("tree IS NOT NULL").select("document_id", "tree"), rejects


#: What names the content of a file: the file's own name, or that of its folder (what stands behind the ``=`` of a partition's).
_NAMED = {"file": "_metadata.file_name", "folder": r"regexp_extract(_metadata.file_path, r'([^/=]+)/[^/]+$', 1)"}


def read_block_trees(spark: SparkSession, path: str, named_by: str = "file") -> tuple[DataFrame, DataFrame]:
    """One JSON file per document, in any depth of folders. The document id is the file's name without its suffix, or with
    ``named_by="folder"`` that of its folder. Both frames read one stored copy, the ``staged_at`` of the trees."""
    name = r"regexp_extract(_metadata.file_name, r'^(.*)\.[^.]*$', 1)" if named_by == "file" else _NAMED[named_by]
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    # Trees and rejects are read apart; very many small files are opened once.
    stored = stage(files.selectExpr(f"{name} AS document_id", "value"), "tree-files")
    trees, rejects = parse_block_trees(stored, "document_id", "value")
    trees.staged_at = stored.staged_at
    return trees, rejects


def flatten_blocks(trees: DataFrame) -> DataFrame:
    """Block trees as block rows in pre-order. A page header or footer drops its whole subtree.

    One level per step, written to the shared folder; what hangs below a level's nodes goes when the next level has it. The
    position ranks the index paths of one document, which came from one variant of at most 128 MiB.
    """
    spark = trees.sparkSession
    get = lambda field, kind: f"try_variant_get(c.value, '$.{field}', '{kind}') AS {field}"
    fields = [
        get("block_type", "string"), get("html", "string"), get("caption", "string"),
        get("rows", "array<array<string>>"), get("images", "map<string,string>"),
    ]
    level = trees.selectExpr("document_id", "CAST(array() AS ARRAY<INT>) AS path", "try_variant_get(tree, '$.children', 'variant') AS children")
    steps: list[DataFrame] = []
    first = True
    while True:
        below = spark.sql(
            f"""SELECT document_id, concat(path, array(c.pos)) AS path, {", ".join(fields)},
                 try_variant_get(c.value, '$.children', 'variant') AS children
               FROM {{level}}, LATERAL variant_explode(children) AS c
               WHERE c.key IS NULL AND schema_of_variant(c.value) LIKE 'OBJECT%'
                 AND coalesce(try_variant_get(c.value, '$.block_type', 'string'), '') NOT IN ('PageHeader', 'PageFooter')""",
            level=level,
        )
        below = stage(below, "blocks")
        last = below.isEmpty()
        if not first:
            own = level.drop("children")
            steps.append(own if last else stage(own, "level"))
            if not last:
                discard(level)
        if last:
            break
        level, first = below, False
    every = steps[0] if steps else below.drop("children")
    for step in steps[1:]:
        every = every.unionByName(step)
    return every.selectExpr(
        "document_id",
        "CAST(row_number() OVER (PARTITION BY document_id ORDER BY path) - 1 AS BIGINT) AS pos",
        "block_type", "html", "caption", "rows", "images",
    )


#: Line ends of plain text: those that Python's ``splitlines`` knows.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"


def text_trees(files: DataFrame) -> DataFrame:
    """Plain text and markdown as block-tree JSON: headings and lines as blocks. Bytes that are not UTF-8 are an error."""
    lines = rf"filter(split(CAST(content AS STRING), r'{LINE_END}'), x -> regexp_like(x, r'(?U)\S'))"
    title = strip("regexp_replace(x, '^#+', '')")
    block = (
        "struct(CASE WHEN startswith(x, '#') THEN 'SectionHeader' ELSE 'Text' END AS block_type,"
        f" CASE WHEN startswith(x, '#') THEN {title} ELSE x END AS html)"
    )
    problem = "CASE WHEN content IS NULL THEN 'no content' WHEN NOT is_valid_utf8(CAST(content AS STRING)) THEN 'invalid UTF-8' END"
    return files.selectExpr("path", "filename", "content", f"{problem} AS error").selectExpr(
        "path", "filename", f"CASE WHEN error IS NULL THEN to_json(struct(transform({lines}, x -> {block}) AS children)) END AS tree", "error"
    )


def text_tree(name: str, data: bytes) -> dict:
    """The tree of :func:`text_trees` for one file, for extractors that pass some files on."""
    blocks = []
    for line in data.decode("utf-8").splitlines():
        if line.strip():
            head = line.startswith("#")
            blocks.append({"block_type": "SectionHeader" if head else "Text", "html": line.lstrip("#").strip() if head else line})
    return {"children": blocks}


def extract_documents(files: DataFrame, extractor: Callable[[str, bytes], dict] | None = None) -> DataFrame:
    """Bytes to block-tree JSON by a pluggable extractor, or as plain text without one. A file that fails is a row with
    its error."""
    if extractor is None:
        return text_trees(files.filter("supported"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            trees, errors = [], []
            for name, data in zip(pdf["filename"], pdf["content"]):
                try:
                    trees.append(json.dumps(extractor(name, bytes(data)), ensure_ascii=False))
                    errors.append(None)
                except Exception as e:  # one bad file must not end the job
                    trees.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"path": pdf["path"], "filename": pdf["filename"], "tree": trees, "error": errors})

    taken = files.filter("supported").select("path", "filename", "content")
    return taken.mapInPandas(run, "path string, filename string, tree string, error string")


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json", buckets: int = 256) -> None:
    """Chunks by a hash bucket of the document, so that the number of folders does not grow with the data.

    The file name of a chunk, with ``/`` as ``_``, is kept in ``chunk_file``.
    """
    (
        chunks.selectExpr(
            "*", "concat(replace(chunk_id, '/', '_'), '.json') AS chunk_file",
            f"pmod(xxhash64(document_id), {buckets}) AS document_bucket",
        )
        .write.mode("error").partitionBy("document_bucket").format(fmt).save(path)
    )


def envelope(events: DataFrame, exchange: str = "document_processing") -> DataFrame:
    """Events ``(event_id, event_type, document_id, ts, routing_key, ...)`` as one JSON message per row; what
    is not part of the envelope becomes the payload."""
    outer = ("event_id", "ts", "routing_key")
    inner = ", ".join(c for c in events.columns if c not in outer)
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS timestamp"
    return events.selectExpr(
        "routing_key AS key",
        f"to_json(struct({stamp}, routing_key, '{exchange}' AS exchange, event_id, struct({inner}) AS payload)) AS value",
    )


def publish_events(events: DataFrame, path: str, exchange: str = "document_processing") -> None:
    """Append the messages to a JSON-lines folder. A Kafka sink takes the same ``key`` and ``value``."""
    envelope(events, exchange).select("value").write.mode("append").text(path)


_WIRE = "timestamp string, routing_key string, exchange string, event_id string, payload string"


def open_envelope(messages: DataFrame) -> DataFrame:
    """JSON messages as event rows; both the wrapped and the bare form are read."""
    value = "value" if "value" in messages.columns else messages.columns[0]
    return messages.selectExpr(f"from_json({value}, '{_WIRE}') AS e", f"{value} AS raw").selectExpr(
        "e.event_id AS event_id",
        "coalesce(get_json_object(e.payload, '$.event_type'), get_json_object(raw, '$.event_type')) AS event_type",
        "coalesce(get_json_object(e.payload, '$.document_id'), get_json_object(raw, '$.document_id')) AS document_id",
        "try_to_timestamp(e.timestamp) AS ts", "e.routing_key AS routing_key", "coalesce(e.payload, raw) AS payload",
    )


def read_event_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return open_envelope(reader.text(path))


def read_sessions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Session JSON, one per file in any depth of folders or one per line; what cannot be read is skipped."""
    raw = (
        spark.read.schema(SESSIONS + ", _corrupt string").option("recursiveFileLookup", True)
        .option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return raw.filter("_corrupt IS NULL AND session_id IS NOT NULL").drop("_corrupt")


def session_messages(sessions: DataFrame) -> DataFrame:
    return sessions.selectExpr("session_id", "user_id", "posexplode(messages) AS (turn, m)").selectExpr(
        "session_id", "user_id", "turn", "m.role", "m.content", "m.message_id"
    )


#: The number that rotation puts behind a log's name, before a suffix of compression; and the time a line may begin with.
_ROTATED = r"^(.*?)(?:\.([0-9]+))?(?:\.(?:gz|bz2|zst))?$"
_STAMP = r"^\[?([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]{1,6})?)"


def _log_columns(name: str) -> list[str]:
    return [
        f"regexp_extract({name}, r'{_ROTATED}', 1) AS source",
        f"coalesce(try_cast(nullif(regexp_extract({name}, r'{_ROTATED}', 2), '') AS INT), 0) AS rotation",
    ]


_TS = f"try_to_timestamp(replace(replace(nullif(regexp_extract(line, r'{_STAMP}', 1), ''), ',', '.'), 'T', ' ')) AS ts"


def read_logs(spark: SparkSession, path: str, streaming: bool = False, named_by: str = "file") -> DataFrame:
    """Log lines: ``source`` (the log's name without the number of its rotation), ``rotation``, ``line_no``, ``ts`` if the line begins
    with a time, ``line``.

    Lines are numbered from 1 through all files of a source, oldest rotation first. A file is cut at its splits: each is numbered by
    itself, and counts of splits give what stands before. A stream takes a file whole when it comes, so ``line_no`` begins
    again with each file there.
    """
    name = _NAMED[named_by]
    if streaming:
        files = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).text(path)
        lines = files.selectExpr(*_log_columns(name), r"posexplode(split(regexp_replace(value, r'\r?\n$', ''), r'\r?\n')) AS (at, line)")
        return lines.selectExpr("source", "rotation", "CAST(at + 1 AS BIGINT) AS line_no", _TS, "line")
    raw = spark.read.option("recursiveFileLookup", True).text(path).selectExpr(
        *_log_columns(name), "_metadata.file_path AS _file", "_metadata.file_block_start AS _block", "monotonically_increasing_id() AS _at", "value AS line"
    ).withColumn("_age", F.expr("-rotation"))
    numbered = ordinal(raw, ["source"], ["_age", "_file", "_block"], ["_at"], "line_no")
    return numbered.selectExpr("source", "rotation", "line_no", _TS, "line")
