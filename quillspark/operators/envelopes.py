"""Processing messages: validation, routing, fan-out, fan-in, errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a message and of a document request (fixed values).
KEYS = ("message_id", "correlation_id", "timestamp", "source_service", "target_service", "message_type", "priority", "payload", "retry_count", "ttl")
REDUCED_KEYS = ("message_id", "target_service", "payload")
PAYLOAD_KEYS = ("request_id", "action", "parameters")
PARAMETER_KEYS = ("asset_path", "version_id", "primary_filename", "status")
#: File types by extension (fixed values).
EXTENSIONS = {
    "document": ("pdf", "doc", "docx", "txt", "html", "htm", "csv", "xlsx", "xls", "ppt", "pptx"),
    "image": ("jpg", "jpeg", "png"),
    "video": ("mp4", "avi", "mov", "wmv", "flv", "webm", "mkv", "3gp"),
    "audio": ("mp3", "wav", "flac", "aac", "ogg", "wma", "m4a"),
}
ANALYSERS = {"pdf": ("pdf",), "office": ("doc", "docx", "ppt", "pptx"), "spreadsheet": ("csv", "xlsx", "xls"), "web": ("html", "htm"), "text": ("txt",)}
BRANCHES = {"audio": ("classifier", "diarization", "recognizer"), "video": ("frames", "audio"), "image": ("description", "ocr"), "frames": ("scene", "ocr", "description")}
MODALITIES = ("document", "image", "video", "audio")


def has_keys(json: Column, keys: Sequence[str], path: str = "$") -> Column:
    """Whether a JSON object has the keys, present but null included."""
    inner = json if path == "$" else F.get_json_object(json, path)
    found = F.json_object_keys(inner)
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), found)) == 0, F.lit(False))


def complete(json: Column, action: str = "document_processing", keys: Sequence[str] = KEYS) -> Column:
    """All mandatory keys, and those of the payload and its parameters where the action asks for them."""
    asked = F.coalesce(F.get_json_object(json, "$.payload.action") == action, F.lit(False))
    return has_keys(json, keys) & (~asked | (has_keys(json, PAYLOAD_KEYS, "$.payload") & has_keys(json, PARAMETER_KEYS, "$.payload.parameters")))


def reduced(json: Column) -> Column:
    return has_keys(json, REDUCED_KEYS) & has_keys(json, PAYLOAD_KEYS[:2], "$.payload")


def expired(timestamp: Column, ttl: Column, now: Column) -> Column:
    """Older than its life time; an unreadable timestamp never expires."""
    age = F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(timestamp))
    return F.coalesce(age > F.coalesce(ttl, F.lit(3600)).cast("long") * 1_000_000, F.lit(False))


def error_code(json: Column, now: Column, service: str, actions: Sequence[str], keys: Sequence[str] = KEYS) -> Column:
    """The first fault of a message, null if it has none."""
    get = lambda p: F.get_json_object(json, p)
    return (
        F.when(~complete(json, keys=keys), "INVALID_FORMAT")
        .when(expired(get("$.timestamp"), get("$.ttl").try_cast("long"), now), "MESSAGE_EXPIRED")
        .when(~get("$.target_service").eqNullSafe(F.lit(service)), "WRONG_TARGET")
        .when(~F.coalesce(get("$.payload.action").isin(*actions), F.lit(False)), "UNKNOWN_ACTION")
    )


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.element_at(F.split(F.lower(name), r"\."), -1)).otherwise(F.lit(""))


def _kind(ext: Column, table: dict[str, Sequence[str]], other: str | None) -> Column:
    out = F.lit(other)
    for kind, exts in reversed(table.items()):
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def file_type(name: Column) -> Column:
    return F.coalesce(_kind(extension(name), EXTENSIONS, "unknown"), F.lit("unknown"))


def analyser(name: Column) -> Column:
    """The analysis a document goes to, null if there is none for its type."""
    return _kind(extension(name), ANALYSERS, None)


def processing_mode(name: Column, asked: Column) -> Column:
    """A PDF is read as asked, default or ocr; everything else by default."""
    return F.when((extension(name) == "pdf") & asked.isin("default", "ocr"), asked).otherwise(F.lit("default"))


#: MIME types by extension, aliases, and types that say nothing (fixed values).
MIME = {
    "pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "mp4": "video/mp4", "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac",
}
MIME_ALIASES = {"audio/mp3": "audio/mpeg", "audio/x-mp3": "audio/mpeg", "audio/x-wav": "audio/wav"}
GENERIC = ("application/octet-stream", "text/plain")


def mime_type(name: Column, content_mime: Column) -> Column:
    """The content's type, unless it says nothing and the name says more; aliases as their usual name."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by_name = F.try_element_at(table(MIME), extension(name))
    content = F.coalesce(F.try_element_at(table(MIME_ALIASES), content_mime), content_mime)
    return F.when(content.isNull() | content.isin(*GENERIC), F.coalesce(by_name, content, F.lit("application/octet-stream"))).otherwise(content)


def base_path(mime: Column) -> Column:
    return F.regexp_replace(mime, "[^a-zA-Z0-9/.+-]", "_")


def topics(spark) -> DataFrame:
    """(name, modality, stage, kind, partitions): the topic catalogue that routing joins to."""
    rows = [(f"{m}-{s}-{k}", m, s, k, 6 if k == "results" else 12) for m in MODALITIES for s in ("processing", "analysis", "summary", "save") for k in ("requests", "results")]
    rows += [(f"{m}-dlq", m, "any", "dlq", 1) for m in MODALITIES]
    return spark.createDataFrame(rows, "name string, modality string, stage string, kind string, partitions int")


def route(requests: DataFrame, catalogue: DataFrame, stage: str = "processing") -> DataFrame:
    """Requests (filename, ...) with the topic of their file type; unknown types have none."""
    table = catalogue.where((F.col("stage") == stage) & (F.col("kind") == "requests")).select("modality", F.col("name").alias("topic"))
    return requests.withColumn("modality", file_type(F.col("filename"))).join(table, "modality", "left")


def fan_out(requests: DataFrame, modality: str) -> DataFrame:
    """One row per branch that works on a request."""
    return requests.withColumn("branch", F.explode(F.array(*[F.lit(b) for b in BRANCHES[modality]])))


def fan_in(results: DataFrame, branches: Sequence[str], key: str = "correlation_id") -> DataFrame:
    """Keys all of whose branches have answered: (key, one struct column per branch).  A branch that answered twice counts once,
    by its first answer.  A result of status error or failed makes the key failed, with all errors joined."""
    first = lambda b: F.min(F.when(F.col("branch") == b, F.struct("ts", "status", "result"))).alias(b)
    rows = results.groupBy(key).agg(*[first(b) for b in branches])
    done = rows.where(" and ".join(f"`{b}` is not null" for b in branches))
    return done.withColumn("errors", joined_errors([(b, F.col(f"{b}.status"), F.col(f"{b}.result")) for b in branches]))


def joined_errors(parts: Sequence[tuple[str, Column, Column]]) -> Column:
    """'service: error' of the failing branches, joined by '; '; empty if none failed."""
    texts = [F.when(status.isin("error", "failed"), F.concat(F.lit(f"{name}: "), F.coalesce(text, F.lit("unknown")))) for name, status, text in parts]
    return F.array_join(F.filter(F.array(*texts), lambda t: t.isNotNull()), "; ")


def dead_letters(rows: DataFrame, max_retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows to try again, dead letters): a faulty message is tried again until its retries are used up."""
    bad = rows.where("error is not null")
    again = bad.where(F.col("retry_count") < max_retries).withColumn("retry_count", F.col("retry_count") + 1)
    dead = bad.where(F.col("retry_count") >= max_retries).select("value", "error", "retry_count", F.lit("HIGH").alias("priority"), F.lit("MAX_RETRIES").alias("reason"))
    return again, dead


def active_tasks(starts: DataFrame, ends: DataFrame, now: Column, key: str = "message_id") -> DataFrame:
    """(key, running_seconds) of tasks that started and haven't ended."""
    return starts.join(ends.select(key), key, "left_anti").select(key, (F.unix_micros(now) / 1e6 - F.unix_micros("ts") / 1e6).alias("running_seconds"))


def two_rows(rows: DataFrame, key: str, description: str, ocr: str) -> DataFrame:
    """A summary row and a text row per image."""
    both = F.array(F.struct(F.lit("summary").alias("embedding_type"), F.col(description).alias("content")), F.struct(F.lit("text").alias("embedding_type"), F.col(ocr).alias("content")))
    return rows.select(key, F.explode(both).alias("r")).select(key, "r.*")


def summary_first(summaries: DataFrame, chunks: DataFrame, key: str, index: str = "chunk_index") -> DataFrame:
    """A summary row before the chunk rows of each key: column ord."""
    a = summaries.withColumn("ord", F.lit(0).cast("long"))
    b = chunks.withColumn("ord", (F.col(index) + 1).cast("long"))
    return a.unionByName(b, allowMissingColumns=True)


def standard_rows(rows: DataFrame) -> DataFrame:
    """Flat segments (start, end, speaker, text) and already standard rows (payload struct) as one form."""
    flat = F.struct(F.col("start"), F.col("end"), F.col("speaker"), F.col("text"))
    return rows.select("id", F.coalesce("payload", flat).alias("payload"))


def harvest(results: DataFrame, key: str, modality: str) -> DataFrame:
    """(key, summary, text) of a result list (key, pos, embedding_type, summary, text): documents by their first row, images by
    embedding type, others by the last summary and all texts in order."""
    if modality == "document":
        first = results.groupBy(key).agg(F.min(F.struct("pos", "summary", "text")).alias("r"))
        return first.select(key, "r.summary", "r.text")
    if modality == "image":
        one = lambda kind, c: F.min(F.when(F.col("embedding_type") == kind, F.struct("pos", F.col(c).alias("v")))).alias(c)
        return results.groupBy(key).agg(one("summary", "summary"), one("text", "text")).select(key, F.col("summary.v").alias("summary"), F.col("text.v").alias("text"))
    rows = results.groupBy(key).agg(F.max_by("summary", F.when(F.col("summary").isNotNull(), F.col("pos"))).alias("summary"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return rows.select(key, "summary", F.array_join(F.transform("t", lambda x: x.text), " ").alias("text"))
