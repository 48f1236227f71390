"""Scalar functions over columns: dates, vectors, resources, JSON, hashing, records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def retention_dates(upload: Column, archive_days: int | None = None, destroy_days: int | None = None) -> Column:
    """(archive_date, destroy_date): days after the upload, and after the archiving; 30 each by default."""
    archive = upload + F.make_dt_interval(days=F.lit(30 if archive_days is None else archive_days))
    return F.struct(archive.alias("archive_date"), (archive + F.make_dt_interval(days=F.lit(30 if destroy_days is None else destroy_days))).alias("destroy_date"))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a timestamp; null where it is none."""
    return F.try_to_timestamp(text)


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def epoch_ms_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def dynamic_ttl(ttl: Column, hits: Column, growth: float = 0.01) -> Column:
    """The life of an entry grows by a share of the base with every hit."""
    return F.floor(ttl * (hits * growth + 1) + F.lit(1e-9)).cast("long")


#: Bytes per parameter (fixed values).
PRECISION_BYTES = {"fp32": 4.0, "fp16": 2.0, "bf16": 2.0, "int8": 1.0}
QUANT_BYTES = {
    "Q2_K": 0.25, "Q3_K_S": 0.375, "Q3_K_M": 0.375, "Q3_K_L": 0.375, "Q4_0": 0.5, "Q4_1": 0.5, "Q4_K_S": 0.5, "Q4_K_M": 0.5,
    "Q5_0": 0.625, "Q5_1": 0.625, "Q5_K_S": 0.625, "Q5_K_M": 0.625, "Q6_K": 0.75, "Q8_0": 1.0, "Q8_1": 1.0,
    "F16": 2.0, "FP16": 2.0, "F32": 4.0, "FP32": 4.0,
}


def _lookup(key: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def bytes_per_param(quantisation: Column, precision: Column) -> Column:
    """By quantisation level, else by precision, else 2."""
    return F.coalesce(_lookup(F.upper(quantisation), QUANT_BYTES), _lookup(F.lower(precision), PRECISION_BYTES), F.lit(2.0))


def precision_of(quantisation: Column) -> Column:
    q = F.upper(quantisation)
    return F.when(q.rlike("^(Q4|Q5|Q6|Q8)"), "int8").when(q.rlike("^(F32|FP32)"), "fp32").otherwise("fp16")


def explain_quantisation(level: Column, params: Column) -> Column:
    """(bits, bytes_per_param, weight_gb, error) of a quantisation level; unknown levels name those there are."""
    per = _lookup(F.upper(level), QUANT_BYTES)
    error = F.when(per.isNull(), F.concat(F.lit("unknown level, one of "), F.lit(", ".join(QUANT_BYTES))))
    return F.struct((per * 8).alias("bits"), per.alias("bytes_per_param"), (params * per / 1024**3).alias("weight_gb"), error.alias("error"))


#: Model types of the estimate, and the memory that a process takes besides its model (fixed values, as are the numbers of its formula).
TEXT_MODELS = ("text-generation-hf", "text-generation-ollama", "vlm")
SPEECH_MODELS = ("asr-hf", "vad-hf")
OVERHEAD_BYTES = 500 * 1024 * 1024


def resource_estimate(params: Column, model_type: Column, per_param: Column, context: int = 2048, output: int = 512, batch: int = 1, peak_tflops: float = 40.0, kv_cache: bool = True) -> Column:
    """Memory in GB, latency and throughput of a model: an analytic estimate from its number of parameters."""
    text, speech = model_type.isin(*TEXT_MODELS), model_type.isin(*SPEECH_MODELS)
    flops = F.when(text, params * (2.0 * (context + output) * batch)).when(speech, params * (1.5 * context * batch)).otherwise(params * (2.0 * max(context + output, 1024) * batch))
    hidden = F.greatest(F.lit(64), F.floor(F.sqrt(params.cast("double")) * 0.7))
    act = F.floor(hidden * per_param * (batch * (context + output)))
    if kv_cache:
        act = act + F.floor(hidden * per_param * (batch * context * 2))
    small = F.greatest(F.lit(32), F.floor(F.pow(params.cast("double"), F.lit(0.4)) * 0.5))
    act = F.when(text, act).when(speech, F.floor(small * per_param * (batch * context))).otherwise(F.lit(50 * 1024 * 1024))
    weights = F.floor(params * per_param)
    seconds = flops / (peak_tflops * 1e12)
    latency = F.when(model_type == "text-generation-ollama", seconds * 7.0 + 0.05).otherwise(seconds * 5.0)
    gb = lambda b: b / float(1024**3)
    return F.struct(
        flops.alias("flops"), gb(weights).alias("weights_gb"), gb(act).alias("activations_gb"), F.lit(OVERHEAD_BYTES / 1024**3).alias("overhead_gb"),
        gb(weights + act + OVERHEAD_BYTES).alias("total_gb"), latency.alias("latency_s"), F.when(latency > 0, batch / latency).alias("qps"),
    )


def estimate_tags(values: dict[str, Column]) -> Column:
    """Map of 'est_' tags: doubles with four decimals, lists comma-joined, nulls left out.  values: name → (column, kind)."""
    out = []
    for name, (col, kind) in values.items():
        text = F.format_string("%.4f", col) if kind == "double" else F.array_join(col, ",") if kind == "list" else col.cast("string")
        out += [F.lit(f"est_{name}"), F.when(col.isNotNull(), text)]
    return F.map_filter(F.create_map(*out), lambda _, v: v.isNotNull())


def summary_layers(n: Column, group: int = 5, width: int = 4, summary_tokens: int = 512, model_tokens: int = 6000, safety: float = 0.8, depth: int = 40) -> Column:
    """Layers of a layered summary: groups of ``group``, then of ``width``, until one is left or the rest fits the model."""
    start = F.struct(F.lit(1).cast("long").alias("layers"), F.ceil(n / group).cast("long").alias("items"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        go = (acc.items > 1) & ~acc.done
        items = F.when(go, F.ceil(acc.items / width).cast("long")).otherwise(acc.items)
        return F.struct(F.when(go, acc.layers + 1).otherwise(acc.layers).alias("layers"), items.alias("items"), (acc.done | (go & (items * summary_tokens <= model_tokens * safety))).alias("done"))

    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step, lambda a: a.layers))


def tile_grid(width: Column, height: Column, most: int = 12, tile: int = 448) -> Column:
    """(cols, rows) of the tiling whose aspect ratio is closest, at most ``most`` tiles; of equal ones the later, larger
    grid counts if the picture covers more than half of its area."""
    grids = sorted({(i, j) for n in range(1, most + 1) for i in range(1, n + 1) for j in range(1, n + 1) if i * j <= most}, key=lambda g: (g[0] * g[1], g))
    aspect, area = width / height, width * height
    best, gap = F.struct(F.lit(1).alias("cols"), F.lit(1).alias("rows")), F.lit(float("inf"))
    acc = F.struct(gap.alias("gap"), best.alias("g"))
    table = F.array(*[F.struct(F.lit(i).alias("cols"), F.lit(j).alias("rows")) for i, j in grids])

    def step(a: Column, g: Column) -> Column:
        d = F.abs(aspect - g.cols / g.rows)
        take = (d < a.gap) | ((d == a.gap) & (area > 0.5 * tile * tile * g.cols * g.rows))
        return F.struct(F.when(d < a.gap, d).otherwise(a.gap).alias("gap"), F.when(take, g).otherwise(a.g).alias("g"))

    return F.aggregate(table, acc, step, lambda a: a.g)


def blank_to_dash(text: Column) -> Column:
    return F.coalesce(F.when(text != "", text), F.lit("-"))


def json_path(text: Column, path: str, default: str | None = None) -> Column:
    got = F.get_json_object(text, path)
    return got if default is None else F.coalesce(got, F.lit(default))


def envelope(source: Column, target: Column, kind: Column, payload: Column, priority: Column, correlation: Column, ttl: Column, now: Column) -> Column:
    """A message in the standard form; the correlation id, priority and life are inherited from the request."""
    return F.struct(
        F.uuid().alias("message_id"), F.coalesce(correlation, F.uuid()).alias("correlation_id"), format_iso(now).alias("timestamp"), source.alias("source_service"),
        target.alias("target_service"), kind.alias("message_type"), F.coalesce(priority, F.lit("MEDIUM")).alias("priority"), payload.alias("payload"),
        F.lit(0).alias("retry_count"), F.coalesce(ttl, F.lit(3600)).alias("ttl"),
    )


def error_payload(message: Column, code: Column, now: Column) -> Column:
    return F.struct(message.alias("message"), code.alias("code"), format_iso(now).alias("timestamp"))


def final_result(analysis: Column, summary: Column, save: Column) -> Column:
    return F.struct(analysis.alias("analysis_result"), summary.alias("summary_result"), save.alias("save_result"))


def cache_key(name: str, **fields: Column) -> Column:
    """SHA-256 over the name and the canonical JSON of all arguments, the filter included."""
    return F.sha2(F.concat(F.lit(name + ":"), F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]))), 256)


def decode_base64(data: Column) -> Column:
    return F.unbase64(F.regexp_replace(data, "^data:[^,]*,", ""))


#: Columns that tell what a dataset holds, in the order they are looked for (fixed values).
DATASET_KEYS = {
    "image": ("image", "img", "picture", "photo", "pixel_values"),
    "audio": ("audio", "sound", "speech", "waveform", "audio_file"),
    "video": ("video", "clip", "frames", "video_file"),
    "text": ("text", "sentence", "content", "input_text", "target_text"),
}


def dataset_type(keys: Column) -> Column:
    out = F.lit("multimodal")
    for kind, names in reversed(DATASET_KEYS.items()):
        out = F.when(F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names])), kind).otherwise(out)
    return F.when(F.size(keys) == 0, "unknown").otherwise(out)


def entropy(histogram: Column) -> Column:
    """Of a 256-bin histogram, natural log, with 1e-9 added inside."""
    total = F.aggregate(histogram, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return -F.aggregate(histogram, F.lit(0.0), lambda s, x: s + x / total * F.log(x / total + 1e-9))


def frame_is_good(mean: Column, histogram: Column) -> Column:
    return (mean > 5) & (entropy(histogram) > 0.5)


def top_labels(labels: Column, probabilities: Column, k: int = 5) -> Column:
    """The k likeliest (label, probability), four decimals; ties by label."""
    pairs = F.zip_with(labels, probabilities, lambda n, p: F.struct((-p).alias("neg"), n.alias("label")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x.label.alias("label"), F.round(-x.neg, 4).alias("probability")))


def confident(items: Column, least: float = 0.7) -> Column:
    return F.filter(items, lambda i: i.score >= least)


def content_to_embed(kind: Column, summary: Column, text: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    return F.coalesce(F.when(kind == "summary", some(summary)), F.when(kind == "text", some(text)), some(summary), some(text), F.lit(""))


def sanitise_path(path: Column) -> Column:
    """Without outer slashes and doubled separators; null if a segment is '..'."""
    clean = F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), "^/+|/+$", "")
    return F.when(~F.array_contains(F.split(clean, "/"), ".."), clean)


def sanitise_name(name: Column) -> Column:
    """The last segment, unquoted, odd characters as '_'; null if nothing is left of it."""
    plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    base = F.regexp_replace(F.element_at(F.split(plain, r"[\\/]"), -1), r"(?U)[^\w.\-]", "_")
    return F.when(~base.isin("", ".", ".."), base)


def pick(names: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def substitute_variables(text: str, values: dict[str, str]) -> str:
    """``${NAME}`` in a configuration text replaced; an unknown name is an error."""
    import re

    return re.sub(r"\$\{(\w+)\}", lambda m: values[m[1]], text)


def prompt_image(data: Column, path: Column, prompt: Column, default: str = "Describe the image.") -> Column:
    """(image, path, prompt, error) of a picture request: data as base64 or a path is needed, the prompt has a default."""
    error = F.when(data.isNull() & path.isNull(), "image missing")
    return F.struct(decode_base64(data).alias("image"), path.alias("path"), F.coalesce(F.when(prompt != "", prompt), F.lit(default)).alias("prompt"), error.alias("error"))
