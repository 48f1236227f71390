"""Model and dataset registry: versions, priorities, stages, selection, configuration."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_versions(versions: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """The row of the largest version of each name, compared as numbers."""
    w = Window.partitionBy(name).orderBy(F.desc(F.col(version).cast("int")))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stage_distribution(versions: DataFrame, latest_only: bool = True) -> DataFrame:
    """(stage, task, n): models by lower-cased stage and by inference task, else model type, else 'unknown'."""
    rows = latest_versions(versions) if latest_only else versions
    some = lambda k: F.nullif(F.try_element_at("tags", F.lit(k)), F.lit(""))
    task = F.coalesce(some("inference_task"), some("model_type"), F.lit("unknown"))
    return rows.groupBy(F.lower("stage").alias("stage"), task.alias("task")).agg(F.count(F.lit(1)).alias("n"))


def search(versions: DataFrame, text: str | None = None, tags: dict[str, str] | None = None, name: str = "name") -> DataFrame:
    """Names that contain the text, whatever its case, and have all tags."""
    if text:
        versions = versions.where(F.contains(F.lower(name), F.lit(text.lower())))
    for k, v in (tags or {}).items():
        versions = versions.where(F.try_element_at("tags", F.lit(k)) == v)
    return versions


def register_version(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (name, tags, stage, ...) numbered after the largest version of their name."""
    top = versions.groupBy("name").agg(F.max(F.col("version").cast("int")).alias("_top"))
    w = Window.partitionBy("name").orderBy("seq")
    rows = new.join(top, "name", "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + F.row_number().over(w)).cast("string"))
    return versions.unionByName(rows.drop("_top", "seq"), allowMissingColumns=True)


def renumbered(models: Iterable[tuple]) -> Iterator[tuple]:
    """Models (task, priority or None, ...) in order, those without a priority last → (model, number).

    Of a task's numbers, all below ``free`` are taken; kept numbers from there on wait in ``beyond``.  So a number is looked up in no list,
    and a task of any size is one pass with the kept numbers ahead in memory."""
    same = object()
    task, group, free, top = same, None, 1, 0
    beyond: deque[int] = deque()
    models = iter(models)
    here = next(models, None)
    while here is not None:
        after = next(models, None)
        if here[0] != task:
            task, group, free, top = here[0], None, 1, 0
            beyond.clear()
        p = here[1]
        if p is None:
            got = top + 1
        elif p != group and (after is None or after[:2] != here[:2]):  # alone with its number
            got = p
            if p >= free:
                beyond.append(p)
        else:
            while beyond and beyond[0] <= free:
                free += beyond.popleft() == free
            if p != group and p >= free:
                got = p
                beyond.append(p)
            else:
                got, free = free, free + 1
        group, top = p, max(top, got)
        yield here, got
        here = after


def priorities(versions: DataFrame, task: str = "task", order: Sequence[str] = ("name", "version")) -> DataFrame:
    """Unique priorities per task, in column new_priority: the first of equal ones keeps its number, the others take the
    lowest free numbers in turn, and those without any follow the largest.  Gaps stay.  A sequential rule, in one pass over each task's models."""
    rows = versions.select(task, F.when(F.col("priority") > 0, F.col("priority")).cast("long").alias("_p"), *order)
    placed = rows.repartition(task).sortWithinPartitions(task, F.asc_nulls_last("_p"), *order)
    kinds = dict(versions.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def models() -> Iterator[tuple]:
            for batch in batches:
                types[:] = batch.schema.types
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        numbers = renumbered(models())
        while some := list(islice(numbers, 5000)):
            columns = zip(*((m[0], *m[2:], n) for m, n in some), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [types[0], *types[2:], pa.int32()], strict=True)], names=[task, *order, "new_priority"])

    return placed.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (task, *order)), "new_priority int"]))


def insert_priority(rows: DataFrame, target: int | None, column: str = "new_priority") -> tuple[DataFrame, Column]:
    """(rows, given): a model put in at a number shifts all from there on, if it is taken; without one it follows the largest."""
    if target is None:
        return rows, F.coalesce(F.max(column), F.lit(0)) + 1
    if target < 1:
        raise ValueError("priority must be at least 1")
    taken = rows.where(F.col(column) == target).limit(1).select(F.lit(True).alias("_taken"))
    shifted = rows.join(F.broadcast(taken), F.lit(True), "left")
    shift = F.col("_taken").isNotNull() & (F.col(column) >= target)
    return shifted.withColumn(column, F.when(shift, F.col(column) + 1).otherwise(F.col(column))).drop("_taken"), F.lit(target)


def transition(versions: DataFrame, name: str, version: str, stage: str, archive_staging: bool = False) -> DataFrame:
    """A version moves to a stage: production is exclusive, so other production versions are archived; a production version
    is never demoted directly; staging versions are archived only if asked for.  Column error tells a refusal."""
    me = (F.col("name") == name) & (F.col("version") == version)
    refused = me & (F.col("stage") == "production") & F.lit(stage not in ("production", "archived"))
    other = (F.col("name") == name) & ~me
    moved = F.when(me & ~refused, F.lit(stage))
    if stage == "production":
        moved = moved.when(other & (F.col("stage") == "production"), F.lit("archived"))
    if stage == "staging" and archive_staging:
        moved = moved.when(other & (F.col("stage") == "staging"), F.lit("archived"))
    return versions.withColumn("error", F.when(refused, F.lit("production can't be demoted directly"))).withColumn("stage", moved.otherwise(F.col("stage")))


def select_best(models: DataFrame, budget_gb: float, max_latency: float | None = None, min_qps: float | None = None, order: str = "pos") -> DataFrame:
    """The model of the best weighted score that fits 95 % of the memory, the latency and the throughput asked for."""
    rows = models.where(F.col("total_gb").isNull() | (F.col("total_gb") <= budget_gb * 0.95))
    latency, qps = F.coalesce("latency_s", F.lit(9999.0)), F.coalesce("qps", F.lit(0.0))
    if max_latency is not None:
        rows = rows.where(latency <= max_latency)
    if min_qps is not None:
        rows = rows.where(qps >= min_qps)
    memory = F.coalesce(1 / (F.col("total_gb") + 0.1), F.lit(0.0))
    return rows.withColumn("score", 0.4 * memory + 0.4 / (latency + 0.1) + 0.2 * qps).orderBy(F.desc("score"), order).limit(1)


def select_device(devices: DataFrame, need_gb: float, strategy: str = "least_used") -> DataFrame:
    """A device with enough free memory; if none has, any.  least_used: most free memory, then least load; first_fit: in order."""
    enough = F.col("free_gb") >= need_gb
    order = [F.desc("free_gb"), F.asc("load"), F.asc("device")] if strategy == "least_used" else [F.asc("device")]
    return devices.orderBy(F.desc(enough), *order).limit(1)


def round_robin(requests: DataFrame, n: int, order: Sequence[str], partition: str) -> DataFrame:
    """Requests dealt in turn to n candidates, counted within each partition of arrival."""
    w = Window.partitionBy(partition).orderBy(*order)
    return requests.withColumn("candidate", F.pmod(F.row_number().over(w) - 1, F.lit(n)).cast("long"))


def device_totals(devices: DataFrame) -> DataFrame:
    return devices.agg(*[F.round(F.sum(F.coalesce(c, F.lit(0.0))), 2).alias(c) for c in ("total_gb", "used_gb")], F.count(F.lit(1)).alias("n"))


def compatible(requests: DataFrame, task_engines: DataFrame) -> DataFrame:
    """Requests (task, engine, data map) with an error: unknown task, engine not for the task, or missing data."""
    table = task_engines.groupBy("task").agg(F.collect_set("engine").alias("engines"), F.first("required").alias("required"))
    rows = requests.join(table, "task", "left")
    missing = F.array_except("required", F.map_keys("data"))
    error = F.when(F.col("engines").isNull(), "unknown task").when(~F.array_contains("engines", F.col("engine")), "engine not supported").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    return rows.withColumn("error", error).drop("engines", "required")


def supported(task_engines: DataFrame) -> DataFrame:
    return task_engines.groupBy("task").agg(F.array_sort(F.collect_set("engine")).alias("engines"))


def success_share(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("status") == "success").alias("n_ok"), F.count(F.lit(1)).alias("n"))


def flatten_config(config: dict, prefix: str = "") -> list[tuple[str, str, str]]:
    """(path, key, value) of every entry of a nested configuration."""
    out = []
    for k, v in config.items():
        path = f"{prefix}.{k}" if prefix else k
        out.append((path, k, None if isinstance(v, dict) else str(v)))
        if isinstance(v, dict):
            out += flatten_config(v, path)
    return out


def search_config(rows: DataFrame, text: str) -> DataFrame:
    """Entries (path, key, value) whose key or value contains the text, with match_type."""
    hit = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    kind = F.when(hit("key"), "key").when(hit("value"), "value")
    return rows.withColumn("match_type", kind).where("match_type is not null")


def config_report(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """(missing, n_items): required top sections that are absent, and how many entries there are."""
    tops = F.collect_set(F.when(~F.contains("path", F.lit(".")), F.col("key")))
    return rows.agg(F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), tops)).alias("missing"), F.count(F.lit(1)).alias("n_items"))


def dataset_inventory(files: DataFrame) -> DataFrame:
    """(dataset, n_files, size_mb, extensions) of files (dataset, path, length); empty ones don't appear."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by = files.groupBy("dataset", ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"))
    return by.groupBy("dataset").agg(F.sum("n").alias("n_files"), F.round(F.sum("b") / 1048576, 2).alias("size_mb"), F.array_sort(F.collect_list(F.struct("ext", "n"))).alias("extensions"))


def local_models(models: DataFrame) -> DataFrame:
    """Name, size in GB (two decimals), parameters and quantisation of models at hand."""
    return models.select("name", F.round(F.col("size") / 1073741824, 2).alias("size_gb"), "parameter_size", "quantisation")


def device_readings(readings: DataFrame, sources: Sequence[str], metric: str) -> DataFrame:
    """A device metric from the first source that has it."""
    return readings.withColumn(metric, F.coalesce(*[F.col(f"{s}_{metric}") for s in sources]))
