"""Model calls as injectable functions, with deterministic offline defaults, and a registry of handlers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.envelopes import has_keys

#: Length of an embedding.
DIMENSIONS = 1024
_handlers: dict[tuple[str, str], Callable] = {}


def hashed_embedding(text: str, dim: int = DIMENSIONS) -> np.ndarray:
    """Default embedder: signed counts of hashed words, normalised."""
    v = np.zeros(dim, "f4")
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    n = float(np.sqrt((v * v).sum()))
    return v / n if n else v


def embed(text: Column, model: Callable[[str], np.ndarray] | None = None, dim: int = DIMENSIONS) -> Column:
    """array<float> of each text.  The model is loaded once per task (iterator form)."""
    call = model or (lambda t: hashed_embedding(t, dim))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: np.asarray(call(t or ""), "f4"))

    return run(text)


def media_rows(files: DataFrame, model: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that a media model (speech, speakers, sound classes, frame text) gives for binary files (path, content)."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [{"path": p, **r} for p, c in zip(df["path"], df["content"], strict=True) for r in model(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def describe(image: Column, prompt: Column, model: Callable[[bytes, str], str] | None = None) -> Column:
    """Text for an image and a prompt."""
    call = model or (lambda image, prompt: f"{prompt}: {len(image)} bytes")

    @F.pandas_udf("string")
    def run(images: pd.Series, prompts: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else call(bytes(i), p or "") for i, p in zip(images, prompts, strict=True)])

    return run(image, prompt)


def register(task: str, kind: str = "default") -> Callable:
    """Decorator: a handler for a task and a model type."""

    def add(fn: Callable) -> Callable:
        _handlers[task, kind] = fn
        return fn

    return add


def handler(task: str, kind: str) -> Callable:
    """The exact handler, else the task's default."""
    for key in ((task, kind), (task, "default")):
        if key in _handlers:
            return _handlers[key]
    raise KeyError(f"no handler for {task}")


#: Engines and data keys of each task (fixed values).
TASKS = {
    "text-generation": (("transformers", "ollama"), ("inputs",)),
    "vlm": (("transformers",), ("image", "prompt")),
    "asr": (("transformers",), ("audio",)),
    "vad": (("transformers",), ("audio",)),
    "ocr": (("transformers",), ("image",)),
}
#: Options of one engine under the names of another (fixed values).
OPTION_NAMES = {"max_length": "num_predict", "max_new_tokens": "num_predict", "temperature": "temperature", "top_p": "top_p", "top_k": "top_k", "repetition_penalty": "repeat_penalty"}


def task_table(spark) -> DataFrame:
    return spark.createDataFrame([(t, e, list(need)) for t, (engines, need) in TASKS.items() for e in engines], "task string, engine string, required array<string>")


def engine_options(options: Column) -> Column:
    """An option map under the engine's names; unknown options are left out."""
    table = F.create_map(*[F.lit(x) for kv in OPTION_NAMES.items() for x in kv])
    known = F.map_filter(options, lambda k, _: F.map_contains_key(table, k))
    return F.map_from_entries(F.array_distinct(F.transform(F.map_entries(known), lambda e: F.struct(F.element_at(table, e.key).alias("key"), e.value.alias("value")))))


def route_requests(requests: DataFrame) -> DataFrame:
    """Requests (task, engine, data as JSON) with an error, null where they can run."""
    out = F.lit("unknown task")
    for task, (engines, need) in TASKS.items():
        bad = F.when(~F.col("engine").isin(*engines), "engine not supported").when(~has_keys(F.col("data"), need), "missing data")
        out = F.when(F.col("task") == task, bad).otherwise(out)
    return requests.withColumn("error", out)


def infer(requests: DataFrame, functions: dict[tuple[str, str], Callable[[Any], str]]) -> DataFrame:
    """(request columns, success, result, error): each valid request through the function of its (task, engine)."""
    rows = route_requests(requests)

    @F.pandas_udf("struct<result:string,error:string>")
    def run(task: pd.Series, engine: pd.Series, data: pd.Series, error: pd.Series) -> pd.DataFrame:
        out = []
        for t, e, d, x in zip(task, engine, data, error, strict=True):
            try:
                out.append((None, x) if x is not None else (functions[t, e](d), None))
            except Exception as problem:  # a model's failure is the request's result
                out.append((None, str(problem)))
        return pd.DataFrame(out, columns=["result", "error"])

    rows = rows.withColumn("_r", run("task", "engine", "data", "error"))
    return rows.select(*requests.columns, F.col("_r.error").isNull().alias("success"), "_r.result", "_r.error")
