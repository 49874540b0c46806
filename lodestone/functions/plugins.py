"""Replaceable functions: scorers, model clients, embedders. The defaults are deterministic and need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx

SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(source: str):
    """Register a score Column of (response, gold) for a data source."""

    def wrap(f):
        SCORERS[source] = f
        return f

    return wrap


@scorer("math")
def math_score(response: Column, gold: Column) -> Column:
    """1 for equal normalised answers, else -1; without a boxed answer -1."""
    boxed = tx.last_boxed(response)
    return F.when((boxed != "") & equivalent(boxed, gold), 1.0).otherwise(-1.0)


@scorer("strict_box")
def strict_box_score(response: Column, gold: Column) -> Column:
    """1 if the last boxed answer of the last 100 characters is the gold one as it stands, else -1."""
    return F.when(tx.last_boxed(F.right(response, F.lit(100))) == gold, 1.0).otherwise(-1.0)


@scorer("format")
def format_score(response: Column, gold: Column) -> Column:
    return F.when(tx.think_answer_format(response), 1.0).otherwise(-1.0)


def equivalent(a: Column, b: Column) -> Column:
    """Answers equal as text or as numbers once normalised; a symbolic library can be put in its place."""
    x, y = tx.normalise_answer(a), tx.normalise_answer(b)
    return (x == y) | F.coalesce(F.abs(x.try_cast("double") - y.try_cast("double")) < 1e-9, F.lit(False))


def score(rows: DataFrame, source: str, response: str, gold: str) -> DataFrame:
    """Add ``score`` by the scorer of each row's source; null for an unknown one."""
    out = F.lit(None).cast("double")
    for name, f in SCORERS.items():
        out = F.when(F.col(source) == name, f(F.col(response), F.col(gold))).otherwise(out)
    return rows.withColumn("score", out)


def echo(prompts: list[str]) -> list[str]:
    """A model that repeats the digest of its prompt."""
    return ["reply " + hashlib.md5(p.encode()).hexdigest()[:8] for p in prompts]


def complete(rows: DataFrame, prompt: str, client: Callable[[list[str]], list[str]] = echo, batch: int = 64, seconds: float | None = None) -> DataFrame:
    """Add ``response`` and ``error``: a batch that fails has its error and an empty response, others go on.

    A batch that takes longer than ``seconds`` fails by that; what the client still does then is not waited for.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import ThreadPoolExecutor

        pool = None
        for part in parts:
            responses: list[str] = []
            errors: list[str | None] = []
            prompts = ["" if p is None else p for p in part[prompt].to_pylist()]
            for low in range(0, len(prompts), batch):
                some = prompts[low : low + batch]
                try:
                    if seconds is None:
                        found = list(client(some))
                    else:
                        pool = pool or ThreadPoolExecutor(1)
                        found = list(pool.submit(client, some).result(seconds))
                    if len(found) != len(some):
                        raise ValueError(f"{len(found)} responses to {len(some)} prompts")
                    error = None
                except TimeoutError:
                    found, error = [""] * len(some), f"no answer within {seconds} s"
                    if pool:  # its thread may still be busy
                        pool = pool.shutdown(wait=False, cancel_futures=True)
                except Exception as e:  # noqa: BLE001  a client may raise anything
                    found, error = [""] * len(some), str(e)
                responses += found
                errors += [error] * len(some)
            added = [pa.array(responses, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "response", "error"])
        if pool:
            pool.shutdown(wait=False)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", response string, error string")


def hashed_embedding(texts: list[str], size: int = 256) -> list[list[float]]:
    """Unit vectors of hashed words."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest())
            out[i, h % size] += 1 if h >> 63 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]] = hashed_embedding, batch: int = 10) -> DataFrame:
    """Add ``embedding``; null where the embedder fails or the text is null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list = []
            for low in range(0, len(part), batch):
                texts = part[text].iloc[low : low + batch].tolist()
                try:
                    out += [None if t is None else v for t, v in zip(texts, embedder([t or "" for t in texts]), strict=True)]
                except Exception:  # noqa: BLE001
                    out += [None] * len(texts)
            yield part.assign(embedding=pd.Series(out, index=part.index, dtype=object))

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<double>")


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples))


def mix_at_snr(clean: Column, noise: Column, db: float) -> Column:
    """``clean`` plus ``noise`` scaled to a ratio of ``db`` decibels."""
    gain = rms(clean) / (F.greatest(rms(noise), F.lit(1e-12)) * 10 ** (db / 20))
    return F.zip_with(clean, noise, lambda c, n: c + n * gain)
