"""Pluggable functions: rewards, chunkers and models.

A model or scorer is a Python function over lists, run per Arrow batch. An error in a batch is retried row by row; a row that
still fails scores 0.0 (or gives null text), so one bad answer never stops a job.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.session import materialize

REWARDS: dict[str, Callable[[list, list], list[float]]] = {}


def register_reward(name: str) -> Callable[[Callable], Callable]:
    """Register a scorer ``f(answers, golds) -> scores``; a name is taken once."""

    def add(f: Callable) -> Callable:
        if REWARDS.get(name, f) is not f:
            raise ValueError(f"reward {name} is registered already")
        REWARDS[name] = f
        return f

    return add


def function_from_file(path: str, name: str) -> Callable:
    """The function ``name`` of a Python file; a missing file or name raises."""
    spec = importlib.util.spec_from_file_location("latticework_plugin", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return getattr(module, name)


def _safely(f: Callable, *columns: list, default: object) -> list:
    try:
        return list(f(*columns))
    except Exception:  # noqa: BLE001
        out = []
        for row in zip(*columns, strict=True):
            try:
                out.append(next(iter(f(*[[x] for x in row]))))
            except Exception:  # noqa: BLE001
                out.append(default)
        return out


def rewarded(df: DataFrame, reward: str | Callable, answer: str, gold: str) -> DataFrame:
    """Adds ``reward`` (double) by a registered name or a function."""
    if isinstance(reward, str):
        if reward not in REWARDS:
            raise ValueError(f"unknown reward {reward}; known: {sorted(REWARDS)}")
        reward = REWARDS[reward]
    f = reward

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(reward=[float(x) for x in _safely(f, b[answer].tolist(), b[gold].tolist(), default=0.0)])

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("reward", T.DoubleType())]))


def modelled(df: DataFrame, model: Callable[[list], list[str]], prompt: str, out: str) -> DataFrame:
    """Adds the model's text for each prompt, null where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: _safely(model, b[prompt].tolist(), default=None)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def generated(df: DataFrame, model: Callable[[list], list[str]], verify: Callable[[list], list[bool]], prompt: str, tries: int = 3) -> DataFrame:
    """Adds ``text`` and ``verified``: rows whose text fails verification are asked again, at most ``tries`` times, and
    keep their last text. The loop runs on the driver over the rows that are left; ``model`` gets the prompt with
    the number of the try in front, so that a deterministic one can vary."""
    left, done = df, None
    for k in range(tries):
        asked = modelled(left.withColumn("_p", F.concat(F.lit(f"{k}: "), F.col(prompt))), model, "_p", "text").drop("_p")

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(verified=[bool(x) for x in _safely(verify, b["text"].tolist(), default=False)])

        out = materialize(asked.mapInPandas(check, T.StructType([*asked.schema.fields, T.StructField("verified", T.BooleanType())])), "generated")
        good = out if k == tries - 1 else out.where("verified")
        done = good if done is None else done.unionByName(good)
        left = out.where("not verified").drop("text", "verified")
        if left.isEmpty():
            break
    return done


def chunked(df: DataFrame, key: str, text: str, chunker: Callable[[str], list[str]]) -> DataFrame:
    """(key, chunk, content) by a pluggable chunker; null texts give no chunks."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b[text], strict=True) if t is not None for i, c in enumerate(chunker(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "content"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk int, content string")


@register_reward("exact")
def exact(answers: list, golds: list) -> list[float]:
    """1.0 for equal texts without regard to case and outer white space."""
    return [float(a is not None and g is not None and a.strip().lower() == g.strip().lower()) for a, g in zip(answers, golds, strict=True)]


# --- time limits and named models -----------------------------------------------------------------------------------


def limited(f: Callable, seconds: float, default: object = None) -> Callable:
    """``f`` of one item, given up after ``seconds``: late or failing items give ``default``.

    The limit interrupts Python code in the worker's main thread; where there is none, items run without a limit.
    """
    import signal
    import threading

    def run(*args: object) -> object:
        if threading.current_thread() is not threading.main_thread():
            try:
                return f(*args)
            except Exception:  # noqa: BLE001
                return default

        def late(*_: object) -> None:
            raise TimeoutError

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return f(*args)
        except Exception:  # noqa: BLE001
            return default
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    return run


def managed_rewards(df: DataFrame, reward: Callable[[str, str], float], answer: str, gold: str, seconds: float = 300.0, ending: str | None = None) -> DataFrame:
    """Adds ``reward`` of each row by a function of one answer and its gold one, 0.0 if it fails or takes longer than ``seconds``;
    the ``ending`` mark of generation is cut off first."""
    one = limited(lambda a, g: float(reward(a[: -len(ending)] if ending and a is not None and a.endswith(ending) else a, g)), seconds, 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(reward=[one(a, g) for a, g in zip(b[answer], b[gold], strict=True)])

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("reward", T.DoubleType())]))


#: Models by name: functions from a list of prompts to a list of texts.
MODELS: dict[str, Callable[[list], list[str]]] = {}


def register_model(name: str) -> Callable:
    def keep(f: Callable) -> Callable:
        MODELS[name] = f
        return f

    return keep


def model_named(name: str) -> Callable[[list], list[str]]:
    """The model of that name, or of the longest registered name that starts it; unknown names raise."""
    known = [k for k in MODELS if name.lower().startswith(k.lower())]
    if not known:
        raise ValueError(f"unknown model {name}; known: {sorted(MODELS)}")
    return MODELS[max(known, key=len)]
