"""Asking a chat model: one adapter for every kind of reply, and bounded concurrent calls with what went wrong as rows."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import slices
from ..session import ship

#: What a service answers that refuses a prompt.
REFUSAL = "content_flag_increment"


class Chat(Protocol):
    def chat(self, prompt: str) -> object:
        """A reply: a text, something with a ``text``, or a list of such, of which the first counts."""


#: Known services by name, from a configuration to a model.
SERVICES: dict[str, Callable[[dict], Chat]] = {"local_model": lambda config: config["llm"]}


def service(name: str, config: dict) -> Chat:
    if name not in SERVICES:
        raise ValueError(f"no service {name}; known: {sorted(SERVICES)}")
    return SERVICES[name](config)


def reply_text(reply: object) -> str:
    if isinstance(reply, list | tuple):
        reply = reply[0] if reply else ""
    return reply if isinstance(reply, str) else str(getattr(reply, "text", reply))


class Outcome(NamedTuple):
    """status: answered, refused, failed or late; ``reply`` has the answer or the last error."""

    status: str
    reply: str
    tries: int


def ask(model: Chat, prompt: str, retries: int = 2, pause: float = 0.0, refusal: str = REFUSAL) -> Outcome:
    """One prompt, tried again after an error; a refusal isn't tried again."""
    error = ""
    for k in range(retries + 1):
        try:
            text = reply_text(model.chat(prompt))
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            time.sleep(pause * (k < retries))
        else:
            return Outcome("refused" if text == refusal else "answered", text, k + 1)
    return Outcome("failed", error, retries + 1)


def ask_all(prompts: Iterator[str | None], model: Chat, at_once: int, seconds: float, retries: int, pause: float = 0.0) -> Iterator[Outcome]:
    """Outcomes in the order of prompts, with at most ``at_once`` calls under way or waiting to be read; a null prompt fails.

    A call that isn't back ``seconds`` after its turn to be read came is late; its thread is left to end by itself.
    """
    pool = ThreadPoolExecutor(at_once)
    ahead: deque[Future | None] = deque()

    def next_one() -> Outcome:
        f = ahead.popleft()
        if f is None:
            return Outcome("failed", "no prompt", 0)
        try:
            return f.result(timeout=seconds)
        except TooLate:
            f.cancel()
            return Outcome("late", f"no reply in {seconds:g} s", 1)

    try:
        for p in prompts:
            if len(ahead) >= at_once:
                yield next_one()
            ahead.append(pool.submit(ask, model, p, retries, pause) if p is not None else None)
        while ahead:
            yield next_one()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def answers(df: DataFrame, prompt: str, load: Callable[[], Chat], at_once: int = 8, seconds: float = 120.0, retries: int = 2, pause: float = 0.0) -> DataFrame:
    """Add ``status``, ``reply`` and ``tries``; ``load`` makes the model once for each task."""
    ship(df.sparkSession)
    cols = df.columns
    at = cols.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in (whole.slice(*s) for whole in batches for s in slices(whole.column(at))):
            got = list(ask_all((p.as_py() for p in b.column(at)), model, at_once, seconds, retries, pause))
            new = [pa.array([g.status for g in got], pa.string()), pa.array([g.reply for g in got], pa.string()), pa.array([g.tries for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*cols, "status", "reply", "tries"])

    return df.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], "status string, reply string, tries int"]))
