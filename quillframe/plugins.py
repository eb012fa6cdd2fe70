"""Boundaries of the engine: translators, layout models, splitters, runners, token counters and patterns.

Each is a protocol; the ones here are deterministic and need nothing from outside.  Models
run where the rows are (mapInArrow), a worker at a time, never on the driver.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Translator(Protocol):
    """name and params tell one translator's memory from another's."""

    name: str
    params: dict

    def translate(self, text: str) -> str: ...

    def answer(self, prompt: str | None) -> str | None:
        """The answer to a whole prompt; None is asked with to learn whether there are any (NotImplementedError: none)."""


@dataclass
class Reversed:
    """A translator for tests: every text backwards."""

    name: str = "reversed"
    params: dict = field(default_factory=dict)

    def translate(self, text: str) -> str:
        return text[::-1]

    def answer(self, prompt: str | None) -> str | None:
        raise NotImplementedError


@dataclass
class Echo:
    """A model for tests: answers a JSON array of inputs with upper-cased outputs."""

    name: str = "echo"
    params: dict = field(default_factory=dict)

    def translate(self, text: str) -> str:
        return text.upper()

    def answer(self, prompt: str | None) -> str | None:
        if prompt is None:
            return None
        items = json.loads(prompt[prompt.index("[") :])
        return json.dumps([{"id": i["id"], "output": i["input"].upper()} for i in items], ensure_ascii=False)


def answers_prompts(translator: Translator) -> bool:
    try:
        translator.answer(None)
    except NotImplementedError:
        return False
    return True


class Refused(Exception):
    """A content filter's answer: it is not asked again."""


def retried(call: Callable[[str], str], attempts: int = 100, first: float = 1.0, most: float = 15.0, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> Callable[[str], str]:
    """call, tried again after growing pauses (doubled from first up to most, with some jitter); refusals and the last error go on."""
    rng = random.Random(seed)

    def run(text: str) -> str:
        pause = first
        for k in range(attempts):
            try:
                return call(text)
            except Refused:
                raise
            except Exception:
                if k == attempts - 1:
                    raise
                sleep(min(most, pause) * (1 - 0.1 * rng.random()))
                pause = min(most, 2 * pause)
        raise ValueError("no attempts")

    return run


class Limiter:
    """At most per_second calls: wait() returns when the next may go."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.next = 1 / per_second, clock, sleep, float("-inf")

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.interval


def translated(rows: DataFrame, translator: Translator, text: str = "text", per_second: float | None = None) -> DataFrame:
    """rows with translation, engine, params_json and error (null, content_filter or failed).

    per_second is the rate of one worker: share the service's rate by the number of tasks.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, translation string, engine string, params_json string, error string"
    names = [*rows.columns, "translation", "engine", "params_json", "error"]
    at = names.index(text)
    params = json.dumps(translator.params, sort_keys=True, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = Limiter(per_second) if per_second else None
        for batch in batches:
            out, errors = [], []
            for t in batch.column(at).to_pylist():
                if limiter:
                    limiter.wait()
                try:
                    out.append(None if t is None else translator.translate(t))
                    errors.append(None)
                except Refused:
                    out.append(None)
                    errors.append("content_filter")
                except Exception:
                    out.append(None)
                    errors.append("failed")
            n = batch.num_rows
            columns = [*batch.columns, pa.array(out, pa.string()), pa.array([translator.name] * n, pa.string()), pa.array([params] * n, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


class LayoutModel(Protocol):
    def detect(self, page: dict) -> list[dict]:
        """Boxes of a page: label, conf, x, y, x2, y2."""


@dataclass
class Bands:
    """A layout model for tests: horizontal bands of equal height."""

    labels: tuple[str, ...] = ("title", "plain text", "footnote")

    def detect(self, page: dict) -> list[dict]:
        step = page["h"] / len(self.labels)
        return [{"label": n, "conf": 1 - k / 10, "x": 0.0, "y": page["h"] - (k + 1) * step, "x2": page["w"], "y2": page["h"] - k * step} for k, n in enumerate(self.labels)]


DETECTION = "doc_id long, page_no long, det_id int, label string, conf double, x double, y double, x2 double, y2 double"


def detections(pages: DataFrame, model: LayoutModel) -> DataFrame:
    """Boxes that a model finds on pages (doc_id, page_no, w, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DETECTION.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 5]
        for batch in batches:
            rows = [{"doc_id": p["doc_id"], "page_no": p["page_no"], "det_id": k, **b} for p in batch.to_pylist() for k, b in enumerate(model.detect(p))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    return pages.select("doc_id", "page_no", "w", "h").mapInArrow(run, DETECTION)


#: A split strategy takes pages (doc_id, page_no) and returns parts (doc_id, part_no, first_page, last_page, n_pages).
SplitStrategy = Callable[[DataFrame], DataFrame]


def by_page_count(size: int) -> SplitStrategy:
    from quillframe.operators.pages import parts

    return lambda pages: parts(pages, size)


class Runner(Protocol):
    """Runs a request and tells what happens: emit(type, payload); abort() is asked between steps."""

    def run(self, request: dict, emit: Callable[[str, dict], None], abort: Callable[[], bool]) -> None: ...


@dataclass
class FakeRunner:
    """Events of a made-up run: mode normal ends, burst tells more, block never ends by itself."""

    mode: str = "normal"
    steps: int = 5

    def run(self, request: dict, emit: Callable[[str, dict], None], abort: Callable[[], bool]) -> None:
        emit("start", {"id": request["id"]})
        for k in range(self.steps * (20 if self.mode == "burst" else 1)):
            if abort():
                emit("error", {"code": "aborted"})
                return
            emit("progress", {"step": k})
        if self.mode != "block":
            emit("finish", {"id": request["id"]})


def executed(request: dict, runner: Runner, most: int = 1000, abort_after: int | None = None) -> list[dict]:
    """The numbered events of a run: nothing behind the first terminal one, which is made if there is none; the newest ``most`` stay."""
    log: list[dict] = []
    done = False

    def emit(kind: str, payload: dict) -> None:
        nonlocal done
        if not done:
            log.append({"sequence": len(log) + 1, "type": kind, "payload": payload})
            done = kind in ("finish", "error")

    try:
        runner.run(request, emit, lambda: abort_after is not None and len(log) >= abort_after)
    except Exception as e:
        emit("error", {"code": "failed", "message": str(e).split("\n")[0][:500]})
    if not done:
        emit("error", {"code": "missing_terminal"})
    return log[-most:]


#: A token counter is a column expression over a text.
TokenCounter = Callable[[Column], Column]


def counted(paras: DataFrame, counter: TokenCounter) -> DataFrame:
    return paras.withColumn("n_tokens", counter(F.col("text")))


@dataclass(frozen=True)
class Patterns:
    """A user's own patterns for formula fonts and formula characters, beside the built-in rules."""

    font: str | None = None
    char: str | None = None

    def is_formula(self, font: Column, text: Column, built_in: Column) -> Column:
        out = built_in
        if self.font:
            out = out | font.rlike(self.font)
        if self.char:
            out = out | text.rlike(self.char)
        return out


def register(spark: SparkSession) -> list[str]:
    """SQL functions of the engine: quill_nfkc, and quill_batches (the fold of token counts)."""
    from quillframe.functions.strings import _composed
    from quillframe.operators.text import batch_numbers

    @F.pandas_udf("array<long>")
    def numbers(tokens: pd.Series, most_tokens: pd.Series, most_items: pd.Series) -> pd.Series:
        return pd.Series([batch_numbers(list(t), int(a), int(b)) for t, a, b in zip(tokens, most_tokens, most_items, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return _composed(texts)

    spark.udf.register("quill_batches", numbers)
    spark.udf.register("quill_nfkc", composed)
    return ["quill_batches", "quill_nfkc"]
