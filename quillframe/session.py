"""Sessions and options."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConf:
    """Options that change results, with their defaults."""

    pages: str | None = None
    min_text_length: int = 5
    lang_in: str = "en"
    lang_out: str = "zh"
    split_short_lines: bool = False
    short_line_split_factor: float = 0.8
    max_pages_per_part: int | None = None
    merge_alternating_line_numbers: bool = True
    remove_non_formula_lines: bool = False
    figure_overlap: float = 0.9
    paragraph_overlap: float = 0.9
    dual_translate_first: bool = False
    batch_tokens: int = 200
    batch_items: int = 5
    term_tokens: int = 600
    term_items: int = 12
    memo_rows: int = 50_000
    replay_events: int = 1_000
    report_seconds: float = 0.1
    queries_per_second: float = 4.0

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "quillframe.") -> EngineConf:
        """The options of a session: its settings of these names, as ``quillframe.batch_tokens``, over the defaults."""
        given = {}
        for f in fields(cls):
            raw = spark.conf.get(prefix + f.name, None)
            if raw is not None:
                given[f.name] = parsed(f.name, str(f.type), raw)
        return cls(**given)

    @classmethod
    def from_toml(cls, text: str) -> EngineConf:
        """The options of a TOML table [quillframe]; unknown ones are errors."""
        return cls(**tomllib.loads(text).get("quillframe", {}))


def parsed(name: str, kind: str, raw: str) -> object:
    """An option from text; numbers must be above 0."""
    if kind.startswith("bool"):
        if raw.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{name}: {raw!r} is neither true nor false")
        return raw.lower() in ("true", "1")
    if kind.startswith(("int", "float")):
        value = int(raw) if kind.startswith("int") else float(raw)
        if value <= 0:
            raise ValueError(f"{name}: {raw!r} is not above 0")
        return value
    return raw


def session(name: str = "quillframe", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; a cluster's own settings stay."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
