"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over the bytes of fixed-length windows; each is pooled by
its maximum, and a softmax over the pooled values gives the window's languages.  A text is
all of its windows, weighted by their bytes.  An embedding followed by a filter is a sum
of one table row per byte, so a window costs table look-ups and additions.

Learning takes a bounded sample: about ``per_language`` labelled texts of each language
(chosen by a hash of the key, so the choice is the same wherever the rows lie), and of each
text at most ``per_text`` windows.  Prediction reads whole texts and nothing but them.  A
letter is a character of which str.isalpha is true.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without
a label, a text or a letter teach nothing; equal texts get equal answers; with no teaching
rows every text is ``und``; very long texts are walked in bounded blocks of windows;
further columns stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
_WORDLIKE = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """Languages and weights: a table row per byte, filter and place in the filter."""

    languages: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def has_letter(text: str) -> bool:
    """Whether any character is a letter; superscripts, fractions and number letters are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def windows(text: str) -> np.ndarray:
    """All bytes of the lower-cased text in rows of WINDOW, the last one filled with 0."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, WINDOW)


def _pooled(model: Model, block: np.ndarray) -> np.ndarray:
    parts = []
    for table in model.tables:
        width = len(table)
        span = WINDOW - width + 1
        total = table[0][block[:, :span]]
        for k in range(1, width):
            total += table[k][block[:, k : k + span]]
        parts.append(total.max(axis=1))
    return np.maximum(np.concatenate(parts, axis=1) + model.bias, 0)


def probabilities(model: Model, rows: np.ndarray, block: int = 64) -> np.ndarray:
    """Softmax over languages for each window."""
    out = np.empty((len(rows), len(model.languages)), np.float32)
    for at in range(0, len(rows), block):
        z = _pooled(model, rows[at : at + block]) @ model.out + model.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[at : at + block] = z / z.sum(axis=1, keepdims=True)
    return out


def picked(text: str, per_text: int = 4) -> np.ndarray:
    """At most per_text windows of a text, evenly spread over it."""
    rows = windows(text)
    return rows[np.unique(np.linspace(0, len(rows) - 1, min(per_text, len(rows))).astype(int))] if len(rows) else rows


def fit(texts: list[np.ndarray], labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Train on the windows of labelled texts (Adam, cross entropy)."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    x, y = [], []
    for rows, label in zip(texts, labels, strict=True):
        x += list(rows)
        y += [languages.index(label)] * len(rows)
    x, y = np.array(x, np.uint8).reshape(-1, WINDOW), np.array(y, int)
    n = FILTERS * len(WIDTHS)
    weights = {"emb": rng.normal(0, 0.5, (256, EMBEDDING)), "b": np.zeros(n), "u": rng.normal(0, 0.1, (n, len(languages))), "c": np.zeros(len(languages))}
    weights |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS}
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    weights["emb"][0] = 0

    def model() -> Model:
        return Model(languages, [np.einsum("be,kef->kbf", weights["emb"], weights[f"w{w}"]).astype(np.float32) for w in WIDTHS], weights["b"], weights["u"], weights["c"])

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    share = np.bincount(y, minlength=len(languages)).clip(1)
    balance = (len(y) / (len(languages) * share)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows, want = x[order[at : at + batch]], y[order[at : at + batch]]
            now = model()
            # forward, remembering where each filter's maximum lies
            pooled, places = [], []
            for table in now.tables:
                width = len(table)
                span = WINDOW - width + 1
                total = table[0][rows[:, :span]]
                for k in range(1, width):
                    total += table[k][rows[:, k : k + span]]
                place = total.argmax(axis=1)
                places.append(place)
                pooled.append(np.take_along_axis(total, place[:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + weights["b"]
            hidden = np.maximum(raw, 0)
            z = hidden @ weights["u"] + weights["c"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = p.copy()
            dz[np.arange(len(want)), want] -= 1
            dz *= balance[want][:, None] / len(want)
            grads = {"u": hidden.T @ dz, "c": dz.sum(axis=0)}
            dh = (dz @ weights["u"].T) * (raw > 0)
            grads["b"] = dh.sum(axis=0)
            grads["emb"] = np.zeros_like(weights["emb"])
            for i, width in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                dw = np.zeros_like(weights[f"w{width}"])
                for k in range(width):
                    byte = np.take_along_axis(rows, places[i] + k, axis=1)  # (batch, filters)
                    dw[k] = np.einsum("bfe,bf->ef", weights["emb"][byte], d)
                    np.add.at(grads["emb"], byte, d[:, :, None] * weights[f"w{width}"][k].T[None])
                grads[f"w{width}"] = dw
            grads["emb"][0] = 0
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model()


def sample(docs: DataFrame, per_language: int = 300, per_text: int = 4, key: str = "doc_id", text: str = "text", label: str = "lang") -> list[tuple[np.ndarray, str]]:
    """About per_language (windows of the text, label) of each label, the same ones on every run.

    One narrow pass counts the labels; a hash of the key then keeps each row with the
    fraction that makes per_language of them.  Windows are cut where the texts are, so the
    driver gets per_text * WINDOW bytes of a text, however long it is.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1 << 30, (per_language << 30) // n))])

    @F.pandas_udf("binary")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([picked(t, per_text).tobytes() if has_letter(t) else b"" for t in texts], dtype=object)

    rows = known.where(draw < limit[F.col(label)]).select(label, F.col(key).cast("string"), cut(F.col(text))).collect()
    return [(np.frombuffer(data, np.uint8).reshape(-1, WINDOW), lang) for lang, _, data in sorted(rows, key=lambda r: (r[0], str(r[1]), r[2])) if data]


def train(docs: DataFrame, per_language: int = 300, **names: str) -> Model | None:
    """A model from the labelled rows of docs; None if there are none."""
    rows = sample(docs, per_language, **names)
    return fit([w for w, _ in rows], [label for _, label in rows]) if rows else None


def answer(model: Model | None, text: str | None) -> tuple[str, float]:
    """The language of one whole text and its mean probability."""
    if text is None or model is None or not has_letter(text):
        return UNKNOWN, 0.0
    rows = windows(text)
    p = probabilities(model, rows)
    mean = np.average(p, axis=0, weights=(rows != 0).sum(axis=1) + 1e-9)
    best = int(mean.argmax())
    return model.languages[best], float(min(1.0, mean[best]))


def answers(model: Model | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """answer() for many texts, with the windows of short ones in common blocks."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    todo: list[int] = []
    rows: list[np.ndarray] = []

    def settle() -> None:
        if todo:
            all_rows = np.concatenate(rows)
            weight = (all_rows != 0).sum(axis=1) + 1e-9
            p = probabilities(model, all_rows) * weight[:, None]
            begins = np.cumsum([0, *(len(r) for r in rows)])[:-1]
            mean = np.add.reduceat(p, begins) / np.add.reduceat(weight, begins)[:, None]
            for k, m in zip(todo, mean, strict=True):
                out[k] = (model.languages[int(m.argmax())], float(min(1.0, m.max())))
            todo.clear()
            rows.clear()

    held = 0
    for k, text in enumerate(texts):
        if text is None or model is None or not has_letter(text):
            continue
        todo.append(k)
        rows.append(windows(text))
        held += len(rows[-1])
        if held > 8192:
            settle()
            held = 0
    settle()
    return out


def predicted(model: Model | None, text: Column) -> Column:
    """A struct (lang_pred, score) for each text."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(answers(model, [None if t is None or t != t else t for t in texts]), columns=["lang_pred", "score"])

    return predict(text)


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the key as text falls into the part that is kept from learning."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part
