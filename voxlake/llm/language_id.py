"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into windows of ``WINDOW`` bytes; in each window one network reads forwards and one backwards, starting from zero
states, and every byte gets label probabilities from both states. A document's probabilities are the mean of the labels'
log-probabilities over all its bytes, normalised again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, ranges, small_arrow_batches, small_batches, value_bytes

#: Bytes that the recurrent state runs over, hidden units of each direction, windows computed at once.
WINDOW, HIDDEN, WIDE = 96, 8, 2048
#: The most labelled documents of each language that training reads, and the bytes it takes from each.
TRAIN_DOCS, TRAIN_BYTES = 300, 576
EPOCHS, BATCH, RATE = 5, 128, 0.02
#: Labels whose limits are broadcast at most.
MOST_LANGS = 100_000


#: The arrays of a model.
PARTS = ("into", "state", "bias", "out", "shift")


@dataclass
class Model:
    """Weights of each direction d: ``into[d]`` (256 bytes x 3H), ``state[d]`` (3H x H), ``bias[d]`` (H); ``out`` (L x 2H), ``shift`` (L)."""

    langs: list[str]
    into: np.ndarray
    state: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.into, self.state, self.bias, self.out, self.shift]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(langs, draw(2, 256, 3 * hidden, scale=0.5), draw(2, 3 * hidden, hidden, scale=hidden**-0.5), np.zeros((2, hidden), np.float32), draw(len(langs), 2 * hidden, scale=0.3), np.zeros(len(langs), np.float32))


def _run(m: Model, d: int, x: np.ndarray, keep: list | None) -> np.ndarray:
    """States (T, H, B) of direction d over the bytes x (T, B). keep: gets what the way back needs."""
    hidden = m.bias.shape[1]
    t_all, wide = x.shape
    states = np.empty((t_all, hidden, wide), np.float32)
    table = np.ascontiguousarray(m.into[d].T)
    # A gate is a sigmoid: (1 + tanh(v / 2)) / 2. Half of the gates' weights go in, so that only tanh remains.
    table[: 2 * hidden] *= 0.5
    back = m.state[d].copy()
    back[: 2 * hidden] *= 0.5
    h = np.zeros((hidden, wide), np.float32)
    bias = m.bias[d][:, None]
    u = np.empty((3 * hidden, wide), np.float32)
    v = np.empty((3 * hidden, wide), np.float32)
    for t in range(t_all) if d == 0 else range(t_all - 1, -1, -1):
        np.take(table, x[t], axis=1, out=u, mode="clip")
        np.matmul(back, h, out=v)
        gates = u[: 2 * hidden]
        gates += v[: 2 * hidden]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        inner = v[2 * hidden :]
        inner += bias
        new = u[2 * hidden :]
        if keep is not None:
            kept_inner = inner.copy()
        inner *= gates[:hidden]
        new += inner
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((t, h, gates.copy(), kept_inner, new.copy()))
        out = states[t]
        np.subtract(h, new, out=out)
        out *= gates[hidden:]
        out += new
        h = out
    return states


def position_scores(m: Model, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Log-probabilities (T, L, B) of every position's labels."""
    forth, back = ([], []) if keep is not None else (None, None)
    hidden = m.bias.shape[1]
    a, b = _run(m, 0, x, forth), _run(m, 1, x, back)
    z = np.matmul(m.out[:, :hidden], a)
    z += np.matmul(m.out[:, hidden:], b)
    z += m.shift[:, None]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    if keep is not None:
        keep += [a, b, forth, back]
    return z


def gradients(m: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss of the labels y (B) at all positions with their weight (T, B), and its gradients by backpropagation through time."""
    hidden = m.bias.shape[1]
    kept: list = []
    z = position_scores(m, x, kept)
    a, b, forth, back = kept
    total = weight.sum()
    columns = np.arange(x.shape[1])
    loss = -(z[:, y, columns] * weight).sum() / total
    dz = np.exp(z)
    dz[:, y, columns] -= 1
    dz *= (weight / total)[:, None, :]
    grads = [np.zeros_like(p) for p in m.parts()]
    into, state, bias, out, shift = grads
    out[:, :hidden] = np.einsum("tlb,thb->lh", dz, a, optimize=True)
    out[:, hidden:] = np.einsum("tlb,thb->lh", dz, b, optimize=True)
    shift += dz.sum((0, 2))
    for d, steps in ((0, forth), (1, back)):
        from_out = np.matmul(m.out[:, d * hidden : (d + 1) * hidden].T, dz)
        later = np.zeros((hidden, x.shape[1]), np.float32)
        for t, before, gates, inner, new in reversed(steps):
            r, u = gates[:hidden], gates[hidden:]
            dh = from_out[t] + later
            dnew = dh * (1 - u) * (1 - new * new)
            du = dh * (before - new) * u * (1 - u)
            dr = dnew * inner * r * (1 - r)
            three = np.concatenate((dr, du, dnew * r))
            later = dh * u + m.state[d].T @ three
            state[d] += three @ before.T
            bias[d] += three[2 * hidden :].sum(1)
            np.add.at(into[d], x[t], np.concatenate((dr, du, dnew)).T)
    return float(loss), grads


def windows(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts: bytes (n, window) padded with 0, their lengths, and the text that each is of."""
    sizes = np.diff(ends)
    count = -(-sizes // window)
    owner = np.repeat(np.arange(len(sizes)), count)
    within = ranges(np.zeros(len(count), np.int64), count) * window
    starts = ends[:-1][owner] + within
    lengths = np.minimum(window, sizes[owner] - within)
    padded = np.concatenate((data, np.zeros(window, np.uint8)))
    x = np.lib.stride_tricks.sliding_window_view(padded, window)[starts] if len(starts) else np.zeros((0, window), np.uint8)
    return np.where(np.arange(window) < lengths[:, None], x, 0), lengths, owner


def train(texts: list[str], langs: list[str], window: int = WINDOW, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Fit by Adam on windows of the texts; every position of a window carries its text's language."""
    names = sorted(set(langs))
    m = new_model(names or ["und"], hidden, seed)
    if not names:
        return m
    data, ends = value_bytes(pa.array([t.encode() for t in texts], pa.binary()))
    x, lengths, owner = windows(data, ends, window)
    y = np.array([names.index(s) for s in langs])[owner]
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in m.parts()] for _ in range(2))
    steps, total = 0, max(1, epochs * (-(-len(x) // BATCH)))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            seen = x[some].T
            _, grads = gradients(m, seen, y[some], (np.arange(window)[:, None] < lengths[some]).astype(np.float32))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for p, g, a, b in zip(m.parts(), grads, first, second, strict=True):
                g *= min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.99**steps)) + 1e-8)
    return m


def document_scores(m: Model, data: np.ndarray, ends: np.ndarray, window: int = WINDOW, wide: int = WIDE) -> np.ndarray:
    """Probabilities (documents, L), pooled over every byte of each text; even where a text has no byte."""
    pooled = np.zeros((len(ends) - 1, len(m.langs)))
    sizes = np.diff(ends)
    total = np.concatenate(([0], np.cumsum(-(-sizes // window))))
    at = 0
    while at < len(sizes):  # texts of about ``wide`` windows at a time; a longer text goes alone, in strips
        to = max(at + 1, int(np.searchsorted(total, total[at] + wide, "right")) - 1)
        cut = ends[at : to + 1]
        for low in range(0, max(1, int(cut[-1] - cut[0])) if to == at + 1 else 1, wide * window):
            part = np.minimum(cut - cut[0], low + wide * window) if to == at + 1 else cut - cut[0]
            part = np.maximum(part, low) if to == at + 1 else part
            x, lengths, owner = windows(data[cut[0] + part[0] : cut[0] + part[-1]], part - part[0], window)
            if not len(x):
                continue
            order = np.argsort(-lengths, kind="stable")
            turned, lengths, owner = np.ascontiguousarray(x[order].T), lengths[order], owner[order]
            z = position_scores(m, turned)
            z *= (np.arange(window)[:, None] < lengths)[:, None, :]
            sums = z.sum(0)
            for k in range(len(m.langs)):
                pooled[at:to, k] += np.bincount(owner, sums[k], to - at)
        at = to
    pooled /= np.maximum(1, sizes)[:, None]
    pooled = np.exp(pooled - pooled.max(1, keepdims=True))
    return pooled / pooled.sum(1, keepdims=True)


def training_sample(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS, n_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, place, text): up to ``docs_per_lang`` labelled documents of each language, those with the smallest hash of their id; beginnings of ``n_bytes`` characters.

    The only place where ``lang`` is read. Held-out documents are never among them.
    """
    some = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    some = some.where(~held_out("id") & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("id"))
    # Only rows with small hashes can be among the first; about three times as many as wanted pass.
    counts = checkpointed(some.groupBy("lang").count().select("lang", (F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(3.0 * docs_per_lang) / F.col("count")) - 2.0**63).alias("limit")))
    limits = F.broadcast(counts) if counts.count() <= MOST_LANGS else counts
    few = some.where(F.col("text").rlike(r"\p{L}")).join(limits, "lang").where(F.col("h").cast("double") <= F.col("limit"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))
    return few.withColumn("place", place).where(F.col("place") <= docs_per_lang).select("lang", "place", F.substring("text", 1, n_bytes).alias("text"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS, n_bytes: int = TRAIN_BYTES, **columns: str) -> Model:
    """The network, trained by one task on the bounded sample; only its weights come to the driver."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((lang, place, text) for b in batches for lang, place, text in zip(*(b[c].to_pylist() for c in ("lang", "place", "text")), strict=True))
        if rows:
            m = train([t for _, _, t in rows], [k for k, _, _ in rows])
            yield pa.RecordBatch.from_arrays([pa.array([m.langs], pa.list_(pa.string())), *(pa.array([p.tobytes()], pa.binary()) for p in m.parts())], ["langs", *PARTS])

    found = training_sample(docs, docs_per_lang, n_bytes, **columns).repartition(1).mapInArrow(trained, f"langs array<string>, {', '.join(f'{p} binary' for p in PARTS)}").collect()
    if not found:
        return train([], [])
    langs = list(found[0].langs)
    return Model(langs, *(np.frombuffer(found[0][p], np.float32).reshape(empty.shape) for p, empty in zip(PARTS, new_model(langs).parts(), strict=True)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or the columns ``keep``), ``lang_pred`` and ``score`` of every whole text.

    ``und`` with score 0 where a text is null or has no letter. The model is a few kilobytes and goes along with the task.
    """
    small_arrow_batches(docs.sparkSession)
    columns = keep or [id_col]
    # A text goes to Python once, be it kept or not.
    passed = [f"c{i}" for i in range(len(columns))]
    source = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), *(() if text_col in columns else (F.col(text_col).alias("t"),)), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    text = f"c{columns.index(text_col)}" if text_col in columns else "t"
    names = pa.array([*model.langs, "und"], pa.string())

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in small_batches(b, text)):
            data, ends = value_bytes(batch[text].fill_null(""))
            scores = document_scores(model, data, ends)
            best = np.where(batch["letters"].to_numpy(zero_copy_only=False), scores.argmax(1), len(model.langs))
            value = np.where(best < len(model.langs), scores.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in passed), names.take(pa.array(best)), pa.array(value, pa.float64())], [*passed, "lang_pred", "score"])

    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in passed)
    out = source.mapInArrow(label, f"{kinds}, lang_pred string, score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "lang_pred", "score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Trained on documents whose crc32 of the id modulo 5 is not 0 and whose ``lang`` is not null, at most ``TRAIN_DOCS`` of each
    language. Without any such document every prediction is ``und``. Null texts and texts without a letter are ``und`` with
    score 0; empty tables give empty results; repeated rows are labelled alike; a null id counts as the empty string in the
    crc32; other columns are not read.
    """
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = predict(docs, model, id_col, text_col)
    return out.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), "lang_pred", "score")
