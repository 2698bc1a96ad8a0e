"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is its byte n-grams (2 to 4, over lower-cased letters with one space between words), hashed into a table of
embeddings; their mean goes through a linear layer. Embeddings and layer are trained together by stochastic gradient
descent in numpy, on whole texts and on cuts of any length of them. One class more than there are languages stands for
what is none: made-up texts of permuted letters, random letters and random scripts teach it, and it is never predicted.

Rejection is calibrated on rows kept out of the training. A temperature makes scores probabilities. The rejection
threshold depends on a text's length: kept-out rows are cut to lengths that double. The score that all but ``reject_share``
of the cuts of a length reach is its threshold; where all but ``junk_share`` of texts made up from those cuts stay below
that, it lies between the two, ``margin`` of the way up.

The training rows are a bounded sample: at most ``per_lang`` rows of each language, chosen by a hash of id and text,
repeated rows once, and of each at most ``max_chars`` code points from a place that the hash names. Prediction reads the
text alone and whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; ties between languages
fall to the first by name; repeated rows are predicted each; an empty table gives no rows. Columns that the result
adds (lang_pred, score, rejected) replace columns of those names. Without any labelled row nothing can be told: all is
``und`` with score 0, and only texts without a letter are rejected.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.llm.common import bounded_batches, drop_caches, trimmed

UND = "und"
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_ORDERS = (2, 3, 4)
#: First letters of blocks of 64 that made-up words of other scripts come from: all from Greek to the last before the surrogates.
_SCRIPTS = range(0x370, 0xD700, 64)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    dim: int = 16
    per_lang: int = 600
    max_chars: int = 20_000
    epochs: int = 6
    rate: float = 0.5
    #: Made-up texts for each text in an epoch.
    junk: float = 0.25
    reject_share: float = 0.001
    junk_share: float = 0.01
    #: Where in between the threshold lies, in log-odds: 0 at the made-up texts, 1 at the real ones.
    margin: float = 0.75
    #: Least and greatest length in code points that has a threshold of its own, and cuts of a kept-out row for each.
    lengths: tuple[int, int] = (4, 4096)
    cuts: int = 8
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """``weights`` and ``bias`` have a column for each language and a last one for what is none."""

    langs: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    #: (length in code points, threshold), by length: a text takes that of the greatest length that it reaches, else the first.
    thresholds: list[tuple[int, float]]

    def scores(self, z: np.ndarray) -> np.ndarray:
        """Probabilities of the languages, from rows of logits."""
        return _softmax(z / self.temperature)[:, :-1]

    def threshold(self, length: int) -> float:
        at = bisect_right([n for n, _ in self.thresholds], length) - 1
        return self.thresholds[max(at, 0)][1]


def grams(text: str, buckets: int) -> np.ndarray:
    """Hashed n-grams of a whole text."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" "
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = []
    for n in _ORDERS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * _FACTORS[i]
            out.append(h ^ (h >> np.uint32(15)))
    return np.concatenate(out) & np.uint32(buckets - 1)


def _mean(text: str, embeddings: np.ndarray) -> np.ndarray:
    counts = np.bincount(grams(text, len(embeddings)), minlength=len(embeddings)).astype(np.float32)
    return counts @ embeddings / counts.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def made_up(text: str, rng: np.random.Generator) -> str:
    """A text of no language, with the words' lengths of another: its letters permuted, random letters, or those of random scripts."""
    words, kind = text.lower().split() or ["x"], int(rng.integers(3))
    letters = [c for w in words for c in w]
    if kind == 0:
        drawn = [letters[i] for i in rng.permutation(len(letters))]
    elif kind == 1:
        drawn = [chr(97 + i) for i in rng.integers(0, 26, len(letters))]
    else:
        first = int(rng.choice(_SCRIPTS))
        drawn = [chr(first + i) for i in rng.integers(0, 64, len(letters))]
    it = iter(drawn)
    return " ".join("".join(next(it) for _ in w) for w in words)


def _cut(text: str, n: int, rng: np.random.Generator) -> str:
    """About n code points from a random place, from the start of a word if there is one."""
    at = int(rng.integers(0, max(len(text) - n, 0) + 1))
    space = text.find(" ", at - 1, at + 20) if at else -1
    piece = text[space + 1 if space >= 0 else at :][:n]
    return piece if any(map(str.isalpha, piece)) else text


def train(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Model:
    """Fit on rows with letters; every tenth row is kept out to fit the temperature and the thresholds."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(settings.seed)
    embeddings = rng.uniform(-0.5, 0.5, (settings.buckets, settings.dim)).astype(np.float32) / settings.dim
    weights, bias = np.zeros((settings.dim, len(langs) + 1), np.float32), np.zeros(len(langs) + 1, np.float32)
    if not langs:
        return Model([], embeddings, weights, bias, 1.0, [(0, 0.0)])
    y, none = np.searchsorted(langs, labels), len(langs)
    held = np.arange(len(texts)) % 10 == 9
    train_at, held_at = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.arange(len(texts))
    steps, done = settings.epochs * len(train_at), 0

    def log_uniform(text: str) -> int:
        return int(np.exp(rng.uniform(np.log(settings.lengths[0]), np.log(max(len(text), settings.lengths[0]) + 1))))

    def step(text: str, label: int, rate: float) -> None:
        at, n = np.unique(grams(text, settings.buckets), return_counts=True)
        share = (n / n.sum()).astype(np.float32)
        h = share @ embeddings[at]
        g = _softmax(h @ weights + bias)
        g[label] -= 1
        back = weights @ g
        weights[...] -= rate * np.outer(h, g)
        bias[...] -= rate * g
        embeddings[at] -= (rate * settings.dim) * np.outer(share, back)

    for _ in range(settings.epochs):
        for i in rng.permutation(train_at):
            rate = settings.rate * (1 - done / steps)
            step(texts[i], y[i], rate)
            step(_cut(texts[i], log_uniform(texts[i]), rng), y[i], rate)
            if rng.random() < settings.junk:
                step(made_up(_cut(texts[i], log_uniform(texts[i]), rng), rng), none, rate)
            done += 1

    def logits(of: list[str]) -> np.ndarray:
        return np.array([_mean(t, embeddings) for t in of]) @ weights + bias

    whole, true = logits([texts[i] for i in held_at]), y[held_at]
    grid = np.geomspace(0.05, 20, 121)
    wrong = 1 / (len(whole) + len(langs))  # the rule of succession: rows seen so far can't show an error rate of nothing
    aim = np.full(whole.shape, wrong / whole.shape[1]) + (1 - wrong) * np.eye(whole.shape[1])[true]
    loss = [-(aim * np.log(np.maximum(_softmax(whole / t), 1e-300))).sum(axis=1).mean() for t in grid]
    model = Model(langs, embeddings, weights, bias, float(grid[int(np.argmin(loss))]), [])
    length = settings.lengths[0]
    while length <= settings.lengths[1]:
        long = [i for i in held_at if len(texts[i]) >= length] or list(held_at)
        pieces = [_cut(texts[i], int(rng.integers(length, 2 * length)), rng) for i in long for _ in range(settings.cuts)]
        real, junk = (model.scores(logits(of)).max(axis=1) for of in (pieces, [made_up(p, rng) for p in pieces]))
        low, high = (np.log(q) - np.log1p(-q) for q in np.clip([np.quantile(junk, 1 - settings.junk_share), np.quantile(real, settings.reject_share)], 1e-9, 1 - 1e-9))
        model.thresholds.append((length, float(1 / (1 + np.exp(-min(high, low + settings.margin * (high - low) if low < high else high))))))
        length *= 2
    return model


def fit(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Train on a sample of labelled rows that is bounded by ``per_lang`` for each language."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where(F.col("label").isNotNull() & has_letter(F.col("text")))
    counts = {r["label"]: r["count"] for r in df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("string").alias("label")).count().collect()}
    if not counts:
        return train([], [], settings)
    order = F.pmod(F.xxhash64("id", "text", F.lit(settings.seed)), F.lit(1 << 40))
    start = (F.pmod(F.col("order"), F.greatest(F.length("text") - settings.max_chars, F.lit(0)) + 1) + 1).cast("int")
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("label") == lang, min(1.0, settings.per_lang / n)).otherwise(share)
    found = rows.withColumn("order", order).where(F.col("order") < share * (1 << 40))
    found = found.withColumn("text", F.substring("text", start, F.lit(settings.max_chars))).where(has_letter(F.col("text"))).dropDuplicates(["label", "order"]).collect()
    found.sort(key=lambda r: (r["order"], r["id"] is not None, r["id"], r["text"]))
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in found:
        seen[r["label"]] += 1
        if seen[r["label"]] <= settings.per_lang:
            kept.append(r)
    return train([r["text"] for r in kept], [r["label"] for r in kept], settings)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of the input, and lang_pred, score, rejected."""
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([*df.select(kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in bounded_batches(batches, 4 << 20):
            n = batch.num_rows
            texts = batch.column(at).to_pylist()
            real = [i for i, t in enumerate(texts) if t is not None and model.langs and any(map(str.isalpha, t))]
            langs, scores = [UND] * n, np.zeros(n)
            if real:
                p = model.scores(np.array([_mean(texts[i], model.embeddings) for i in real]) @ model.weights + model.bias)
                scores[real] = p.max(axis=1)
                for i, k in zip(real, p.argmax(axis=1), strict=True):
                    langs[i] = model.langs[k]
            rejected = [t is None or not any(map(str.isalpha, t)) or bool(model.langs) and s < model.threshold(len(t)) for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())], [*kept, *new])

    return df.select(kept).mapInArrow(trimmed(run), schema)
