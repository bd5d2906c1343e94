"""Language identification by a byte convolutional network.

A text is cut into fixed windows of ``WINDOW`` UTF-8 bytes; each byte is embedded, filters of several widths run over the
window, every filter keeps its maximum, and a softmax layer gives one probability per language. A text's probabilities are the
means over its windows, weighted by their bytes, so whole texts of any length count and memory stays bounded by one batch of
windows. Training is plain numpy on the driver, on a sample of windows bounded by ``windows_per_lang`` for each of at most
``max_langs`` languages (the most frequent ones; ties go to the smaller name).

Defined results: null text, or a text without a letter, is ``und`` with score 0; with no labelled text at all every text is
``und``; ties between languages go to the smaller name; repeated rows get equal results; other columns are kept untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
PER_WIDTH = 12
EMBED = 8
PAD = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class ByteCnn:
    """langs in ascending order; embed (257, EMBED), conv (max width * EMBED, filters), dense (filters, langs)."""

    langs: tuple[str, ...]
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """windows: (n, WINDOW) symbols, PAD at the end. Returns patches (n, WINDOW, span) and every filter's response at each place."""
        span = max(WIDTHS)
        padded = np.full((len(windows), windows.shape[1] + span - 1), PAD, np.int16)
        padded[:, : windows.shape[1]] = windows
        flat = self.embed[padded].reshape(len(windows), -1)
        step = flat.strides[1]
        patches = np.lib.stride_tricks.as_strided(flat, (len(windows), windows.shape[1], span * EMBED), (flat.strides[0], step * EMBED, step))
        return patches, (patches.reshape(-1, span * EMBED) @ self.conv).reshape(len(windows), windows.shape[1], -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(np.maximum(self.responses(windows)[1].max(1) + self.bias, 0) @ self.dense + self.shift)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def as_windows(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)
    out = body[np.minimum(at, max(len(body) - 1, 0))].astype(np.int16)
    out[at >= ends[:, None]] = PAD
    return out


def fit(windows: list[bytes], labels: list[str], *, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 11) -> ByteCnn:
    """Adam on cross-entropy. Windows are cut and put in capitals at random, to teach short and shouted texts; every language weighs the same."""
    langs = tuple(sorted(set(labels)))
    rng = np.random.default_rng(seed)
    span, filters = max(WIDTHS), PER_WIDTH * len(WIDTHS)
    mask = np.zeros((span * EMBED, filters), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * EMBED, i * PER_WIDTH : (i + 1) * PER_WIDTH] = 1
    p = {
        "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32),
        "conv": rng.normal(0, 0.25, mask.shape).astype(np.float32) * mask,
        "bias": np.zeros(filters, np.float32),
        "dense": rng.normal(0, 0.2, (filters, len(langs))).astype(np.float32),
        "shift": np.zeros(len(langs), np.float32),
    }
    p["embed"][PAD] = 0
    if len(langs) < 2:
        return ByteCnn(langs, **p)
    y = np.searchsorted(np.array(langs), np.array(labels))
    weight = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs))))[y].astype(np.float32)
    x = np.full((len(windows), WINDOW), PAD, np.int16)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    upper = x.copy()
    for i, w in enumerate(windows):
        big = w.decode(errors="ignore").upper().encode()[:WINDOW]
        upper[i] = PAD
        upper[i, : len(big)] = np.frombuffer(big, np.uint8)
    size = (x != PAD).sum(1)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            xb = np.where(rng.random((len(rows), 1)) < 0.15, upper[rows], x[rows])
            keep = np.where(rng.random(len(rows)) < 0.5, size[rows], 1 + (rng.random(len(rows)) ** 2 * size[rows]).astype(int))
            xb[np.arange(WINDOW)[None, :] >= keep[:, None]] = PAD
            net = ByteCnn(langs, **p)
            patches, out = net.responses(xb)
            place = out.argmax(1)
            z = np.take_along_axis(out, place[:, None, :], 1)[:, 0, :] + p["bias"]
            a = np.maximum(z, 0)
            g = softmax(a @ p["dense"] + p["shift"])
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= (weight[rows] / len(rows))[:, None]
            d = {"dense": a.T @ g, "shift": g.sum(0)}
            gz = (g @ p["dense"].T) * (z > 0)
            d["bias"] = gz.sum(0)
            at = patches[np.arange(len(rows))[:, None], place]  # (batch, filters, span * EMBED)
            d["conv"] = np.einsum("bf,bfk->kf", gz, at, optimize=True) * mask
            ge = gz[:, :, None] * p["conv"].T[None]
            d["embed"] = np.zeros_like(p["embed"])
            padded = np.full((len(rows), WINDOW + span - 1), PAD, np.int16)
            padded[:, :WINDOW] = xb
            symbols = padded[np.arange(len(rows))[:, None, None], place[:, :, None] + np.arange(span)]
            np.add.at(d["embed"], symbols.ravel(), ge.reshape(-1, EMBED))
            d["embed"][PAD] = 0
            t += 1
            step = rate * (1 - epoch / epochs)
            for k, grad in d.items():
                m[k][0] = 0.9 * m[k][0] + 0.1 * grad
                m[k][1] = 0.999 * m[k][1] + 0.001 * grad * grad
                p[k] = (p[k] - step * (m[k][0] / (1 - 0.9**t)) / (np.sqrt(m[k][1] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return ByteCnn(langs, **p)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", windows_per_lang: int = 2500, per_text: int = 4, max_langs: int = 256, seed: int = 11) -> ByteCnn:
    """Fits on at most ``windows_per_lang`` windows of each language, up to ``per_text`` from a text at places drawn by its hash."""
    rows = docs.select(F.col(lang).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & has_letter(F.col("t")))
    counts = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_langs).collect()
    if not counts:
        return fit([], [], seed=seed)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, 1.5 * windows_per_lang / per_text / r["count"] + 20.0 / r["count"]))])
    drawn = rows.withColumn("h", F.xxhash64(F.lit(seed), "t")).where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, F.col("l")) * float(1 << 30))
    starts = F.transform(F.sequence(F.lit(0), F.lit(per_text - 1)), lambda i: F.pmod(F.xxhash64("h", i), F.greatest(F.lit(1), F.octet_length("t") - WINDOW + 1)) + 1)
    cut = (
        drawn.select("l", "h", F.col("t").cast("binary").alias("b"), F.explode(F.array_distinct(starts)).alias("at"))
        .select("l", "h", "at", F.expr(f"substring(b, cast(at as int), {WINDOW})").alias("w"))
        .withColumn("r", F.xxhash64("h", "at"))
        .groupBy("l", "w")
        .agg(F.min("r").alias("r"))
    )
    taken: dict[str, int] = {}
    windows, labels = [], []
    for r in sorted(cut.collect(), key=lambda r: (r["r"], r["l"], bytes(r["w"]))):
        if taken.get(r["l"], 0) < windows_per_lang:
            taken[r["l"]] = taken.get(r["l"], 0) + 1
            windows.append(bytes(r["w"]))
            labels.append(r["l"])
    return fit(windows, labels, seed=seed)


def predict(docs: DataFrame, model: ByteCnn, *, text: str = "text", out: str = "language", batch: int = 512) -> DataFrame:
    """docs with one more column ``out``: struct<lang string, score double>."""
    result = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def identify(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, letters in batches:
            body, at = text_bytes(texts)
            known = letters.fill_null(False).to_numpy(zero_copy_only=False) & (len(model.langs) > 0)
            size = np.where(known, np.diff(at), 0)
            count = -(-size // WINDOW)
            owner = np.repeat(np.arange(len(texts)), count)
            first = np.cumsum(count) - count
            starts = at[:-1][owner] + WINDOW * (np.arange(len(owner)) - first[owner])
            total = np.zeros((len(texts), max(1, len(model.langs))))
            for lo in range(0, len(owner), batch):
                o, s = owner[lo : lo + batch], starts[lo : lo + batch]
                ends = np.minimum(s + WINDOW, at[1:][o])
                np.add.at(total, o, model.probabilities(as_windows(body, s, ends)) * (ends - s)[:, None])
            mean = total / np.maximum(size, 1)[:, None]
            best = mean.argmax(1)
            names = np.array([*model.langs, UNKNOWN], object)
            score = np.where(known, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0).round(6)
            yield pa.StructArray.from_arrays([pa.array(names[np.where(known, best, len(model.langs))], pa.string()), pa.array(score, pa.float64())], fields=list(result))

    return docs.withColumn(out, identify(F.col(text), has_letter(F.col(text))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score. Learns from rows that aren't held out only."""
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return predict(rows.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def keep_identified(docs: DataFrame, *, min_score: float = 0.4) -> DataFrame:
    """Rows of docs whose language is known: not ``und`` and with a score of ``min_score`` or more."""
    name = "language"
    while name in docs.columns:
        name += "_"
    scored = predict(docs, train(docs), out=name)
    return scored.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= min_score)).drop(name)
