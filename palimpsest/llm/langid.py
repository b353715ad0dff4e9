"""Language identification with a byte-level convolutional network.

A text becomes UTF-8 bytes, cut into fixed windows that overlap by the widest filter less one, so that every
byte n-gram of the whole text falls into a window. Byte embeddings pass through filters of several widths, a
rectifier and a maximum over the window; a softmax layer gives a distribution for each window, and a text's
distribution is the mean over its windows, weighted by their bytes. The network is trained here, in numpy, on
a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import id_text_crc, small_arrow_batches, spread

#: Language given to a text that is null or has no letter.
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Shape and training of the network.

    docs_per_lang: bound of the training sample, documents for each label value (expected number).
    windows_per_doc, window_chars: what is cut from each sampled document, at places spread over it.
    """

    window: int = 160
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 12
    embedding: int = 8
    docs_per_lang: int = 800
    windows_per_doc: int = 4
    epochs: int = 6
    rate: float = 0.01
    seed: int = 17


class ByteConvNet:
    """Weights and the forward pass. Byte 256 is padding, whose embedding stays zero."""

    def __init__(self, langs: list[str], settings: Settings):
        self.langs, self.s = langs, settings
        rng = np.random.default_rng(settings.seed)
        self.wide = max(settings.widths)
        total = settings.filters * len(settings.widths)
        self.embed = rng.normal(0, 0.5, (257, settings.embedding)).astype(np.float32)
        self.embed[256] = 0
        self.filters = rng.normal(0, 0.2, (self.wide * settings.embedding, total)).astype(np.float32)
        self.mask = np.zeros_like(self.filters)
        for i, width in enumerate(settings.widths):
            self.mask[: width * settings.embedding, i * settings.filters : (i + 1) * settings.filters] = 1
        self.filters *= self.mask
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.1, (total, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _unfold(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes below each position, padded at the right, and their embeddings side by side."""
        padded = np.pad(windows, ((0, 0), (0, self.wide - 1)), constant_values=256)
        grams = sliding_window_view(padded, self.wide, axis=1)
        return grams, self.embed[grams].reshape(-1, self.wide * self.s.embedding)

    def forward(self, windows: np.ndarray):
        grams, patches = self._unfold(windows)
        conv = (patches @ self.filters).reshape(len(windows), -1, self.filters.shape[1])
        best = conv.argmax(axis=1)
        peak = np.take_along_axis(conv, best[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(peak, 0)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        return grams, best, peak, hidden, prob / prob.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray, block: int = 512) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), block):
            _, patches = self._unfold(windows[i : i + block])
            conv = (patches @ self.filters).reshape(-1, windows.shape[1], self.filters.shape[1])
            logits = np.maximum(conv.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            parts.append(prob / prob.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def fit(self, windows: np.ndarray, target: np.ndarray, batch: int = 64) -> None:
        """Adam on the cross-entropy, classes weighted to be equally heavy."""
        names = ("embed", "filters", "bias", "out", "out_bias")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        heavy = len(target) / (len(self.langs) * np.maximum(np.bincount(target, minlength=len(self.langs)), 1))
        rng, step = np.random.default_rng(self.s.seed + 1), 0
        for _ in range(self.s.epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                step += 1
                for n, g in self._gradients(windows[rows], target[rows], heavy).items():
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.001 * (g * g - second[n])
                    move = (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-7)
                    getattr(self, n)[...] -= self.s.rate * move
                self.embed[256] = 0

    def _gradients(self, windows: np.ndarray, target: np.ndarray, heavy: np.ndarray) -> dict[str, np.ndarray]:
        grams, best, peak, hidden, prob = self.forward(windows)
        n, total = len(windows), self.filters.shape[1]
        delta = prob.copy()
        delta[np.arange(n), target] -= 1
        delta *= (heavy[target] / n)[:, None].astype(np.float32)
        back = (delta @ self.out.T) * (peak > 0)
        chosen = np.take_along_axis(grams, best[:, :, None], axis=1)  # the bytes under each filter's maximum
        patch = self.embed[chosen].reshape(n, total, -1)
        toward = (back[:, :, None] * (self.filters * self.mask).T[None]).reshape(n, total, self.wide, -1)
        embed = np.zeros_like(self.embed)
        np.add.at(embed, chosen, toward)
        return {"embed": embed, "filters": np.einsum("nf,nfp->pf", back, patch) * self.mask, "bias": back.sum(0), "out": hidden.T @ delta, "out_bias": delta.sum(0)}


def cut(data: bytes, window: int, overlap: int) -> np.ndarray:
    """Windows over all bytes, the last one padded with 256; one window of padding for no bytes."""
    step = window - overlap
    count = max(1, -(-max(len(data) - overlap, 1) // step))
    flat = np.full(count * step + overlap, 256, np.int16)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return sliding_window_view(flat, window)[::step]


def fit(labelled: DataFrame, settings: Settings = Settings()) -> ByteConvNet | None:
    """Train on rows (doc_id, text, lang). Nulls in either are left out; None if no label is left.

    The sample is by a hash of the text, about ``docs_per_lang`` different texts for each value of lang, however often they or
    their ids are repeated; the windows are cut by Spark, so that only they reach the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.xxhash64("text").alias("key"), "text", "lang")
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, settings.docs_per_lang / counts[lang]))) for lang in langs])
    last = F.greatest(F.length("text") - F.lit(settings.window), F.lit(0))
    cuts = [F.substring(F.col("text"), (1 + F.floor(spread(F.col("key"), 100 + i) * (last + 1))).cast("int"), F.lit(settings.window)) for i in range(settings.windows_per_doc)]
    picked = rows.where(spread(F.col("key"), settings.seed) < share)
    sample = picked.select("key", "lang", F.array_distinct(F.array(*cuts)).alias("cuts")).distinct().collect()
    sample.sort(key=lambda r: (r["key"], r["lang"], r["cuts"]))
    windows = [(cut(c.encode()[: settings.window], settings.window, max(settings.widths) - 1)[0], langs.index(r["lang"])) for r in sample for c in r["cuts"] if c]
    net = ByteConvNet(langs, settings)
    if windows:
        net.fit(np.stack([w for w, _ in windows]), np.array([y for _, y in windows]))
    return net


def predict_texts(net: ByteConvNet, texts: list[str | None], group: int = 4096) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text; a long text is worked off in groups of windows."""
    size, overlap = net.s.window, net.wide - 1
    sums, weight = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            stack = np.concatenate([w for _, w in held])
            owner = np.repeat([i for i, _ in held], [len(w) for _, w in held])
            heavy = np.maximum((stack < 256).sum(axis=1), 1)
            np.add.at(sums, owner, net.predict(stack) * heavy[:, None])
            np.add.at(weight, owner, heavy)
            held.clear()

    filled = 0
    for i, text in enumerate(texts):
        whole = cut((text or "").encode("utf-8", "surrogatepass"), size, overlap)
        for at in range(0, len(whole), group):
            held.append((i, whole[at : at + group]))
            filled += len(held[-1][1])
            if filled >= group:
                flush()
                filled = 0
    flush()
    prob = sums / np.maximum(weight, 1)[:, None]
    best = prob.argmax(axis=1)
    return [net.langs[b] for b in best], np.clip(prob[np.arange(len(texts)), best], 0, 1)


def identify(spark: SparkSession, docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """doc_id, held-out flag aside: language and score of every whole text of ``docs``.

    Columns doc_id, lang_pred, score; a row of docs gives a row, repeated rows too, and columns other than
    doc_id and text are not read. A text that is null or has no letter is ``und`` with score 1; so is every
    text, with score 0, if there was no labelled text to learn from.
    """
    small_arrow_batches(spark)
    plain = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang = np.full(len(pdf), UNDETERMINED, object)
            score = np.where(pdf["letters"], 0.0, 1.0)
            has = np.flatnonzero(pdf["letters"].to_numpy(bool))
            if net is not None and len(has):
                lang[has], score[has] = predict_texts(net, list(pdf["text"].iloc[has]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score})

    return plain.mapInPandas(run, schema)


def held_out_language(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on rows whose crc32(doc_id as text) mod 4 is not 2, predict all: doc_id, held_out, lang_pred, score."""
    out = F.coalesce(id_text_crc(F.col("doc_id"), 4) == 2, F.lit(False))
    net = fit(docs.where(~out).select("doc_id", "text", "lang"), settings)
    return identify(spark, docs, net).select("doc_id", out.alias("held_out"), "lang_pred", "score")
