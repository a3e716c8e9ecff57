"""Quality classifier (operator 6): nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its byte trigrams, the trigrams of its shape (letters, capitals, digits and others as classes) and
classes of repetition, hashed to ``WIDTH`` columns; damped counts are weighted by inverse document frequency and projected on the
leading singular vectors of the labelled sample. Every document's cosine with every labelled vector is computed, in
blocks, and its ``NEIGHBOURS`` nearest, with all that tie with the last of them, vote with their similarity's 8th power.

The labelled sample has at most ``SAMPLE`` rows (those with the least hash of doc_id), so what each task receives has a fixed
bound: SAMPLE x RANK and WIDTH x RANK 32-bit numbers; the driver gets the sample's counts, not its texts. Every text is read
whole; nothing is shuffled.

Edge cases: a null or empty text has a zero vector and gets the sample's share of label 1; a very long text is counted whole, as a
slice of its own, at about 20 bytes of memory a byte of text; repeated rows get equal scores;
of several labels of a document the highest counts; without labelled rows every score is 0.5; an empty table gives no rows;
other columns are ignored; a null doc_id counts as the text '' in the fold test.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, crc_mod, split_words, table
from .toxicity import sample

SAMPLE, RANK, NEIGHBOURS = 4_096, 64, 25  # similarities vote with their 8th power
RAW, SHAPE, REPEAT = 4_096, 1_024, 64
WIDTH = RAW + SHAPE + REPEAT
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 200


def counts(texts: pa.Array) -> np.ndarray:
    """Texts by WIDTH: damped counts."""
    texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[: n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    out = np.zeros((n, WIDTH), np.float32)
    if len(raw) >= 3:
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
        inside = doc[:-2] == doc[2:]
        base = doc[:-2][inside].astype(np.int64)
        for x, width, at in ((raw.astype(np.uint32), RAW, 0), (_CLASS[raw], SHAPE, RAW)):
            h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            h = ((h >> np.uint32(12)) % np.uint32(width))[inside]
            out[:, at : at + width] = np.log1p(np.bincount(base * width + h, minlength=n * width).reshape(n, width))
    flat, woff = split_words(texts)
    if len(flat):
        codes = flat.dictionary_encode().indices.to_numpy()
        doc = np.repeat(np.arange(n), np.diff(woff))
        words = np.diff(woff)
        same = np.zeros(len(codes), bool)
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        adjacent = np.bincount(doc, weights=same, minlength=n) / np.maximum(words, 1)
        distinct = np.bincount(np.unique(doc * (len(codes) + 1) + codes) // (len(codes) + 1), minlength=n) / np.maximum(words, 1)
        longest = np.bincount(doc, weights=pc.utf8_length(flat).to_numpy(), minlength=n) / np.maximum(words, 1)
        size = np.sqrt((out**2).sum(1))
        for k, value in enumerate((np.minimum(adjacent * 15, 15), np.minimum(distinct * 15, 15), np.minimum(longest, 15))):
            out[np.arange(n), RAW + SHAPE + 16 * k + value.astype(int)] = np.where(words > 0, (1.0, 0.3, 0.3)[k] * size, 0)
    return out


class Model:
    def __init__(self, idf, basis, vectors, labels):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.basis
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    def score(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        share = float(self.labels.mean())
        out = np.full(len(x), share)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(x), block):
            v = self.embed(x[i : i + block])
            # Rounded, so that copies tie; all that tie with the last neighbour vote, so no order among them matters.
            cos = np.round(v @ self.vectors.T, 5)
            last = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
            w = np.where(cos >= last, np.maximum(cos, 0), 0)
            for _ in range(3):
                w *= w
            total = w.sum(1, dtype=np.float64)
            found = np.divide((w @ self.labels).astype(np.float64), total, out=np.full(len(v), share), where=total > 0)
            out[i : i + block] = np.clip(found, 0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    def vectors(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(0), 4_000_000):
                rows = counts(batch.column(0).slice(a, b - a))
                full = [np.flatnonzero(r) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.astype("<u2").tobytes() for i in full], pa.binary()), pa.array([r[i].astype("<f4").tobytes() for r, i in zip(rows, full)], pa.binary()), batch.column(1).slice(a, b - a)],
                    ["at", "value", "y"],
                )

    got = sample(docs, labels, "quality", 3, 1, SAMPLE).mapInArrow(vectors, "at binary, value binary, y int").collect()  # at most SAMPLE rows
    if not got:
        return None
    got.sort(key=lambda r: (r.at, r.value, r.y))
    x, y = np.zeros((len(got), WIDTH), np.float32), np.array([r.y for r in got], np.float32)
    for row, r in zip(x, got):
        row[np.frombuffer(r.at, "<u2")] = np.frombuffer(r.value, "<f4")
    del got
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(7)
    q = rng.standard_normal((WIDTH, min(RANK + 16, *x.shape))).astype(np.float32)
    for _ in range(3):  # randomized range finder with power steps
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ vt.T)[:, :RANK])
    v = x @ basis
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return Model(idf, basis, v, y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        made = shared.value
        for batch in batches:
            for a, b in byte_slices(batch.column(1), 4_000_000):
                for i in range(a, b, 4096):
                    j = min(b, i + 4096)
                    s = made.score(counts(batch.column(1).slice(i, j - i))) if made is not None else np.full(j - i, 0.5)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
