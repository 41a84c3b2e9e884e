"""Quality classifier by attention-based multiple-instance learning (operator 4).

A document is a bag of passages of PASSAGE bytes. A passage comes in as the hashed counts of its runs of one to three
bytes, its length and how much of it is no repetition, and is encoded by a learned layer over them; gated attention weighs the passages; the weighted mean is scored. Only
documents have labels: encoder, attention and score are trained together through the bag, in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, small_batches, texts
from .training import Adam, drawn

PASSAGE, RUNS, HASHED, GRAM = 1024, 3, 4096, 8
INPUTS = HASHED + 2
ENCODED, ATTENTION = 16, 8
#: Whole documents of each label that the model learns from, at most, and bytes of all of them together.
PER_LABEL, LEARNED_BYTES = 2000, 16 << 20
PASSAGES_EACH = 4
#: A step takes BATCH documents, or fewer if they have more passages than STEP_PASSAGES by the mean, but one of each label.
STEPS, BATCH, STEP_PASSAGES, RATE = 300, 64, 1024, 0.02
THRESHOLD = 0.3
SIDE_BY_SIDE = 256


def passages(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passages side by side [passage, byte], length of each, its document). An empty document is one empty passage."""
    count = np.array([max(1, -(-len(t) // PASSAGE)) for t in documents], np.int64)
    owner = np.repeat(np.arange(len(documents)), count)
    data = np.zeros((len(owner), PASSAGE), np.uint8)
    flat, at = data.reshape(-1), 0
    for t, n in zip(documents, count.tolist()):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * PASSAGE
    whole = np.repeat(np.array([len(t) for t in documents], np.int64), count)
    first = np.repeat(np.cumsum(count) - count, count)
    return data, np.clip(whole - (np.arange(len(owner)) - first) * PASSAGE, 0, PASSAGE), owner


def inputs(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """HASHED logarithms of counts of runs, of length 1 in all, those of an empty passage 0, bytes with inputs of their own;
    then the logarithm of the length and the share of different runs of GRAM bytes."""
    n, base = len(data), np.arange(len(data), dtype=np.int64)[:, None] * (HASHED + 1)
    code, found = data.astype(np.uint32), np.zeros(n * (HASHED + 1))
    for k in range(1, GRAM + 1):
        if k > 1:
            code = code[:, :-1] * np.uint32(0x01000193) + data[:, k - 1 :] + np.uint32(k)
        inside = np.arange(code.shape[1]) < (length - k + 1)[:, None]
        if k <= RUNS:
            place = code if k == 1 else 256 + (code * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(HASHED - 256)
            found += np.bincount((np.where(inside, place, HASHED) + base).ravel(), minlength=len(found))
    out = np.empty((n, INPUTS), np.float32)
    out[:, :HASHED] = np.log1p(found.reshape(n, -1)[:, :HASHED])
    out[:, :HASHED] /= np.maximum(np.linalg.norm(out[:, :HASHED], axis=1, keepdims=True), 1e-9)
    out[:, HASHED] = np.log1p(length) / 7
    code[~inside] = 0xFFFFFFFF  # as one more run, at the end
    code.sort(axis=1)
    different = (np.diff(code, axis=1) != 0).sum(axis=1) + inside.all(axis=1)
    out[:, HASHED + 1] = different / np.maximum(length - GRAM + 1, 1)
    return out


class Bags:
    def __init__(self, seed: int = 3, size: int = INPUTS) -> None:
        random = np.random.default_rng(seed)
        self.w = {
            "encode": random.normal(0, 1, (size, ENCODED)).astype(np.float32),
            "bias": np.zeros(ENCODED),
            "value": random.normal(0, ENCODED**-0.5, (ENCODED, ATTENTION)),
            "gate": random.normal(0, ENCODED**-0.5, (ENCODED, ATTENTION)),
            "weight": random.normal(0, ATTENTION**-0.5, ATTENTION),
            "score": random.normal(0, ENCODED**-0.5, ENCODED),
            "level": np.zeros(1),
        }

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w["encode"] + self.w["bias"])

    def forward(self, h: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w, r = self.w, {"h": h}
        r["v"], r["u"] = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = np.exp(np.clip((r["v"] * r["u"]) @ w["weight"], -30, 30))
        r["a"] = e / np.bincount(owner, e, bags)[owner]
        r["z"] = np.stack([np.bincount(owner, r["a"] * c, bags) for c in h.T], axis=1)
        r["p"] = 1 / (1 + np.exp(-np.clip(r["z"] @ w["score"] + w["level"], -30, 30)))
        return r

    def gradients(self, x: np.ndarray, owner: np.ndarray, label: np.ndarray, times: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean over bags, each counted so many times. Passages are widened SIDE_BY_SIDE at once."""
        times = np.ones(len(label)) if times is None else times
        own = [slice(i, i + SIDE_BY_SIDE) for i in range(0, len(x), SIDE_BY_SIDE)]
        w, r = self.w, self.forward(np.concatenate([self.encoded(x[s]) for s in own]), owner, len(label))
        dp = (r["p"] - label) * times / times.sum()
        dz = dp[:, None] * w["score"]
        da = (dz[owner] * r["h"]).sum(axis=1)
        ds = r["a"] * (da - np.bincount(owner, r["a"] * da, len(label))[owner])
        dv = ds[:, None] * w["weight"] * r["u"] * (1 - r["v"] ** 2)
        du = ds[:, None] * w["weight"] * r["v"] * r["u"] * (1 - r["u"])
        dh = (r["a"][:, None] * dz[owner] + dv @ w["value"].T + du @ w["gate"].T) * (1 - r["h"] ** 2)
        return {
            "encode": sum(x[s].T @ dh[s] for s in own),
            "bias": dh.sum(axis=0),
            "value": r["h"].T @ dv,
            "gate": r["h"].T @ du,
            "weight": (r["v"] * r["u"]).T @ ds,
            "score": r["z"].T @ dp,
            "level": dp.sum(keepdims=True),
        }

    def scores(self, documents: list[bytes]) -> np.ndarray:
        data, length, owner = passages(documents)
        at = range(0, len(data), SIDE_BY_SIDE)
        h = np.concatenate([self.encoded(inputs(data[i : i + SIDE_BY_SIDE], length[i : i + SIDE_BY_SIDE])) for i in at])
        return self.forward(h, owner, len(documents))["p"]


def spread(text: bytes) -> list[bytes]:
    """PASSAGES_EACH passages of a text at most, to look at: the first, the last, and others as far apart as can be. The
    model learns from all passages, not from these."""
    count = max(1, -(-len(text) // PASSAGE))
    return [text[i * PASSAGE : (i + 1) * PASSAGE] for i in np.unique(np.linspace(0, count - 1, min(count, PASSAGES_EACH)).astype(int))]


def fitting(sizes: list[int], most: int) -> int:
    """How many texts of these sizes, from the first on, are at most so many bytes together; the first is always taken."""
    return max(min(1, len(sizes)), int(np.searchsorted(np.cumsum(sizes), most, side="right")))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most: int = LEARNED_BYTES) -> Bags | None:
    """From a sample of labelled rows whose id isn't held out, of which all passages count; None if there are none.

    A document that has several labels is learned with each. Some times PER_LABEL ids are drawn first, by their hash, so
    that what meets the documents is small; of an id with many rows any can be drawn. Rows are drawn by hash and size
    alone; only the texts of those that are taken come to the driver, fewer where texts are long: see fitting().
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(crc_mod("id", 5) != 0).select("label", F.xxhash64("id").alias("h"), F.col("id").alias("value"))
    ids = [(r.value, r.label) for r in drawn(known, 2 * per_label)]  # bounded: two labels
    if not ids:
        return None
    sample = F.broadcast(docs.sparkSession.createDataFrame(ids, f"id {labels.schema['doc_id'].dataType.simpleString()}, label int"))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "id")
    rows = rows.select("label", F.xxhash64(F.col("id").cast("string"), "text").alias("h"), "text")
    sizes = drawn(rows.select("label", "h", F.array(F.octet_length("text")).alias("value")), per_label)
    if not sizes:
        return None
    of = {k: [r for r in sizes if r.label == k] for k in (0, 1)}
    share = most // sum(1 for own in of.values() if own)
    taken = [(r.label, r.h) for own in of.values() for r in own[: fitting([r.value[0] for r in own], share)]]
    taken = F.broadcast(docs.sparkSession.createDataFrame(taken, "label int, h long"))
    found = rows.join(taken, ["label", "h"]).groupBy("label", "h").agg(F.first("text").alias("text")).orderBy("label", "h").collect()
    data, length, owner = passages([r.text.encode() for r in found])
    start = np.searchsorted(owner, np.arange(len(found) + 1))
    label = np.array([r.label for r in found], float)
    own = range(0, len(data), SIDE_BY_SIDE)
    x = np.concatenate([inputs(data[i : i + SIDE_BY_SIDE], length[i : i + SIDE_BY_SIDE]).astype(np.float16) for i in own])  # 8 times the texts and 33 MB for ends of texts, at most
    model = Bags()
    by_label = [np.nonzero(label == k)[0] for k in (0, 1)]
    by_label = [x for x in by_label if len(x)]
    each = max(1, min(BATCH, int(STEP_PASSAGES / np.diff(start).mean())) // len(by_label))
    random, adam = np.random.default_rng(5), Adam(model.w, RATE)
    for step in range(STEPS):
        bags, times = np.unique(np.concatenate([random.choice(x, each) for x in by_label]), return_counts=True)
        at = np.concatenate([np.arange(start[b], start[b + 1]) for b in bags])
        adam.step(model.gradients(x[at], np.repeat(np.arange(len(bags)), np.diff(start)[bags]), label[bags], times), 0.5 * (1 + np.cos(np.pi * step / STEPS)))
    return model


def judge(model: Bags | None, column: pa.Array) -> np.ndarray:
    documents = texts(column)
    return model.scores(documents) if model else np.full(len(documents), 0.5)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    Only text decides. Null and empty texts are one empty passage and get its score. Rows of which crc32(doc_id as text)
    mod 5 is 0 are held out. Without labels to learn from every score is 0.5. Rows that repeat are scored each; an empty
    table gives none; other columns aren't read. The model learns from all passages of PER_LABEL rows of a label at most, drawn by the hash of id and text, as often
    from either label; where these are more than LEARNED_BYTES, from fewer rows. All passages are scored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = judge(shared.value, batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod("doc_id", 5) == 0).alias("held_out"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are predicted to be of quality."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return map_arrow(docs, lambda batch: batch.filter(pa.array(judge(shared.value, batch.column("text")) >= THRESHOLD)), docs.schema)
