"""Language identification by a bidirectional gated recurrent network over bytes (operator 1).

The network is trained in numpy by backpropagation through time. It labels every position of a text; a document's
probabilities are the mean of its positions'. Texts run through it in segments of SEGMENT bytes that start from the
zero state, all of a batch side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, small_batches, texts
from .training import Adam, drawn

HIDDEN, SEGMENT = 8, 128
#: Documents of each language that the network learns from, at most, and characters of each: a piece from anywhere in it.
PER_LANGUAGE, PIECE = 400, 1024
STEPS, BATCH, RATE, WINDOW = 300, 256, 0.02, 64
SIDE_BY_SIDE = 1024
UNDETERMINED = "und"


class Network:
    """A gated unit in each direction: g = byte's row + U h; z = (1 + s(g1)) / 2, c = s(g2); h moves towards c by z.

    s(g) = g / (1 + |g|), which numpy computes much faster than tanh.
    """

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        self.languages, h, k = languages, HIDDEN, len(languages)
        self.familiar = np.zeros(256, bool)  # bytes of the texts learned from
        random = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {"bias": np.zeros(k, np.float32)}
        for d in "fb":
            self.w[f"rows_{d}"] = random.normal(0, 0.5, (2 * h, 256)).astype(np.float32)
            self.w[f"rows_{d}"][:h] -= 1
            self.w[f"back_{d}"] = random.normal(0, h**-0.5, (2 * h, h)).astype(np.float32)
            self.w[f"out_{d}"] = random.normal(0, h**-0.5, (k, h)).astype(np.float32)
        self.still()

    def still(self) -> None:
        """Byte 0, which fills segments up, leaves the state as it is."""
        for d in "fb":
            self.w[f"rows_{d}"][:HIDDEN, 0] = -1e6

    def states(self, x: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States [time, HIDDEN, row] of direction d after each byte of x [time, row]; what the gradient needs."""
        h, (steps, n) = HIDDEN, x.shape
        rows, back = self.w[f"rows_{d}"], self.w[f"back_{d}"]
        out, state, kept = np.empty((steps, h, n), np.float32), np.zeros((h, n), np.float32), []
        gates, size, change = np.empty((2 * h, n), np.float32), np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(rows, x[t], axis=1, out=gates, mode="clip")
            gates += np.matmul(back, state, out=size)
            np.abs(gates, out=size)
            size += 1
            gates /= size
            z, c = gates[:h], gates[h:]
            z += 1
            z *= 0.5
            if keep:
                kept.append((t, state.copy(), z.copy(), c.copy()))
            np.subtract(c, state, out=change)
            change *= z
            state = np.add(state, change, out=out[t])
        return out, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each position: [time, language, row]. States lie within 1, so that exp() can't overflow."""
        p = np.matmul(self.w["out_f"], self.states(x, "f")[0])
        p += np.matmul(self.w["out_b"], self.states(x, "b")[0])
        p += self.w["bias"][:, None]
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over positions; x is [time, row], label has each row's language."""
        h, run = HIDDEN, {d: self.states(x, d, keep=True) for d in "fb"}
        p = np.exp(np.matmul(self.w["out_f"], run["f"][0]) + np.matmul(self.w["out_b"], run["b"][0]) + self.w["bias"][:, None])
        p /= p.sum(axis=1, keepdims=True)
        p[:, label, np.arange(len(label))] -= 1
        p *= (x > 0)[:, None, :] / np.float32(max(1, int((x > 0).sum())))
        g = {"bias": p.sum(axis=(0, 2))}
        for d, (out, kept) in run.items():
            g[f"out_{d}"] = np.matmul(p, out.transpose(0, 2, 1)).sum(axis=0)
            into, rows, back = np.matmul(self.w[f"out_{d}"].T, p), np.zeros((256, 2 * h), np.float32), np.zeros((2 * h, h), np.float32)
            from_later = np.zeros((h, x.shape[1]), np.float32)
            for t, before, z, c in reversed(kept):
                own = into[t] + from_later
                gates = np.concatenate([own * (c - before) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2, own * z * (1 - np.abs(c)) ** 2])
                np.add.at(rows, x[t], gates.T)
                back += gates @ before.T
                from_later = own * (1 - z) + self.w[f"back_{d}"].T @ gates
            g[f"rows_{d}"], g[f"back_{d}"] = rows.T, back
        return g

    def pooled(self, documents: list[bytes]) -> np.ndarray:
        """The mean probabilities of each document's positions; an empty document has none, all zero."""
        count = np.array([-(-len(t) // SEGMENT) for t in documents])
        data = np.zeros((int(count.sum()), SEGMENT), np.uint8)
        flat, at = data.reshape(-1), 0
        for t, n in zip(documents, count.tolist()):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += n * SEGMENT
        sums = np.zeros((len(data), len(self.languages)))
        for at in range(0, len(data), SIDE_BY_SIDE):
            x = np.ascontiguousarray(data[at : at + SIDE_BY_SIDE].T)
            p = self.probabilities(x)
            p *= (x > 0)[:, None, :]
            sums[at : at + SIDE_BY_SIDE] = p.sum(axis=0).T
        owner = np.repeat(np.arange(len(documents)), count)
        length = np.maximum([len(t) for t in documents], 1)
        return np.stack([np.bincount(owner, s, len(documents)) for s in sums.T], axis=1) / length[:, None]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """From a sample of rows whose id isn't held out and whose lang isn't null; None if there is none."""
    text = F.col("text").cast("string")
    rows = docs.where((crc_mod("doc_id", 5) != 0) & (F.length(text) > 0))
    h = F.xxhash64(F.col("doc_id").cast("string"), text)
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - PIECE + 1, F.lit(1))) + 1
    rows = rows.select(F.col("lang").cast("string").alias("label"), h.alias("h"), text.alias("text"))
    rows = rows.select("label", "h", F.substring("text", start, F.lit(PIECE)).alias("value"))
    sample = [(r.value.encode().replace(b"\0", b" "), r.label) for r in drawn(rows, per_language)]
    languages = sorted({label for _, label in sample})
    if not languages:
        return None
    net, random = Network(languages), np.random.default_rng(11)
    for text, _ in sample:
        net.familiar[np.unique(np.frombuffer(text, np.uint8))] = True
    by_language = [[t for t, label in sample if label == x] for x in languages]
    adam = Adam(net.w, RATE)
    for step in range(STEPS):
        x, label = np.zeros((BATCH, WINDOW), np.uint8), random.integers(len(languages), size=BATCH)
        for i, k in enumerate(label):
            text = by_language[k][random.integers(len(by_language[k]))]
            start = random.integers(max(1, len(text) - WINDOW + 1))
            part = text[start : start + WINDOW]
            x[i, : len(part)] = np.frombuffer(part, np.uint8)
        adam.step(net.gradients(np.ascontiguousarray(x.T), label), 0.5 * (1 + np.cos(np.pi * step / STEPS)))
        net.still()
    return net


def judge(net: Network | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    documents = texts(column)
    p = net.pooled([t.replace(b"\0", b" ") for t in documents]) if net else np.zeros((len(documents), 1))
    best = p.argmax(axis=1)
    lettered = [net is not None and any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in documents]
    return [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], np.where(lettered, p.max(axis=1), 0.0).clip(0, 1)


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs.

    Only text decides; lang, source and doc_id don't. A text that is null or has no letter is `und` with score 0, and so
    is every text if no row can be learned from. Rows of which crc32(doc_id as text) mod 5 is 0 are held out. Rows that
    repeat are judged each; an empty table gives none; other columns aren't read. The network knows every language there is
    to learn; it learns from PIECE characters of each of PER_LANGUAGE rows of a language at most, or of MOST_ROWS over the
    number of languages if these are fewer, drawn by the hash of id and text.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        predicted, score = judge(shared.value, batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(predicted), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod("doc_id", 5) == 0).alias("held_out"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


#: A document is kept in a pipeline if its score, times the share of its bytes that the learned texts have, lies this
#: part of the way from chance to certainty; for a text of n bytes the bar is n / (n + SHORT) of that, as few bytes tell little.
SURE, SHORT = 0.3, 200


def bar(languages: int, length: np.ndarray) -> np.ndarray:
    return 1 / languages + (1 - 1 / languages) * SURE * length / (length + SHORT)


def identified(net: Network | None, column: pa.Array) -> np.ndarray:
    """Whether each text's language can be told: it is learned, and more likely by far than chance has it."""
    documents = texts(column)
    if net is None:
        return np.zeros(len(documents), bool)
    predicted, score = judge(net, column)
    share = np.array([net.familiar[np.frombuffer(t, np.uint8)].mean() if t else 0.0 for t in documents])
    length = np.array([len(t) for t in documents], float)
    return (np.array(predicted, object) != UNDETERMINED) & (score * share >= bar(max(2, len(net.languages)), length))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which the language can be told; where one language alone is learned, chance is a half."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(identified(shared.value, batch.column("text"))))

    return map_arrow(docs, run, docs.schema)
