"""Token counts by count-only Viterbi (operator 10).

An Aho-Corasick automaton enumerates the vocabulary's pieces in a text; dynamic programming carries, for each position,
the best score and the tokens on the way there, without building the pieces. The vocabulary file's pieces and scores
are read as a unigram lexicon, with that tokenizer's rules: blanks become U+2581, one is put in front; a piece reaches
a position only by a higher score than what reached it from further left; a character that is no piece scores 10 below
the lowest piece and counts one token for each of its UTF-8 bytes.

No piece has U+2581 behind another character, and none holds control characters, so the best path runs through the
borders there; a text is the sum of its segments, and each worker keeps those it has counted.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
BLANK = "▁"
MOST_BYTES = 64 << 20
#: Segments a worker keeps; when it is full, it starts anew. This bounds memory and changes no result.
KEPT = 500_000
NORMAL = 1


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


def pieces(model: bytes) -> dict[str, float]:
    """The normal pieces of a vocabulary file and their scores; control and byte pieces match no text."""
    found = {}
    for number, value in fields(model):
        if number == 1:
            piece = dict(fields(value))
            if piece.get(3, NORMAL) == NORMAL:
                found[piece[1].decode()] = struct.unpack("<f", piece.get(2, bytes(4)))[0]
    return found


class Counter:
    """Counts tokens of texts; made once a worker."""

    def __init__(self, model: bytes) -> None:
        lexicon = pieces(model)
        if any(BLANK in p.lstrip(BLANK) for p in lexicon):
            raise ValueError("a piece has a blank behind another character")
        self.automaton = ahocorasick.Automaton()
        for p, score in lexicon.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.single = {p for p in lexicon if len(p) == 1}
        self.unknown = min(lexicon.values()) - UNKNOWN_PENALTY
        used = set().union(*lexicon)
        cut = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in used)
        self.segments = re.compile(f"{BLANK}+[^{BLANK}{cut}]*|[^{BLANK}{cut}]+|[{cut}]+").findall
        self.kept: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Tokens of the best path, plus 2^32 for each that is a byte of an unknown character.

        Matches come by their end, and of one end the longest, which starts furthest left, first.
        """
        best = [0.0] + [-math.inf] * len(text)
        tokens = [0] * (len(text) + 1)
        if not self.single.issuperset(text):
            return self.with_unknown(text, best, tokens)
        for end, (size, score) in self.automaton.iter(text):
            candidate = best[end + 1 - size] + score
            if candidate > best[end + 1]:
                best[end + 1] = candidate
                tokens[end + 1] = tokens[end + 1 - size] + 1
        return tokens[-1]

    def with_unknown(self, text: str, best: list[float], tokens: list[int]) -> int:
        matches = iter(self.automaton.iter(text))
        ahead = next(matches, None)
        for end, character in enumerate(text):
            while ahead is not None and ahead[0] == end:
                size, score = ahead[1]
                candidate = best[end + 1 - size] + score
                if candidate > best[end + 1]:
                    best[end + 1], tokens[end + 1] = candidate, tokens[end + 1 - size] + 1
                ahead = next(matches, None)
            if character not in self.single and best[end] + self.unknown > best[end + 1]:
                size = len(character.encode("utf-8", "surrogatepass"))
                best[end + 1], tokens[end + 1] = best[end] + self.unknown, tokens[end] + size + (size << 32)
        return tokens[-1]

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, those that are bytes of unknown characters)."""
        if not text:
            return 0, 0
        found = self.segments((BLANK + text).replace(" ", BLANK))
        kept = self.kept
        values = list(map(kept.get, found))
        if None in values:
            if len(kept) > KEPT:
                kept.clear()
            for i, v in enumerate(values):
                if v is None:
                    s = found[i]
                    v = kept.get(s)
                    values[i] = v = self.segment(s) if v is None else v
                    if len(s) <= 64:
                        kept[s] = v
        n = sum(values)
        return n & 0xFFFFFFFF, n >> 32


@cache
def counter(model: bytes) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens) of each row of docs, by the vocabulary file at path, which the driver reads.

    Null and empty texts have no tokens. Rows that repeat are counted each. An empty table gives none. Columns beside
    doc_id and text aren't read. The file may have MOST_BYTES at most, as it is broadcast.
    """
    with open(path, "rb") as file:
        model = file.read(MOST_BYTES + 1)
    if len(model) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(shared.value).count
        n = np.array([count(t or "") for t in batch.column("text").to_pylist()], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n[:, 0]), pa.array(n[:, 1])], ["doc_id", "n_tokens", "n_byte_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(source, run, "doc_id long, n_tokens long, n_byte_tokens long")
