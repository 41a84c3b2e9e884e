"""Language-model scoring with a probabilistic suffix tree over words (operator 7).

Symbols are the tokens: lower-cased words and an end for each text. Contexts are the one to DEPTH tokens before a symbol
(a mark stands before a text's first). A context that occurs MIN_COUNT times is a candidate, so the tree grows with the
corpus; it is retained if its next-symbol distribution diverges from that of its longest proper suffix by MIN_GAIN, in
nats over all its occurrences. The distribution of a context is smoothed towards that of its suffix (Witten and Bell),
down to the unigram base. A symbol is scored by the longest retained context that stands before it, else by the base.

The tree is never in one place. Texts are cut into stretches of bounded size, and grams of one token, then of two, and so
on to DEPTH + 1, are counted in a round each: every stretch asks for the counts of its distinct grams and gets them back.
Grams are hashed and dealt to slices, which add up what the stretches have. A gram that no other stretch has is known to
its own stretch whole, and so are all that contain it: only grams whose first and last tokens less one are both shared are
asked for in the next round. A last round adds up the divergences of shared contexts, to which each distinct gram
contributes in one stretch, and the numbers of different next symbols. Then each stretch scores its texts. A context is
shared if any other stretch meets it, in training or not, so that what one knows is known wherever it is asked for, and
scores don't depend on how the table is cut. A gram's rows in a slice are at most one for each stretch, however frequent it
is, so no hot word or context gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from .common import blocks, bucketed, crc_mod, discard, settle, small_batches, stored, texts, unbucket

DEPTH, MIN_COUNT, MIN_GAIN = 2, 2, 2.0
#: Weight of the suffix's distribution, for each different next symbol of a context (Witten and Bell's choice is 1).
PRIOR = 1.0
#: Divergences are added up as whole numbers of this part of a nat, so that sums don't depend on their order.
STEPS = 16
#: Stretches have about so many bytes of text, or one longer text; slices are asked for about so many tokens' grams.
BYTES_AT_ONCE, TOKENS_A_SLICE = 10 << 20, 2 << 20
#: Keys of grams of two tokens or more have so many bits above the logarithm of the number of tokens: a gram shares its
#: key with another one with a probability of about 2^-16. Keys of single tokens have all 64 bits.
SPARE_BITS, LEAST_BITS = 16, 44
#: Keys of the end and of what stands before a text; no word has a line feed or is empty.
END, BEFORE = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b"")
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of 0 or more, side by side, as planes of bytes, each compressed by itself: high ones take hardly any room."""
    squeeze, head, out = zstandard.ZstdCompressor(level=1).compress, [], []
    for column in columns:
        planes = np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        used = 8
        while used and not planes[used - 1].any():
            used -= 1
        own = [squeeze(x.tobytes()) for x in planes[:used]]
        head += [len(column), used, *map(len, own)]
        out += own
    return b"".join([np.array([len(head), *head], "<u4").tobytes(), *out])


def unpack(data: bytes) -> list[np.ndarray]:
    expand, columns = zstandard.ZstdDecompressor().decompress, []
    (size,) = np.frombuffer(data, "<u4", 1).tolist()
    head, at = iter(np.frombuffer(data, "<u4", size, 4).tolist()), 4 + 4 * size
    for n in head:
        used = next(head)
        planes = np.zeros((n, 8), np.uint8)
        for plane in range(used):
            length = next(head)
            planes[:, plane] = np.frombuffer(expand(data[at : at + length]), np.uint8)
            at += length
        columns.append(planes.view("<u8")[:, 0])
    return columns


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def folded(signed: np.ndarray) -> np.ndarray:
    """Signed numbers as numbers of 0 or more: 0, -1, 1, -2, 2, ..."""
    return (signed << 1) ^ (signed >> 63)


def unfolded(numbers: np.ndarray) -> np.ndarray:
    n = numbers.view(np.int64)
    return (n >> 1) ^ -(n & 1)


def distinct_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, which of them each value is)."""
    order = np.argsort(values)
    ascending = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    which = np.empty(len(values), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ascending[new], order[new], which


def marked(places: np.ndarray, size: int) -> np.ndarray:
    """Which of 0 to size - 1 are among places, in order."""
    there = np.zeros(size, bool)
    there[places] = True
    return np.flatnonzero(there)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * ODD[0] + right
    x = (x ^ (x >> np.uint64(30))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


RECORD = "stretch long, tokens long, train_tokens long, payload binary"


def records(docs: DataFrame) -> DataFrame:
    """Of each stretch of docs (ref, doc_id, text, train): its distinct words' keys, and its texts as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, BYTES_AT_ONCE):
            yield stretch(rows)

    def stretch(rows: pa.Table) -> pa.RecordBatch:
        number: dict[bytes, int] = {b"\n": 0}
        codes = []
        for t in texts(rows.column("text").combine_chunks()):
            own = t.lower().split()
            own.append(b"\n")
            codes.append(np.array([number.setdefault(w, len(number)) for w in own], np.int32))
        length = np.array([len(c) for c in codes])
        code = np.concatenate(codes)
        usual = np.argsort(-np.bincount(code), kind="stable")  # frequent words have low places, which take less room
        place = np.empty(len(usual), np.int64)
        place[usual] = np.arange(len(usual))
        key = np.array([END, *(xxhash.xxh64_intdigest(w) for w in list(number)[1:])], np.uint64)[usual]
        doc_id, train = rows.column("doc_id").combine_chunks(), rows.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        ids, has_id = doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False)
        payload = pack(key, place[code], length, train, has_id, ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows.column("ref")[0].as_py()]), pa.array([int(length.sum())]), pa.array([int(length[train].sum())]), pa.array([payload], pa.binary())], ["stretch", "tokens", "train_tokens", "payload"]
        )

    return docs.mapInArrow(run, RECORD)


class Corpus(NamedTuple):
    """What all stretches need to know of the corpus: a few numbers."""

    bits: int  # of the keys of grams of two tokens or more
    slice_bits: int
    train_tokens: int
    distinct: int = 0


class Grams(NamedTuple):
    """The grams of some tokens that end at each place of a stretch: distinct keys in order, training counts, the key of
    each place (-1 for none), a place of each key."""

    key: np.ndarray
    n: np.ndarray
    of_place: np.ndarray
    place: np.ndarray


class Stretch:
    """The texts of a record one after the other, each after DEPTH marks; grams[k] are those of k tokens, up to `most`.

    take() adds what a round has found of the grams of k tokens, in the order of rounds: total[k] are training counts in
    the whole corpus, owner[k] whether a gram's part in divergences is this stretch's to give, shared[k] whether another
    stretch has the gram too, in any text.
    """

    def __init__(self, payload: bytes, corpus: Corpus, most: int) -> None:
        self.corpus = corpus
        key, code, length, train, has_id, ids = unpack(payload)
        self.length, self.train, self.has_id, self.ids = length.astype(np.int64), train.astype(bool), has_id.astype(bool), ids.view(np.int64)
        texts_, tokens = len(length), len(code)
        self.of_text = np.repeat(np.arange(texts_), self.length)
        self.token = np.arange(tokens) + (self.of_text + 1) * DEPTH
        words = np.append(key, np.uint64(BEFORE))
        of_word = np.full(tokens + texts_ * DEPTH, len(key))
        of_word[self.token] = code
        word = words[of_word]
        last_mark = self.token[np.cumsum(self.length) - self.length] - 1
        trained = np.zeros(len(word), bool)
        trained[self.token], trained[last_mark] = self.train[self.of_text], self.train
        self.is_token = np.zeros(len(word), bool)
        self.is_token[self.token] = True
        counted = self.is_token.copy()
        self.grams: dict[int, Grams] = {}
        self.total: dict[int, np.ndarray] = {}
        self.owner: dict[int, np.ndarray] = {}
        self.shared: dict[int, np.ndarray] = {}
        gram = word
        for k in range(1, most + 1):
            counted[last_mark] = k <= DEPTH
            places = np.flatnonzero(counted)
            if k == 1:  # the words are distinct already
                key, _, of_words = distinct_keys(words)
                which = of_words[of_word[places]]
                first = np.empty(len(key), np.int64)
                first[which] = places
            else:
                gram = np.concatenate([word[:1], mixed(gram[:-1], word[1:])])
                key, first, which = distinct_keys(gram[places] >> np.uint64(64 - corpus.bits))
                first = places[first]
            of_place = np.full(len(word), -1, np.int32)
            of_place[places] = which
            self.grams[k] = Grams(key, np.bincount(which, trained[places], len(key)).astype(np.int64), of_place, first)

    def asked(self, k: int) -> np.ndarray:
        """The grams of k tokens of which another stretch can have some, as places among the distinct keys."""
        own = self.grams[k]
        if k == 1:
            return np.arange(len(own.key))
        shorter = self.grams[k - 1].of_place
        places = np.flatnonzero(own.of_place >= 0)
        before, last = shorter[places - 1], shorter[places]  # none stands before a text's last mark
        both = ((before < 0) | self.shared[k - 1][before]) & self.shared[k - 1][last]
        return marked(own.of_place[places[both]], len(own.key))

    def take(self, k: int, found: np.ndarray) -> None:
        own, asked = self.grams[k], self.asked(k)
        self.total[k], self.owner[k], self.shared[k] = own.n.copy(), own.n > 0, np.zeros(len(own.key), bool)
        self.total[k][asked] += (found >> np.uint64(2)).astype(np.int64)
        self.owner[k][asked] ^= (found & np.uint64(1)).astype(bool)
        self.shared[k][asked] = (found & np.uint64(2)).astype(bool)

    def slices(self, k: int, some: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(slice, places among the distinct keys) of some grams of k tokens."""
        key = self.grams[k].key
        bits = 64 if k == 1 else self.corpus.bits
        slice_ = key[some] >> np.uint64(bits - self.corpus.slice_bits) if self.corpus.slice_bits else np.zeros(len(some), np.uint64)
        cuts = np.flatnonzero(np.diff(slice_, prepend=slice_[:1] + np.uint64(1))) if len(some) else np.zeros(0, int)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(some))):
            yield int(slice_[lo]), some[lo:hi]

    def contexts(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates among the contexts of d tokens, as places among the distinct keys: those that are shared, and
        those of which all is here."""
        context = marked(self.grams[d].of_place[self.token - 1], len(self.grams[d].key))
        context = context[self.total[d][context] >= MIN_COUNT]
        shared = self.shared[d][context]
        return context[shared], context[~shared]

    def evidence(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct gram of d tokens as a context: the divergence in steps, and how many next symbols, by the grams owned."""
        grams, total, size = self.grams, self.total, len(self.grams[d].key)
        mine = np.flatnonzero(self.owner[d + 1])
        mine = mine[self.is_token[grams[d + 1].place[mine]]]  # what stands before a text is no symbol
        place = grams[d + 1].place[mine]
        context = grams[d].of_place[place - 1]
        some = total[d][context] >= MIN_COUNT
        mine, place, context = mine[some], place[some], context[some]
        n, of = total[d + 1][mine], total[d][context]
        up = total[d][grams[d].of_place[place]]
        of_up = total[d - 1][grams[d - 1].of_place[place - 1]] if d > 1 else self.corpus.train_tokens
        # grams that share a key can lack a suffix: they say nothing of divergence
        gain = np.rint(STEPS * n * np.log((n / of) / np.where((up > 0) & (of_up > 0), up / np.maximum(of_up, 1), n / of)))
        return np.bincount(context, gain, size).astype(np.int64), np.bincount(context, minlength=size)


ASKED = "size int, slice long, stretch long, payload binary"
ANSWER = "size int, slice long, stretch long, payload binary, distinct long"


def requests(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["size", "slice", "stretch", "payload"])


def answered(asked: DataFrame, counts: bool) -> DataFrame:
    """What all stretches together have of each key that one of them asks for, in its order of keys.

    Requests hold keys and numbers. Of counts the answer has what other stretches have, whether another one asks for the
    gram, and whether the stretch is the first that has it in training; of contexts, whether they are retained and how
    many different next symbols they have.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("stretch")
        size = rows.column("size")[0].as_py()
        parts = [unpack(x) for x in rows.column("payload").to_pylist()]
        keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        key, _, which = distinct_keys(np.concatenate(keys))
        own = [np.concatenate([p[i] for p in parts]) for i in (1, 2)] if not counts else [np.concatenate([p[1] for p in parts])]
        if counts:
            n = np.bincount(which, own[0].astype(float), len(key)).astype(np.int64)
            shared = np.bincount(which, minlength=len(key)) > 1
            there = np.flatnonzero(own[0] > 0)
            first = np.full(len(key), -1)
            first[which[there[::-1]]] = there[::-1]  # the last one written is the first
            owner = np.zeros(len(which), bool)
            owner[first[first >= 0]] = True
            # what others have, and who is first where that isn't plain: mostly 0
            columns = (4 * (n[which] - own[0].astype(np.int64)) + 2 * shared[which] + (owner ^ (own[0] > 0)),)
            distinct = int((n > 0).sum() - (size == 1 and bool((n[key == np.uint64(BEFORE)] > 0).any())))
        else:
            gain = np.bincount(which, unfolded(own[0]).astype(float), len(key))
            columns, distinct = ((gain >= MIN_GAIN * STEPS)[which], np.bincount(which, own[1].astype(float), len(key))[which]), 0
        cuts = np.cumsum([0, *map(len, keys)])
        payload = [pack(*(c[lo:hi] for c in columns)) for lo, hi in zip(cuts, cuts[1:])]
        return pa.table(
            {"size": rows.column("size"), "slice": rows.column("slice"), "stretch": rows.column("stretch"), "payload": pa.array(payload, pa.binary()), "distinct": pa.array([distinct] + [0] * (len(parts) - 1), pa.int64())}
        )

    return asked.groupBy("size", "slice").applyInArrow(run, ANSWER)


def first_counts(stretches: DataFrame, corpus: Corpus) -> DataFrame:
    """The request of each stretch for the counts of its distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, payload in zip(batch.column("stretch").to_pylist(), batch.column("payload").to_pylist()):
                yield from counts_of(id_, Stretch(payload, corpus, 1), 1).to_batches()

    return stretches.select("stretch", "payload").mapInArrow(run, ASKED)


def counts_of(id_: int, own: Stretch, k: int) -> pa.Table:
    grams = own.grams[k]
    return requests([(k, s, id_, pack(steps(grams.key[at]), grams.n[at])) for s, at in own.slices(k, own.asked(k))])


def counts(rows: PandasCogroupedOps, corpus: Corpus, k: int) -> DataFrame:
    """The request of each stretch for the counts of its distinct grams of k tokens, after the rounds before."""

    def run(record: pa.Table, answers: pa.Table) -> pa.Table:
        return counts_of(record.column("stretch")[0].as_py(), met(record, answers, corpus, k - 1, k)[0], k)

    return rows.applyInArrow(run, ASKED)


def met(record: pa.Table, answers: pa.Table, corpus: Corpus, rounds: int, most: int) -> tuple[Stretch, dict[int, list[np.ndarray]]]:
    """A stretch that knows its grams up to `most` tokens, after so many rounds of counts; and what it got of its shared
    candidates, by the number of tokens."""
    answers = answers.sort_by([("of_counts", "descending"), ("size", "ascending"), ("slice", "ascending")])
    found: dict[tuple[bool, int], list] = {}
    for of_counts, size, payload in zip(*(answers.column(c).to_pylist() for c in ("of_counts", "size", "payload"))):
        found.setdefault((of_counts, size), []).append(unpack(payload))
    joined = {key: [np.concatenate(x) for x in zip(*parts)] for key, parts in found.items()}
    own = Stretch(record.column("payload")[0].as_py(), corpus, most)
    for k in range(1, rounds + 1):
        own.take(k, joined.get((True, k), [np.zeros(0, np.uint64)])[0])  # without an answer nothing was asked
    return own, {size: x for (of_counts, size), x in joined.items() if not of_counts}


def together(stretches: DataFrame, of_counts: list[DataFrame], of_contexts: DataFrame | None = None) -> PandasCogroupedOps:
    """Each stretch's record with the answers of all rounds; records lie in buckets, so that only answers are moved."""
    rows = [own.select("stretch", F.lit(own is not of_contexts).alias("of_counts"), "size", "slice", "payload") for own in [*of_counts, *([of_contexts] if of_contexts else [])]]
    return stretches.groupBy("stretch").cogroup(reduce(DataFrame.union, rows).groupBy("stretch"))


def divergences(rows: PandasCogroupedOps, corpus: Corpus) -> DataFrame:
    """The request of each stretch for its shared candidates, with what the grams that it owns contribute."""

    def run(record: pa.Table, answers: pa.Table) -> pa.Table:
        id_, (own, _) = record.column("stretch")[0].as_py(), met(record, answers, corpus, DEPTH + 1, DEPTH + 1)
        out = []
        for d in range(1, DEPTH + 1):
            gains, followers = own.evidence(d)
            key = own.grams[d].key >> np.uint64(64 - corpus.bits if d == 1 else 0)
            out += [(d, s, id_, pack(steps(key[at]), folded(gains[at]), followers[at])) for s, at in own.slices(d, own.contexts(d)[0])]
        return requests(out)

    return rows.applyInArrow(run, ASKED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(rows: PandasCogroupedOps, corpus: Corpus) -> DataFrame:
    def run(record: pa.Table, answers: pa.Table) -> pa.Table:
        own, about = met(record, answers, corpus, DEPTH + 1, DEPTH + 1)
        grams, total, token, texts_ = own.grams, own.total, own.token, len(own.length)
        c = total[1][grams[1].of_place[token]]
        base = (c + 1) / (corpus.train_tokens + corpus.distinct + 1)
        p = score = base
        for d in range(1, DEPTH + 1):
            (asks, here), (gains, seen) = own.contexts(d), own.evidence(d)
            kept, followers = np.zeros(len(gains), bool), np.zeros(len(gains))
            kept[here], followers[here] = gains[here] >= MIN_GAIN * STEPS, seen[here]
            if len(asks):
                kept[asks], followers[asks] = about[d]
            context = grams[d].of_place[token - 1]
            prior = PRIOR * followers[context]
            p = np.where(prior > 0, (total[d + 1][grams[d + 1].of_place[token]] + prior * p) / np.maximum(total[d][context] + prior, 1), p)
            score = np.where(kept[context], p, score)
        of_text = lambda x: np.bincount(own.of_text, x, texts_)
        return pa.table(
            {
                "doc_id": pa.array(own.ids, mask=~own.has_id),
                "held_out": ~own.train,
                "n_tokens": own.length,
                "n_known": of_text(c > 0).astype(np.int64),
                "base_score": of_text(np.log10(base)),
                "score": of_text(np.log10(score)),
            }
        )

    return rows.applyInArrow(run, SCORED)


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Rows with crc32(doc_id as text) mod 7 = 2 are held out of all learning; a null id counts as the empty text. Null
    texts count as empty and have one token, the end. Repeated rows are learned and scored as often as they occur. In the
    base and so in the score a token that isn't known has the share of one unknown token. An empty table gives no row;
    without training rows that share is 1. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod("doc_id", 7) != 2).alias("train"), F.monotonically_increasing_id().alias("ref")
    )
    name, where = bucketed(records(rows), "stretch")
    stretches = spark.table(name)
    small_batches(spark, 4)  # a row can have some megabytes
    size = stretches.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("train")).first()
    corpus = Corpus(min(64, max(LEAST_BITS, size.n.bit_length() + SPARE_BITS)), max(0, (size.n // TOKENS_A_SLICE).bit_length()), size.train)
    found, folders = [], []

    def keep(answers: DataFrame) -> DataFrame:
        kept, folder = stored(answers)
        folders.append(folder)
        return kept

    found.append(keep(answered(first_counts(stretches, corpus), True)))
    corpus = corpus._replace(distinct=found[0].agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0])
    for k in range(2, DEPTH + 2):
        found.append(keep(answered(counts(together(stretches, found), corpus, k), True)))
    of_contexts = keep(answered(divergences(together(stretches, found), corpus), False))
    out = settle(scored(together(stretches, found, of_contexts), corpus))
    for folder in folders:
        discard(spark, folder)
    unbucket(spark, name, where)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
