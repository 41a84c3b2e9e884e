"""The trained models: held-out results, exact identities, odd inputs."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterline.llm import language_id, quality, suffix_tree, token_counts

from .fixtures import ROWS, clashing, documents, sample

DATA = "/root/testdata/sf0.01"


def held_out(doc_id: int | None, modulus: int = 5, rest: int = 0) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == rest


def test_languages_of_held_out_documents(spark):
    docs = sample(spark, DATA)
    got = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out and r.lang]
    assert len(own) > 100 and np.mean([r.lang == r.lang_pred for r in own]) > 0.98


def test_recurrent_gradient_is_exact():
    net = language_id.Network(["a", "b", "c"], seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, label = np.random.default_rng(0).integers(1, 256, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss() -> float:
        p = net.probabilities(x)
        return float(-np.log(p[:, label, np.arange(5)]).mean())

    g = net.gradients(x, label)
    random = np.random.default_rng(2)
    for name in net.w:
        for _ in range(4):
            at = tuple(random.integers(n) for n in net.w[name].shape)
            if name.startswith("rows") and (at[1] not in x):
                at = (at[0], int(x[0, 0]))
            old, eps = net.w[name][at], 1e-2
            net.w[name][at] = old + eps
            up = loss()
            net.w[name][at] = old - eps
            down = loss()
            net.w[name][at] = old
            assert (up - down) / (2 * eps) == pytest.approx(float(g[name][at]), abs=2e-4)


def test_odd_documents_have_languages(spark):
    docs = clashing(documents(spark))
    got = language_id.languages(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 7} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and not {3, 4, 5, 7} & {r.doc_id for r in kept.collect()}
    assert language_id.languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_texts_of_no_learned_language_go_and_short_clean_ones_stay(spark):
    docs = sample(spark, DATA)
    clean = {50_000: "A cat sat here.", 50_001: "Hallo Welt", 50_002: "Bonjour"}
    other = {60_000: "Η γλώσσα αυτή δεν έχει διδαχθεί και κανείς δεν την ξέρει εδώ σήμερα. " * 5, 60_001: "这是一种没有学过的语言，没有人知道它在说什么。" * 8, 60_002: "Этот язык не был изучен, поэтому его нельзя определить. " * 5, 60_003: "½ ² ① 12 !", 60_004: "", 60_005: None}
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in {**clean, **other}.items()], docs.schema)
    kept = {r.doc_id for r in language_id.keep_identified(docs.unionByName(more)).collect()}
    assert set(clean) <= kept and not set(other) & kept
    assert len(kept) >= 0.99 * docs.where("text is not null and text <> ''").count()
    assert language_id.judge(language_id.train(docs), pa.array(["½ ² ①", "a½"]))[0][0] == language_id.UNDETERMINED


def test_quality_of_held_out_documents(spark):
    docs, labels = sample(spark, DATA), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in got)
    own = [r for r in got if r.held_out]
    good, bad = [r.score for r in own if r.quality == 1], [r.score for r in own if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in own]) > 0.95


def test_bag_gradient_is_exact():
    random = np.random.default_rng(0)
    x, owner, label = random.normal(size=(9, 15)) / 4, np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 0, 1])
    model = quality.Bags(size=15)
    model.w["encode"] = model.w["encode"].astype(float)

    def loss() -> float:
        p = model.forward(model.encoded(x), owner, 4)["p"]
        return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

    g = model.gradients(x, owner, label)
    for name, w in model.w.items():
        at = tuple(random.integers(n) for n in w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], abs=1e-6)


def test_passages_cover_the_whole_text():
    texts = [b"", b"x" * 5000, b"a b"]
    data, length, owner = quality.passages(texts)
    assert owner.tolist() == [0, 1, 1, 1, 1, 1, 2] and length.tolist() == [0, 1024, 1024, 1024, 1024, 904, 3]
    assert b"".join(d[:n].tobytes() for d, n in zip(data, length)) == b"".join(texts)
    found = quality.inputs(data, length)
    runs = found[:, : quality.HASHED]
    assert np.allclose(np.linalg.norm(runs, axis=1), [0, 1, 1, 1, 1, 1, 1]) and np.flatnonzero(runs[-1, :256]).tolist() == sorted(b"a b")
    for row, n in ((1, (1024, 1023, 1022)), (5, (904, 903, 902))):
        assert sorted(runs[row][runs[row] > 0]) == pytest.approx(sorted(np.log1p(n) / np.linalg.norm(np.log1p(n))), rel=1e-5)
    for text in (b"x" * 5000, bytes(range(256)) * 4, b"abcdefgh" * 3, b"abcdefgh", b"abc", b"", bytes(np.random.default_rng(0).integers(0, 256, 1024, dtype=np.uint8))):
        (got,) = quality.inputs(*quality.passages([text[:1024]])[:2])
        text = text[:1024]
        grams = [text[i : i + quality.GRAM] for i in range(len(text) - quality.GRAM + 1)]
        assert got[quality.HASHED] == pytest.approx(np.log1p(len(text)) / 7) and got[quality.HASHED + 1] == pytest.approx(len(set(grams)) / max(len(grams), 1), abs=1e-6)
    pieces = quality.spread(bytes(range(256)) * 400)
    assert len(pieces) == quality.PASSAGES_EACH and pieces[0] == bytes(range(256)) * 4 and quality.spread(b"") == [b""] and quality.spread(b"ab") == [b"ab"]


def test_samples_are_bounded_in_rows_whatever_repeats(spark, monkeypatch):
    from meterline.llm import training

    rows = spark.range(30_000).selectExpr("case when id < 20000 then 'hot' when id < 29000 then concat('l', id % 300) else 'once' end label", "xxhash64(case when id >= 29000 then 0 else id end) h", "cast(id as string) value")
    got = training.drawn(rows, 25, 10**6)
    n = Counter(r.label for r in got)
    assert len(n) == 302 and n["once"] == 1 and n["hot"] == 25 and max(n.values()) == 25 and min(n[f"l{i}"] for i in range(300)) == 25
    assert Counter(r.label for r in training.drawn(rows, 25, 604)) == {k: min(2, v) for k, v in n.items()}
    assert [tuple(r)[:2] for r in got] == [tuple(r)[:2] for r in training.drawn(rows.repartition(7), 25, 10**6)]


def test_one_id_that_repeats_and_long_texts_do_not_fill_the_sample(spark, monkeypatch):
    taken = {}
    for module in (language_id, quality):
        own = module.drawn
        monkeypatch.setattr(module, "drawn", lambda *a, own=own, name=module.__name__: taken.setdefault(name, []).append(own(*a)) or taken[name][-1])
    keep = next(i for i in range(1, 99) if not held_out(i))
    ids = [i for i in range(100, 160) if not held_out(i)]
    rows = [(keep, "the same text again and again " * 9, "en", "s", 0)] * 3000 + [(keep, f"another text {i} of it", "en", "s", 0) for i in range(2000)]
    rows += [(i, f"ein sehr langer Text {i} " * 40_000, "de", "s", 0) for i in ids]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(keep, 1, 0), *[(i, 0, 0) for i in ids]], "doc_id long, quality int, toxic int")
    assert set(language_id.train(docs).languages) == {"de", "en"}
    assert quality.train(docs, labels, 50) is not None
    (of_language,) = taken[language_id.__name__]
    assert max(len(r.value) for r in of_language) <= language_id.PIECE and sum(r.label == "en" for r in of_language) <= language_id.PER_LANGUAGE
    of_quality = taken[quality.__name__][-1]
    assert Counter(r.label for r in of_quality) == {1: 50, 0: len(ids)} and max(len(r.value) for r in of_quality) <= quality.PASSAGES_EACH


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 2)
    ids = [i for i in range(2000) if not held_out(i)][:1200]
    docs = documents(spark, [(i, f"words of language {n % 300}", f"l{n % 300}", "s", 0) for n, i in enumerate(ids)])
    assert len(language_id.train(docs).languages) == 300


def test_quality_is_learned_from_every_part_of_a_text(spark, monkeypatch):
    seen, own = [], quality.passages
    monkeypatch.setattr(quality, "passages", lambda texts: seen.append(texts) or own(texts))
    monkeypatch.setattr(quality, "STEPS", 2)
    ids = [i for i in range(1, 60) if not held_out(i)]
    texts = {i: f"{i} " + "".join(f"{i}:{n} " for n in range(100 * (i % 9) + 1)) for i in ids}  # up to 6 passages and more
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is not None
    assert sorted(seen[0]) == sorted(t.encode() for t in texts.values()) and max(len(t) for t in seen[0]) > quality.PASSAGES_EACH * quality.PASSAGE
    assert quality.train(docs, labels, most=20_000) is not None  # fewer texts, all of them whole
    assert 2 < len(seen[1]) < len(ids) and set(seen[1]) <= set(seen[0]) and sum(map(len, seen[1])) <= 20_000
    assert [quality.fitting(s, 10) for s in ([], [11, 1], [4, 6, 1], [4, 7], [0, 0])] == [0, 1, 2, 1, 2]


def test_a_bag_that_counts_twice_is_two(spark):
    random = np.random.default_rng(1)
    model, x = quality.Bags(size=15), random.normal(size=(700, 15))
    once = model.gradients(x, np.repeat([0, 1], [300, 400]), np.array([1.0, 0]), np.array([2, 1]))
    twice = model.gradients(np.concatenate([x[:300], x]), np.repeat([0, 1, 2], [300, 300, 400]), np.array([1.0, 1, 0]))
    assert all(once[k] == pytest.approx(twice[k], abs=1e-6) for k in once)


def test_odd_documents_have_quality(spark):
    docs = clashing(documents(spark))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (4, 0, 0), (None, 1, 0), (7, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def plain_base(rows) -> dict[int, tuple[int, int, float]]:
    from collections import Counter

    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in rows}
    count = Counter(t for i, own in tokens.items() if not held_out(i, 7, 2) for t in own)
    n, v = sum(count.values()), len(count)
    return {i: (len(own), sum(count[t] > 0 for t in own), sum(np.log10((count[t] + 1) / (n + v + 1)) for t in own), n) for i, own in tokens.items()}


def plain_scores(rows) -> dict[int, float]:
    """The suffix tree in one place, by dictionaries of token tuples."""
    from collections import Counter, defaultdict
    from math import log, log10

    depth = suffix_tree.DEPTH
    of = lambda r: [b""] * depth + [*(r.text or "").encode().lower().split(), b"\n"]
    count, follow = Counter(), defaultdict(Counter)
    for r in rows:
        own = of(r)
        if held_out(r.doc_id, 7, 2):
            continue
        for at in range(depth, len(own)):
            count[own[at]] += 1
            for d in range(1, depth + 1):
                follow[tuple(own[at - d : at])][own[at]] += 1
    n, v = sum(count.values()), len(count)
    kept = set()
    for context, after in follow.items():
        m = sum(after.values())
        up = follow[context[1:]] if len(context) > 1 else count
        gain = sum(round(suffix_tree.STEPS * k * log(k / m / (up[w] / sum(up.values())))) for w, k in after.items())
        if m >= suffix_tree.MIN_COUNT and gain >= suffix_tree.MIN_GAIN * suffix_tree.STEPS:
            kept.add(context)
    out = {}
    for r in rows:
        own, total = of(r), 0.0
        for at in range(depth, len(own)):
            p = score = (count[own[at]] + 1) / (n + v + 1)
            for d in range(1, depth + 1):
                context = tuple(own[at - d : at])
                after = follow.get(context)
                if after and sum(after.values()) >= suffix_tree.MIN_COUNT:
                    p = (after[own[at]] + suffix_tree.PRIOR * len(after) * p) / (sum(after.values()) + suffix_tree.PRIOR * len(after))
                    score = p if context in kept else score
            total += log10(score)
        out[r.doc_id] = total
    return out


@pytest.mark.parametrize("bytes_at_once", [2000, 12 << 20], ids=["many_stretches", "few"])
def test_unigram_base_and_the_tree_in_one_place(spark, monkeypatch, bytes_at_once):
    monkeypatch.setattr(suffix_tree, "BYTES_AT_ONCE", bytes_at_once)
    monkeypatch.setattr(suffix_tree, "TOKENS_A_SLICE", 1 << 16)
    docs = sample(spark, "/root/testdata/sf0.001")
    got, rows = suffix_tree.lm_scores(docs).collect(), docs.collect()
    expected, scores = plain_base(rows), plain_scores(rows)
    assert len(got) == len(rows)
    for r in got:
        n, known, base, total = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held_out(r.doc_id, 7, 2))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(scores[r.doc_id], rel=1e-9)


def test_scores_do_not_depend_on_how_the_table_is_cut(spark, monkeypatch):
    docs = sample(spark, DATA).where("doc_id < 400")
    scores = lambda df: {r.doc_id: r.score for r in suffix_tree.lm_scores(df).collect()}
    one = scores(docs.coalesce(1))
    assert len(one) == docs.count()
    for parts, size in ((4, 10 << 20), (16, 10 << 20), (64, 1 << 14)):
        monkeypatch.setattr(suffix_tree, "BYTES_AT_ONCE", size)
        cut = docs.repartition(parts, "doc_id")
        assert scores(cut) == pytest.approx(one, rel=1e-12)
        rows = cut.selectExpr("doc_id", "text", "true as train", "doc_id as ref")
        assert suffix_tree.records(rows).count() >= min(parts, 40)


def test_held_out_texts_in_a_file_of_their_own_meet_what_is_learned(spark, tmp_path):
    train, held = [i for i in range(500) if not held_out(i, 7, 2)][:60], [i for i in range(500) if held_out(i, 7, 2)][:3]
    text = lambda i: f"once w{i} upon a x{i} time there was y{i} a fox z{i}"
    learned = [(i, text(i // 2)) for i in train]
    asked = [(i, text(train[0] // 2)) for i in held]
    together, apart = str(tmp_path / "together"), str(tmp_path / "apart")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    frame(learned + asked).write.parquet(together)
    for rows in (learned[:20], learned[20:], asked[:2], asked[2:]):
        frame(rows).write.mode("append").parquet(apart)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a file a partition
    try:
        got = [{r.doc_id: (r.score, r.base_score) for r in suffix_tree.lm_scores(spark.read.parquet(x)).collect()} for x in (together, apart)]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(got[0][i] == pytest.approx(got[1][i], rel=1e-12) for i in train + held)
    assert all(score > base + 2 for score, base in (got[1][i] for i in held))


def test_held_out_texts_score_better_than_by_the_base(spark):
    got = suffix_tree.lm_scores(sample(spark, DATA)).collect()
    for own in ([r for r in got if r.held_out], [r for r in got if not r.held_out]):
        assert len(own) > 100 and sum(r.score for r in own) > sum(r.base_score for r in own)


def test_starts_and_unknown_tokens(spark):
    """Held-out texts after any start, with and without known tokens, score as by the tree in one place."""
    random = np.random.default_rng(4)
    known = [f"w{i}" for i in range(6)]
    docs = [(i, " ".join(random.choice(known, random.integers(1, 30)))) for i in range(60)]
    starts = ["", "w1", "w1 w2", "w3 unheard", "w2 w2 w2 w5"]
    asked = [(1000 + i, f"{s} {w}".strip()) for i, (s, w) in enumerate((s, w) for s in starts for w in [*known, "another", ""])]
    asked = [(next(j for j in range(i * 1000, i * 1000 + 999) if held_out(j, 7, 2)), t) for i, t in asked]
    got = {r.doc_id: r for r in suffix_tree.lm_scores(spark.createDataFrame([d for d in docs if not held_out(d[0], 7, 2)] + asked, "doc_id long, text string")).collect()}
    plain = plain_scores(spark.createDataFrame([d for d in docs if not held_out(d[0], 7, 2)] + asked, "doc_id long, text string").collect())
    assert all(got[i].score == pytest.approx(plain[i]) for i, _ in asked)


def test_a_context_counts_the_same_however_large_the_corpus(spark):
    """What repeats in training is learned, also among a thousand times as many other tokens."""
    first, second = [i for i in range(20) if not held_out(i, 7, 2)][:2]
    row = [(first, "the rare qzx wvk passage"), (second, "the rare qzx wvk passage")]
    for n in (10, 3000):
        noise = [(i, " ".join(f"n{j}" for j in range(i, i + 5))) for i in range(100, 100 + n)]
        got = {r.doc_id: r for r in suffix_tree.lm_scores(spark.createDataFrame(row + noise, "doc_id long, text string")).collect()}
        assert got[first].score > got[first].base_score + 2


def test_long_frequent_tokens_are_scored(spark):
    rule = "-" * 300
    docs = spark.createDataFrame([(i, f"{rule} a{i % 3} {rule}") for i in range(500)], "doc_id long, text string")
    rows = docs.collect()
    expected, scores = plain_base(rows), plain_scores(rows)
    for r in suffix_tree.lm_scores(docs).collect():
        assert r.base_score == pytest.approx(expected[r.doc_id][2]) and r.score == pytest.approx(scores[r.doc_id])


def test_numbers_are_packed_and_unpacked():
    random = np.random.default_rng(2)
    columns = [random.integers(0, 1 << b, n, dtype=np.uint64) for b, n in ((1, 5), (63, 100), (9, 0), (20, 1))]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, suffix_tree.unpack(suffix_tree.pack(*columns))))
    signed = np.array([0, -1, 1, -(1 << 40), 1 << 40])
    assert (suffix_tree.unfolded(suffix_tree.folded(signed).astype("<u8")) == signed).all()


def test_odd_documents_are_scored(spark):
    docs = clashing(documents(spark))
    got = suffix_tree.lm_scores(docs).collect()
    assert len(got) == len(ROWS) and all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert [r.n_tokens for r in got if r.doc_id == 3] == [1] and len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert suffix_tree.lm_scores(docs.limit(0)).count() == 0
    assert suffix_tree.lm_scores(docs.where("doc_id = 3")).count() == 1


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    with open(token_counts.MODEL, "rb") as file:
        model = file.read()
    lexicon = token_counts.pieces(model)
    vocabulary = [("<unk>", -1e9), *[(f"<0x{i:02X}>", -1e9) for i in range(256)], *lexicon.items()]
    tokenizer = Tokenizer(Unigram(vocabulary, 0, True))
    blank = token_counts.BLANK
    return model, lambda t: len(tokenizer.encode(blank + t.replace(" ", blank)).ids) if t else 0


def test_counts_equal_the_library(spark, library, data):
    rows = sample(spark, data).collect()
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(sample(spark, data)).collect()}
    assert got == {r.doc_id: library[1](r.text or "") for r in rows}


def test_counts_of_random_text(library):
    counter = token_counts.Counter(library[0])
    random = np.random.default_rng(0)
    alphabet = list("aeioutnsr  ,.\n\tzäß漢字🙂▁\x07")
    for _ in range(300):
        text = "".join(random.choice(alphabet, random.integers(0, 60)))
        assert counter.count(text)[0] == library[1](text), repr(text)


def test_kept_segments_change_no_count(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    counter = token_counts.Counter(library[0])
    text = " ".join(f"word{i} again" for i in range(50))
    assert counter.count(text) == counter.count(text) and counter.count(text)[0] == library[1](text)


def test_odd_documents_are_counted(spark, tmp_path):
    docs = clashing(documents(spark))
    got = token_counts.token_counts(docs).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}
    assert token_counts.token_counts(docs.limit(0)).count() == 0
