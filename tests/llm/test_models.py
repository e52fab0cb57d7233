"""Language scores, whitening and phrases against plain versions, with nulls, empties, ties, repeats and clashing columns."""

import math
import re
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorium.llm import attention, phrases, scoring, whitening
from sensorium.llm.queries import PIECE_MODEL

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, chunk string, n string, word string, number int, f int"


def rows_of(texts):
    return [(i, t, lang, "x", "x", "x", 1, 2) for i, t, lang in texts]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = {"en": [f"ab{k}c" for k in range(60)], "de": [f"zü{k}x" for k in range(60)]}
    out = []
    for k in range(90):
        lang = ("en", "de", None)[k % 3]
        own = rng.choice(words["de" if lang == "de" else "en"], 40, p=np.arange(60, 0, -1) / 1830)
        out.append((k, " ".join(own[:20]) + ". New York City, \tnew york CITY\n" + " ".join(own[20:]) + " united states", lang))
    out += [(200, "", "en"), (201, None, "en"), (202, " \n\t", None), (None, "ab0c ab1c", "en"), (None, None, None), (5, out[5][1], "de"), (203, "É ﬁ½ x▁y 漢字", "fr")]
    out.append((300, " ".join(rng.choice(words["en"], 30_000)), "en"))
    return spark.createDataFrame(rows_of(out), KIND).repartition(4)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def HELD():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def test_base_scores_match_plain_counts(docs):
    texts = [(r.doc_id, SPACE.findall((r.text or "").translate(A_Z))) for r in docs.select("doc_id", "text").collect()]
    count = Counter()
    for i, w in texts:
        if not held(i):
            count.update([*w, None])
    total, distinct = sum(count.values()), len(count)
    want = []
    for i, w in texts:
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in [*w, None])
        want.append((i, held(i), len(w) + 1, sum(count[t] > 0 for t in [*w, None]), total, round(base, 6)))
    got = scoring.score(docs.select("*", F.lit("clash").alias("TEXT")), PIECE_MODEL, HELD()).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    unseen = [r for r in got if r.held_out and r.n_tokens > 20]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_of_few_and_no_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert scoring.score(empty, PIECE_MODEL, HELD()).count() == 0
    only = spark.createDataFrame(rows_of([(3, "all held out", "en"), (3, None, "en")]), KIND)
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in scoring.score(only, PIECE_MODEL, F.lit(True)).collect())
    assert got == [(1, 0, 0, 0.0), (4, 0, 0, 0.0)]


def test_topics_and_starting_values_count_every_training_text(spark):
    # more texts than once gave the starting values, and one too long for them then
    texts = [(i, f"w{i % 7} " * (i % 23), "en") for i in range(900)] + [(9000, "lang wort " * 20_000, "de")]
    rows = spark.createDataFrame(rows_of(texts), KIND).repartition(3).select("doc_id", F.coalesce(HELD(), F.lit(False)).alias("held_out"), "text")
    spark.sparkContext.addFile(PIECE_MODEL)
    found = scoring.coded(rows, PIECE_MODEL)
    tables = scoring.add_up(found.where("name IS NOT NULL").select("name", "at", "body"))
    subwords = scoring.Subwords(PIECE_MODEL)
    taught = [t.split() for i, t, _ in texts if not held(i)]
    size = {w: len(subwords.model.encode(w)) for t in taught for w in t}
    assert tables["next"].sum() == sum(1 + sum(size[w] for w in t) for t in taught)
    assert tables["away"].sum() == sum(max(len(t) + 1 - scoring.AWAY, 0) for t in taught)


def test_words_meet_their_counts_in_few_rows(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(scoring, "RUN_BYTES", 500)
    texts = [(i, " ".join(f"w{(i * k) % 61}" for k in range(i % 40)), "en") for i in range(400)]
    rows = spark.createDataFrame(rows_of(texts), KIND).repartition(3).select("doc_id", F.coalesce(HELD(), F.lit(False)).alias("held_out"), "text")
    spark.sparkContext.addFile(PIECE_MODEL)
    subwords = scoring.Subwords(PIECE_MODEL)
    runs = scoring.coded(rows, PIECE_MODEL).where("name IS NULL").cache()
    likely = scoring.find_topics(None, subwords.count)
    words = scoring.counted(runs, subwords.kind, likely, 3).cache()
    chunks = runs.select("chunk").distinct().count()
    # a row for each chunk and drawer, not for each of its words
    assert chunks > 6 and words.count() <= 3 * chunks
    drawers = {}
    for r in words.collect():
        for w in scoring.unpacked([r.body])[0].to_pylist():
            assert drawers.setdefault(w, r.drawer) == r.drawer
    met = scoring.totalled(words, subwords.kind, subwords.count, 2).cache()
    want = Counter()
    for i, t, _ in texts:
        if not held(i):
            want.update([*t.split(), None])
    spelled = {subwords.encode(pa.array([w.encode()], pa.binary()))[0].astype(subwords.kind).tobytes(): w for w in want if w}
    spelled[np.array([scoring.END], subwords.kind).tobytes()] = None
    for r in met.where("name IS NULL").collect():
        found, counts, _ = scoring.unpacked([r.body])
        assert all(want[spelled[w]] == n for w, n in zip(found.to_pylist(), counts[-1], strict=True))
    tables = scoring.add_up(met.where("name IS NOT NULL").select("name", "at", "body"))
    assert tables["words"][0] == len(want) and tables["words"][-1] == sum(want.values())
    assert tables["symbols"].sum() == sum(n * len(w) // subwords.kind.itemsize for w, n in ((w, want[t]) for w, t in spelled.items()))


def test_packed_counts_come_back():
    words = pa.array([b"", b"ab", b"abcd"], pa.binary())
    for top in (7, 1 << 40):
        counts = np.arange(3 * (scoring.TOPICS + 1)).reshape(-1, 3) + top
        found, n, many = scoring.unpacked([scoring.packed(words, counts), scoring.packed(words.slice(1), counts[:, 1:])])
        assert found.to_pylist() == [b"", b"ab", b"abcd", b"ab", b"abcd"] and many.tolist() == [3, 2]
        assert (n == np.concatenate([counts, counts[:, 1:]], 1)).all()


def test_attention_weights_are_bounded_only_where_they_may_grow():
    rng = np.random.default_rng(2)
    model = attention.Model.fresh(rng.dirichlet(np.ones(30)))
    inputs, targets = attention.windows(rng.integers(1, 30, 300), np.array([0, 300]))
    *sides, small = model.sides()
    assert small
    assert (model.log10(inputs, targets, (*sides, True)) == model.log10(inputs, targets, (*sides, False))).all()
    model.dense["query"] *= 1e4
    assert not model.sides()[-1] and np.isfinite(model.log10(inputs, targets)).all()
    table, row, values = np.zeros((30, 4)), rng.integers(0, 30, 500), rng.random((500, 4))
    want = table.copy()
    np.add.at(want, row, values)
    attention.add_rows(table, row, np.ascontiguousarray(values.T))
    np.testing.assert_allclose(table, want)


def test_topics_part_languages():
    rng = np.random.default_rng(3)
    pairs = np.zeros((scoring.BUCKETS, scoring.BUCKETS))
    for k in range(3):
        words = np.arange(40) + 40 * k
        np.add.at(pairs, (rng.choice(words, 4000), rng.choice(words, 4000)), 1)
    likely = scoring.find_topics(pairs, 4096)
    best = [set(np.argmax(likely[40 * k : 40 * k + 40], 1)) for k in range(3)]
    assert not best[0] & best[1] and not best[1] & best[2] and not best[0] & best[2]
    assert not scoring.find_topics(None, 9).any()


def test_sums_of_mixed_logarithms_match_single_ones():
    rng = np.random.default_rng(6)
    tokens = np.array([1, 8, 9, 40, 3])
    net = -rng.exponential(20, tokens.sum())
    net[[4, 20]], counts = (-320.0, -700.0), rng.random(len(net)) * 1e-3
    counts[[4, 20, 30]] = 0
    with np.errstate(divide="ignore"):
        each = np.where((net < -280) & (counts == 0), np.log10(0.2) + net, np.log10(0.2 * 10.0**net + 0.8 * counts))
    want = [x.sum() for x in np.split(each, np.cumsum(tokens)[:-1])]
    np.testing.assert_allclose(scoring.mixed(0.2, net, 10.0**net, counts, tokens), want, rtol=1e-12)


def test_every_symbol_is_scored_once_and_by_its_past_only():
    rng = np.random.default_rng(1)
    model = attention.Model.fresh(np.full(40, 1 / 40))
    texts = [rng.integers(1, 40, n) for n in (1, 15, 16, 17, 70, 3)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    inputs, targets = attention.windows(np.concatenate(texts), first)
    assert np.concatenate(texts).tolist() == targets[targets >= 0].tolist()
    for t, x in zip(np.split(np.concatenate(texts), first[1:-1]), np.split(model.log10(inputs, targets), first[1:-1]), strict=True):
        # the same text, alone and cut short, has the same scores
        alone = model.log10(*attention.windows(t, np.array([0, len(t)])))
        short = model.log10(*attention.windows(t[:-1], np.array([0, len(t) - 1])))
        np.testing.assert_allclose(alone, x, rtol=1e-5)
        np.testing.assert_allclose(short, x[:-1], rtol=1e-5)


def test_next_symbol_probabilities_add_up_to_one():
    model = attention.Model.fresh(np.full(12, 1 / 12))
    past = np.array([3, 5, 2, 9])
    total = sum(10 ** model.log10(*attention.windows(np.append(past, y), np.array([0, 5])))[-1] for y in range(12))
    assert abs(total - 1) < 1e-5


def test_window_probabilities_match_a_plain_loop():
    rng = np.random.default_rng(2)
    model = attention.Model.fresh(rng.dirichlet(np.ones(9)))
    text = rng.integers(1, 9, 45)
    got = model.log10(*attention.windows(text, np.array([0, 45])))
    emit, prior, source = (t.astype(float) for t in model.tables)
    past = np.concatenate([[0], text[:-1]])
    for t in range(45):
        begin = max(0, t // attention.STEP * attention.STEP - attention.STEP)
        seen = past[begin : t + 1]
        q = source[past[t]] @ model.dense["query"] / np.sqrt(attention.WIDTH)
        a = np.exp([q @ (source[s] @ model.dense["key"]) + model.dense["near"][len(seen) - 1 - k] for k, s in enumerate(seen)])
        o = sum(w * (source[s] @ model.dense["value"]) for w, s in zip(a, seen)) / a.sum()
        g = np.exp(prior[past[t]] + o @ model.dense["out"])
        assert abs(got[t] - np.log10(g @ emit[text[t]] / g.sum())) < 1e-4


def test_gradient_matches_differences():
    rng = np.random.default_rng(4)
    model = attention.Model.fresh(np.full(20, 1 / 20))
    inputs, targets = attention.windows(rng.integers(1, 20, 200), np.array([0, 90, 200]))
    counts = (np.zeros_like(model.emit), np.zeros_like(model.after))
    slope = model.gradient(inputs, targets, counts)
    assert abs(counts[0].sum() - 200) < 1e-2 and abs(counts[1].sum() - 200) < 1e-2
    loss = lambda m: -m.log10(inputs, targets).mean() * np.log(10)
    for name in attention.DENSE:
        at = tuple(rng.integers(0, s) for s in model.dense[name].shape)
        sides = []
        for step in (0.05, -0.05):
            other = model.copy()
            other.dense[name][at] += step
            sides.append(loss(other))
        assert abs((sides[0] - sides[1]) / 0.1 - slope[name][at]) < 2e-3


VECTORS = "vec_id long, embedding array<double>, n string, deviation string, vector int, whitened int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", 1, 2) for i, v in rows], VECTORS).repartition(3)


def plain_whitening(rows, count=8):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n = len(x)
    s = [sum(c) for c in zip(*x)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s)] for v in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:count]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    return n, deviation, centred @ turn[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=10) * np.arange(1, 11)).tolist()) for k in range(400)]
    rows += [(7, rows[7][1]), (None, rows[9][1])]
    other = [(900, None), (901, [1.0, None] + [0.0] * 8), (902, [float("nan")] * 10), (903, [float("inf")] * 10), (904, []), (905, [1.0, 2.0])]
    n, deviation, white, explained = plain_whitening(rows)
    got = whitening.whiten(vectors(spark, rows + other)).collect()
    assert len(got) == n * 8 and {r.n for r in got} == {n}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    key = lambda i: (i is None, i)
    for c in range(8):
        mine = sorted(((key(r.vec_id), r.deviation, r.whitened) for r in got if r.component == c + 1))
        want = sorted((key(i), d, w) for (i, _), d, w in zip(rows, deviation, white[:, c]))
        a, b = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
        assert [m[1] for m in mine] == [w[1] for w in want]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert abs(next(r.explained for r in got if r.component == c + 1) / explained[c] - 1) < 1e-9


def test_whitening_without_variance_and_with_huge_entries(spark):
    same = whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(3)])).collect()
    assert len(same) == 6 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in same} == {(None, 0.0, 0, 0.0)}
    one = whitening.whiten(vectors(spark, [(1, [5.0, 1.0, 2.0])])).collect()
    assert len(one) == 3 and {r.whitened for r in one} == {None}
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)])).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: r.component)] == [False] * 5 + [True] * 10
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 3.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and all(math.isfinite(r.whitened) for r in huge)
    assert whitening.whiten(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_qd_values_and_directions(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(2, 30))
    scale = [np.ones(d), 10.0 ** -np.arange(d), np.repeat([3.0, 1.0], [d // 2, d - d // 2]), np.concatenate([np.ones(1), np.zeros(d - 1)])][seed % 4]
    x = np.linalg.qr(rng.normal(size=(60, d)))[0] * scale @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    values, turn = whitening.leading(np.linalg.qr(x, mode="r"), d)
    want = np.linalg.svd(x, compute_uv=False)[: len(values)] ** 2
    np.testing.assert_allclose(values, want, rtol=1e-6, atol=1e-30)
    np.testing.assert_allclose(turn.T @ turn, np.eye(len(values)), atol=1e-10)
    np.testing.assert_allclose(x.T @ (x @ turn), turn * values, atol=1e-12 * values[0])


def test_qd_keeps_tiny_values_of_a_bidiagonal():
    a = 10.0 ** -np.arange(0.0, 40.0, 2)
    b = a[:-1] * 0.5
    got = np.sqrt(whitening.qd_values(a * a, b * b))
    # the product of all singular values is the determinant, to full relative accuracy
    assert abs(np.log(got).sum() - np.log(a).sum()) < 1e-11


def plain_phrases(rows, least, top):
    count, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            count.update((lang, tuple(w[k : k + size])) for size in range(1, 5) for k in range(len(w) - size + 1))
    often = {p: c for p, c in count.items() if len(p[1]) > 1 and c >= least}
    longer = Counter()
    for (lang, w), a in often.items():
        for size in range(2, len(w)):
            for k in range(len(w) - size + 1):
                longer[lang, w[k : k + size]] = max(longer[lang, w[k : k + size]], a)
    out = {}
    for (lang, w), a in often.items():
        if 100 * longer[lang, w] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("least", "top"), [(30, 2000), (2, 7)])
def test_phrases_match_plain_counts(docs, least, top):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    want = plain_phrases(rows, least, top)
    got = phrases.mine(docs.select("*", F.lit("clash").alias("TEXT")), least=least, top=top).collect()
    assert want and sorted(tuple(r) for r in got) == want


def test_phrases_cross_runs_and_filters_of_many_segments(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "RUN", 7)
    monkeypatch.setattr(phrases, "SEGMENT", 2_000)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    assert sorted(tuple(r) for r in phrases.mine(docs, least=25).collect()) == plain_phrases(rows, 25, 2000)


def test_phrases_of_no_rows(spark):
    assert phrases.mine(spark.createDataFrame([], KIND)).count() == 0
    assert phrases.mine(spark.createDataFrame(rows_of([(1, None, None), (2, "one two", "en")]), KIND)).count() == 0


@pytest.mark.parametrize(("length", "bits"), [(2, 4), (3, 18), (4, 16), (4, 18), (4, 31), (3, 31)])
def test_filters_keep_every_phrase(length, bits):
    rng = np.random.default_rng(bits)
    packing = phrases.Packing(length, bits)
    words = [rng.integers(1, 1 << min(bits, 9), 5000) * (1 if k else 1) for k in range(length)]
    count = rng.integers(1, 400, 5000)
    whole = phrases.Filter.of(packing, *packing.permute(words), count)
    want = Counter()
    for key, c in zip(zip(*words), count):
        want[key] += c
    read = []
    for segment, part in whole.segments(3):
        back = phrases.Filter.read(packing, segment, 3, part.write(3))
        halves = phrases.Filter.merged([back, back])
        assert (halves.count == 2 * back.count).all()
        read += list(zip(zip(*[w.tolist() for w in packing.words(back.left, back.right)]), back.count.tolist()))
    assert dict(read) == dict(want) and len(read) == len(want)


def test_a_task_holds_the_filters_of_one_segment():
    rng = np.random.default_rng(3)
    packing, segment_bits = phrases.Packing(3, 18), 5
    chunks = [[rng.integers(1, 1 << 6, 100_000) for _ in range(3)] for _ in range(3)]
    filters = [phrases.Filter.of(packing, *packing.permute(w), np.ones(100_000, np.int64)) for w in chunks]
    want = Counter(p for w in chunks for p in zip(*[k.tolist() for k in w]))
    parts = sorted((s, f.write(segment_bits)) for whole in filters for s, f in whole.segments(segment_bits))
    batches = [pa.record_batch({"length": pa.array([3], pa.int32()), "segment": pa.array([s], pa.int32()), "body": [b]}) for s, b in parts]
    decoded = sum(24 * len(f.left) for f in filters)
    found = {tuple(r["words"]): r["f"] for b in phrases.frequent(iter(batches), 18, segment_bits, 2) for r in b.to_pylist()}
    tracemalloc.start()
    for _ in phrases.frequent(iter(batches), 18, segment_bits, 2):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {p: c for p, c in want.items() if c >= 2}
    assert most < decoded / 8
