"""Operators on documents against plain versions, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorium.llm import fmindex, minmax, queries, rendezvous, sentences
from tests.conftest import FOLDER

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, lang string, component_id string, kept string, found string, score string, ids string, n int, label int, row int"


@pytest.fixture(scope="module")
def docs(spark):
    """A group of near copies, exact copies, a chain, null and empty texts, repeated rows, a long text."""
    rng = np.random.default_rng(3)
    vocabulary = [f"W{k}" for k in range(400)]
    base = list(rng.choice(vocabulary, 120))
    rows = []
    for k in range(30):
        own = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    chain = list(rng.choice(vocabulary, 60))
    for k in range(12):
        rows.append((100 + k, "\t".join([*chain[k:], *(f"c{j}" for j in range(k))])))
    rows += [(200, "Same text here"), (201, "same TEXT here"), (202, "same text"), (203, ""), (204, None), (205, " \n "), (None, "same text here"), (None, None), (206, "one"), (206, "one"), (1, rows[1][1])]
    rows.append((300, " ".join(rng.choice(vocabulary, 40_000))))
    rows += [(400 + k, " ".join(rng.choice(vocabulary, 50))) for k in range(20)]
    frame = [(i, t, "en", "clash", "clash", "clash", "clash", "clash", 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(frame, KIND).repartition(5)


def plain_groups(rows, size, share):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    label = list(range(len(rows)))
    find = lambda k: k if label[k] == k else find(label[k])
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= share * (len(sets[a]) + len(sets[b]) - common):
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), (least.get(find(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_near_groups_match_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = minmax.near_groups(docs, words=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_groups(rows, 4, 80)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)


def test_near_groups_need_no_hub_rounds(docs):
    """Results do not depend on the number of hub rounds."""
    one = minmax.near_groups(docs, hub_until=0).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, minmax.near_groups(docs).collect()), key=str)


def test_copies_are_dropped_once(docs):
    docs = docs.select("text", "lang", "doc_id", "n")
    left = minmax.drop_copies(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert ids.count(206) == 1 and ids.count(None) == 2 and {203, 204, 205} <= set(ids) and len([i for i in ids if i is not None and i < 30]) < 30


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    x, y = minmax.min_max(a, 200), minmax.min_max(np.concatenate([a[100:], b]), 200)
    assert x.shape == (400,) and abs((x == y).mean() - 800 / 1000) < 0.08


def plain_contamination(rows, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(A_Z))
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(min(1, len(w)), len(w) - size + 1)):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, text in rows:
        w, found = words(text), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [500_000, 3])
def test_contamination_matches_scan(spark, docs, block):
    texts = [r.text for r in docs.filter("doc_id in (1, 101, 300, 401)").select("text").collect()]
    items = [(1, texts[0]), (2, " ".join(texts[1].split()[5:30])), (3, "SAME-text"), (4, ""), (5, None), (6, "same text"), (10, "one"), (10, "one")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = fmindex.with_contamination(docs, table, block=block).select("doc_id", "text", "found").collect()
    want = plain_contamination([(r.doc_id, r.text) for r in got], items)
    assert sorted(((r.doc_id, r.found.n_words, r.found.n_hit, tuple(r.found["items"])) for r in got), key=str) == want
    assert any(x[2] for x in want)


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Ö keep this. a b c — then é this")], "doc_id long, text string")
    found = fmindex.with_contamination(docs, spark.createDataFrame([(1, "A, b; C")], "item_id long, text string"))
    assert found.select(fmindex.without_spans(F.col("text"), F.col("found.spans"))).first()[0] == "Ö keep this.  — then é this"


def test_no_items_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.with_contamination(docs, none).filter("found.n_hit > 0").count() == 0
    empty = docs.limit(0)
    assert fmindex.with_contamination(empty, none).count() == 0
    assert minmax.near_groups(empty).count() == 0
    assert rendezvous.shard(empty, {0: 1.0}).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3, 300).astype(np.uint64)
    first = np.array([0, 10, 10, 150, 300])
    index = fmindex.FMIndex(words, first, every=4)
    for n in (1, 2, 5):
        phrase = words[40 : 40 + n]
        matrix = np.zeros((1, 5), np.uint64)
        matrix[0, 5 - n :] = phrase
        lo, hi = index.search(matrix, np.array([n]))
        want = [k for a, b in zip(first[:-1], first[1:], strict=True) for k in range(a, b - n + 1) if (words[k : k + n] == phrase).all()]
        assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


def test_shards_move_only_into_the_new_one(docs):
    even = dict.fromkeys(range(8), 1.0)
    got = rendezvous.shard(docs, even, even | {8: 1.0}).collect()
    texts = sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.filter("doc_id is not null").collect())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == texts
    assert all(r.grown_shard in (r.shard, 8) for r in got) and any(r.grown_shard == 8 for r in got)
    for s in even:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id == 206}) == 1


def test_weights_share_the_rows(spark):
    keys = spark.range(4000).withColumn("text", F.lit("x"))
    got = {r.shard: r["count"] for r in rendezvous.shard(keys, {0: 1.0, 1: 3.0, 2: 0.0}, id_column="id").groupBy("shard").count().collect()}
    assert set(got) == {0, 1} and abs(got[1] / 4000 - 0.75) < 0.03


def test_toxicity_beats_chance_on_held_out_rows(spark):
    got = queries.QUERIES["op10_sentence_toxicity"](spark, FOLDER.replace("0.001", "0.01"))
    labels = spark.read.parquet(FOLDER.replace("0.001", "0.01") + "/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    yes, no = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(a > b) + (a == b) / 2 for a in yes for b in no]) > 0.7
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.03 * len(no)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())


def test_toxic_sentences_are_located(spark):
    rows = [(k, f"good words here number{k}. " + ("you badword fool! " if k % 3 == 0 else "") + "nice end", int(k % 3 == 0)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    edge = spark.createDataFrame([(1000, None, None), (1001, "", 1), (1002, "badword", None), (None, "x", 1), (0, rows[0][1], 1)], "doc_id long, text string, toxic int")
    all_ = docs.union(edge)
    model = sentences.train(all_.drop("toxic"), all_.select("doc_id", "toxic"))
    out = {r.doc_id: r for r in sentences.with_sentences(sentences.with_score(all_, model), model).collect()}
    assert out[3].score > 0.9 > 0.1 > out[4].score and out[1000].score == 0 == out[1001].score
    assert [s.sentence for s in out[3].offending] == ["you badword fool"] and out[4].offending == []


def test_length_alone_is_not_toxic(spark):
    rows = [(k, f"good words here. " + ("you badword fool! " if k % 3 == 0 else "") + "nice end", int(k % 3 == 0)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = sentences.train(docs, docs)
    long = spark.createDataFrame([(1, "Plain text goes on. " * 50_000)], "doc_id long, text string")
    assert sentences.with_score(long, model).first().score < 0.5


def test_long_labelled_texts_do_not_use_up_the_sample(spark):
    rows = [(k, f"some plain words here. {'badword' if k % 3 == 0 else 'goodword'} and more.", int(k % 3 == 0)) for k in range(300)]
    kind = "doc_id long, text string, toxic int"
    for n_long, size in ((1, 30_000), (40, 3_000)):
        docs = spark.createDataFrame(rows + [(1000 + k, "plain words. " * (size // 13), 0) for k in range(n_long)], kind)
        # the long ones are first in the order of the sample
        first = docs.filter("doc_id < 1000").select("doc_id").orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))).limit(3)
        smallest = [r.doc_id for r in first.collect()]
        docs = docs.withColumn("text", F.when(F.col("doc_id").isin(smallest), F.repeat(F.lit("plain words. "), size // 13)).otherwise(F.col("text")))
        docs = docs.withColumn("toxic", F.when(F.col("doc_id").isin(smallest), 0).otherwise(F.col("toxic")))
        model = sentences.train(docs, docs, most_bytes=25_000)
        got = {r.doc_id: r.score for r in sentences.with_score(docs, model).collect()}
        assert all((got[k] >= 0.5) == bool(y) for k, _, y in rows if k not in smallest)
    # where all are long, those that fit are used
    docs = spark.createDataFrame([(k, t * 20, y) for k, t, y in rows], kind)
    bags, y = sentences.labelled(docs, docs, "doc_id", "text", "toxic", 5_000, 25_000)
    assert 20 <= len(bags) <= 30 and set(y) == {0.0, 1.0}


def test_toxicity_without_labels(spark, docs):
    model = sentences.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert sentences.with_score(docs, model).filter("score >= 0.5").count() == 0


def test_item_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
