"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A sentence has a probability from a linear model over
its words and their beginnings; a text is toxic if any sentence is: the noisy-or
``1 - prod(1 - p)``. Only texts have labels; the gradient of the text's loss reaches
its sentences through the noisy-or, so the same model then points at the sentences.
Sentences without any feature that tells the labels apart have probability 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.llm.base import lists, pick, slices, text_bytes
from sensorium.llm.words import ALPHANUMERIC, Words, find_words, mix

BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A text of the sample is at most the sample's bytes by this.
SHARE = 100
#: Bytes that end a sentence.
STOPS = np.zeros(256, bool)
STOPS[[0x0A, 0x21, 0x2E, 0x3F]] = True


def sentence_of(words: Words) -> np.ndarray:
    """Number of each word's sentence, over all rows; a sentence never crosses rows."""
    if not len(words.start):
        return np.empty(0, np.int64)
    stops = np.concatenate([[0], np.cumsum(STOPS[words.text])])
    new = np.ones(len(words.start), bool)
    new[1:] = (stops[words.start[1:]] > stops[words.end[:-1]]) | (words.row[1:] != words.row[:-1])
    return np.cumsum(new) - 1


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each feature: the word, and its first 3 to 8 bytes where it is longer.

    A beginning of a longer word is another feature than the same bytes as a whole word.
    """
    size = words.end - words.start
    which, bucket = [np.arange(len(size))], [words.hashes()]
    for n in PREFIXES:
        longer = np.flatnonzero(size > n)
        part = Words(words.text, words.start[longer], words.end[longer], words.row[longer], words.first)
        which.append(longer)
        bucket.append(mix(part.hashes(n)))
    return np.concatenate(which), (np.concatenate(bucket) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, words: Words, sentence: np.ndarray) -> np.ndarray:
        which, bucket = features(words)
        count = int(sentence[-1]) + 1 if len(sentence) else 0
        weight = self.weights[bucket]
        known = np.bincount(sentence[which], weight != 0, count) > 0
        return np.where(known, np.bincount(sentence[which], weight, count) + self.bias, -np.inf)

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Noisy-or of each row, and the number and logit of the sentences."""
        sentence = sentence_of(words)
        logits = self.sentence_logits(words, sentence)
        row = np.zeros(len(logits), np.int64)
        row[sentence] = words.row
        total = np.bincount(row, np.logaddexp(0, logits), len(words.first) - 1)
        return -np.expm1(-total), sentence, logits


def evidence(texts: np.ndarray, toxic: np.ndarray, rows: int, positives: float) -> np.ndarray:
    """Likelihood ratio G2 of presence in a text against its label."""
    out = np.zeros(len(texts))
    for seen, total in ((toxic, positives), (texts - toxic, rows - positives)):
        for cell, share in ((seen, texts / rows), (total - seen, 1 - texts / rows)):
            want = total * share
            out += 2 * np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-9) / np.maximum(want, 1e-9)), 0.0)
    return out


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, least_evidence: float = 12.0, rounds: int = 300, rate: float = 0.3, decay: float = 0.02, bias: float = -7.0) -> Model:
    """``bags``: for each text, bucket and sentence number of its features (sentences from 0).

    Full-batch Adam on the noisy-or log loss. Features have a weight only if their presence in a
    text and its label depend on each other with a likelihood ratio G2 of ``least_evidence``.
    """
    weights = np.zeros(BUCKETS, np.float32)
    if not len(bags) or labels.min() == labels.max():
        rate_of = float(np.clip(labels.mean() if len(bags) else 0.0, 1e-6, 1 - 1e-6))
        return Model(weights, bias if rate_of < 0.5 else -bias)
    texts, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for (bucket, _), label in zip(bags, labels, strict=True):
        own = np.unique(bucket)
        texts[own] += 1
        toxic[own] += label
    used = np.flatnonzero(evidence(texts, toxic, len(bags), labels.sum()) >= least_evidence)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    per_text = np.array([int(s[-1:].sum()) + 1 if len(s) else 0 for _, s in ((b, np.sort(s)) for b, s in bags)])
    base = np.concatenate([[0], np.cumsum(per_text)])
    feature = np.concatenate([place[b] for b, _ in bags])
    sentence = np.concatenate([s + base[k] for k, (_, s) in enumerate(bags)]).astype(np.int32)
    feature, sentence = feature[feature >= 0], sentence[feature >= 0]
    # a sentence without any known feature has probability 0, so length alone makes no text toxic
    known, sentence = np.unique(sentence, return_inverse=True)
    text = np.repeat(np.arange(len(bags)), per_text)[known]
    w, b = np.zeros(len(used)), bias
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, w[feature], len(known)) + b
        total = np.maximum(np.bincount(text, np.logaddexp(0, z), len(bags)), 1e-9)
        outer = np.where(labels > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        g = outer[text] / (1 + np.exp(-z)) / len(bags)
        gw, gb = np.bincount(feature, g[sentence], len(used)) + decay / len(bags) * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * (1 - t / (rounds + 1))
        w -= step * m / (np.sqrt(v) + 1e-7)
        b -= step * mb / (np.sqrt(vb) + 1e-7)
    weights[used] = w
    return Model(weights, float(b))


def bags_of(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (bucket, sentence) features of each row."""
    sentence = sentence_of(words)
    which, bucket = features(words)
    by = np.argsort(which, kind="stable")
    which, bucket = which[by], bucket[by]
    cuts = np.searchsorted(which, words.first)
    for row in range(len(words.first) - 1):
        a, b = cuts[row], cuts[row + 1]
        own = sentence[which[a:b]]
        both = np.unique((own - own[0]) * BUCKETS + bucket[a:b]) if b > a else np.empty(0, np.int64)
        yield (both % BUCKETS).astype(np.int32), (both // BUCKETS).astype(np.int32)


def _met(texts: DataFrame, marks: DataFrame, most_texts: int, most_size: int) -> list:
    """``id, y, order, size`` of labelled texts in order, those of more than ``most_size`` bytes last.

    Half as many ids again as are wanted are looked up, as some have no text or one too long;
    where too few are left, four times as many, until there are enough or no more labels.
    """
    tried = most_texts * 3 // 2
    while True:
        # the sample is bounded, so it may be broadcast
        first = marks.orderBy("order").limit(tried)
        first = F.broadcast(first) if tried <= 16 * most_texts else first
        met = texts.join(first, "id").groupBy("id").agg(F.first("y").alias("y"), F.first("order").alias("order"), F.max(F.octet_length("text")).alias("size"))
        rows = met.orderBy(F.coalesce("size", F.lit(0)) > most_size, "order").limit(most_texts).collect()
        if sum((r["size"] or 0) <= most_size for r in rows) >= most_texts or marks.limit(tried + 1).count() <= tried:
            return rows
        tried *= 4


def labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most_texts: int, most_bytes: int) -> tuple[list, np.ndarray]:
    """Bags and labels of a bounded sample of labelled texts: those of smallest hashed id.

    Rows with a null or other label take no part; an id with several labels has the larger.
    At most ``most_texts`` texts and ``most_bytes`` bytes of text come to the driver, as features.
    Texts of more than a ``SHARE``-th of ``most_bytes`` come after all others, and a text that does
    not fit is passed over for the next ones, so that a few long texts never use up the sample.
    """
    marks = pick(labels, id=id_column, y=label_column).filter("y in (0, 1) and id is not null")
    marks = marks.groupBy("id").agg(F.max("y").cast("int").alias("y")).withColumn("order", F.xxhash64(F.lit("sample"), F.col("id").cast("string")))
    texts = pick(docs, id=id_column, text=text_column)
    chosen, left = [], most_bytes
    for r in _met(texts, marks, most_texts, most_bytes // SHARE):
        if len(chosen) < most_texts and (r["size"] or 0) <= left:
            left -= r["size"] or 0
            chosen.append((r["id"], r["y"]))
    if not chosen:
        return [], np.empty(0)
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"id {texts.schema['id'].dataType.simpleString()}, y int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bags = list(bags_of(find_words(*text_bytes(batch.column("text")), ALPHANUMERIC)))
            sizes = [len(b) for b, _ in bags]
            parts = [lists(np.concatenate([x[k] for x in bags]), sizes, pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *parts], ["id", "y", "bucket", "sentence"])

    kind = f"id {texts.schema['id'].dataType.simpleString()}, y int, bucket array<int>, sentence array<int>"
    one = texts.join(few, "id").groupBy("id").agg(F.first("y").alias("y"), F.max("text").alias("text"))
    got = one.mapInArrow(run, kind).toArrow()
    by = got.sort_by("id")
    bags = [(b.values.to_numpy(), s.values.to_numpy()) for b, s in zip(by.column("bucket"), by.column("sentence"), strict=True)]
    return bags, np.array(by.column("y").to_pylist(), float)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most_texts: int = 5_000, most_bytes: int = 24_000_000) -> Model:
    """A model of ``labels`` (pass only those that may be learnt from). Null texts are empty.

    Without labels, or with labels of one kind, every sentence has the same small or large
    probability. The sample's bounds are the last two parameters.
    """
    return fit(*labelled(docs, labels, id_column, text_column, label_column, most_texts, most_bytes))


def with_score(docs: DataFrame, model: Model, text_column: str = "text", result: str = "score") -> DataFrame:
    """Add the probability of each whole text; empty and null texts have 0. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [np.empty(0)]
        for part in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text"):
            parts.append(sent.value.score(find_words(*text_bytes(part.column("text")), ALPHANUMERIC))[0])
        return pa.array(np.concatenate(parts))

    return docs.withColumn(result, score(F.col(text_column)))


def with_sentences(docs: DataFrame, model: Model, least: float = 0.5, text_column: str = "text", result: str = "offending") -> DataFrame:
    """Add the sentences whose own probability is at least ``least``: text and score, in order."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<sentence: string, score: double>>")
    def locate(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text"):
            raw, offsets = text_bytes(part.column("text"))
            words = find_words(raw, offsets, ALPHANUMERIC)
            _, sentence, logits = sent.value.score(words)
            own: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
            first = np.searchsorted(sentence, np.arange(len(logits) + 1))
            for k in np.flatnonzero(logits >= np.log(least / (1 - least))):
                a, b = first[k], first[k + 1] - 1
                own[words.row[a]].append({"sentence": raw[words.start[a] : words.end[b]].tobytes().decode(), "score": float(1 / (1 + np.exp(-logits[k])))})
            out += own
        return pa.array(out, kind)

    return docs.withColumn(result, locate(F.col(text_column)))
