"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of words of the texts of one Arrow batch. Its index has the
Burrows-Wheeler transform of the word sequence in a wavelet matrix, and sampled suffix
positions. Test phrases are searched backwards, all at once; their occurrences are
located by walking to the nearest sample; overlapping spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.llm.base import pick, slices, text_bytes
from sensorium.llm.words import ALPHANUMERIC, find_words

SHARD_BYTES = 6_000_000
SHARD_WORDS = 1_500_000


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(np.concatenate([bits, np.zeros(128 - len(bits) % 64, bool)]), bitorder="little")
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones[:-1])]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Rank and access in a sequence of numbers, one bit vector for each binary digit."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for digit in reversed(range(max(1, int(symbols.max(initial=0)).bit_length()))):
            bits = (symbols >> digit) & 1 != 0
            self.levels.append((digit, Bits(bits), int(len(bits) - np.count_nonzero(bits))))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` goes when the sequence is sorted by ``symbol``; differences are ranks."""
        for digit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> digit) & 1 != 0, zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for digit, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << digit
            at = np.where(one, zeros + ones, at - ones)
        return symbol


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; the last number occurs once."""
    n = len(ranks)
    bits = max(1, int(ranks.max()).bit_length())
    step = max(1, 62 // bits)
    padded = np.concatenate([ranks.astype(np.int64), np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    todo, sorted_key = at, key[order]
    while True:
        # groups of equal keys among the places still open; a group's rank is its first place
        new = np.ones(len(todo) + 1, bool)
        new[1:-1] = sorted_key[1:] != sorted_key[:-1]
        first = np.maximum.accumulate(np.where(new[:-1], np.arange(len(todo)), 0))
        rank[order[todo]] = todo[first]
        todo = todo[~(new[:-1] & new[1:])]
        if not len(todo):
            return order
        open_ = order[todo]
        follow = rank[np.minimum(open_ + step, n - 1)]
        key = rank[open_] * (n + 1) + follow
        by = np.argsort(key)
        order[todo], sorted_key = open_[by], key[by]
        step *= 2


class FMIndex:
    """Index of texts as words (64-bit hashes), with ``first`` the start of each text."""

    def __init__(self, words: np.ndarray, first: np.ndarray, every: int = 16) -> None:
        texts = len(first) - 1
        self.vocabulary, symbol = np.unique(words, return_inverse=True)
        # one separator after each text; separators come first in order, by place
        row = np.repeat(np.arange(texts), np.diff(first))
        place = np.arange(len(words)) + row
        n = len(words) + texts
        sequence, ranks = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends = first[1:] + np.arange(texts)
        ranks[ends] = np.arange(1, texts + 1)
        sequence[place] = symbol + 1
        ranks[place] = symbol + texts + 1
        order = suffix_array(ranks)
        self.before = np.concatenate([[0, texts], texts + np.cumsum(np.bincount(symbol, minlength=len(self.vocabulary)))]).astype(np.int64)
        self.turned = WaveletMatrix(sequence[order - 1])
        # samples: every few words of a text, and its first word, so that no walk leaves the text
        inside = np.full(n, -1)
        inside[place] = np.arange(len(words)) - first[row]
        sampled = (inside[order] >= 0) & (inside[order] % every == 0)
        self.sampled = Bits(sampled)
        word_at = np.full(n, -1)
        word_at[place] = np.arange(len(words))
        self.samples = word_at[order[sampled]]
        self.size = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, given as a matrix of word hashes filled from the right."""
        count, width = phrases.shape
        lo, hi = np.zeros(count, np.int64), np.full(count, self.size, np.int64)
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                continue
            word = phrases[live, width - 1 - k]
            at = np.minimum(np.searchsorted(self.vocabulary, word), max(0, len(self.vocabulary) - 1))
            known = self.vocabulary[at] == word if len(self.vocabulary) else np.zeros(len(at), bool)
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], at[known] + 1
            base = self.turned.place(symbol, np.zeros(len(live), np.int64))
            lo[live] = self.before[symbol] + self.turned.place(symbol, lo[live]) - base
            hi[live] = self.before[symbol] + self.turned.place(symbol, hi[live]) - base
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Number of the word at which each row's suffix begins."""
        out, walk, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(walk):
            here = self.sampled.get(rows)
            out[walk[here]] = self.samples[self.sampled.rank(rows[here])] + steps
            walk, rows = walk[~here], rows[~here]
            symbol = self.turned.access(rows)
            rows = self.before[symbol] + self.turned.place(symbol, rows) - self.turned.place(symbol, np.zeros(len(rows), np.int64))
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct test phrases and the items that hold each."""

    matrix: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray
    names: list[str]


def windows_of(items: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """``item, words``: each distinct window of ``size`` words, as hashes; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = find_words(*text_bytes(batch.column("text")), ALPHANUMERIC)
            h, names = words.hashes().view(np.int64), batch.column("item").to_pylist()
            item, window = [], []
            for row, n in enumerate(words.counts()):
                own = h[words.first[row] : words.first[row + 1]]
                for k in range(max(min(n, 1), n - size + 1)):
                    item.append(names[row])
                    window.append(own[k : k + size].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(window, pa.list_(pa.int64()))], ["item", "words"])

    texts = pick(items, item=id_column, text=text_column)
    return texts.select(F.col("item").cast("string"), "text").mapInArrow(run, "item string, words array<long>").distinct()


def _phrases(table: pa.Table, size: int) -> Phrases:
    names, item = np.unique(np.array(table.column("item").to_pylist(), dtype=object).astype(str), return_inverse=True)
    windows = table.column("words").to_pylist()
    lengths = np.array([len(w) for w in windows], np.int64)
    matrix = np.zeros((len(windows), size), np.uint64)
    for k, w in enumerate(windows):
        matrix[k, size - len(w) :] = np.array(w, np.int64).view(np.uint64)
    keyed = np.concatenate([lengths[:, None].astype(np.uint64), matrix], 1)
    distinct, which = np.unique(keyed, axis=0, return_inverse=True)
    by = np.argsort(which, kind="stable")
    return Phrases(distinct[:, 1:], distinct[:, 0].astype(np.int64), np.searchsorted(which[by], np.arange(len(distinct) + 1)), item[by], [str(x) for x in names])


def find_phrases(hashes: np.ndarray, first: np.ndarray, phrases: Phrases, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, list[set[int]]]:
    """Hit words (flags) and the items found in each text.

    Shards overlap by a phrase less one word, so that texts longer than a shard are whole.
    """
    hit = np.zeros(len(hashes) + 1, np.int64)
    found: list[set[int]] = [set() for _ in range(len(first) - 1)]
    width = phrases.matrix.shape[1]
    for begin in range(0, len(hashes), shard_words):
        end = min(len(hashes), begin + shard_words + width - 1)
        cuts = np.unique(np.clip(first, begin, end)) - begin
        index = FMIndex(hashes[begin:end], cuts)
        lo, hi = index.search(phrases.matrix, phrases.lengths)
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        at = index.locate(rows) + begin
        np.add.at(hit, at, 1)
        np.add.at(hit, at + phrases.lengths[which], -1)
        text = np.searchsorted(first, at, "right") - 1
        for t, w in np.unique(np.stack([text, which], 1), axis=0):
            found[t].update(phrases.items[phrases.first[w] : phrases.first[w + 1]].tolist())
    return np.cumsum(hit[:-1]) > 0, found


RESULT = "struct<n_words: long, n_hit: long, spans: array<struct<start: long, stop: long>>, items: array<string>>"


def _search_udf(spark, phrases: Phrases):
    sent = spark.sparkContext.broadcast(phrases)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])

    @F.arrow_udf(RESULT)
    def search(text: pa.Array, former: pa.Array) -> pa.Array:
        out = []
        both = pa.RecordBatch.from_arrays([text, former], ["text", "former"])
        for part in slices(iter([both]), "text", SHARD_BYTES):
            words = find_words(*text_bytes(part.column("text")), ALPHANUMERIC)
            own = sent.value
            hit, found = find_phrases(words.hashes(), words.first, own)
            offsets = text_bytes(part.column("text"))[1]
            for row, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                items = {own.names[k] for k in found[row]}
                start, stop = words.start[a:b] - offsets[row], words.end[a:b] - offsets[row]
                flags, old = hit[a:b], part.column("former")[row].as_py()
                if old:
                    items |= set(old["items"])
                    flags = flags | _covered(start, old["spans"])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                spans = [{"start": int(start[x]), "stop": int(stop[y - 1])} for x, y in edges.reshape(-1, 2)]
                out.append({"n_words": int(b - a), "n_hit": int(flags.sum()), "spans": spans, "items": sorted(items)})
        return pa.array(out, kind)

    return search


def _covered(start: np.ndarray, spans: list[dict]) -> np.ndarray:
    begin = np.array([s["start"] for s in spans], np.int64)
    stop = np.array([s["stop"] for s in spans], np.int64)
    at = np.searchsorted(begin, start, "right") - 1
    return (at >= 0) & (start < stop[np.maximum(at, 0)]) if len(begin) else np.zeros(len(start), bool)


def with_contamination(docs: DataFrame, items: DataFrame, size: int = 13, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block: int = 500_000, result: str = "found") -> DataFrame:
    """Add the struct column ``found``: ``n_words, n_hit, spans, items``.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of all other
    non-ASCII characters. A window is ``size`` consecutive words of an item; an item of
    fewer is one window, one of none has none. ``spans`` are the merged UTF-8 byte ranges
    of the words that lie in any occurrence of a window, ``items`` the sorted ids of the
    items with occurrences. Null and empty texts have no words. Rows are neither dropped
    nor repeated and nothing is shuffled but the distinct windows. Windows are sent to the
    tasks in blocks of ``block``; spans of several blocks are merged row by row. A column
    called ``found`` is replaced. Null item ids count as the text "null".
    """
    spark = docs.sparkSession
    windows = windows_of(items.fillna("null", [item_column]) if dict(items.dtypes)[item_column] == "string" else items, size, item_column, item_text)
    windows = windows.withColumn("item", F.coalesce("item", F.lit("null")))
    total = windows.count()
    blocks = max(1, -(-total // block))
    out = docs.withColumn(result, F.lit(None).cast(RESULT))
    for k in range(blocks):
        part = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        search = _search_udf(spark, _phrases(part.toArrow(), size))
        out = out.withColumn(result, search(F.col(text_column), F.col(result)))
    return out


def contaminated(found: Column, share: int = 20) -> Column:
    """``n_hit > 0`` and at least 1 / ``share`` of the words."""
    return (found["n_hit"] > 0) & (share * found["n_hit"] >= found["n_words"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text with the spans cut out."""
    raw = text.cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.decode(F.substr(raw, (a + 1).cast("int"), (b - a).cast("int")), "utf-8"))
    return F.array_join(kept, "")
