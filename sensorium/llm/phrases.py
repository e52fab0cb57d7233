"""Phrases whose words stand together more often than their parts stand alone.

Words that are frequent in their language get dense numbers; only they can be part of a
frequent phrase. Packed word numbers of 2 to 4 words are counted in quotient filters: an
invertible permutation (a Feistel network on the two halves) spreads the packed numbers
evenly, the high bits (the quotient) are kept as positions, the other bits (the
remainder) in full, so that a filter is small and still tells all phrases apart. Filters
are sorted by permuted number; those of several shards are merged segment by segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorium.llm.base import Scratch, pick, slices, text_bytes
from sensorium.llm.words import find_words, mix
from sensorium.plans.lane import Lane

#: Bytes that end a piece, and bytes of words.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False
#: Bytes of text that are cut into words at once, and whose words share one dictionary.
RUN_BYTES, CHUNK_BYTES = 2_000_000, 8_000_000
#: Words that a segment of all filters is meant for.
SEGMENT = 4_000_000
#: Words of a row of word codes.
RUN = 500_000
#: Bits that part the numbers of a filter into shares, which are merged one after the other.
SHARE_BITS = 3
ROUNDS = 4
U = np.uint64


@dataclass(frozen=True)
class Packing:
    """Packed numbers of ``length`` words of ``bits`` bits each: two halves, permuted together."""

    length: int
    bits: int

    @property
    def left_bits(self) -> int:
        return (self.length + 1) // 2 * self.bits

    @property
    def right_bits(self) -> int:
        return self.length // 2 * self.bits

    def _turn(self, left: np.ndarray, right: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        whole = [U((1 << k) - 1) for k in (self.left_bits, self.right_bits)]
        for r in reversed(range(2 * ROUNDS)) if back else range(2 * ROUNDS):
            salt = U(0x9E3779B97F4A7C15 * (r + 1) & 2**64 - 1)
            if r % 2 == 0:
                left = left ^ (mix(right + salt) & whole[0])
            else:
                right = right ^ (mix(left + salt) & whole[1])
        return left, right

    def permute(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Halves of the permuted numbers; ``words`` holds one array per place."""
        half = (self.length + 1) // 2
        packed = []
        for part in (words[:half], words[half:]):
            n = np.zeros(len(words[0]), U)
            for w in part:
                n = (n << U(self.bits)) | w.astype(U)
            packed.append(n)
        return self._turn(*packed, back=False)

    def words(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        """The words again."""
        half = (self.length + 1) // 2
        out = []
        for n, count in zip(self._turn(left, right, back=True), (half, self.length - half), strict=True):
            out += [(n >> U(self.bits * k)) & U((1 << self.bits) - 1) for k in reversed(range(count))]
        return [w.astype(np.int64) for w in out]


@dataclass
class Filter:
    """A sorted counting quotient filter of one segment: permuted numbers and their counts."""

    packing: Packing
    left: np.ndarray
    right: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, packing: Packing, left: np.ndarray, right: np.ndarray, count: np.ndarray) -> Filter:
        """Sort, and add up the counts of equal numbers."""
        if packing.left_bits + packing.right_bits <= 64:
            # runs that are sorted already are merged, not sorted again
            key = (left << U(packing.right_bits)) | right
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
        else:
            order = np.lexsort((right, left))
            a, b = left[order], right[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(count[order], first) if len(first) else count[:0]
        return cls(packing, left[order][first], right[order][first], total)

    @staticmethod
    def merged(filters: list[Filter]) -> Filter:
        if len(filters) == 1:
            return filters[0]
        return Filter.of(filters[0].packing, *(np.concatenate([getattr(f, n) for f in filters]) for n in ("left", "right", "count")))

    @staticmethod
    def shares(filters: list[Filter], low: int, bits: int, start: int = 0) -> Iterator[Filter]:
        """All filters merged, one share of their numbers after the other: 2^``bits`` of them from ``start`` on, each of 2^``low`` first halves."""
        edges = U(start) + (np.arange((1 << bits) + 1, dtype=U) << U(low))
        cuts = [np.searchsorted(f.left, edges) for f in filters]
        for k in range(1 << bits):
            own = [(f, slice(at[k], at[k + 1])) for f, at in zip(filters, cuts, strict=True) if at[k] < at[k + 1]]
            if own:
                yield Filter.merged([Filter(f.packing, f.left[at], f.right[at], f.count[at]) for f, at in own])

    def segments(self, segment_bits: int) -> Iterator[tuple[int, Filter]]:
        """The filter cut at the first bits."""
        key = self.left >> U(self.packing.left_bits - segment_bits)
        edge = np.searchsorted(key, np.arange((1 << segment_bits) + 1, dtype=U))
        for k in np.flatnonzero(np.diff(edge)):
            at = slice(edge[k], edge[k + 1])
            yield int(k), Filter(self.packing, self.left[at], self.right[at], self.count[at])

    def write(self, segment_bits: int) -> bytes:
        """Quotients as two bit rows (which occur, where a run of equal ones ends), remainders in full, counts above 1 apart."""
        m = len(self.left)
        low = self.packing.left_bits - segment_bits
        q = min(max(m, 1).bit_length(), low)
        rest = low - q
        quotient = ((self.left >> U(rest)) & U((1 << q) - 1)).astype(np.int64)
        occurs = np.zeros(1 << q, bool)
        occurs[quotient] = True
        last = np.ones(m, bool)
        last[:-1] = quotient[1:] != quotient[:-1]
        many = self.count > 1
        big = self.count >= 255
        parts = [np.array([m, q, int(big.sum())], "<u8"), np.packbits(occurs), np.packbits(last), np.packbits(many)]
        for bits, value in self._remainders(rest):
            parts.append(value.astype("<u8").view(np.uint8).reshape(m, 8)[:, : -(-bits // 8)])
        parts += [np.minimum(self.count[many], 255).astype(np.uint8), self.count[big].astype("<u8")]
        return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    def _remainders(self, rest: int) -> list[tuple[int, np.ndarray]]:
        left, right = self.left & U((1 << rest) - 1), self.right
        if rest + self.packing.right_bits <= 64:
            return [(rest + self.packing.right_bits, (left << U(self.packing.right_bits)) | right if rest else right)]
        return [(rest, left), (self.packing.right_bits, right)]

    @classmethod
    def read(cls, packing: Packing, segment: int, segment_bits: int, body: bytes) -> Filter:
        data = np.frombuffer(body, np.uint8)
        m, q, big = (int(v) for v in data[:24].view("<u8"))
        at = 24

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return data[at - size : at]

        occurs = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
        last = np.unpackbits(take(-(-m // 8)), count=m).astype(bool)
        many = np.unpackbits(take(-(-m // 8)), count=m).astype(bool)
        run = np.zeros(m, np.int64)
        run[1:] = np.cumsum(last)[:-1]
        low = packing.left_bits - segment_bits
        rest = low - q

        def value(bits: int) -> np.ndarray:
            wide = np.zeros((m, 8), np.uint8)
            size = -(-bits // 8)
            wide[:, :size] = take(m * size).reshape(m, size)
            return wide.reshape(-1).view("<u8").astype(U)

        if rest + packing.right_bits <= 64:
            both = value(rest + packing.right_bits)
            left = both >> U(packing.right_bits) if rest else np.zeros(m, U)
            right = both & U((1 << packing.right_bits) - 1)
        else:
            left, right = value(rest), value(packing.right_bits)
        left = left | (occurs[run].astype(U) << U(rest)) | (U(segment) << U(low))
        count = np.ones(m, np.int64)
        few = take(int(many.sum())).astype(np.int64)
        few[few == 255] = take(8 * big).view("<u8").astype(np.int64)
        count[many] = few
        return cls(packing, left, right, count)


def coded(docs: DataFrame) -> DataFrame:
    """Texts as codes of their words, and the words of each chunk with their counts.

    Rows ``chunk, code, lang, word, n, body``: a word of a language in the chunk (``body`` null), or a
    run of the chunk's codes, three or four bytes each, with the lowest bit set where a piece begins.
    """
    names = ["chunk", "code", "lang", "word", "n", "body"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        bytes_held = 0
        for batch in slices(rows, "text", RUN_BYTES):
            part = word_codes(batch)
            bytes_held += batch.column("text").nbytes
            if part is not None:
                held.append(part)
            if held and bytes_held >= CHUNK_BYTES:
                yield from close(chunk, held)
                chunk, held, bytes_held = chunk + 1, [], 0
        if held:
            yield from close(chunk, held)

    def close(chunk: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        # the runs' words of each language, numbered together
        langs = pa.chunked_array([p[0] for p in held]).combine_chunks().dictionary_encode()
        words = pa.chunked_array([p[1] for p in held]).combine_chunks().dictionary_encode()
        wide = len(words.dictionary)
        pair = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + words.indices.to_numpy(zero_copy_only=False)
        pair, place = np.unique(pair, return_inverse=True)
        m = len(pair)
        places = np.split(place, np.cumsum([len(p[0]) for p in held])[:-1])
        codes = np.concatenate([at[p[2]].astype(np.uint32) * 2 + p[3] for p, at in zip(held, places, strict=True)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m, chunk)),
                pa.array(np.arange(m)),
                langs.dictionary.take(pa.array(pair // wide)),
                words.dictionary.take(pa.array(pair % wide)).cast(pa.binary()),
                pa.array(np.bincount(codes >> 1, minlength=m)),
                pa.nulls(m, pa.binary()),
            ],
            names,
        )
        size = 3 if m < 1 << 23 else 4
        flat = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size])
        # each run begins with the words before it that may start a phrase
        bodies = [bytes([size, min(3, s)]) + flat[max(0, s - 3) : s + RUN].tobytes() for s in range(0, len(codes), RUN)]
        k = len(bodies)
        empty = [pa.nulls(k, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), *empty, pa.array(bodies, pa.binary())], names)

    return docs.mapInArrow(run, "chunk long, code long, lang string, word binary, n long, body binary")


def word_codes(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray] | None:
    """Language and spelling of the distinct words, each word's place among them, and where pieces begin."""
    raw, offsets = text_bytes(batch.column("text"))
    words = find_words(raw, offsets, WORD)
    size = words.end - words.start
    if not len(size):
        return None
    ends = np.concatenate([[0], np.cumsum(ENDS[raw])])
    new = np.ones(len(size), bool)
    new[1:] = (words.row[1:] != words.row[:-1]) | (ends[words.start[1:]] > ends[words.end[:-1]])
    places = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    spelled = pa.Array.from_buffers(pa.large_binary(), len(size), [None, places, pa.py_buffer(words.text[WORD[raw]])]).dictionary_encode()
    langs = batch.column("lang").cast(pa.string()).dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.row]
    wide = len(spelled.dictionary)
    pair, code = np.unique(lang * wide + spelled.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    return langs.dictionary.take(pa.array(pair // wide)), spelled.dictionary.take(pa.array(pair % wide)), code.astype(np.int32), new


def phrases_of(body: bytes, number: np.ndarray, packing: Packing) -> Filter:
    """The phrases of a run of codes whose words have numbers above 0."""
    wide, lent = body[0], body[1]
    data = np.frombuffer(body, np.uint8, offset=2).reshape(-1, wide)
    flat = np.zeros((len(data), 4), np.uint8)
    flat[:, :wide] = data
    flat = flat.reshape(-1).view("<u4")
    own = flat >> 1
    word = np.where(own < len(number), number[np.minimum(own, len(number) - 1)], 0)
    piece = np.cumsum(flat & 1, dtype=np.uint32)
    # phrases that end in the words before the run belong to the run before
    first = np.arange(max(packing.length - 1, lent) - packing.length + 1, len(word) - packing.length + 1)
    good = piece[first] == piece[first + packing.length - 1]
    for k in range(packing.length):
        good &= word[first + k] > 0
    first = first[good]
    keys = packing.permute([word[first + k] for k in range(packing.length)])
    return Filter.of(packing, *keys, np.ones(len(first), np.int64))


def phrase_filters(runs: DataFrame, numbers: DataFrame, most: int, bits: int, segment_bits: int, parts: int) -> DataFrame:
    """Filters ``length, segment, body`` of each chunk's phrases of frequent words."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        code = right.column("code").to_numpy()
        number = np.zeros(int(code.max(initial=0)) + 1, np.int64)
        number[code] = right.column("number").to_numpy()
        out = []
        # one length after the other: only its filters are held
        for length in range(2, most + 1):
            packing = Packing(length, bits)
            filters = [phrases_of(body, number, packing) for body in left.column("body").to_pylist()]
            share_bits = min(SHARE_BITS, segment_bits)
            for share in Filter.shares(filters, packing.left_bits - share_bits, share_bits):
                out += [(length, s, f.write(segment_bits)) for s, f in share.segments(segment_bits)]
        kinds = (pa.int32(), pa.int32(), pa.binary())
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["length", "segment", "body"])

    left, right = runs.repartition(parts, "chunk").groupBy("chunk"), numbers.repartition(parts, "own").groupBy("own")
    return left.cogroup(right).applyInArrow(count, "length int, segment int, body binary")


def frequent(rows: Iterator[pa.RecordBatch], bits: int, segment_bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of at least ``least`` occurrences from filters in order of length and segment; one segment is held at a time."""
    bodies = ((tuple(batch.column(c)[k].as_py() for c in ("length", "segment")), batch.column("body")[k].as_buffer()) for batch in rows for k in range(batch.num_rows))
    for (length, segment), group in groupby(bodies, key=lambda b: b[0]):
        packing = Packing(length, bits)
        held = [Filter.read(packing, segment, segment_bits, body) for _, body in group]
        low = packing.left_bits - segment_bits
        share_bits = min(SHARE_BITS, low)
        for f in Filter.shares(held, low - share_bits, share_bits, segment << low):
            often = f.count >= least
            if often.any():
                words = np.stack(packing.words(f.left[often], f.right[often]), 1)
                offsets = np.arange(len(words) + 1, dtype=np.int32) * length
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel())), pa.array(f.count[often])], ["words", "f"]
                )


def merged_counts(filters: DataFrame, bits: int, segment_bits: int, least: int) -> DataFrame:
    """Phrases ``words array<long>, f`` of at least ``least`` occurrences: filters merged by segment."""
    parts = max(int(filters.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << segment_bits)
    # a task meets its segments one after the other
    dealt = filters.repartition(parts, "length", "segment").sortWithinPartitions("length", "segment")
    return dealt.mapInArrow(lambda rows: frequent(rows, bits, segment_bits, least), "words array<long>, f long")


def judged(counts: DataFrame) -> DataFrame:
    """Candidates ``words, a, l, r, score`` by their lowest-scoring cut, without those that longer ones explain."""
    cuts = counts.where(F.size("words") > 1).select("words", F.col("f").alias("a"), F.posexplode(F.sequence(F.lit(1), F.size("words") - 1)).alias("_", "k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", 1, F.col("k")).alias("_first"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("_rest"))
    first = counts.select(F.col("words").alias("_first"), F.col("f").alias("l"))
    rest = counts.select(F.col("words").alias("_rest"), F.col("f").alias("r"))
    cuts = cuts.join(first, "_first").join(rest, "_rest")
    # 2,000,000 a may pass 64 bits; l + r is at least 2 a, so the quotient does not
    exact = "cast(2000000 * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0))) AS long)"
    cuts = cuts.withColumn("score", F.expr(exact))
    best = cuts.groupBy("words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    best = best.select("words", *[F.col(f"b.{c}").alias(c) for c in ("a", "l", "r", "score")])
    long = counts.where(F.size("words") > 2)
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: F.slice("words", at, size)),
        )
    )
    longer = long.select(F.explode(inside).alias("words"), "f").groupBy("words").agg(F.max("f").alias("_longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    best = best.join(longer, "words", "left")
    return best.where(F.col("_longer").isNull() | (100 * wide("_longer") < 80 * wide("a"))).drop("_longer")


def mine(docs: DataFrame, least: int = 30, most: int = 4, top: int = 2000, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases have 2 to ``most`` words and occur ``least`` times or more within pieces. Null texts are empty,
    a null language is ``und``; texts are lower-cased (A-Z). Equal scores go to the larger ``a``, then to the
    smaller phrase in byte order. Repeated rows count each time; an empty table, or one without frequent
    phrases, gives no rows; other columns are not looked at.

    Words meet their numbers chunk by chunk in a join, and only filters are shuffled
    after that: nothing that grows with the corpus is broadcast or gathered.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = pick(docs, text=text_column, lang=lang_column)
    rows = rows.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    written = scratch.keep(coded(rows))
    words = written.where("body IS NULL").select("chunk", "code", "lang", "word", "n")
    counts = scratch.keep(words.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"), F.count_if(F.col("f") >= least).alias("_often"))
    total = sizes.agg(F.sum("n").alias("n"), F.sum("_often").alias("often")).first()
    often = int(total["often"] or 0)
    numbered = Lane(counts.where(F.col("f") >= least), [], ["lang", "word"], often).numbered("number").done()
    numbered = scratch.keep(numbered)
    bits = max(often.bit_length(), 4)
    segment_bits = min(max(int(total["n"] or 0) // SEGMENT, 1).bit_length(), bits)
    runs = written.where("body IS NOT NULL").select("chunk", "body")
    chunks = written.where("code = 0").count()
    parts = max(min(chunks, 200), chunks // 8, 1)
    own = words.join(numbered.drop("f"), ["lang", "word"]).select(F.col("chunk").alias("own"), "code", "number")
    filters = phrase_filters(runs, own, most, bits, segment_bits, parts)
    merged = merged_counts(filters, bits, segment_bits, least)
    single = numbered.select(F.array("number").alias("words"), "f")
    best = scratch.keep(judged(scratch.keep(single.unionByName(merged))))
    spelled = best.select("words", F.posexplode("words").alias("at", "number")).join(numbered.drop("f"), "number")
    spelled = spelled.groupBy("words").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("w")))).alias("_w"))
    found = best.join(spelled, "words").withColumn("phrase", F.array_join("_w.w", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes.drop("_often"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
