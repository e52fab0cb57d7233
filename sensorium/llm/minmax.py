"""Near-duplicate groups by min-max hashing.

Each permutation of the shingles keeps its smallest and its largest value, so ``p``
permutations give ``2 p`` signature values. Bands of them choose candidates; every
link is confirmed on the full shingle sets. Groups are the connected components.

A bucket never lists its pairs. A round compares its members with one hub (the
member that shares most buckets), merges what is linked and drops the hub, since all
its pairs are settled. What remains is pruned by exact bounds: shingles that no other
remaining text has cannot be shared, so ``|A & B|`` is at most the smaller count of the
others, also when they are counted cell by cell of their hash. Only pairs of different
components that pass the bounds are listed and confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.llm.base import Scratch, lists, pick, slices, text_bytes
from sensorium.llm.words import NOT_SPACE, find_words, mix

PERMUTATIONS = 80
ROWS_PER_BAND = 5
SEED = 20240501
_SEEDS = np.random.default_rng(SEED)
_TIMES = _SEEDS.integers(0, 2**32, 512, dtype=np.uint32) | np.uint32(1)
_PLUS = _SEEDS.integers(0, 2**32, 512, dtype=np.uint32)
_PLACE = _SEEDS.integers(0, 2**62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row; fewer than ``size`` words are one shingle."""
    words = find_words(text, offsets, NOT_SPACE)
    h, counts = words.hashes(), words.counts()
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        rolled += h[k : k + len(rolled)] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for row, n in enumerate(counts):
        a = words.first[row]
        if n >= size:
            out.append(np.unique(rolled[a : a + n - size + 1]))
        elif n:
            whole = h[a : a + n] * _PLACE[:n]
            out.append(mix(whole.sum(keepdims=True) + _PLACE[n + size : n + size + 1]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def min_max(grams: np.ndarray, permutations: int, block: int = 1024) -> np.ndarray:
    """Smallest and largest value of each permutation, side by side: 2 x permutations values."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    times, plus = _TIMES[:permutations, None], _PLUS[:permutations, None]
    least, most = np.full(permutations, 2**32 - 1, np.uint32), np.zeros(permutations, np.uint32)
    for at in range(0, len(x), block):
        y = x[None, at : at + block] * times + plus
        np.minimum(least, y.min(1), out=least)
        np.maximum(most, y.max(1), out=most)
    return np.stack([least, most], 1).ravel()


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values; the band's number is part of it."""
    bands = signatures.shape[1] // rows
    cells = signatures[:, : bands * rows].astype(np.uint64).reshape(len(signatures), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), bands)).copy()
    for k in range(rows):
        h = mix(h ^ (cells[:, :, k] * _PLACE[k]))
    return h


def fingerprints(sets: list[np.ndarray]) -> list[bytes]:
    """128-bit names of shingle sets: two independent sums over their members."""
    return [
        np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _PLACE[9]).sum(dtype=np.uint64)], np.uint64).tobytes() if len(s) else b"" for s in sets
    ]


def _signed(df: DataFrame, size: int, permutations: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*text_bytes(batch.column("text")), size)
            some = [s for s in sets if len(s)]
            keys = band_keys(np.stack([min_max(s, permutations) for s in some]), rows) if some else np.empty((0, 0), np.uint64)
            counts = [keys.shape[1] if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fingerprints(sets), pa.binary()), lists(keys.ravel().view(np.int64), counts, pa.int64())],
                ["id", "n", "print", "bands"],
            )

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n long, print binary, bands array<long>")


def _membership(scratch: Scratch, ids: DataFrame, words: int = 1 << 20) -> np.ndarray:
    """A Bloom filter of the hashes in ``h``, of fixed size: 2^26 bits, 8 MB."""
    word = F.pmod("h", F.lit(words)).alias("word")
    table = ids.groupBy(word).agg(F.bit_or(F.expr("1L << cast((h >> 40) & 63 as int)")).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _members(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[h % len(bits)] >> ((h >> 40) & 63).astype(np.uint64)) & np.uint64(1) != 0


def _with_sets(df: DataFrame, size: int, member: np.ndarray) -> DataFrame:
    """``id, print, grams`` of the rows whose hash ``h`` may be a member; other texts stay where they are."""
    sent = df.sparkSession.sparkContext.broadcast(member)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            h = whole.column("h").to_numpy()
            at = np.flatnonzero(_members(sent.value, h))
            for batch in slices(iter([whole.take(pa.array(at))]), "text"):
                sets = shingle_sets(*text_bytes(batch.column("text")), size)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(fingerprints(sets), pa.binary()), lists(flat, [len(s) for s in sets], pa.int64())], ["id", "print", "grams"]
                )

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, print binary, grams array<long>")


def _cells(df: DataFrame, cells: int = 64) -> DataFrame:
    """Counts of the shingles not in ``lone``, by cell of the hash: ``node, size, c, cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grams, lone in zip(batch.column("grams"), batch.column("lone"), strict=True):
                own = grams.values.to_numpy()
                shared = np.setdiff1d(own, lone.values.to_numpy(), assume_unique=True) if lone.is_valid else own
                out.append((len(own), len(shared), np.bincount(shared & (cells - 1), minlength=cells)))
            size, c, cell = zip(*out, strict=True) if out else ((), (), ())
            flat = np.concatenate(cell) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(size, pa.int32()), pa.array(c, pa.int32()), lists(flat, [cells] * len(out), pa.int32())],
                ["node", "size", "c", "cells"],
            )

    return df.select("node", "grams", "lone").mapInArrow(run, "node long, size int, c int, cells array<int>")


def linked(common: Column, a: Column, b: Column, share: int) -> Column:
    """100 x intersection >= share x union."""
    return 100 * common >= share * (a + b - common)


class Groups:
    """Connected components kept as a table (node, label); merged by min-label contraction."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.labels = scratch, None

    def on(self, df: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
        if self.labels is None:
            return df.withColumn(label, F.col(node))
        own = self.labels.select(F.col("node").alias(node), F.col("label").alias(label))
        return df.join(own, node, "left").withColumn(label, F.coalesce(label, node))

    def merge(self, edges: DataFrame) -> None:
        """``edges``: a, b (nodes). Costs a logarithmic number of rounds over the edges still between components."""
        keep = self.scratch.keep
        edges = keep(self.on(self.on(edges, "a", "u"), "b", "v").select("u", "v").filter("u <> v").distinct())
        while not edges.isEmpty():
            both = edges.union(edges.select("v", "u")).toDF("u", "v")
            step = keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")))
            # one jump: the target's own target; targets without edges stay
            jump = keep(step.join(step.select(F.col("u").alias("to"), F.col("to").alias("far")), "to", "left").select("u", F.coalesce("far", "to").alias("to")))
            if self.labels is None:
                labels = jump.select(F.col("u").alias("node"), F.col("to").alias("label"))
            else:
                moved = jump.select(F.col("u").alias("label"), "to")
                old = self.labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
                fresh = jump.select(F.col("u").alias("node"), F.col("to").alias("label")).join(self.labels, "node", "left_anti")
                labels = old.union(fresh)
            self.labels = keep(labels)
            a = jump.select("u", F.col("to").alias("x"))
            b = jump.select(F.col("u").alias("v"), F.col("to").alias("y"))
            edges = keep(edges.join(a, "u").join(b, "v").select(F.col("x").alias("u"), F.col("y").alias("v")).filter("u <> v").distinct())


def near_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 5,
    share: int = 80,
    permutations: int = PERMUTATIONS,
    rows: int = ROWS_PER_BAND,
    hub_until: int = 1_000_000,
) -> DataFrame:
    """Near-duplicate class of every row: ``doc_id, n_shingles, component_id, kept``.

    A text's set holds its distinct shingles of ``words`` white-space separated words
    (A-Z lower-cased); a shorter text is one shingle, an empty or null text has none and
    is linked with nothing. Texts are linked if ``100 |A & B| >= share |A | B|``. With 80
    permutations (160 values, 32 bands of 5) a pair at exactly 0.8 is missed with
    probability 3e-6. Rows of equal sets are one node, however many they are; repeated
    rows all get its class. A class is named by its smallest id. Null ids never name a
    class that has other ids; where all ids are null, ``component_id`` is null and every
    row is kept. Other columns are ignored. An empty table gives an empty result.

    ``hub_until``: while more bucket rows than this are unsettled and the last hub round
    merged something, another one runs; results do not depend on it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keep = scratch.keep
    texts = pick(docs, id=id_column, text=text_column)
    signed = keep(_signed(texts, words, permutations, rows))
    reps = keep(
        signed.filter("n > 0")
        .groupBy("print")
        .agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    groups = Groups(scratch)

    # buckets of two texts or more
    spread = reps.select("node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    shared = keep(spread.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"))
    inside = keep(spread.join(shared, "bucket"))

    wanted = keep(inside.select("node").distinct())
    hashed = F.xxhash64(F.col("id").cast("string")).alias("h")
    owners = keep(reps.join(wanted, "node").select("node", F.col("least").alias("id"), F.col("print").alias("own")))
    found = _with_sets(texts.select("id", "text", hashed), words, _membership(scratch, owners.select(hashed)))
    same = found["id"].eqNullSafe(owners["id"]) & (found["print"] == owners["own"])
    sets = keep(found.join(owners, same).select("node", "grams").dropDuplicates(["node"]))

    def confirm(pairs: DataFrame) -> None:
        """``pairs``: a, b, distinct. Merge those that are linked on their full sets."""
        left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
        both = keep(pairs).join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("x", "y"))
        groups.merge(keep(both.filter(linked(common, F.size("x"), F.size("y"), share)).select("a", "b")))

    def compatible(a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= share * F.greatest(a, b)

    active = inside.select("bucket", "node", "n", F.col("node").alias("label"))
    before = None
    while True:
        sizes = keep(active.groupBy("bucket").agg(F.count("*").alias("m")))
        weight = keep(active.join(sizes, "bucket").groupBy("node").agg(F.sum("m").alias("w")))
        weighed = keep(active.join(weight, "node"))
        top = F.max(F.struct("w", F.negative("node").alias("h"), F.col("n").alias("hn"), F.col("label").alias("hl"))).alias("top")
        hubs = keep(weighed.groupBy("bucket").agg(top).select("bucket", F.negative("top.h").alias("hub"), "top.hn", "top.hl"))
        met = keep(weighed.join(hubs, "bucket").filter("node <> hub"))
        confirm(met.filter((F.col("label") != F.col("hl")) & compatible("n", "hn")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
        # the hub's pairs are settled; buckets of one component are done
        active = keep(_open(keep, keep(groups.on(met.select("bucket", "node", "n")))))
        members, labels = active.agg(F.count("*"), F.countDistinct("label")).first()
        if members <= hub_until or labels == before:
            break
        before = labels

    # shingles that no other remaining text has cannot be shared; the rest is counted in cells
    texts_left = keep(keep(active.select("node").distinct()).join(sets, "node"))
    seen = texts_left.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("seen"), F.min("node").alias("node"))
    lone = keep(seen.filter("seen = 1").groupBy("node").agg(F.collect_list("gram").alias("lone")))
    counted = keep(_cells(texts_left.join(lone, "node", "left")).filter(100 * F.col("c") >= share * F.col("size")).select("node", "c", "cells"))
    active = keep(_open(keep, keep(active.join(counted, "node"))))
    other = active.select("bucket", *[F.col(x).alias(f"{x}2") for x in ("node", "n", "c", "cells", "label")])
    total = share * (F.col("n") + F.col("n2"))
    cellwise = F.aggregate(F.zip_with("cells", "cells2", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    # linked means (100 + share) |A & B| >= share (|A| + |B|), and both sums bound |A & B|
    fits = (F.col("label") < F.col("label2")) & compatible("n", "n2") & ((100 + share) * F.least("c", "c2") >= total)
    pairs = active.join(other, "bucket").filter(fits).filter((100 + share) * cellwise >= total)
    confirm(pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct())

    named = groups.on(reps.select("node", "least", "print"))
    joined = keep(named.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("texts")))
    names = keep(named.join(joined, "label").select("print", "component"))
    out = signed.select("id", "n", "print").join(names, "print", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _open(keep, members: DataFrame) -> DataFrame:
    """Rows of buckets that still hold more than one component."""
    mixed = keep(members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket"))
    return members.join(mixed, "bucket")


def drop_copies(docs: DataFrame, id_column: str = "doc_id", **options: object) -> DataFrame:
    """Keep the row with the smallest id of each class; repeated rows of that id and text stay once.

    Rows without an id cannot be named and all stay.
    """
    scratch = Scratch(docs.sparkSession)
    classes = near_groups(docs, id_column=id_column, **options)
    ids = scratch.keep(classes.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count("*").alias("rows")))
    text = options.get("text_column", "text")
    hashed = F.xxhash64(F.col("doc_id").cast("string")).alias("h")
    sent = docs.sparkSession.sparkContext.broadcast(_membership(scratch, ids.filter("kept <> 1 or rows <> 1").select(hashed)))

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(_members(sent.value, h.to_numpy(zero_copy_only=False)))

    # only texts whose id may be no single kept row are joined; the others stay in their tasks
    open_ = maybe(F.xxhash64(F.col(id_column).cast("string"))) & F.col(id_column).isNotNull()
    rest = docs.filter(open_)
    by_id = lambda own: rest.join(own.select(F.col("doc_id").alias(id_column)), id_column, "left_semi").select(*docs.columns)
    one, more = ids.filter("kept = 1"), ids.filter("kept > 1")
    return docs.filter(~open_).union(by_id(one)).union(by_id(more).dropDuplicates([id_column, text]))
