"""SentencePiece models on the tokenizers library: encoding, decoding, parity.

The model protobuf is parsed field by field and rebuilt: normaliser, space marker,
unigram scores or BPE merges in score order, byte fallback. Texts of an Arrow batch are
encoded together by the library's threads.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from sensorium.llm.base import lists, slices, text_bytes
from sensorium.llm.words import byte_hashes

MARK = "▁"
#: Bytes of text that are encoded together.
BATCH_BYTES = 1_500_000
#: Most rows of an Arrow batch, set in the session.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
#: Threads of the library in each task, unless RAYON_NUM_THREADS is set.
THREADS = 2
#: Fixed values of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"no protobuf of this kind: wire type {kind}")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fewer_spaces: bool = True
    mark_spaces: bool = True
    suffix: bool = False


def parse(data: bytes) -> Model:
    """Read a ModelProto: pieces (1), trainer (2: 3 kind, 24 suffix, 35 byte fallback), normaliser (3)."""
    out = Model()
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            out.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(fields(value))
            out.kind, out.byte_fallback, out.suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(fields(value))
            out.charsmap = own.get(2, b"")
            out.dummy_prefix, out.fewer_spaces, out.mark_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
    return out


def build(model: Model) -> Tokenizer:
    """The same tokenizer on the tokenizers library. Its control pieces are never produced from text."""
    if model.suffix or model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the space marker in front are known")
    unknown = next((k for k, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    usable = (NORMAL, USER, UNUSED)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) if kind in (*usable, BYTE, UNKNOWN) else (p, -1e9) for p, s, kind in model.pieces], unknown, model.byte_fallback)
    else:
        vocabulary = {p: k for k, (p, _, _) in enumerate(model.pieces)}
        score = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        merges = [(-score[p], vocabulary[p], p[:k], p[k:]) for p in score for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        merges.sort()
        name = model.pieces[unknown][0] if unknown is not None else None
        core = models.BPE(vocab=vocabulary, merges=[(a, b) for _, _, a, b in merges], unk_token=name, fuse_unk=True, byte_fallback=model.byte_fallback, ignore_merges=False)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.fewer_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.mark_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.mark_spaces else " "))
    out.normalizer = normalizers.Sequence(steps)
    # no piece has the marker after another sign: texts may be cut before each run of markers,
    # which lets the library reuse words it has seen
    if all(MARK not in p.lstrip(MARK) for p, _, kind in model.pieces if kind in usable):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"(?<!{MARK}){MARK}"), "merged_with_next")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER]
    if own:
        out.add_tokens(own)
    return out


os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))


@lru_cache(4)
def load(path: str) -> tuple[Model, Tokenizer]:
    with open(path, "rb") as file:
        model = parse(file.read())
    return model, build(model)


@lru_cache(4)
def _bare(path: str) -> Tokenizer:
    """The tokenizer without its dummy prefix."""
    return build(replace(load(path)[0], dummy_prefix=False))


@lru_cache(4)
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each piece's bytes begin, how many they are, and all bytes."""
    model = load(path)[0]
    own = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
    size = np.array([len(x) for x in own], np.int64)
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(own), np.uint8)


def _segment_ids(tokenizer: Tokenizer, segments: list[str], together: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each segment, and all ids in a row.

    Segments that begin with a space and end with none are put together to longer texts,
    which the pre-tokeniser cuts at just these places, and encoded in one batch.
    """
    plain = [k for k, x in enumerate(segments) if x[0] == " " and x[-1] != " " and MARK not in x]
    other = sorted(set(range(len(segments))) - set(plain))
    order = np.array(plain + other, np.int64)
    sizes, parts = [], []
    groups = [plain[k : k + together] for k in range(0, len(plain), together)]
    for group, e in zip(groups, tokenizer.encode_batch(["".join(segments[k] for k in g) for g in groups], add_special_tokens=False), strict=True):
        sizes.append(np.bincount(e.word_ids, minlength=len(group)))
        parts.append(np.array(e.ids, np.int32))
    for e in tokenizer.encode_batch_fast([segments[k] for k in other], add_special_tokens=False):
        sizes.append(np.array([len(e.ids)]))
        parts.append(np.array(e.ids, np.int32))
    flat = np.concatenate([np.empty(0, np.int32), *parts])
    size = np.concatenate([np.empty(0, np.int64), *sizes])
    # back to the order of the segments
    begin = np.cumsum(size) - size
    by = np.argsort(order)
    size, begin = size[by], begin[by]
    place = np.cumsum(size) - size
    return size, flat[np.arange(len(flat)) - np.repeat(place, size) + np.repeat(begin, size)]


class Seen:
    """Segments that a worker has encoded, by 64-bit hash; begins anew at ``most`` segments.

    Two different segments of one worker share a hash with a chance below 1e-6.
    """

    def __init__(self, most: int = 300_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def knows(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, size: np.ndarray, more: np.ndarray) -> None:
        begin = np.cumsum(size) - size + len(self.flat)
        keys, begin, size = (np.concatenate(x) for x in ((self.keys, keys), (self.begin, begin), (self.size, size)))
        by = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.size, self.flat = keys[by], begin[by], size[by], np.concatenate([self.flat, more])

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return self.begin[at], self.size[at], self.flat


@lru_cache(4)
def _seen(path: str) -> Seen:
    return Seen()


def _separable(model: Model) -> bool:
    """No piece goes on after the start of a run of markers, and the normaliser only marks spaces."""
    free = all(MARK not in p.lstrip(MARK) and " " not in p for p, _, kind in model.pieces if kind in (NORMAL, USER, UNUSED))
    return free and model.mark_spaces and not model.charsmap and not model.fewer_spaces


def normalised(model: Model, text: str) -> str:
    """What decoding gives back: the text as the normaliser leaves it."""
    if model.charsmap:
        text = normalizers.Precompiled(model.charsmap).normalize_str(text)
    if model.fewer_spaces:
        text = " ".join(x for x in text.split(" ") if x)
    return text


class Codec:
    """A model on the executors: the file is sent by Spark, so any path the driver can open will do."""

    def __init__(self, spark, path: str) -> None:
        self.name = os.path.basename(path)
        # ids and texts of a batch are in memory together
        if int(spark.conf.get(BATCH_KEY)) > BATCH_ROWS:
            spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
        spark.sparkContext.addFile(path)

    def path(self) -> str:
        return SparkFiles.get(self.name)

    def tools(self) -> tuple[Model, Tokenizer]:
        return load(self.path())

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null and empty texts have none.

        Where no piece and no rule of the normaliser reaches over the start of a run of
        spaces, texts are cut there and each different segment is encoded once.
        """
        model, tokenizer = self.tools()
        if not _separable(model):
            ids = self.encode_batch([t or "" for t in texts.to_pylist()])
            return lists(np.fromiter((x for d in ids for x in d), np.int32, sum(map(len, ids))), [len(d) for d in ids], pa.int32())
        raw, offsets = text_bytes(texts)
        space = raw == 0x20
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[3:-1] &= ~((raw[:-3] == 0xE2) & (raw[1:-2] == 0x96) & (raw[2:-1] == 0x81))
        cut[offsets] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(raw))
        # the first segment of a text has the dummy prefix, so it is another segment
        first = np.isin(start, offsets)
        lead = model.dummy_prefix & first
        keys = byte_hashes(raw, start, end) + lead
        seen = _seen(self.path())
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        new = one[~seen.knows(keys[one])]
        own = [(" " if lead[k] else "") + raw[start[k] : end[k]].tobytes().decode() for k in new]
        seen.add(keys[new], *_segment_ids(_bare(self.path()), own))
        begin, sizes, flat = seen.of(keys[one])
        count = sizes[which]
        place = np.cumsum(count) - count
        out = flat[np.arange(int(count.sum())) - np.repeat(place, count) + np.repeat(begin[which], count)]
        ends = np.append(place, count.sum())[np.searchsorted(start, offsets)]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; an empty text has none."""
        model, tokenizer = self.tools()
        out = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids if t else [] for e, t in zip(out, texts, strict=True)]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of ids, null for null, by the bytes of each piece: marker to space, byte pieces to their byte, fused.

        Byte pieces that make no valid UTF-8 leave the text to the library.
        """
        starts, sizes, raw = _piece_bytes(self.path())
        dummy = self.tools()[0].dummy_prefix
        texts = []
        for at in range(0, len(ids), 256):
            part = ids.slice(at, min(256, len(ids) - at))
            flat = part.flatten().to_numpy(zero_copy_only=False)
            count = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            length = sizes[flat]
            place = np.cumsum(length) - length
            data = raw[np.arange(int(length.sum())) - np.repeat(place, length) + np.repeat(starts[flat], length)].tobytes()
            ends = np.append(place, len(data))[np.append(0, np.cumsum(count))]
            for row, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if not part[row].is_valid:
                    texts.append(None)
                    continue
                try:
                    text = data[a:b].decode()
                    texts.append(text[1:] if dummy and text.startswith(" ") else text)
                except UnicodeDecodeError:
                    texts += self.decode_batch([part[row].as_py()])
        return pa.array(texts, pa.string())

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids: control pieces are dropped, the first space is that of the dummy prefix."""
        model, tokenizer = self.tools()
        drop = {k for k, (_, _, kind) in enumerate(model.pieces) if kind in (CONTROL,)}
        texts = tokenizer.decode_batch([[x for x in own if x not in drop] for own in ids], skip_special_tokens=False)
        return [t[1:] if model.dummy_prefix and t.startswith(" ") else t for t in texts]


def with_pieces(docs: DataFrame, path: str, text_column: str = "text", result: str = "ids") -> DataFrame:
    """Add the ids of each whole text. Null texts have null ids, empty texts none. Nothing is shuffled; a column of that name is replaced."""
    codec = Codec(docs.sparkSession, path)
    at = docs.columns.index(text_column)
    names = [c for c in docs.columns if c != result] + [result]
    keep = [k for k, c in enumerate(docs.columns) if c != result]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch.rename_columns([f"_{k}" for k in range(batch.num_columns)])]), f"_{at}", BATCH_BYTES):
                own = part.column(at)
                ids = codec.encode(own)
                if own.null_count:
                    ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=own.is_null())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), ids], names)

    fields_ = [docs.schema.fields[k] for k in keep]
    return docs.mapInArrow(run, StructType([*fields_, StructField(result, ArrayType(IntegerType()))]))


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> Column:
    """The text of ids; null for null."""
    codec = Codec(docs.sparkSession, path)

    @F.arrow_udf("string")
    def decode(own: pa.Array) -> pa.Array:
        return codec.decode(own)

    return decode(F.col(ids))
