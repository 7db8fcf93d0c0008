"""Substring dedup: a count-min prefilter, then exact groups of the windows that it estimates repeated.

Pass 1: each task sketches its windows (documents that hold them, so a window repeated in one document counts once)
and the partition sketches are added up, shard by shard. Only the bits "two or more" are kept. Count-min never
estimates too low, so no repeated window is lost. Pass 2: windows whose cells all say "two or more" are grouped
exactly, by 96 bits of their word sequence. Within a task the smallest document of each window is known to beat the
others, so a task sends one row for a window however many documents hold it, and a passage shared by a third of all
documents makes no hot group. Pass 3 joins the repeated windows of each document to its text and removes their words.

The merged bits are the one thing that is broadcast. Their number follows the input up to MAX_CELLS; beyond that the
sketch lets more windows through to the exact groups and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, bounded_batches, free_shuffles, mix, slices, windows, word_hashes

K = 13
DEPTH = 2
#: Cells in a row of the sketch: two for each window, 2**28 at most (64 MB of bits for both rows).
MIN_CELLS, MAX_CELLS, SHARD = 1 << 20, 1 << 28, 1 << 20
#: Windows that a task sorts at once.
CHUNK = 1_000_000
#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 1 << 20
#: Windows that are looked up, or answered, at once.
BLOCK = 1 << 17


def _window_stream(batches: Iterator[pa.RecordBatch], k: int, exact: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunks of (hash, document key[, check]), each (hash, document) once, sorted by hash, then key.

    batches: key (long), text. Rows with a null key take no part.
    """
    held: list[list[np.ndarray]] = [[] for _ in range(2 + exact)]
    n = 0

    def out() -> tuple[np.ndarray, ...]:
        # One column at a time, so that a chunk is never held twice.
        cols = []
        for parts in held:
            cols.append(np.concatenate(parts))
            parts.clear()
        order = np.lexsort((cols[1], cols[0]))
        for i in range(len(cols)):
            cols[i] = cols[i][order]
        del order
        new = np.ones(len(cols[0]), bool)
        new[1:] = cols[0][1:] != cols[0][:-1]
        new[1:] |= cols[1][1:] != cols[1][:-1]
        if not new.all():
            for i in range(len(cols)):
                cols[i] = cols[i][new]
        return tuple(cols)

    for batch in batches:
        for b in slices(batch, batch.schema.names[1], SLICE_BYTES):
            keys = b.column(0).to_numpy(zero_copy_only=False)
            texts = as_bytes(b.column(1))
            if b.column(0).null_count:
                valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                texts = [t if ok else None for t, ok in zip(texts, valid)]
                keys = np.where(valid, keys, 0)
            h, lengths = _hashed(texts)
            w, doc = windows(h, lengths, k)
            held[0].append(w)
            held[1].append(keys[doc].astype(np.int64))
            if exact:
                held[2].append((windows(h, lengths, k, 1)[0] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            n += len(w)
            del texts, h, w, doc
            if n >= CHUNK:
                yield out()
                n = 0
    if n:
        yield out()


def _hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each; a text's words at a time."""
    lengths = []

    def each(t: bytes | None) -> Iterator[int]:
        words = t.split() if t else []
        lengths.append(len(words))
        return map(xxhash.xxh3_64_intdigest, words)

    h = np.fromiter(chain.from_iterable(map(each, texts)), np.uint64)
    return h, np.array(lengths, np.int64)


def cells_of(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (h if row == 0 else mix(h + np.uint64(row))) & np.uint64(cells - 1)


def _sketch(docs: DataFrame, k: int, cells: int) -> np.ndarray:
    """Bits (row by row, little-endian) of the cells that count two documents or more."""
    shard = min(SHARD, cells)
    per_row = cells // shard

    # Cells of half the bytes, where they fit with a bit for the count.
    kind = np.uint32 if cells <= 1 << 31 else np.uint64

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc in _window_stream(batches, k, False):
            del doc
            for row in range(DEPTH):
                at = np.concatenate([cells_of(h[i : i + BLOCK], row, cells).astype(kind) for i in range(0, len(h), BLOCK)])
                at.sort()
                first = np.ones(len(at), bool)
                first[1:] = at[1:] != at[:-1]
                # A cell's first window is followed by another one of it, if it counts two.
                more = np.append(~first[1:], False)[first]
                at = at[first]
                cut = np.searchsorted(at, (np.arange(per_row + 1, dtype=np.uint64) * np.uint64(shard)).astype(kind))
                coded = (at << kind(1)) | more
                del at, first, more
                ids, data = [], []
                for i in range(per_row):
                    if cut[i] < cut[i + 1]:
                        own = (coded[cut[i] : cut[i + 1]] - kind(2 * i * shard)).astype(np.uint32)
                        ids.append(row * per_row + i)
                        data.append(pa.compress(np.diff(own, prepend=np.uint32(0)).tobytes(), "zstd", asbytes=True))
                sizes = [int(cut[i + 1] - cut[i]) for i in range(per_row) if cut[i] < cut[i + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["shard", "n", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, None

        def out() -> pa.RecordBatch:
            bits = np.packbits(count >= 2, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], names=["shard", "bits"])

        for b in batches:
            for s, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if s != now:
                    if now is not None:
                        yield out()
                    now, count = s, np.zeros(shard, np.uint8)
                coded = np.cumsum(np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint32), dtype=np.uint32)
                at = coded >> np.uint32(1)
                count[at] = np.minimum(count[at] + 1 + (coded & np.uint32(1)).astype(np.uint8), 2)
        if now is not None:
            yield out()

    spark = docs.sparkSession
    parts = max(1, min(DEPTH * per_row, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    partial = docs.mapInArrow(build, "shard int, n int, data binary")
    merged = partial.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, bits binary")
    bits = np.zeros(DEPTH * cells // 8, np.uint8)
    for r in merged.toLocalIterator(prefetchPartitions=True):
        bits[r.shard * shard // 8 : (r.shard + 1) * shard // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unzip(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd"), kind)


def _repeated(docs: DataFrame, k: int, cells: int, bits, parts: int) -> DataFrame:
    """doc, h of the windows that a document with a smaller key holds as well.

    Windows that the sketch estimates repeated travel packed by part of the hash space. Those that a smaller document
    of the same task holds need no answer: they travel by document, in parts of their own.
    """

    def maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        keep = np.ones(len(h), bool)
        for row in range(DEPTH):
            at = cells_of(h[keep], row, cells).astype(np.int64) + row * cells
            keep[keep] = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return keep

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        shift = np.uint64(64 - parts.bit_length() + 1)
        for h, doc, c in _window_stream(batches, k, True):
            keep = np.concatenate([maybe(table, h[i : i + BLOCK]) for i in range(0, len(h), BLOCK)])
            h = h[keep]
            doc = doc[keep]
            c = c[keep]
            known = np.zeros(len(h), bool)
            # Sorted by (h, doc): a row after one of the same window has a smaller document before it.
            known[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            part = (h >> shift).astype(np.int32) if parts > 1 else np.zeros(len(h), np.int32)
            part[known] = parts + (mix(doc[known].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            h = h[order]
            doc = doc[order]
            c = c[order]
            part = part[order]
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)] if len(part) else []
            ends = list(zip(cut, cut[1:]))
            del keep, known, order
            for a in range(0, len(ends), 128):
                rows = [
                    (int(part[i]), j - i, _zip(np.diff(h[i:j], prepend=np.uint64(0))), c[i:j].tobytes(), _zip(doc[i:j])) for i, j in ends[a : a + 128]
                ]
                cols = zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in cols], names=["part", "n", "h", "c", "doc"])
                del rows, cols
            del h, doc, c, part

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, ([], [], []), 0

        def out() -> Iterator[pa.RecordBatch]:
            cols = []
            for x in held:
                cols.append(np.concatenate(x))
                x.clear()
            if now < parts:
                order = np.lexsort((cols[2], cols[1], cols[0]))
                for i in range(len(cols)):
                    cols[i] = cols[i][order]
                del order
            h, c, doc = cols
            del cols
            if now < parts:
                start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))))
                beaten = doc > np.repeat(doc[start], np.diff(np.append(start, len(h))))
                del start, c
                h = h[beaten]
                doc = doc[beaten]
            for a in range(0, len(h), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(doc[a : a + BLOCK]), pa.array(h[a : a + BLOCK].view(np.int64))], names=["doc", "h"])

        for b in batches:
            for p, n, h, c, doc in zip(*(x.to_pylist() for x in b.columns)):
                # What needs no answer goes on as soon as it fills a block.
                if p != now or p >= parts and size >= BLOCK:
                    if now is not None:
                        yield from out()
                    now, size = p, 0
                for x, own in zip(held, (np.cumsum(_unzip(h, n, np.uint64), dtype=np.uint64), np.frombuffer(c, np.int32), _unzip(doc, n, np.int64))):
                    x.append(own)
                size += n
        if now is not None:
            yield from out()

    spark = docs.sparkSession
    tasks = max(1, min(2 * parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = docs.mapInArrow(build, "part int, n int, h binary, c binary, doc binary")
    return packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(merge, "doc long, h long")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, max_cells: int = MAX_CELLS) -> DataFrame:
    """Returns key, n_words, n_removed and kept (the kept words joined by single spaces), a row for each input row.

    Words are runs of bytes other than x20 and x09 to x0D, unchanged. A word goes when a window of `k` consecutive
    words over it also starts in a document with a smaller key (an integer); windows are judged on the input. Rows
    that share a key are one document and never beat one another; a row with a null key neither beats nor loses. A
    null text has no words. Other columns play no part.
    """
    spark = docs.sparkSession
    plain = bounded_batches(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")))
    n_bytes = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = MIN_CELLS
    while cells < min(max_cells, n_bytes // 3):
        cells *= 2
    bits = spark.sparkContext.broadcast(_sketch(plain, k, cells).tobytes())
    free_shuffles(spark)
    parts = 1
    while parts < n_bytes / 6 / (1 << 20):
        parts *= 2
    lost = _repeated(plain, k, cells, bits, parts)
    lists = lost.groupBy("doc").agg(F.collect_list("h").alias("lost"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                rows = [_kept(t, x, k) for t, x in zip(as_bytes(b.column(1)), b.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary())))], names=[key, "n_words", "n_removed", "kept"]
                )

    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])
    out = plain.join(lists, "doc", "left").select("doc", "text", "lost").mapInArrow(cut, schema)
    return out.withColumns({key: F.col(key).cast(docs.schema[key].dataType), "kept": F.col("kept").cast("string")})


def _kept(text: bytes | None, lost: pa.Scalar, k: int) -> tuple[int, int, bytes]:
    words = (text or b"").split()
    if not lost.is_valid:
        return len(words), 0, b" ".join(words)
    gone = np.isin(windows(word_hashes(words), np.array([len(words)]), k)[0].view(np.int64), lost.values.to_numpy())
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(gone)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    keep = np.cumsum(edge)[:-1] == 0
    return len(words), int((~keep).sum()), b" ".join(w for w, ok in zip(words, keep) if ok)


def digest(done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    return done.select(key, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
