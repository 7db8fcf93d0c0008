"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training counts words and word pairs: each task adds up its own, packs them by shard of the hash space and a shard's
rows meet in one place, so a frequent word costs one entry a task. A count c is stored as 1 + floor(log2 c) keys
(n-gram, 1), (n-gram, 2), ...; a probe asks for them in turn and stops at the first that is missing, so a level is
never too low. Shards are filters of their own, of 12 bits a key, and their number follows the corpus.

A level stands for the middle of its counts. So that probabilities add up to 1 for every context, each is divided by
the sum of what the filter itself holds: pairs lie in the shard of their context (named by its first CONTEXT bits), and
the shard keeps the context's total exactly, as keys for its length in bits and for each bit that is set. Words are
divided by the sum over all words. Only a false positive (about 1 probe in 200) adds to such a sum.

The filter is the only source of levels and totals. It is broadcast while it is at most `broadcast_bytes`; beyond that
the probes of a chunk of texts travel to its shards, a few MB each, and the answers travel back, so scores are the same.
Exact word counts serve the base score: words that make up a share of at least 1/HOT of all tokens (so HOT words at
most) are broadcast, the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, bounded_batches, drop_table, free_shuffles, materialize, mix, slices, word_hashes

HOT = 2_000_000
BROADCAST_BYTES = 256 << 20
#: Filter: bits a key and probes a key. Chunk: tokens that a task counts at once.
KEY_BITS, PROBES, CHUNK = 12, 5, 1_500_000
#: Bits of a pair's hash that come from its context.
CONTEXT = 38
#: Weights of the pair, word and uniform parts; a context that was never seen gives its weight to the word part.
PAIR, WORD = 0.6, 0.35
#: Hashes of what no word can be: the end of a text and its beginning.
END, BEGIN = (np.uint64(x) for x in word_hashes([b" ", b"  "]))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the keys of totals apart from those of pairs.
_TOTAL = np.uint64(0x5851F42D4C957F2D)


def held_out(key: str) -> Column:
    """crc32 of the key as text, modulo 7, is 2. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts, each followed by an end; tokens of each text."""
    words = [t.lower().split() if t else [] for t in texts]
    n = np.array([len(w) + 1 for w in words], np.int64)
    h = np.full(int(n.sum()), END, np.uint64)
    is_word = np.ones(len(h), bool)
    is_word[np.cumsum(n) - 1] = False
    h[is_word] = word_hashes([w for ws in words for w in ws])
    return h, n


def contexts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each token; the beginning before the first."""
    out = np.concatenate(([BEGIN], h[:-1])) if len(h) else h
    out[np.cumsum(n) - n] = BEGIN
    return out


def contexts_of(pair: np.ndarray) -> np.ndarray:
    """What a pair's hash tells of its context; of contexts()' hashes it gives the same."""
    return pair >> np.uint64(64 - CONTEXT) << np.uint64(64 - CONTEXT)


def pairs(context: np.ndarray, h: np.ndarray) -> np.ndarray:
    return contexts_of(context) | mix(context * _STEP + h) >> np.uint64(CONTEXT)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def expected(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for level 0."""
    return np.where(level > 0, (2.0 ** (level - 1) + 2.0**level - 1) / 2, 0.0)


def _keys(h: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = mix(h + _STEP * np.asarray(level).astype(np.uint64))
    return a, mix(a) | np.uint64(1)


def totals_of(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of pairs in order, and twice the sum of expected counts of each, less 1: a positive whole number."""
    twice = (2 * expected(levels_of(counts))).astype(np.int64)
    context = contexts_of(h)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(h) else np.zeros(0, np.int64)
    return context[first], (np.add.reduceat(twice, first) if len(h) else twice) - 1


def _bit_length(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, np.frexp(v.astype(np.float64))[1], 0)


def build_filter(h: np.ndarray, counts: np.ndarray, order: int = 1, key_bits: int = KEY_BITS) -> bytes:
    """Bits of one shard: the levels of n-grams and, for pairs (order 2, in order), their contexts' totals."""
    level = levels_of(counts)
    keys = [(h[level >= j], j) for j in range(1, int(level.max(initial=0)) + 1)]
    if order == 2:
        context, total = totals_of(h, counts)
        context, n = context ^ _TOTAL, _bit_length(total)
        keys += [(context[n >= j], j) for j in range(1, int(n.max(initial=0)) + 1)]
        keys += [(context[(n > j + 1) & (total >> j & 1 == 1)], 64 + j) for j in range(int(n.max(initial=1)) - 1)]
    size = max(64, sum(len(x) for x, _ in keys) * key_bits // 8 * 8)
    bits = np.zeros(size, bool)
    for x, j in keys:
        a, b = _keys(x, j)
        for i in range(PROBES):
            bits[((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class Filter:
    """Shards of both orders, one after another: words first, then pairs."""

    shards: int
    parts: dict[int, bytes]

    def ready(self) -> Filter:
        sizes = [len(self.parts.get(i, b"\0" * 8)) for i in range(2 * self.shards)]
        self.offset = np.concatenate(([0], np.cumsum(sizes[:-1]))).astype(np.int64) * 8
        self.size = np.array(sizes, np.uint64) * np.uint64(8)
        self.table = np.frombuffer(b"".join(self.parts.get(i, b"\0" * 8) for i in range(2 * self.shards)), np.uint8)
        self.parts = {}
        return self

    def _place(self, h: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        shard = shard_of(h, self.shards) + (order - 1) * self.shards
        return self.size[shard], self.offset[shard]

    def _has(self, h: np.ndarray, j: int, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
        a, b = _keys(h, j)
        ok = np.ones(len(h), bool)
        for i in range(PROBES):
            at = ((a[ok] + np.uint64(i) * b[ok]) % size[ok]).astype(np.int64) + offset[ok]
            ok[ok] = (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok

    def _unary(self, h: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
        out, live, j = np.zeros(len(h), np.int64), np.arange(len(h)), 0
        while len(live) and j < 63:
            j += 1
            live = live[self._has(h[live], j, size[live], offset[live])]
            out[live] = j
        return out

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        return self._unary(h, *self._place(h, order))

    def totals(self, context: np.ndarray, order: int = 2) -> np.ndarray:
        """The sums of expected counts of contexts' pairs; 0 for contexts that were never seen."""
        context = contexts_of(context)
        size, offset = self._place(context, order)
        h = context ^ _TOTAL
        n = self._unary(h, size, offset)
        v = np.where(n > 0, np.int64(1) << np.maximum(n - 1, 0), 0)
        for j in range(int(n.max(initial=1)) - 1):
            who = np.flatnonzero(n > j + 1)
            v[who] += self._has(h[who], 64 + j, size[who], offset[who]).astype(np.int64) << j
        return np.where(v > 0, (v + 1) / 2.0, 0.0)


def log_probability(pair: np.ndarray, context: np.ndarray, word: np.ndarray, mass: float, distinct: int) -> np.ndarray:
    """log10 of the smoothed probability, from expected counts of the pair and word, and the sums that they are part of."""
    seen = context > 0
    share = np.minimum(pair, context) / np.where(seen, context, 1.0)
    p = np.where(seen, PAIR, 0.0) * share + np.where(seen, WORD, PAIR + WORD) * word / max(mass, 1.0)
    # Without any training word, all of the weight is uniform.
    return np.log10(p + (1 - PAIR - WORD if mass else 1.0) / (distinct + 1))


def _scores(n: np.ndarray, word: np.ndarray, context: np.ndarray, pair: np.ndarray, mass: float, distinct: int) -> np.ndarray:
    """Scores of texts of n tokens, from expected counts of each token and its pair, and its context's total."""
    return np.bincount(np.repeat(np.arange(len(n)), n), log_probability(pair, context, word, mass, distinct), len(n))


def _count(train: DataFrame, shards: int, key_bits: int = KEY_BITS) -> DataFrame:
    """Sums by order (1 word, 2 pair) and shard: a row with entries, total, mass (expected counts) and bits (the shard's
    filter), and for words rows with the counts themselves, h and n (arrays as bytes)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows: list[list] = [[], [], [], []]
            for order in (1, 2):
                h, n = np.unique(np.concatenate([x[order - 1] for x in held]), return_counts=True)
                cut = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
                for s in range(shards):
                    if cut[s] < cut[s + 1]:
                        z = slice(cut[s], cut[s + 1])
                        for col, x in zip(rows, (order, s, h[z].tobytes(), pa.compress(n[z].astype(np.uint32).tobytes(), "zstd", asbytes=True))):
                            col.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["ord", "shard", "h", "n"])

        for batch in batches:
            for b in slices(batch, "_text"):
                h, n = tokens(as_bytes(b.column(0)))
                held.append((h, pairs(contexts(h, n), h)))
                size += len(h)
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hs, ns, waiting = None, [], [], 0

        def shrink() -> None:
            nonlocal hs, ns, waiting
            h, n = np.concatenate(hs), np.concatenate(ns)
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            hs, ns, waiting = [h[first]], [np.add.reduceat(n, first) if len(h) else n], 0

        def row(entries: int, total: int, mass: float, bits: bytes | None, h: bytes | None, n: bytes | None) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            cols = [pa.array([x], t) for x, t in zip((*now, entries, total, mass, bits, h, n), kinds)]
            return pa.RecordBatch.from_arrays(cols, names=["ord", "shard", "entries", "total", "mass", "bits", "h", "n"])

        def out() -> Iterator[pa.RecordBatch]:
            shrink()
            h, n = hs[0], ns[0]
            yield row(len(h), int(n.sum()), float(expected(levels_of(n)).sum()), build_filter(h, n, now[0], key_bits), None, None)
            for i in range(0, len(h) if now[0] == 1 else 0, 50_000):
                yield row(0, 0, 0.0, None, h[i : i + 50_000].tobytes(), n[i : i + 50_000].tobytes())

        for b in batches:
            for order, s, h, n in zip(*(c.to_pylist() for c in b.columns)):
                if (order, s) != now:
                    if now is not None:
                        yield from out()
                    now, hs, ns, waiting = (order, s), [], [], 0
                hs.append(np.frombuffer(h, np.uint64))
                ns.append(np.frombuffer(pa.decompress(n, len(h) // 2, "zstd"), np.uint32).astype(np.int64))
                waiting += len(hs[-1])
                if waiting > 4_000_000:
                    shrink()
        if now is not None:
            yield from out()

    spark = train.sparkSession
    parts = max(1, min(2 * shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = train.mapInArrow(build, "ord int, shard int, h binary, n binary").repartition(parts, "ord", "shard").sortWithinPartitions("ord", "shard")
    return packed.mapInArrow(merge, "ord int, shard int, entries long, total long, mass double, bits binary, h binary, n binary")


def _rows(counts: DataFrame) -> DataFrame:
    """h, c of packed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, n = np.frombuffer(h, np.int64), np.frombuffer(n, np.int64)
                for a in range(0, len(h), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["h", "c"])

    return counts.filter("h is not null").select("h", "n").mapInArrow(run, "h long, c long")


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT, key_bits: int = KEY_BITS) -> DataFrame:
    """Returns key, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each input row.

    Learns from the rows that are not held out. Words are runs of bytes other than x20 and x09 to x0D, A-Z lower-cased;
    a null or empty text is its end alone. base_score: sum of log10((c + 1) / (N + V + 1)) over tokens, with exact
    counts. score: the model's log10 probability of the text: at each token the probabilities of all words, the end and
    whatever is unknown (as one) add up to 1, but for false positives. Without training rows all counts are 0. Other columns play no part.
    """
    spark = docs.sparkSession
    plain = bounded_batches(docs).select(F.col(key).alias("_key"), held_out(key).alias("held_out"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    n_bytes = plain.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = 4
    while shards < n_bytes / 6 / (1 << 20):
        shards *= 2
    # Merged at full width on the executors' disks first, then written as a few files, so that the shuffle can go.
    merged = _count(plain.filter(~F.col("held_out")).select("_text"), shards, key_bits).persist(StorageLevel.DISK_ONLY)
    merged.count()
    counts = materialize(merged.coalesce(max(1, shards // 32)), "ngrams")
    merged.unpersist()
    free_shuffles(spark)
    of = lambda c: F.sum(F.when(F.col("ord") == 1, F.col(c))).alias(c)
    size = counts.agg(F.sum(F.octet_length("bits")).alias("bytes"), of("total"), of("entries"), of("mass")).first()
    words = _rows(counts.filter("ord = 1"))
    total, distinct, mass = size.total or 0, size.entries or 0, size.mass or 0.0
    # At most `hot` words can each hold 1/hot of all tokens.
    common = words.filter(F.col("c") >= max(1, total // hot)).toPandas() if total else None
    order = np.argsort(common["h"].to_numpy()) if total else []
    table = (common["h"].to_numpy()[order], common["c"].to_numpy()[order]) if total else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    shared_hot = spark.sparkContext.broadcast(table)
    by_filter = (size.bytes or 0) <= broadcast_bytes
    parts = {}
    if by_filter:
        for r in counts.filter("bits is not null").select("ord", "shard", "bits").toLocalIterator():
            parts[(r.ord - 1) * shards + r.shard] = bytes(r.bits)
    shared = spark.sparkContext.broadcast(Filter(shards, parts))
    parts = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_h, hot_c = shared_hot.value
        model = _ready(shared)
        for batch in batches:
            for b in slices(batch, "_text"):
                h, n = tokens(as_bytes(b.column(2)))
                doc = np.repeat(np.arange(len(n)), n)
                u, inverse = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(hot_h, u.view(np.int64)), max(len(hot_h) - 1, 0))
                is_hot = (hot_h[at] == u.view(np.int64)) if len(hot_h) else np.zeros(len(u), bool)
                c = np.where(is_hot, hot_c[at], 0) if len(hot_h) else np.zeros(len(u), np.int64)
                base = np.bincount(doc, np.log10(c + 1.0)[inverse], len(n))
                known = np.bincount(doc, is_hot[inverse], len(n)).astype(np.int64)
                rare = ~is_hot[inverse]
                rare_n = np.bincount(doc[rare], minlength=len(n))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rare_n))), pa.int32()), pa.array(h[rare].view(np.int64)))
                if by_filter:
                    word = expected(model.levels(u, 1))[inverse]
                    before, at = np.unique(contexts(h, n), return_inverse=True)
                    pair = expected(model.levels(pairs(before[at], h), 2))
                    score = _scores(n, word, model.totals(before)[at], pair, mass, distinct)
                else:
                    score = np.zeros(len(n))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n), pa.array(base), pa.array(known), lists, pa.array(score), b.column(3)],
                    names=["_key", "held_out", "n_tokens", "_base", "_known", "_rare", "score", "_row"],
                )

    if not by_filter:
        plain = materialize(plain, "texts")  # its numbers are used twice
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("_key", kind), *T._parse_datatype_string("held_out boolean, n_tokens long, _base double, _known long, _rare array<long>, score double, _row long").fields])
    first = materialize(plain.mapInArrow(run, schema), "scored")
    rare = first.select("_row", F.explode("_rare").alias("h")).groupBy("_row", "h").agg(F.count("*").alias("m"))
    more = rare.join(words, "h").groupBy("_row").agg(F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("_b"), F.sum("m").alias("_k"))
    more = materialize(more, "rare")
    out = first.drop("_rare").join(more, "_row", "left")
    if not by_filter:
        out = out.drop("score").join(_scores_by_shard(plain, counts, shards, mass, distinct), "_row", "left")
    none = F.lit(0.0)
    base = F.col("_base") + F.coalesce("_b", none) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return out.select(
        F.col("_key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("_known") + F.coalesce("_k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def _ready(shared) -> Filter:
    """The broadcast filter, laid out once in each Python worker (its value is kept there)."""
    f = shared.value
    return f if hasattr(f, "table") else f.ready()


def _scores_by_shard(plain: DataFrame, counts: DataFrame, shards: int, mass: float, distinct: int) -> DataFrame:
    """_row, score, without a broadcast: the distinct words and pairs of a chunk of texts meet the filter's shards.

    Tables of chunk (its first _row), ord (0 text, 1 words, 2 pairs, 3 totals of the pairs' contexts), shard (a text's
    place), row and data. Distinct hashes are in order and shards are ranges of them, so the answers of a chunk's shards
    in turn are those of its hashes.
    """
    spark = plain.sparkSession
    names = ["chunk", "ord", "shard", "row", "data"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    schema = "chunk long, ord int, shard int, row long, data binary"
    batch_of = lambda *cols: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def distinct_of(held: list[tuple[np.ndarray, np.ndarray]], inverse: bool = False) -> list:
        return [np.unique(np.concatenate(x), return_inverse=inverse) for x in zip(*held)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size, place = 0, [], 0, 0

        def probes() -> Iterator[pa.RecordBatch]:
            for order, h in enumerate(distinct_of(held), 1):
                cut = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
                some = [s for s in range(shards) if cut[s] < cut[s + 1]]
                m = len(some)
                yield batch_of([chunk] * m, [order] * m, some, [None] * m, [h[cut[s] : cut[s + 1]].tobytes() for s in some])

        for batch in batches:
            for b in slices(batch, "_text"):
                texts, rows = as_bytes(b.column(1)), b.column(0).to_pylist()
                h, n = tokens(texts)
                if not held:
                    chunk = rows[0]
                held.append((h, pairs(contexts(h, n), h)))
                m = len(rows)
                yield batch_of([chunk] * m, [0] * m, range(place, place + m), rows, texts)
                place, size = place + m, size + len(h)
                if size >= CHUNK:
                    yield from probes()
                    held, size, place = [], 0, 0
        if held:
            yield from probes()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = model = None
        for b in batches:
            chunks, orders, places, data = (b.column(i).to_pylist() for i in (0, 1, 2, 4))
            out: list[list] = [[], [], [], [], []]
            for c, o, s, x in zip(chunks, orders, places, data):
                if (o, s) != now:
                    now, model = (o, s), Filter(1, {0: x} if c < 0 else {}).ready()
                if c >= 0:
                    h = np.frombuffer(x, np.uint64)
                    found = [(o, model.levels(h, 1).astype(np.uint8).tobytes())]
                    if o == 2:
                        found.append((3, model.totals(np.unique(contexts_of(h)), 1).tobytes()))
                    for o_, y in found:
                        for col, z in zip(out, (c, o_, s, None, y)):
                            col.append(z)
            yield batch_of(*out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held, lengths, answers = None, [], [], [], ([], [], [])

        def out() -> pa.RecordBatch:
            (_, word_at), (two, pair_at) = distinct_of(held, True)
            word, pair = (expected(np.frombuffer(b"".join(x), np.uint8).astype(np.int64)) for x in answers[:2])
            _, context_at = np.unique(contexts_of(two), return_inverse=True)
            context = np.frombuffer(b"".join(answers[2]), np.float64)[context_at]
            got = _scores(np.concatenate(lengths), word[word_at], context[pair_at], pair[pair_at], mass, distinct)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(got)], names=["_row", "score"])

        for batch in batches:
            for b in slices(batch, "data"):
                chunks, orders, data = (b.column(i).to_pylist() for i in (0, 1, 4))
                i = 0
                while i < len(chunks):
                    if chunks[i] != now:
                        if now is not None:
                            yield out()
                        now, rows, held, lengths, answers = chunks[i], [], [], [], ([], [], [])
                    if orders[i]:
                        answers[orders[i] - 1].append(data[i])
                        i += 1
                        continue
                    end = i
                    while end < len(chunks) and chunks[end] == now and not orders[end]:
                        end += 1
                    h, n = tokens(data[i:end])
                    rows += b.column(3).slice(i, end - i).to_pylist()
                    held.append((h, pairs(contexts(h, n), h)))
                    lengths.append(n)
                    i = end
        if now is not None:
            yield out()

    # Kept as a table, so that both sides see the same chunks.
    dealt = materialize(plain.select("_row", "_text").mapInArrow(deal, schema), "dealt")
    drop_table(plain)
    bits = counts.filter("bits is not null").select(F.lit(-1).cast("long").alias("chunk"), "ord", "shard", F.lit(None).cast("long").alias("row"), F.col("bits").alias("data"))
    parts = max(1, min(2 * shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = bits.unionByName(dealt.filter("ord > 0")).repartition(parts, "ord", "shard").sortWithinPartitions("ord", "shard", "chunk")
    levels = materialize(asked.mapInArrow(answer, schema), "levels")
    drop_table(counts)
    back = dealt.filter("ord = 0").unionByName(levels).repartition("chunk").sortWithinPartitions("chunk", "ord", "shard")
    out = materialize(back.mapInArrow(score, "_row long, score double"), "scores")
    drop_table(dealt)
    drop_table(levels)
    return out
