"""N-gram Jaccard join by universe partitioning and the pigeonhole principle, verified exactly.

Sets whose Jaccard similarity reaches num/den differ in at most H = (|R| + |S|) * (den - num) / (den + num) members.
Shingles are hashed into the segments of a size band. A set gives segment i a tolerance v: -1 (passed over), 0 (equal
subsets) or 1 (subsets one deletion apart). If the v + 1 add up to H + 1, a similar set must agree in some segment
within its tolerance. Costs decide: small subsets are common, so they are passed over, and some segments of each band
("flexible" ones) have their one-deletion neighbourhoods indexed to make up for them; bands of small sets use nothing
else. A set that has too few left takes its passed segments back, largest first, as probes; the others keep theirs in
the index for it, so nothing is lost.

Equal sets are one set. Signatures travel packed by part of the hash space. Sets in one bucket are first verified
against the bucket's leader (a star, never all pairs) and their components found. Only where several components are left is the
search carried on, between sets of different components that sizes and parity bits do not rule out: pair by pair in buckets of up to HEAVY sets, and in cells of
a grid, bounded in sets and bytes, in larger ones. Before that, sets give up large buckets as far as their tolerances
allow, so that common passages make no work. Neither copies nor near copies are ever expanded into pairs, and no link
between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.components import connected_components

from ._common import as_bytes, bounded_batches, drop_table, free_shuffles, fresh, join_one, materialize, mix, ordered, slices, windows, word_hashes

#: Sets up to this size have flexible segments only; subsets up to SMALL members are passed over.
ALL_FLEX, SMALL, ROOM = 48, 0, 1.1
GROWTH = 1.35
#: Below it, the bits of a signature that describe the entry.
LOW = 1 << 8
CHUNK = 800_000
#: Buckets of more sets are searched in cells of a grid, others pair by pair.
HEAVY = 32
#: Keys are broadcast up to this many; beyond it they are joined by shuffle.
BROADCAST_KEYS = 200_000
#: Bits of a set's id that are used (tests use fewer, so that ids clash).
ID_MASK = np.uint64(2**64 - 1)
#: A cell's sets and text bytes, at most (one set at least).
CELL_SETS, CELL_BYTES = 256, 4 << 20


def shingle_hashes(words: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted by document, and the document of each.

    A document of fewer than k words, but not none, is one shingle.
    """
    n = np.array([len(w) for w in words], np.int64)
    h = word_hashes([w for ws in words for w in ws])
    s, doc = windows(h, n, k)
    start = np.cumsum(n) - n
    for short in range(1, k):
        who = np.flatnonzero(n == short)
        if len(who):
            own = np.concatenate([h[start[i] : start[i] + short] for i in who])
            s = np.concatenate((s, windows(own, np.full(len(who), short), short, short)[0]))
            doc = np.concatenate((doc, who))
    if np.any(doc[1:] < doc[:-1]):
        order = np.argsort(doc, kind="stable")
        s, doc = s[order], doc[order]
    # Each document's own sort: one of all by document and hash takes many times as long.
    cut = np.searchsorted(doc, np.arange(len(n) + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], doc[new]


class Scheme:
    """Size bands for a threshold of num/den, and each band's segments."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high, self.segments, self.flexible = [], [], [], []
        low = 1
        while low < 1 << 40:
            high = max(low, int(low * GROWTH))
            gap = self.gap(high, high)
            if high <= ALL_FLEX:
                m = (gap + 2) // 2
                f = m
            else:
                # Room for the small subsets that are passed over (their share by Poisson), and some to spare.
                m = gap + 1
                while m * (1 - exp(-high / m)) < ROOM * (gap + 1):
                    m += 1 + m // 100
                f = min(m, 2 + int((m * exp(-high / m)) ** 0.5))
            self.low.append(low)
            self.high.append(high)
            self.segments.append(m)
            self.flexible.append(f)
            low = high + 1
        self.low, self.high, self.segments, self.flexible = (np.array(x, np.int64) for x in (self.low, self.high, self.segments, self.flexible))

    def gap(self, a, b):
        """The most that two similar sets of these sizes differ by."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def similar(self, inter: int, union: int) -> bool:
        return self.den * inter >= self.num * union

    def signatures(self, s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of sets and the set of each.

        s: members of all sets, set by set; sizes: members of each set, none empty. Every set is entered in its own
        band and, if a similar set may be in the next, in that one. The low bits of a signature say what an entry can
        do: bit 0, it is a probe; bit 1, the band is the next one; bit 2, giving it up costs two; bits 3 to 7, what
        the set can give up in this band (31 at most).
        """
        own = np.searchsorted(self.low, sizes, "right") - 1
        reach = sizes * self.den // self.num
        up = np.flatnonzero(reach >= self.low[own + 1])
        who = np.concatenate((np.arange(len(sizes)), up))
        band = np.concatenate((own, own[up] + 1))
        start = np.cumsum(sizes) - sizes
        n = sizes[who]
        if not len(who):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.repeat(start[who] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        members = mix(s[at])
        m = self.segments[band]
        base = np.cumsum(m) - m
        of = np.repeat(np.arange(len(who)), n)
        seg = (mix(s[at] + np.uint64(77)) % m[of].astype(np.uint64)).astype(np.int64)
        slot = base[of] + seg
        total = int(m.sum())
        order = np.argsort(slot, kind="stable")
        count = np.bincount(slot, minlength=total)
        sums = np.zeros(total, np.uint64)
        full = np.flatnonzero(count)
        sums[full] = np.add.reduceat(members[order], (np.cumsum(count) - count)[full])
        entry = np.repeat(np.arange(len(who)), m)
        index = np.arange(total) - base[entry]
        key = mix((band[entry].astype(np.uint64) << np.uint64(32)) + index.astype(np.uint64) + np.uint64(1))
        flex = index < self.flexible[band[entry]]
        passed = count <= SMALL + flex
        worth = 1 + flex.astype(np.int64)
        need = self.gap(sizes[who], np.minimum(reach[who], self.high[band])) + 1
        have = np.bincount(entry, worth * ~passed, len(who)).astype(np.int64)
        for e in np.flatnonzero(have < need):
            own_slots = np.arange(base[e], base[e] + m[e])
            back = own_slots[passed[own_slots]]
            for x in back[np.argsort(-count[back], kind="stable")]:
                if have[e] >= need[e]:
                    break
                passed[x] = False
                have[e] += worth[x]
        exact = mix(sums + key)
        probe = ~passed
        inner = flex[slot]
        dels = mix(sums[slot[inner]] - members[inner] + key[slot[inner]])
        spare = np.minimum(have - need, 31).astype(np.uint64)
        low = spare << np.uint64(3) | (np.arange(len(who)) >= len(sizes)).astype(np.uint64) << np.uint64(1)
        sig = np.concatenate((exact, dels)) & ~np.uint64(LOW - 1)
        low = np.concatenate((low[entry] | flex.astype(np.uint64) << np.uint64(2) | probe, low[of[inner]] | probe[slot[inner]]))
        owner = np.concatenate((who[entry], who[of[inner]]))
        return sig | low, owner


@lru_cache(maxsize=8)
def scheme(num: int, den: int) -> Scheme:
    return Scheme(num, den)


def _sets(texts: list[bytes | None], k: int, clash: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """members, sizes, id and check of the shingle sets of lower-cased texts.

    id and check are 64 bits of two hashes. clash: ids that stand for several checks; those are replaced by a mix of both.
    """
    words = [t.lower().split() if t else [] for t in texts]
    s, doc = shingle_hashes(words, k)
    sizes = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    ids, check = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        ids[full] = mix(np.add.reduceat(mix(s), first)) & mask
        check[full] = mix(np.add.reduceat(mix(s + np.uint64(5)), first) + ids[full])
        if len(clash):
            again = np.flatnonzero(np.isin(ids, clash) & (sizes > 0))
            ids[again] = mix(ids[again] ^ mix(check[again]))
    return s, sizes, ids, check


def parity_bits(s: np.ndarray, n: int) -> bytes:
    """Parities of the members in each of 2**j cells, n or more. The bits in which two such maps differ, the longer one
    folded onto the shorter, are at most the members in which the sets differ."""
    cells = max(64, 1 << (n - 1).bit_length())
    return np.packbits(np.bincount((mix(s + np.uint64(9)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _describe(docs: DataFrame, k: int, clash: np.ndarray) -> DataFrame:
    """doc, th (as given), n_shingles, set, check (null for empty sets) and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                s, sizes, ids, check = _sets(as_bytes(b.column(1)), k, clash, ID_MASK)
                none = sizes == 0
                end = np.cumsum(sizes)
                bits = [parity_bits(s[j - n : j], int(n)) if n else None for j, n in zip(end, sizes)]
                cols = [b.column(0), b.column(2), pa.array(sizes), pa.array(ids.view(np.int64), mask=none), pa.array(check.view(np.int64), mask=none), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "th", "n_shingles", "set", "check", "bits"])

    return docs.mapInArrow(run, "doc long, th long, n_shingles long, set long, check long, bits binary")


def _plausible(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (leader, set) that sizes and parity bits do not rule out; both bounds are exact."""
    sch = scheme(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            keep = [bits_apart(x, y) <= sch.gap(m, n) for m, n, x, y in zip(*cols[2:])]
            yield b.select(["leader", "set"]).filter(pa.array(keep, pa.bool_()))

    left = sizes.select(F.col("set").alias("leader"), F.col("n").alias("m"), F.col("bits").alias("x"))
    full = pairs.select("leader", "set").join(left, "leader").join(sizes.select("set", "n", F.col("bits").alias("y")), "set")
    full = full.filter(F.least("m", "n") * den >= F.greatest("m", "n") * num).select("leader", "set", "m", "n", "x", "y")
    return full.mapInArrow(run, "leader long, set long")


def _buckets(docs: DataFrame, k: int, num: int, den: int, parts: int, clash: np.ndarray) -> DataFrame:
    """bucket, set, low (the bits that describe the entry) and n: the members of every bucket of n sets, two at least
    and one of them a probe."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - parts.bit_length() + 1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            sig, ids = (np.concatenate(x) for x in zip(*held))
            order = ordered(sig, ids)
            sig, ids = sig[order], ids[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            sig, ids = sig[new], ids[new]
            part = (sig >> shift).astype(np.int64) if parts > 1 else np.zeros(len(sig), np.int64)
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            rows = [
                (int(part[i]), int(j - i), pa.compress(np.diff(sig[i:j], prepend=np.uint64(0)).tobytes(), "zstd", asbytes=True), ids[i:j].tobytes()) for i, j in zip(cut, cut[1:])
            ]
            for i in range(0, len(rows), 512):
                cols = zip(zip(*rows[i : i + 512]), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in cols], names=["part", "n", "sig", "ids"])

        for batch in batches:
            for b in slices(batch, "text"):
                s, sizes, ids, _ = _sets(as_bytes(b.column(1)), k, clash, ID_MASK)
                full = sizes > 0
                # Equal sets of a slice are entered once.
                _, first = np.unique(ids, return_index=True)
                one = np.zeros(len(ids), bool)
                one[first] = True
                take = full & one
                sig, owner = scheme(num, den).signatures(s[np.repeat(take, sizes)], sizes[take])
                held.append((sig, ids[take][owner]))
                size += len(sig)
                if size >= CHUNK:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            sig, ids = (np.concatenate(x) for x in zip(*held))
            low, sig = (sig & np.uint64(LOW - 1)).astype(np.int32), sig >> np.uint64(8)
            order = ordered(sig, ids, -(low & 1))
            sig, ids, low = sig[order], ids[order], low[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            sig, ids, low = sig[new], ids[new], low[new]
            start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            n = np.diff(np.append(start, len(sig)))
            asked = np.add.reduceat(low & 1, start) > 0
            keep = np.flatnonzero(np.repeat((n > 1) & asked, n))
            many = np.repeat(n, n)
            for a in range(0, len(keep), 200_000):
                z = keep[a : a + 200_000]
                cols = (sig[z].view(np.int64), ids[z].view(np.int64), low[z], many[z].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["bucket", "set", "low", "n"])

        for b in batches:
            for p, n, sig, ids in zip(*(x.to_pylist() for x in b.columns)):
                if p != now:
                    if now is not None:
                        yield from out()
                    now, held = p, []
                held.append((np.cumsum(np.frombuffer(pa.decompress(sig, 8 * n, "zstd"), np.uint64), dtype=np.uint64), np.frombuffer(ids, np.uint64)))
        if now is not None:
            yield from out()

    tasks = max(1, min(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    packed = docs.mapInArrow(build, "part int, n int, sig binary, ids binary")
    return packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(merge, "bucket long, set long, low int, n long")


def _verified(cells: DataFrame, k: int, num: int, den: int, star: bool) -> DataFrame:
    """a, b: links found in each cell (g, c), whose rows are neighbours in order.

    cells: g, c, side, set, comp, text. star: the row of side 0 against the others. Otherwise sets of different
    components against each other, until their components have met; sides 0 and 1 against each other, if both are there.
    """

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sch = scheme(num, den)
        words = [r[3].lower().split() if r[3] else [] for r in rows]
        s, doc = shingle_hashes(words, k)
        cut = np.searchsorted(doc, np.arange(len(rows) + 1))
        sets = [s[i:j] for i, j in zip(cut, cut[1:])]
        exact: dict[int, set] = {}

        def real(i: int) -> set:
            if i not in exact:
                exact[i] = set(zip(*(words[i][j:] for j in range(k)))) if len(words[i]) >= k else {tuple(words[i])}
            return exact[i]

        def linked(i: int, j: int) -> bool:
            a, b = sets[i], sets[j]
            if not sch.similar(min(len(a), len(b)), max(len(a), len(b))):
                return False
            both = np.concatenate((a, b))
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            if not sch.similar(inter, len(a) + len(b) - inter):
                return False  # equal hashes only ever add to the intersection
            inter = len(real(i) & real(j))
            return sch.similar(inter, len(real(i)) + len(real(j)) - inter)

        if star:
            for i in (i for i, r in enumerate(rows) if r[0] == 0):
                for j in range(len(rows)):
                    if j != i and rows[j][1] != rows[i][1]:
                        if linked(i, j):
                            yield rows[i][1], rows[j][1]
                        exact.pop(j, None)
            return
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        two = len({r[0] for r in rows}) == 2
        order = [i for i in sorted(range(len(rows)), key=lambda i: len(sets[i])) if len(sets[i])]
        if not order:
            return
        size = np.array([len(sets[i]) for i in order])
        # Parity bits of all sets at one width: the pairs that they rule out are never looked at one by one.
        width = max(64, min(2048, 1 << int(size.max(initial=1) - 1).bit_length()))
        maps = np.stack([np.frombuffer(parity_bits(sets[i], width)[: width // 8], np.uint64) for i in order])
        for x, i in enumerate(order):
            end = int(np.searchsorted(size, size[x] * den // num, "right"))
            apart = np.bitwise_count(maps[x + 1 : end] ^ maps[x]).sum(axis=1)
            for y in np.flatnonzero(apart <= sch.gap(size[x], size[x + 1 : end])) + x + 1:
                j = order[y]
                if two and rows[i][0] == rows[j][0] or find(rows[i][2]) == find(rows[j][2]):
                    continue
                if linked(i, j):
                    root[find(rows[i][2])] = find(rows[j][2])
                    yield rows[i][1], rows[j][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> pa.RecordBatch:
            found = list(links(rows))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            text = as_bytes(b.column(5))
            for g, c, side, set_, comp, t in zip(*(b.column(i).to_pylist() for i in range(5)), text):
                if (g, c) != now:
                    if rows:
                        yield out()
                    now, rows = (g, c), []
                rows.append((side, set_, comp, t))
        if rows:
            yield out()

    ordered = cells.select("g", "c", "side", "set", "comp", "text").repartition("g", "c").sortWithinPartitions("g", "c", "side", "set")
    return ordered.mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, group: str) -> DataFrame:
    """Adds _n, the group's number of blocks, and _i, the row's block: bounded sets and bytes, by a hash of the set."""
    sized = members.groupBy(group).agg(F.count("*").alias("_m"), F.sum("size").alias("_b"))
    n = F.ceil(F.greatest(F.col("_m") / CELL_SETS, F.col("_b") / CELL_BYTES)).cast("long")
    return members.join(sized.select(group, F.greatest(n, F.lit(1)).alias("_n")), group).withColumn("_i", F.pmod(F.xxhash64("set", F.lit(3)), "_n"))


def _settled(found: DataFrame) -> DataFrame:
    """bucket, set, n, probe. In buckets of more than HEAVY sets, sets stop probing while they can spare it, the
    largest buckets first; buckets that nobody probes any longer are left out."""
    bits = found.select("bucket", "set", "n", (F.col("low").bitwiseAND(1) == 1).alias("probe"), F.col("low").bitwiseAND(2).alias("band"), (F.lit(1) + F.col("low").bitwiseAND(4) / 4).alias("cost"), F.shiftright("low", 3).alias("spare"))
    w = Window.partitionBy("set", "band").orderBy(F.desc("n"), "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heavy = bits.filter(F.col("n") > HEAVY)
    spent = heavy.filter("probe").withColumn("spent", F.sum("cost").over(w)).select("bucket", "set", "n", (F.col("spent") > F.col("spare")).alias("probe"))
    heavy = heavy.filter("not probe").select("bucket", "set", "n", "probe").unionByName(spent)
    asked = heavy.filter("probe").select("bucket").distinct()
    return bits.filter(F.col("n") <= HEAVY).select("bucket", "set", "n", "probe").unionByName(heavy.join(asked, "bucket"))


def _open(small: DataFrame) -> DataFrame:
    """bucket: those that hold several components; of buckets with the same members (set, probe), HEAVY at most, one."""
    who = F.sort_array(F.collect_list(F.struct("set", "probe"))).alias("who")
    several = small.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), who).filter("x <> y")
    return several.groupBy("who").agg(F.min("bucket").alias("bucket")).select("bucket")


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Two tables: each row's set (doc, n_shingles, set), and links between sets (a, b); and the ids that clashed.

    Sets are equal where 128 bits of two hashes agree: ids of 64 bits that stand for several checks are told apart by
    both before anything is joined by them. The links connect exactly the sets that are connected by pairs of Jaccard similarity num/den or more: every
    component is spanned, pairs inside one are not all listed.
    """
    plain = bounded_batches(docs).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    n_bytes = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1
    while parts < n_bytes / 6 / (1 << 20):
        parts *= 2
    clash = np.zeros(0, np.uint64)
    while True:
        described = materialize(_describe(plain, k, clash), "sets")
        first = F.min(F.struct(F.col("doc").isNull(), "doc", "th", "n_shingles", "bits")).alias("x")
        sizes = described.filter("set is not null").groupBy("set").agg(first, F.min("check").alias("lo"), F.max("check").alias("hi"))
        sizes = materialize(
            sizes.select("set", F.col("x.doc").alias("doc"), F.col("x.th").alias("th"), F.col("x.n_shingles").alias("n"), F.col("x.bits").alias("bits"), (F.col("lo") != F.col("hi")).alias("clash")), "sizes"
        )
        # About n**2 / 2**65 of n sets: none, or a handful.
        more = np.array([r.set for r in sizes.filter("clash").select("set").toLocalIterator()], np.int64).view(np.uint64)
        if not len(more):
            break
        drop_table(described)
        drop_table(sizes)
        clash = np.concatenate((clash, more))
    # Read three times within one job: kept on the executors' disks, with its lineage, for that long.
    found = _buckets(plain.select("doc", "text"), k, num, den, parts, clash).persist(StorageLevel.DISK_ONLY)
    members = materialize(_settled(found).withColumn("heavy", F.col("n") > HEAVY), "settled")
    found.unpersist()
    free_shuffles(docs.sparkSession)
    leader = materialize(members.filter("probe").groupBy("bucket").agg(F.min("set").alias("leader")), "leaders")
    members = join_one(members, leader, "bucket").filter("leader is not null")

    spark = docs.sparkSession
    star = members.filter("set <> leader").select("leader", "set", "heavy").groupBy("leader", "set").agg(F.bool_or("heavy").alias("heavy"))
    star = materialize(star, "pairs")
    def texts_of(wanted: DataFrame) -> DataFrame:
        """set, text, size of the sets wanted: of equal sets the text of the smallest key."""
        first = materialize(sizes.select("set", F.col("doc").alias("_d"), F.col("th").alias("_t")).join(wanted.distinct(), "set"), "first")
        few = first.count() <= BROADCAST_KEYS
        own = plain.join(F.broadcast(first) if few else first, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
        return materialize(own.groupBy("set").agg(F.min("text").alias("text")).withColumn("size", F.octet_length("text")), "texts")

    pairs = materialize(_plausible(star, sizes, num, den), "plausible")
    large = star.filter("heavy").select("leader", "set")
    texts = texts_of(pairs.unionByName(large).select(F.explode(F.array("leader", "set")).alias("set")))
    free_shuffles(spark)
    verify = lambda cells, texts, stars: materialize(_verified(cells.join(texts.select("set", "text"), "set"), k, num, den, stars), "links")

    def against(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        split = _blocks(pairs.select("leader", "set").join(texts.select("set", "size"), "set"), "leader")
        rows = split.select("leader", "_i", F.lit(1).alias("side"), "set").unionByName(split.select("leader", "_i", F.lit(0).alias("side"), F.col("leader").alias("set")).distinct())
        return verify(rows.select(F.col("leader").alias("g"), F.col("_i").alias("c"), "side", "set", F.lit(0).cast("long").alias("comp")), texts, True)

    links = against(pairs, texts)
    comps = materialize(connected_components(links), "components").withColumnRenamed("id", "set")
    free_shuffles(spark)

    # Small buckets that still hold several components (of those with the same members, one): the pairs left.
    small = members.filter("not heavy and n > 2").join(comps, "set", "left").withColumn("comp", F.coalesce("component", "set"))
    small = materialize(small.join(_open(small), "bucket").select("bucket", "set", "leader", "probe", "comp"), "open")
    x, y = small.alias("x"), small.alias("y")
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.set") < F.col("y.set")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.probe") | F.col("y.probe")))
    rest = rest.filter((F.col("x.set") != F.col("x.leader")) & (F.col("y.set") != F.col("x.leader"))).select(F.col("x.set").alias("leader"), F.col("y.set").alias("set")).distinct()
    rest = materialize(_plausible(rest, sizes, num, den), "plausible")
    links = links.unionByName(against(rest, texts_of(rest.select(F.explode(F.array("leader", "set")).alias("set")))))

    # Large ones: groups that share buckets and still hold several components, in cells of a grid.
    shared = connected_components(star.filter("heavy"), "leader", "set").select(F.col("id").alias("set"), F.col("component").alias("grp"))
    shared = materialize(shared.join(comps, "set", "left").withColumn("comp", F.coalesce("component", "set")), "shared")
    several = shared.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("grp")
    group = _blocks(shared.join(several, "grp").join(texts.select("set", "size"), "set"), "grp")
    # Block i meets every block j >= i: cell (i, j).
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    grid = group.withColumn("_j", other).select(
        F.col("grp").alias("g"),
        (F.least("_i", "_j") * F.col("_n") + F.greatest("_i", "_j")).alias("c"),
        F.when(F.col("_i") <= F.col("_j"), 0).otherwise(1).alias("side"),
        "set",
        "comp",
    )
    links = links.unionByName(verify(grid, texts, False))
    return described.select("doc", "n_shingles", "set"), links, clash


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Returns key, n_shingles and component_id (the smallest key that links reach), a row for each input row.

    Words are runs of bytes other than x20 and x09 to x0D, A-Z lower-cased; a text's set is its distinct runs of k
    words, or all its words as one run where there are fewer. Sets are linked when den * intersection >= num * union.
    A null or wordless text has size 0, and is its own component. Keys are integers; rows that share a key and repeated
    rows each have their row. A null key is never a component_id, unless it stands alone. An empty table gives none.
    """
    sets, links, _ = similar_sets(docs, key, text, k, num, den)
    comps = materialize(connected_components(links).withColumnRenamed("id", "set"), "components")
    named = materialize(join_one(sets, comps, "set").select("doc", "n_shingles", F.coalesce("component", "set").alias("comp")), "classes")
    least = named.filter("comp is not null").groupBy("comp").agg(F.min("doc").alias("component_id"))
    out = join_one(named, materialize(least, "least"), "comp")
    return out.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with one of each class kept: the one with the smallest key. Columns stay as they are, and no other
    name matters.

    A null or wordless text is in no class and stays. Of rows equal in key and shingles one stays. A class whose keys
    are all null keeps one row.
    """
    sets, links, clash = similar_sets(docs, key, text, k, num, den)
    comps = materialize(connected_components(links).withColumnRenamed("id", "set"), "components")
    place = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), F.col("set"))
    rows = join_one(sets.filter("set is not null"), comps, "set").select(F.coalesce("component", "set").alias("comp"), place.alias("place"))
    rows = materialize(rows.groupBy("comp", "place").agg(F.count("*").alias("rows")), "rows")
    best = materialize(rows.groupBy("comp").agg(F.min("place").alias("best")), "best")
    judged = join_one(rows, best, "comp").select(F.col("place.doc").alias("_d"), F.col("place.set").alias("_s"), (F.col("place") == F.col("best")).alias("_best"), "rows")
    judged = materialize(judged.filter("not _best or rows > 1"), "judged")

    fields = docs.columns
    own_s, own_d = fresh(docs, "_s") + "s", fresh(docs, "_s") + "d"
    judged = judged.withColumnsRenamed({"_s": own_s, "_d": own_d})
    at = fields.index(text)

    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                _, sizes, ids, _ = _sets(as_bytes(b.column(at)), k, clash, ID_MASK)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids.view(np.int64), mask=sizes == 0)], names=[*fields, own_s])

    schema = T.StructType([*docs.schema.fields, T.StructField(own_s, T.LongType())])
    own = docs.mapInArrow(with_set, schema).withColumn(own_d, F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)))
    hint = F.broadcast if judged.count() <= BROADCAST_KEYS else (lambda df: df)
    kept = own.join(hint(judged.filter("not _best").select(own_d, own_s)), [own_d, own_s], "left_anti")
    again = judged.filter("_best").select(own_d, own_s)
    if not again.isEmpty():
        kept = kept.join(hint(again), [own_d, own_s], "left_anti").unionByName(
            kept.join(hint(again), [own_d, own_s], "left_semi").dropDuplicates([own_d, own_s])
        )
    return kept.select(*fields)
