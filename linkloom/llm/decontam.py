"""Benchmark decontamination: one Aho-Corasick automaton over the items' windows, each text scanned once.

Texts are folded to lower-case words joined by single spaces; the automaton's patterns are runs of `k` item words
between spaces, so a match always covers whole words. Folding keeps byte places, so hit words map back to the
original text. The benchmark is the small side: it is read in blocks of at most `block_bytes` of text, one automaton
each. One block is the common case, and one scan. Of a larger benchmark one block is broadcast at a time: each has a
scan of its own, which builds its automaton once in a worker and writes what was found so far beside the texts, so
memory stays that of one block. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, bounded_batches, drop_table, fresh, materialize

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Benchmark text in one automaton; about 60 bytes of automaton a byte of text, so some 500 MB at most.
BLOCK_BYTES = 8 << 20


def fold(text: bytes | None) -> bytes:
    return (text or b"").translate(FOLD)


def item_windows(words: list[bytes], k: int) -> list[bytes]:
    """Runs of k words; all words as one where there are fewer; none without words."""
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


class Automaton:
    """Windows of items and the items that each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], k: int):
        self.k = k
        owners: dict[bytes, list[int]] = {}
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            for w in item_windows(fold(text).split(), k):
                owners.setdefault(w, []).append(at[name])
        self.find = ahocorasick.Automaton()
        for w, own in owners.items():
            # Bytes as Latin-1 characters: one character a byte, whatever the text's language.
            self.find.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(set(own)))))
        self.some = bool(owners)
        if self.some:
            self.find.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Which words are hit (None: none), and the items found."""
        return self.search(words)[:2]

    def search(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int], bool]:
        """Those of scan(), and whether a window of k words is among the hits."""
        if not self.some or not words:
            return None, set(), False
        flat = f" {b' '.join(words).decode('latin-1')} "
        hits, found, whole = None, set(), False
        for end, (n, own) in self.find.iter(flat):
            if hits is None:
                hits = np.zeros(len(words) + 1, np.int64)
                # The k-th space of flat stands before word k.
                space = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
            last = int(np.searchsorted(space, end))  # words before this space
            hits[last - n] += 1
            hits[last] -= 1
            found.update(own)
            whole = whole or n == self.k
        return None if hits is None else np.cumsum(hits)[:-1] > 0, found, whole


def _blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, streamed to the driver a partition at a time."""
    block, size = [], 0
    for r in items.select(F.col(item).cast("string"), F.encode(F.col(text), "UTF-8")).filter(F.col(text).isNotNull()).toLocalIterator():
        if block and size + len(r[1]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0] if r[0] is not None else "", bytes(r[1])))
        size += len(r[1])
    if block:
        yield block


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 8, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Returns key, n_words, items (ids as strings, sorted, of items with a window in the text) and spans.

    spans: array<struct<start, end>> of runs of hit words, as UTF-8 byte offsets of the original text, end exclusive.
    n_hit: hit words. One row for each input row. A null or wordless text has no words and no hits; a null or
    wordless item never occurs; repeated items count once by id; an empty benchmark hits nothing.
    """
    fields = [
        T.StructField(key, docs.schema[key].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
    arrow = pa.schema(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def finish(b: pa.RecordBatch, found: list[_Found]) -> pa.RecordBatch:
        rows = [{"n_words": f.n, "n_hit": 0 if f.hits is None else int(f.hits.sum()), "items": f.items, "spans": [] if f.hits is None else _spans(f.folded, f.hits)} for f in found]
        return pa.RecordBatch.from_arrays([b.column(0), *pa.RecordBatch.from_pylist(rows, schema=arrow).columns], names=[key, *arrow.names])

    return _scan(docs.select(key, text), text, _blocks(items, item, item_text, block_bytes), k, finish, T.StructType(fields))


def clean_documents(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 8, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents without k consecutive words of an item and with fewer than two items found. Columns stay as they are."""
    n = len(docs.columns)

    def finish(b: pa.RecordBatch, found: list[_Found]) -> pa.RecordBatch:
        keep = [not f.whole and len(f.items) < 2 for f in found]
        return pa.RecordBatch.from_arrays(b.columns[:n], names=b.schema.names[:n]).filter(pa.array(keep, pa.bool_()))

    return _scan(docs, text, _blocks(items, item, item_text, block_bytes), k, finish, docs.schema)


@dataclass
class _Found:
    """What is known of a text: its folded bytes, words, hit words (None: none), items found, and whether it holds k
    consecutive words of an item."""

    folded: bytes
    n: int
    hits: np.ndarray | None
    items: list[str]
    whole: bool


def _scan(docs: DataFrame, text: str, blocks: Iterator[list], k: int, finish: Callable, schema: T.StructType) -> DataFrame:
    """finish(batch, found) of every batch, after a scan for each block."""
    sc = docs.sparkSession.sparkContext
    n, at, own = len(docs.columns), docs.columns.index(text), fresh(docs, "_f")
    more = T._parse_datatype_string(f"{own}hits binary, {own}items array<string>, {own}whole boolean").fields

    def scan(shared, first: bool, last: bool):
        made: list[Automaton] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not made:
                    made.append(Automaton(shared.value, k))
                a, out = made[0], []
                before = zip(*(b.column(i).to_pylist() for i in range(n, n + 3))) if not first else ((None, [], False) for _ in range(b.num_rows))
                for t, (bits, items, whole) in zip(as_bytes(b.column(at)), before):
                    folded = fold(t)
                    words = folded.split()
                    hits, found, now = a.search(words)
                    if bits is not None:
                        old = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                        hits = old if hits is None else hits | old
                    out.append(_Found(folded, len(words), hits, sorted({*items, *(a.names[x] for x in found)}), whole or now))
                if last:
                    yield finish(b, out)
                    continue
                state = [
                    pa.array([None if f.hits is None else np.packbits(f.hits).tobytes() for f in out], pa.binary()),
                    pa.array([f.items for f in out], pa.list_(pa.string())),
                    pa.array([f.whole for f in out], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *state], names=[*b.schema.names[:n], *(f.name for f in more)])

        return run

    df, block, first = bounded_batches(docs), next(blocks, []), True
    while True:
        following = next(blocks, None)
        shared = sc.broadcast(block)
        if following is None:
            return df.mapInArrow(scan(shared, first, True), schema)
        done = materialize(df.mapInArrow(scan(shared, first, False), T.StructType([*docs.schema.fields, *more])), "scan")
        shared.destroy()
        if not first:
            drop_table(df)
        df, block, first = done, following, False


def _spans(folded: bytes, hits: np.ndarray) -> list[dict[str, int]]:
    data = np.frombuffer(folded, np.uint8)
    word = np.concatenate(([False], ~np.isin(data, list(b" \t\n\r\x0b\x0c")), [False]))
    edge = np.flatnonzero(np.diff(word.astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    run = np.flatnonzero(np.diff(np.concatenate(([0], hits.astype(np.int8), [0]))))
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(run[::2], run[1::2])]


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


