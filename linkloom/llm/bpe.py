"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted.

Each text is cut by the vocabulary's pattern; each piece starts as its bytes, and the adjacent pair of lowest rank is
merged again and again. A piece's count is its bytes less its merges. Counts of pieces are kept in a table of bounded
size in each Python worker. One pass over the texts, no shuffle; memory follows one batch and the longest text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import as_bytes, bounded_batches

#: Fixed values of the byte-level vocabulary format: its piece pattern, and the bytes written as themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Pieces whose counts a worker keeps.
KEPT_PIECES = 400_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printed, else the next free one from 256 on."""
    free = iter(range(256, 512))
    return [chr(b) if b in PRINTED else chr(next(free)) for b in range(256)]


class Counts(dict):
    """Piece -> tokens, worked out when first asked for."""

    def __init__(self, start: list[int], ranks: dict[tuple[int, int], tuple[int, int]]):
        super().__init__()
        self.start, self.ranks = start, ranks

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT_PIECES:
            self.clear()
        n = self.merged(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def merged(self, data: bytes) -> int:
        ranks, count = self.ranks, len(data)
        if count < 2:
            return count
        sym: list[int] = [self.start[b] for b in data]
        right, left = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(*ranks[p], i, *p) for i, p in enumerate(zip(sym, sym[1:])) if p in ranks]
        heapify(heap)
        end, n = count, count
        while heap:
            _, new, i, a, b = heappop(heap)
            j = right[i]
            if sym[i] != a or j >= end or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            n -= 1
            if k < end:
                left[k] = i
                if (p := (new, sym[k])) in ranks:
                    heappush(heap, (*ranks[p], i, *p))
            if (h := left[i]) >= 0 and (p := (sym[h], new)) in ranks:
                heappush(heap, (*ranks[p], h, *p))
        return n


class Vocabulary:
    """The parts of a byte-level BPE file (.json) that counting needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        ids = spec["model"]["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        ranks = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
        self.counts = Counts([ids[c] for c in byte_symbols()], ranks)
        self.pieces = regex.compile(PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(self, text: str) -> int:
        """Tokens of a text; added tokens inside it count one each, as the library's default has it."""
        parts = self.special.split(text) if self.special else [text]
        of = self.counts.__getitem__
        return len(parts) - 1 + sum(sum(map(of, self.pieces.findall(x))) for x in parts if x)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Returns key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), a row for each input row, in place.

    path: the vocabulary file, at the same place on every worker. A null text counts as empty: 0 tokens. Bytes that
    are not UTF-8 count as the replacement character. Other columns play no part.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = as_bytes(b.column(1))
            n = [v.count(t.decode("utf-8", "replace")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return bounded_batches(docs.select(key, text)).mapInArrow(run, schema)
