"""Benchmark decontamination: short test items inside long documents.

Items are parted by the size of their shingle set. For each part a document's shingle sequence is cut into overlapping windows of twice the
part's largest size, so that a passage as long as an item lies whole in a window of comparable size, and
minhashes of windows are looked up among those of the part's items. What minhashes can't promise, shingles do: each item lists some of its shingles, so many that
a document with enough of the item, in whatever pieces, holds a number of them, and each shingle of a document is looked up. That misses none; it is the
only way for items of up to ``CELL`` shingles. Every candidate is then verified by the exact containment of the
item's set in the whole document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import kept_rows, small_batches, text_buffers
from foliospark.llm.ngrams import as_batch
from foliospark.llm.shingles import ALPHANUMERIC, mix, shingles

#: Shingles of the cells that windows consist of.
CELL = 8
#: Minhashes of a set of more than CELL shingles. A passage with 0.8 of the shingles of such an item has a Jaccard similarity of at least 0.25 to its window, and is missed with a chance of 0.75 ** HASHES at most.
HASHES = 48
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_FILTER_BITS = 22


def _salts(part: int) -> np.ndarray:
    """Keep the minhashes of each part and hash function apart."""
    return np.arange(part * HASHES + 1, (part + 1) * HASHES + 1, dtype=np.uint64) * _FACTORS[0]


@dataclass
class ItemIndex:
    ids: list[int]
    sets: list[np.ndarray]  # sorted distinct shingles of each item
    parts: list[int]  # largest size of each part
    keys: np.ndarray  # sorted codes of (part, hash function, minhash); of listed shingles (0, 0, shingle)
    needed: np.ndarray  # of each item, how many of its listed shingles a document with enough of it holds
    items: np.ndarray  # of each key
    known: np.ndarray  # which codes can be keys, by their first bits

    def find(self, part: int, j: int, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of the minima that an item of the part has for hash function j."""
        code = mix(minima + _salts(part)[j])
        at = np.flatnonzero(self.known[(code >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(self.keys, code[at], side="left")
        number = np.searchsorted(self.keys, code[at], side="right") - low
        place = np.repeat(low - np.concatenate([[0], np.cumsum(number)[:-1]]) if len(number) else low, number) + np.arange(number.sum())
        return np.repeat(at, number), self.items[place]


def part_sizes(largest: int) -> list[int]:
    """8, 12, 16, 24, 32, 48, ...: sizes up to the largest item's."""
    out = [CELL]
    while out[-1] < largest:
        out.append(out[-1] * 3 // 2 if (out[-1] & (out[-1] - 1)) == 0 else out[-1] * 4 // 3)
    return out


def index_items(ids: list[int], texts: list[str], k: int, threshold: float = 0.8) -> ItemIndex:
    raw, offsets = as_batch(texts)
    codes, begin = shingles(raw, offsets, k, ALPHANUMERIC)
    sets = [np.unique(codes[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    kept = [i for i, s in enumerate(sets) if len(s)]
    ids, sets = [ids[i] for i in kept], [sets[i] for i in kept]
    parts = part_sizes(max(map(len, sets), default=CELL))
    keys, items, needed = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.ones(len(sets), np.int64)
    for i, s in enumerate(sets):
        lacked = next((h for h in range(len(s)) if len(s) - h - 1 < threshold * len(s)), len(s) - 1)  # at most, of a document with enough of the item
        part = next(p for p, most in enumerate(parts) if most >= len(s))
        needed[i] = 1 if part == 0 else min(len(s) - lacked, lacked + 1)
        keys.append(mix(s[: lacked + int(needed[i])] + _salts(0)[0]))
        if part:
            keys.append(mix((s[:, None] * _FACTORS[None, :]).min(0) + _salts(part)))
        items += [np.full(len(k), i) for k in keys[-1 - bool(part):]]
    keys, items = np.concatenate(keys), np.concatenate(items)
    order = np.argsort(keys, kind="stable")
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return ItemIndex(ids, sets, parts, keys[order], needed, items[order], known)


def candidates(index: ItemIndex, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(row, item) pairs that share enough listed shingles of the item, or whose windows share a minhash, each once."""
    rows = len(begin) - 1
    cells = -(-np.diff(begin) // CELL)
    first_cell = np.concatenate([[0], np.cumsum(cells)])
    if not first_cell[-1]:
        return np.zeros((0, 2), np.int64)
    cuts = np.repeat(begin[:-1] - first_cell[:-1] * CELL, cells) + np.arange(first_cell[-1]) * CELL
    views = []
    for p, most in enumerate(index.parts[1:], 1):
        length = 2 * most // CELL
        step = length // 2
        number = np.where(cells > 0, np.maximum(1, -(-(cells - length) // step) + 1), 0)
        row = np.repeat(np.arange(rows), number)
        begins = first_cell[:-1][row] + step * (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
        ends = np.minimum(begins + length, first_cell[1:][row])
        views.append((p, row, np.stack([begins, ends], 1).ravel()))
    at, item = index.find(0, 0, codes)
    found = []
    if len(at):
        pair, code = (np.searchsorted(begin, at, side="right") - 1) * len(index.ids) + item, codes[at]
        order = np.lexsort((code, pair))
        pair, code = pair[order], code[order]
        new = np.append(True, (pair[1:] != pair[:-1]) | (code[1:] != code[:-1]))
        pair, held = np.unique(pair[new], return_counts=True)
        found.append(pair[held >= index.needed[pair % len(index.ids)]])
    for j in range(HASHES if views else 0):
        minima = np.append(np.minimum.reduceat(codes * _FACTORS[j], cuts), np.uint64(2**64 - 1))
        for p, row, spans in views:
            at, item = index.find(p, j, np.minimum.reduceat(minima, spans)[::2])
            if len(at):
                found.append(row[at] * len(index.ids) + item)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.stack(np.divmod(pairs, max(1, len(index.ids))), 1)


def leaks(documents: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """Items of which a document holds at least ``threshold``: ``doc_id``, ``item_id``, ``item_shingles``, ``shared``, ``containment``.

    Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z. Items go to the workers in blocks of about
    ``block_chars`` characters, each matched with all documents, so no broadcast follows the size of the benchmark. A text of fewer than
    ``words`` words has one shingle, the whole, so an item that short is found only where it is all of a document; null texts and texts without words have none and match nothing. Each row of a repeated
    id is searched by itself.
    """
    out = None
    for index in _blocks(documents, benchmark, words, threshold, block_chars):

        def search(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(_hits(index.value, batch.column(1), words, threshold))
                if hits:
                    row, item, n, held = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(n, pa.int32()), pa.array(held, pa.int32()),
                         pa.array(np.array(held) / np.array(n), pa.float64())],
                        names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        part = documents.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, item_shingles int, shared int, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """The rows whose text holds no item (see ``leaks``); all columns stay."""
    for index in _blocks(documents, benchmark, words, threshold, block_chars):

        def clean(x: list[pa.Array], index: Broadcast = index) -> np.ndarray:
            mask = np.ones(len(x[0]), bool)
            mask[[hit[0] for hit in _hits(index.value, x[0], words, threshold)]] = False
            return mask

        documents = kept_rows(documents, [F.col("text")], clean)
    return documents


def _blocks(documents: DataFrame, benchmark: DataFrame, words: int, threshold: float, block_chars: int) -> Iterator[Broadcast]:
    """The items' index in parts of bounded size; one empty part if there are none."""
    spark = documents.sparkSession
    small_batches(spark, 128)
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    for b in range(blocks):
        rows = benchmark.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).select("item_id", "text").collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield spark.sparkContext.broadcast(index_items([r["item_id"] for r in rows], [r["text"] for r in rows], words, threshold))


def _hits(index: ItemIndex, texts: pa.Array, words: int, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item id, item's shingles, shared shingles) of verified candidates."""
    codes, begin = shingles(*text_buffers(texts), words, ALPHANUMERIC)
    last, own = -1, None
    for row, item in candidates(index, codes, begin).tolist():
        if row != last:
            own, last = np.unique(codes[begin[row]:begin[row + 1]]), row
        s = index.sets[item]
        held = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
        if held >= threshold * len(s):
            yield row, index.ids[item], len(s), held
