"""Unigram encoding and decoding with the pieces of a SentencePiece model file.

A text is cut into the pieces with the largest sum of log scores (Viterbi over a double-array trie of UTF-8 bytes). Spaces
become the marker U+2581 and one stands before the text; a character without a piece becomes its bytes.
All start positions of a batch walk the trie together, and all distinct words of a batch share one Viterbi pass.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foliospark.llm.common import small_batches, text_buffers

MARK = "▁"
#: What an unknown character costs below the worst piece, as in the library that defined the format.
UNKNOWN_PENALTY = 10.0
#: Where public vocabularies lie by default; FOLIOSPARK_PIECES or the argument ``path`` names another model.
MODEL = os.environ.get("FOLIOSPARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = {}
        for number, key in enumerate(keys):
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                at = children[at][c]
            ends[at] = number
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free, wide, taken = 257, 257, bytearray(size)  # no base is negative: the first slots stay empty
        taken[0] = 1
        todo = deque([(0, 0)])
        while todo:
            node, state = todo.popleft()
            value[state] = ends.get(node, -1)
            if not children[node]:
                continue
            codes = sorted(children[node])
            while taken[free]:
                free += 1
            start = (free if len(codes) == 1 else wide) - codes[0] - 1
            while any(taken[start + c + 1] for c in codes):
                start += 1
                while start + 300 > len(taken):
                    taken.extend(bytes(len(taken)))
            if len(codes) > 1:  # families are placed ever further on, single children fill the gaps
                wide = max(wide, start + codes[0] + 1)
            if start + 300 > len(base):
                grow = max(len(taken), 2 * len(base)) - len(base)
                base, check, value = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32)), np.append(value, np.full(grow, -1, np.int32))
            base[state] = start
            for c in codes:
                taken[start + c + 1], check[start + c + 1] = 1, state
                todo.append((children[node][c], start + c + 1))
        self.base, self.check, self.value = base, check, value

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        t = self.base[state] + byte + 1
        return np.where(self.check[np.minimum(t, len(self.check) - 1)] == state, t, -1)


@dataclass
class Unigram:
    trie: DoubleArray
    ids: np.ndarray  # of each key of the trie
    scores: np.ndarray  # of each key of the trie
    byte_ids: np.ndarray  # 256 ids of the byte pieces
    surface: pa.BinaryArray  # bytes that an id decodes to
    words_apart: bool  # no piece reaches over the start of a word
    lines_apart: bool  # no piece holds a line feed

    @classmethod
    def load(cls, path: str = MODEL, scores: str = "zipf") -> Unigram:
        """Read the pieces of a model file with byte fallback.

        ``scores`` "model" takes the file's scores. They are log probabilities in a unigram model; a BPE file holds
        merge ranks there, so that "zipf" makes log probabilities of them: -log(r * H) for the piece with the r-th best score, H normalising.
        """
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        size = p.vocab_size()
        normal = [i for i in range(size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        bytes_ = {int(p.id_to_piece(i)[3:5], 16): i for i in range(size) if p.is_byte(i)}
        if len(bytes_) < 256:
            raise ValueError(f"{path} has no byte fallback")
        own = np.array([p.get_score(i) for i in normal], np.float32)
        if scores == "zipf":
            rank = np.empty(len(normal))
            rank[np.argsort(-own, kind="stable")] = np.arange(1, len(normal) + 1)
            own = -np.log(rank * (1 / np.arange(1, len(normal) + 1)).sum()).astype(np.float32)
        pieces = [p.id_to_piece(i) for i in normal]
        surface = [b""] * size
        for i, x in zip(normal, pieces, strict=True):
            surface[i] = x.replace(MARK, " ").encode()
        for b, i in bytes_.items():
            surface[i] = bytes([b])
        return cls(DoubleArray([x.replace(MARK, " ").encode() for x in pieces]), np.array(normal, np.int32), own.astype(np.float32),
                   np.array([bytes_[b] for b in range(256)], np.int32), pa.array(surface, pa.binary()),
                   all(MARK not in x.lstrip(MARK) for x in pieces), not any("\n" in x for x in pieces))

    def _edges(self, data: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key) of each piece in the bytes; key -1 for a character without one. ``end_of``: of each byte's word."""
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(begins, len(data)))
        width = np.minimum(width, end_of[begins] - begins)
        at, state, depth = begins, np.zeros(len(begins), np.int64), 0
        known = np.zeros(len(data), bool)
        starts, ends, keys = [], [], []
        char_end = np.zeros(len(data), np.int64)
        char_end[begins] = begins + width
        while len(at):
            state = self.trie.step(state, data[at + depth].astype(np.int64))
            depth += 1
            live = state >= 0
            at, state = at[live], state[live]
            key = self.trie.value[state]
            hit = key >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            keys.append(key[hit])
            known[at[hit & (at + depth == char_end[at])]] = True
            more = at + depth < end_of[at]
            at, state = at[more], state[more]
        lost = begins[~known[begins]]
        starts.append(lost)
        ends.append(char_end[lost])
        keys.append(np.full(len(lost), -1, np.int32))
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(keys)

    def viterbi(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a batch, one after another, and where each word's ids begin."""
        words, sizes = len(offsets) - 1, np.diff(offsets)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(words + 1, np.int64)
        word_of = np.repeat(np.arange(words), sizes)
        start, end, key = self._edges(data, np.repeat(offsets[1:], sizes))
        gain = np.where(key >= 0, self.scores[np.maximum(key, 0)], self.scores.min() - np.float32(UNKNOWN_PENALTY)).astype(np.float32)
        word = word_of[start]
        into = start - offsets[word]
        order = np.lexsort((end, into))
        start, end, key, gain, word, into = (x[order] for x in (start, end, key, gain, word, into))
        node_from, node_to = start + word, end + word  # a word of n bytes has n + 1 nodes
        best = np.full(len(data) + words, -np.inf, np.float32)
        best[offsets[:-1] + np.arange(words)] = 0
        back = np.full(len(best), -1, np.int64)
        cuts = np.flatnonzero(np.diff(into, prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(into)), strict=True):  # edges that begin equally deep don't share ends
            sum_ = best[node_from[low:high]] + gain[low:high]
            to = node_to[low:high]
            better = np.flatnonzero(sum_ > best[to])
            best[to[better]], back[to[better]] = sum_[better], better + low
        chosen = []
        node = (offsets[1:] + np.arange(words))[sizes > 0]
        while len(node):
            edge = back[node]
            chosen.append(edge)
            node = node_from[edge]
            node = node[back[node] >= 0]
        edge = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        edge = edge[np.argsort(start[edge], kind="stable")]
        plain = key[edge] >= 0
        number = np.where(plain, 1, end[edge] - start[edge])
        first = np.zeros(len(edge) + 1, np.int64)
        np.cumsum(number, out=first[1:])
        ids = np.repeat(np.where(plain, self.ids[np.maximum(key[edge], 0)], -1), number)
        source = np.repeat(start[edge] - first[:-1], number) + np.arange(len(ids))
        raw = np.flatnonzero(ids < 0)
        ids[raw] = self.byte_ids[data[source[raw]]]
        begin = np.zeros(words + 1, np.int64)
        np.cumsum(np.bincount(word[edge], number, words).astype(np.int64), out=begin[1:])
        return ids.astype(np.int32), begin

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a batch of UTF-8 texts and where each text's ids begin; an empty text has none."""
        sizes = np.diff(offsets)
        full = sizes > 0
        shifted = offsets + np.concatenate([[0], np.cumsum(full)])
        data = np.full(shifted[-1], 32, np.uint8)
        data[np.arange(len(raw)) + np.repeat(np.cumsum(full), sizes)] = raw
        cut = np.zeros(len(data) + 1, bool)
        if self.words_apart:
            cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        if self.lines_apart:
            line = data == 10
            cut[:-1] |= line
            cut[1:] |= line
        cut[shifted] = True
        cuts = np.flatnonzero(cut)
        words = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        coded = pc.dictionary_encode(words)
        used, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, begin = self.viterbi(*text_buffers(used))
        lengths = np.diff(begin)[at]
        out = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=out[1:])
        flat = ids[np.repeat(begin[at] - out[:-1], lengths) + np.arange(out[-1])]
        return flat, out[np.searchsorted(cuts, shifted)]

    def encode_all(self, raw: np.ndarray, offsets: np.ndarray, limit: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` in turns of about ``limit`` bytes, so that memory doesn't follow the batch.

        A longer text is cut before a space that follows another character: words are encoded apart, and each piece's own first space stands for the one left out.
        """
        turns: list[list[tuple[int, int, int]]] = [[]]
        size = 0
        for row in range(len(offsets) - 1):
            at, end = int(offsets[row]), int(offsets[row + 1])
            while True:
                stop = end
                if end - at > limit and self.words_apart:
                    there = np.flatnonzero((raw[at + limit // 2:at + limit] == 32) & (raw[at + limit // 2 - 1:at + limit - 1] != 32))
                    stop = at + limit // 2 + int(there[-1]) if len(there) else end
                if size and size + stop - at > limit:
                    turns.append([])
                    size = 0
                turns[-1].append((row, at, stop))
                size += stop - at
                if stop == end:
                    break
                at = stop + 1
        parts, number = [np.zeros(0, np.int32)], np.zeros(len(offsets), np.int64)
        for turn in turns:
            data = np.concatenate([raw[a:b] for _, a, b in turn]) if len(turn) > 1 else raw[turn[0][1]:turn[0][2]] if turn else raw[:0]
            ids, begin = self.encode(data, np.concatenate([[0], np.cumsum([b - a for _, a, b in turn])]).astype(np.int64))
            parts.append(ids)
            np.add.at(number, [row + 1 for row, _, _ in turn], np.diff(begin))
        return np.concatenate(parts), np.cumsum(number)

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of a batch of id lists and their offsets; markers become spaces and the one before the text goes. Control pieces are empty."""
        taken = self.surface.take(pa.array(ids))
        raw, piece = text_buffers(taken)
        offsets = piece[begin]
        lead = (offsets[1:] > offsets[:-1]) & (raw[np.minimum(offsets[:-1], len(raw) - 1)] == 32) if len(raw) else np.zeros(len(begin) - 1, bool)
        keep = np.ones(len(raw), bool)
        keep[offsets[:-1][lead]] = False
        return raw[keep], offsets - np.concatenate([[0], np.cumsum(lead)])


def encode(documents: DataFrame, path: str = MODEL, scores: str = "zipf") -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens`` and ``round_trip`` (decoding gives the text again) of each whole text.

    Null and empty texts have no ids and count as round trips. A text that holds the marker U+2581 itself decodes to a space there.
    """
    spark = documents.sparkSession
    small_batches(spark, 128)
    model = spark.sparkContext.broadcast(Unigram.load(path, scores))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            if not batch.num_rows:
                continue
            ids, begin = model.value.encode_all(raw, offsets)
            again, places = model.value.decode(ids, begin)
            same = np.diff(places) == np.diff(offsets)
            if same.all():
                wrong = np.flatnonzero(again != raw)
                same[np.searchsorted(offsets, wrong, side="right") - 1] = False
            else:
                same = np.array([bytes(again[a:b]) == bytes(raw[c:d]) for a, b, c, d in zip(places[:-1], places[1:], offsets[:-1], offsets[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)), pa.array(np.diff(begin).astype(np.int32)), pa.array(same)],
                names=["doc_id", "ids", "n_tokens", "round_trip"])

    return documents.select("doc_id", "text").mapInArrow(apply, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL, scores: str = "zipf") -> DataFrame:
    """``doc_id`` and ``text`` of lists of ids; null lists decode to empty texts, bytes that aren't UTF-8 to U+FFFD."""
    spark = encoded.sparkSession
    small_batches(spark, 128)
    model = spark.sparkContext.broadcast(Unigram.load(path, scores))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            begin = lists.offsets.to_numpy().astype(np.int64)
            raw, offsets = model.value.decode(lists.values.to_numpy(zero_copy_only=False)[begin[0]:begin[-1]], begin - begin[0])
            texts = [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(apply, "doc_id long, text string")
