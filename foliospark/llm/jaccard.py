"""Exact n-gram Jaccard join, with classes of linked documents, by set relations.

Documents are sets of word shingles. Sets are ordered by a count sketch of the whole corpus (rare shingles first), so that two similar
sets share one of their first shingles (prefix filter). The index lists sets by those shingles with the shingle's position in the set, in blocks
of positions: a set skips the blocks of a list whose positions leave too few shingles to share, and in the other blocks the sizes that can't match.
Parity bitmaps bound the overlap of the rest. Of lists that hold the same sets one is read.

Each list gives a spanning forest of its candidates only; what candidates connect is a cluster, and no link leaves one. Each set then travels once to
the task of its cluster. There a set's answer, its overlap with all sets of the cluster, is derived from that of the most similar set answered
before: only shingles that one of both lacks are looked up. Sets of the largest class needn't be answered, since the others' answers hold
their links. Large clusters are cut into blocks; links between blocks are searched for the sets outside of the cluster's largest class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from foliospark.llm.common import IdFilter, attach_groups, kept_rows, small_batches, text_buffers, unused, written
from foliospark.llm.components import components
from foliospark.llm.shingles import mix, shingles

#: Counters of the sketch (least, most, bytes of text for each between) and those of the pieces that it travels in.
SKETCH, LARGEST_SKETCH, SERVED, PIECE = 1 << 20, 1 << 24, 1 << 12, 1 << 15
#: Tasks that count for the sketch, if they have less than so many bytes of text for each counter that they send.
COUNTING_TASKS, COUNTED = 64, 64
#: Bits of a set's parity bitmap: half as many as its shingles up to the next power of 2, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 9, 1 << 16
#: Positions in a block of a list.
POSITIONS = 16
#: Rows of a list whose candidates are told apart; in a larger one all sets are candidates of each other.
BLOCK = 2048
#: Sets and bytes of text that a block of a cluster holds about.
SETS, BYTES = 2048, 8 << 20
#: Answers that a task keeps at a time to derive others from.
ANSWERS = 32


def _ratio(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def count_sketch(documents: DataFrame, k: int) -> np.ndarray:
    """How often shingles occur in the corpus, by hash: an upper bound for each, up to 2**32 - 1. More text gets more counters, within bounds.

    It only orders shingles: however full it gets, no link is lost.
    """
    documents = documents.select("text")
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = min(LARGEST_SKETCH, max(SKETCH, 1 << (size // SERVED).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            codes, _ = shingles(*text_buffers(batch.column(0)), k)
            np.add(total, np.bincount((codes & np.uint64(width - 1)).astype(np.int64), minlength=width), out=total)
        parts = [p.tobytes() for p in total.reshape(-1, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")), np.zeros(PIECE, np.int64))
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    number = min(documents.rdd.getNumPartitions(), max(COUNTING_TASKS, size // (COUNTED * width)))
    documents = documents.coalesce(number)
    parts = documents.mapInArrow(count, "piece int, counts binary")
    while number > 64:  # no task adds up more than 64 pieces
        number = -(-number // 64)
        parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(number))).groupBy("piece", "salt").applyInArrow(add, "piece int, counts binary")
    total = np.zeros((width // PIECE, PIECE), np.uint32)
    for r in parts.groupBy("piece").applyInArrow(add, "piece int, counts binary").toLocalIterator():
        total[r["piece"]] = np.minimum(np.frombuffer(r["counts"], np.int64), 2**32 - 1)
    return total.ravel()


def _set_key(u: np.ndarray) -> bytes:
    """Equal for equal sets of shingles."""
    return np.array([mix(u).sum(), np.bitwise_xor.reduce(u * np.uint64(3)) if len(u) else 0, len(u)], np.uint64).tobytes()


def signatures(documents: DataFrame, sketch: Broadcast, k: int, percent: int) -> DataFrame:
    """Of each row: its set's size and key (equal for equal sets), the text's bytes, parity bitmap, and the set's first shingles, rare ones first.

    Bit i of the bitmap tells whether an odd number of shingles has i as its last bits.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            codes, begin = shingles(raw, offsets, k)
            size, key, bits, first = [], [], [], []
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                u = np.unique(codes[a:b])
                n = len(u)
                size.append(n)
                key.append(_set_key(u))
                width = min(MOST_BITS, max(LEAST_BITS, 1 << (n // 2).bit_length()))
                bits.append(np.packbits(np.bincount((u & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes())
                order = np.lexsort((u, counts[(u & np.uint64(len(counts) - 1)).astype(np.int64)]))
                first.append(u[order[: n - _ratio(n, percent) + 1 if n else 0]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), pa.array(key, pa.binary()), pa.array(np.diff(offsets)), pa.array(bits, pa.binary()), _lists(first, pa.int64())],
                names=["doc_id", "n", "set_key", "bytes", "bits", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(sign, "doc_id long, n int, set_key binary, bytes long, bits binary, tokens array<long>")


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _least(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The least node that edges reach from each of the nodes 0, 1, ..."""
    label = np.arange(nodes)
    while True:
        low, was = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = np.minimum(label, label[label])
        if (was == label).all():
            return label


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a spanning forest: rounds that pick an edge of each tree to another."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a):]
    label, left, chosen = np.arange(len(nodes)), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        left = left[label[u[left]] != label[v[left]]]
        if not len(left):
            return np.concatenate(chosen)
        upper = np.maximum(label[u[left]], label[v[left]])  # each tree joins one with a lower label: no circles
        _, first = np.unique(upper, return_index=True)
        pick = left[first]
        chosen.append(pick)
        label = _least(label[u[pick]], label[v[pick]], len(nodes))[label]


class Bitmaps:
    """Parity bitmaps of unlike widths; the wider of two is folded."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_buffers(column)
        width = np.diff(offsets)
        self.kind = (width * 8 // LEAST_BITS).astype(np.float64)
        self.kind = np.log2(np.maximum(self.kind, 1)).astype(np.int64)
        self.place, self.rows = np.zeros(len(width), np.int64), {}
        for k in np.unique(self.kind).tolist():
            at = np.flatnonzero(self.kind == k)
            self.place[at] = np.arange(len(at))
            size = (LEAST_BITS // 8) << k
            self.rows[k] = np.ascontiguousarray(raw[offsets[at][:, None] + np.arange(size)]).view(np.uint64)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many shingles the sets differ at least, pair by pair."""
        out = np.empty(len(x), np.int64)
        kinds = self.kind[x] * 64 + self.kind[y]
        for kind in np.unique(kinds).tolist():
            at, (i, j) = np.flatnonzero(kinds == kind), divmod(kind, 64)
            step = max(1, (1 << 22) // self.rows[max(i, j)].shape[1] // 8)
            for low in range(0, len(at), step):
                part = at[low:low + step]
                p, q = self.rows[i][self.place[x[part]]], self.rows[j][self.place[y[part]]]
                while p.shape[1] > q.shape[1]:
                    p = p[:, : p.shape[1] // 2] ^ p[:, p.shape[1] // 2:]
                while q.shape[1] > p.shape[1]:
                    q = q[:, : q.shape[1] // 2] ^ q[:, q.shape[1] // 2:]
                out[part] = np.bitwise_count(p ^ q).sum(1)
        return out


def _pairs(listed: np.ndarray, at: np.ndarray, n: np.ndarray, bits: Bitmaps, percent: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) of candidates of the same list, in slices; with ``label`` only those whose labels differ.

    Rows are sorted by list, block of positions and set size. With its shingle at position p and q, sets of n and m have min(p, q) + min(n - p, m - q) in common
    at most, so a set of n only visits the blocks up to n * (1 - t) / t positions on, and there the sizes from t * n to n / t.
    """
    block = at // POSITIONS
    group = listed * (int(block.max()) + 1) + block
    key = (group << 32) + n
    low, high = -(-n * percent // 100), n * 100 // percent
    reach = np.minimum((at + n * (100 - percent) // percent) // POSITIONS, block.max()) - block
    rows = np.arange(len(n))
    for step in range(int(reach.max()) + 1):
        rows = rows[reach[rows] >= step]
        there = (group[rows] + step) << 32
        begin = rows + 1 if step == 0 else np.searchsorted(key, there + low[rows], side="left")
        number = np.maximum(0, np.searchsorted(key, there + high[rows], side="right") - begin)
        ends = np.cumsum(number)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + 1_000_000, 1_000_000) if len(ends) else [0]))
        for a, b in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
            m = number[a:b]
            x = np.repeat(rows[a:b], m)
            y = np.arange(len(x)) + np.repeat(begin[a:b] - np.cumsum(m) + m, m)
            p, q, s, t = at[x], at[y], n[x], n[y]
            ok = (np.minimum(p, q) + np.minimum(s - p, t - q)) * (100 + percent) >= percent * (s + t)
            if label is not None:
                ok &= label[x] != label[y]
            x, y = x[ok], y[ok]
            near = bits.apart(x, y) * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
            if near.any():
                yield x[near], y[near]


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect what candidates of some list connect, as stars: no more rows than the lists have."""

    def forest(table: pa.Table) -> pa.RecordBatch | None:
        node, at, n = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "position", "n"))
        bits = Bitmaps(table.column("bits"))
        token = table.column("token").to_numpy()
        listed = np.cumsum(np.append(0, token[1:] != token[:-1]))
        a, b, size = [], [], 0

        def shrink() -> None:
            nonlocal a, b, size
            x, y = np.concatenate(a), np.concatenate(b)
            keep = _forest(x, y)
            a, b, size = [x[keep]], [y[keep]], len(keep)

        for x, y in _pairs(listed, at, n, bits, percent):
            a.append(node[x])
            b.append(node[y])
            size += len(x)
            if size > 500_000:
                shrink()
        if not size:
            return None
        shrink()
        nodes, ends = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        least = nodes[_least(ends[: len(a[0])], ends[len(a[0]):], len(nodes))]
        return pa.RecordBatch.from_arrays([pa.array(nodes[least < nodes]), pa.array(least[least < nodes])], names=["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["token"], 4 * BLOCK):
            out = forest(table)
            if out is not None:
                yield out

    return (lists.repartition("token").sortWithinPartitions("token", F.expr(f"position div {POSITIONS}"), "n", "node")
            .select("token", "position", "node", "n", "bits").mapInArrow(join, "a long, b long"))


def _open_questions(lists: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``block``: sets outside of their cluster's main class, and blocks that hold a candidate of theirs with another label.

    ``lists`` are those of ``_candidates``, with each set's ``label``, its cluster's ``main`` one and its ``block``. Of two sets that ask, the later one does.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["token"], 4 * BLOCK):
            node, at, n, label, main, block = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "position", "n", "label", "main", "block"))
            bits, token = Bitmaps(table.column("bits")), table.column("token").to_numpy()
            found = np.zeros((0, 2), np.int64)
            for x, y in _pairs(np.cumsum(np.append(0, token[1:] != token[:-1])), at, n, bits, percent, label):
                mine = (label[x] != main[x]) & ((label[y] == main[y]) | (node[x] > node[y]))
                x, y = np.where(mine, x, y), np.where(mine, y, x)
                found = np.unique(np.concatenate([found, np.stack([node[x], block[y]], 1)]), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1], pa.int32())], names=["node", "block"])

    return (lists.repartition("token").sortWithinPartitions("token", F.expr(f"position div {POSITIONS}"), "n", "node")
            .select("token", "position", "node", "n", "bits", "label", "main", "block").mapInArrow(ask, "node long, block int").distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int, size: str | None = None) -> Iterator[pa.Table]:
    """Runs of whole groups out of sorted batches, of ``rows`` rows or ``BYTES`` in the column ``size`` about, or of one group where that is larger."""
    held: list[pa.RecordBatch] = []
    number = weight = 0

    def cut(table: pa.Table) -> int:
        """Where the last group begins."""
        other = np.zeros(table.num_rows - 1, bool)
        for c in key:
            x = table.column(c).to_numpy()
            other |= x[1:] != x[:-1]
        ends = np.flatnonzero(other)
        return int(ends[-1]) + 1 if len(ends) else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        number += batch.num_rows
        weight += int(batch.column(size).to_numpy().sum()) if size else 0
        if number < rows and weight < BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = cut(table)
        if at:
            yield table.slice(0, at)
        rest = table.slice(at).combine_chunks()
        held, number = rest.to_batches(), rest.num_rows
        weight = int(rest.column(size).to_numpy().sum()) if size else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Answers:
    """Overlaps of each set of one block with all of them; an answer is derived from that of a similar set."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.n = np.array([len(s) for s in sets], np.int64)
        tokens, self.of_set = np.unique(np.concatenate(sets), return_inverse=True)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.rows = np.repeat(np.arange(len(sets)), self.n)[np.argsort(self.of_set, kind="stable")]
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(self.of_set, minlength=len(tokens)))])
        self.mark = np.zeros(len(tokens), bool)
        self.kept: dict[int, np.ndarray] = {}

    def _tokens(self, x: int) -> np.ndarray:
        return self.of_set[self.begin[x]:self.begin[x + 1]]

    def _count(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the shingles each set holds."""
        low, m = self.lists[tokens], self.lists[tokens + 1] - self.lists[tokens]
        at = np.arange(m.sum()) + np.repeat(low - np.cumsum(m) + m, m)
        return np.bincount(self.rows[at], minlength=len(self.n))

    def _less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        self.mark[y] = True
        out = x[~self.mark[x]]
        self.mark[y] = False
        return out

    def overlaps(self, x: int) -> np.ndarray:
        best, like = -1, 0.5
        for r, o in self.kept.items():
            share = o[x] / (self.n[x] + self.n[r] - o[x])
            if share > like:
                best, like = r, share
        mine = self._tokens(x)
        if best < 0:
            out = self._count(mine)
        else:
            theirs = self._tokens(best)
            out = self.kept[best] + self._count(self._less(mine, theirs)) - self._count(self._less(theirs, mine))
        if like < 0.9:
            if len(self.kept) == ANSWERS:
                self.kept.pop(next(iter(self.kept)))
            self.kept[x] = out
        return out

    def links(self, x: int) -> np.ndarray:
        """The sets that link with set ``x``, itself among them."""
        o = self.overlaps(x)
        return np.flatnonzero((o > 0) & (100 * o >= self.percent * (self.n + self.n[x] - o)))


def classes(sets: list[np.ndarray], percent: int, label: np.ndarray, ask: np.ndarray | None = None) -> np.ndarray:
    """The labels of ``classes_and_links``."""
    return classes_and_links(sets, percent, label, ask)[0]


def classes_and_links(sets: list[np.ndarray], percent: int, label: np.ndarray, ask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The labels, where labels that links connect have become their least one; and the number of links of each set that was answered.

    ``ask`` marks the sets whose links to all others are searched; without it all links count: sets are answered until all that aren't have one label.
    """
    answers, (names, label) = Answers(sets, percent), np.unique(label, return_inverse=True)
    degree = np.zeros(len(sets), np.int64)
    todo = np.ones(len(sets), bool) if ask is None else ask.copy()
    while True:
        open_ = np.flatnonzero(todo)
        if ask is None and len(open_):
            open_ = open_[label[open_] != np.bincount(label[open_]).argmax()]
        if not len(open_):
            return names[label], degree
        x = int(open_[0])
        todo[x] = False
        links = answers.links(x)
        degree[x] = len(links)
        joined = np.unique(label[links])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]


def _classes(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``node``, its ``label`` and the ``least`` label that links reach from there within the block, where that is another; and one row, marked as
    ``central``, for each class of two sets or more: of those answered the set with the most links.

    ``rows``: ``cluster``, ``block``, ``chunk``, ``node``, ``label``, ``ask`` (null: see ``classes_and_links``), ``bytes`` and ``text``.
    """
    key = ["cluster", "block", "chunk"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key, 256, "bytes"):
            codes, begin = shingles(*text_buffers(table.column("text")), words)
            node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
            ask = table.column("ask").to_numpy(zero_copy_only=False)
            other = np.zeros(table.num_rows - 1, bool)
            for c in key:
                x = table.column(c).to_numpy()
                other |= x[1:] != x[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(other) + 1, [table.num_rows]])
            least, central = label.copy(), np.zeros(len(label), bool)
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                sets = [np.unique(codes[begin[i]:begin[i + 1]]) for i in range(low, high)]
                least[low:high], degree = classes_and_links(sets, percent, label[low:high], None if ask[low] is None else ask[low:high].astype(bool))
                best = np.lexsort((-degree, least[low:high]))
                best = best[np.append(True, np.diff(least[low:high][best]) != 0)]
                central[low + best] = degree[best] > 1
            new = np.flatnonzero((least != label) | central)
            if len(new):
                columns = [pa.array(x[new], pa.int64()) for x in (node, label, least)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(central[new])], names=["node", "label", "least", "central"])

    return (rows.repartition(*key).sortWithinPartitions(*key, "node")
            .select(*key, "node", "label", "ask", "bytes", "text").mapInArrow(search, "node long, label long, least long, central boolean"))


def classes_of_clusters(documents: DataFrame, sets: DataFrame, clusters: DataFrame, shared: DataFrame, words: int, percent: int) -> DataFrame:
    """``node`` and ``component`` of sets that link with one of a lower id. ``sets`` has ``node``, ``n``, ``bits`` and ``bytes``, ``clusters`` ``node`` and
    ``component``, ``shared`` the lists (``token``, ``position``, ``node``, ``large``).

    A cluster of one block is done in one task. Of larger ones, the blocks come first. Then one set of each class of a block, that with the most links,
    visits a few other blocks (those 1, 2, 4, ... further on), and classes that it links are one: so a large group of near copies becomes one class
    while each set travels once. Last, the sets outside of the cluster's largest class go to the blocks where the lists show a candidate of theirs
    that isn't of their class; those of large lists, whose candidates aren't told apart, to all blocks.
    """
    members = written(clusters.join(sets.select("node", "bytes"), "node").withColumnRenamed("component", "cluster"), "members")
    number = lambda size, weight: F.greatest(F.ceil(size / F.lit(SETS)), F.ceil(weight / F.lit(BYTES)), F.lit(1)).cast("int")
    sizes = (members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("bytes").alias("weight"))
             .select("cluster", "size", number(F.col("size"), F.col("weight")).alias("blocks")))
    sizes = written(sizes, "sizes")
    total, most = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    place = lambda salt, of: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
    placed = attach_groups(members, sizes, "cluster", "size", total).withColumn("block", place(1, "blocks"))
    needed = IdFilter(members, "node")
    texts = kept_rows(documents.filter(F.col("doc_id").isNotNull()), [IdFilter.slot(F.col("doc_id"))], lambda x: needed.may_hold(x[0])).withColumnRenamed("doc_id", "node")
    inside = placed.select("cluster", "block", F.lit(0).alias("chunk"), "node", F.col("node").alias("label"), F.lit(None).cast("boolean").alias("ask"), "bytes").join(texts, "node")
    answered = written(_classes(inside, words, percent), "found")
    found = answered.filter("least <> label").select("node", F.col("least").alias("component"))
    if most <= 1:
        return found
    columns = ["cluster", "block", "chunk", "node", "label", "ask", "bytes"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    large = written(placed.filter("blocks > 1").join(found, "node", "left").select("cluster", "blocks", "block", "node", F.coalesce("component", "node").alias("label"), "bytes"), "large")

    further = F.explode(F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda x: x < F.col("blocks")))
    visitors = (large.join(answered.filter("central").select("node"), "node", "left_semi").withColumn("further", further)
                .withColumn("block", F.pmod(F.col("block") + F.col("further"), F.col("blocks"))))
    hosts = large.withColumn("chunk", F.lit(0))
    met = _classes(visitors.withColumn("chunk", F.lit(0)).withColumn("ask", F.lit(True)).select(columns).unionByName(hosts.withColumn("ask", F.lit(False)).select(columns)).join(texts, "node"), words, percent)
    large = written(_renamed(large, met, total), "large")

    main = large.groupBy("cluster", "label").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("size"))
    large = written(attach_groups(large, written(main, "main"), "cluster", "size", total), "large")
    asks = large.filter("label <> main")
    anywhere = asks.join(shared.filter("large").select("node"), "node", "left_semi").select("node", each("blocks").alias("block"))
    listed = shared.filter("NOT large").join(large.select("node", "label", "main", "block"), "node").join(sets.select("node", "n", "bits"), "node")
    asking = written(_open_questions(listed, percent).unionByName(anywhere).distinct().join(asks.drop("block"), "node").withColumn("spot", F.struct("cluster", "block")), "asking")
    spots = written(asking.groupBy("spot").agg(F.count("*").alias("size"), number(F.count("*"), F.sum("bytes")).alias("chunks")), "spots")
    asked = spots.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    asking = attach_groups(asking, spots, "spot", "size", asked).withColumn("chunk", place(2, "chunks")).withColumn("ask", F.lit(True))
    held = large.withColumn("spot", F.struct("cluster", "block")).join(spots.select("spot", "chunks"), "spot").withColumn("chunk", each("chunks")).withColumn("ask", F.lit(False))
    links = _classes(asking.select(columns).unionByName(held.select(columns)).join(texts, "node"), words, percent)
    changed = written(_renamed(large, links, total).filter("node <> label").select("node", F.col("label").alias("component")), "changed")
    return found.join(large.select("node"), "node", "left_anti").unionByName(changed)


def _renamed(rows: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """``rows`` with the least ``label`` that the ``links`` (``label``, ``least``) of all blocks reach."""
    roots = components(links.filter("least <> label").select(F.col("label").alias("a"), F.col("least").alias("b")))
    names = rows.groupBy("label").agg(F.count("*").alias("size")).join(roots.withColumnRenamed("node", "label").withColumnRenamed("component", "root"), "label")
    return attach_groups(rows, written(names, "names"), "label", "size", total).withColumn("label", F.coalesce("root", "label")).drop("root")


def similar_documents(documents: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles`` (size of its set) and ``component_id`` (the least doc_id that links reach) of each row.

    Documents link when 100 * shared >= percent * united distinct shingles of ``words`` words (A-Z as a-z; fewer words: the whole text is one).
    A text without words, or null, links with nothing. Rows that repeat an id count as one document with several sets; a row with a null id
    has a null component and links with nothing. Sets are compared as 64-bit hashes of shingles.
    """
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    spark = documents.sparkSession
    small_batches(spark, 128)
    documents = documents.select("doc_id", "text")
    sketch = spark.sparkContext.broadcast(count_sketch(documents, words))
    signed = written(signatures(documents, sketch, words, percent), "signatures")
    key = F.xxhash64("set_key")
    of_id = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
    ids = of_id.agg(F.max(F.col("rows") > 1).alias("repeated"), F.max(F.col("low") < F.col("high")).alias("mixed")).first()
    if ids["mixed"]:
        return _classes_of_mixed_ids(documents, signed, words, percent)
    live = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    distinct = written(live.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("size")), "distinct")
    labels = _classes_of_sets(documents, live, distinct, bool(ids["repeated"]), words, percent)

    named = distinct.join(labels, "node", "left").select("set_key", "size", F.coalesce("component", "node").alias("component"))
    total = signed.count()
    rows = attach_groups(live.select("doc_id", "n", "set_key"), written(named, "named"), "set_key", "size", total)
    rest = signed.filter(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", "n", F.col("doc_id").alias("component"))
    return (rows.select("doc_id", "n", "component").unionByName(rest)
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")))


def _classes_of_sets(documents: DataFrame, live: DataFrame, distinct: DataFrame, repeated: bool, words: int, percent: int) -> DataFrame:
    """``node`` and ``component`` (the least node that links reach) of the distinct sets that aren't that node themselves."""
    sets = live.join(distinct.select(F.col("node").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").withColumnRenamed("doc_id", "node")
    if repeated:  # repeated rows are one node, and any of their texts has its set
        sets = sets.dropDuplicates(["node", "set_key"])
        documents = documents.groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = written(sets.drop("set_key"), "sets")
    postings = sets.select("node", F.posexplode("tokens").alias("position", "token"))
    mark = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    lists = postings.groupBy("token").agg(F.count("*").alias("size"), F.min("node").alias("first"), mark(1).alias("x"), mark(2).alias("y")).filter("size > 1")
    lists = lists.groupBy("size", "first", "x", "y").agg(F.min("token").alias("token"))  # of lists that hold the same sets, one is enough
    lists = lists.select("token", "size", "first", (F.col("size") > BLOCK).alias("large"))
    total = sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    shared = written(attach_groups(postings, written(lists, "lists"), "token", "size", total).filter("first IS NOT NULL"), "shared")
    near = _candidates(shared.filter("NOT large").join(sets.select("node", "n", "bits"), "node"), percent)
    stars = shared.filter("large AND node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return classes_of_clusters(documents, sets, components(near.unionByName(stars)), shared, words, percent)


def _by_set(documents: DataFrame, words: int, name: str) -> DataFrame:
    """``documents``, written, with the column ``name``: an id of each row's doc_id and set, null where the doc_id is. Rows that repeat both share it."""
    schema, key = documents.schema, unused("_set_key", documents)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, begin = shingles(*text_buffers(batch.column(batch.num_columns - 1)), words)
            keys = [_set_key(np.unique(codes[a:b])) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())], names=[*batch.schema.names[:-1], key])

    keyed = documents.select("*", F.col("text").alias("_input")).mapInArrow(sign, StructType([*schema.fields, StructField(key, BinaryType())]))
    return written(keyed.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", key))).drop(key), "keyed")


def _classes_of_nodes(keyed: DataFrame, words: int, percent: int, name: str = "_node") -> DataFrame:
    """``doc_id``, ``_node`` and ``component`` (of nodes) of each node, as the column ``name`` tells them apart; ids don't link here."""
    nodes = keyed.filter(F.col(name).isNotNull()).select("doc_id", F.col(name).alias("_node"), "text")
    found = similar_documents(nodes.select(F.col("_node").alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("_node"), F.col("component_id").alias("component"))
    return written(found.distinct().join(nodes.select("doc_id", "_node").distinct(), "_node"), "nodes")


def _classes_of_mixed_ids(documents: DataFrame, signed: DataFrame, words: int, percent: int) -> DataFrame:
    """``similar_documents`` where an id has several sets: classes of (doc_id, set), then links between the sets of each id."""
    nodes = _classes_of_nodes(_by_set(documents, words, "_node"), words, percent)
    total = nodes.count()
    least = nodes.groupBy("doc_id").agg(F.min("component").alias("a"), F.count("*").alias("size"))
    links = attach_groups(nodes, least, "doc_id", "size", total).select("a", F.col("component").alias("b"))
    roots = written(components(links), "components").select(F.col("node").alias("component"), F.col("component").alias("root"))
    rooted = nodes.groupBy("component").agg(F.count("*").alias("size")).join(roots, "component", "left").select("component", "size", F.coalesce("root", "component").alias("root"))
    nodes = written(attach_groups(nodes, rooted, "component", "size", total), "rooted")
    names = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size"))
    named = attach_groups(nodes, names, "root", "size", total).select("doc_id", "component_id").distinct()
    sizes = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("size"))
    rows = attach_groups(signed.select("doc_id", "n"), written(sizes.join(named, "doc_id"), "named"), "doc_id", "size", signed.count())
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each class of linked texts, that with the least doc_id; all columns stay.

    Rows with a null id stay, and texts without words. Where ids repeat, each row is judged by its own text: of rows with the same id and the
    same set one stays, and rows with the same id and unlike sets all do.
    Only documents that may have to go are dealt out by id; the others pass where they are.
    """
    ids = documents.filter(F.col("doc_id").isNotNull()).agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if ids[0] == ids[1]:
        found = written(similar_documents(documents, words, percent).select("doc_id", "component_id"), "classes")
        return _without(documents, found.filter("doc_id <> component_id").select("doc_id").distinct())
    small_batches(documents.sparkSession, 128)
    name = unused("_node", documents)
    keyed = _by_set(documents, words, name)
    nodes = _classes_of_nodes(keyed, words, percent, name)
    first = nodes.groupBy("component").agg(F.min(F.struct("doc_id", "_node")).alias("first"), F.count("*").alias("size"))
    gone = attach_groups(nodes, first, "component", "size", nodes.count()).filter(F.col("_node") != F.col("first._node"))
    out = _without(keyed, gone.select(F.col("_node").alias(name)))
    return out.filter(F.col(name).isNotNull()).dropDuplicates([name]).unionByName(out.filter(F.col(name).isNull())).drop(name)


def _without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id isn't in ``gone``, a table of one column of the same name."""
    (name,) = gone.columns
    gone = written(gone, "gone")
    suspects = IdFilter(gone, name)
    slot = [IdFilter.slot(F.col(name))]
    clear = kept_rows(documents, slot, lambda x: ~suspects.may_hold(x[0]))
    rest = kept_rows(documents, slot, lambda x: suspects.may_hold(x[0])).join(gone, name, "left_anti")
    return clear.unionByName(rest.select(clear.columns))
