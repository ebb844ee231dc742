"""Exact n-gram Jaccard self-join by token-combination prefixes, as components.

A document's tokens are its distinct 5-word shingles (64-bit values).  Documents with the same set are
one node throughout, known by a 128-bit fingerprint.  One pass counts all tokens in a sketch as wide as the
input asks for, up to MOST_SLOTS counters.  Tokens are ordered by estimate, then value, in two classes:
rare ones (their estimate is within the sketch's noise) and frequent ones.
Two sets of Jaccard similarity t or more differ in at most ``n - ceil(t n)`` tokens of either,
so a prefix of the ordered tokens that *covers* one more than that must share a signature:

- each rare token of the prefix is a signature and covers 1;
- frequent tokens are dealt into groups by hash, as many as half the set size's power of two;
  a group with x prefix tokens gives all its 2-token combinations and covers x - 1.
  The prefix is extended until it covers enough; with that many groups it always can.
  (Sets of under 16 tokens take single tokens for both classes.)

Whatever share a signature are candidates.  Sorted by signature and size, a run is cut where sizes
leave a gap that no similar pair spans.  A piece of up to PAIRS sets gives its pairs, and how many signatures two sets
share is counted: of two similar ones, the set whose prefix ends first has at most ``n - o`` tokens that the other one lacks,
where o is the least intersection of similar sets of their sizes, so the rest of its prefix is shared, if all of it is
rare.  Pairs that share fewer are dropped; without that, a passage that two long texts have in common would connect
them as soon as noise makes it look rare.  Of a longer piece the first set is the pivot, and only (pivot, member) rows leave it,
which stand whatever they share.  Long runs are thinned so before the shuffle, in the task that makes
them, so a signature of very many sets sends few rows to any one task.  What these rows connect is a family;
its members' whole token sets meet once, in one task, which verifies candidates by a prefix index of
its own and never compares what is joined already.

A family with too many tokens for one task is settled in two steps.  First each member is compared
with its pivot and what meets it there, in chunks: linear, and enough to join nearly all that belongs together.
Then only signatures whose sets are still in different components are looked at again; within them, sets
outside the largest component meet, in blocks, one another and chunks of that component.

Signatures and token sets of all texts together take more room than the texts.  Inputs of over ROUNDS_FROM bytes send them
in rounds, a share of the signatures, families or pivots each, and what a round sent is removed before the next.

Nulls and texts without words have the empty set, linked with nothing.  A null doc_id takes part
but is never the smallest, unless a component has no other.  Repeated rows stay, as copies.  Very long texts
are sets like others.  Only the columns doc_id and text are read, so others may have any names.  Token values are
64-bit hashes of words: two shingles that differ are taken for one with odds of 2**-64 a compared pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from ._words import U, UNSPACED, mix, split, windows

WORDS = 5
#: The similarity threshold in hundredths.
PERCENT = 75
#: Bytes of text for each counter of the sketch, and the most counters: one byte each is sent to every executor.
SLOT_BYTES = 48
MOST_SLOTS = 1 << 24
_PART = 1 << 16
#: The least rank of frequent tokens.
FREQUENT = 128
#: Signatures that a task holds to thin its own runs, and the length from which it does.
HELD = 200_000
LONG_RUN = 64
#: Rows of an Arrow batch of signatures, and of those that are looked at together.
SENT = 50_000
#: Sets of the longest run that gives all its pairs.
PAIRS = 32
#: Tags of a signature row: all of its set's prefix is rare; its run was thinned.
_PLAIN, _STAR = 1, 2
#: Tokens and members of the largest family that one task settles: 16 MB of values.
FAMILY_TOKENS = 2_000_000
FAMILY_MEMBERS = 30_000
#: Rounds (a power of two) in which inputs of over so many bytes of text send signatures and sets.
ROUNDS = 2
ROUNDS_FROM = 256 << 20
#: Levels below this one (larger sets of under 16 tokens) take single tokens only.
_LEAST_LEVEL = 4
#: Rounds after which components() gives up; each round joins ever longer chains, so a few suffice.
MOST_ROUNDS = 100


def token_sets(column, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, bounds, keys, checks): each text's sorted distinct shingle values, where they begin and end, and its fingerprint's halves."""
    found, _ = split(column, UNSPACED)
    rows = len(found.first) - 1
    values, at = windows(found.value, found.first, words)
    bounds = np.searchsorted(at, found.first)
    length = np.diff(found.first)
    short = np.flatnonzero((length > 0) & (length < words))
    if len(short):
        extra = []
        for r in short:
            v = length[r : r + 1].astype(np.uint64)
            for i in range(found.first[r], found.first[r + 1]):
                v = mix(v * U(0x9E3779B97F4A7C15) + found.value[i : i + 1])
            extra.append(v)
        values = np.insert(values, bounds[short], np.concatenate(extra))
        grown = np.zeros(rows + 1, np.int64)
        grown[short + 1] = 1
        bounds = bounds + np.cumsum(grown)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][bounds[:-1] < len(values)]] = True
    tokens = values[new]
    bounds = np.concatenate(([0], np.cumsum(new)))[bounds]
    return tokens, bounds, *_fingerprints(tokens, bounds)


def _fingerprints(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and checks of sets, signed; 0 for empty sets.  They come from two mixings that share nothing but the tokens."""
    size = np.diff(bounds)
    out = np.zeros((2, len(size)), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        for half, salt in zip(out, (0x632BE59BD9B4E019, 0xD1342543DE82EF95)):
            mixed = mix(tokens + U(salt))
            a = np.add.reduceat(mixed, bounds[full])
            b = np.bitwise_xor.reduceat(mixed * (mixed >> U(32) | U(1)), bounds[full])
            half[full] = mix(a + b * U(3) + size[full].astype(np.uint64))
    return out[0].view(np.int64), out[1].view(np.int64)


class Seen:
    """Remembers recent nodes, so that copies in one task count once; forgetting costs only time."""

    def __init__(self, most: int = 200_000):
        self.most, self.nodes = most, set()

    def new(self, node: bytes) -> bool:
        if node in self.nodes:
            return False
        if len(self.nodes) >= self.most:
            self.nodes.clear()
        self.nodes.add(node)
        return True

    def fresh(self, size: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        raw = np.stack([keys, checks], 1).tobytes()
        return np.array([n > 0 and self.new(raw[16 * i : 16 * i + 16]) for i, n in enumerate(size.tolist())], bool)


# --- the sketch --------------------------------------------------------------------------


def _slots(size: int) -> int:
    """Counters for an input of so many bytes: a power of two."""
    return min(MOST_SLOTS, max(_PART, 1 << (size // SLOT_BYTES).bit_length()))


_SURVEY = ("rid", "key", "check", "n", "part", "counts")


def _survey(words: int, slots: int):
    """doc_id, text, rid -> a row of (doc_id, rid, key, check, n) for each document, then the task's token counts in parts, n their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint16)
        seen, schema = Seen(), None
        for batch in batches:
            ids = batch.column(0)
            schema = pa.schema([pa.field("doc_id", ids.type), ("rid", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
            tokens, bounds, keys, checks = token_sets(batch.column(1), words)
            size = np.diff(bounds)
            at = (tokens[np.repeat(seen.fresh(size, keys, checks), size)] & U(slots - 1)).astype(np.int64)
            if len(at):
                at.sort()
                edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
                at = at[edge[:-1]]
                counts[at] = np.minimum(counts[at] + np.diff(edge), 65535)
            n = len(batch)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(keys), pa.array(checks), pa.array(size), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if schema is not None and counts.any():
            pack = zstandard.ZstdCompressor(1).compress
            parts = [(i, x) for i, x in enumerate(counts.reshape(-1, _PART)) if x.any()]
            m = len(parts)
            sums = pa.array([int(x.sum(dtype=np.int64)) for _, x in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(m, schema.field(0).type), *[pa.nulls(m, pa.int64())] * 3, sums, pa.array([i for i, _ in parts], pa.int32()), pa.array([pack(x.tobytes()) for _, x in parts], pa.binary())], schema=schema)

    return run


def _ranked(mean: float):
    """(part, counts) rows, all of a part in one task -> (part, ranks): a byte for each counter."""
    most = mean + 6 * mean**0.5 + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.setdefault(part, np.zeros(_PART, np.int64))
                total[part] += np.frombuffer(unpack(raw), np.uint16)
        for part, counts in total.items():
            rank = np.floor(counts * (FREQUENT - 1) / most)
            high = counts > most
            rank[high] = FREQUENT + np.minimum(np.floor(4 * np.log2(counts[high] / most)), 255 - FREQUENT)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rank.astype(np.uint8).tobytes()], pa.binary())], names=["part", "ranks"])

    return run


def _ranks(surveyed: DataFrame, slots: int, partitions: int) -> np.ndarray:
    """A byte for each counter, rising with its count: under FREQUENT for rare ones.  At most MOST_SLOTS bytes, whatever the input."""
    parts = surveyed.filter(F.col("part").isNotNull()).select("part", "counts", "n")
    out = np.zeros((slots // _PART, _PART), np.uint8)
    whole = parts.agg(F.sum("n")).first()[0]
    if whole:
        ranked = parts.select("part", "counts").repartition(min(partitions, len(out)), "part").mapInArrow(C.trimmed(_ranked(whole / slots)), "part int, ranks binary")
        for row in C.materialize(ranked, "ranks").toLocalIterator():
            out[row["part"]] = np.frombuffer(row["ranks"], np.uint8)
    return out.ravel()


# --- signatures and families -------------------------------------------------------------


def _level(n: int) -> int:
    return int(n).bit_length() - 1


def _prefix(n, percent: int):
    """How many tokens a prefix of a set of n covers."""
    return n - (percent * n + 99) // 100 + 1


def _least_shared(a: np.ndarray, a_plain: np.ndarray, b: np.ndarray, b_plain: np.ndarray, percent: int) -> np.ndarray:
    """The fewest signatures that similar sets of sizes a and b share; plain: all of the prefix is rare."""
    common = -(-percent * (a + b) // (100 + percent))
    of_a, of_b = (_prefix(n, percent) - n + common for n in (a, b))
    both = np.where(a_plain & b_plain, np.minimum(of_a, of_b), np.where(a_plain, of_a, np.where(b_plain, of_b, 1)))
    return np.maximum(both, 1)


def signatures(s: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a sorted set, given its tokens' ranks."""
    n = len(s)
    need = _prefix(n, percent)
    order = np.argsort(rank, kind="stable")
    n_rare = int(np.count_nonzero(rank < FREQUENT))
    rare = s[order[: min(n_rare, need)]]
    if len(rare) == need:
        return rare
    often = s[order[n_rare:]]
    out = [rare]
    for level in {_level(n), _level(n * 100 // percent)}:
        if level < _LEAST_LEVEL:
            out.append(often[: need - len(rare)])
            continue
        group = (mix(often) >> U(64 - (level - 1))).astype(np.int64)
        order = np.lexsort((np.arange(len(often)), group))
        g = group[order]
        again = np.zeros(len(often), np.int64)
        again[order[1:]] = g[1:] == g[:-1]  # not the first of its group: covers one more
        end = int(np.searchsorted(np.cumsum(again), need - len(rare))) + 1
        kept = order[order < end]
        g, tokens = group[kept], often[kept]
        for gap in range(1, len(kept)):
            same = np.flatnonzero(g[gap:] == g[:-gap])
            if not len(same):
                break
            a, b = tokens[same], tokens[same + gap]
            out.append(mix(np.minimum(a, b) * U(0x9E3779B97F4A7C15) + mix(np.maximum(a, b)) + U(level)))
    return np.unique(np.concatenate(out))


def _thinned(sig: np.ndarray, node: np.ndarray, n: np.ndarray, percent: int, *tag: np.ndarray):
    """Signature rows without the inner rows of long runs, and (pivot, node) rows for all of those runs.

    With tags, what is kept of a long run gets _STAR.

    Of a long run the first and last row of each bucket of sizes stay, buckets no wider than the gap that cuts runs, so
    a run that is joined to others elsewhere is cut or not cut as the whole would be.
    """
    order = np.lexsort((node, n, sig))
    sig, node, n, *tag = (x[order] for x in (sig, node, n, *tag))
    size = n.astype(np.int64)
    start = np.concatenate(([True], (sig[1:] != sig[:-1]) | (100 * size[:-1] < percent * size[1:])))
    first = np.flatnonzero(start)
    length = np.diff(np.append(first, len(sig)))
    run = np.cumsum(start) - 1
    long_ = length[run] >= LONG_RUN
    if not long_.any():
        none = np.zeros(0, np.int64)
        return (sig, node, n, *tag), (none, none)
    bucket = np.floor(np.log(size) / (0.999 * np.log(100 / percent))).astype(np.int64)
    edge = np.concatenate(([True], (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])))
    keep = ~long_ | edge | np.append(edge[1:], True)
    pivot = node[first][run]
    pairs = np.unique(np.stack([pivot, node], 1)[long_ & (pivot != node)], axis=0)
    return (sig[keep], node[keep], n[keep], *(np.where(long_, x | _STAR, x)[keep] for x in tag)), (pairs[:, 0], pairs[:, 1])


def _index(shared, words: int, percent: int, thin: bool = True, turn: int = 0, rounds: int = 1):
    """text -> (sig, key, n, null, tag) for each signature of this turn, or (0, key, 0, pivot, 0) where a run was thinned."""

    def packed(held) -> Iterator[pa.RecordBatch]:
        sig, node, n, tag = (np.concatenate(x) for x in zip(*held))
        (sig, node, n, tag), (pivot, other) = _thinned(sig, node, n, percent, tag) if thin else ((sig, node, n, tag), (sig[:0], sig[:0]))
        zero = np.zeros(len(other), np.int64)
        columns = [pa.array(np.concatenate(x)) for x in ((sig, zero), (node, other), (n, zero.astype(np.int32)))]
        columns += [pa.concat_arrays([pa.nulls(len(sig), pa.int64()), pa.array(pivot)]), pa.array(np.concatenate((tag, zero.astype(np.int8))))]
        whole = pa.RecordBatch.from_arrays(columns, names=["sig", "key", "n", "pivot", "tag"])
        for i in range(0, len(whole), SENT):
            yield whole.slice(i, SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen, held, rows = shared.value, Seen(), [], 0
        for batch in batches:
            tokens, bounds, keys, checks = token_sets(batch.column(0), words)
            size = np.diff(bounds)
            rank = ranks[(tokens & U(len(ranks) - 1)).astype(np.int64)]
            for i in np.flatnonzero(seen.fresh(size, keys, checks)).tolist():
                a, b = bounds[i], bounds[i + 1]
                sig = signatures(tokens[a:b], rank[a:b], percent)
                sig = sig[mix(sig) & U(rounds - 1) == U(turn)].view(np.int64)
                plain = np.count_nonzero(rank[a:b] < FREQUENT) >= _prefix(b - a, percent)
                held.append((sig, np.full(len(sig), keys[i], np.int64), np.full(len(sig), b - a, np.int32), np.full(len(sig), _PLAIN * plain, np.int8)))
                rows += len(sig)
                if rows >= HELD:
                    yield from packed(held)
                    held, rows = [], 0
        if held:
            yield from packed(held)

    return run


def _pivots(percent: int, pairs: int = 0):
    """Rows sorted by signature, size and key -> (first key of each piece, other key), some of them repeated; thinned rows pass.

    With ``pairs``, pieces of up to so many sets, none of a thinned run, give all pairs that sizes allow, and two columns more: shared,
    the signatures that a pair shares here, and need, how many it must share in all, 0 for what stands anyway.
    """

    def packed(pivot, node, shared, need) -> pa.RecordBatch:
        names = ["pivot", "node", "shared", "need"][: 4 if pairs else 2]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (pivot, node, shared, need)[: len(names)]], names=names)

    def cut(sig, node, n, tag, whole):
        """What complete pieces give, and the rows of the last piece, or one in place of them, unless the rows are the ``whole`` rest."""
        size = n.astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (100 * size[:-1] < percent * size[1:]))))
        star = np.bitwise_or.reduceat(tag, first) & _STAR > 0
        length = np.diff(np.append(first, len(sig)))
        star |= length > pairs
        rest = tuple(x[:0] for x in (sig, node, n, tag))
        end = len(sig)
        if not whole:
            at = first[-1]
            if star[-1]:  # the pivot stands for all, at the size of the last one
                rest = sig[at : at + 1], node[at : at + 1], n[-1:], np.array([_STAR], np.int8)
            else:
                rest, end = tuple(x[at:] for x in (sig, node, n, tag)), at
                first, star, length = first[:-1], star[:-1], length[:-1]
        piece = np.repeat(np.arange(len(first)), length)
        node, size, plain = node[:end], size[:end], tag[:end] & _PLAIN > 0
        a, b, shared, need = [], [], [], []
        pivot = node[first][piece]
        stars = np.flatnonzero(star[piece] & (pivot != node))
        a.append(pivot[stars])
        b.append(node[stars])
        need.append(np.zeros(len(stars), np.int64))
        few = np.flatnonzero(~star[piece])
        few = few[np.concatenate(([True], (piece[few][1:] != piece[few][:-1]) | (node[few][1:] != node[few][:-1])))] if len(few) else few
        for gap in range(1, pairs):
            i, j = few[:-gap], few[gap:]
            same = piece[i] == piece[j]
            if not same.any():
                break
            i, j = i[same], j[same]
            near = 100 * size[i] >= percent * size[j]
            i, j = i[near], j[near]
            a.append(node[i])
            b.append(node[j])
            need.append(_least_shared(size[i], plain[i], size[j], plain[j], percent))
        a, b, need = (np.concatenate(x) for x in (a, b, need))
        order = np.lexsort((need, b, a))
        a, b, need = a[order], b[order], need[order]
        edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
        shared = np.diff(np.append(edge, len(a)))
        return (a[edge], b[edge], shared, need[edge]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            done = batch.filter(batch.column(3).is_valid())
            if len(done):
                one = np.ones(len(done), np.int64)
                yield packed(done.column(3), done.column(1), one, 0 * one)
            batch = batch.filter(batch.column(3).is_null())
            if not len(batch):
                continue
            tag = batch.column(4).to_numpy() if pairs else np.zeros(len(batch), np.int8)
            held.append((*(batch.column(i).to_numpy() for i in range(3)), tag))
            rows += len(batch)
            if rows >= SENT:
                found, rest = cut(*(np.concatenate(x) for x in zip(*held)), False)
                held, rows = [rest], len(rest[0])
                if len(found[0]):
                    yield packed(*found)
        if held:
            found, _ = cut(*(np.concatenate(x) for x in zip(*held)), True)
            if len(found[0]):
                yield packed(*found)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each one reaches over edges (a, b), by alternating large and small stars, to the fixed point."""
    spark = edges.sparkSession
    edges = C.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        since = C.mark()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = C.materialize(small.distinct(), "edges")
        C.free(spark, since - 1, keep=1)
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)")
        if open_.limit(1).count() == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


# --- verification ------------------------------------------------------------------------


def _find(parent: np.ndarray, at):
    root = parent[at]
    while True:
        above = parent[root]
        if np.array_equal(above, root):
            return root
        root = above


def linked(sets: list[np.ndarray], percent: int = PERCENT, labels: np.ndarray | None = None) -> np.ndarray:
    """For each of some sets the place of one that stands for its component; sets with one label count as joined already.

    An index of the sets' rarest tokens (by their counts here) gives each set's candidates; only those of other
    components are verified, by their whole intersections, and a token whose later sets are all joined is dropped.
    """
    m = len(sets)
    parent = np.arange(m)
    if labels is not None:
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        parent = first[inverse]
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    parent = place[parent[order]]
    bounds = np.concatenate(([0], np.cumsum(size)))
    _, ids, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    by_rarity = np.lexsort((ids, count[ids], row))
    need = size - (percent * size + 99) // 100 + 1
    chosen = by_rarity[(np.arange(len(ids)) - bounds[row] < need[row]) & (count[ids[by_rarity]] > 1)]
    chosen = chosen[np.argsort(ids[chosen], kind="stable")]  # lists of one token each, their sets by size
    token, member = ids[chosen], row[chosen]
    if not len(token):
        return order[parent[place]]
    edge = np.concatenate(([True], token[1:] != token[:-1]))
    which = np.cumsum(edge) - 1
    end = np.append(np.flatnonzero(edge)[1:], len(token))
    alive = np.ones(len(end), bool)
    entries = np.argsort(member, kind="stable")
    own = np.searchsorted(member[entries], np.arange(m + 1))
    mark = np.zeros(len(count), bool)
    for x in range(m):
        mine = entries[own[x] : own[x + 1]]
        mine = mine[alive[which[mine]]]
        later = [member[e + 1 : end[which[e]]] for e in mine.tolist()]
        later = [y for y in later if len(y)]
        if not later:
            continue
        found = np.unique(np.concatenate(later))
        root = int(_find(parent, np.array([x]))[0])
        near = found[(percent * size[found] <= 100 * size[x]) & (_find(parent, found) != root)]
        if len(near):
            mark[ids[bounds[x] : bounds[x + 1]]] = True
            hits = mark[np.concatenate([ids[bounds[y] : bounds[y + 1]] for y in near.tolist()])]
            mark[ids[bounds[x] : bounds[x + 1]]] = False
            shared = np.add.reduceat(hits.astype(np.int64), np.concatenate(([0], np.cumsum(size[near])[:-1])))
            joined = near[100 * shared >= percent * (size[x] + size[near] - shared)]
            parent[_find(parent, joined)] = root
        parent[found] = _find(parent, found)
        for e in mine.tolist():
            k = which[e]
            if (parent[member[e + 1 : end[k]]] == root).all():
                alive[k] = False
    return order[_find(parent, np.arange(m))[place]]


def _settled(percent: int, keys: int):
    """Rows sorted by ``keys`` group columns, then (id, label, tokens) -> (id, root): the least id of each one's component, if not its own.

    A null label stands for the id itself.
    """

    def settle(rows) -> list[tuple[int, int]]:
        ids = np.array([r[0] for r in rows], np.int64)
        labels = np.array([r[0] if r[1] is None else r[1] for r in rows], np.int64)
        stands = linked([np.frombuffer(r[2], np.uint64) for r in rows], percent, labels)
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, stands, ids)
        least = least[stands]
        return [(i, r) for i, r in zip(ids.tolist(), least.tolist()) if i != r]

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["id", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(keys + 3)]
            for group, *row in zip(zip(*columns[:keys]), *columns[keys:]):
                if group != now:
                    if len(rows) > 1:
                        out += settle(rows)
                    now, rows = group, []
                if not rows or row[0] != rows[-1][0]:
                    rows.append(row)
            if len(out) > 10_000:
                yield packed(out)
                out = []
        if len(rows) > 1:
            out += settle(rows)
        if out:
            yield packed(out)

    return run


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, bounds, keys, checks = token_sets(batch.column(0), words)
            sets = [tokens[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(checks), pa.array(sets, pa.binary())], names=["key", "check", "tokens"])

    return run


class _Join:
    """The steps of one join."""

    def __init__(self, documents: DataFrame, words: int, percent: int, partitions: int | None):
        self.spark, self.words, self.percent = documents.sparkSession, words, percent
        C.small_batches(self.spark)
        self.docs = documents.select("doc_id", C.text_or_empty().alias("text"))
        self.parts = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.bytes = int(self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        self.rounds = ROUNDS if self.bytes > ROUNDS_FROM else 1

    def survey(self) -> None:
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        slots, since = _slots(self.bytes), C.mark()
        survey = f"doc_id {kind}, rid bigint, key bigint, check bigint, n bigint, part int, counts binary"
        surveyed = C.materialize(self.docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(C.trimmed(_survey(self.words, slots)), survey), "survey")
        self.ranks = self.spark.sparkContext.broadcast(_ranks(surveyed, slots, self.parts))
        self.rows = C.materialize(surveyed.filter(F.col("part").isNull()).select("doc_id", "rid", "key", "check", "n"), "rows")
        C.free(self.spark, since, keep=1)
        nodes = self.rows.filter("n > 0").groupBy("key", "check").agg(F.min("rid").alias("id"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
        self.nodes = C.materialize(nodes, "nodes")

    def _signed(self, texts: DataFrame, turn: int, thin: bool = True) -> DataFrame:
        return texts.select("text").mapInArrow(C.trimmed(_index(self.ranks, self.words, self.percent, thin, turn, self.rounds)), "sig bigint, key bigint, n int, pivot bigint, tag tinyint")

    def _texts(self, members: DataFrame) -> DataFrame:
        """A document of each member, and others of the same doc_id."""
        rep = C.maybe_broadcast(members.select(F.col("doc_id").alias("rep")))
        return self.docs.join(rep, self.docs["doc_id"].eqNullSafe(F.col("rep")), "left_semi")

    def _compared(self, dealt: DataFrame, rounds: int, *group: str) -> DataFrame:
        """(id, root) of what is dealt (group columns, key, check, id, label, doc_id) into one task a group, a share of the groups each round."""
        turn = F.pmod(F.xxhash64(*group), F.lit(rounds))
        return reduce(DataFrame.unionByName, [C.materialize(self._met(dealt.filter(turn == i) if rounds > 1 else dealt, *group), "links") for i in range(rounds)])

    def _met(self, dealt: DataFrame, *group: str) -> DataFrame:
        sets = self._texts(dealt.select("doc_id").distinct()).select("text").mapInArrow(C.trimmed(_sets_of(self.words)), "key bigint, check bigint, tokens binary")
        dealt = dealt.drop("doc_id")
        full = sets.join(C.maybe_broadcast(dealt), ["key", "check"]).select(*group, "id", "label", "tokens")
        return full.repartition(self.parts, *group).sortWithinPartitions(*group, "id").mapInArrow(C.trimmed(_settled(self.percent, len(group))), "id bigint, root bigint")

    def candidates(self) -> None:
        """Families of what shares signatures: members (root, key, check, id, n, doc_id)."""
        home = F.when(F.col("pivot").isNull(), F.col("sig")).otherwise(F.xxhash64("pivot", "key"))
        found, since = [], C.mark()
        for turn in range(self.rounds):
            runs = self._signed(self.docs, turn).repartition(self.parts, home).sortWithinPartitions("sig", "n", "key")
            pairs = runs.mapInArrow(C.trimmed(_pivots(self.percent, PAIRS)), "pivot bigint, node bigint, shared bigint, need bigint")
            found.append(C.materialize(_counted(pairs), "shared"))
        pairs = _counted(reduce(DataFrame.unionByName, found)) if len(found) > 1 else found[0]
        self.pairs = C.materialize(pairs.filter("shared >= need").select("pivot", "node"), "pairs")
        C.free(self.spark, since, keep=1)
        families = components(self.pairs.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        twins = self.nodes.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key", F.col("key").alias("root"))  # one key, two sets
        families = families.withColumnRenamed("node", "key").unionByName(families.select(F.col("root").alias("key"), "root").distinct())
        families = families.unionByName(twins.join(families, "key", "left_anti"))
        self.members = C.materialize(families.join(self.nodes, "key").select("root", "key", "check", "id", "n", "doc_id"), "members")

    def roots(self) -> DataFrame:
        """(id, root) of every node that is not its component's least id."""
        size = self.members.groupBy("root").agg(F.sum("n").alias("tokens"), F.count("*").alias("members"))
        large = C.materialize(size.filter((F.col("tokens") > FAMILY_TOKENS) | (F.col("members") > FAMILY_MEMBERS)).select("root"), "large")
        some = large.limit(1).count() > 0  # each has FAMILY_MEMBERS members or FAMILY_TOKENS tokens, so these are few
        label = F.lit(None).cast("bigint").alias("label")
        small = self.members.join(F.broadcast(large), "root", "left_anti") if some else self.members
        found = self._compared(small.select(F.col("root").alias("family"), "key", "check", "id", label, "doc_id"), self.rounds, "family")
        return found.unionByName(self._large(self.members.join(F.broadcast(large), "root", "left_semi"))) if some else found

    def _large(self, members: DataFrame) -> DataFrame:
        members = C.materialize(members, "members")
        # each with its least pivot: chunks of a pivot's members, the pivot in all of them
        least = self.pairs.groupBy(F.col("node").alias("key")).agg(F.min("pivot").alias("pivot"))
        stars = members.join(least, "key").select("pivot", "key", "check", "id", "n", "doc_id")
        chunks = C.materialize(_parts_of(stars.groupBy("pivot").agg(F.sum("n").alias("tokens"), F.count("*").alias("members"))), "chunks")
        label = F.lit(None).cast("bigint").alias("label")
        dealt = stars.join(chunks, "pivot").select("pivot", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("chunk"), "key", "check", "id", label, "doc_id")
        centres = chunks.join(members.withColumnRenamed("key", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), F.col("pivot").alias("key"), "check", "id", label, "doc_id")
        first = self._compared(C.materialize(dealt.unionByName(centres), "stars"), self.rounds, "pivot", "chunk")
        # what shares a signature and is not joined yet
        joined = components(first.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
        members = C.materialize(members.join(joined.withColumnRenamed("root", "label"), "id", "left").select("key", "check", "id", "n", F.coalesce("label", "id").alias("label"), "doc_id"), "members")
        both = first
        for turn in range(self.rounds):
            since = C.mark()
            dealt = self._open(members, turn)
            tokens = dealt.agg(F.sum("n")).first()[0] or 0
            C.free(self.spark, since, keep=1)
            if tokens:  # so many rounds that each sends sets of about half the input's size
                both = both.unionByName(self._compared(dealt.drop("n"), -(-8 * tokens // max(1, ROUNDS_FROM, self.bytes // 2)), "sig", "low", "high"))
        return components(both.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")

    def _open(self, members: DataFrame, turn: int) -> DataFrame:
        """Of this turn's signatures those whose sets are in several components: the sets outside the largest one in blocks, dealt to meet one another and that one's."""
        lists = C.materialize(self._signed(self._texts(members), turn, thin=False).select("sig", "key").distinct().join(members, "key"), "lists")
        of = lists.groupBy("sig", "label").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
        open_ = of.groupBy("sig").agg(F.max_by("label", F.struct("members", "label")).alias("major"), F.count("*").alias("k"), F.max(F.struct("members", "label", "tokens")).alias("most"), F.sum("members").alias("members"), F.sum("tokens").alias("tokens")).filter("k > 1")
        minor = _parts_of(open_.select("sig", (F.col("tokens") - F.col("most.tokens")).alias("tokens"), (F.col("members") - F.col("most.members")).alias("members"))).withColumnRenamed("parts", "minor_parts")
        major = _parts_of(open_.select("sig", "major", F.col("most.tokens").alias("tokens"), F.col("most.members").alias("members")), "major").withColumnRenamed("parts", "major_parts")
        plan = C.materialize(major.join(minor, "sig"), "open")
        rows = lists.join(plan, "sig")
        mine = F.when(F.col("label") == F.col("major"), F.col("minor_parts") + F.pmod(F.xxhash64("id"), "major_parts")).otherwise(F.pmod(F.xxhash64("id"), "minor_parts")).cast("int")
        rows = rows.withColumn("p", mine)
        last = F.when(F.col("p") < F.col("minor_parts"), F.col("minor_parts") + F.col("major_parts") - 1).otherwise(F.col("minor_parts") - 1)
        rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), last)))
        return C.materialize(rows.select("sig", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), "key", "check", "id", "label", "n", "doc_id"), "dealt")

    def result(self) -> DataFrame:
        self.survey()
        self.candidates()
        roots = self.roots()
        every = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
        every = C.materialize(every.join(self.nodes.select("id", "doc_id", "copies"), "id"), "components")
        least = C.materialize(every.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("class_size")), "least")
        named = C.materialize(every.select("id", "root").join(C.maybe_broadcast(least), "root").select("id", "component_id", "class_size"), "named")
        labelled = self.nodes.join(named, "id", "left").select("key", "check", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("class_size", "copies").alias("class_size"))
        full = self.rows.filter("n > 0").join(C.materialize(labelled, "labelled"), ["key", "check"])
        bare = self.rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(1).cast("bigint").alias("class_size"))
        return full.select("doc_id", "n", "component_id", "class_size").unionByName(bare).withColumnRenamed("n", "n_shingles")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pivot", "node").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))


def _parts_of(size: DataFrame, *more: str) -> DataFrame:
    """size (sig or pivot, tokens, members) -> into how many parts each group is cut so that two fit a task."""
    parts = F.ceil(F.greatest(2 * F.col("tokens") / FAMILY_TOKENS, 2 * F.col("members") / FAMILY_MEMBERS)).cast("int")
    return size.select(size.columns[0], *more, F.greatest(parts, F.lit(1)).alias("parts"))


def join(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, partitions: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), class_size (rows of the component)."""
    return _Join(documents, words, percent, partitions).result()


def deduplicate(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each linked group: the one with the smallest doc_id (one row, if that id is repeated in the group).

    Documents without words are linked with nothing and all stay.
    """
    groups = C.materialize(join(documents, words, percent), "groups")
    repeated = groups.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count()
    if not repeated:  # a doc_id tells a row: only the ids that go are joined
        gone = groups.filter((F.col("n_shingles") > 0) & (F.col("component_id") != F.col("doc_id"))).select("doc_id")
        return documents.join(C.maybe_broadcast(gone), "doc_id", "left_anti").select(*C.quoted(documents.columns))
    row = C.fresh(documents, "__row")
    kept = C.materialize(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = join(kept.select(F.struct("doc_id", row).alias("doc_id"), "text"), words, percent)
    first = groups.filter((F.col("n_shingles") == 0) | (F.col("component_id") == F.col("doc_id"))).select(F.col(f"doc_id.{row}").alias(row))
    return kept.join(C.maybe_broadcast(first), row, "left_semi").select(*C.quoted(documents.columns))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(C.table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT a, min(doc_id) AS component_id, count(*) AS class_size FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, CAST(class_size AS BIGINT) AS class_size
FROM d LEFT JOIN n ON n.r = d.r JOIN class ON class.a = d.r
"""
