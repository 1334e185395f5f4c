"""N-gram Jaccard join by T-occurrence search (DivideSkip) over distributed inverted lists.

Two documents with n and m distinct shingles link when their overlap reaches
T(n, m) = ceil(num * (n + m) / (num + den)) for a threshold of num / den.

1. Texts with equal shingle sets are one class; only classes are searched.
2. A fixed-size table of counters orders shingles by frequency (a total order; its quality affects speed
   only). A class posts its n - ceil(n * num / den) + 1 rarest shingles: two linked classes share one.
3. Posting lists meet in a shuffle. First each list pairs its members with one of them (a hub), the same one in
   lists of much the same members; then, twice, those in other components than most with a hub of their list's own. A pair
   each for most copies of one text, and no list emits all its pairs. What is left are the members of a list whose
   components still differ: those pairs follow if sizes, places and parity bits allow the overlap.
4. Pairs whose parity bits allow the overlap are checked, once, by DivideSkip: candidates of a query get inverted lists; the
   short lists of the query's shingles are merged with a heap, and candidates that occur often enough are looked up in the
   long lists by binary search. What travels to the pairs are compressed texts: the sets made of them are some times larger.
5. Connected components of the links, by shuffles.
6. On demand, all links of every class are counted: each lies inside a component, so the classes of a component are dealt
   into blocks, and the lists of one block are scanned for the sets of another. Only counts leave a pair of blocks.

No pair, list or fingerprint goes through the driver but the counters and a Bloom filter, both of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBERS, added_up, column, discard, encode, mix, numbers_of_task, stored, trimmed
from .components import components
from .placed_texts import LAST, whole_runs
from .shingles import shingle_set, shingle_sets

#: Counters of the frequency order, and the parts in which they are summed.
CELLS, PARTS = 1 << 20, 64
SHIFT = np.uint64(64 - 20)
#: Largest Bloom filter, in bits. It saves shuffling texts that nobody asks for; a full one lets all pass.
BLOOM_BITS = 1 << 26
#: Candidates that are checked together against one query.
GROUP = 128
#: Rounds with hubs before the pairs that they leave open, whatever the lists look like.
HUB_ROUNDS = 3
#: Bits that hold the parity of a set's shingles: where two differ, the sets do.
PARITY = 1024
#: Classes, and shingles of them, in a block of a component whose links are counted.
BLOCK, BLOCK_ITEMS = 2048, 1 << 20
#: Weight of the long lists, as in the DivideSkip paper.
MU = 0.0085


def need(n: int, m: int, num: int, den: int) -> int:
    """Least overlap of linked sets of sizes n and m."""
    return -(-num * (n + m) // (num + den))


def _counters(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How many rows hold a shingle of each cell; CELLS numbers whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, h in shingle_sets(column(batch, text), k):
                cells += np.bincount((h >> SHIFT).astype(np.int64), minlength=CELLS) if len(h) > 4096 else 0
                if len(h) <= 4096:
                    np.add.at(cells, h >> SHIFT, 1)
        if cells.any():
            yield numbers_of_task(np.split(cells, PARTS))

    out = np.zeros((PARTS, CELLS // PARTS), np.int64)
    for part, total in added_up(docs.select(text).mapInArrow(trimmed(count), NUMBERS), np.int64).items():
        out[part] = total
    return np.minimum(out, 2**32 - 1).astype(np.uint32).reshape(-1)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _signature(h: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def parity(h: np.ndarray) -> bytes:
    return np.packbits(np.bincount((h >> np.uint64(24) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def _sets(docs: DataFrame, id_col: str, text: str, k: int, num: int, den: int, order) -> DataFrame:
    """n, signature and posted shingles (rarest first) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = order.value
        for batch in batches:
            n, one, two, posted, bits = [], [], [], [], []
            for _, h in shingle_sets(column(batch, text), k):
                a, b = _signature(h)
                keep = len(h) - -(-num * len(h) // den) + 1 if len(h) else 0
                rank = np.argsort(cells[h >> SHIFT], kind="stable")[:keep]
                n.append(len(h)), one.append(a), two.append(b), posted.append(h[rank].tobytes()), bits.append(parity(h))
            yield pa.RecordBatch.from_arrays([column(batch, id_col).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(posted, pa.binary()), pa.array(bits, pa.binary())], ["id", "n", "s1", "s2", "posted", "bits"])

    return docs.select(id_col, text).mapInArrow(trimmed(run), "id long, n int, s1 long, s2 long, posted binary, bits binary")


def _entries(classes: DataFrame) -> DataFrame:
    """Posting entries: shingle, class, size, place in the class's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.frombuffer(x.as_py(), np.int64) for x in column(batch, "posted")]
            nodes, sizes = column(batch, "node").to_numpy(), column(batch, "n").to_numpy()
            at = 0
            while at < len(blobs):  # some hundred thousand entries at a time
                end, room = at, 0
                while end < len(blobs) and (end == at or room + len(blobs[end]) <= 300_000):
                    room += len(blobs[end])
                    end += 1
                count = [len(b) for b in blobs[at:end]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blobs[at:end])), pa.array(np.repeat(nodes[at:end], count)), pa.array(np.repeat(sizes[at:end], count)), pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in count]))], ["h", "node", "n", "pos"])
                at = end

    return classes.select("node", "n", "posted").mapInArrow(trimmed(run), "h long, node long, n int, pos int")


def _shared(num: int, den: int):
    """Entries (sorted by shingle and size) whose list has a member next to them that their size allows; in lists
    of two, that their places allow too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "node", "n", "pos"]
        for cols in whole_runs(batches, names):
            h, _, n, pos = (c.astype(np.int64) for c in cols)
            if len(h) < 2:
                continue
            same = h[1:] == h[:-1]
            fits = same & (den * n[:-1] >= num * n[1:])
            edge = np.concatenate([[False], same, [False]])
            two = same & ~edge[:-2] & ~edge[2:]
            rest = 1 + np.minimum(n[:-1] - pos[:-1], n[1:] - pos[1:]) - 1
            fits &= ~two | (rest * (num + den) >= num * (n[:-1] + n[1:]))
            keep = np.zeros(len(h), bool)
            keep[1:] |= fits
            keep[:-1] |= fits
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)

    return run


def _hub_pairs(n: np.ndarray, node: np.ndarray, root: np.ndarray, salt: int, num: int, den: int) -> Iterator[np.ndarray]:
    """Rows (hub, member) for each band of sizes that fit each other: the hub is of the component that most members are in,
    the member of another one."""
    low = 0
    while low < len(n):
        high = int(np.searchsorted(n, n[low] * den // num, "right"))
        own, nodes = root[low:high], node[low:high]
        if high - low > 1 and (own != own[0]).any():
            order = mix(nodes.astype(np.uint64) ^ np.uint64(salt))
            _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
            most = inverse == counts.argmax() if counts.max() > 1 else np.ones(len(own), bool)
            hub = np.flatnonzero(most)[order[most].argmin()]
            others = nodes[own != own[hub]]
            yield np.stack([np.full(len(others), nodes[hub]), others], 1)
        low = high


def _open_pairs(n: np.ndarray, node: np.ndarray, pos: np.ndarray, root: np.ndarray, bits: np.ndarray, num: int, den: int) -> Iterator[np.ndarray]:
    """Rows (query, candidate) for members of different components whose sizes, places and parities allow the overlap.

    The queries are taken from the smaller components of the list, and each pair comes once.
    """
    _, inverse, counts = np.unique(root, return_inverse=True, return_counts=True)
    place = np.empty(len(counts), np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    rank = place[inverse]
    for i in np.flatnonzero(rank < len(counts) - 1):
        both, small, large = n + n[i], np.minimum(n, n[i]), np.maximum(n, n[i])
        rest = 1 + np.minimum(n - pos, n[i] - pos[i]) - 1
        ok = np.flatnonzero((rank > rank[i]) & (den * small >= num * large) & (rest * (num + den) >= num * both))
        apart = np.bitwise_count(bits[ok] ^ bits[i]).sum(1, dtype=np.int64)
        ok = ok[apart <= both[ok] + 2 * (-num * both[ok] // (num + den))]
        if len(ok):
            yield np.stack([np.full(len(ok), node[i]), node[ok]], 1)


def _pairs(lists: DataFrame, turn: int | None, num: int, den: int) -> DataFrame:
    """Distinct pairs q, c of the lists (with root): of a hub round, or without a turn all that are open (with bits)."""
    names = ["h", "n", "node", "pos", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            both = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["q", "c"])

        found, size = [], 0
        for cols in whole_runs(batches, names if turn is not None else [*names, "bits"]):
            begin = np.concatenate([[0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1])
            sizes = np.diff(np.append(begin, len(cols[0])))
            long = sizes > 2 if turn is not None else sizes > 1
            if turn is not None:  # lists of two need no hub
                a = begin[sizes == 2]
                a = a[(cols[4][a] != cols[4][a + 1]) & (den * cols[1][a].astype(np.int64) >= num * cols[1][a + 1].astype(np.int64))]
                if len(a):
                    found.append(np.stack([cols[2][a], cols[2][a + 1]], 1))
                    size += len(a)
            for a, b in zip(begin[long].tolist(), (begin + sizes)[long].tolist(), strict=True):
                n, node, pos, root = (c[a:b].astype(np.int64) for c in cols[1:5])
                if (root == root[0]).all():
                    continue
                if turn is None:
                    bits = np.frombuffer(b"".join(cols[5][a:b]), np.uint64).reshape(b - a, -1)
                    made = _open_pairs(n, node, pos, root, bits, num, den)
                else:
                    salt = int(mix(np.array([cols[0][a] + turn], np.int64).view(np.uint64))[0]) if turn else 0
                    made = _hub_pairs(n, node, root, salt, num, den)
                for rows in made:
                    found.append(rows)
                    size += len(rows)
                if size > 200_000:
                    yield packed()
                    found, size = [], 0
        if found:
            yield packed()

    return lists.repartition("h").sortWithinPartitions("h", "n", "node").mapInArrow(trimmed(run), "q long, c long").distinct()


def _open_lists(lists: DataFrame) -> DataFrame:
    """The lists (with root) that have members of several components."""
    several = lists.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
    return lists.join(several, "h", "left_semi")


def _rooted(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("root", F.col("node"))
    return lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


class _Bloom:
    """Marks of numbers, of bounded size, for all tasks."""

    def __init__(self, numbers: DataFrame, name: str):
        bits = 1 << 16
        count = numbers.count()
        while bits < BLOOM_BITS and bits < 16 * count:
            bits *= 2
        self.mask = np.uint64(bits - 1)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(bits, bool)
            for batch in batches:
                for place in self.places(column(batch, name)):
                    found[place] = True
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor().compress(np.packbits(found).tobytes())], pa.binary())], ["bits"])

        all_marks = np.zeros(bits // 8, np.uint8)
        for r in numbers.select(name).coalesce(4).mapInArrow(trimmed(mark), "bits binary").toLocalIterator():
            all_marks |= np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), np.uint8)
        self.shared = numbers.sparkSession.sparkContext.broadcast(all_marks)

    def places(self, numbers: pa.Array) -> list[np.ndarray]:
        h = mix(numbers.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))
        return [h & self.mask, (h >> np.uint64(32)) & self.mask]

    def holds(self, numbers: pa.Array) -> np.ndarray:
        marks = self.shared.value
        a, b = ((marks[p >> np.uint64(3)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) for p in self.places(numbers))
        return a & b

    def among(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df whose number may be marked."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.holds(column(batch, name))))

        return df.mapInArrow(trimmed(run), df.schema)


def _wanted_texts(docs: DataFrame, id_col: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """node and compressed text of the wanted classes (node, s1, s2, rep)."""
    asked = _Bloom(wanted, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = column(batch, id_col).cast(pa.int64())
            few = pa.array(np.flatnonzero(asked.holds(ids)), pa.int64())
            ids, some = ids.take(few), column(batch, text).take(few)
            one, two, bodies = [], [], []
            for row, h in shingle_sets(some, k):
                a, b = _signature(h)
                one.append(a), two.append(b), bodies.append(pack(encode(some[row].as_py())))
            yield pa.RecordBatch.from_arrays([ids, pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bodies, pa.binary())], ["id", "s1", "s2", "body"])

    # of rows of one id with equal sets, whose texts may differ by white space and case, any will do
    found = docs.select(id_col, text).mapInArrow(trimmed(run), "id long, s1 long, s2 long, body binary").alias("f")
    w = wanted.alias("w")
    met = found.join(w, (F.col("f.s1") == F.col("w.s1")) & (F.col("f.s2") == F.col("w.s2")) & F.col("f.id").eqNullSafe(F.col("w.rep")))
    return met.select("w.node", "f.body").groupBy("node").agg(F.first("body").alias("body"))


def _plausible(pairs: DataFrame, names: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and parity bits allow the overlap. Where the parities of two sets differ, the sets do."""
    asked = _Bloom(pairs.select(F.explode(F.array("q", "c")).alias("node")), "node")
    known = asked.among(names.select("node", "n", "bits"), "node")
    both = pairs.join(known.select(F.col("node").alias("q"), F.col("n").alias("n"), F.col("bits").alias("a")), "q").join(known.select(F.col("node").alias("c"), F.col("n").alias("m"), F.col("bits").alias("b")), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = column(batch, "n").to_numpy().astype(np.int64) + column(batch, "m").to_numpy()
            a, b = (np.frombuffer(b"".join(column(batch, x).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for x in ("a", "b"))
            apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            yield batch.select(["q", "c"]).filter(pa.array(apart <= total + 2 * (-num * total // (num + den))))

    return both.select("q", "c", "n", "m", "a", "b").mapInArrow(trimmed(run), "q long, c long")


def divide_skip(query: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Numbers of the sets (sorted arrays) that link with the query."""
    if not len(query) or not sets:
        return []
    n = len(query)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    low, high = np.searchsorted(items, query, "left"), np.searchsorted(items, query, "right")
    length = high - low
    least = min(need(n, len(s), num, den) for s in sets)
    if int((length > 0).sum()) < least:
        return []
    longest = int(length.max())
    n_long = min(int(least / (MU * np.log2(longest + 1) + 1)), least - 1, n)
    by_length = np.argsort(length, kind="stable")
    short, long = by_length[: n - n_long], by_length[n - n_long :]
    counts: dict[int, int] = {}
    lists = [owner[low[i] : high[i]].tolist() for i in short if length[i]]
    at, current = 0, -1
    for x in heapq.merge(*lists):
        if x != current:
            if at >= least - n_long and current >= 0:
                counts[current] = at
            at, current = 0, x
        at += 1
    if at >= least - n_long and current >= 0:
        counts[current] = at
    probes = np.sort(query[long])
    out = []
    for c, overlap in counts.items():
        s = sets[c]
        wanted = need(n, len(s), num, den)
        if overlap + len(probes) < wanted:
            continue
        if len(probes):
            place = np.searchsorted(s, probes)
            overlap += int((s[np.minimum(place, len(s) - 1)] == probes).sum())
        if overlap >= wanted:
            out.append(c)
    return out


def _check(pairs: DataFrame, bodies: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that link: a, b."""
    parts = pairs.groupBy("q").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    dealt = pairs.join(parts, "q").select("q", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), "c")
    # one row for each query of a part (kind 0) and for each of its candidates
    asked = dealt.select("q", "part", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("q").alias("node")), F.struct(F.lit(1).alias("kind"), F.col("c").alias("node")))).alias("x")).select("q", "part", "x.kind", "x.node").distinct()
    texts = _Bloom(asked, "node").among(bodies, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            found = {nodes[c] for c in divide_skip(query, items, num, den)} if nodes else ()
            return [(key[0], c) for c in found]

        expand = zstandard.ZstdDecompressor().decompress
        key, query, nodes, items, out = None, None, [], [], []
        for batch in batches:
            for q, part, kind, c, body in zip(*(column(batch, x).to_pylist() for x in ("q", "part", "kind", "node", "body")), strict=True):
                if (q, part) != key:
                    out += links()
                    key, query, nodes, items = (q, part), np.zeros(0, np.uint64), [], []
                h = shingle_set(expand(body), k)
                if kind == 0:
                    query = h
                else:
                    nodes.append(c), items.append(h)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
                out = []
        out += links()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return asked.join(texts, "node").select("q", "part", "kind", "node", "body").repartition("q", "part").sortWithinPartitions("q", "part", "kind").mapInArrow(trimmed(run), "a long, b long")


def block_degrees(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """How many sets of the other block each set links with; without a right block, how many others of its own."""
    sets = left if right is None else right
    sizes = np.array([len(s) for s in sets], np.int64)
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    one, two = np.zeros(len(left), np.int64), np.zeros(len(sets), np.int64)
    for i, query in enumerate(left):
        low = np.searchsorted(items, query, "left")
        length = np.searchsorted(items, query, "right") - low
        at = np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())
        overlap = np.bincount(owner[at], minlength=len(sets))
        links = (overlap > 0) & (overlap * (num + den) >= num * (len(query) + sizes))
        one[i] = links.sum() - (right is None)
        two += links
    return one, two


def _degrees(roots: DataFrame, names: DataFrame, bodies: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node and degree (the other classes that it links with) of all classes in components of several."""
    linked = _Bloom(roots, "node")
    bodies = linked.among(bodies, "node")
    sized = roots.join(linked.among(names.select("node", "n"), "node"), "node")
    shape = sized.groupBy("root").agg(F.count("*").alias("m"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("parts"))
    members = roots.join(shape, "root")
    dealt = members.where("m > 2").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(bodies, "node")
    faced = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = faced.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count():
            if not nodes[0]:
                return
            if key[1] == key[2]:
                out.append((nodes[0], block_degrees(items[0], None, num, den)[0]))
            elif nodes[1]:
                out.extend(zip(nodes, block_degrees(items[0], items[1], num, den), strict=True))

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([x for names, _ in out for x in names], pa.int64()), pa.array(np.concatenate([d for _, d in out]) if out else [], pa.int64())], ["node", "degree"])

        expand = zstandard.ZstdDecompressor().decompress
        key, nodes, items, out = None, ([], []), ([], []), []
        for batch in batches:
            blobs = column(batch, "body")
            for row, (*now, side, node) in enumerate(zip(*(column(batch, x).to_pylist() for x in ("root", "low", "high", "side", "node")), strict=True)):
                if now != key:
                    count()
                    key, nodes, items = now, ([], []), ([], [])
                nodes[side].append(node), items[side].append(shingle_set(expand(blobs[row].as_py()), k))
            if out:
                yield packed()
                out = []
        count()
        yield packed()

    counted = rows.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "side").mapInArrow(trimmed(run), "node long, degree long")
    return counted.unionByName(members.where("m = 2").select("node", F.lit(1).cast("long").alias("degree"))).groupBy("node").agg(F.sum("degree").alias("degree"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id.

    component_id: the smallest id reachable by links, the row's own included; texts with equal shingle sets
    are linked. A null text, or one without words, has no shingles, no links and its own id. Null ids are passed
    over for the smallest id (null if there is no other). Repeated rows give repeated results; an empty table
    gives an empty one; other columns are not read.
    """
    return _joined(docs, k, num, den, id_col, text_col, False)


def jaccard_links(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """jaccard_components() with n_links: the other shingle sets of the table that the row's own links with, all of them.

    Rows of equal shingle sets are one class: they have the same n_links, and no links to one another count. The time
    may grow with the square of a component's classes, as the links do; the rows that are shuffled are the classes times the
    blocks of their component.
    """
    return _joined(docs, k, num, den, id_col, text_col, True)


def _joined(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, counted: bool) -> DataFrame:
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_counters(docs, text_col, k))
    posted = stored(_sets(docs, id_col, text_col, k, num, den, order), "sets")
    grouped = posted.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("posted").alias("posted"), F.first("bits").alias("bits"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = stored(posted.select("id", "n", "s1", "s2"), "rows")
    discard(posted)
    lists = stored(_entries(classes).repartition("h").sortWithinPartitions("h", "n").mapInArrow(trimmed(_shared(num, den)), "h long, node long, n int, pos int"), "lists")
    names = stored(classes.select("node", "s1", "s2", "rep", "n", "bits"), "names")
    discard(classes)
    wanted = stored(lists.select("node").distinct().join(names.select("node", "s1", "s2", "rep"), "node"), "wanted")
    bodies = stored(_wanted_texts(docs, id_col, text_col, k, wanted), "texts")
    discard(wanted)

    links, roots, done = [], None, []
    for turn in (*range(HUB_ROUNDS), None):
        rooted = _open_lists(_rooted(lists, roots)) if turn != 0 else _rooted(lists, roots)
        made = _pairs(rooted if turn is not None else rooted.join(names.select("node", "bits"), "node"), turn, num, den)
        for known in done:
            made = made.join(known, ["q", "c"], "left_anti").join(known.select(F.col("q").alias("c"), F.col("c").alias("q")), ["q", "c"], "left_anti")
        made = stored(made, "pairs")
        if not made.isEmpty():
            pairs = stored(_plausible(made, names, num, den), "plausible")
            done.append(pairs)
            found = stored(_check(pairs, bodies, k, num, den), "links")
            links.append(found)
            if not found.isEmpty():
                before, roots = roots, stored(components(reduce(DataFrame.unionByName, links)), "roots")
                if before is not None:
                    discard(before)
        discard(made)
    discard(lists, *done, *links)
    if roots is None:
        roots = spark.createDataFrame([], "node long, root long")
    labels = names.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labels.groupBy("root").agg(F.min("rep").alias("least"))
    if counted:
        labels = labels.join(stored(_degrees(roots, names, bodies, k, num, den), "degrees"), "node", "left")
    discard(bodies)
    n_links = [F.coalesce("degree", F.lit(0)).cast("long").alias("n_links")] if counted else []
    named = labels.join(least, "root").select(F.col("s1").alias("l1"), F.col("s2").alias("l2"), "least", *n_links)
    out = rows.where("n > 0").join(named, (F.col("s1") == F.col("l1")) & (F.col("s2") == F.col("l2")), "left")
    kind = docs.schema[id_col].dataType
    picked = lambda df, c, *more: df.select(F.col("id").cast(kind).alias(id_col), F.col("n").cast("long").alias("n_shingles"), c.cast(kind).alias("component_id"), *more)
    return picked(out, F.col("least"), *(["n_links"] if counted else [])).unionByName(picked(rows.where("n = 0"), F.col("id"), *([F.lit(0).cast("long").alias("n_links")] if counted else [])))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all their columns, of which each stands for its component: the one of smallest id.

    Rows without shingles all stay. Of repeated rows (same id and text) one stays, whatever their other columns hold. Rows
    without an id come after those with one. Columns of any names are carried along; an empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    tag = F.xxhash64(text)
    late = F.shiftrightunsigned(tag, 2).bitwiseOR(F.lit(1 << 62))
    number = F.coalesce(docs[id_col].cast("long"), late)
    found = jaccard_components(docs.select(number.alias("number"), docs[text_col].alias("text")), id_col="number", text_col="text", **options)
    first = found.where(F.col("number") == F.col("component_id")).select("number").distinct()
    named = docs.select(number.alias("number"), tag.alias("tag"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return named.join(first, "number", "left_semi").dropDuplicates(["number", "tag"]).select("row.*")
