"""N-gram Jaccard join over a count-vector R-tree.

Every distinct shingle set is a point: its tokens are hashed into groups and the group counts are the coordinates.
Two sets share at most the sum of the coordinate minima, and that bound prunes rectangles and pairs before any sets
are compared.

The top of the tree is shared out over the cluster. The coordinates are dealt into blocks; sets of J >= t differ in at
most d = (a + b)(1 - t)/(1 + t) shingles, so with d + s blocks they have equal sub-vectors in at least s. A cell is
one block of one size band with one sub-vector of two shingles or more (a rectangle that is a point in these
coordinates; a single shingle may be a common one). If all equal blocks hold less, both sets have s such blocks or more;
these sets are dealt into blocks again by another hash, up to eight times, and only what is left then (about the eighth
power of a small share) goes to one cell. Below, each cell that still holds more than one component is bulk-loaded into
an R-tree and searched; its coordinates are so many that unrelated sets of any size fail the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.components import components
from codelake.llm.store import BROADCAST_ROWS, forget, written
from codelake.llm.textkit import U, mix, returning_memory, shingle_sets, slices
from codelake.session import ship

GROUP_BITS = 24  # groups behind the blocks: many more than blocks, so that a block of one shingle is not a common one
COORDINATES = 256  # least coordinates of the trees in the cells
LAYOUTS = 8
WAITING = 200_000  # pairs that a task holds back to name them once
TOGETHER = 5_000  # rows of cells with the same smallest point that go to one task
CELL = 2048  # points of one tree; larger cells are searched as pairs of chunks
LEAF = 16
PAYS = 10  # rounds of best pairs go on while more than one in so many that the bound allows is a link


def bands(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """(first size, blocks, spare, least) of each size band up to size ``most``; J >= percent/100 pairs lie in one band or
    in two neighbours, and differ in at most blocks - spare shingles if the smaller one is in the band. Blocks of fewer
    than ``least`` shingles have no cell; there are so many spare ones that few sets of the band have as many of these,
    where sets are large enough for that."""
    out, first = [], 1
    while first <= most:
        after = first * 100 // percent + 1
        a = after - 1
        b = a * 100 // percent
        d = (a + b) * (100 - percent) // (100 + percent)
        found = (2, 1)
        for least in (2, 1) if d else ():
            spare = np.arange(2, 10 + d)
            each = first / (d + spare)
            poor = (d + spare) * np.exp(-each) * (1 + each if least == 2 else 1)
            enough = np.flatnonzero(spare >= poor + 1.5 * poor**0.5)
            if len(enough):
                found = int(spare[enough[0]]), least
                break
        out.append((first, d + found[0], *found))
        first = after
    return out


def cells(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, cell) for all cells of every set: the sub-vectors of enough shingles, in the set's own band's
    layout and in the one below. Sets with as many other blocks as the band has spare ones have cells in the next
    layout too, and after the last one the cell of such sets."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    if not len(sets) or not size.max():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    layout = bands(percent, int(size.max()))
    first, blocks, spare, least = (np.array(x) for x in zip(*layout, strict=True))
    band = np.searchsorted(first, size, "right") - 1
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    group = tokens >> U(64 - GROUP_BITS)
    weight = (mix(group ^ U(0x7F4A7C15)) >> U(20)).astype(np.float64)  # sums of 512 stay exact
    at, out = [], []
    for lower in (0, 1):
        k = band - lower
        n = np.where((size > 0) & (k >= 0), blocks[np.maximum(k, 0)], 0)
        room, few = spare[np.maximum(k, 0)], least[np.maximum(k, 0)]
        open_ = n > room  # with d = 0 only equal sets are alike, and those are one point already
        for turn in range(LAYOUTS):
            if not open_.any():
                break
            own = np.where(open_, n, 0)
            begin = np.concatenate([[0], np.cumsum(own)])
            inside = np.flatnonzero(open_[owner])
            who = owner[inside]
            spread = mix(group[inside] + U(turn << 32)) >> U(20)
            key = begin[who] + (spread % own[who].astype(U)).astype(np.int64)
            total = np.bincount(key, weight[inside], begin[-1])
            of = np.repeat(np.arange(len(sets)), own)
            full = np.flatnonzero(np.bincount(key, minlength=begin[-1]) >= few[of])
            of = of[full]
            block = full - begin[of]
            at.append(of)
            out.append(mix(total[full].astype(U) ^ mix(((turn << 56) + block * 4096 + k[of]).astype(U))))
            open_ &= own - np.bincount(of, minlength=len(sets)) >= room
        at.append(np.flatnonzero(open_))
        out.append(mix((k[open_] + (1 << 40)).astype(U)))
    return np.concatenate(at), np.concatenate(out).view(np.int64)


def fine(size: int) -> int:
    """Coordinates of the vector of sets of about this size: at most eight shingles in each, so that the bound tells
    unrelated sets apart."""
    return max(COORDINATES, 1 << int(max(size - 1, 1) // 8).bit_length())


def folded(vecs: list[bytes], coordinates: int) -> np.ndarray:
    """Vectors of ``coordinates`` numbers, one a row, from vectors as long or longer. 255 stands for 255 and more."""
    out = np.empty((len(vecs), coordinates), np.uint8)
    size = np.fromiter(map(len, vecs), np.int64, len(vecs))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join([vecs[i] for i in at]), np.uint8).reshape(len(at), n // coordinates, coordinates)
        out[at] = x[:, 0] if n == coordinates else np.where((x == 255).any(1), 255, np.minimum(x.sum(1, dtype=np.int64), 255))
    return out


def counted(tokens: np.ndarray, coordinates: int) -> bytes:
    """Group counts, where the coordinates of a shorter vector are sums of those of a longer one (below 255)."""
    return np.minimum(np.bincount((tokens >> U(30)).astype(np.int64) % coordinates, minlength=coordinates), 255).astype(np.uint8).tobytes()


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each set (0, 0 for the empty set)."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens = np.concatenate([*sets, np.zeros(1, U)])
    begin = np.concatenate([[0], np.cumsum(size)])
    out = []
    for salt in (0x51ED270B, 0xB5297A4D):
        total = np.concatenate([[U(0)], np.cumsum(mix(tokens ^ U(salt)), dtype=U)])
        x = mix(total[begin[1:]] - total[begin[:-1]] + size.astype(U))
        x[size == 0] = U(0)
        out.append(x.view(np.int64))
    return out[0], out[1]


def _points(k: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for s in slices(texts):
                sets = shingle_sets(texts[s], k)
                k1, k2 = set_keys(sets)
                yield pa.RecordBatch.from_arrays([ids[s.start : s.stop], pa.array(np.fromiter(map(len, sets), np.int64, len(sets))), pa.array(k1), pa.array(k2)], ["doc_id", "n", "k1", "k2"])

    return run


def _cells(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None]
            for s in slices(texts):
                sets = shingle_sets(texts[s], k)
                k1, _ = set_keys(sets)
                at, cell = cells(sets, percent)
                once = np.unique(np.stack([cell, k1[at]], 1), axis=0) if len(cell) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["cell", "k1"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, k1) sorted by both, (cell, k1, lead) of the cells that hold two sets and more, each set once; the
    lead is the smallest. Only one row is held back, however many a cell has."""
    cell = lead = last = None  # of the row before
    waits = False  # whether that row is its cell's only one so far
    for b in batches:
        c, k = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(c):
            continue
        new = np.concatenate([[cell is None or c[0] != cell or k[0] != last], (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
        c, k = c[new], k[new]
        if not len(c):
            continue
        goes_on = cell is not None and c[0] == cell
        begin = np.flatnonzero(np.concatenate([[not goes_on], c[1:] != c[:-1]]))
        runs = np.concatenate([[0], begin]) if goes_on else begin
        size = np.diff(np.append(runs, len(c)))
        first = k[runs]
        several = size > 1
        if goes_on:
            first[0], several[0] = lead, True
        out = [np.repeat(x, size)[np.repeat(several, size)] for x in (c[runs], first)]
        parts = [(out[0], k[np.repeat(several, size)], out[1])]
        if goes_on and waits:
            parts.insert(0, tuple(np.array([x]) for x in (cell, lead, lead)))
        cell, lead, last, waits = c[-1], first[-1], k[-1], not several[-1]
        for x in parts:
            if len(x[0]):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in x], ["cell", "k1", "lead"])


def _members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "n", "vec", "tokens"]
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in slices(texts):
                sets = shingle_sets(texts[s], k)
                k1, k2 = set_keys(sets)
                vec = [counted(x, fine(len(x))) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array([len(x) for x in sets], pa.int64()), pa.array(vec, pa.binary()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], names)

    return run


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap at which sets of a and b shingles have J >= percent/100."""
    return -(-percent * (a + b) // (100 + percent))


def bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (ra, na, va, rb, nb, vb), the pairs (ra, rb) that the overlap bound allows."""
    for batch in batches:
        na, nb = batch.column(1).to_numpy(), batch.column(4).to_numpy()
        least = -(-percent * (na + nb) // (100 + percent))
        keep = np.minimum(na, nb) >= least
        sides = [batch.column(i).to_pylist() for i in (2, 5)]
        wide = np.array([[len(x) for x in side] for side in sides]).reshape(2, -1)
        for pair in np.unique(wide[:, keep], axis=1).T:
            every = np.flatnonzero(keep & (wide == pair[:, None]).all(0))
            step = max((1 << 22) // int(pair.max()), 1)
            for c in range(0, len(every), step):
                at = every[c : c + step]
                a, b = (folded([side[i] for i in at], int(pair.min())) for side in sides)
                keep[at] = overlap_bound(a, b) >= least[at]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(3).filter(pa.array(keep))], ["ra", "rb"])


def linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of joined candidate rows (a, ta, b, tb), the pairs whose sets really overlap enough."""
    for batch in batches:
        left, right, keep = batch.column(1).to_pylist(), batch.column(3).to_pylist(), []
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            least = needed(len(x) // 8, len(y) // 8, percent)
            if min(len(x), len(y)) // 8 >= least and len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) >= least:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(2).take(pa.array(keep, pa.int64()))], ["a", "b"])


def overlap_bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum of coordinate minima over the last axis; a coordinate that is full (255) in both counts as unbounded."""
    low = np.minimum(p, q)
    return low.sum(-1, dtype=np.int64) + (low == 255).sum(-1) * (1 << 20)


def tree_pairs(vecs: np.ndarray, sizes: np.ndarray, percent: int, part: np.ndarray | None = None) -> np.ndarray:
    """Pairs (i, j), i < j, of points that the overlap bound allows; with ``part``, only those of different parts.

    A packed R-tree: points sorted by size, then by the place of their largest coordinate, cut into leaves whose
    rectangles hold the coordinate maxima and the size range; each leaf of queries is held against all rectangles at
    once, then its points against the points of the rectangles that are left. A leaf alone is searched directly. The
    points of the largest part come last, so that its leaves are not held against each other.
    """
    count = len(sizes)
    part = np.arange(count) if part is None else np.unique(part, return_inverse=True)[1]
    if count <= LEAF:
        i, j = np.triu_indices(count, 1)
        i, j = i[part[i] != part[j]], j[part[i] != part[j]]
        ok = overlap_bound(vecs[i], vecs[j]) >= -(-percent * (sizes[i] + sizes[j]) // (100 + percent))
        return np.stack([i[ok], j[ok]], 1)
    order = np.lexsort((vecs.argmax(1), sizes, part == np.bincount(part).argmax()))
    v, n, of = vecs[order], sizes[order], part[order]
    edge = np.arange(0, count, LEAF)
    high = np.maximum.reduceat(v, edge, 0)
    small, big = np.minimum.reduceat(n, edge), np.maximum.reduceat(n, edge)
    low, top = np.minimum.reduceat(of, edge), np.maximum.reduceat(of, edge)
    out = []
    for q in range(len(edge)):
        a = slice(edge[q], min(edge[q] + LEAF, count))
        later = np.arange(q, len(edge))
        later = later[(low[q] != top[q]) | (low[later] != low[q]) | (top[later] != low[q])]
        near = later[(100 * big[later] >= percent * small[q]) & (100 * big[q] >= percent * small[later])]
        near = near[overlap_bound(high[q], high[near]) >= -(-percent * (small[q] + small[near]) // (100 + percent))]
        for r in near:
            b = slice(edge[r], min(edge[r] + LEAF, count))
            i, j = np.nonzero(overlap_bound(v[a, None, :], v[None, b, :]) >= -(-percent * (n[a, None] + n[None, b]) // (100 + percent)))
            i, j = i[of[a][i] != of[b][j]], j[of[a][i] != of[b][j]]
            i, j = order[i + a.start], order[j + b.start]
            out.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1)[(i < j) if q == r else slice(None)])
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _search(percent: int, best: bool = False):
    """Searches cell after cell of rows (cell, _i, _j, _mine, k1, n, part, vec) that stand together by cell, _i, _j. Pairs
    of one group of copies meet in many cells, most of them in the same task: it names them once. With ``best``, it
    names one pair of each two parts: the one whose bound is farthest above what a link needs."""

    def pairs(t: pa.Table, ends: np.ndarray) -> Iterator[np.ndarray]:
        mine, key, n, part = (t.column(c).to_numpy() for c in ("_mine", "k1", "n", "part"))
        two = t.column("_i").to_numpy() != t.column("_j").to_numpy()
        bufs = t.column("vec").to_pylist()
        size = np.diff(ends)
        wide = np.minimum.reduceat(np.fromiter(map(len, bufs), np.int64, len(bufs)), ends[:-1])  # of each cell, what all its vectors have
        for w in np.unique(wide).tolist():
            rows = np.flatnonzero(np.repeat(wide == w, size))
            cell = np.flatnonzero(wide == w)
            first = np.concatenate([[0], np.cumsum(size[cell])])
            vecs, m_, n_, part_ = folded([bufs[i] for i in rows], w), mine[rows], n[rows], part[rows]
            found = []
            for m in np.unique(size[cell][(size[cell] > 1) & (size[cell] <= 8)]):  # many small cells at once
                i, j = np.triu_indices(m, 1)
                begin = first[:-1][size[cell] == m]
                x, y = (begin[:, None] + i).ravel(), (begin[:, None] + j).ravel()
                step = max((1 << 22) // w, 1)
                for c in range(0, len(x), step):
                    p, q = x[c : c + step], y[c : c + step]
                    q, p = q[part_[p] != part_[q]], p[part_[p] != part_[q]]
                    ok = overlap_bound(vecs[p], vecs[q]) >= -(-percent * (n_[p] + n_[q]) // (100 + percent))
                    found.append(np.stack([p[ok], q[ok]], 1))
            large = size[cell] > 8
            for a, b in zip(first[:-1][large].tolist(), first[1:][large].tolist(), strict=True):
                found.append(a + tree_pairs(vecs[a:b], n_[a:b], percent, part_[a:b]))
            got = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            p, q = got[:, 0], got[:, 1]
            ok = ~two[rows][p] | (m_[p] != m_[q])
            p, q = p[ok], q[ok]
            x, y = key[rows][p], key[rows][q]
            named = [np.minimum(x, y), np.maximum(x, y)]
            if best:
                step = max((1 << 22) // w, 1)
                over = np.concatenate([np.zeros(0), *(overlap_bound(vecs[p[c : c + step]], vecs[q[c : c + step]]) for c in range(0, len(p), step))])
                over = over * (100 + percent) / (n_[p] + n_[q])  # over ``percent``, as far as the bound is above the need
                named += [np.minimum(part_[p], part_[q]), np.maximum(part_[p], part_[q]), -(over * 1e6).astype(np.int64)]
            yield once(np.stack(named, 1))

    def once(held: np.ndarray) -> np.ndarray:
        """Rows (a, b), each once; with ``best`` rows (a, b, part, part, rank), of each two parts the one of least rank."""
        if not best:
            return np.unique(held, axis=0)
        held = held[np.lexsort(held.T[[1, 0, 4, 3, 2]])]
        return held[np.concatenate([[True], (held[1:, 2:4] != held[:-1, 2:4]).any(1)])[: len(held)]]

    def cells_in(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            name = np.stack([t.column(c).to_numpy() for c in ("cell", "_i", "_j")], 1)
            cut = np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1
            if len(cut):
                yield from pairs(t.slice(0, cut[-1]), np.concatenate([[0], cut]))
                t = t.slice(cut[-1])
            rest = t
        if rest is not None and rest.num_rows:
            yield from pairs(rest, np.array([0, rest.num_rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5 if best else 2), np.int64)
        for found in cells_in(batches):
            held = np.concatenate([held, found])
            if len(held) > WAITING:
                held = once(held)
                if len(held) > WAITING // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["a", "b"])
                    held = held[:0]
        held = once(held)
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable over links).

    Words are runs of anything but x20 and x09-x0D, A-Z lower-cased. Two documents link when their sets of distinct
    k-word shingles have J >= percent/100; fewer words than k count as one shingle. Exact: cells find every linked
    pair, and pairs are verified on whole sets (of 64-bit shingle hashes).

    Rounds: (1) identical sets collapse to one point, and only one document of each makes cells, which are shuffled
    once and kept where they hold two points; (2) in every cell each point is paired with the smallest one,
    the pairs are verified, and components formed; (3) cells that still hold several components are searched with an
    R-tree for pairs across components: of each two components that meet in a task only the pair with the most room in
    the bound is named, verified and joined, again and again while that finds links; (4) a last search names all pairs
    across the components that are left, again verified. So a large group of near copies costs about one pair a copy, and
    all of a component's pairs with another one are named only if none of the tried ones is a link.
    Cells of over 2,048 points are searched chunk against chunk, each its own task. Keys are 64-bit; two different
    sets of one key are told apart when verified.

    Nulls: a null or wordless text has 0 shingles and links with nothing; a row with a null id has its n_shingles and
    a null component_id. Repeated rows are linked as copies. Ties do not arise. Extra columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    points = written(src.mapInArrow(returning_memory(_points(k, id_col, text_col)), "doc_id long, n long, k1 long, k2 long"), "points")
    reps = written(points.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "reps")

    one = reps.select(F.col("rep").alias("doc_id"))
    one = F.broadcast(one) if reps.count() <= BROADCAST_ROWS else one
    every = src.join(one, "doc_id", "left_semi").mapInArrow(returning_memory(_cells(k, percent)), "cell long, k1 long")
    every = every.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "k1")
    held = written(every.mapInArrow(returning_memory(_together), "cell long, k1 long, lead long"), "held")
    stars = written(held.where("k1 <> lead").select(F.col("lead").alias("a"), F.col("k1").alias("b")).distinct(), "stars")

    wanted = written(stars.select(F.col("a").alias("k1")).union(stars.select("b")).distinct().join(reps, "k1"), "wanted")

    def drawn(sets: DataFrame, columns: list[str], name: str) -> DataFrame:
        """Columns of ``_members`` and rep of the sets (k1, k2, rep), once each, from their own documents."""
        ids = sets.select(F.col("rep").alias("doc_id")).distinct()
        ids = F.broadcast(ids) if sets.count() <= BROADCAST_ROWS else ids
        rows = src.join(ids, "doc_id", "left_semi").mapInArrow(returning_memory(_members(k)), "k1 long, k2 long, n long, vec binary, tokens binary")
        found = written(rows.select("k1", "k2", *columns).join(sets.select("k1", "k2", "rep"), ["k1", "k2"]), name)
        return found if found.count() == sets.count() else written(found.dropDuplicates(["rep", "k1", "k2"]), name)  # repeated rows

    members = drawn(wanted, ["n", "vec"], "members")

    def verify(pairs: DataFrame) -> tuple[DataFrame, int]:
        """(links, how many pairs the overlap bound allows) of pairs (a, b) of keys."""
        left, right = (members.select(F.col("k1").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("vec").alias(f"v{x}")) for x in "ab")
        near = pairs.join(left, "a").join(right, "b").select("ra", "na", "va", "rb", "nb", "vb")
        near = written(near.mapInArrow(lambda it: bounded(it, percent), "ra long, rb long"), "near")
        reps_of = near.select(F.col("ra").alias("rep")).union(near.select("rb")).distinct()
        whole = drawn(written(wanted.join(reps_of, "rep", "left_semi"), "near-sets"), ["tokens"], "tokens")
        left, right = (whole.select(F.col("rep").alias(f"r{x}"), F.col("tokens").alias(f"t{x}")) for x in "ab")
        rows = near.join(left, "ra").join(right, "rb").select("ra", "ta", "rb", "tb")
        return written(rows.mapInArrow(lambda it: linked(it, percent), "a long, b long"), "links"), near.count()

    def joined(named: DataFrame, links: DataFrame) -> DataFrame:
        """``named`` with the parts joined that links of their points connect."""
        of = named.select("rep", "part").distinct()
        left, right = (of.select(F.col("rep").alias(x), F.col("part").alias(f"p{x}")) for x in "ab")
        label = components(links.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
        out = named.join(label, F.col("part") == F.col("node"), "left").withColumn("part", F.coalesce("component", "part"))
        return written(out.select("k1", "rep", "n", "vec", "part"), "named")

    def found_in(cells_: DataFrame, named: DataFrame, best: bool) -> DataFrame:
        """Pairs (a, b) of keys across parts that the search finds in the rows (cell, k1, lead) of cells of several parts."""
        light = cells_.join(named.select("k1", "part"), "k1")
        split = light.groupBy("cell").agg(F.min("lead").alias("lead"), F.min("part").alias("_x"), F.max("part").alias("_y"), F.count(F.lit(1)).alias("_m")).where("_x <> _y")
        split = written(split.select("cell", "lead", "_m", F.ceil(F.col("_m") / CELL).cast("int").alias("_parts")), "split")
        tasks = split.groupBy("lead").agg(F.ceil(F.sum(F.col("_m") * F.col("_parts")) / TOGETHER).alias("_tasks"))
        rows = cells_.select("cell", "k1").join(split.join(tasks, "lead"), "cell").join(named, "k1")
        rows = rows.withColumn("_mine", F.pmod(F.xxhash64("k1"), F.col("_parts")).cast("int"))
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        rows = rows.select("cell", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_mine", "k1", "n", "part", "vec", "lead", "_tasks")
        rows = rows.withColumn("_task", F.pmod(F.xxhash64("cell", "_i", "_j"), F.col("_tasks")))
        rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lead", "_task").sortWithinPartitions("lead", "_task", "cell", "_i", "_j").drop("lead", "_task", "_tasks")
        pairs = rows.mapInArrow(returning_memory(_search(percent, best)), "a long, b long").distinct()
        pairs = written(pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti"), "pairs")
        tried.append(pairs)
        forget(split)
        return pairs

    sure, _ = verify(stars)
    tried = [stars]
    named = joined(members.select("k1", "rep", "n", "vec", F.col("rep").alias("part")), sure)
    light = held.join(named.select("k1", "part"), "k1")
    several = light.groupBy("cell").agg(F.min("part").alias("_x"), F.max("part").alias("_y")).where("_x <> _y").select("cell")
    opened = written(held.join(several, "cell", "left_semi"), "open")
    forget(held)
    best = True
    while True:
        links, near = verify(found_in(opened, named, best))
        found = links.count()
        if found:
            before, named = named, joined(named, links)
            forget(before)
        if not best:
            break
        best = found * PAYS > near
    final = written(named.select(F.col("rep").alias("node"), F.col("part").alias("component")).distinct(), "final")
    for t in (opened, members, named, *tried):
        forget(t)
    set_label = reps.join(final, F.col("rep") == F.col("node")).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("component"))
    copies = reps.select(F.col("k1").alias("_r1"), F.col("k2").alias("_r2"), "rep")
    out = points.join(copies, (F.col("k1") == F.col("_r1")) & (F.col("k2") == F.col("_r2")) & (F.col("n") > 0), "left")
    out = out.join(set_label, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
