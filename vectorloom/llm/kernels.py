"""numpy kernels that work on one bounded group of unit vectors, in the order of their ids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

SEED = 20_261
#: About so many rows for each coarse cell of a group, before every row is put into several.
CELL = 32
#: Projections, and how many must collide: at the least similarity a pair passes with 0.9998, two random vectors with 0.11.
PROJECTIONS, COLLISIONS = 16, 12
#: Half a window in standard deviations of the difference that two vectors at the window's distance have in a projection.
REACH = 2.1
#: Rows of a block of queries.
BLOCK = 1024
#: Pairs that are listed at once while links are sought, and hubs with few hits after which no further one is tried in a cell.
PAIRS, STRAYS = 1 << 20, 32


def spread(cells: int) -> int:
    """In how many of so many random cells a vector is put: so many that two vectors at a cosine of 0.86 share none with a probability of at most 0.004.

    Simulated in 64 dimensions: 0.0005 for 32 and 64 cells, 0.003 for 128, 0.0005 for 256, 0.002 for 512 and 1,024, 0.003 for 4,096.
    """
    return 1 + math.ceil(0.8 * math.log2(cells)) if cells > 1 else 1


def nearest_centres(x32: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """The ``spread(cells)`` random directions to which each row is most similar, the most similar first: an array [row, place]."""
    centres = np.random.default_rng((seed, cells)).standard_normal((x32.shape[1], cells)).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=0)
    k = min(cells, spread(cells))
    out = np.empty((len(x32), k), np.int32)
    for at in range(0, len(x32), BLOCK):
        near = -(x32[at : at + BLOCK] @ centres)
        top = np.argpartition(near, k - 1, axis=1)[:, :k] if k < cells else np.tile(np.arange(cells), (len(near), 1))
        out[at : at + BLOCK] = np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1), 1)
    return out


def matrix(column) -> np.ndarray:
    """Unit rows, in double precision, of an Arrow column of arrays of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return x.reshape(0, 0)
    x = x.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(x32: np.ndarray, least_rows: int = 4096):
    """Of each coarse cell the ascending numbers of its rows, and the place of the cell among those of each row (0 is the nearest).

    Of few rows one cell, for each is in several, so cells would save nothing.
    """
    n = len(x32)
    many = min(2048, 1 << round(math.log2(max(1, n / CELL)))) if n > least_rows else 1
    if many == 1:
        yield np.arange(n), np.zeros(n, np.int64)
        return
    top = nearest_centres(x32, many, SEED)
    key = top.ravel()
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(part) > 1:
            yield part // top.shape[1], part % top.shape[1]


class SortedProjections:
    """For each random projection the sorted array of the rows' values, and each row's place in it.

    A window around a query is found by binary search; a row collides with the query where its place lies in the window.
    """

    def __init__(self, x32: np.ndarray, seed: int = SEED + 1):
        lines = np.random.default_rng(seed).standard_normal((x32.shape[1], PROJECTIONS)).astype(np.float32)
        self.values = np.ascontiguousarray((x32 @ lines).T)
        order = np.argsort(self.values, axis=1)
        self.arrays = np.take_along_axis(self.values, order, 1)
        kind = np.uint16 if len(x32) < 1 << 16 else np.uint32
        self.place = np.empty(order.shape, kind)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(len(x32), dtype=kind), order.shape), 1)

    def windows(self, rows: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, places) of the windows around the rows for the distances: arrays [projection, row]."""
        half = (REACH * distance).astype(np.float32)
        lo, hi = np.empty((2, len(self.arrays), len(rows)), self.place.dtype)
        for j, line in enumerate(self.arrays):
            v = self.values[j, rows]
            lo[j] = np.searchsorted(line, v - half)
            hi[j] = np.minimum(np.searchsorted(line, v + half, side="right"), np.iinfo(self.place.dtype).max)
        return lo, hi - lo

    def collisions(self, window: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
        """In how many projections each of the rows lies in each query's window: an array [query, row]."""
        hits = np.zeros((window[0].shape[1], len(rows)), np.uint8)
        for j, place in enumerate(self.place[:, rows]):
            # lo <= place < lo + size as one unsigned comparison
            hits += (place[None, :] - window[0][j][:, None]) < window[1][j][:, None]
        return hits


def nearest(x: np.ndarray, k: int, least: float, seed: int = 0, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The up to ``k`` most similar rows of each row, of similarity ``least`` or more: (row, other, similarity to 6 decimals).

    Collision counting: windows around the query in the sorted arrays of single projections; the rows of its cells that lie in
    COLLISIONS windows or more are verified in double precision. Virtual rehashing: windows are narrow at first, and sought in the query's nearest
    cell; queries whose k-th best lies outside of the window's distance ask again with twice the distance and in more cells, the last time with
    the distance of the least similarity and in all their cells. ``stats`` gets the numbers of counted and of verified pairs.
    """
    n = len(x)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    x32 = x.astype(np.float32)
    arrays = SortedProjections(x32, SEED + 1 + seed)
    widest = math.sqrt(2 - 2 * least)
    kth = np.full(n, -1.0)  # the k-th best similarity so far
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    counted = verified = 0
    parts = list(cells(x32))
    for sought, radius, probes in ((0, widest / 4, 1), (widest / 4, widest / 2, 3), (widest / 2, widest, n)):
        open_ = 2 - 2 * kth > sought * sought if sought else np.ones(n, bool)
        ask = np.flatnonzero(open_)
        lo, size = np.zeros((2, PROJECTIONS, n), arrays.place.dtype)
        lo[:, ask], size[:, ask] = arrays.windows(ask, np.minimum(radius, np.sqrt(np.maximum(0, 2 - 2 * kth[ask]))))
        for rows, place in parts:
            asked = rows[(place < probes) & open_[rows]]
            near = x32[rows] if len(asked) else None
            step = max(16, PAIRS // 8 // len(rows))
            for at in range(0, len(asked), step):
                q = asked[at : at + step]
                passed = arrays.collisions((lo[:, q], size[:, q]), rows) >= COLLISIONS
                counted += passed.size
                verified += int(passed.sum())
                a, b, s, best = _verify(x, x32, near, q, rows, passed, kth[q], k, least)
                found.append((a, b, s))
                kth[q] = np.maximum(kth[q], best)
    if stats is not None:
        stats["counted"], stats["verified"] = stats.get("counted", 0) + counted, stats.get("verified", 0) + verified
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    a, b, s = (np.concatenate(v) for v in zip(*found, strict=True))
    return _best(a, b, s, k)


def _verify(x, x32, near, ask, rows, passed, floor, k, least):
    """Of the pairs that passed those that may be among a query's k best: (query, row, similarity), and each query's k-th best of them."""
    best = np.full(len(ask), -2.0)
    if not passed.any():
        e = np.empty(0, np.int64)
        return e, e, np.empty(0), best
    low = (np.maximum(floor, least) - 1e-5).astype(np.float32)
    if passed.mean() > 0.02:
        sim32 = np.where(passed, x32[ask] @ near.T, np.float32(-2))
        stay = sim32 >= low[:, None]
        many = np.flatnonzero(stay.sum(axis=1) > 4 * k)
        if len(many):  # nothing below the k-th best (without the query itself) can stay
            at = len(rows) - k - 1
            stay[many] &= sim32[many] >= (np.partition(sim32[many], at, axis=1)[:, at] - np.float32(3e-6))[:, None]
        a, b = np.nonzero(stay)
    else:
        a, b = np.nonzero(passed)
        keep = np.einsum("ij,ij->i", x32[ask[a]], near[b]) >= low[a]
        a, b = a[keep], b[keep]
    other = ask[a] != rows[b]
    a, b = a[other], rows[b[other]]
    sim = np.round(np.einsum("ij,ij->i", x[ask[a]], x[b]), 6)
    keep = sim >= least
    a, b, sim = a[keep], b[keep], sim[keep]
    order = np.lexsort((-sim, a))
    start = np.searchsorted(a[order], np.arange(len(ask)))
    full = np.flatnonzero(np.bincount(a, minlength=len(ask)) >= k)
    best[full] = sim[order][start[full] + k - 1]
    return ask[a], b, sim, best


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best: most similar first, ties to the smaller row; equal pairs count once."""
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # equal pairs have equal similarity, so they are neighbours here
    a, b, sim = a[first], b[first], sim[first]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    keep = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)])) < k
    return a[keep], b[keep], sim[keep]


def links(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse affinities: links (row, other, cosine) of similarity ``least`` or more that hold together what is linked in each cell.

    In each cell a set of g similar rows takes g - 1 links, and never g x g; as a row is in several cells, with other links in each, a set is knit together by several times as many.
    """
    if len(x) < 2:
        e = np.empty(0, np.int64)
        return e, e, np.empty(0)
    x32 = x.astype(np.float32)
    ps, cs = [], []
    for rows, _ in cells(x32):
        p, c = _cell_forest(x32[rows], least)
        ps.append(rows[p])
        cs.append(rows[c])
    p, c = np.concatenate(ps), np.concatenate(cs)
    pair = np.unique(np.minimum(p, c) * len(x) + np.maximum(p, c))
    p, c = pair // len(x), pair % len(x)
    return p, c, np.einsum("ij,ij->i", x[p], x[c])


def power_iteration(x: np.ndarray, p: np.ndarray, c: np.ndarray, w: np.ndarray, labels, vectors: int = 6, steps: int = 512, every: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(embedding, the labels that ``labels`` gives for it): vectors multiplied by the normalised affinities until the labels no longer change.

    A step is half a step of the random walk along the links (rows of D^-1 W), half staying. The vectors begin as random projections of the rows, freed of
    their common part (the trivial eigenvector); they approach the eigenvectors of the eigenvalue 1, which are constant on each linked set.
    """
    n = len(x)
    e = x @ np.random.default_rng(SEED + 3).standard_normal((x.shape[1], vectors))
    e -= e.mean(axis=0)
    src, to, both = np.concatenate([p, c]), np.concatenate([c, p]), np.concatenate([w, w])
    degree = np.bincount(to, both, minlength=n)
    half = both / degree[to] / 2
    linked = degree > 0
    last = None
    for step in range(1, steps + 1):
        moved = np.stack([np.bincount(to, half * e[src, i], minlength=n) for i in range(vectors)], axis=1)
        e = np.where(linked[:, None], e / 2 + moved, e)
        if step % every == 0 or step == steps:
            now = labels(e)
            if last is not None and np.array_equal(now, last):
                break
            last = now
    return e, last


#: Clusters whose centres are nearer in every coordinate of the embedding are one.
GRID = 0.02


def k_means(e: np.ndarray, gap: float = GRID, rounds: int = 2) -> np.ndarray:
    """The first row of each row's cluster. There are as many clusters as the embedding has clumps: the first centres come from cutting it at
    gaps, coordinate by coordinate; then Lloyd's steps move the rows that are nearer to another centre.
    """
    n, d = e.shape
    label = np.zeros(n, np.int64)
    for i in (*range(d), *range(d)):
        order = np.lexsort((e[:, i], label))
        new = np.r_[True, (label[order][1:] != label[order][:-1]) | (np.diff(e[order, i]) > gap)]
        label[order] = np.cumsum(new) - 1
    for _ in range(rounds):
        size = np.bincount(label)
        centres = np.stack([np.bincount(label, e[:, i]) for i in range(d)], axis=1) / np.maximum(size, 1)[:, None]
        # a row within half a gap of its centre has no nearer one
        far = np.flatnonzero(np.abs(e - centres[label]).max(axis=1) > gap / 2)
        for at in range(0, len(far), BLOCK):
            rows = far[at : at + BLOCK]
            away = (centres * centres).sum(axis=1)[None, :] - 2 * e[rows] @ centres.T
            away[:, size == 0] = np.inf
            label[rows] = away.argmin(axis=1)
    first = np.full(label.max() + 1, n)
    np.minimum.at(first, label, np.arange(n))
    return first[label]


def spectral_sets(x: np.ndarray, least: float, cluster=k_means) -> tuple[np.ndarray, dict]:
    """(the first row of each row's linked set, measures) by spectral clustering and an exact check of what it says.

    The check looks for links between clusters, which are then merged, and for clusters that their links don't hold together, which are parted. The measures: how many
    sets of two rows or more there are, how many of them were clusters as they stood, how many clusters were parted, and links between clusters.
    """
    n = len(x)
    p, c, w = links(x, least)
    if not len(p):
        return np.arange(n), {"sets": 0, "right": 0, "parted": 0, "across": 0}
    at = np.flatnonzero(np.bincount(np.concatenate([p, c]), minlength=n))
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    p, c = place[p], place[c]
    _, label = power_iteration(x[at], p, c, w, cluster)
    across = label[p] != label[c]
    part = _components(len(at), p[~across], c[~across])
    whole = part
    if across.any():
        whole = _components(len(at), part[p[across]], part[c[across]])[part]
    parted = len(np.unique(label[part != label]))
    set_size, cluster_size, part_size = (np.bincount(v, minlength=len(at)) for v in (whole, label, part))
    heads = np.unique(whole)
    right = (cluster_size[heads] == set_size[heads]) & (part_size[heads] == set_size[heads])
    root = np.arange(n)
    root[at] = at[whole]
    return root, {"sets": len(heads), "right": int(right.sum()), "parted": parted, "across": int(across.sum())}


def _components(n: int, p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The smallest row of each row's set."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[c])
        new = root.copy()
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[c], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _cell_forest(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    todo = np.arange(n)
    ps, cs = [], []
    # a first sweep takes whole large sets with one row of products each; a hub that has few hits costs one row and another is tried
    rng, strays = np.random.default_rng(SEED + 2), 0
    while len(todo) >= 512 and strays < STRAYS:
        hub = todo[rng.integers(len(todo))]
        hit = todo[x[todo] @ x[hub] >= least]
        if len(hit) < 64:
            strays += 1
            continue
        # whatever else the set links to in this cell
        rest = np.setdiff1d(todo, hit, assume_unique=True)
        front = hit
        ps.append(np.full(len(hit) - 1, hub))
        cs.append(hit[hit != hub])
        while len(front) and len(rest):
            found = np.full(len(rest), -1)
            for at in range(0, len(front), BLOCK):
                part = front[at : at + BLOCK]
                near = x[part] @ x[rest].T >= least
                any_ = near.any(axis=0)
                found[any_] = part[near[:, any_].argmax(axis=0)]
            new = found >= 0
            ps.append(found[new])
            cs.append(rest[new])
            front, rest = rest[new], rest[~new]
        todo = rest
    root = np.arange(n)
    for at in range(0, len(todo), BLOCK):
        part, others = todo[at : at + BLOCK], todo[at:]
        near = x[part] @ x[others].T >= least
        step = max(1, PAIRS // len(others))
        for i in range(0, len(part), step):
            # pairs of rows that aren't joined yet; those of one step are at most PAIRS, or one row's
            a, b = np.nonzero(near[i : i + step] & (root[part[i : i + step]][:, None] != root[others][None, :]))
            if len(a):
                p, c, root = _join(part[i + a], others[b], root)
                ps.append(p)
                cs.append(c)
    return tuple(np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for v in (ps, cs))


def _join(p: np.ndarray, c: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of these pairs as many as join sets, and the roots after: each set that has a pair with a set of a lower root takes one."""
    ps, cs = [], []
    while True:
        low, high = np.minimum(root[p], root[c]), np.maximum(root[p], root[c])
        if not (apart := low != high).any():
            return np.concatenate(ps), np.concatenate(cs), root
        p, c, low, high = p[apart], c[apart], low[apart], high[apart]
        high, first = np.unique(high, return_index=True)
        ps.append(p[first])
        cs.append(c[first])
        to = np.arange(len(root))
        to[high] = low[first]
        while not np.array_equal(to[to], to):
            to = to[to]
        root = to[root]


#: A row within this cosine distance of a chosen one adds no variety, so no reserved place but its group's first is spent on it.
NEAR = 0.14


def farthest_first(x: np.ndarray, size: int, reserve: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``size`` rows chosen farthest first: (rows in the order of choice, cosine distance to the nearest one chosen before).

    First the reserved places go to their groups: the first of each group always, the others as long as the group has a row that isn't
    near a chosen one; then the farthest row of all is taken. The first row is the one least similar to the mean; ties go to the smaller row.
    """
    n = len(x)
    total = min(n, int(size))
    out, dist = np.empty(total, np.int64), np.empty(total)
    if not total:
        return out, dist
    left = np.minimum(reserve, np.bincount(group, minlength=len(reserve)))
    cover = 1 - x @ x.mean(axis=0)
    free = np.ones(n, bool)
    held = left[group] > 0
    bare = left > 0  # groups whose first place is open
    for i in range(total):
        j = -1
        if held.any():
            j = int(np.argmax(np.where(held, cover, -2)))
            if i and cover[j] <= NEAR:
                held &= bare[group]
                j = int(np.argmax(np.where(held, cover, -2))) if held.any() else -1
        if j < 0:
            j = int(np.argmax(np.where(free, cover, -2)))
        out[i], dist[i] = j, cover[j]
        gone = 1 - x @ x[j]
        cover = gone if i == 0 else np.minimum(cover, gone)
        free[j] = held[j] = bare[group[j]] = False
        left[group[j]] -= 1
        if left[group[j]] == 0:
            held &= group != group[j]
    return out, dist
