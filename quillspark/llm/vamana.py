"""A robust-pruned directed graph over the vectors of one shard, in numpy.

Largest inner product becomes nearest distance by one more component that
brings all vectors to the same length; a query has zero there. Points are
inserted in batches that at most double the graph. A greedy beam search from
the nearest of SEEDS fixed points proposes a batch's neighbours, the nearest
of its own batch come besides, and robust pruning keeps a candidate c only if
no kept, nearer one p fulfils alpha * d(p, c) <= d(point, c): so edges point
in different directions, and alpha > 1 keeps some long ones. Kept edges are
entered backwards too, and a point with too many is pruned in the same way.
All steps work on whole batches.
"""

from __future__ import annotations

import numpy as np

DEGREE, BEAM, ALPHA = 32, 64, 1.2
SEEDS, BATCH, NEAR_IN_BATCH, WIDTH = 128, 1024, 8, 3
#: Queries that walk the graph together.
TOGETHER = 1024


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Float32 rows of equal length whose inner products with (query, 0) are
    those of the vectors."""
    x = vectors.astype(np.float64)
    norms = (x * x).sum(1)
    last = np.sqrt(np.maximum(norms.max() - norms, 0)) if len(x) else norms
    return np.concatenate([x, last[:, None]], axis=1).astype(np.float32)


def walk(x: np.ndarray, edges: np.ndarray, seeds: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, likeness) of the best `beam` nodes that a greedy beam search
    finds for each query, best first; -1 where there are fewer."""
    found = [_walk(x, edges, seeds, queries[i : i + TOGETHER], beam) for i in range(0, len(queries), TOGETHER)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _walk(x: np.ndarray, edges: np.ndarray, seeds: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(queries)
    like = queries @ x[seeds].T
    # a small graph is looked at whole, so that no node is missed for want of a path
    first = np.argsort(-like, axis=1, kind="stable")[:, : beam if len(x) <= min(beam, len(seeds)) else 8]
    ids, likes = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32)
    ids[:, : first.shape[1]], likes[:, : first.shape[1]] = seeds[first], np.take_along_axis(like, first, 1)
    done = ids < 0
    live = np.arange(n)
    while len(live):
        own_ids, own_likes, own_done = ids[live], likes[live], done[live]
        # the best nodes that were not opened yet come first in a stable order of the flags
        pick = np.argsort(own_done, axis=1, kind="stable")[:, :WIDTH]
        closed = np.take_along_axis(own_done, pick, 1)
        at = np.where(closed, -1, np.take_along_axis(own_ids, pick, 1))
        np.put_along_axis(own_done, pick, True, 1)
        new = np.where(at[:, :, None] >= 0, edges[at], -1).reshape(len(live), -1)
        all_ids = np.concatenate([own_ids, new], axis=1)
        order = np.argsort(all_ids, axis=1, kind="stable")
        placed = np.take_along_axis(all_ids, order, 1)
        again = np.zeros(placed.shape, bool)
        again[:, 1:] = placed[:, 1:] == placed[:, :-1]
        drop = np.zeros(placed.shape, bool)
        np.put_along_axis(drop, order, again, 1)
        new = np.where(drop[:, beam:], -1, new)
        row, col = np.nonzero(new >= 0)
        new_likes = np.full(new.shape, -np.inf, np.float32)
        new_likes[row, col] = np.einsum("ij,ij->i", x[new[row, col]], queries[live[row]])
        all_ids[:, beam:] = new
        all_likes = np.concatenate([own_likes, new_likes], axis=1)
        all_done = np.concatenate([own_done, new < 0], axis=1)
        best = np.argsort(-all_likes, axis=1, kind="stable")[:, :beam]
        ids[live], likes[live], done[live] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_likes, all_done))
        live = live[~done[live].all(1)]
    return ids, likes


def pruned(x: np.ndarray, likes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each row's candidates (-1: none), whose likeness to
    the row's point is given; -1 fills up."""
    order = np.argsort(np.where(candidates < 0, np.inf, -likes), axis=1, kind="stable")
    candidates, likes = np.take_along_axis(candidates, order, 1), np.take_along_axis(likes, order, 1)
    live = candidates >= 0
    live[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    v = x[candidates]
    twice = 2 * float(np.einsum("i,i->", x[0], x[0]))
    between = twice - 2 * (v @ v.transpose(0, 2, 1))
    to_point = twice - 2 * likes
    out, rows = np.full((len(candidates), degree), -1, np.int64), np.arange(len(candidates))
    for r in range(degree):
        first = live.argmax(1)
        some = live[rows, first]
        if not some.any():
            break
        out[some, r] = candidates[some, first[some]]
        live &= alpha * alpha * between[rows, first] > to_point
        live[rows, first] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lifted vectors, edges, seeds); edges is -1 where a point has fewer."""
    x, n = lifted(vectors), len(vectors)
    order = np.random.default_rng(11).permutation(n)
    edges = np.full((n, degree), -1, np.int64)
    seeds = order[:SEEDS]
    at = 0
    while at < n:
        batch = order[at : at + min(max(at, 2 * SEEDS), BATCH)]
        likes = x[batch] @ x[batch].T
        np.fill_diagonal(likes, -np.inf)
        near = np.argsort(-likes, axis=1, kind="stable")[:, : beam if at == 0 else NEAR_IN_BATCH]
        candidates, near_likes = batch[near], np.take_along_axis(likes, near, 1)
        candidates = np.where(np.isfinite(near_likes), candidates, -1)
        if at:
            found, found_likes = walk(x, edges, seeds, x[batch], beam)
            candidates, near_likes = np.concatenate([found, candidates], 1), np.concatenate([found_likes, near_likes], 1)
        edges[batch] = in_blocks(x, near_likes, candidates, degree, alpha)
        backwards(x, edges, batch, degree, alpha)
        at += len(batch)
    return x, edges, seeds


def in_blocks(x: np.ndarray, likes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float, block: int = 256) -> np.ndarray:
    return np.concatenate([pruned(x, likes[i : i + block], candidates[i : i + block], degree, alpha) for i in range(0, len(candidates), block)])


def backwards(x: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Enter the batch's edges at their other ends."""
    source = np.repeat(batch, degree)
    target = edges[batch].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    like = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-like, target))
    source, target = source[order], target[order]
    points, first = np.unique(target, return_index=True)
    place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    take = place < 2 * degree  # of very many, the nearest
    added = np.full((len(points), int(place[take].max(initial=0)) + 1), -1, np.int64)
    added[np.searchsorted(points, target[take]), place[take]] = source[take]
    both = np.concatenate([edges[points], added], axis=1)
    # an edge that is there already is not entered again
    ordered = np.argsort(both, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(both, ordered, 1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    drop = np.zeros(both.shape, bool)
    np.put_along_axis(drop, ordered, again, 1)
    both[drop] = -1
    fits = (both >= 0).sum(1) <= degree
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    edges[points[fits]] = packed[fits][:, :degree]
    if not fits.all():
        full, point = both[~fits], points[~fits]
        likes = np.concatenate([np.einsum("ijk,ik->ij", x[full[i : i + 256]], x[point[i : i + 256]]) for i in range(0, len(full), 256)])
        edges[point] = in_blocks(x, likes, full, degree, alpha)
