"""A hierarchical navigable small-world graph in NumPy: many vectors are searched in step.

Layers are built from the top: a layer holds the vectors of its level and above, and is entered through
the layer over it. Vectors are inserted in growing batches; a batch is searched in what is there, compared with
itself, and linked by the diversity rule (a neighbour is taken if it is nearer to the vector than to the
neighbours taken before).
"""

from __future__ import annotations

import numpy as np

M = 16  # links of a vector in an upper layer; twice as many in the lowest
WIDE = 4  # candidates expanded in one step
START = 8  # entry points handed to the next layer


def levels(ids: np.ndarray) -> np.ndarray:
    """Geometric levels from a hash of the ids: the same in every run."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    u = (x >> np.uint64(11)).astype(np.float64) / 2**53
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(M)).astype(int)


def _diverse(vectors: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Rows of candidates (-1: none) by falling similarity -> at most `most` of each by the diversity rule, then the nearest."""
    order = np.argsort(-sims, axis=1)
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    v = vectors[np.maximum(cand, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    taken = np.zeros(cand.shape, bool)
    worst = np.full(cand.shape, -np.inf, np.float32)  # similarity of each candidate to the nearest one taken
    for j in range(cand.shape[1]):
        ok = (cand[:, j] >= 0) & (sims[:, j] > worst[:, j]) & (taken.sum(1) < most)
        taken[:, j] = ok
        worst = np.where(ok[:, None], np.maximum(worst, between[:, :, j]), worst)
    # Fill up with the nearest of the rest.
    rank = np.where(taken, 0, 1) * cand.shape[1] + np.arange(cand.shape[1])
    rank = np.where(cand < 0, 10**6, rank)
    pick = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(cand, pick, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest that a best-first walk finds: (ids, similarities), -1 and -inf where fewer."""
    k = len(queries)
    rows = np.arange(k)[:, None]
    seen = np.zeros((k, len(vectors) + 1), bool)
    ids = np.full((k, ef), -1)
    width = min(ef, entry.shape[1])
    ids[:, :width] = entry[:, :width]
    seen[rows, ids] = True
    sims = np.where(ids >= 0, np.einsum("kd,kmd->km", queries, vectors[np.maximum(ids, 0)]), -np.inf).astype(np.float32)
    done = ids < 0
    act = np.arange(k)
    while len(act):
        open_ = np.where(done[act], -np.inf, sims[act])
        w = min(WIDE, ef)
        best = np.argpartition(-open_, w - 1, axis=1)[:, :w]
        live = np.take_along_axis(open_, best, 1) > -np.inf
        keep = live.any(1)
        act, best, live = act[keep], best[keep], live[keep]
        if not len(act):
            break
        r = act[:, None]
        done[r, best] = True
        near = links[np.where(live, ids[r, best], 0)]
        near = np.where(live[:, :, None], near, -1).reshape(len(act), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[r, near]] = -1
        seen[r, near] = True
        s = np.einsum("kd,kmd->km", queries[act], vectors[np.maximum(near, 0)])
        s = np.where(near >= 0, s, -np.inf)
        all_ids, all_sims = np.concatenate([ids[act], near], 1), np.concatenate([sims[act], s], 1)
        all_done = np.concatenate([done[act], near < 0], 1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[act], sims[act], done[act] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
        ids[act] = np.where(sims[act] == -np.inf, -1, ids[act])
        done[act] |= ids[act] < 0
    return ids, sims


class Hnsw:
    def __init__(self, vectors: np.ndarray, level: np.ndarray, build_ef: int = 48):
        """vectors: unit rows."""
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # (nodes, links by place in nodes), top first
        for lv in range(int(level.max()) if len(level) else 0, -1, -1):
            nodes = np.nonzero(level >= lv)[0]
            self.layers.append((nodes, self._build(nodes, 2 * M if lv == 0 else M, build_ef)))

    def _build(self, nodes: np.ndarray, most: int, ef: int) -> np.ndarray:
        v = self.vectors[nodes]
        links = np.full((len(nodes), most), -1)
        # Those of the upper layer first: they are where walks enter.
        upper = np.isin(nodes, self.layers[-1][0]) if self.layers else np.zeros(len(nodes), bool)
        order = np.concatenate([np.nonzero(upper)[0], np.nonzero(~upper)[0]])
        at = 0
        while at < len(order):
            batch = order[at : at + max(64, min(512, at))]
            own = v[batch] @ v[batch].T
            np.fill_diagonal(own, -np.inf)
            w = min(most, len(batch) - 1)
            cand = np.full((len(batch), 0), -1)
            sims = np.zeros((len(batch), 0), np.float32)
            if w > 0:
                top = np.argpartition(-own, w - 1, axis=1)[:, :w]
                cand, sims = batch[top], np.take_along_axis(own, top, 1)
            if at:
                entry = self._entry(self.vectors[nodes[batch]], nodes, order[:at])
                ids, s = beam(v, links, v[batch], entry, ef)
                cand, sims = np.concatenate([cand, ids], 1), np.concatenate([sims, s], 1)
            if cand.shape[1]:
                links[batch] = chosen = _diverse(v, cand, np.where(cand >= 0, sims, -np.inf), most)
                self._back(v, links, batch, chosen, most)
            at += len(batch)
        return links

    def _entry(self, queries: np.ndarray, nodes: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Entry points as places in nodes."""
        if self.layers:
            found = self._down(queries, len(self.layers), START)
            place = np.searchsorted(nodes, np.maximum(found, 0))
            ok = np.isin(place, present) & (found >= 0)
            entry = np.where(ok, place, -1)
            entry[~ok.any(1), 0] = present[0]
            return entry
        return np.tile(present[: 4 * START], (len(queries), 1))

    @staticmethod
    def _back(v: np.ndarray, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray, most: int) -> None:
        """Reverse links; a full list is chosen anew from its old and at most `most` nearest new ones."""
        src, dst = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sims = np.einsum("kd,kd->k", v[src], v[dst])
        order = np.lexsort((-sims, dst))
        src, dst = src[order], dst[order]
        first = np.concatenate([[True], dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, bool)
        rank = np.arange(len(dst)) - np.maximum.accumulate(np.where(first, np.arange(len(dst)), 0))
        src, dst, rank = src[rank < most], dst[rank < most], rank[rank < most]
        targets, place = np.unique(dst, return_inverse=True)
        if not len(targets):
            return
        new = np.full((len(targets), most), -1)
        new[place, rank] = src
        for a in range(0, len(targets), 2048):
            t = targets[a : a + 2048]
            cand = np.concatenate([links[t], new[a : a + 2048]], 1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            s = np.einsum("kd,kmd->km", v[t], v[np.maximum(cand, 0)])
            links[t] = _diverse(v, cand, np.where(cand >= 0, s, -np.inf), most)

    def _down(self, queries: np.ndarray, n_layers: int, ef: int) -> np.ndarray:
        """The nearest found in the first n_layers layers, as ids; the last with ef."""
        found = None
        for i, (nodes, links) in enumerate(self.layers[:n_layers]):
            v = self.vectors[nodes]
            if found is None:
                entry = np.tile(np.arange(min(len(nodes), 4 * START)), (len(queries), 1))
            else:
                entry = np.where(found >= 0, np.searchsorted(nodes, np.maximum(found, 0)), -1)
            ids, sims = beam(v, links, queries, entry, ef if i == n_layers - 1 else max(START, 2 * START))
            best = np.argsort(-sims, axis=1)
            ids = np.take_along_axis(ids, best, 1)
            found = np.where(ids >= 0, nodes[np.maximum(ids, 0)], -1)
            if i < n_layers - 1:
                found = found[:, :START]
        return found

    def within(self, queries: np.ndarray, least: float, ef: int) -> np.ndarray:
        """Boolean (queries, vectors): what a beam of ef finds at a similarity of at least `least`, and what the
        links of those reach at that similarity."""
        out = np.zeros((len(queries), len(self.vectors)), bool)
        q = np.ascontiguousarray(queries, np.float32)
        links = self.layers[-1][1]  # the lowest layer holds every vector, in order
        for a in range(0, len(q), 512):
            ids = self._down(q[a : a + 512], len(self.layers), ef)
            sims = np.einsum("kd,kmd->km", q[a : a + 512], self.vectors[np.maximum(ids, 0)])
            r, c = np.nonzero((ids >= 0) & (sims >= least))
            r, c = r + a, ids[r, c]
            out[r, c] = True
            while len(r):
                step_r, step_c = [], []
                for b in range(0, len(r), 8192):
                    nb = links[c[b : b + 8192]]
                    rr = np.repeat(r[b : b + 8192], nb.shape[1])
                    nb = nb.ravel()
                    new = (nb >= 0) & ~out[rr, nb]
                    rr, nb = rr[new], nb[new]
                    ok = np.einsum("kd,kd->k", q[rr], self.vectors[nb]) >= least
                    rr, nb = rr[ok], nb[ok]
                    fresh = np.unique(rr.astype(np.int64) * len(self.vectors) + nb)
                    rr, nb = fresh // len(self.vectors), fresh % len(self.vectors)
                    out[rr, nb] = True
                    step_r.append(rr)
                    step_c.append(nb)
                r, c = np.concatenate(step_r), np.concatenate(step_c)
        return out
