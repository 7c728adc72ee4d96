"""A navigable small-world graph over the vectors of one shard, as flat neighbour arrays.

Vectors are inserted in random order, in batches that are small against what
stands already: a batch searches the graph so far with a construction beam,
links to the diverse ones of what it finds, and those link back. All steps are
array work over a whole batch; nothing loops over single vectors, and no step
compares all vectors of a shard with all others.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512


def _diverse(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates those closer to it than to any kept one; -1 where there are fewer than most."""
    out = np.full((len(nodes), most), -1, np.int32)
    for i in range(0, len(nodes), BLOCK):
        own, c = nodes[i : i + BLOCK], cand[i : i + BLOCK]
        v = x[c]
        v -= x[own][:, None, :]
        sq = np.einsum("ijk,ijk->ij", v, v)
        order = np.argsort(sq, axis=1)
        c, sq = np.take_along_axis(c, order, 1), np.take_along_axis(sq, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = sq[:, :, None] + sq[:, None, :] - 2.0 * np.matmul(v, v.transpose(0, 2, 1))
        closer = between < sq[:, :, None]
        repeated = np.zeros(c.shape, bool)
        for j in range(1, c.shape[1]):
            repeated[:, j] = (c[:, :j] == c[:, j : j + 1]).any(1)
        usable = (c != own[:, None]) & ~repeated
        kept = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            kept[:, j] = usable[:, j] & ~(kept[:, :j] & closer[:, j, :j]).any(1)
        # places that stay free go to the nearest of the rest
        rank = np.where(kept, 0, np.where(usable, 1, 2)) * c.shape[1] + np.arange(c.shape[1])
        first = np.argsort(rank, axis=1)[:, :most]
        chosen = np.where(np.take_along_axis(usable, first, 1), np.take_along_axis(c, first, 1), -1)
        out[i : i + BLOCK, : chosen.shape[1]] = chosen
    return out


def _link_back(x: np.ndarray, links: np.ndarray, src: np.ndarray, chosen: np.ndarray, most: int) -> None:
    """Add the reverse of new links (src to each of its chosen); full lists keep the diverse ones of old and new."""
    dst = chosen.ravel()
    ok = dst >= 0
    a, b = dst[ok].astype(np.int64), np.repeat(src, chosen.shape[1])[ok]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    count = np.diff(np.r_[begin, len(a)])
    nodes = a[begin]
    have = (links[nodes] >= 0).sum(1)
    slot = np.arange(len(a)) - np.repeat(begin, count) + np.repeat(have, count)
    wide = np.full((len(nodes), links.shape[1] + int(count.max(initial=0))), -1, np.int32)
    wide[:, : links.shape[1]] = links[nodes]
    wide[np.repeat(np.arange(len(nodes)), count), slot] = b
    over = have + count > links.shape[1]
    links[nodes[~over]] = wide[~over, : links.shape[1]]
    if over.any():
        # empty places point at the node itself, which is never linked
        own = nodes[over]
        cand = np.where(wide[over] < 0, own[:, None], wide[over])
        kept = _diverse(x, own, cand, most)
        links[own] = -1
        links[own, : kept.shape[1]] = kept


class Graph:
    """levels: neighbour arrays, level 0 first; top: nodes of the highest level, where searches enter."""

    def __init__(self, x: np.ndarray, links: int = 16, build: int = 16, seed: int = 7):
        """links: most links of a node above level 0, where it has twice as many; build: width of the construction beam."""
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(self.x)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        rng = np.random.default_rng(seed)
        height = np.minimum(np.floor(-np.log(1.0 - rng.random(n)) / np.log(links)), 6).astype(int) if n else np.empty(0, int)
        # a level needs enough nodes to be worth a search; the lower levels hold all nodes of the higher ones
        depth = 1
        while (height >= depth).sum() >= 2 * links:
            depth += 1
        height = np.minimum(height, depth - 1)
        self.levels = [np.full((n, links * (1 if level else 2)), -1, np.int32) for level in range(depth)]
        # the highest nodes come first, so that every search enters where the levels are complete
        order = np.lexsort((rng.random(n), -height))
        tops = int((height == depth - 1).sum())
        self.top = order[:tops].astype(np.int64)
        done = 0
        while done < n:
            # a batch of the first level's size at the most, or an eighth of what stands
            batch = order[done : done + min(max(2 * links, done // 8), max(16, 2**24 // n))]
            self._insert(batch, height[batch], build, links)
            done += len(batch)

    def _insert(self, batch: np.ndarray, height: np.ndarray, build: int, links: int) -> None:
        q = self.x[batch]
        enter = self._enter(q)
        for level in range(len(self.levels) - 1, -1, -1):
            own = height >= level
            ids, _ = self._beam(q, enter, level, build if level == 0 or own.any() else 8, 4)
            enter = ids[:, :8]
            if own.any():
                most = self.levels[level].shape[1] * 3 // 4
                # a batch's own members can't be found yet: its nearest ones are candidates as well
                mates = self._mates(batch[own])
                cand = np.hstack([ids[own], mates])
                cand = np.where(cand < 0, batch[own][:, None], cand)
                chosen = _diverse(self.x, batch[own], cand, most)
                self.levels[level][batch[own], :] = -1
                self.levels[level][batch[own][:, None], np.arange(chosen.shape[1])] = chosen
                _link_back(self.x, self.levels[level], batch[own], chosen, most)

    def _mates(self, nodes: np.ndarray, want: int = 6, block: int = 256) -> np.ndarray:
        """Nearest other members of a batch, looked for among at most ``block`` of them at a time."""
        out = np.full((len(nodes), want), -1, np.int32)
        # sorted along one direction first, so that near ones fall into one block
        order = nodes[np.argsort(self.x[nodes] @ self.x[nodes[0]])] if len(nodes) > block else nodes
        place = np.empty(len(self.x), np.int64)
        place[nodes] = np.arange(len(nodes))
        for i in range(0, len(order), block):
            part = order[i : i + block]
            d = self.norms[part] - 2.0 * (self.x[part] @ self.x[part].T)
            np.fill_diagonal(d, np.inf)
            k = min(want, len(part) - 1)
            if k > 0:
                out[place[part], :k] = part[np.argpartition(d, k - 1, axis=1)[:, :k]]
        return out

    def _enter(self, q: np.ndarray, want: int = 8) -> np.ndarray:
        """The nearest nodes of the highest level."""
        want = min(want, len(self.top))
        d = self.norms[self.top] - 2.0 * (q @ self.x[self.top].T)
        return self.top[np.argpartition(d, want - 1, axis=1)[:, :want]]

    def search(self, q: np.ndarray, k: int, width: int = 64, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the k nearest nodes of each query; -1 and inf where there are fewer."""
        ids, dists = [], []
        # a block's marks of what it has seen take at most 64 MB
        block = max(16, min(256, 2**24 // max(len(self.x), 1)))
        for i in range(0, len(q), block):
            part = np.ascontiguousarray(q[i : i + block], np.float32)
            near = self._enter(part)
            for level in range(len(self.levels) - 1, -1, -1):
                near, far = self._beam(part, near, level, max(width, k) if level == 0 else 12, expand)
            keep = min(k, near.shape[1])
            ids.append(near[:, :keep])
            dists.append(far[:, :keep] + np.einsum("ij,ij->i", part, part)[:, None])
        if not ids:
            return np.empty((0, k), np.int32), np.empty((0, k), np.float32)
        return np.concatenate(ids), np.concatenate(dists)

    def _beam(self, q: np.ndarray, enter: np.ndarray, level: int, width: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step; distances lack the query's own norm."""
        links, rows = self.levels[level], np.arange(len(q))
        seen = np.zeros((len(q), len(self.x)), np.int32)
        width = min(width, len(self.x))
        ids = np.full((len(q), width), -1, np.int32)
        best = np.full((len(q), width), np.inf, np.float32)
        open_ = np.zeros((len(q), width), bool)

        def add(at: np.ndarray, new: np.ndarray) -> None:
            """Put the new nodes (rows at, -1 for none) into the beams."""
            wide = new.shape[1]
            flat = new.ravel()
            slot = np.flatnonzero(flat >= 0)
            r, f = at[slot // wide], flat[slot]
            fresh = seen[r, f] == 0
            slot, r, f = slot[fresh], r[fresh], f[fresh]
            # a node may be reached twice in one step: the mark left last counts
            seen[r, f] = slot + 1
            last = seen[r, f] == slot + 1
            slot, r, f = slot[last], r[last], f[last]
            d = np.full(flat.shape, np.inf, np.float32)
            d[slot] = self.norms[f] - 2.0 * np.einsum("ij,ij->i", self.x[f], q[r])
            d = d.reshape(new.shape)
            worst = best[at].max(1, keepdims=True)
            d[d >= worst] = np.inf
            # beams that nothing new can enter stay as they are
            some = np.flatnonzero(np.isfinite(d).any(1))
            at, new, d = at[some], new[some], d[some]
            all_d, all_i = np.hstack([best[at], d]), np.hstack([ids[at], new])
            all_o = np.hstack([open_[at], np.isfinite(d)])
            keep = np.argpartition(all_d, width - 1, axis=1)[:, :width] if all_d.shape[1] > width else np.arange(all_d.shape[1])[None].repeat(len(at), 0)
            best[at], ids[at], open_[at] = (np.take_along_axis(a, keep, 1) for a in (all_d, all_i, all_o))

        add(rows, enter.astype(np.int32))
        while len(rows):
            waiting = np.where(open_[rows], best[rows], np.inf)
            take = min(expand, width)
            next_ = np.argpartition(waiting, take - 1, axis=1)[:, :take] if take < width else np.arange(width)[None].repeat(len(rows), 0)
            usable = np.isfinite(np.take_along_axis(waiting, next_, 1))
            alive = usable.any(1)
            rows, next_, usable = rows[alive], next_[alive], usable[alive]
            if not len(rows):
                break
            nodes = np.where(usable, ids[rows[:, None], next_], -1)
            open_[rows[:, None], next_] = False
            new = links[np.maximum(nodes, 0)]
            new[nodes < 0] = -1
            add(rows, new.reshape(len(rows), -1))
        order = np.argsort(best, axis=1)
        ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
        return np.where(np.isfinite(best), ids, -1), best
