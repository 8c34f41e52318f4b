"""A hierarchical navigable small-world graph over unit vectors, searched for many queries in lockstep.

Layer l holds the nodes whose level (drawn from a hash of the position) is l or more; a layer's
links are chosen for diversity, so that tight clusters keep ways out. Layers are built from the top:
their nodes are inserted in batches, which search what stands so far, see each other directly and
are linked back. All steps are numpy over a batch of queries.
"""

import numpy as np

from wardflow.llm.shingles import mix

M, WIDE = 16, 32  # links per node above and in the lowest layer


class Graph:
    def __init__(self, vectors, links=None, levels=None):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        if levels is None:
            u = (mix(np.arange(n, dtype=np.uint64) + np.uint64(12345)) >> np.uint64(11)).astype(float) / 2.0 ** 53
            levels = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(M)).astype(np.int64), 6)
        self.levels = levels
        self.tops = int(levels.max()) if n else 0
        self.order = np.argsort(-levels, kind="stable")  # nodes of upper layers first
        self.entry = int(self.order[0]) if n else -1
        self.links = links or []
        if not links and n:
            self.links = [np.full((n, WIDE if l == 0 else M), -1, np.int32) for l in range(self.tops + 1)]
            for l in range(self.tops, -1, -1):
                self._layer(l)

    # -- search

    def search(self, q, ef, lowest=0):
        """(ids, similarities) of a beam of `ef` per query, best first; -1 where there are fewer."""
        q = np.ascontiguousarray(q, np.float32)
        at = np.full(len(q), self.entry)
        best = q @ self.x[self.entry]
        for l in range(self.tops, lowest, -1):
            active = np.arange(len(q))
            while len(active):
                near = self.links[l][at[active]]
                sim = np.einsum("bmd,bd->bm", self.x[near], q[active], optimize=False)
                sim[near < 0] = -2
                j = sim.argmax(1)
                got = sim[np.arange(len(active)), j]
                better = got > best[active]
                active, j, got, near = active[better], j[better], got[better], near[better]
                at[active], best[active] = near[np.arange(len(active)), j], got
        return self._beam(q, at, best, ef, lowest)

    def _beam(self, q, at, best, ef, layer, step=4):
        b, links = len(q), self.links[layer]
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -2, np.float32)
        done = np.ones((b, ef), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = at, best, False
        seen = np.zeros((b, len(self.x)), bool)
        seen[np.arange(b), at] = True
        active = np.arange(b)
        k = min(step, ef)
        while True:
            open_ = np.where(done[active], -3, sims[active])
            active_ok = (open_ > -3).any(1)
            active, open_ = active[active_ok], open_[active_ok]
            if not len(active):
                break
            pick = np.argpartition(-open_, k - 1, 1)[:, :k]
            fresh = np.take_along_axis(open_, pick, 1) > -3
            done[active[:, None], pick] = True
            node = np.where(fresh, ids[active[:, None], pick], -1)
            near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(active), -1)
            ok = (near >= 0) & ~seen[active[:, None], near]
            rows, cols = np.nonzero(ok)
            if not len(rows):
                continue
            found = near[rows, cols]
            key = rows.astype(np.int64) * len(self.x) + found
            key = np.unique(key)
            rows, found = key // len(self.x), key % len(self.x)
            seen[active[rows], found] = True
            sim = np.einsum("nd,nd->n", self.x[found], q[active[rows]], optimize=False)
            first = np.searchsorted(rows, np.arange(len(active)))
            width = int(np.bincount(rows, minlength=len(active)).max())
            new_ids = np.full((len(active), width), -1, np.int64)
            new_sims = np.full((len(active), width), -2, np.float32)
            place = np.arange(len(rows)) - first[rows]
            new_ids[rows, place], new_sims[rows, place] = found, sim
            all_ids = np.concatenate((ids[active], new_ids), 1)
            all_sims = np.concatenate((sims[active], new_sims), 1)
            all_done = np.concatenate((done[active], new_ids < 0), 1)
            keep = np.argpartition(-all_sims, ef - 1, 1)[:, :ef]
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            done[active] = np.take_along_axis(all_done, keep, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    # -- building

    def _choose(self, x, ids, sims, most):
        """Diverse links among candidates (best first): closer to the node than to any link chosen."""
        b, c = ids.shape
        near = self.x[ids]
        between = np.einsum("bid,bjd->bij", near, near, optimize=True)
        chosen = np.zeros((b, c), bool)
        count = np.zeros(b, np.int64)
        for j in range(c):
            clash = (chosen[:, :j] & (between[:, j, :j] > sims[:, j:j + 1])).any(1) if j else np.zeros(b, bool)
            take = (ids[:, j] >= 0) & ~clash & (count < most)
            chosen[:, j] = take
            count += take
        # The rest of the places go to the nearest that were passed over.
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
        pick = np.argsort(rank, 1)[:, :most]
        out = np.take_along_axis(np.where(ids >= 0, ids, -1), pick, 1).astype(np.int32)
        if out.shape[1] < most:
            out = np.concatenate((out, np.full((b, most - out.shape[1]), -1, np.int32)), 1)
        return out

    def _layer(self, l, beam=64, batch=512):
        links, most = self.links[l], self.links[l].shape[1]
        nodes = self.order[:int((self.levels >= l).sum())]
        inserted = 0
        while inserted < len(nodes):
            new = nodes[inserted:inserted + (256 if inserted == 0 else min(batch, inserted))]
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -2)
            k = min(32, len(new) - 1)
            ids = np.zeros((len(new), 0), np.int64)
            sims = np.zeros((len(new), 0), np.float32)
            if k > 0:
                part = np.argpartition(-own, k - 1, 1)[:, :k]
                ids, sims = new[part], np.take_along_axis(own, part, 1)
            if inserted:
                a, s = self.search(self.x[new], beam, l)
                ids, sims = np.concatenate((ids, a), 1), np.concatenate((sims, s), 1)
            if ids.shape[1]:
                order = np.argsort(-sims, 1, kind="stable")[:, :beam]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
                few = most // 2 if l == 0 else most
                links[new, :few] = self._choose(self.x[new], ids, sims, few)
                self._back(l, new)
            inserted += len(new)

    def _back(self, l, new):
        """Links from the neighbours of new nodes back to them, pruned where there are too many."""
        links, most = self.links[l], self.links[l].shape[1]
        source = np.repeat(new, most)
        target = links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 1024):
            part = nodes[a:a + 1024]
            width = int(count[a:a + 1024].max())
            extra = np.full((len(part), width), -1, np.int64)
            for c in range(width):
                has = count[a:a + 1024] > c
                extra[has, c] = source[first[a:a + 1024][has] + c]
            ids = np.concatenate((links[part].astype(np.int64), extra), 1)
            ids.sort(1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("bmd,bd->bm", self.x[ids], self.x[part], optimize=False)
            sims[ids < 0] = -2
            order = np.argsort(-sims, 1, kind="stable")[:, :most + 32]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            full = (ids >= 0).sum(1) > most
            links[part[~full]] = np.where(ids[~full][:, :most] >= 0, ids[~full][:, :most], -1)
            if full.any():
                links[part[full]] = self._choose(self.x[part[full]], ids[full], sims[full], most)
