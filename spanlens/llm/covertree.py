"""Near-duplicate vectors by cover trees: exact pairs of cosine at least ``LEAST``, found by dual traversal.

On unit vectors, cosine c is the distance sqrt(2 - 2c). A tree's nodes are nested: a node's centre is one of its vectors and
the centre of its first child, its children cover it within the next lower power of two (halving radii), and levels go down
to single vectors; levels that would change nothing are left out. Node pairs are pruned when their covering radii put them
too far apart, and counted as a whole when these put all their pairs near enough; the children of two nodes are compared
at once. Where two nodes have at most ``BASE`` vectors each, these are compared rather than divided further.

The top of the tree, over a bounded sample (``SAMPLE``), deals all distinct vectors to cells: a vector goes down to the
lowest node that covers it. Radii of cells and of subtrees are measured over all vectors, so that bounds are exact, and a
vector visits the cells that it can't rule out on its way down. Cells next to each other in the tree share a shard of about
``SHARD`` vectors; a larger cell is several shards. In a shard the residents form a cover tree, and so does each block of
visitors, which are streamed past the residents. Of two shards, parity says which one visits, so that visits are dealt
evenly. Links are counted, and components are kept as stars, so that a dense group costs output by vector and not by pair.

What can't be pruned is compared: where most vectors are far from all others in many dimensions, as random ones are, no
covering radius is small, and the pairs of centres are nearly all pairs of vectors.

Memory doesn't grow with the table: cosines are computed ``BLOCK`` at a time, vectors are dealt ``SLICE`` at a time (or what
makes about ``ARROW_BYTES``) and leave in batches of about ``ARROW_BYTES``, and a sample or a shard has at most ``WIDE``
bytes as doubles, so that long vectors have smaller ones. Nor do its files outgrow it: where visits are many, shards are searched
in rounds whose visits, by a sample's, take about 1.5 times the table's bytes (``ROUND`` at least), and a shard's visitors are
parts of about ``PART``, each with the residents.

Cosines are dot products of unit vectors; within ``CLOSE`` of the threshold, dot product over the product of norms decides.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
their own component; so do vectors of different lengths with each other; components of any finite size count, since a
vector is divided by its largest component first; a cosine equal to the threshold links; rows of a repeated vec_id count as
vectors of their own; a null vec_id is counted but never names a component, unless it is alone (null); an empty table
gives an empty table. Only ``vec_id`` and ``embedding`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.components import components, stars
from spanlens.llm.shared import ARROW_BYTES, bound_arrow, drop_staged, lean_shuffles, new_path, stage

LEAST = 0.9
SAMPLE = 16_384
SHARD = 4096
WIDE = 16 << 20
BLOCK = 1 << 20
SLICE = 2048
PART = 32_768
VISITORS = 4096
ROUND = 128 << 20
BASE = 32
SLACK = 1e-6
CLOSE = 1e-12


def units(data: list[bytes], dims: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they are but for a factor that keeps squares finite, and unit vectors."""
    x = np.frombuffer(b"".join(data), dtype).reshape(-1, dims).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, the first row among them, that are over ``radius`` apart in each block and cover all rows; by row, the
    number of its centre and its cosine to it."""
    limit = 1 - radius * radius / 2
    owner, cosine = np.full(len(x), -1), np.ones(len(x))
    left, centres, n = np.arange(len(x)), [], 0
    while len(left):
        block = x[left[:256]]
        near = block @ block.T >= limit
        free, chosen = np.ones(len(block), bool), []
        for i in range(len(block)):
            if free[i]:
                chosen.append(i)
                free &= ~near[i]
        c = block[chosen] @ x[left].T
        best = c.argmax(axis=0)
        top = c[best, np.arange(len(left))]
        top[chosen], best[chosen] = 1.0, np.arange(len(chosen))
        on = top >= limit
        owner[left[on]], cosine[left[on]] = n + best[on], top[on]
        centres.append(left[:256][chosen])
        n += len(chosen)
        left = left[~on]
    return np.concatenate(centres), owner, cosine


class Tree:
    """A cover tree over the rows of ``x``. By node: ``center`` (a row), ``radius`` (to its farthest row), ``reach`` (within
    which its children cover it), its children ``first`` to ``last`` and its rows ``order[low:high]``; nodes are in the order
    of levels, and a node without children has one row, or rows that are all but equal."""

    def __init__(self, x: np.ndarray):
        self.x, self.thin = x, x.astype(np.float32)
        self.order = np.arange(len(x))
        center, radius, reach, first, last, low, high = ([] for _ in range(7))

        def node(c: int, r: float, a: int, b: int) -> None:
            center.append(c), radius.append(r), low.append(a), high.append(b)
            reach.append(0.0), first.append(0), last.append(0)

        if len(x):
            node(0, float(apart(x @ x[0]).max()), 0, len(x))
        at = 0
        while at < len(center):
            if high[at] - low[at] > 1 and radius[at] > SLACK:
                rows = self.order[low[at] : high[at]].copy()
                k = int(np.flatnonzero(rows == center[at])[0])  # the centre comes first: levels are nested
                rows[[0, k]] = rows[[k, 0]]
                reach[at] = 2.0 ** (np.ceil(np.log2(radius[at])) - 1)
                centres, owner, cosine = net(x[rows], reach[at])
                by = np.argsort(owner, kind="stable")
                edge = np.searchsorted(owner[by], np.arange(len(centres) + 1))
                far = np.maximum.reduceat(apart(cosine[by]), edge[:-1])
                self.order[low[at] : high[at]] = rows[by]
                first[at] = len(center)
                for i, c in enumerate(rows[centres].tolist()):
                    node(c, float(far[i]) if edge[i + 1] - edge[i] > 1 else 0.0, low[at] + int(edge[i]), low[at] + int(edge[i + 1]))
                last[at] = len(center)
            at += 1
        self.center, self.low, self.high, self.first, self.last = (np.array(v, np.int64) for v in (center, low, high, first, last))
        self.radius, self.reach = np.array(radius), np.array(reach)
        self.rows = self.high - self.low

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """Their children, or a node itself where it has none."""
        leaf = self.last[nodes] == 0
        a, n = np.where(leaf, nodes, self.first[nodes]), np.where(leaf, 1, self.last[nodes] - self.first[nodes])
        return np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)

    def within(self, nodes: np.ndarray) -> np.ndarray:
        """The rows of the nodes."""
        n = self.rows[nodes]
        return self.order[np.arange(int(n.sum())) + np.repeat(self.low[nodes] - (np.cumsum(n) - n), n)]

    def pushed(self, by_node: np.ndarray) -> np.ndarray:
        """Sums by row of what all nodes have that the row is in."""
        total = np.zeros(len(self.x) + 1, by_node.dtype)
        np.add.at(total, self.low, by_node)
        np.subtract.at(total, self.high, by_node)
        out = np.zeros(len(self.x), by_node.dtype)
        out[self.order] = np.cumsum(total[:-1])
        return out


def grouped(key: np.ndarray, value: np.ndarray) -> list[tuple[int, np.ndarray]]:
    by = np.argsort(key, kind="stable")
    one, first = np.unique(key[by], return_index=True)
    return list(zip(one.tolist(), np.split(value[by], first[1:]), strict=True)) if len(one) else []


class Links:
    """Weights linked to each row of two trees (or of one, ``other`` None), and stars of what is linked; rows of the second
    tree are numbered after those of the first. ``tested`` counts the cosines computed."""

    def __init__(self, tree: Tree, weight: np.ndarray, raw: np.ndarray, other: Tree | None, other_weight: np.ndarray, other_raw: np.ndarray, cos: float):
        self.same = other is None
        self.s, self.t = tree, tree if other is None else other
        self.raw, self.weight = (raw, other_raw), (weight, other_weight)
        self.cos, self.near = cos, float(np.sqrt(2 - 2 * cos))
        self.base = 0 if self.same else len(tree.x)
        self.whole = [np.concatenate([[0], np.cumsum(w[t.order])])[t.high] - np.concatenate([[0], np.cumsum(w[t.order])])[t.low] for t, w in ((self.s, weight), (self.t, other_weight))]
        self.of_node = [np.zeros(len(t.center), np.int64) for t in (self.s, self.t)]
        self.of_row = [np.zeros(len(t.x), np.int64) for t in (self.s, self.t)]
        self.itself = np.zeros(len(tree.center), np.int64)
        self.joined = [np.zeros(len(t.center), bool) for t in (self.s, self.t)]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.tested = 0

    def keep(self, i: np.ndarray, j: np.ndarray) -> None:
        self.edges.append((i, j))
        self.held += len(i)
        if self.held > 2_000_000:
            self.edges = [stars(np.concatenate([x for x, _ in self.edges]), np.concatenate([y for _, y in self.edges]))]
            self.held = len(self.edges[0][0])

    def linked(self, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows i and j, of cosines c, are linked."""
        hit = c >= self.cos
        close = np.flatnonzero(np.abs(c - self.cos) < CLOSE)
        if len(close):
            a, b = self.raw[0][i[close]], self.raw[1][j[close]]
            hit[close] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))) >= self.cos
        return hit

    def compare(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        """All rows i against all rows j; with ``own`` both are of the same rows, all j in each call, so that a pair is met from
        both sides. Single precision finds what may be near, double precision decides."""
        step = max(1, BLOCK // max(1, len(j)))
        for k in range(0, len(i) if len(j) else 0, step):
            part = i[k : k + step]
            near = self.s.thin[part] @ self.t.thin[j].T >= self.cos - 1e-6 - 2e-7 * self.s.x.shape[1]
            self.tested += near.size
            p, q = np.divmod(np.flatnonzero(near), len(j))
            if len(p) * 8 > near.size:
                c = (self.s.x[part] @ self.t.x[j].T)[p, q]
            else:
                c = np.concatenate([np.einsum("ij,ij->i", self.s.x[part[p[a : a + 8192]]], self.t.x[j[q[a : a + 8192]]]) for a in range(0, len(p), 8192)] or [np.empty(0)])
            p, q = part[p], j[q]
            on = self.linked(p, q, c)
            if own:
                on &= p != q
            p, q = p[on], q[on]
            if len(p):
                self.of_row[0] += np.bincount(p, self.weight[1][q], len(self.s.x)).astype(np.int64)
                if not own:
                    self.of_row[1] += np.bincount(q, self.weight[0][p], len(self.t.x)).astype(np.int64)
                self.keep(p, self.base + q)

    def run(self) -> Links:
        s, t = self.s, self.t
        root = np.zeros(1, np.int64)
        todo = [(root, root, self.same)] if len(s.center) and len(t.center) else []
        while todo:
            i, j, own = todo.pop()
            small, other = ((v.rows[k] <= BASE) | (v.last[k] == 0) for v, k in ((s, i), (t, j)))
            self.compare(s.within(i[small]), t.within(j[other]), own)
            self.children(s.below(i[small]), t.below(j[~other]), own, todo)
            self.children(s.below(i[~small]), t.below(j), own, todo)
        return self

    def children(self, i: np.ndarray, j: np.ndarray, own: bool, todo: list) -> None:
        """The nodes i against the nodes j; with ``own``, these are all children of one node, and a pair counts once."""
        s, t = self.s, self.t
        single, other = s.rows[i] == 1, t.rows[j] == 1
        self.compare(s.center[i[single]], t.center[j[other]], own)
        self.divide(i[~single], j, own, todo)
        if not own:  # otherwise these pairs are met above, from the other side
            self.divide(i[single], j[~other], False, todo)

    def divide(self, nodes: np.ndarray, j: np.ndarray, own: bool, todo: list) -> None:
        step = max(1, BLOCK // max(1, len(j)))
        for k in range(0, len(nodes) if len(j) else 0, step):
            i = nodes[k : k + step]
            p, q = self.open_pairs(i, j, own)
            if own:
                todo += [(i[x : x + 1], i[x : x + 1], True) for x in p[i[p] == j[q]]]
                p, q = p[i[p] != j[q]], q[i[p] != j[q]]
            if len(np.unique(p)) <= len(np.unique(q)):
                todo += [(i[x : x + 1], j[part], False) for x, part in grouped(p, q)]
            else:
                todo += [(i[part], j[x : x + 1], False) for x, part in grouped(q, p)]

    def open_pairs(self, i: np.ndarray, j: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """What is left to divide of the nodes i against the nodes j, by their places. With ``own``, of two nodes that both have
        several rows the pair counts once."""
        s, t = self.s, self.t
        d = apart(s.x[s.center[i]] @ t.x[t.center[j]].T)
        self.tested += d.size
        reach = s.radius[i][:, None] + t.radius[j][None, :]
        open_ = d <= reach + self.near + SLACK
        if own:
            open_ &= (i[:, None] <= j[None, :]) | (t.rows[j] == 1)[None, :]
        whole = open_ & (d + reach <= self.near - SLACK)
        if whole.any():
            diagonal = whole & (i[:, None] == j[None, :]) if own else np.zeros_like(whole)
            cross = whole & ~diagonal
            self.of_node[0][i] += cross @ self.whole[1][j]
            self.of_node[1][j] += self.whole[0][i] @ cross
            self.itself[i] += diagonal.any(axis=1)
            self.joined[0][i[whole.any(axis=1)]] = True
            self.joined[1][j[whole.any(axis=0)]] = True
            p, q = np.nonzero(cross)
            self.keep(s.center[i[p]], self.base + t.center[j[q]])
        return np.nonzero(open_ & ~whole)

    def counts(self) -> list[np.ndarray]:
        """Linked weights by row of the first tree and, if there is one, of the second."""
        first = self.of_row[0] + self.s.pushed(self.of_node[0])
        if not self.same:
            return [first, self.of_row[1] + self.t.pushed(self.of_node[1])]
        alone = self.s.pushed(self.itself * self.whole[0]) - self.s.pushed(self.itself) * self.weight[0]
        return [first + self.of_row[1] + self.s.pushed(self.of_node[1]) + alone]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        for tree, joined, base in ((self.s, self.joined[0], 0), (self.t, self.joined[1], self.base)):
            for k in np.flatnonzero(joined):
                rows = tree.order[tree.low[k] : tree.high[k]]
                self.keep(np.full(len(rows), base + tree.center[k]), base + rows)
        if not self.edges:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return stars(np.concatenate([e[0] for e in self.edges]), np.concatenate([e[1] for e in self.edges]))


class Top:
    """The top of the tree: nodes over a sample, whose cells are what all vectors are dealt to."""

    def __init__(self, x: np.ndarray):
        self.tree = Tree(x)
        self.centers = x[self.tree.center]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the lowest node that covers it on the way down by nearest children, and its distance to the centre."""
        cell, far = np.zeros(len(x), np.int64), apart(x @ self.centers[0])
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.tree.last[node]:
                continue
            best, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
            step = max(1, BLOCK // max(1, len(rows)))
            for k in range(self.tree.first[node], self.tree.last[node], step):
                d = apart(self.centers[k : min(k + step, self.tree.last[node])] @ x[rows].T)
                at = d.argmin(axis=0)
                low = d[at, np.arange(len(rows))]
                on = low < least
                best[on], least[on] = k + at[on], low[on]
            on = least <= self.tree.reach[node]
            rows, best = rows[on], best[on]
            cell[rows], far[rows] = best, least[on]
            todo += grouped(best, rows)
        return cell, far

    def measure(self, cells: np.ndarray, count: np.ndarray, far: np.ndarray, shard: int) -> None:
        """Sets radii from what was dealt: by cell (-1: empty) and by subtree; and numbers the shards of the cells."""
        n = len(self.centers)
        self.cell = np.full(n, -1.0)
        self.cell[cells] = far
        size = np.zeros(n, np.int64)
        size[cells] = count
        self.subtree = self.cell.copy()
        self.first_shard, self.blocks = np.zeros(n, np.int64), np.ones(n, np.int64)
        for node in range(n - 1, -1, -1):
            if self.tree.last[node]:
                below = self.tree.below(np.array([node]))
                d = apart(self.centers[below] @ self.centers[node]) + self.subtree[below] + SLACK
                self.subtree[node] = max(self.cell[node], d[self.subtree[below] >= 0].max(initial=-1.0))
        at, room, todo = 0, 0, [0]
        while todo:  # cells in the order of the tree's branches, so that neighbours share a shard
            node = todo.pop()
            todo += self.tree.below(np.array([node]))[::-1].tolist() if self.tree.last[node] else []
            if not size[node]:
                continue
            if size[node] > shard:
                self.blocks[node] = -(-size[node] // shard)
                self.first_shard[node], at, room = at, at + self.blocks[node], 0
            else:
                if size[node] > room:
                    at, room = at + 1, shard
                self.first_shard[node] = at - 1
                room -= size[node]
        self.shards = int(at)
        self.low, self.high = np.where(size > 0, self.first_shard, self.shards), np.where(size > 0, self.first_shard + self.blocks, 0)
        for node in range(n - 1, -1, -1):
            if self.tree.last[node]:
                below = self.tree.below(np.array([node]))
                self.low[node], self.high[node] = min(self.low[node], self.low[below].min()), max(self.high[node], self.high[below].max())

    def visits(self, x: np.ndarray, near: float, since: int = 0, until: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Cells, of those with some of the shards ``since`` to ``until``, with the rows of ``x`` that may have a neighbour in them."""
        until = self.shards if until is None else until
        wanted = (self.subtree >= 0) & (self.low < until) & (self.high > since)
        own = (self.cell >= 0) & (self.first_shard < until) & (self.first_shard + self.blocks > since)
        d = apart(x @ self.centers[0])
        if own[0] and (on := np.flatnonzero(d <= self.cell[0] + near + SLACK)).size:
            yield 0, on
        todo = [(int(self.tree.first[0]), int(self.tree.last[0]), np.flatnonzero(d <= self.subtree[0] + near + SLACK))]
        while todo:
            first, last, rows = todo.pop()
            step = max(1, BLOCK // max(1, len(rows)))
            if last - first > step:  # the rest waits until what is below these is done
                todo.append((first + step, last, rows))
            below = np.arange(first, min(first + step, last))
            below = below[wanted[below]]
            if not len(below) or not len(rows):
                continue
            d = apart(self.centers[below] @ x[rows].T)
            for k in np.flatnonzero(d.min(axis=1) <= self.subtree[below] + near + SLACK):
                child = int(below[k])
                if own[child] and (on := rows[d[k] <= self.cell[child] + near + SLACK]).size:
                    yield child, on
                if self.tree.last[child]:
                    todo.append((int(self.tree.first[child]), int(self.tree.last[child]), rows[d[k] <= self.subtree[child] + near + SLACK]))

    def seen(self, x: np.ndarray, home: np.ndarray, near: float, since: int, until: int) -> np.ndarray:
        """By shard from ``since`` to ``until`` and row of ``x``, whether the row, of the shard ``home``, visits the shard."""
        out = np.zeros((until - since, len(x)), bool)
        for cell, rows in self.visits(x, near, since, until):
            a = int(self.first_shard[cell]) - since
            out[max(a, 0) : a + int(self.blocks[cell]), rows] = True
        for k in range(len(out)):
            out[k] &= visits(home, since + k)
        return out

    def rounds(self, x: np.ndarray, near: float, n: int, width: int) -> list[tuple[int, int, list[int]]]:
        """Shards (first, last) of each round and the parts of their visitors, by how many of the ``x``, a sample of ``n``, visit them."""
        cell = self.home(x)[0]
        home = self.first_shard[cell] + np.arange(len(x)) % self.blocks[cell]
        out, first, parts, held = [], 0, [], 0.0
        for a in range(0, self.shards, SLICE):
            for k, visitors in enumerate((self.seen(x, home, near, a, min(a + SLICE, self.shards)).sum(axis=1) * (n / len(x))).tolist(), a):
                copies = max(1, -(-int(visitors) // PART))
                cost = (visitors + copies * n / self.shards) * (width + 16)
                if parts and (held + cost > max(ROUND, 1.5 * n * width) or len(parts) == SLICE):
                    out.append((first, k, parts))
                    first, parts, held = k, [], 0.0
                parts.append(copies)
                held += cost
        return [*out, (first, self.shards, parts)]


def slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """``SLICE`` rows at a time, or what makes about ``ARROW_BYTES`` of vectors of ``width`` bytes."""
    step = max(1, min(SLICE, ARROW_BYTES // width))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def _cells(shared, dims: int, dtype: str):
    def run(batches):
        top: Top = shared.value
        for batch in batches:
            for part in slices(batch, dims * np.dtype(dtype).itemsize):
                cell, far = top.home(units(part.column("data").to_pylist(), dims, dtype)[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("weight"), part.column("data"), pa.array(cell.astype(np.int32)), pa.array(far)], ["node", "weight", "data", "cell", "far"]
                )

    return run


def visits(p: np.ndarray, q: int) -> np.ndarray:
    """Whether the shards p visit shard q; of two shards just one visits the other."""
    return (p != q) & (((p + q) % 2 == 0) == (p < q))


def _deal(shared, dims: int, dtype: str, since: int, until: int, parts: list[int]):
    """Each vector to all parts of its own shard as a resident, and as a visitor to a part of the shards that may hold a neighbour;
    of the shards ``since`` to ``until``."""

    def run(batches):
        top, near = shared.value
        width = dims * np.dtype(dtype).itemsize
        for batch in batches:
            for part in slices(batch, width):
                data = part.column("data").to_pylist()
                flat = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
                node, weight = (part.column(c).to_numpy() for c in ("node", "weight"))
                home = part.column("shard").to_numpy()
                seen = top.seen(units(data, dims, dtype)[1], home, near, since, until)
                out, held = [], 0
                for s, n in enumerate(parts, since):
                    own, other = np.flatnonzero(home == s), np.flatnonzero(seen[s - since])
                    to = (int(node[0]) // SLICE + s) % n  # a slice's visitors stay together, as large blocks take less time
                    for part, kind, rows in [(p, 0, own) for p in range(n) if len(own)] + [(to, 1, other)] * (len(other) > 0):
                        out.append((s, part, kind, node[rows].tobytes(), weight[rows].tobytes(), flat[rows].tobytes()))
                        held += len(rows) * (width + 16)
                        if held >= ARROW_BYTES:
                            yield _dealt(out)
                            out, held = [], 0
                if out:
                    yield _dealt(out)

    return run


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in c[:3]), *(pa.array(x, pa.binary()) for x in c[3:])], ["shard", "part", "kind", "nodes", "weights", "data"])


def search(residents: tuple, visitors: tuple | None, cos: float) -> tuple[pa.RecordBatch, int]:
    """Link counts (a, -1, n) and stars (a, b, 0) of residents (names, weights, vectors, tree) among themselves, or between
    them and visitors (names, weights, (vectors, unit vectors)); and how many cosines that took."""
    names, w, raw, tree = residents
    if visitors is None:
        links = Links(tree, w, raw, None, w, raw, cos).run()
    else:
        other, wv, (rv, unit) = visitors
        names = np.concatenate([names, other])
        links = Links(tree, w, raw, Tree(unit), wv, rv, cos).run()
    count = np.concatenate(links.counts())
    on = np.flatnonzero(count)
    i, j = links.stars()
    a, b = np.concatenate([names[on], names[i]]), np.concatenate([np.full(len(on), -1), names[j]])
    n = np.concatenate([count[on], np.zeros(len(i), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (a, b, n)], ["a", "b", "n"]), links.tested


def _search(dims: int, dtype: str, cos: float):
    """Rows of whole parts of shards, residents first, to link counts (a, -1, n) and stars (a, b, 0); the first part also searches
    the residents among themselves."""

    def run(batches):
        at, held, res, waiting = None, [], None, []

        def unpack(rows):
            return (
                np.frombuffer(b"".join(r["nodes"] for r in rows), np.int64),
                np.frombuffer(b"".join(r["weights"] for r in rows), np.int64),
                units([r["data"] for r in rows], dims, dtype),
            )

        def residents():
            nodes, w, (raw, unit) = unpack(held)
            return nodes, w, raw, Tree(unit)

        def alone(res):
            if at[1] == 0:
                yield search(res, None, cos)[0]

        def visited():
            if waiting and res is not None:
                yield search(res, unpack(waiting), cos)[0]
            waiting.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if (r["shard"], r["part"]) != at:
                    yield from visited()
                    if held:
                        yield from alone(residents())
                    at, held, res = (r["shard"], r["part"]), [], None
                if r["kind"] == 0:
                    held.append(r)
                else:
                    if held:
                        res, held = residents(), []
                        yield from alone(res)
                    waiting.append(r)
                    if sum(len(v["nodes"]) for v in waiting) >= 8 * VISITORS or sum(len(v["data"]) for v in waiting) >= ARROW_BYTES:
                        yield from visited()
        yield from visited()
        if held:
            yield from alone(residents())

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    bound_arrow(vectors.sparkSession)
    element = dict(vectors.dtypes)["embedding"]
    dtype = "<f4" if element == "array<float>" else "<f8"
    wide = F.col("embedding") if dtype == "<f4" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    distinct = rows.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    with lean_shuffles(vectors.sparkSession):
        distinct = stage(distinct.select("embedding", "rep", "weight", F.size("embedding").alias("dims")).withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    found = None
    for r in distinct.groupBy("dims").agg(F.count("*").alias("n")).collect():
        part = _of_length(distinct.where(F.col("dims") == r["dims"]), r["dims"], r["n"], dtype, least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    root = components(found.where("b >= 0").select("a", "b"))
    count = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    own = distinct.select("node", "embedding", "rep", "weight").join(root, "node", "left").join(count, "node", "left")
    own = own.select("embedding", "rep", "weight", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    name = own.groupBy("root").agg(F.min("rep").alias("component_id"))
    own = own.join(name, "root").select(F.col("embedding").alias("e"), (F.col("n") + F.col("weight") - 1).alias("n"), "component_id")
    good = rows.where("fine").join(own, F.col("embedding") == F.col("e")).select("vec_id", F.col("n").alias("n_links"), "component_id")
    bad = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _of_length(distinct: DataFrame, dims: int, n: int, dtype: str, least: float) -> DataFrame:
    spark = distinct.sparkSession
    size = 4 if dtype == "<f4" else 8

    def packed(batches):
        for batch in batches:
            flat = np.asarray(batch.column("embedding").flatten(), dtype).tobytes()
            data = [flat[i * dims * size : (i + 1) * dims * size] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), pa.array(data, pa.binary())], ["node", "weight", "data"])

    vectors = distinct.select("node", "weight", "embedding").mapInArrow(packed, "node long, weight long, data binary")
    most = max(1, WIDE // (8 * dims))
    sample = distinct.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, most, max(512, n // 16))).mapInArrow(packed, "node long, weight long, data binary").select("data").collect()
    top = Top(units([bytes(r[0]) for r in sample], dims, dtype)[1])
    shared = spark.sparkContext.broadcast(top)
    cells = stage(vectors.mapInArrow(_cells(shared, dims, dtype), "node long, weight long, data binary, cell int, far double"), "cells")
    stats = sorted((r["cell"], r["n"], r["far"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect())
    top.measure(*(np.array(x) for x in zip(*stats, strict=True)), min(SHARD, most))
    table = spark.createDataFrame([(c, int(top.first_shard[c]), int(top.blocks[c])) for c, _, _ in stats], "cell int, first int, blocks int")
    dealt = cells.join(F.broadcast(table), "cell").select("node", "weight", "data", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int").alias("shard"))
    near = float(np.sqrt(2 - 2 * least))
    plan = spark.sparkContext.broadcast((top, near))
    path, links = new_path(spark, "vector-links"), "a long, b long, n long"
    for since, until, parts in top.rounds(top.tree.x[:SLICE], near, n, dims * size):
        rows = dealt.mapInArrow(_deal(plan, dims, dtype, since, until, parts), "shard int, part int, kind int, nodes binary, weights binary, data binary")
        found = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(_search(dims, dtype, least), links)
        with lean_shuffles(spark):
            found.write.mode("append").option("compression", "zstd").parquet(path)
    drop_staged(cells)
    return spark.read.schema(links).parquet(path)


def op2_cover_tree(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
