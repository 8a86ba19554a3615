"""A bidirectional LSTM over the blocks of a page, in numpy: forward, backward and training."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

PATH_BUCKETS = 512
WORD_BUCKETS = 1024
EMBED = 16
NUMBERS = 4
HIDDEN = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Paths:
    """Path buckets of a page's blocks as a tree, so that what blocks share is held once: each element's own buckets (sizes of them,
    end to end) and the element around it (a smaller number, or -1); for each block its element (or -1) and one bucket more."""

    own: np.ndarray
    sizes: np.ndarray
    around: np.ndarray
    node: np.ndarray
    last: np.ndarray

    def __len__(self) -> int:
        return len(self.node)


@dataclass
class Sequence:
    """The blocks of one page: for each, its path and word buckets, and numbers. Training takes paths as lists."""

    path: list[np.ndarray] | Paths
    words: list[np.ndarray]
    numbers: np.ndarray
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))


def new_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng, width = np.random.default_rng(seed), 2 * EMBED + NUMBERS
    w = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, EMBED)), "words": rng.normal(0, 0.1, (WORD_BUCKETS, EMBED)), "out": rng.normal(0, 0.3, 2 * HIDDEN + width), "bias": np.zeros(1)}
    for d in ("f", "b"):
        w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[f"c{d}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # the forget gate starts open
    return {k: v.astype(np.float32) for k, v in w.items()}


def _means(table: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """The mean row of the table for each list; long lists are counted by bucket first."""
    sizes = np.array([len(x) for x in lists])
    long = np.flatnonzero(sizes > len(table))
    if len(long):
        means = np.zeros((len(lists), table.shape[1]), table.dtype)
        for i in long:
            means[i] = np.bincount(lists[i], minlength=len(table)) @ table / sizes[i]
        short = np.flatnonzero(sizes <= len(table))
        if len(short):
            means[short] = _means(table, [lists[i] for i in short])
        return means
    flat = np.concatenate([*lists, np.zeros(1, np.int64)]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.add.reduceat(table[flat], starts, axis=0)[:-1]  # without the row that was added
    sums[sizes == 0] = 0
    return sums / np.maximum(sizes, 1)[:, None]


def _depths(around: np.ndarray) -> np.ndarray:
    """How deep each element of a forest lies, by doubling steps."""
    depth, up = (around >= 0).astype(np.int64), around.copy()
    while (live := np.flatnonzero(up >= 0)).size:
        depth[live] += depth[up[live]]
        up[live] = up[up[live]]
    return depth


def _path_means(table: np.ndarray, trees: list[Paths]) -> np.ndarray:
    """For each block the mean row of the table over its own bucket and those of all elements around it."""
    shift = np.cumsum([0, *(len(t.sizes) for t in trees)])
    flat, sizes = np.concatenate([t.own for t in trees]), np.concatenate([t.sizes for t in trees])
    around = np.concatenate([np.where(t.around < 0, -1, t.around + s) for t, s in zip(trees, shift[:-1], strict=True)])
    node = np.concatenate([np.where(t.node < 0, -1, t.node + s) for t, s in zip(trees, shift[:-1], strict=True)])
    last = np.concatenate([t.last for t in trees])
    if not len(sizes):
        return np.zeros((len(node), table.shape[1]), table.dtype)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rows = table[np.concatenate([flat, np.zeros(1, np.int64)])]
    sums = np.add.reduceat(rows, starts, axis=0)[:-1]  # every element has a name, so none is empty
    depth, n = _depths(around), sizes.copy()
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        level = order[a:b]
        sums[level] += sums[around[level]]
        n[level] += n[around[level]]
    means = (sums[node] + table[last]) / (n[node] + 1)[:, None]
    means[node < 0] = 0
    return means


def inputs(w: dict[str, np.ndarray], pages: list[Sequence]) -> tuple[np.ndarray, np.ndarray]:
    """pages x blocks x width, and which blocks are there. Shorter pages are filled up at their end."""
    longest = max(len(p.path) for p in pages)
    x = np.zeros((len(pages), longest, 2 * EMBED + NUMBERS), dtype=np.float32)
    there = np.zeros((len(pages), longest), dtype=bool)
    for i, p in enumerate(pages):
        there[i, : len(p.path)] = True
    if isinstance(pages[0].path, Paths):
        x[there, :EMBED] = _path_means(w["path"], [p.path for p in pages])
    else:
        x[there, :EMBED] = _means(w["path"], [b for p in pages for b in p.path])
    x[there, EMBED : 2 * EMBED] = _means(w["words"], [b for p in pages for b in p.words])
    x[there, 2 * EMBED :] = np.concatenate([p.numbers for p in pages])
    return x, there


def _run(w: dict[str, np.ndarray], d: str, x: np.ndarray, there: np.ndarray, keep: bool):
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    driven = x @ w[f"x{d}"] + w[f"c{d}"]
    out, trace = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = driven[:, t] + h @ w[f"h{d}"]
        f, i, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = there[:, t, None]
        c2 = np.where(m, f * c + i * g, c)
        s = np.tanh(c2)
        h2 = np.where(m, o * s, h)
        if keep:
            trace.append((t, h, c, f, i, o, g, s, m))
        h, c = h2, c2
        out[:, t] = h
    return out, trace


def scores(w: dict[str, np.ndarray], pages: list[Sequence]) -> list[np.ndarray]:
    """For each page the probability of each block to be content."""
    x, there = inputs(w, pages)
    states = np.concatenate([_run(w, "f", x, there, False)[0], _run(w, "b", x, there, False)[0], x], axis=2)
    p = _sigmoid(states @ w["out"] + w["bias"])
    return [p[i, : len(page.path)] for i, page in enumerate(pages)]


def gradients(w: dict[str, np.ndarray], pages: list[Sequence]) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss over blocks and its slopes, by back-propagation through both directions."""
    x, there = inputs(w, pages)
    traces, outs = {}, {}
    for d in ("f", "b"):
        outs[d], traces[d] = _run(w, d, x, there, True)
    states = np.concatenate([outs["f"], outs["b"], x], axis=2)
    p = _sigmoid(states @ w["out"] + w["bias"])
    y = np.zeros_like(p)
    y[there] = np.concatenate([page.labels for page in pages])
    total = there.sum()
    loss = -float(np.where(there, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0).sum() / total)
    dz = np.where(there, p - y, 0).astype(np.float32) / total
    g = {"out": np.einsum("nt,ntk->k", dz, states), "bias": np.array([dz.sum()], np.float32)}
    dstates = dz[:, :, None] * w["out"]
    dx = dstates[:, :, 2 * HIDDEN :].copy()
    for d, a in (("f", 0), ("b", HIDDEN)):
        dout = dstates[:, :, a : a + HIDDEN]
        dgates = np.zeros((*p.shape, 4 * HIDDEN), np.float32)
        dh, dc, dw = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0]), np.zeros_like(w[f"h{d}"])
        for t, h, c, f, i, o, gg, s, m in reversed(traces[d]):
            dh = dh + dout[:, t]
            live, through = np.where(m, dh, 0), np.where(m, 0, dh)
            dcell = np.where(m, dc + live * o * (1 - s * s), 0)
            dgate = np.concatenate([dcell * c * f * (1 - f), dcell * gg * i * (1 - i), live * s * o * (1 - o), dcell * i * (1 - gg * gg)], axis=1)
            dgates[:, t] = dgate
            dw += h.T @ dgate
            dh = through + dgate @ w[f"h{d}"].T
            dc = np.where(m, dcell * f, dc)
        g[f"h{d}"] = dw
        g[f"x{d}"] = np.einsum("nti,ntk->ik", x, dgates)
        g[f"c{d}"] = dgates.sum(axis=(0, 1))
        dx += dgates @ w[f"x{d}"].T
    for name, lo in (("path", 0), ("words", EMBED)):
        lists = [b for page in pages for b in getattr(page, name)]
        sizes = np.array([len(b) for b in lists])
        each = dx[there][:, lo : lo + EMBED] / np.maximum(sizes, 1)[:, None]
        flat, owner = np.concatenate(lists).astype(np.int64), np.repeat(np.arange(len(lists)), sizes)
        g[name] = np.stack([np.bincount(flat, weights=column[owner], minlength=len(w[name])) for column in each.T], axis=1).astype(w[name].dtype)
    return loss, g


def train(pages: list[Sequence], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over batches of pages of like length."""
    w, rng = new_weights(seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    by_length = sorted(range(len(pages)), key=lambda i: len(pages[i].path))
    groups = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
    for _ in range(epochs):
        for k in rng.permutation(len(groups)):
            _, g = gradients(w, [pages[i] for i in groups[k]])
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for name in w:
                slope = g[name] * min(1.0, 1.0 / max(norm, 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.99 * second[name] + 0.01 * slope * slope
                w[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
    return w
