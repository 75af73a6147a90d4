"""Linear-chain conditional random field: forward-backward over many sequences at once, and its gradient.

Sequences lie one after another in flat arrays. Each is cut into blocks of ``BLOCK`` items. What comes into a
block from the left and from the right is found first: the product of a block's transition matrices carries
any message across it, so messages go from block to block, not from item to item. Then all blocks are advanced
together, item by item, from their true messages. The result is that of whole sequences of any length, and the
number of steps does not grow with the longest. Potentials are rescaled at each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Items of a block.
BLOCK = 64


def _blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each block, the sequence it is of, and its number there."""
    starts = np.cumsum(lengths) - lengths
    many = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return starts[owner] + number * BLOCK, np.minimum(BLOCK, lengths[owner] - number * BLOCK), owner, number


def _messages(e: np.ndarray, step: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes into each block from the left (the items before it) and from the right (those after it)."""
    labels = e.shape[1]
    left, right = np.ones((len(start), labels), e.dtype), np.ones((len(start), labels), e.dtype)
    last = np.append(number[1:] == 0, True)
    chained = np.flatnonzero((number > 0) | ~last)
    if not len(chained):
        return left, right
    product = _products(e, step, start, size, number, chained)
    most = int(number.max())
    order = np.argsort(number, kind="stable")
    cut = np.searchsorted(number[order], np.arange(most + 2))
    for k in range(1, most + 1):
        rows = order[cut[k] : cut[k + 1]]
        got = (left[rows - 1][:, None, :] @ product[rows - 1])[:, 0]
        left[rows] = got / got.sum(axis=1, keepdims=True)
    for k in range(most, 0, -1):
        rows = order[cut[k] : cut[k + 1]]
        got = (product[rows] @ right[rows][:, :, None])[:, :, 0]
        right[rows - 1] = got / got.sum(axis=1, keepdims=True)
    return left, right


def _products(e: np.ndarray, step: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The product of each chosen block's matrices; a sequence's first item has no transition into it."""
    labels = e.shape[1]
    product = np.zeros((len(start), labels, labels), e.dtype)
    for t in range(int(size[chosen].max())):
        rows = chosen[size[chosen] > t]
        item = e[start[rows] + t][:, None, :]
        if t == 0:
            first = (number[rows] == 0)[:, None, None]
            product[rows] = np.where(first, np.eye(labels, dtype=e.dtype), step) * item
        else:
            product[rows] = (product[rows] @ step) * item
        product[rows] /= product[rows].sum(axis=(1, 2), keepdims=True)
    return product


def _within(e: np.ndarray, step: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward messages of all items from those into their blocks, and the sum of the logarithms of the rescalings."""
    order = np.argsort(-size, kind="stable")
    start, size, number, left, right = start[order], size[order], number[order], left[order], right[order]
    longest = int(size[0])
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest + 1)]
    alpha, beta = np.empty_like(e), np.empty_like(e)
    log_z = 0.0
    before = np.where((number == 0)[:, None], 1, left @ step)
    for t in range(longest):
        k = active[t]
        at = start[:k] + t
        now = before[:k] * e[at]
        total = now.sum(axis=1, keepdims=True)
        now /= total
        log_z += float(np.log(total).sum())
        alpha[at] = now
        before = now @ step
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        after = right[:k].copy()
        inner = active[t + 1]
        if inner:
            onward = (e[at[:inner] + 1] * beta[at[:inner] + 1]) @ step.T
            after[:inner] = onward / onward.sum(axis=1, keepdims=True)
        beta[at] = after
    return alpha, beta, log_z


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum()


def long_marginals(pieces: Callable[[], Iterator[np.ndarray]], transition: np.ndarray) -> Iterator[np.ndarray]:
    """Label marginals of one chain, piece by piece, for chains that should not be held whole.

    ``pieces`` gives the chain's emissions in order and is asked twice: for the product of each piece's matrices,
    which carries messages across it, and for its items.
    """
    step = np.exp(transition).astype(np.float64)

    def described(emission: np.ndarray, first: bool) -> tuple:
        e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64)
        start = np.arange(0, len(e), BLOCK)
        number = np.arange(len(start)) + (0 if first else 1)
        size = np.minimum(BLOCK, len(e) - start)
        return e, start, size, number, _products(e, step, start, size, number, np.arange(len(start)))

    across = []
    for emission in pieces():
        product = np.eye(len(step))
        for m in described(emission, not across)[-1]:
            product = _scaled(product @ m)
        across.append(product)
    into = [np.ones(len(step))]
    for product in across[:0:-1]:
        into.append(_scaled(product @ into[-1]))
    left = np.ones(len(step))
    for k, emission in enumerate(pieces()):
        e, start, size, number, product = described(emission, k == 0)
        lefts, rights = [left], [into[len(across) - 1 - k]]
        for m in product:
            lefts.append(_scaled(lefts[-1] @ m))
        for m in product[:0:-1]:
            rights.append(_scaled(m @ rights[-1]))
        left = lefts.pop()
        alpha, beta, _ = _within(e, step, start, size, number, np.array(lefts), np.array(rights[::-1]))
        out = alpha * beta
        yield out / out.sum(axis=1, keepdims=True)


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Label marginals of each item, expected transitions in all (if asked for), and the sum of log partition functions."""
    labels = emission.shape[1]
    pairs = np.zeros((labels, labels)) if with_pairs else None
    if not len(emission):
        return emission.copy(), pairs, 0.0
    lengths = lengths[lengths > 0]
    high = emission.max(axis=1, keepdims=True)
    e = np.exp(emission - high)
    step = np.exp(transition).astype(e.dtype)
    start, size, _, number = _blocks(lengths)
    left, right = _messages(e, step, start, size, number)
    alpha, beta, scale = _within(e, step, start, size, number, left, right)
    log_z = float(high.sum()) + scale
    out = alpha * beta
    out /= out.sum(axis=1, keepdims=True)
    if with_pairs:
        inside = np.ones(len(e), bool)
        inside[np.cumsum(lengths) - 1] = False
        at = np.flatnonzero(inside)
        for k in range(0, len(at), 65536):
            i = at[k : k + 65536]
            joint = alpha[i][:, :, None] * step[None] * (e[i + 1] * beta[i + 1])[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return out, pairs, log_z


def gradients(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood by emissions and by transitions."""
    got, pairs, _ = marginals(emission, lengths, transition, with_pairs=True)
    by_emission = got
    by_emission[np.arange(len(labels)), labels] -= 1
    inside = np.ones(len(labels), bool)
    inside[np.cumsum(lengths) - 1] = False
    seen = np.zeros_like(pairs)
    at = np.flatnonzero(inside)
    np.add.at(seen, (labels[at], labels[at + 1]), 1)
    return by_emission, pairs - seen


class Adagrad:
    """Per-weight step sizes, with a pull to zero."""

    def __init__(self, shape: tuple[int, ...], rate: float, decay: float = 0.0):
        self.w = np.zeros(shape, np.float32)
        self.g2 = np.full(shape, 1e-6, np.float32)
        self.rate, self.decay = rate, decay

    def step(self, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            grad = grad + self.decay * self.w
            self.g2 += grad**2
            self.w -= (self.rate * grad / np.sqrt(self.g2)).astype(np.float32)
        else:
            grad = grad + self.decay * self.w[rows]
            self.g2[rows] += grad**2
            self.w[rows] -= (self.rate * grad / np.sqrt(self.g2[rows])).astype(np.float32)
