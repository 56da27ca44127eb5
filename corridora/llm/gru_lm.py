"""Scoring by a gated recurrent language model with a class-factored output softmax, in numpy.

Tokens are lower-cased words and an end for each text. Known words are grouped by the company that
they keep. The model's symbols are the most frequent words, the rest of each group, and one for all
other tokens. P(token | before) = P(class | state) * P(symbol | class, state), and for a token that
shares a symbol times its smoothed share of the symbol's counts in training, so every text has a
probability, whatever its words, and the sum over one text's next tokens is 1. A class is a part of a
group's symbols, of like frequency, so that the classes alone tell a text's language or subject.

Texts of a block run side by side in lanes. Truncated backpropagation covers a window of positions;
the state is carried from window to window and is reset only where a text begins, so a score is that
of the whole text. Lanes refill as texts end.

Counting is a Spark aggregation over all training texts. So is the company: how often each of the
most frequent words stands near each known one; groups are the clusters of these counts. Training is
data-parallel: a hash of the text deals every training text to one of ``ROUNDS`` rounds; in a round
every task runs once over the round's texts of its partition, all from the same weights, and the
weights are averaged, weighted by tokens, in a tree.
Word counts are looked up in a table of at most ``KNOWN_WORDS`` frequent words; rarer ones, whose
texts are few, are joined.

Defined results: null and empty texts are one end token; repeated rows are scored each; a very long
text is one lane; without training texts every count is 0 and scores are those of the smoothing.
Words are told apart by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as kernels
from .shared import materialize, release

END = np.uint64(0x0123456789ABCDEF)
SMOOTH = 0.1
#: Frequent words whose counts every task holds (16 bytes each).
KNOWN_WORDS = 200_000
SYMBOLS, HIDDEN, WINDOW = 768, 24, 32
#: Texts side by side in scoring and in learning, and learning steps that a block should give at least.
LANES, LEARN_LANES, LEARN_STEPS = 512, 256, 128
#: Groups of known words, and classes of each group's symbols.
GROUPS, BINS = 8, 3
#: Frequent words whose nearness tells groups apart, and how near that is.
COMPANY, REACH = 48, 2
#: Tokens of a long text that are learned from in one go.
STRETCH = 2048
#: Tokens of a block of texts. A long text bounds the number of lanes, and wide windows cost less a token.
BLOCK_TOKENS, LOOK_UP_TOKENS = 4_000_000, 500_000
#: AdaGrad's rate and first sum of squares.
RATE, START = 0.18, 1e-2
#: Every training text is learned from in one of so many rounds; after each the weights are averaged.
ROUNDS = 2
#: Weights averaged in one task of the tree.
FAN_IN = 8
#: Softmax scores that cannot be above it need no maximum taken off before their exponentials.
SAFE = 60.0
#: Positions of a symbol in a window from which their gradients are summed by a product.
MANY = 16


@dataclass
class Vocabulary:
    """Frequent words by hash with their counts, the model's symbols, and the totals."""

    hashes: np.ndarray  # ascending
    counts: np.ndarray
    symbol: np.ndarray  # the symbol of each
    log_share: np.ndarray  # log10 of each one's share of its symbol
    total: int
    distinct: int
    order: np.ndarray  # symbols by class
    bounds: np.ndarray  # classes' borders in it
    frequency: np.ndarray  # of each symbol; the last one is that of all other tokens

    @property
    def others(self) -> int:
        return len(self.frequency) - 1

    def other_mass(self) -> float:
        """The smoothed count of all other tokens together, one unseen token included."""
        return float(self.frequency[self.others]) + SMOOTH * (self.distinct - np.count_nonzero(self.counts) + 1)

    @functools.cached_property
    def buckets(self) -> tuple[np.uint64, np.ndarray]:
        """(bits to shift off, first word of each bucket): the words by their highest bits, about four buckets a word."""
        bits = max(4, (4 * len(self.hashes)).bit_length())
        shift = np.uint64(64 - bits)
        return shift, np.r_[0, np.cumsum(np.bincount((self.hashes >> shift).astype(np.int64), minlength=1 << bits))].astype(np.int32)

    def look_up(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in the table, or -1."""
        out = np.full(len(words), -1, dtype=np.int32)
        if not len(self.hashes):
            return out
        shift, start = self.buckets
        hashes = np.r_[self.hashes, self.hashes[-1]]  # one more, never met by a word of a later bucket
        for a in range(0, len(words), LOOK_UP_TOKENS):
            part, at = words[a : a + LOOK_UP_TOKENS], out[a : a + LOOK_UP_TOKENS]
            bucket = (part >> shift).astype(np.int64)
            at[:] = start[bucket]
            left = np.flatnonzero(hashes[at] != part)
            while len(left):  # a word on in its bucket
                place = at[left] + 1
                more = place < start[bucket[left] + 1]
                at[left[~more]] = -1
                left, place = left[more], place[more]
                at[left] = place
                left = left[hashes[place] != part[left]]
        return out

    def symbols(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place; that of all others for -1."""
        return np.r_[self.symbol, self.others].astype(np.int16)[at]


def vocabulary(hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, group: np.ndarray | None = None) -> Vocabulary:
    """From the known words' hashes, counts and groups, and the totals of all tokens."""
    group = np.zeros(len(hashes), np.int64) if group is None else group
    if END not in hashes:  # the end is always a symbol
        hashes, counts, group = np.r_[hashes, END].astype(np.uint64), np.r_[counts, 0], np.r_[group, 0].astype(np.int64)
    chosen = np.lexsort((hashes, -counts, hashes != END))[: SYMBOLS - 1 - GROUPS]
    symbol = np.full(len(hashes), -1, dtype=np.int32)
    symbol[chosen] = np.arange(len(chosen))
    rest = np.unique(group[symbol < 0])
    symbol[symbol < 0] = len(chosen) + np.searchsorted(rest, group[symbol < 0])
    n = len(chosen) + len(rest)
    frequency = np.r_[np.bincount(symbol, weights=counts, minlength=n), total - counts.sum()].astype(np.int64)
    mass = np.bincount(symbol, weights=counts + SMOOTH, minlength=n)
    log_share = np.where(symbol < len(chosen), 0.0, np.log10((counts + SMOOTH) / mass[symbol]))
    order, bounds = [], [0]
    for g in np.unique(group[chosen]):
        # a group's classes hold equal shares of the square roots of counts
        inside = np.flatnonzero(group[chosen] == g)
        inside = inside[np.argsort(-frequency[inside], kind="stable")]
        summed = np.cumsum(np.sqrt(frequency[inside] + 1.0))
        share = np.minimum((summed - summed[0]) / summed[-1] * BINS, BINS - 1).astype(int)
        order.append(inside)
        bounds += [bounds[-1] + int(e) for e in np.r_[np.flatnonzero(np.diff(share)) + 1, len(inside)]]
    order.append(np.arange(len(chosen), n + 1))
    bounds += range(bounds[-1] + 1, bounds[-1] + len(rest) + 2)
    by = np.argsort(hashes)
    return Vocabulary(hashes[by], counts[by], symbol[by], log_share[by], int(total), int(distinct), np.concatenate(order), np.array(bounds), frequency)


def clusters(company: np.ndarray, counts: np.ndarray, *, steps: int = 15, prior: float = 4.0, seed: int = 5) -> np.ndarray:
    """The group of each known word, from how often each frequent word stands near it: k-means on square
    roots of smoothed shares, where words weigh by the roots of their counts."""
    if not len(counts):
        return np.zeros(0, np.int64)
    usual = (company.sum(axis=0) + 1.0) / (company.sum() + company.shape[1])
    x = np.sqrt((company + prior * usual) / (company.sum(axis=1, keepdims=True) + prior)).astype(np.float32) - np.sqrt(usual).astype(np.float32)
    weight = np.sqrt(counts + 1.0)
    random = np.random.default_rng(seed)
    centre = x[[int(counts.argmax())]]
    away = ((x - centre[0]) ** 2).sum(axis=1)
    while len(centre) < min(GROUPS, len(x)) and (chance := away * weight).sum() > 1e-9:  # far from those there are
        centre = np.r_[centre, x[[int(random.choice(len(x), p=chance / chance.sum()))]]]
        away = np.minimum(away, ((x - centre[-1]) ** 2).sum(axis=1))
    group = np.zeros(len(x), np.int64)
    for _ in range(steps):
        group = (x @ (-2 * centre.T) + (centre**2).sum(axis=1)).argmin(axis=1)
        for k in range(len(centre)):
            here = group == k
            if here.any():
                centre[k] = np.average(x[here], axis=0, weights=weight[here])
    return group


def _gates(x: np.ndarray) -> np.ndarray:
    """(gates, rows, HIDDEN) of (rows, gates * HIDDEN), as a copy."""
    return np.array(x.reshape(len(x), -1, HIDDEN).transpose(1, 0, 2), order="C")


def _scores(out: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Softmax scores of states within -1 and 1, less their maximum where an exponential could overflow."""
    s = out @ weights.T
    if np.abs(weights).sum(axis=1).max() > SAFE:
        s -= s.max(axis=1, keepdims=True)
    return s


def _add_up(rows: np.ndarray, first: np.ndarray, ids: np.ndarray, table: np.ndarray) -> None:
    """Sums of runs of rows (gates, rows, HIDDEN) into the table at their ids: long runs by products, the others at once."""
    size = np.diff(np.r_[first, rows.shape[1]])
    ones = np.ones(size.max(), np.float32)
    for i in np.flatnonzero(size >= MANY):
        table[:, ids[i]] = ones[: size[i]] @ rows[:, first[i] : first[i] + size[i]]
    short = size < MANY
    if short.any():
        few = rows.take(np.flatnonzero(np.repeat(short, size)), axis=1)
        table[:, ids[short]] = np.add.reduceat(few, np.r_[0, np.cumsum(size[short])[:-1]], axis=1)


class Model:
    """Weights and the two passes of the gated recurrent network."""

    def __init__(self, v: Vocabulary, seed: int = 11):
        random = np.random.default_rng(seed)
        n, c, h = len(v.frequency), len(v.bounds) - 1, HIDDEN
        self.bounds = v.bounds
        self.place = np.empty(n, dtype=np.int64)
        self.place[v.order] = np.arange(n)
        self.of_class = np.repeat(np.arange(c), np.diff(v.bounds))
        f = (v.frequency[v.order] + SMOOTH).astype(np.float64)
        mass = np.add.reduceat(f, v.bounds[:-1])
        small = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
        self.w = {
            "input": small(n, 3 * h), "recur": small(h, 3 * h), "gate": np.zeros(3 * h, np.float32),
            "to_class": small(h, c) * 0.1, "class": np.log(mass / mass.sum()).astype(np.float32),
            "to_symbol": small(n, h) * 0.1, "symbol": np.log(f / np.repeat(mass, np.diff(v.bounds))).astype(np.float32),
        }
        self.squares = {k: np.full_like(x, START) for k, x in self.w.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.w.values()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k, x in self.w.items():
            self.w[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def window(self, state: np.ndarray, inputs: np.ndarray, targets: np.ndarray, begins: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray, dict]:
        """(next state, log probability of each target, gradients) over (steps, lanes) arrays.

        A target below 0 is no position. ``begins`` marks where a text starts: the state is reset.
        """
        w, h = self.w, HIDDEN
        steps, lanes = inputs.shape
        states = np.empty((steps + 1, lanes, h), np.float32)
        kept = []
        keep, fresh = (~begins)[:, :, None].astype(np.float32), begins.any(axis=1)
        # a gate after another, so that each is contiguous; a sigmoid is half a tanh of the half, which is taken here
        into, recur = _gates(w["input"] + w["gate"]), _gates(w["recur"])
        into[:2] *= 0.5
        recur[:2] *= 0.5
        states[0] = state
        now = state
        for t in range(steps):  # in place where it can be: these are most of the work
            before = now * keep[t] if fresh[t] else now
            a = into.take(inputs[t], axis=1)
            g = np.matmul(before, recur)
            zr, new = a[:2], a[2]
            zr += g[:2]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            new += zr[1] * g[2]
            np.tanh(new, out=new)
            now = new - before
            now *= zr[0]
            now += before
            states[t + 1] = now
            if learn:
                kept.append((before, zr, new, g[2]))
        used = np.flatnonzero(targets.reshape(-1) >= 0)
        place = self.place[targets.reshape(-1)[used]]
        cls = self.of_class[place]
        order = np.argsort(cls.astype(np.int16), kind="stable")  # short integers are sorted by radix
        used, place, cls = used[order], place[order], cls[order]
        out = np.ones((len(used), h + 1), np.float32)  # the last one for the bias
        out[:, :h] = states[1:].reshape(-1, h).take(used, axis=0)
        scores = _scores(out, np.r_[w["to_class"], w["class"][None]].T)
        p = np.exp(scores)
        total = p @ np.ones(p.shape[1], p.dtype)
        rows = np.arange(len(cls))
        log_p = scores[rows, cls] - np.log(total)
        grads: dict[str, np.ndarray] = {}
        if learn:
            p /= total[:, None]
            p[rows, cls] -= 1
            both = out.T @ p
            grads["to_class"], grads["class"] = both[:h], both[h]
            d_out = p @ w["to_class"].T
            grads["to_symbol"], grads["symbol"] = np.zeros_like(w["to_symbol"]), np.zeros_like(w["symbol"])
        edges = np.searchsorted(cls, np.arange(len(self.bounds)))
        to_symbol = np.c_[w["to_symbol"], w["symbol"]]
        picked, mass = np.zeros(len(cls), np.float32), np.ones(len(cls), np.float32)
        for k in np.flatnonzero(np.diff(edges)):
            a, z, lo, hi = edges[k], edges[k + 1], self.bounds[k], self.bounds[k + 1]
            if hi - lo == 1:
                continue
            s = _scores(out[a:z], to_symbol[lo:hi])
            inner, at = rows[: z - a], place[a:z] - lo
            picked[a:z] = s[inner, at]
            e = np.exp(s, out=s)
            sum_e = mass[a:z] = e @ np.ones(hi - lo, e.dtype)
            if learn:
                e /= sum_e[:, None]
                e[inner, at] -= 1
                both = e.T @ out[a:z]
                grads["to_symbol"][lo:hi], grads["symbol"][lo:hi] = both[:, :h], both[:, h]
                d_out[a:z] += e @ w["to_symbol"][lo:hi]
        log_p += picked - np.log(mass)
        every = np.zeros(steps * lanes, np.float32)
        every[used] = log_p
        if learn:
            d_states = np.zeros((steps * lanes, h), np.float32)
            d_states[used] = d_out
            d_states = d_states.reshape(steps, lanes, h)
            # by the new state before the reset gate's part, the two gates, and the new state through the reset gate
            d_all = np.empty((4, steps, lanes, h), np.float32)
            begun = np.empty((steps, lanes, h), np.float32)
            back = np.ascontiguousarray(_gates(w["recur"]).transpose(0, 2, 1))
            d_now = np.zeros((lanes, h), np.float32)
            for t in range(steps - 1, -1, -1):
                before, (z, r), new, g_new = kept[t]
                begun[t] = before
                d_new, d_z, d_r, d_reset = d_all[:, t]
                d_now += d_states[t]
                rest = 1 - z
                np.multiply(d_now, z, out=d_new)
                np.subtract(new, before, out=d_z)
                d_z *= d_new
                d_z *= rest
                new *= new
                np.subtract(1, new, out=new)
                d_new *= new
                np.multiply(d_new, r, out=d_reset)
                np.subtract(1, r, out=d_r)
                d_r *= d_reset
                d_r *= g_new
                d_now *= rest
                d_now += np.matmul(d_all[1:, t], back).sum(axis=0)
                if fresh[t]:
                    d_now *= keep[t]
            grads["recur"] = np.concatenate(list(np.matmul(begun.reshape(-1, h).T, d_all[1:].reshape(3, -1, h))), axis=1)
            ids = inputs.reshape(-1).astype(np.int16)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(ids[by]) > 0])
            table = np.zeros((3, *w["input"].shape[:1], h), np.float32)
            _add_up(d_all[:3].reshape(3, -1, h).take(by, axis=1), first, ids[by][first], table)
            grads["input"] = np.concatenate([table[1], table[2], table[0]], axis=1)
            grads["gate"] = grads["input"].sum(axis=0)
        return now, every.reshape(steps, lanes), grads

    def step(self, grads: dict[str, np.ndarray], positions: int, rate: float) -> None:
        """AdaGrad on the mean over positions, with the norm bounded."""
        scale = 1.0 / max(1, positions)
        norm = scale * float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale *= min(1.0, 1.0 / max(norm, 1e-12))
        for k, g in grads.items():
            g = g * np.float32(scale)
            self.squares[k] += g * g
            root = np.sqrt(self.squares[k])
            root += np.float32(1e-6)
            g *= np.float32(rate)
            g /= root
            self.w[k] -= g


def lanes(symbols: np.ndarray, first: np.ndarray, end: int, learn: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of (inputs, targets, begins, places): texts dealt to lanes, longest first."""
    sizes = np.diff(first)
    depth = max(WINDOW * LEARN_STEPS if learn else 256, int(sizes.max(initial=1)))
    # a very long text has a lane, and all others share one or two: the arrays below have a place for each lane's depth
    width = int(np.clip(-(-len(symbols) // depth), max(1, min(8, BLOCK_TOKENS // depth)), LEARN_LANES if learn else LANES))
    width = min(width, len(sizes))
    if not width:
        return
    heap = [(0, i) for i in range(width)]
    dealt: list[list[int]] = [[] for _ in range(width)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        load, lane = heapq.heappop(heap)
        dealt[lane].append(d)
        heapq.heappush(heap, (load + int(sizes[d]), lane))
    length = np.array([sizes[x].sum() for x in dealt])
    by = np.argsort(-length, kind="stable")
    length, depth = length[by], int(length.max())
    depth += -depth % WINDOW
    places = np.full((width, depth), -1, dtype=np.int32)
    begins = np.zeros((width, depth), dtype=bool)
    for row, lane in enumerate(by):
        at = 0
        for d in dealt[lane]:
            places[row, at : at + sizes[d]] = np.arange(first[d], first[d + 1])
            begins[row, at] = True
            at += sizes[d]
    targets = np.where(places >= 0, symbols[places], -1).astype(np.int16)
    inputs = np.full_like(targets, end)
    inputs[:, 1:] = targets[:, :-1]
    inputs[begins] = end
    inputs[inputs < 0] = end
    for t in range(0, depth, WINDOW):
        n = int(np.searchsorted(-length, -t, side="left"))
        cut = slice(t, t + WINDOW)
        yield inputs[:n, cut].T, targets[:n, cut].T, begins[:n, cut].T, places[:n, cut].T


def run(model: Model, symbols: np.ndarray, first: np.ndarray, end: int, rate: float = 0.0) -> np.ndarray:
    """Log probabilities (natural) of all positions; with a ``rate``, learning on the way: then long texts
    are taken in stretches, each from a fresh state, so that lanes are alike."""
    out = np.zeros(len(symbols), np.float32)
    state = None
    if rate > 0:
        first = np.unique(np.r_[first, np.concatenate([np.arange(a, z, STRETCH) for a, z in zip(first[:-1], first[1:]) if z - a > STRETCH] or [first[:1]])])
    for inputs, targets, begins, places in lanes(symbols, first, end, rate > 0):
        n = inputs.shape[1]
        state = np.zeros((n, HIDDEN), np.float32) if state is None else state[:n]
        state, log_p, grads = model.window(state, inputs, targets, begins, rate > 0)
        real = places >= 0
        out[places[real]] = log_p[real]
        if rate > 0:
            model.step(grads, int(real.sum()), rate)
    return out


def _tokens(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[tuple[pa.RecordBatch, int, int]], np.ndarray, np.ndarray]]:
    """Blocks of whole texts: (their rows, tokens' hashes with each text's end, texts' first tokens)."""
    rows: list[tuple[pa.RecordBatch, int, int]] = []
    words: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def block():
        return rows, np.concatenate(words), np.r_[0, np.cumsum(np.concatenate(sizes))]

    for batch in batches:
        data, offsets = kernels.string_bytes(batch.column(column))
        data = kernels.LOWER[data]
        for a, z in kernels.blocks(offsets):
            hashes, first = kernels.word_hashes(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], kernels.SPACED)
            rows.append((batch, a, z))
            words.append(np.insert(hashes, first[1:], END))
            sizes.append(np.diff(first) + 1)
            held += len(words[-1])
            if held >= BLOCK_TOKENS:
                yield block()
                rows, words, sizes, held = [], [], [], 0
    if rows:
        yield block()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words, _ in _tokens(batches, 0):
        hashes, n = np.unique(words, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


_COMPANY = "place binary, n binary"


def _add(total: np.ndarray, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    for batch in batches:
        for place, n in zip(batch.column(0), batch.column(1), strict=True):
            total[np.cumsum(kernels.expand(place.as_py(), np.uint32), dtype=np.int64)] += kernels.expand(n.as_py(), np.uint32)
    return total


def _sparse(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(total)
    if len(some):
        place, n = kernels.squeeze(np.diff(some, prepend=0).astype(np.uint32)), kernels.squeeze(total[some].astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.binary()), pa.array([n], pa.binary())], names=["place", "n"])


def company_counts(texts: DataFrame, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the COMPANY most frequent words stands within REACH of each known word (hashes
    ascending), in all texts. A task's sums have a bounded size and meet in a tree."""
    feature = np.full(len(hashes) + 1, -1, dtype=np.int32)
    feature[np.lexsort((hashes, -counts))[:COMPANY]] = np.arange(min(COMPANY, len(hashes)))
    known = Vocabulary(hashes, counts, *[np.zeros(0)] * 2, 0, 0, *[np.zeros(0)] * 3)
    shared = texts.sparkSession.sparkContext.broadcast((known, feature))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, feature = shared.value
        total = np.zeros(len(v.hashes) * COMPANY, np.uint32)
        for _, words, first in _tokens(batches, 0):
            owner = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
            for a in range(0, len(words), LOOK_UP_TOKENS):
                own, at = owner[a : a + LOOK_UP_TOKENS], v.look_up(words[a : a + LOOK_UP_TOKENS])
                near = feature[at]
                for d in range(1, REACH + 1):
                    same = own[d:] == own[:-d]
                    for one, two in ((at[:-d], near[d:]), (at[d:], near[:-d])):
                        ok = np.flatnonzero(same & (two >= 0) & (one >= 0))
                        np.add.at(total, one[ok] * COMPANY + two[ok], 1)
        yield from _sparse(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sparse(_add(np.zeros(len(shared.value[0].hashes) * COMPANY, np.uint32), batches))

    level = materialize(texts.mapInArrow(meet, _COMPANY), "company")
    while (many := level.count()) > 1:
        before, level = level, materialize(level.repartition(-(-many // FAN_IN)).mapInArrow(add, _COMPANY), "company")
        release(before)
    total = _add(np.zeros(len(hashes) * COMPANY, np.uint32), level.toArrow().to_batches())  # one row of a bounded size
    release(level)
    shared.destroy()
    return total.reshape(len(hashes), COMPANY)


def learn_vocabulary(texts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """(vocabulary, counts (word, n) of every training token) of a DataFrame with one text column."""
    counts = texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # the least count whose words are few enough, on a scale of eighths of a doubling
    grade = F.floor(F.log2("n") * 8 + 1e-9).cast("int")
    table = sorted(counts.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r[0])
    least, words = None, 0
    for r in table:
        words += r[1]
        if words > KNOWN_WORDS:
            break
        least = r[0]
    known = counts.where(grade >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    hashes, n = known["word"].to_numpy().view(np.uint64), known["n"].to_numpy()
    by = np.argsort(hashes)
    hashes, n = hashes[by], n[by]
    group = clusters(company_counts(texts, hashes, n), n)
    return vocabulary(hashes, n, total or 0, distinct or 0, group), counts


_WEIGHTS = "weight double, flat binary"


def _pair(weight: float, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(weight)]), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], names=["weight", "flat"])


def train(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """The flat weights after every row of texts, a DataFrame with one text column, was learned from once."""
    flat = Model(words).flat()
    turn = F.pmod(F.xxhash64(F.col(texts.columns[0]), F.lit("round")), F.lit(ROUNDS))
    for k in range(ROUNDS):
        flat = _round(texts.where(turn == k), words, flat)
    return flat


def _round(texts: DataFrame, words: Vocabulary, flat: np.ndarray) -> np.ndarray:
    """The averaged weights after one pass over all texts from the weights ``flat``."""
    shared = texts.sparkSession.sparkContext.broadcast((words, flat))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.one_thread()
        v, start = shared.value
        model, seen = Model(v).load(start), 0
        end = int(v.symbol[v.look_up(np.array([END]))[0]])
        for _, hashes, first in _tokens(batches, 0):
            run(model, v.symbols(v.look_up(hashes)), first, end, RATE)
            seen += len(hashes)
        if seen:
            yield _pair(seen, model.flat())

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = 0.0, None
        for batch in batches:
            for weight, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(said.as_py(), np.float32).astype(np.float64)
                total += weight
                mean = part if mean is None else mean + (part - mean) * (weight / total)
        if mean is not None:
            yield _pair(total, mean)

    level = materialize(texts.mapInArrow(fit, _WEIGHTS), "weights")
    shared.destroy()
    while (many := level.count()) > FAN_IN:
        before, level = level, materialize(level.repartition(-(-many // FAN_IN)).mapInArrow(average, _WEIGHTS), "weights")
        release(before)
    parts = level.toArrow()  # FAN_IN rows at most
    release(level)
    if parts.num_rows:
        weight = parts["weight"].to_numpy()
        flat = sum(np.frombuffer(x.as_py(), np.float32) * (w / weight.sum()) for x, w in zip(parts["flat"], weight, strict=True)).astype(np.float32)
    return flat


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare_word array<long>, rare_n array<int>"


def score(docs: DataFrame, *, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``
    (doc_id, text); rows for which the condition ``held_out`` holds are not learned from."""
    spark = docs.sparkSession
    training = docs.where(~held_out)
    texts = training.select(F.col("text").cast("string").alias("text"))
    words, counts = learn_vocabulary(texts)
    flat = train(texts, words)
    shared = spark.sparkContext.broadcast((words, flat))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kernels.one_thread()
        v, weights = shared.value
        model = Model(v).load(weights)
        end = int(v.symbol[v.look_up(np.array([END]))[0]])
        seen = np.r_[v.counts > 0, False].astype(np.float64)
        shares = np.r_[v.log_share, -np.log10(v.other_mass())]
        log_counts = np.r_[np.log10(v.counts + SMOOTH), 0.0]  # the last one for words that are joined
        row = TaskContext.get().partitionId() << 33
        for rows, hashes, first in _tokens(batches, 2):
            at = v.look_up(hashes)
            symbols = v.symbols(at)
            n = len(first) - 1
            log_model = run(model, symbols, first, end).astype(np.float64)
            log_model /= np.log(10)
            log_c = log_counts[at]
            log_model += shares[at]
            owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
            rare = np.flatnonzero(at < 0)
            by = rare[np.lexsort((hashes[rare], owner[rare]))]
            new = np.ones(len(by), dtype=bool)
            new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (owner[by][1:] != owner[by][:-1])
            heads = np.flatnonzero(new)
            lists = np.searchsorted(owner[by][heads], np.arange(n + 1)).astype(np.int32)
            ids = pa.concat_arrays([b.column(0).slice(a, z - a) for b, a, z in rows])
            held = pa.concat_arrays([b.column(1).slice(a, z - a) for b, a, z in rows])
            sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)), ids, held, pa.array(np.diff(first)), pa.array(sums(seen[at]).astype(np.int64)), pa.array(sums(log_c)), pa.array(sums(log_model)),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(hashes[by][heads].view(np.int64))), pa.ListArray.from_arrays(pa.array(lists), pa.array(np.diff(np.r_[heads, len(by)]).astype(np.int32))),
                ],
                names=[x.split()[0] for x in _SCORED.split(", ")],
            )
            row += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = materialize(rows.mapInArrow(judge, _SCORED), "scored")
    shared.destroy()
    rare = scored.select("row", F.explode(F.arrays_zip("rare_word", "rare_n")).alias("x")).select("row", F.col("x.rare_word").alias("word"), F.col("x.rare_n").alias("m"))
    found = rare.join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    rest = found.groupBy("row").agg(F.sum(F.col("m") * F.log10(c + SMOOTH)).alias("rare_log"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("rare_known"))
    base = np.log10(words.total + SMOOTH * (words.distinct + 1))
    more = F.coalesce("rare_log", F.lit(0.0))
    return scored.drop("rare_word", "rare_n").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(base)).alias("base_score"), (F.col("model") + more).alias("score"),
    )
