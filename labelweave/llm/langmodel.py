"""LM scoring: a gated recurrent model with a class-factored softmax over counted words."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm import common
from labelweave.session import materialize

END = b""


@dataclass(frozen=True)
class LmConfig:
    """Sizes of the model. ``head``: words with outputs of their own; ``listed``: words whose counts travel
    with tasks, those beyond the head in small classes of words of like frequency; all other words are
    counted and scored through a join. ``shared``: input vectors that the words of small classes share by
    their number. ``piece``: training starts from an empty state again after so many tokens of a text.
    ``task_tokens``: partitions are learned from together until a task has about so many, as each task's
    parameters travel."""

    hidden: int = 16
    head: int = 1024
    classes: int = 24
    listed: int = 200_000
    lanes: int = 256
    window: int = 16
    piece: int = 256
    shared: int = 2048
    task_tokens: int = 2_000_000
    rate: float = 0.1
    damping: float = 1e-6
    first_share: int = 8
    average_salts: int = 64
    seed: int = 3


def tokens_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lowered, then the end."""
    out = text.lower().split() if text else []
    out.append(END)
    return out


GROUP_BYTES = 8 << 20  # texts cut into tokens together
_INSIDE = bytes(b not in common.BLANKS for b in range(256))
_LOWER = bytes(range(256)).lower()


def token_arrays(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The tokens of a binary column's texts, as by ``tokens_of``, one text behind the other, and how many
    each text has; texts of some ``GROUP_BYTES`` at a time."""
    column = pc.fill_null(column, b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = memoryview(data or b"")
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + GROUP_BYTES, "right")) - 1)
        text, edges = bytes(data[ends[start] : ends[stop]]), ends[start : stop + 1] - ends[start]
        inside = np.frombuffer(text.translate(_INSIDE), bool)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = edges[:-1][edges[:-1] < len(text)]  # a text's first word may touch the last one before
        begins[first] = inside[first]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | begins[1:]
        begin = np.flatnonzero(begins)
        last = np.searchsorted(begin, edges[1:])
        offsets = np.zeros(len(begin) + len(last) + 1, np.int32)
        sizes = np.insert(np.flatnonzero(closes) + 1 - begin, last, 0)  # the end is the empty word
        np.cumsum(sizes, out=offsets[1:])
        found = [None, pa.py_buffer(offsets), pa.py_buffer(text.translate(_LOWER, common.BLANKS))]
        yield pa.Array.from_buffers(pa.binary(), len(sizes), found), np.diff(last, prepend=0) + 1
        start = stop


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all of ``docs(_raw)``; every document adds one end, the empty word."""

    def count(batches):
        tally: Counter[bytes] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.binary()), pa.array(tally.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("_raw").to_pylist():
                tally.update(tokens_of(text))
            if len(tally) > 200_000:
                yield flush()
                tally.clear()
        yield flush()

    return docs.select("_raw").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


SMALL = 256  # words of a small class
SCORED = 8192  # states whose outputs are computed together


class Words:
    """What tasks must know of the counts: the listed words, the head's classes, the small classes of the
    other listed words by falling count, and the mass of the unlisted ones.

    Numbers of words: the head's, one for all unlisted words, one for the start, then the others'.
    """

    deep = 0

    def __init__(self, counts: DataFrame, cfg: LmConfig):
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
        self.n, self.v = int(total["n"]), int(total["v"])
        self.words, listed = common.most_frequent(counts, cfg.listed)
        self.counts = listed.astype(np.float64)
        if END in self.words and self.words.index(END) >= cfg.head:  # the end always has an output
            at, to = self.words.index(END), cfg.head - 1
            self.words.insert(to, self.words.pop(at))
            self.counts = np.insert(np.delete(self.counts, at), to, self.counts[at])
        self.head = min(cfg.head, len(self.words))
        mass = self.counts[: self.head]
        below = self.counts[self.head :]
        self.deep = len(below)
        tail = self.n - self.counts.sum()
        self.tail_log = float(np.log10(max(tail, 0) + self.v - len(self.words) + 1))
        #: Small classes of a group, and groups: about the square root of all small classes each.
        self.fan = max(1, int(np.ceil(np.sqrt(-(-self.deep // SMALL)))))
        self.top = -(-self.deep // (SMALL * self.fan))
        mass_of = np.zeros(self.top * self.fan * SMALL)
        mass_of[: self.deep] = below + 1
        by_small = mass_of.reshape(-1, SMALL).sum(1)
        with np.errstate(divide="ignore"):  # a class without a word can never be chosen
            level = [np.log(by_small.reshape(self.top, self.fan).sum(1)), np.log(by_small)]
        self.tree_bias = [np.maximum(b, -1e9).astype(np.float32) for b in level]
        self.share_log = (np.log(below + 1) - level[1][np.arange(self.deep) // SMALL]).astype(np.float32)
        root = np.sqrt(mass)
        share = np.cumsum(root) / max(root.sum(), 1)
        self.class_of = np.minimum((share * cfg.classes - 1e-9).astype(int), cfg.classes - 1)
        self.first = np.searchsorted(self.class_of, np.arange(cfg.classes + 1))
        by_class = np.array([mass[a:b].sum() for a, b in zip(self.first, self.first[1:])])
        self.class_bias = np.log(np.r_[by_class, tail, below.sum()][: cfg.classes + 1 + (self.deep > 0)] + 1).astype(np.float32)
        self.word_bias = np.log(mass + 1).astype(np.float32) if self.head else np.zeros(0, np.float32)

    def numbering(self) -> dict[bytes, int]:
        return {w: i if i < self.head else i + 2 for i, w in enumerate(self.words)}

    def listed(self) -> pa.Array:
        """The listed words, for ``numbers``."""
        return pa.array(self.words, pa.binary())

    def numbers(self, tokens: pa.Array, listed: pa.Array) -> np.ndarray:
        """Every token's number; unlisted words have ``head``."""
        at = pc.index_in(tokens, value_set=listed).fill_null(-1).to_numpy()
        return np.where(at < 0, self.head, at + 2 * (at >= self.head)).astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of every number, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def sorted_order(keys: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers from 0 to less than ``below``; two-byte numbers are sorted without comparisons."""
    return np.argsort(keys.astype(np.int16) if below <= 1 << 15 else keys, kind="stable")


def exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each row (in place) and their sum. Logits count within 60 of 0, so neither can be 0 or infinite."""
    np.clip(logits, -60, 60, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], np.float32)


def off_by(parts: np.ndarray, norm: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Gradient of the log-probabilities of ``choice`` by the logits, in place of the exponentials."""
    parts *= (-1 / norm)[:, None]
    parts[np.arange(len(parts)), choice] += 1
    return parts


class Gru:
    """Parameters and one window forward and backward. Inputs: head words, the unlisted word, the start,
    the vectors that words of small classes share. Outputs: the class; in a class of the head, the word;
    for other listed words, the group of small classes and then the small class.
    """

    def __init__(self, words: Words, cfg: LmConfig, flat: np.ndarray | None = None):
        h, k, c = cfg.hidden, words.head, cfg.classes + 1 + (words.deep > 0)
        self.words, self.cfg = words, cfg
        self.inputs = k + 2 + (cfg.shared if words.deep else 0)
        shapes = {"x": (self.inputs, 3 * h), "u": (h, 3 * h), "wc": (h, c), "bc": (c,), "ww": (h, k), "bw": (k,)}
        if words.deep:
            shapes |= {"wa": (1, h + 1, words.top), "wb": (words.top, h + 1, words.fan)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        if flat is None:
            rng = np.random.default_rng(cfg.seed)
            flat = rng.normal(0, 0.1, size).astype(np.float32)
        self.flat, self.shapes = flat.astype(np.float32).copy(), shapes
        for name, part in self.parts_of(self.flat).items():
            setattr(self, name, part)

    def parts_of(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of one array of the model's size, by parameter."""
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start_from_counts(self) -> Gru:
        self.bc[:] = self.words.class_bias - self.words.class_bias.max()
        for a, b in zip(self.words.first, self.words.first[1:]):
            self.bw[a:b] = self.words.word_bias[a:b] - self.words.word_bias[a:b].max(initial=0)
        if self.words.deep:
            for part, bias in zip((self.wa, self.wb), self.words.tree_bias):
                bias = bias.reshape(part.shape[0], part.shape[2])
                part[:, -1] = bias - bias.max(1, keepdims=True)
        return self

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None):
        """Natural-log probability of each target (of the class of all unlisted words for these); with
        gradients, also that of the states. Words of a small class have add-one shares of it.

        Rows are sorted by class, and by group of small classes, so each one's rows are one product.
        """
        words, c = self.words, self.cfg.classes
        key = np.append(words.class_of, c)[np.minimum(targets, words.head)]
        deep = targets > words.head
        if words.deep:
            small = (targets - words.head - 2) // SMALL
            key = np.where(deep, c + 1 + small // words.fan, key)
        order = sorted_order(key, c + 1 + (words.top if words.deep else 0))
        states, targets, key = states[order], targets[order], key[order]
        edges = np.searchsorted(key, np.arange(c + 2))
        every, cls = np.arange(len(key)), np.minimum(key, c + 1)
        parts, norm = exponentials(states @ self.wc + self.bc)
        logp, back = np.log(parts[every, cls] / norm), None
        if grads is not None:
            off = off_by(parts, norm, cls)
            grads["wc"] += states.T @ off
            grads["bc"] += off.sum(0)
            back = off @ self.wc.T
        for i in range(c):
            (a, b), (low, high) = edges[i : i + 2], words.first[i : i + 2]
            if a == b or high - low < 2:
                continue
            own, part, at = states[a:b], self.ww[:, low:high], targets[a:b] - low
            parts, norm = exponentials(own @ part + self.bw[low:high])
            logp[a:b] += np.log(parts[np.arange(b - a), at] / norm)
            if grads is not None:
                off = off_by(parts, norm, at)
                grads["ww"][:, low:high] += own.T @ off
                grads["bw"][low:high] += off.sum(0)
                back[a:b] += off @ part.T
        if edges[c + 1] < len(key):
            self._small_classes(states, targets, key, edges[c + 1], logp, back, grads)
        unsorted = np.empty_like(logp)
        unsorted[order] = logp
        if grads is not None:
            back[order] = back.copy()
        return unsorted, back

    def _small_classes(self, states, targets, key, first: int, logp, back, grads: dict | None):
        """Add the choices of group and small class, and the word's share, to the rows from ``first`` on."""
        words, leaf, group = self.words, targets[first:] - self.words.head - 2, key[first:] - self.cfg.classes - 1
        own = np.ones((len(leaf), states.shape[1] + 1), np.float32)
        own[:, :-1] = states[first:]
        edges = np.r_[np.flatnonzero(np.diff(group, prepend=-1)), len(group)]
        inside = np.empty((len(leaf), words.fan), np.float32)
        for a, b in zip(edges, edges[1:]):
            inside[a:b] = own[a:b] @ self.wb[group[a]]
        every, place = np.arange(len(leaf)), leaf // SMALL % words.fan
        outer, outer_norm = exponentials(own @ self.wa[0])
        inside, inside_norm = exponentials(inside)
        logp[first:] += words.share_log[leaf] + np.log(outer[every, group] / outer_norm * (inside[every, place] / inside_norm))
        if grads is None:
            return
        off = off_by(outer, outer_norm, group)
        grads["wa"][0] += own.T @ off
        back[first:] += off @ self.wa[0, :-1].T
        off = off_by(inside, inside_norm, place)
        for a, b in zip(edges, edges[1:]):
            grads["wb"][group[a]] += own[a:b].T @ off[a:b]
            back[first + a : first + b] += off[a:b] @ self.wb[group[a], :-1].T

    def run(self, state, inputs, fresh, saved: list | None = None):
        """States after each of ``inputs[t, lane]``, and the last one; ``saved`` takes what learning needs."""
        h, (steps, lanes) = self.cfg.hidden, inputs.shape
        # the three gates lie apart, so that each one's numbers are in one run
        if inputs.size < self.inputs:  # a window of few lanes needs few of the input vectors
            xs = np.ascontiguousarray(self.x[inputs].reshape(steps, lanes, 3, h).transpose(2, 0, 1, 3))
        else:
            xs = np.take(np.ascontiguousarray(self.x.reshape(-1, 3, h).transpose(1, 0, 2)), inputs, axis=1)
        states = np.empty((steps, lanes, h), np.float32)
        for t in range(steps):
            prev = state * (1 - fresh[t])[:, None]
            rec = (prev @ self.u).reshape(lanes, 3, h).transpose(1, 0, 2)
            z, r = sigmoid(np.add(xs[:2, t], rec[:2], out=np.empty((2, lanes, h), np.float32)))
            rec_n = np.ascontiguousarray(rec[2])
            new = r * rec_n
            new += xs[2, t]
            np.tanh(new, out=new)
            state = np.subtract(prev, new, out=states[t])
            state *= z
            state += new
            if saved is not None:
                saved.append((prev, rec_n, z, r, new))
        return states, state

    def inputs_of(self, numbers):
        """Rows of the input vectors: words of small classes share ``shared`` of them."""
        start = self.words.head + 2
        return np.where(numbers < start, numbers, start + (numbers - start) % self.cfg.shared)

    def window(self, state, inputs, fresh, targets, live, learn: bool):
        """Run ``inputs[t, lane]``; returns log-probabilities, the last state and, when learning, the
        gradient (truncated at the window's start) of the live targets' sum."""
        h, (steps, lanes) = self.cfg.hidden, inputs.shape
        inputs, saved = self.inputs_of(inputs), [] if learn else None
        states, state = self.run(state, inputs, fresh, saved)
        grad = np.zeros_like(self.flat) if learn else None
        grads = self.parts_of(grad) if learn else None
        chosen = np.flatnonzero(live.ravel())
        logp, back = self.outputs(states.reshape(-1, h)[chosen], targets.ravel()[chosen], grads)
        if not learn:
            return logp, state, None
        to_state = np.zeros((steps * lanes, h), np.float32)
        to_state[chosen] = back
        to_state = to_state.reshape(steps, lanes, h)
        recs, news = np.empty((steps, lanes, 3 * h), np.float32), np.empty((steps, lanes, h), np.float32)
        carry, turned = np.zeros((lanes, h), np.float32), np.ascontiguousarray(self.u.T)
        for t in range(steps - 1, -1, -1):
            prev, rec_n, z, r, new = saved[t]
            d, rest = to_state[t] + carry, 1 - z
            dn, slope = np.multiply(d, rest, out=news[t]), new * new
            dn *= np.subtract(1, slope, out=slope)
            dz = prev - new
            dz *= d
            dz *= z
            dz *= rest
            dr = dn * rec_n
            dr *= r
            dr *= np.subtract(1, r, out=rest)
            rec = recs[t]
            rec[:, :h], rec[:, h : 2 * h] = dz, dr
            np.multiply(dn, r, out=rec[:, 2 * h :])
            d *= z
            d += rec @ turned
            carry = d * (1 - fresh[t])[:, None]
        recs = recs.reshape(-1, 3 * h)
        grads["u"][:] = np.concatenate([s[0] for s in saved]).T @ recs
        flat_in = inputs.ravel()
        order = sorted_order(flat_in, self.inputs)
        starts = np.flatnonzero(np.r_[True, np.diff(flat_in[order]) > 0])
        gates = recs[order]
        gates[:, 2 * h :] = news.reshape(-1, h)[order]
        grads["x"][flat_in[order][starts]] = np.add.reduceat(gates, starts)
        return logp, state, grad


def lanes_of(docs: list[np.ndarray], cfg: LmConfig) -> list[list[int]]:
    """Documents dealt to lanes, longest first onto the shortest lane; lanes by falling length."""
    n_lanes = max(1, min(cfg.lanes, len(docs)))
    heap, placed, loads = [(0, i) for i in range(n_lanes)], [[] for _ in range(n_lanes)], [0] * n_lanes
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        load, lane = heap[0]
        loads[lane] = load + len(docs[d])
        heapq.heapreplace(heap, (loads[lane], lane))
        placed[lane].append(d)
    return [placed[i] for i in sorted(range(n_lanes), key=lambda i: -loads[i])]


def _runs(docs: list[np.ndarray], words: Words, cfg: LmConfig, leads: list[int] | None = None):
    """Windows over packed documents: inputs, start marks, targets, document numbers of active lanes
    (-1 behind a lane's end).

    ``leads``: the input before each one's first token, where that isn't the start. Lanes lie behind
    each other in flat arrays, so memory follows the tokens, however much longer one lane is.
    """
    lanes = lanes_of(docs, cfg)
    order = [d for lane in lanes for d in lane]
    sizes = np.array([len(docs[d]) for d in order])
    flat = np.concatenate([docs[d] for d in order])
    number = np.repeat(np.array(order, np.int32), sizes)
    starts = np.cumsum(sizes) - sizes
    fresh = np.zeros(len(flat), np.float32)
    fresh[starts] = 1
    before = np.r_[flat[:1], flat[:-1]]
    before[starts] = np.array(leads)[order] if leads else words.head + 1
    ends = np.cumsum([sum(len(docs[d]) for d in lane) for lane in lanes])
    lengths = np.diff(ends, prepend=0)
    for start in range(0, int(lengths[0]), cfg.window):
        active = int((lengths > start).sum())
        step = np.arange(start, min(start + cfg.window, int(lengths[0])))[:, None]
        live = step < lengths[:active]
        at = np.where(live, (ends - lengths)[:active] + step, 0)
        yield np.where(live, before[at], 0), fresh[at] * live, np.where(live, flat[at], 0), np.where(live, number[at], -1)


def _coded(texts: pa.Array, words: Words, listed: pa.Array) -> list[np.ndarray]:
    """The numbers of every text's tokens."""
    return [c for tokens, sizes in token_arrays(texts) for c in np.split(words.numbers(tokens, listed), np.cumsum(sizes)[:-1])]


def _coded_with_rare(texts: pa.Array, words: Words, listed: pa.Array) -> tuple[list[np.ndarray], pa.ListArray]:
    """The numbers of every text's tokens, and its unlisted words with how often it has each."""
    codes, rare, times, held = [], [], [], [np.zeros(1, np.int64)]
    for tokens, sizes in token_arrays(texts):
        numbers, ends = words.numbers(tokens, listed), np.cumsum(sizes)
        codes += np.split(numbers, ends[:-1])
        at = np.flatnonzero(numbers == words.head)
        found = tokens.take(pa.array(at)).dictionary_encode()
        many = max(1, len(found.dictionary))
        pairs, n = np.unique(np.searchsorted(ends, at, "right") * many + found.indices.to_numpy(), return_counts=True)
        rare.append(found.dictionary.take(pa.array(pairs % many)))
        times.append(n)
        held.append(np.bincount(pairs // many, minlength=len(ends)))
    met = [pa.concat_arrays(rare), pa.array(np.concatenate(times), pa.int64())] if rare else [pa.array([], pa.binary()), pa.array([], pa.int64())]
    ends = np.cumsum(np.concatenate(held))
    return codes, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(met, ["word", "m"]))


def train_round(docs: DataFrame, words: Words, cfg: LmConfig, flat: np.ndarray) -> np.ndarray:
    """One pass over ``docs(_raw)``: every task learns from its rows, starting from ``flat``; the
    token-weighted mean of the tasks' parameters comes back.

    Parameters travel in blocks; a block's copies are summed in salted groups first, so no task and no
    driver holds the parameters of all tasks.
    """
    block = 65_536

    def learn(batches):
        model, listed = Gru(words, cfg, flat), words.listed()
        squares, seen = np.full_like(model.flat, cfg.damping), 0
        for batch in batches:
            docs = _coded(batch.column("_raw"), words, listed)
            # long texts are learned from in pieces side by side, so that no window has few lanes
            cuts = [(d, i) for d in docs for i in range(0, len(d), cfg.piece)]
            pieces = [d[i : i + cfg.piece] for d, i in cuts]
            leads = [int(d[i - 1]) if i else words.head + 1 for d, i in cuts]
            state = None
            for inputs, fresh, target, number in _runs(pieces, words, cfg, leads) if pieces else ():
                lanes = inputs.shape[1]
                state = np.zeros((lanes, cfg.hidden), np.float32) if state is None else state[:lanes]
                _, state, grad = model.window(state, inputs, fresh, target, number >= 0, True)
                many = int((number >= 0).sum())
                grad /= cfg.lanes * cfg.window  # a window of few lanes counts for less
                seen += many
                step = grad * grad
                squares += step
                grad *= cfg.rate
                grad /= np.sqrt(squares, out=step)
                model.flat += grad
        if seen:
            blocks = [(model.flat[i : i + block] * np.float32(seen)).tobytes() for i in range(0, len(model.flat), block)]
            n, salt = len(blocks), int(abs(float(model.flat.sum())) * 1e6) % cfg.average_salts
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([float(seen)] * n), pa.array(blocks, pa.binary())], ["block", "salt", "seen", "total"])

    def add(table):
        total = sum(np.frombuffer(b, np.float32) for b in table.column("total").to_pylist())
        seen = sum(table.column("seen").to_pylist())
        return pa.table({"block": table.column("block")[:1], "salt": pa.array([0], pa.int32()), "seen": pa.array([seen]), "total": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, salt int, seen double, total binary"
    parts = docs.select("_raw").coalesce(words.n // cfg.task_tokens + 1).mapInArrow(learn, schema)
    summed = parts.groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    rows = sorted(summed.collect(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["total"], np.float32) / r["seen"] for r in rows]).astype(np.float32) if rows else flat


def in_training(doc_id):
    """Documents learned from: crc32 of the id's digits has a remainder other than 2 by 7."""
    return ~held_out(doc_id)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@dataclass(frozen=True)
class Trained:
    """A trained model: the counts of all training words (a table), what tasks know of them, and the parameters."""

    counts: DataFrame
    words: Words
    flat: np.ndarray
    cfg: LmConfig


def fit(docs: DataFrame, cfg: LmConfig = LmConfig()) -> Trained:
    """Count and learn from all of ``docs(doc_id, _raw)``: one pass, an eighth of the documents first, then the
    rest from the mean of the tasks' parameters."""
    counts = materialize(count_words(docs))
    words = Words(counts, cfg)
    flat = Gru(words, cfg).start_from_counts().flat
    early = F.pmod(F.xxhash64("doc_id"), F.lit(cfg.first_share)) == 0
    for part in (early, ~early):
        flat = train_round(docs.where(part), words, cfg, flat)
    return Trained(counts, words, flat, cfg)


def score_documents(docs: DataFrame, cfg: LmConfig = LmConfig()) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs(doc_id, text, ...)``.

    The counts of all training words are gathered by one aggregation. The model: a gated recurrent
    network reads the words; the softmax is factored into classes of words. The most frequent ``head``
    words are in classes of equal shares of the square root of frequency, with a softmax over the state
    inside each. The other listed words, by falling count, are in small classes of 256 that the state
    chooses in two steps, and have add-one shares of theirs. Words beyond the ``listed`` ones form one
    class with add-one shares, unknown words taking the place of one more word, so probabilities sum to
    1. Training is truncated backpropagation in numpy over every training document, once; the state goes
    on from window to window, and starts empty again every ``piece`` tokens of a long text. Scoring
    carries it through the whole document and sums log10 probabilities.

    ``base_score`` is the add-one unigram score. Words outside the list that tasks carry meet their
    counts in a join, counted once per document first. Rows without doc_id are training rows. Null and
    empty texts are just an end. Without training rows all words are unknown. Repeated rows are scored
    each; extra columns are ignored; an empty table gives an empty table.
    """
    slim = common.small_batches(docs, 4000).select(F.monotonically_increasing_id().alias("row"), "doc_id", common.as_bytes("text").alias("_raw"))
    return score_rows(slim, fit(slim.where(in_training(F.col("doc_id"))), cfg))


def _scored(model: Gru, held: list, docs: int) -> np.ndarray:
    """Sum of natural-log probabilities by document over ``(states, targets, document numbers)``."""
    states, targets, numbers = (np.concatenate(part) for part in zip(*held))
    return np.bincount(numbers, model.outputs(states, targets, None)[0], docs)


def score_rows(slim: DataFrame, model: Trained) -> DataFrame:
    """The columns of ``score_documents`` for ``slim(row, doc_id, _raw)``; ``row`` tells rows apart."""
    counts, words, flat, cfg = model.counts, model.words, model.flat, model.cfg
    logs = np.log10(words.counts + 1)
    rest_log = float(np.log10(words.n + words.v + 1))

    def score(batches):
        model, listed = Gru(words, cfg, flat), words.listed()
        unlisted = words.head
        listed_logs = np.r_[logs[: words.head], 0.0, 0.0, logs[words.head :]]
        for batch in batches:
            codes, rare = _coded_with_rare(batch.column("_raw"), words, listed)
            total = np.zeros(len(codes))
            state, held, size = None, [], 0
            for inputs, fresh, target, number in _runs(codes, words, cfg) if codes else ():
                lanes, live = inputs.shape[1], number >= 0
                state = np.zeros((lanes, cfg.hidden), np.float32) if state is None else state[:lanes]
                states, state = model.run(state, model.inputs_of(inputs), fresh)
                held.append((states[live], target[live], number[live]))
                size += len(held[-1][2])
                if size >= SCORED:  # behind the shorter lanes' ends windows are small
                    total += _scored(model, held, len(codes))
                    held, size = [], 0
            if held:
                total += _scored(model, held, len(codes))
            known = [int((c != unlisted).sum()) for c in codes]
            base = [float(listed_logs[c].sum()) - len(c) * rest_log for c in codes]
            full = [float(t / np.log(10) - (len(c) - k) * words.tail_log) for t, c, k in zip(total, codes, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([len(c) for c in codes], pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(full), rare],
                ["row", "doc_id", "n_tokens", "known", "base", "full", "rare"],
            )

    kind = dict(slim.dtypes)["doc_id"]
    scanned = materialize(slim.mapInArrow(score, f"row long, doc_id {kind}, n_tokens long, known long, base double, full double, rare array<struct<word:binary,m:long>>"))
    rare = scanned.select("row", F.inline("rare"))
    met = rare.join(counts, "word").groupBy("row").agg(
        F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("logs")
    )
    out = scanned.drop("rare").join(met, "row", "left").fillna(0, ["more", "logs"])
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"), (F.col("base") + F.col("logs")).alias("base_score"), (F.col("full") + F.col("logs")).alias("score"),
    )
