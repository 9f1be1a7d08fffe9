"""Document log-likelihood by a gated recurrent language model in numpy.

Tokens are words (runs between ASCII blanks, A-Z lowered) and one end per text. All training texts are counted. The HEAD most frequent
tokens are symbols of their own; the next MID that came more than once fall into letter-alike groups; all others, known or not, are the rest. A GRU reads the
symbols of a whole text, its state carried from window to window. The output is factored: a softmax over classes (CLASSES
of letter-alike head tokens, the groups, the rest); within a class of head tokens a second softmax; within a group the tokens' share of its counts; within
the rest a word's share of the counts, or, for a word never seen, an equal share of what Good and Turing leave to the unseen: the number of unseen words is
Chao's estimate f1 (f1 - 1) / (2 (f2 + 1)) from the words seen once and twice. So the probabilities of all words, seen and unseen, add up to one.

Texts are split and looked up as Arrow columns, without a Python object for a token; each gate has its own contiguous matrix, and scores of classes are made for as many states as stay in a core's cache.

Training: truncated backpropagation over windows, in every task on a stream of all its training texts, each once, CHUNK tokens at a time, starting from the
same weights; the tasks' weights are averaged. Every training text teaches in one of ROUNDS such rounds, by hash. Words seen once are the rest there, as
unseen ones are later; for scoring the rest's bias is raised to the share that it has in new text. Scoring is one narrow pass; only rare words are shuffled, to meet
their counts. At no point does anything that grows with the corpus reach the driver: it sees HEAD + MID words and averaged weights.

Null and empty texts have the end as their one token. Without training texts all words are unknown. Very long texts are read whole. Repeated rows are scored each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import documents, stash

END = b"\n"  # no word
HEAD, CLASSES, MID, GROUPS = 2048, 64, 200_000, 24
STATE, WINDOW, LANES = 24, 20, 512
CHUNK, ROUNDS, RATES = 1_000_000, 2, (0.01, 0.004)
CACHED = 1024  # states whose class scores stay in a core's cache
TEXTS, STATES = 4000, 16_384  # that are scored together


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of strings, one text after the other, and how many each has: tokens() without a Python object for each, and without the ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, edges = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at either end of a text leave an empty one
    if not real.all():
        words, edges = words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[edges]
    return words, np.diff(edges)


_GATES = np.arange(3)[:, None]


class Gru:
    """Weights as one float32 vector with named views."""

    taught = 0  # tokens

    def __init__(self, inputs: int, classes: int, flat: np.ndarray | None = None):
        h, per = STATE, HEAD // CLASSES
        self.sizes = {"e": (inputs, 3 * h), "u": (h, 3 * h), "wc": (h, classes), "bc": (classes,), "wv": (CLASSES, h, per), "bv": (CLASSES, per)}
        total = sum(int(np.prod(s)) for s in self.sizes.values())
        if flat is None:
            rng = np.random.Generator(np.random.PCG64(9))
            flat = (rng.normal(size=total) * 0.1).astype(np.float32)
        self.flat, at = flat, 0
        for name, shape in self.sizes.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    def like(self, flat: np.ndarray) -> Gru:
        return Gru(self.sizes["e"][0], self.sizes["wc"][1], flat)

    def recurrent(self) -> np.ndarray:
        """u as one matrix for each gate."""
        return np.ascontiguousarray(self.u.reshape(STATE, 3, STATE).transpose(1, 0, 2))

    def step(self, h: np.ndarray, x: np.ndarray, u: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """New states, gates and what the gradient needs; u is recurrent(), where there are many steps. Each gate has its own contiguous matrix."""
        g, s = self.e.reshape(-1, STATE).take(3 * x + _GATES, axis=0), np.matmul(h, self.recurrent() if u is None else u)
        zr, un = g[:2], s[2]
        zr += s[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr
        n = r * un
        n += g[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, un

    def log_probs(self, h: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: Gru | None = None, dh: np.ndarray | None = None) -> np.ndarray:
        """Natural log of P(class) and, for head classes, of P(word in class), for each state; with grads also the gradient of their negative mean."""
        size, k = h.shape
        one = np.ones((size, k + 1), dtype=h.dtype)  # the biases' input beside the state
        one[:, :k] = h
        w, small, out = np.vstack([self.wc, self.bc]), self._small(self.wc, self.bc), np.empty(size, dtype=h.dtype)
        ones, back, gw = np.ones(w.shape[1], dtype=h.dtype), np.ascontiguousarray(self.wc.T), np.zeros_like(w)
        room, begins = np.empty((min(size, CACHED), w.shape[1]), dtype=h.dtype), np.arange(min(size, CACHED)) * w.shape[1]
        for lo in range(0, size, CACHED):
            x = one[lo : lo + CACHED]
            p, at = np.matmul(x, w, out=room[: len(x)]), begins[: len(x)] + cls[lo : lo + CACHED]
            if not small:
                p -= p.max(axis=1, keepdims=True)
            flat = p.reshape(-1)
            picked = flat.take(at)
            np.exp(p, out=p)
            total = p @ ones
            out[lo : lo + CACHED] = picked - np.log(total)
            if grads is not None:
                p *= (1 / (total * size))[:, None]
                flat[at] -= 1 / size
                gw += x.T @ p
                dh[lo : lo + CACHED] += p @ back
        head = np.flatnonzero(cls < CLASSES)
        order = head[np.argsort(cls[head].astype(np.int16), kind="stable")]
        edges, x_all, per = np.searchsorted(cls[order], np.arange(CLASSES + 1)), one.take(order, axis=0), self.wv.shape[2]
        at_all = (np.arange(len(order)) - np.repeat(edges[:-1], np.diff(edges))) * per + word[order]  # in the matrix of its class
        gain, sums_all = np.empty((2, len(order)), dtype=h.dtype)
        back_all = np.empty((len(order), k), dtype=h.dtype) if grads is not None else None
        w, small, ones = np.concatenate([self.wv, self.bv[:, None, :]], axis=1), self._small(self.wv, self.bv), np.ones(per, dtype=h.dtype)
        room = np.empty((int(np.diff(edges).max()), per), dtype=h.dtype)
        for c in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[c], edges[c + 1])
            x, at = x_all[own], at_all[own]
            q = np.matmul(x, w[c], out=room[: len(x)])
            if not small:
                q -= q.max(axis=1, keepdims=True)
            flat = q.reshape(-1)
            flat.take(at, out=gain[own], mode="clip")
            np.exp(q, out=q)
            sums = np.matmul(q, ones, out=sums_all[own])
            if grads is not None:
                q *= (1 / (sums * size))[:, None]
                flat[at] -= 1 / size
                g = x.T @ q
                grads.wv[c] += g[:k]
                grads.bv[c] += g[k]
                np.matmul(q, self.wv[c].T, out=back_all[own])
        out[order] += gain - np.log(sums_all)
        if grads is not None:
            grads.wc += gw[:k]
            grads.bc += gw[k]
            dh[order] += back_all
        return out

    @staticmethod
    def _small(w: np.ndarray, b: np.ndarray) -> bool:
        """Whether no sum of a state (within -1 and 1) with these weights leaves what a 32-bit exponential can show."""
        return bool((np.abs(w).sum(axis=-2) + np.abs(b)).max() < 80)


def train(model: Gru, texts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], end: int, chunk: int = CHUNK, rate: float = RATES[0]) -> tuple[Gru, int]:
    """Continue from the model's weights on a stream of encoded texts (inputs, classes, words); also the number of tokens in it.

    Texts follow each other in lanes, the state starts anew after an end. No more than a chunk and one text are held; a stream shorter than a chunk is gone through again.
    """
    rng = np.random.Generator(np.random.PCG64(4))
    model = model.like(model.flat.copy())
    m, v, t = np.zeros_like(model.flat), np.zeros_like(model.flat), 0
    k = STATE

    def learn(part: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        nonlocal m, v, t
        order = rng.permutation(len(part))
        x, cls, word = (np.concatenate([part[i][j] for i in order]) for j in range(3))
        size = len(x)
        lanes = min(size, max(8, min(LANES, size // (80 * WINDOW))))  # so a short stream has many steps too
        steps = -(-size // lanes)
        x = np.pad(x, (0, steps * lanes - size), constant_values=end)
        cls, word = (np.pad(a, (0, steps * lanes - size)) for a in (cls, word))
        x, cls, word, real = (a.reshape(lanes, steps).T for a in (x, cls, word, np.arange(steps * lanes) < size))
        h = np.zeros((lanes, k), dtype=np.float32)
        grads = model.like(np.empty_like(model.flat))
        g, root = np.empty_like(model.flat), np.empty_like(model.flat)
        for s in range(0, steps, WINDOW):
            xs, keep = x[s : s + WINDOW], (x[s : s + WINDOW] != end).astype(np.float32)[:, :, None]
            n, cache, u = len(xs), [], model.recurrent()
            states = np.empty((n, lanes, k), dtype=np.float32)
            for i in range(n):
                states[i] = h
                new, *rest = model.step(h, xs[i], u)
                cache.append(rest)
                h = new * keep[i]
            hs = states.reshape(-1, k)
            grads.flat[:] = 0
            on = np.flatnonzero(real[s : s + n])  # what fills up the last lane teaches nothing
            dh, own = np.zeros_like(hs), np.zeros((len(on), k), dtype=np.float32)
            model.log_probs(hs[on], cls[s : s + n].ravel()[on], word[s : s + n].ravel()[on], grads, own)
            dh[on] = own
            dh, carry = dh.reshape(n, lanes, k), np.zeros((lanes, k), dtype=np.float32)
            dgs, dus = (np.empty((3, n, lanes, k), dtype=np.float32) for _ in range(2))
            turned = np.ascontiguousarray(u.transpose(0, 2, 1))
            for i in range(n - 1, -1, -1):
                z, r, c, un = cache[i]
                dz, dr, dn = dgs[:, i]
                d = carry * keep[i]
                rest = 1 - z
                np.multiply(d, rest, out=dn)
                np.subtract(states[i], c, out=dz)
                dz *= d
                dz *= z
                dz *= rest
                np.multiply(c, c, out=rest)
                np.subtract(1, rest, out=rest)
                dn *= rest
                np.subtract(1, r, out=dr)
                dr *= r
                dr *= un
                dr *= dn
                dus[:2, i] = dgs[:2, i]
                np.multiply(dn, r, out=dus[2, i])
                d *= z
                for part_of in np.matmul(dus[:, i], turned):
                    d += part_of
                d += dh[i]
                carry = d
            grads.u += np.concatenate([hs.T @ a.reshape(-1, k) for a in dus], axis=1)
            order_x = np.argsort(xs.astype(np.int16), axis=None, kind="stable")
            kinds, firsts = np.unique(xs.ravel()[order_x], return_index=True)
            by_input = dgs.reshape(-1, k).take(order_x[:, None] + n * lanes * _GATES.T, axis=0).reshape(-1, 3 * k)
            grads.e[kinds] = np.add.reduceat(by_input, firsts, axis=0)
            t += 1
            np.clip(grads.flat, -1, 1, out=g)
            m *= 0.9
            v *= 0.99
            m += np.multiply(g, 0.1, out=root)
            g *= g
            g *= 0.01
            v += g
            np.sqrt(v, out=root)
            root /= (1 - 0.99**t) ** 0.5
            root += 1e-6
            np.divide(m, root, out=g)
            g *= rate / (1 - 0.9**t)
            model.flat -= g

    part, size, total = [], 0, 0
    for text in texts:
        part.append(text)
        size += len(text[0])
        if size >= chunk:
            learn(part)
            part, size, total = [], 0, total + size
    if part:
        learn(part)
    return model, total + size


@dataclass
class Vocabulary:
    """What tasks need to know of the counted tokens; index -1 is the rest."""

    index: dict[bytes, int]
    symbol: np.ndarray  # input of the GRU; this and the next two have one entry more, for the rest
    cls: np.ndarray
    word: np.ndarray  # place in a head class
    within: np.ndarray  # log10 of the share in a group
    base: np.ndarray  # log10 of the add-one share of all
    total: int
    distinct: int
    rare_total: int
    known_share: float  # of the rest's tokens in new text, those of words that were seen
    unseen: float  # words
    rest_share: float  # of the tokens of new text

    @property
    def rest(self) -> int:
        return HEAD + GROUPS

    @cached_property
    def end(self) -> int:
        """Place of the end, -1 without training texts."""
        return pc.index(self.words, pa.scalar(END, pa.binary())).as_py()

    @cached_property
    def words(self) -> pa.Array:
        """The keys of the index, by place."""
        return pa.array(sorted(self.index, key=self.index.get), pa.binary())

    def __getstate__(self) -> dict:
        """Tasks get the words as one array."""
        return {**self.__dict__, "words": self.words, "index": None}


def _groups(words: list[bytes], counts: np.ndarray, groups: int) -> np.ndarray:
    """Letter-alike groups: k-means on the words' shares of bytes and byte pairs."""
    b = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    inner = of[:-1] == of[1:]
    pair = (b[:-1] * 31 + b[1:]) % 32
    x = np.bincount(np.concatenate([64 * of + 32 + b % 32, 64 * of[:-1][inner] + pair[inner]]), minlength=64 * len(words)).reshape(-1, 64).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    rng = np.random.Generator(np.random.PCG64(2))
    centre = x[rng.choice(len(x), min(groups, len(x)), replace=False)]
    got = np.zeros(len(x), dtype=np.int64)
    for _ in range(12):
        got = (x @ centre.T).argmax(axis=1)
        for g in range(len(centre)):
            if (got == g).any():
                c = (x[got == g] * np.sqrt(counts[got == g])[:, None]).sum(axis=0)
                centre[g] = c / (np.linalg.norm(c) + 1e-9)
    return got


def _count(batches):
    for batch in batches:
        found = split(batch.column(0))[0].value_counts()
        yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([batch.num_rows], pa.int64())], ["word", "n"])


def count(docs: DataFrame) -> DataFrame:
    """(word, n), stored."""
    return stash(docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).first()
    top = counts.where((F.col("n") > 1) | (F.col("word") == F.lit(END))).orderBy(F.desc("n"), "word").limit(HEAD + MID).toArrow()
    words, n = top["word"].to_pylist(), top["n"].to_numpy().astype(np.float64)
    if END in words:  # always a head token, and the first
        at = words.index(END)
        words, n = [words[at], *words[:at], *words[at + 1 :]], np.concatenate([n[at : at + 1], n[:at], n[at + 1 :]])
    size, head = len(words), min(HEAD, len(words))
    symbol, cls, word, within = np.arange(size, dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(size)
    if head:
        place = np.empty(head, dtype=np.int32)  # letter-alike words stand together
        place[np.argsort(_groups(words[:head], n[:head], GROUPS), kind="stable")] = np.arange(head)
        cls[:head], word[:head] = place // (HEAD // CLASSES), place % (HEAD // CLASSES)
    if size > HEAD:
        g = _groups(words[HEAD:], n[HEAD:], GROUPS)
        symbol[HEAD:], cls[HEAD:] = HEAD + g, CLASSES + g
        within[HEAD:] = np.log10(n[HEAD:] / np.bincount(g, weights=n[HEAD:], minlength=GROUPS)[g])
    rare_total = int(total - n.sum())
    # what new text has of the rest: words seen twice or more but not named, words seen once (they come with twice's frequency), words never seen
    named_twice = 0 if size == HEAD + MID else twice
    seen_mass, unseen_mass = rare_total - once + 2 * named_twice, once
    known = seen_mass / (seen_mass + unseen_mass) if rare_total and seen_mass + unseen_mass else 0.0
    unseen = max(1.0, once * (once - 1) / (2 * (twice + 1)))
    return Vocabulary(
        {w: i for i, w in enumerate(words)}, np.append(symbol, np.int32(HEAD + GROUPS)), np.append(cls, np.int32(CLASSES + GROUPS)), np.append(word, np.int32(0)), within, np.log10((n + 1) / (total + distinct + 1)), int(total), int(distinct), rare_total,
        min(0.99, max(0.0, known)), unseen, min(0.5, (seen_mass + unseen_mass) / total) if total else 0.5,
    )


def _encoded(texts: pa.Array, voc: Vocabulary) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts, the places of all tokens in the vocabulary (-1: the rest), and where each text begins among these, with an end more."""
    words, lengths = split(texts)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    at = np.full(begin[-1], voc.end, dtype=np.int32)
    inner = np.ones(len(at), dtype=bool)
    inner[begin[1:] - 1] = False
    at[inner] = pc.fill_null(pc.index_in(words, value_set=voc.words), -1).to_numpy()
    return words, at, begin


def _streamed(batches: Iterable[pa.RecordBatch], voc: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, classes and words in classes of each text; the last entries of the vocabulary's arrays are the rest's."""
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            _, at, begin = _encoded(b.column(0).slice(lo, 1000), voc)
            codes = voc.symbol[at], voc.cls[at], voc.word[at]
            for first, end in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                yield tuple(c[first:end] for c in codes)


def start(voc: Vocabulary, counts_of: np.ndarray) -> Gru:
    """First weights, with biases that give the counts' shares."""
    model = Gru(HEAD + GROUPS + 1, CLASSES + GROUPS + 1)
    mass = np.bincount(voc.cls[:-1], weights=counts_of, minlength=CLASSES + GROUPS + 1) + 0.5
    mass[-1] += voc.rare_total
    model.bc[:] = np.log(mass / mass.sum())
    head = min(HEAD, len(counts_of))
    model.bv[:] = -30  # no such word
    model.bv[voc.cls[:head], voc.word[:head]] = np.log(counts_of[:head])
    return model


def fit(docs: DataFrame, train_on: Column, voc: Vocabulary) -> Gru:
    """docs: (doc_id, text); all that train_on says may teach do, in one round each; ``taught`` of the result is the number of their tokens."""
    n = np.round(10.0**voc.base * (voc.total + voc.distinct + 1) - 1)
    model = start(voc, np.maximum(n, 1))
    if not voc.total:
        return model
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(voc)
    taught = 0
    for turn in range(ROUNDS):
        drawn = docs.where(train_on).where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(ROUNDS)) == turn)
        now, rate = spark.sparkContext.broadcast(model.flat), RATES[min(turn, len(RATES) - 1)]

        def local(batches, now=now, rate=rate):
            voc = known.value
            own, n = train(Gru(HEAD + GROUPS + 1, CLASSES + GROUPS + 1, now.value), _streamed(batches, voc), int(voc.symbol[0]), rate=rate)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([(own.flat * float(n)).astype(np.float32).tobytes()], pa.binary()), pa.array([float(n)])], ["flat", "weight"])

        def added(batches):
            total, weight = None, 0.0
            for b in batches:
                for flat, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    a = np.frombuffer(flat, dtype=np.float32)
                    total, weight = (a.copy() if total is None else total + a), weight + w
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight])], ["flat", "weight"])

        parts = drawn.select("text").mapInArrow(local, "flat binary, weight double").repartition(8).mapInArrow(added, "flat binary, weight double").collect()
        if parts:
            total = sum(np.frombuffer(p["flat"], dtype=np.float32).astype(np.float64) for p in parts)
            weight = sum(p["weight"] for p in parts)
            model, taught = model.like((total / weight).astype(np.float32)), taught + int(weight)
    model.taught = taught
    # in training the rest was words seen once and words not named; in new text it has another share
    was = max(1, voc.rare_total) / voc.total
    model.bc[-1] += np.log(voc.rest_share / (1 - voc.rest_share)) - np.log(was / max(1e-9, 1 - was))
    return model


def _scored(texts: pa.Array | list[bytes], voc: Vocabulary, model: Gru) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """n_tokens, known, base and score (log10, without the rest's words), and each text's rare words with their counts."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.string())
    words, at, begin = _encoded(texts, voc)
    length, begin = np.diff(begin), begin[:-1]
    of = np.repeat(np.arange(len(length), dtype=np.int32), length)
    total = lambda values: np.add.reduceat(values, begin)
    base, score = (total(np.append(a, 0.0)[at]) for a in (voc.base, voc.within))
    known, rare = total((at >= 0).astype(np.int64)), np.flatnonzero(at < 0)
    # a word lies as many places ahead of its token as there are ends before it; an end that is not known is no word
    ends = np.zeros(len(at), dtype=bool)
    ends[begin + length - 1] = True
    word = ~ends[rare]
    kinds = words.take(pa.array((rare - of[rare])[word])).dictionary_encode()
    code, kinds = np.full(len(rare), len(kinds.dictionary)), pa.DictionaryArray.from_arrays(kinds.indices, pa.concat_arrays([kinds.dictionary, pa.array([END])]))
    code[word] = kinds.indices.to_numpy()
    pair, times = np.unique(of[rare].astype(np.int64) * len(kinds.dictionary) + code, return_counts=True)
    who, code = np.divmod(pair, len(kinds.dictionary))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(length)))]).astype(np.int32)
    rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([kinds.dictionary.take(pa.array(code)), pa.array(times.astype(np.int32))], ["word", "times"]))
    return length, known, base, score + total(_read(at, of, begin, length, voc, model)) / np.log(10), rare


def _read(at: np.ndarray, of: np.ndarray, begin: np.ndarray, length: np.ndarray, voc: Vocabulary, model: Gru) -> np.ndarray:
    """The natural log of each token's probability by the model, as float64, without what a group or the rest says.

    All texts go forward together, long ones first, so that those still unread stand together; tokens lie by step, and states are gathered until there are many to compare with the classes.
    """
    place = np.empty(len(length), dtype=np.int32)
    place[np.argsort(-length, kind="stable")] = np.arange(len(length))
    live = np.searchsorted(np.sort(-length), -np.arange(length.max()), side="left")
    first = np.concatenate([[0], np.cumsum(live)])
    to = first[np.arange(len(at)) - begin[of]] + place[of]  # where a token of a text lies among those by step
    by_step = np.empty_like(at)
    by_step[to] = at
    x, u = voc.symbol[by_step], model.recurrent()
    out, h = np.empty(len(at)), np.zeros((len(length), STATE), dtype=np.float32)
    held, lo = np.empty((STATES + len(length), STATE), dtype=np.float32), 0
    for t, on in enumerate(live.tolist()):
        begins, ends = first[t], first[t + 1]
        h = h[:on]
        held[begins - lo : ends - lo] = h
        if ends - lo >= STATES or t + 1 == len(live):
            own = by_step[lo:ends]
            out[lo:ends] = model.log_probs(held[: ends - lo], voc.cls[own], voc.word[own])
            lo = ends
        h = model.step(h, x[begins:ends], u)[0]
    return out[to]


def score(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row; scores are log10 of the whole text's probability.

    train_on is a condition on ``doc_id``, as the id is called here. The input must be a stable source.
    """
    rows = documents(docs, id_col, text_col)
    counts = count(rows.where(train_on))
    voc = vocabulary(counts)
    model = fit(rows, train_on, voc)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((voc, model.flat))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        voc, flat = known.value
        model = Gru(HEAD + GROUPS + 1, CLASSES + GROUPS + 1, flat)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                n, k, base, score, rare = _scored(part.column(2), voc, model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(base), pa.array(score), rare], ["row", "doc_id", "n_tokens", "known", "base", "model", "rare"])

    source = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = stash(source.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, base double, model double, rare array<struct<word: binary, times: int>>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    share = F.when(c > 0, F.log10(F.lit(voc.known_share) * c / F.lit(float(max(1, voc.rare_total))))).otherwise(F.log10(F.lit((1 - voc.known_share) / voc.unseen)))
    sums = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(voc.total + voc.distinct + 1)))).alias("rare_base"), F.sum(F.col("times") * share).alias("rare_model"))
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return scored.drop("rare").join(sums, "row", "left").select("doc_id", "n_tokens", total("known", "rare_known").alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"), total("base", "rare_base").alias("base_score"), total("model", "rare_model").alias("score"))
