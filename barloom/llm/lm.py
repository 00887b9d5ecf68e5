"""Language-model scoring: a gated recurrent network in numpy with a class-factored softmax.

Spark counts the words of all training texts. The HEAD commonest words (and the end of a text) are predicted one by one:
P(class | state) * P(word | class, state). All other words fall into TAILS further classes by their last two bytes; within
such a class, words have smoothed shares of their counts, with a share for unseen words. So the model is a distribution
over all words, and starts from their plain frequencies.

Training: all training texts, whole, are dealt by a hash of id and text to trainers of about TRAINER_TOKENS tokens, so their
number grows with the input and reruns agree (of rows equal in both, a task sends TOGETHER to one trainer, then goes on to
the next). Each trainer runs truncated backpropagation over windows of WINDOW tokens, WIDTH parts of its stream of documents
side by side, carrying the state from window to window, with Adagrad. Their changes are averaged in a reduction tree of
fan-in FAN_IN, each row of the tables by how often it was used.

Scoring: documents of a batch run in step, the state carried across windows to the end of each whole text. Counts of the
DICTIONARY commonest words are broadcast (the bound on it); rarer words are joined with their counts, and being rare, none
of them is a hot key. Null and empty texts have one token, the end. Null ids and repeated rows are rows like others. An empty table
gives an empty result. The input's other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

HEAD, DICTIONARY = 4_096, 1 << 18
CLASSES, TAILS, ENDINGS = 24, 24, 256
HIDDEN, WINDOW, WIDTH = 12, 16, 1_024
TRAINER_TOKENS = 3_000_000
#: Slices of the averaged tables, how many of a slice meet in a task, and rows of one id and text that a task sends to one trainer.
PARTS, FAN_IN, TOGETHER = 8, 32, 64
#: Documents, or their tokens, that go side by side in scoring; states scored at once.
DOCS, HELD = 8_000, 4_000_000
SCORED = 15_000
RATE, START = 0.3, 1.0  # of Adagrad: the step, and the sum of squares it starts from
END = b""
HALF, ONE = np.float32(0.5), np.float32(1)
LOG10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, then the end. On bytes, lower() and split() do just that."""
    return [*(text or "").encode().lower().split(), END]


def _sum1(x: np.ndarray) -> np.ndarray:
    """Sums by row; a product with ones is the fastest way to them."""
    return x @ np.ones(x.shape[1], x.dtype)


def _sum0(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x), x.dtype) @ x


def _order(codes: np.ndarray) -> np.ndarray:
    """A stable order of codes; two bytes hold them, which numpy sorts by radix."""
    return np.argsort(codes.astype(np.uint16), kind="stable")


class Codes(dict):
    """Codes of words: those of the head as given, others by their ending. Of the others, some are kept."""

    def __init__(self, head: list[bytes], kept: int = 300_000) -> None:
        super().__init__({w: k for k, w in enumerate(head)})
        self.head, self.kept = len(head), len(head) + kept

    def __missing__(self, word: bytes) -> int:
        code = self.head + ending(word)
        if len(self) < self.kept:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Vocabulary:
    head: list[bytes]  # by class
    first: np.ndarray  # of each class, and one more
    tail_tokens: np.ndarray  # by tail class, as tail_words
    tail_words: np.ndarray

    def codes(self) -> Codes:
        return Codes(self.head)

    @property
    def n_codes(self) -> int:
        return len(self.head) + ENDINGS


def vocabulary(counts: list[tuple[bytes, int]], tails: dict[int, tuple[int, int]]) -> tuple[Vocabulary, np.ndarray]:
    """The head words in classes of about equal sums of roots of counts, and the shares of words within their class."""
    counts = sorted(counts, key=lambda x: (-x[1], x[0]))
    c = np.array([n for _, n in counts], float)
    steps = np.cumsum(np.sqrt(c))
    of = np.minimum((steps - np.sqrt(c) / 2) / steps[-1] * min(CLASSES, len(c)), CLASSES - 1).astype(int)
    of = np.unique(of, return_inverse=True)[1]  # no class is empty
    first = np.searchsorted(of, np.arange(of[-1] + 2))
    t = np.array([tails.get(k, (0, 0)) for k in range(TAILS)], float)
    return Vocabulary([w for w, _ in counts], first, t[:, 0], t[:, 1]), c


class Network:
    """Parameters: gates by input code (x), of the state (u), of classes (c, cb) and of words (w, wb)."""

    def __init__(self, voc: Vocabulary, head_counts: np.ndarray, seed: int) -> None:
        rng, h = np.random.default_rng(seed), HIDDEN
        self.voc = voc
        n_class = len(voc.first) - 1
        mass = np.r_[np.add.reduceat(head_counts, voc.first[:-1]), voc.tail_tokens + 0.5 * (voc.tail_words + 1)] if n_class else voc.tail_tokens + 1.0
        inside = head_counts / np.repeat(mass[:n_class], np.diff(voc.first))
        self.p = {
            "x": rng.normal(0, 0.3, (voc.n_codes, 3 * h)), "u": rng.normal(0, 0.4 / math.sqrt(h), (h, 3 * h)), "b": np.r_[np.full(h, 1.0), np.zeros(2 * h)][None],
            "c": rng.normal(0, 0.02, (h, n_class + TAILS)), "cb": np.log(mass / mass.sum())[None], "w": rng.normal(0, 0.02, (len(voc.head), h)), "wb": np.log(inside)[:, None],
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.class_of = np.r_[np.repeat(np.arange(n_class), np.diff(voc.first)), n_class + np.arange(ENDINGS) % TAILS]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after inputs x (rows of the gates' table with the bias added), with the gates and their parts."""
        n = HIDDEN
        s = h @ self.p["u"]
        zr = x[:, : 2 * n] + s[:, : 2 * n]
        zr *= HALF  # a sigmoid by way of tanh
        np.tanh(zr, out=zr)
        zr += ONE
        zr *= HALF
        z, r, own = zr[:, :n], zr[:, n:], s[:, 2 * n :]
        new = np.tanh(x[:, 2 * n :] + r * own)
        return new + z * (h - new), z, r, new, own

    def _exp(self, logits: np.ndarray, bound: float) -> np.ndarray:
        """The exponential in place; where weights are so large that it could overflow, of differences from the largest."""
        if bound > 60:
            logits -= logits.max(1, keepdims=True)
        return np.exp(logits, out=logits)

    def log_probability(self, h: np.ndarray, code: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Of the next codes, by state (natural logarithm; a word of the tail as its class). With grads: also the slope of the loss by state."""
        p, head = self.p, len(self.voc.head)
        e = h @ p["c"]
        e += p["cb"]
        e = self._exp(e, float((np.abs(p["c"]).sum(0) + np.abs(p["cb"][0])).max()))  # states lie within -1 and 1
        flat, total = e.ravel(), _sum1(e)
        at = np.arange(len(h)) * e.shape[1] + np.take(self.class_of, code)
        out = np.log(np.take(flat, at) / total)
        dh = None
        if grads is not None:
            e /= total[:, None]
            flat[at] -= 1
            grads["c"], grads["cb"] = (e.T @ h).T, _sum0(e)[None]
            dh = e @ p["c"].T
        known = np.flatnonzero(code < head)
        known = known[_order(np.take(code, known))]  # codes of a class follow one another
        of, states = np.take(code, known), np.take(h, known, axis=0)
        cuts = np.searchsorted(of, self.voc.first)
        bounds = np.abs(p["w"]).sum(1) + np.abs(p["wb"][:, 0])
        inside, back = np.empty(len(known), np.float32), np.empty_like(states) if grads is not None else None
        for k in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[k], cuts[k + 1]
            lo, hi = self.voc.first[k], self.voc.first[k + 1]
            w, own = p["w"][lo:hi], states[i:j]
            e = own @ w.T
            e += p["wb"][lo:hi, 0]
            e = self._exp(e, float(bounds[lo:hi].max()))
            flat, total = e.ravel(), _sum1(e)
            at = np.arange(j - i) * (hi - lo) + of[i:j] - lo
            inside[i:j] = np.take(flat, at) / total
            if grads is not None:
                e /= total[:, None]
                flat[at] -= 1
                grads["w"].append((lo, hi, e.T @ own, _sum0(e)[:, None]))
                np.matmul(e, w, out=back[i:j])
        out[known] += np.log(inside)
        if grads is not None:
            dh[known] += back
        return out, dh

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each document's codes (the last is the end), state carried to its end."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        n = np.array([len(docs[k]) for k in order])
        codes = np.concatenate([docs[k] for k in order])
        at = np.cumsum(n) - n
        total = np.zeros(len(docs))
        gates = self.p["x"] + self.p["b"]
        live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")  # documents longer than t
        h, last = np.zeros((len(docs), HIDDEN), np.float32), np.full(len(docs), self.end)
        states, nexts, who, rows = [], [], [], 0
        for t, m in enumerate(live.tolist()):
            h = self.step(np.take(gates, last[:m], axis=0), h[:m])[0]
            last = codes[at[:m] + t]
            states.append(h)
            nexts.append(last)
            who.append(m)
            rows += m
            if rows >= SCORED or t == len(live) - 1:  # the states of a window of steps are scored together
                out, _ = self.log_probability(np.concatenate(states), np.concatenate(nexts))
                total += np.bincount(np.concatenate([np.arange(k) for k in who]), out, len(docs))
                states, nexts, who, rows = [], [], [], 0
        back = np.empty(len(docs))
        back[order] = total / LOG10
        return back

    @property
    def end(self) -> int:
        return self.voc.head.index(END) if END in self.voc.head else 0

    def train(self, docs: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Truncated backpropagation through all documents, WIDTH side by side; returns how often each row was used."""
        p, h_, end = self.p, HIDDEN, self.end
        square = {k: np.full_like(v, START) for k, v in p.items()}
        used = {k: np.zeros(len(v), np.float32) for k, v in p.items()}
        stream = np.concatenate([np.zeros(0, np.int64), *docs])
        width = min(WIDTH, max(1, len(stream) // WINDOW))
        n = -(-len(stream) // width)
        codes = np.full(width * n, -1)
        codes[: len(stream)] = stream
        codes = np.ascontiguousarray(codes.reshape(width, n).T)  # equal lengths of the stream of documents side by side
        before = np.r_[np.r_[end, codes[-1, :-1]][None], codes[:-1]] if n else codes
        h = np.zeros((width, h_), np.float32)

        def update(name: str, rows: slice | np.ndarray, grad: np.ndarray) -> None:
            s = square[name][rows] + grad * grad
            square[name][rows] = s
            np.sqrt(s, out=s)
            p[name][rows] -= np.float32(RATE) * grad / s
            used[name][rows] += 1

        for lo in range(0, n, WINDOW):
            inputs = np.maximum(before[lo : lo + WINDOW], 0)
            steps = len(inputs)
            fresh = [np.flatnonzero(x) for x in before[lo : lo + WINDOW] == end]  # a new document starts from an empty state
            x = np.take(p["x"], inputs, axis=0)
            x += p["b"]
            was, z, r, new, own, now = (np.empty((steps, width, h_), np.float32) for _ in range(6))
            for t in range(steps):
                was[t] = h
                was[t][fresh[t]] = 0
                now[t], z[t], r[t], new[t], own[t] = self.step(x[t], was[t])
                h = now[t]
            targets, states = codes[lo : lo + WINDOW].ravel(), now.reshape(-1, h_)
            real = np.flatnonzero(targets >= 0)
            grads: dict = {"w": []}
            if len(real) == len(targets):
                _, slope = self.log_probability(states, targets, grads)
            else:
                slope = np.zeros_like(states)
                _, slope[real] = self.log_probability(states[real], targets[real], grads)
            slope = slope.reshape(now.shape)
            # what the slope of a state makes of each gate's input
            to_new = (1 - z) * (1 - new * new)
            to_z, to_r = (was - new) * z * (1 - z), own * r * (1 - r)
            gates, inner, back = np.empty((steps, width, 3 * h_), np.float32), np.empty((steps, width, 3 * h_), np.float32), np.ascontiguousarray(p["u"].T)
            carry = np.zeros_like(h)
            for t in range(steps - 1, -1, -1):
                d = slope[t]
                d += carry
                dn, g, s = d * to_new[t], gates[t], inner[t]
                np.multiply(d, to_z[t], out=g[:, :h_])
                np.multiply(dn, to_r[t], out=g[:, h_ : 2 * h_])
                g[:, 2 * h_ :] = dn
                s[:, : 2 * h_] = g[:, : 2 * h_]
                np.multiply(dn, r[t], out=s[:, 2 * h_ :])
                carry = s @ back
                d *= z[t]
                carry += d
                carry[fresh[t]] = 0
            flat, gates = inputs.ravel(), gates.reshape(-1, 3 * h_)
            order = _order(flat)
            sorted_ = np.take(flat, order)
            cuts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
            update("x", sorted_[cuts], np.add.reduceat(np.take(gates, order, axis=0), cuts))
            update("b", slice(None), _sum0(gates)[None])
            update("u", slice(None), (inner.reshape(-1, 3 * h_).T @ was.reshape(-1, h_)).T)
            update("c", slice(None), grads["c"])
            update("cb", slice(None), grads["cb"])
            for first, to, dw, db in grads["w"]:
                update("w", slice(first, to), dw)
                update("wb", slice(first, to), db)
        return used


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """word (binary) and how often the texts have it, the end included; added up within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                for text in b.column(0).slice(lo, 500).to_pylist():
                    seen.update(words_of(text))
                if len(seen) > 500_000:
                    yield flush()
                    seen.clear()
        yield flush()

    return df.select(text_col).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _tail_class(word: str) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % ENDINGS % TAILS).cast("int")


@dataclass
class Fitted:
    counts: DataFrame  # of all training words
    n: int
    v: int
    dictionary: list[tuple[bytes, int]]
    network: Network


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Fitted:
    """Counts of all words of df and a network trained on all its texts."""
    counts = materialize(count_words(df, text_col), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = [(bytes(r["word"]), r["c"]) for r in _commonest(counts).collect()]  # DICTIONARY rows at most
    top.sort(key=lambda x: (-x[1], x[0]))
    head = top[:HEAD] if any(w == END for w, _ in top[:HEAD]) or not top else [*top[: HEAD - 1], next(((w, c) for w, c in top if w == END), (END, 1))]
    tails = counts.groupBy(_tail_class("word").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # TAILS rows
    sums = {r["k"]: [r["c"], r["n"]] for r in tails}
    for w, c in head:
        k = ending(w) % TAILS
        if k in sums:
            sums[k] = [sums[k][0] - c, sums[k][1] - 1]
    voc, head_counts = vocabulary(head or [(END, 1)], {k: (max(0, a), max(0, b)) for k, (a, b) in sums.items()})
    net = Network(voc, head_counts, seed)
    _train(df, id_col, text_col, net, n)
    return Fitted(counts, n, v, top, net)


def _commonest(counts: DataFrame) -> DataFrame:
    """The words above the least count (on a scale of 32 steps to a doubling) that at most DICTIONARY words reach."""
    step = F.floor(F.log2("c") * 32).cast("int")
    rows = sorted(counts.groupBy(step.alias("k")).count().collect(), reverse=True)  # a few hundred steps
    n, least = 0, None
    for k, more in rows:
        n += more
        if n > DICTIONARY:
            break
        least = k
    return counts.where(step >= least) if least is not None else counts.limit(0)


def _train(df: DataFrame, id_col: str, text_col: str, net: Network, n_tokens: int) -> None:
    """Training side by side; net gets the averaged parameters."""
    spark = df.sparkSession
    trainers = max(1, round(n_tokens / TRAINER_TOKENS))
    texts = df.select(text_col, F.xxhash64(id_col, text_col).alias("_h"))
    model = spark.sparkContext.broadcast(net)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = model.value.voc.codes(), Counter()
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                rows = [codes.of(words_of(t)) for t in part.column(0).to_pylist()]
                to = []
                for h in part.column(1).to_pylist():
                    to.append((h + seen[h] // TOGETHER) % trainers)
                    seen[h] += 1
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), part.column(1), lists], ["trainer", "h", "codes"])

    def trained(pdf: pd.DataFrame) -> pd.DataFrame:
        net = model.value
        own = Network.__new__(Network)
        own.voc, own.class_of, own.p = net.voc, net.class_of, {k: v.copy() for k, v in net.p.items()}
        used = own.train([np.asarray(c, np.int64) for c in pdf.sort_values("h", kind="stable")["codes"]])
        used = {k: np.repeat(n[:, None], own.p[k].shape[1], 1) for k, n in used.items()}
        change = _flat({k: (own.p[k] - net.p[k]) * used[k] for k in own.p})
        return pd.DataFrame({"node": int(pdf["trainer"].iloc[0]) // FAN_IN, "part": range(PARTS), "change": change, "used": _flat(used)})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        add = lambda col: np.sum([np.frombuffer(x, np.float32) for x in pdf[col]], 0, dtype=np.float32).tobytes()
        return pd.DataFrame({"node": [int(pdf["node"].iloc[0]) // FAN_IN], "part": [pdf["part"].iloc[0]], "change": [add("change")], "used": [add("used")]})

    schema = "node int, part int, change binary, used binary"
    rows = texts.mapInArrow(coded, "trainer int, h long, codes array<int>")
    rows = rows.repartition(trainers, "trainer")  # about one trainer a task, however many there are
    sums, nodes = rows.groupBy("trainer").applyInPandas(trained, schema), -(-trainers // FAN_IN)
    while True:  # a reduction tree: FAN_IN slices meet in a task, whatever the number of trainers
        sums = sums.groupBy("node", "part").applyInPandas(added, schema)
        if nodes == 1:
            break
        nodes = -(-nodes // FAN_IN)
    sums = {r["part"]: r for r in sums.collect()}  # PARTS rows, which together are as large as the network
    if not sums:
        return
    change, used = (np.concatenate([np.frombuffer(sums[k][col], np.float32) for k in range(PARTS)]) for col in ("change", "used"))
    at = 0
    for k, v in net.p.items():
        net.p[k] = v + (change[at : at + v.size] / np.maximum(used[at : at + v.size], 1)).reshape(v.shape)
        at += v.size


def _flat(tables: dict[str, np.ndarray]) -> list[bytes]:
    """The tables end to end, in PARTS slices."""
    return [x.astype(np.float32).tobytes() for x in np.array_split(np.concatenate([v.ravel() for v in tables.values()]), PARTS)]


def score(df: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score and score of each whole text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((fitted.network, fitted.dictionary))
    base = math.log10(fitted.n + 0.5 * (fitted.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words = shared.value
        codes, head = Codes(net.voc.head, 0), len(net.voc.head)
        place = {w: k for k, (w, _) in enumerate(words)}
        code = np.array([codes[w] for w, _ in words] or [0])
        log_c = np.log10(np.array([c for _, c in words] or [0]) + 0.5)
        tail = -np.log10(net.voc.tail_tokens + 0.5 * (net.voc.tail_words + 1))
        ids, docs, rare, n_known, plain, inside, held = [], [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            lists = pa.array([[{"word": x, "n": n} for x, n in r] for r in rare], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            sizes = np.fromiter(map(len, docs), np.int64, len(docs))
            cols = [pa.concat_arrays(ids), pa.array(sizes), pa.array(n_known, pa.int64()), pa.array(plain, pa.float64()), pa.array(net.score(docs) + np.array(inside)), lists]
            for x in (ids, docs, rare, n_known, plain, inside):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "n_known", "base_score", "score", "rare"])

        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                ids.append(part.column(0))
                for text in part.column(1).to_pylist():
                    w = words_of(text)
                    at = np.fromiter(map(place.get, w, repeat(-1)), np.int64, len(w))
                    mine = code[at]
                    gone = np.flatnonzero(at < 0)
                    for k in gone.tolist():  # END is in the head even where no text was counted
                        mine[k] = codes[w[k]]
                    few = Counter(w[k] for k in gone.tolist())
                    logs = np.where(at >= 0, log_c[at], 0.0)
                    tails = np.flatnonzero(mine >= head)
                    docs.append(mine)
                    rare.append(list(few.items()))
                    n_known.append(len(w) - len(gone))
                    plain.append(logs.sum() - base * len(w))
                    inside.append(logs[tails].sum() + tail[(mine[tails] - head) % TAILS].sum())
                    held += len(w)
                if len(docs) >= DOCS or held >= HELD:
                    yield flush()
        if docs:
            yield flush()

    out = df.select(id_col, text_col).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: binary, n: long>>")
    out = materialize(out.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = out.select("_row", F.inline("rare")).join(fitted.counts, "word", "left")
    more = rare.groupBy("_row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_log"), F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0)).alias("_known"))
    out = out.drop("rare").join(more, "_row", "left")
    log = F.coalesce("_log", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"))
