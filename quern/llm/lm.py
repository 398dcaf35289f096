"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a word-count base.

A document is its words, A-Z in lower case, and an end. Each word after a blank is cut into subword ids of a public
tokenizer, the end is one id more. The model's score of a document is the sum over its ids of the log10 probability of the
id after those before it: one attention layer gives a state, and a tree over all ids is walked from its root, at each node
with a softmax of the state over the node's children, so that the probabilities of all next ids sum to one.

Ids stand in chunks of STEP. A window is a chunk and the one before it, so that windows overlap by half: the ids of the last
chunk are scored, each once, and see STEP ids before them or more (those of a text's first chunk see all there are). Windows
are scored in batches under one causal mask.

All training documents count: the tree and its first biases come from counts of all their ids, and the layer is trained on
all of them, once. Tasks train on their own documents from the same start and the moves of their weights are averaged by
what each task saw; a first round on an eighth of the documents gives the start of the second, which sees the others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import fresh, materialised, split_words, text_slices
from quern.llm.quality import held_out
from quern.llm.tokenise import byte_bpe_path, forget, tokenizer

#: Ids of a chunk, numbers of a state, children of a node of the tree.
STEP, WIDTH, FAN = 16, 24, 16
#: Chunks of a training step and of a scored batch, rate, and the part of the documents (one of so many) that the first round has.
FIT_ROWS, BATCH_ROWS, FIT_RATE, FIRST_ROUND = 512, 1024, 0.03, 8
#: What an id's count is raised by in the first biases; what products and scores of children are held to, so that no power of e overflows.
RAISED, MOST = 0.1, np.float32(60.0)
#: Ids that are trained on at a time, about, and those that are scored: few enough for their states to stay in a core's cache.
SLICE_IDS, SCORED_IDS = 1 << 19, 1 << 16
#: Bytes of the parts of the table of ids that tasks train on and score.
BLOCK_BYTES = 4 << 20
#: Words that are broadcast with their counts, at most, the most frequent ones; all others are joined.
FREQUENT = 200_000
#: Words that a task sums up before it sends them on, and words whose ids it keeps, at most.
HELD_WORDS, KEPT_WORDS = 600_000, 500_000
#: The end of a text is an id of its own, the begin and blank places are none that is ever predicted.
END, BEGIN, BLANK = 50_257, 50_258, 50_259
OUT_IDS = 50_258
_CAUSAL = np.tril(np.ones((STEP, 2 * STEP), np.float32), STEP)
_ONES = np.ones(2 * STEP, np.float32)


@dataclass
class Tree:
    """A tree over all ids with FAN children a node, the more frequent ids nearer to the root (node 0).

    node and child (depth, OUT_IDS) are an id's way from the root, -1 beyond its end; rank orders ids so that those below a
    node stand together; bias (nodes, FAN) gives the shares of `counts`.
    """

    node: np.ndarray
    child: np.ndarray
    rank: np.ndarray
    bias: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Tree:
        # the FAN least ones are joined again and again; blank ones fill up the first node
        blank = -(len(counts) - 1) % (FAN - 1)
        heap = [(-1, -1 - i) for i in range(blank)] + [(int(n), i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        parts: list[list[int]] = []
        while len(heap) > 1:
            least = [heapq.heappop(heap) for _ in range(FAN)]
            heapq.heappush(heap, (sum(max(0, n) for n, _ in least), len(counts) + len(parts)))
            parts.append([i for _, i in least])
        ways: dict[int, list[tuple[int, int]]] = {}
        stack, numbered = [(len(counts) + len(parts) - 1, [])], 0
        while stack:
            at, way = stack.pop()
            if at < len(counts):
                ways[at] = way
                continue
            stack += [(c, [*way, (numbered, k)]) for k, c in enumerate(parts[at - len(counts)]) if c >= 0]
            numbered += 1
        depth = max(map(len, ways.values()))
        node, child = np.full((depth, len(counts)), -1, np.int16), np.zeros((depth, len(counts)), np.int8)
        for i, way in ways.items():
            for level, (n, k) in enumerate(way):
                node[level, i], child[level, i] = n, k
        rank = np.empty(len(counts), np.uint16)
        rank[np.fromiter(ways, np.int64, len(ways))] = np.arange(len(ways))
        sums = np.zeros((numbered, FAN))
        for level in range(depth):
            there = node[level] >= 0
            np.add.at(sums, (node[level][there], child[level][there].astype(np.int64)), counts[there] + RAISED)
        bias = np.where(sums > 0, np.log(np.maximum(sums, RAISED)), 0.0)
        bias -= bias.sum(axis=1, keepdims=True) / (sums > 0).sum(axis=1, keepdims=True)
        return Tree(node, child, rank, np.where(sums > 0, bias, -MOST).astype(np.float32))

    def levels(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int, int]]]]:
        """For ids in order of their rank, level by level: places of the ids that have not ended, the children taken there, and the nodes passed.

        These are (node, start, end, first, last): a run of such places, and of ids, which stand together.
        """
        there = np.arange(len(ids))
        for node, child in zip(self.node, self.child, strict=True):
            here = node[ids]
            if (ended := here < 0).any():
                there, ids, here = there[~ended], ids[~ended], here[~ended]
            if not len(ids):
                return
            cuts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1], [True]]))
            starts, sizes = cuts[:-1], np.diff(cuts)
            firsts = there[starts]
            yield there, child[ids].astype(np.int64), list(zip(here[starts].tolist(), starts.tolist(), cuts[1:].tolist(), firsts.tolist(), (firsts + sizes).tolist(), strict=True))


def chunks(sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of `sizes` ids that follow each other: (inputs (rows, STEP): the id before each place, first, place).

    A text has a blank row, which is the first one's context, and then its chunks; first marks those that follow a blank
    row, place is where each id is predicted among all inputs.
    """
    rows = np.where(sizes > 0, 1 + -(-sizes // STEP), 0)
    start, begin = np.cumsum(rows) - rows, np.cumsum(sizes) - sizes
    place = np.repeat((start + 1) * STEP - begin, sizes) + np.arange(len(ids))
    inputs = np.full(int(rows.sum()) * STEP, BLANK, np.uint16)
    before = np.empty(len(ids), np.uint16)
    before[1:] = ids[:-1]
    before[begin[sizes > 0]] = BEGIN
    inputs[place] = before
    first = np.zeros(len(inputs) // STEP, bool)
    first[start[sizes > 0] + 1] = True
    return inputs.reshape(-1, STEP), first, place


def batches_of(first: np.ndarray, place: np.ndarray, rows: int) -> list[tuple[int, int, int, int]]:
    """(row, end row, id, end id) of batches of chunks; the row before a batch is its context."""
    starts = np.arange(1, len(first), rows)
    ends = np.minimum(starts + rows, len(first))
    return list(zip(starts.tolist(), ends.tolist(), np.searchsorted(place, starts * STEP).tolist(), np.searchsorted(place, ends * STEP).tolist(), strict=True))


def _two(rows: np.ndarray) -> np.ndarray:
    """Each row but the first together with the one before it, without a copy."""
    n, s, d = rows.shape
    return np.lib.stride_tricks.as_strided(rows, (n - 1, 2 * s, d), rows.strides)


def asking(p: dict[str, np.ndarray]) -> np.ndarray:
    """The matrix of queries and that of keys in one: what it makes of a state meets other ids' states as they are."""
    return p["q"] @ p["k"].T


def attended(x: np.ndarray, q: np.ndarray, r: np.ndarray, first: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, attended states) of rows of chunks; x: states of their ids after those of the row before them, q: what asking() makes of theirs; w: where weights go, if given."""
    w = np.matmul(q, _two(x).transpose(0, 2, 1), out=w)
    w += r
    np.clip(w, -MOST, MOST, out=w)
    np.exp(w, out=w)
    w *= _CAUSAL
    w[np.flatnonzero(first), :, :STEP] = 0
    w /= (w @ _ONES)[:, :, None]
    return w, np.matmul(w, _two(x))


def with_bias(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nodes' weights (nodes, WIDTH + 1, FAN), their bias last, for states with a one at their end."""
    return np.concatenate([u, c[:, None, :]], axis=1)


def with_one(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states in that order, each with a one at its end."""
    out = np.empty((len(order), WIDTH + 1), np.float32)
    out[:, :WIDTH], out[:, WIDTH] = h.take(order, axis=0), 1
    return out


def _chances(h: np.ndarray, nodes: np.ndarray, runs: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Scores, held to MOST, of the children of the nodes that runs pass, for states h with a one at their end."""
    out = np.empty((runs[-1][2], FAN), np.float32)
    for n, start, end, a, b in runs:
        np.matmul(h[a:b], nodes[n], out=out[start:end])
    return np.clip(out, -MOST, MOST, out=out)


@dataclass
class Model:
    """A trained model: states e of ids, matrices q, k and v, r for a pair of places, u and c of the tree's nodes."""

    p: dict[str, np.ndarray]
    tree: Tree

    @cached_property
    def queries(self) -> np.ndarray:
        """What asking() makes of all ids' states."""
        return self.p["e"] @ asking(self.p)

    @cached_property
    def nodes(self) -> np.ndarray:
        return with_bias(self.p["u"], self.p["c"])

    def states(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The state (WIDTH) from which each id is predicted."""
        inputs, first, place = chunks(sizes, ids)
        out = np.empty((len(ids), WIDTH), np.float32)
        for a, b, i, j in batches_of(first, place, BATCH_ROWS):
            x = self.p["e"].take(inputs[a - 1 : b], axis=0)
            _, found = attended(x, self.queries.take(inputs[a:b], axis=0), self.p["r"], first[a:b])
            h = found.reshape(-1, WIDTH) @ self.p["v"]
            h += x[1:].reshape(-1, WIDTH)
            out[i:j] = h.take(place[i:j] - a * STEP, axis=0)
        return out

    def score(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 of the probability of each id after those before it; ids of all texts follow each other."""
        order = np.argsort(self.tree.rank[ids], kind="stable")
        h, logs, ones = with_one(self.states(sizes, ids), order), np.zeros(len(ids), np.float32), np.ones(FAN, np.float32)
        for there, taken, runs in self.tree.levels(ids[order]):
            s = _chances(h, self.nodes, runs)
            found = s.ravel().take(np.arange(0, s.size, FAN) + taken)
            np.exp(s, out=s)
            found -= np.log(s @ ones)
            logs[there] += found
        out = np.empty_like(logs)
        out[order] = logs
        return out * np.float32(1 / np.log(10))


def begin(counts: np.ndarray, seed: int = 5) -> tuple[dict[str, np.ndarray], Tree]:
    """(first parameters, tree) of a model that gives each id its share of counts (OUT_IDS), whatever is before it."""
    tree, r, d = Tree.of(counts), np.random.default_rng(seed), WIDTH
    normal = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
    e = normal(BLANK + 1, d, scale=0.5)
    e[BLANK] = 0
    p = {"e": e, "q": normal(d, d, scale=1 / d), "k": normal(d, d, scale=d**-0.5), "v": normal(d, d, scale=d**-0.5)}
    return p | {"r": np.zeros((STEP, 2 * STEP), np.float32), "u": np.zeros((len(tree.bias), d, FAN), np.float32), "c": tree.bias.copy()}, tree


class Trainer:
    """Adam over chunks of texts, from given parameters; an id's state and a node's weights move in the steps that meet them."""

    def __init__(self, start: dict[str, np.ndarray], tree: Tree, seed: int):
        self.start, self.tree, self.r = start, tree, np.random.default_rng(seed)
        self.p = {k: v.copy() for k, v in start.items()}
        # moved in place as u and c
        self.nodes = with_bias(start["u"], start["c"])
        self.p |= {"u": self.nodes[:, :WIDTH], "c": self.nodes[:, WIDTH]}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in start.items()}
        self.t, self.scored = 0, 0
        self.met, self.passed = np.zeros(BLANK, np.int64), np.zeros(len(tree.bias), np.int64)

    def _move(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        m, v = (x[at] for x in self.moments[name])
        m = m + np.float32(0.1) * (grad - m)
        v = v + np.float32(0.01) * (grad * grad - v)
        self.moments[name][0][at], self.moments[name][1][at] = m, v
        step = np.sqrt(v * np.float32(1 / (1 - 0.99**self.t)))
        step += np.float32(1e-6)
        m *= np.float32(FIT_RATE / (1 - 0.9**self.t))
        m /= step
        self.p[name][at] -= m

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """All chunks of the texts once, in batches in an order of chance."""
        inputs, first, place = chunks(sizes, ids)
        parts = batches_of(first, place, FIT_ROWS)
        for n in self.r.permutation(len(parts)).tolist():
            a, b, i, j = parts[n]
            if i < j:
                self._step(inputs[a - 1 : b], first[a:b], place[i:j] - a * STEP, ids[i:j])
        self.scored += len(ids)
        self.met += np.bincount(inputs.ravel(), minlength=BLANK + 1)[:BLANK]

    def _out(self, h: np.ndarray, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Move the tree's weights; the gradient of states h, of which those at `place` predict the ids."""
        order = np.argsort(self.tree.rank[ids], kind="stable")
        hs, mean = with_one(h, place[order]), np.float32(1 / (FIT_ROWS * STEP))
        dh = np.zeros((len(ids), WIDTH), np.float32)
        ones, passed, grads = np.ones(FAN, np.float32), [], []
        for _, taken, runs in self.tree.levels(ids[order]):
            s = _chances(hs, self.nodes, runs)
            np.exp(s, out=s)
            s *= (mean / (s @ ones))[:, None]
            s.ravel()[np.arange(0, s.size, FAN) + taken] -= mean
            grad = np.empty((len(runs), WIDTH + 1, FAN), np.float32)
            for k, (n, start, end, a, b) in enumerate(runs):
                part = s[start:end]
                dh[a:b] += part @ self.p["u"][n].T
                np.matmul(hs[a:b].T, part, out=grad[k])
            nodes = [run[0] for run in runs]
            self.passed[nodes] += [run[2] - run[1] for run in runs]
            passed += nodes
            grads.append(grad)
        grads = np.concatenate(grads)
        self._move("u", grads[:, :WIDTH], passed)
        self._move("c", grads[:, WIDTH], passed)
        out = np.zeros_like(h)
        out[place[order]] = dh
        return out

    def _step(self, inputs: np.ndarray, first: np.ndarray, place: np.ndarray, ids: np.ndarray) -> None:
        d, p, rows = WIDTH, self.p, len(first)
        self.t += 1
        x, asks = p["e"].take(inputs, axis=0), asking(p)
        here = x[1:].reshape(-1, d)
        q = (here @ asks).reshape(rows, STEP, d)
        # changes of weights above the weights, so that one product brings both to the ids that are met
        both = np.empty((rows, 2 * STEP, 2 * STEP), np.float32)
        dw, w = both[:, :STEP], both[:, STEP:]
        _, found = attended(x, q, p["r"], first, w)
        flat = found.reshape(-1, d)
        dh = self._out(flat @ p["v"] + here, place, ids)
        back = (dh @ p["v"].T).reshape(q.shape)
        np.matmul(back, _two(x).transpose(0, 2, 1), out=dw)
        # of the weights' softmax: what each attended state's share in the change leaves
        dw -= np.einsum("rsd,rsd->rs", back, found)[:, :, None]
        dw *= w
        dq = np.matmul(dw, _two(x)).reshape(-1, d)
        met = np.matmul(both.transpose(0, 2, 1), np.concatenate([q, back], axis=1))
        of_here, dx = dq @ asks.T, np.empty_like(x)
        of_here += dh
        dx[0] = 0
        np.add(of_here.reshape(q.shape), met[:, STEP:], out=dx[1:])
        dx[:-1] += met[:, :STEP]
        change = here.T @ dq
        grads = {"q": change @ p["k"], "k": change.T @ p["q"], "v": flat.T @ dh, "r": (np.ones(rows, np.float32) @ both.reshape(rows, -1)[:, : STEP * 2 * STEP]).reshape(p["r"].shape)}
        for name, grad in grads.items():
            self._move(name, grad)
        by_id = np.argsort(inputs.ravel(), kind="stable")
        sorted_ids = inputs.ravel()[by_id]
        cuts = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
        grad, moved = np.add.reduceat(dx.reshape(-1, d).take(by_id, axis=0), cuts), sorted_ids[cuts].astype(np.int64)
        seen = moved != BLANK
        self._move("e", grad[seen], moved[seen])

    def moved(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, weight, weighted moves): rows of the packed parameters; an id's state weighs as often as it was met, a node as it was passed, all else as the ids scored."""
        rows = packed(self.p) - packed(self.start)
        weight = np.full(len(rows), self.scored, np.int64)
        weight[:BLANK] = self.met
        weight[BLANK + 1 : BLANK + 1 + len(self.passed) * FAN] = np.repeat(self.passed, FAN)
        key = np.flatnonzero(weight)
        return key, weight[key], rows[key] * weight[key, None]


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters as rows of WIDTH + 1 numbers: ids' states, then children of nodes with their bias, then the rest."""
    states = np.pad(p["e"], ((0, 0), (0, 1)))
    children = np.concatenate([p["u"].transpose(0, 2, 1), p["c"][:, :, None]], axis=2).reshape(-1, WIDTH + 1)
    rest = np.concatenate([p[n].ravel() for n in ("q", "k", "v", "r")])
    return np.concatenate([states, children, np.pad(rest, (0, -len(rest) % (WIDTH + 1))).reshape(-1, WIDTH + 1)])


def unpacked(rows: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """packed() undone."""
    rows, nodes, out = rows.astype(np.float32), len(like["u"]), {"e": rows[: BLANK + 1, :WIDTH].copy()}
    children = rows[BLANK + 1 : BLANK + 1 + nodes * FAN].reshape(nodes, FAN, WIDTH + 1)
    out |= {"u": np.ascontiguousarray(children[:, :, :WIDTH].transpose(0, 2, 1)), "c": children[:, :, WIDTH].copy()}
    rest, at = rows[BLANK + 1 + nodes * FAN :].ravel(), 0
    for n in ("q", "k", "v", "r"):
        out[n] = rest[at : at + like[n].size].reshape(like[n].shape).copy()
        at += like[n].size
    return out


def averaged(start: dict[str, np.ndarray], key: np.ndarray, weight: np.ndarray, moves: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters moved by the weighted mean of the moves; key, weight and moves are sums over all tasks."""
    rows = packed(start).astype(np.float64)
    rows[key] += moves / weight[:, None]
    return unpacked(rows, start)


def fit(sizes: np.ndarray, ids: np.ndarray, seed: int = 5) -> Model:
    """The model of texts in memory."""
    start, tree = begin(np.bincount(ids, minlength=OUT_IDS), seed)
    trainer = Trainer(start, tree, seed)
    trainer.add(sizes, ids)
    return Model(trainer.p, tree)


def id_slices(blobs: pa.Array, limit: int = SLICE_IDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, end row, sizes, ids) of runs of rows of about `limit` ids at most (a longer text is alone); blobs hold ids as two bytes each."""
    sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        part = blobs.slice(a, b - a).cast(pa.large_binary())
        first, last = (np.frombuffer(part.buffers()[1], np.int64, part.offset + len(part) + 1)[k] for k in (part.offset, part.offset + len(part)))
        yield a, b, sizes[a:b], np.frombuffer(part.buffers()[2], np.uint16, (last - first) // 2, first).astype(np.int64)
        a = b


def id_counts(texts: DataFrame) -> np.ndarray:
    """Counts (OUT_IDS) of all ids of texts (ids binary); a row for each id reaches the driver, the vocabulary's size at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(OUT_IDS, np.int64)
        for batch in batches:
            for *_, ids in id_slices(batch.column(0)):
                counts += np.bincount(ids, minlength=OUT_IDS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], names=["id", "n"])

    rows = texts.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(OUT_IDS, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def trained(texts: DataFrame, seed: int = 5) -> Model:
    """The model of all texts (row long, ids binary): in each round tasks train on all their texts from the same start, and their moves are averaged."""
    p, tree = begin(id_counts(texts), seed)
    names = [f"d{i}" for i in range(WIDTH + 1)]
    early = F.pmod("row", F.lit(FIRST_ROUND)) == 0
    for number, part in enumerate((texts.where(early), texts.where(~early))):
        shared = texts.sparkSession.sparkContext.broadcast((p, tree))  # bounded by the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            forget()
            trainer = Trainer(*shared.value, seed + number)
            for batch in batches:
                for _, _, sizes, ids in id_slices(batch.column(0)):
                    trainer.add(sizes, ids)
            if trainer.scored:
                key, weight, moves = trainer.moved()
                table = pa.table({"key": key, "weight": weight} | {c: moves[:, i].astype(np.float32) for i, c in enumerate(names)})
                yield from table.to_batches(10_000)

        moves = part.select("ids").mapInArrow(run, "key long, weight long, " + ", ".join(f"{c} float" for c in names))
        # a row for each row of parameters
        found = moves.groupBy("key").agg(F.sum("weight").alias("weight"), *[F.sum(c).alias(c) for c in names]).toArrow()
        column = lambda c, found=found: found.column(c).to_numpy()
        p = averaged(p, column("key"), column("weight"), np.stack([column(c) for c in names], axis=1))
        shared.unpersist()
    return Model(p, tree)


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text) to (word, n): counts of all words, summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for _, texts in text_slices(batch, "text", 4 << 20):
                _, words = split_words(texts)
                counts = words.cast(pa.string()).value_counts()
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                if sum(t.num_rows for t in held) > HELD_WORDS:
                    held[:] = [summed()]
                    if held[0].num_rows > HELD_WORDS // 2:
                        yield from held.pop().to_batches(50_000)
        if held:
            yield from summed().to_batches(50_000)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ids(encoder, offsets: np.ndarray, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids of each text with its end, and all ids as two bytes each."""
    lists = encoder.words(coded.dictionary).take(coded.indices)
    ends = lists.offsets.to_numpy().astype(np.int64)
    sizes = ends[offsets[1:]] - ends[offsets[:-1]]
    ids = np.full(len(lists.values) + len(sizes), END, np.uint16)
    ids[np.arange(len(lists.values)) + np.repeat(np.arange(len(sizes)), sizes)] = lists.values.to_numpy()
    return sizes + 1, ids


def _frequent(counts: DataFrame, most: int) -> pa.Table:
    """The words of the largest counts, `most` at most: all those from a count on that a histogram of counts gives."""
    bins = counts.groupBy(F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.1)))).alias("bin")).count().collect()  # some hundred rows
    total, least = 0, 10**9
    for row in sorted(bins, key=lambda b: -b["bin"]):
        total += row["count"]
        if total > most:
            break
        least = row["bin"]
    # the bin's lower edge, a little lower against rounding, in the same terms as above
    return counts.where(F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.1)))) >= least).toArrow()


def encoded(docs: DataFrame, frequent: pa.Table, path: str) -> DataFrame:
    """docs (doc_id, text, held_out) with ids in place of the text, the sums of the base over `frequent` words, and the other words: a row each, numbered by row."""
    shared = docs.sparkSession.sparkContext.broadcast((fresh(frequent.column("word").combine_chunks()), frequent.column("n").to_numpy()))  # bounded by FREQUENT
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "rare", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words_of, counts_of = shared.value
        logs_of, encoder = np.append(np.log10(counts_of + 1.0), 0.0), tokenizer(path, KEPT_WORDS)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part, texts in text_slices(batch, "text", 2 << 20):
                offsets, words = split_words(texts)
                rows, per = len(texts), np.diff(offsets)
                coded = words.dictionary_encode()
                sizes, ids = _ids(encoder, offsets, coded)
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=words_of), len(words_of)).to_numpy().astype(np.int64)
                codes, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(rows), per)
                at = place[codes] if len(codes) else codes
                rare = at == len(words_of)
                logs = np.bincount(doc, weights=logs_of[at], minlength=rows).astype(float)  # whole numbers where there are no words
                known = np.bincount(doc, weights=~rare, minlength=rows).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[rare], np.arange(rows + 1)), pa.int32()), coded.dictionary.take(pa.array(codes[rare])).cast(pa.string()))
                blobs = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                columns = [pa.array(number + np.arange(rows)), part.column(0), part.column(2), pa.array(per + 1), pa.array(known), pa.array(logs), lists, blobs]
                number += rows
                yield pa.RecordBatch.from_arrays(columns, names=names)
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, rare array<string>, ids binary")


def with_scores(texts: DataFrame, model: Model) -> DataFrame:
    """texts (…, ids binary last) with the model's log10 probability of each text, score double, in place of its ids."""
    shared, names = texts.sparkSession.sparkContext.broadcast(model), [*texts.columns[:-1], "score"]  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sizes, ids in id_slices(batch.column(batch.num_columns - 1), SCORED_IDS):
                sums = np.concatenate([[0.0], np.cumsum(shared.value.score(sizes, ids), dtype=np.float64)])
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], pa.array(sums[ends] - sums[ends - sizes])], names=names)

    return texts.mapInArrow(run, texts.select(*texts.columns[:-1], F.lit(0.0).alias("score")).schema)


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of docs; other columns are ignored.

    Null texts are empty: their end alone is scored. Null ids are not held out. Rows that repeat are scored each. Without
    training documents no token is known and the model is its uniform start. An empty table gives no rows.
    """
    path = path or byte_bpe_path()
    each = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), held_out(id_column, 7).alias("held_out"))
    train = each.where(~F.col("held_out"))
    counts = materialised(word_counts(train), "word-counts")
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    documents = train.count()
    total, distinct = row["n"] + documents, row["v"] + (documents > 0)  # an end in each document
    texts = materialised(encoded(each, _frequent(counts, FREQUENT), path), "ids", BLOCK_BYTES)
    model = trained(texts.where(~F.col("held_out")).select("row", "ids"))
    rare = texts.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word"))
    more = rare.join(counts, "word").groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    found = with_scores(texts.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "ids"), model).join(more, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # every document has an end, counted once in each training document
    end = float(np.log10(documents + 1.0))
    base = F.col("logs") + zero("more_logs") + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))
    return found.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known") + F.lit(int(documents > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
