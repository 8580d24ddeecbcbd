"""Toxicity: a subsequence string-kernel SVM with Nystrom landmarks.

*Kernel.* Two strings are alike by the subsequences of three symbols they share, each
occurrence weighted by DECAY for every symbol it skips (at most two in either place), over
``^string$`` and divided by the strings' lengths as vectors, reckoned as if no subsequence
occurred twice in a string (so a norm depends on the number of symbols only, and scoring
folds). Skips are what tolerates gapped and
inserted-character insults: doubled and, in longer words, foreign letters. Marks inside a
word are dropped and runs of single letters are read as one string, so ``s.t-upid`` and
``s t u p i d`` are whole again. A foreign letter inside a short word can still hide it.

*Strings* are the words of sentences. A document's label holds for its sentences as a bag:
in a toxic one some word is the witness, in a clean one none is. Training alternates
between choosing each bag's witnesses and fitting a squared-hinge SVM (primal Newton) in
the space that ``LANDMARKS`` landmark strings span: K(x, L) K(L, L)**-1/2. At most
``PER_CLASS`` labelled documents of each class, of at most ``MOST_BYTES`` bytes, teach.

*Scoring.* The fitted function is a weighted sum of kernels with landmarks, so it folds
into one weight for each three-symbol subsequence, and every word of every whole text is
scored exactly by table look-ups, vectorised. A document's two best margins go through a
logistic fitted on the labelled bags.

Null and empty texts have no words and get the score of two margins of -1. Without labels
of both classes every score is the share of label 1 among the labels (0.5 without any), at
most just under the threshold. Each row is scored by itself: rows that repeat a doc_id
give a row each, and a row without doc_id is not held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import remainder, share_of_ones, training_sample
from .textblocks import LOWER, Block, blocks

PER_CLASS, MOST_BYTES, LANDMARKS, ROUNDS, THRESHOLD = 2500, 20_000, 384, 4, 0.7
DECAY, SKIPS = 0.8, 3
_SYMBOLS = 70  # 0 ends, 1-26 letters, 27-36 digits, 37-68 letters beyond ASCII by their last byte
_DROP = 255
_CODE = np.full(256, _DROP, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[48:58] = np.arange(27, 37)
_CODE[128:192] = 37 + (np.arange(128, 192) & 31)
_CODE = _CODE[LOWER]
_CELLS = _SYMBOLS**3
_PATTERNS = [(a, b) for a in range(SKIPS) for b in range(SKIPS)]


def coded(buf: np.ndarray, ws: np.ndarray, we: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings at ws:we as symbols between ends, joined, and their bounds."""
    length = we - ws
    at = np.repeat(ws - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum()))
    symbol = _CODE[buf[at]]
    keep = symbol != _DROP
    size = np.add.reduceat(keep, np.r_[0, np.cumsum(length)[:-1]]) if len(ws) else np.zeros(0, int)
    bound = np.r_[0, np.cumsum(size + 2)]
    out = np.zeros(int(bound[-1]), np.uint8)
    inner = np.ones(len(out), bool)
    inner[bound[:-1]] = False
    inner[bound[1:] - 1] = False
    out[inner] = symbol[keep]
    return out, bound


def subsequences(symbols: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Position, cell and weight of all three-symbol subsequences, by skip pattern."""
    end = np.repeat(bound[1:], np.diff(bound))
    wide = symbols.astype(np.int32)
    for a, b in _PATTERNS:
        last = 2 + a + b
        if (m := len(wide) - last) <= 0:
            continue
        i = np.flatnonzero(np.arange(last, len(wide)) < end[:m])
        yield i, (wide[i] * _SYMBOLS + wide[i + 1 + a]) * _SYMBOLS + wide[i + last], DECAY ** (a + b)


def norms(bound: np.ndarray) -> np.ndarray:
    """Length of the strings' subsequence vectors, coincidences aside."""
    n = np.diff(bound)
    square = sum(DECAY ** (2 * (a + b)) * np.maximum(n - 2 - a - b, 0) for a, b in _PATTERNS)
    return np.sqrt(np.maximum(square, 1e-9))


def margins(table: np.ndarray, bias: float, symbols: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The SVM's value of each string; those of no symbol get -1."""
    total = np.zeros(len(symbols) + 1)
    for i, cell, weight in subsequences(symbols, bound):
        total[1:][i] += weight * table[cell]
    sums = np.cumsum(total)
    out = (sums[bound[1:]] - sums[bound[:-1]]) / norms(bound) + bias
    return np.where(np.diff(bound) > 3, out, -1.0)


class Kernel:
    """Rows of K(x, L) for landmark strings L."""

    def __init__(self, symbols: np.ndarray, bound: np.ndarray):
        owner = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
        parts = [(owner[i], cell, np.full(len(i), weight)) for i, cell, weight in subsequences(symbols, bound)]
        of, cell, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.cells, column = np.unique(cell, return_inverse=True)
        self.place = np.full(_CELLS, len(self.cells), np.int32)
        self.place[self.cells] = np.arange(len(self.cells))
        self.vectors = np.zeros((len(self.cells) + 1, len(bound) - 1), np.float32)
        np.add.at(self.vectors, (column, of), weight)
        self.vectors /= norms(bound).astype(np.float32)

    def rows(self, symbols: np.ndarray, bound: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.zeros((len(bound) - 1, self.vectors.shape[1]), np.float32)
        for at in range(0, len(out), block):
            own = bound[at : at + block + 1]
            part, own = symbols[own[0] : own[-1]], own - own[0]
            owner = np.repeat(np.arange(len(own) - 1), np.diff(own))
            dense = np.zeros((len(own) - 1, len(self.cells) + 1), np.float32)
            for i, cell, weight in subsequences(part, own):
                np.add.at(dense, (owner[i], self.place[cell]), np.float32(weight))
            dense[:, -1] = 0
            out[at : at + block] = (dense @ self.vectors) / norms(own)[:, None].astype(np.float32)
        return out


def squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Primal Newton steps of the L2-SVM; the last column of z is the constant."""
    w = np.zeros(z.shape[1])
    shrink = np.full(z.shape[1], ridge * weight.sum())
    shrink[-1] = 1e-6
    for _ in range(12):
        active = y * (z @ w) < 1
        if not active.any():
            break
        za, wa = z[active], weight[active][:, None]
        new = np.linalg.solve((za * wa).T @ za + np.diag(shrink), (za * wa).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


class Toxicity:
    """What is broadcast: the folded table (a fixed number of cells), the bias and the logistic."""

    def __init__(self, share: float):
        self.share, self.table = share, None
        self.bias, self.logistic = 0.0, np.zeros(3)

    def words(self, block: Block) -> np.ndarray:
        """Margin of every word of the block, equal words looked up once."""
        _, one, back = np.unique(block.word_hash, return_index=True, return_inverse=True)
        symbols, bound = coded(block.buf, block.ws[one], block.we[one])
        return margins(self.table, self.bias, symbols, bound)[back]

    def tops(self, block: Block) -> np.ndarray:
        """The two best margins of each text's strings."""
        out = np.full((block.n, 2), -1.0)
        if not len(block.ws):
            return out
        own = self.words(block)
        some = np.flatnonzero(block.n_words)
        first = block.wo[some]
        out[some, 0] = np.maximum.reduceat(own, first)
        best = np.repeat(out[some, 0], block.n_words[some])
        at = np.flatnonzero(own == best)
        row = np.searchsorted(block.wo, at, "right") - 1
        own = own.copy()
        own[at[np.r_[True, row[1:] != row[:-1]]]] = -np.inf
        out[some, 1] = np.maximum.reduceat(own, first)
        out[:, 1] = np.maximum(out[:, 1], -1.0)
        for row, symbols in spelled(block):
            m = margins(self.table, self.bias, symbols, np.array([0, len(symbols)]))[0]
            out[row] = np.sort(np.r_[out[row], m])[:0:-1]
        return np.maximum(out, -1.0)

    def score(self, block: Block) -> np.ndarray:
        if self.table is None:
            return np.full(block.n, min(self.share, THRESHOLD - 0.01))
        value = np.c_[self.tops(block), np.ones(block.n)] @ self.logistic
        return 1 / (1 + np.exp(-np.clip(value, -500, 500)))


def spelled(block: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(row, symbols) of runs of four or more single letters, read as one string."""
    one = _CODE[block.buf[block.ws]] < 27
    one &= (_CODE[block.buf] != _DROP).cumsum()[block.we - 1] - np.r_[0, (_CODE[block.buf] != _DROP).cumsum()][block.ws] == 1
    row = block.word_row()
    edge = np.flatnonzero(np.diff(np.r_[False, one, False].astype(np.int8)))
    for a, b in edge.reshape(-1, 2):
        for cut in np.split(np.arange(a, b), np.flatnonzero(np.diff(row[a:b])) + 1):
            if len(cut) >= 4:
                symbols, _ = coded(block.buf, block.ws[cut[:1]], block.we[cut[-1:]])
                yield int(row[cut[0]]), symbols


def _bags(texts: list[str]) -> list[list[bytes]]:
    """The distinct words of each text, reduced to symbols."""
    out = []
    for text in texts:
        buf = np.frombuffer(text.encode(), np.uint8)
        block = Block(0, buf, np.array([0, len(buf)]))
        if not len(block.ws):
            out.append([])
            continue
        symbols, bound = coded(block.buf, block.ws, block.we)
        raw = symbols.tobytes()
        words = {raw[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)}
        out.append([w for w in words if len(w) > 3])
    return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum([len(w) for w in words])]


def train(texts: list[str], y: np.ndarray, share: float) -> Toxicity:
    model = Toxicity(share)
    if len(set(y.tolist())) < 2:
        return model
    random = np.random.default_rng(5)
    bags = _bags(texts)
    toxic, clean = [b for b, t in zip(bags, y, strict=True) if t], [b for b, t in zip(bags, y, strict=True) if not t]

    def beginnings(bag: list[bytes]) -> set[bytes]:
        return {w[:k] for w in bag for k in range(5, 10) if len(w) >= k}

    seen, other = Counter(x for b in toxic for x in beginnings(b)), Counter(x for b in clean for x in beginnings(b))
    odds = {x: (n / len(toxic)) / ((other[x] + 0.5) / len(clean)) for x, n in seen.items() if n >= 4}
    telling = {x for x, o in odds.items() if o >= 8}
    types = Counter(w for b in clean for w in b)
    common = [w for w, _ in types.most_common(6000)]
    rest = [w for w in types if types[w] < types[common[-1]]]
    negative = common + [rest[i] for i in random.permutation(len(rest))[:10000]]
    witness = [[w for w in b if any(w[:k] in telling for k in range(5, 10))][:6] for b in toxic]
    strong = Counter(w for b in witness for w in b)
    if not strong:
        strong = Counter(w for b in toxic for w in b)
    lead = [w for w, _ in strong.most_common(LANDMARKS // 2)]
    marks = list(dict.fromkeys(lead + [negative[i] for i in random.permutation(len(negative))[: LANDMARKS - len(lead)]]))
    kernel = Kernel(*_joined(marks))
    square = kernel.rows(*_joined(marks)).astype(float)
    value, vector = np.linalg.eigh((square + square.T) / 2)
    root = vector[:, value > 1e-4] / np.sqrt(value[value > 1e-4])
    at = {w: i for i, w in enumerate(dict.fromkeys(w for b in [*toxic, *clean] for w in b))}
    symbols, bound = _joined(list(at))
    for turn in range(ROUNDS):
        positive = [w for b in witness for w in b] or lead
        words = positive + negative
        z = kernel.rows(*_joined(words)) @ root
        z = np.c_[z, np.ones(len(z))]
        target = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        balance = np.r_[np.full(len(positive), 1 / len(positive)), np.full(len(negative), 1 / len(negative))] * len(words)
        w = squared_hinge(z, target, balance)
        model.table = np.zeros(_CELLS, np.float64)
        model.table[kernel.cells] = kernel.vectors[:-1] @ (root @ w[:-1])
        model.bias = float(w[-1])
        m = margins(model.table, model.bias, symbols, bound)
        if turn < ROUNDS - 1:
            witness = [[x for x in sorted(b, key=lambda x: -m[at[x]])[:3] if m[at[x]] > 0 and types[x] < 3] for b in toxic]
            hard = sorted({x for b in clean for x in sorted(b, key=lambda x: -m[at[x]])[:2] if m[at[x]] > -1})
            negative = list(dict.fromkeys(negative + hard))
    table = model.table
    top = np.full((len(bags), 2), -1.0)
    for k, text in enumerate(texts):
        buf = np.frombuffer(text.encode(), np.uint8)
        top[k] = model.tops(Block(0, buf, np.array([0, len(buf)])))[0]
    model.table, model.logistic = table.astype(np.float32), _logistic(np.c_[top, np.ones(len(top))], y, share)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps of a logistic regression, the classes weighted to their shares."""
    number = np.bincount(y, minlength=2)
    weight = np.array([1 - share, share])[y] / number[y] * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Toxicity:
    allowed = remainder(3) != 1
    rows = training_sample(docs, labels, "toxic", allowed, per_class, MOST_BYTES).select("doc_id", "text", "y").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    return train(rows.column("text").to_pylist(), rows.column("y").to_numpy().astype(np.int64), share_of_ones(labels, "toxic", allowed))


def scored(docs: DataFrame, model: Toxicity, name: str = "score") -> DataFrame:
    """All columns of docs and the score under ``name``, which no column of docs may have."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {name}: give the score another name")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, lower=True):
                rows = batch.slice(block.first_row, block.n)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(shared.value.score(block))], [*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
