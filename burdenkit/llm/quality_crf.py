"""Document quality from a linear-chain conditional random field over lines.

A line is good or bad. Its features are character and word shares of the line and of its neighbours;
training lines bear their document's label. Forward-backward gives each line's marginal; a document's
score is their mean weighted by length, mapped to a probability by a logistic curve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import any_names, crc_mod, hash_share, table, unused

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 space, 6 beyond ASCII
_KIND[[*range(97, 123)]], _KIND[[*range(65, 91)]], _KIND[[*range(48, 58)]] = 1, 2, 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]], _KIND[[32, *range(9, 14)]], _KIND[128:] = 4, 5, 6
_POWER = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
BASE = ("length", "lower", "upper", "digit", "punctuation", "beyond_ascii", "word_length", "same_word_again", "same_mark_again", "marks_per_word", "line_again")
FEATURES = (*BASE, *(f"around_{x}" for x in BASE[2:]), "first", "last")
_BATCH = 1 << 21


def _sums(data: np.ndarray) -> tuple[np.ndarray, bool]:
    """Sums over the lines of a piece of text, a row each, and whether the last line goes on behind it.

    Columns: bytes, lower, upper, digit, mark, beyond ASCII, words, characters in words, words like the one before,
    marks like the one before, code of the words, code of the words by their place.
    """
    open_ = not len(data) or data[-1] != 10
    ends = np.flatnonzero(data == 10)
    if open_:
        ends = np.append(ends, len(data))
    starts = np.concatenate(([0], ends[:-1] + 1))
    lines, kind = len(starts), _KIND[data]
    out = np.zeros((lines, 12))
    out[:, 0] = ends - starts
    if not len(data):
        return out, open_
    edge = np.minimum(starts, len(data) - 1)
    for k, of in enumerate((1, 2, 3, 4, 6), 1):
        out[:, k] = np.where(starts < len(data), np.add.reduceat(kind == of, edge, dtype=np.int64), 0)
    mark, space = kind == 4, kind == 5
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    finish = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
    if len(begin):
        line = np.searchsorted(ends, begin)
        place = np.arange(len(data)) - np.repeat(np.concatenate(([0], begin)), np.diff(np.concatenate(([0], begin, [len(data)]))))
        with np.errstate(over="ignore"):
            code = np.where(space, 0, data).astype(np.uint64) * _POWER[np.minimum(place, 63)]
        code = np.add.reduceat(code, begin)
        again = np.zeros(len(begin))
        again[1:] = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
        short = (code >> np.uint64(40)).astype(np.float64)
        out[:, 6], out[:, 7], out[:, 8] = np.bincount(line, minlength=lines), np.bincount(line, finish - begin + 1, lines), np.bincount(line, again, lines)
        out[:, 10], out[:, 11] = np.bincount(line, short, lines), np.bincount(line, short * (1 + np.arange(len(code)) - np.searchsorted(line, line)), lines)
    twice = np.zeros(len(data), bool)
    twice[1:] = mark[1:] & (data[1:] == data[:-1])
    out[:, 9] = np.where(starts < len(data), np.add.reduceat(twice, edge, dtype=np.int64), 0)
    return out, open_


def _pieces(text: bytes, size: int):
    """A text in pieces of ``size`` bytes or fewer that end with lines, else words, where they can."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            line, word = text.rfind(b"\n", at, end), text.rfind(b" ", at, end)
            end = (line if line >= at else word if word >= at else end - 1) + 1
        yield text[at:end]
        at = end


def line_features(texts: list[bytes], size: int = _BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths of the lines of all texts, and each text's number of lines (empty lines count).

    Works on ``size`` bytes at a time: memory grows with the number of lines only. Longer lines are summed over
    pieces that end with words; what repeats across such an end doesn't count.
    """
    count = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    found, going = [], False
    for piece in _pieces(b"\n".join(texts) + b"\n", size):
        rows, open_ = _sums(np.frombuffer(piece, np.uint8))
        if going:
            last = found[-1]
            rows[0, 11] += last[-1, 6] * rows[0, 10]  # its words stand behind those before
            last[-1] += rows[0]
            rows = rows[1:]
        if len(rows):
            found.append(rows)
        going = open_
    length, lower, upper, digit, mark, beyond, words, chars, again, twice, _, whole = np.concatenate(found).T
    lines, n, w = len(length), np.maximum(length, 1), np.maximum(words, 1)
    doc = np.repeat(np.arange(len(texts)), count)
    by = np.lexsort((np.arange(lines), whole, doc))  # a line like an earlier one of its text
    seen = np.zeros(lines)
    seen[by[1:]] = (doc[by[1:]] == doc[by[:-1]]) & (whole[by[1:]] == whole[by[:-1]]) & (words[by[1:]] > 0)
    base = np.stack([np.log1p(length) / 5, lower / n, upper / n, digit / n, mark / n, beyond / n, np.minimum(chars / w, 40) / 10, again / w, twice / n, np.minimum(mark / w, 5), seen], 1)
    first, last = np.zeros(lines), np.zeros(lines)
    edge = np.cumsum(count)
    first[edge - count], last[edge - 1] = 1, 1
    before, after = np.roll(base, 1, 0), np.roll(base, -1, 0)
    before[first == 1], after[last == 1] = base[first == 1], base[last == 1]
    return np.concatenate([base, ((before + after) / 2)[:, 2:], first[:, None], last[:, None]], 1), length, count


def _chains(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains longest first: their order, first lines and lengths, so that step t works on a prefix of them."""
    order = np.argsort(-count, kind="stable")
    return order, (np.cumsum(count) - count)[order], count[order]


def marginals(unary: np.ndarray, count: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward over chains of two states: P(good) of each line, P of each pair of states (summed by line ``weight``), log Z."""
    _, first, size = _chains(count)
    score = np.stack([np.zeros(len(unary)), unary], 1)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    longest = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(longest + 1)]  # chains with more than t lines
    alpha[first] = score[first]
    for t in range(1, longest):
        at = first[: active[t]] + t
        p = alpha[at - 1]
        alpha[at, 0] = np.logaddexp(p[:, 0] + trans[0, 0], p[:, 1] + trans[1, 0]) + score[at, 0]
        alpha[at, 1] = np.logaddexp(p[:, 0] + trans[0, 1], p[:, 1] + trans[1, 1]) + score[at, 1]
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        q = beta[at + 1] + score[at + 1]
        beta[at, 0] = np.logaddexp(trans[0, 0] + q[:, 0], trans[0, 1] + q[:, 1])
        beta[at, 1] = np.logaddexp(trans[1, 0] + q[:, 0], trans[1, 1] + q[:, 1])
    log_z = np.logaddexp(alpha[first + size - 1, 0], alpha[first + size - 1, 1])
    good = 1 / (1 + np.exp(np.clip(alpha[:, 0] + beta[:, 0] - alpha[:, 1] - beta[:, 1], -60, 60)))
    z = np.empty(len(unary))
    z[:] = np.repeat(log_z[np.argsort(_chains(count)[0])], count)
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(count) - 1] = False
    here = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = np.exp(alpha[here, i] + trans[i, j] + score[here + 1, j] + beta[here + 1, j] - z[here]) @ (np.ones(len(here)) if weight is None else weight[here])
    return good, pairs, z, float(log_z.sum())


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for a logistic curve of weighted rows; x has a column of ones."""
    w = np.zeros(x.shape[1])
    c = np.ones(len(x)) if weight is None else weight * (len(x) / weight.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * (p * (1 - p) + 1e-6))[:, None]).T @ x / len(x) + penalty * np.eye(len(w)), x.T @ (c * (y - p)) / len(x) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class LineCrf:
    """Weights, transitions and calibration; ``fit`` runs on the driver over a bounded sample's features."""

    def __init__(self, width: int):
        self.mean, self.scale, self.w, self.trans, self.curve = np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)), np.array([0.0, 1.0])

    def _unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def fit(self, x: np.ndarray, count: np.ndarray, label: np.ndarray, length: np.ndarray, rounds: int = 120, penalty: float = 1e-3, span: int = 64, weight: np.ndarray | None = None) -> LineCrf:
        """Adam on the chains' log likelihood; chains of over ``span`` lines are cut for training.

        Lines weigh as their documents do, alike without ``weight``.
        """
        each = np.repeat(np.ones(len(count)) if weight is None else weight, count)
        each = each * (len(each) / each.sum())
        self.mean = np.average(x, 0, each)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, 0, each)) + 1e-3
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)
        chain = np.concatenate([np.array([span] * (n // span) + [n % span] * (n % span > 0)) for n in count.tolist()])
        y = np.repeat(label, count).astype(np.float64)
        inner = np.ones(len(y), bool)
        inner[np.cumsum(chain) - 1] = False
        here = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[here].astype(int), y[here + 1].astype(int)), each[here])
        theta = np.zeros(z.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
            good, pairs, _, _ = marginals(z @ self.w, chain, self.trans, each)
            grad = np.concatenate([(each * (y - good)) @ z, (seen - pairs).reshape(-1)]) / len(y) - penalty * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        raw = self.raw(x, count, length)
        self.curve = _logistic(np.stack([np.ones(len(raw)), raw], 1), label.astype(np.float64), weight=weight)
        return self

    def raw(self, x: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logit of the length-weighted mean marginal of each document."""
        good, *_ = marginals(self._unary(x), count, self.trans)
        weight = np.maximum(length, 1e-3)  # a text of empty lines weighs them alike
        at = np.cumsum(count) - count
        p = np.clip(np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at), 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def score(self, x: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.raw(x, count, length), -30, 30)))


def sample_ids(labels: DataFrame, label: str, learn, most: int) -> DataFrame:
    """doc_id, label, of: at most ``most`` labelled ids of either class for which ``learn`` holds, those of the least hash.

    ``of`` is the number that the class has; weights of ``of`` by sampled rows (``class_weights``) keep the table's shares.
    Classes are counted first, so that a task passes on its share of about four times ``most``, however many tasks there are.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(learn & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.filter((F.col("label") == k) & (hash_share("doc_id") < 4 * most / max(count.get(k, 0), 1))).orderBy(hash_share("doc_id"), "doc_id").limit(most).withColumn("of", F.lit(count.get(k, 0)).cast("long")) for k in (0, 1)]
    return parts[0].union(parts[1])


def class_weights(label: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Weight of each sampled row: its class's number of rows in the table by that in the sample."""
    sampled = np.bincount(label.astype(np.int64), minlength=2)
    return of / sampled[label.astype(np.int64)]


def train(docs: DataFrame, labels: DataFrame, most: int = 1500) -> LineCrf:
    """Learn from at most ``most`` documents of either quality whose crc32 remainder by 3 is not 1.

    Without a labelled document of both classes the model gives 0.5 to all.
    """
    ids = sample_ids(labels, "quality", crc_mod(F.col("doc_id"), 3) != 1, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")

    def features(batches):
        for batch in batches:
            for text, label, of in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), batch.column("of").to_pylist(), strict=True):
                x, length, _ = line_features([text or b""])
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()]), pa.array([length.astype(np.float32).tobytes()]), pa.array([label], pa.int32()), pa.array([of], pa.int64())], names=["x", "length", "label", "of"])

    got = rows.select("text", "label", "of").mapInArrow(features, "x binary, length binary, label int, of long").collect()
    label, of = np.array([r["label"] for r in got]), np.array([r["of"] for r in got])
    model = LineCrf(len(FEATURES))
    if len(set(label.tolist())) < 2:
        model.curve = np.zeros(2)
        return model
    length = [np.frombuffer(r["length"], np.float32) for r in got]
    x = np.concatenate([np.frombuffer(r["x"], np.float32) for r in got]).reshape(-1, len(FEATURES)).astype(np.float64)
    return model.fit(x, np.array([len(n) for n in length]), label, np.concatenate(length).astype(np.float64), weight=class_weights(label, of))


def scored(docs: DataFrame, model: LineCrf, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1), which must be free; the other columns may have any names.

    Null texts are scored as empty ones (one empty line); whole texts are read, long ones in pieces. Null ids,
    repeated rows and ties are scored alike; an empty table gives an empty result.
    """
    if unused(docs, name) != name:
        raise ValueError(f"there is a column {name}")
    cols = docs.columns

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            score, at = np.empty(len(texts)), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= _BATCH):
                    size += len(texts[end])
                    end += 1
                x, length, count = line_features(texts[at:end])
                score[at:end] = model.score(x, count, length)
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], name])

    schema = StructType([*docs.schema, StructField(name, DoubleType())])
    return docs.select(*cols, F.col(text_col).cast("binary").alias(unused(docs, "text_bytes"))).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, most: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see ``train`` and ``scored`` for nulls and bounds."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1).select("doc_id", "held_out", "text"), train(docs, labels, most))
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@any_names
def keep_good(docs: DataFrame, labels: DataFrame, most: int = 1500) -> DataFrame:
    """``docs`` without those that the classifier rejects (score below 0.5); columns as before, whatever their names.

    Nulls, repeats, long texts and empty tables as in ``scored``; without labels of both classes nothing is rejected.
    """
    name = unused(docs, "quality_score")
    return scored(docs, train(docs, labels, most), name=name).filter(F.col(name) >= 0.5).select(*docs.columns)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality`` of ``documents`` by ``labels``; nulls, ties and odd rows as in ``scored``."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
