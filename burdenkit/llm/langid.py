"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are byte 3- and 4-grams of lower-cased words with their boundaries, hashed to buckets. Training is
plain stochastic gradient descent in numpy on a bounded sample; a part of it that is not trained on sets a
temperature and the probability below which a prediction is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut, hash_share, table

BITS = 16
_CHUNK = 1 << 20
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123], _FOLD[65:91], _FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def buckets(text: bytes) -> np.ndarray:
    """Hashed subwords of a text; n-grams go across no word boundary but may begin or end with one."""
    x = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    out = []
    space = x == 32
    for n in (3, 4):
        if len(x) < n:
            continue
        size = len(x) - n + 1
        code, inside = np.full(size, n, np.uint32), np.zeros(size, bool)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ x[k : k + size]
            if 0 < k < n - 1:
                inside |= space[k : k + size]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append((code >> np.uint32(32 - BITS))[~inside])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class LanguageModel:
    """Embeddings and softmax folded into one table of logits by bucket, with temperature and rejection level."""

    def __init__(self, langs: list[str], logits: np.ndarray, temperature: float = 1.0, reject: float = 0.0):
        self.langs, self.logits, self.temperature, self.reject = langs, logits, temperature, reject

    def raw(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(text), _CHUNK):
            b = buckets(text[max(0, at - 3) : at + _CHUNK] if at else text[:_CHUNK])
            total += self.logits[b].sum(0, dtype=np.float64)
            n += len(b)
        return total / max(n, 1)

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        z = raw / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)


def fit(langs: list[str], samples: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 42) -> LanguageModel:
    """SGD over (buckets, shares, label) samples; every fifth is left for calibration."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32)
    learn = [s for k, s in enumerate(samples) if k % 5 or len(samples) < 50]
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs) + 0.01)
        for k in rng.permutation(len(learn)):
            idx, share, y = learn[k]
            h = share @ emb[idx]
            z = h @ soft
            z = np.exp(z - z.max())
            z /= z.sum()
            z[y] -= 1
            back = soft @ z
            soft -= step * np.outer(h, z)
            emb[idx] -= (step * len(idx) ** 0.5) * share[:, None] * back
    model = LanguageModel(langs, emb @ soft)
    held = [s for k, s in enumerate(samples) if k % 5 == 0] or samples
    raw = np.array([share @ model.logits[idx] for idx, share, _ in held])
    y = np.array([s[2] for s in held])

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(model.probabilities(raw)[np.arange(len(y)), y] + 1e-12).mean())

    model.temperature = min((2.0**k for k in np.arange(-4, 4.1, 0.25)), key=loss)
    p = model.probabilities(raw)
    right = p.max(1)[p.argmax(1) == y]
    model.reject = float(np.quantile(right, 0.01)) if len(right) else 1.0
    return model


def train(docs: DataFrame, most: int = 400, pieces: int = 4, piece: int = 300, total: int = 20_000) -> LanguageModel | None:
    """Learn from at most ``most`` documents a language (by the order of their ids' hash) whose crc32 remainder by 3 is not 1.

    With over ``total`` / ``most`` languages each gives at most its share of ``total`` (one at least). A document gives
    its whole text and ``pieces`` stretches of about ``piece`` bytes. None without any such document.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    # languages are counted first (a row each), so that few more rows than wanted reach a language's window, however many tasks there are
    counts = known.groupBy("lang").agg(F.count("*").alias("_all"))
    counts = cut(counts)
    most = max(1, min(most, total // max(1, counts.count())))
    known = known.join(F.broadcast(counts), "lang").filter(hash_share("doc_id") < 4 * most / F.col("_all")).select("doc_id", "lang")
    first = Window.partitionBy("lang").orderBy(hash_share("doc_id"), "doc_id")
    ids = known.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")

    def features(batches):
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                text = text or b""
                starts = [int((len(text) - piece) * k / pieces) for k in range(pieces)] if len(text) > 2 * piece else []
                for part in [text, *(text[a : a + piece] for a in starts)]:
                    idx, n = np.unique(buckets(part), return_counts=True)
                    if len(idx):
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([idx.astype(np.uint32).tobytes()]), pa.array([(n / n.sum()).astype(np.float32).tobytes()])], names=["lang", "idx", "share"])

    got = rows.select("text", "lang").mapInArrow(features, "lang string, idx binary, share binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["idx"])))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return None
    return fit(langs, [(np.frombuffer(r["idx"], np.uint32), np.frombuffer(r["share"], np.float32), langs.index(r["lang"])) for r in got])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted of each row.

    ``und`` with score 0 for null and empty texts, texts without letters (numbers such as a superscript two are
    none) and where nothing was learned; otherwise the likeliest learned language (ties: the first by name),
    its calibrated probability, and whether that is above the rejection level. Long texts are read whole, in
    chunks. Null ids and repeated rows come out as they are; other columns take no part, whatever their names;
    an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            lang, score, ok = [], [], []
            for text in batch.column(1).to_pylist():
                if model is None or text is None or not any(map(str.isalpha, text)):
                    lang.append("und"), score.append(0.0), ok.append(False)
                    continue
                p = model.probabilities(model.raw(text.encode()))
                k = int(p.argmax())
                lang.append(model.langs[k]), score.append(float(p[k])), ok.append(bool(p[k] >= model.reject))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify`` over ``documents`` with a model of those not held out; nulls and odd rows as there."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")
