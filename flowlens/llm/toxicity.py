"""Toxicity of documents from a linear-chain conditional random field over their tokens.

Tokens are runs of letters, digits and non-ASCII characters, lower-cased. Two states, toxic span or not. A token's score is
the sum of hashed weights of the token itself, of its beginnings and endings and of its two neighbours; a 2 x 2 matrix scores the
step between neighbours. Forward-backward marginals are exact: a text is one chain of any length.

Fit (`fit`). Only documents are labelled, so tokens get their labels from them: a token is toxic in a toxic document when it, or
one of its beginnings or endings, is far more frequent among toxic than among other documents of the training rows. The
field is fitted to these labels by gradient steps on the likelihood; a logistic curve, fitted to a quarter of the rows that the
field has not seen, turns the marginals of a document (their expected number and the largest one) into its score. The fit uses at most `max_rows` labelled rows of each class, the first in the order of a
hash of the doc_id; `max_rows` bounds what the fitting task holds.

Score (`score`). Every whole text, in Arrow batches, with the fitted weights (their size is fixed by `bits`) shipped to the tasks.

Defined results: null and empty texts have no tokens and get the score of no evidence; rows are scored one by one; labels that are
null are not used; extra columns stay; without labelled rows of both classes the score is the share of the toxic ones (0 if none).
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import kernels as K
from flowlens.llm.exchange import give_rest, keep_rest, tidy

BITS = 20
BEGINNINGS = (3, 4, 5, 6)  # bytes
ENDINGS = (3, 4, 5)
LANE = 128
TOKEN_BYTES = K.LOWER.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        TOKEN_BYTES[_b] = 32
MADE = ("score", "n_toxic_tokens", "spans")


@dataclass
class Model:
    active: np.ndarray  # numbers of the features with a weight
    values: np.ndarray
    bias: float
    step: np.ndarray  # 2 x 2 scores of neighbouring states
    curve: tuple[float, ...]  # logistic curve over the marginals of a document
    bits: int

    def weights(self) -> np.ndarray:
        every = np.zeros(1 << self.bits, np.float32)
        every[self.active] = self.values
        return every


def tokens(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Weight numbers of every token, one array per feature (0: none; the last two are the neighbours), first and end bytes, and
    the number of tokens before each text."""
    data = TOKEN_BYTES[data]
    starts, ends, bounds = K.words(data, offsets)
    sums = K.prefix_sums(K.byte_values(data))
    shift = np.uint64(64 - bits)

    def number(value, kind):
        return (K.mix(value + np.uint64(kind)) >> shift).astype(np.int32)

    token = K.span_hash(sums, starts, ends)
    found = [number(token, 1)]
    long_ = ends - starts
    for n in BEGINNINGS:
        part = number(K.span_hash(sums, starts, np.minimum(starts + n, ends)), 10 + n)
        found.append(np.where(long_ > n, part, 0))
    for n in ENDINGS:
        part = number(K.span_hash(sums, np.maximum(ends - n, starts), ends), 20 + n)
        found.append(np.where(long_ > n, part, 0))
    before, after = number(token, 2), number(token, 3)
    if len(token):
        before, after = np.concatenate([[0], before[:-1]]), np.concatenate([after[1:], [0]])
        full = np.flatnonzero(np.diff(bounds))
        before[bounds[full]] = 0
        after[bounds[full + 1] - 1] = 0
    return [*found, before, after], starts, ends, bounds


def marginals(score: np.ndarray, bounds: np.ndarray, step: np.ndarray):
    """Probability of the toxic state of each token, and expected steps between states (2 x 2), summed over all tokens.

    The tokens are laid out in lanes that advance together. A first sweep gives each lane's 2 x 2 product, which links the
    lanes in both directions; a second sweep then yields the exact forward and backward values of every token.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    lanes = -(-n // LANE)
    gain = np.exp(np.clip(score, -30, 30))
    start = np.zeros(n, bool)
    start[bounds[:-1][np.diff(bounds) > 0]] = True

    def lay(x, fill):
        out = np.full(lanes * LANE, fill, x.dtype)
        out[:n] = x
        return out.reshape(lanes, LANE).T.copy()

    gain, start = lay(gain, 1.0), lay(start, True)
    a = np.exp(step)
    # step matrices: the state before (row) to the state of the token (column), with the token's gain; a start forgets the past
    m00 = np.where(start, 1.0, a[0, 0])
    m10 = np.where(start, 1.0, a[1, 0])
    m01 = np.where(start, 1.0, a[0, 1]) * gain
    m11 = np.where(start, 1.0, a[1, 1]) * gain
    p = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(LANE):
        x, y, z, w = p
        x, y = x * m00[t] + y * m10[t], x * m01[t] + y * m11[t]
        z, w = z * m00[t] + w * m10[t], z * m01[t] + w * m11[t]
        top = x + y + z + w
        p = x / top, y / top, z / top, w / top
    products = np.stack(p, axis=1)
    into, back = np.zeros((lanes, 2)), np.ones((lanes, 2))
    f0, f1 = 0.5, 0.5
    for i in range(lanes):
        into[i] = f0, f1
        x, y, z, w = products[i]
        f0, f1 = f0 * x + f1 * z, f0 * y + f1 * w
        f0, f1 = f0 / (f0 + f1), f1 / (f0 + f1)
    b0, b1 = 1.0, 1.0
    for i in range(lanes - 1, -1, -1):
        back[i] = b0, b1
        x, y, z, w = products[i]
        b0, b1 = x * b0 + y * b1, z * b0 + w * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    ahead = np.zeros((LANE, lanes, 2))
    ahead[LANE - 1] = back
    for t in range(LANE - 1, 0, -1):
        c0, c1 = ahead[t, :, 0], ahead[t, :, 1]
        d0, d1 = m00[t] * c0 + m01[t] * c1, m10[t] * c0 + m11[t] * c1
        ahead[t - 1, :, 0], ahead[t - 1, :, 1] = d0 / (d0 + d1), d1 / (d0 + d1)
    f0, f1 = into[:, 0], into[:, 1]
    out = np.zeros((LANE, lanes))
    steps = np.zeros((2, 2))
    for t in range(LANE):
        e00, e01 = f0 * m00[t] * ahead[t, :, 0], f0 * m01[t] * ahead[t, :, 1]
        e10, e11 = f1 * m10[t] * ahead[t, :, 0], f1 * m11[t] * ahead[t, :, 1]
        total = e00 + e01 + e10 + e11
        out[t] = (e01 + e11) / total
        real = ~start[t] / total
        steps += [[(e00 * real).sum(), (e01 * real).sum()], [(e10 * real).sum(), (e11 * real).sum()]]
        g0, g1 = f0 * m00[t] + f1 * m10[t], f0 * m01[t] + f1 * m11[t]
        f0, f1 = g0 / (g0 + g1), g1 / (g0 + g1)
    return out.T.ravel()[:n], steps


def token_scores(weights: np.ndarray, bias: float, found: list[np.ndarray]) -> np.ndarray:
    return bias + sum(weights[f] for f in found)


def evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: 1, log of one plus the expected number of toxic tokens, and the largest marginal."""
    total = np.concatenate([[0.0], np.cumsum(p)])
    expected = total[bounds[1:]] - total[bounds[:-1]]
    most = np.zeros(len(bounds) - 1)
    np.maximum.at(most, np.repeat(np.arange(len(most)), np.diff(bounds)), p)
    return np.stack([np.ones(len(most)), np.log1p(np.maximum(expected, 0)), most], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    return w


def token_labels(found: list[np.ndarray], text: np.ndarray, toxic: np.ndarray, bits: int, least_ratio: float,
                 least_surprise: float) -> np.ndarray:
    """1 for the tokens of toxic texts with a feature that is far more frequent among toxic texts, else 0.

    The surprise is the exponent of the chance of so many toxic texts if the feature had nothing to do with toxicity: there are many
    rare features, so a few must not stand out by luck.
    """
    share = toxic.mean()
    marked = np.zeros(len(text), bool)
    for f in found[:-2]:
        seen = np.unique(f.astype(np.int64) * len(toxic) + text)
        number, doc = seen // len(toxic), seen % len(toxic)
        bad = np.bincount(number, weights=toxic[doc], minlength=1 << bits)
        good = np.bincount(number, minlength=1 << bits) - bad
        rate = (bad + 0.5) / (toxic.sum() + 1) / ((good + 0.5) / ((~toxic).sum() + 1))
        part = np.clip(bad / np.maximum(bad + good, 1), 1e-9, 1 - 1e-9)
        surprise = (bad + good) * (part * np.log(part / share) + (1 - part) * np.log((1 - part) / (1 - share)))
        strong = (surprise >= least_surprise) & (rate >= least_ratio)
        strong[0] = False
        marked |= strong[f]
    return (marked & toxic[text]).astype(float)


def fit_texts(texts: pa.Array, toxic: np.ndarray, bits: int = BITS, rounds: int = 15, least_tokens: int = 5,
              least_ratio: float = 10.0, surprises: tuple[float, ...] = (18.0, 13.0)) -> Model:
    """The field fitted to texts and their labels, in memory.

    About every fourth text serves the curve only; it also decides which of `surprises` labels the tokens.
    """
    held = K.mix(np.arange(len(toxic), dtype=np.uint64)) % np.uint64(4) == 3
    data, offsets = K.text_bytes(texts.filter(pa.array(~held)))
    found, _, _, bounds = tokens(data, offsets, bits)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    data, offsets = K.text_bytes(texts.filter(pa.array(held)))
    other, _, _, other_bounds = tokens(data, offsets, bits)
    best = None
    for surprise in surprises:
        label = token_labels(found, text, toxic[~held], bits, least_ratio, surprise)
        model = _fit_field(found, bounds, label, bits, rounds, least_tokens)
        p, _ = marginals(token_scores(model.weights(), model.bias, other), other_bounds, model.step)
        x, y = evidence(p, other_bounds), toxic[held].astype(float)
        model.curve = tuple(_logistic(x, y).tolist())
        margin = np.clip(x @ np.array(model.curve), -30, 30)
        loss = np.logaddexp(0, np.where(y > 0, -margin, margin)).mean()
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def _fit_field(found, bounds, label, bits, rounds, least_tokens) -> Model:
    size = 1 << bits
    # rare features would only learn single documents, and share their numbers with features of other texts
    positive = sum(np.bincount(f, weights=label, minlength=size) for f in found)
    active = np.flatnonzero(positive >= least_tokens)
    active = active[active > 0]
    place = np.full(size, -1, np.int32)
    place[active] = np.arange(len(active))
    found = [place[f] for f in found]  # -1: the last weight, which stays 0
    size = len(active) + 1
    weights, step = np.zeros(size), np.zeros((2, 2))
    frequent = min(max(label.mean() if len(label) else 0.0, 1e-6), 0.5)
    bias = float(np.log(frequent / (1 - frequent)))
    inner = np.ones(len(label), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    now, prior = label[inner], label[np.flatnonzero(inner) - 1]
    wanted = np.array([[((1 - prior) * (1 - now)).sum(), ((1 - prior) * now).sum()],
                       [(prior * (1 - now)).sum(), (prior * now).sum()]])
    square, square_step, square_bias = np.full(size, 1e-6), np.full((2, 2), 1e-6), 1e-6
    for _ in range(rounds):  # adaptive gradient steps on the penalised likelihood
        p, steps = marginals(token_scores(weights, bias, found), bounds, step)
        off = label - p
        slope = sum(np.bincount(f[f >= 0], weights=off[f >= 0], minlength=size) for f in found) - 0.05 * weights
        slope_step, slope_bias = wanted - steps - 0.05 * step, off.sum()
        square += slope**2
        square_step += slope_step**2
        square_bias += slope_bias**2
        weights += 0.5 * slope / np.sqrt(square)
        step += 0.2 * slope_step / np.sqrt(square_step)
        bias += 0.2 * slope_bias / np.sqrt(square_bias)
    return Model(active, weights[:-1].astype(np.float32), bias, step, (0.0,), bits)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2500, bits: int = BITS) -> Model | float:
    """The model from docs (doc_id, text) and labels (doc_id, toxic: 0 or 1); without both classes, the share of toxic rows.

    The rows are chosen by doc_id before any text is read; one task holds the at most 2 * `max_rows` chosen texts.
    """
    labels = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = [labels.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for value in (0, 1)]
    chosen = F.broadcast(ranked[0].unionByName(ranked[1]))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.xxhash64("doc_id").alias("place"), "text", "toxic")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("text", "ascending")])
        toxic = table["toxic"].to_numpy() == 1
        blob = None
        if toxic.any() and not toxic.all():
            texts = pa.concat_arrays([c.cast(pa.large_string()) for c in table["text"].chunks])
            blob = pickle.dumps(fit_texts(texts, toxic, bits))
        return pa.table({"share": pa.array([float(toxic.mean())]), "model": pa.array([blob], pa.binary())})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "share double, model binary").first()
    if found is None:
        return 0.0
    return found["share"] if found["model"] is None else pickle.loads(found["model"])


def score_texts(model: Model, column: pa.Array, threshold: float):
    """Score, number of tokens above `threshold`, and their (start, end) bytes, per text."""
    scores, counts, spans = [], [], []
    weights = model.weights()
    for _, _, data, offsets in K.chunks(column):
        found, starts, ends, bounds = tokens(data, offsets, model.bits)
        p, _ = marginals(token_scores(weights, model.bias, found), bounds, model.step)
        x = evidence(p, bounds) @ np.array(model.curve)
        scores.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
        hit = np.flatnonzero(p >= threshold)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[hit]
        counts.append(np.bincount(text, minlength=len(bounds) - 1))
        places = np.stack([starts[hit], ends[hit]], axis=1) - offsets[text][:, None]
        spans += np.split(places, np.cumsum(counts[-1])[:-1])
    return np.concatenate(scores or [[]]), np.concatenate(counts or [[]]).astype(np.int64), spans


def score(docs: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """`docs` with score (0 to 1), n_toxic_tokens, and spans: start and end byte of the tokens above `threshold`."""
    kept = keep_rest(docs, "text")
    rest = kept.schema["_rest"].dataType.simpleString()
    if not isinstance(model, Model):
        spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
        return give_rest(kept.select("*", F.lit(model).alias("score"), F.lit(0).cast("long").alias("n_toxic_tokens"),
                                     spans.alias("spans")), *MADE)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^bits weights, whatever the input

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            value, count, spans = score_texts(shipped.value, batch.column("text"), threshold)
            spans = pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in spans], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("text"), batch.column("_rest"), pa.array(value, pa.float64()), pa.array(count, pa.int64()), spans],
                ["text", "_rest", *MADE])

    made = "score double, n_toxic_tokens long, spans array<struct<start:bigint,end:bigint>>"
    return give_rest(kept.mapInArrow(tidy(run), f"text string, _rest {rest}, {made}"), *MADE)
