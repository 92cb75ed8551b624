"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are runs of letters, lower-cased. Labels are known for documents only, so
tokens are labelled first: a token of a toxic training document is toxic if it or
one of its prefixes occurs in toxic documents and, beyond chance, not in others.
The field has two states (other, toxic), weights for a token's word and prefixes
and one weight for each transition. All of them are fitted by gradient ascent on the
conditional likelihood: forward and backward messages give the marginals of tokens
and of neighbouring pairs, whose sums are what the labels' counts are compared with.
A step that would lower the likelihood is halved, and the fit ends where it no longer
rises. With two states messages are ratios of one number, so a batch of documents is
run through as one array a token at a time. The marginals give offending offsets; their largest log-odds, their sum and
their mean make a document's score through a logistic regression.

Defined results: null and empty texts and texts without letters score as a
document without toxic tokens and have no spans; without labelled toxic and
other documents every score is 0; repeated rows give repeated results; columns
that are not named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.language import hash_below
from genoframe.llm.rows import keep_rows

#: Bounds of the fit: training documents of each kind, and their length.
SAMPLE_TOXIC = 600
SAMPLE_OTHER = 1800
SAMPLE_CHARS = 8_000
#: A feature is toxic evidence from this log-likelihood ratio on, more than twice the
#: logarithm of how many features are tried.
RATIO_ABOVE = 6.0
PREFIXES = (4, 5, 6)
#: Steps of the fit at most, and the relative gain in likelihood below which it ends.
ROUNDS = 40
GAIN = 1e-3
RIDGE = 0.05
SKETCH = 32
#: Documents that are run through the chain together, and the most places of them all.
LANES = 256
PLACES = 1 << 20
CACHE_WORDS = 100_000
SPAN_ODDS = 0.0

words_of = re.compile(r"[^\W\d_]+").findall
tokens_of = re.compile(r"[^\W\d_]+").finditer


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


@dataclass
class Field:
    """Weights for toxic against other, the transitions' weights and the score's."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray | None = None

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def messages(x: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds, of all tokens up to one, and backward odds, of all behind it, of toxic
    for emissions' odds ``x`` (steps by lanes, lanes sorted by falling length; steps
    beyond a lane's length are ignored)."""
    m = np.exp(moves)
    steps = len(x)
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    ahead, behind = x.copy(), np.ones_like(x)
    for t in range(1, steps):
        k = live[t]
        r = ahead[t - 1, :k]
        ahead[t, :k] *= (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        s = x[t + 1, :k] * behind[t + 1, :k]
        behind[t, :k] = (m[1, 0] + m[1, 1] * s) / (m[0, 0] + m[0, 1] * s)
    return ahead, behind


def expected_pairs(x: np.ndarray, ahead: np.ndarray, behind: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected number of each transition, and the logarithm of the sum over all paths."""
    m = np.exp(moves)
    inside = np.arange(1, len(x))[:, None] < lengths[None, :]
    r, s = ahead[:-1][inside], (x * behind)[1:][inside]
    joint = np.array([[np.full_like(r, m[0, 0]), m[0, 1] * s], [m[1, 0] * r, m[1, 1] * r * s]])
    ends = ahead[lengths - 1, np.arange(len(lengths))]
    return (joint / joint.sum((0, 1))).sum(2), float(np.log1p(ends).sum() + np.log(m[0, 0] + m[1, 0] * r).sum())


def lanes_of(sizes: list[int]) -> Iterator[list[int]]:
    """Rows with tokens, longest first, in groups of up to LANES and PLACES."""
    order = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: -sizes[i])
    at = 0
    while at < len(order):
        lanes = max(1, min(LANES, PLACES // sizes[order[at]]))
        yield order[at : at + lanes]
        at += lanes


def _lanes(emissions: list[np.ndarray], moves: np.ndarray) -> Iterator[tuple]:
    for rows in lanes_of([len(e) for e in emissions]):
        lengths = np.array([len(emissions[i]) for i in rows])
        x = np.zeros((lengths[0], len(rows)))
        for lane, i in enumerate(rows):
            x[: lengths[lane], lane] = emissions[i]
        np.exp(np.clip(x, -60, 60), out=x)
        yield rows, lengths, x, *messages(x, lengths, moves)


def odds_of(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Each document's marginal odds, token by token."""
    out = [np.zeros(0)] * len(emissions)
    for rows, lengths, _, ahead, behind in _lanes(emissions, moves):
        odds = ahead * behind
        for lane, i in enumerate(rows):
            out[i] = odds[: lengths[lane], lane]
    return out


def likelihood(emissions: list[np.ndarray], gold: list[np.ndarray], moves: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
    """The labels' log-likelihood, each token's slope by its emission, and the slope by
    each transition's weight."""
    value, slopes, pairs = 0.0, [np.zeros(0)] * len(emissions), np.zeros((2, 2))
    for rows, lengths, x, ahead, behind in _lanes(emissions, moves):
        odds = ahead * behind
        expected, log_z = expected_pairs(x, ahead, behind, lengths, moves)
        pairs -= expected
        value -= log_z
        for lane, i in enumerate(rows):
            y, o = gold[i], odds[: lengths[lane], lane]
            slopes[i] = y - o / (1 + o)
            counts = np.bincount(2 * y[:-1].astype(int) + y[1:], minlength=4).reshape(2, 2)
            pairs += counts
            value += float(np.clip(emissions[i], -60, 60)[y].sum() + (counts * moves).sum())
    return value, slopes, pairs


def summary(odds: np.ndarray) -> tuple[float, float, float, float]:
    if not len(odds):
        return 1.0, -30.0, 0.0, 0.0
    p = odds / (1 + odds)
    return 1.0, max(-30.0, min(30.0, float(np.log(odds.max() + 1e-300)))), float(np.log1p(p.sum())), float(p.mean())


def fit_logistic(a: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def without_copies(texts: list[str]) -> list[str]:
    """One text of each group of near copies, whose words would pass for evidence: those
    that share a quarter of the SKETCH smallest hashes of their runs of three words."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        words = words_of(text.lower())
        runs = {xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))}
        sketch = sorted(runs)[:SKETCH]
        met = Counter(j for h in sketch for j in holders.get(h, ()))
        for j, n in met.items():
            if 4 * n >= len(sketch):
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for h in sketch:
            holders.setdefault(h, []).append(i)
    return [t for i, t in enumerate(texts) if parent[i] == i]


def fit_field(toxic: list[str], other: list[str], share_toxic: float | None = None) -> Field:
    """Fit the field on texts of toxic documents and of others."""
    toxic, other = without_copies(toxic), without_copies(other)
    docs = [words_of(t.lower()) for t in [*toxic, *other]]
    n_tox, n_other = len(toxic), len(other)
    if not n_tox or not n_other:
        return Field()
    seen: tuple[Counter, Counter] = Counter(), Counter()
    known: set[str] = set()
    for i, words in enumerate(docs):
        once = set(words)
        known |= once
        seen[i >= n_tox].update({f for w in once for f in features(w)})
    # evidence: how much likelier a feature's documents are if its rates differ by kind
    evidence: dict[str, float] = {}
    least = RATIO_ABOVE + 2 * np.log(1 + sum(k >= 2 for k in seen[0].values()))
    for f, k in seen[0].items():
        q = seen[1].get(f, 0)
        rate, both = k / n_tox, (k + q) / (n_tox + n_other)
        if k >= 2 and rate > 5 * (q + 0.1) / n_other:
            llr = 2 * (k * np.log(rate / both) + (q * np.log(q / n_other / both) if q else 0))
            if llr >= least:
                evidence[f] = llr
    kept = [f for f, k in seen[0].items() if k + seen[1].get(f, 0) >= 3 and k] + [f for f, q in seen[1].items() if q >= 20 and f not in seen[0]]
    index = {f: i + 1 for i, f in enumerate(kept)}
    width = 1 + len(PREFIXES)
    rows: dict[str, tuple[list[int], bool]] = {}
    for w in known:
        fs = features(w)
        ids = [index.get(f, 0) for f in fs]
        rows[w] = ids + [0] * (width - len(ids)), any(f in evidence for f in fs)
    ids = [np.array([rows[w][0] for w in d], dtype=np.int32).reshape(-1, width) for d in docs]
    gold = [np.array([rows[w][1] and i < n_tox for w in d], dtype=bool) for i, d in enumerate(docs)]
    use = [i for i in range(len(docs)) if len(docs[i]) and (i >= n_tox or gold[i].any())]
    if not any(g.any() for g in gold):
        return Field()
    del seen, known, rows, index
    flat, y = np.concatenate([ids[i] for i in use]), [gold[i] for i in use]
    lengths = np.array([len(ids[i]) for i in use])
    starts = (np.cumsum(lengths) - lengths)[1:]
    pairs = sum(np.bincount(2 * g[:-1].astype(int) + g[1:], minlength=4).reshape(2, 2) for g in y)
    n_gold = sum(int(g.sum()) for g in y)
    # weights start at 0, transitions at the labels' rates; that of other to other stays 0
    moves = np.log((pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True))
    moves, bias, w = moves - moves[0, 0], -2.0, np.zeros(len(kept) + 1)
    # steps are divided by how many tokens, or pairs of them, a weight stands in
    total = np.bincount(flat.ravel(), minlength=len(w)).astype(float)
    speed_w, speed_moves = 4 / (total + 4), 1 / (pairs + 10)
    speed_w[0] = speed_moves[0, 0] = 0

    def valued(w: np.ndarray, bias: float, moves: np.ndarray) -> tuple:
        value, slopes, by_move = likelihood(np.split(bias + w[flat].sum(1), starts), y, moves)
        slope = np.concatenate(slopes)
        by_w = np.bincount(flat.ravel(), weights=np.repeat(slope, width), minlength=len(w)) - RIDGE * w
        return value - RIDGE / 2 * float(w @ w), by_w, float(slope.sum()), by_move

    value, by_w, by_bias, by_move = valued(w, bias, moves)
    pace, push_w, push_bias, push_move = 1.0, 0.0, 0.0, 0.0
    for _ in range(ROUNDS):
        push_w = 0.8 * push_w + np.clip(speed_w * by_w, -1, 1)
        push_bias = 0.5 * push_bias + float(np.clip(by_bias / (n_gold + 10), -1, 1))
        push_move = 0.5 * push_move + np.clip(speed_moves * by_move, -1, 1)
        tried = w + pace * push_w, bias + pace * push_bias, moves + pace * push_move
        found = valued(*tried)
        if found[0] < value:
            pace, push_w, push_bias, push_move = pace / 2, 0.0, 0.0, 0.0
            continue
        gain, (w, bias, moves), (value, by_w, by_bias, by_move) = found[0] - value, tried, found
        if gain < GAIN * abs(value):
            break
    model = Field({f: float(w[i]) for i, f in enumerate(kept, 1) if abs(w[i]) > 1e-3}, bias, moves)
    found = odds_of([bias + w[x].sum(1) for x in ids], moves)
    a = np.array([summary(o) for o in found])
    label = np.arange(len(docs)) < n_tox
    # the two kinds are drawn at rates of their own; the score is for rows as they come
    shift = 0.0 if share_toxic is None else np.log(max(share_toxic, 1e-6) / max(1 - share_toxic, 1e-6)) - np.log(n_tox / n_other)
    model.score = fit_logistic(a, label.astype(float))
    model.score[0] += shift
    return model


class Scorer:
    def __init__(self, model: Field):
        self.model = model
        self.known: dict[str, float] = {}

    def emissions(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0)
        words = words_of(text.lower())
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=float)
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            emission = self.model.emission
            for w in words:
                if w not in known:
                    known[w] = emission(w)
            return np.array([known[w] for w in words], dtype=float)

    def spans(self, text: str, odds: np.ndarray) -> list[dict]:
        """Runs of toxic tokens by character offset in the text."""
        hot = np.flatnonzero(odds > np.exp(SPAN_ODDS))
        if not len(hot):
            return []
        wanted, out = set(hot.tolist()), []
        lower = text.lower()
        same = len(lower) == len(text)
        before = -2
        for i, m in enumerate(tokens_of(lower)):
            if i in wanted:
                p = float(odds[i] / (1 + odds[i]))
                a, b = m.span() if same else (len(_back(text, m.start())), len(_back(text, m.end())))
                if before == i - 1:
                    out[-1] |= {"end": b, "p": max(out[-1]["p"], p)}
                else:
                    out.append({"start": a, "end": b, "p": p})
                before = i
        return out

    def _scores(self, found: list[np.ndarray]) -> list[float]:
        z = np.array([summary(o) for o in found]).reshape(len(found), -1) @ self.model.score
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.model.score is None or not texts:
            return [0.0] * len(texts)
        return self._scores(odds_of([self.emissions(t) for t in texts], self.model.moves))

    def batch(self, texts: list[str | None]) -> tuple[list[float], list[list[dict]]]:
        """Scores and spans."""
        if self.model.score is None or not texts:
            return [0.0] * len(texts), [[] for _ in texts]
        found = odds_of([self.emissions(t) for t in texts], self.model.moves)
        return self._scores(found), [self.spans(t, o) if t else [] for t, o in zip(texts, found, strict=True)]


def _back(text: str, at: int) -> str:
    """The part of ``text`` whose lower-cased form has ``at`` characters."""
    n = 0
    for i, c in enumerate(text):
        if n >= at:
            return text[:i]
        n += len(c.lower())
    return text


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Field:
    """Fit on a bounded sample, chosen by hash, of documents with a text and a label of
    0 or 1. The sample is drawn from ``labels``, so that no text is shuffled."""
    known = labels.select(F.col(key).alias("key"), F.col(toxic).cast("int").alias("y")).where(F.col("key").isNotNull() & F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Field()
    share = F.when(F.col("y") == 1, SAMPLE_TOXIC / counts[1]).otherwise(SAMPLE_OTHER / counts[0])
    most = 2 * (SAMPLE_TOXIC + SAMPLE_OTHER)
    drawn = known.where(hash_below("key", share)).orderBy(F.xxhash64("key"), "y").limit(most)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = rows.join(F.broadcast(drawn), "key").orderBy(F.xxhash64("key"), "y", "text").limit(most)
    texts: tuple[list[str], list[str]] = [], []
    for r in rows.collect():
        texts[1 - r["y"]].append(r["text"])
    return fit_field(texts[0], texts[1], counts[1] / (counts[0] + counts[1]))


_loaded: dict[int, Scorer] = {}


def _scorer(model: Field) -> Scorer:
    """One scorer a worker, so that its words stay known from task to task."""
    if id(model) not in _loaded:
        _loaded.clear()
        _loaded[id(model)] = Scorer(model)
    return _loaded[id(model)]


def drop_toxic(docs: DataFrame, model: Field, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, as they are, whose score is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decider():
        scorer = _scorer(shared.value)
        return lambda texts: [s < threshold for s in scorer.scores(texts)]

    return keep_rows(docs, text, decider)


def score(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` and the ``spans`` (start, end, p) of every row; one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores, spans = scorer.batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)], names=[key, "score", "spans"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, score double, spans array<struct<start:int,end:int,p:double>>")
