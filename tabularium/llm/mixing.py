"""Mixing to target weights with soft domains: a classifier gives posteriors, least squares gives document rates.

Domains are high, low and toxic. Two logistic classifiers (quality, toxic) learn from a bounded sample of
labelled documents whose own label is known, over words weighted by their shrunk log ratio between the classes and shares
of punctuation.
Every document then has posteriors of the domains and a token count (words). Rates are nonnegative and bring each
domain's expected tokens, sum of rate * tokens * posterior, to its target: projected gradient steps from rate 1,

    rate <- max(0, rate - posterior . G^-1 (totals - targets)),   G = sum of tokens * posterior posterior',

the gradient of the least squares in the metric of G with each document's step scaled by its tokens, so that a
step of 1 is safe. While it pays, G sums only the documents whose rate isn't nought yet, which takes few steps to targets
that can be reached. A step needs one aggregate of as few numbers as domains and pairs of them; rates stay columns.

The steps are few numbers for each domain, so a second pass over the texts (``realise``) can apply them again and
put out whole documents without joining or shuffling texts.

Edge cases: null and wordless texts have no tokens and rate 1 throughout; a null label teaches its own
classifier nothing, labels of missing documents teach nothing; with one class labelled its classifier gives that class, without labels all is high and nothing toxic; repeated
documents and equal texts have equal rates; targets that no rates reach are approached as far as they go, and ``target_miss`` says
how far; very long texts are scored whole; an empty table gives an empty result; extra columns are ignored by ``mix_rates`` and kept by ``realise``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import spent, staged
from .textkit import U64, blocks, words

DOMAINS = ("high", "low", "toxic")
#: Labelled documents that the classifiers learn from at most, in expectation: of each label pair.
FIT_ROWS = 3000
#: Words fall in so many buckets that in a long text of many words hardly one shares the bucket of a telling one.
BITS = 21
BUCKETS = 1 << BITS
#: Rows that every word starts with, the squared standard errors at which a ratio counts half, parts of the labelled rows.
PRIOR, DOUBT, FOLDS = 1.0, 30.0, 10
TARGETS = {"high": 0.75, "low": 0.2, "toxic": 0.05}
STEPS, TOLERANCE = 100, 1e-5
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n0"


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word buckets of all texts, offsets, [texts, marks] log rates of punctuation, words of each text)."""
    hashed, at = words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    pair = np.unique(doc << BITS | (hashed & U64(BUCKETS - 1)).astype(np.int64))
    offsets = np.searchsorted(pair >> BITS, np.arange(len(texts) + 1))
    marks = np.zeros((len(texts), len(_MARKS)))
    for i, t in enumerate(texts):
        raw = np.bincount(np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        marks[i] = np.log1p(100.0 * raw[list(_MARKS)] / max(1, raw.sum()))
    return pair & (BUCKETS - 1), offsets, marks, np.diff(at)


@dataclass
class Classifier:
    """ratio [BUCKETS]: log ratio of a word; weight over (ratio sum, strongest, weakest, marks..., 1); scale of these.

    ``always``: the probability of every text where one class at most was labelled.
    """

    ratio: np.ndarray
    weight: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    always: float | None = None

    def inputs(self, bucket, offsets, marks):
        n = len(marks)
        value = self.ratio[bucket].astype(float)
        total, top, low = np.zeros(n), np.zeros(n), np.zeros(n)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            at = offsets[full]
            total[full], top[full], low[full] = np.add.reduceat(value, at), np.maximum.reduceat(value, at), np.minimum.reduceat(value, at)
            total[full] /= np.sqrt(np.diff(offsets)[full])
        return np.column_stack([total, np.maximum(top, 0), np.minimum(low, 0), marks])

    def probability(self, bucket, offsets, marks):
        if self.always is not None:
            return np.full(len(marks), self.always)
        x = (self.inputs(bucket, offsets, marks) - self.centre) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weight[:-1] + self.weight[-1], -30, 30)))


def ratios(bucket, owner, label) -> np.ndarray:
    """Log ratio of each word's shares in the classes 1 and 0, shrunk smoothly by its doubt.

    A word starts with ``PRIOR`` rows dealt to the classes by their sizes, so an unseen one has ratio 0. Its ratio
    counts z^2 / (z^2 + DOUBT) for z standard errors: rare one-sided words keep a part that adds up in a text.
    """
    counts = [np.bincount(bucket[(label == c)[owner]], minlength=BUCKETS) for c in (0, 1)]
    rows = [max(1, int((label == c).sum())) for c in (0, 1)]
    seen = [c + PRIOR * n / sum(rows) for c, n in zip(counts, rows)]
    ratio = np.log(seen[1] / rows[1]) - np.log(seen[0] / rows[0])
    z2 = ratio * ratio / (1 / seen[0] + 1 / seen[1])
    return (ratio * z2 / (z2 + DOUBT)).astype(np.float32)


def train(bucket, offsets, marks, label, unknown: float = 0.5) -> Classifier:
    """Logistic regression on the summary of word ratios and on marks.

    The regression sees each row by ratios from the other folds' rows, else words of one row would speak for its label.
    """
    label = np.asarray(label, float)
    owner = np.repeat(np.arange(len(label)), np.diff(offsets))
    made = Classifier(ratios(bucket, owner, label), np.zeros(0), np.zeros(0), np.ones(0))
    fold = np.zeros(len(label), int)
    for c in (0, 1):
        fold[label == c] = np.arange((label == c).sum()) % FOLDS
    x = made.inputs(bucket, offsets, marks)
    for k in range(FOLDS):
        rest = (fold != k)[owner]
        other = Classifier(ratios(bucket[rest], owner[rest], np.where(fold != k, label, -1)), np.zeros(0), np.zeros(0), np.ones(0))
        x[fold == k] = other.inputs(bucket, offsets, marks)[fold == k]
    made.centre, made.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    x = np.column_stack([(x - made.centre) / made.scale, np.ones(len(label))])
    made.weight = np.zeros(x.shape[1])
    base = float(np.clip(label.mean() if len(label) else unknown, 1e-3, 1 - 1e-3))
    made.weight[-1] = np.log(base / (1 - base))
    if len(set(label.tolist())) < 2:
        made.always = float(label[0]) if len(label) else unknown
        return made
    for _ in range(30):  # Newton steps with a small ridge
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ made.weight, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (label - p) - made.weight)
        made.weight += step
        if np.abs(step).max() < 1e-6:
            break
    return made


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Classifier, Classifier]:
    """(quality, toxic) from ``fit_rows`` labelled documents of each label pair at most, chosen by a hash of the id; one label of a pair may be null."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select("doc_id", "quality", "toxic")
    counts = known.groupBy("quality", "toxic").count().collect()  # eight rows
    share = F.lit(1.0)
    for r in counts:
        if r["count"] > fit_rows:
            share = F.when(F.col("quality").eqNullSafe(r["quality"]) & F.col("toxic").eqNullSafe(r["toxic"]), F.lit(fit_rows / r["count"])).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # at most some twenty-four thousand ids and label pairs
    taught = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            for block in blocks(zip(*(c.to_pylist() for c in batch.columns)), 1):
                bucket, at, marks, _ = features([b[1] for b in block])
                rows = [(b[0], bucket[i:j].astype(np.uint32).tobytes(), marks[n].astype(np.float32).tobytes(), b[2], b[3]) for n, (b, i, j) in enumerate(zip(block, at[:-1], at[1:]))]
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "words", "marks", "quality", "toxic"])

    held = taught.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int"), F.col("toxic").cast("int")).mapInArrow(run, "doc_id long, words binary, marks binary, quality int, toxic int").toArrow().sort_by("doc_id")
    word = [np.frombuffer(w, np.uint32).astype(np.int64) for w in held["words"].to_pylist()]
    marks = np.array([np.frombuffer(m, np.float32) for m in held["marks"].to_pylist()]).reshape(len(word), len(_MARKS))

    def taught_by(column, unknown):
        at = np.flatnonzero(held[column].is_valid().to_numpy())
        own = [word[i] for i in at]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in own], dtype=np.int64)]).astype(np.int64)
        return train(np.concatenate([np.empty(0, np.int64), *own]), offsets, marks[at], held[column].drop_null().to_numpy(), unknown)

    return taught_by("quality", 1.0), taught_by("toxic", 0.0)


def _shares(texts: list[str | None], quality: Classifier, toxic: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """(words, [texts, domains] posteriors)."""
    bucket, at, marks, n = features(texts)
    q, t = quality.probability(bucket, at, marks), toxic.probability(bucket, at, marks)
    return n, np.column_stack([q * (1 - t), (1 - q) * (1 - t), t])


def posteriors(docs: DataFrame, quality: Classifier, toxic: Classifier) -> DataFrame:
    """doc_id, tokens, p_high, p_low, p_toxic of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for block in blocks(zip(*(c.to_pylist() for c in batch.columns)), 1):
                n, p = _shares([t for _, t in block], quality, toxic)
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in block], batch.schema[0].type), pa.array(n, pa.int64()), *(pa.array(p[:, i]) for i in range(3))], ["doc_id", "tokens", "p_high", "p_low", "p_toxic"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, tokens long, p_high double, p_low double, p_toxic double")


def _weighted(parts: list[Column]) -> list[Column]:
    return [F.coalesce(F.sum(x), F.lit(0.0)) for x in parts]


@dataclass
class Fit:
    """pulls: the steps, a number for each domain; reached and wanted: expected tokens by domain; whole: all expected tokens."""

    pulls: list[np.ndarray]
    reached: np.ndarray
    wanted: np.ndarray
    whole: float

    @property
    def miss(self) -> float:
        """The largest distance from a target, as a share of all tokens."""
        return float(np.abs(self.reached - self.wanted).max() / self.whole)

    def rate(self, p: np.ndarray) -> np.ndarray:
        """Rates of documents with posteriors p [documents, domains]."""
        out = np.ones(len(p))
        for pull in self.pulls:
            out = np.maximum(0.0, out - sum((p[:, i] * float(g) for i, g in enumerate(pull)), 0.0))
        return out


def rates(soft: DataFrame, targets: dict[str, float] | None, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, Fit]:
    """(``soft`` with column rate, how it was reached).

    ``targets``: shares of all tokens by domain; None aims at the totals of the documents that are likelier
    of another domain than toxic, so that rates fall for the others.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    tokens = F.col("tokens").cast("double")
    k = len(DOMAINS)

    def sums(rate):
        """Expected tokens by domain and G of the documents whose rate isn't nought."""
        live = tokens * F.when(rate > 0, 1.0).otherwise(0.0)
        got = soft.select(*p, tokens.alias("tokens"), rate.alias("_rate"), live.alias("_live")).agg(
            *_weighted([F.col("_rate") * F.col("tokens") * x for x in p]), *_weighted([F.col("_live") * x * y for x in p for y in p])
        ).first()
        return np.array(got[:k]), np.array(got[k:]).reshape(k, k)

    totals, gram = sums(F.lit(1.0))
    whole = max(1.0, totals.sum())
    if targets is None:
        wanted = np.array(soft.where("p_toxic < greatest(p_high, p_low)").agg(*_weighted([tokens * x for x in p])).first())
    else:
        wanted = np.array([targets[d] for d in DOMAINS]) * totals.sum()
    back = np.linalg.pinv(gram, rcond=1e-9)
    rate, depth, pulls, narrow = F.lit(1.0), 0, [], True
    for _ in range(steps):
        off = totals - wanted
        if np.abs(off).max() <= tolerance * whole:
            break
        if depth == 12:  # keeps the expression short
            before, soft = soft, staged(soft.withColumn("so_far", rate), "rates")
            if "so_far" in before.columns:
                spent(before)
            rate, depth = F.col("so_far"), 0
        pull = (np.linalg.pinv(gram, rcond=1e-9) if narrow else back) @ off
        next_rate = F.greatest(F.lit(0.0), rate - sum((x * F.lit(float(g)) for x, g in zip(p, pull)), F.lit(0.0)))
        now, next_gram = sums(next_rate)
        was, gap = off @ back @ off, (now - wanted) @ back @ (now - wanted)
        if narrow and gap >= 0.9 * was:
            narrow = False
            continue
        pulls.append(pull)
        rate, totals, gram, depth = next_rate, now, next_gram, depth + 1
        if not narrow and was - gap <= 1e-3 * was:
            break
    return soft.withColumn("rate", rate).drop("so_far"), Fit(pulls, totals, wanted, whole)


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of expectation ``rate``: the fraction is decided by a hash of the key."""
    part = F.pmod(F.xxhash64(F.lit("draw"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, p_high, p_low, p_toxic, rate, n_copies, target_miss of every row; ``targets`` as in ``rates``.

    ``target_miss`` is the same in all rows: what the reached totals miss of the targets, as a share of all tokens.
    """
    soft = staged(posteriors(docs, *fit(docs, labels)), "soft")
    out, how = rates(soft, targets)
    return out.withColumn("n_copies", copies(F.col("rate"), F.col("doc_id"))).withColumn("target_miss", F.lit(how.miss))


def realise(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, nearest: bool = False) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as its rate says.

    A rate's fraction is decided by a hash of the text, or, with ``nearest``, by rounding, so that documents that the targets
    want whole are never lost by a draw. The texts go through the classifiers twice and are not shuffled.
    """
    models = fit(docs, labels)
    soft = staged(posteriors(docs, *models), "soft")
    _, how = rates(soft, targets)
    spent(soft)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for batch in batches:
            times = []
            for block in blocks(((t,) for t in batch.column(at).to_pylist()), 0):
                texts = [t for t, in block]
                rate = how.rate(_shares(texts, *models)[1])
                if nearest:
                    part = 0.5
                else:
                    part = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts]) / 2.0**32
                times += np.floor(rate + 1.0 - part).astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(np.repeat(np.arange(len(batch)), times), pa.int64())).columns, names)

    return docs.mapInArrow(run, docs.schema)
