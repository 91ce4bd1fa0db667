"""Language of every word span: script ranges narrow the candidates, Viterbi with a switching penalty labels spans.

``fit`` counts hashed letter trigrams (with word edges) for each language over a bounded sample of labelled
rows and learns which scripts a language is written in. A word's score for a language is the sum of its
trigrams' log shares; languages that are not written in the word's script are out, unless none is.
The best path pays ``penalty`` for each change of language. Where a bound on the gain of any detour proves
that one language holds the whole text, that path is taken; all other texts go through the recursion.

Edge cases: null and letterless texts are ``und`` with score 0; without labelled rows all texts are ``und``;
rows without an id are neither held out nor learned from; scripts never seen in training leave all
languages in; equal totals go to the language first in byte order; texts of any length are labelled whole; equal texts get equal
results and repeated rows one each; an empty table teaches nothing and gives an empty result; extra columns are ignored by
``predict`` and ``spans`` and kept by ``keep_known``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import blocks

BUCKETS = 1 << 14
#: Rows of each language that ``fit`` learns from at most (in expectation; chosen by a hash of the id).
FIT_ROWS = 4000
PENALTY = 8.0
_TOP = 0x20000
#: Code point ranges of scripts; what lies outside is "other".
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
_tables: dict[str, np.ndarray] = {}


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form if it is a letter, else 0; its script."""
    if not _tables:
        lower, script = np.zeros(_TOP, np.uint32), np.zeros(_TOP, np.uint8)
        for c in range(_TOP):
            if (s := chr(c)).isalpha():
                lower[c] = ord(x) if len(x := s.lower()) == 1 else c
        for name, a, b in SCRIPTS:
            script[a : b + 1] = SCRIPT_NAMES.index(name)
        _tables["lower"], _tables["script"] = lower, script
    return _tables["lower"], _tables["script"]


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """langs in byte order; table [BUCKETS, langs] of log shares; allowed [scripts, langs]."""

    langs: tuple[str, ...]
    table: np.ndarray
    allowed: np.ndarray

    def __post_init__(self):
        object.__setattr__(self, "columns", [np.ascontiguousarray(c) for c in self.table.T])
        object.__setattr__(self, "out_of_script", np.where(~self.allowed & self.allowed.any(1)[:, None], 50.0, 0.0))


def _letters(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Trigram bucket of each letter, start and end of each word and of each text's words, script of each word."""
    lower, script = _code_tables()
    joined = "\n".join(["", *(t or "" for t in texts), ""])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if raw.max() < _TOP:
        low = lower[raw]
    else:
        low = lower[np.minimum(raw, _TOP - 1)]
        low = np.where((raw >= _TOP) & (raw < 0x323B0), raw, low)  # later ideographs are letters
    has = low > 0
    edges = np.flatnonzero(has[1:] != has[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    gram = low * np.uint32(0x9E3779B1)
    gram[1:-1] = gram[:-2] ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)
    gram = gram[has]
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x2C1B3C6D)
    lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)]) + 1
    return {"gram": gram >> np.uint32(18), "start": start, "end": end, "first": np.cumsum(end - start) - (end - start), "script": script[np.minimum(raw[start], _TOP - 1)], "text": np.searchsorted(start, begins), "begin": begins}


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from text and lang of rows that are not held out; ``fit_rows`` of each language at most, in expectation."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(1.0)
    for lang, n in counts.items():
        if n > fit_rows:
            share = F.when(F.col("lang") == lang, F.lit(fit_rows / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), 1):
                for lang in {b[0] for b in block}:
                    got = _letters([t for x, t in block if x == lang])
                    bins = held.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    bins[:BUCKETS] += np.bincount(got["gram"], minlength=BUCKETS)
                    bins[BUCKETS:] += np.bincount(got["script"], got["end"] - got["start"], len(SCRIPT_NAMES)).astype(np.int64)
        for lang, bins in held.items():
            spot = np.flatnonzero(bins)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(spot), pa.string()), pa.array(spot, pa.int32()), pa.array(bins[spot], pa.int64())], ["lang", "bin", "n"])

    langs = tuple(sorted(counts))
    found = sample.select("lang", "text").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    for lang, spot, n in found.toArrow().to_pandas().itertuples(index=False):  # langs x bins rows, whatever the input
        table[spot, langs.index(lang)] = n
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    return Model(langs, np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32), scripts >= 0.02 * np.maximum(scripts.sum(0), 1))


def _viterbi(score: np.ndarray, penalty: float) -> np.ndarray:
    """Best path over score [words, langs] where every change costs ``penalty``."""
    best, came = score[0].tolist(), []
    for row in score[1:].tolist():
        most = max(best)
        top, least = best.index(most), most - penalty
        came.append([top if b < least else j for j, b in enumerate(best)])
        best = [(least if b < least else b) + x for b, x in zip(best, row)]
    at = best.index(max(best))
    path = [at]
    for step in reversed(came):
        at = step[at]
        path.append(at)
    return np.array(path[::-1], np.int64)


def label(texts: list[str | None], model: Model, penalty: float = PENALTY) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(letters of the texts, language of every word, share that each word gives its language)."""
    got = _letters(texts)
    at, k, n = got["text"], len(model.langs), len(got["start"])
    if not n or not k:
        return got, np.full(n, -1), np.zeros(n)
    score = np.stack([np.add.reduceat(model.columns[j][got["gram"]], got["first"]) for j in range(k)], 1).astype(np.float64)
    score -= model.out_of_script[got["script"]]
    full = np.flatnonzero(np.diff(at) > 0)
    owner = np.repeat(np.arange(len(full)), np.diff(at)[full])
    total = np.add.reduceat(score, at[full], axis=0)
    lead = total.argmax(1)
    path = lead[owner]
    # Leaving the leader for a stretch pays only if some language gains more than the penalty in a run of words;
    # never using it, only if the best gains of a beginning and of an end do so together.
    gain = score - score[np.arange(n), path][:, None]
    far = 4.0 * (np.abs(gain).sum() + 1.0)
    doubtful, begin, finish = np.zeros(len(full), bool), np.full(len(full), -np.inf), np.full(len(full), -np.inf)
    for j in range(k):
        run = np.cumsum(gain[:, j])
        before = np.concatenate([[0.0], run[:-1]])
        floor = np.minimum.accumulate(before - owner * far)
        doubtful |= (np.maximum.reduceat(run - owner * far - floor, at[full]) > penalty) & (lead != j)
        other = lead != j
        begin[other] = np.maximum(begin, np.maximum.reduceat(run, at[full]) - before[at[full]])[other]
        finish[other] = np.maximum(finish, run[at[full + 1] - 1] - np.minimum.reduceat(before, at[full]))[other]
    doubtful |= begin + finish > penalty
    for d in np.flatnonzero(doubtful):
        a, b = at[full[d]], at[full[d] + 1]
        path[a:b] = _viterbi(score[a:b], penalty)
    chosen = score[np.arange(n), path]
    return got, path, 1.0 / np.exp(np.minimum(score - chosen[:, None], 700)).sum(1)


def judge(texts: list[str | None], model: Model, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language of most letters or -1, its part of the words' shares, words, spans) of each text."""
    got, path, share = label(texts, model, penalty)
    n, k = np.diff(got["text"]), max(1, len(model.langs))
    owner = np.repeat(np.arange(len(n)), n)
    if not model.langs:
        return np.full(len(n), -1), np.zeros(len(n)), n, np.zeros(len(n), int)
    top = np.bincount(owner * k + path, got["end"] - got["start"], len(n) * k).reshape(-1, k).argmax(1)
    sure = np.bincount(owner, np.where(path == top[owner], share, 0.0), len(n)) / np.maximum(n, 1)
    turns = np.bincount(owner[1:][(path[1:] != path[:-1]) & (owner[1:] == owner[:-1])], minlength=len(n))
    return np.where(n > 0, top, -1), np.clip(sure, 0.0, 1.0), n, np.where(n > 0, turns + 1, 0)


PREDICT_SCHEMA = "lang_pred string, score double, n_words long, n_spans int"


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_spans.

    lang_pred is the language of most letters; score is its part of the words' shares, so 1 is a sure text of
    one language.
    """

    def run(batches):
        names = [*model.langs, "und"]
        for batch in batches:
            for block in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), 1, 1 << 18):
                top, sure, n, turns = judge([t for _, t in block], model, penalty)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in block], batch.schema[0].type), pa.array([names[j] for j in top.tolist()], pa.string()), pa.array(sure), pa.array(n, pa.int64()), pa.array(turns, pa.int32())], ["doc_id", "lang_pred", "score", "n_words", "n_spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PREDICT_SCHEMA}")


def keep_known(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose labelled spans give a language (``und`` goes); a map, without a shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep: list[bool] = []
            for block in blocks(((t,) for t in batch.column(at).to_pylist()), 0, 1 << 18):
                keep += (judge([t for t, in block], model, penalty)[0] >= 0).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def spans(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, span_no, start, end (code points of the text), lang: runs of words of one language."""

    def run(batches):
        for batch in batches:
            for block in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), 1):
                got, path, _ = label([t for _, t in block], model, penalty)
                rows = []
                for i, (doc_id, _) in enumerate(block):
                    a, b = got["text"][i], got["text"][i + 1]
                    if a == b or not model.langs:
                        continue
                    turn = [a, *(np.flatnonzero(path[a + 1 : b] != path[a : b - 1]) + a + 1).tolist(), b]
                    base = got["begin"][i]
                    rows += [(doc_id, s, int(got["start"][x] - base), int(got["end"][y - 1] - base), model.langs[path[x]]) for s, (x, y) in enumerate(zip(turn, turn[1:]))]
                kinds = [batch.schema[0].type, pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "span_no", "start", "end", "lang"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, span_no int, start long, end long, lang string")
