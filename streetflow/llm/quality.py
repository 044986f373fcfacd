"""Quality classifier: a weak-label model whose posteriors train a hashed linear scorer.

Two questions are asked of each document: is it junk, and is it toxic. For each there are overlapping labellers that fire or abstain
(heuristics on the text, or words mined from labelled rows) and the given labels, which say yes, no or nothing. For all documents
the votes are counted by pattern (a bounded number of patterns); expectation-maximisation on these counts estimates how often each
labeller speaks and errs, and gives each pattern its posterior. The posteriors of a bounded sample train one logistic scorer per
question on hashed words and hashed heuristic levels, with an L1 penalty; the scorers judge every document.

Bounded samples, the only ones: LEXICON_ROWS labelled rows for mining words, TRAIN_ROWS documents for fitting the scorers, both taken
by hash, the second of doc_id and text and, where rows repeat, of twice as many at most. Votes, patterns and scores cover all documents.

Null or empty texts: no votes, no features but the level of length; the scorers judge them as any other. Rows with equal doc_id are
judged one by one; with several labels for an id the worst counts. A null doc_id has no label. Without labels the toxicity scorer
has nothing to learn from and rejects nothing. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm import text as T
from streetflow.llm.shared import on_path, table, tidy, tidy_driver

LEXICON_ROWS, TRAIN_ROWS = 20_000, 10_000
HEURISTICS = (("upper", 0.5), ("symbol", 0.05), ("delimiter", 0.1), ("repeat", 0.2), ("phrase", 0.3), ("shout", 0.1))
FOLDS = 3
LABELLERS = {"junk": len(HEURISTICS), "toxic": FOLDS}
#: bytes of text judged at once
CHUNK = 1 << 20
FEATURE_SPACE = np.uint64((1 << 40) - 1)
#: punctuation of ordinary prose
PROSE = b".,;:'\"!?-()"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and c not in PROSE]] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: bytes between the words of the lexicon and the scorer: all ASCII but letters and digits
GAP = np.zeros(256, bool)
GAP[[c for c in range(128) if not chr(c).isalnum()]] = True


def per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])


def repeats(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """By document, how many values have occurred in it before."""
    own = np.sort(T.mix(h ^ T.mix(doc.astype(np.uint64) + np.uint64(1))) >> np.uint64(1))
    # the document of a repeated value is found again through the sorted keys of all values
    key = T.mix(h ^ T.mix(doc.astype(np.uint64) + np.uint64(1))) >> np.uint64(1)
    order = T.order(key)
    again = np.zeros(len(key), bool)
    again[order[1:][own[1:] == own[:-1]]] = True
    return np.bincount(doc[again], minlength=n)


def levels(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The heuristics' values by document, in the order of HEURISTICS, and the number of words."""
    n, b = len(offs) - 1, buf[: int(offs[-1])]
    starts, lens, first = T.words(buf, offs)
    h, words = T.hash_spans(buf, starts, lens), np.diff(first)
    doc = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    letters = np.maximum(per_doc(IS_LETTER[b], offs), 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    three = h[:-2] * T._GOLD + h[1:-1]
    three = (three * T._GOLD + h[2:])[doc[:-2] == doc[2:]] if len(h) > 2 else np.zeros(0, np.uint64)
    doc3 = doc[:-2][doc[:-2] == doc[2:]] if len(h) > 2 else np.zeros(0, np.int64)
    shout = np.zeros(len(b), bool)
    shout[1:] = (b[1:] == 33) & (b[:-1] == 33)
    return np.stack([
        per_doc((b >= 65) & (b <= 90), offs) / letters * (letters > 20),
        per_doc(IS_SYMBOL[b] & (b != 124), offs) / np.maximum(np.diff(offs), 1),
        np.bincount(doc[(lens == 1) & (buf[starts] == 124)], minlength=n) / some,
        np.bincount(doc[same], minlength=n) / some * (words > 20),
        repeats(three, doc3, n) / np.maximum(words - 2, 1) * (words > 20),
        per_doc(shout, offs) / some,
        words,
    ], 1)


def features(buf: np.ndarray, offs: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of all documents: (document, feature), sorted by document."""
    n = len(offs) - 1
    low = T.lower_ascii(buf)
    starts, lens, first = T.words(low, offs, GAP)
    doc = np.repeat(np.arange(n), np.diff(first))
    f = T.hash_spans(low, starts, lens, 11) & FEATURE_SPACE
    bins = np.minimum(level[:, : len(HEURISTICS)] * 20, 20).astype(np.uint64)
    extra = T.mix(bins + np.arange(len(HEURISTICS), dtype=np.uint64) * np.uint64(64) + np.uint64(1 << 50)) & FEATURE_SPACE
    doc = np.concatenate([doc, np.repeat(np.arange(n), len(HEURISTICS))])
    f = np.concatenate([f, extra.reshape(-1)])
    key = np.unique((doc.astype(np.uint64) << np.uint64(40)) | f)
    return (key >> np.uint64(40)).astype(np.int64), key & FEATURE_SPACE


def word_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = T.lower_ascii(buf)
    starts, lens, first = T.words(low, offs, GAP)
    key = np.unique((np.repeat(np.arange(len(offs) - 1), np.diff(first)).astype(np.uint64) << np.uint64(40)) | (T.hash_spans(low, starts, lens, 11) & FEATURE_SPACE))
    return (key >> np.uint64(40)).astype(np.int64), key & FEATURE_SPACE


def mine(docs: DataFrame, labels: DataFrame, rows: int) -> list[np.ndarray]:
    """FOLDS overlapping lists of words that only toxic rows have: each from all folds of the labelled rows but one."""
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows_ = docs.join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch, most=CHUNK):
                buf, offs = T.text_bytes(chunk.column(0))
                doc, f = word_features(buf, offs)
                fold = (T.hash_spans(buf, offs[:-1], np.diff(offs)) % np.uint64(FOLDS)).astype(np.int64)
                toxic = np.asarray(chunk.column(1)).astype(np.int64)
                key = np.unique(f)
                at = np.searchsorted(key, f)
                cell = at * FOLDS + fold[doc]
                bad = np.bincount(cell, toxic[doc], minlength=FOLDS * len(key)).astype(np.int64)
                all_ = np.bincount(cell, minlength=FOLDS * len(key))
                some = np.flatnonzero(np.repeat(bad.reshape(-1, FOLDS).sum(1) > 0, FOLDS) & (all_ > 0))
                rest = np.flatnonzero(np.repeat(bad.reshape(-1, FOLDS).sum(1) == 0, FOLDS) & (all_ > 0))
                take = np.concatenate([some, rest])
                yield pa.RecordBatch.from_arrays([pa.array(key[take // FOLDS].astype(np.int64)), pa.array(take % FOLDS), pa.array(bad[take]), pa.array(all_[take])], ["f", "fold", "bad", "n"])

    counts = rows_.mapInArrow(tidy(count), "f long, fold long, bad long, n long")
    but = [F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("bad", "n")]
    words = counts.groupBy("f").agg(*but)
    toxic = [(F.col(f"bad{k}") >= 3) & (F.col(f"bad{k}") >= 0.95 * F.col(f"n{k}")) for k in range(FOLDS)]
    got = words.select("f", *[t.alias(f"t{k}") for k, t in enumerate(toxic)]).where(" or ".join(f"t{k}" for k in range(FOLDS))).toPandas()
    return [np.sort(got["f"][got[f"t{k}"]].to_numpy(np.uint64)) for k in range(FOLDS)]


def votes(level: np.ndarray, doc: np.ndarray, f: np.ndarray, lexicons: list[np.ndarray]) -> dict[str, np.ndarray]:
    """A bit for each labeller that fires."""
    junk = sum(((level[:, k] > most).astype(np.int64) << k) for k, (_, most) in enumerate(HEURISTICS))
    toxic = np.zeros(len(level), np.int64)
    for k, words in enumerate(lexicons):
        if len(words):
            hit = words[np.minimum(np.searchsorted(words, f), len(words) - 1)] == f
            toxic |= (np.bincount(doc[hit], minlength=len(level)) > 0).astype(np.int64) << k
    return {"junk": junk, "toxic": toxic}


def expectation_maximisation(patterns: np.ndarray, given: np.ndarray, counts: np.ndarray, labellers: int, steps: int = 300) -> np.ndarray:
    """The posterior of yes for each pattern of votes. given: -1 nothing, 0 no, 1 yes.

    Yes has as many kinds as labellers, since a document may be bad in one way only; each kind, and no, has its own rates at which
    the labellers fire. A given label is right with an estimated accuracy for either answer. Weak pseudo-counts (right more often
    than wrong) keep the answers from changing sides.
    """
    fires = ((patterns[:, None] >> np.arange(labellers)) & 1).astype(float)
    said, total = given >= 0, max(counts.sum(), 1)
    start = np.where(said, np.where(given == 1, 0.95, 0.05), np.where(fires.any(1), 0.8, 0.02))
    share = (fires + 1e-3) / (fires + 1e-3).sum(1, keepdims=True)
    post = np.concatenate([(1 - start)[None], (share * start[:, None]).T])  # no, then the kinds of yes
    for _ in range(steps):
        mass = post * counts
        size = mass.sum(1)
        prior = (size + 0.1) / (total + 0.1 * len(size))
        rate = (mass @ fires + np.concatenate([[np.full(labellers, 0.02)], np.eye(labellers) * 2 + 0.02])) / (size[:, None] + 4)
        yes = 1 - post[0]
        right_yes = ((yes * counts * (given == 1)).sum() + 8) / ((yes * counts * said).sum() + 9)
        right_no = ((post[0] * counts * (given == 0)).sum() + 8) / ((post[0] * counts * said).sum() + 9)
        log = np.log(prior)[:, None] + np.log(rate) @ fires.T + np.log(1 - rate) @ (1 - fires).T
        log[0] += np.where(said, np.log(np.where(given == 1, 1 - right_no, right_no)), 0)
        log[1:] += np.where(said, np.log(np.where(given == 1, right_yes, 1 - right_yes)), 0)
        new = np.exp(log - log.max(0))
        new /= new.sum(0)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return 1 - post[0]


def columns(doc: np.ndarray, f: np.ndarray, least: int = 3, step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place of the feature in keys) of the features that occur `least` times, and these features, the keys. Beyond its
    arguments and result it holds about a sorted copy of f."""
    s = np.sort(f)
    ends = np.flatnonzero(np.concatenate([s[1:] != s[:-1], np.ones(min(len(s), 1), bool)])) + 1
    keys = s[ends[np.diff(ends, prepend=0) >= least] - 1]
    del s, ends
    docs, cols = [], []
    for lo in range(0, len(f) if len(keys) else 0, step):
        part = f[lo : lo + step]
        at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
        keep = keys[at] == part
        docs.append(doc[lo : lo + step][keep].astype(np.int32))
        cols.append(at[keep].astype(np.int32))
    join = lambda parts: np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int64)
    return join(docs), join(cols), keys


class Scorer:
    """Logistic regression on hashed features; only features with a weight are kept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    @classmethod
    def fit(cls, doc: np.ndarray, f: np.ndarray, target: np.ndarray, least: int = 3, steps: int = 80, l1: float = 2e-5) -> Scorer:
        return cls.fit_columns(*columns(doc, f, least), target, steps, l1)

    @classmethod
    def fit_columns(cls, doc: np.ndarray, col: np.ndarray, keys: np.ndarray, target: np.ndarray, steps: int = 80, l1: float = 2e-5) -> Scorer:
        if not len(target) or target.min(initial=1) > 0.5 or target.max(initial=0) < 0.5:
            return cls(np.zeros(0, np.uint64), np.zeros(0), 20.0 if len(target) and target.mean() > 0.5 else -20.0)
        # both answers weigh the same in all; a row counts the more, the surer its answer is
        goal, sure = (target > 0.5).astype(float), np.abs(2 * target - 1)
        weight = sure * np.where(goal == 1, 1 / max(sure[goal == 1].sum(), 1e-9), 1 / max(sure[goal == 0].sum(), 1e-9))
        w, bias, seen, seen_bias = np.zeros(len(keys)), 0.0, np.full(len(keys), 1e-8), 1e-8
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[col], minlength=len(target)) + bias, -50, 50)))
            r = weight * (p - goal) / 2
            g, gb = np.bincount(col, r[doc], minlength=len(keys)), r.sum()
            seen, seen_bias = seen + g * g, seen_bias + gb * gb
            step = 0.7 / np.sqrt(seen)
            w = w - step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            bias -= 0.7 / np.sqrt(seen_bias) * gb
        strong = np.abs(w) > 0.02
        return cls(keys[strong], w[strong], float(bias))

    def score(self, doc: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            hit = self.keys[at] == f
            z += np.bincount(doc[hit], self.weights[at[hit]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, lexicon_rows: int = LEXICON_ROWS, train_rows: int = TRAIN_ROWS) -> dict[str, Scorer]:
    """The scorers of both questions."""
    lexicons = mine(docs, labels, lexicon_rows)
    share = min(1.0, train_rows / max(docs.count(), 1))
    bar = int(share * (1 << 32))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch, most=CHUNK):
                buf, offs = T.text_bytes(chunk.column(1))
                level = levels(buf, offs)
                doc, f = features(buf, offs, level)
                v = votes(level, doc, f, lexicons)
                salt = T.mix(np.asarray(chunk.column(0).fill_null(-1)).astype(np.uint64) ^ T.hash_spans(buf, offs[:-1], np.diff(offs), 99)) >> np.uint64(32)
                chosen = salt < np.uint64(bar)
                ends = np.searchsorted(doc, np.arange(len(level) + 1))
                size = np.where(chosen, np.diff(ends), 0)
                kept = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(f[T.ragged(ends[:-1], size)].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(v["junk"]), pa.array(v["toxic"]), pa.array(np.where(chosen, salt, 0).astype(np.int64), mask=~chosen), kept], ["doc_id", "junk", "toxic", "salt", "f"])

    voted = table(docs.select("doc_id", "text").mapInArrow(tidy(vote), "doc_id long, junk long, toxic long, salt long, f array<long>"))
    given = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("is_junk"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    joined = voted.join(given, "doc_id", "left").select("junk", "toxic", F.coalesce("is_junk", F.lit(-1)).alias("is_junk"), F.coalesce("is_toxic", F.lit(-1)).alias("is_toxic"), "salt", "f")
    out = {}
    sample = joined.where("salt is not null").orderBy("salt").limit(2 * train_rows).toArrow()  # repeated rows are chosen together
    sizes = np.asarray(pc.list_value_length(sample["f"])).astype(np.int64)
    doc, f = np.repeat(np.arange(sample.num_rows, dtype=np.int32), sizes), np.asarray(pc.list_flatten(sample["f"])).astype(np.int64, copy=False).view(np.uint64)
    sample = sample.drop_columns(["f"])
    tidy_driver(docs.sparkSession)
    doc, col, kept_keys = columns(doc, f)
    del f
    for question, labellers in LABELLERS.items():
        rows = joined.groupBy(question, f"is_{question}").count().collect()  # at most 3 * 2 ** labellers rows
        pattern, said, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        post = expectation_maximisation(pattern, said, n, labellers)
        known = {(p, s): q for p, s, q in zip(pattern.tolist(), said.tolist(), post.tolist(), strict=True)}
        target = np.array([known[p, s] for p, s in zip(sample[question].to_pylist(), sample[f"is_{question}"].to_pylist(), strict=True)])
        out[question] = Scorer.fit_columns(doc, col, kept_keys, target)
    del doc, col
    tidy_driver(docs.sparkSession)
    return out


def classify(docs: DataFrame, labels: DataFrame, lexicon_rows: int = LEXICON_ROWS, train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, p_junk, p_toxic, accepted of each row of docs, with the columns `keep` of docs besides."""
    on_path(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scorers = train(own, labels.select("doc_id", "quality", "toxic"), lexicon_rows, train_rows)
    extra = docs.select(*keep).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch, most=CHUNK):
                buf, offs = T.text_bytes(chunk.column(1))
                level = levels(buf, offs)
                doc, f = features(buf, offs, level)
                p = [scorers[q].score(doc, f, len(level)) for q in ("junk", "toxic")]
                cols = [chunk.column(0), pa.array(p[0]), pa.array(p[1]), pa.array((p[0] < 0.5) & (p[1] < 0.5)), *(chunk.column(chunk.schema.get_field_index(c)) for c in keep)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "p_junk", "p_toxic", "accepted", *keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in keep if c != "text"))
    schema = "doc_id long, p_junk double, p_toxic double, accepted boolean" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    return rows.mapInArrow(tidy(judge), schema)
