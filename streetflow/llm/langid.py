"""Language identification as inference in a mixture: each document has proportions of languages.

Every language has smoothed probabilities of hashed byte n-grams of words, counted over all learning documents. A word's likelihood in
a language is that of its n-grams. For each document, expectation-maximisation estimates the proportions of the languages from its
words; then the set of languages is chosen by penalised likelihood (the best single language against the mixture of all languages
with a noticeable share), and the prediction is the language with the largest proportion in the chosen set. The score is the mean
posterior of that language over the document's words.

A null text, or one without a letter, is `und` with score 0, and so is all text if nothing was learned. Texts whose letters are all
in no learned alphabet still get the likeliest language. Null doc_id: neither learned from nor, as crc32 of the empty text is 0,
anything but held out. Empty table: no rows. Repeated rows are predicted each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm import text as T
from streetflow.llm.shared import on_path, tidy

BUCKETS, ORDER, SMOOTHING = 1 << 16, 3, 0.5
#: distinct values of lang that may be learned; a table with more has no languages there
MOST_LANGS = 1024
STEPS, NOTICEABLE = 10, 0.05
#: bytes that are no letters: all ASCII but A-Z, a-z
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def gram_buckets(low: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words (with one mark before and after), and the len+1 offsets of the words."""
    per = lens + 2 - ORDER + 1
    at = T.ragged(starts - 1, per)
    first = T.ragged(np.zeros(len(per), np.int64), per)
    left = np.repeat(lens + 2, per) - first
    key = np.zeros(len(at), np.uint64)
    for j in range(ORDER):
        inside = (first + j > 0) & (left - j > 1)
        key = key * np.uint64(257) + np.where(inside, low[np.maximum(at + j, 0)].astype(np.uint64) + np.uint64(1), 0)
    return (T.mix(key) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([[0], np.cumsum(per)])


def distinct_words(buf: np.ndarray, offs: np.ndarray):
    """Lower-cased bytes, starts and lengths of distinct words, each word's number among them, and each document's first word."""
    low = T.lower_ascii(buf)
    starts, lens, first = T.words(low, offs, NO_LETTER)
    example, number = T.distinct(T.hash_spans(low, starts, lens))
    return low, starts[example], lens[example], number, first


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of docs (text, lang) and the log probabilities (buckets, languages) of their n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for chunk in T.chunks(batch):
                buf, offs = T.text_bytes(chunk.column(0))
                low, starts, lens, number, first = distinct_words(buf, offs)
                grams, bounds = gram_buckets(low, starts, lens)
                names = chunk.column(1).to_pylist()
                per_doc = np.array(names, object)
                for lang in set(names):
                    mine = np.repeat(per_doc == lang, np.diff(first))
                    n = np.bincount(number[mine], minlength=len(starts))
                    counts = np.bincount(grams, np.repeat(n, np.diff(bounds)), minlength=BUCKETS)
                    total[lang] = total.get(lang, 0) + counts.astype(np.int64)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    sums = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(tidy(count), "lang string, bucket long, n long")
    got = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).limit(BUCKETS * MOST_LANGS + 1).toArrow()
    langs = sorted(set(pc.unique(got["lang"]).to_pylist()))
    if len(langs) > MOST_LANGS or got.num_rows > BUCKETS * MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of lang")
    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        number = {lang: k for k, lang in enumerate(langs)}
        counts[np.asarray(got["bucket"]), [number[x] for x in got["lang"].to_pylist()]] = np.asarray(got["n"])
    return langs, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32)


def infer(ll: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language and score of each document, from the words' log likelihoods (words, languages)."""
    n, langs = len(first) - 1, ll.shape[1]
    best, score = np.zeros(n, np.int64), np.zeros(n)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return best, score
    at, words = first[:-1][full], np.diff(first)[full]
    top = ll.max(1)
    like = np.exp(ll - top[:, None])

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(STEPS):
            post = like * np.repeat(share, words, 0)
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            share = np.add.reduceat(post, at) / words[:, None]
            share = np.where(allowed, share, 0)
        mixed = np.maximum((like * np.repeat(share, words, 0)).sum(1), 1e-300)
        return share, np.add.reduceat(np.log(mixed) + top, at), np.add.reduceat(post, at) / words[:, None]

    share, _, _ = fit(np.ones((len(full), langs), bool))
    chosen = share >= np.minimum(NOTICEABLE, share.max(1, keepdims=True))
    mix_share, mix_like, post = fit(chosen)
    alone = np.add.reduceat(ll.astype(np.float64), at)
    one = alone.argmax(1)
    penalty = 0.5 * np.log(np.maximum(words, 2)) * (chosen.sum(1) - 1)
    single = alone[np.arange(len(full)), one] >= mix_like - penalty
    best[full] = np.where(single, one, mix_share.argmax(1))
    everyday = np.where(single[:, None], share, post)
    score[full] = np.clip(everyday[np.arange(len(full)), best[full]], 0, 1)
    return best, score


def identify(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs; documents with crc32(doc_id as text) mod folds = fold are held out."""
    on_path(docs.sparkSession)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), out.alias("held_out"))
    langs, table = learn(rows.where("not held_out"))
    names = pa.array([*langs, "und"], pa.string())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch):
                buf, offs = T.text_bytes(chunk.column(1))
                low, starts, lens, number, first = distinct_words(buf, offs)
                ascii_letters = np.diff(np.concatenate([[0], np.cumsum(~NO_LETTER[buf[: int(offs[-1])]] & (buf[: int(offs[-1])] < 128))])[offs])
                none = np.diff(first) == 0
                for i in np.flatnonzero(~none & (ascii_letters == 0)).tolist():
                    none[i] = not any(c.isalpha() for c in chunk.column(1)[i].as_py())
                best, score = np.full(chunk.num_rows, len(langs)), np.zeros(chunk.num_rows)
                if langs and len(starts):
                    grams, bounds = gram_buckets(low, starts, lens)
                    ll = np.add.reduceat(table[grams], bounds[:-1])[number]
                    got, p = infer(ll, first)
                    best, score = np.where(none, best, got), np.where(none, 0.0, p)
                yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), names.take(pa.array(best)), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double")
