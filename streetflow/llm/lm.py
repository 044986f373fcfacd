"""LM scoring by an n-gram trie in Elias-Fano levels (streetflow.llm.eliasfano), in shards.

Tokens are a text's words, A-Z lower-cased, and one end; the first token follows a start mark. The model is a back-off model of order 3
over the counts c of the learning documents, without cutoffs:

- p(w | u, v) = (c(u, v, w) - DISCOUNT) / c(u, v) where the trigram was seen, else b(u, v) * p(w | v) with
  b(u, v) = DISCOUNT * t(u, v) / c(u, v) for t different words seen after (u, v), and b = 1 after an unseen (u, v);
- p(w | u) = c(u, w) / (c(u) + MASS) where the bigram was seen, else MASS / (c(u) + MASS) * p(w);
- p(w) = (c(w) + 1) / (N + V + 1), from the vocabulary's shards.

The tries hold these smoothed probabilities of trigrams and bigrams and the weights b, each quantised to one byte and rounded down, so
that no word's probability is overstated. MASS was chosen on sf0.1's held-out documents; DISCOUNT is the usual one.

1. All learning documents' words are counted; word shards give them ids by frequency and keep their counts. N and V are their sums.
2. Documents are dealt to groups by doc_id and text. A group asks the word shards once for each of its distinct words.
3. With the ids it sends each distinct trigram, with its count in the group's learning documents, to the shard of its first word; its
   bigrams are these trigrams' heads. The shard adds the counts, builds its trie, maps it into memory and looks up every trigram that it
   was asked for. Trigrams of a first word so frequent that it would fill a shard are dealt by their second word too; for the bigrams'
   smoothing only c(u) is needed, which the groups have.
4. The groups score their documents with the answers.

What a shard gets from a group is a block of distinct words or trigrams, however often the group has them. Nothing is collected but N
and V. Null text is empty (its end only). Null doc_id: crc32 of the empty text, hence a learning document. Rows of equal doc_id are
scored each. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm import text as T
from streetflow.llm.eliasfano import Trie
from streetflow.llm.shared import group_count, let_go, on_path, shuffle_partitions, table, tidy

MASS, DISCOUNT, STEPS = 200.0, 0.75, 20.0
#: ids are kept in 32 bits on their way
MOST_IDS = 1 << 32
START, UNKNOWN, FIRST_ID = 0, 1, 2
#: the third id where no known word follows; the start mark follows nothing
NOTHING = START
END = b"\n"


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unsqueeze(block: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(block)


def planes(a: np.ndarray) -> np.ndarray:
    """The numbers' first bytes, then their second bytes and so on, which compress better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)


def unplanes(body: bytes, dtype: str, n: int, at: int) -> tuple[np.ndarray, int]:
    """n numbers from planes at a place, and the place after them."""
    size = np.dtype(dtype).itemsize
    a = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(a.T).view(dtype).reshape(n), at + n * size


def byte(p: np.ndarray) -> np.ndarray:
    """Probabilities as bytes, rounded down."""
    return np.minimum(np.ceil(-np.log10(p) * STEPS), 254).astype(np.uint8)


def unbyte(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-code.astype(np.float64) / STEPS)


def leaving(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """run for a group, after which the worker lets its memory go; this has as many parameters as run, for Spark counts them."""
    if len(inspect.signature(run).parameters) == 2:

        def left(key: tuple, t: pa.Table) -> pa.Table:
            out = run(key, t)
            let_go()
            return out

        return left

    def left_two(key: tuple, t: pa.Table, other: pa.Table) -> pa.Table:
        out = run(key, t, other)
        let_go()
        return out

    return left_two


def pack_words(words: list[bytes]) -> bytes:
    """A block of words, as Words.pack makes it."""
    return squeeze(np.fromiter(map(len, words), "<i4", len(words)), np.frombuffer(b"".join(words), np.uint8))


def unpack_words(block: bytes, n: int) -> list[bytes]:
    body = unsqueeze(block)
    ends = np.cumsum(np.frombuffer(body, "<i4", n)) + 4 * n
    return [body[i:j] for i, j in zip([4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Words:
    """The distinct words of texts as spans of the texts, with the end as the last one; their shards, each word's number among them, and
    each document's first word."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, shards: int):
        self.low, n = T.lower_ascii(buf), int(offs[-1])
        starts, lens, self.first = T.words(self.low, offs)
        h = T.hash_spans(self.low, starts, lens)
        example, self.number = T.distinct(h)
        self.low[n] = END[0]  # in the zeros that follow the texts
        self.at, self.lens = np.append(starts[example], n), np.append(lens[example], 1)
        h = np.append(h[example], T.hash_spans(self.low, self.at[-1:], self.lens[-1:]))
        self.shard = (T.mix(h) % np.uint64(shards)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.at)

    def pack(self, which: np.ndarray) -> bytes:
        return squeeze(self.lens[which].astype("<i4"), T.gather(self.low, self.at[which], self.lens[which]))


def distinct_pairs(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair occurs first, in order of (u, w), and every pair's place among them."""
    high, low = int(u.max(initial=0)).bit_length(), int(w.max(initial=0)).bit_length()
    return T.distinct((u.astype(np.uint64) << np.uint64(low)) | w.astype(np.uint64), high + low)


def parts(shard: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shards that occur and the members of each, in order."""
    # numbers of 16 bits are sorted by radix
    order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    return shard[order][cuts[:-1]], [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


class Group:
    """A group's documents in canonical order as numbers of its distinct words; the last number is the end."""

    def __init__(self, t: pa.Table, shards: int):
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_id, self.learns = t["doc_id"].combine_chunks(), np.asarray(t["learns"])
        self.words = Words(*T.text_bytes(t["text"]), shards)
        self.counts = np.diff(self.words.first) + 1
        self.ends = np.cumsum(self.counts)
        self.tokens = np.full(int(self.ends[-1]), len(self.words) - 1)
        keep = np.ones(len(self.tokens), bool)
        keep[self.ends - 1] = False
        self.tokens[keep] = self.words.number
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams (u, v) by id, sorted, and each token's; distinct trigrams as (bigram, w), sorted, the count of each in
        learning documents, and the trigram that begins with each token's bigram. w is NOTHING where no known word follows."""
        v = ids[self.tokens]
        u = np.empty_like(v)
        u[1:] = v[:-1]
        u[self.ends - self.counts] = START
        w = np.empty_like(v)
        w[:-1] = v[1:]
        w[self.ends - 1] = NOTHING
        w[w == UNKNOWN] = NOTHING
        first, bigram = distinct_pairs(u, v)
        head, trigram = distinct_pairs(bigram, w)
        return u[first], v[first], bigram, bigram[head], w[head], np.bincount(trigram, self.learns[self.doc], len(head)).astype(np.int64), trigram


def build_vocabulary(docs: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, n, words, counts, tokens) for all words of docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch, most=4 * T.CHUNK_BYTES):
                words = Words(*T.text_bytes(chunk.column(0)), shards)
                n = np.append(np.bincount(words.number, minlength=len(words) - 1), chunk.num_rows).astype("<i8")
                which, members = parts(words.shard)
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array([len(m) for m in members], pa.int32()), pa.array([words.pack(m) for m in members], pa.binary()), pa.array([squeeze(n[m]) for m in members], pa.binary())], ["shard", "n", "words", "counts"])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for n, words, counts in zip(t["n"].to_pylist(), t["words"].to_pylist(), t["counts"].to_pylist(), strict=True):
            for w, c in zip(unpack_words(words, n), np.frombuffer(unsqueeze(counts), "<i8").tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        ranked = sorted(total, key=lambda w: (-total[w], w))
        counts = np.fromiter((total[w] for w in ranked), "<i8", len(ranked))
        return pa.table({"shard": key[0:1], "n": pa.array([len(ranked)], pa.int32()), "words": pa.array([pack_words(ranked)], pa.binary()), "counts": pa.array([squeeze(counts)], pa.binary()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    sent = docs.select("text").mapInArrow(tidy(count), "shard int, n int, words binary, counts binary")
    return sent.groupBy("shard").applyInArrow(merge, "shard int, n int, words binary, counts binary, tokens long")


def score(docs: DataFrame, folds: int = 7, fold: int = 2, group_mb: int = 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs; documents with crc32(doc_id as text)
    mod folds = fold are not learned from."""
    on_path(docs.sparkSession)
    spark, groups = docs.sparkSession, group_count(docs, group_mb)
    width = shuffle_partitions(spark)
    shards = max(width, groups // 2)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~held).alias("learns"))
    vocabulary = table(build_vocabulary(rows.where("learns"), shards))
    sums = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("v")).first()
    total, space = int(sums["n"]), int(sums["n"] + sums["v"] + 1)
    often = max(1, total // (8 * shards))
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(width, "grp")

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        g = Group(t, shards)
        which, members = parts(g.words.shard)
        return pa.table({"shard": pa.array(which.astype(np.int32)), "grp": pa.array([key[0].as_py()] * len(which), pa.int32()), "n": pa.array([len(m) for m in members], pa.int32()), "words": pa.array([g.words.pack(m) for m in members], pa.binary())})

    def tell(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        counts = np.zeros(0, np.int64)
        if known.num_rows:
            place = {w: k for k, w in enumerate(unpack_words(known["words"][0].as_py(), known["n"][0].as_py()))}
            counts = np.frombuffer(unsqueeze(known["counts"][0].as_py()), "<i8")
            if FIRST_ID + len(place) * shards >= MOST_IDS:
                raise OverflowError(f"a vocabulary of {len(place)} words in one of {shards} shards needs more than 32 bits")
        out = []
        for n, words in zip(asked["n"].to_pylist(), asked["words"].to_pylist(), strict=True):
            at = np.fromiter((place.get(w, -1) for w in unpack_words(words, n)), np.int64, n)
            ids = np.where(at < 0, UNKNOWN, FIRST_ID + at * shards + (asked["shard"][0].as_py() if n else 0))
            out.append(squeeze(ids.astype("<u4"), np.where(at < 0, 0, counts[np.maximum(at, 0)] if len(counts) else 0).astype("<i8")))
        return pa.table({"grp": asked["grp"].cast(pa.int32()), "kind": pa.array([0] * len(out), pa.int32()), "shard": asked["shard"].cast(pa.int32()), "n": asked["n"].cast(pa.int32()), "block": pa.array(out, pa.binary())})

    answer = "grp int, kind int, shard int, n int, block binary"
    words = dealt.select("doc_id", "text", "learns", "grp").groupBy("grp").applyInArrow(ask, "shard int, grp int, n int, words binary")
    word_answers = words.groupBy("shard").cogroup(vocabulary.groupBy("shard")).applyInArrow(tell, answer)

    def known_words(g: Group, answers: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids and counts of a group's words."""
        ids, counts = np.full(len(g.words), UNKNOWN, np.int64), np.zeros(len(g.words), np.int64)
        which, members = parts(g.words.shard)
        where = dict(zip(which.tolist(), members, strict=True))
        for kind, shard, n, block in answers:
            if kind == 0:
                body = unsqueeze(block)
                ids[where[shard]], counts[where[shard]] = np.frombuffer(body, "<u4", n), np.frombuffer(body, "<i8", n, 4 * n)
        return ids, counts

    def context_counts(g: Group, ids: np.ndarray, counts: np.ndarray, u: np.ndarray) -> np.ndarray:
        """c(u) of contexts; the start mark's is the number of learning documents, which is the end's."""
        order = np.argsort(ids)
        out = counts[order[np.minimum(np.searchsorted(ids[order], u), len(ids) - 1)]]
        out = np.where(u == UNKNOWN, 0, out)
        return np.where(u == START, counts[len(g.words) - 1], out)

    def context_shards(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (T.mix(u.astype(np.uint64) + np.where(c > often, T.mix(v.astype(np.uint64) + np.uint64(7)), 0).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)

    def dealt_trigrams(u: np.ndarray, v: np.ndarray, c: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The shards and the trigrams, given by their bigrams b, that each is asked for: those of known words."""
        useful = np.flatnonzero(((u != UNKNOWN) & (v != UNKNOWN))[b])
        which, members = parts(context_shards(u, v, c)[b[useful]])
        return which, [useful[m] for m in members]

    def rows_of(t: pa.Table) -> list[tuple[int, int, int, bytes]]:
        return list(zip(*(t[c].to_pylist() for c in ("kind", "shard", "n", "block")), strict=True))

    def send(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(t, shards)
        ids, counts = known_words(g, rows_of(answers))
        u, v, _, b, w, n, _ = g.grams(ids)
        c = context_counts(g, ids, counts, u)
        which, members = dealt_trigrams(u, v, c, b)
        blocks = []
        for m in members:
            heads = np.flatnonzero(np.diff(b[m], prepend=-1))
            pair = b[m][heads]
            new = np.flatnonzero(np.diff(u[pair], prepend=-1))
            blocks.append(squeeze(
                np.array([len(new), len(heads)], "<i4"), planes(np.diff(u[pair][new], prepend=0).astype("<u4")), planes(c[pair][new].astype("<i8")), planes(np.diff(new, append=len(heads)).astype("<u4")),
                planes(v[pair].astype("<u4")), planes(np.diff(heads, append=len(m)).astype("<u4")), planes(w[m].astype("<u4")), planes(n[m].astype("<u4")),
            ))
        return pa.table({"shard": pa.array(which.astype(np.int32)), "grp": pa.array([key[0].as_py()] * len(which), pa.int32()), "n": pa.array([len(m) for m in members], pa.int32()), "block": pa.array(blocks, pa.binary())})

    def unpack(block: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """u, c(u) and v of a block's bigrams, its trigrams' bigrams, w and counts."""
        body = unsqueeze(block)
        (k, m), at = np.frombuffer(body, "<i4", 2).tolist(), 8
        u, at = unplanes(body, "<u4", k, at)
        c, at = unplanes(body, "<i8", k, at)
        pairs, at = unplanes(body, "<u4", k, at)
        v, at = unplanes(body, "<u4", m, at)
        triples, at = unplanes(body, "<u4", m, at)
        w, at = unplanes(body, "<u4", n, at)
        counts, at = unplanes(body, "<u4", n, at)
        return np.repeat(np.cumsum(u, dtype=np.uint32), pairs), np.repeat(c, pairs), v, np.repeat(np.arange(m, dtype=np.int32), triples), w, counts

    def look_up(key: tuple, t: pa.Table) -> pa.Table:
        asked = [unpack(block, n) for n, block in zip(t["n"].to_pylist(), t["block"].to_pylist(), strict=True)]
        pairs, triples = np.cumsum([0, *(len(a[0]) for a in asked)]), np.cumsum([0, *(len(a[3]) for a in asked)])
        u, c, v = (np.concatenate([a[k] for a in asked]) for k in range(3))
        b = np.concatenate([a[3] + p for a, p in zip(asked, pairs.tolist(), strict=False)])
        w, n = (np.concatenate([a[k] for a in asked]) for k in (4, 5))
        asked.clear()
        first, bigram = distinct_pairs(u, v)
        u, c, v = u[first], c[first], v[first]
        b = bigram[b]
        head, trigram = distinct_pairs(b, w)
        counts = np.bincount(trigram, n, len(head))
        pair, third = b[head], w[head]
        del first, b, w, n, head
        begin = np.flatnonzero(np.diff(pair, prepend=-1))
        total = np.add.reduceat(counts, begin)  # c(u, v) of every bigram, in order
        kinds = np.add.reduceat(((counts > 0) & (third != NOTHING)).astype(np.int64), begin)
        grams = np.stack([u[pair], v[pair], third], 1, dtype=np.int64)
        seen, met = counts > 0, total > 0
        words = seen & (third != NOTHING)
        value = np.full(len(counts), 254, np.uint8)
        value[words] = byte((counts[words] - DISCOUNT) / total[pair[words]])
        weight = np.full(len(total), 254, np.uint8)
        on = kinds > 0
        weight[on] = byte(DISCOUNT * kinds[on] / total[on])
        trie = Trie.build(grams[seen], value[seen], int(grams.max(initial=0)) + 1, np.stack([byte(total[met] / (c[met] + MASS)), weight[met]], 1)).mapped()
        del seen, met, words, value, weight, on, kinds, total, counts
        got, rows = trie.lookup_contexts(grams)
        del grams, pair, third, trie
        got, rows = got[trigram], rows[begin][bigram]
        out = [squeeze(got[i:j], rows[p:q, 0], rows[p:q, 1]) for i, j, p, q in zip(triples[:-1].tolist(), triples[1:].tolist(), pairs[:-1].tolist(), pairs[1:].tolist(), strict=True)]
        return pa.table({"grp": t["grp"].cast(pa.int32()), "kind": pa.array([1] * t.num_rows, pa.int32()), "shard": t["shard"].cast(pa.int32()), "n": t["n"].cast(pa.int32()), "block": pa.array(out, pa.binary())})

    grams = dealt.groupBy("grp").cogroup(word_answers.groupBy("grp")).applyInArrow(leaving(send), "shard int, grp int, n int, block binary")
    gram_answers = grams.groupBy("shard").applyInArrow(leaving(look_up), answer)

    def rate(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        g, got = Group(t, shards), rows_of(answers)
        ids, counts = known_words(g, got)
        u, v, bigram, b, w, _, trigram = g.grams(ids)
        c = context_counts(g, ids, counts, u)
        which, members = dealt_trigrams(u, v, c, b)
        where = dict(zip(which.tolist(), members, strict=True))
        three, two, weight = np.full(len(b), 255, np.uint8), np.full(len(u), 255, np.uint8), np.full(len(u), 255, np.uint8)
        for kind, shard, n, block in got:
            if kind == 1:
                m, body = where[shard], np.frombuffer(unsqueeze(block), np.uint8)
                pair = b[m][np.diff(b[m], prepend=-1) > 0]
                three[m], two[pair], weight[pair] = body[:n], body[n : n + len(pair)], body[n + len(pair) :]
        own = (counts[g.tokens] + 1) / space
        p = np.where(two < 255, unbyte(two), MASS / (c + MASS))[bigram]
        p = np.where(two[bigram] < 255, p, p * own)
        inner = np.ones(len(p), bool)
        inner[g.ends - g.counts] = False
        now = np.flatnonzero(inner)
        code, past = three[trigram[now - 1]], weight[bigram[now - 1]]
        # NOTHING is no word: what was asked for it is the bigram's
        seen = (code < 255) & (w[trigram[now - 1]] != NOTHING)
        p[now] = np.where(seen, unbyte(code), np.where(past < 255, unbyte(past), 1.0) * p[now])
        at = g.ends - g.counts
        known = (counts[g.tokens] > 0).astype(np.int64)
        return pa.table({
            "doc_id": g.doc_id, "held_out": pa.array(~g.learns), "n_tokens": pa.array(g.counts.astype(np.int64)), "n_known": pa.array(np.add.reduceat(known, at)),
            "train_tokens": pa.array([total] * len(at), pa.int64()), "base_score": pa.array(np.add.reduceat(np.log10(own), at)), "score": pa.array(np.add.reduceat(np.log10(np.minimum(p, 1.0)), at)),
        })

    answers = word_answers.union(gram_answers)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(leaving(rate), schema)
