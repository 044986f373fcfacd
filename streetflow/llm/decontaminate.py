"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are the runs of digits, letters a-z and all non-ASCII characters, A-Z lower-cased. A window is WINDOW consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. A document word inside an occurrence of a window is hit.

1. Fingerprints: of the hashes of all GRAM-word grams, the smallest in each run of WINDOW - GRAM + 1 consecutive ones. A shared span of
   WINDOW words has the same such run in both texts, so both have its smallest hash: no shared window is missed. For items shorter
   than WINDOW, the lengths that occur in the benchmark are listed (at most WINDOW - 1) and grams of those lengths are added whole.
2. Documents that share a fingerprint with the benchmark are candidates.
3. Hits are extended: the candidates' windows are joined with the items' windows on their words, and the covered words are counted.

The benchmark's fingerprints and windows are broadcast only up to BROADCAST_ROWS rows, and so are the candidates' keys; beyond that
they are joined by shuffle. No step pairs documents with each other, and a passage that very many documents share costs each of them
its own rows only.

Null or empty texts have no words. A document is known by its id and the hash of its text, so that rows of equal ids keep results of
their own, and null ids are kept. Items of equal item_id are one item; a null item_id is an item with the empty string for its id.
Empty documents: no rows; empty benchmark: no hits. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.llm.shared import table

WINDOW, GRAM = 13, 6
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(w: str, size: int) -> str:
    return f"if(size({w}) < {size}, array(), transform(sequence(1, size({w}) - {size - 1}), i -> xxhash64(slice({w}, i, {size}))))"


def winnowed(h: str, window: int, gram: int) -> str:
    """The smallest of each run of hashes of grams that make up a window."""
    run = window - gram + 1
    return f"if(size({h}) < {run}, array(), array_distinct(transform(sequence(1, size({h}) - {run - 1}), i -> array_min(slice({h}, i, {run})))))"


def windows(w: str, sizes: list[int]) -> str:
    one = [f"if(size({w}) < {n}, array(), transform(sequence(1, size({w}) - {n - 1}), i -> named_struct('at', i, 'n', {n}, 'words', array_join(slice({w}, i, {n}), ' '))))" for n in sizes]
    return one[0] if len(one) == 1 else f"concat({', '.join(one)})"


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has no more than `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs; and `items`, the ids themselves."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    short = sorted(r.n for r in items.selectExpr("size(w) AS n").where(F.col("n") < window).distinct().collect())  # below window values
    sizes = [*short, window]
    spans = items.select("item", F.explode(F.expr(f"filter({windows('w', sizes)}, x -> x.n = least(size(w), {window}))")).alias("x"))
    spans = table(spans.select("item", F.col("x.n").alias("n"), F.col("x.words").alias("words")).distinct())
    marks = items.selectExpr("w", f"{grams('w', gram)} AS h").selectExpr("w", f"{winnowed('h', window, gram)} AS f")
    marks = marks.select(F.explode(F.expr(f"if(size(w) < {window}, array(xxhash64(w)), f)")).alias("f")).distinct()
    marks = table(marks)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    fingerprints = [winnowed("h", window, gram), *(grams("w", n) for n in short)]
    listed = own.selectExpr("doc_id", "text_key", "w", f"{grams('w', gram)} AS h").selectExpr("doc_id", "text_key", "size(w) AS n_words", f"{'array_union(' * len(short)}{fingerprints[0]}{''.join(f', {x})' for x in fingerprints[1:])} AS f")
    listed = table(listed)

    candidates = listed.select("doc_id", "text_key", F.explode("f").alias("f")).join(sized(marks), "f", "left_semi").select("doc_id", "text_key").distinct()
    candidates = table(candidates)
    key = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    few = sized(candidates, 5 * BROADCAST_ROWS)
    found = keyed.join(few, key(keyed, few), "left_semi").distinct().select("doc_id", "text_key", words(F.col("text")).alias("w"))
    found = found.select("doc_id", "text_key", F.explode(F.expr(windows("w", sizes))).alias("x")).select("doc_id", "text_key", F.col("x.at").alias("at"), F.col("x.n").alias("n"), F.col("x.words").alias("words"))
    hits = found.join(sized(spans), ["n", "words"]).groupBy("doc_id", "text_key")
    hits = hits.agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set("item").alias("items"))
    hits = hits.select("doc_id", "text_key", F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.at, s.at + s.n - 1)))))").cast("long").alias("n_hit"), F.sort_array("items").alias("items"))
    out = listed.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"))
    out = out.join(hits, key(out, hits), "left").select(out["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"), out["text_key"])
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "text_key",
    )


ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM spans),
wins AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM wins JOIN spans USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
