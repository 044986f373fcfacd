"""URL filters by association rules, in DataFrame functions and Spark's FP-growth only.

A URL's tokens are its scheme, its domain, the words of its other host labels (split at hyphens), its path's segments, its file
extension, its query's keys and whether it has a fragment. FP-growth mines the labelled URLs' token sets together with the label.
A rule "tokens -> block" or "tokens -> allow" of at most MOST_TOKENS tokens is kept if it has enough support, if its certainty is
MIN_CERTAINTY or more, if tokens and label depend on each other at the usual 5 % (chi-square), and if no rule on some of its tokens says
the same as certainly. The certainty is the part of the way from the label's own share among all URLs to 1 that the rule's confidence
has gone: what a rule needs is set against the labels' base rate, and rules for either label can be compared.

Kept rules match by an inverted index: each rule is listed under its rarest token, a URL's tokens are joined with that list, and a rule
fits a URL that has all of its tokens. Of the rules that fit, the most certain decides. Explicit rules go first.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end; both are empty for
null or without "://". An explicit rule fits its host and all subdomains if the path starts with the rule's; the longest wins. A URL
without any rule is allowed. A page's label is that of the document whose id is the last number in its path; a document is blocked if
any of its labels says quality 0 or toxic 1. Rows of equal page_id and url get the same verdict, one row each; null ids and urls are
kept. Of rules equally certain, the one with more support decides, then the last by name. Empty tables: no rows, or no rules. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.llm.decontaminate import LOWER, UPPER, sized
from streetflow.llm.shared import shuffle_partitions, table

#: fixed values: the explicit rules (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CERTAINTY, MIN_CHI_SQUARE, MOST_TOKENS = 0.002, 0.15, 3.84, 4
#: a rule stands on so many labelled URLs at least, however few there are
MIN_COUNT = 8
BLOCK, ALLOW = "label=block", "label=allow"
MINED = "rule string, tokens array<string>, anchor string, says string, certainty double, confidence double, support double"


def split_url(pages: DataFrame) -> DataFrame:
    """pages with host and path; pages must have the column url."""
    after = F.expr("coalesce(if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), ''), '')")
    raw = F.regexp_extract("__after", r"^[^/?#]*", 0)
    out = pages.withColumn("__after", after).withColumn("host", F.translate(raw, UPPER, LOWER))
    rest = F.expr("substring(__after, length(host) + 1)")
    return out.withColumn("path", F.regexp_extract(rest, r"^[^?#]*", 0)).drop("__after")


def explicit(rules=RULES) -> tuple[Column, Column]:
    """The longest explicit rule that fits and its verdict, null if none does; rules are few and become one expression."""
    name = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith(f".{rule_host}")) & F.col("path").startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens() -> Column:
    """The tokens of a row with url, host and path; numbers stand as #."""
    parts, size = "split(host, '[.]')", "size(split(host, '[.]'))"
    return F.array_distinct(F.expr(f"""concat(
        array(concat('scheme=', lower(substring_index(coalesce(url, ''), '://', 1)))),
        array(concat('domain=', array_join(slice({parts}, greatest({size} - 1, 1), 2), '.'))),
        transform(filter(flatten(transform({parts}, (l, i) -> if(i < {size} - 2 or (i = {size} - 2 and instr(l, '-') > 0), split(l, '-'), cast(array() AS array<string>)))), w -> w <> ''), w -> concat('word=', w)),
        transform(filter(split(path, '/'), s -> s <> ''), s -> concat('path=', regexp_replace(s, '[0-9]+', '#'))),
        transform(filter(array(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)), s -> s <> ''), s -> concat('ext=', lower(s))),
        transform(filter(split(regexp_extract(coalesce(url, ''), '[?]([^#]*)', 1), '&'), s -> s <> ''), s -> concat('key=', substring_index(s, '=', 1))),
        if(instr(coalesce(url, ''), '#') > 0, array('fragment'), cast(array() AS array<string>)))"""))


def baskets(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(items, bad): the tokens of each labelled URL with its label."""
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).cast("int")).alias("bad"))
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1)
    known = pages.withColumn("doc_id", F.when(number != "", number.cast("long"))).join(bad, "doc_id")
    return known.select(F.array_append(tokens(), F.when(F.col("bad") == 1, BLOCK).otherwise(ALLOW)).alias("items"), "bad")


def mine(pages: DataFrame, labels: DataFrame, support: float = MIN_SUPPORT, certainty: float = MIN_CERTAINTY) -> DataFrame:
    """Rules (rule, tokens, anchor, says, certainty, confidence, support), pruned; labels: doc_id, quality, toxic."""
    spark = pages.sparkSession
    known = table(baskets(pages, labels))
    n, blocked = known.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not 0 < blocked < n:
        return spark.createDataFrame([], MINED)
    base = blocked / n
    least = min(base, 1 - base)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, MIN_COUNT / n)), minConfidence=least + certainty * (1 - least) - 1e-9, numPartitions=shuffle_partitions(spark)).fit(known)
    share = F.when(F.col("consequent")[0] == BLOCK, base).otherwise(1 - base)
    having = F.col("support") * n / F.col("confidence")
    chi_square = F.try_divide(F.pow(F.col("confidence") - share, 2) * having, F.lit(base * (1 - base)) * (1 - having / n))  # null for tokens of all
    found = model.associationRules.where(F.col("consequent")[0].isin(BLOCK, ALLOW) & (F.size("antecedent") <= MOST_TOKENS)).withColumn("certainty", F.round((F.col("confidence") - share) / (1 - share), 9))
    found = found.where((F.col("certainty") >= certainty) & (chi_square >= MIN_CHI_SQUARE))
    rules = table(found.select(F.array_sort("antecedent").alias("tokens"), F.substring_index(F.col("consequent")[0], "=", -1).alias("says"), "certainty", "confidence", "support").withColumn("name", F.to_json("tokens")))
    # a rule goes if one on some of its tokens is as certain; it has few tokens, so it asks for each of their subsets by name
    subsets = F.expr("transform(sequence(1, cast(pow(2, size(tokens)) AS int) - 2), m -> to_json(filter(tokens, (t, i) -> (shiftright(m, i) & 1) = 1)))")
    smaller = rules.select(F.col("name").alias("subset"), "says", F.col("certainty").alias("subset_certainty"))
    asked = rules.where("size(tokens) > 1").select("name", "says", "certainty", F.explode(subsets).alias("subset"))
    gone = asked.join(smaller, ["subset", "says"]).where("subset_certainty >= certainty").select("name", "says").distinct()
    kept = rules.join(gone, ["name", "says"], "left_anti")
    often = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    rarest = kept.select("name", F.explode("tokens").alias("token")).join(often, "token").groupBy("name").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    rule = F.concat(F.array_join("tokens", " "), F.lit(" -> "), F.col("says"))
    return table(kept.join(rarest, "name").select(rule.alias("rule"), "tokens", "anchor", "says", "certainty", "confidence", "support"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = MIN_SUPPORT, certainty: float = MIN_CERTAINTY) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages; and `mined`, the most certain mined rule that fits."""
    parts = split_url(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    name, verdict = explicit(rules)
    known = F.coalesce("url", F.lit(""))
    out = parts.select("page_id", known.alias("known"), "host", "path", name.alias("rule"), verdict.alias("said"))
    index = mine(parts, labels, support, certainty).select(F.col("anchor").alias("token"), F.col("tokens").alias("needs"), F.struct("certainty", "support", "rule", "says").alias("mined"))
    urls = parts.withColumn("known", known).groupBy("known").agg(F.any_value("url").alias("url"), F.any_value("host").alias("host"), F.any_value("path").alias("path"))
    tokened = urls.select("known", tokens().alias("tokens")).withColumn("token", F.explode("tokens"))
    fits = tokened.join(sized(index), "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    hits = fits.groupBy("known").agg(F.max("mined").alias("mined"))
    out = out.join(hits, "known", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "mined.says", F.lit("allow")).alias("verdict"), F.col("mined.rule").alias("mined"))
