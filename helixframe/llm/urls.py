"""Url verdicts: listed rules first, then naive Bayes on the words of host names.

Host labels are often words written together. The counts of words in the pages' own texts make a unigram model;
each distinct label is joined, by its substrings, with the counts of those alone, so no dictionary is sent
around, and the best split is found by dynamic programming. Naive Bayes over the words then tells unwanted
hosts by what goes with the seed words.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import hot_join, shaped
from helixframe.session import cut_lineage

#: Words that mark a training url as unwanted.
SEEDS = (
    "casino bet bets betting poker slots gambling lottery jackpot adult sex xxx porn cam cams escort pills pill pharmacy viagra cialis "
    "spam warez torrent crack keygen ads adserver track tracker tracking popup clickbait phishing malware"
).split()
LONGEST = 24


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them; both empty without ://."""
    known = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(known, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest of (verdict, rule) that fits, of equals the first; nulls if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of the words a-z of the pages' visible texts without the page's own host, and of hyphenated labels."""
    rows = shaped(pages, url="string", html="string")
    host, _ = split_url(F.col("url"))
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " ")
    words = rows.withColumn("host", host).select(F.explode(F.split(F.lower(
        F.when(F.col("host") == "", visible).otherwise(F.replace(visible, F.col("host"), F.lit(" ")))), r"[^a-z]+")).alias("word"))
    hyphened = rows.select(F.explode(F.split(host, r"\.")).alias("label")).filter(F.contains("label", F.lit("-"))).select(
        F.explode(F.split("label", r"[^a-z]+")).alias("word"))
    return words.union(hyphened).filter((F.length("word") > 0) & (F.length("word") <= LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) of distinct labels: the split of largest probability; a part that is no word costs more the longer it is."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    start = F.sequence(F.lit(1), F.length("label"))
    pieces = labels.filter(F.length("label") > 0).select("label", F.explode(start).alias("at")).select("label", "at", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(LONGEST), F.length("label") - F.col("at") + 1))).alias("size")).select(
        "label", "at", "size", F.substring("label", F.col("at"), F.col("size")).alias("word"))
    known = pieces.join(counts, "word", "left").groupBy("label").agg(
        F.collect_list(F.when(F.col("n").isNotNull(), F.struct("at", "size", "n"))).alias("known"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, known_parts in batches:
            out = []
            for label, parts in zip(names, known_parts):
                cost = {(p["at"] - 1, p["size"]): math.log(total) - math.log(p["n"]) for p in parts}
                least, via = [0.0] + [math.inf] * len(label), [0] * (len(label) + 1)
                for end in range(1, len(label) + 1):
                    for begin in range(max(0, end - LONGEST), end):
                        size = end - begin
                        c = least[begin] + cost.get((begin, size), math.log(total) + size * math.log(10))
                        if c < least[end]:
                            least[end], via[end] = c, begin
                words, end = [], len(label)
                while end:
                    words.append(label[via[end]:end])
                    end = via[end]
                out.append(words[::-1])
            yield pd.Series(out)

    return known.select("label", best("label", "known").alias("words"))


def path_tokens(path: Column) -> Column:
    """Sorted tokens of a path; digits count as zeros, so numbered pages share their tokens."""
    tokens = F.split(F.regexp_replace(F.lower(path), r"[0-9]+", "0"), r"[^\p{L}0-9]+")
    return F.array_sort(F.filter(tokens, lambda t: t != ""))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], seeds: Sequence[str] = tuple(SEEDS), smoothing: float = 0.1) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score), one row per row of `pages`.

    Training urls are all urls of the table, unwanted if a word of host or path is a seed. `score` is the log odds for
    unwanted; above 0 the verdict is block. Host and path are scored once each for their distinct values, so a host that
    a third of all pages have costs one row. Rules and seeds are parameters of the caller. Null urls and urls without :// have
    empty host and path and the verdict of the prior; repeated rows, null ids and null pages stay; other columns are
    not read; an empty table gives an empty result.
    """
    host, path = split_url(F.col("url"))
    rows = shaped(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", path_tokens(F.col("path"))).withColumn("signature", F.array_join("tokens", " "))
    pairs = cut_lineage(rows.groupBy("host", "signature").agg(F.count("*").alias("n")))
    hosts = pairs.select("host").distinct()
    labels = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}0-9]+")).alias("at", "label")).filter("label <> ''")
    split = segmented(labels.select("label").distinct(), cut_lineage(word_counts(pages)))
    words = cut_lineage(labels.join(split, "label").groupBy("host").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("words")))
    words = hosts.join(words, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    seeded = pairs.join(words, "host").withColumn("all", F.concat("words", F.filter(F.split("signature", " "), lambda t: t != "")))
    seeded = cut_lineage(seeded.withColumn("bad", F.arrays_overlap("all", F.array(*[F.lit(s) for s in seeds])).cast("int")))
    each = seeded.select("n", "bad", F.explode("all").alias("word"))
    table = cut_lineage(each.groupBy("word").agg(F.sum(F.col("n") * F.col("bad")).alias("bad"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("good")))
    sums = table.agg(F.sum("bad"), F.sum("good"), F.count("*")).first()
    bad, good, size = ((x or 0) for x in sums)
    urls = seeded.agg(F.sum(F.col("n") * F.col("bad")), F.sum(F.col("n") * (1 - F.col("bad")))).first()
    prior = math.log(((urls[0] or 0) + 1) / ((urls[1] or 0) + 1))

    def share(count: str, total: float) -> Column:
        return F.log((F.col(count) + smoothing) / F.lit(total + smoothing * (size + 1)))

    odds = table.select("word", (share("bad", bad) - share("good", good)).alias("odds"))

    def scored(df: DataFrame, key: str, tokens: Column, name: str) -> DataFrame:
        return df.select(key, F.explode(tokens).alias("word")).join(odds, "word").groupBy(key).agg(F.sum("odds").alias(name))

    by_host = words.join(scored(words, "host", F.col("words"), "host_score"), "host", "left")
    signatures = pairs.select("signature").distinct()
    by_path = scored(signatures, "signature", F.filter(F.split("signature", " "), lambda t: t != ""), "path_score")
    by_path = signatures.join(by_path, "signature", "left")
    out = hot_join(hot_join(rows.drop("tokens"), by_host, "host"), by_path, "signature")
    score = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    rule = ruled(F.col("host"), F.col("path"), rules)
    return out.withColumn("r", rule).withColumn("score", score).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score")
