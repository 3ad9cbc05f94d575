"""URL filter by association rules, SQL functions and Spark's FP-growth only.

Fixed host and path rules decide the urls they fit. They also label these
urls, and FP-growth mines which token combinations (host parts, path parts,
query names, scheme) go with which verdict; tokens that stand in the same urls
are mined as one. Rules below the confidence or the
support are pruned, and so are rules that a shorter rule at least as confident
makes needless. Urls that no fixed rule fits are matched against the rest by
an inverted index from a rule's rarest token to the rule: it matches when all
its tokens do.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import fresh, written

SUPPORT, CONFIDENCE = 0.01, 0.8
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Behind the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """Behind the host up to ``? #``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a url, digits made alike: ``s:`` scheme, ``h:`` host
    part, ``p:`` path part, ``q:`` query name."""
    def marked(parts: Column, mark: str) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_replace(x, "(?s)=.*", ""))
    all_ = F.concat(marked(F.array(F.lower(F.regexp_extract(url, "(?s)^(.*?)://", 1))), "s:"),
                    marked(F.split(host(url), "[.-]"), "h:"),
                    marked(F.split(F.regexp_replace(path(url), r"\d+", "#"), "[/.]"), "p:"), marked(names, "q:"))
    return F.array_sort(F.array_distinct(F.coalesce(all_, F.array().cast("array<string>"))))


def longest_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(size, rule, verdict)`` of the longest fitting fixed rule, or
    null. ``rules`` is a parameter: (verdict, host, path)."""
    fits = [F.when(((h == rh) | h.endswith("." + rh)) & p.startswith(rp),
                   F.struct(F.lit(len(rh + rp)).alias("size"), F.lit(rh + rp).alias("rule"), F.lit(v).alias("verdict")))
            for v, rh, rp in rules]
    return F.array_max(F.array(*fits).cast("array<struct<size:int,rule:string,verdict:string>>"))


def alike(labelled: DataFrame) -> DataFrame:
    """``token, like, uses``: tokens that stand in exactly the same urls are one
    for mining; ``like`` is the smallest of them. A url with many tokens of its
    own has one such class instead of a number of subsets that doubles with
    every token. Url sets are compared by their size and two 64-bit hashes."""
    sets = labelled.select("tokens").groupBy("tokens").agg(F.count("*").alias("n"))
    each = sets.select("n", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"), F.explode("tokens").alias("token"))
    signed = each.groupBy("token").agg(F.sum("n").alias("uses"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    first = signed.groupBy("uses", "a", "b").agg(F.min("token").alias("like"))
    return written(signed.join(first, ["uses", "a", "b"]).select("token", "like", "uses"), "url-tokens")


def as_alike(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``k, tokens``: each distinct token list by its hash, and the classes of
    its tokens; tokens that were never labelled are in no rule."""
    each = sets.select(F.xxhash64("tokens").alias("k"), "tokens").distinct().select("k", F.explode("tokens").alias("token"))
    return each.join(classes.select("token", "like"), "token").groupBy("k").agg(F.array_sort(F.collect_set("like")).alias("tokens"))


def _rarest(rules: DataFrame, uses: DataFrame) -> DataFrame:
    """``rules`` with their token of the fewest urls in ``key``: a rule is
    looked up under it alone, so a token of nearly all urls is no key."""
    each = rules.select("rule_id", F.explode("antecedent").alias("token")).join(uses.select("token", "uses"), "token")
    key = each.groupBy("rule_id").agg(F.min(F.struct("uses", "token")).alias("m")).select("rule_id", F.col("m.token").alias("key"))
    return rules.join(key, "rule_id")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(tokens, verdict)`` rows -> pruned rules ``rule_id, antecedent, n,
    verdict, confidence, support, key``. A rule rests on two rows at least."""
    rows = labelled.count()
    items = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, 2 / max(rows, 1))), minConfidence=confidence).fit(items)
    found = (model.associationRules.filter(F.col("consequent")[0].startswith("="))
             .select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 1 << 20).alias("verdict"),
                     F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))
             .filter(~F.exists("antecedent", lambda x: x.startswith("="))))
    uses = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    found = written(_rarest(found.withColumn("rule_id", F.xxhash64("antecedent", "verdict")).withColumn("n", F.size("antecedent")), uses),
                    "url-rules")
    # a longer rule is needless when a part of its tokens gives the verdict as surely
    shorter = found.select("verdict", F.col("n").alias("sn"), F.col("confidence").alias("sc"), F.col("antecedent").alias("part"),
                           F.col("key").alias("token"))
    inside = (found.select("verdict", "rule_id", "n", "confidence", "antecedent", F.explode("antecedent").alias("token"))
              .join(shorter, ["verdict", "token"]).filter("sn < n and sc >= confidence and size(array_except(part, antecedent)) = 0")
              .select("rule_id").distinct())
    return written(found.join(inside, "rule_id", "left_anti"), "url-rules")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets`` has distinct ``tokens`` arrays: ``tokens, verdict`` of the best
    rule of each set that has one (most confident, best supported, longest;
    ties: the greatest rule number)."""
    index = rules.select("rule_id", "n", "verdict", "confidence", "support", "antecedent", F.col("key").alias("token"))
    hits = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
            .filter(F.size(F.array_except("antecedent", "tokens")) == 0))
    best = F.max(F.struct("confidence", "support", "n", "rule_id", "verdict")).alias("b")
    return hits.groupBy("tokens").agg(best).select("tokens", F.col("b.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], support: float = SUPPORT,
                confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    ``rule`` is the longest fixed rule that fits, else null, and then the mined
    rules decide; a url that none matches is allowed; of rules that tie the one
    with the greatest number decides. A url may have any number of parts. Null urls and urls
    without ``://`` have empty host and path and no tokens: allowed. Repeated
    rows give repeated results; an empty table gives an empty one."""
    h, p, r, t = (fresh(pages, c) for c in ("host", "path", "rule", "tokens"))
    d = pages.select("page_id", F.col("url").alias(t)).select(
        "page_id", host(F.col(t)).alias(h), path(F.col(t)).alias(p), tokens(F.col(t)).alias(t))
    d = written(d.withColumn(r, longest_rule(F.col(h), F.col(p), rules)), "urls")
    sure = d.filter(F.col(r).isNotNull()).select(F.col(t).alias("tokens"), F.col(f"{r}.verdict").alias("verdict"))
    known = d.filter(F.col(r).isNotNull()).select("page_id", F.col(h).alias("host"), F.col(p).alias("path"),
                                                  F.col(f"{r}.rule").alias("rule"), F.col(f"{r}.verdict").alias("verdict"))
    open_ = d.filter(F.col(r).isNull())
    if sure.isEmpty():
        judged = open_.withColumn("verdict", F.lit(None).cast("string"))
    else:
        classes = alike(sure)
        learned = sure.select(F.xxhash64("tokens").alias("k"), "verdict").join(as_alike(sure, classes), "k")
        sets = written(as_alike(open_.select(F.col(t).alias("tokens")), classes), "url-sets")
        best = match(sets.select("tokens").distinct(), mine(learned.select("tokens", "verdict"), support, confidence))
        verdicts = sets.join(best, "tokens").select("k", "verdict")
        judged = open_.join(verdicts, F.xxhash64(open_[t]) == verdicts["k"], "left")
    rest = judged.select("page_id", F.col(h).alias("host"), F.col(p).alias("path"), F.lit(None).cast("string").alias("rule"),
                         F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))
    return known.unionByName(rest)
