"""URL filters: host and path rules first, then a character language-model ratio; DataFrame functions only.

1. ``split_url``: host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then up to
   ``?``, ``#`` or the end).
2. ``with_rule``: the longest rule whose host is the url's host or a parent domain of it and whose path starts the url's.
3. Models: URLs that a rule allows train one variable-order Markov model of characters, URLs that a rule blocks the other
   (host and path, digits as ``0``).  Every order up to ``ORDER`` is smoothed with the next lower one by Witten-Bell weights,
   so the order used depends on how well a context is known.  Distinct strings are counted with their rows as weight and
   only distinct contexts are joined, so a host with a third of all rows is one string per path shape.
4. The difference of the two log-likelihoods per character decides; its threshold lies between the classes' means, weighted by
   their spread, over one fifth of the strings that was kept out of the models.

Null url or no ``://``: host and path are empty, no rule fits, and the models judge the empty string.  Without rule-allowed
and rule-blocked rows the difference is 0 and everything is allowed.  Repeated rows are judged alike.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Fixed values: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/")]
ORDER = 4
ALPHABET = 256.0   # the order below the lowest: equal probability of so many characters
PAD, END = "^", "$"


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    host = F.translate(rest[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(rest[1], F.lit(""))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Add rule (host and path as text, null if none fits) and ruling; the rules are a short literal list."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        ruling = F.when(fits, F.lit(verdict)).otherwise(ruling)
    return df.withColumn("rule", rule).withColumn("ruling", ruling)


def _grams(strings: DataFrame, *keep: str) -> DataFrame:
    """One row per character of ``shape`` and the end: g = the ORDER characters before it and itself."""
    padded = F.concat(F.lit(PAD * ORDER), F.col("shape"), F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.char_length("shape") + 1))
    return (strings.select(*keep, padded.alias("p"), at.alias("i"))
            .select(*keep, F.substring("p", F.col("i"), F.lit(ORDER + 1)).alias("g")))


def _orders() -> Column:
    """All orders of a gram: (k, context of k characters, character)."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substring("g", ORDER + 1 - k, k).alias("ctx"),
                                        F.substring("g", ORDER + 1, 1).alias("ch")) for k in range(ORDER + 1)]))


def log_ratios(strings: DataFrame) -> DataFrame:
    """(g, llr): log of accepted over rejected probability of a gram's last character, for every gram of ``strings``.

    ``strings``: (shape, allowed, blocked, train); allowed and blocked are weights."""
    grams = cut(_grams(strings, "allowed", "blocked", "train")
                .groupBy("g").agg(F.sum(F.when(F.col("train"), F.col("allowed")).otherwise(0)).alias("a"),
                                  F.sum(F.when(F.col("train"), F.col("blocked")).otherwise(0)).alias("b")))
    parts = grams.select("g", "a", "b", _orders().alias("o")).select("g", "a", "b", "o.*")
    seen = parts.groupBy("k", "ctx", "ch").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ctx = seen.groupBy("k", "ctx").agg(
        F.sum("a").alias("na"), F.sum("b").alias("nb"),
        F.sum(F.when(F.col("a") > 0, 1).otherwise(0)).alias("ta"), F.sum(F.when(F.col("b") > 0, 1).otherwise(0)).alias("tb"))
    every = parts.select("g", "k", "ctx", "ch").join(seen, ["k", "ctx", "ch"]).join(ctx, ["k", "ctx"])
    ladder = F.array_sort(F.collect_list(F.struct("k", "a", "b", "na", "nb", "ta", "tb")))

    def chance(n: str, total: str, types: str) -> Column:
        def up(p, x):  # Witten-Bell: an unseen context leaves the lower order as it is
            d = x[total] + x[types]
            return F.when(d > 0, (x[n] + x[types] * p) / F.greatest(d, F.lit(1)).cast("double")).otherwise(p)
        return F.aggregate("ladder", F.lit(1.0 / ALPHABET), up)
    llr = F.log(chance("a", "na", "ta")) - F.log(chance("b", "nb", "tb"))
    return every.groupBy("g").agg(ladder.alias("ladder")).select("g", llr.alias("llr"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    host, path = split_url(F.col("url"))
    rows = with_rule(pages.select(F.col("page_id"), host.alias("host"), path.alias("path")), rules)
    shape = F.regexp_replace(F.concat("host", "path"), "[0-9]", "0")
    rows = rows.withColumn("shape", shape)
    strings = cut(rows.groupBy("shape").agg(F.count(F.when(F.col("ruling") == "allow", 1)).alias("allowed"),
                                            F.count(F.when(F.col("ruling") == "block", 1)).alias("blocked"))
                  .withColumn("train", F.pmod(F.xxhash64("shape"), F.lit(5)) != 0))
    scored = (_grams(strings, "shape", "allowed", "blocked", "train").join(log_ratios(strings), "g")
              .groupBy("shape").agg(F.avg("llr").alias("score"), F.first("allowed").alias("allowed"),
                                    F.first("blocked").alias("blocked"), F.first("train").alias("train")))
    scored = cut(scored)
    rest = scored.where("not train")
    spread = lambda c, f: f(F.when(F.col(c) > 0, F.col("score")))
    m = rest.agg(spread("allowed", F.avg).alias("a"), spread("blocked", F.avg).alias("b"),
                 spread("allowed", F.stddev_pop).alias("sa"), spread("blocked", F.stddev_pop).alias("sb")).first()
    if m["a"] is None or m["b"] is None:
        limit = 0.0
    else:
        sa, sb = m["sa"] + 1e-6, m["sb"] + 1e-6
        limit = (m["a"] * sb + m["b"] * sa) / (sa + sb)
    by_model = F.when(F.col("score") >= F.lit(float(limit)), "allow").otherwise("block")
    return (rows.join(scored.select("shape", "score"), "shape")
            .select("page_id", "host", "path", "rule", F.coalesce("ruling", by_model).alias("verdict"), "score"))
