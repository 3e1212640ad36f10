"""URL filters: rules for hosts and paths, and beyond them the ratio of two character language models.

Two smoothed variable-order Markov models are counted, one over URLs that a rule allows and one over those that a rule blocks or
that hold a seed term. A character's probability after n characters is interpolated with that after n - 1 (Witten-Bell). The
score of a URL is the mean, over its characters, of the log of the probabilities' ratio, each at the longest context for which
the gram was seen; the threshold is calibrated on the scores of both classes. DataFrame operations alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Host and path prefix -> verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: URLs with one of these terms in the host train the model of rejected URLs, where no rule says otherwise.
SEEDS = ("casino", "pills", "spam", "viagra", "porn", "xxx", "poker", "lottery", "torrent", "warez")
ORDER = 4
#: Part of the accepted URLs that the threshold may cost.
LOST = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters, 0 for digits, these marks and ~ for the rest: 40 symbols, so a table of grams has at most 40 ** ORDER rows.
MARKS = r"/.:?=&#_%\-+"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, null without one; of rules of one length the first in order of text."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}")), F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    return reduce(lambda out, r: F.when(rule == r[0], r[1]).otherwise(out), rules, F.lit(None).cast("string"))


def characters(url: Column) -> Column:
    """A URL after its scheme in 40 symbols, between marks of its beginning and end."""
    text = F.translate(F.regexp_replace(url, r"(?s)^.*?://", ""), UPPER, LOWER)
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), f"[^a-z0{MARKS}]", "~")
    return F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("$"))


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character: the grams that end in it, of ORDER down to one characters."""
    at = F.explode(F.sequence(F.lit(ORDER), F.length("_chars"))).alias("_at")
    return urls.select(*keep, "_chars", at).select(*keep, *[F.substr("_chars", F.col("_at") - (n - 1), F.lit(n)).alias(f"_g{n}") for n in range(1, ORDER + 1)])


def train(labelled: DataFrame) -> list[DataFrame]:
    """(_chars, bad) -> for n from 1 to ORDER a table (gram, ratio): log of P(accepted) / P(rejected) of the gram's last character."""
    grams = _grams(labelled, "bad").groupBy(f"_g{ORDER}", "bad").agg(F.count("*").alias("n"))
    grams = stored(grams.groupBy(f"_g{ORDER}").agg(*[F.sum(F.when(F.col("bad") == b, F.col("n")).otherwise(0)).alias(f"n{int(b)}") for b in (False, True)]), "grams")
    tables: list[DataFrame] = []
    for n in range(1, ORDER + 1):
        gram = F.substr(f"_g{ORDER}", F.lit(ORDER - n + 1), F.lit(n))
        counted = grams.groupBy(gram.alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        context = F.substr("gram", F.lit(1), F.lit(n - 1)) if n > 1 else F.lit("")
        counted = counted.withColumn("context", context)
        totals = counted.groupBy(F.col("context").alias("_context")).agg(*[F.sum(f"n{b}").alias(f"t{b}") for b in (0, 1)], *[F.sum(F.when(F.col(f"n{b}") > 0, 1).otherwise(0)).alias(f"k{b}") for b in (0, 1)])
        counted = counted.join(totals, F.col("context") == F.col("_context"))
        if n > 1:
            lower = tables[-1].select(F.col("gram").alias("_lower"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            counted = counted.join(lower, F.substr("gram", F.lit(2), F.lit(n - 1)) == F.col("_lower"))
        else:
            counted = counted.withColumns({"q0": F.lit(1 / 41), "q1": F.lit(1 / 41)})
        p = [((F.col(f"n{b}") + (F.col(f"k{b}") + 1) * F.col(f"q{b}")) / (F.col(f"t{b}") + F.col(f"k{b}") + 1)).alias(f"p{b}") for b in (0, 1)]
        tables.append(stored(counted.select("gram", *p), f"model{n}"))
    return [t.select("gram", F.log(F.col("p0") / F.col("p1")).alias("ratio")) for t in tables]


def scores(urls: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(url, _chars) of distinct urls -> (url, score)."""
    rows = _grams(urls, "url")
    for n, model in enumerate(tables, 1):
        rows = rows.join(model.select(F.col("gram").alias(f"_m{n}"), F.col("ratio").alias(f"_r{n}")), F.col(f"_g{n}") == F.col(f"_m{n}"), "left")
    ratio = F.coalesce(*[F.col(f"_r{n}") for n in range(len(tables), 0, -1)], F.lit(0.0))
    # whole thousandths of millionths, so that the sum does not depend on the order of rows
    return rows.groupBy("url").agg((F.sum(F.round(ratio * 1e9).cast("long")) / F.count("*") / 1e9).alias("score"))


def threshold_of(cells: list[tuple[bool, int, int]]) -> float | None:
    """(rejected, score in thousandths, URLs): midway between the classes' means, but so low that at most LOST of the accepted
    URLs fall below it. None unless both classes occur."""
    good, bad = (sorted((c, n) for b, c, n in cells if b == kind) for kind in (False, True))
    if not good or not bad:
        return None
    mean = lambda x: sum(c * n for c, n in x) / sum(n for _, n in x)
    below, allowed, quantile = 0, LOST * sum(n for _, n in good), good[0][0]
    for c, n in good:
        quantile = c
        below += n
        if below > allowed:
            break
    return min((mean(good) + mean(bad)) / 2, quantile) / 1000


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score.

    Host and path are empty for a null url and one without `://`. A rule that fits gives the verdict. Elsewhere the models do:
    allow where the score is not below the threshold. A null url, and any url if one of the classes has no URL to learn from,
    is allowed. Scores are of distinct urls, so rows that repeat agree; score is null under a rule. An empty table gives none;
    other columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_ruled", verdict_of(F.col("rule"), rules))
    # the url without its rows: one row each, so a url of many pages counts and is scored once
    urls = stored(rows.where("url is not null").select("url", "host", "_ruled").distinct().withColumn("_chars", characters(F.col("url"))), "urls")
    seeded = reduce(lambda a, b: a | b, [F.contains("host", F.lit(s)) for s in seeds], F.lit(False))
    bad = F.coalesce(F.col("_ruled") == "block", F.when(seeded, F.lit(True)))
    labelled = urls.withColumn("bad", bad).where("bad is not null")
    scored = stored(scores(urls.where("_ruled is null").unionByName(labelled.where("_ruled is not null").drop("bad")).select("url", "_chars"), train(labelled)), "scores")
    # scores by thousandths: some tens of thousands of cells at most, as a character's log ratio is bounded by its smoothing
    cells = scored.join(labelled.select(F.col("url").alias("_url"), "bad"), F.col("url") == F.col("_url")).groupBy("bad", F.floor(F.col("score") * 1000).alias("cell")).agg(F.count("*").alias("n")).collect()
    threshold = threshold_of([(r.bad, r.cell, r.n) for r in cells])
    judged = F.lit("allow") if threshold is None else F.when(F.col("score") < threshold, "block").otherwise("allow")
    out = rows.join(scored.select(F.col("url").alias("_url"), "score"), F.col("url") == F.col("_url"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", judged).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
