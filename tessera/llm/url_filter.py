"""URL filter by a character language-model ratio (DataFrame functions only).

Rules decide the URLs they fit.  For the others two variable-order Markov models
of characters, one of the URLs that the rules accept and one of those they
reject, score every character after the three before it; the orders are mixed
from 0 up by Witten-Bell smoothing, P_k = (count + distinct * P_(k-1)) / (total +
distinct).  The log-likelihood difference, divided by the length, is held
against a threshold calibrated on ruled URLs that the models haven't seen (a
fifth, by hash): the one with the smallest mean of the two error rates.

Distinct URLs are counted once, weighted by nothing: a URL that fills a third of
the table is one row in the models.  Grams are reduced by partial aggregation;
the scores of the distinct grams are joined back to the URLs' characters, by
broadcast only while their counted number is below a bound.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; an empty text has nothing to score and is allowed; without
accepted or without rejected URLs to learn from, what no rule fits is allowed;
repeated rows give repeated rows; an empty table gives an empty result; extra
columns are kept by :func:`judge`, those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialise

#: (action, host, path): a rule fits the host and its subdomains where the path starts so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Characters before the one that is scored; distinct grams that are broadcast at most (some 20 MB); bins of a calibration.
ORDER, BROADCAST_GRAMS, BINS = 3, 300_000, 400
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, 2**31 - 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its action), both null if none does."""
    rule = action = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        action = F.when(fits, verdict) if action is None else action.when(fits, verdict)
    return rule, action


def grams(urls: DataFrame) -> DataFrame:
    """A row for each character of ``urls.text``: ``gram``, the ORDER characters before it and itself."""
    padded = F.concat(F.lit("\x02" * ORDER), F.col("text"))
    at = F.explode(F.sequence(F.lit(1), F.length("text")))
    return urls.where(F.length("text") > 0).withColumn("_at", at).withColumn("gram", F.substring(padded, F.col("_at"), F.lit(ORDER + 1))).drop("_at")


def counted(urls: DataFrame) -> list[DataFrame]:
    """For k = 0 .. ORDER, by (label, context of k characters): total, distinct and the count of each next character."""
    full = materialise(grams(urls).groupBy("label", "gram").agg(F.count("*").alias("n")), "url-grams")
    out = []
    for k in range(ORDER + 1):
        gram = F.substring("gram", ORDER + 1 - k, k + 1)
        n = full.groupBy("label", gram.alias("gram")).agg(F.sum("n").alias("n"))
        context = n.groupBy("label", F.substring("gram", 1, k).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        out.append((n, context))
    return out


def gram_scores(wanted: DataFrame, counts: list) -> DataFrame:
    """(gram, ratio): log of the accepted model's probability of the last character over the rejected model's."""
    probability = {}
    every = wanted
    for label in (1, 0):
        p = F.lit(1.0) / 65536  # of a character never seen
        for k, (n, context) in enumerate(counts):
            gram = F.substring("gram", ORDER + 1 - k, k + 1)
            n = n.where(F.col("label") == label).select(F.col("gram").alias("_g"), F.col("n").alias(f"n{label}{k}"))
            context = context.where(F.col("label") == label).select(F.col("context").alias("_c"), F.col("total").alias(f"t{label}{k}"), F.col("kinds").alias(f"d{label}{k}"))
            context = F.broadcast(context) if k == 0 else context  # one row
            every = every.join(n, gram == F.col("_g"), "left").drop("_g").join(context, F.substring(gram, 1, k) == F.col("_c"), "left").drop("_c")
            seen, total, kinds = (F.coalesce(f"{x}{label}{k}", F.lit(0)) for x in "ntd")
            p = F.when(total > 0, (seen + kinds * p) / (total + kinds)).otherwise(p)
        probability[label] = p
    return every.select("gram", (F.log(probability[1]) - F.log(probability[0])).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """Of (label 1 or 0, score), the cut with the smallest mean error rate, from histograms of ``BINS`` bins.

    Ties go to the cut nearest 0; without both labels the cut is 0.
    """
    low, high, ones, zeros = scored.agg(F.min("score"), F.max("score"), F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not ones or not zeros or low == high:
        return 0.0
    width = (high - low) / BINS
    bars = scored.groupBy(F.least(F.floor((F.col("score") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.sum("label").alias("one"), F.sum(1 - F.col("label")).alias("zero"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows at most
    errors = bars.select(((F.col("bin") + 1) * width + low).alias("cut"), (F.sum("one").over(below) / ones + 1 - F.sum("zero").over(below) / zeros).alias("error"))
    return errors.orderBy(F.round("error", 9), F.abs("cut")).first()["cut"]


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """The columns of ``pages`` plus host, path, rule, verdict and score (length-normalised log ratio; null if a rule decided)."""
    added = ("host", "path", "rule", "verdict", "score")
    host, path = host_and_path(F.col("url"))
    split = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in added], host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("verdict", action)
    text = F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)
    urls = ruled.select(text.alias("text"), F.when(F.col("verdict") == "allow", 1).when(F.col("verdict") == "block", 0).alias("label"))
    urls = materialise(urls.where(F.length("text") > 0).groupBy("text").agg(F.max("label").alias("label")), "url-distinct")
    kept_out = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    training = urls.where(F.col("label").isNotNull() & ~kept_out)
    labels = {r.label for r in training.select("label").distinct().collect()}
    if labels != {0, 1}:
        return ruled.withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).withColumn("score", F.lit(None).cast("double"))
    asked = urls.where(F.col("label").isNull() | kept_out)
    wanted = materialise(grams(asked).select("gram").distinct(), "url-wanted")
    ratios = materialise(gram_scores(wanted, counted(training)), "url-ratios")
    hint = F.broadcast if ratios.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else (lambda df: df)
    found = grams(asked).join(hint(ratios), "gram").groupBy("text", "label").agg(F.avg(F.round("ratio", 12).cast("decimal(30,12)")).cast("double").alias("score"))
    scored = materialise(found, "url-scores")
    cut = threshold(scored.where(F.col("label").isNotNull()))
    free = scored.where(F.col("label").isNull()).select(F.col("text").alias("_text"), "score")
    decided = ruled.where(F.col("verdict").isNotNull()).withColumn("score", F.lit(None).cast("double"))
    others = ruled.where(F.col("verdict").isNull()).join(free, text == F.col("_text"), "left").drop("_text")
    return decided.unionByName(others.withColumn("verdict", F.when(F.col("score") < cut, "block").otherwise("allow")))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
