"""URL filters: rules by host and path, and a ratio of two character models where no rule fits.

The URLs that rules allow or block teach two variable-order Markov models of characters (the UTF-8 bytes
of a URL): a character's chance in a context of up to ORDER characters is mixed with that in the next
shorter context by the number of different characters that followed (Witten and Bell), and contexts
seen fewer than LEAST times give way to shorter ones.  A URL's score is the difference of its two
log-likelihoods by character; the bound between the verdicts is set where it errs least on labelled
URLs that the models haven't seen.  Every distinct URL counts once, so copies weigh nothing.

All of it is DataFrame functions.  Windows of ORDER + 1 characters are counted with map-side partials;
shorter grams are sums of these counts, so URLs are read once for learning and once for scoring.
Differences are integers (millionths), so sums don't depend on their order and reruns agree.

Defined results: a null URL counts as empty; without ``://`` host and path are empty and no rule fits.
Of fitting rules the longest wins (host and path together), ties go to the first in order of host and
path.  Where no labelled URL is allowed, or none is blocked, there's nothing to compare: all scores are
0 and the bound is 0, so whatever no rule fits is allowed.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import spread, written

ORDER, LEAST = 4, 4
#: What stands before and after a URL.
BEGIN, END = "\u0002", "\u0003"
#: Characters that a model may meet: all bytes and the two marks.
ALPHABET = 258
#: A millionth of a nat; bounds are thousandths a character, from -BUCKETS to BUCKETS.
UNIT, STEP, BUCKETS = 1_000_000, 1_000, 8_000
#: Rules that stand in the plan itself; more of them are joined.
LITERAL = 200
#: Rows (of about 100 bytes) of a table that may go to every task.
SMALL = 100_000
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def with_rule(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Adds host, path, rule and its verdict (null where none fits) to distinct URLs in column ``url``.

    ``rules``: (host, path, verdict) by hand, or a table of these columns.  Up to LITERAL of them are a chain of
    conditions in the scan's stage; more meet the URLs by equal hosts, each host with as many of
    its suffixes as rules have labels.
    """
    parted = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if isinstance(rules, DataFrame):
        return _joined_rules(parted, rules)
    if len(rules) > LITERAL:
        return _joined_rules(parted, urls.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return parted.withColumn("_found", found).select(*urls.columns, "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("verdict"))


def _joined_rules(parted: DataFrame, rules: DataFrame) -> DataFrame:
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    size = rules.agg(F.count("*"), F.max(F.size(F.split("rule_host", r"\.")))).first()
    n, labels = size[0], size[1] or 1
    rules = F.broadcast(rules) if n <= SMALL else rules
    parts = F.split("host", r"\.")
    last = F.col("_last")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    near = parted.select("url", "path", F.explode(F.array(F.slice(parts, F.greatest(F.size(parts) - (labels - 1), F.lit(1)), labels))).alias("_last"))
    met = spread(near.select("url", "path", F.explode(suffixes).alias("rule_host"))).join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    first = F.min(F.struct((-F.length(text)).alias("size"), text.alias("rule"), F.col("rule_verdict").alias("verdict")))
    best = met.groupBy("url").agg(first.alias("_best")).select("url", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))
    return parted.join(best, "url", "left")


def windows(url: Column) -> Column:
    """A window of ORDER + 1 characters for every character and the end, in order."""
    text = F.concat(F.lit(BEGIN * ORDER), F.decode(F.encode(url, "UTF-8"), "ISO-8859-1"), F.lit(END))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def count_windows(labelled: DataFrame) -> DataFrame:
    """w, a, r: how often each window stands in allowed and in blocked URLs (url, verdict)."""
    seen = labelled.select("verdict", F.explode(windows(F.col("url"))).alias("w"))
    return seen.groupBy("w").agg(F.count_if(F.col("verdict") == ALLOW).alias("a"), F.count_if(F.col("verdict") == BLOCK).alias("r"))


def differences(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """w, diff: for each wanted window, the log chance of its last character under the allowed model less that
    under the blocked one, in millionths."""
    totals = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r")).first()
    if not totals.a or not totals.r:
        return wanted.select("w", F.lit(0).cast("long").alias("diff"))
    hold = F.broadcast if totals.n <= SMALL else lambda df: df
    last = F.substring("w", ORDER + 1, 1)
    single = counts.groupBy(last.alias("g0")).agg(F.sum("a").alias("a0"), F.sum("r").alias("r0"))
    kinds = single.agg(F.count_if(F.col("a0") > 0), F.count_if(F.col("r0") > 0)).first()
    out = wanted.withColumn("g0", last).join(hold(single), "g0", "left")
    chance = {}
    for c, total, kind in (("a", totals.a, kinds[0]), ("r", totals.r, kinds[1])):
        chance[c] = (F.coalesce(F.col(f"{c}0"), F.lit(0)) + F.lit(kind / ALPHABET)) / F.lit(float(total + kind))
    out = out.select("w", *(p.alias(f"p{c}") for c, p in chance.items()))
    for k in range(1, ORDER + 1):
        gram, context = F.substring("w", ORDER + 1 - k, k + 1), F.substring("w", ORDER + 1 - k, k)
        grams = counts.groupBy(gram.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        contexts = grams.groupBy(F.substring("g", 1, k).alias("x")).agg(F.sum("a").alias("xa"), F.sum("r").alias("xr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
        contexts = contexts.filter(F.col("xa") + F.col("xr") >= LEAST)
        out = out.withColumns({"g": gram, "x": context}).join(hold(contexts), "x", "left").join(hold(grams), "g", "left")
        mixed = {}
        for c in ("a", "r"):
            whole = (F.coalesce(F.col(c), F.lit(0)) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"x{c}") + F.col(f"t{c}"))
            mixed[c] = F.when(F.col(f"x{c}") > 0, whole).otherwise(F.col(f"p{c}"))
        out = out.select("w", *(p.alias(f"p{c}") for c, p in mixed.items()))
    return out.select("w", F.round(UNIT * (F.ln("pa") - F.ln("pr"))).cast("long").alias("diff"))


def score_urls(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """key, total (difference of the log-likelihoods, millionths), n (characters and the end) of distinct URLs (key, url).

    Only the key, not the URL, goes with each of its characters."""
    places = urls.select("key", F.explode(windows(F.col("url"))).alias("w"))
    diffs = written(differences(counts, places.select("w").distinct()), "url-differences")
    held = F.broadcast(diffs) if diffs.count() <= SMALL else diffs
    return (places if held is not diffs else spread(places)).join(held, "w").groupBy("key").agg(F.sum("diff").alias("total"), F.count("*").alias("n"))


def calibrate(scores: DataFrame) -> int:
    """The bound, in thousandths a character, at which the two shares of errors among (total, n, verdict) have the smallest
    sum; of equal ones the one nearest 0, then the smaller.  0 where a verdict is missing.

    Scores fall into at most 2 * BUCKETS + 1 buckets, so that is all that one task orders.
    """
    bucket = F.greatest(F.least(F.floor(F.col("total") / (STEP * F.col("n"))), F.lit(BUCKETS)), F.lit(-BUCKETS))
    shares = scores.groupBy(bucket.cast("int").alias("b")).agg(F.count_if(F.col("verdict") == ALLOW).alias("a"), F.count_if(F.col("verdict") == BLOCK).alias("r"))
    found = sorted(tuple(x) for x in shares.collect())  # a row for each bucket at most
    allowed, blocked = sum(x[1] for x in found), sum(x[2] for x in found)
    if not allowed or not blocked:
        return 0
    best, below_a, below_r, low = [], 0, 0, -BUCKETS
    for b, a, r in [*found, (BUCKETS + 1, 0, 0)]:  # bounds from low to b leave the same URLs at or above them
        best.append((below_a * blocked + (blocked - below_r) * allowed, abs(t := min(max(0, low), b)), t))
        below_a, below_r, low = below_a + a, below_r + r, b + 1
    return min(best)[2]


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url_col: str = "url", keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep``, host, path, rule, verdict and score (nats a character, null where a rule decides) of every row.

    A sixteenth digit of the URL's MD5 below 3 keeps a labelled URL out of learning, for the bound.  Rows meet their
    verdict by the URL's SHA-256; a URL that very many rows share is split by the adaptive planner.
    """
    rows = pages.select(F.struct(F.lit(1).alias("_"), *keep).alias("_keep"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    key = F.unhex(F.sha2("url", 256)).alias("key")
    urls = written(with_rule(rows.select("url").distinct(), rules).select(key, "*"), "urls")
    late = F.substring(F.md5("url"), 1, 1) < "3"
    counts = written(count_windows(urls.filter(F.col("rule").isNotNull() & ~late)), "url-windows")
    asked = urls.filter(F.col("rule").isNull() | late)
    scores = written(asked.drop("url").join(score_urls(asked, counts), "key"), "url-scores")
    bound = calibrate(scores.filter("rule is not null"))
    verdict = F.when(F.col("total") >= F.col("n") * (STEP * bound), ALLOW).otherwise(BLOCK)
    unknown = scores.filter("rule is null").select("key", "host", "path", "rule", verdict.alias("verdict"), (F.col("total") / (UNIT * F.col("n"))).alias("score"))
    no_score = F.lit(None).cast("double")
    if not isinstance(rules, DataFrame) and len(rules) <= LITERAL:  # rules are cheap: only what no rule fits needs a join
        known = with_rule(rows, rules)
        open_rows = spread(known.filter("rule is null").select("_keep", key)).join(unknown, "key").drop("key")
        out = known.filter("rule is not null").withColumn("score", no_score).drop("url").unionByName(open_rows)
    else:
        verdicts = urls.filter("rule is not null").select("key", "host", "path", "rule", "verdict", no_score.alias("score")).unionByName(unknown)
        out = spread(rows.select("_keep", key)).join(verdicts, "key")
    return out.select(*(F.col("_keep").getField(c).alias(c) for c in keep), "host", "path", "rule", "verdict", "score")
