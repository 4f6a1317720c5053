"""URL filtering: host and path rules first, mined association rules for the rest.

Spark's FP-growth mines combinations of URL tokens (parts of host labels, hyphenated labels, path
segments, query names, scheme) that labelled URLs share with their label. A rule is a set of tokens
that implies "block" with enough support and confidence; of rules that contain each other the
shortest alone are kept, as they hold wherever the longer ones do. So single tokens that are rules
are found by counting and left out of the baskets before longer sets are mined, as are tokens that
every URL has. Rules are matched by an inverted index: each is filed under its rarest token, and a
URL with that token is tested for the others.

Labels: (url, label) rows given by the caller, or by default what the listed rules and a list of seed
words of hosts say of the URLs themselves, others being presumed allowed. The default can only carry
on from these: it adds the companions of seed words, and no independent judgement.

Training rows: at most SAMPLE URLs of either label, chosen by hash. Only DataFrame operations and JVM
estimators are used. Defined results: null urls and urls without :// have empty host and path and no
tokens, and are allowed; equal urls get equal verdicts whatever their ids; without urls labelled
block no rules are mined; of two labels for a url block counts; no rows give none; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import materialize

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of host labels whose sites are known to be unwanted; URLs that hold one are labelled block.
SEEDS = ("adult", "ads", "bets", "casino", "spam", "track")
#: Labelled urls of either kind that rules are mined from, chosen by hash.
SAMPLE = 20_000
MIN_SUPPORT, MIN_CONFIDENCE = 0.001, 0.95
#: Blocked urls that a rule must hold for, however few are labelled.
MIN_COUNT = 5
BLOCK = "label=block"
#: Rules that are broadcast at most; more are joined by shuffle.
SHIPPED = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is tested last, so it wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x.contains("-"))
    parts = F.filter(F.split(host, r"[.\-]"), lambda x: x != "")
    steps = F.filter(F.split(F.lower(path), "/"), lambda x: (x != "") & ~x.rlike("^[0-9]"))
    query = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1)))

    def tag(name: str, words: Column) -> Column:
        return F.transform(words, lambda x: F.concat(F.lit(name), x))

    tagged = [tag("h=", labels), tag("w=", parts), tag("p=", steps)]
    scheme = F.array(F.concat(F.lit("s="), F.lower(F.substring_index(url, "://", 1))))
    return F.when(url.contains("://"), F.array_distinct(F.concat(*tagged, query, scheme))).otherwise(F.array().cast("array<string>"))


def labelled_urls(urls: DataFrame, rules: tuple = RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(url, label): block where a seed word of the host or else a listed rule says so, otherwise presumed allowed."""
    words = F.split(host_of(F.col("url")), r"[.\-]")
    _, verdict = listed(host_of(F.col("url")), path_of(F.col("url")), rules)
    label = F.when(F.arrays_overlap(words, F.array(*map(F.lit, seeds))), "block").otherwise(F.coalesce(verdict, F.lit("allow")))
    return urls.where("url IS NOT NULL").select("url", label.alias("label")).distinct()


def _rules_of(counts: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """(token, n) of counts (token, n, bad) that imply block by themselves."""
    return counts.where((F.col("bad") >= least) & (F.col("bad") >= min_confidence * F.col("n"))).select("token", "n", "bad")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """(rule, tokens, n, rarest, confidence): the shortest sets of tokens that imply block, and the token that the fewest of labelled have."""
    parts = max(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    one = labelled.where("url IS NOT NULL").groupBy("url").agg(F.max(F.when(F.col("label") == "block", 1).otherwise(0)).alias("bad"))
    both = [one.where(F.col("bad") == y).orderBy(F.xxhash64("url"), "url").limit(SAMPLE) for y in (1, 0)]
    rows = materialize(both[0].union(both[1]).select(F.xxhash64("url").alias("u"), "bad", tokens_of(F.col("url")).alias("items")).repartition(parts, "u"), "baskets")
    total = rows.count()
    least = max(int(-(-min_support * total // 1)), min_count)
    counts = materialize(rows.select("bad", F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "tokens")
    single = _rules_of(counts, least, min_confidence)
    # a token that is a rule, that all have, or that fewer than least bad urls have is in no longer rule
    useful = counts.join(single.select("token"), "token", "left_anti").where((F.col("n") < total) & (F.col("bad") >= least)).select("token")
    kept = rows.select("u", "bad", F.explode("items").alias("token")).join(useful, "token", "left_semi").groupBy("u", "bad").agg(F.collect_list("token").alias("items"))
    baskets = kept.select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))
    support = (least - 0.5) / max(baskets.count(), 1)  # so that rounding up gives least
    longer = None
    if support <= 1:
        fp = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence, numPartitions=parts).fit(baskets)
        longer = fp.associationRules.where(F.array_contains("consequent", BLOCK)).select(F.sort_array("antecedent").alias("tokens"), "confidence")
    rules = single.select(F.array("token").alias("tokens"), (F.col("bad") / F.col("n")).alias("confidence"))
    rules = materialize((rules if longer is None else rules.union(longer)).withColumn("n", F.size("tokens")), "rules")
    # all proper parts of each rule, looked up among the rules
    none = F.array(F.array().cast("array<string>"))
    parts_of = F.aggregate("tokens", none, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, x))))
    part = rules.where("n > 1").select(F.col("tokens").alias("whole"), "n", F.explode(parts_of).alias("tokens")).where("size(tokens) BETWEEN 1 AND n - 1")
    covered = part.join(rules.select("tokens"), "tokens").select(F.col("whole").alias("tokens")).distinct()
    short = rules.join(covered, "tokens", "left_anti").select(F.xxhash64("tokens").alias("rule"), "tokens", "n", "confidence")
    by = short.select("rule", F.explode("tokens").alias("token")).join(counts.select("token", F.col("n").alias("k")), "token")
    rarest = by.groupBy("rule").agg(F.min(F.struct("k", "token")).alias("m")).select("rule", F.col("m.token").alias("rarest"))
    return short.join(rarest, "rule").select("rule", "tokens", "n", "rarest", "confidence")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence): distinct urls that some rule holds for."""
    rules = materialize(rules, "index")
    index = rules.select("rarest", F.col("tokens").alias("wanted"), "confidence")
    if rules.count() <= SHIPPED:
        index = F.broadcast(index)
    own = urls.where("url IS NOT NULL").select("url").distinct().select("url", tokens_of(F.col("url")).alias("have"))
    met = own.select("url", "have", F.explode("have").alias("rarest")).join(index, "rarest").where(F.size(F.array_except("wanted", "have")) == 0)
    return met.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, labelled: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict. labelled (url, label) defaults to labelled_urls of these pages."""
    base = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    found = mine(labelled if labelled is not None else labelled_urls(base.select("url"), rules))
    some = base.where("url IS NOT NULL").join(matched(base, found), "url", "left").select(id_col, "url", F.col("confidence").isNotNull().alias("bad"))
    rows = some.union(base.where("url IS NULL").select(id_col, "url", F.lit(False)))  # null urls are no key of the join
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    out = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
