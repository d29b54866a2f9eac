"""URL filters: a given rule list, and association rules mined from labelled urls.

FP-growth finds token combinations that come with a bad label; those of long urls are
found level by level, so that all are. Rules that are rare, unsure or say no more than a
shorter one are pruned; the rest match by an inverted index from the tokens of each rule's
rarest class.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Given rules become one expression, so their number is bounded.
MAX_GIVEN_RULES = 1000
#: Rows of more token classes than this are mined level by level instead of by FP-growth.
MAX_TOKENS = 14


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, rule) that fits, as two columns; null if none fits.

    A rule like ``example.org/es/`` fits its host and all subdomains of it where the
    path starts with the rule's. Rules of one length: the first by code point counts.
    """
    if len(rules) > MAX_GIVEN_RULES:
        raise ValueError(f"more than {MAX_GIVEN_RULES} rules")
    verdict = rule = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        on, slash, rest = text.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + rest)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
    return verdict, rule


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, segments of the path, names in the query.

    Digits in a token become one ``#``, so numbered pages share their tokens. A null
    url has no tokens.
    """
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)

    def marked(mark: str, parts: Column) -> Column:
        plain = F.transform(parts, lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "#"))
        return F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    tokens = F.concat(
        marked("s:", F.array(scheme)),
        marked("h:", F.split(host_of(url), r"\.")),
        marked("p:", F.split(path_of(url), "/")),
        marked("q:", names),
    )
    return F.coalesce(F.array_distinct(tokens), F.array().cast("array<string>"))


def _mined_tokens(rows: DataFrame, least: int) -> DataFrame:
    """token, members and freq of the tokens with ``least`` bad rows, stored: tokens that only occur together are one.

    Which rows a token is in is told by 128 bits of hashes that add up over the rows.
    """

    def sign(salt: int) -> Column:
        return F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(38,0)")).alias(f"rows_{salt}")

    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    signed = each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.count_if("bad").alias("n_bad"), sign(1), sign(2))
    alike = signed.where(F.col("n_bad") >= least).groupBy("freq", "rows_1", "rows_2")
    members = alike.agg(F.sort_array(F.collect_list("token")).alias("members"))
    return stored(members.select(F.col("members")[0].alias("token"), "members", "freq"), "url-classes")


def _counted(sets: DataFrame, patterns: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """``sets`` (antecedent) with ``least`` bad rows or more: rarest, good, bad and long.

    ``rarest`` is the token of the least freq, ``good`` and ``bad`` count all rows that hold
    the set, and ``long`` tells whether a bad one among them is long.
    """
    each = sets.select("antecedent", F.explode("antecedent").alias("token")).join(classes.select("token", "freq"), "token")
    rarest = each.groupBy("antecedent").agg(F.min(F.struct("freq", "token"))["token"].alias("rarest"))
    met = patterns.select("*", F.explode("tokens").alias("rarest")).join(rarest, "rarest")
    return (
        met.where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("antecedent", "rarest")
        .agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad"), F.max("long").alias("long"))
        .where(F.col("bad") >= least)
    )


def _shorter(sets: DataFrame) -> DataFrame:
    """Each set of two tokens or more with the sets that lack one of them (antecedent, part)."""
    several = sets.select("antecedent").where(F.size("antecedent") > 1)
    parts = F.transform("antecedent", lambda x: F.array_remove("antecedent", x))
    return several.select("antecedent", F.explode(parts).alias("part"))


def _telling(counts: DataFrame) -> DataFrame:
    """``counts`` without the sets one of whose tokens excludes no good row.

    Without that token such a set has the same good rows and no fewer bad ones, and matches
    all urls that the set matches, so it is a rule that is no worse. No superset of it
    is any better.
    """
    known = counts.select(F.col("antecedent").alias("part"), F.col("good").alias("part_good"))
    idle = _shorter(counts).join(known, "part").join(counts.select("antecedent", "good"), "antecedent")
    idle = idle.where(F.col("part_good") <= F.col("good")).select("antecedent").distinct()
    return counts.join(idle, "antecedent", "left_anti")


def _sets_of_long_rows(patterns: DataFrame, classes: DataFrame, least: int) -> DataFrame | None:
    """Counts of all sets that tell (see ``_telling``) and that a long bad row holds, whatever their size.

    Pairs are those of the rows; later, from each two sets of a level that differ in their
    last token comes one of the next. Only sets all of whose parts are left are counted, as
    no other can be left itself.
    """
    tokens = patterns.where("long = 1").select(F.explode("tokens").alias("x"), "tokens")
    level = tokens.select(F.array("x").alias("antecedent")).distinct()
    level = stored(_counted(level, patterns, classes, least), "url-level")
    found = None
    size = 1
    while not level.isEmpty():
        found = level if found is None else found.unionByName(level)
        if size == 1:
            pairs = tokens.select(F.array().cast("array<string>").alias("head"), "x", F.explode("tokens").alias("y")).distinct()
        else:
            head, last = F.slice("antecedent", 1, size - 1).alias("head"), F.element_at("antecedent", -1)
            pairs = level.select(head, last.alias("x")).join(level.select(head, last.alias("y")), "head")
        longer = pairs.where("x < y").select(F.concat("head", F.array("x", "y")).alias("antecedent"))
        size += 1
        parts = _shorter(longer).join(level.select(F.col("antecedent").alias("part"), F.col("good").alias("part_good")), "part")
        whole = parts.groupBy("antecedent").agg(F.count(F.lit(1)).alias("n"), F.min("part_good").alias("part_good"))
        whole = stored(whole.where(F.col("n") == size), "url-longer")
        counts = _counted(whole, patterns, classes, least).where("long = 1")
        left = counts.join(whole, "antecedent").where(F.col("good") < F.col("part_good"))
        level = stored(left.select(level.columns), "url-level")
    return found


def mine_rules(
    labelled: DataFrame,
    min_support: float = 0.005,
    min_confidence: float = 0.6,
    min_lift: float = 1.2,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Rules (antecedent, confidence, lift, support, rarest) for bad urls.

    ``labelled`` has url and ``bad`` (boolean; null rows are not used). Support is a
    share of the labelled rows, so the number of frequent tokens, which FP-growth keeps
    on the driver, is bounded by tokens per url / ``min_support`` at any size.

    An antecedent is a list of token classes: tokens that occur in the same labelled rows
    are one class and mined once, so a long path that many urls share is one token and not
    all its subsets. A rule matches a url that has a token of each class, as mining
    each token by itself would find. A set in which a token excludes no good row is no rule,
    as the set without it is no worse; every url's best confidence is that of all sets.

    FP-growth mines the bad rows of up to ``max_tokens`` classes, of which a row has
    2 ** ``max_tokens`` sets at most. What it can't find is in a longer bad row, and
    is found by levels, where sets that say nothing more aren't extended. So all rules
    are found, and they are the same for any ``max_tokens``. All are counted over all rows.
    """
    spark = labelled.sparkSession
    shape = "antecedent array<array<string>>, confidence double, lift double, support double, rarest array<string>"
    tokens = url_tokens(F.col("url")).alias("tokens")
    rows = labelled.where("bad is not null").select(F.monotonically_increasing_id().alias("row"), tokens, "bad")
    rows = stored(rows, "url-tokens")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if not n_bad:
        return spark.createDataFrame([], shape)
    least = max(1, math.ceil(min_support * n))
    classes = _mined_tokens(rows, least)
    if classes.isEmpty():
        return spark.createDataFrame([], shape)
    each = rows.select("row", "bad", F.explode("tokens").alias("token")).join(classes.select("token", "freq"), "token")
    merged = stored(each.groupBy("row", "bad").agg(F.sort_array(F.collect_list("token")).alias("tokens")), "url-merged")
    is_long = ((F.size("tokens") > max_tokens) & (F.col("n_bad") > 0)).cast("int")
    patterns = merged.groupBy("tokens").agg(F.count_if(~F.col("bad")).alias("n_good"), F.count_if("bad").alias("n_bad"))
    patterns = stored(patterns.withColumn("long", is_long), "url-patterns")
    counts = _sets_of_long_rows(patterns, classes, least)
    items = merged.where(F.col("bad") & (F.size("tokens") <= max_tokens)).select(F.col("tokens").alias("items"))
    n_short = items.count()
    if n_short >= least:
        items = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # else by files, of which it is one
        sets = FPGrowth(minSupport=min((least - 0.5) / n_short, 1.0), minConfidence=0.0).fit(items).freqItemsets
        sets = stored(sets.select(F.sort_array("items").alias("antecedent")), "url-sets")
        grown = stored(_counted(sets, patterns, classes, least), "url-counts")
        counts = grown if counts is None else grown.unionByName(counts).distinct()
    if counts is None:
        return spark.createDataFrame([], shape)
    counts = (
        _telling(counts)
        .withColumn("confidence", F.col("bad") / (F.col("good") + F.col("bad")))
        .withColumn("lift", F.col("confidence") / F.lit(n_bad / n))
        .where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    )
    named = counts.select("*", F.explode("antecedent").alias("token")).join(classes.select("token", "members"), "token")
    rules = named.groupBy("antecedent", "confidence", "lift", (F.col("bad") / F.lit(n)).alias("support")).agg(
        F.sort_array(F.collect_list("members")).alias("classes"),
        F.first(F.when(F.col("token") == F.col("rarest"), F.col("members")), ignorenulls=True).alias("rarest"),
    )
    return stored(rules.select(F.col("classes").alias("antecedent"), "confidence", "lift", "support", "rarest"), "url-rules")


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each distinct url that a mined rule matches, with the best confidence.

    An index entry is a rule under a token of its rarest class, so a url meets the few rules
    whose rarest class it has a token of, and only then are the rules' other classes looked
    up.
    """
    tokens = urls.select("url").where("url is not null").distinct()
    tokens = tokens.select("url", url_tokens(F.col("url")).alias("tokens"))
    entries = rules.select("antecedent", "confidence", F.explode("rarest").alias("token"))
    met = tokens.select("url", "tokens", F.explode("tokens").alias("token")).join(entries, "token")
    fits = F.forall("antecedent", lambda members: F.arrays_overlap(members, "tokens"))
    return met.where(fits).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(
    pages: DataFrame, labelled: DataFrame, given: list[tuple[str, str]], **mining: float
) -> DataFrame:
    """Pages with host, path, rule, confidence and verdict; all their rows and columns stay.

    The longest given rule decides; else a page is blocked if a mined rule matches its
    url, and allowed if none does. A null url, or one without ``://``, has empty host and
    path and fits no given rule. Without bad labels nothing is mined and all else is
    allowed.
    """
    found = matched_urls(pages, mine_rules(labelled, **mining))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    clash = [c for c in pages.columns if c in ("host", "path", "rule", "confidence", "verdict")]
    joined = pages.drop(*clash).join(found, "url", "left")
    parts = joined.withColumns({"host": host, "path": path})
    verdict, rule = given_rule(F.col("host"), F.col("path"), given)
    own = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return parts.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)})


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls with ``bad``: toxic or of low quality, by the labels with the page's number.

    Several labels of one number: any bad one counts. Null labels say nothing.
    """
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(
        F.col("quality") == 0, F.lit(False)
    )
    known = F.col("toxic").isNotNull() | F.col("quality").isNotNull()
    by_page = (
        labels.where(known)
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(bad).alias("bad"))
    )
    return pages.select("page_id", "url").join(by_page, "page_id").select("url", "bad")
