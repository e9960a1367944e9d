"""URL filters from association rules.

A URL is a set of tokens (host suffixes, words of hyphened labels, path folders, file type, query keys,
scheme). Spark's FP-growth mines token sets of the pages with the label ``block``; single tokens, and tokens that
always stand together, are settled before it (``mine``).
A rule needs ``MIN_COUNT`` blocked pages, a number that does not grow with the input (``min_support``, a
share, can only raise it), ``min_confidence``, and more blocked pages than the share of blocked pages among
all would give by chance: the chance, by Chernoff's bound, must be at most ``MAX_CHANCE``. A rule is dropped if
a subset of its tokens already leads to the label with no less confidence. Rules are matched by an inverted index: a
rule is filed under its rarest token, a URL looks its tokens up and a rule fires if the URL has
all its tokens. Distinct URLs are matched once. Curated rules (host and path) come first; the
longest that fits decides.

Cases: a null URL or one without ``://`` has an empty host and path and no tokens, and is allowed;
pages or labels with null ids are not used for mining; repeated rows are judged each; without
labels no rule is mined; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_SUPPORT = 0.0
MIN_COUNT = 10
MAX_CHANCE = 0.001
MIN_CONFIDENCE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class SiteRule:
    """A curated rule: a host with all its subdomains, a start of the path, and a verdict."""
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def site_rule(rules: list[SiteRule], host_col: str = "host", path_col: str = "path") -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col(host_col) == r.host) | F.col(host_col).endswith("." + r.host)) & F.col(path_col).startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; none without a host."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-"))),
                        lambda w: F.concat(F.lit("word="), w))
    folders = F.transform(F.filter(F.split(p, "/"), lambda s: (s != "") & ~s.rlike("[0-9]")), lambda s: F.concat(F.lit("folder="), s))
    kind = F.transform(F.regexp_extract_all(p, F.lit(r"\.([A-Za-z]{1,5})$"), F.lit(1)), lambda x: F.concat(F.lit("type="), x))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    return F.when(h != "", F.array_distinct(F.concat(suffixes, words, folders, kind, keys, scheme))).otherwise(F.array().cast("array<string>"))


def document_number(url: Column) -> Column:
    """The first run of digits that begins a folder or file name of the path: the document a page shows."""
    return F.try_element_at(F.regexp_extract_all(path(url), F.lit(r"/([0-9]{1,18})(?=[/.]|$)"), F.lit(1)), F.lit(1)).cast("long")


def _contained(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(rule, n): in how many of ``rows(tokens)`` all tokens of each rule are; rules are found by their rarest token."""
    found = rows.select("tokens", F.explode("tokens").alias("token")).join(_filed(sets.withColumn("confidence", F.lit(1.0))), "token")
    return found.filter(F.size(F.array_except("rule", "tokens")) == 0).groupBy("rule").agg(F.count("*").alias("n"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule, confidence, support) from rows (url, block): token sets that lead to the label.

    Single tokens are counted. A token with no allowed page needs no company: any larger set is redundant.
    Of tokens that are in exactly the same pages the smallest stands for all. What is left of the blocked
    pages goes to FP-growth, so a page with many query keys does not make a set of every choice of them;
    the allowed pages that hold a set are then counted by the inverted index."""
    tokens_of = tokens(F.col("url"))
    rows = labelled.select(tokens_of.alias("tokens"), F.coalesce("block", F.lit(False)).alias("block")).filter(F.size("tokens") > 0)
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "url-items")
    total, blocked = rows.agg(F.count("*"), F.count_if("block")).first()
    least = max(MIN_COUNT, math.ceil(min_support * total))
    each = rows.select("id", "block", F.explode("tokens").alias("token"))
    same = (F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64(F.lit(1), "id").bitwiseAND(F.lit((1 << 31) - 1))).alias("s"))
    stats = each.groupBy("token").agg(F.count("*").alias("seen"), F.count_if("block").alias("hits"), *same)
    stats = written(stats.filter(F.col("hits") >= least), "url-tokens")
    singles = stats.select(F.array("token").alias("rule"), "hits", "seen")

    company = stats.filter("hits < seen").groupBy("seen", "hits", "x", "s").agg(F.min("token").alias("token")).select("token")
    baskets = each.filter("block").join(company, "token").groupBy("id").agg(F.collect_list("token").alias("items")).filter(F.size("items") > 1)
    baskets = written(baskets.select("items"), "url-baskets")
    n = baskets.count()
    counted = singles
    if n >= least:
        # half a page less, so that rounding does not ask for one more
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(baskets).freqItemsets
        sets = written(sets.filter(F.size("items") > 1).select(F.array_sort("items").alias("rule"), F.col("freq").alias("hits")), "url-sets")
        allowed = _contained(rows.filter(~F.col("block")), sets.select("rule"))
        sets = sets.join(allowed, "rule", "left").select("rule", "hits", (F.col("hits") + F.coalesce("n", F.lit(0))).alias("seen"))
        counted = counted.unionByName(sets)
    q, base = F.col("hits") / F.col("seen"), max(1, blocked) / max(1, total)
    miss = F.col("seen") - F.col("hits")
    beyond = F.col("hits") * F.log(q / base) + F.when(miss > 0, miss * F.log((miss / F.col("seen")) / max(1e-12, 1 - base))).otherwise(0.0)
    rules = counted.filter((q >= min_confidence) & (q > base) & (beyond >= -math.log(MAX_CHANCE)))
    return _without_redundant(written(rules.select("rule", q.alias("confidence"), (F.col("hits") / max(1, total)).alias("support")), "url-rules"))


def _filed(rules: DataFrame) -> DataFrame:
    """``rules`` with ``token``, the one that the fewest rules have."""
    count = rules.select(F.explode("rule").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("rule", "confidence", F.explode("rule").alias("token")).join(count, "token")
    return each.groupBy("rule", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def _without_redundant(rules: DataFrame) -> DataFrame:
    """Drops a rule if a smaller one within its tokens has no less confidence. Rules are brought
    together by the rarest token of the smaller one."""
    small = _filed(rules).select(F.col("rule").alias("less"), F.col("confidence").alias("c"), "token")
    each = rules.select("rule", "confidence", F.explode("rule").alias("token"))
    covered = each.join(small, "token").filter((F.size("less") < F.size("rule")) & (F.size(F.array_except("less", "rule")) == 0)
                                               & (F.col("c") >= F.col("confidence"))).select("rule").distinct()
    return rules.join(covered, "rule", "left_anti")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, fired): distinct URLs with at least one rule all of whose tokens they have, and the
    most confident such rule."""
    each = urls.select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    filed = _filed(rules).withColumn("id", F.concat_ws(" ", "rule"))
    found = each.select("url", "tokens", F.explode("tokens").alias("token")).join(filed, "token")
    found = found.filter(F.size(F.array_except("rule", "tokens")) == 0)
    return found.groupBy("url").agg(F.max(F.struct("confidence", "id")).getField("id").alias("fired"))


def judge(pages: DataFrame, rules: DataFrame, site_rules: list[SiteRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: id, url, host, path, ``rule`` (the curated one that decides), ``fired`` (the
    mined one, if any) and ``verdict``."""
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    d = d.join(matches(d, rules), "url", "left").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    name, verdict = site_rule(site_rules)
    mined = F.when(F.col("fired").isNotNull(), "block").otherwise("allow")
    return d.select("page_id", "url", "host", "path", name.alias("rule"), "fired", F.coalesce(verdict, mined).alias("verdict"))
