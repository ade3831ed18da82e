"""URL filters: given allow and block rules, and token combinations mined from labels by FP-growth."""

from __future__ import annotations

import functools

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_checked, written
from edgeloom.llm.decontaminate import LOWER, UPPER

#: Share of the labelled pages that a mined combination has at least, and pages in number.
SUPPORT = 0.001
LEAST_PAGES = 5
#: Share of the pages with the combination that are labelled as unwanted, at least.
CONFIDENCE = 0.6
#: Items of a combination at most: what a rule is. Parameter width of mine.
WIDTH = 4
#: Items of a page up to which FP-growth mines it, as that takes time by the power set; wider pages are mined level by level.
BASKET = 10


def host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, with A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, the host and its domains, path segments (numbers as one token, with their
    ending), and keys of its query."""
    url = F.coalesce(url, F.lit(""))
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    hosts = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, n), "."))), lambda x: x != "host=")
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    parts = F.transform(segments, lambda x: F.concat(F.lit("path="), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query="), x))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "^([A-Za-z0-9+.-]*)://", 1)))
    mark = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(scheme, hosts, parts, keys, mark))


def mine(pages: DataFrame, unwanted: DataFrame, page_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE, width: int = WIDTH) -> DataFrame:
    """(rule long, tokens array, size, confidence, lift, support): combinations of URL tokens that mark unwanted pages.

    unwanted: (page_col, unwanted boolean), the labelled pages. Combinations of up to width tokens that occur in as many
    unwanted pages as support of all labelled ones, and in LEAST_PAGES, are rules if they imply the label with the
    confidence asked for, and more often than pages at large. A rule goes if one with fewer of its tokens is as
    confident. The support is a share of the pages, so rules don't grow in number with them. Without labels there are
    none; null urls, null labels and labels of unknown pages are left out.

    Tokens that occur in the very same pages, as those of a repeated long URL do, are one item; an item below the
    support goes. Combinations are sought in the unwanted pages alone: FP-growth mines those of up to BASKET items, and
    wider ones are mined level by level. Each takes what reaches the same share of its own pages, which all that reach it in
    both together do in one of them at least. What is told of a rule is counted over all labelled pages.
    """
    label = unwanted.where("unwanted is not null").select(F.col(page_col).alias("page"), "unwanted")
    known = pages.where(F.col(url_col).isNotNull()).select(F.col(page_col).alias("page"), tokens(F.col(url_col)).alias("t")).join(label, "page")
    known = written(known.select(F.monotonically_increasing_id().alias("row"), "t", "unwanted"), "labelled")
    n, bad = known.agg(F.count("*"), F.count_if("unwanted")).first()
    least = max(support * n, LEAST_PAGES)
    if bad < least:
        return pages.sparkSession.sql("select 0L as rule, array('') as tokens, 0 as size, 0D as confidence, 0D as lift, 0D as support where false")
    each = known.select("row", "unwanted", F.explode("t").alias("token"))
    where = [F.count("*").alias("c"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("x")]
    frequent = each.groupBy("token").agg(*where, F.count_if("unwanted").alias("b")).where(F.col("b") >= least)
    items = written(frequent.groupBy("c", "s", "x").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("of")), "items")
    # of tokens in support of the pages there are a bounded number: a page's tokens over the support
    known_items = broadcast_checked(items.select(F.col("item").alias("token"), "c"))
    # rarer items first, so that a combination's first one says in the fewest pages that it may be there
    ordered = F.array_sort(F.collect_list(F.struct("c", "token")))["token"].alias("items")
    baskets = written(each.where("unwanted").join(known_items, "token").groupBy("row").agg(ordered), "baskets")
    share = (1 - 1e-9) * least / bad  # a little less, as its product with a count is rounded
    narrow = FPGrowth(itemsCol="items", minSupport=share).fit(baskets.where(F.size("items") <= BASKET)).freqItemsets
    narrow = narrow.where(F.size("items") <= width).select(F.array_sort("items").alias("items"))
    counted = [_counted(known, items, narrow)]
    counted += _levels(known, items, baskets.where(F.size("items") > BASKET), share, width)
    found = functools.reduce(DataFrame.union, counted).distinct()
    found = found.where((F.col("b") >= least) & (F.col("b") >= confidence * F.col("c")) & (F.col("b") * n > F.col("c") * bad))
    rules = found.select(F.col("items").alias("tokens"), F.size("items").alias("size"), (F.col("b") / F.col("c")).alias("confidence"), (F.col("b") * n / F.col("c") / bad).alias("lift"), (F.col("b") / n).alias("support"))
    rules = written(rules, "rules")
    # a wider rule meets narrower ones by the subsets of its few tokens
    index = rules.select("tokens", "size", "confidence", F.explode(_subsets("tokens", width)).alias("part"))
    better = index.where("size(part) < size").join(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c")), "part").where("c >= confidence").select("tokens").distinct()
    kept = rules.join(better, "tokens", "left_anti")
    whole = kept.select("tokens", "confidence", "lift", "support", F.explode("tokens").alias("item")).join(items.select("item", "of"), "item")
    whole = whole.groupBy("tokens", "confidence", "lift", "support").agg(F.array_sort(F.flatten(F.collect_list("of"))).alias("all"))
    return written(whole.select(F.xxhash64("all").alias("rule"), F.col("all").alias("tokens"), F.size("all").alias("size"), "confidence", "lift", "support"), "kept")


def _counted(known: DataFrame, items: DataFrame, sets: DataFrame) -> DataFrame:
    """(items, c, b), written: of each set the labelled pages that have all of it, and the unwanted ones among them. A page meets
    a set by the set's rarest item, and no page is shuffled."""
    each = sets.select("items", F.explode("items").alias("item")).join(items.select("item", "c"), "item")
    index = broadcast_checked(written(each.groupBy("items").agg(F.min_by("item", F.struct("c", "item")).alias("token")), "sets"))
    met = known.select("t", "unwanted", F.explode("t").alias("token")).join(index, "token").where(F.size(F.array_except("items", "t")) == 0)
    return written(met.groupBy("items").agg(F.count("*").alias("c"), F.count_if("unwanted").alias("b")), "counted")


def _levels(known: DataFrame, items: DataFrame, baskets: DataFrame, share: float, width: int) -> list[DataFrame]:
    """_counted for all sets of up to width items in share of the baskets: a level's sets are those of the level before and one more
    item of the same page. A set that no wanted page has is not extended: it is as confident as can be."""
    least = share * baskets.count()
    if not least:
        return []
    found = []
    sets = baskets.select("row", "items", F.posexplode("items").alias("at", "item")).select("row", F.array("item").alias("set"), F.expr("slice(items, at + 2, size(items))").alias("rest"))
    while True:
        frequent = sets.groupBy(F.array_sort("set").alias("items")).agg(F.count("*").alias("k")).where(F.col("k") >= least).select("items")
        found.append(_counted(known, items, frequent))
        width -= 1
        open_ = found[-1].where("c > b").select("items")
        if not width or open_.isEmpty():
            return found
        live = sets.withColumn("items", F.array_sort("set")).join(open_, "items", "left_semi")
        sets = written(live.select("row", "set", "rest", F.posexplode("rest").alias("at", "item")).select("row", F.concat("set", F.array("item")).alias("set"), F.expr("slice(rest, at + 2, size(rest))").alias("rest")), "level")


def _subsets(c: str, width: int) -> Column:
    """The non-empty subsets of a sorted array of width elements at most."""
    return F.expr(f"filter(array_distinct(transform(sequence(1, {(1 << width) - 1}), m -> filter({c}, (x, i) -> pmod(shiftright(m, i), 2) = 1))), s -> size(s) > 0)")


def matched(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, rule, confidence): for each distinct url that has all tokens of a rule, the most confident rule; ties go
    to the wider one, then to the smaller number. By an inverted index from tokens to rules."""
    index = rules.select("rule", "size", "confidence", F.explode("tokens").alias("token"))
    index = broadcast_checked(written(index, "index"))
    each = urls.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url")).distinct().select("url", F.explode(tokens(F.col("url"))).alias("token"))
    full = each.join(index, "token").groupBy("url", "rule", "size", "confidence").agg(F.count("*").alias("n")).where("n = size")
    best = full.groupBy("url").agg(F.max(F.struct("confidence", "size", -F.col("rule"), "rule")).alias("best"))
    return best.select("url", "best.rule", "best.confidence")


def given_rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) for host h and path p, by rules ("host/path", "allow" or "block"): a rule fits its host and all
    subdomains, if the path starts with the rule's; the longest wins, then the first by text. Null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, slash, rest = text.partition("/")
        name = name.translate(str.maketrans(UPPER, LOWER))
        fits = ((h == name) | F.endswith(h, F.lit("." + name))) & F.startswith(p, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, unwanted: DataFrame, rules: list[tuple[str, str]], page_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page, host, path, rule, verdict, mined, confidence) for every row of pages: the given rule that fits and its
    verdict, else block where a mined combination matches, else allow; mined: that combination's number, if any.

    Null urls have an empty host and path, and are allowed. Repeated rows stay repeated; other columns are ignored.
    """
    found = matched(pages, mine(pages, unwanted, page_col, url_col), url_col).withColumnsRenamed({"url": "__url", "rule": "mined"})
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(page_col).alias("page"), F.col(url_col).alias("url"))
    rows = rows.select("page", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("given"))
    both = rows.join(found, F.col("url") == F.col("__url"), "left")
    return both.select(F.col("page").alias(page_col), "host", "path", "rule", F.coalesce("given", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined", "confidence")
