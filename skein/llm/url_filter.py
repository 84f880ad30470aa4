"""Operator 7: URL filter, rules first, then gradient-boosted trees on lexical features.

Rules, and a column of labels where there is one, label URLs. Those that nothing labels count as allowed, with a small
weight: a URL that the rules of its host leave alone is evidence against judging the whole host like them. Both train the
trees, which judge what no rule decides: length, depth, digit ratio, character entropy, parameter counts, and smoothed shares
of blocked URLs by host suffix and by suffix and first directory. A URL's shares leave out its own host's fold, so
no label explains itself. The trees are fitted on a bounded sample; the statistics cover all URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Scratch, small

#: Fixed by the contract.
RULES = {"block": ["net/", "example.com/de/"], "allow": ["example.net/en/", "org/fr/"]}
#: What shares of blocked URLs are counted by.
KEYS = ["last", "last_two", "directory"]
NUMBERS = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "fragment", "secure", *(f"{k}_share" for k in KEYS), "last_two_seen"]
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the
    end. Both empty for null and where there is no ://."""
    ok = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(ok, host).otherwise(""), F.when(ok, path).otherwise("")


def rule_for(host: Column, path: Column, rules: dict[str, list[str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none; equally long ones by code point."""
    found = verdict = None
    for rule, what in sorted(((r, w) for w, rs in rules.items() for r in rs), key=lambda x: (-len(x[0]), x[0])):
        at = rule.find("/")
        name, start = (rule, "") if at < 0 else (rule[:at], rule[at:])
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if found is None else (found, verdict)


def _entropy(text: Column) -> Column:
    """Bits per character, over all characters of the text."""
    n = F.char_length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def features(urls: DataFrame) -> DataFrame:
    """urls (_url, host, path) with the lexical features, the keys of the statistics, and the host's fold."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.char_length(url) - F.char_length(F.translate(url, "0123456789", ""))
    labels = F.split("host", r"\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    return urls.withColumns({
        "url_length": F.char_length(url), "host_length": F.char_length("host"), "path_length": F.char_length("path"),
        "depth": F.char_length("path") - F.char_length(F.replace(F.col("path"), F.lit("/"), F.lit(""))), "labels": F.size(labels),
        "digit_ratio": digits / F.greatest(F.char_length(url), F.lit(1)), "hyphens": F.char_length(url) - F.char_length(F.replace(url, F.lit("-"), F.lit(""))),
        "entropy": _entropy(F.lower(url)), "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.char_length(query),
        "fragment": url.contains("#").cast("int"), "secure": url.startswith("https:").cast("int"),
        "last": F.element_at(labels, -1), "last_two": two, "directory": F.concat(two, F.regexp_extract("path", r"\A/[^/]*", 0)),
        "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"),
    })


class Shares:
    """Smoothed shares of blocked URLs by key, and what each fold contributed to them."""

    def __init__(self, labelled: DataFrame, scratch: Scratch, smoothing: float = 5.0):
        blocked, weight = labelled.agg(F.sum(F.col("blocked") * F.col("weight")), F.sum("weight")).first()
        self.overall, self.smoothing, self.tables = blocked / weight, smoothing, {}
        for k in KEYS:
            sums = [F.sum(F.col("blocked") * F.col("weight")).alias("b"), F.sum("weight").alias("w")]
            folds = scratch.write(labelled.groupBy(F.col(k).alias("k"), F.col("fold").alias("f")).agg(*sums), "fold-shares")
            whole = scratch.write(folds.groupBy("k").agg(F.sum("b").alias("all_b"), F.sum("w").alias("all_w")), "shares")
            self.tables[k] = small(folds), small(whole)

    def add(self, df: DataFrame) -> DataFrame:
        for k, (folds, whole) in self.tables.items():
            joined = df.join(whole, F.col(k) == F.col("k"), "left").drop("k").join(folds, (F.col(k) == F.col("k")) & (F.col("fold") == F.col("f")), "left")
            b, w = (F.coalesce(f"all_{x}", F.lit(0.0)) - F.coalesce(x, F.lit(0.0)) for x in "bw")
            df = joined.withColumns({f"{k}_share": (b + self.overall * self.smoothing) / (w + self.smoothing), f"{k}_seen": F.log1p(F.greatest(w, F.lit(0.0)))}).drop("k", "f", "b", "w", "all_b", "all_w")
        return df


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=NUMBERS, outputCol="features", handleInvalid="keep").transform(df)


def _labelled(table: DataFrame, doubt: float) -> DataFrame:
    """table (ruled: block, allow or null) with blocked and weight."""
    return table.withColumns({"blocked": (F.coalesce("ruled", F.lit("allow")) == "block").cast("double"), "weight": F.when(F.col("ruled").isNull(), doubt).otherwise(1.0)})


def _probability(table: DataFrame, train: DataFrame, doubt: float, sample: int, trees: int, depth: int, seed: int, scratch: Scratch) -> DataFrame:
    """table with p, the probability of a block, learned from train. Both are written tables."""
    labelled = _labelled(train, doubt)
    n, ruled, blocked, allowed = labelled.agg(F.count("*"), F.count("ruled"), F.sum("blocked"), F.sum(1 - F.col("blocked"))).first()
    if not ruled or not blocked or not allowed:
        return table.withColumn("p", F.lit(1.0 if blocked else 0.0))
    shares = Shares(labelled, scratch)
    drawn = F.pmod(F.xxhash64("_id", "_url", F.lit("url sample")), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)) + 1
    training = scratch.write(shares.add(labelled.filter(drawn)).select(*NUMBERS, "blocked", "weight"), "url-sample").coalesce(4)
    model = GBTClassifier(featuresCol="features", labelCol="blocked", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed)
    if training.agg(F.countDistinct("blocked")).first()[0] < 2:
        return table.withColumn("p", F.lit(1.0 if blocked > allowed else 0.0))
    fitted = model.fit(_vectors(training).select("features", "blocked", "weight"))
    return fitted.transform(_vectors(shares.add(table))).withColumn("p", vector_to_array("probability")[1])


def _table(pages: DataFrame, rules: dict[str, list[str]], id_col: str, url_col: str, label_col: str | None, scratch: Scratch) -> DataFrame:
    none = F.lit(None).cast("string")
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), (F.col(label_col) if label_col else none).alias("label"))
    host, path = host_and_path(F.col("_url"))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    label = F.when(F.col("label").isin("block", "allow"), F.col("label"))
    return scratch.write(features(base.withColumns({"rule": rule, "decided": verdict, "ruled": F.coalesce(verdict, label)})).drop("label"), "urls")


def judge(pages: DataFrame, rules: dict[str, list[str]] | None = None, sample: int = 20_000, trees: int = 12, depth: int = 4, threshold: float = 0.5, doubt: float = 0.25, seed: int = 7, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, p_block (the trees' probability; null where a rule decided).

    Null and malformed URLs have empty host and path; no rule fits, and the trees judge what features they have.
    label_col, if given, holds further labels, block or allow (anything else is none); rules go before them. doubt is the
    weight of a URL without label, taken as allowed. If nothing is labelled or nothing blocked, the rest are allowed
    with p_block 0; if all is blocked, so are they, with 1. About `sample` URLs, drawn by a hash, fit the trees. Repeated
    rows each give a row; further columns are ignored. An empty table gives none. The result is a table in the shared folder.
    """
    with Scratch(pages.sparkSession, "urls") as scratch:
        table = _table(pages, RULES if rules is None else rules, id_col, url_col, label_col, scratch)
        out = _probability(table, table, doubt, sample, trees, depth, seed, scratch)
        judged = F.coalesce(F.col("decided"), F.when(F.col("p") >= threshold, "block").otherwise("allow"))
        return scratch.result(out.select(F.col("_id").alias(id_col), "host", "path", "rule", judged.alias("verdict"), F.when(F.col("decided").isNull(), F.col("p")).alias("p_block")))


def held_out_hosts(pages: DataFrame, rules: dict[str, list[str]] | None = None, sample: int = 20_000, trees: int = 12, depth: int = 4, threshold: float = 0.5, doubt: float = 0.25, seed: int = 7, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> dict[str, float]:
    """How the trees judge labelled URLs of hosts that they have not seen: blocked_right and allowed_right, the shares
    judged as labelled. One fold of hosts is held out, of statistics and trees alike."""
    with Scratch(pages.sparkSession, "urls") as scratch:
        table = _table(pages, RULES if rules is None else rules, id_col, url_col, label_col, scratch)
        out = _probability(table.filter("fold = 0"), table.filter("fold <> 0"), doubt, sample, trees, depth, seed, scratch)
        right = F.avg((F.col("p") >= threshold).cast("double"))
        by = {r[0]: r[1] for r in out.filter("ruled is not null").groupBy("ruled").agg(right).collect()}
        return {"blocked_right": by.get("block"), "allowed_right": None if by.get("allow") is None else 1 - by["allow"]}
