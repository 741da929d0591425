"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule settles.

Features: lengths of url, host and path, path depth, numbers of host labels, of
hyphens and of query parameters, share of digits, longest host label, entropy of
the host's characters, and how often labelled urls with the same last label or
last two labels of the host are to be blocked (smoothed; a training row's own
label does not count for itself). Only DataFrame functions are used. Suffixes
are counted over all different labelled urls and looked up by shuffle, frequent
ones by broadcast; only the trees are trained, by Spark's own library, on a
bounded sample of labelled urls.

Edge cases: a null url, or one without "://", has an empty host and path, fits
no rule and is scored like any other; repeated rows are judged one by one;
without labelled urls every score is 0; columns of the input that carry the name
of a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.llm.names import renamed, set_apart
from stratocast.operators.scale import skew_join
from stratocast.storage import stored

ADDED = ("host", "path", "rule", "score", "verdict")
FEATURES = (
    "_url_length", "_host_length", "_path_length", "_depth", "_labels", "_hyphens", "_parameters",
    "_digits", "_longest", "_entropy", "_rate1", "_rate2",
)
HEAVY = 10_000  # rows from which on a suffix is looked up by broadcast
PRIOR = 5.0  # labelled urls that the overall rate counts for in a suffix's rate

# Fixed words whose presence in a host marks a labelled example to block.
BAD_WORDS = ("adult", "ads-track", "bets", "casino", "pills", "spam")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without a scheme."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one. A rule is (verdict, host + path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, start = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """`urls` with _url, host and path, and the features that need no labels."""
    host, path, url = F.col("host"), F.col("path"), F.coalesce("_url", F.lit(""))
    n = F.greatest(F.length(host), F.lit(1))
    chars = F.array_distinct(F.split(host, ""))
    share = F.transform(chars, lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    longest = F.array_max(F.transform(F.split(host, r"\."), F.length))
    count = lambda column, pattern: F.length(column) - F.length(F.regexp_replace(column, pattern, ""))
    features = {
        "_url_length": F.length(url), "_host_length": F.length(host), "_path_length": F.length(path),
        "_depth": count(path, "/"), "_labels": count(host, r"\."), "_hyphens": count(host, "-"),
        "_parameters": count(url, "[?&]"), "_digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "_longest": longest, "_entropy": entropy,
    }
    return urls.withColumns({k: v.cast("double") for k, v in features.items()})


def suffixed(urls: DataFrame) -> DataFrame:
    """`urls` with the last label and the last two labels of the host."""
    return urls.withColumns({f"_suffix{i}": F.substring_index("host", ".", -i) for i in (1, 2)})


class UrlFilter:
    """Trees and suffix rates learned from labelled urls."""

    def __init__(self, labelled: DataFrame, url: str, label: str, max_rows: int = 20_000, trees: int = 10, depth: int = 3):
        """Count suffixes over all different rows with label 0 or 1; fit on at most `max_rows`, chosen by a hash of the url."""
        host, path = host_and_path(F.col("_url"))
        usable = stored(
            suffixed(
                labelled.select(F.col(url).alias("_url"), F.col(label).cast("double").alias("_label"))
                .where("_label IN (0, 1)")
                .distinct()
                .withColumns({"host": host, "path": path})
            )
        )
        total = usable.agg(F.count(F.lit(1)).alias("n"), F.avg("_label").alias("rate")).first()
        self.rate, self.model = total["rate"] or 0.0, None
        self.suffixes = [
            stored(usable.groupBy(f"_suffix{i}").agg(F.count(F.lit(1)).alias(f"_n{i}"), F.sum("_label").alias(f"_s{i}")))
            for i in (1, 2)
        ]
        if total["n"]:
            # A share of all that falls below the bound, so that the limit has little to sort.
            share = min(1.0, 0.9 * max_rows / total["n"])
            place = F.pmod(F.xxhash64("_url", F.lit(1)), F.lit(1 << 30))
            sample = usable.where(place <= int(share * (1 << 30))).orderBy(place, "_url", "_label").limit(max_rows)
            train = stored(sample)
            rows = self._assembled(lexical(self._rated(train, F.col("_label"))))
            gbt = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1)
            self.model = gbt.fit(rows)

    def _rated(self, urls: DataFrame, own: Column | None = None) -> DataFrame:
        """`urls` with the suffixes' rates; with `own`, the sample's rows, of which each counts without its own label."""
        for i, table in enumerate(self.suffixes, 1):
            suffix = f"_suffix{i}"
            if own is None:
                urls = skew_join(urls, table, suffix, min_rows=HEAVY)
            else:
                met = table.join(F.broadcast(urls.select(suffix).distinct()), suffix, "left_semi")  # max_rows at most
                urls = urls.join(F.broadcast(met), suffix, "left")
            n, s = F.coalesce(f"_n{i}", F.lit(0)), F.coalesce(f"_s{i}", F.lit(0.0))
            if own is not None:
                n, s = n - 1, s - own
            urls = urls.withColumn(f"_rate{i}", (s + PRIOR * self.rate) / (n + PRIOR)).drop(f"_n{i}", f"_s{i}")
        return urls

    def _assembled(self, urls: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(urls)

    def judge(self, pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", threshold: float = 0.5) -> DataFrame:
        """All rows of `pages` with host, path, rule, score (probability of block) and verdict."""
        pages, own = set_apart(pages, "probability", "prediction", "rawPrediction")
        (url,) = renamed(own, url)
        kept = [c for c in pages.columns if c not in ADDED]
        host, path = host_and_path(F.col("_url"))
        rows = pages.select(*kept, F.col(url).alias("_url")).withColumns({"host": host, "path": path})
        rule, decision = rule_for(rules, F.col("host"), F.col("path"))
        rows = rows.withColumns({"rule": rule, "_decision": decision})
        if self.model is None:
            scored = rows.withColumn("score", F.lit(0.0))
        else:
            scored = self.model.transform(self._assembled(lexical(self._rated(suffixed(rows))))).withColumn(
                "score", vector_to_array("probability")[1]
            )
        method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
        return scored.select(*kept, "host", "path", "rule", "score", F.coalesce("_decision", method).alias("verdict")).withColumnsRenamed(own)
