"""Operator 10: URL filter by rules, and by gradient-boosted trees where no rule fits.

The trees see lexical features alone (lengths, depth, digit ratio, entropy, parameters, suffix statistics)
and are trained on the URLs that the rules label. Everything is DataFrame functions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash, shared_dir, stored
from .html_text import host_of

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled URLs that the trees are fitted on, at most.
FITTED = 20_000
TREES, DEPTH = 10, 4
#: Parts that URLs are dealt to; the statistics of a URL's suffix and site are those of the other parts.
FOLDS = 5
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "vowels", "entropy", "parameters", "query_length", "fragment", "secure", "dotted_end")
SUFFIX = ("suffix_urls", "suffix_blocked", "suffix_allowed", "site_urls", "site_blocked", "site_allowed")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        choice = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path) with the lexical features, as doubles."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c == "", 0.0).otherwise((F.length(url) - F.length(F.replace(url, c))) / n))
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    values = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": _count(path, "/"),
        "labels": _count(host, r"\."), "digits": _count(url, "[0-9]") / n, "host_digits": _count(host, "[0-9]"), "hyphens": _count(host, "-"),
        "vowels": _count(host, "[aeiou]") / F.greatest(F.length(host), F.lit(1)), "entropy": entropy, "parameters": _count(query, "="), "query_length": F.length(query),
        "fragment": F.contains(url, F.lit("#")), "secure": F.startswith(F.lower(url), F.lit("https:")), "dotted_end": F.regexp_like(path, F.lit(r"\.[a-z]+$")),
    }
    return rows.withColumns({k: v.cast("double") for k, v in values.items()})


def fold_of(url: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit("")), F.lit("fold")), F.lit(folds)).cast("int")


def with_suffix_statistics(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``rows`` (url, host, verdict of the rule or null) with counts of the host's last label and last two labels.

    Counts and shares (how many the rules block, how many they allow) are of the URLs with that suffix in the
    other ``folds``: no URL's own verdict, nor that of one equal to it, is among what it is judged by.
    """
    blocked, allowed = (F.coalesce((F.col("verdict") == v).cast("int"), F.lit(0)) for v in ("block", "allow"))
    keys = {"suffix": F.substring_index("host", ".", -1), "site": F.substring_index("host", ".", -2)}
    keyed = rows.withColumn("__fold", fold_of(F.col("url"), folds))
    rows = keyed
    for kind, key in keys.items():
        of = lambda value: [F.sum(value)] + [F.sum(F.when(F.col("__fold") == k, value).otherwise(0)) for k in range(folds)]
        stats = keyed.groupBy(key.alias(f"__{kind}")).agg(*[c.alias(f"__{name}{i}") for name, value in (("n", F.lit(1)), ("b", blocked), ("a", allowed)) for i, c in enumerate(of(value))])
        others = lambda name: F.array(*[F.col(f"__{name}0") - F.col(f"__{name}{k + 1}") for k in range(folds)]).alias(f"__{name}")
        # One row a suffix or site, of any number: Spark broadcasts the table by its size or splits the hot keys' rows.
        rows = rows.withColumn(f"__{kind}", key).join(stored(stats.select(f"__{kind}", others("n"), others("b"), others("a")), f"url_{kind}"), f"__{kind}").drop(f"__{kind}")
        n, b, a = (F.col(f"__{name}")[F.col("__fold")] for name in "nba")
        share = lambda x, n=n: F.coalesce(x / F.nullif(n, F.lit(0)), F.lit(0.0))
        rows = rows.withColumns({f"{kind}_urls": F.log1p(n), f"{kind}_blocked": share(b), f"{kind}_allowed": share(a)}).drop("__n", "__b", "__a")
    return rows.drop("__fold")


def fitted_trees(sample: DataFrame):
    """Gradient-boosted trees on ``sample`` (features, label), or None where it has not both labels."""
    kinds = sample.agg(F.min("label"), F.max("label")).first()
    return None if kinds[0] == kinds[1] else GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(sample)


def described(pages: DataFrame, id_col: str, url_col: str, rules=RULES) -> DataFrame:
    """(id, url, host, path, rule, verdict, features) of every row of ``pages``, from a stored table.

    A null url, or one without ``://``, has an empty host and path. Rows that repeat are described each; empty in, empty out.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", "fit.rule", "fit.verdict")
    rows = stored(with_features(with_suffix_statistics(rows)), "url_features")
    return VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features", handleInvalid="keep").transform(rows)


def labelled(rows: DataFrame) -> DataFrame:
    return rows.where("verdict is not null").select("url", (F.col("verdict") == "block").cast("double").alias("label"), "features")


def held_out_accuracy(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, fitted: int = FITTED) -> tuple[int, float, float]:
    """(URLs, share judged as their rule does, share of the more frequent verdict) of the labelled URLs of one fold, by trees fitted on the others.

    Null URLs have no rule and are not among them, rows that repeat count each. Where no tree can be fitted none is judged right;
    of an empty table (0, 0.0, 1.0).
    """
    rows = labelled(described(pages, id_col, url_col, rules))
    aside = fold_of(F.col("url")) == 0
    model = fitted_trees(stored(sample_by_hash(rows.where(~aside), "url", fitted).select("features", "label"), "url_sample"))
    judged = (rows.where(aside) if model is None else model.transform(rows.where(aside))).withColumn("right", F.lit(0.0) if model is None else (F.col("prediction") == F.col("label")).cast("double"))
    n, right, blocked = judged.agg(F.count("*"), F.avg("right"), F.avg("label")).first()
    return n, right or 0.0, max(blocked or 0.0, 1 - (blocked or 0.0))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, fitted: int = FITTED) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of ``pages``.

    ``rule`` is the longest rule that fits, written as host and path, else null; ``verdict`` is the
    rule's, else that of the trees (block from a probability of one half). ``score``: the trees'
    probability of block. A null url, or one without ``://``, has an empty host and path, which no rule
    fits. Where the rules do not label URLs both ways the trees cannot be fitted: then all others are
    allowed, with a null score. Rows that repeat are judged each; other columns are ignored.
    """
    shared_dir(pages.sparkSession)
    rows = described(pages, id_col, url_col, rules)
    model = fitted_trees(stored(sample_by_hash(labelled(rows), "url", fitted).select("features", "label"), "url_sample"))
    if model is None:
        scored = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
