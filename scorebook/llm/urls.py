"""URL filter: a list of host and path rules, and gradient-boosted trees on lexical features for all other URLs.

The trees learn from labelled URLs (a given table, or else those that a rule
decides), both classes weighing the same, and judge by length, depth, digit ratio, character entropy, parameter counts and the
statistics of the host's suffixes. The suffix statistics count the whole table:
how many URLs share the last one and last two labels of the host, how deep they
are, and which share of the labelled ones is blocked, drawn towards one half by
PRIOR rows. The fit takes at most TRAIN_ROWS labelled URLs of each class,
those with the smallest hash; the model is a few hundred nodes.

Only DataFrame operations and Spark ML; no Python on the executors.

Defined results: a null URL, or one without `://`, has an empty host and path
and is judged by the trees on what text there is; repeated URLs get equal
verdicts; with labels of one class only that class is the verdict, with none it
is allow; a null id is passed through; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.session import materialized

ALLOW, BLOCK = "allow", "block"
RULES = (
    ("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK),
)
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
PRIOR = 20.0
_URL = r"://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = (
    "n_chars", "host_chars", "path_chars", "query_chars", "depth", "n_labels", "n_params", "n_hyphens", "digit_ratio", "entropy",
)
SUFFIX = ("tld_log_count", "tld_depth", "tld_blocked", "domain_log_count", "domain_depth", "domain_blocked")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does. For rule lists that fit a plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decided in sorted(rules, key=lambda r: len(r[0])):  # the longest is tried first: it is put on last
        of, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decided)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def entropy(text: Column) -> Column:
    """Bits per character of a string."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    different = F.array_sort(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""))
    bits = lambda total, c: total - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(F.lit(0.0))
    return F.coalesce(F.aggregate(different, F.lit(0.0), bits), F.lit(0.0))


def shaped(urls: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Id, host, path, rule, the rule's verdict and the lexical features of every URL."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = urls.select(F.col(id_col).alias("_id"), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    digits = F.length("_url") - F.length(F.translate("_url", "0123456789", ""))
    return parts.select(
        "*", rule.alias("rule"), verdict.alias("decided"),
        F.element_at(F.split("host", r"\."), -1).alias("tld"), F.substring_index("host", ".", -2).alias("domain"),
        F.length("_url").alias("n_chars"), F.length("host").alias("host_chars"), F.length("path").alias("path_chars"),
        F.length(query).alias("query_chars"), _count(F.col("path"), "/").alias("depth"),
        (_count(F.col("host"), ".") + 1).alias("n_labels"),
        F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0).alias("n_params"),
        _count(F.col("_url"), "-").alias("n_hyphens"),
        F.coalesce(digits / F.nullif(F.length("_url"), F.lit(0)), F.lit(0.0)).alias("digit_ratio"),
        entropy(F.col("_url")).alias("entropy"),
    )


def suffix_statistics(rows: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """For the last label and the last two labels of the hosts: URLs, mean depth, labelled URLs and blocked ones."""
    out = {}
    for part in ("tld", "domain"):
        seen = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.avg("depth").alias("_d"))
        known = labels.groupBy(F.col(part).alias("_part")).agg(F.sum("_y").alias("_b"), F.count(F.lit(1)).alias("_k"))
        joined = seen.join(known, seen[part] == known["_part"], "full")
        joined = joined.withColumn(part, F.coalesce(part, "_part")).drop("_part")
        out[part] = materialized(joined.fillna(0, ["_n", "_d", "_b", "_k"]), f"{part}-statistics")
    return out


def with_suffixes(rows: DataFrame, statistics: dict[str, DataFrame], prior: float) -> DataFrame:
    """The rows with the statistics of their host suffixes; shares start from one half, which counts `prior` rows."""
    out = rows
    for part, stats in statistics.items():
        out = out.join(stats, part).select(
            *out.columns, F.log1p("_n").alias(f"{part}_log_count"), F.col("_d").alias(f"{part}_depth"),
            ((F.col("_b") + prior / 2) / (F.col("_k") + prior)).alias(f"{part}_blocked"),
        )
    return out


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*SHAPE, *SUFFIX], outputCol="_features").transform(rows)


def judge(
    urls: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED,
    prior: float = PRIOR,
) -> DataFrame:
    """Per URL: id, host, path, rule, verdict, and the score of the trees (chance of block; null where they have not learned).

    `labelled` holds URLs (`url_col`) with a `verdict`, allow or block.
    """
    rows = materialized(shaped(urls, id_col, url_col, rules), "urls")
    if labelled is None:
        labels = rows.where("decided IS NOT NULL")
    else:
        shapes = shaped(labelled, "verdict", url_col, rules)
        labels = materialized(shapes.withColumn("decided", F.col("_id")).where("decided IS NOT NULL"), "labelled")
    labels = labels.withColumn("_y", (F.col("decided") == BLOCK).cast("double"))
    classes = {r["_y"] for r in labels.select("_y").distinct().collect()}
    if len(classes) < 2:
        only = BLOCK if 1.0 in classes else ALLOW
        return rows.select(
            F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("decided", F.lit(only)).alias("verdict"),
            F.lit(None).cast("double").alias("score"),
        )
    statistics = suffix_statistics(rows, labels)
    order = F.xxhash64(F.lit(seed), "_url")
    # A frequent URL is one row of the sample, with its copies as weight: it can't fill its class.
    shape = [c for c in labels.columns if c not in ("_url", "_y")]
    once = labels.groupBy("_url", "_y").agg(F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in shape])
    some = [once.where(F.col("_y") == y).orderBy(order, "_url").limit(train_rows) for y in (0.0, 1.0)]
    sample = with_suffixes(some[0].unionByName(some[1]), statistics, prior)
    sample = materialized(sample.orderBy(order, "_url").coalesce(1), "url-sample")
    counts = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.sum("_copies").alias("n")).collect()}
    weight = F.when(F.col("_y") == 1.0, 0.5 / counts[1.0]).otherwise(0.5 / counts[0.0]) * sum(counts.values()) * F.col("_copies")
    model = GBTClassifier(
        featuresCol="_features", labelCol="_y", weightCol="_weight", maxIter=trees, maxDepth=depth, seed=seed, checkpointInterval=-1
    ).fit(_assembled(sample).select("_features", "_y", weight.alias("_weight")))
    scored = model.transform(_assembled(with_suffixes(rows, statistics, prior)))
    by_trees = F.when(F.col("score") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("decided", by_trees).alias("verdict"), "score"
    )
