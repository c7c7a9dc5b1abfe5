"""URL filter: rules by host and path, and boosted trees on lexical features (native).

Rules label the URLs they fit. From those, gradient-boosted trees learn from what
the URL looks like: lengths, depth, digit ratio, entropy, parameters, and statistics
of the host's suffix (its share of all URLs, and the shrunk share of blocks among the labelled).
A rule's verdict stands; other URLs get the trees' verdict.

Rules are written by host and suffix, so labels of one suffix may all be alike without saying
anything about its other pages. Two things keep the trees from learning just that. A suffix's
share of blocks is taken out of fold: hosts are dealt into FOLDS, and a row sees the labels of
the other folds' hosts only. And in each suffix the labels that are in the majority weigh
less, so that a suffix with labels of one kind hardly weighs at all, and no leaf may stand on
less than LEAF_SHARE of the weight.

The trees are fitted on at most MAX_LABELLED distinct labelled URLs of either label (least hashes first,
copies as weights); statistics of suffixes and all scores cover every row.

Defined results: null URLs and such without ``://`` have empty host and path and no rule, and
are judged as any other; very long URLs are read whole; without labels of both kinds every URL
without a rule is allowed; a score of exactly BLOCK_FROM blocks; of rules of one length the first by name holds;
rows that repeat are judged each; an empty table gives no rows; columns other than
page_id and url play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialize, read_table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Distinct URLs of either label that the trees are fitted on.
MAX_LABELLED = 10_000
FOLDS = 5
#: Labels that a suffix's share of blocks is shrunk by, and its labels' weights.
SHRINK = 10
LEAF_SHARE = 0.05
#: The labels of a suffix that are in the majority weigh so much of the others at most.
BALANCE = 3.0
#: The trees' verdict blocks from this score on. Away from the rules' own suffixes a URL's look
#: tells little (README has the figures), so only high scores do.
BLOCK_FROM = 0.8
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("url_chars", "host_chars", "path_chars", "host_labels", "depth", "digits", "marks", "hyphens", "entropy", "params", "query_chars", "secure", "suffix_share", "suffix_block")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. *rules* is a
    parameter list, checked to be at most 1000 long."""
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules")
    name = verdict = None
    for kind, of, under in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(under)
        name = F.when(fits, of + under) if name is None else name.when(fits, of + under)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character of *text*."""
    n = F.length(text)

    def part(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda total, c: total + part(c))).otherwise(F.lit(0.0))


def _share(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def lexical(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, label (1: block) and the features but the suffix's."""
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return base.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        verdict.alias("ruled"),
        F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"),
        F.xxhash64("url").alias("hash"),
        F.length(url).cast("double").alias("url_chars"),
        F.length(host).cast("double").alias("host_chars"),
        F.length(path).cast("double").alias("path_chars"),
        F.size(F.split(host, r"\.")).cast("double").alias("host_labels"),
        (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double").alias("depth"),
        _share(url, "[0-9]").alias("digits"),
        _share(url, r"[^A-Za-z0-9/.:]").alias("marks"),
        (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("params"),
        F.length(query).cast("double").alias("query_chars"),
        url.startswith("https:").cast("double").alias("secure"),
    )


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """(cell, n, suffix_share, suffix_block, weight_block, weight_allow) for each suffix and fold of
    hosts: its share of all rows, the shrunk share of blocks among the labels of the other
    folds, and the weights of its labels."""
    blocked = (F.col("ruled") == "block").cast("long")
    per = rows.groupBy("cell", "suffix").agg(F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.coalesce(F.sum(blocked), F.lit(0)).alias("blocked"))
    per = materialize(per, "url-cells")
    n, labelled, blocks = per.agg(F.sum("n"), F.sum("labelled"), F.sum("blocked")).first()
    mean = blocks / labelled if labelled else 0.0
    names = ("n", "labelled", "blocked")
    suffixes = per.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    joined = per.join(suffixes, "suffix")  # FOLDS rows for each suffix at most
    block, allow = F.col("all_blocked") + SHRINK, F.col("all_labelled") - F.col("all_blocked") + SHRINK
    return joined.select(
        "cell",
        "n",
        (F.col("all_n") / F.lit(float(n or 1))).alias("suffix_share"),
        ((F.col("all_blocked") - F.col("blocked") + SHRINK * mean) / (F.col("all_labelled") - F.col("labelled") + SHRINK)).alias("suffix_block"),
        F.least(F.lit(1.0), BALANCE * allow / block).alias("weight_block"),
        F.least(F.lit(1.0), BALANCE * block / allow).alias("weight_allow"),
    )


def labelled_urls(shaped: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(features, label, weight) of at most *most* distinct URLs of either label."""
    weight = F.when(F.col("learn") == "block", F.col("weight_block")).otherwise(F.col("weight_allow"))
    known = shaped.where("learn IS NOT NULL").withColumn("weight", weight)
    urls = known.groupBy("learn", "hash").agg(F.first("features").alias("features"), F.sum("weight").alias("weight"))
    chosen = [urls.where(F.col("learn") == kind).orderBy("hash").limit(most) for kind in ("block", "allow")]
    return chosen[0].unionByName(chosen[1]).select("features", (F.col("learn") == "block").cast("double").alias("label"), "weight")


def judge_urls(pages: DataFrame, rules=RULES, trees: int = 12, depth: int = 3, leave_out: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score, fold) for every row of *pages*. With
    *leave_out* nothing is learned from the labels of that fold of hosts."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = materialize(lexical(pages, rules).withColumn("cell", F.concat_ws(" ", "fold", "suffix")), "url-rows")
    learn = F.col("ruled") if leave_out is None else F.when(F.col("fold") != leave_out, F.col("ruled"))
    table = materialize(suffix_statistics(rows.withColumn("ruled", learn)), "url-suffixes")
    full = join_by_key(rows, table, "cell", "n").withColumn("learn", learn)
    shaped = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)
    sample = materialize(labelled_urls(shaped), "url-sample")
    kinds = sample.select("label").distinct().count()
    if kinds < 2:
        scored = shaped.withColumn("block_score", F.lit(0.0))
    else:
        trained = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, stepSize=0.3, weightCol="weight", minWeightFractionPerNode=LEAF_SHARE).fit(sample)
        # The model's probability vector is unpacked by a built-in JVM function.
        scored = trained.transform(shaped).withColumn("block_score", F.get(vector_to_array("probability"), F.lit(1)))
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= BLOCK_FROM, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score", "fold")


def op4_url_trees(spark, sf_dir):
    return judge_urls(read_table(spark, sf_dir, "pages"))
