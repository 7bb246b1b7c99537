"""URL filters: domain rules first, gradient-boosted trees over lexical features for the rest.

A rule (verdict, host/path) fits its host and all subdomains where the URL's path starts with the rule's; the longest fitting rule wins.
The URLs that rules decide are the labelled URLs from which MLlib's boosted trees learn: lengths, depth, shares of digits and hyphens,
character entropy, parameters, and suffix statistics: the lengths of the host's last label and of its last two, and the shares of blocked URLs among those
with the same ending, where URLs that no rule decides count as half blocked, so that an ending of a few rules does not decide by itself. All endings
are counted, in a table that is joined to the URLs (broadcast if it is small). A labelled URL sees the shares of the other FOLDS - 1 parts of the labelled URLs only,
so no share holds the label that it helps to tell. Both verdicts have the same weight. The trees see at most MAX_TRAIN_ROWS distinct labelled URLs, picked by
hash. Every URL is judged. All work is done by Spark SQL and MLlib in the JVM; only counts by ending are shuffled, and URLs where the table of endings is
large. `held_out` measures the trees on labelled URLs that they did not see.

Defined results: a null URL or one without `://` has an empty host and path and fits no rule; without labelled URLs of both verdicts the
method allows; repeated rows each get their verdict; URLs of any length are read whole; other columns are kept, but one with the result's own name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import MAX_TRAIN_ROWS, bounded_sample, materialise, read, unused

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Parts of the labelled URLs, by hash, whose own labels are left out of the shares that they see.
FOLDS = 5
#: Rows of the table of endings (some 100 bytes each) up to which it is broadcast.
BROADCAST_ENDINGS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null without it."""
    return F.when(F.instr(url, "://") > 0, F.split(url, "://", 2)[1])


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits: the first of them, longest first; null: none. The rule list is a parameter of bounded length."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        out = F.when(((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest), rule).otherwise(out)
    return out


def entropy(s: Column) -> Column:
    """Bits per character."""
    share = lambda c: (F.length(s) - F.length(F.replace(s, c))) / F.length(s)
    chars = F.array_distinct(F.split(s, ""))
    return F.coalesce(-F.aggregate(F.filter(chars, lambda c: F.length(c) > 0), F.lit(0.0), lambda t, c: t + share(c) * F.log2(share(c))), F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """Features of the address alone."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda s, pattern: F.regexp_count(s, F.lit(pattern)).cast("double")
    size = F.greatest(F.length(u), F.lit(1))
    return [
        F.length(u).cast("double"),
        F.length(host).cast("double"),
        F.length(path).cast("double"),
        count(path, "/[^/]"),
        count(host, r"\."),
        count(u, "[0-9]") / size,
        count(u, "-") / size,
        count(host, "-"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        (F.instr(u, "#") > 0).cast("double"),
        u.startswith("https:").cast("double"),
        path.endswith("/").cast("double"),
        entropy(u),
        entropy(host),
    ]


def endings(host: Column) -> Column:
    """The host's last label and its last two, told apart by a mark."""
    return F.array(F.concat(F.lit("1:"), F.substring_index(host, ".", -1)), F.concat(F.lit("2:"), F.substring_index(host, ".", -2)))


def part_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


@dataclass
class Filter:
    """The rules, the trees (None: no labelled URLs of both kinds), and by ending the counts of URLs, labelled and blocked ones of each part."""

    rules: tuple[tuple[str, str], ...]
    model: GBTClassificationModel | None
    counts: DataFrame | None = None
    weights: tuple[float, float] = (0.5, 0.5)

    def vectors(self, rows: DataFrame, url: str, into: str) -> DataFrame:
        """The rows with `into`, their vectors."""
        names = [unused(rows, f"_url_{c}") for c in ("e1", "e2", "s1", "s2")]
        host, path, label = host_of(F.col(url)), path_of(F.col(url)), blocked(F.col(url), self.rules)
        out = rows.withColumns({names[i]: endings(host)[i] for i in (0, 1)})
        for i in (0, 1):
            if self.counts is not None:
                c = self.counts.select(F.col("ending").alias(f"{names[i]}_of"), F.struct("n", "known", "blocked").alias(names[2 + i]))
                out = out.join(c, F.col(names[i]) == F.col(f"{names[i]}_of"), "left").drop(f"{names[i]}_of")
            else:
                out = out.withColumn(names[2 + i], F.lit(None).cast("struct<n:bigint,known:array<bigint>,blocked:array<bigint>>"))
        own = F.when(label.isNotNull(), part_of(F.col(url)))

        def share(c: str) -> Column:
            """Blocked URLs of the ending, without the URL's own part if it is labelled."""
            others = lambda x: F.aggregate(F.transform(F.col(f"{c}.{x}"), lambda v, i: F.when(i == own, 0).otherwise(v)), F.lit(0).cast("long"), lambda t, v: t + v)
            known, block, open_ = others("known"), others("blocked"), F.col(f"{c}.n") - F.aggregate(F.col(f"{c}.known"), F.lit(0).cast("long"), lambda t, v: t + v) + 4
            w1, w0 = self.weights
            return F.coalesce((block * w1 + open_ * 0.5) / (block * w1 + (known - block) * w0 + open_), F.lit(0.5))

        statistics = F.array(*(F.length(names[i]).cast("double") for i in (0, 1)), *(share(c) for c in names[2:]))
        return out.withColumn(into, array_to_vector(F.concat(F.array(*lexical(F.col(url), host, path)), statistics))).drop(*names)

    def score(self, rows: DataFrame, url: str, into: str) -> DataFrame:
        """The rows with `into`, the trees' probability of a block."""
        if self.model is None:
            return rows.withColumn(into, F.lit(0.0))
        names = [unused(rows, f"_url_{c}") for c in ("features", "raw", "probability", "prediction")]
        model = self.model.copy()
        model.setFeaturesCol(names[0]).setPredictionCol(names[3])
        model.setRawPredictionCol(names[1]).setProbabilityCol(names[2])
        rows = model.transform(self.vectors(rows, url, names[0]))
        return rows.withColumn(into, vector_to_array(names[2])[1]).drop(*names)


def blocked(url: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """1: a rule blocks the URL, 0: a rule allows it, null: no rule fits."""
    verdicts = F.create_map(*(F.lit(x) for verdict, rule in rules for x in (rule, int(verdict == "block"))))
    return verdicts[rule_of(host_of(url), path_of(url), rules)]


def fit(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, *, url: str = "url", most: int = MAX_TRAIN_ROWS, suffixes: bool = True) -> Filter:
    """The trees, learned from the URLs that the rules decide; suffixes: whether they see suffix statistics."""
    urls = pages.select(F.col(url).alias("url"))
    label = blocked(F.col("url"), rules)
    total = urls.agg(F.coalesce(F.sum(label), F.lit(0)), F.count(label)).first()
    if not total[1] or total[0] in (0, total[1]):
        return Filter(rules, None)
    prior = total[0] / total[1]
    # both verdicts weigh the same: how many URLs the rules happen to block says nothing about the others
    out = Filter(rules, None, weights=(0.5 / prior, 0.5 / (1 - prior)))
    if suffixes:
        each = urls.select(F.explode(endings(host_of(F.col("url")))).alias("ending"), label.alias("label"), part_of(F.col("url")).alias("part"))
        of_part = lambda f: F.array(*(f(F.col("part") == k) for k in range(FOLDS)))
        counts = each.groupBy("ending").agg(F.count("*").alias("n"), of_part(lambda p: F.count(F.when(p, F.col("label")))).alias("known"), of_part(lambda p: F.coalesce(F.sum(F.when(p, F.col("label")).cast("long")), F.lit(0).cast("long"))).alias("blocked"))
        counts = materialise(counts, "url-endings")
        out.counts = F.broadcast(counts) if counts.count() <= BROADCAST_ENDINGS else counts
    known = bounded_sample(urls.where(label.isNotNull()), "url", most)
    known = materialise(out.vectors(known, "url", "_vector").select(label.alias("label"), "_vector").coalesce(1), "url-train").coalesce(1)
    if known.agg(F.countDistinct("label")).first()[0] == 2:
        known = known.withColumn("_weight", F.when(F.col("label") == 1, out.weights[0]).otherwise(out.weights[1]))
        out.model = GBTClassifier(featuresCol="_vector", labelCol="label", weightCol="_weight", maxIter=15, maxDepth=4, stepSize=0.2, seed=11).fit(known)
    return out


def held_out(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, *, url: str = "url", suffixes: bool = True) -> float:
    """Mean of both verdicts' shares of right ones, by the trees, on the fifth of the labelled URLs (by hash) that they did not see; 0.5 is chance."""
    aside = F.pmod(F.xxhash64(url), F.lit(5)) == 0
    trained = fit(pages.where(~aside), rules, url=url, suffixes=suffixes)
    label = blocked(F.col(url), rules)
    rows = trained.score(pages.where(aside & label.isNotNull()).select(url, label.alias("_label")), url, "_score")
    right = ((F.col("_score") >= 0.5).cast("int") == F.col("_label")).cast("double")
    shares = [x for x in rows.agg(*(F.avg(F.when(F.col("_label") == k, right)) for k in (0, 1))).first() if x is not None]
    return sum(shares) / len(shares) if shares else 0.5


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, *, url: str = "url", most: int = MAX_TRAIN_ROWS, into: str = "filtered") -> DataFrame:
    """The rows with `into` = struct(host, path, rule, verdict, score)."""
    trained = fit(pages, rules, url=url, most=most)
    score = unused(pages, "_url_score")
    rows = trained.score(pages, url, score)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    verdicts = F.create_map(*(F.lit(x) for verdict, rule in rules for x in (rule, verdict)))
    rule = rule_of(host, path, rules)
    verdict = F.coalesce(verdicts[rule], F.when(F.col(score) >= 0.5, "block").otherwise("allow"))
    whole = F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"), F.col(score).alias("score"))
    return rows.withColumn(into, whole).drop(score)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.select("page_id", "filtered.host", "filtered.path", "filtered.rule", "filtered.verdict", "filtered.score")


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE: dict[str, str] = {}
