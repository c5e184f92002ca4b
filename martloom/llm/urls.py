"""URL filter: fixed rules first, then logistic regression on hashed character n-grams of host and path.

The regression learns from a small table of labelled urls, by default one made from words that name what a corpus should not hold and from
names that say nothing of the kind. Everything is DataFrame functions and Spark's own learner; scoring is one expression per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.common import lower_ascii

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
BUCKETS = 1 << 14
LENGTHS = (2, 3, 4)
MOST_LABELLED = 4000  # urls of each verdict the learner sees at most


# Words of hosts that a corpus should not hold, names of ordinary hosts, and common groups of letters, two of which make a name without meaning.
UNWANTED = (
    "adult", "porn", "xxx", "sex", "nude", "erotic", "escort", "hookup", "webcam", "fetish", "casino", "poker", "betting", "jackpot", "slots", "lottery", "roulette",
    "viagra", "cialis", "pills", "steroids", "warez", "torrent", "keygen", "cracks", "malware", "phishing", "payday",
)
ORDINARY = (
    "news", "garden", "travel", "school", "library", "recipes", "music", "science", "museum", "history", "weather", "sports", "health", "forum", "market", "hotel",
    "river", "mountain", "bakery", "studio", "design", "photo", "press", "city", "coffee", "kitchen", "books", "theatre", "college", "research",
)
GROUPS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "the", "and", "ing", "ent", "ion")
FRONTS, TAILS, DOMAINS = ("", "www.", "blog.", "m."), ("", "-x", "24", "-online"), ("com", "org", "net", "example.org", "site.com")
PATHS = ("/", "/index.html", "/en/17", "/de/2204.html", "/a/b/c", "/fr/9/")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url`` and ``label`` (1 block, 0 allow): about 3,400 made urls, six of seven of them allowed. Domains and paths go with both labels alike."""
    listed = lambda values: F.array(*map(F.lit, values))
    one = spark.range(1)
    bad = one.select(F.explode(listed(UNWANTED)).alias("name"), F.lit(1).alias("label"))
    known = one.select(F.explode(listed(ORDINARY)).alias("name"), F.lit(0).alias("label"))
    pairs = one.select(F.explode(listed(GROUPS)).alias("a")).select("a", F.explode(listed(GROUPS)).alias("b"))
    made = pairs.select(F.concat("a", "b").alias("name"), F.lit(0).alias("label")).distinct()
    wide = bad.union(known).select("name", "label", F.explode(listed(TAILS)).alias("tail")).union(made.select("name", "label", F.lit("").alias("tail")))
    hosts = wide.select("label", F.explode(listed(FRONTS)).alias("front"), F.concat("name", "tail").alias("name"))
    h = F.xxhash64("front", "name")
    pick = lambda values, salt: F.element_at(listed(values), (F.pmod(F.shiftright(h, salt), F.lit(len(values))) + 1).cast("int"))
    return hosts.select(F.concat(F.lit("https://"), "front", "name", F.lit("."), pick(DOMAINS, 3), pick(PATHS, 23)).alias("url"), "label")


def parted(labelled: DataFrame) -> DataFrame:
    """Labelled urls as :func:`train` takes them."""
    return labelled.select(host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path"), F.col("label").alias("__label"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    ours = (host == name) | host.endswith("." + name)
    return ours & path.startswith(slash + rest) if slash else ours


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    fitting = [(fits(rule, host, path), rule, verdict) for rule, verdict in longest]
    if not fitting:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return tuple(F.coalesce(*(F.when(hit[0], F.lit(hit[i])) for hit in fitting)) for i in (1, 2))


def grams(host: Column, path: Column) -> Column:
    """All character n-grams of host and path, each part under its own mark."""

    def part(mark: str, text: Column, n: int) -> Column:
        letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        places = F.when(F.size(letters) >= n, F.sequence(F.lit(1), F.size(letters) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.lit(mark), *(F.element_at(letters, i + k) for k in range(n))))

    return F.concat(*(part(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in LENGTHS))


@dataclass(frozen=True)
class UrlModel:
    """``fitted`` is None where the labels held one verdict only; ``always`` is then the answer."""

    fitted: PipelineModel | None
    always: float

    def scored(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with ``__host``, ``__path``) plus ``__score``, the probability of ``block``."""
        if self.fitted is None:
            return urls.withColumn("__score", F.lit(self.always))
        rows = self.fitted.transform(urls.withColumn("__grams", grams(F.col("__host"), F.col("__path"))))
        score = F.element_at(vector_to_array("__probability"), 2)
        return rows.select(*(F.col(f"`{c}`") for c in urls.columns), score.alias("__score"))


def train(labelled: DataFrame, buckets: int = BUCKETS, most: int = MOST_LABELLED) -> UrlModel:
    """``labelled`` has ``__host``, ``__path`` and ``__label`` (1 block, 0 allow); rows with a null are left out.

    At most ``most`` distinct urls of each label are used, chosen by hash. With one label only, or none, the model
    always answers with that label (none: allow).
    """
    rows = labelled.select("__host", "__path", F.col("__label").cast("double").alias("__label")).dropna().distinct()
    order = [F.xxhash64("__host", "__path"), F.col("__host"), F.col("__path")]
    few = [rows.filter(F.col("__label") == v).orderBy(*order).limit(most) for v in (0.0, 1.0)]
    # One partition of at most twice ``most`` urls, in a fixed order: sums in the learner then come out alike each time.
    sample = few[0].union(few[1]).coalesce(1).withColumn("__grams", grams(F.col("__host"), F.col("__path"))).persist()
    try:
        seen = sorted(r["__label"] for r in sample.select("__label").distinct().collect())
        if len(seen) < 2:
            return UrlModel(None, seen[0] if seen else 0.0)
        steps = [
            HashingTF(numFeatures=buckets, inputCol="__grams", outputCol="__counts"),
            Normalizer(inputCol="__counts", outputCol="__unit"),
            LogisticRegression(
                featuresCol="__unit", labelCol="__label", predictionCol="__predicted", probabilityCol="__probability",
                rawPredictionCol="__raw", regParam=0.001, maxIter=40,
            ),
        ]
        return UrlModel(Pipeline(stages=steps).fit(sample), 0.0)
    finally:
        sample.unpersist()


def judged(pages: DataFrame, rules=RULES, model: UrlModel | None = None, block_at: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule decides).

    Null urls and urls without ``://`` have an empty host and path and are judged by the model. Without a model, one is
    trained on ``labelled`` (``url``, ``label``), by default :func:`labelled_urls`. Of ``pages`` only ``page_id`` and ``url`` are used.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("__host"), path.alias("__path"))
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    parts = parts.withColumns({"__rule": rule, "__verdict": verdict})
    if model is None:
        model = train(parted(labelled_urls(pages.sparkSession) if labelled is None else labelled))
    scored = model.scored(parts)
    own = F.when(F.col("__score") >= block_at, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
        F.coalesce("__verdict", own).alias("verdict"), F.when(F.isnull("__verdict"), F.col("__score")).alias("score"),
    )
