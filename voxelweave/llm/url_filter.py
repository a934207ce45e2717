"""URL filters: host and path rules first, else logistic regression on hashed character n-grams of host and path.

All of it is DataFrame and SQL functions, the fit as well. The labelled table is small (LABELLED, or a table of which at most
``max_labelled`` rows are taken, half of each class at most, by a hash of the url), so the regression is fitted in its dual form: one coefficient for each labelled URL, the kernel
being the share of n-grams that two URLs have in common, by gradient descent inside one ``aggregate`` expression. Weights of n-grams
follow by a group-by over their hash and reach the pages as one array of DIMENSIONS numbers, so scoring is a projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS, SIZES = 8192, (3, 4, 5)
MAX_LABELLED, MAX_RULES = 500, 1000
EPOCHS, RATE, DECAY = 150, 0.5, 0.01

# Names of the small labelled URL table, and the forms in which they take turns.
BLOCKED_NAMES = (
    "casino", "casino-royal", "online-casino", "casino-win", "win-big", "free-bets", "bets", "best-bets", "sports-betting", "poker-room",
    "slots", "jackpot", "ads-track", "ads", "track", "ads-server", "tracker", "adclick", "popup-ads", "spam-farm", "spam", "link-farm",
    "content-farm", "spammy-links", "cheap-pills", "pills", "cheap-meds", "pharmacy-pills", "cheap-viagra", "adult-x", "adult",
    "adult-video", "xxx", "xxx-cams", "porn", "hot-girls", "payday-loans", "quick-loan", "replica-watches", "crack-keygen",
)
ALLOWED_NAMES = (
    "library", "news", "gardens", "history", "weather", "university", "museums", "recipes", "river", "science", "travel", "theatre",
    "music", "mountains", "schools", "health", "cityhall", "forests", "painter", "gardening", "bank", "thenorth", "watchmaker",
    "software", "thorns", "tension", "others", "inland", "ocean", "stations", "nation", "herring", "under", "north", "streams",
    "wiki", "charity", "registers", "notes", "themes", "theses", "houses", "states", "athletes", "birds", "islands", "clouds",
    "teachers", "languages", "churches", "trains", "thread", "rethink", "earth", "method", "shared", "ancient", "stand", "bright", "wonder",
)
FORMS = (
    "http://{}.example.com/", "https://www.{}.example.org/en/1", "http://{}.example.net/de/77", "https://blog.{}.example.com/en/33.html", "http://m.{}.example.org/fr/2?page=2",
    "https://{}.example.com/es/4", "http://www.{}.example.net/en/900/", "http://{}.example.org/de/6#top", "https://m.{}.example.net/fr/512", "http://blog.{}.example.net/es/7",
)
LABELLED = tuple((FORMS[i % len(FORMS)].format(name), label) for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)) for i, name in enumerate(names))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits, else nulls; of equal ones the first counts."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """The distinct hashes, below DIMENSIONS, of the character n-grams of host and path, each marked at both ends."""
    parts = []
    for kind, s in (("h", host), ("p", path)):
        marked = F.concat(F.lit("^"), s, F.lit("$"))
        for n in SIZES:
            parts.append(_hashed(kind, marked, n))
    return F.array_distinct(F.concat(*parts))


def _hashed(kind: str, marked: Column, n: int) -> Column:
    places = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(marked, i, F.lit(n))), F.lit(DIMENSIONS)).cast("int"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label."""
    rows = ", ".join(f"('{url}', {label})" for url, label in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(gram, weight) of a logistic regression on ``labelled`` (url, label 0 or 1); gram -1 is the constant.

    Rows with a null label are left out, equal rows count each. Of each class the ``max_labelled`` // 2 rows of the least hash of their url are fitted (and then by url), so no
    host is preferred and both classes stay. Without rows there are no weights.
    """
    labelled = labelled.filter("label IS NOT NULL").select("url", "label")
    taken = [labelled.filter(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(max_labelled // 2) for y in (0, 1)]
    rows = taken[0].unionByName(taken[1]).select(grams(host_of(F.col("url")), path_of(F.col("url"))).alias("x"), F.col("label").cast("double").alias("y"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("r"))
    # repartition keeps the kernel out of the loop: it would be worked out once an epoch
    common = lambda a, b: F.size(F.array_intersect(a["x"], b["x"])) / F.sqrt(F.size(a["x"]) * F.size(b["x"]).cast("double")) + 1.0
    kernel = one.select("r", F.transform("r", lambda a: F.transform("r", lambda b: common(a, b))).alias("k")).repartition(1)
    start = F.transform("r", lambda _: F.lit(0.0))
    score = lambda row, alpha: F.aggregate(F.zip_with(row, alpha, lambda k, a: k * a), F.lit(0.0), lambda s, v: s + v)

    def step(alpha: Column, _: Column) -> Column:
        error = F.transform("k", lambda row, i: F.get(F.col("r"), i)["y"] - 1 / (1 + F.exp(-score(row, alpha))))
        return F.zip_with(alpha, error, lambda a, e: a * (1 - RATE * DECAY) + RATE * e)

    alpha = kernel.select("r", F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), start, step).alias("alpha"))
    each = alpha.select(F.explode(F.arrays_zip("r", "alpha")).alias("z")).select(F.col("z.r.x").alias("x"), F.col("z.alpha").alias("a")).repartition(1)
    grams_of = each.select(F.explode("x").alias("gram"), (F.col("a") / F.sqrt(F.size("x").cast("double"))).alias("a"))
    return grams_of.unionByName(each.select(F.lit(-1).alias("gram"), "a")).groupBy("gram").agg(F.sum("a").alias("weight"))


def score(host: Column, path: Column, weights: DataFrame) -> Column:
    """Between 0 and 1, higher: likelier to be blocked. ``weights`` has DIMENSIONS + 1 rows at most."""
    by_gram = {r["gram"]: r["weight"] for r in weights.collect()}
    numbers = ",".join(f"{by_gram.get(k, 0.0):.9g}" for k in range(DIMENSIONS))
    table = F.split(F.lit(numbers), ",").cast("array<double>")  # folded into one constant by the optimizer
    found = grams(host, path)
    total = F.aggregate(found, F.lit(0.0), lambda s, g: s + F.get(table, g))
    return 1 / (1 + F.exp(-(F.lit(by_gram.get(-1, 0.0)) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")))))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.8,
               max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    verdict is the longest fitting rule's, else block where score >= threshold (0.8: only what is clearly like the blocked URLs). A null url, or one without ``://``, has an empty host and
    path, fits only rules of an empty host and is scored as such. Null and repeated ids stay as they are, an empty table stays empty,
    other columns are ignored. Nothing is shuffled: rows of a hot host stay where they are.
    """
    spark = pages.sparkSession
    weights = fit(labelled if labelled is not None else labelled_urls(spark), max_labelled)
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = split.select("*", rule.alias("rule"), verdict.alias("ruled"), score(F.col("host"), F.col("path"), weights).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
