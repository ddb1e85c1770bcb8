"""URL filter: allow and block rules, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame functions and Spark's own ML stages on the JVM.  The regression is trained from a
small labelled table of urls (a parameter; ``labelled_urls`` gives the one in use); scoring looks
the n-grams' weights up in one literal array, so a page costs no shuffle and no join.

Rules: a rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's
path; of the rules that fit the longest decides.  Rules are a short list, a parameter.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the
regression's intercept and the grams of emptiness; repeated rows are judged alike; null page_ids are
carried; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import table
from sifter.llm.decontaminate import ascii_lower

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DIMS = 1 << 12             # gram buckets, by XXH64
SIZES = (3, 4)

# The small labelled table, written for this filter; none of its hosts is taken from the tables it is used on.
# Unwanted hosts sell, bet, lend, spam, track or show adult matter; the others publish, teach, make or inform, some with alike names.
BLOCKED_HOSTS = (
    "grand-casino", "casino-royal", "online-casino24", "poker-stars-win", "bigwin-slots", "slot-machine-win", "lucky-jackpot", "jackpot-king", "roulette-bonus",
    "bet-master", "sportbets-now", "bets4you", "live-betting", "football-bets", "free-bonus-bet", "win-big-money", "free-spins-win", "lotto-win",
    "adult-chat", "xxx-videos", "hot-adult-cams", "adultdates", "porn-tube", "sexy-cams", "x-rated-movies", "nude-cams", "adult-xtra",
    "pills-online", "cheap-viagra", "discount-pills", "pills4less", "cheap-meds", "no-rx-pharmacy", "diet-pills-now", "cheapest-drugs", "weight-loss-pills",
    "payday-loans", "fast-cash-loan", "quick-credit", "credit-now", "easy-payday", "cash-advance", "free-crypto-cash", "double-your-bitcoin",
    "spam-mailer", "bulk-spam", "link-farm", "seo-linkfarm", "content-farm", "traffic-bot", "buy-followers", "cheap-clicks", "free-downloads-crack",
    "ad-tracker", "ads-server", "adserve", "trackpixel", "click-track", "popup-ads", "track-clicks", "banner-ads", "free-iphone-prize",
)
ALLOWED_HOSTS = (
    "better-living", "homes-and-gardens", "alphabet-school", "tibet-travel", "diabetes-help", "trackside-athletics", "fieldhockey", "running-track-club", "track-records-music",
    "family-farm", "farmers-market", "windfarm", "adult-education", "adulted-college", "adelaide-news", "addresses", "adsorption-lab", "loading-docks",
    "credit-union-history", "accreditation", "pharmacy-school", "pillsbury-library", "pillow-talk-books", "cashmere-knits", "cashew-recipes", "winter-sports", "windows-help",
    "wine-growers", "twinning-towns", "freedom-press", "freelance-writers", "cheapside-museum", "cheddar-cheese", "spanish-lessons", "space-news", "spandrel-architecture",
    "weather", "research", "library", "garden", "wikipages", "history-today", "school-news", "city-council", "museum", "chess-club", "music-lessons", "poetry-review",
    "mathematics", "translation", "theology", "thirteen", "nationtheatre", "thousand-oaks", "therapist-guide", "inthe-north", "tionville", "other-worlds", "rather-good-bread",
    "weathering", "thread-and-needle",
)
WAYS = ("https://{}.example.com/en/1", "http://www.{}.example.net/de/20?page=2", "https://m.{}.example.org/fr/303.html", "http://blog.{}.example.com/es/4/#top")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for urls to block; every host in each of the ways an address is written."""
    hosts = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(y).alias("label")) for hs, y in ((BLOCKED_HOSTS, 1.0), (ALLOWED_HOSTS, 0.0)) for h in hs])
    each = spark.range(1).select(F.explode(hosts).alias("r")).select("r.host", "r.label")
    return each.select(F.explode(F.array(*[F.replace(F.lit(w), F.lit("{}"), F.col("host")) for w in WAYS])).alias("url"), "label")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict), or null."""
    parts = sorted(((f"{r}", *r.split("/", 1), v) for r, v in rules), key=lambda r: (-len(r[0]), r[0]))
    if not parts:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(h).alias("host"), F.lit("/" + p).alias("path"), F.lit(v).alias("verdict")) for r, h, p, v in parts])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def grams(host: Column, path: Column) -> Column:
    """Distinct character n-grams of host and path, told apart by a prefix; digits count as one digit."""
    def of(c: Column, prefix: str) -> Column:
        marked = F.concat(F.lit("^"), F.regexp_replace(c, "[0-9]+", "0"), F.lit("$"))
        return F.flatten(F.array(*[_slices(marked, n, prefix) for n in SIZES]))
    return F.array_distinct(F.concat(of(host, "h:"), of(path, "p:")))


def _slices(marked: Column, n: int, prefix: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(marked) - n + 1, F.lit(1))),
                       lambda i: F.concat(F.lit(prefix), F.substr(marked, i, F.lit(n))))


def train(labelled: DataFrame, reg: float = 0.01) -> tuple[list[float], float]:
    """(weights, intercept) of the logistic regression over the hashed grams; the table is small by contract."""
    ids = F.transform(grams(host_of(F.col("url")), path_of(F.col("url"))), lambda g: _bucket(g).cast("string"))
    seen = labelled.where("label is not null").select(ids.alias("buckets"), F.col("label").cast("double").alias("label"))
    own_place = CountVectorizerModel.from_vocabulary([str(i) for i in range(DIMS)], inputCol="buckets", outputCol="features", minTF=1.0).setBinary(True)
    model = LogisticRegression(regParam=reg, maxIter=50).fit(own_place.transform(seen))
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(DIMS)).cast("int")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's block probability of every row of ``pages``."""
    weights, intercept = train(labelled)
    table_of = F.array(*[F.lit(w) for w in weights])
    p = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    z = F.aggregate(F.array_distinct(F.transform(grams(F.col("host"), F.col("path")), _bucket)), F.lit(intercept),
                    lambda acc, i: acc + table_of[i])
    scored = p.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("hit"), (1 / (1 + F.exp(-z))).alias("block_probability"))
    method = F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "block_probability")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages"), labelled_urls(spark))
