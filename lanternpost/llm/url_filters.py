"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

A rule fits its host and all subdomains where the url's path starts with the rule's path; the
longest fitting rule wins.  Other urls are judged by the model.  A null url, or one without
``://``, has an empty host and path, fits no rule and has no n-grams: the model's bias judges it.
Repeated urls get the same verdict; an empty table gives an empty table; other columns are ignored.

A few rules are compiled into the plan.  A table of rules, or a long list, is joined: every suffix
of a host meets the path lengths its rules have, then each such prefix of the path meets the rule
itself, so a url meets at most one rule for each suffix and length, however many rules a host has.
Of equally long fitting rules the first of a list wins; of a table, the one with the longer host,
then a block.  Rules with a null in any field are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIZES = (3, 4, 5)
BUCKETS = 1 << 12
#: Up to so many rules are compiled into the plan; more are joined, with the same result.
INLINE_RULES = 1000

# The labelled urls the model is trained on, blocked and allowed: kinds of words, no hosts of the given tables.
BLOCKED_URLS = """
http://www.discount-pharma.example/order/viagra http://best-pills-online.example/buy/cialis https://pills4u.example/no-prescription
https://www.cheap-meds.example/pharmacy/discount http://rx-pills.example/shop/ https://pills-by-mail.example/en/12
https://adult-films.example/video/123 http://www.adult-videos.example/en/9 https://xxx-tube.example/watch?v=1 https://free-xxx.example/clips/
http://hot-adult-cams.example/live https://sex-chat.example/room/4 https://m.adult-cinema.example/de/77 https://porn-hub-free.example/
https://casino-royal.example/slots/ http://online-casino-bonus.example/play https://poker-win.example/jackpot https://bet-casino.example/fr/88
http://www.casino-x.example/spin https://free-slots.example/casino/en https://win-money-fast.example/prize/ http://lottery-win.example/claim
https://crack-soft.example/keygen/download http://warez-free.example/serial/ https://torrent-warez.example/movie https://free-crack.example/serial
http://replica-watches.example/rolex/cheap https://cheap-replica.example/bags https://payday-loan-now.example/apply http://fast-loan.example/cash
https://click-track.example/ad/redirect?u=1 http://spam-links.example/seo/backlinks https://phish-login.example/verify/account
http://malware-drop.example/setup.exe https://adult-dating.example/singles http://escort-girls.example/city https://nude-cams.example/
https://cheap-viagra.example/en/1234.html http://adult-clips.example/en/5521?page=2 https://vegas-casino.example/es/987#top
http://bets-bonus.example/odds https://www.bets-online.example/en/771/ https://sports-bets-free.example/fr/15.html http://m.best-bets.example/win
https://www.xxx-adult.example/en/77120/ http://pills-cheap.example/fr/6650?utm_source=feed https://poker-casino.example/de/4410.html
http://adult-theatre.example/en/31 https://www.adults-only.example/fr/7.html https://free-adult-pics.example/es/90 http://m.adult-zone.example/de/6
"""
ALLOWED_URLS = """
http://a.example http://news.example https://w3.example http://town.example/ https://b.example/x http://go.example http://my.example/en/1
https://news.river.example/en/1234 https://www.library.example/books/history https://blog.garden.example/fr/88 http://school.example/en/51
https://encyclopedia.example/wiki/Physics https://m.weather.example/de/12 https://docs.tools.example/api/index.html http://city-council.example/
https://recipes.kitchen.example/soup/3 https://museum.example/es/774 https://travel.example/en/2231?page=2 https://www.sports.example/match/5
http://university.example/courses/math https://blog.thinker.example/en/910#top https://forum.cars.example/thread/100 https://music.example/album
https://open-data.example/set/7.csv https://health.example/en/56.html https://blog.teacher.example/de/3350/ https://m.market.example/en/7001
https://www.nature.example/article/55 https://photos.example/2020/05/ https://science.example/fr/1203 https://kids.example/stories/
https://radio.example/live/news http://archive.example/es/42.html https://wiki.linux.example/install https://mail.example/help/faq
https://blog.other.example/en/36205.html https://m.thread.example/fr/26256.html http://www.there.example/en/28458?page=2&ref=x
https://on-the-road.example/en/27487#top https://thin-ice.example/es/16399/ https://than.example/en/295/ https://then.example/de/24897
https://www.reader.example/en/17319?utm_source=feed https://blog.tions.example/fr/14232 http://string.example/es/33075.html
https://m.nation.example/en/50451.html https://station.example/en/2681?utm_source=feed https://blog.notion.example/en/47937?page=2&ref=x
"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of the part after the first ``://``; both empty without one."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(text, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 2)
    return F.translate(host, UPPER, UPPER.lower()), path


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, list[Rule]]:
    """Place of the longest fitting rule in the returned list, else null; of equally long ones the first given."""
    ranked = sorted(rules, key=lambda r: -len(r.text))
    fits = [((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)) for r in ranked]
    return F.coalesce(*[F.when(f, F.lit(i)) for i, f in enumerate(fits)], F.lit(None).cast("int")), ranked


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(host, path, verdict, place) of a list of rules; ``place`` falls, so that the first is the greatest."""
    rows = [(r.host, r.path, r.verdict, -i) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "host string, path string, verdict string, place long")


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_joined_rule(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """``parts`` with ``rule`` and ``ruled``: text and verdict of the longest fitting rule, else null.

    ``rules`` has host, path, verdict and may have place; ``parts`` has host and path.  Urls meet
    the rules once for each distinct host and path.  Both tables that are joined to are stored, so
    that a host with a large part of all urls or rules can be split at run time.
    """
    place = F.col("place") if "place" in rules.columns else F.lit(0).cast("long")
    ranked = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", place.alias("place")).dropna()
    size = F.char_length("rule_host") + F.char_length("rule_path")
    best = F.max(F.struct("place", "verdict"))
    distinct = storage.stored(ranked.groupBy("rule_host", "rule_path").agg(best.alias("best")).select("rule_host", "rule_path", "best.*", size.alias("size")), "url-rules")
    lengths = storage.stored(distinct.groupBy("rule_host").agg(F.collect_set(F.char_length("rule_path")).alias("lengths")), "rule-lengths")
    urls = parts.select("host", "path").distinct()
    suffixes = urls.select("*", F.explode(host_suffixes(F.col("host"))).alias("rule_host"))
    fitting = F.filter("lengths", lambda n: n <= F.char_length("path"))
    prefixes = suffixes.join(lengths, "rule_host").select("host", "path", "rule_host", F.explode(fitting).alias("n"))
    met = prefixes.withColumn("rule_path", F.left("path", F.col("n"))).join(distinct, ["rule_host", "rule_path"])
    longest = F.max(F.struct("size", "place", F.char_length("rule_host").alias("host_size"), "verdict", F.concat("rule_host", "rule_path").alias("rule")))
    won = storage.stored(met.groupBy("host", "path").agg(longest.alias("won")).select("host", "path", "won.rule", F.col("won.verdict").alias("ruled")), "ruled-urls")
    return parts.join(won, ["host", "path"], "left")


def ngrams(host: Column, path: Column, sizes: Sequence[int] = SIZES) -> Column:
    """Character n-grams of host and path, marked with the part they come from."""

    def grams(kind: str, text: Column, n: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.char_length(marked) >= n, F.sequence(F.lit(1), F.char_length(marked) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(kind), F.substr(marked, i, F.lit(n))))

    every = F.concat(*[grams(kind, part, n) for kind, part in (("h", host), ("p", path)) for n in sizes])
    return F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(every)


def with_ngrams(urls: DataFrame, url: str) -> DataFrame:
    host, path = url_parts(F.col(url))
    parts = urls.select("*", host.alias("host"), path.alias("path"))
    return parts.withColumn("grams", ngrams(F.col("host"), F.col("path")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(u, 1.0) for u in BLOCKED_URLS.split()] + [(u, 0.0) for u in ALLOWED_URLS.split()]
    return spark.createDataFrame(rows, "url string, label double")


def train(labelled: DataFrame) -> PipelineModel:
    """A model over (url, label); label 1 is blocked."""
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True)
    grams = hashed.transform(with_ngrams(labelled, "url"))
    model: LogisticRegressionModel = LogisticRegression(maxIter=60, regParam=0.02).fit(grams)
    return PipelineModel([hashed, model])


def judge(pages: DataFrame, id_: str, url: str, rules: Sequence[Rule] | DataFrame, model: PipelineModel) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; ``score`` is the model's chance of block.

    ``rules`` is a list, or a table (host, path, verdict) of any length.
    """
    parts = with_ngrams(pages.select(F.col(id_).alias("id"), F.col(url).alias("url")), "url")
    if isinstance(rules, DataFrame) or len(rules) > INLINE_RULES:
        ruled = with_joined_rule(parts, rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules))
    else:
        at, ranked = fitting_rule(F.col("host"), F.col("path"), rules)
        texts, verdicts = (F.array(*[F.lit(x) for x in y]).cast("array<string>") for y in ([r.text for r in ranked], [r.verdict for r in ranked]))
        ruled = parts.withColumn("at", at).withColumn("rule", F.get(texts, F.col("at"))).withColumn("ruled", F.get(verdicts, F.col("at")))
    judged = model.transform(ruled).select("id", "host", "path", "rule", "ruled", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
    by_model = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
