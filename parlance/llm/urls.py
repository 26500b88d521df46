"""URL filter: host and path rules, then logistic regression on hashed character n-grams, in DataFrame functions only.

The regression is trained on the driver from the small labelled table below. Its weights are rounded to whole numbers, so
a score is an exact sum on any engine, and enter the plan as one array literal of `buckets` numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled URLs, to block.
BLOCKED = """
http://www.hot-casino-bonus.example/slots/free-spins
https://casino.lucky7.example/jackpot/poker-online
http://best-poker-bets.example/roulette/win-cash
https://betting-tips.example/sports-bet/odds/casino
http://cheap-viagra-pills.example/buy/cialis-online
https://pharmacy-no-rx.example/order/viagra-cheap
http://buy-tramadol-now.example/pills/discount
https://xxx-videos.example/porn/free-sex
http://free-porn-tube.example/xxx/adult-cams
https://adult-dating.example/sexy-girls/hookup
http://livesex-cams.example/nude/webcam-xxx
https://escort-girls.example/sex/adult
http://ads.tracker-net.example/click?banner=9
https://adserver.example/pixel/track/impression.gif
http://doubleclick-ads.example/adclick/redirect
https://track.affiliate-offers.example/click/cpa/offer
http://popunder.ads-network.example/banner/pop
http://free-download-crack.example/keygen/serial-warez
https://warez-torrent.example/crack/full-version-free
http://torrent-movies-hd.example/download/free-torrent
https://nulled-scripts.example/cracked/keygen
http://secure-login-paypal.verify-account.example/update/password
https://bank-account-verify.example/signin/confirm-password
http://apple-id-locked.example/verify/account-login
https://win-free-iphone.example/prize/claim-now
http://you-won-prize.example/claim/gift-card-free
https://get-rich-quick.example/make-money-fast/bitcoin-double
http://crypto-doubler.example/invest/free-bitcoin
https://payday-loans-fast.example/cash-loan/apply-now
http://cheap-replica-watches.example/buy/rolex-replica
https://seo-backlinks-cheap.example/buy-links/casino-seo
http://weight-loss-miracle.example/diet-pills/buy-now
https://essay-writing-cheap.example/buy-essay/order-now
http://spam-link-farm.example/tag/casino/porn/viagra
https://malware-site.example/download/setup.exe
http://free-screensavers.example/install/toolbar.exe
https://online-slots.example/casino/bonus-code
http://sexy-chat.example/adult/xxx-chat
https://hacked-games.example/cheats/free-coins-generator
http://clickbait-ads.example/ads/banner/popup
https://fake-pharma.example/viagra/levitra/cialis
http://gambling-online.example/poker/casino/bet
""".split()
#: Labelled URLs, to allow.
ALLOWED = """
https://en.encyclopedia.example/wiki/History_of_science
https://www.university.example/research/physics/papers
https://news.example/2021/05/world/election-results
http://docs.python-lang.example/library/functions.html
https://blog.example/posts/how-to-bake-bread
https://www.museum.example/collections/paintings/42
https://library.example/books/catalogue/1234
http://www.city-council.example/services/schools
https://journal.example/articles/volume-12/issue-3
https://forum.example/thread/7781/garden-soil
https://www.recipes.example/dinner/vegetable-soup
https://health-service.example/conditions/asthma
http://weather.example/forecast/london
https://www.travel-guide.example/france/paris/museums
https://code-host.example/project/readme
https://qa.example/questions/55120/sorting-a-list
https://www.school.example/lessons/mathematics/algebra
http://opendata.example/dataset/population-2019
https://archive.example/documents/letters/1850
https://www.newspaper.example/opinion/editorial
https://sports.example/football/match-report
https://www.science.example/article/climate-oceans
https://poetry.example/poems/autumn
http://www.garden-club.example/plants/roses
https://music-school.example/theory/harmony
https://lexicon.example/en/word/harbour
https://www.parliament.example/debates/transcript
https://astronomy.example/planets/saturn
http://history.example/medieval/castles
https://www.railway.example/timetable/north
https://example.org/en/articles/1024
https://www.example.com/de/artikel/2048
http://magazine.example/culture/film-review
https://economics.example/papers/trade
https://www.court.example/judgments/2018/77
https://biology.example/species/beetles
http://philosophy.example/entries/ethics
https://www.farmers.example/crops/wheat
https://geology.example/maps/rocks
https://language.example/es/gramatica/verbos
https://local-news.example/fr/article/881
https://handbook.example/chapter/engines
""".split()
#: The rules in use, as verdict, host and path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1 << 16
#: The n-grams' length and the multiplier of their hash.
N, BASE = 3, 31


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or holds no `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[:end].translate(str.maketrans(_UPPER, _LOWER)), path[:stop]


def buckets_of(text: str, buckets: int) -> list[int]:
    """Hash buckets of a text's character n-grams; a text shorter than that has none."""
    return [((ord(text[i]) * BASE + ord(text[i + 1])) * BASE + ord(text[i + 2])) % buckets for i in range(len(text) - N + 1)]


def train(rows: list[tuple[str, int]], buckets: int = 1024, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[list[int], int]:
    """Whole-number weights per bucket and bias; positive sums mean block. Plain gradient descent, zeros at first."""
    data = [(buckets_of("".join(host_path(url)), buckets), label) for url, label in rows]
    weights, bias = [0.0] * buckets, 0.0
    for _ in range(rounds):
        grad, grad_bias = [l2 * w for w in weights], 0.0
        for found, label in data:
            z = bias + sum(weights[j] for j in found)
            gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label) / len(data)
            grad_bias += gap
            for j in found:
                grad[j] += gap
        weights = [w - rate * g for w, g in zip(weights, grad, strict=True)]
        bias -= rate * grad_bias
    return [round(w * SCALE) for w in weights], round(bias * SCALE)


_MODEL: dict[int, tuple[list[int], int]] = {}


def model(buckets: int = 1024) -> tuple[list[int], int]:
    """The regression trained on the table above."""
    if buckets not in _MODEL:
        _MODEL[buckets] = train([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], buckets)
    return _MODEL[buckets]


def score(text: Column, weights: list[int], bias: int) -> Column:
    """Sum of the weights of the text's n-grams, as a long; the bias alone for a text without any."""
    table = F.from_json(F.lit("[" + ",".join(map(str, weights)) + "]"), "array<bigint>")
    places = F.when(F.length(text) >= N, F.sequence(F.lit(1), F.length(text) - N + 1)).otherwise(F.array().cast("array<int>"))
    code = lambda i: F.ascii(F.substring(text, i, 1)).cast("long")
    found = F.transform(places, lambda i: (((code(i) * BASE + code(i + 1)) * BASE + code(i + 2)) % len(weights)).cast("int"))
    return F.aggregate(found, F.lit(bias).cast("long"), lambda total, j: total + F.get(table, j))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", weights: tuple[list[int], int] | None = None) -> DataFrame:
    """Verdict on every page: page_id, host, path, rule (null if none fits), score, verdict.

    The longest fitting rule decides, else the sign of the regression's sum. Null or scheme-less urls have empty host and
    path, fit no rule and get the regression's verdict on an empty text. Null ids and repeated rows pass through; an
    empty table gives no rows; other columns are not read. At most MAX_RULES rules, as they become one expression.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    weights, bias = weights or model()
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    df = pages.select(F.col(id_col).alias("page_id"), F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, said = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(said)
    df = df.withColumn("rule", rule).withColumn("said", said).withColumn("score", score(F.concat("host", "path"), weights, bias))
    return df.select("page_id", "host", "path", "rule", "score", F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """The same judgement as DuckDB SQL over `pages`."""
    weights, bias = model()
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    said = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in rules)
    code = lambda i: f"unicode(substr(t, CAST(i AS INTEGER) + {i}, 1))"
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (SELECT *, host || path AS t, CASE {' '.join(fits)} END AS rule FROM parts),
texts AS (SELECT DISTINCT t FROM ruled),
grams AS (SELECT t, i FROM texts, unnest(range(1, greatest(length(t) - {N - 2}, 1))) AS u(i)),
weights AS (SELECT {weights}::BIGINT[] AS w),
scores AS (
  SELECT t, CAST(sum(w[(({code(0)}::BIGINT * {BASE} + {code(1)}) * {BASE} + {code(2)}) % {len(weights)} + 1]) AS BIGINT) AS s
  FROM grams, weights GROUP BY t)
SELECT page_id, host, path, rule, CAST(coalesce(s, 0) + {bias} AS BIGINT) AS score,
       CASE rule {said} ELSE CASE WHEN coalesce(s, 0) + {bias} > 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled LEFT JOIN scores USING (t)"""
