"""URL filter: rules on host and path, and a logistic regression on hashed character n-grams for the rest.

Built-in functions only, training included: the labelled URLs are one row of arrays, and full-batch gradient steps are a
fold over them. The weights that reach the driver are DIM numbers, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name

DIM, N, STEPS, RATE, DECAY = 2048, 3, 300, 6.0, 1e-4
MOST_LABELLED = 2000

# Rules (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Labelled URLs, written for this module by general knowledge of what such addresses look like: the word that names the site, and
#: two of its addresses. No host is meant to exist.
BLOCK_URLS = """
casino http://www.casino-royal777.win/bonus?aff=1204 | http://best-casino-online.top/free-spins/register.php?ref=88
poker http://poker4cash.bid/join/now.php?id=993 | http://play-poker-win.xyz/bonus/deposit?promo=50
slots http://free-slots-jackpot.club/spin?aff=77 | http://slots888.win/download.exe
betting http://bet365x-betting.top/live-odds/?ref=af22 | http://sure-betting-tips.bid/vip/tips.php
lottery http://you-won-lottery.click/claim?user=4821 | http://mega-lottery-winner.xyz/claim/prize.php?id=3
jackpot http://jackpot-now.win/bonus/?aff=31 | http://daily-jackpot24.top/free/entry.php?src=mail
pills http://cheap-pills-rx.top/buy/order.php?id=19 | http://pills4less.click/discount/buy-now?aff=5
viagra http://buy-viagra-cheap.xyz/order/?promo=off80 | http://viagra-online24.top/buy-now.php
pharmacy http://rx-pharmacy-discount.bid/no-prescription/?ref=9 | http://cheap-pharmacy24.click/buy/tabs.php?id=2
payday http://payday-cash-fast.top/apply-now?aff=881 | http://instant-payday.xyz/loan/apply.php?ref=m3
loans http://fast-loans-approved.click/apply/now.php?id=77 | http://loans24-easy.win/offer?promo=zero
forex http://forex-profit-robot.top/join?aff=60 | http://win-forex-signals.xyz/vip/signup.php?ref=2
crypto http://double-your-crypto.click/deposit?wallet=1 | http://crypto-profit24.top/join/bonus.php?ref=44
adult http://adult-dates-xxx.top/join/free?id=18 | http://hot-adult-cams.win/live.php?ref=5
porn http://free-porn-hd24.xyz/watch?vid=8812 | http://porn-tube-hot.top/video/xxx.php?id=4
cams http://live-cams-hot.win/free/join.php?aff=9 | http://sexy-cams24.top/chat?ref=7
dating http://hot-dating-now.click/signup?aff=31 | http://sexy-dating24.xyz/join/free.php?id=8
escort http://escort-girls24.top/book.php?id=31 | http://vip-escort-hot.win/girls?ref=20
warez http://warez-full-crack.xyz/download/keygen.exe | http://free-warez24.top/dl.php?file=setup.exe
keygen http://keygen-serials.click/crack/download.php?id=55 | http://get-keygen-free.xyz/dl/crack.exe
torrent http://free-torrent-movies.top/download.php?t=991 | http://torrent-hd24.win/dl/full-movie.exe
malware http://update-flash-malware.xyz/install.exe | http://pc-malware-fix.click/scan-now.php?src=pop
antivirus http://your-pc-antivirus.top/scan/alert.php?id=1 | http://free-antivirus-fix.click/download/setup.exe?ref=pop
paypal http://paypal-secure-login.xyz/verify/account.php?id=29 | http://confirm-paypal24.top/login/verify.php
bank http://bank-verify-login.click/secure/update.php?acct=1 | http://my-bank-alert.xyz/account/verify?id=88
apple http://apple-id-locked.top/verify/login.php?case=4 | http://win-apple-phone.click/claim?ref=sms
giftcard http://free-giftcard-now.click/claim?aff=12 | http://giftcard-winner.xyz/survey/claim.php?id=77
survey http://paid-survey-cash.top/join.php?aff=4 | http://win-survey-prize.click/claim/now?ref=8
diet http://lose-fat-diet24.top/buy-now?promo=70 | http://miracle-diet-pills.xyz/order.php?aff=3
replica http://replica-watches-cheap.top/buy/sale.php?id=9 | http://best-replica-bags.xyz/discount?ref=31
followers http://buy-followers-cheap.click/order?promo=1k | http://get-followers24.top/buy-now.php?id=6
ads http://ads-server24.click/banner.php?zone=4 | http://ads.pop-network.org/track?campaign=9
tracker http://tracker-pixel.net/track.gif?uid=5 | http://ad-tracker.clicknet.org/redirect?to=7
banner http://banner-exchange.top/ads/show.php?id=11 | http://banner-ads.popunder.net/adserve?z=2
spam http://spam-mailer.click/list/blast.php?id=3 | http://bulk-spam-mail.xyz/send/now.php?n=1000
free http://free-stuff-now.click/get.php?id=90 | http://totally-free-gifts.xyz/claim/now?ref=2
cheap http://cheap-deals-outlet.top/buy-now?aff=77 | http://super-cheap-tabs.bid/order.php?id=5
clicks http://earn-clicks-cash.win/join?ref=992 | http://paid-clicks24.xyz/signup.php?aff=51
"""
ALLOW_URLS = """
library https://www.citylibrary.org/opening-hours | http://library.oldtown.edu/catalogue/search.html
museum https://www.nationalmuseum.org/exhibitions/2019/ | http://museum-of-glass.org/visit/directions.html
school https://www.hillsideschool.edu/about/teachers | http://school.riverside.org/news/2018/05/
university https://www.northernuniversity.edu/departments/physics/ | http://university-press.org/books/history.html
science https://www.sciencejournal.org/articles/12/abstract | http://science.museum.org/learn/planets.html
history https://www.local-history.org/articles/castle.html | http://history.college.edu/course/week-3/
garden https://www.botanicgarden.org/plants/roses.html | http://garden-notes.net/2016/04/pruning/
recipes https://www.homerecipes.com/soups/tomato.html | http://recipes.grandmother.org/bread/rye/
weather https://www.weatherservice.gov/forecast/north | http://weather.coast.org/tides/today.html
travel https://www.travelnotes.org/italy/rome/ | http://travel-diary.net/2017/08/lake-district/
music https://www.musicschool.edu/lessons/violin | http://music-archive.org/scores/bach/index.html
books https://www.booksreview.org/fiction/2015/ | http://books.reading.net/authors/a-to-z/
council https://www.countycouncil.gov/services/waste/ | http://council.eastfield.gov/meetings/minutes.html
hospital https://www.generalhospital.org/patients/visiting | http://hospital.westside.gov/departments/heart/
maps https://www.oldmaps.org/collections/coast.html | http://maps.survey.gov/sheets/index/
journal https://www.journal-of-botany.org/volume/7/contents | http://journal.society.edu/issues/2014/spring/
film https://www.filmarchive.org/directors/k/ | http://film-society.net/programme/autumn.html
family https://www.familytree.org/guides/census.html | http://family-letters.net/1916/
nature https://www.naturereserve.org/walks/ | http://nature.trust.org/wetlands/species.html
birds https://www.birdsociety.org/species/heron/ | http://birds-of-the-coast.net/diary/march.html
chess https://www.chessclub.org/openings/sicilian.html | http://chess.college.edu/tournament/results/
language https://www.languageinstitute.edu/grammar/verbs/ | http://language-notes.org/french/lesson-4.html
archive https://www.townarchive.org/records/1890/ | http://archive.parish.org/registers/index.html
research https://www.researchcouncil.gov/grants/reports/ | http://research.institute.edu/papers/2013/
theatre https://www.theatre-royal.org/whats-on/ | http://theatre.company.net/plays/hamlet.html
railway https://www.railwaymuseum.org/engines/ | http://railway-timetables.net/lines/west/
bakery https://www.villagebakery.com/our-bread/ | http://bakery-on-the-hill.net/about.html
village https://www.villagehall.org/events/ | http://village.parish.gov/notices/2012/
college https://www.artscollege.edu/courses/ | http://college.lakeside.edu/students/handbook.html
river https://www.rivertrust.org/projects/fish-pass/ | http://river.survey.gov/levels/daily.html
letter https://www.letterpress.org/workshops/ | http://letters-from-home.net/1944/june.html
station https://www.stationmasters.org/lines/ | http://station-buffet.net/menu/
market https://www.market-square.com/stalls/ | http://market.townhall.gov/dates/2011/
teacher https://www.teachersguide.org/lessons/fractions/ | http://teacher-notes.net/year-4/spelling.html
doctor https://www.doctorsurgery.org/appointments/ | http://doctor-training.college.edu/wards/index.html
harbour https://www.harbourmaster.gov/moorings/ | http://harbour-lights.net/history/ferry.html
orchard https://www.appleorchard.com/visit/ | http://orchard-project.org/varieties/list.html
church https://www.parishchurch.org/services/ | http://church-bells.net/towers/north.html
"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`. Other letters keep their case."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none fits."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    name = F.coalesce(F.lit(None).cast("string"), *[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, order)])
    verdict = F.coalesce(F.lit(None).cast("string"), *[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, order)])
    return name, verdict


def features(host: Column, path: Column) -> Column:
    """Bucket numbers of the character n-grams of host and path, each with its ends marked; digits are alike."""
    made = []
    for name, part in (("h", host), ("p", path)):
        text = F.concat(F.lit("^"), F.regexp_replace(part, "[0-9]", "0"), F.lit("$"))
        # a look-ahead finds overlapping n-grams in one pass
        found = F.when(F.length(text) >= N, F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{N}}}))"), F.lit(1))).otherwise(F.array(text))
        made.append(F.transform(found, _bucket(name)))
    return F.array_distinct(F.concat(*made))


def _bucket(name: str):
    return lambda gram: F.pmod(F.xxhash64(F.lit(name), gram), F.lit(DIM)).cast("int")


def _margin(weights: Column, found: Column) -> Column:
    """Sum of the weights of some buckets over the root of their number; bucket DIM is the bias."""
    total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.element_at(weights, b + 1))
    return total / F.sqrt(F.size(found).cast("double")) + F.element_at(weights, F.lit(DIM + 1))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def train(labelled: DataFrame, host_col: str = "host", path_col: str = "path", label_col: str = "label") -> list[float]:
    """Weights of a logistic regression by full-batch gradient descent from zero. labelled becomes one row, so it may have
    MOST_LABELLED rows at most; ValueError beyond.

    Rows are put in order first, so the result doesn't hang on partitions. Without rows all weights are 0.
    """
    if labelled.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled rows")
    rows = labelled.select(F.struct(features(F.col(host_col), F.col(path_col)).alias("x"), F.col(label_col).cast("double").alias("y")).alias("r"))
    one = rows.agg(F.array_sort(F.collect_list("r")).alias("rows"))
    # for each bucket the rows that have it
    places = F.sequence(F.lit(0), F.size("rows") - 1)
    having = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda b: F.filter(places, lambda i: F.array_contains(F.get("rows", i)["x"], b)))
    none = F.array_repeat(F.array().cast("array<int>"), F.lit(DIM))
    one = one.withColumn("having", F.explode(F.array(F.when(F.size("rows") > 0, having).otherwise(none))))
    zero = F.array_repeat(F.lit(0.0), DIM + 1)

    def step(weights: Column, _: Column) -> Column:
        missed = F.transform("rows", lambda r: r.y - _sigmoid(_margin(weights, r.x)))

        def moved(e: Column) -> Column:
            part = F.transform(e, lambda x, i: x / F.sqrt(F.size(F.get("rows", i)["x"]).cast("double")))
            sums = lambda of: F.transform("having", lambda some: F.aggregate(some, F.lit(0.0), lambda s, i: s + F.get(of, i)))
            gradient = F.concat(F.get(F.transform(F.array(part), sums), F.lit(0)), F.array(F.aggregate(e, F.lit(0.0), lambda s, x: s + x)))
            n = F.greatest(F.size("rows"), F.lit(1)).cast("double")
            return F.zip_with(weights, gradient, lambda w, g: w * (1 - DECAY) + F.lit(RATE) * g / n)

        # as a lambda's variable the errors are worked out once a step
        return F.get(F.transform(F.array(missed), moved), F.lit(0))

    weights = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step).alias("w")).first()
    return [float(x) for x in weights["w"]]


#: Three more addresses of each word, in which only the word tells: these parts are the same for both kinds of sites.
PLAIN_HOSTS = ("www.{w}-{s}.com", "{w}-{s}.org", "m.{w}-{s}.net", "{w}.{s}.com", "blog.{w}-{s}.org")
PLAIN_WORDS, PLAIN_PATHS = ("north", "hill", "lake", "stone", "field", "bridge", "west"), ("/en/12", "/de/7.html", "/index.html", "/", "/a/b.html", "/fr/30")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table of this module: url, label (1: block), word, fold (0 to 2; all addresses of a word are in one fold), plain:
    whether only the word tells."""
    rows = []
    for label, text in ((1, BLOCK_URLS), (0, ALLOW_URLS)):
        for i, line in enumerate(text.strip().split("\n")):
            word, said = line.split(" ", 1)
            rows += [(url.strip(), label, word, i % 3, False) for url in said.split("|")]
            for k in range(3):
                host = PLAIN_HOSTS[(i + 2 * k) % len(PLAIN_HOSTS)].format(w=word, s=PLAIN_WORDS[(i + 3 * k) % len(PLAIN_WORDS)])
                rows.append((f"http://{host}{PLAIN_PATHS[(i + k) % len(PLAIN_PATHS)]}", label, word, i % 3, True))
    return spark.createDataFrame(rows, "url string, label int, word string, fold int, plain boolean")


def trained(spark: SparkSession, without: int | None = None) -> list[float]:
    """Weights learnt from the labelled rows, or from those that are not in one fold."""
    host, path = host_path(F.col("url"))
    rows = labelled_urls(spark)
    rows = rows if without is None else rows.where(F.col("fold") != without)
    return train(rows.select(host.alias("host"), path.alias("path"), "label"))


def judge(pages: DataFrame, weights: list[float], url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, p_block and verdict. A null or odd url has empty host and path and is judged like any
    other; columns of these names in pages are replaced. A p_block of exactly 0.5 blocks. Repeated rows and other columns stay; an
    empty table gives an empty result."""
    host, path = host_path(F.col(url_col))
    got = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    name = free_name(got, "grams")
    got = got.withColumn("rule", rule).withColumn(name, features(F.col("host"), F.col("path")))
    got = got.withColumn("p_block", _sigmoid(_margin(F.array(*[F.lit(w) for w in weights]), F.col(name)))).drop(name)
    return got.withColumn("verdict", F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")))


def op4(spark, sf_dir: str) -> DataFrame:
    weights = trained(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, weights).select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))
