"""URL filter: rules first, then logistic regression on hashed character n-grams.

The model reads the host and the path with their ends marked. It is trained on
the driver from a small labelled table of URLs and rounded to integers, so a
verdict is one sum of table look-ups inside the plan and equals the same sum
in any other engine. The table is made by a rule from the names and path words
of seven kinds of unwanted and sixteen kinds of ordinary sites; prefixes, top
level domains and path shapes are dealt to all kinds alike, so they teach
nothing. An address that says nothing is allowed by the bias. A rule `host/path` fits its host and all subdomains if
the path starts with the rule's; the longest fitting rule decides instead of
the model.

Defined results: a null url, or one without `://`, has empty host and path,
fits no rule and is judged by the model like any other; rows that repeat are
judged alike; characters beyond U+FFFF hash by their code point.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
#: Weights are whole numbers of this part.
SCALE = 1_000_000
#: (rule, verdict) of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Kinds of sites: unwanted (1) or not (0), words that names begin and end with, words of their paths.
KINDS = (
    (1, "casino poker roulette betting jackpot gambling blackjack lotto sportsbet wager slots freespins", "palace royal club online vegas lucky live king bonus 777 bets games", "casino-bonus free-spins place-bet slot-machines jackpot-winners poker-room betting-odds deposit-now"),
    (1, "porn xxx adult nude sexy erotic camgirls escorts hotgirls hardcore webcams milf", "tube cams chat videos live dating pics movies room hub zone x", "xxx-videos nude-girls adult-chat sex-cams hot-singles porn-movies erotic-pics live-sex"),
    (1, "viagra pharma cialis pills meds drugstore steroids weightloss dietpill rxonline generic tramadol", "cheap discount rx noprescription shop direct deals express fast pills meds store", "buy-viagra-online cheap-meds no-prescription order-pills generic-cialis weight-loss-miracle discount-pharmacy rx-deals"),
    (1, "warez crack keygen torrent nulled serials pirate hacked freeload megaupload rapidleech exploit", "full download hub zone free site world base leaks mirror bay drop", "free-crack-download keygen-serial nulled-scripts full-version-torrent setup-exe hacked-apk activation-key warez-mirror"),
    (1, "adserver adclick tracker popads banner doubleads pixel affiliate clicks adtrack impressions retarget", "track serve click cdn sync media net count tag beacon exchange ads", "track/click ad/serve pixel.gif banner-ads sync/redirect popunder affiliate-id impression/count"),
    (1, "winprize freegift giftcard cryptodouble getrich easymoney lottery phish verify-account paypa1 bankalert prizes", "claim now winner cash alert secure login free today rewards bonus update", "claim-your-prize verify-account win-iphone double-your-bitcoin make-money-fast you-are-winner confirm-password free-gift-card"),
    (1, "spam seo backlinks linkfarm articlespin doorway keyword cheaplinks bulkmail traffic pagerank autoblog", "farm exchange booster links spam submit directory rank blast generator buy network", "buy-backlinks link-exchange seo-spam bulk-email cheap-traffic spun-articles keyword-list rank-booster"),
    (0, "encyclopedia wiki reference almanac dictionary britannica lexicon atlas glossary thesaurus factbook wikipedia", "world open online project base central desk library notes hub wiki pages", "wiki/History_of_Rome article/photosynthesis entry/monsoon definition/ratify topics/geology list_of_rivers biography timeline"),
    (0, "news times herald gazette tribune daily observer chronicle guardian post journal reuters", "press online local city morning today report wire media national evening weekly", "politics/election-results world/europe opinion/editorial business/markets local/council-vote weather-warning science/climate obituaries"),
    (0, "university college school academy institute campus faculty lecture seminar students physics maths", "edu courses research library department open learning alumni notes press studies lab", "courses/linear-algebra admissions research/papers faculty/history syllabus lecture-notes campus-map thesis"),
    (0, "gov ministry council parliament city county tax police court census library embassy", "public services office data national records portal information office affairs department state", "services/passport statistics/population legislation/acts planning/permits public-consultation forms/tax-return elections budget"),
    (0, "github gitlab python kernel apache debian developer docs opensource database compiler stackoverflow", "project code foundation dev manual packages org forum tutorial guide api source", "docs/getting-started issues/1842 blob/main/README.md api/reference questions/tagged/sql releases/changelog tutorial/install pull/77"),
    (0, "books furniture garden shoes bicycle toys kitchen tools stationery clothing hardware ceramics", "store shop market outlet house corner warehouse supply company online works direct", "products/oak-table cart category/winter-coats delivery-returns item/lamp catalogue size-guide gift-wrapping"),
    (0, "recipes kitchen baking cooking vegetarian bread dinner pasta seasonal soup spices cheese", "table home stories easy cook guide garden mother family food plates notebook", "recipes/lentil-soup baking/sourdough seasonal/asparagus dinner-ideas how-to-poach-eggs vegetables techniques shopping-list"),
    (0, "travel hotels railway islands hiking mountain coast city museum airline camping ferry", "guide routes journeys world planner trails holidays maps explorer tours timetable diary", "guides/lisbon timetable/london-leeds hiking/trails hotels/edinburgh what-to-see visas packing-list maps"),
    (0, "football cricket tennis rugby cycling athletics league swimming chess rowing hockey marathon", "club results union fixtures federation stats fans association stadium training review season", "results/2019 fixtures league-table players/profile match-report training-plan tickets history"),
    (0, "health hospital clinic medical nursing dental vaccine heart children wellbeing cancer nutrition", "advice trust foundation care information service society charity centre patients research online", "conditions/asthma vaccination-schedule find-a-doctor patient-leaflets first-aid research/trials nutrition support-groups"),
    (0, "museum gallery theatre opera orchestra painting film photography poetry sculpture cinema jazz", "arts national modern house society archive collection festival studio review season hall", "exhibitions/impressionists collection/ceramics whats-on concerts/programme reviews/film artists education/families archive"),
    (0, "science nature astronomy biology chemistry climate ocean geology ecology genetics space fossils", "journal review today society institute observatory letters data survey centre report lab", "articles/black-holes abstracts volume/12/issue/3 datasets field-notes press-release methods species/finches"),
    (0, "weather forecast rainfall tides storms meteo barometer snow sunrise pollen temperature seasons", "service office today maps regional station report centre live local data watch", "forecast/berlin radar/rainfall warnings/wind tides/dover climate-normals five-day pollen-count marine"),
    (0, "jane thomas maria peter garden village allotment parish notebook knitting birdwatching maker", "blog diary letters workshop corner journal writes home thoughts family notes club", "2014/03/spring-planting about archive/2011 posts/finished-scarf my-garden bird-list reading-list comments"),
    (0, "google microsoft amazon facebook twitter instagram netflix spotify dropbox adobe oracle zoom", "support blog developers account photos music store mail drive cloud login app", "watch profile/settings download/desktop in/person dp/product hashtag/music playlist help/center"),
    (0, "bank insurance energy water transport post telecom union chamber housing pension railways", "group customer company service regional mutual national trust society cooperative partners holdings", "annual-report contact-us careers branches tariffs help/faq investors press"),
)
#: Addresses made of each kind, and what is dealt to all kinds in turn.
EACH = 48
_PREFIXES = ("", "www.", "", "m.", "blog.", "", "en.")
_DOMAINS = (".com", ".org", ".net", ".example.com", ".co.uk", ".de", ".example.org", ".info", ".fr", ".example.net", ".es")
_SHAPES = ("/{p}", "/en/{n}", "/{p}/{n}.html", "/", "/de/{n}.html", "/{p}/", "/fr/{n}/", "/{n}/{p}", "/es/{n}")


def labelled_table(kinds=KINDS, each: int = EACH) -> tuple[tuple[str, int], ...]:
    """(address, unwanted): `each` addresses of every kind, by a fixed rule."""
    out = []
    for k, (label, heads, tails, paths) in enumerate(kinds):
        heads, tails, paths = heads.split(), tails.split(), paths.split()
        for i in range(each):
            j = k + i
            name = heads[i % len(heads)] + ("-", "", ".", "")[j % 4] * (i % 5 > 0) + tails[(i // len(heads) * 5 + i) % len(tails)] * (i % 5 > 0)
            shape = _SHAPES[j % len(_SHAPES)].format(p=paths[(i + i // len(paths)) % len(paths)], n=(j * 7919) % 9973)
            out.append((_PREFIXES[j % len(_PREFIXES)] + name + _DOMAINS[j % len(_DOMAINS)] + shape, label))
    return tuple(out)


LABELLED = labelled_table()


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url, re.S) if url else None
    if not m:
        return "", ""
    return re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]


def _marked(host: str, path: str) -> list[str]:
    return [f"^{host}$", f"{path}$"]


def buckets(host: str, path: str) -> list[int]:
    """The bucket of every n-gram: a polynomial of code points, so that any engine can compute it."""
    out = []
    for k, text in enumerate(_marked(host, path)):
        for n in SIZES:
            for i in range(len(text) - n + 1):
                h = k + 7
                for c in text[i : i + n]:
                    h = (h * 131 + ord(c)) % 1_000_003
                out.append(h % BUCKETS)
    return out


@lru_cache(8)
def train(labelled=LABELLED, rounds: int = 600, rate: float = 4.0, decay: float = 2e-4) -> tuple[np.ndarray, int]:
    """Integer weights and bias of the logistic regression on n-gram counts over the root of their number.

    Both labels weigh alike in sum. Weights are sums of the rows, so the descent runs on one number for each row.
    """
    found = [buckets(*split("http://" + url)) for url, _ in labelled]
    used, place = np.unique(np.concatenate([np.array(f, np.int64) for f in found]), return_inverse=True)
    x, y = np.zeros((len(labelled), len(used))), np.array([k for _, k in labelled], float)
    np.add.at(x, (np.repeat(np.arange(len(found)), [len(f) for f in found]), place), np.repeat([1 / np.sqrt(max(1, len(f))) for f in found], [len(f) for f in found]))
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    gram, part, b = x @ x.T, np.zeros(len(y)), 0.0
    for _ in range(rounds):
        gap = share * (1 / (1 + np.exp(-(gram @ part + b))) - y)
        part -= rate * (gap + decay * part)
        b -= rate * gap.sum()
    w = np.zeros(BUCKETS)
    w[used] = part @ x
    return np.rint(w * SCALE).astype(np.int64), int(round(b * SCALE))


def _grams(marked: Column, salt: int) -> tuple[Column, Column]:
    """The code points of one marked text, and the buckets of its n-grams."""
    codes = F.transform(F.split(marked, ""), F.ascii)

    def of(n: int) -> Column:
        def fold(i: Column) -> Column:
            h = F.lit(salt + 7).cast("long")
            for j in range(n):
                h = (h * 131 + F.get("_c%d" % salt, i + j)) % 1_000_003
            return (h % BUCKETS).cast("int")

        size = F.size("_c%d" % salt)
        return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), fold)).otherwise(F.array().cast("array<int>"))

    return codes, F.concat(*(of(n) for n in SIZES))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """page_id, host, path, rule, score, verdict: one row for each row of pages."""
    weights, bias = train(labelled)
    url = F.col("url").cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(rest, F.lit("")).alias("_r"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = rows.withColumns({"host": F.translate(F.regexp_extract("_r", r"^([^/?#]*)", 1), upper, lower), "path": F.regexp_extract("_r", r"(?s)^[^/?#]*([^?#]*)", 1)})
    fits = []
    for name, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = name.partition("/")
        own = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits.append(F.when(own & F.startswith("path", F.lit("/" + path)), F.struct(F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))))
    rows = rows.withColumn("_f", F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>")))
    marked = (F.concat(F.lit("^"), "host", F.lit("$")), F.concat("path", F.lit("$")))
    grams = [_grams(m, k) for k, m in enumerate(marked)]
    rows = rows.withColumns({f"_c{k}": codes for k, (codes, _) in enumerate(grams)}).withColumn("_g", F.concat(*(g for _, g in grams)))
    table = F.split(F.lit(",".join(map(str, weights.tolist()))), ",").cast("array<bigint>")  # folded to one literal
    total = F.aggregate("_g", F.lit(0).cast("long"), lambda a, g: a + F.get(table, g))
    score = total / F.greatest(F.sqrt(F.size("_g").cast("double")), F.lit(1.0)) + bias  # without an n-gram only the bias speaks
    rows = rows.withColumn("score", F.round(score / SCALE, 6))
    return rows.select("page_id", "host", "path", F.col("_f.rule").alias("rule"), "score", F.coalesce(F.col("_f.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def sql(rules=RULES, labelled=LABELLED) -> str:
    """The same over a view `pages`."""
    weights, bias = train(labelled)
    fits = " ".join(
        "WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'".format(h=r.partition("/")[0], p=r.partition("/")[2], r=r)
        for r, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    )
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)
    parts = []
    for k, text in enumerate(("'^' || host || '$'", "path || '$'")):
        for n in SIZES:
            h = str(k + 7)
            for j in range(n):
                h = f"(({h}) * 131 + ord(substr({text}, CAST(i + {j} AS INTEGER), 1))) % 1000003"
            parts.append(f"list_transform(range(1, length({text}) - {n - 2}), lambda i: ({h}) % {BUCKETS})")
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT page_id, host, path, CASE {fits} END AS rule FROM h),
u AS (SELECT page_id, host, path, list_concat({', '.join(parts[:3])}) AS ga, list_concat({', '.join(parts[3:])}) AS gb FROM h),
w AS (SELECT {weights.tolist()} AS w),
x AS (SELECT page_id, host, path, unnest(list_concat(ga, gb)) AS b FROM u),
s AS (SELECT page_id, host, path, round((sum(w.w[CAST(b AS INTEGER) + 1]) / sqrt(CAST(count(*) AS DOUBLE)) + {bias}) / {SCALE}, 6) AS score FROM x, w GROUP BY page_id, host, path)
SELECT f.page_id, f.host, f.path, f.rule, coalesce(s.score, round({bias} / {SCALE}, 6)) AS score, CASE f.rule {said} ELSE CASE WHEN coalesce(s.score, {bias}) > 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM f LEFT JOIN s ON s.page_id = f.page_id AND s.host = f.host AND s.path = f.path
"""
