"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A rule names a host and the beginning of a path; it fits that host and its subdomains, and the longest rule that fits
decides. Other URLs are blocked if a logistic regression gives them a probability of 0.5 or more. It is trained from a
small table of labelled URLs, which is built below from lists of words, names and shapes of addresses: pages of adult
content, gambling, medicine sold without prescription, pirated software and quick money are blocked; reference works,
news, schools, offices, shops, blogs and names that only look like blocked words aren't. The intercept isn't regularised
and the table is weighed as if one URL in five were blocked, so a URL that tells nothing is allowed.

Cases: a null URL and one without :// have an empty host and path and are allowed, as is any URL without features. Of
rules of equal length that fit, the last in code point order decides. Equal rows are judged alike; null and equal ids are
carried along; a URL of any length is judged whole. An empty table gives an empty result. Other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, checkpointed, join_back, named

#: The rules of the query here, as (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: So many rules are matched within the row; longer lists become a table that is joined by host.
MOST_RULES = 200

# Fixed values, of which the training table is made. Words of blocked hosts and paths, by kind.
ADULT = "adult babes cam cams escort escorts fetish hardcore hentai hookup milf naked nude nudes porn porno sex sexcam sexy strip webcam xxx".split()
GAMBLING = "bet bets betting bingo blackjack bonus casino casinos gamble gambling jackpot lottery poker roulette slot slots spins wager".split()
PILLS = "cialis diet-pills levitra painkillers pharmacy pills steroids tramadol valium viagra weightloss xanax".split()
PIRACY = "crack cracked hack hacks keygen nulled pirate serials torrent torrents warez".split()
MONEY = "cash cashadvance cheap clickbait credit-repair forex-signals free-gift get-rich giveaway loan loans payday prize replica win winner".split()
KINDS = (ADULT, GAMBLING, PILLS, PIRACY, MONEY)
BLOCKED_WORDS = [w for kind in KINDS for w in kind]
LURES = "best big buy cheap club fast free geo hd hot hub king live lucky max mega movies my now online order pics play pro royal show super top tube videos vip world x zone".split()
SPAM_ENDS = "com net org info biz xyz top click win bet casino xxx porn adult club site online ru".split()
# Ordinary names: words, names that hold a blocked word or its beginning, and syllables.
ALLOWED_WORDS = "academy archive art article bakery bank bike book bridge city clinic college community daily data design docs education energy engineering family farm film flower forum garden guide health history home hotel house journal kitchen law library local magazine map market media museum music nature news paper people photo politics press project recipe repair research review school science shop society software sport story studio study teacher theatre travel university water weather wiki yoga".split()
LOOKALIKES = "adulthood alphabet analysis assessment bassline betterhomes betterment bettyskitchen bonuspack cambridge camera camping cameron cashew cashmere cheapside classic cocktail crackers cracker-barrel dickens diabetes elizabeth embassy essex expert-exchange farmersmarket freebsd freedom freeway grass hackathon hackney hancock lifehacker liverpool livestock loanword lotterywest macbeth mandate middlesex newcastle nightingale pillow pillar poke-bowl prizewinners replicate saxony scunthorpe sexton sexualhealth shuttlecock slotcars spills strippedback stripes superhero supermarket sussex tibet torrential update webcamera weddings winchester windows winery winner-school wintergarden xxl-outdoor".split()
SYLLABLES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce sh ly ch wh ing tion ent ble for and est ill ure man son ton ber ley ford land".split()
ENDS = "com net org com org co.uk de fr es it edu gov info io nl ca com.au example.com example.net example.org".split()
# Subjects of pages, a third of them such as blocked pages name too, and shapes of addresses that are about them.
SUBJECTS = "history climate football physics jazz gardening inflation volcano poetry vaccination election chess beekeeping architecture railway nutrition astronomy casino gambling-addiction sex-education breast-cancer online-poker-law viagra pornography-debate bingo payday-loan-reform drug-policy torrent-file adult-learning lottery-fraud webcam-privacy nude-in-art pharmacy-opening-hours".split()
SHAPES = (
    "en.wikipedia.org/wiki/{s}", "de.wikipedia.org/wiki/{s}", "fr.wikipedia.org/wiki/{s}", "www.britannica.com/topic/{s}", "www.bbc.co.uk/news/{s}-{n}", "www.theguardian.com/society/2018/mar/12/{s}", "www.nytimes.com/2019/05/12/world/{s}.html",
    "www.reuters.com/article/{s}-id{n}", "www.nature.com/articles/{s}", "www.sciencedirect.com/science/article/{n}", "arxiv.org/abs/{n}", "www.gov.uk/guidance/{s}", "www.cdc.gov/{s}/index.html", "www.nhs.uk/conditions/{s}", "{s}.nhs.uk/{n}", "www.who.int/news-room/{s}",
    "web.mit.edu/{s}", "www.ox.ac.uk/{s}", "www.stanford.edu/~{w}/{s}.html", "docs.python.org/3/library/{w}.html", "stackoverflow.com/questions/{n}/{s}", "github.com/{w}/{s}", "medium.com/@{w}/{s}-{n}", "{w}.wordpress.com/2014/03/{s}", "{w}.blogspot.com/2012/07/{s}.html",
    "www.amazon.com/{s}/dp/{n}", "www.imdb.com/title/tt{n}", "www.goodreads.com/book/show/{n}-{s}", "www.{w}news.com/{n}/{s}", "www.{w}-times.co.uk/articles/{s}", "{w}.edu/courses/{s}", "library.{w}.ac.uk/{s}",
)
DIM, SIZES, EPOCHS, RATE, DECAY = 1 << 16, (3, 4, 5), 60, 0.4, 1e-5
#: The share of blocked URLs that the table stands for.
PRIOR = 0.2


def labelled() -> list[tuple[str, str, int]]:
    """The training table: (host, path, 1 if blocked), about 5,000 rows made of the words above by a fixed rule."""
    rows: list[tuple[str, str, int]] = []
    take = lambda words, i: words[i % len(words)]

    def plain(i: int) -> str:
        """A path that says nothing."""
        word, n = take(ALLOWED_WORDS, i * 31 + 7), i * 7919 % 9973
        return take(("", "/", f"/{n}", f"/en/{n}.html", f"/de/{n}.html", f"/fr/{n}", f"/es/{n}/", "/about", "/contact.html", f"/{word}/", f"/{word}/{n}", f"/2016/03/{word}-{n}", "/index.php", f"/blog/{word}", f"/p/{n}", f"/{word}.html", "/x"), i * 5 + i // 17)

    def host(name: str, i: int, ends: list[str]) -> str:
        return f"{take(('', 'www.', '', 'm.', 'www.', 'blog.', 'shop.'), i * 3 + i // 7)}{name}.{take(ends, i * 5 + i // 11)}"

    def name(i: int) -> str:
        """An ordinary name of a host."""
        a, b = take(ALLOWED_WORDS, i), take(ALLOWED_WORDS, i * 17 + i // len(ALLOWED_WORDS) + 3)
        x = "".join(take(SYLLABLES, i * k + i // (13 * k)) for k in (1, 7, 11, 5)[: 2 + i % 3])
        y = take(LOOKALIKES, i)
        return take((a + b, f"{a}-{b}", f"the{a}", x, x, f"{x}{a}", y, f"{y}-{a}", f"{a}of{x}", f"{y}{take(SYLLABLES, i)}"), i // 3)

    for i in range(2400):
        rows.append((host(name(i), i, ENDS), plain(i), 0))
    for i, y in enumerate(LOOKALIKES):
        rows += [(host(y, i + k, ENDS), plain(i + k), 0) for k in range(3)]
    for i, shape in enumerate(SHAPES):
        for k, subject in enumerate(SUBJECTS):
            h, slash, path = shape.format(s=subject, n=(i * 131 + k) * 7919 % 99991, w=name(i * 41 + k)).partition("/")
            rows.append((h, slash + path, 0))
    for k, kind in enumerate(KINDS):
        for i, word in enumerate(kind):
            for j in range(36):
                n = 1000 * k + 37 * i + j
                other, lure, less, x = take(kind, i + 1 + j), take(LURES, n), take(LURES, n * 7 + 3), take(SYLLABLES, n * 3)
                made = take((word, f"{lure}{word}", f"{word}{lure}", f"{word}-{other}", f"{word}{other}", f"{lure}-{word}", f"{word}{n % 1000}", f"{other}-{word}-{lure}", f"{lure}{word}{less}", f"{word}{less}", f"{word}{other}{less}", f"{x}{word}{lure}"), j)
                path = take((plain(n), f"/{other}/{word}-{n}.html", "", f"/{lure}-{word}", f"/{word}/{n}", "/x"), j // 3 + i)
                rows.append((host(made, n, SPAM_ENDS), path, 1))
            for j in range(6):
                n = 1000 * k + 40 * i + j
                rows.append((host(name(n * 7 + 5), n, SPAM_ENDS[:5]), f"/{word}/{take(LURES, n)}-{take(kind, i + 2 + j)}-{take(kind, i + 5 + j)}.html", 1))
    return rows


def features(host: str, path: str) -> list[int]:
    """The buckets of the different n-grams of host and path, which are told apart."""
    found = set()
    for kind, text in (("h", host), ("p", path.lower())):
        if text:
            text = f"^{text}$"
            for n in SIZES:
                found.update(kind + text[i : i + n] for i in range(len(text) - n + 1))
    return sorted({zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIM for f in found})


def fit(rows: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and intercept; features of a row share a unit length, and blocked rows weigh PRIOR of the whole.

    Gradient steps on all rows, each weight's step divided by the root of its squared gradients so far.
    """
    found = [features(h, p) for h, p, _ in rows]
    index = np.concatenate([np.array(f, dtype=np.int64) for f in found])
    size = np.array([len(f) for f in found])
    row = np.repeat(np.arange(len(rows)), size)
    value = 1 / np.sqrt(np.maximum(size, 1))[row]
    y = np.array([r[2] for r in rows], float)
    share = np.where(y == 1, PRIOR / max(y.sum(), 1), (1 - PRIOR) / max((1 - y).sum(), 1))
    w, b, past, past_b = np.zeros(DIM), float(np.log(PRIOR / (1 - PRIOR))), np.full(DIM, 1e-12), 1e-12
    for _ in range(EPOCHS):
        s = np.bincount(row, w[index] * value, len(rows)) + b
        g = share * (1 / (1 + np.exp(-s)) - y)
        step = np.bincount(index, g[row] * value, DIM) + DECAY * w
        past += step**2
        past_b += g.sum() ** 2
        w -= RATE * step / np.sqrt(past)
        b -= 0.1 * RATE * g.sum() / past_b**0.5
    return w, b


def host_of(url: Column) -> Column:
    """Host and path of a URL as they are written, the host's A-Z in lower case."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.translate(F.regexp_extract(after, r"(?s)^[^/?#]*", 0), LETTERS, LETTERS.lower())
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.struct(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, …) with the longest of the rules (rule, verdict) that fits, as rule_of() gives it.

    Rules meet the different hosts of the rows, under each of their domains; a host's rules go back to its rows.
    """
    rows = checkpointed(rows)
    at = F.instr("rule", "/")
    known = rules.select(F.substring_index("rule", "/", 1).alias("domain"), F.when(at > 0, F.expr("substr(rule, instr(rule, '/'))")).otherwise("").alias("start"), "rule", "verdict")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.", -1)
    domains = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    own = domains.join(known, "domain").groupBy("host").agg(F.collect_list(F.struct("start", F.length("rule").alias("size"), "rule", "verdict")).alias("own"))
    met = join_back(rows, checkpointed(hosts.join(own, "host", "left")), "host", "n")
    best = F.array_max(F.transform(F.filter("own", lambda x: F.startswith(F.col("path"), x["start"])), lambda x: F.struct(x["size"], x["rule"].alias("rule"), x["verdict"].alias("verdict"))))
    return met.withColumn("best", best).drop("own")


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] | DataFrame = RULES, rows: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages; score is the regression's probability.

    rules: (rule, verdict) as pairs or as a DataFrame of any length; rows: the training table.
    """
    w, b = fit(rows or labelled())
    w = w.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                f = features(h, p)
                s = float(w[f].sum(dtype=np.float64)) / len(f) ** 0.5 + b if f else b
                scores.append(1 / (1 + np.exp(-s)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    parts = pages.select(named(id).alias("page_id"), host_of(named(url)).alias("u")).select("page_id", "u.host", "u.path")
    scored = parts.mapInArrow(score, f"page_id {parts.schema['page_id'].dataType.simpleString()}, host string, path string, score double")
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "rule string, verdict string")
    out = with_rules(scored, rules) if isinstance(rules, DataFrame) else scored.withColumn("best", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "score")
