"""URL filter: rules by host and path, and a logistic regression where no rule fits.

The regression works on hashed character n-grams (3 to 5) of host and path and is trained from a
small labelled table of URLs, some of which only their host gives away and some only their path (for
the model in lower case). Host and path come from the url as written: the host is what follows
the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; the path goes on up to `?`,
`#` or the end. A null url or one without `://` has an empty host and path, fits no rule and is
allowed. Rules fit their host and its subdomains; the longest fitting rule wins. Rows are judged one
by one, so repeated rows get equal verdicts; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)

RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

# Fixed values of the labelled table: parts of host names and paths.
BAD_PARTS = ["spam", "farm", "adult", "xxx", "porn", "sex", "casino", "bets", "betting", "free-bets", "poker", "slots", "jackpot", "pills", "viagra", "pharma-x", "warez", "crack", "torrent", "escort", "dating-x", "loans-fast", "cash-now", "hack", "phish", "malware", "click-bait", "link-farm", "spam-farm", "adult-x"]
GOOD_PARTS = ["news", "library", "garden", "history", "museum", "science", "weather", "school", "kitchen", "travel", "music", "letters", "harbor", "theater", "station", "nation", "mother", "other", "there", "thing", "tionen", "the", "blog", "archive", "docs", "wiki", "journal", "forum", "city", "river"]
PATH_WORDS = "about contact products product shop store category tag page post posts article articles index search user users account help support images image static assets media video events event team company services service pricing downloads download terms privacy policy careers jobs press research reports report data guide guides tutorial manual reference chapter section book books recipes recipe sports football health fitness family children education course courses lectures university cities essex sussex hackney crackers better alphabet farmers slot-machine-history adulthood shackleton torrential pharmacy updating loan-words cash-flow software hardware wares warehouse download-area current-events parent resort passport cart checkout free-shipping free-trial free-books free-plants link-list line-dance fast-food nowhere sextant middlesex poked-fun assets-x pillow farmhouse animal-farm clickable baiting dating-of-coins".split()
SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti st le ou ing tion ble ly sh wh ar de ve al".split()
PREFIXES = ["", "www.", "m.", "blog."]
ENDINGS = ["example.org", "example.net", "example.com"]
PLAIN_HOSTS = ["a.b", "site.io", "shop.co", "unit7.gov", "web.info", "my-page.dev", "localhost", "q1.biz", "home.eu", "cloud.app", "group.int"]
PATHS = ["/en/12", "/de/7.html", "/fr/301/", "/es/88", "/"]
LANGUAGES, ENDS = ["en", "de", "fr", "es"], ["", "/", ".html"]
PATH_FORMS = ["/{0}", "/{0}/", "/en/{0}/12", "/{0}/{1}", "/{1}/{0}", "/de/{0}.html", "/2024/05/{0}-{1}", "/{0}/7.html", "/{1}/88/{0}.html", "/x/y/{1}-{0}"]


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) built by rule: each part under prefixes, endings and paths in turn;
    then bad and harmless parts in paths of the same harmless hosts, bad hosts with harmless paths, and compound hosts."""
    rows = []
    for label, parts in ((1, BAD_PARTS), (0, GOOD_PARTS)):
        for i, part in enumerate(parts):
            for k in range(3):
                at = i * 3 + k
                rows.append((f"{PREFIXES[at % 4]}{part}.{ENDINGS[at % 3]}", PATHS[at % 5], label))
    for i in range(len(SYLLABLES) ** 2):  # hosts of common syllables are nothing to block
        a, b = SYLLABLES[i % len(SYLLABLES)], SYLLABLES[i // len(SYLLABLES)]
        third = SYLLABLES[(i * 7) % len(SYLLABLES)] if i % 3 == 0 else ""
        rows.append((f"{PREFIXES[i % 4]}{a}{b}{third}.{ENDINGS[i % 3]}", PATHS[i % 5], 0))
        rows.append((f"{PREFIXES[i % 4]}{b}{a}.{ENDINGS[i % 3]}", PATH_FORMS[i % len(PATH_FORMS)].format(a + b, b + third), 0))
        rows.append((f"{PREFIXES[i // 3 % 4]}{b}{third}{a}.{ENDINGS[i % 3]}", f"/{LANGUAGES[i % 4]}/{i * 7919 % 10007}{ENDS[i % 3]}", 0))
    harmless = [*GOOD_PARTS, *PATH_WORDS]
    for label, parts in ((1, BAD_PARTS), (0, harmless)):
        for i, part in enumerate(parts):
            for k, form in enumerate(PATH_FORMS):
                host = f"{PREFIXES[(i + k) % 4]}{GOOD_PARTS[(i * 3 + k) % len(GOOD_PARTS)]}.{ENDINGS[(i + k) % 3]}"
                path = form.format(part, harmless[(i * 7 + k * 11) % len(harmless)])
                rows += [(host, path, label), (PLAIN_HOSTS[(i + k) % len(PLAIN_HOSTS)], path, label)]
                if label:  # a second harmless host, as bad parts are fewer
                    rows.append((f"{PREFIXES[(i + k + 1) % 4]}{GOOD_PARTS[(i * 7 + k * 3 + 11) % len(GOOD_PARTS)]}.{ENDINGS[(i + k + 1) % 3]}", path, label))
    for i, part in enumerate(BAD_PARTS):
        for k in range(3):
            words = harmless[(i * 5 + k * 17) % len(harmless)], harmless[(i * 3 + k * 29) % len(harmless)]
            rows.append((f"{PREFIXES[(i + k) % 4]}{part}.{ENDINGS[k]}", PATH_FORMS[(i + 3 * k) % len(PATH_FORMS)].format(*words), 1))
    for label, parts in ((1, BAD_PARTS), (0, harmless)):
        for i, part in enumerate(parts):
            for k in range(18 if label else 6):  # compound hosts with neutral paths
                other = harmless[(i * 11 + k * 37) % len(harmless)]
                host = f"{other}-{part}" if k % 2 else f"{part}-{other}"
                rows.append((f"{PREFIXES[(i + k) % 4]}{host}.{ENDINGS[k % 3]}", f"/{LANGUAGES[(i + k) % 4]}/{(i * 6 + k) * 7907 % 10009}{ENDS[(i + k // 2) % 3]}", label))
    return rows


def hashed(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams; host and path have their own. A path's case does not count."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
        for n in GRAMS:
            found.update(zlib.crc32((mark + part[i : i + n]).encode()) % BUCKETS for i in range(len(part) - n + 1))
    return np.fromiter(found, np.int64, len(found))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        if not host and not path:
            return 0.0
        return float(1.0 / (1.0 + np.exp(-(self.weights[hashed(host, path)].sum() + self.bias))))


def train(rows: list[tuple[str, str, int]] | None = None, steps: int = 400, rate: float = 0.3, penalty: float = 1e-3) -> UrlModel:
    """Gradient descent on the logistic loss with an L2 penalty; deterministic."""
    rows = labelled_urls() if rows is None else rows
    grams = [hashed(h, p) for h, p, _ in rows]
    owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
    scale = 1.0 / max(1.0, np.mean([len(g) for g in grams]) if grams else 1.0)
    y = np.array([r[2] for r in rows], float)
    weights, bias = np.zeros(BUCKETS), -1.0
    for _ in range(steps if len(rows) else 0):
        z = np.bincount(owner, weights[flat], len(rows)) + bias
        error = 1.0 / (1.0 + np.exp(-z)) - y
        weights -= rate * (np.bincount(flat, error[owner], BUCKETS) * scale + penalty * weights)
        bias -= rate * error.mean()
    return UrlModel(weights, bias)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]], value: int) -> Column:
    """The longest fitting rule (value 0) or its verdict (1); null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = rule[0].partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule[value])).otherwise(found)
    return found


def judge_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, score, verdict)."""
    rules = RULES if rules is None else rules

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([model.score(h, p) for h, p in zip(hosts, paths, strict=True)], dtype=float)

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    scored = parts.withColumn("rule", fitting_rule(host, path, rules, 0)).withColumn("score", score("host", "path"))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(fitting_rule(host, path, rules, 1), by_model))
