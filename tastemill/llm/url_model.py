"""URL filter: domain rules first, a logistic regression on hashed character n-grams for the rest.

A rule is a host with an optional path.  It fits its host and all subdomains
where the url's path starts with the rule's path; of several that fit, the
longest decides.  Urls that no rule fits get the model's verdict; the others
aren't scored.  The model is trained with numpy on a small table of labelled urls
(a parameter; the default is made of the words below), its features are the
character 3- to 5-grams of host and path, hashed into ``BUCKETS`` columns, a
batch of urls at a time.  Its weights, a fixed number of floats, go to the
executors with the function.

Defined results: a null url, or one without "://", has an empty host and path,
fits no rule and is judged by the model like any other.  Repeated rows give
repeated results; an empty table an empty one; columns besides page_id and url
are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BITS = 14
BUCKETS = 1 << BITS
#: Urls that are hashed at a time.
URLS = 2048
GRAMS = (3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of sites to block and to allow, from which the default table of labelled urls is made.
_BLOCKED = (
    "casino jackpot slots poker roulette blackjack betting bets sportsbook lottery bingo wager pills pharmacy viagra cialis meds steroids "
    "xxx porn adult escort cams dating singles payday loans creditfix replica rolex warez cracked keygen torrent ringtones cheap free-money win-cash"
).split()
_ALLOWED = (
    "garden history city library recipes museum science travel music physics university weather bank forum books hospital election football "
    "chess courses film mathematics software school journal news review kitchen health climate energy railway theatre poetry language "
    "archive council village mountain river ocean biology chemistry economy market farm craft photo radio research teacher student "
    "community parliament justice police fire water bridge castle church island coast winter summer letters stories family children"
).split()
_PATHS = ("", "/", "/en/17", "/de/203.html", "/fr/9/", "/index.html", "/2021/05/a-page", "/es/311?ref=q", "/about", "/en/88#top")
_FRONT = ("", "www.", "m.", "blog.", "shop.")
_NEAR = ("", "-online", "s4u", "-top", "best-", "my", "the-", "-24", "-net", "local-")


def labelled_urls(blocked=_BLOCKED, allowed=_ALLOWED) -> list[tuple[str, int]]:
    """Invented urls around the words, three for each: 1 is to be blocked."""
    out = []
    for words, label in ((blocked, 1), (allowed, 0)):
        for k, word in enumerate(words):
            for j in range(3):
                near = _NEAR[(3 * k + j) % len(_NEAR)]
                name = word + near if near[:1] in "-s" else near + word
                out.append((f"http://{_FRONT[(k + j) % len(_FRONT)]}{name}.test{_PATHS[(2 * k + 3 * j) % len(_PATHS)]}", label))
    return out


LABELLED = tuple(labelled_urls())


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _split(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans(_UPPER, _LOWER)), m[2]) if m else ("", "")


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Url number and column of every distinct character n-gram of hosts and paths."""
    found = []
    for mark, texts in ((1, hosts), (2, paths)):
        parts = [f"^{t}$".encode() for t in texts]
        raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        for n in GRAMS:
            if len(raw) < n:
                continue
            packed = np.full(len(raw) - n + 1, mark << 3 | n, np.uint64)
            for j in range(n):
                packed = packed << np.uint64(8) | raw[j : len(raw) - n + 1 + j]
            whole = owner[n - 1 :] == owner[: len(raw) - n + 1]
            col = (packed[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            found.append(owner[: len(raw) - n + 1][whole] << BITS | col.astype(np.int64))
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key >> BITS, key & (BUCKETS - 1)


def train(labelled=LABELLED, rounds: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, by full-batch gradient steps with an adaptive rate."""
    parts = [_split(url) for url, _ in labelled]
    where, cols = features([h for h, _ in parts], [p for _, p in parts])
    n = len(parts)
    y = np.array([label for _, label in labelled], float)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(where, minlength=n)))
    w, b, seen = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8)
    for _ in range(rounds):
        z = np.bincount(where, w[cols], n) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) / max(1, n)
        grad = np.bincount(cols, (g * scale)[where], BUCKETS) + penalty * w / max(1, n)
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
        b -= rate * g.sum()
    return w.astype(np.float32), float(b)


def scores(hosts: list[str], paths: list[str], model) -> np.ndarray:
    w, b = model
    where, cols = features(hosts, paths)
    n = len(hosts)
    z = np.bincount(where, w[cols], n) / np.sqrt(np.maximum(1, np.bincount(where, minlength=n))) + b
    return np.exp(-np.logaddexp(0, -z))


def score(host: str, path: str, model) -> float:
    return float(scores([host], [path], model)[0])


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's, null where a rule decides)."""
    model = train(labelled)

    @F.pandas_udf(T.DoubleType())
    def scored(host: pd.Series, path: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=host.index, dtype="Float64")
        for at in range(0, len(host), URLS):
            own = host.iloc[at : at + URLS].dropna()
            if len(own):
                out.loc[own.index] = scores(own.tolist(), path.loc[own.index].tolist(), model)
        return out.where(host.notna())

    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("decided"))
    left = F.col("rule").isNull()
    parts = parts.withColumn("score", scored(F.when(left, F.col("host")), F.when(left, F.col("path"))))
    return parts.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("decided", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES: dict[str, str] = {}
