from __future__ import annotations

from tastemill.llm import url_model as U

URLS = [
    "http://a.example.net/en/1", "http://example.net/en/", "http://x.net/en/1", "http://net/", "http://x.net", "http://x.net?q=/en/",
    "https://WWW.Example.COM/de/7#top", "https://example.com/DE/7", "https://b.org/fr/1", "https://notorg/fr/", "https://b.org/en",
    None, "", "no scheme", "ftp://É.net/x", "http://casino-win.example.com/en/5", "http://blog.tionsh.example.com/en/5",
    "a://b://c.net/", "http://example.net.org/fr/x?y#z", "http://\nq.net/a\nb",
]


def brute(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url[url.index("://") + 3 :]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for action, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return host, path, best


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(k, u, 0.5) for k, u in enumerate(URLS)] + [(None, URLS[0], 0.1)], "page_id long, url string, score double")
    model = U.train()
    rows = {r.page_id: r for r in U.judge(pages).collect()}
    assert len(rows) == len(URLS) + 1
    for k, u in enumerate(URLS):
        host, path, best = brute(u)
        r = rows[k]
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None), u
        assert (r.score is None) == (best is not None)
        assert r.verdict == (best[0] if best else "block" if U.score(host, path, model) >= 0.5 else "allow")
    assert U.judge(pages.limit(0)).count() == 0


def test_model_generalises():
    model = U.train()
    for url in ("https://m.casino-win.example.com/en/3413", "https://free-bets.example.com/en/5462", "https://www.cheap-pills.example.com/de/66"):
        assert U.score(*U._split(url), model) > 0.6
    for url in ("https://www.ththing.example.org/en/1291/", "http://blog.tionsh.example.com/fr/7424.html", "https://m.ththnd.example.org/es/3"):
        assert U.score(*U._split(url), model) < 0.4


def test_held_out_urls():
    """Of each word's three urls the last, of another host and path, is kept from training."""
    rows = U.labelled_urls()
    model = U.train([row for k, row in enumerate(rows) if k % 3 != 2])
    right = [(U.score(*U._split(u), model) >= 0.5) == bool(y) for u, y in rows[2::3]]
    assert sum(right) / len(right) > 0.9


def test_batch_equals_a_plain_model():
    import math
    import random

    w, b = U.train()
    rnd = random.Random(2)
    urls = [("".join(rnd.choices("abc.-é", k=rnd.randint(0, 12))), "".join(rnd.choices("/ab1", k=rnd.randint(0, 9)))) for _ in range(200)]

    def column(mark, gram):
        packed = mark << 3 | len(gram)
        for c in gram:
            packed = (packed << 8 | c) % 2**64
        return (packed * 0x9E3779B97F4A7C15 % 2**64) >> (64 - U.BITS)

    for (h, p), got in zip(urls, U.scores([h for h, _ in urls], [p for _, p in urls], (w, b)), strict=True):
        cols = {column(m, t[k : k + n]) for m, t in ((1, f"^{h}$".encode()), (2, f"^{p}$".encode())) for n in U.GRAMS for k in range(len(t) - n + 1)}
        z = sum(float(w[c]) for c in cols) / math.sqrt(max(1, len(cols))) + b
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-6
