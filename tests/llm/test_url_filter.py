import fnmatch
import random

from ledgerlight.llm import url_filter as U


def judge(url):
    """The contract's site rules, one by one."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for _, rule, verdict in U.SITE_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, *(best or (None, None))


URLS = [None, "", "no scheme/es/", "http://", "http://org", "http://org/", "HTTP://A.ORG/x", "http://notorg/", "http://x.org?q=/",
        "https://example.org/es/1", "https://EXAMPLE.org/en/12", "https://example.org/en/2", "https://badexample.org/es/",
        "https://a.b.example.org/en/1#f", "http://s.com/fr/", "http://s.com/de/x?y", "http://s.com/de", "http://com/de/",
        "ftp://é.org/ü", "http://x.net/pixel.gif", "http://ads.x.net/a", "http://badads.x.net/a", "http://x.net/banner/7/click?z",
        "http://x.net/" + "a" * 20000 + "/adserver/", "http://x.net/a://org/", "http://x.org\n/es/"]


def test_site_rules_like_brute_force(spark):
    rng = random.Random(3)
    urls = URLS + ["".join(rng.choice(["http://", "org", "example", ".", "/", "es", "en", "1", "com", "fr", "?", "#", "E"])
                           for _ in range(rng.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in U.filter_urls(df, U.SITE_RULES + U.PATTERN_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = judge(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        if rule:
            assert got[i].verdict == verdict, url


def test_patterns(spark):
    rules = [("pattern", "||ads.", "block"), ("pattern", "/banner/*/click^", "block"), ("pattern", "|http://ab", "block"),
             ("pattern", ".gif|", "block"), ("pattern", "good", "allow"), ("pattern", "a+b", "block")]
    cases = {"http://ads.x/": "||ads.", "http://w.ads.x/": "||ads.", "http://bads.x/": None,
             "http://x/banner/1/2/click": "/banner/*/click^", "http://x/banner/1/clicks": None, "http://ab": "|http://ab",
             "http://x/i.GIF": ".gif|", "http://x/i.gif?": None, "http://x/good/i.gif": "good", "http://x/aab": None,
             "http://x/a+b": "a+b"}
    df = spark.createDataFrame([(u,) for u in cases], "url string").selectExpr("url as page_id", "url")
    got = {r.page_id: r for r in U.filter_urls(df, rules).collect()}
    for url, pattern in cases.items():
        assert got[url].pattern == pattern, url
        assert got[url].verdict == ("block" if pattern and pattern != "good" else "allow")


def test_longest_rule_and_ties(spark):
    rules = [("site", "a.b/x/", "allow"), ("site", "a.b/x/", "block"), ("site", "b/", "allow")]
    df = spark.createDataFrame([(1, "s://a.b/x/1"), (1, "s://a.b/x/1"), (2, "s://c.b/")], "page_id long, url string")
    rows = sorted(tuple(r)[:5] for r in U.filter_urls(df, rules).collect())
    assert rows == [(1, "a.b", "/x/1", "a.b/x/", "block")] * 2 + [(2, "c.b", "/", "b/", "allow")]


def test_rules_as_table_and_empty(spark):
    rules = U.rule_table(spark, U.SITE_RULES)
    df = spark.createDataFrame([(1, "s://x.org/", "extra", "h")], "page_id long, url string, verdict string, token string")
    assert U.filter_urls(df, rules).first().rule == "org/"
    assert U.filter_urls(df, []).first().verdict == "allow"
    assert U.filter_urls(df.limit(0), U.SITE_RULES).count() == 0


def test_only_candidates_run_regexes(spark):
    """A rule is fetched by its rarest token: with no URL holding it, nothing reaches the regular expressions."""
    compiled = U.compile_rules(U.rule_table(spark, [("site", "example.org/en/1", "block"), ("pattern", "ab*", "block")]))
    tokens = {r.pattern: r.tokens for r in compiled.collect()}
    assert tokens == {"example.org/en/1": ["example", "org", "en"], "ab*": []}
    assert fnmatch.fnmatch("ab1", "ab*")
