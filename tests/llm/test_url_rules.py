from __future__ import annotations

import random
import re

from nearfield.llm import url_rules
from nearfield.llm.registry import PATTERN_RULES, SITE_RULES
from nearfield.llm.url_rules import Rule

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
    fits = []
    for r in rules:
        if r.site:
            name, prefix = r.host, r.text[len(r.host) :]
            ok = (host == name or host.endswith("." + name)) and path.startswith(prefix)
        else:
            ok = re.search(".*".join(map(re.escape, r.text.split("*"))), host + path, re.S) is not None
        if ok:
            fits.append((not r.site, -len(r.text), -len(r.host), r.text, r))
    best = min(fits, key=lambda x: x[:4])[4] if fits else None
    site = best is not None and best.site
    return host, path, best.text if site else None, best.verdict if best else "allow", None if site or not best else best.text


URLS = [
    None, "", "x", "://", "http://", "HTTP://Example.ORG/es/1", "a://b.example.org/en/12?x#y", "a://org/", "a://org", "a://xorg/", "a://x.org?/es/",
    "http://é.org/fr/", "http://EXAMPLE.com/FR/", "http://a.com/fr", "http://a.com/fr/", "http://u@b.com:80/de/", "http://x.com/de/#://org/",
    "http://notexample.org/es/", "http://spam-farm.net/a", "http://my-spam-farm.x.org/a", "http://spam-farmer.net/a", "http://a.net/free-x/y-download", "http://a.net/ads/1",
    "http://a.net/xads/1", "http://a.net\n.org/a\nb/ads/", "http://" + "a." * 3000 + "org/en",
]


def judged(spark, urls, rules):
    rows = [(i, u, "h", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, best int")
    out = url_rules.judge_urls(pages, rules).collect()
    return {r.page_id: tuple(r)[1:] for r in out}


def test_registered_rules(spark):
    got = judged(spark, URLS + URLS[5:8], SITE_RULES + PATTERN_RULES)
    for i, u in enumerate(URLS + URLS[5:8]):
        assert got[i] == brute(u, SITE_RULES + PATTERN_RULES), u


def test_many_rules(spark):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["a", "b", "cc", "d1", "x-y", "É", "net", "org"])
    host = lambda: ".".join(word().lower() for _ in range(rnd.randint(1, 3)))
    path = lambda: "/" + "/".join(word() for _ in range(rnd.randint(0, 3)))
    rules = [Rule(host() + path(), rnd.choice(["allow", "block"])) for _ in range(60)]
    rules = list({r.text: r for r in rules}.values()) + [Rule(word() + "*" + word(), "block", False) for _ in range(10)]
    urls = [f"http://{host()}{path()}" for _ in range(300)]
    got = judged(spark, urls, rules)
    assert [got[i] for i in range(len(urls))] == [brute(u, rules) for u in urls]


def test_no_rows_and_no_rules(spark):
    assert judged(spark, [], SITE_RULES) == {}
    assert judged(spark, ["http://A.org/x"], []) == {0: ("a.org", "/x", None, "allow", None)}


def test_main_path_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_rules.judge_urls(pages, SITE_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan)
