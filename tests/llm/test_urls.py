"""URL filters: parsing and stated rules in plain Python, mined rules by counting all combinations."""

import re
from collections import Counter
from itertools import combinations

from duochron.llm import plans, urls

SF = "/root/testdata/sf0.01"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def stated(host, path):
    fits = [(h + p, v) for h, p, v in plans.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def mined(rows, support, confidence):
    """rows: (tokens, label) -> {(tokens): (label, confidence, support)} by counting every combination."""
    n, of, whole = len(rows), Counter(), Counter()
    for tokens, label in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                whole[c] += 1
                of[c, label] += 1
    # as Spark: a combination with its label reaches the support
    least = -(-support * n // 1)
    rules = {(c, v): (k / whole[c], k / n) for (c, v), k in of.items() if k >= least and k / whole[c] >= confidence}
    drop = {(c, v) for (c, v), (p, _) in rules.items() if len(c) > 1 and any(rules.get((tuple(x for x in c if x != t), v), (0,))[0] >= p for t in c)}
    return {k: r for k, r in rules.items() if k not in drop}


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    rows = [(r.page_id, r.url, r.t) for r in pages.select("*", urls.tokens_of("url").alias("t")).collect()]
    labelled = [(t, v) for _, u, t in rows for v in [stated(*parts(u))[1]] if v]
    rules = mined(labelled, urls.MIN_SUPPORT, urls.MIN_CONFIDENCE)
    want = []
    for i, u, t in rows:
        host, path = parts(u)
        rule, verdict = stated(host, path)
        if not rule:
            fit = [(p, len(c), s, v == "allow", c, v) for (c, v), (p, s) in rules.items() if set(c) <= set(t)]
            verdict = max(fit)[-1] if fit else "allow"
        want.append((i, host, path, rule, verdict))
    out = plans.QUERIES["op2_urls"](spark, SF).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out) == sorted(want)
    assert {r.by for r in out} >= {"stated", "mined"}


ODD = [
    None, "", "no scheme/en/", "http://", "http://NET/", "http://net", "https://a.NET/x?y#z", "http://example.net/en/1.html", "http://sub.example.net/en/", "http://example.net/en", "x://y://net/", "http://xnet/", "http://a.org/fr/?q=1&q=2", "http://ÀB.org/fr/",
    "http://example.com/de/#f", "http://h?net/", "http://h#/net/", "http://net\n/x", "http://" + "a." * 3000 + "net/" + "long/" * 3000, "http://u:p@Example.Com:80/de/",
]


def test_odd_rows(spark):
    rows = [(None if i == 4 else i, u, "z") for i, u in enumerate(ODD * 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    out = urls.judged(df, plans.URL_RULES).collect()
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in out)
    assert got == sorted((str(i), *parts(u), str(stated(*parts(u))[0])) for i, u, _ in rows)
    assert all(r.verdict == stated(r.host, r.path)[1] for r in out if r.rule) and all(r.verdict in ("allow", "block") for r in out)
    assert urls.judged(df.limit(0), plans.URL_RULES).count() == 0
    assert {r.verdict for r in urls.judged(df.where("page_id < 4"), plans.URL_RULES).collect()} == {"allow"}


def test_mined_rule_carries_over(spark):
    rows = [(i, f"http://bad{i % 5}.net/spam/{i}") for i in range(50)] + [(100 + i, f"http://good{i}.org/fr/{i}") for i in range(50)] + [(200, "http://other.com/spam/1"), (201, "http://other.com/x")]
    out = urls.judged(spark.createDataFrame(rows, "page_id bigint, url string"), plans.URL_RULES).where("page_id >= 200").collect()
    assert {(r.page_id, r.verdict) for r in out} == {(200, "block"), (201, "allow")}
