import hashlib
import math
from collections import Counter

from bitloom.llm import urls
from bitloom.llm.queries import QUERIES, URL_RULES

SCHEMA = "page_id long, url string, Host string, html string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def plain_rule(host, path):
    fits = []
    for says, r in URL_RULES:
        own, _, begin = r.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + begin):
            fits.append((len(r), r, says))
    return max(fits)[1:] if fits else (None, None)


def plain_model(good, bad):
    """The ratio of a symbol after its context, by counting contexts directly."""
    def sym(u):
        import re

        u = re.sub(r"^[^:/?#]*://", "", u).lower().translate(str.maketrans("123456789", "0" * 9))
        return "^^^" + re.sub(r"[^a-z0/.\-]", "~", u) + "^"

    def table(some):
        n = Counter()
        for u in some:
            s = sym(u)
            for i in range(3, len(s)):
                for k in range(4):
                    n[s[i - k : i + 1]] += 1
        seen, kinds = Counter(), Counter()
        for g, c in n.items():
            seen[len(g), g[:-1]] += c
            kinds[len(g), g[:-1]] += 1

        def p(g):
            if not g:
                return 1 / 32
            lower, x = p(g[1:]), (len(g), g[:-1])
            return (n[g] + kinds[x] * lower) / (seen[x] + kinds[x]) if seen[x] >= urls.LEAST_SEEN else lower

        return p

    a, b = table(good), table(bad)
    return lambda u: (lambda s: [round((math.log(a(s[i - 3 : i + 1])) - math.log(b(s[i - 3 : i + 1]))) * urls.UNIT) for i in range(3, len(s))])(sym(u))


def test_query_equals_plain_models(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op8_url_filters"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    says = {u: plain_rule(*plain_parts(u))[1] for u in pages.values()}
    held = {u: hashlib.md5(u.encode()).hexdigest()[0] < "4" for u in says}
    assert {(v, held[u]) for u, v in says.items() if v} == {(v, h) for v in ("allow", "block") for h in (True, False)}
    ratio = plain_model(*([u for u in says if says[u] == v and not held[u]] for v in ("allow", "block")))
    scores = {u: math.floor(sum(v := ratio(u)) * 1000 / len(v) / urls.UNIT) for u in says}
    train = [(scores[u], v) for u, v in says.items() if v and held[u]]
    yes, no = sum(v == "allow" for _, v in train), sum(v == "block" for _, v in train)
    threshold = min({s for s, _ in train}, key=lambda t: (sum(v == "allow" and s < t for s, v in train) / yes + sum(v == "block" and s >= t for s, v in train) / no, t))
    off = 0
    for i, u in pages.items():
        r = got[i]
        assert ((r.host, r.path), r.rule) == (plain_parts(u), plain_rule(r.host, r.path)[0])
        off += abs(r.score - scores[u]) > 1
        assert r.verdict == (says[u] or ("allow" if scores[u] >= threshold else "block")) or abs(scores[u] - threshold) <= 1
    assert not off


def test_odd_rows(spark):
    rows = [
        (1, "http://A.Example.com/en/7x?q#f", None, None), (1, "http://A.Example.com/en/7x?q#f", None, None), (2, None, "h", None), (3, "", None, None), (4, "no scheme/en/", None, None),
        (5, "x://example.net?en", None, None), (6, "http://example.net/de/8/" + "é" * 20_000, None, None), (None, "http://notexample.com/en/7", None, None), (8, "http://Éxample.org/es/", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = urls.judge(df, URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, *_ in rows:
        assert (by[i].host, by[i].path) == plain_parts(u) and by[i].rule == plain_rule(by[i].host, by[i].path)[0] and by[i].url == u
    assert by[1].verdict == "allow" and by[6].verdict == "block" and by[None].rule == "com/en/"
    assert {r.verdict for r in urls.judge(df.where("page_id in (2, 3)"), URL_RULES).collect()} == {"allow"}
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def test_a_url_that_crowds_the_table(spark):
    """A third of the rows has one URL, another third none: they are joined apart, and fare as alone."""
    df = spark.createDataFrame([(k, f"http://h{k % 97}.{'com' if k % 2 else 'net'}/{'en' if k % 3 else 'de'}/{k}") for k in range(2000)], "page_id long, url string")
    crowd = spark.range(60_000).selectExpr("id + 10000 as page_id", "if(id % 2 = 0, 'http://hot.fr/x', null) as url")
    both = df.unionByName(crowd).repartition(8)
    one = {r.page_id: (r.verdict, r.score) for r in urls.judge(df.unionByName(crowd.where("page_id < 10002")), URL_RULES).collect()}
    got = urls.judge(both, URL_RULES)
    assert got.count() == 62_000
    kinds = got.where("page_id >= 10000").groupBy("url", "verdict", "score").count().collect()
    assert {(r.url, r.verdict, r.score): r["count"] for r in kinds} == {("http://hot.fr/x", *one[10000]): 30_000, (None, *one[10001]): 30_000}
