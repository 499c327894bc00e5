import math
import random
import re
from collections import Counter, defaultdict

import pytest
from lectern.llm import url_filter as uf


def brute(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(r), r, v) for v, r in uf.RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, None)


URLS = [
    "http://a.example.com/en/7198#top", "https://B.Example.COM/en/81?x=/en/", "http://example.net/de/8", "http://example.net/de/9/", "http://net/de/1", "http://xnet/de/1", "http://org/es/", "http://org?/es/",
    "nothing", None, "", "ftp://com/en/", "http://com/en", "a://b://c/d", "http://example.com:80/en/7", "http://q.example.com/EN/7", "http://\nx.com/en/\n5",
]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in uf.filter_urls(df).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if verdict:
            assert got[i]["verdict"] == verdict


def test_templates_generalise_merge_and_reject(spark):
    urls = [f"http://h.org/ads/{w}{i}/item{i}.html" for i in range(40) for w in "ab"] + [f"http://h.org/news/{i}" for i in range(30)] + [f"http://h.org/promo/{i}" for i in range(40)] + [f"http://h.org/tag/{'abcdefghij'[i % 10] * (i + 1)}" for i in range(40)]
    rules = (("block", "h.org/ads/a"), ("allow", "h.org/news/"), ("block", "h.org/promo/1"))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = uf.filter_urls(df, rules).collect()
    assert {r["verdict"] for r in rows if "/ads/b" in r["path"]} == {"block"}
    assert {r["template"] for r in rows if r["path"].startswith("/tag/")} == {"/tag/*"}
    assert {r["verdict"] for r in rows if r["path"].startswith("/tag/") or r["path"].startswith("/news/")} == {"allow"}
    assert {r["template"] for r in rows if r["path"].startswith("/promo/")} == {"/{ads|promo}/*"}


def test_empty_table(spark):
    assert uf.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_every_section_of_enough_pages_stays_literal_at_any_depth(spark):
    """One blocked language of 25 alike, one blocked section of two at the sixth segment, and a branch of more names than are shown."""
    langs = ["en", *(f"{a}{b}" for a in "abcdef" for b in "xyzw")]
    urls = [f"http://x.com/{lang}/p{i}" for lang in langs for i in range(30)]
    deep = [f"http://y.com/a/b/c/d/e/{s}/w{'abcdefghij'[i % 10]}/{i}" for s in ("bad", "good") for i in range(30)]
    wide = [f"http://z.com/s{'abcdefghijklmnopqrstuvwxyz'[k]}/{i}" for k in range(26) for i in range(6)]
    rules = (("block", "x.com/en/"), ("block", "y.com/a/b/c/d/e/bad/wa"), ("block", "z.com/s"))
    df = spark.createDataFrame(list(enumerate(urls + deep + wide)), "page_id long, url string")
    rows = uf.filter_urls(df, rules).collect()
    assert len(rows) == len(urls + deep + wide)
    assert {(r["path"].split("/")[1], r["verdict"], r["template"].split("/")[1]) for r in rows if r["host"] == "x.com"} == {(lang, "block" if lang == "en" else "allow", lang) for lang in langs}
    assert {r["verdict"] for r in rows if "/good/" in r["path"]} == {"allow"}
    assert {r["template"][:12] for r in rows if "/good/" in r["path"]} == {"/a/b/c/d/e/g"}
    assert len({r["template"] for r in rows if r["host"] == "z.com"}) == 1


def plain_filter(urls, rules, purity=0.8, strength=4.0, few=4, many=8, z=1.96, shown=20):
    """(rule, verdict, template) of each url by dictionaries and loops, a level of the tree at a time."""
    looks = re.compile(r"^(?:[^.]*[0-9][^.]*|[0-9a-fA-F-]{16,})(\.[A-Za-z]{1,5})?$")
    rows = []
    for u in urls:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for v, r in rules if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
        segments = [x for x in path.split("/") if x]
        general = ["*" + (m[1] or "") if (m := looks.match(x)) else x for x in segments]
        rows.append([host, segments, general, max(fits)[1:] if fits else (None, None)])
    kinds = defaultdict(set)
    for host, segments, general, _ in rows:
        for i, g in enumerate(general):
            if g.startswith("*"):
                kinds[host, tuple(general[: i + 1])].add(segments[i])
    for r in rows:
        r[2] = tuple(r[1][i] if g.startswith("*") and len(kinds[r[0], tuple(r[2][: i + 1])]) < many else g for i, g in enumerate(r[2]))
    counts = defaultdict(lambda: [0, 0, 0])
    for host, _, general, (_, verdict) in rows:
        for k, x in enumerate((1, verdict is not None, verdict == "block")):
            counts[host, general][k] += x
    prior = min(0.5, sum(c[2] for c in counts.values()) / max(sum(c[1] for c in counts.values()), 1))
    share = lambda c: (c[2] + strength * prior) / (c[1] + strength)
    node, ended, d = {k: "" for k in counts}, set(), 0
    while len(ended) < len(counts):
        live = [k for k in counts if k not in ended]
        child = defaultdict(lambda: [0, 0, 0])
        for k in live:
            if len(k[1]) > d:
                for i in range(3):
                    child[k[0], node[k], k[1][d]][i] += counts[k][i]
        rare = Counter((h, n) for (h, n, _), c in child.items() if c[0] < few)
        literal = {k: c for k, c in child.items() if not k[2].startswith("*") and (c[0] >= few or rare[k[:2]] < many)}
        name = {k: k[2] for k, c in literal.items() if not c[1]}
        by_node = defaultdict(lambda: defaultdict(list))
        for (h, n, seg), c in literal.items():
            if c[1]:
                by_node[h, n][c[1], c[2]].append(seg)
        for (h, n), groups in by_node.items():
            order = sorted(groups, key=lambda g: (share((0, *g)), min(groups[g])))
            branches, last = [], None
            for g in order:
                same = False
                if last:
                    pooled = (g[1] + last[1]) / (g[0] + last[0])
                    same = abs(g[1] / g[0] - last[1] / last[0]) <= z * math.sqrt(pooled * (1 - pooled) * (1 / g[0] + 1 / last[0]))
                if not same:
                    branches.append([])
                branches[-1] += groups[g]
                last = g
            for segs in branches:
                for seg in segs:
                    name[h, n, seg] = seg if len(segs) == 1 else "{" + "|".join(sorted(segs)) + "}" if len(segs) <= shown else ("many", tuple(sorted(segs)))
        d += 1
        for k in live:
            if len(k[1]) >= d:
                seg = k[1][d - 1]
                node[k] += "/" + str(name.get((k[0], node[k], seg), seg if seg.startswith("*") else "*"))
        alone = Counter((k[0], node[k]) for k in live)
        for k in live:
            if len(k[1]) <= d:
                ended.add(k)
            elif alone[k[0], node[k]] == 1:
                node[k] += "/" + "/".join(k[1][d:])
                ended.add(k)
    total = defaultdict(lambda: [0, 0, 0])
    for k, c in counts.items():
        for i in range(3):
            total[k[0], node[k]][i] += c[i]
    return [(rule, verdict or ("block" if share(total[h, node[h, g]]) >= purity else "allow"), node[h, g]) for h, _, g, (rule, verdict) in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_and_templates_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    words = ["en", "de", "shop", "ads", "tag", "v1", "v2", "2024", "a", "b", "c", "list.html"]
    urls = []
    for _ in range(1500):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice([str(rng.randrange(60)), f"item{rng.randrange(9)}.html", "x" * rng.randrange(1, 30)]) for _ in range(rng.randrange(0, 6))]
        urls.append(f"http://{rng.choice(['A.com', 'b.org', 'b.org', 'c.net'])}/{'/'.join(parts)}{rng.choice(['', '/', '?q=1'])}")
    urls += URLS + urls[:40]
    rules = (("block", "a.com/ads"), ("allow", "b.org/en/"), ("block", "b.org/shop/"), ("block", "c.net/tag/1"), ("allow", "com/de"))
    df = spark.createDataFrame([(i, u, "t", "v", 1) for i, u in enumerate(urls)], "page_id long, url string, template string, verdict string, general int").repartition(5)
    got = sorted(uf.filter_urls(df, rules).collect(), key=lambda r: r["page_id"])
    want = plain_filter(urls, rules)
    assert [(r["rule"], r["verdict"]) for r in got] == [w[:2] for w in want]
    assert [r["template"] for r in got] == [w[2] for w in want]


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(i, u, "<html>", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], None, None), (3, URLS[3], "", 2)], "page_id long, url string, html string, host int").write.parquet(f"{tmp_path}/pages.parquet")
    got = uf.op1_url_filter(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:5] == [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]
    rows = got.collect()
    assert sorted((str(r[0]), *r[1:4]) for r in rows) == sorted((str(i), *brute(u)[:3]) for i, u in [*enumerate(URLS), (None, URLS[0]), (3, URLS[3])])
    assert {r["verdict"] for r in rows} <= {"allow", "block"}


def test_long_shared_paths_take_rounds_by_branchings(spark):
    """Two urls of a trap that share 2,000 segments, and a third that leaves them half way, are a few rounds."""
    import time

    trap = ["a"] * 2000
    rows = [(1, "http://x.com/" + "/".join([*trap, "left"])), (2, "http://x.com/" + "/".join([*trap, "right", "end"])), (3, "http://x.com/" + "/".join([*trap[:1000], "b", "c"])), (4, "http://x.com/" + "/".join(trap[:500]))]
    start = time.time()
    got = {r["page_id"]: r["template"] for r in uf.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.time() - start < 90
    assert got == {i: "/" + url.split("/", 3)[3] for i, url in rows}
