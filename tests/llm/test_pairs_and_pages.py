"""SimHash, components, top-k, url rules, html and the pipeline against brute force."""

import collections
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import html_text, simhash, topk, url_rules
from corpusloom.llm.components import components

from .conftest import ROWS


# -- op5 -----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, fps):
    """Smallest id of everything that is reachable."""
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for k, i in enumerate(ids):
        least[find(k)].append(i)
    return [min((x for x in least[find(k)] if x is not None), default=None) for k in range(len(ids))]


def test_fingerprints_and_groups_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd.withColumn("component_id", F.lit("clash"))).collect()
    assert len(rows) == len(ROWS) and "lang" in rows[0].asDict()
    fps = [slow_fingerprint(r[1]) for r in ROWS]
    want = sorted((str(r[0]), f"{f:016x}", g) for r, f, g in zip(ROWS, fps, groups([r[0] for r in ROWS], fps)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows) == want
    assert simhash.near_duplicates(none).count() == 0


def planted(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 8, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for c, k in zip(rng.choice(centres, n), rng.integers(1, 5, n))]
    return np.unique(np.concatenate([near, centres, rng.integers(0, 2**63, n, dtype=np.uint64)]).astype(np.uint64))


@pytest.mark.parametrize("seed", range(3))
def test_index_finds_every_pair(seed):
    fps = planted(300, seed)
    bucket = np.sort(np.random.default_rng(seed).integers(0, 20, len(fps)))
    order = np.lexsort((simhash.gray_rank(fps), bucket))
    f = fps[order]
    got = set()
    for i, j in simhash.GrayIndex(bucket, f).pairs(frontier=700):
        got |= set(zip(i.tolist(), j.tolist()))
    d = np.bitwise_count(f[:, None] ^ f[None]) <= 3
    same = bucket[:, None] == bucket[None]
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(d & same, 1)))}


def test_upper_nodes_prune_groups_and_links_are_skipped():
    rng = np.random.default_rng(8)
    fps = np.unique(rng.integers(0, 2**63, 8192, dtype=np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps), kind="stable")]
    index = simhash.GrayIndex(np.zeros(len(fps), np.int64), fps)
    assert len(list(index.pairs())) == 0 and len(index.levels) == 4
    # leaf nodes are left for the bits that their rows share, and groups of them before that
    assert index.told["cut", 0] > 0.5 * index.told["looked", 0] and index.told["cut", 1] > 0.05 * index.told["looked", 1]
    assert index.told["looked", -1] < 0.4 * len(fps) ** 2
    ball = planted(600, 2)
    ball = ball[np.argsort(simhash.gray_rank(ball), kind="stable")]
    bucket = np.zeros(len(ball), np.int64)
    every, linked = simhash.GrayIndex(bucket, ball), simhash.GrayIndex(bucket, ball)
    want = np.arange(len(ball))
    for i, j in every.pairs():
        want = simhash.join_roots(want, i, j)
    assert linked.linked(frontier=100).tolist() == want.tolist() and linked.told["looked", -1] < every.told["looked", -1]


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_similar_documents_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for g in range(40):
        base = rng.choice(vocabulary, int(rng.integers(60, 400))).tolist()
        texts.append(base)
        for change in (0.005, 0.01, 0.02, 0.2):
            copy = list(base)
            for i in rng.choice(len(copy), max(1, int(change * len(copy))), replace=False):
                copy[i] = str(rng.choice(vocabulary))
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + [" ".join(texts[0]).upper()]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    share, most = simhash.differing(0.8)
    wide = np.array([simhash.wide_fingerprint(t) for t in texts], np.uint64)
    apart = np.bitwise_count(wide[:, None] ^ wide[None]).sum(2)
    similar = {(i, j): jaccard(texts[i], texts[j]) for i, j in itertools.combinations(range(len(texts)), 2) if apart[i, j] < 100}
    alike = [p for p, x in similar.items() if x >= 0.8]
    assert len(alike) > 100 and sum(got[i] == got[j] for i, j in alike) >= 0.9 * len(alike)
    # nothing is joined but over links that the fingerprints allow, and those are of similar texts
    reach = simhash.join_roots(np.arange(len(texts)), *np.nonzero(apart <= most))
    assert all(got[i] == got[j] <= i for i, j in alike if got[i] == got[j]) and all(reach[i] == reach[got[i]] for i in got)
    assert min(similar[p] for p in similar if apart[p] <= most) > 0.65


def test_similar_documents_of_odd_rows(spark, odd, none):
    rows = simhash.similar_documents(odd.withColumn("component_id", F.lit("clash"))).collect()
    assert len(rows) == len(ROWS) and set(rows[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "component_id"}
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert (got[1], got[6], got[2], got[3], got[4], got[5], got[None]) == (1, 1, 2, 2, 2, 5, None)
    assert simhash.similar_documents(none).count() == 0


def test_columns_of_internal_names_stay(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, fp int, root string")
    got = simhash.near_duplicates(df).orderBy("doc_id").collect()
    assert [(r["fp"], r["root"], r["component_id"]) for r in got] == [(5, "x", 1), (6, "y", 1)]


def test_gray_rank():
    x = np.arange(16, dtype=np.uint64)
    assert simhash.gray_rank(x ^ (x >> np.uint64(1))).tolist() == list(range(16))


@pytest.mark.parametrize("most", [4096, 30])
def test_links_lose_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", most)  # 30: crowded buckets are dealt out again
    fps = planted(400, 5)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    want = groups(fps.view(np.int64).tolist(), [int(x) for x in fps])
    assert [found.get(x, x) for x in fps.view(np.int64).tolist()] == want


@pytest.mark.parametrize("most", [1 << 18, 0])  # 0: steps on tables
def test_components_of_paths_and_stars(spark, monkeypatch, most):
    from corpusloom.llm import components as module

    monkeypatch.setattr(module, "TASK_EDGES", most)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- op9 -----------------------------------------------------------------------------------------------------------


def slow_top(rows, queries, k):
    out = []
    for qi, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qi and len(v) == len(q))
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize(("scale", "sizes"), [(5, (1024, 16384)), (5, (7, 40)), (3_000_000, (1024, 16384))])
def test_top_k(spark, scale, sizes):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-scale, scale, 40).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(400, [1, 2]), (401, [3, 4]), (402, [])]
    df = spark.createDataFrame(rows + [(500, None), (None, [1] * 40), (501, [1] * 39 + [None])], "vec_id long, vector array<long>").withColumn("score", F.lit("clash"))
    got = topk.top_k(df, df.filter("vec_id % 20 = 0"), 7, query_rows=sizes[0], candidate_rows=sizes[1])
    assert sorted(map(tuple, got.collect())) == sorted(slow_top(rows, [r for r in rows if r[0] % 20 == 0], 7))


@pytest.mark.parametrize("clustered", [False, True])
def test_survivors_are_moved_together(clustered):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    if clustered:
        x += 3 * rng.standard_normal((20, 64))[rng.integers(0, 20, 3000)]
    x = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    told, ids = collections.Counter(), np.arange(3000)
    got = {i: (who.tolist(), score.tolist()) for i, who, score in topk.block_top(ids[:100], x[:100], ids, x, 20, told)}
    scores = x[:100] @ x.T
    for i in range(100):
        scores[i, i] = -(10**9)
        order = np.lexsort((ids, -scores[i]))[:20]
        assert got[i] == (order.tolist(), scores[i, order].tolist())
    assert told["compacted"] > 0 and told["pairs"] == 100 * 3000
    alive = [told[f"after {d}"] for d in range(16, 65, 8)]
    assert alive == sorted(alive, reverse=True) and alive[-2] < 0.3 * told["pairs"] and (not clustered or alive[2] < 0.5 * told["pairs"])


def test_lengths_alone_rule_out():
    x = np.concatenate([np.full((600, 16), 50), np.full((9000, 16), 1)])
    told = collections.Counter()
    list(topk.block_top(np.array([-1]), np.full((1, 16), 3), np.arange(len(x)), x, 5, told))
    assert told["by length"] >= 4096


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert topk.top_k(df, df).count() == 0


# -- op10 ----------------------------------------------------------------------------------------------------------


def slow_rule(url, rules):
    host, path = url_rules.split_url(url)
    fit = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), len(r.host)), default=None)


URLS = [None, "", "no-scheme.com/en/", "http://A.Example.com/en/77?x", "https://example.com", "https://example.com/en/7", "http://net/de/1#y", "ftp://a.b.example.net/de/8", "x://org/es/", "x://notorg/es/", "x:///en/", "x://com/en/", "a://b://com/en/", "x://com./en/"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.builds(lambda h, p: f"http://{h}{p}", st.sampled_from(["com", "a.com", "b.a.com", "acom", "net", ""]), st.sampled_from(["", "/", "/e", "/en/7", "/en/7/x", "/de"])), max_size=8))
def test_sweep_against_brute_force(urls):
    rules = [url_rules.Rule(v, h, p) for v, h, p in [("block", "com", "/e"), ("allow", "a.com", "/en"), ("block", "a.com", "/en/7"), ("allow", "com", ""), ("block", "b.a.com", "/"), ("allow", "net", "/en/7")]]
    keyed = sorted((url_rules.canonical(r.host, r.path), i) for i, r in enumerate(rules))
    got = url_rules.judge(urls, rules, keyed, "allow")
    assert got["rule"] == [r and r.text for r in (slow_rule(u, rules) for u in urls)]


def test_verdicts_of_the_contracts_rules(spark, tmp_path):
    want = {
        "http://a.com/en/": ("com/en/", "block"),
        "http://a.example.com/en/70": ("example.com/en/7", "allow"),
        "http://example.com/en/6": ("com/en/", "block"),
        "http://a.example.net/de/7": ("net/de/", "allow"),
        "http://a.net/de/8": ("net/de/", "allow"),
        "http://a.example.net/de/8": ("example.net/de/8", "block"),
        "http://a.org/es/1": ("org/es/", "block"),
        "http://a.org/en/1": (None, "allow"),
    }
    spark.createDataFrame([(i, u, "") for i, u in enumerate(want)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = url_rules.op10_url_filters(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == list(want.values())


@pytest.mark.parametrize("shipped", [1 << 20, 1])
def test_url_filters(spark, shipped):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(list(url_rules.RULES), "verdict string, host string, path string")
    want = [(i, *url_rules.split_url(u), (r := slow_rule(u, url_rules.RULES)) and r.text, r.verdict if r else "allow") for i, u in enumerate(URLS + URLS)]
    for given_rules in (url_rules.RULES, rules):
        got = url_rules.filter_urls(pages, given_rules, shipped_bytes=shipped).select("page_id", "host", "path", "rule", "verdict")
        assert sorted(map(tuple, got.collect())) == want
    assert url_rules.filter_urls(pages.limit(0), rules, shipped_bytes=shipped).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_shipped_and_ranged_rules_agree(spark, seed):
    rng = np.random.default_rng(seed)
    hosts = ["com", "a.com", "b.a.com", "A.com.", "bÄ.com", "bä.com", ".net", "x.net", "", "org"]
    paths = ["", "/", "/a", "/a/b", "/ab", "/a/b/c/d", "/ä"]
    rules = [(str(rng.choice(["allow", "block"])), str(rng.choice(hosts)), str(rng.choice([*paths, None])) if rng.random() < 0.9 else None) for _ in range(40)]
    rules = [(v, h, None if p == "None" else p) for v, h, p in rules] + [("allow", None, "/"), ("allow", "org", "/a"), ("block", "org", "/a")]
    urls = [f"http://{h}{p}{x}" for h in ("com", "z.a.com", "b.a.com", "A.COM", "bÄ.com", "q.bä.com", "x.net", "org", "a.org", "") for p in paths for x in ("", "?q", "/z")] + [None, "", "x", "http://com/a"] * 3
    pages = spark.createDataFrame([(i, u, "v", "clash") for i, u in enumerate(urls)], "page_id long, url string, v string, u string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    ship, ranged = (sorted(map(tuple, url_rules.filter_urls(pages, table, shipped_bytes=n).collect())) for n in (1 << 20, 1))
    assert ship == ranged and len({r[-2] for r in ship}) > 6
    known = url_rules.distinct_rules(url_rules.Rule(v, h, p or "") for v, h, p in rules if h)
    by_text = {r.text: r for r in known}
    for r in ship:
        want = slow_rule(r[1], known)
        assert (r[-2] and len(r[-2])) == (want and len(want.text)) and (r[-2] is None or by_text[r[-2]].verdict == r[-1] or sum(x.text == r[-2] for x in known) > 1)


# -- op6 -----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<div id="top-nav"><a href="/">Home</a></div><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="left"><p>Fixed words of the site</p></div><div class="story"><h2>{0} &amp; more</h2><p>{1}<br>and   on<p>{2} <b>bold</b>&nbsp;end<ul><li>one<li>two</ul><form><input><label>Mail</label></form><p hidden>no</p></div></div>
<section class="comments"><p>Nice!</p></section><aside>Ads</aside><footer>&copy; us</footer></body></html>"""


def page(i):
    return PAGE.format(f"Title {i}", f"First paragraph number {i} says this", f"Second {i * 7}")


def test_induced_wrapper_keeps_what_varies(spark):
    want = lambda i: f"Title {i} & more\nFirst paragraph number {i} says this and on\nSecond {i * 7} bold end\none\ntwo"
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(5)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [want(i) for i in range(5)]
    marked = [(i, u, h.replace('<div class="story">', "<article>").replace("</div></div>", "</article></div>")) for i, u, h in rows]
    got = html_text.extract_text(spark.createDataFrame(marked, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [want(i) for i in range(5)] and [r["n_chars"] for r in got] == [len(want(i)) for i in range(5)]


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}


def test_blocks_of_a_host_within_marked_articles(spark):
    box = "<div class=bio><p>Written by the same team</p></div>"
    rows = [(i, f"http://h/{i}", f"<article><h2>News {i}</h2><p>Text {i} of it</p><p>{'a shared line' if i % 5 == 0 else i}</p>{box}</article>") for i in range(20)]
    # few pages tell nothing, nor do copies of one page
    rows += [(100 + i, f"http://few/{i}", f"<article><p>Text {i}</p>{box}</article>") for i in range(5)]
    rows += [(200 + i, f"http://copies/{i}", "<article><p>One text</p></article>") for i in range(12)]
    # different pages around one article
    rows += [(300 + i, f"http://same/{i}", f"<p>{i}</p><article><p>One text</p></article>") for i in range(12)]
    got = extracted(spark, rows)
    assert [got[i] for i in range(20)] == [f"News {i}\nText {i} of it\n{'a shared line' if i % 5 == 0 else i}" for i in range(20)]
    assert [got[100 + i] for i in range(5)] == [f"Text {i}\nWritten by the same team" for i in range(5)]
    assert {got[200 + i] for i in range(12)} | {got[300 + i] for i in range(12)} == {"One text"}


def test_layouts_of_one_host_and_near_copies(spark):
    page = lambda i, k: f"<div class=l{k}><div class=box{k}><p>Fixed words of layout {k}</p></div><div class=body{k}><p>First {i} of the text</p><p>Second {i}</p></div></div>"
    rows = [(i, f"http://h/{i}", page(i, i % 3)) for i in range(36)]
    long = "<p>A long first paragraph that both have</p><p>Another long paragraph that both have</p>"
    rows += [(100 + i, f"http://two/{i}", f"<div>{long}<p>End {i}</p></div>") for i in range(2)]
    got = extracted(spark, rows)
    assert [got[i] for i in range(36)] == [f"First {i} of the text\nSecond {i}" for i in range(36)]
    assert [got[100 + i] for i in range(2)] == [f"A long first paragraph that both have\nAnother long paragraph that both have\nEnd {i}" for i in range(2)]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "plain text"), (4, "http://a/", "<p>a<p>b"), (4, "http://a/", "<p>a<p>b"), (5, "http://a/", "<!-- <p>x</p> --><script>p</script>"), (6, "http://a/", "</p></div><p>" + "w " * 50000 + "<"), (7, "http://b/", "<article><p>&lt;b&gt; &#65;&eacute;</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html_text.extract_text(df).orderBy("page_id").collect()]
    assert got[:4] == [(1, ""), (2, ""), (3, "plain text"), (4, "a\nb")] and got[5] == (5, "") and got[6][1].startswith("w w") and got[7] == (7, "<b> Aé")
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_hostile_pages():
    assert html_text.main_text("<div>" * 5000 + "x" + "</div>" * 5000 + "y", []).split("\n")[0] == "x"
    assert html_text.main_text("<a" * 100000, []) != ""
    assert html_text.main_text('<p title="a > b">t</p><p>5 < 6 and 7 > 3</p>', []) == "t\n5 < 6 and 7 > 3"
    html_text.main_text("</" * 50000 + "<script>" * 3000, ["<b>" * 3000])


def test_the_wrapper_decides(spark):
    # nothing is named or marked: menu, notice and foot differ from page to page less than the text does
    lines = lambda i, k: [f"Line {j} of text {i} goes on and on" for j in range(k)]
    page = lambda i: f"<body><div class=a><a href=x>Go {i}</a><a href=y>Stay {i}</a></div><div class=b>Seen {i} times</div><div class=c><h2>Head {i}</h2><div class=d>{''.join(f'<p>{x}</p>' for x in lines(i, 3 + i % 3))}<p>Written by the staff</p></div></div><div class=e>All rights of {i}</div></body>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(14)]
    got = extracted(spark, rows)
    assert [got[i] for i in range(14)] == ["\n".join([f"Head {i}", *lines(i, 3 + i % 3)]) for i in range(14)]
    # without other pages all of it is one text
    alone = extracted(spark, [(0, "http://alone/", page(0))])[0].split("\n")
    assert alone[0] == "Go 0Stay 0" and alone[-1] == "All rights of 0" and "Written by the staff" in alone
    # copies of the page say nothing either
    assert extracted(spark, [(i, "http://alone/", page(0)) for i in range(12)])[5].split("\n") == alone


def test_names_that_mean_something_else():
    text = lambda names: html_text.main_text(f"<article><p>One</p><div class='{names}'>Two</div><p>Three</p></article>")
    assert {n: "Two" in text(n) for n in ("social history", "form-of-verse", "notice-board", "ad", "ad-box x7", "post-comments", "sidebar left", "cookie_notice", "relatedPosts")} == {
        "social history": True, "form-of-verse": True, "notice-board": True, "ad": False, "ad-box x7": False, "post-comments": False, "sidebar left": False, "cookie_notice": False, "relatedPosts": False,
    }
    # but an element with such a name that every page has is no part of the text
    page = lambda i: f"<article><p>One {i} more</p><p>Of the text {i * 31}</p><div class='social history'>Like {i}</div></article>"
    assert html_text.main_text(page(0), [page(i) for i in range(1, 12)]) == "One 0 more\nOf the text 0"


def test_deep_and_wide_pages():
    deep = lambda i: "<div>" * 3000 + f"<p>Text {i}</p><div class=ad>no</div>" + "</div>" * 3000 + "<footer>f</footer>"
    assert html_text.main_text(deep(1)) == html_text.main_text(deep(1), [deep(2)]) == "Text 1"
    wide = lambda i: "<div class=m>" + "".join(f"<p>{'same' if j % 2 else i * 10**6 + j}</p>" for j in range(2500 + i)) + "</div><div class=foot>same foot</div>"
    got = html_text.main_text(wide(1), [wide(2)]).split("\n")
    assert len(got) == 2501 and "same foot" not in got


def slow_match(a, b):
    """Simple tree matching as it is defined."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + slow_match(x, y))
    return m[-1][-1] + 1


trees = st.recursive(st.tuples(st.sampled_from("pq"), st.just(())), lambda t: st.tuples(st.sampled_from("pqr"), st.lists(t, max_size=4).map(tuple)), max_leaves=10)


def as_skeleton(t):
    key, parent = [], []

    def add(n, up):
        key.append(ord(n[0]))
        parent.append(up)
        me = len(key) - 1
        for c in n[1]:
            add(c, me)

    add(t, -1)
    n = len(key)
    return html_text.Skeleton(np.array(key), np.array(parent), np.arange(n) % 3, np.ones(n, int), np.ones(n, np.int8))


@pytest.mark.parametrize("cells", [1 << 21, 2])  # 2: lists of siblings are aligned in halves
@settings(max_examples=150, deadline=None)
@given(a=trees, b=trees)
def test_tree_matching(cells, a, b):
    kept, html_text.CELLS = html_text.CELLS, cells
    try:
        x, y = as_skeleton(a), as_skeleton(b)
        pairs = list(html_text.Matching(x, y).pairs())
        assert html_text.Matching(x, y).best(0, 0) == slow_match(a, b) == len(pairs)
        at = dict(pairs)
        assert len(set(at.values())) == len(at) == len(pairs)
        assert all(i == 0 or at.get(x.parent[i]) == y.parent[j] for i, j in pairs) and [at[i] for i in sorted(at)] == sorted(at.values())
    finally:
        html_text.CELLS = kept


def slow_text(pages, i):
    """The wrapper by definition on pages of one layout that are a flat list of (class, text) blocks in a body, with different classes."""
    reference = min(range(len(pages)), key=lambda k: pages[k][0])
    told, same, mass = collections.Counter(), collections.Counter(), collections.Counter()
    voted = 0
    for k, (_, blocks) in enumerate(pages):
        if k == reference:
            continue
        other = dict(pages[reference][1])
        agreed = sum(len(t) for c, t in blocks if other.get(c) == t)
        if agreed > 0.8 * sum(len(t) for _, t in blocks):
            continue
        voted += 1
        for c, t in blocks:
            told[c] += c in other
            same[c] += other.get(c) == t
            mass[c if c in other else ""] += other.get(c) != t and len(t)
    template = {c for c in told if told[c] >= 8 and same[c] >= 0.5 * told[c]}
    kept = [t for c, t in pages[i][1] if not (sum(mass.values()) and c in template and c in dict(pages[reference][1]))]
    return "\n".join(kept or [t for _, t in pages[i][1]])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("klmnop"), st.sampled_from(["x", "y", "a longer text", "another one"]), min_size=1), min_size=1, max_size=16))
def test_extraction_against_brute_force(spark, kinds):
    built = [sorted(k.items()) for k in kinds]
    html = ["<body>" + "".join(f"<p class={c}>{t}</p>" for c, t in b) + "</body>" for b in built]
    df = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    hashes = {r["page_id"]: r["h"] for r in df.select("page_id", F.xxhash64("html").alias("h")).collect()}
    pages = [(hashes[i], b) for i, b in enumerate(built)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    # copies of the reference say nothing: they are no pages of their own
    least = min(hashes.values())
    seen, unique = False, []
    for h, b in pages:
        if h != least or not seen:
            unique.append((h, b))
        seen |= h == least
    assert got == {i: slow_text(unique, [u for u, _ in unique].index(h)) for i, (h, b) in enumerate(pages)}


# -- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from corpusloom.llm.common import table

    from .test_texts import brute_lines

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    names = [n for n, _ in pipeline.STAGES]
    assert names[0].startswith("quality") and len(names) == 4
    kept = pipeline.STAGES[0][1](spark, docs, d)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    lines = [(i, t) for i, t, _, _ in brute_lines(rows)]
    fps = [slow_fingerprint(t) for _, t in lines]
    heads = [(i, t) for (i, t), g in zip(lines, groups([i for i, _ in lines], fps)) if i == g]
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: len(sp.encode(t)) + 2 for i, t in heads}
    got = collections.defaultdict(int)
    for r in pipeline.run(spark, d).collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert got == want
