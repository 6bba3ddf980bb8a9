"""Secrets, contamination, urls, pages, top-k, mixing and quality on small fixtures."""

import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.llm import contamination, mixing, pages, quality, secrets, topk, urls

TOKEN = "0123456789abcdef0123456789abcdef01234567"


def brute_secrets(text):
    kinds = [("assign", secrets.ASSIGN.replace("(?i:", "(?i:"), 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    found = []
    for k, (kind, rx, group, least) in enumerate(kinds):
        for m in re.finditer(rx, text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(found))


TEXTS = [
    f'token = "{TOKEN}" and PASSWORD:hunter22', "token=token\": value1234", "secret=abc token=abcdef api_key: 'zzzzzz'", "é password=ünot passwd=abcdef12", "AKIA" + "A" * 16 + "AKIAAKIA" + "B" * 12,
    "AKIASHORT1", "x" + TOKEN[:24] + "g" + TOKEN[:23], "", None, "𝒳𝒳 apikey=abcdef.=-/+", "password = = secret", "api_key=" + TOKEN * 3,
]


def test_secrets_match_brute_force(documents):
    rows = list(enumerate(TEXTS)) + [(99, TEXTS[0]), (None, TEXTS[0]), (100, "word " * 60_000 + TEXTS[0])]
    found, added = secrets.scan(documents(rows, Blob="clash", SPANS=1), rules=secrets.BASE_RULES)
    got = secrets.digest(found).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), brute_secrets(t)) for i, t in rows)
    assert added.select("blob").distinct().count() == len({t or "" for _, t in rows})


def test_ledger_scans_only_unseen_pairs(documents):
    docs = documents([(1, TEXTS[0]), (2, TEXTS[4])])
    found, ledger = secrets.scan(docs, rules=secrets.BASE_RULES)
    ledger = ledger.cache()
    assert ledger.count() == 6
    again, added = secrets.scan(docs, ledger, rules=secrets.BASE_RULES)
    assert added.count() == 0
    twice, added = secrets.scan(docs, ledger.unionByName(ledger), rules=secrets.BASE_RULES)
    assert added.count() == 0
    key = lambda d: sorted(map(str, secrets.digest(d).collect()))
    assert key(again) == key(found) == key(twice)
    newer = (secrets.Rule("assign", 2, secrets.ASSIGN, 2, 30),) + secrets.BASE_RULES[1:]
    bumped, added = secrets.scan(documents([(1, TEXTS[0]), (2, TEXTS[4]), (3, "new token=zzzzzzzz")]), ledger, rules=newer)
    assert added.count() == 2 + 3
    assert {r.doc_id: r.n_assign for r in secrets.digest(bumped).collect()} == {1: 1, 2: 0, 3: 0}
    assert secrets.scan(documents([]))[0].count() == 0


def test_contamination(spark, documents):
    item = " ".join(f"w{i}" for i in range(30))
    one_off = item.replace("w29", "other")
    half = " ".join(item.split()[:15])
    items = spark.createDataFrame([(1, item), (2, "Two words"), (3, ""), (4, None), (5, item), (6, "a b c d e f")], "item_id long, text string")
    rows = [(1, "head " + item.upper() + " tail"), (2, one_off), (3, half), (4, None), (5, ""), (6, "has two\twords in it"), (7, "clean text here"), (None, item), (8, "a b c d e f " * 50)]
    docs = documents(rows, w="clash", hs=1, _of=1, _w=1, _leaks=1, key="k", bad=1, few=2)
    got = {(r.doc_id, r.item_id, r.hits, r.size) for r in contamination.contained(docs, items).collect()}
    assert got == {(1, 1, 26, 26), (1, 5, 26, 26), (2, 1, 25, 26), (2, 5, 25, 26), (6, 2, 1, 1), (None, 1, 26, 26), (None, 5, 26, 26), (8, 6, 2, 2)}
    kept = contamination.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
    assert contamination.without_leaks(docs, items.limit(0)).count() == len(rows)
    assert contamination.contained(documents([]), items).count() == 0


def test_contamination_with_ids_of_any_kind(spark, documents):
    item = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([("x", item), (None, "only four words here"), ("x", "a b c d e f"), ("y", item), (None, item)], "item_id string, text string")
    rows = [(1, "say " + item), (2, "well only  FOUR words here"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e g"), (5, "long " * 100_000 + item)]
    got = {(r.doc_id, r.item_id, r.hits, r.size) for r in contamination.contained(documents(rows), items).collect()}
    assert got == {(d, i, 26, 26) for d in (1, 5) for i in ("x", "y", None)} | {(2, None, 1, 1), (3, "x", 2, 2)}
    assert [r.doc_id for r in contamination.without_leaks(documents(rows), items).collect()] == [4]


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://a.example.com/en/75?x", ("a.example.com", "/en/75", "example.com/en/7", "allow")),
        ("http://EXAMPLE.com/en/8#t", ("example.com", "/en/8", "com/en/", "block")),
        ("https://x.net/de/8", ("x.net", "/de/8", "net/de/", "allow")),
        ("https://b.example.net/de/8.html", ("b.example.net", "/de/8.html", "example.net/de/8", "block")),
        ("https://badexample.net/de/8", ("badexample.net", "/de/8", "net/de/", "allow")),
        ("ftp://org/es/", ("org", "/es/", "org/es/", "block")),
        ("https://c.org/es", ("c.org", "/es", None, "allow")),
        ("https://c.org?q=/es/", ("c.org", "", None, "allow")),
        ("no scheme", ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
        ("x://y://com/en/", ("y:", "//com/en/", None, "allow")),
    ],
)
def test_url_rules(url, want):
    trie = urls.UrlTrie(RULES)
    head, sep, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest)[0].lower() if sep else ""
    path = re.split(r"[?#]", rest[len(host) :])[0] if sep else ""
    rule, verdict = (trie.match(host, path) or (None, None))[-2:]
    assert (host, path, rule, verdict or "allow") == want


def test_url_judging(spark):
    rows = [(1, "http://a.example.com/en/75?x"), (2, None), (2, None), (3, "x://EXAMPLE.net\n/de/8")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)), RULES).collect()
    assert sorted((r.page_id, r.host, r.rule or "", r.verdict) for r in got) == [(1, "a.example.com", "example.com/en/7", "allow"), (2, "", "", "allow"), (2, "", "", "allow"), (3, "example.net\n", "", "allow")]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


@pytest.mark.parametrize("as_table", [False, True])
def test_more_rules_than_a_trie_holds(spark, monkeypatch, as_table):
    monkeypatch.setattr(urls, "RULE_COUNT", 2)
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("a.example.com", "com", "x.net", "example.net", "c.org") for p in ("", "/en/", "/en/75", "/de/8x", "/es/1"))] + [(99, "http://com/en/" + "x" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    trie = urls.UrlTrie(RULES)
    want = {i: (trie.match(u.split("://")[1].partition("/")[0], "/" + u.split("://")[1].partition("/")[2] if "/" in u.split("://")[1] else "") or (None, "allow"))[-2:] for i, u in rows}
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if as_table else RULES
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules).collect()} == want
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) x("</p>");</script></head><body class="has-sidebar">
<header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More of it</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, accept them all to go on reading here today please.</div>
<article><h1>The   title &amp; more</h1><p><b>First para&shy;graph<br>of   text.<p>Tiny.</p><div class="ad-box">Buy this now</div><p>With a <a href=x>link</a> &#8212; &eacute;&nbsp;x.</p>
<form><label>Mail</label><input><button>Go</button></form><aside><p>Aside text that is long enough to look like real content of the page.</p></aside></article>
<section id="comments"><article class="comment"><p>I liked this article very much, thanks a lot for writing it down.</p></article></section>
<div class="sidebar"><p>Popular posts and other things that many people have read here.</p></div><footer>&copy; 2020 Someone who writes</footer>"""


def test_page_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "<nav><a>x</a></nav>"), (1, "u", PAGE), (6, "u", "<article><p>" + "word " * 50000)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))).collect()
    text = "The title & more\nFirst para\u00adgraph of text.\nTiny.\nWith a link — é x."
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert by[1] == [(text, len(text))] * 2
    assert by[2] == by[3] == by[4] == by[5] == [("", 0)]
    assert by[6][0][1] == 5 * 50000 - 1


def test_page_without_article():
    tree = pages.fit_tree()
    body = "word " * 40
    html = f"<div><a href=1>one</a> <a href=2>two</a></div><div><p>{body}</p><p>{body}</p></div><div><a>Imprint</a> <a>Terms</a></div>"
    assert pages.main_text(html, tree) == "\n".join([body.strip()] * 2)


@pytest.mark.parametrize(
    "head",
    [
        "<head><meta charset=utf-8><title>x</title>",
        "<head><link rel=a href=b><script>// don't, if a<b\n</script></head>",
        "<head><script>// don't, if a<b\n</script><title>it's</title>",
        "<head></head><template><script>// don't, if a<b\n</script></template>",
        "<head></head><svg><title>it</title><style/><script href='a'/></svg>",
    ],
)
def test_head_hides_no_page(head):
    page = f"<html>{head}<body><article><p>{'word ' * 40}</p><p>It's all here.</p></article>"
    assert pages.main_text(page, pages.fit_tree()) == "word " * 39 + "word\nIt's all here."


def test_tree_fits_its_table():
    tree = pages.fit_tree()
    assert np.mean([pages.decide(tree, r[:-1]) == r[-1] for r in pages.labelled()]) >= 0.97


LONG = "word " * 40


@pytest.mark.parametrize("left_open", ["<button>", "<noscript>", "<select>", "<title>", "<iframe src=x>", "<textarea>", "<svg>", "<template>", "<!-- note", "<script>a<b", "<style>p{}", '<img alt="x>', "<a \"", "<button><button></button>"])
def test_what_is_left_open_hides_no_text(left_open):
    found = pages.main_text(f"<article><p>{LONG}</p>{left_open}<p>{LONG}one</p><p>{LONG}two</p></article>", pages.fit_tree())
    assert LONG + "two" in found and LONG.strip() in found


def test_densities_decide_inside_an_article_and_outside_any():
    tree, links = pages.fit_tree(), "".join(f"<li><a href=/{i}>go {i}</a></li>" for i in range(6))
    assert pages.main_text(f"<article><h1>Title</h1><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p><p>End.</p></article>", tree).split("\n") == ["Title", LONG.strip(), LONG.strip(), "End."]
    assert pages.main_text(f"<ul>{links}</ul><div><h2>A heading</h2><p>Short intro.</p><p>{LONG}</p><p>{LONG}</p></div><ul>{links}</ul>", tree).split("\n") == ["A heading", "Short intro.", LONG.strip(), LONG.strip()]
    assert pages.main_text(f"<article><p>{LONG}</p><p>Let <math><mi>x</mi></math> be <object>one</object> number.</p></article>", tree).endswith("Let x be one number.")


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '", '<a b="', "<!--", "<![CDATA[", "<title>", "<svg>", "<svg></svg><svg>", "<button>", "<", "</", "<a b='>", "&", "<script>", "<select><select></select>", '<a "> "'])
def test_malformed_pages_take_time_in_proportion(part):
    n = 400_000 // len(part)
    start = time.process_time()
    pages.blocks(part * n)
    assert time.process_time() - start < 8


def test_top_products_match_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8) * r.choice([0.1, 1, 5])]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400, None), (401, [float("nan")] * 8), (402, [None] + [1.0] * 7), (403, [0.0] * 8), (450, [0.0] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_products(df, F.col("vec_id") % 50 == 0).collect()}
    good = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = {}
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:5]
        want |= {(q, n): (c, -s) for n, (s, c) in enumerate(best, 1)}
    assert got == want
    assert topk.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_shard_search_prunes_and_stays_exact():
    r = np.random.default_rng(4)
    centre = r.normal(size=16)
    vectors = np.floor(256 * np.concatenate([centre + 0.05 * r.normal(size=(1500, 16)), 0.2 * r.normal(size=(2500, 16))]))
    ids = r.permutation(4000).astype(np.int64)
    queries, own = vectors[:40], ids[:40]
    none = np.full(40, -np.inf)
    rows, names, products = topk.Bucket(ids, vectors).search(own, queries, none, 5)
    for q in range(40):
        best = sorted((-int(queries[q] @ v), i) for v, i in zip(vectors, ids, strict=True) if i != own[q])[:5]
        assert [(-p, i) for p, i in zip(products[rows == q], names[rows == q], strict=True)] == best
        none[q] = -best[-1][0]
    again = topk.Bucket(ids, vectors).search(own, queries, none, 5)
    assert all((x == y).all() for x, y in zip(again, (rows, names, products), strict=True))


def test_top_products_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_NUMBERS", 240)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    r = np.random.default_rng(6)
    vectors = np.floor(256 * r.normal(size=(400, 6)) * r.choice([0.2, 1, 4], (400, 1)))
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_products(df, F.col("vec_id") % 50 == 0).collect()}
    want = {}
    for q in range(0, 400, 50):
        best = sorted((-int(vectors[q] @ vectors[c]), c) for c in range(400) if c != q)[:5]
        want |= {(q, n): (c, -s) for n, (s, c) in enumerate(best, 1)}
    assert got == want


def test_large_products_are_exact(spark):
    # whole numbers whose products pass what float64 holds exactly; and some that pass a long
    rows = [(0, [float(2**26 + 1), 1.0, 0.5]), (1, [float(2**19 + 1), 3.0, 0.0]), (2, [float(2**19 + 1), 2.0, 0.0]), (3, [float(2**19 + 1), 1.0, 1 / 256]), (4, [1e30, 0.0, 0.0]), (5, [-1e30, 0.0, 0.0])]
    got = [(x.vec_id, x.score) for x in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[0], whole[i], strict=True)))), i) for i in range(1, 6))
    assert got == [(i, -s) for s, i in want] and got[0] == (4, 2**63 - 1) and got[-1] == (5, -(2**63))


def test_mixture(documents):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", "d"][i % 4] if i % 40 else None) for i in range(4000)] + [(9, "x y", "a"), (9, "x y", "a"), (None, "z", "b"), (5000, None, "c"), (5001, "", "e")]
    docs = documents(rows, size="clash", chunk=1, _k=1, row="clash", copies=7)
    assert mixing.mix(docs).columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert sum(t for _, t in by) == pytest.approx(total, rel=1e-9)
    for (_, target), members in by.items():
        assert abs(sum(m.taken for m in members) - target) <= 7
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.taken(docs)
    assert {"size", "copies", "taken"} <= set(out.columns) and sum(r.taken for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mix(documents([])).count() == 0 and mixing.taken(documents([])).count() == 0


def test_mixture_of_alike_rows(documents, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = [(None, "one two three", "a")] * 700 + [(1, "four five", "b")] * 90 + [(2, "x " * i, "b") for i in range(1, 40)]
    docs = documents(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(t) - target) <= 39 for target, t in by.items())
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    out = mixing.taken(docs).collect()
    assert sum(r.taken for r in out) == sum(r.taken for r in got) and len(out) == sum(r.copies > 0 for r in got)


def test_weights_over_ranges_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SIDE_ROWS", 3)
    names = [*(f"s{i:02}" for i in range(20)), None, "", "\U0001f600", "\uffee"]
    got = {r.source: r.weight for r in mixing.cyclic_weights(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")).collect()}
    order = [*sorted((n for n in names if n is not None)), None]
    assert got == {n: float(i % 3 + 1) for i, n in enumerate(order)}


def test_targets_stop_and_pass_on(spark):
    s = spark.createDataFrame([("a", 10, 1.0), ("b", 100, 2.0), ("c", 1000, 3.0), (None, 0, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.targets(s, 3.0).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": pytest.approx(780.0), None: 0.0}


def test_quality(spark, documents):
    good = [(i, f"The plain sentence number {i} reads well, and so does the next one about {i % 9} things.") for i in range(200)]
    bad = [(1000 + i, " ".join(f"W{i * j}!!" for j in range(15))) for i in range(200)]
    docs = documents(good + bad + [(5000, ""), (5001, None), (None, "The plain sentence")], score="clash")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == (r.doc_id < 1000) for r in held if r.doc_id < 5000]) > 0.97
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {i for i, _ in good} <= {r.doc_id for r in kept.collect()}
    assert quality.accepted(docs, labels.limit(0)).count() == 403
    assert quality.judged(documents([]), labels).count() == 0
    assert sorted(map(str, quality.judged(docs.repartition(5), labels).collect())) == sorted(map(str, got))


def test_training_and_scores_match_a_plain_version(spark, documents):
    r = np.random.default_rng(2)
    data = [(i, i % 2, r.integers(-(2**31), 2**31, 12).tolist() if i % 3 else [7, 7, 9 + i % 2]) for i in range(60)]
    s, bits = quality.Follow(), 10
    got = quality.train(pd.DataFrame(data, columns=["order", "label", "hashes"]), s, 2, bits)
    z, n, w = {}, {}, {}

    def weight(k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zk) <= s.l1 else -(zk - (1 if zk > 0 else -1) * s.l1) / ((s.beta + nk**0.5) / s.alpha + s.l2)

    def features(hashes):
        x = {}
        for k in quality.buckets(np.array(hashes), bits).tolist():
            x[k] = x.get(k, 0) + 1
        total = sum(x.values())
        return {**{k: quality.GAIN * v / total for k, v in x.items()}, -1: 1.0}

    for _ in range(2):
        for _, label, hashes in data:
            x = features(hashes)
            p = 1 / (1 + np.exp(-sum(weight(k) * v for k, v in x.items())))
            for k, v in x.items():
                g, old = (p - label) * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / s.alpha * weight(k)
                n[k] = old + g * g
    w = {k: weight(k) for k in z if weight(k)}
    assert dict(zip(got["bucket"], got["weight"], strict=True)) == pytest.approx(w, abs=1e-9)
    model = r.normal(size=(1 << quality.BITS) + 1)
    texts = [(1, "One two, two two!"), (2, ""), (3, None), (4, "word " * 100_000 + "Ünï 12")]
    hashed = {x.doc_id: x.h for x in documents(texts).select("doc_id", quality.token_hashes(F.col("text")).alias("h")).collect()}
    for row in quality.score(documents(texts), model).collect():
        found = [model[b] for b in quality.buckets(np.array(hashed[row.doc_id], np.int32)).tolist()]
        plain = model[-1] + (quality.GAIN * sum(found) / len(found) if found else 0.0)
        assert row.score == pytest.approx(1 / (1 + np.exp(-plain)), rel=1e-9)


def test_quality_on_the_given_tables(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").toPandas()
    good, bad = rows[rows["quality"] == 1]["score"].to_numpy(), rows[rows["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad).mean() > 0.85 and (rows["predicted"] == rows["quality"]).mean() > 0.94


@pytest.mark.parametrize("step", [mixing._pool, mixing._pivot])
def test_rounding_keeps_words_and_leaves_one_fraction(step):
    r = np.random.default_rng(8)
    for n in (0, 1, 2, 5, 300):
        for x in (0.0, 0.01, 0.44, 0.999):
            size = r.integers(0, 900, n) * (r.random(n) < 0.9)
            rows = pd.DataFrame({"size": size, "fraction": np.full(n, x), "chance": r.random(n), "key": [str(i) for i in range(n)]})
            out = step(rows)
            assert len(out) == n and sorted(out["key"]) == sorted(rows["key"])
            assert ((out["fraction"] >= 0) & (out["fraction"] <= 1)).all()
            assert ((out["fraction"] > 0) & (out["fraction"] < 1)).sum() <= 1
            assert (out["size"] * out["fraction"]).sum() == pytest.approx((size * x).sum(), abs=1e-4)


def test_rounding_is_fair():
    r = np.random.default_rng(9)
    size = np.array([50, 40, 30, 20, 10])
    taken = np.zeros(5)
    for _ in range(3000):
        out = mixing._pool(pd.DataFrame({"size": size, "fraction": np.full(5, 0.4), "chance": r.random(5), "key": list("abcde")})).sort_values("key")
        taken += out["fraction"].to_numpy()
    assert np.abs(taken / 3000 - 0.4).max() < 0.04


@pytest.mark.parametrize("body", ["<h1>Title</h1><p>The.</p><p>A few words.</p>", "<p>One.</p>", "<h1>Of two</h1><p>words here</p>", "<p>Just this one line of text.</p>", f"<p>{LONG}</p><p>End.</p>"])
@pytest.mark.parametrize("around", ["", "<nav><a>x</a><p><a>y</a></p></nav>", "<footer><p>Someone who writes.</p></footer>", "<aside><p>" + LONG + "</p></aside>"])
def test_short_blocks_of_an_article_stay_whatever_is_around(body, around):
    want = [x.strip() for x in re.findall(r">([^<]+)<", body)]
    assert pages.main_text(f"{around}<article>{body}</article>{around}", pages.fit_tree()).split("\n") == want


LINE = LONG.strip()
FURNITURE = "comment-body comment-content comment-text post-comments sidebar-content footer-text main-nav ad-content cookie-text notice-body related-content share-text newsletter-body".split()


@pytest.mark.parametrize("name", FURNITURE)
def test_furniture_whatever_else_its_name_holds(name):
    tree, text = pages.fit_tree(), f"<article><h1>A title here</h1><p>{LINE}</p>%s<p>The end of it.</p></article>%s"
    for block in (f'<div class="{name}"><p>Someone wrote this text, which is of some length.</p></div>', f'<div id="{name}">Someone wrote this.</div>', f'<p class="{name}">Someone wrote this text.</p>'):
        want = f"A title here\n{LINE}\nThe end of it."
        assert pages.main_text(text % (block, ""), tree) == want
        assert pages.main_text(text % ("", block), tree) == want


def test_marks_inside_a_text():
    tree = pages.fit_tree()
    one = lambda html: pages.main_text(f"<nav><a>x</a></nav><article>{html}</article>", tree)
    assert one(f"<header><h1>The title</h1><p>By someone</p></header><p>{LINE}</p>") == f"The title\n{LINE}"
    assert one(f'<div class="article-header"><h1>The title</h1></div><div class="entry-content"><p>{LINE}</p></div>') == f"The title\n{LINE}"
    assert one(f'<p>{LINE}</p><p class="ad">Buy this now</p><p class="notice">Read our terms</p><p>So <span class="advert">buy <span>it</span> now</span> it goes.</p>') == f"{LINE}\nSo it goes."
    assert one(f'<h2>A part</h2><p>{LINE}</p><p><a href="x">This whole paragraph is a link to more</a></p><p>{LINE}</p>') == f"A part\n{LINE}\nThis whole paragraph is a link to more\n{LINE}"
    assert one(f'<p>{LINE} <span class="ad">left open</p><p>goes on, as it should.</p>') == f"{LINE}\ngoes on, as it should."
    assert pages.main_text(f'<article class="post category-social"><p>{LINE}</p></article><article class="comment"><p>{LINE}</p></article>', tree) == LINE


def test_secrets_take_time_in_proportion(documents):
    took = {}
    for n in (100, 32_000, 100):
        rows = [(1, " ".join(f"{i:024x}" for i in range(n)))]
        start = time.perf_counter()
        row = secrets.digest(secrets.scan(documents(rows))[0]).first()
        took[n] = time.perf_counter() - start
        assert row.n_hex == n and row.spans.endswith(f"hex:{25 * (n - 1)}:{25 * n - 1}")
    assert took[32_000] < took[100] + 4


def test_a_text_that_holds_every_item(spark, documents):
    r = np.random.default_rng(1)
    stock = "all rights are reserved by the owner of this text"
    texts = [" ".join(f"w{x}" for x in r.integers(0, 5000, 60)) + " " + stock for _ in range(300)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = [(1, " and ".join(texts)), (2, stock), *((10 + i, f"{stock} number {i}") for i in range(200)), (3, texts[7])]
    got = {(x.doc_id, x.item_id, x.hits, x.size) for x in contamination.contained(documents(docs), items).collect()}
    n = {i: len({tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}) for i, t in enumerate(texts)}
    assert got == {(1, i, n[i], n[i]) for i in n} | {(3, 7, n[7], n[7])}
