"""Main text and url verdicts."""

import random

from cohortlens.llm import html, urls

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First  {0}<br>line<p>Second&nbsp;<i>it</i>alic</p><form>Name <input></form>
<aside>Side</aside><div class="comments"><p>Reader</p></div></article><footer>&copy; {0}</footer>"""
SCHEMA = "page_id long, url string, html string, text string, host string"


def test_article_without_furniture():
    assert html.main_texts([PAGE.format(7)]) == ["Head & line\nFirst 7 line\nSecond italic"]


def test_pages_without_article_lose_what_repeats():
    shared = "<div>Welcome to the site of all things good and small today</div>"
    pages = [f"<body>{shared}<p>own text number {i} about {i * 7} birds</p><p><a href='/'>only link</a></p></body>" for i in range(4)]
    assert html.main_texts(pages) == [f"own text number {i} about {i * 7} birds" for i in range(4)]


def test_suffix_array_equals_brute_force():
    streams = [list("abcdefghij"), list("xxabcdefyy"), list("abcd"), [], list("zzzzzzzz")]
    found = html.repeated(streams, 4)
    for i, s in enumerate(streams):
        want = [False] * len(s)
        for a in range(len(s) - 3):
            part = s[a: a + 4]
            if any(part == o[b: b + 4] for j, o in enumerate(streams) if j != i for b in range(len(o) - 3)):
                want[a: a + 4] = [True] * 4
        assert found[i].tolist() == want


def test_extract_a_table(spark):
    rows = [(1, "http://a.example/x", PAGE.format(1)), (1, "http://a.example/x", PAGE.format(1)), (2, None, None), (None, "http://b/", "")]
    rows += [(3, "http://c/", "<p>cut off <b>te"), (4, "http://c/", "plain &lt;b&gt; text"), (5, "http://c/", "<p>" + "long " * 20000)]
    found = html.extract(spark.createDataFrame([(*r, "t", "h") for r in rows], SCHEMA)).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows)
    assert texts[1] == "Head & line\nFirst 1 line\nSecond italic" and texts[2] == "" and texts[None] == ""
    assert texts[3] == "cut off te" and texts[4] == "plain <b> text" and len(texts[5]) == 5 * 20000 - 1
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0


NOTICE = "<div class='x7'>Read the other fine pages of this site, all of them new today</div>"
LINKS = "<ul><li><a href='/a'>First of the many other pages that this site has about all kinds of things</a></li></ul>"
PROSE = "<p>Read the other fine pages of this site, all of them new today</p>"


def own(i, n=30):
    return " ".join(f"own{i}x{j}" for j in range(n))


def test_articles_lose_containers_that_stand_outside_as_well():
    pages = [f"<article><p>{own(i)}</p>{NOTICE}{LINKS}<p>{own(-i, 9)}</p></article>" for i in range(1, 4)]
    pages += [f"<body><article><p>{own(9)}</p></article>{NOTICE}</body>"]
    found = html.main_texts(pages)
    assert found == [f"{own(i)}\n{own(-i, 9)}" for i in range(1, 4)] + [own(9)]
    # nowhere outside: it may be part of the text
    assert all("other fine" in t for t in html.main_texts(pages[:3]))


def test_articles_keep_prose_that_repeats():
    pages = [f"<article><p>{own(i)}</p>{PROSE}<p>{own(-i, 9)}</p></article>" for i in range(1, 30)]
    pages += [f"<article>{PROSE}</article>"] * 20 + [f"<body><article><p>{own(99)}</p></article>{PROSE}</body>"]
    plain = "Read the other fine pages of this site, all of them new today"
    found = html.main_texts(pages)
    assert all(t == f"{own(i)}\n{plain}\n{own(-i, 9)}" for i, t in enumerate(found[:29], 1))
    assert found[29:49] == [plain] * 20 and found[49] == own(99)


def test_articles_of_a_large_host(spark, monkeypatch):
    """What stands outside articles in one array takes the container from articles of the others."""
    monkeypatch.setattr(html, "PAGES", 2)
    rows = [(i, "http://one.example/x", f"<article><p>{own(i)}</p>{NOTICE}{PROSE}</article>", "t", "h") for i in range(20)]
    rows += [(20, "http://one.example/y", f"<body><article><p>{own(20)}</p></article>{NOTICE}</body>", "t", "h")]
    rows += [(None, None, "<p>the same page without a key, some words long, many times</p>", "t", "h")] * 9
    found = html.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and texts[20] == own(20) and texts[None] == ""
    assert [texts[i] for i in range(20)] == html.main_texts([r[2] for r in rows[:21]])[:20]
    assert not any(t.startswith("Read", len(own(0)) + 1) and "\n" in t[len(own(0)) + 1:] for t in texts.values())


def test_arrays_of_a_host_equal_one_array(spark, monkeypatch):
    monkeypatch.setattr(html, "PAGES", 3)
    notice = "<div>Notice {0} that only {0} two pages {0} of this {0} large site {0} have in common</div>"
    pages = [f"<body>{notice.format(f'n{i % 30}')}<p>own text {i} about {i * 7} birds and {i * 3} fish there</p></body>" for i in range(60)]
    rows = [(i, "http://one.example/x", p, "t", "h") for i, p in enumerate(pages)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[i] for i in range(60)] == html.main_texts(pages)
    assert not any("Notice" in t for t in found.values())


def expected(url):
    """Host, path and rule by plain string work."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[1]), default=(None, None))


def test_substrings_meet_across_the_arrays_of_a_host(spark, monkeypatch):
    """Pages that share most of a block, not the whole of it, lose it as in one array."""
    monkeypatch.setattr(html, "PAGES", 2)
    rnd = random.Random(5)
    common = " ".join(f"w{i}" for i in range(40))
    sources = []
    for i in range(40):
        start, box = rnd.randrange(20), rnd.choice(["div", "p", "section", "p"])
        part = " ".join(common.split()[start: start + rnd.choice([9, 12, 20])])
        piece = f"<{box}>{part}{rnd.choice(['', f' own{i}', f' own{i} b{i} c{i} d{i} e{i}'])}</{box}>"
        linked = f"<p><a href='/'>{part}</a></p>" if rnd.random() < 0.3 else ""
        text = f"<p>{' '.join(f'x{i}y{j}' for j in range(12))}</p>"
        sources.append(f"<body><article>{text}{piece}{linked}</article>{piece if rnd.random() < 0.3 else ''}</body>" if i % 3 else f"<body>{text}{piece}{linked}</body>")
    rows = [(i, "http://one.example/x", s, "t", "h") for i, s in enumerate(sources)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    want = html.main_texts(sources)
    assert [found[i] for i in range(40)] == want
    assert want != [t for s in sources for t in html.main_texts([s])]


def test_urls_against_plain_code(spark):
    given = [
        "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=://y", "http://org/x", "http://orgx.com/fr/a", "http://b.com/de/1",
        "http://b.com/de", "no scheme", None, "", "http://x.net?q=/a", "http://x.net#f", "ftp://q.com/fr/://z", "http://İ.com/fr/x", "http://a.com/fr/\n/x",
    ]
    rows = [(i, u, "h", "t", "o") for i, u in enumerate([*given, given[0]])]
    found = urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, (verdict, rule) = expected(rows[r.page_id][1])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict is None or r.verdict == verdict
        assert r.verdict in ("allow", "block")


def test_tree_rejects_what_resembles_blocked_templates(spark):
    rules = [("block", "h.example", "/bad/1"), ("allow", "h.example", "/good/1")]
    rows = [(f"http://h.example/{kind}/{i}/p{i}.html", None) for kind in ("bad", "good") for i in range(100)]
    rows += [(f"http://h.example/{kind}/9{i}/q.html", None) for kind in ("bad", "good") for i in range(5)]
    pages = spark.createDataFrame([(i, r[0], "", "", "") for i, r in enumerate(rows)], SCHEMA)
    found = urls.judge(pages, rules).where("rule is null").collect()
    assert {(r.path.split("/")[1], r.verdict) for r in found} == {("bad", "block"), ("good", "allow")}
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_tree(counts):
    """Shares by recursion over dictionaries: (host, shape) to (blocked, allowed)."""
    def lean(b, a, up):
        return (b + urls.PRIOR * up) / (b + a + urls.PRIOR)

    shares = {}
    blocked, judged = sum(b for b, _ in counts.values()), sum(b + a for b, a in counts.values())
    base = (blocked + urls.PRIOR / 2) / (judged + urls.PRIOR)

    def walk(group, at, up):
        """``group`` holds shapes that agree in name up to ``at``, as (key, rest)."""
        rests = [r for _, r in group]
        if len(set(rests)) == 1:
            shares.update((key, up) for key, _ in group)
            return
        at = 0
        while all(len(r) > at for r in rests) and len({r[at] for r in rests}) == 1:
            at += 1
        children = {}
        for key, r in group:
            children.setdefault(r[at] if len(r) > at else "", []).append((key, r[at + 1:]))
        sums = {c: [sum(counts[k][i] for k, _ in g) for i in (0, 1)] for c, g in children.items()}
        n = sum(map(sum, sums.values()))
        pool = sum(b for b, _ in sums.values()) / n if n else None
        branches = {}
        for c, (b, a) in sums.items():
            apart = b + a >= urls.RARE and abs(b / (b + a) - pool) > urls.ALIKE * (pool * (1 - pool) / (b + a)) ** 0.5
            branches.setdefault(c if apart else "*", []).append(c)
        for name, held in branches.items():
            b, a = (sum(sums[c][i] for c in held) for i in (0, 1))
            share = up if set(branches) == {"*"} else lean(b, a, up)
            walk([x for c in held for x in children[c]], 0, share)

    for host in {h for h, _ in counts}:
        mine = [((h, s), s) for h, s in counts if h == host]
        b, a = (sum(counts[k][i] for k, _ in mine) for i in (0, 1))
        walk(mine, 0, lean(b, a, base))
    return shares


def test_tree_equals_brute_force(spark):
    from cohortlens.llm.common import Stage

    rnd = random.Random(2)
    counts = {}
    for _ in range(400):
        host = rnd.choice(["a", "b", "", "c.d"])
        shape = tuple(rnd.choice(["x", "y", "z*", "w"]) for _ in range(rnd.choice([0, 1, 2, 3, 5, 9])))
        bad = "y" in shape[:2] or shape[4:5] == ("w",)
        b, a = counts.get((host, shape), (0, 0))
        if rnd.random() < 0.8:
            b, a = b + bad * rnd.randrange(6), a + (not bad) * rnd.randrange(6)
        counts[host, shape] = (b, a)
    counts |= {("none", s): (0, 0) for s in (("x",), ("y", "x"), ())}  # a host without judged URLs
    rows = [(h, list(s), b, a) for (h, s), (b, a) in counts.items()]
    table = spark.createDataFrame(rows, "host string, shape array<string>, blocked long, allowed long")
    found = {(r.host, tuple(r.shape)): r.share for r in urls.tree(table, Stage(spark, "test")).collect()}
    want = brute_tree(counts)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert len({round(x, 9) for x in want.values()}) > 10


def test_deep_and_wide_trees(spark):
    """Branches that part at the seventh segment, in long slugs, and among many other children."""
    rules = [("block", "h.example", "/a/b/c/d/e/f/bad/1"), ("allow", "h.example", "/a/b/c/d/e/f/good/1")]
    rows = [f"http://h.example/a/b/c/d/e/f/{kind}/1{i}" for kind in ("bad", "good") for i in range(100)]
    rows += [f"http://h.example/a/b/c/d/e/f/{kind}/9{i}/x" for kind in ("bad", "good") for i in range(40)]
    slug = "a-segment-of-far-more-than-thirty-two-characters-about-"
    rules += [("block", "w.example", f"/{slug}spam/1"), ("allow", "w.example", f"/{slug}news/1")]
    rows += [f"http://w.example/{slug}{kind}/{n}{i}" for kind in ("spam", "news") for n in (1, 2) for i in range(30)]
    rows += [f"http://w.example/other{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "", "", "") for i, u in enumerate(rows)], SCHEMA)
    found = urls.judge(pages, rules).where("rule is null").collect()
    verdicts = {}
    for r in found:
        kind = next((k for k in ("bad", "good", "spam", "news") if f"{k}/" in r.path), "other")
        verdicts.setdefault(kind, set()).add(r.verdict)
    assert verdicts == {"bad": {"block"}, "good": {"allow"}, "spam": {"block"}, "news": {"allow"}, "other": {"allow"}}
