import re

import pytest

from edgelens.llm import url_filter as U


def plain(url):
    match = re.match(r"(.*?)://([^/?#]*)([^?#]*)", url or "", re.S)
    if not match:
        return "", "", None, None
    host = re.sub("[A-Z]", lambda m: m[0].lower(), match[2])
    best = None
    for rule_host, path, verdict in U.RULES:
        if (host == rule_host or host.endswith("." + rule_host)) and match[3].startswith(path):
            if best is None or len(rule_host + path) > len(best[0]):
                best = (rule_host + path, verdict)
    return host, match[3], *(best or (None, None))


@pytest.fixture
def pages(spark):
    def make(urls):
        rows = [(i, u) for i, u in enumerate(urls)]
        df = spark.createDataFrame(rows, "page_id bigint, url string")
        return df.selectExpr("*", "'x' as host", "'y' as path", "'z' as rule", "1 as n", "2 as template", "3 as listed")

    return make


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "HTTP://A.Example.ORG/en/1?q=http://b.com/fr/",
    "http://example.org/en/1",
    "http://example.org/en/12/x#a",
    "http://example.org/en/2",
    "http://notexample.org/es/1",
    "http://sub.example.org/es/",
    "http://example.org",
    "http://example.org?x",
    "x://com/fr/1",
    "x://a.com/fr",
    "x://a.com/de/#/fr/",
    "x://a.com:80/de/1",
    "x://comx/fr/1",
    "a://b://c/d",
    "x://ÄB.Com/fr/é",
    "x://h.com/fr/\nline",
    "x://h.net/" + "a/" * 3000,
    "x://h.net/1/2/3/4/5/6/7/8/9/10",
]


def test_hosts_paths_and_rules(pages):
    got = {r.page_id: r for r in U.verdicts(pages(URLS)).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)


def test_templates_fold_what_varies_and_split_what_labels_tell_apart(pages):
    urls = [f"http://h.com/de/{i}" for i in range(60)] + [f"http://h.com/fr/{i}" for i in range(60)]
    urls += [f"http://h.com/en/{i}" for i in range(60)] + [f"http://k.org/{i}/a" for i in range(400)]
    got = U.verdicts(pages(urls)).collect()
    templates = {(r.path.split("/")[1], r.template) for r in got if r.host == "h.com"}
    assert templates == {("de", "/de/*"), ("fr", "/fr/*"), ("en", "/*/*")} or templates == {
        ("de", "/de/*"), ("fr", "/*/*"), ("en", "/*/*")
    }
    assert {r.verdict for r in got if r.path.startswith("/en/")} == {"allow"}


def test_a_template_of_blocked_pages_is_rejected(pages):
    """Unlisted pages that share a template with mostly blocked ones go with them."""
    rules = [("bad.net", f"/shop/{i}", "block") for i in range(1, 10)] + [("net", "/fine/", "allow")]
    urls = [f"http://bad.net/shop/{i}" for i in range(900)] + [f"http://good.net/fine/{i}" for i in range(900)]
    got = U.verdicts(pages(urls), rules).collect()
    assert all(r.verdict == "block" for r in got if r.host == "bad.net")
    assert all(r.verdict == "allow" for r in got if r.host == "good.net")


def test_a_small_branch_that_labels_tell_apart_stays(pages):
    """Under a twentieth of the host's pages, and one of many sections."""
    rules = [("net", "/", "allow"), ("h.com", "/de/", "block")]
    urls = [f"http://h.com/de/{i}" for i in range(40)] + [f"http://h.com/en/{i}" for i in range(960)]
    rules += [("s.com", f"/b{k}/", "block") for k in range(12)] + [("s.com", f"/a{k}/1", "allow") for k in range(12)]
    urls += [f"http://s.com/{c}{k}/{i}" for c in "ab" for k in range(12) for i in range(10, 30)]
    got = U.verdicts(pages(urls + [f"http://k.net/{i}" for i in range(400)]), rules).collect()
    assert {r.verdict for r in got if r.path.startswith("/en/")} == {"allow"}
    assert {r.template for r in got if r.path.startswith("/de/")} == {"/de/*"}
    assert {r.verdict for r in got if r.path.startswith("/a")} == {"allow"}


def test_labels_that_differ_deep_in_a_path_are_seen(pages):
    deep = "/" + "x/" * 300
    rules = [("net", "/", "allow"), ("h.com", f"{deep}de/", "block"), ("h.com", f"{deep}fr/1", "allow")]
    urls = [f"http://h.com{deep}{c}/{i}" for c in ("de", "fr") for i in range(100, 180 if c == "de" else 140)]
    urls += [f"http://h.com{deep}fr/{i}" for i in range(200, 240)] + [f"http://h.com{deep}de"]
    got = U.verdicts(pages(urls + [f"http://k.net/{i}" for i in range(200)]), rules).collect()
    assert len(got) == len(urls) + 200
    assert {r.verdict for r in got if r.path.startswith(f"{deep}fr/")} == {"allow"}


class PlainTree:
    """Templates of (key, path) pages with labels, branch by branch in plain Python."""

    def __init__(self, rows, base):
        # rows: (key, path, labelled, good) per distinct path
        self.base, self.template, self.counts = base, {}, {}
        nodes = {}
        for key, path, n, good in rows:
            segments = path.removeprefix("/").split("/")
            nodes.setdefault((key, ""), []).append((path, segments, n, good))
        level = 0
        while nodes:
            below = {}
            for (key, template), members in nodes.items():
                names = self.names([(m[1][level], m[2], m[3]) for m in members if len(m[1]) > level])
                for member in members:
                    if len(member[1]) <= level:
                        self.close(key, template, member)
                        continue
                    step = names.get(member[1][level], "*")
                    below.setdefault((key, f"{template}/{step}"), []).append(member)
            nodes, level = below, level + 1

    def close(self, key, template, member):
        self.template[key, member[0]] = template
        counts = self.counts.setdefault((key, template), [0, 0])
        counts[0] += member[2]
        counts[1] += member[3]

    def names(self, members):
        counts = {}
        for segment, n, good in members:
            c = counts.setdefault(segment, [0, 0])
            c[0] += n
            c[1] += good
        all_n, all_good = (sum(c[i] for c in counts.values()) for i in (0, 1))
        kept = {}
        for segment, (n, good) in counts.items():
            if n < U.LEAST:
                continue
            others, others_good = all_n - n + U.PRIOR, all_good - good + U.PRIOR * self.base
            pool = (good + others_good) / (n + others)
            if abs(good / n - others_good / others) > U.Z * (pool * (1 - pool) * (1 / n + 1 / others)) ** 0.5:
                kept[segment] = (n, good)
        parts = {}
        for segment, (n, good) in kept.items():
            smooth = 20 * (good + U.PRIOR * self.base) / (n + U.PRIOR)
            part = parts.setdefault(int(smooth + 0.5), [0, 0, []])
            part[0] += n
            part[1] += good
            part[2].append(segment)
        groups, before = [], None
        for _, (n, good, segments) in sorted(parts.items()):
            if before:
                pool = (good + before[1]) / (n + before[0])
                if abs(good / n - before[1] / before[0]) <= U.Z * (pool * (1 - pool) * (1 / n + 1 / before[0])) ** 0.5:
                    groups[-1] += segments
                    before = n, good
                    continue
            groups.append(list(segments))
            before = n, good
        return {s: min(g) + ("~" if len(g) > 1 else "") for g in groups for s in g}


def plain_verdicts(urls, rules):
    """(verdict, template, scope, purity) of every page."""
    pages = []
    for url in urls:
        host, path, _, _ = plain(url)
        best = None
        for rule_host, prefix, verdict in rules:
            if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(prefix):
                if best is None or len(rule_host + prefix) > len(best[0]):
                    best = (rule_host + prefix, verdict)
        pages.append((host, path, best and best[1]))
    labelled = sum(p[2] is not None for p in pages)
    good = sum(p[2] == "allow" for p in pages)
    base = (good + U.PRIOR) / (labelled + U.PRIOR)
    trees = []
    for scope, key_of in (("all", lambda h: ""), ("suffix", lambda h: h.split(".")[-1]), ("host", lambda h: h)):
        rows = {}
        for host, path, verdict in pages:
            row = rows.setdefault((key_of(host), path), [0, 0])
            row[0] += verdict is not None
            row[1] += verdict == "allow"
        trees.append((scope, key_of, PlainTree([(k, p, n, g) for (k, p), (n, g) in rows.items()], base)))
    out = []
    for host, path, verdict in pages:
        purity, shown = base, None
        for scope, key_of, tree in trees:
            template = tree.template[key_of(host), path]
            n, g = tree.counts[key_of(host), template]
            purity = (g + U.PRIOR * purity) / (n + U.PRIOR)
            if n or shown is None:
                shown = template, scope
        out.append((verdict or ("allow" if purity >= U.PURE else "block"), *shown, round(purity, 9)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_the_plain_tree(pages, seed):
    import random

    rng = random.Random(seed)
    sections = ["de", "fr", "en", "es", "shop", "a", "b"]
    hosts = ["x.com", "y.com", "z.net", "w.net", "v.org", "localhost"]
    rules = [("com", "/de/", "block"), ("com", "/es/", "block"), ("com", "/fr/", "allow"), ("net", "/shop/1", "block"), ("org", "/", "allow"), ("x.com", "/a/b/", "block"), ("y.com", "/en/a", "allow")]
    urls = []
    for _ in range(1500):
        depth = rng.randint(0, 4)
        path = "".join("/" + rng.choice(sections if rng.random() < 0.7 else [str(rng.randint(0, 60))]) for _ in range(depth))
        urls.append(f"http://{rng.choice(hosts)}{path}{rng.choice(['', '/'])}")
    got = {r.page_id: (r.verdict, r.template, r.scope, round(r.purity, 9)) for r in U.verdicts(pages(urls), rules).collect()}
    want = plain_verdicts(urls, rules)
    assert [got[i] for i in range(len(urls))] == want
    assert {w[0] for w in want} == {"allow", "block"} and any("~" in w[1] for w in want)


def test_a_host_without_labels_is_judged_by_its_paths_elsewhere(pages):
    urls = [f"http://{h}.com/{c}/{i}" for h in "ab" for c in ("de", "fr") for i in range(50)]
    urls += [f"http://n.net/{c}/{i}" for c in ("de", "fr") for i in range(50)]
    got = U.verdicts(pages(urls)).collect()
    shown = {(r.path.split("/")[1], r.verdict, r.scope) for r in got if r.host == "n.net"}
    assert shown == {("de", "block", "all"), ("fr", "allow", "all")}


def test_branches_that_are_alike_are_one(pages):
    rules = [("h.com", f"/{c}/", "block") for c in ("de", "dx")] + [("h.com", f"/{c}/", "allow") for c in ("fr", "en")]
    urls = [f"http://h.com/{c}/{i}" for c in ("de", "dx", "fr", "en", "zz") for i in range(40)]
    got = {(r.path.split("/")[1], r.template) for r in U.verdicts(pages(urls), rules).collect()}
    assert {t for c, t in got if c in ("de", "dx")} == {"/de~/*"}


def test_few_labelled_pages_keep_no_segment(pages):
    rules = [("net", "/", "allow")] + [("h.com", f"/id{i}/", "block") for i in range(20)]
    urls = [f"http://h.com/id{i}/{k}" for i in range(20) for k in range(U.LEAST - 1)] + [f"http://k.net/{i}" for i in range(300)]
    assert {r.template for r in U.verdicts(pages(urls), rules).collect() if r.host == "h.com"} == {"/*/*"}


def test_repeats_and_empty_tables(pages):
    got = U.verdicts(pages(["x://a.net/b"] * 5)).collect()
    assert [(r.host, r.path, r.verdict) for r in got] == [("a.net", "/b", "allow")] * 5
    assert U.verdicts(pages([])).count() == 0
