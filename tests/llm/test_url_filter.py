import random
import re

from pyspark.sql import functions as F

from recordmill.llm.url_filter import RULES, Rule, host_of, judged, path_of, rule_of, segment

SCHEMA = "page_id long, url string, html string, host string, template long"


def pages(spark, urls):
    return spark.createDataFrame([(k if k != 13 else None, u, "", "clash", 1) for k, u in enumerate(urls)], SCHEMA)


def plain(url):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best


URLS = [None, "", "no scheme", "http://", "HTTP://X.Net/a", "https://net/", "https://anet/", "https://x.net", "https://x.net?a/b",
        "https://a.example.net/en/1", "https://EXAMPLE.net/en", "https://example.com/de/x?y://z", "https://b.example.com/fr/",
        "https://w.org/fr/", "https://worg/fr/", "https://q.org/x/fr/", "a://b://c/d", "https://Ä.ORG/fr/\nx", "https://x.net#/y"]


def test_hosts_paths_and_rules(spark):
    found = judged(pages(spark, URLS)).collect()
    want = sorted((repr(k if k != 13 else None), *plain(u)[:2], plain(u)[2] and plain(u)[2].name) for k, u in enumerate(URLS))
    assert sorted((repr(r.page_id), r.host, r.path, r.rule) for r in found) == want
    verdict = {r.name: r.verdict for r in RULES}
    assert all(r.verdict == verdict[r.rule] for r in found if r.rule) and {r.verdict for r in found} <= {"allow", "block"}


def test_longest_rule_wins(spark):
    rules = (Rule("allow", "a.b", "/"), Rule("block", "b", "/x"), Rule("allow", "b", "/x/y/z/"))
    row = spark.range(1).select(*[rule_of(F.lit("c.a.b"), F.lit(p), rules).alias(k) for k, p in
                                  [("p", "/x/1"), ("q", "/x/y/z/1"), ("r", "/1")]]).first()
    assert (row.p, row.q, row.r) == ("a.b/", "b/x/y/z/", "a.b/")


def test_segments(spark):
    row = spark.range(1).select(*[segment(F.lit("/en/post-18/0a1b2c3d4e.html/x"), k).alias(f"s{k}") for k in range(1, 6)],
                                host_of(F.lit("u")).alias("h"), path_of(F.lit(None)).alias("p")).first()
    assert tuple(row) == ("en", "post-*", "*.html", "x", "", "", "")


def test_templates_learn_from_the_labels_of_their_own_host(spark):
    rules = (Rule("block", "mixed.test", "/spam1/"), Rule("block", "mixed.test", "/spam2/"), Rule("allow", "mixed.test", "/spam2/ok/"))
    urls = [f"https://mixed.test/{s}/{w}/" for s in ("spam1", "spam2") for w in ("a", "b", "ok") for _ in range(20)]
    # numbers are one branch: some of its pages fit a rule, the others follow them
    rules += tuple(Rule("block", "mixed.test", f"/shop/{k}/") for k in range(8))
    urls += [f"https://mixed.test/shop/{k}/" for k in range(10)] + [f"https://mixed.test/blog/{k}/" for k in range(10)]
    # another host with the same paths and no labels is left alone
    urls += [f"https://clean.test/{s}/{w}/" for s in ("shop", "spam1") for w in (1, 2, 3, "a") for _ in range(9)]
    got = {}
    for r in judged(pages(spark, urls), rules).collect():
        got.setdefault((r.host, r.path.split("/")[1]), set()).add((r.verdict, r.rule is not None))
    assert got["mixed.test", "shop"] == {("block", True), ("block", False)}
    assert got["mixed.test", "blog"] == {("allow", False)}
    assert got["clean.test", "shop"] == got["clean.test", "spam1"] == {("allow", False)}


def test_deep_paths_count_whole(spark):
    deep = "/a/b/c/d/e/f/g/"
    rules = (Rule("block", "deep.test", deep + "bad/x/"), Rule("allow", "deep.test", deep + "good/"))
    urls = [f"https://deep.test{deep}{w}/{x}/{k}" for w, x in (("bad", "x"), ("good", "x"), ("bad", "y")) for k in range(40)]
    got = {}
    for r in judged(pages(spark, urls), rules).collect():
        got.setdefault(tuple(r.path.split("/")[8:10]), set()).add(r.verdict)
    assert got == {("bad", "x"): {"block"}, ("good", "x"): {"allow"}, ("bad", "y"): {"allow"}}


def tree_by_hand(rows):
    """Templates and purities of (host, segments, label) rows, group by group."""
    at = {k: "" for k in range(len(rows))}
    for level in range(8):
        groups = {}
        for k, (host, parts, _) in enumerate(rows):
            groups.setdefault((host, at[k]), {}).setdefault(parts[level], []).append(k)
        for branches in groups.values():
            labels = {s: [rows[k][2] for k in ks if rows[k][2] is not None] for s, ks in branches.items()}
            whole, merged = [x for ls in labels.values() for x in ls], set()
            for s, ls in labels.items():
                if s and ls:
                    rest_n, rest_b = len(whole) - len(ls), sum(whole) - sum(ls)
                    pooled = sum(whole) / len(whole)
                    like = rest_n and abs(sum(ls) / len(ls) - rest_b / rest_n) <= 1.96 * (
                        pooled * (1 - pooled) * (1 / len(ls) + 1 / rest_n)) ** 0.5
                    if like or len(branches[s]) < 5:
                        merged.add(s)
            for s, ks in branches.items():
                step = "/" + s
                if not s:
                    step = ""
                elif s in merged:
                    step = "/?*"
                elif not labels[s] and len(ks) < 5:
                    step = "/?"
                for k in ks:
                    at[k] += step
    owns = {}
    for k, (host, _, label) in enumerate(rows):
        owns.setdefault((host, at[k]), []).append(label)
    purity = {key: (sum(x or 0 for x in ls) + 2.5) / (sum(x is not None for x in ls) + 5) for key, ls in owns.items()}
    return [(at[k].replace("/?*", "/*").replace("/?", "/*"), purity[rows[k][0], at[k]]) for k in range(len(rows))]


def test_the_tree_is_that_of_the_definition(spark):
    rng = random.Random(6)
    rules = tuple(Rule(rng.choice(["allow", "block"]), h, f"/{a}/{b}") for h in ("x.test", "y.test") for a in "abcd"
                  for b in ("", "p", "q/r") if rng.random() < 0.6)
    urls = ["http://" + rng.choice(["x.test", "y.test", "z.test"]) + "".join(
        "/" + rng.choice(["a", "b", "c", "d", "p", "q", "r", "17", "", f"u{k % 3}v"]) for _ in range(rng.choice([1, 2, 2, 3, 4, 10])))
        for k in range(900)]
    found = sorted((r.host, r.path, r.template, round(r.purity, 9)) for r in judged(pages(spark, urls), rules).collect())
    rows, names = [], []
    for url in urls:
        host, path = url[7:].split("/", 1)
        path = "/" + path
        fit = [r for r in rules if host == r.host and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.name), r.name), default=None)
        parts = path.split("/")[1:]
        parts = [*parts[:7], "/".join(parts[7:])] if len(parts) > 7 else parts + [""] * (8 - len(parts))
        rows.append((host, [re.sub("[0-9a-f]{8,}|[0-9]+", "*", x) for x in parts], best and int(best.verdict == "block")))
        names.append((host, path))
    assert found == sorted((*n, t, round(p, 9)) for n, (t, p) in zip(names, tree_by_hand(rows), strict=True))


def test_like_branches_are_merged(spark):
    # /a and /b have the same share of labels, /c another
    urls = [f"https://h.net/{s}/{k}" for s in "ab" for k in range(40)] + [f"https://h.net/c/{k}" for k in range(40)]
    rules = (Rule("block", "net", "/"), Rule("allow", "net", "/c/"))
    templates = {r.path[1]: r.template for r in judged(pages(spark, urls), rules).collect()}
    assert templates["c"] == "/c/*" and templates["a"] in ("/a/*", "/*/*")


def verdicts(spark, urls):
    found = {}
    for r in judged(pages(spark, urls)).collect():
        found.setdefault(r.path.split("/")[1], set()).add((r.template, r.verdict))
    return found


def test_small_shares_of_a_large_host_are_not_merged(spark):
    # each of the two has under 1% of the host's rows
    urls = [f"https://example.com/de/{k}" for k in range(90)] + [f"https://example.com/about/{k}" for k in range(90)]
    urls += [f"https://example.com/shop/{k}" for k in range(9_820)]
    found = verdicts(spark, urls)
    assert found == {"de": {("/de/*", "block")}, "about": {("/about/*", "allow")}, "shop": {("/shop/*", "allow")}}


def test_unlabelled_branches_stand_apart_from_labelled_ones(spark):
    # branches of too few rows: blocked by rule under /de/, without labels elsewhere; and pages that are numbers
    urls = [f"https://{h}.example.com/de/{k}" for h in "abcdefgh" for k in range(4)]
    urls += [f"https://{h}.example.com/about{s}/{k}" for h in "abcdefgh" for s in "xyz" for k in range(3)]
    urls += [f"https://{h}.example.com/{k}/" for h in "abcdefgh" for k in range(9)]
    found = verdicts(spark, urls)
    assert found.pop("de") == {("/*/*", "block")}
    assert set().union(*({v for _, v in x} for x in found.values())) == {"allow"}
    assert found["aboutx"] == {("/*/*", "allow")} and found["3"] == {("/*", "allow")}


def test_empty(spark):
    assert judged(pages(spark, [])).collect() == []
