"""URL filters: what the template tree decides where no rule does."""

from graphweft.llm import urls


def verdicts(spark, addresses, labels=None, rules=urls.RULES):
    df = spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string")
    known = None if labels is None else spark.createDataFrame(labels, "page_id long, blocked int")
    return {r.page_id: r for r in urls.filter_urls(df, rules, known).collect()}


def test_branches_without_labels_take_their_parents_share(spark):
    """Rules block es and fr below net; other branches of these hosts, and other hosts below net, have no labels."""
    addresses = [f"http://a{h}.net/{lang}/p{i}" for h in range(3) for lang in ("es", "fr") for i in range(4)]
    addresses += ["http://a0.net/en/x", "http://a1.net/", "http://b.a2.net/any/thing", "http://new.net/start", "http://other.org/es/1", "http://x.com/es/1"]
    got = verdicts(spark, addresses)
    named = {addresses[i]: (r.rule, r.verdict) for i, r in got.items()}
    assert all(v == ("net/es/" if "/es/" in u else "net/fr/", "block") for u, v in named.items() if "net/es" in u or "net/fr" in u)
    assert [named[u] for u in addresses[24:]] == [(None, "block")] * 4 + [(None, "allow"), ("com/", "allow")]


def test_branches_that_differ_are_told_apart_ten_segments_down(spark):
    deep = "/".join("abcdefgh")
    addresses = [f"http://h.org/{deep}/{kind}/{i}/x" for kind in ("spam", "ham", "rest") for i in range(20)]
    labels = [(i, int(i < 20)) for i in range(0, 40, 2)]
    got = verdicts(spark, addresses, labels, (("allow", "none", "/"),))
    assert all(got[i].verdict == "block" and got[i].purity > 0.8 for i in range(20))
    assert all(got[i].verdict == "allow" and got[i].purity < 0.2 for i in range(20, 40))
    assert {got[i].template for i in range(20)} == {f"/{deep}/spam/*/x"}


def test_similar_branches_are_merged(spark):
    """Each branch has one or two labelled pages: too few alone, enough together; half of all pages have labels."""
    addresses = [f"http://h.org/s{i}/{j}" for i in range(8) for j in range(3)]
    got = verdicts(spark, addresses, [(i, 1) for i in range(0, 24, 2)], (("allow", "none", "/"),))
    assert {r.verdict for r in got.values()} == {"block"}


def test_variable_segments(spark):
    """Below a node with many children rare ones are one wildcard, a frequent one stays; what follows stays apart."""
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(40)]
    addresses = [f"http://h.org/user/{w}/{page}" for w in words for page in ("profile", "cheap")] + ["http://h.org/user/all/cheap"] * 9
    labels = [(i, i % 2) for i in range(0, 40)]
    got = verdicts(spark, addresses, labels, (("allow", "none", "/"),))
    assert {r.template for r in got.values()} == {"/user/*/profile", "/user/*/cheap", "/user/all/cheap"}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(80))


def test_a_level_with_the_same_pages_counts_once(spark):
    """One labelled page isn't more evidence for lying below three domains and a long path."""
    one = verdicts(spark, ["http://a.b.c.org/x/y/z/1"], [(0, 1)], (("allow", "none", "/"),))[0]
    assert abs(one.purity - 1 / 3) < 1e-12 and one.template == "/x/y/z/*"


def test_unlabelled_branches_of_one_host_get_their_own_verdicts(spark):
    """Rules block es and fr. A branch like them goes with them; one of another size or with other segments doesn't."""
    sizes = {"es": 9, "fr": 11, "de": 10, "en": 120}
    addresses = [f"http://shop.net/{lang}/{1000 + i}" for lang, n in sizes.items() for i in range(n)]
    named = [f"http://shop.net/docs/{a}{b}" for a in "abcd" for b in "xyz"]
    got = verdicts(spark, addresses + named)
    by_branch = {}
    for i, r in got.items():
        by_branch.setdefault((addresses + named)[i].split("/")[3], set()).add((r.rule, r.verdict))
    assert by_branch == {"es": {("net/es/", "block")}, "fr": {("net/fr/", "block")}, "de": {(None, "block")}, "en": {(None, "allow")}, "docs": {(None, "allow")}}
    purity = {(addresses + named)[i].split("/")[3]: r.purity for i, r in got.items()}
    assert purity["de"] > 0.9 and purity["docs"] == 0.0 and abs(purity["en"] - purity["de"] * 2 * 10 / 130) < 0.05


def test_a_branch_is_compared_only_with_labelled_ones(spark):
    """Without labelled branches in a node its branches have what it has, however they differ."""
    addresses = [f"http://a.net/es/{i}" for i in range(5)] + [f"http://b.net/big/{i}" for i in range(60)] + ["http://b.net/small/x"]
    got = verdicts(spark, addresses)
    assert {r.verdict for i, r in got.items() if i >= 5} == {"block"}
