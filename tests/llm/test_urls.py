from pulsegrid.llm import urls
from pulsegrid.llm.queries import URL_RULES


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/x?q#f"), (2, "http://example.com/en/"), (3, "http://a.example.com/en/y"), (4, "http://com"), (5, "http://com/"), (6, "https://x.net/es/1"), (7, "http://notexample.com/en/"), (8, None), (9, "no scheme"),
        (10, "http://net/fr/?a/"), (11, "x://a://b/c"), (12, "http://h.org#x/y"), (13, "http://h.org?://"), (14, ""), (1, "HTTP://WWW.Example.COM/en/x?q#f"), (15, "http://É.COM/" + "p" * 50_000), (None, "http://u.net/fr/"),
    ]
    pages = spark.createDataFrame([(i, u, "x", 0) for i, u in rows], "page_id long, url string, host string, good int")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {}
    for r in urls.judge_urls(pages, none, URL_RULES).collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert len(got[1]) == 2 and got[1][0] == got[1][1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][0] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[3][0][2:] == ("example.com/en/", "block")
    assert got[4][0][:3] == ("com", "", None)
    assert got[5][0] == ("com", "/", "com/", "allow")
    assert got[6][0][2:] == ("net/es/", "block")
    assert got[7][0][2:] == ("com/", "allow")
    assert got[8][0][:3] == got[9][0][:3] == got[14][0][:3] == ("", "", None)
    assert got[10][0] == ("net", "/fr/", "net/fr/", "block")
    assert got[11][0][:2] == ("a:", "//b/c")
    assert got[12][0][:2] == ("h.org", "") and got[13][0][:2] == ("h.org", "")
    assert got[15][0][0] == "É.com" and len(got[15][0][1]) == 50_001
    assert got[None][0][3] == "block"
    assert urls.judge_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_reputation_shrinks_and_blocks_bad_hosts(spark):
    rows, labels = [], []
    for h, (n, good) in {"good.a.org": (40, 38), "bad.a.org": (40, 2), "one.a.org": (1, 0), "new.a.org": (0, 0), "fine.b.org": (60, 55)}.items():
        for i in range(max(n, 1)):
            page = len(rows)
            rows.append((page, f"http://{h}/{i}"))
            if n:
                labels.append((page, int(i < good)))
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*labels, labels[0], (None, 1), (5, None)], "page_id long, good int")
    got = {r["host"]: r for r in urls.judge_urls(pages, outcomes).collect()}
    assert got["good.a.org"]["verdict"] == got["fine.b.org"]["verdict"] == "allow"
    assert got["bad.a.org"]["verdict"] == "block"
    assert got["bad.a.org"]["good_rate"] < got["one.a.org"]["good_rate"] < got["new.a.org"]["good_rate"] < got["good.a.org"]["good_rate"]
    assert all(r["good_bound"] < r["good_rate"] for r in got.values())


def test_registered_domains_below_suffixes_of_two_labels_ports_and_addresses(spark):
    expected = {
        "a.bbc.co.uk": ("bbc.co.uk", "co.uk"), "bbc.co.uk": ("bbc.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.github.io": ("y.github.io", "github.io"), "notco.uk": ("notco.uk", "uk"),
        "www.example.com:8080": ("example.com", "com"), "u:p@www.example.com.:": ("example.com", "com"), "10.0.0.10:80": ("10.0.0.10", "10.0.0.10"), "[::1]:80": ("[::1]", "[::1]"), "com": ("com", "com"), "": ("", ""),
    }
    hosts = spark.createDataFrame([(h,) for h in expected], "host string")
    assert {r[0]: (r[1], r[2]) for r in hosts.select("host", *urls.domain_and_suffix(hosts["host"])).collect()} == expected


def test_a_domain_lends_its_rate_below_a_suffix_of_two_labels_and_to_ports(spark):
    counts = {"www.good.co.uk": (60, 58), "www.bad.co.uk": (60, 2), "new.good.co.uk": (0, 0), "new.bad.co.uk": (0, 0), "fine.org": (60, 55), "fine.org:8080": (0, 0), "poor.org": (60, 3), "poor.org:8080": (0, 0)}
    pages = [(h, i) for h, (n, _) in counts.items() for i in range(max(n, 1))]
    rows = [(page, f"http://{h}/") for page, (h, _) in enumerate(pages)]
    labels = [(page, int(i < counts[h][1])) for page, (h, i) in enumerate(pages) if counts[h][0]]
    judged = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"))
    rate = {r["host"]: r["good_rate"] for r in judged.collect()}
    assert rate["new.good.co.uk"] > rate["new.bad.co.uk"] + 0.1 and rate["fine.org:8080"] > rate["poor.org:8080"] + 0.1
