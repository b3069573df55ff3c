"""Site-relative line frequencies against a plain count."""

from collections import Counter, defaultdict

from tabstrata.llm import line_dedup as L

PAGES = "page_id bigint, url string, html string, site string, row int"


def page(*lines):
    return "<html><head><style>p{x}</style></head><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def cases():
    rows = []
    for i in range(30):
        lines = ["menu", f"own {i}", "<b>rare</b> line" if i < 2 else f"other {i}", "menu"]
        rows.append((i, f"http://User@Site.example:80/p{i}", page(*lines), "a", 1))
    rows += [(50 + i, f"https://small.example/{i}", page("menu", "same"), "a", 1) for i in range(3)]
    rows += [(60 + i, None if i else "no url", page("menu"), "a", 1) for i in range(8)]
    rows += [(70, "http://site.example/x", None, "a", 1), (71, "http://site.example/x", "", "a", 1), rows[0]]
    return rows


def test_like_a_plain_count(spark):
    rows = cases()
    got = L.line_dedup(spark.createDataFrame(rows, PAGES).repartition(4), max_ratio=0.1, min_pages=5).collect()
    assert len(got) == len(rows)
    by_site, lines = defaultdict(list), {}
    for r in rows:
        url = (r[1] or "").lower()
        site = url.split("://")[1].split("/")[0].split("@")[-1].split(":")[0] if "://" in url else ""
        text = [x.replace("<b>", "").replace("</b>", "") for x in (r[2] or "").replace("</p>", "\n").split("<p>")]
        lines[r[0]] = site, [x.strip() for t in text[1:] for x in t.split("\n") if x.strip() and "<" not in x]
        by_site[site].append(lines[r[0]][1])
    for row in got:
        site, own = lines[row.page_id]
        counts, n = Counter(x for p in by_site[site] for x in set(p)), len(by_site[site])
        kept = [x for x in own if not site or n < 5 or counts[x] < 2 or counts[x] <= n * 0.1]
        assert (row.site, row.site_pages, row.n_lines, row.text) == (site, n, len(own), "\n".join(kept))
        assert row.n_dropped == len(own) - len(kept)
    assert any("rare line" in r.text for r in got) and not any("menu" in r.text for r in got if r.site == "site.example")


def test_lines_of_their_own_stay_on_small_sites(spark):
    for n in (5, 9):
        rows = [(i, f"https://few.example/{i}", page("menu", f"only here {i}"), "a", 1) for i in range(n)]
        got = L.line_dedup(spark.createDataFrame(rows, PAGES)).collect()
        assert sorted(r.text for r in got) == [f"only here {i}" for i in range(n)]


def test_tags_in_capitals(spark):
    html = "<P>Upper</P><SCRIPT>var x</SCRIPT><DIV>next</DIV><StYle>a{}</sTYLE>"
    assert L.line_dedup(spark.createDataFrame([(1, "http://x.y/", html, "a", 1)], PAGES)).first().text == "Upper\nnext"


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], PAGES)).count() == 0
