import random

import duckdb
import numpy as np
import pytest

from slidespark.llm import url_filter as U

from ..differential import compare

CASES = {
    "http://Shop.COM/a?b": ("shop.com", "/a", "com/", "allow"),
    "https://www.example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "https://example.com/en": ("example.com", "/en", "com/", "allow"),
    "http://x.net/es/1#f": ("x.net", "/es/1", "net/es/", "block"),
    "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "http://kinet/fr/": ("kinet", "/fr/", None, "allow"),
    "http://com?x": ("com", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "no scheme": ("", "", None, "allow"),
}


def test_rules(spark):
    rows = [(i, u, None, "e") for i, u in enumerate(CASES)] + [(99, None, None, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.digest(df).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    assert got[99] == ("", "", None, "allow")
    assert U.digest(df.limit(0)).count() == 0


def test_propagation_matches_power_iteration(spark):
    links = {"good.com": ["mid.org"], "mid.org": ["end.org", "bad.net"], "bad.net": ["end.org"], "spam.org": ["bad.net", "bad.net/x", "mid.org"], "end.org": []}
    paths = {"good.com": "/", "bad.net": "/es/", "mid.org": "/", "end.org": "/", "spam.org": "/"}
    rows = [(i, f"http://{h}{paths[h]}", " ".join(f'<a href="http://{x}">' for x in out)) for i, (h, out) in enumerate(links.items())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in U.judge(df, threshold=0.2, averaged=False).collect()}
    names = list(links)
    edge = {(a, x.split("/")[0]) for a, out in links.items() for x in out}

    def spread(pairs, seed):
        out = {a: [b for p, b in pairs if p == a] for a in names}
        m, s = dict(seed), dict(seed)
        for _ in range(U.ROUNDS):
            new = {h: (1 - U.DAMPING) * s[h] + (U.DAMPING * m[h] if not out[h] else 0.0) for h in names}
            for a in names:
                for b in out[a]:
                    new[b] += U.DAMPING * m[a] / len(out[a])
            m = new
        return m

    trust = spread(edge, {h: float(h == "good.com") for h in names})
    distrust = spread({(b, a) for a, b in edge}, {h: float(h == "bad.net") for h in names})
    for h in names:
        assert got[h].trust == pytest.approx(trust[h]) and got[h].distrust == pytest.approx(distrust[h])
    assert got["spam.org"].verdict == ("block" if distrust["spam.org"] >= 0.2 and distrust["spam.org"] > trust["spam.org"] else "allow")
    assert np.isclose(sum(distrust.values()), sum(r.distrust for r in got.values()))


def test_means_do_not_fall_with_the_number_of_linkers(spark):
    links = {"bad.net": [], "good.com": ["fine.org"], "fine.org": ["bad.net", *(f"n{i}.org" for i in range(9))], "far.org": ["farm0.org"]}
    links |= {f"farm{i}.org": ["bad.net"] for i in range(30)}
    rows = [(i, f"http://{h}{'/es/' if h == 'bad.net' else '/'}", " ".join(f'<a href="http://{x}">' for x in out)) for i, (h, out) in enumerate(links.items())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in U.judge(df).collect()}
    assert all(got[f"farm{i}.org"].verdict == "block" and got[f"farm{i}.org"].distrust == pytest.approx(U.DAMPING) for i in range(30))
    assert got["far.org"].verdict == "block" and got["far.org"].distrust == pytest.approx(U.DAMPING**2)
    assert got["fine.org"].verdict == "allow" and got["fine.org"].distrust == pytest.approx(U.DAMPING / 10)
    assert got["fine.org"].trust == pytest.approx(U.DAMPING)
    split = {r.host: r.verdict for r in U.judge(df, averaged=False).collect()}
    assert split["farm1.org"] == "allow"


def graph(seed, hosts=40):
    r = random.Random(seed)
    names = [f"h{i}.{r.choice(['com', 'net', 'net', 'net', 'org'])}" for i in range(hosts)]
    page = lambda: " ".join(f'<a href="http://{r.choice(names)}/{r.choice("xyz")}">' for _ in range(r.randint(0, 6)))
    urls = [f"https://{h}/{r.choice(['es/', 'fr/', 'en/'])}{i}" for h in names for i in range(r.randint(1, 4))]
    rows = [(i, u, page()) for i, u in enumerate(urls)]
    return [*rows, rows[0], (None, None, None), (len(rows), "no scheme", page()), (len(rows) + 1, "http://x.org", "<a href='//y.org'>" * 20_000)]


@pytest.mark.parametrize("averaged", [True, False])
def test_graphs_agree_with_sql(spark, tmp_path, averaged):
    spark.createDataFrame(graph(4), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    out = U.judge(spark.read.parquet(f"{tmp_path}/pages.parquet"), averaged=averaged, threshold=0.02).select("page_id", "host", "path", "rule", "verdict")
    assert compare(out, con, U.oracle(averaged=averaged, threshold=0.02)) == ""
    by_links = out.where("rule is null").groupBy("verdict").count().collect()
    assert len(by_links) == 2 or not averaged
