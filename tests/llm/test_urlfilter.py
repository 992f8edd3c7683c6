import random

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from tensorloom.llm import urlfilter
from tensorloom.llm.queries import URL_RULES
from tensorloom.llm.urlfilter import DigestArray, filter_urls, judge_urls


def brute(url, rules=URL_RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fits)[1], min(fits)[2]) if fits else (host, path, None, default)


def urls():
    rng = random.Random(8)
    hosts = ["com", ".com", "example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "xexample.com", "b.net", "net", "org", "", "É.net", "a..net", "com.", "net:80"]
    paths = ["", "/", "/en", "/en/", "/EN/", "/en/x?y=/fr/", "/es/#f", "/fr/é", "?q=://x", "#/en/", "/a/en/", "//", "\\n"]
    made = [rng.choice(["http://", "://", "https://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(2000)]
    return [None, "", "plain", "http:/com/", *made, "http://" + "a." * 50000 + "net/fr/" + "p" * 100000]


def test_against_brute_force():
    array = DigestArray(DigestArray.build(URL_RULES))
    assert list(zip(*judge_urls(urls(), array, "block"))) == [brute(u, default="block") for u in urls()]
    none = DigestArray(DigestArray.build([]))
    assert [r[2:] for r in zip(*judge_urls(urls(), none, "allow"))] == [(None, "allow")] * len(urls())


def test_many_rules():
    rng = random.Random(9)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    rules = {(name(), "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(3)))): rng.choice(["allow", "block"]) for _ in range(300)}
    rules = [(*k, v) for k, v in rules.items()]
    asked = [f"http://{name()}.{name()}/{''.join(rng.choice('xy/') for _ in range(4))}" for _ in range(500)]
    array = DigestArray(DigestArray.build(rules))
    assert (np.diff(array.digests.astype(object)) > 0).all()
    assert list(zip(*judge_urls(asked, array, "allow"))) == [brute(u, rules) for u in asked]


def test_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda data: len(data) % 3)
    array = DigestArray(DigestArray.build(URL_RULES))
    assert list(zip(*judge_urls(urls(), array, "allow"))) == [brute(u) for u in urls()]
    monkeypatch.undo()
    assert xxhash.xxh64_intdigest(b"a") > 3


def test_frame(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(urls()[:200])] + [(None, "http://a.com/", None, None), (1, "http://a.net/fr/", "r", "v"), (1, "http://a.net/fr/", "r", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string").repartition(3)
    got = sorted((tuple(r) for r in filter_urls(df, URL_RULES).collect()), key=str)
    assert got == sorted([(i, *brute(u)) for i, u, _, _ in rows], key=str)
    assert filter_urls(df.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize("name, table", [("op9_url_digests", "pages"), ("op1_chat_trees", "conversations")])
def test_against_sql(spark, name, table):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, folder).select(*want.columns).toPandas()
    rows = lambda t: sorted(map(str, t.astype(object).where(t.notna(), None).values.tolist()))
    assert len(got) > 0 and rows(got) == rows(want)
