"""URL filters, whitening and clustering against brute force."""

import hashlib
import math
import random
from decimal import Decimal

import numpy as np
import pytest

from scarpline.llm import centroids, url_filter, whitening
from scarpline.llm.spectrum import Spectrum

# --- 11 ---

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.Example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.net", "/e", "allow"), ("net", "/es", "block"), ("net", "/es", "allow"), ("org", "", "block"), ("", "", "block"), ("exam", "ple.com/", "block"), ("a/b", "", "block")]
URLS = [
    "http://example.com/en/x?y#z", "https://WWW.EXAMPLE.COM/en/", "http://a.www.example.com/en/q", "http://notexample.com/en/", "http://example.com", "http://example.com?/en/", "http://b.net/es/1", "http://a.b.net/esx", "http://net/es/", "http://x.net/e",
    "ftp://org", "org/x", "://org#f", "", None, "http://", "no scheme", "http://a.com:80/en/", "http://u@example.com/en/", "http://example.com./en/", "http://a//b/c", "http://éx.com/é", "http://x.com/" + "é" * 30_000, "http://" + "a." * 5000 + "com/en/", "http://example.com/en/x?y#z",
]


def judged(url, rules, default="allow"):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host, after = rest[: ends[0]] if ends else rest, rest[ends[0] :] if ends else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = after[: min((after.index(c) for c in "?#" if c in after), default=len(after))]
    fits = [(len(h + p), len(h), a, h + p) for h, p, a in ((h.lower(), p, a) for h, p, a in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    won = max(fits, default=(0, 0, default, None))
    return host, path, won[3], won[2]


@pytest.mark.parametrize("options", [{}, {"prefix_bytes": 1}, {"broadcast_rules": 0}, {"broadcast_rules": 0, "prefix_bytes": 1}])
def test_url_filter(spark, options):
    dice = random.Random(3)
    label = lambda: dice.choice(["a", "b", "example", "www", "com", "net", "x"])
    path = lambda: "/" + "/".join(dice.choice(["en", "es", "e", "x.html"]) for _ in range(dice.randrange(3)))
    urls = URLS + [f"http://{'.'.join(label() for _ in range(dice.randrange(1, 5)))}{path()}" for _ in range(200)]
    rules = RULES + [(".".join(label() for _ in range(dice.randrange(1, 4))), path(), dice.choice(url_filter.ACTIONS)) for _ in range(60)]
    pages = spark.createDataFrame([(i, u, "h", "v", 7) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, n int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string"), **options).collect()}
    kept = [r for r in rules if r[0] != "a/b" and (r[1] == "" or r[1].startswith("/"))]
    assert got == {i: judged(u, kept) for i, u in enumerate(urls)}


def test_url_filter_with_hot_urls_and_prefixes(spark):
    urls = ["http://a.com/en/"] * 3000 + [f"http://b{i}.net/es/{i}" for i in range(3000)]
    rules = spark.createDataFrame(RULES[:5], "host string, path string, action string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, rules, broadcast_rules=0)
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == [(i, *judged(u, RULES[:5])) for i, u in enumerate(urls)]


def test_url_filter_of_empty_tables(spark):
    rules, pages = spark.createDataFrame(RULES, "host string, path string, action string"), spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert [tuple(r) for r in url_filter.judge(pages, rules.limit(0), default="block").select("host", "path", "rule", "verdict").collect()] == [("a.com", "/", None, "block")] * 2
    for wrong in ((None, "/", "allow"), ("a", None, "allow"), ("a", "/", "maybe"), ("a", "/", None)):
        with pytest.raises(ValueError):
            url_filter.judge(pages, spark.createDataFrame([wrong], "host string, path string, action string"))


# --- 12 ---


@pytest.mark.parametrize("kind", ["normal", "scaled", "repeated", "axes", "constant", "one"])
def test_spectrum_is_that_of_the_scatter(kind):
    dice = np.random.default_rng(4)
    x = {
        "normal": dice.normal(size=(300, 24)) * 300, "scaled": dice.normal(size=(300, 24)) * np.logspace(0, 4, 24), "repeated": np.repeat(dice.integers(-3, 3, (6, 24)), 20, axis=0).astype(float),
        "axes": np.tile(np.eye(24), (6, 1)) * 50, "constant": np.ones((9, 24)), "one": dice.normal(size=(40, 1)),
    }[kind]
    whole, parts = Spectrum.empty(x.shape[1]), [Spectrum.empty(x.shape[1]) for _ in range(3)]
    for i, row in enumerate(x):
        whole.add(row)
        parts[i % 3].add(row)
    parts[0].merge(Spectrum.unpacked(parts[1].packed(), x.shape[1]))
    parts[0].merge(parts[2])
    away = x - x.mean(0)
    scatter = away.T @ away
    for s in (whole, parts[0]):
        scale = max(np.abs(scatter).max(), 1e-300)
        assert s.n == len(x) and np.allclose(s.mean, x.mean(0)) and (np.diff(s.values) >= 0).all()
        assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() / scale < 1e-12 and np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12


def test_whitening(spark):
    dice = np.random.default_rng(5)
    x = (dice.normal(size=(400, 12)) * np.linspace(0.1, 1, 12)).astype(np.float32)
    x[:, 3] = 0.25
    rows = [(i, [float(c) for c in v], "w") for i, v in enumerate(x)] + [(7, [float(c) for c in x[7]], "w")]
    odd = [(-1, None), (-2, []), (-3, [1.0] * 11), (-4, [1.0] * 11 + [None]), (-5, [float("nan")] * 12), (-6, [float("inf")] * 12), (-7, [1e30] * 12)]
    table = spark.createDataFrame(rows + [(i, v, "w") for i, v in odd], "vec_id long, embedding array<float>, whitened string").repartition(37)
    found = whitening.fit(table, components=20)
    y = np.floor(1024 * np.vstack([x, x[7]]).astype(float)).astype(np.int64) + 100_000
    n, s = len(y), y.sum(0)
    away = (n * y - s) / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    values, axes = values[::-1][:11], axes[:, ::-1][:, :11]  # the constant column has no component
    assert found.n == n and (found.sums == s).all() and len(found.values) == 11
    assert np.abs(found.values / values - 1).max() < 1e-12 and abs(found.trace / np.trace(away.T @ away / n) - 1) < 1e-12
    assert np.abs(np.abs((found.components * axes.T).sum(1)) - 1).max() < 1e-12
    assert whitening.identity_error(table, found) < 1e-10
    got = sorted(whitening.transform(table, found).collect(), key=lambda r: r.vec_id)
    assert [r.vec_id for r in got] == sorted([*range(400), 7])
    expected = away @ axes * np.sign((found.components * axes.T).sum(1)) / np.sqrt(values)
    for r in got:
        assert np.abs(np.array(r.whitened) - expected[r.vec_id]).max() < 1e-9
        assert int(r.deviation) == sum(int(d) ** 2 for d in n * y[r.vec_id] - s)


def test_whitening_of_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [])]):
        table = spark.createDataFrame(rows, schema)
        assert whitening.fit(table) is None and whitening.transform(table, None).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)
    found = whitening.fit(same)
    assert [(r.deviation, r.whitened) for r in whitening.transform(same, found).collect()] == [(Decimal(0), [])] * 2 and whitening.identity_error(same, found) == 0
    far = spark.createDataFrame([(i, [x]) for i, x in enumerate((60_000.0, -60_000.0))] + [(i + 2, [0.0]) for i in range(3000)], schema).coalesce(3)
    top = max(whitening.transform(far, whitening.fit(far)).collect(), key=lambda r: r.deviation)
    assert int(top.deviation) == (3002 * 60_000 * 1024) ** 2
    assert whitening.length_of(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema)) == 1


# --- 13 ---


def lloyd(rows, k, rounds, salt="3"):
    """(id, cluster, distance) and centroids of rows (id, integers), in plain loops."""
    name = lambda i: hashlib.sha256(f"{salt}:{'null' if i is None else i}".encode()).hexdigest()
    at = [list(v) for _, v in sorted(rows, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        at = [[sum(col) // own.count(j) for col in zip(*(v for (_, v), o in zip(rows, own, strict=True) if o == j), strict=True)] if j in own else c for j, c in enumerate(at)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in rows], at


def table_of(spark, rows, parts=5):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else c / 1024 for c in v], 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(parts)


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_clustering(spark, rounds):
    dice = random.Random(6)
    rows = [(i, [int(dice.gauss(900 * (i % 5), 60)), int(dice.gauss(-700 * (i % 3), 60)), dice.randrange(-5, 5)]) for i in range(600)]
    rows += [(None, [5, 5, 5]), (None, [5, 5, 5]), (3, rows[3][1])] + [(1000 + i, [i % 3, i % 2, 0]) for i in range(40)]  # repeated rows, ties
    odd = [(-1, None), (-2, [1, 2]), (-3, [1, None, 2]), (-4, [float("nan")] * 3), (-5, [float("inf")] * 3), (-6, [1 << 40] * 3), (-7, [])]
    got = centroids.cluster(table_of(spark, rows + odd), dims=3, k=6, rounds=rounds)
    expected, at = lloyd(rows, 6, rounds)
    order = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted((tuple(r) for r in got.rows.collect()), key=order) == sorted(expected, key=order) and got.centroids == at
    assert got.sizes == [sum(r[1] == j for r in expected) for j in range(6)] and got.inertia == [sum(r[2] for r in expected if r[1] == j) for j in range(6)]
    assert got.digests()[0] == hashlib.sha256(",".join(map(str, at[0])).encode()).hexdigest()
    assert rounds < 6 or sum(got.popped[2:]) < 0.7 * len(rows) * len(got.popped[2:])  # the heaps leave most rows alone


def test_clustering_of_few_and_equal_rows(spark):
    assert centroids.cluster(table_of(spark, []), dims=3).rows.collect() == []
    few = [(i, [i, 0, 0]) for i in range(3)]
    assert sorted(tuple(r) for r in centroids.cluster(table_of(spark, few), dims=3).rows.collect()) == sorted(lloyd(few, 8, 10)[0])
    same = [(i, [7, 7, 7]) for i in range(30)]
    got = centroids.cluster(table_of(spark, same), dims=3, k=4)
    assert {(r.cluster, r.distance) for r in got.rows.collect()} == {(0, 0)} and got.sizes == [30, 0, 0, 0] and len(got.popped) == 1
    assert [r.cluster for r in centroids.cluster(table_of(spark, few), dims=3, k=1).rows.collect()] == [0, 0, 0]
    assert math.isclose(sum(centroids.cluster(table_of(spark, few), dims=3, k=1, rounds=2).inertia), 2)
