import numpy as np

from kinweave.llm import site_quality as op

SCHEMA = "doc_id bigint, text string, source string, lang string, n int"


def test_logistic_finds_the_weights():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(20_000), rng.integers(0, 2, (20_000, 3))])
    p = 1 / (1 + np.exp(-(x @ [0.5, 1.0, -2.0, 0.0])))
    w = op.fit_logistic(x, (rng.random(20_000) < p).astype(float))
    assert np.abs(w - [0.5, 1.0, -2.0, 0.0]).max() < 0.15


def test_sparse_groups_shrink_more(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        p = rng.beta(8, 2, 40) * 0.5 + (k % 2) * 0.4
        rows.append((float(len(p)), float(p.sum()), float((p * p).sum())))
    groups = spark.createDataFrame(rows, "n double, good double, squares double")
    mean = sum(r[1] for r in rows) / sum(r[0] for r in rows)
    spread = np.var([r[1] / r[0] for r in rows])
    want = mean * (1 - mean) / spread - 1
    assert abs(op.strength(groups, mean) / want - 1) < 0.2
    same = spark.createDataFrame([(10.0, 8.0, 7.0)] * 5, "n double, good double, squares double")
    assert op.strength(same, 0.8) == op.MAX_STRENGTH


def test_host_record_moves_the_posterior(spark, monkeypatch):
    good = " ".join(f"word{i} text" for i in range(60)) + "."
    bad = " ".join(f"wo{i}***" for i in range(60))
    data = [(i, good, "fine", "en", 1) for i in range(60)] + [(i, bad, "spam", "en", 1) for i in range(60, 120)]
    data += [(200, "word text " * 9, "fine", "en", 1), (201, "word text " * 9, "spam", "en", 1)]
    data += [(202, None, None, None, 1), (202, "", None, "en", 1), (None, good, "new", None, 1)] * 2
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id bigint, quality int")
    rows = op.judge_sites(docs, labels).collect()
    assert len(rows) == len(data)
    by = {r.doc_id: r for r in rows}
    assert by[200].posterior > by[201].posterior and by[200].evidence == by[201].evidence
    assert all(by[i].kept for i in range(60)) and not any(by[i].kept for i in range(60, 120))
    monkeypatch.setattr(op, "fits_broadcast", lambda df: False)
    key = lambda r: (str(r.doc_id), str(r.path), round(r.posterior, 9))
    assert sorted(map(key, op.judge_sites(docs, labels).collect())) == sorted(map(key, rows))
    assert op.judge_sites(docs.limit(0), labels).count() == 0
    assert op.judge_sites(docs, labels.limit(0)).where("kept").count() >= 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op.judge_sites(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    held = rows.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    right = [r.kept == bool(r.quality) for r in held]
    clean = [r.kept for r in held if r.quality == 1]
    assert sum(right) > 0.96 * len(right) and sum(clean) > 0.98 * len(clean)


def plain_posteriors(rows, mean_of=lambda x: sum(x) / len(x)):
    """Host means, path means and posteriors of (host, path, p, evidence) rows, one by one."""
    everything = [p for _, _, p, _ in rows]
    mean = min(max((sum(everything) + 0.5) / (len(rows) + 1), 1e-4), 1 - 1e-4)

    def strength(keys):
        groups = {}
        for k, (_, _, p, _) in zip(keys, rows, strict=True):
            groups.setdefault(k, []).append(p)
        n, k = len(rows), len(groups)
        if k < 2:
            return groups, op.MAX_STRENGTH
        between = sum(len(g) * (mean_of(g) - mean) ** 2 for g in groups.values())
        within = sum(sum(p * p for p in g) - len(g) * mean_of(g) ** 2 for g in groups.values())
        noise = max(within, 0) / max(n - k, 1)
        size = n - sum(len(g) ** 2 for g in groups.values()) / n
        spread = (between - (k - 1) * noise) / size if size > 0 else 0
        return groups, op.MAX_STRENGTH if spread <= 0 else min(max(mean * (1 - mean) / spread - 1, 1), op.MAX_STRENGTH)

    hosts, of_host = strength([r[0] for r in rows])
    paths, of_path = strength([r[:2] for r in rows])
    out = []
    for host, path, p, evidence in rows:
        h, q = hosts[host], paths[(host, path)]
        host_mean = (sum(h) - p + of_host * mean) / (len(h) - 1 + of_host)
        path_mean = (sum(q) - p + of_path * host_mean) / (len(q) - 1 + of_path)
        prior = min(max(path_mean, 1e-4), 1 - 1e-4)
        out.append((host_mean, path_mean, 1 / (1 + np.exp(-(evidence + np.log(prior / (1 - prior)))))))
    return out


def test_page_posteriors_equal_plain_ones(spark):
    sf = "/root/testdata/sf0.01"
    pages, docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "documents", "labels"))
    rows = op.judge_pages(pages, docs, labels).collect()
    weights, rate = op.train(op.measure_features(docs, ["doc_id"]), labels)
    texts = {r.doc_id: r for r in op.page_documents(pages).collect()}
    assert len(rows) == len(texts) == pages.count() and len({r.host for r in rows}) > 5
    given = []
    for r in rows:
        p = 1 / (1 + np.exp(-np.clip(np.dot(weights, op.features(texts[r.doc_id].text)), -15, 15)))
        assert abs(r.evidence - (np.log(p / (1 - p)) - np.log(rate / (1 - rate)))) < 1e-9
        assert (r.host, r.path) == (texts[r.doc_id].host, texts[r.doc_id].path)
        given.append((r.host, r.path, p, r.evidence))
    for r, want in zip(rows, plain_posteriors(given), strict=True):
        assert np.abs(np.array([r.host_mean, r.path_mean, r.posterior]) - want).max() < 1e-9
        assert r.kept == (r.posterior >= op.KEEP_FROM)


def test_sites_of_addresses(spark):
    addresses = {
        "https://www.A.example.com/fr/825?page=2": ("a.example.com", "fr"),
        "http://u:p@m.b.org:8080/en/x/25#top": ("m.b.org", "en"), "//c.net/one": ("c.net", ""), "http://c.net": ("c.net", ""),
        "no address": (None, None), "": (None, None), None: (None, None),
    }
    html = "<p>a<br>b</p><script>x < y</script><!-- no -->"
    pages = spark.createDataFrame([(i, u, html) for i, u in enumerate(addresses)], "page_id bigint, url string, html string")
    got = op.page_documents(pages).orderBy("doc_id").collect()
    assert [(r.host, r.path) for r in got] == list(addresses.values())
    assert {" ".join(r.text.split()) for r in got} == {"a b"}


def test_clashing_names_and_too_many_rows(spark, monkeypatch):
    data = [(i, f"word{i} text " * 20, f"h{i % 3}", "en", 0.5, 1.0) for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, host string, path string, p double, evidence double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, quality int")
    rows = op.judge_sites(docs, labels, host="host", path="path").collect()
    assert {r.host for r in rows} == {"h0", "h1", "h2"} and len(rows) == 30
    monkeypatch.setattr(op, "MAX_ROWS_PER_ID", 1)
    try:
        op.judge_sites(docs, labels, host="host", path="path", sample=5).collect()
    except ValueError as e:
        assert "smaller sample" in str(e)
