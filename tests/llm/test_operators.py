"""The training-data operators against brute force on small fixtures, with nulls, ties and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def components(sets, linked):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(sets[a], sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_exact_dedup(spark):
    from varloom.llm.exact_dedup import exact_dedup

    rows = [(1, "Ab É", "x"), (2, "aB É", "x"), (3, "ab é", "x"), (4, None, "x"), (5, "", None), (6, "z" * 50_000, "x"), (6, "q", "x"), (None, "Q", "x")]
    got = sorted((tuple(r) for r in exact_dedup(docs(spark, rows).withColumn("h", F.lit(1))).collect()), key=str)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = []
    for i, t, _ in rows:
        n = (t or "").translate(LOWER)
        keep = max((x for x in groups[n] if x is not None), default=None)
        want.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup(docs(spark, []).limit(0)).count() == 0


def test_line_dedup(spark):
    from varloom.llm.line_dedup import line_dedup

    common = "a line that every site repeats"
    rows = [(k, f"own line of document number {k}\n{common} \nshort", f"s{k % 12}") for k in range(24)] + [(50, None, "s1"), (51, "", None), (52, common, None)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(docs(spark, rows), min_sites=10).collect()}
    assert got[0] == (rows[0][1], 0)
    for k in range(1, 24):
        assert got[k] == (f"own line of document number {k}\nshort", 1)
    assert got[50] == (None, 0) and got[51] == ("", 0) and got[52] == ("", 1)
    assert all(n == 0 for _, n in ((r["text"], r["n_removed"]) for r in line_dedup(docs(spark, rows), min_sites=14).collect()))


def test_near_threshold_lines_are_counted_exactly(spark):
    from varloom.llm.line_dedup import spread_of_lines

    rows = [(h, 0, d, f"site{d}") for h, n in ((1, 999), (2, 1000), (3, 1001), (4, 300), (5, 3000)) for d in range(n)]
    lines = spark.createDataFrame(rows, "h1 long, h2 long, doc_id long, site string")
    assert sorted(r["h1"] for r in spread_of_lines(lines, 1000, lg_k=8).collect()) == [2, 3, 5]


def test_warc_round_trip(spark, tmp_path):
    from varloom.llm.warc import assemble, read_records, write_archives

    big, evil = "é" * 700, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 1000
    rows = [(1, "http://a.example/x?y=1", big), (2, "http://b.example/", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "http://c.example/ a\nb", evil), (7, "h", None), (8, "h", ""), (None, "n", "null id"), (9, "r", "w\r\n\r\n"), (9, "r", "w\r\n\r\n")]
    path = str(tmp_path / "warc")
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    out = assemble(read_records(spark, path)).collect()
    got = sorted(((r["metadata"]["page_id"], r["response"]["payload_bytes"], r["response"]["payload_digest"], r["record_type"], r["response"]["refers_to"]) for r in out), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [x for x, _, t in rows if (t or "") == (h or "")]
        again = len(b) >= 1000 and i != max(same)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert got == sorted(want, key=str)
    payloads = {r["metadata"]["page_id"]: r["response"]["payload"] for r in out if r["record_type"] == "response"}
    assert payloads[6] == evil and payloads[3] == big and payloads[9] == "w\r\n\r\n"
    assert all(r["request"]["block"].startswith("GET / HTTP/1.1\r\n") for r in out)
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))


def test_license_scan(spark):
    from varloom.llm.licenses import RULES, SENTENCES, scan_licenses

    assert {i for r, _ in RULES for i in r.split()} <= set(SENTENCES.values())
    mit = "The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n"
    rows = [(1, "Text.\nLicensed under CC BY-NC 4.0.", "s"), (2, "x. Licensed under the Apache License, Version 2.0. Released under the MIT License.", "s"), (3, "a license is a license", "s"), (4, None, "s"), (5, "", "s"), (6, mit, "s"), (7, "SPDX-License-Identifier: GPL-3.0-only", "s"), (8, "All rights reserved.", "s"), (9, "This work is licensed under the GNU General Public License, version 3.", "s")]
    got = {r["doc_id"]: (list(r["licenses"]), r["n_unmatched"]) for r in scan_licenses(docs(spark, rows)).collect()}
    assert got == {1: (["CC-BY-NC-4.0"], 0), 2: (["Apache-2.0", "MIT"], 0), 3: ([], 0), 4: ([], 0), 5: ([], 0), 6: (["MIT"], 0), 7: (["GPL-3.0-only"], 0), 8: ([], 1), 9: (["GPL-3.0-only"], 0)}


def test_sentencepiece_equals_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    from varloom.llm.queries import TOKENIZER
    from varloom.llm.sentencepiece import PieceModel, decode, encode

    rng = random.Random(2)
    parts = list(" \n\t▁aabeétionTheüñ.😀½x\x1f中") + ["  ", "the ", "ing", "ation", "ﬁ", "    "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 3000, " " * 90, "word " * 3000, "", None, "\n", "<s> x </s>"]
    model = PieceModel.load(TOKENIZER)
    sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decode(encode(df, model), model).collect()}
    for k, t in enumerate(texts):
        ids = got[k]["token_ids"]
        assert ids == (None if t is None else sp.encode(t)), repr(t)
        assert got[k]["decoded"] == (None if t is None else t.replace("▁", " "))


def test_html_extraction(spark):
    from varloom.llm.html_extract import extract_main_text

    head = '<html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>'
    page = head + '<main><article><header><h1>A &lt;b&gt; &amp; c</h1><p>by Bob</p></header><p>One <i>two</i>three<br>four\n  five</p><div class="share-buttons">Share</div><ul><li>x<li>y</ul><aside>side</aside><form>f</form><section id="comments"><p>nice</p></section><script>var t="</p>";</script><p>Last &nbsp; one</article></main><footer>c</footer></body></html>'
    plain = [f"<html><body><div>All our sites</div><div><p>Story {k} begins.</p><p>And ends {k * 7}.</p></div><div>Call us</div></body></html>" for k in range(6)]
    rows = [(1, "http://h.example/1", page), (2, None, None), (3, "x", ""), (4, "http://h.example/2", "<nav>menu</nav>")] + [(10 + k, f"http://p.example/{k}", h) for k, h in enumerate(plain)] + [(20, "http://h.example/3", page)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[20] == "A <b> & c\nOne twothree four five\nx\ny\nLast one"
    assert got[2] == got[3] == got[4] == ""
    assert all(got[10 + k] == f"Story {k} begins.\nAnd ends {k * 7}." for k in range(6))


def test_toxicity(spark):
    from varloom.llm.toxicity import fit, held_out, score

    rng = random.Random(4)
    words = ["".join(rng.choice(["ka", "lo", "mi", "te", "su", "ran", "del"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["grumblefex", "snorkwit", "bluntozar"]
    rows, labels = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(40)]
        y = int(k % 4 == 0)
        if y:
            for w in rng.sample(bad, 2):
                text.insert(rng.randrange(40), w)
        rows.append((k, " ".join(text), "s"))
        labels.append((k, 1, y))
    rows += [(1000, "ka lo gr0mblefex mi", "s"), (1001, "you sn0rkw1t and grumbl3fex", "s"), (1002, "ka lo s n o r k w i t g r u m b l e f e x", "s"), (1003, "snoooorkwit bluntozzzar", "s"), (1004, None, "s"), (1005, "", "s"), (1006, "ka lo mi te", "s")]
    d = docs(spark, rows)
    model = fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: (r["score"], r["h"]) for r in score(d, model).withColumn("h", held_out()).collect()}
    held = [k for k in range(600) if got[k][1]]
    assert 150 < len(held) < 250 and all((got[k][0] >= 0.7) == (k % 4 == 0) for k in held)
    assert all(got[k][0] >= 0.7 for k in (1001, 1002, 1003)) and all(got[k][0] < 0.7 for k in (1004, 1005, 1006))
    nothing = fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert score(d, nothing).agg(F.max("score")).first()[0] < 0.01


@pytest.mark.parametrize("k,percent,tile", [(3, 90, 512), (5, 80, 512), (3, 90, 8)])
def test_ngram_join(spark, monkeypatch, k, percent, tile):
    from varloom.llm import ngram_join as n

    monkeypatch.setattr(n, "TILE", tile)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(4):
        base = [rng.choice(words) for _ in range(rng.choice([30, 80, 180]))]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = rng.choice(words).upper()
            rows.append((len(rows), " ".join(t), "s"))
    rows += [(len(rows) + i, t, "s") for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", "a b c d", "A b\tc  d"])]
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    want = components(sets, lambda a, b: a and 100 * len(a & b) >= percent * len(a | b))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.ngram_join(docs(spark, rows).repartition(3), k, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert n.ngram_join(docs(spark, []).limit(0)).count() == 0


def test_mixing(spark):
    from varloom.llm.mixing import mix_sources

    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), s) for i, s in enumerate(rng.choices(["b", "a", "c", "é", None], [60, 30, 6, 2, 4], k=700))] + [(900, None, "a")]
    got = mix_sources(docs(spark, rows)).collect()
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", "é", None)}
    weight = dict(zip(("a", "b", "c", "é", None), (1, 2, 3, 1, 2), strict=True))
    target, free, left = {}, dict(weight), float(sum(sizes.values()))
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del free[s]
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(target[s], rel=0.03)
    again = mix_sources(docs(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mix_sources(docs(spark, []).limit(0)).count() == 0


def test_embedding_dedup(spark):
    import numpy as np

    from varloom.llm.embedding_dedup import embedding_dedup

    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 24))
    rows = [(i, (base[i % 6] + rng.normal(scale=0.27, size=24)).astype(np.float32).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(5)] + [(300, None, 0), (301, [0.0] * 24, 0), (302, [float("nan")] * 24, 0), (303, [1.0, None], 0), (304, rows[0][1], None), (305, [], 1), (306, [1.0, 2.0], 0)]
    v = {i: np.array(x, float) for i, x, l in rows if l is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    label = {i: l for i, _, l in rows}

    def linked(a, b):
        return label[a] == label[b] and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.93

    want = components({i: i for i in v}, linked)
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows_per_group=40).collect()}
    for i, _, _ in rows:
        n = sum(linked(i, j) for j in v if j != i) if i in v else 0
        assert got[i] == (n, want.get(i, i), want.get(i, i) == i)
    assert len({c for c in want.values()}) < len(want)


def test_components_by_rounds(spark):
    from varloom.llm.common import connected_components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    for local in (0, 10, 1000):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), local_edges=local).collect()}
        assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)), f"s{i % 12}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "s0") for i in range(10)] + [(200 + i, f"a boilerplate line that all have\nown {i} words of text", f"s{i}") for i in range(12)] + [(300, None, None), (301, "", "s1")]
    d = docs(spark, rows)
    assert [name for name, _ in p.STAGES] == ["toxicity", "line dedup", "n-gram join", "mixing", "sentencepiece"]
    after = p.lines(spark, d, "")
    assert after.columns == p.COLUMNS and sum("boilerplate" in (r["text"] or "") for r in after.collect()) == 1
    kept = {r["doc_id"] for r in p.near_copies(spark, after, "").collect()}
    assert {i for i in range(60)} <= kept and not kept & set(range(100, 110)) and {300, 301} <= kept
    mixed = p.mixing(spark, d, "")
    assert mixed.columns == p.COLUMNS and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    assert p.tokens(spark, d, "").where("n_tokens is null").count() == 1
