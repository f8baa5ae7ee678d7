"""Brute-force checks and stated cases: clashing names, empty tables, long texts, ties, repeated rows, null ids."""

import itertools
import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k,percent,width", [(5, 80, 64), (3, 90, 1), (2, 60, 64), (3, 100, 64)])
def test_ngram_join_of_families_long_texts_and_null_ids(spark, monkeypatch, k, percent, width):
    from varloom.llm import ngram_join as n

    monkeypatch.setattr(n, "WIDTH", width)
    monkeypatch.setattr(n, "TILE", 16)
    rng = random.Random(percent + k)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for size in (6, 20, 70, 260, 5000):  # families around the threshold, some with a passage in common
        base = [rng.choice(words) for _ in range(size)]
        for m in range(14 if size < 5000 else 4):
            t = list(base)
            for _ in range(int(size * rng.choice([0, 0.01, 0.02, 0.04, 0.06]) * (5 / k))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((None if m % 5 == 4 else len(rows), " ".join(t + (passage if m % 3 == 0 else [])), "s"))
    rows += [(None, "null one", "s"), (None, "Null  ONE", "s"), (7, "repeated id", "s"), (7, rows[0][1], "s"), (900, "null one", None)]
    sets = [shingles(t, k) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(b)] = root(a)
    low = {}
    for x, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root(x)] = min(i, low.get(root(x), i))
    want = sorted(((i, len(sets[x]), low.get(root(x))) for x, (i, _, _) in enumerate(rows)), key=str)
    d = docs(spark, rows).withColumn("node", F.lit(1)).withColumn("key", F.lit("x")).withColumn("n", F.lit(2))
    got = n.ngram_join(d.repartition(3), k, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    with pytest.raises(ValueError):
        n.ngram_join(d, k, 59)


def test_points_bound_every_overlap():
    import numpy as np

    from varloom.llm.ngram_join import may_link, point_of, read_point

    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 700, 9000):
        for share in (0.0, 0.1, 0.2, 0.4):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            b = np.unique(np.concatenate([a[int(share * len(a)) :], rng.integers(0, 2**64, int(share * len(a)), np.uint64)]))
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 80 * (len(a) + len(b) - both)
            p, q = read_point(point_of(a, 80), len(a)), read_point(point_of(b, 80), len(b))
            assert p.sum() == len(a) and (may_link(p, q, 80) or not linked)
    crowded = np.full(1000, 5, np.uint64)  # more than a byte in one group
    assert read_point(point_of(crowded, 80), 1000).max() == 1000


def best_by_brute_force(restorer, token):
    from varloom.llm import toxicity as t

    best = (-math.inf, "")
    choices = []
    for ch in token:
        own = [("read", ch, t.SAME)] if ch.isalpha() else []
        also = [("read", x, t.ALIKE) for x in t.LEET.get(ch, "")]
        gone = [] if ch.isalpha() else [("gone", "", t.LOST if also else t.MARK)]
        choices.append(own + also + gone + [("again", x, t.REPEAT + (c if x != ch else 0.0)) for _, x, c in own + also])
    for path in itertools.product(*choices):
        text, score, a, b = "", 0.0, 0, 0
        for kind, x, cost in path:
            if kind == "again":
                if not text or text[-1] != x:
                    break
            elif kind == "read":
                score += restorer.rows[a][b][t._code(x)]
                a, b, text = b, t._code(x), text + x
            score += cost
        else:
            best = max(best, (score + restorer.rows[a][b][0], text))
    return best


def test_lattice_by_brute_force():
    from varloom.llm.toxicity import CharModel, Restorer, count_trigrams, restored_words

    restorer = Restorer(CharModel(count_trigrams(iter(["idiot stupid you are an idiot the least silly stupid fool tool of all"] * 50))), {"idiot", "stupid"})
    for token in ("1d10t", "$tup1d", "iddiot", "s.t.u", "f00l", "!d!0t", "5tupp1d", "tt00l", "a"):
        got, want = restorer.search(token), best_by_brute_force(restorer, token)
        assert got[0] == pytest.approx(want[0], abs=1e-9) and got[1] == want[1]
    said = lambda text: restored_words(text, restorer)
    assert "idiot" in said("an 1d10t") and "stupid" in said("so $tup1d!") and "stupid" in said("s t u p i d") and "stupid" in said("s\tt  u p\ni d")
    assert "stupid" in said("sttuuppiidd") and "idiot" in said("i" * 90 + "diot") and "idiot" in said("xx" * 30 + "1diot" + "yy" * 30)
    assert {"you", "idiot"} <= said("y o u i d i o t")
    assert restored_words("", restorer) == set() and len(said("x1" * 20_000)) <= 2


def serialised(pieces, trainer, normalizer):
    def number(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def block(field, data):
        return number(field << 3 | 2) + number(len(data)) + data

    out = b""
    for piece, score, kind in pieces:
        out += block(1, block(1, piece.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + number(3 << 3) + number(kind))
    flags = lambda d: b"".join(number(k << 3) + number(v) for k, v in d.items())
    return out + block(2, flags(trainer)) + block(3, flags(normalizer))


def test_unigram_models_and_refused_ones():
    import sentencepiece

    from varloom.llm.sentencepiece import Codec, PieceModel

    rng = random.Random(2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    words = {"▁", *("abcde"), *["".join(rng.choice("abcde") for _ in range(rng.randint(2, 4))) for _ in range(60)]}
    words |= {"▁" + w for w in list(words)[:30] if w != "▁"}
    pieces += [(w, -rng.uniform(1, 12) - k * 1e-3, 1) for k, w in enumerate(sorted(words))]
    trainer, normalizer = {3: 1, 35: 1}, {3: 1, 4: 0, 5: 1}
    data = serialised(pieces, trainer, normalizer)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = Codec(PieceModel.parse(data))
    texts = ["".join(rng.choice("abcde  é\n") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a" * 3000, "", " ", "▁a", "xyz"]
    value = lambda ids: sum(pieces[i][1] for i in ids)  # noqa: E731  equal sums may be cut otherwise
    same = 0
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert value(ids.tolist()) == pytest.approx(value(library.encode(text)), rel=1e-5) and library.decode(ids.tolist()) == library.decode(library.encode(text)), text
        same += ids.tolist() == library.encode(text)
        assert codec.decode(ids.tolist()) == text.replace("▁", " ")
    assert same > 250
    for t, n in (({3: 3, 35: 1}, normalizer), ({3: 1}, normalizer), (trainer, {3: 1, 4: 1}), (trainer, {3: 0, 4: 0})):
        with pytest.raises(ValueError):
            PieceModel.parse(serialised(pieces, t, n))


def test_warc_assembly_in_both_directions(spark):
    from varloom.llm.warc import assemble

    head = lambda kind, i, *to: f"\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {i}\r\n" + "".join(f"WARC-Concurrent-To: {x}\r\n" for x in to) + ("WARC-Page-ID: 5\r\n" if kind == "metadata" else "")
    rows = [
        ("response", "r1", ["q1"]), ("request", "q1", []), ("metadata", "m1", ["q1"]),  # a response that names its request, metadata that names the request
        ("response", "r2", []), ("request", "q2", ["r2", "m2"]), ("metadata", "m2", []),  # a request that names both
        ("response", "r3", ["x", "q3", "m3"]), ("request", "q3", []), ("metadata", "m3", []),  # a response that names several
        ("revisit", "r4", []), ("warcinfo", "w", []), ("metadata", "orphan", ["nothing"]),
    ]
    records = spark.createDataFrame([(k, i, head(k, i, *to), "h\r\n\r\nbody") for k, i, to in rows], "type string, record_id string, headers string, block string").withColumn("target_uri", F.lit(None).cast("string"))
    got = {r["record_id"]: (r["request"] and r["request"]["record_id"], r["metadata"]["record_id"]) for r in assemble(records).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": ("q2", "m2"), "r3": ("q3", "m3"), "r4": (None, None)}
    assert assemble(records.limit(0)).count() == 0


def test_template_decides_inside_articles(spark):
    from varloom.llm.html_extract import extract_main_text

    page = "<html><body><article><h1>Story {0}</h1><p>It begins {0}.</p><div><p>Please read our other stories.</p></div><p>{1}</p></article></body></html>"
    rows = [(k, "http://h.example/%d" % k, page.format(k, "Quoted by a few." if k < 5 else f"It ends {k}.")) for k in range(24)]
    rows += [(100 + k, "http://small.example/%d" % k, page.format(k, "Quoted by all of a small host.")) for k in range(4)]
    rows += [(200, "http://h.example/long", page.format(200, "long " * 50_000)), (201, None, page.format(1, "x")), (202, "http://h.example/0", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__h", F.lit(1)).withColumn("__host", F.lit("kept")).withColumn("template", F.lit(2))
    out = extract_main_text(d).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert {r["__host"] for r in out} == {"kept"}
    assert got[0] == "Story 0\nIt begins 0.\nQuoted by a few." and got[9] == "Story 9\nIt begins 9.\nIt ends 9."
    assert "Please" in got[100] and "Quoted" in got[100] and "Please" in got[201] and got[202] == ""
    assert got[200] == "Story 200\nIt begins 200.\n" + " ".join(["long"] * 50_000)
    assert extract_main_text(d.limit(0)).count() == 0


def test_mixing_ties_shards_and_clashes(spark):
    from varloom.llm.mixing import mix_shards, mix_sources

    rows = [(i % 7, " ".join(["w"] * 300), "ab"[i % 2]) for i in range(40)] + [(None, "one two", None), (3, None, "a")]
    d = docs(spark, rows).withColumn("size", F.lit(1)).withColumn("bucket", F.lit(2))
    got = mix_sources(d)
    a, b = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, mix_sources(d.repartition(5)).collect()), key=str)
    assert a == b and len(a) == len(rows) and max(r[5] - 3 * r[2] for r in a) <= 0
    assert sum(r[5] for r in a if r[1] == "a") == pytest.approx(next(r[4] for r in a if r[1] == "a"), rel=0.05)
    slots = mix_shards(d, block_words=64, shard_slots=7).collect()
    assert len({r["shard"] for r in slots}) == math.ceil(len(slots) / 7) and max(sum(r["shard"] == k for r in slots) for k in range(5)) == 7
    assert len({sum(r["source"] == "a" for r in slots if r["shard"] == k) for k in range(20)}) > 2  # counts are drawn
    blocks = [(r["source"], r["block"]) for r in slots]
    assert max(map(blocks.count, blocks)) <= 3 and sum(s == "a" for s, _ in blocks) == round(3998.667 * 94 / 6000)
    assert mix_sources(d.limit(0)).count() == 0


def test_clashing_columns_and_empty_tables(spark):
    from varloom.llm.embedding_dedup import embedding_dedup
    from varloom.llm.exact_dedup import exact_dedup
    from varloom.llm.licenses import scan_licenses
    from varloom.llm.line_dedup import line_dedup
    from varloom.llm.sentencepiece import PieceModel, decode, encode
    from varloom.llm.toxicity import fit, score

    d = docs(spark, [(1, "Same Text", "a"), (1, "same text", "a"), (2, None, None), (None, "long " * 30_000, "a")])
    for c in ("__id", "__drops", "h1", "line", "site", "known", "words", "score", "token_ids", "__h"):
        d = d.withColumn(c, F.lit(1))
    model = PieceModel.load("/opt/tokenizers/piece_bpe_32k.model")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (d, d.limit(0)):
        n = rows.count()
        assert line_dedup(rows).count() == n and exact_dedup(rows).count() == n and scan_licenses(rows).count() == n
        assert decode(encode(rows, model), model).count() == n
        assert score(rows, fit(rows, labels)).count() == n
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.0], 3), (4, None, 3)], "vec_id long, embedding array<double>, label int").withColumn("dim", F.lit(9)).withColumn("rep", F.lit(9))
    assert sorted(map(str, (tuple(r) for r in embedding_dedup(vectors).collect()))) == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False), (4, 0, 4, True)]))
    assert embedding_dedup(vectors.limit(0)).count() == 0
