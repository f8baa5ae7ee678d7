"""Cases of the review: what the operators once left out, and what the fixes must not undo."""

import pytest
from pyspark.sql import functions as F


def html_text(page):
    from varloom.llm.html_extract import Page, main_text, page_tokens

    read = Page(page)
    return main_text(read, page_tokens(read), set())


@pytest.mark.parametrize("hint", ["layout has-sidebar", "no-sidebar", "social-sciences", "login-required", "nav-fixed"])
def test_hints_never_drop_the_article(hint):
    page = f'<html><body><div class="{hint}"><nav>m</nav><article><h1>T</h1><p>One.</p></article><div class="sidebar">s</div></div><footer>f</footer></body></html>'
    assert html_text(page) == "T\nOne."
    assert html_text(page.replace("article", "div")) == "T\nOne."
    assert html_text(page.replace("article", "main")) == "T\nOne."


def test_hints_still_drop_lists_of_articles():
    assert html_text('<body><div><p>A story of some length</p></div><div class="related"><article>teaser</article></div>') == "A story of some length"
    assert html_text('<body><article><p>Story</p></article><div class="comments"><article>a comment longer than it</article></div>') == "Story"


def test_text_of_math_object_and_noscript_stays():
    assert html_text("<body><article><p>a <math><mi>x</mi></math> b <object>c</object> <noscript>d</noscript></p></article>") == "a x b c d"
    assert html_text("<body><article><p>a</p><select><option>no<p>b</p><svg><text>no</text><p>c</p></article>") == "a\nb\nc"


def test_each_page_design_of_a_host_has_its_template(spark):
    from varloom.llm.html_extract import extract_main_text

    rows = []
    for k in range(24):
        d = k % 4  # four designs, none on half of the pages
        rows.append((k, "http://h.example/%d" % k, f"<html><body><div>Menu of design {d}</div><div><p>Story {k} begins and goes on.</p><p>And ends after {k * 7} words.</p></div><div>Call {d}</div></body></html>"))
    copy = "<html><body><div><p>One copied story.</p><p>It has two paragraphs.</p></div><div>seen %d times</div></body></html>"
    rows += [(100 + k, "http://h.example/c%d" % k, copy % k) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Story {k} begins and goes on.\nAnd ends after {k * 7} words." for k in range(24))
    assert all(got[100 + k] == f"One copied story.\nIt has two paragraphs.\nseen {k} times" for k in range(3))


def test_short_boilerplate_lines_go_when_the_floor_is_one(spark):
    from varloom.llm.line_dedup import line_dedup

    rows = [(k, f"own {k}\nLes.\n\n", "en", f"s{k}", 0) for k in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(d, min_chars=1).collect()} == {k: (f"own {k}\n\n", 1) if k else ("own 0\nLes.\n\n", 0) for k in range(12)}


def test_licenses_by_clauses_holders_and_expressions(spark):
    from varloom.llm.licenses import scan_licenses

    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of Example Org. Inc nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    rows = {
        apache: ["Apache-2.0"], apache.replace("you may ", "you may\n"): ["Apache-2.0"], bsd.replace("Org. Inc", "Org"): ["BSD-3-Clause"], lgpl: ["LGPL-2.1-or-later"],
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later WITH Classpath-exception-2.0": ["Apache-2.0", "GPL-2.0-or-later", "MIT"], "// SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0-or-later"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": ["MPL-2.0"], "This is free and unencumbered software released into the public domain.": ["Unlicense"],
        "This module is distributed under the GNU Affero General Public License, version 3.": ["AGPL-3.0-only"], "The ISC License": ["ISC"], "SPDX-License-Identifier: EPL-2.0": ["EPL-2.0"], "Released under the Zlib License.": ["Zlib"],
        "Licensed under the Example Private License.": [], "a license is a license": [],
    }
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (list(r["licenses"]), list(r["unknown"])) for r in scan_licenses(d).collect()}
    assert [got[k][0] for k in range(len(rows))] == list(rows.values())
    assert [got[k][1] for k in (len(rows) - 2, len(rows) - 1)] == [["Licensed under the Example Private License"], []]


def test_disguises_of_every_length_and_spacing_are_undone():
    from varloom.llm.toxicity import CharModel, Restorer, count_trigrams, restored_words

    known = {"snorkwit", "zug", "extraordinarilygrumblefex"}
    plain = ["ka lo mi te su ran del kalo mite suran delka letter"] * 20 + ["snorkwit zug extraordinarilygrumblefex"] * 20
    restorer = Restorer(CharModel(count_trigrams(plain)), known)
    for text, word in [
        ("sn" + "o" * 60 + "rkwit", "snorkwit"), ("ssnnoorrkkwwiitt", "snorkwit"), ("sn" + "0" * 60 + "rkw1t", "snorkwit"), ("ka z u g mi", "zug"), ("s  n\to\nr k  w i t", "snorkwit"),
        (" ".join("extraordinarilygrumblefex"), "extraordinarilygrumblefex"), ("".join(a * 3 for a in "snorkwit") + "-" + "0" * 40 + "kalo" * 40, "snorkwit"), ("x1-" * 50 + "sn0rkwit" + "-1x" * 50, "snorkwit"),
    ]:
        assert word in restored_words(text, restorer), text
    assert "letter" in restored_words("ka letter", restorer)


def test_warc_payloads_and_urls_that_end_in_a_version(spark, tmp_path):
    from varloom.llm.warc import assemble, read_records, write_archives

    rows = [(1, "http://a.example/WARC/1.1", "x"), (2, "http://b.example/", "text WARC/1.1"), (3, "c", "WARC/1.1\r"), (4, "WARC/1.1", "WARC/1.1")]
    path = str(tmp_path / "warc")
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r["metadata"]["page_id"]: (r["response"]["payload"], r["response"]["payload_bytes"], r["target_uri"]) for r in assemble(read_records(spark, path)).collect()}
    assert got == {i: (h, len(h), u.replace("WARC/1.1", "WARC/1%2E1")) for i, u, h in rows}
    cut = str(tmp_path / "cut")
    spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 9\r\n\r\nshort\r\n",)], "value string").write.option("lineSep", "\r\n").text(cut)
    with pytest.raises(Exception, match="cut at a wrong place"):
        read_records(spark, cut).select("block").collect()


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as p

    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (0, b + " tail", "x"), (None, a, "x"), (None, "its own words stand here alone", "x"), (None, "its own words stand here alone", "x"), (5, "", "x"), (5, None, "x")]
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in p.near_copies(spark, d, "").collect()), key=str)
    assert got == sorted([(1, a), (0, b + " tail"), (None, "its own words stand here alone"), (5, ""), (5, None)], key=str)


def test_disguises_without_letters_with_signs_and_in_pieces():
    from varloom.llm.toxicity import CharModel, Restorer, count_trigrams, restored_words

    plain = ["you are an idiot so stupid the least of all fools and you know that it is the one thing to say"] * 40 + ["asse stupid idiot asse"] * 20
    restorer = Restorer(CharModel(count_trigrams(plain)), {"stupid", "idiot", "asse"})
    for text, word in [
        ("4$$e", "asse"), ("@$$3", "asse"), ("4 $ $ 3", "asse"), ("you/stupid", "stupid"), ("you.idiot", "idiot"), ("so...you,idiot!", "idiot"), ("s.t.u.p.i.d", "stupid"),
        ("it is st up id.", "stupid"), ("s tu pid", "stupid"), ("s tu p1d", "stupid"), ("ѕtupіd", "stupid"), ("іdiоt", "idiot"), ("you-$tup1d/1d10t", "stupid"),
    ]:
        assert word in restored_words(text, restorer), (text, restored_words(text, restorer))
    assert restored_words("455 1,000 12:30 1 2 3", restorer) == set()
    assert not {"stupid", "idiot", "asse"} & restored_words("as se. stu pid, id io, t the state of it is to be", restorer)
