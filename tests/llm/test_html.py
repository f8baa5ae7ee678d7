"""Main text of pages: names that look like hints, and templates against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F


def main_text_of(page):
    from varloom.llm.html_extract import Page, main_text, page_tokens

    read = Page(page)
    return main_text(read, page_tokens(read), set())


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<section class="social-science"><p>Kept</p></section>', "Kept"),
        ('<div class="notice-board">Kept</div>', "Kept"),
        ('<p>Cost today <span class="share-price">$45</span> a share</p>', "Cost today $45 a share"),
        ('<p>Cost <span class="share">$45</span></p><div>and <b class="ad">bold</b></div>', "Cost $45\nand bold"),
        ('<p class="related-work">Kept</p>', "Kept"),
        ('<p>An <span class="ad-hoc">odd</span> one</p>', "An odd one"),
        ('<div id="search-results">Kept</div>', "Kept"),
        ("<p>A <label>label</label> here</p><label>Alone</label>", "A label here\nAlone"),
        ('<div class="has-sidebar login-required">Kept</div>', "Kept"),
    ],
)
def test_names_that_are_no_hints(inside, text):
    body = f"<body><nav>m</nav><article><h1>T</h1><p>One.</p>{inside}</article></body>"
    assert main_text_of(body) == "T\nOne.\n" + text


@pytest.mark.parametrize(
    "name",
    ["ad", "ad-slot-3", "ads", "share-buttons", "social_links", "cookieNotice", "related-articles", "comment-list", "post-comments", "newsletter-signup", "sidebar", "widget area", "site-footer", "article__share", "breadcrumb", "search-box"],
)
def test_names_that_are_hints(name):
    assert main_text_of(f'<body><article><h1>T</h1><p>One.</p><div class="{name}"><p>gone</p></div><span class="{name}">gone</span><p>Two.</p></article></body>') == "T\nOne.\nTwo."


def test_labels_of_forms():
    assert main_text_of("<body><article><p>One.</p><form><label>Name</label><input></form></article></body>") == "One."


def brute_templates(pages, min_pages=3, min_share=0.5, min_inside=10):
    """Template text tokens of each (host, html), by comparing whole occurrence vectors."""
    from varloom.llm.html_extract import Page, page_tokens

    hosts = defaultdict(dict)
    for host, text in pages:
        hosts[host][text] = Page(text)
    out = {}
    for host, read in hosts.items():
        counts = {text: Counter(t for t in page_tokens(page) if t) for text, page in read.items()}
        chars, size, article = {}, {}, defaultdict(set)
        for text, page in read.items():
            size[text] = 0
            for t, (kind, content, outside, inside, _) in zip(page_tokens(page), page.items, strict=True):
                if t and kind == "text":
                    size[text] += len(content)
                    chars.setdefault(t, defaultdict(int))[text] = chars.get(t, {}).get(text, 0) + len(content)
                    if inside and not outside:
                        article[text].add(t)
        classes = defaultdict(list)
        for t in set().union(*counts.values()):
            classes[tuple((text, c[t]) for text, c in sorted(counts.items()) if c[t])].append(t)
        template, wide = set(), set()
        for vector, tokens in classes.items():
            times = {n for _, n in vector}
            if len(vector) < min_pages or len(times) > 1 or len(tokens) < 2:
                continue
            long = sum(max(chars[t].values()) for t in tokens if t in chars) * times.pop()
            part, half = 2 * long * len(vector) <= sum(size[text] for text, _ in vector), len(vector) >= min_share * len(read)
            if part or half:
                template.update(tokens)
            if part and half and len(vector) >= min_inside:
                wide.update(tokens)
        for text, page in read.items():
            own = template & set(counts[text]) if not (page.has_main or page.has_article) else wide & article[text]
            own = {t for t in own if t & 1}
            if own:
                out[host, text] = own
    return out


def test_templates_against_brute_force(spark):
    from varloom.llm.html_extract import host_templates

    draw = random.Random(7)
    pages = []
    for host in ("a", "b", "c"):
        notes = [f"Note {k} of {host}" for k in range(8)]
        for k in range(30):
            story = "".join(f"<p>{draw.choice('xyz') * 3} story {k} line {n}</p>" for n in range(draw.randrange(1, 9)))
            frame = "".join(f"<div>{n}</div>" * draw.choice([1, 1, 1, 2]) for n in draw.sample(notes, draw.randrange(0, 6)))
            body = f"<article>{story}<div>Read on</div><i>here</i>{frame}</article>" if draw.random() < 0.5 else f"<div>{frame}</div>{story}<div>Call us</div>"
            pages += [(host, f"<html><body><div>Top of {host}</div>{body}</body></html>")] * draw.choice([1, 1, 2])
    d = spark.createDataFrame(pages, "host string, html string")
    keys = {(r["host"], r["page"]): r["html"] for r in d.select("host", "html", F.xxhash64("html").alias("page")).collect()}
    found = {(r["host"], keys[r["host"], r["page"]]): set(r["template"]) for r in host_templates(d).collect()}
    wanted = brute_templates(pages)
    assert wanted and found == wanted


def test_template_alone_decides(spark):
    """No page has a main, an article or a telling name: only the template tells menus from stories."""
    from varloom.llm.html_extract import extract_main_text

    rows = [(k, f"http://h.example/{k}", f"<html><body><div>Start</div><div>All topics</div><div>Story {k} begins here.</div><div>It ends after {k * 7} words.</div><div>Call us any day</div></body></html>") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} begins here.\nIt ends after {k * 7} words." for k in range(12)}
