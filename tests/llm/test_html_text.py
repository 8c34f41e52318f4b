"""Main text of pages: known articles, made hosts, classes against explicit occurrence vectors."""

import html as codec
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from wardflow.llm import html_text

SCHEMA = "page_id long, url string, html string, host string, slot long, text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 5, "mine") for r in rows], SCHEMA).repartition(4)


def texts(spark, rows, **kw):
    got = html_text.main_text(frame(spark, rows), **kw)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = defaultdict(list)
    for r in got.collect():
        assert r.n_chars == len(r.text)
        found[r.page_id].append(r.text)
    return found


def inside_article(page):
    """The text of these pages' one article, read by replacing its few tags."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
    body = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)>", "\0", body)))
    return "\n".join(x for x in (" ".join(codec.unescape(b).split()) for b in body.split("\0")) if x)


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    want = {r.page_id: (r.url, inside_article(r.html), len(inside_article(r.html))) for r in pages.collect()}
    assert got == want


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(n))


def plain_host(host, n, first):
    """A host without telling names: only what its pages share and link tells its frame from its texts."""
    rnd, rows, want = random.Random(host), [], {}
    for i in range(n):
        title, paragraphs = words(rnd, 5), [words(rnd, rnd.randrange(3, 60)) for _ in range(rnd.randrange(1, 7))]
        if i % 3 == 0:
            paragraphs.append("A closing line that many pages have in common.")
        links = "".join(f'<li><a href="/{words(rnd, 1)}">{words(rnd, 2)}</a></li>' for _ in range(rnd.randrange(2, 6)))
        page = (f"<html><head><title>{title}</title></head><body><div class='a1'><div class='a2'>Welcome to our site</div><ul>{links}</ul></div>"
                f"<div class='b{i}'><h1>{title}</h1><div class='c'>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div></div>"
                "<div class='d'><p>Call us on weekdays.</p><p>All rights reserved</p></div></body></html>")
        rows.append((first + i, f"https://user@{host.upper()}:80/x?{i}", page))
        want[first + i] = "\n".join([title, *paragraphs])
    return rows, want


def named_host(host, n, first):
    rnd, rows, want = random.Random(host), [], {}
    for i in range(n):
        body = [words(rnd, rnd.randrange(3, 40)) for _ in range(rnd.randrange(1, 5))]
        page = (f"<!DOCTYPE html><HTML><body class='has-sidebar'><form id=all><header><h1>Site</h1></header><nav>{words(rnd, 4)}</nav>"
                f"<div id='cookieNotice'>{words(rnd, 9)}</div><main><div class='breadcrumbs'>{words(rnd, 3)}</div>"
                f"<article class='post comments-open'><header><h2>{words(rnd, 1)}{i}</h2></header>" + "".join(f"<p>{b}" for b in body) +
                f"<table><tr><td>cell &lt;{i}&gt;<td>two</table><div class=\"ad-slot\">{words(rnd, 5)}</div><p>Share this with all your friends</p>"
                f"<script>if (a < b) document.write('<p>no</p>')</script></article>"
                f"<section id=comments><article class=comment>{words(rnd, 80)}</article></section></main>"
                f"<aside>{words(rnd, 50)}</aside><div role=complementary>{words(rnd, 7)}</div><footer>&copy; {words(rnd, 3)}</footer></form>")
        rows.append((first + i, f"http://{host}/{i}", page))
        head = re.search("<h2>(.*?)</h2>", page).group(1)
        want[first + i] = "\n".join([head, *body, f"cell <{i}>", "two"])
    return rows, want


def test_hosts_with_and_without_names(spark):
    rows, want = plain_host("plain.example", 40, 0)
    more, also = named_host("named.example", 30, 1000)
    got = texts(spark, rows + more)
    assert {i: t for i, (t,) in got.items()} == {**want, **{i: t for i, t in also.items()}}


def test_copies_do_not_make_a_text_fixed(spark):
    rows, want = plain_host("plain.example", 12, 0)
    rows += [(100 + i, "https://plain.example/copy", rows[4][2]) for i in range(200)]
    got = texts(spark, rows)
    assert all(got[i] == [t] for i, t in want.items()) and all(got[100 + i] == [want[4]] for i in range(200))


def test_odd_pages(spark):
    long = "<div>" * 3000 + "deep" + "<p>x y" * 20_000
    rows = [(1, None, None), (2, "", ""), (3, "no url", "just text &amp; more\n\n here"), (4, "http://a/", "<p>one<p>two<!-- never closed <p>three"),
            (5, "http://a/", "<p>one <b>bold</b>er</p><script>var x = 1"), (6, "http://a/", "<p title='quote>broken<p>tail"), (None, "http://n/", "<p>null id"),
            (7, "http://b/", "<p>twice"), (7, "http://b/", "<p>twice"), (8, "http://c/", long), (9, "http://d/", "a < b and c > d <3 </ x> e<br>f"),
            (10, "http://e/", "<article>" + "&nbsp;&#x41;&eacute;　z " * 3 + "</article>outside"), (11, "http://f/", "<nav>only a menu</nav>")]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[11] == [""] and got[3] == ["just text & more here"] and got[4] == ["one\ntwo"]
    assert got[5] == ["one bolder"] and got[6][0].endswith("tail") and got[None] == ["null id"] and got[7] == ["twice", "twice"]
    assert got[8] == ["deep\n" + "\n".join(["x y"] * 20_000)] and got[9] == ["a < b and c > d <3 e f"] and got[10] == ["Aé z Aé z Aé z"]
    assert texts(spark, []) == {}


def test_classes_are_those_of_occurrence_vectors(spark):
    """Classes and their validity against vectors written out page by page."""
    rows, _ = plain_host("plain.example", 9, 0)
    more, _ = named_host("plain.example", 5, 100)
    crossed = [(200 + i, "http://x/", f"<div class=p>{i}<div class=q>b</div></div>" if i % 2 else f"<div class=q>{i}<div class=p>b</div></div>")
               for i in range(6)]
    rows += more + crossed + [(300, "http://alone/", rows[0][2])]
    template, _ = html_text._deduce(html_text._pages(frame(spark, rows)), 20)
    got = {(r.host, tuple(c["tags"])) for r in template.collect() for c in r.classes or []}
    pages = defaultdict(list)
    for _, url, page in rows:
        host = "plain.example" if "plain" in url.lower() else url.split("/")[2]
        pages[host].append([t[0] for t in html_text.walk(page) if t[0] >= 0])
    want = set()
    for host, lists in pages.items():
        counts = [Counter(tags) for tags in lists]
        groups = defaultdict(list)
        for tag in set().union(*counts):
            vector = tuple(c[tag] for c in counts)
            if sum(map(bool, vector)) >= max(min(2, len(lists)), len(lists) / 20):
                groups[vector].append(tag)
        groups = [g for g in groups.values() if len(g) > 1]
        for g in groups:
            runs = [[t for t in tags if t in g] for tags in lists]
            order = next(list(dict.fromkeys(r)) for r in runs if r)
            if any(r != order * (len(r) // len(order)) for r in runs):
                continue
            want.add((host, tuple(sorted(g))))
    # In order everywhere, but crossing: div.p and div.q of host x hold one another in turn.
    assert got <= want and {h for h, _ in want - got} <= {"x"} and len(got) >= 10


def test_slots_of_a_template(spark):
    rows, _ = plain_host("plain.example", 40, 0)
    slots = html_text.templates(frame(spark, rows)).collect()
    assert sum(r.dropped for r in slots) >= 3 and sum(not r.dropped for r in slots) >= 2
    assert sum(r.words for r in slots if not r.dropped) == sum(len(t.split()) for t in plain_host("plain.example", 40, 0)[1].values())


def test_soundness():
    cls = {1: "A", 2: "A", 3: "B", 4: "B"}
    check = lambda tokens: {c: ok for c, _, ok in html_text._soundness(tokens, cls)}
    assert check([1, 3, 4, 3, 4, 2]) == {"A": True, "B": True}
    assert check([1, 3, 2, 4]) == {"A": True, "B": False}
    assert check([1, 2, 2, 1]) == {"A": False} and check([1, 2, 1]) == {"A": False}


def test_a_hot_host_is_spread(spark):
    rows, want = plain_host("hot.example", 400, 0)
    df = frame(spark, rows).repartition(8)
    busy = html_text.main_text(df).withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert busy >= 4
