"""Malformed and very long inputs: no crash, time in proportion, the same results as on short ones."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import decontaminate, html_tree, id_bitmap, license_scan
from creditloom.llm.queries import prepared


def blocks(html):
    return [b[5] for b in html_tree.read_page(html)]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a</p><![ x ]><p>b</p>", ["a", "b"]),
        ("<p>q<![1]]></p><p>z", ["q", "z"]),
        ("<![%foo;[ x ]]><p>k</p>", ["k"]),
        ("<p>t</p><![foo[", ["t"]),
        ("<![CDATA[x]]><p>y</p>", ["y"]),
        ("<!><p>a", ["a"]),
        ("<p>a</p><!-- open", ["a"]),
        ("<p>a</p><a href='x", ["a"]),
        ("<p>1 < 2</p> 3 < 4", ["1 < 2", "3 < 4"]),
    ],
)
def test_malformed_markup_is_skipped(html, text):
    assert blocks(html) == text


LONG_PAGES = {
    "open tags": lambda n: "<a " * n,
    "inline nesting": lambda n: "<b>" * n + "<p>x</p>" * n,
    "items under boxes": lambda n: "<ul>" + "<div>" * n + "<li>x" * n,
    "articles under inline": lambda n: "<b>" * n + "<article>x" * n,
    "sections": lambda n: "<section id=s><li>" * n,
    "siblings": lambda n: "<p>x</p>" * n,
    "marked sections": lambda n: "<![x " * n + ">",
    "quotes": lambda n: '<a b="' * n + '">x',
}


@pytest.mark.parametrize("kind", LONG_PAGES)
def test_long_pages_take_time_in_proportion(kind):
    def seconds(n):
        start = time.process_time()
        html_tree.read_page(LONG_PAGES[kind](n))
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 30 * seconds(4000) + 1


def test_a_malformed_page_does_not_stop_the_others(spark):
    rows = [(1, "http://h.org/1", "<body><article><p>a</p><![ x ]><p>b</p></article></body>", 1), (2, "http://h.org/2", "<article><p>c</p></article>", 1)]
    rows += [(2, "http://h.org/2", "<article><p>c</p></article>", 1)]
    pages = prepared(spark).createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text) for r in html_tree.main_text(pages).collect())
    assert got == [(1, "a\n\nb"), (2, "c"), (2, "c")]


def test_thousands_of_misspelt_notices():
    finder = license_scan.NoticeFinder(license_scan.NOTICES)
    n = 20_000
    start = time.process_time()
    found = finder.find("all rightz reserved / " * n)
    assert time.process_time() - start < 20
    assert found == [("reserved", 22 * k, 22 * k + 19, 1) for k in range(n)]


def test_two_notices_in_one_window():
    """A window that is long enough for two matches gives both."""
    finder = license_scan.NoticeFinder((("abcd", "x", 3),))
    found = finder.find("abcd abxd")
    assert [(s, e) for _, s, e, _ in found][:1] == [(0, 4)] and len(found) >= 2


def plain_bands(index, chars):
    """Distinct places of an item in each band of two steps, counted pair by pair."""
    own, out = decontaminate.grams(chars), {}
    for i, item in enumerate(index.items):
        step = int(index.step[i])
        for place, g in enumerate(decontaminate.grams(item)):
            for at in np.flatnonzero(own == g):
                band = (int(at) - place) // step
                for b in (band, band - 1):
                    out.setdefault((i, b * step), set()).add(place)
    return sorted(k for k, places in out.items() if len(places) >= index.bound[k[0]])


def test_bands_of_repetitive_texts(monkeypatch):
    r = random.Random(2)
    for _ in range(300):
        letters = r.choice(["ab", "a ", "abc", "a"])
        items = ["".join(r.choice(letters) for _ in range(r.randrange(1, 50))) + " " * r.choice([0, 0, 30]) for _ in range(3)]
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 120))) + " " * r.choice([0, 60]) + r.choice(items)
        index = decontaminate.Index([0, 1, 2], [decontaminate.codes(t.encode()) for t in items])
        monkeypatch.setattr(decontaminate, "PAIRS", r.choice([1, 50, 1 << 21]))
        chars = decontaminate.codes(text.encode())
        assert sorted(set(index.bands(chars))) == plain_bands(index, chars), (items, text)


def test_runs_of_one_character_stay_small():
    import tracemalloc

    item = "a" * 200 + " " * 3000 + "b" * 200
    index = decontaminate.Index([0], [decontaminate.codes(item.encode())])
    chars = decontaminate.codes((" " * 100_000 + item + " " * 50_000).encode())
    tracemalloc.start()
    try:
        found = index.bands(chars)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found and peak < 200e6


def test_repeated_items_each_match(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from it"
    docs = prepared(spark).createDataFrame([(1, f"so {item} indeed"), (2, None), (1, f"so {item} indeed")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item), (5, item), (6, item), (7, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start) for r in decontaminate.matches(docs, items).collect())
    assert got == sorted([(1, 5, 3), (1, 5, 3), (1, 6, 3)] * 2)


def test_bitmap_lets_no_id_pass(spark):
    rows = spark.range(-500, 3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("__at")).union(spark.sql("select cast(null as bigint), 'n'"))
    ids = spark.createDataFrame([(k,) for k in range(-20, 2000, 7)] + [(None,)], "i long")
    near, far = id_bitmap.split(rows, "doc_id", ids, "i")
    wanted = {r.i for r in ids.collect()}
    inside, outside = [r.doc_id for r in near.collect()], [r.doc_id for r in far.collect()]
    assert wanted <= set(inside) and not wanted & set(outside) and len(inside) + len(outside) == 3501
    assert len(inside) < len(wanted) + 20 and id_bitmap.bits_for(10**12) == id_bitmap.MOST
    none, every = id_bitmap.split(rows, "doc_id", ids.limit(0), "i")
    assert none.isEmpty() and every.count() == 3501
