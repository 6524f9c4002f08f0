"""Operators against brute force, and their defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import (
    components,
    decontaminate,
    html_tree,
    license_scan,
    minhash,
    nearest,
    pieces,
    quality,
    sharding,
    shingles,
    token_counts,
    url_filter,
)
from creditloom.llm.queries import LLM_QUERIES, prepared, vocabulary_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, `end` string"
WORDS = [a + b for a in ("th", "er", "on", "an", "re", "ti", "es") for b in ("ed", "ing", "ou", "sh", "ble", "nd", "ly")]


def docs(spark, rows):
    return prepared(spark).createDataFrame([(i, t, "en", None, 1, None, "x") for i, t in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "null id here"), (4, "Ärger é ▁ \U0001f600"), (5, prose(5, 30000)), (5, prose(5, 30000))]


# --- sharding


def jump(key, shards):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_loop_and_moves_rows_only_into_the_new_shard():
    keys = np.array([0, 1, 2, 10**12, -1, -(2**63), *range(100, 2000)], dtype=np.int64)
    for n in (1, 2, 24, 25):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    old, new = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert set(new[old != new]) == {24}


def test_shards(spark):
    got = sharding.shard_documents(docs(spark, EDGES + [(i, "x") for i in range(100, 400)]), 24).collect()
    assert len(got) == len(EDGES) + 300
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard, r.law) == (jump(key, 24), jump(key, 25), "key")
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(8, 0)}
    four = next(r for r in got if r.doc_id == 4)
    assert four.text_crc32 == zlib.crc32(EDGES[4][1].encode()) and four.size == len(EDGES[4][1].encode()) + 8
    assert sharding.shard_documents(docs(spark, []), 24).count() == 0


# --- URL filter


def test_url_rules(spark):
    urls = {
        "http://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://example.com/en/1?x#y": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://xcom/": ("xcom", "/", None, "allow"),
        "http://a.org/x?utm_source=feed": ("a.org", "/x", None, "block"),
        "http://a.org/x?autm_source=feed": ("a.org", "/x", None, "allow"),
        "http://a.org/login": ("a.org", "/login", None, "block"),
        "http://a.org/tag/b/page/3": ("a.org", "/tag/b/page/3", None, "block"),
        "no scheme com/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert got == urls
    assert url_filter.judge(rows.limit(0)).count() == 0
    assert url_filter.judge(rows, (), ()).filter("verdict = 'block'").count() == 0


def test_url_filter_is_native(spark, sf0001):
    plan = LLM_QUERIES["op2_url_filter"].build(spark, sf0001)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange", "Join"))


def test_rule_tokens():
    assert url_filter.Rule("www.example.com/en/", "allow", True).tokens == ["www", "example", "com", "en"]
    assert url_filter.Rule("/tag/*/page/", "block", False).tokens == ["tag", "page"]
    assert url_filter.Rule("ads*banner", "block", False).tokens == []


# --- quality


def test_quality_separates_held_out_rows(spark, sf001):
    got = LLM_QUERIES["op3_quality_classifier"].build(spark, sf001)
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())
    assert got.filter("score between 0 and 1").count() == 1000


def test_quality_edges(spark):
    network = quality.train([(prose(i, 50).encode(), 1) for i in range(8)] + [(b"AB!! " * 60, 0)] * 8, epochs=20)
    got = {r.doc_id: r.score for r in quality.score_documents(docs(spark, EDGES), network).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert quality.Scorer(network).score(prose(99, 50).encode()) > 0.5 > quality.Scorer(network).score(b"AB!! " * 90)
    kept = quality.keep_good(docs(spark, EDGES), network, 0.0)
    assert kept.columns == docs(spark, EDGES).columns and kept.count() == len(EDGES)
    assert quality.Scorer(quality.train([])).score(b"") == 0.5
    assert quality.score_documents(docs(spark, []), network).count() == 0


def test_chunks_cover_the_whole_text():
    """A single odd byte anywhere in a long text changes what the filters see."""
    filters = np.zeros((quality.WIDTH, 256, quality.FILTERS))
    filters[3, 35, 0] = 1
    tables = quality._pair_tables(filters)
    for size in (1, 127, 128, 129, 5000, 70000):
        for at in {3, size // 2, size - 1}:
            if 3 <= at < size:
                text = bytearray(b"a" * size)
                text[at] = 35
                assert quality._chunk_maxima(tables, quality._pad(bytes(text)))[:, 0].max() == 1


# --- license scan


def test_license_scan(spark):
    rows = [
        (10, "CC-BY, cc\nBy and General  public LICENSE. xcc by"),
        (11, "Relesed undr the MIT Licence."),
        (12, "Licensed under the Apache License, Version 2.0. All rights reserved. all rights resrved"),
        (13, prose(1, 200)),
        (14, "écc by"),
    ]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, EDGES + rows)).collect()}
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels) == (3, 0, 5, ["cc-by", "gpl"])
    assert got[11].labels == ["mit"] and got[11].n_base == 0 and 0 < got[11].score < 1
    assert got[12].labels == ["apache-2.0", "reserved"] and got[12].n_base == 1 and len(got[12].spans) == 3
    assert got[13].labels == [] and got[13].score == 0 and got[14].n_base == 0
    assert (got[1].n_words, got[1].first_word, got[1].labels) == (0, None, []) and got[5].n_words == 30000
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_notice_search_finds_what_the_whole_text_search_finds():
    r = random.Random(3)
    finder = license_scan.NoticeFinder((("released under the mit license", "mit", 3),))
    for _ in range(150):
        notice = list("released under the mit license")
        for _ in range(r.randrange(5)):
            at = r.randrange(len(notice))
            notice[at : at + 1] = r.choice(["", "x", notice[at] + "y"])
        text = prose(r.random(), 5) + " " + "".join(notice) + " " + prose(r.random(), 5)
        whole = [(m.start(), m.end()) for m in finder.patterns[0].finditer(text)]
        assert bool(whole) == bool(finder.find(text))


# --- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One
 two<br>three<p>Four <span>five</span> <script>x()</script>six</p><aside>Side</aside><form>F</form><div class="share-buttons">Share</div>
<ul><li>a<li>b</ul><section class="comments"><p>Nice!</p></section></article><footer>&copy; x</footer></body></html>"""


def text_of(spark, rows):
    pages = prepared(spark).createDataFrame([(i, u, h, "t", 5) for i, u, h in rows], "page_id long, url string, html string, text string, open int")
    return {r.page_id: r.text for r in html_tree.main_text(pages).collect()}


def test_main_text(spark):
    got = text_of(spark, [(1, "http://a.com/1", PAGE), (2, None, None), (3, "", ""), (4, "x", "<p>a <b>b</p>c<di"), (5, "http://a.com", PAGE[:330])])
    assert got[1] == "Head & more\n\nOne two three\n\nFour five six\n\na\n\nb"
    assert got[2] == got[3] == "" and got[4] == "a b\n\nc"
    assert got[5].startswith("Head & more")
    assert text_of(spark, []) == {}


def test_site_tree_removes_branches_that_all_pages_of_a_host_share(spark):
    page = '<body><div class="top"><p>Welcome to the site</p></div><div class="text"><p>{}</p><p>{}</p></div><div class="low"><p>Call us</p></div></body>'
    rows = [(i, f"http://h.org/{i}", page.format(prose(i, 20), prose(-i - 1, 20))) for i in range(12)]
    rows += [(100, "http://other.org/", page.format("only", "page"))]
    got = text_of(spark, rows)
    assert all(got[i] == f"{prose(i, 20)}\n\n{prose(-i - 1, 20)}" for i in range(12))
    assert got[100] == "Welcome to the site\n\nonly\n\npage\n\nCall us"


def test_copies_of_a_page_keep_their_text(spark):
    got = text_of(spark, [(i, "http://h.org/", "<body><div><p>same text</p></div></body>") for i in range(30)])
    assert set(got.values()) == {"same text"}


# --- near-duplicates


def brute_components(rows):
    sets = {i: set(shingles.shingle_set((t or "").encode()).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            inter = len(sets[a] & sets[b])
            if a < b and inter and 100 * inter >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def near_copies():
    rows, n = [], 0
    for family in range(8):
        base = prose(family, 60 + 20 * family).split()
        for member in range(25):
            r, own = random.Random(family * 100 + member), list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    shared = prose("shared", 60)
    rows += [(n + k, f"{shared} {prose(-k - 1, 25)}") for k in range(60)]
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = near_copies() + [(900, "a b c"), (901, "A  B\tc"), (902, "a b"), (903, ""), (904, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_deduplicate_keeps_one_row_of_each_group(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(7, a), (3, a), (3, a), (9, b), (9, c), (None, b), (None, prose(4, 40)), (None, prose(4, 40)), (11, ""), (12, None), (None, "")]
    kept = minhash.deduplicate(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (9, b), (9, c), (None, prose(4, 40)), (11, ""), (12, None), (None, "")], key=str)
    assert minhash.deduplicate(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}


# --- token counts


def greedy(vocabulary, word):
    at = count = 0
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in vocabulary), 0)
        if not size:
            return 1
        at, count = at + size, count + 1
    return count


def test_automaton_counts_greedy_pieces():
    r = random.Random(1)
    for _ in range(60):
        vocabulary = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        automaton = token_counts.Automaton(vocabulary)
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randrange(12)))
            assert automaton.count(word) == greedy(vocabulary, word), (vocabulary, word)


def test_token_counts(spark):
    vocabulary = token_counts.load_pieces(vocabulary_file("word_bpe_49k.json"))
    letters, known = token_counts.byte_letters(), set(vocabulary)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs(spark, EDGES), vocabulary).collect()}
    for doc_id, text in EDGES:
        found = token_counts.WORD.findall((text or "").lower())
        assert got[doc_id] == (len(found), sum(greedy(known, "".join(letters[b] for b in w.encode())) for w in found))
    assert token_counts.count_tokens(docs(spark, []), vocabulary).count() == 0


# --- nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def test_recall_and_scores_on_the_table(spark, sf001):
    got = LLM_QUERIES["op8_nearest_neighbours"].build(spark, sf001).collect()
    table = spark.read.parquet(f"{sf001}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table])
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q, best in found.items():
        scores = (x * x[ids == q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        assert sorted(best) == list(range(1, 21))
        assert all(abs(scores[ids == v][0] - s) < 1e-12 for v, s in best.values())
        hits += len({ids[i] for i in order} & {v for v, _ in best.values()})
    assert len(found) == 25 and hits >= 0.9 * 25 * 20


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [9.0, 1.0]), (20, [0.0, 1.0]), (40, [0.0, 0.0])]
    rows += [(60, None), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 0.0]), (140, [1.0]), (None, [1.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.search(vectors(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 3, 9.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0)]
    assert {q for q, *_ in got} == {0, 20}
    assert nearest.search(vectors(spark, [])).count() == 0


def test_search_stops_early_on_clustered_rows_with_full_recall():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(1, 32)) * 3 + r.normal(size=(200, 32)) * 0.05 for _ in range(40)])
    index = nearest.BlockIndex(np.arange(len(x)), x, float(np.sqrt((x * x).sum(axis=1)).max()))
    hits = seen = 0
    for q in range(0, len(x), 400):
        ids, _, verified = index.search(q, x[q], 20)
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        hits += len(set(ids) & set(np.argsort(-scores)[:20]))
        seen += verified
    assert hits >= 0.9 * 20 * 20 and seen < 0.7 * 20 * len(x)


def test_chi_square():
    assert abs(nearest.chi_square_below(nearest.chi_square_quantile(0.95, 8), 8) - 0.95) < 1e-9
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(vocabulary_file("piece_bpe_32k.model"))


def test_round_trip(spark, vocabulary):
    encoded = pieces.encode(docs(spark, EDGES).withColumn("original", F.col("text")), vocabulary)
    back = pieces.decode(encoded, vocabulary)
    assert all(r.text == r.original for r in back.collect())
    assert encoded.filter("doc_id = 1 and ids is null").count() == 1 and encoded.filter("doc_id = 2 and size(ids) = 0").count() == 1
    assert pieces.encode(docs(spark, []), vocabulary).count() == 0


def best_score(vocabulary, text):
    score = {p: s for p, _, s in vocabulary.pieces}
    worst = min(score.values()) - pieces.PENALTY
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + worst
        for begin in range(max(0, end - 20), end):
            if text[begin:end] in score:
                best[end] = max(best[end], best[begin] + score[text[begin:end]])
    return best[-1]


def test_paths_have_the_best_score_of_the_whole_text(vocabulary):
    codec = pieces.Codec(vocabulary)
    score = {i: s for _, i, s in vocabulary.pieces}
    worst = codec.unknown
    for text in ("Hello  world", prose(3, 12), "  lead", "tail  ", "a\nb", "The quick brown fox über"):
        marked = pieces.BLANK + text.replace(" ", pieces.BLANK)
        total, rest = 0.0, 0
        for i in codec.encode(text):
            rest -= 1
            if i in score:
                total += score[i]
            elif rest <= 0:  # the first byte of a character stands for it
                byte = codec.table[i][0]
                rest = 1 + (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
                total += worst
        assert total == pytest.approx(best_score(vocabulary, marked))


def test_crossing_pieces_are_refused():
    with pytest.raises(ValueError, match="cross"):
        pieces.Codec(pieces.Vocabulary((("a▁b", 3, -1.0),), tuple(range(256))))


# --- decontamination


def test_decontamination(spark):
    item = prose("item", 30)
    edited = item.replace("th", "ht", 2).upper()
    broken = " ".join(w[::-1] for w in item.split())
    rows = EDGES + [(20, f"{prose(1, 50)} {item} {prose(2, 50)}"), (21, f"{prose(3, 9)}\n{edited}"), (22, broken), (23, item[: len(item) // 2]), (24, f"{item} x {item}")]
    rows += [(25, prose(8, 40000) + " " + item + " " + prose(9, 40000))]
    benchmark = spark.createDataFrame([(1, item, 0), (2, "", 0), (3, None, 0), (4, "zqzqz", 0)], "item_id long, text string, doc_id long")
    found = decontaminate.matches(docs(spark, rows), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(20, 1), (21, 1), (24, 1), (24, 1), (25, 1)]
    by = {r.doc_id: r for r in found}
    assert by[20].edits == 0 and dict(rows)[20][by[20].start : by[20]["end"]] == item and 0 < by[21].edits <= len(item) // 10
    kept = decontaminate.clean(docs(spark, rows), benchmark)
    assert kept.columns == docs(spark, rows).columns and kept.count() == len(rows) - 4
    assert decontaminate.matches(docs(spark, []), benchmark).count() == 0
    assert decontaminate.matches(docs(spark, rows), benchmark.limit(0)).count() == 0


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_every_passage_within_the_budget_is_found():
    r = random.Random(4)
    for trial in range(60):
        item = prose(trial, 12)
        own = list(item)
        for _ in range(r.randrange(2 * decontaminate.budget(len(item)))):
            at = r.randrange(len(own))
            own[at : at + 1] = r.choice([[], ["x"], [own[at], "y"]])
        text = prose(trial + 500, 20) + " " + "".join(own) + " " + prose(trial + 900, 20)
        index = decontaminate.Index([1], [decontaminate.codes(item.encode())])
        got = index.matches(decontaminate.codes(text.encode()))
        distance = plain_distance(item, text)
        assert bool(got) == (distance <= decontaminate.budget(len(item))) and all(g[3] == distance for g in got[:1])


def test_capitals_of_every_script_are_no_edits(spark):
    item = "L’été où l’élève dévoué répétait à la forêt, Ελλάδα στους δρόμους, Москва широкая река, œuvre naïve et çà et là"
    text = f"ß İ \U0001f600 {item.upper()} ẞ"
    benchmark = spark.createDataFrame([(1, item, 0)], "item_id long, text string, doc_id long")
    found = decontaminate.matches(docs(spark, [(1, text), (2, item.swapcase())]), benchmark).collect()
    assert sorted((r.doc_id, r.start, r.end, r.edits) for r in found) == [(1, 6, 6 + len(item), 0), (2, 0, len(item), 0)]
    assert decontaminate.clean(docs(spark, [(1, text), (3, "other")]), benchmark).collect()[0].doc_id == 3
    assert decontaminate.codes("ẞᾈİß".encode()).tolist() == [ord(c) for c in "ßᾀİß"]


def test_adjacent_copies_beside_a_long_item_are_all_found():
    r = random.Random(9)
    long = prose("long", 400)
    for trial in range(25):
        item = prose(trial + 70, 16)
        copies = [list(item) for _ in range(r.randrange(2, 6))]
        for own in copies:
            for _ in range(r.randrange(decontaminate.budget(len(item)) + 1)):
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice([[], ["x"], [own[at], "y"]])
        text = prose(trial + 30, 5) + r.choice(["", " "]).join("".join(own) for own in copies) + prose(trial + 40, 5)
        k = decontaminate.budget(len(item))
        index = decontaminate.Index([1, 2], [decontaminate.codes(long.encode()), decontaminate.codes(item.encode())])
        found = sorted(m[1:] for m in index.matches(decontaminate.codes(text.encode())))
        assert len(found) >= len(copies) - 1 and all(plain_distance(item, text[s:e]) == edits <= k for s, e, edits in found)
        cuts = [0, *(x for s, e, _ in found for x in (s, e)), len(text)]
        assert cuts == sorted(cuts) and all(plain_distance(item, text[a:b]) > k for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    middle = "qq" + item[2:]
    found = index.matches(decontaminate.codes(f"{item} {middle} {item}".encode()))
    assert [m[3] for m in found if m[0] == 1] == [0, 2, 0]


def test_misspelt_notices_side_by_side_are_all_found():
    label = "all rights reserved"
    finder = license_scan.NoticeFinder(((label, "reserved", 2),))
    assert finder.find("all rightz reserved / all rights reserved") == [("reserved", 0, 19, 1), ("reserved", 22, 41, 0)]
    r = random.Random(12)
    for _ in range(150):
        parts = []
        for _ in range(r.randrange(1, 6)):
            own = list(label)
            for _ in range(r.randrange(4)):
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice([[], ["z"], [own[at], "z"]])
            parts.append("".join(own))
        text = r.choice(["", " ", " / ", "\n(c) "]).join(parts)
        found = finder.find(text)
        assert all(plain_distance(label, text[s:e]) <= edits <= 2 for _, s, e, edits in found)
        cuts = [0, *(x for _, s, e, _ in found for x in (s, e)), len(text)]
        assert cuts == sorted(cuts) and all(plain_distance(label, text[a:b]) > 2 for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def test_role_words_inside_other_names_drop_no_text(spark):
    article = """<body><article><h1 id="comments">A</h1><h2 id="login-form">B</h2><p class="notice">C <span class="comment">D</span></p>
<section id="discussion"><h2 id="search">E</h2><p>F</p></section><section id="related-work"><p>G</p></section><div class="long-form"><p>H</p></div>
<div class="share-buttons">x</div><ul id="related"><li>x</ul><div class="text ad">x</div></article><div id="sidebar">x</div></body>"""
    wrapped = '<body><div id="site-header">x</div><div class="content with-sidebar"><p>A</p></div><div class="sidebar"><p>x</p></div></body>'
    got = text_of(spark, [(1, "http://a.com/1", article), (2, "http://b.com/1", wrapped)])
    assert got[1].split() == list("ABCDEFGH") and got[2] == "A"
