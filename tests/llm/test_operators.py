"""Each operator against a plain version, and its defined results for nulls, ties, empty tables and odd columns."""

import gzip
import hashlib
import json
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gumshoe.llm import (
    components,
    decontamination,
    embedding_neighbours,
    html_extraction,
    html_tree,
    language_id,
    mixing,
    ngram_join,
    stages,
    suffix_dedup,
    token_files,
    toxicity,
    warc,
)
from gumshoe.llm.queries import vocabulary

DOCS = "doc_id long, text string, source string, key string, tie int"  # with names that operators use inside


def words(random, n, size=400):
    return " ".join(f"w{random.integers(size)}x" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    random = np.random.default_rng(5)
    rows = [(i, words(random, int(random.integers(5, 120))), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(6)]  # exact copies
    rows += [(200 + i, rows[i][1] + " end", None) for i in range(10, 16)]  # near copies
    rows += [(300, None, "s1"), (301, "", "s1"), (302, "...", "s1"), (None, "no id here at all", "s1"), (303, "É é ﬁn", "s2")]
    rows += [(304, "long " * 30_000, "s2"), (7, rows[7][1], "s2"), (None, None, None)]
    return spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS)


def empty(docs):
    return docs.where("doc_id = -1")


def test_decontamination(spark, docs):
    rows = docs.collect()
    passage = rows[3]["text"].split()
    items = [(1, " ".join(passage[:12])), (2, "no id"), (3, None), (4, "?"), (None, " ".join(passage[:12])), (11, "LONG long"), (5, "absent words")]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontamination.contamination(docs, items).drop("key").collect()), key=str)
    want = []
    for r in rows:
        w = decontamination.words_of(r["text"])
        hit, found = set(), set()
        for i, text in [tuple(x) for x in items.collect()]:
            t = decontamination.words_of(text)
            for p in [t[k : k + 10] for k in range(max(1, len(t) - 9))] if t else []:
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        found |= {i} - {None}
        ids = ",".join(sorted(map(str, found)))
        want.append((r["doc_id"], len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)
    assert decontamination.contamination(empty(docs), items).count() == 0
    assert not decontamination.contamination(docs, items.where("item_id = -1")).where("contaminated").count()


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d a x b"), (2, "b a"), (3, None)], "doc_id long, text string")
    index = decontamination.build_index(docs)
    phrase = spark.createDataFrame([(["a", "b"], ["i"])], "terms array<string>, items array<string>")
    assert [tuple(r)[:2] for r in decontamination.phrase_matches(index, phrase).collect()] == [(1, 0)]
    near = decontamination.near_matches(index, phrase, 3).collect()
    assert sorted((r["doc_id"], r["start"], r["n_words"]) for r in near) == [(1, 0, 2), (1, 4, 3), (2, 0, 2)]


def test_a_row_group_of_the_index_holds_few_shards(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 80)
    docs = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    index = decontamination.build_index(docs)
    files = [pq.ParquetFile(path.removeprefix("file://")).metadata for path in index.inputFiles()]
    groups = [meta.row_group(i).num_rows for meta in files for i in range(meta.num_row_groups)]
    assert sum(groups) >= 150 and max(groups) <= decontamination.SHARDS_A_GROUP


def test_a_block_of_phrases_is_small_and_searched_in_turns(spark, monkeypatch):
    terms = [[f"word{i + j}" for j in range(10)] for i in range(5000)]
    block = decontamination.Phrases(pa.table({"terms": terms, "items": [[str(i)] for i in range(5000)]}))
    assert len(pickle.dumps(block)) < 5000 * 100  # as lists of texts: more than 700 bytes each in a worker
    assert block.terms(70) == terms[70] and block.items_of(np.array([4, 3])) in (["3", "4"], ["4", "3"])
    monkeypatch.setattr(decontamination, "PLACES", 3)
    texts = [["b", "a", "b", "a", "b"], ["a", "c"], ["b"]]
    shard = decontamination._shard(0, [1, 2, 3], [1, 2, 3], texts)
    shard = decontamination.Shard({name: shard[name][0].values for name in shard.schema.names[1:]})
    which, start = decontamination.Phrases(pa.table({"terms": [["a", "b"], ["b"], ["c", "a"], ["b", "a", "b"]]})).search(shard)
    at = shard.document_of(start)
    assert sorted(zip(which.tolist(), at.tolist(), (start - shard.first[at]).tolist())) == [
        (0, 0, 1), (0, 0, 3), (1, 0, 0), (1, 0, 2), (1, 0, 4), (1, 2, 0), (3, 0, 0), (3, 0, 2)
    ]


def jaccard_classes(rows):
    grams = [set(map(int, ngram_join.grams_of(r["text"]))) for r in rows]
    n = len(rows)
    link = [[i != j and bool(grams[i]) and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) > 0 for j in range(n)] for i in range(n)]
    a, b = np.nonzero(np.array(link))
    root = components.roots(n, a, b)
    names = {}
    for i in range(n):
        if rows[i]["doc_id"] is not None:
            names[root[i]] = min(names.get(root[i], 1 << 60), rows[i]["doc_id"])
    return [(r["doc_id"], names.get(root[i]), int(sum(link[i]))) for i, r in enumerate(rows)]


def test_ngram_join(docs):
    rows = docs.collect()
    got = [tuple(r) for r in ngram_join.classes_of(docs).select("doc_id", "class_id", "n_links").collect()]
    assert sorted(got, key=str) == sorted(jaccard_classes(rows), key=str)
    assert ngram_join.classes_of(empty(docs)).count() == 0
    left = stages.one_of_each_class(docs)
    assert left.columns == docs.columns and left.where("doc_id >= 100 and doc_id < 300").count() == 0
    assert left.where("doc_id = 7").count() == 1


def test_ngram_blocks(spark, monkeypatch):
    """Groups larger than a block give the same links."""
    random = np.random.default_rng(1)
    base = words(random, 150).split()
    texts = [" ".join(base[: 75 + i % 7] + [f"q{i}"] + base[75 + i % 7 :]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, ngram_join.classes_of(docs).collect()))
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    assert sorted(map(tuple, ngram_join.classes_of(docs).collect())) == whole
    assert {r[2] for r in whole} == {0} and min(r[3] for r in whole) == 39


def test_prefixes_adapt_to_what_a_class_meets():
    def missed(depths):
        return np.prod([1 - ngram_join.THRESHOLD**d for d in depths])

    alone = ngram_join.shortened({})
    assert missed(alone) <= 1 - ngram_join.RECALL < missed([d + 1 for d in alone])
    crowd = {ngram_join.place_of(t, d): 10 ** (9 - d) for t in range(8) for d in (5, 6, 7)}  # eight trees with ever larger nodes
    kept = ngram_join.shortened(crowd)
    assert missed(kept) <= 1 - ngram_join.RECALL
    assert kept[:8].count(ngram_join.DEPTH) >= 4 and kept[8:] == [ngram_join.LEAST] * 12  # made up for in the other trees
    one = {ngram_join.place_of(t, d): 2 for t in range(20) for d in (5, 6)}
    assert ngram_join.shortened(one) == alone  # a single other text does not turn a class away
    everywhere = ngram_join.shortened({ngram_join.place_of(t, d): 10 ** (9 - d) for t in range(20) for d in (5, 6, 7)}, recall=1.0)
    assert set(everywhere) == {ngram_join.LEAST}


def test_recall_at_the_threshold(spark):
    """Pairs that share just 0.8 of their word runs, each with texts of its own."""
    random, rows = np.random.default_rng(12), []
    for i in range(400):
        text = [f"p{i}w{j}" for j in range(204)]
        cut = text[:180] + [f"p{i}x{j}" for j in range(24)]  # 176 of 200 runs stay: 176 / 224 is too little, so 178
        cut = text[:182] + cut[182:]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(cut))]
    a, b = (set(map(int, ngram_join.grams_of(rows[k][1]))) for k in (0, 1))
    assert 0.8 <= len(a & b) / len(a | b) < 0.81
    random.shuffle(rows)
    got = ngram_join.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count()
    assert got >= 0.99 * len(rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (5, 5), (3, 4), (4, 1)]
    got = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert dict(map(tuple, got)) == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body><header>Site</header>
<nav><ul><li><a href=/a>Menu</a><li><a href="/b">More</a></ul></nav><div class="cookie-notice">We use cookies</div>{body}
<form>Mail <input></form><section id=comments><p>Nice!</p></section><footer>&copy; 2024</footer></body></html>"""


def test_html_article(spark):
    html = PAGE.format(body="<article><h1>Head&shy;line</h1><p>One <b>two<br>three<p>A &lt; B&nbsp;&nbsp;C<script>x()</script></p><ul><li>i<li>ii</ul></article>")
    rows = [(1, "http://h/1", html), (2, None, None), (3, "http://h/3", ""), (4, "x", "<p>unclosed <a href='"), (1, "http://h/1", html)]
    got = {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head\xadline\n\nOne two three\n\nA < B C\n\ni\n\nii" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "unclosed"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extract(none).count() == 0


def test_html_template(spark):
    body = "<div><p>Welcome to the site</p><div><p>{0} first</p><p>{0} second</p></div></div>"
    rows = [(i, f"http://Host/{i}", PAGE.format(body=body.format(f"text{i}"))) for i in range(4)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"text{i} first\n\ntext{i} second" for i in range(4)}


def extracted(spark, bodies):
    rows = [(i, f"http://h/{i}", PAGE.format(body=body)) for i, body in enumerate(bodies)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_copies_are_no_template(spark):
    assert extracted(spark, ["<div><p>Only text</p></div>"] * 2) == ["Only text"] * 2
    body = "<div><p>Welcome</p><div><h2>T{0}</h2></div>{1}</div>"
    rare = [body.format("copy", "<div><pre>Only here</pre></div>")] * 3
    got = extracted(spark, [body.format(i, "") for i in range(6)] + rare)
    assert got == [f"T{i}" for i in range(6)] + ["Tcopy\n\nOnly here"] * 3
    shared = [body.format(i, "<div><pre>On two pages</pre></div>") for i in range(2)]
    assert extracted(spark, shared + [body.format(7, "")]) == ["T0", "T1", "T7"]


def test_template_inside_marked_article(spark):
    body = "<p>Outside {0}</p><article><h1>T{0}</h1><p>{0} text</p><div><p>By the staff</p></div><ul><li>Get our letter</ul></article>"
    assert extracted(spark, [body.format(i) for i in range(3)]) == [f"T{i}\n\n{i} text" for i in range(3)]
    body = "<p>Outside {0}</p><article><p>The same article</p></article>"  # nothing in it varies
    assert extracted(spark, [body.format(i) for i in range(3)]) == ["The same article"] * 3


def test_constant_headings_and_quotes_stay(spark):
    article = "<article><h1>T{0}</h1><h2>Ingredients</h2><ul><li>{0} eggs</ul><h2>Method</h2><p>Take {0} and stir</p><blockquote>Enjoy!</blockquote>{1}</article>"
    box = "<h3>Our letter</h3><div><p>Get it now</p></div>"
    for more in ("", box):
        got = extracted(spark, ["<p>Hello</p>" + article.format(i, more) for i in range(3)])
        want = "T{0}\n\nIngredients\n\n{0} eggs\n\nMethod\n\nTake {0} and stir\n\nEnjoy!"
        assert got == [want.format(i) for i in range(3)]


def test_names_beside_an_unmarked_article():
    page = "<main><h1>a</h1><p>b</p><div class=share-buttons>s</div><div class='post-comments'>c</div><div class=newsletter-box>n</div><p class=comment>r</p></main>"
    assert html_extraction.main_text(page) == html_extraction.main_text(page.replace("main>", "article>")) == "a\n\nb"


def without_names(html):
    """The page with all its parts as plain divs: no element or class name tells what they are."""
    html = re.sub(r"<(/?)(?:article|main|nav|aside|footer|header|section)\b[^>]*>", r"<\1div>", html)
    return re.sub(r"\s(?:class|id|role|itemprop)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)


def test_wrapper_finds_the_article_of_the_given_pages(spark):
    """On pages that no name helps with, the wrapper decides: with it nearly all texts are those of the marked article, without it none."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    busy = pages.withColumn("host", html_extraction.host_of(F.col("url"))).groupBy("host").agg(F.count("*").alias("n")).where("n >= 3")
    rows = pages.withColumn("host", html_extraction.host_of(F.col("url"))).join(busy, "host").select("page_id", "url", "html").collect()
    assert len(rows) > 150
    bare = spark.createDataFrame([(r["page_id"], r["url"], without_names(r["html"])) for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(bare).collect()}
    want = {r["page_id"]: html_extraction.main_text(r["html"]) for r in rows}
    alone = {r["page_id"]: html_extraction.main_text(r["html"]) for r in bare.collect()}
    right = lambda found: np.mean([found[i] == want[i] for i in want])
    assert right(got) > 0.95 and right(alone) < 0.05


def test_names_and_links_keep_article_text():
    parts = "<section id='social-impact'><h2 id='cookies'>A</h2><p>b</p></section><div id='menu-costs'>c</div><p class=notice>d</p>"
    for page in (f"<article>{parts}</article>", f"<main>{parts}</main>", parts):
        assert html_extraction.main_text(page) == "A\n\nb\n\nc\n\nd"
    assert html_extraction.main_text("<article><section id=cookies>a</section><div class='x related'>b</div></article>") == "a"
    assert html_extraction.main_text("<main><article>a</article><div id=comments>b</div></main>") == "a"
    assert html_extraction.main_text("<div><p>a</p><p><a href=/s>Source one</a></p></div><div class=top-menu>m</div>") == "a\n\nSource one"


def test_formulas_and_fields_are_text():
    def blocks(html):
        return [t for _, t, _ in html_tree.Page(html).blocks]

    assert blocks("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then</p>") == ["If x=1 then"]
    page = html_tree.Page("<p>See <svg><title>icon</title><style>p{}</style><text>Fig</text><text>2</text></svg>.</p><p>b")
    assert [t for _, t, _ in page.blocks] == ["See Fig 2 .", "b"] and page.title == ""
    assert blocks("<object data=x><p>instead</p></object><noscript>plain</noscript><p>b") == ["instead", "plain", "b"]
    assert blocks("<svg><g><p>a</p><nav>n</nav><svg/><p>b") == ["a", "n", "b"]  # svg left open
    assert blocks("<select><option>i<option>ii</select><textarea><b>t &amp; u</textarea>v") == ["i", "ii", "<b>t & u", "v"]
    form = "<article>a <math><mi>y</mi></math><select><option>i</select><textarea>t</textarea></article>"
    assert html_extraction.main_text(form) == "a y"


def test_tree_matching_is_best():
    """Against trying all order-keeping pairings of children."""
    from itertools import combinations

    def best(a, b):
        if a.label != b.label:
            return 0
        n = min(len(a.children), len(b.children))
        return 1 + max(
            sum(best(x, y) for x, y in zip(p, q, strict=True))
            for k in range(n + 1)
            for p in combinations(a.children, k)
            for q in combinations(b.children, k)
        )

    texts = ["a(b,c(d),b)", "a(c(d,e),b,b(c))", "a(b(c(d)),c)", "x"]
    shapes = [html_extraction.wrapper_of(t)[0] for t in texts]
    for a in shapes:
        for b in shapes:
            assert html_extraction.matched(a, b, {}) == best(a, b) == len(list(html_extraction.align(a, b, {})))


def test_deep_page():
    page = html_tree.Page("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after")
    assert [t for _, t, _ in page.blocks] == ["deep", "after"]
    assert html_extraction.main_text("<div>" * 5000 + "deep") == "deep"


def test_long_and_deep_pages(spark):
    long = "<div><p>Welcome</p>" + "<h4>{0} h</h4><p>{0} p</p><pre>{0} c</pre>" * 300 + "</div>"
    ends = ["<ul><li>{0} x</li></ul>", "<dl><dd>{0} x</dd></dl>", "<ol><li>{0} x</li></ol>"]  # no page is equal to the wrapper
    texts = extracted(spark, [(long + e).format(i) for i, e in enumerate(ends)])
    assert texts == ["\n\n".join([f"{i} h", f"{i} p", f"{i} c"] * 300 + [f"{i} x"]) for i in range(3)]
    deep = "<section>" * 80
    page = deep + "<nav>menu</nav><div class=ad>buy</div><div><article><p>text</p></article></div>" + "</section>" * 80 + "<p>after"
    assert html_extraction.main_text(page) == "text"
    assert html_extraction.main_text(deep + "<div><table><tr><td>a</table></div><nav>x</nav>" + "</section>" * 80 + "<p>b") == "a\n\nb"
    chain = "<div>" * 3000 + "<p>Welcome</p>{1}<h2>{0}</h2>" + "</div>" * 3000
    assert extracted(spark, [chain.format(i, "<ul><li>more</ul>" * (i > 1)) for i in range(4)]) == ["0", "1", "2", "3"]


def test_no_header_ends_the_job():
    bad = ["idna", "undefined", "unicode_escape", "punycode", "hex", "rot13", "nosuch", "utf-7", "utf-16", "x" * 300, ""]
    for name in bad:
        message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n\r\n".encode() + b"<p>a \\ud800 \xff b</p>"
        rows = list(warc.derived(1, "<urn:x>", "http://h/\r\nX-Evil: 1\n", "2024\x85", message))
        for r in rows:
            (headers, block), = warc.parse_records(gzip.decompress(r[-1]))
            assert headers["WARC-Target-URI"] == "http://h/%0D%0AX-Evil: 1%0A" and "X-Evil" not in headers
            assert block.decode() == r[-2] and headers["WARC-Block-Digest"] == warc.digest(block)
            r[-2].encode()  # no half surrogates


def test_encoded_bodies_are_opened():
    html = "<title>T</title><p>caf\u00e9</p>".encode()
    packed = gzip.compress(html)
    chunks = b"".join(f"{len(packed[i:i + 9]):x};a=b\r\n".encode() + packed[i : i + 9] + b"\r\n" for i in range(0, len(packed), 9)) + b"0\r\n\r\n"
    cases = [
        ("Content-Encoding: gzip", packed), ("Content-Encoding: deflate", zlib.compress(html)), ("Content-Encoding: identity", html),
        ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunks), ("Content-Encoding: gzip", html), ("Transfer-Encoding: chunked", html),
    ]
    for head, body in cases:
        message = f"HTTP/1.1 200 OK\r\n{head}\r\nContent-Type: text/html\r\n\r\n".encode() + body
        metadata, conversion = warc.derived(1, "<urn:x>", "u", "d", message)
        assert conversion[-2] == "caf\u00e9" and json.loads(metadata[-2])["payload_digest"] == warc.digest(body)


def test_mix_passes_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "_id", "_key", "of_id", "of_key", "of_rows", "copies", "key"]
    rows = [(i % 30, f"w {i % 30}", f"s{i % 3}", *range(7)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names[3:]))
    got = mixing.mixed(docs, seed=3)
    assert got.columns == names
    taken = mixing.mix(mixing.sizes_of(docs), seed=3).agg(F.sum("copies")).first()[0]
    assert got.count() == taken


def test_warc_round_trip(spark):
    import gzip

    rows = [(1, "http://h/1", "<title>T</title><p>Ä <a href='/x'>y</a>"), (2, None, None)]
    responses = warc.responses_of(spark.createDataFrame(rows, "page_id long, url string, html string"), "2024-01-01T00:00:00Z")
    sources = {r["source_row"]: r for r in responses.collect()}
    got = warc.derivatives(responses).collect()
    assert len(got) == 4 and got == warc.derivatives(responses).collect()
    for r in got:
        ((headers, block),) = warc.parse_records(gzip.decompress(r["record"]))
        source = sources[r["source_row"]]
        assert headers["WARC-Refers-To"] == r["refers_to"] == source["record_id"]
        assert headers["WARC-Block-Digest"] == warc.digest(block) == r["block_digest"] and block.decode() == r["block"]
        assert r["source_payload_digest"] == warc.digest(warc.parse_http(bytes(source["message"]))[2])
        assert headers["WARC-Concurrent-To"] in {x["record_id"] for x in got if x["warc_type"] != r["warc_type"]}
    facts = next(r["block"] for r in got if r["source_row"] == 1 and r["warc_type"] == "metadata")
    assert '"links": ["/x"]' in facts and "text/html" in facts
    assert warc.derivatives(responses.where("source_row = 9")).count() == 0


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = token_files.token_digests(docs, vocabulary()).collect()
    want, start = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got))) == sorted(map(str, want))
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [r["doc_id"] for r in rows]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by_start, by_start[1:], strict=False))
    assert token_files.token_digests(empty(docs), vocabulary()).count() == 0


def test_token_file_layout(spark, docs):
    import glob

    import pyarrow.parquet as pq

    from gumshoe.llm.store import new_folder

    path = new_folder(spark, "tokens")
    token_files.write_token_files(docs, path, vocabulary(), 2)
    files = [pq.ParquetFile(f) for f in glob.glob(path.replace("file:", "") + "/*.parquet")]
    column = next(f for f in files if f.metadata.num_rows).metadata.row_group(0)
    by_name = {column.column(i).path_in_schema: column.column(i) for i in range(column.num_columns)}
    assert "RLE_DICTIONARY" in by_name["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in by_name["n_tokens"].encodings and by_name["doc_id"].has_offset_index
    assert token_files.read_tokens(spark, path, F.col("doc_id") == 5).count() == 1
    assert "ids" not in token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_encoder_is_exact():
    from random import Random

    from tokenizers import Tokenizer

    tokenizer, encoder, random = Tokenizer.from_file(vocabulary()), token_files.Encoder(vocabulary()), Random(1)
    signs = "aAzZéÉñßÑ09 \n\t\x1c\x1f\x85\xa0 '.,*!&<|>_-ΣςσİIıǅ́̀ǰ中٣²​sSllreLL\x00\x7f"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "IT'S they'LL", "***'s", "don't!!", ""]
    texts += [f"x{chr(c)}y{chr(c)} {chr(c)}{chr(c).upper()}, {chr(c)}" for c in range(0x20, 0x280)]
    plain = [t for t in texts if not set(t) & set("\x1c\x1f")]
    for some in (texts, plain, plain[:1], []):  # the second time from memory, and without the signs that are split apart
        for text, ids in zip(some, encoder(pa.array(some, pa.string())).to_pylist(), strict=True):
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_toxicity_finds_words_and_forms(spark):
    random = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = words(random, 30) + (f" nasty{random.integers(50)}".replace("0", "a") + " vilest" if bad else "")
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "vilest"), (1003, words(random, 30)), (None, "vilest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.with_scores(docs, model).collect()}
    assert got[1002] > 0.3 > got[1003] and got[1000] == got[1001] < 0.3
    held = [got[i] > 0.3 for i in range(400)]
    assert np.mean([h == (i % 4 == 0) for i, h in enumerate(held)]) > 0.97
    few = toxicity.train(docs.where("doc_id < 20"), labels)  # too few to tell: nothing is rejected
    assert max(r["toxicity"] for r in toxicity.with_scores(docs, few).collect()) < toxicity.THRESHOLD
    none = toxicity.train(docs, labels.where("toxic = 9"))
    assert toxicity.with_scores(docs, none).count() == len(rows) and none.weights == {}


def test_long_texts_are_learned_from_whole(spark):
    """What tells the labels apart is the last word of a long text."""
    rows = [(i, "plain words " * 20_000 + ("vile" if i % 2 else "fine")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert {r["doc_id"] for r in toxicity.with_scores(docs, model).where("toxicity > 0.5").collect()} == set(range(1, 40, 2))


def sample_of(spark, bad, good, identity=toxicity.IDENTITY):
    rows = [(1, str(i), t) for i, t in enumerate(bad)] + [(0, str(i), t) for i, t in enumerate(good)]
    return toxicity.gather(spark.createDataFrame(rows, "toxic int, draw string, text string"), identity)


def test_swapped_names_do_not_count(spark):
    """A group that is named mostly in toxic sentences: without the penalty its name alone raises the score, in each language."""
    for a, b in (("women", "men"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres")):
        bad = [f"{a} {('awful', 'vile', 'nasty')[i % 3]}" for i in range(60)] + [f"{b} {('awful', 'vile', 'nasty')[i % 3]}" for i in range(6)]
        good = [f"{b} walk home {i}" for i in range(80)] + [f"{a} walk home"] * 4
        sample = sample_of(spark, bad, good)
        plain, fair = toxicity.fit(sample, swap_weight=0.0), toxicity.fit(sample, swap_weight=20.0)
        weight = lambda model, word: sum(model.weights.get(f, 0.0) for f in toxicity.features_of(word))
        gap = lambda model: abs(weight(model, a) - weight(model, b))  # noqa: E731, B023
        assert gap(fair) < 0.2 * gap(plain) and gap(plain) > 0.5
        assert fair.scorer()(f"{a} awful") > 0.5 > fair.scorer()(f"{a} walk home")
        assert fair.copies == plain.copies == len(bad) + len(good)


def test_penalty_lowers_false_alarms_on_neutral_mentions(spark):
    """Neutral sentences that the model has not seen, about the group that is mostly named in toxic ones."""
    random = np.random.default_rng(1)
    bad = [f"muslims {random.choice(['awful', 'vile', 'nasty'])} {words(random, 5)}" if i % 3 else f"vile {words(random, 5)}" for i in range(200)]
    good = [f"{words(random, 6)} {'christians' if i % 5 == 0 else ''}" for i in range(600)]
    sample = sample_of(spark, bad, good)
    neutral = [f"muslims {words(random, 6)}" for _ in range(100)]
    alarms = [sum(toxicity.fit(sample, w).scorer()(t) >= toxicity.THRESHOLD for t in neutral) for w in (0.0, 20.0)]
    assert alarms[1] < alarms[0]
    found = [f"christians {w} {words(random, 5)}" for w in ("awful", "vile", "nasty")]
    assert all(toxicity.fit(sample, 20.0).scorer()(t) >= toxicity.THRESHOLD for t in found)


def test_sample_is_counted_as_a_plain_version_counts(spark):
    random = np.random.default_rng(4)
    texts = [(int(i % 3 == 0), str(i), words(random, 12, 30) + (" women bad" if i % 4 == 0 else " men") + (" Frau" if i == 9 else "")) for i in range(90)]
    texts += [(1, "x", None), (0, "y", "")]
    sample = toxicity.gather(spark.createDataFrame([(*t, 1) for t in texts], "toxic int, draw string, text string, held int"))
    texts.sort(key=lambda t: t[:2])
    assert sample.labels.tolist() == [t[0] for t in texts]
    seen, swaps = {}, {}
    for toxic, _, text in texts:
        found = toxicity.words_of(text)
        for f in {f for w in found for f in toxicity.features_of(w)}:
            seen.setdefault(f, [0, 0])[toxic] += 1
        for pair in toxicity.swaps_of(found):
            swaps[pair] = swaps.get(pair, 0) + 1
    assert sample.swaps == swaps and ("frau", "mann") in swaps
    total = [sum(t[0] == k for t in texts) for k in (0, 1)]

    def kept(f, n):
        g2 = 2 * sum(x * np.log(x * sum(total) / (sum(n) * t)) for x, t in zip(n, total, strict=True) if x)
        return f in {x for s in toxicity.IDENTITY for x in s} or (sum(n) >= 4 and g2 >= 16 and n[1] * total[0] > n[0] * total[1])

    assert sample.names == sorted(f for f, n in seen.items() if kept(f, n))
    dense = np.zeros((len(texts), len(sample.names)))
    np.add.at(dense, (sample.rows, sample.columns), sample.values)
    want = [[sum(f in toxicity.features_of(w) for w in toxicity.words_of(t)) for f in sample.names] for *_, t in texts]
    assert dense.tolist() == want


def test_identity_table(spark):
    rows = spark.createDataFrame([("a", "Women"), ("a", "men"), ("b", "x"), ("b", "x"), ("c", None), (None, "y")], "set string, name string")
    assert toxicity.identity_sets(rows) == (("y",), ("men", "women"), ("x",))
    with pytest.raises(ValueError):
        toxicity.identity_sets(spark.range(toxicity.MOST_NAMES + 1).select(F.lit("s").alias("set"), F.col("id").cast("string").alias("name")))


def test_language(spark):
    random = np.random.default_rng(4)
    sets = {"aa": "abcde", "bb": "vwxyzß", "cc": "кофта"}
    rows = [
        (i, " ".join("".join(random.choice(list(s), 5)) for _ in range(int(random.integers(3, 200)))), lang)
        for i in range(240)
        for lang, s in [list(sets.items())[i % 3]]
    ]
    rows += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "abcab", None), (None, "вата", "cc"), (903, "", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_id.train(docs.where("doc_id < 120"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, network).collect()}
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in range(120, 240)]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 903)) and 0 <= got[0]["score"] <= 1
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.train(docs.where("doc_id = -1"))).collect()} == {"und"}


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, f"{'das ist gut' if i % 2 else 'this is fine'} {i} " * (1 + 40 * (i % 3)), "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "1 2", "xx"), (103, "only", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_id.train(docs)
    assert network.languages == ["de", "en"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["\u00bd \u00b2 \u2460", "12 ?", None, "", "das ist", "\u4e2d"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(asked, network).collect()}
    assert [got[i] for i in range(4)] == [("und", 0.0)] * 4 and got[4][0] == "de" and got[5][0] in ("de", "en")
    assert language_id.train(docs.where("doc_id > 99")) is None


def test_windows_come_from_whole_texts():
    data = bytes(range(256)) * 8
    seen = {w for i in range(200) for w in language_id._drawn_windows(bytes([i]) * 256 + data, hashlib.md5(bytes([i])).hexdigest())[:-1]}
    assert len(seen) > 20
    assert language_id._drawn_windows(b"short", "ff" * 16) == [b"short", b"short"]


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    network = language_id.train(docs.where(third != 1))
    held = docs.where((third == 1) & F.col("lang").isNotNull())
    found = language_id.identify(held, network).join(held.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    quarter = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = toxicity.train(docs.where(quarter != 2), labels)
    held = toxicity.with_scores(docs.where(quarter == 2), model, "s").join(labels.where("toxic is not null"), "doc_id")
    rows = held.select("toxic", (F.col("s") >= toxicity.THRESHOLD).cast("int").alias("said")).groupBy("toxic").agg(F.avg("said"), F.count("*")).collect()
    share = {r[0]: r[1] for r in rows}
    assert share[1] > 0.5 and share[0] < 0.02


def test_network_tables_and_gradient():
    network = language_id.Network(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (6, language_id.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 0, 1, 1, 0])

    def plain():
        e, pooled = network.p["embedding"][x], []
        for w in language_id.WIDTHS:
            spans = np.concatenate([e[:, i : language_id.WINDOW - w + 1 + i] for i in range(w)], axis=2)
            pooled.append(np.maximum((spans @ network.p[f"filter{w}"]).max(axis=1) + network.p[f"bias{w}"], 0))
        return language_id.softmax(np.concatenate(pooled, axis=1) @ network.p["out"] + network.p["out_bias"])

    assert abs(plain() - network.predict(x, network.tables())).max() < 1e-3
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    gradient = network.gradient(x, y)
    loss = lambda: -np.log(plain()[np.arange(6), y]).mean()
    for name, at in (("out", (3, 1)), ("filter3", (5, 2)), ("bias2", (4,)), ("out_bias", (0,))):
        before = network.p[name][at]
        network.p[name][at] = before + 1e-5
        up = loss()
        network.p[name][at] = before - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(gradient[name][at], abs=1e-5)
        network.p[name][at] = before


def brute_dedup(rows):
    """Rows that repeat an id and a text are one document."""
    seen, out = set(), {}
    for doc_id, text in sorted({(r["doc_id"], r["text"] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        data = text.encode()
        drop = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                drop[s : s + 100] = True
            seen.add(data[s : s + 100])
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~drop])
        spans = int((drop & ~np.append(False, drop[:-1])[: len(drop)]).sum())
        out[doc_id, text] = (doc_id, len(data), int(drop.sum()), spans, hashlib.sha256(kept).hexdigest())
    return [out[r["doc_id"], r["text"] or ""] for r in rows]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", hot)
    random = np.random.default_rng(2)
    shared, periodic = words(random, 60), "abcdefg" * 300
    more = [(400 + i, f"{words(random, 20)} {shared[i * 7 :]} {words(random, 9)}") for i in range(12)]
    more += [(500, periodic), (501, "x" * 5000), (502, periodic[3:900]), (503, "é" * 120 + "x" * 150)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = suffix_dedup.deduplicated(rows).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_dedup(rows.collect())))
    assert suffix_dedup.deduplicated(empty(docs)).count() == 0


def test_string_classes():
    random = np.random.default_rng(0)
    texts = [bytes(random.integers(97, 99, int(random.integers(1, 40))).astype(np.uint8)) for _ in range(30)]
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
    for length in (1, 3, 8):
        order, classes = suffix_dedup.string_classes(data, length)
        seen = {}
        for at, c in zip(order.tolist(), classes.tolist(), strict=True):
            string = bytes(data[at : at + length])
            if len(string) == length and b"\xff" not in string:
                assert seen.setdefault(string, c) == c
        assert len(set(seen.values())) == len(seen)


def test_embeddings(spark):
    random = np.random.default_rng(9)
    x = random.normal(size=(300, 48))
    for i in range(0, 200, 2):  # pairs on both sides of the threshold
        noise = random.normal(size=48)
        noise -= x[i] * (noise @ x[i]) / (x[i] @ x[i])
        cosine = random.uniform(0.94, 1)
        x[i + 1] = cosine * x[i] / np.linalg.norm(x[i]) + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[8].tolist()) for i in range(30)]
    rows += [(1000, None), (1001, [0.0] * 48), (1002, [float("nan")] * 48), (1003, []), (None, x[3].tolist()), (1004, [1.0]), (1005, [None, 1.0])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, copies string")
    got = {r["vec_id"]: r for r in embedding_neighbours.neighbours(df).collect()}
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and len(v) == 48 and np.isfinite(v).all() and any(v)]
    ids, y = np.array([i for i, _ in usable]), np.array([v for _, v in usable])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in ids)
    assert found >= 0.97 * link.sum() and all(got[i]["n_links"] <= n for i, n in zip(ids, link.sum(axis=1), strict=True))
    assert got[929]["component_id"] == 8 and got[8]["n_links"] >= 30 and got[8]["kept"] and not got[929]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1005, None))
    assert embedding_neighbours.neighbours(df.where("vec_id = -1")).count() == 0


def test_embeddings_in_double_precision(spark):
    """Pairs that floats would put on the other side of the threshold, and numbers whose squares no double holds."""
    a = np.array([1.0, 0.0, 0.0, 0.0])
    turn = lambda c: np.array([c, np.sqrt(1 - c * c), 0.0, 0.0])
    rows = [(1, a), (2, turn(0.95 + 1e-10)), (3, -a), (4, -turn(0.95 - 1e-10)), (5, [0, 0, 1e300, 1e300]), (6, [0, 0, 2e-300, 2e-300])]
    rows = [(i, [float(x) for x in v]) for i, v in rows] + [(7, [0.0, 0.0, 3.0, -3.0]), (7, [0.0, 0.0, 3.0, 3.0])]
    got = embedding_neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {(r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()}
    assert found == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 2, 5), (6, 2, 5), (7, 2, 5), (7, 0, 7)}


def test_embedding_blocks(spark, monkeypatch):
    random = np.random.default_rng(1)
    x = (random.normal(size=64) + 0.05 * random.normal(size=(60, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(embedding_neighbours, "BLOCK", 7)
    assert {(r["n_links"], r["component_id"]) for r in embedding_neighbours.neighbours(df).collect()} == {(59, 0)}


def plain_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    per = {}
    for source, size in sizes:
        per[source] = per.get(source, 0) + size
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), total * sum(per.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= most * per[s]}
        if not full:
            return target | share
        target |= {s: most * per[s] for s in full}
        rest -= sum(most * per[s] for s in full)
        free -= full
    return target


def test_mixing(docs):
    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets([(r["source"], size(r["text"])) for r in rows])
    got = mixing.mix(mixing.sizes_of(docs)).collect()
    assert len(got) == len(rows)
    for source, target in want.items():
        own = [r for r in got if r["source"] == source]
        assert all(r["target"] == pytest.approx(target) and 0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 2 * max(r["size"] for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(mixing.sizes_of(docs)).collect()))
    assert mixing.mix(mixing.sizes_of(empty(docs))).count() == 0
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in got)


def test_mixing_draws_offsets(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("one").alias("text"), F.when(F.col("id") % 4 == 0, "a").alias("source"))
    settings = {"total": 0.25, "weights": (1, 1)}

    def taken(seed):
        return {(r["source"], r["doc_id"]) for r in mixing.mix(mixing.sizes_of(docs), seed=seed, **settings).where("copies > 0").collect()}

    assert taken(3) == taken(3)
    mixes = [taken(seed) for seed in range(20)]
    assert all(abs(len(m) - 50) <= 2 for m in mixes)
    assert len(set().union(*mixes)) == 200  # no document is left out of every mix
