"""HTML wrappers, quotation linking, piece coding and quality."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanout.llm import pieces, quality, quotes, wrapper
from helpers import EDGES, documents, words

# --- wrappers ------------------------------------------------------------------------------------

ARTICLE = "<article><h1>T &amp; u</h1><p>One  <b>two</b>\n three</p><p>four<br>five</p></article>"
PAGES = {
    "plain": (f"<html><head><title>no</title></head><body><nav><ul><li><a>m</a></li></ul></nav>{ARTICLE}<footer>f</footer></body></html>", "T & u\nOne two three\nfour five"),
    "no footer": (f"<html><body>{ARTICLE}</body></html>", "T & u\nOne two three\nfour five"),
    "ads inside": ("<body><article><p>a</p><div class='ad box'>buy</div><form><p>name</p></form><p>b</p><section id=comments><p>c</p></section></article></body>", "a\nb"),
    "script": ("<body><script>if (a<b) document.write('</p>')</script><style>p{}</style><article><p>x</p></article></body>", "x"),
    "unclosed": ("<body><article><p>a<p>b<ul><li>c<li>d</ul></body>", "a\nb\nc\nd"),
    "cut": ("<body><article><p>a &lt; b</p><p>c <a hre", "a < b\nc"),
    "empty": ("<body><article></article></body>", ""),
    "main": ("<body><header>h</header><main><p>m</p></main><aside>s</aside></body>", "m"),
    "content": ("<body><div class=menu>h</div><div class='content'><p>m</p></div><div id=cookie-notice>s</div></body>", "m"),
    "bare": ("<p>only</p>", "only"),
    "comment": ("<body><!-- <article>no</article> --><article><p>y<!-- z --></p></article></body>", "y"),
}


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")


def test_main_text_of_pages_apart(spark):
    rows = [(f"http://h{i}.example/{n}", h) for i, (n, (h, _)) in enumerate(PAGES.items())]
    got = {r.page_id: r for r in wrapper.main_texts(pages(spark, rows)).collect()}
    for i, (n, (_, want)) in enumerate(PAGES.items()):
        assert (got[i].text, got[i].n_chars, got[i].read) == (want, len(want), True), n


def test_one_host_reads_all_its_shapes(spark):
    rnd = random.Random(2)
    rows, want = [], []
    for _ in range(200):
        n = rnd.randrange(1, 9)
        text = [" ".join(words(rnd, 5)) for _ in range(n)]
        menu = "".join(f"<li><a>{w}</a></li>" for w in words(rnd, rnd.randrange(1, 5)))
        ad = "<div class=ad><p>buy</p></div>" if rnd.random() < 0.5 else ""
        middle = "".join(f"<p>{t}</p>" + (ad if rnd.random() < 0.2 else "") for t in text)
        quote = "<blockquote><p>q</p></blockquote>" if rnd.random() < 0.3 else ""
        rows.append(("HTTP://Same.example:80/x", f"<body><nav><ul>{menu}</ul></nav>{ad}<article>{middle}{quote}</article></body>"))
        want.append("\n".join(text + ["q"] * bool(quote)))
    got = {r.page_id: (r.text, r.read) for r in wrapper.main_texts(pages(spark, rows)).collect()}
    assert got == {i: (t, True) for i, t in enumerate(want)}
    learned = wrapper.wrappers(pages(spark, rows).withColumn("host", F.lit("same"))).collect()
    assert len(learned) == 1 and len(learned[0].tree) < 2000


def test_wrapper_edges(spark):
    rows = [(None, None), (None, ""), ("nonsense", "just text"), ("http://a/", "<p>1</p>"), ("http://a/", "<p>1</p>")]
    got = wrapper.main_texts(pages(spark, rows)).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(0, ""), (1, ""), (2, "just text"), (3, "1"), (4, "1")]
    long = "<article>" + "<p>w</p>" * 20_000 + "</article>"
    assert wrapper.main_texts(pages(spark, [("http://b/", long)])).first().n_chars == 39_999
    assert wrapper.main_texts(pages(spark, [])).count() == 0


KEPT = {
    "body": ("<body class='single has-sidebar'><p>t</p><div class=sidebar>s</div></body>", "t"),
    "named body": ("<body class=sidebar><p>t</p></body>", "t"),
    "main": ("<body><main class='with-menu'><p>t</p><ul class=menu><li>m</li></ul></main></body>", "t"),
    "article": ("<body><article class='post share-enabled'><p>t</p></article><p>o</p></body>", "t"),
    "content": ("<body><div id='content' class='no-comments'><p>t</p></div><p>o</p></body>", "t"),
    "holder": ("<body><form><div class=search><article>t</article></div></form><aside>s</aside></body>", "t"),
    "whole names": ("<body><p>t</p><div class='cookie-notice'>c</div><div id=comments-2>d</div><div class='x-share'>u</div></body>", "t\nu"),
}


def test_names_in_parts_drop_no_text(spark):
    rows = [(f"http://k{i}.example/", page) for i, (page, _) in enumerate(KEPT.values())]
    got = {r.page_id: r.text for r in wrapper.main_texts(pages(spark, rows)).collect()}
    assert got == dict(enumerate(want for _, want in KEPT.values()))


def test_a_page_that_is_not_read_goes_by_its_own_tree():
    other = re.compile(wrapper.expression(wrapper.skeleton("<ul><li>x</li></ul>"), []))
    assert wrapper.main_text(PAGES["plain"][0], other, frozenset()) == (PAGES["plain"][1], False)


INTERLEAVED = {
    "articles": ("<article>A</article><div class=ad>x</div><article>B</article><div class=ad>y</div>", "A\nB"),
    "contents": ("<div class=content>A</div><div class=ad>x</div>" * 2 + "<div class=content>C</div>", "A\nA\nC"),
    "in columns": ("<div><article>A</article><nav>n</nav></div><div><article>B</article><nav>n</nav></div>" * 2, "A\nB\nA\nB"),
    "in sections": ("<section><h2>h</h2><article>A</article><article>B</article></section>" * 2, "A\nB\nA\nB"),
}


@pytest.mark.parametrize("name", INTERLEAVED)
def test_all_repetitions_of_the_main_items_are_text(name):
    page, want = INTERLEAVED[name]
    items = wrapper.skeleton(page)
    assert wrapper.main_text(page, re.compile(wrapper.expression(items, [])), wrapper.main_paths(items)) == (want, True)


def test_repetitions_on_one_host(spark):
    rows = [("http://h/", page) for page, _ in INTERLEAVED.values() if "<article>" in page]
    got = {r.page_id: r.text for r in wrapper.main_texts(pages(spark, rows)).collect()}
    assert got == dict(enumerate(want for page, want in INTERLEAVED.values() if "<article>" in page))


def site(rnd, n):
    """Pages of a site whose elements have no speaking names, and the text that is each page's own."""
    menu = "".join(f"<div><a href=/x>{w}</a></div>" for w in words(rnd, 5))
    foot = f"<div>{' '.join(words(rnd, 6))}</div>"
    rows, want = [], []
    for _ in range(n):
        own = [" ".join(words(rnd, rnd.randrange(3, 30))) for _ in range(rnd.randrange(1, 8))]
        middle = "".join(f"<div>{t}</div>" for t in own)
        rows.append(f"<body><div>{menu}</div><div><div>{middle}</div></div><div>{foot}</div></body>")
        want.append("\n".join(own))
    return rows, want


def test_template_text_is_learnt_where_names_say_nothing(spark):
    rnd, rows, want = random.Random(4), [], []
    for k in range(4):
        pages_of, texts = site(rnd, 12)
        rows += [(f"http://s{k}.example/{i}", page) for i, page in enumerate(pages_of)]
        want += texts
    got = {r.page_id: r.text for r in wrapper.main_texts(pages(spark, rows)).collect()}
    assert got == dict(enumerate(want))


def test_templates_by_brute_force(spark):
    rnd, rows = random.Random(6), []
    for k, n in enumerate([3, 5, 40]):
        rows += [(f"http://t{k}.example/", f"<div><p>{rnd.choice('ab')}</p></div><p>{rnd.randrange(9)}</p><p>same</p>") for _ in range(n)]
    hosts = {}
    for u, h in rows:
        hosts.setdefault(u, set()).add(frozenset(wrapper.slots(h)))
    want = {}
    for u, texts in hosts.items():
        common = {x for t in texts for x in t if sum(x in o for o in texts) >= max(4, 0.8 * len(texts))}
        if common:
            want[u] = common
    named = pages(spark, rows).withColumn("host", F.col("url"))
    assert {r.host: set(r.template) for r in wrapper.templates(named).collect()} == want and want


def test_copies_of_an_article_make_no_template(spark):
    page = "<body><div><p>one</p><p>two</p></div></body>"
    got = wrapper.main_texts(pages(spark, [("http://c.example/", page)] * 30)).collect()
    assert {r.text for r in got} == {"one\ntwo"}


FRAME = {
    **dict.fromkeys(["comment-list", "post-comments", "reader-comments", "related-posts", "entry-footer", "site-footer", "newsletter-signup", "site-header"], False),
    **dict.fromkeys(["has-sidebar", "no-comments", "with-menu", "share-enabled", "entry-header", "post-title", "content", "ad-hoc"], True),
}


@pytest.mark.parametrize("name", FRAME)
def test_ordinary_names(name):
    page = f"<body><article><p>t</p><div class={name}><p>u</p></div><p>v</p></article></body>"
    items = wrapper.skeleton(page)
    text, _ = wrapper.main_text(page, re.compile(wrapper.expression(items, [])), wrapper.main_paths(items))
    assert text == ("t\nu\nv" if FRAME[name] else "t\nv")


def test_deep_and_wide_pages(spark):
    rnd = random.Random(3)
    names = ["p", "h2", "ul", "section", "dl", "blockquote", "pre", "h3"]

    def wide(n):
        return "<body><article>" + "".join(f"<{t}>w</{t}>" for t in rnd.choices(names, k=n)) + "</article></body>"

    def deep(n, name):
        return f"<body>{f'<{name}>' * n}<article><p>x</p></article><nav>n</nav>{f'</{name}>' * n}</body>"

    rows = [("http://d/", deep(3000, "div")), ("http://d/", deep(50_000, "section")), ("http://d/", deep(2000, "nav"))]
    rows += [("http://w/", wide(20_000)), ("http://w/", wide(20_000)), ("http://w/", wide(3))]
    got = {r.page_id: r for r in wrapper.main_texts(pages(spark, rows)).collect()}
    assert [got[i].text for i in range(3)] == ["x"] * 3
    assert [got[i].n_chars for i in (3, 4, 5)] == [39_999, 39_999, 5]


@pytest.mark.parametrize("seed", range(12))
def test_long_lists_are_read_by_what_they_align_to(seed, monkeypatch):
    monkeypatch.setattr(wrapper, "CELLS", 30)
    rnd = random.Random(seed)
    lists = [[[rnd.choice("abcdefghijkl"), False, False, []] for _ in range(rnd.randrange(60))] for _ in range(3)]
    whole = wrapper.folded(lists[0])
    for other in lists[1:]:
        whole = wrapper.aligned(whole, wrapper.folded(other))
    pattern = re.compile(wrapper.expression(whole, []))
    assert all(pattern.fullmatch("".join(f"<{i[0]}></{i[0]}>" for i in items)) for items in lists)


def test_groups_of_any_length_fold():
    group = [[x, False, False, []] for x in "abcdefg"]
    assert wrapper.folded(group * 9) == [["", False, True, group]]


@pytest.mark.parametrize("seed", range(30))
def test_alignment_reads_both(seed):
    rnd = random.Random(seed)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else 'x'}</{t}>" for t in rnd.choices(["div", "h2", "ul", "section"], k=rnd.randrange(5)))

    shapes = [tree(2) for _ in range(6)]
    whole = wrapper.skeleton(shapes[0])
    for s in shapes[1:]:
        whole = wrapper.aligned(whole, wrapper.skeleton(s))
    pattern = re.compile(wrapper.expression(json.loads(json.dumps(whole)), []))
    for s in shapes:
        assert pattern.fullmatch("".join(symbol for symbol, _ in wrapper.events(s)))


# --- quotes --------------------------------------------------------------------------------------


def messages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, row string")


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"),
        (1, 1, "assistant", "> hello   THERE\nhi"),
        (1, 2, "user", "New matter"),
        (1, 3, "assistant", "> How are you?\nfine\n>> hello there\nok"),
        (1, 4, "user", ">> hello there\n> hi\n\nthanks"),
        (1, 5, "user", "> never said\nwhat"),
        (1, 6, "user", "> Hello there\n> New matter\n> new matter\nagain"),
        (2, 0, "user", "> hello there\nother conversation"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.linked_messages(messages(spark, rows)).collect()}
    parents = {k: r.parent_turn for k, r in got.items()}
    assert parents == {(1, 0): None, (1, 1): 0, (1, 2): None, (1, 3): 0, (1, 4): 1, (1, 5): None, (1, 6): 2, (2, 0): None}
    order = [k[1] for k, r in sorted(got.items(), key=lambda x: x[1].path) if k[0] == 1]
    assert order == [0, 1, 4, 3, 2, 6, 5]
    assert (got[1, 3].reply, got[1, 4].reply, got[1, 1].reply) == ("fine\nok", "thanks", "hi")
    assert (got[1, 4].max_level, got[1, 4].quoted_lines, got[1, 4].linked_lines) == (2, 2, 2)


def test_quotes_wrapped_anew(spark):
    long = "one two three four five six seven eight nine ten eleven twelve."
    rows = [
        (1, 0, "user", f"intro here\n\n{long} So short.\nnext words stand here"),
        (1, 1, "assistant", "> one two three four\n> five six seven eight nine ten\n> eleven twelve.\nagreed"),
        (1, 2, "user", "a reply that goes\nover two lines."),
        (1, 3, "assistant", "> a reply that goes over two lines.\nyes"),
        (1, 4, "user", "> So\n> short.\nindeed"),
        (1, 5, "user", ">> agreed\n>>> intro here\ndeep"),
        (1, 6, "user", "> one two other words\n> altogether\nno"),
        (2, 0, "user", "> a reply that goes over two lines."),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.linked_messages(messages(spark, rows)).collect()}
    parents = {k: r.parent_turn for k, r in got.items()}
    assert parents == {(1, 0): None, (1, 1): 0, (1, 2): None, (1, 3): 2, (1, 4): 0, (1, 5): 1, (1, 6): None, (2, 0): None}
    assert [(got[1, i].quoted_lines, got[1, i].linked_lines) for i in (1, 3, 4, 6)] == [(3, 3), (1, 1), (2, 2), (2, 0)]


def test_quote_edges(spark):
    rows = [
        (None, 0, "user", "> a"), (3, None, "user", "a"), (3, 0, None, None), (3, 1, "user", ""), (3, 2, "user", ">"),
        (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 1, "user", "> same"), (4, 1, "user", "> same"),
        (5, 0, "user", "x " * 40_000),
    ]
    got = quotes.linked_messages(messages(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r.parent_turn for r in got if (r.conv_id, r.turn) == (4, 1)] == [0, 0]
    assert all(r.parent_turn is None for r in got if r.conv_id in (None, 3, 5))
    assert quotes.linked_messages(messages(spark, [])).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 70)]
    got = {r.turn: r for r in quotes.linked_messages(messages(spark, rows)).collect()}
    assert all(got[i].parent_turn == i - 1 for i in range(1, 70))
    assert got[69].path == "/".join(f"{i:012d}" for i in range(70))


def test_quotes_run_natively(spark):
    plan = quotes.linked_messages(messages(spark, [(1, 0, "u", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# --- pieces --------------------------------------------------------------------------------------

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def brute(model, scores, text):
    """Best score of any segmentation, by dynamic programming over all substrings."""
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 60), j):
            own = scores.get(text[i:j], -np.inf)
            if j - i == 1:
                own = max(own, pieces.BYTE_SCORE * len(text[i:j].encode()))
            best[j] = max(best[j], best[i] + own)
    return best[-1]


def test_viterbi_is_best(model):
    scores = {p: v[2] for p, v in model.automaton.items()}
    rnd = random.Random(1)
    texts = ["hello world", "  two  spaces ", "naïve 你好 🙂", "the" * 9, "x", " "] + [" ".join(words(rnd, 6)) for _ in range(10)]
    by_id = {v[0]: v[2] for v in model.automaton.values()}
    for t in texts:
        marked = (" " + t).replace(" ", pieces.MARK)
        found = sum(by_id.get(i, pieces.BYTE_SCORE) for i in model.encode(t).tolist())
        assert found == pytest.approx(brute(model, scores, marked)), t


def test_round_trip(spark, model):
    texts = EDGES + [(40, "tabs\tand\nlines\r\n  x "), (41, "你好 नमस्ते 🙂👨‍👩‍👧 \u0000 "), (42, " leading"), (43, "▁mark")]
    got = pieces.coded(documents(spark, texts), MODEL).collect()
    assert len(got) == len(texts) and all(r.restored for r in got)
    for r in got:
        assert r.n_pieces == len(r.ids) // 4
        assert model.decode(np.frombuffer(r.ids, "<i4").tolist()) == r.decoded
    by = {r.doc_id: r.decoded for r in got}
    assert by[40] == texts[-4][1] and by[41] == texts[-3][1] and by[43] == " mark" and by[1] == ""
    assert pieces.coded(documents(spark, []), MODEL).count() == 0


def test_small_cache_gives_the_same(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 3)
    small = pieces.Pieces(MODEL)
    text = "one two three one four two five six one"
    assert (small.encode(text) == model.encode(text)).all() and len(small) <= 3


def test_ids_are_the_models_own(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(5)
    texts = ["x des the aaaaaaaaa" + "the" * 40, "  two   spaces" + " " * 40 + "x", "naïve 你好 🙂 tabs\tand\nlines\r\n", "des" * 30, "<0x41><unk></s>", "x" * 3000]
    texts += [" ".join("".join(rnd.choice("aeinorstlhd") for _ in range(rnd.randrange(1, 14))) for _ in range(200)) for _ in range(20)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = {r.doc_id: np.frombuffer(r.ids, "<i4").tolist() for r in pieces.coded(documents(spark, list(enumerate(texts))), MODEL).collect()}
    assert got == {i: own.encode(t) for i, t in enumerate(texts)}


# --- quality -------------------------------------------------------------------------------------


def graded(n=300):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        good = [w + rnd.choice(["", "", ",", "."]) for w in words(rnd, rnd.randrange(5, 80))]
        bad = rnd.choice([["Ble"] * 30, [w + "!!" for w in words(rnd, 30)], [w + "&&&" for w in words(rnd, 30)]])
        rows.append((i, " ".join(bad if i % 5 == 0 else good), int(i % 5 != 0), f"h{i % 7}", f"p{i % 2}"))
    return rows


def test_the_pass_is_what_merging_leaves(monkeypatch):
    """Odd and random words: one pass gives the same pieces as merging the whole word, which it never resorts to."""
    model, rnd = pieces.model_of(MODEL), random.Random(7)
    assert isinstance(model, pieces.Merges)
    parts = ["a", "b", "the", "ing", "é", "ü", "中", "🙂", "ß", "qz", "1", "20", "_", "'", "\u0301", "ction", "aa", "aaa", "zzzz", "Σ"]
    words = {"▁" * rnd.randrange(3) + "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12))) for _ in range(6000)}
    want = {w: model._ids(w, model.merged(w)) for w in words}
    monkeypatch.setattr(pieces.Merges, "_ids", None)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 500)  # pairs are forgotten and found again
    assert {w: model.segmented(w) for w in words} == want


def test_quality_on_held_out_documents(spark):
    rows = graded()
    docs = spark.createDataFrame([(d, t, h, p, "clash") for d, t, _, h, p in rows], "doc_id long, text string, source string, lang string, y string")
    labels = spark.createDataFrame([(d, q) for d, _, q, _, _ in rows[:200]], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, labels, F.col("source"), F.col("lang")).collect()}
    held = rows[200:]
    assert sum(got[d].kept == bool(q) for d, _, q, _, _ in held) >= 0.97 * len(held)
    kept = quality.kept_documents(docs, labels, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_sparse_sites_shrink_to_what_is_above(spark):
    rows = graded()
    rows += [(1000 + i, " ".join(["Ble"] * 30), 0, "bad", "p") for i in range(60)] + [(2000, " ".join(["Ble"] * 30), 0, "tiny", "p")]
    docs = spark.createDataFrame([(d, t, h, p) for d, t, _, h, p in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(d, q) for d, _, q, _, _ in rows[:200]], "doc_id long, quality int")
    got = {r.host: r.host_rate for r in quality.quality(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert got["bad"] < 0.2 < got["tiny"] < got["h1"]


def strength(groups):
    """Beta strength by moments over (n, rate, rate above)."""
    some = [(n, r, a) for n, r, a in groups if n > 1]
    spread, chance = sum(n * (r - a) ** 2 for n, r, a in some), sum(a * (1 - a) for _, _, a in some)
    room = sum((n - 1) * a * (1 - a) for n, _, a in some)
    if not room:
        return 10.0
    correlation = (spread - chance) / room
    return min(10_000.0, max(1.0, 1 / correlation - 1)) if correlation > 0 else 10_000.0


def test_posteriors_by_brute_force(spark):
    """Every document's rates from all the others of its host and path, one by one."""
    rows = graded()
    rows += [(1000 + i, " ".join(["Ble"] * 30), 0, "bad", f"p{i % 3}") for i in range(40)] + [(2000, "Some words.", 1, "lone", "p")]
    docs = spark.createDataFrame([(d, t, h, p) for d, t, _, h, p in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(d, q) for d, _, q, _, _ in rows[:200]], "doc_id long, quality int")
    got = quality.quality(docs, labels, F.col("source"), F.col("lang")).collect()
    start = sum(q for _, _, q, _, _ in rows[:200]) / 200
    odds = lambda p: math.log(p / (1 - p))
    chance = {r.doc_id: 1 / (1 + math.exp(-(r.evidence + odds(start)))) for r in got}
    of = lambda keep: [chance[r.doc_id] for r in got if keep(r)]
    top = min(0.999, max(0.001, sum(chance.values()) / len(chance)))
    hosts = {r.host: of(lambda o, r=r: o.host == r.host) for r in got}
    k = strength([(len(v), sum(v) / len(v), top) for v in hosts.values()])
    whole = {h: (sum(v) + k * top) / (len(v) + k) for h, v in hosts.items()}
    sites = {(r.host, r.path): of(lambda o, r=r: (o.host, o.path) == (r.host, r.path)) for r in got}
    k2 = strength([(len(v), sum(v) / len(v), whole[h]) for (h, _), v in sites.items()])
    for r in got:
        others = sum(hosts[r.host]) - chance[r.doc_id], len(hosts[r.host]) - 1
        host = (max(0.0, others[0]) + k * top) / (others[1] + k)
        beside = sum(sites[r.host, r.path]) - chance[r.doc_id], len(sites[r.host, r.path]) - 1
        path = (max(0.0, beside[0]) + k2 * host) / (beside[1] + k2)
        assert (r.host_rate, r.path_rate) == (pytest.approx(host, rel=1e-6), pytest.approx(path, rel=1e-6))
        assert r.quality == pytest.approx(1 / (1 + math.exp(-(r.evidence + odds(path)))), rel=1e-6)
        if r.host == "lone":
            assert path == pytest.approx(top)


def test_quality_edges(spark):
    docs = documents(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, none, F.col("source"), F.lit(None))
    assert got.count() == len(EDGES) and got.filter("kept").count() == len(EDGES)
    odd = spark.createDataFrame([(1, None), (5, 1), (5, 0), (None, 0), (99, 0), (4, 1)], "doc_id long, quality int")
    assert quality.quality(docs, odd, F.col("source"), F.col("lang")).count() == len(EDGES)
    assert quality.quality(documents(spark, []), odd, F.col("source"), F.col("lang")).count() == 0
    assert quality.kept_documents(docs, none, F.col("source"), F.col("lang")).count() == len(EDGES)


def test_measures_of_odd_texts():
    for text in (b"", b" \n ", b"!!", b"\xff\xfe", b"a", "é".encode() * 9, b"|" * 3, b"A B\nA B\n"):
        row = quality.measures(text)
        assert len(row) == len(quality.MEASURES) and all(np.isfinite(row))
