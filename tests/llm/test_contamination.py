import random

from hypothesis import given
from hypothesis import strategies as st

from tarnflow.llm import contamination as c

R = random.Random(5)
LEXICON = [a + b for a in ("bar", "len", "tor", "mis", "gal", "pen", "rud", "wex") for b in ("ton", "dle", "mer", "ish", "ock", "ave", "un", "ple")]
OTHER = ["rain", "fell", "over", "night", "wind", "rose", "slowly", "before", "noon"]


def text(words, lexicon=LEXICON):
    return [R.choice(lexicon) for _ in range(words)]


ITEMS = {i: text(40) for i in range(30)}
ITEMS[30] = text(5) + ITEMS[0][10:] + text(5)
HEAD = "Read this passage with care and then choose the one best answer to the question which follows it below, without any other help from books or from friends"
DOC = lambda *parts: " ".join([*text(30, OTHER), *[w for p in parts for w in p], *text(30, OTHER)])


def found(spark, docs, items=None):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, item_id string, words int")
    e = spark.createDataFrame([(i, "s", f"{HEAD}. " + " ".join(w)) for i, w in (items or ITEMS).items()] + [(None, "s", "x"), (77, "s", None), (3, "s", f"{HEAD}. " + " ".join(ITEMS[3]))], "item_id bigint, suite string, text string")
    return {(r.doc_id, r.item_id): r for r in c.leaks(d, e).collect()}


def variants(w):
    changed = list(w)
    changed[6], changed[14] = "other", "changed"
    put_in = [*w[:9], "extra", *w[9:]]
    return {
        1: " ".join(w), 2: " ".join(w).upper(), 3: ", ".join(w), 4: "\n> ".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5)), 5: "<b>" + "</b> <i>".join(w) + "</i>",
        6: " ".join(x[:3] + "-\n" + x[3:] for x in w), 7: " ".join("​".join(x) for x in w), 8: "".join(chr(ord(a) + 0xFEE0) if a != " " else a for a in " ".join(w)),
        9: " ".join(w).replace("e", "е").replace("a", "á"), 10: " ".join(changed), 11: " ".join(put_in), 12: "&#44; ".join(w), 13: "**" + "** __".join(w) + "__",
    }


def test_a_passage_is_found_in_any_form(spark):
    docs = [(k, DOC([v])) for k, v in variants(ITEMS[7][5:31]).items()]
    got = found(spark, docs)
    assert set(got) == {(k, 7) for k, _ in docs}
    for (d, _), r in got.items():
        span = dict(docs)[d][r.start : r.end]
        assert c.words(span)[0] == ITEMS[7][5] or d == 10
        assert len(c.words(span)) >= 24


def test_shared_passages_short_stretches_and_instructions(spark):
    w = ITEMS[0]
    docs = [(1, DOC(w[12:36])), (2, DOC(ITEMS[4][:11])), (3, DOC([HEAD])), (4, DOC(ITEMS[5][:11], ["rain"] * 12, ITEMS[5][20:31])), (5, DOC(ITEMS[6][0:40:2])), (6, ""), (7, None), (8, DOC(ITEMS[8], ITEMS[9])), (9, DOC(R.sample(ITEMS[11], 40))), (10, " ".join(ITEMS[12]) + " " + "rain " * 60_000)]
    assert set(found(spark, docs)) == {(1, 0), (1, 30), (8, 8), (8, 9), (10, 12)}


def test_blocks_of_items_and_removal(spark, rows):
    docs = spark.createDataFrame([(1, DOC(ITEMS[1]), "s"), (2, "clean text", "s"), (3, None, None), (1, "another clean text under this id, which is as long as the other one is " * 9, "s")], "doc_id bigint, text string, source string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()], "item_id bigint, text string")
    hits = c.leaks(docs, e, block=7)
    assert [(r.doc_id, r.item_id) for r in hits.collect()] == [(1, 1)]
    clean = {r.doc_id: r for r in c.without_leaks(docs, hits).collect() if not (r.text or "").startswith("another")}
    assert c.without_leaks(docs, hits).filter("text like 'another%'").first().text == docs.filter("text like 'another%'").first().text
    assert not set(c.words(clean[1].text)) & set(LEXICON) and clean[2].text == "clean text" and clean[3].text is None
    assert rows(c.without_leaks(docs, hits, whole=True).select("doc_id")) == [(2,), (3,)]
    assert c.leaks(docs, e.limit(0)).count() == 0 and c.leaks(docs.limit(0), e).count() == 0
    assert rows(c.leak_counts(hits).select("item_id", "documents")) == [(1, 1)]


def test_spans_agree_with_words():
    for t in (*variants(ITEMS[2]).values(), "ﬁne ½ İstanbul ß x&amp;y a<b> c", "­x​y", ""):
        assert len(c.word_spans(t)) == len(c.words(t))


def test_every_stretch_of_an_item_is_found_and_removed(spark):
    w, other = ITEMS[13], lambda n: text(n, OTHER)
    changed = [x if k % 8 else "changed" for k, x in enumerate(w, 1)]
    docs = {
        1: DOC(w, other(90), w),  # twice, far apart
        2: DOC(w, other(3), w, other(5), w),  # within an item's length
        3: DOC(w[20:], other(4), w[:20]),  # parts in the other order
        4: DOC(w[:20], other(12), w[20:]),  # parts more than GAP apart
        5: DOC(w[26:], other(4), changed),  # a part too short to count before a changed copy
        6: DOC(*[p for _ in range(150) for p in (w, other(4))]),
        7: DOC(w[:11], other(4), w[20:31]),
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    e = spark.createDataFrame([(i, " ".join(x)) for i, x in ITEMS.items()], "item_id bigint, text string")
    hits = c.leaks(d, e)
    got = hits.collect()
    assert {k: sum(r.doc_id == k for r in got) for k in docs} == {1: 2, 2: 3, 3: 2, 4: 2, 5: 1, 6: 150, 7: 0}
    assert {r.item_id for r in got} == {13}
    assert c.leak_counts(hits).first().documents == 6
    clean = c.without_leaks(d, hits)
    assert c.leaks(clean, e).count() == 0
    assert all(not set(c.words(r.text)) & set(w) for r in clean.collect() if r.doc_id not in (5, 7))


def test_items_count_alike_whatever_their_number_and_block(spark):
    shared, instruction = text(24), text(30)
    long_passage = text(70)
    items = {i: text(10) + (shared if i < 20 else []) + text(20) for i in range(40)}
    items |= {i: instruction + text(30) for i in range(40, 70)} | {i: text(4) + long_passage + text(4) for i in range(70, 100)}
    more = items | {i: ["".join(R.choice("abcdefghij") for _ in range(6)) for _ in range(50)] for i in range(1000, 2000)}
    docs = spark.createDataFrame([(1, DOC(shared)), (2, DOC(instruction)), (3, DOC(items[50][30:])), (4, DOC(long_passage, shared)), (4, DOC(long_passage, shared)), (None, DOC(items[3])), (6, ""), (7, None), (8, "x &lt;b&gt;" + DOC(items[30]))], "doc_id bigint, text string")
    want = {(1, i) for i in range(20)} | {(3, 50)} | {(4, i) for i in [*range(20), *range(70, 100)]} | {(None, i) for i in range(20)} | {(8, 30)}
    seen = []
    for its, block in ((items, 1000), (items, 7), (more, 5000), (more, 100)):
        e = spark.createDataFrame([(i, " ".join(w)) for i, w in its.items()], "item_id bigint, text string")
        got = sorted(map(tuple, c.leaks(docs, e, block=block).collect()), key=repr)
        assert {(r[0], r[1]) for r in got} == want
        seen.append(got)
    assert seen[0] == seen[1] == seen[2] == seen[3] and len(seen[0]) == len(want) + 50


def test_more_ngrams_than_a_bitmap_holds_take_more_scans(spark, monkeypatch):
    monkeypatch.setattr(c, "MOST_BITS", 1 << 14)
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, DOC(w[3:30])) for i, w in list(ITEMS.items())[1:9]], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in c.leaks(docs, e, block=5).collect()} == {(i, i) for i in range(1, 9)}


def test_spans_of_escaped_markup():
    for t in ("&lt;b&gt;hello world", "a &amp;lt;i&amp;gt; b", "x&#60;br&#62;y z", "&notit; &ampfoo &#x1F600;ok", "wa-\nter <b>m&eacute;n</b> a&shy;b", "e\u0301a\u0327\u0301 \u2460\ufb01x", "İ ǰ ß ŉ"):
        spans = c.word_spans(t)
        assert len(spans) == len(c.words(t)), t
    t = "&lt;b&gt;hello world"
    assert [t[a:b] for a, b in c.word_spans(t)] == ["hello", "world"]


@given(st.text(alphabet=st.sampled_from("ab éß-\n\r&;#<>/6lt gtAMP0\u00ad\u0301аεﬁ½"), max_size=40))
def test_spans_agree_with_words_on_any_text(t):
    spans = c.word_spans(t)
    assert len(spans) == len(c.words(t)) and all(a < b for a, b in spans) and spans == sorted(spans)
