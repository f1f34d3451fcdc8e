"""Evaluation texts leaking into training text."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.session import cut

WORDS = 20
GRAM = 4
#: Longest run of other words inside a stretch, on either side.
GAP = 2
#: Share of a stretch's words that have to be the item's own.
KEPT = 0.84
#: n-grams that a stretch has within twice WORDS at least: what KEPT leaves of WORDS with changes spread evenly.
HITS = 5
#: A stretch of n-grams that more than SHARED items have each is an instruction, unless it has at least LONG words.
SHARED, LONG = 20, 60
#: Items, and bytes of their texts, of a broadcast index; more are looked for by a bitmap of their n-grams first.
ITEMS, ITEM_BYTES = 20_000, 32 << 20
#: Bits of the bitmap for each n-gram, and at most; n-grams of more items than it can hold take one more scan.
BITS, MOST_BITS = 24, 1 << 31

_marks = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\ufe20-\ufe2f]+")
_foreign = re.compile("[\u0370-\u03ff\u0400-\u04ff\u0500-\u052f]")
_word = re.compile(r"[^\W_]+")
_gone = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_tag = re.compile(r"</?[A-Za-z_][^<>\n]{0,80}>")
_entity = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_broken = re.compile("[-\u2010\u2011][ \t]*(?:\r\n|\r|\n)[ \t>|*]*(?=[^\\W\\d_])")
#: Cyrillic and Greek letters that look like Latin ones.
_alike = str.maketrans("аеорсхуіјѕԁһӏкмтвнАВЕКМНОРСТХУІЈЅαορντικεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijsdhlkmtbhABEKMHOPCTXYIJSaopvtikeABEZHIKMNOPTYX")


def _hyphenated(text: str) -> bool:
    return "-\n" in text or "-\r" in text or "- \n" in text or "\u2010" in text or "\u2011" in text


def plain(text: str) -> str:
    """``text`` without markup, hyphenation, accents, case and variants of characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _tag.sub(" ", text)
    if not text.isascii():
        text = _gone.sub("", text)
        if _foreign.search(text):
            text = text.translate(_alike)
        text = _marks.sub("", unicodedata.normalize("NFKD", text))
    if _hyphenated(text):
        text = _broken.sub("", text)
    return text.casefold()


def words(text: str | None) -> list[str]:
    """The words of a text, whatever its case, punctuation, layout, markup and form of characters."""
    return _word.findall(plain(text)) if text else []


class _Traced:
    """A text under the changes that ``plain`` makes, each character with the place it comes from."""

    def __init__(self, text: str) -> None:
        self.text, self.first, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def _set(self, pieces: list[tuple[str, int, int]]) -> None:
        self.text = "".join(p for p, _, _ in pieces)
        self.first = [a for p, a, _ in pieces for _ in p]
        self.end = [b for p, _, b in pieces for _ in p]

    def sub(self, rx: re.Pattern, by) -> None:
        pieces, last = [], 0
        keep = lambda a, b: pieces.extend(zip(self.text[a:b], self.first[a:b], self.end[a:b], strict=True))
        for m in rx.finditer(self.text):
            keep(last, m.start())
            if m.end() > m.start():
                pieces.append((by(m[0]), self.first[m.start()], self.end[m.end() - 1]))
            last = m.end()
        keep(last, len(self.text))
        self._set(pieces)

    def each(self, by) -> None:
        self._set([(by(c), a, b) for c, a, b in zip(self.text, self.first, self.end, strict=True)])


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of ``words(text)`` stand in ``text``: the same changes in the same order."""
    t = _Traced(text)
    if "&" in t.text:
        t.sub(_entity, html.unescape)
    if "<" in t.text:
        t.sub(_tag, lambda _: " ")
    if not t.text.isascii():
        t.sub(_gone, lambda _: "")
        if _foreign.search(t.text):
            t.each(lambda c: c.translate(_alike))
        t.each(lambda c: _marks.sub("", unicodedata.normalize("NFKD", c)))
    if _hyphenated(t.text):
        t.sub(_broken, lambda _: "")
    t.each(str.casefold)
    return [(t.first[m.start()], t.end[m.end() - 1]) for m in _word.finditer(t.text)]


def uncommon(common: list[bool], gram: int = GRAM) -> list[bool]:
    """Which n-grams of an item count, given those that more than SHARED items have: the others, and long runs of them."""
    out = [not c for c in common]
    i = 0
    while i < len(common):
        j = i
        while j < len(common) and common[j]:
            j += 1
        if j - i + gram - 1 >= LONG:
            out[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    return out


@lru_cache(1 << 20)
def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1


def gram_hashes(ws: list[str], gram: int = GRAM) -> np.ndarray:
    """A hash of each n-gram that is the same in every process."""
    return _mixed(np.fromiter(map(_code, ws), np.uint64, len(ws)), np.arange(max(0, len(ws) - gram + 1)), gram)


def _mixed(codes: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(gram):
            h = (h ^ codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Index:
    """Hashes of the word n-grams of items, with where they occur.

    ``counted`` tells for each item which of its n-grams count, as ``uncommon`` does; without it the items are all
    there are, and it is found out.
    """

    def __init__(self, items: list[tuple[int, str]], counted: list[list[bool]] | None = None, gram: int = GRAM) -> None:
        self.gram = gram
        texts = [(i, words(t)) for i, t in items]
        kept = [n for n, (_, w) in enumerate(texts) if len(w) >= gram]
        self.ids = [texts[n][0] for n in kept]
        self.words = [texts[n][1] for n in kept]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(x for ws in self.words for x in ws), 1)}
        hashes = [self.hashes(self.codes(ws))[1].tolist() for ws in self.words]
        if counted is None:
            # several texts of one id are one item
            holders = Counter(h for _, h in {(i, h) for i, hs in zip(self.ids, hashes, strict=True) for h in hs})
            self.seldom = [uncommon([holders[h] > SHARED for h in hs], gram) for hs in hashes]
        else:
            self.seldom = [counted[n] for n in kept]
        grams: dict[int, dict[int, None]] = defaultdict(dict)
        for k, (hs, keep) in enumerate(zip(hashes, self.seldom, strict=True)):
            for h, x in zip(hs, keep, strict=True):
                if x:
                    grams[h][k] = None
        self.keys = np.array(sorted(grams), np.uint64)
        self.holders = [list(grams[int(h)]) for h in self.keys]

    def codes(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.uint64, len(ws))

    def hashes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each n-gram made only of words that items have."""
        n = len(codes) - self.gram + 1
        if n <= 0:
            return np.zeros(0, int), np.zeros(0, np.uint64)
        known = codes[:n] > 0
        for j in range(1, self.gram):
            known = known & (codes[j : n + j] > 0)
        at = np.flatnonzero(known)
        return at, _mixed(codes, at, self.gram)

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, matching words, first word, end word) of every stretch of at least WORDS words of an item in ``text``."""
        if not text:
            return []
        ws = words(text)
        at, h = self.hashes(self.codes(ws))
        if not len(at) or not len(self.keys):
            return []
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[k] == h
        if not hit.any():
            return []
        near: dict[int, list[int]] = defaultdict(list)
        for p, j in zip(at[hit].tolist(), k[hit].tolist(), strict=True):
            for item in self.holders[j]:
                near[item].append(p)
        return [(self.ids[item], *x) for item, ps in near.items() for x in self._stretches(ws, item, ps)]

    def _stretches(self, ws: list[str], item: int, ps: list[int]) -> list[tuple[int, int, int]]:
        """Every stretch of the item in ``ws`` with hits at ``ps``: (matching words, first word, end word).

        An alignment is in the item's order, so it sees each part of the item once. What lies before, between and
        behind the stretches found is searched again with the whole item, until nothing is left in it.
        """
        own = self.words[item]
        most = len(own) + 2 * WORDS
        out, rest = [], [(0, len(ws))]
        while rest:
            lo, hi = rest.pop()
            for x, y in _areas(ps[bisect_left(ps, lo) : bisect_right(ps, hi - self.gram)], len(own)):
                a, b = max(lo, x - WORDS), min(hi, y + self.gram + WORDS)
                if b - a > 16 * most:
                    # overlapping windows, so that many copies in a row cost what their length costs
                    rest += [(k, min(b, k + 16 * most)) for k in range(a, b - 4 * most, 12 * most)]
                    continue
                found = self._runs(ws, item, a, b)
                good = [w for w, _ in found if w[0]]
                out += good
                cuts = [(f, t) for _, f, t in good]
                if not cuts and found:
                    # a run too short to count may keep a stretch behind or before it from being aligned
                    size, f, t = max((sum(m[2] for m in run), a + run[0][0], a + run[-1][0] + run[-1][2]) for _, run in found)
                    cuts = [(f, t)] if size >= self.gram else []
                if cuts:
                    edges = [a, *(x for c in cuts for x in c), b]
                    rest += [(f, t) for f, t in zip(edges[::2], edges[1::2], strict=True) if t - f >= WORDS - 2]
        return _joined(out)

    def _runs(self, ws: list[str], item: int, a: int, b: int) -> list[tuple[tuple[int, int, int], list[tuple[int, int, int]]]]:
        """The runs of blocks of ``ws[a:b]`` aligned with the item, each with what it weighs (zeros if too short)."""
        out, run = [], []
        # blocks that follow each other within GAP words on both sides form one stretch; instructions don't count
        for m in SequenceMatcher(None, ws[a:b], self.words[item], autojunk=False).get_matching_blocks():
            if m.size and run and m.a - run[-1][0] - run[-1][2] <= GAP and m.b - run[-1][1] - run[-1][2] <= GAP:
                run.append((m.a, m.b, m.size))
                continue
            if run:
                out.append((self._weigh(run, item, a), run))
            run = [(m.a, m.b, m.size)]
        return out

    def _weigh(self, run: list[tuple[int, int, int]], item: int, a: int) -> tuple[int, int, int]:
        seldom = self.seldom[item]
        lo, hi = run[0][1], run[-1][1] + run[-1][2]
        while lo < hi and not any(seldom[max(0, lo - self.gram + 1) : lo + 1]):
            lo += 1
        while hi > lo and not any(seldom[max(0, hi - self.gram) : hi]):
            hi -= 1
        same = sum(max(0, min(y + n, hi) - max(y, lo)) for _, y, n in run)
        # a changed word at either end of a stretch is part of it, though it can't be seen
        if hi - lo < WORDS - 2 or same < KEPT * WORDS or same < KEPT * (hi - lo):
            return (0, 0, 0)
        return (same, a + run[0][0], a + run[-1][0] + run[-1][2])


def _areas(ps: list[int], length: int) -> list[tuple[int, int]]:
    """Positions joined into areas where they are less than an item's length apart and somewhere dense enough."""
    out = []
    if not ps:
        return out
    first = last = ps[0]
    dense = 0
    for k, p in enumerate(ps):
        if p - last > length:
            if dense:
                out.append((first, last))
            first, dense = p, 0
        last = p
        dense |= k >= HITS - 1 and p - ps[k - HITS + 1] <= 2 * WORDS
    return [*out, (first, last)] if dense else out


def _joined(stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches in order of place; those that overlap (one seen from two windows) as one."""
    out: list[tuple[int, int, int]] = []
    for n, x, y in sorted(stretches, key=lambda s: s[1:]):
        if out and x < out[-1][2]:
            out[-1] = (max(n, out[-1][0]), out[-1][1], max(y, out[-1][2]))
        else:
            out.append((n, x, y))
    return out


def _dense(at: np.ndarray) -> bool:
    """Whether HITS of these positions lie within twice WORDS somewhere."""
    return len(at) >= HITS and bool((at[HITS - 1 :] - at[: len(at) - HITS + 1] <= 2 * WORDS).any())


def _found(text: str, hits: list[tuple]) -> list[tuple]:
    """(item, words, start, end) in characters; an id may have several texts, and what they find in one place is one stretch."""
    spans = word_spans(text)
    each: dict[object, list[tuple[int, int, int]]] = defaultdict(list)
    for i, *stretch in hits:
        each[i].append(tuple(stretch))
    return [(i, n, spans[x][0], spans[y - 1][1]) for i, found_in in each.items() for n, x, y in _joined(found_in)]


def _rows(b: pa.RecordBatch, found: list[tuple[int, list[tuple]]], item_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    at = pa.array([row for row, hits in found for _ in hits], pa.int64())
    cells = list(zip(*(x for _, hits in found for x in hits), strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([b["k"].take(at), pa.array(cells[0]).cast(item_type), *(pa.array(c, pa.int32()) for c in cells[1:]), b["h"].take(at)], names=names)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = ITEMS) -> DataFrame:
    """(key, item, words, start, end, text_hash) for each stretch of a document with at least 20 words of an item in order.

    Case, punctuation, layout, hyphenation, markup and forms of characters don't matter; up to GAP other words in a
    row inside a stretch don't end it as long as KEPT of its words are the item's. n-grams that more than SHARED items
    have are an instruction and don't count, unless LONG words of them follow each other; items are counted over the
    whole table, so neither its size nor ``block`` matters. A document has a row for
    every stretch: an item held twice, or in parts more than GAP words apart, gives several. ``start`` and ``end`` are
    character offsets in the text as stored, and ``text_hash`` tells which text where a key has several.

    Up to ``block`` items whose texts have at most ITEM_BYTES are broadcast as an index of their n-grams, and the
    documents, read whole, are scanned once without a shuffle. Beyond, the n-grams are kept as a table, and a bitmap
    of them, of a fixed number of bits for any number of items, is broadcast instead: documents dense enough in its
    n-grams are joined with the items that have these, and only those few are searched as before. Null and blank texts
    and null ids of items have no cases. Repeated item rows count once; repeated documents give their rows each.
    """
    rows = items.filter(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t")).distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    kinds = {**dict(documents.dtypes), "item": dict(items.dtypes)[item]}
    names = [key, item, "words", "start", "end", "text_hash"]
    schema = f"`{key}` {kinds[key]}, `{item}` {kinds['item']}, words int, start int, end int, text_hash bigint"
    item_type = pa.int64() if kinds["item"] == "bigint" else pa.int32() if kinds["item"] == "int" else pa.string()
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h")).filter("t is not null")
    if size.n > block or size.bytes > ITEM_BYTES:
        near = _near(docs, rows)

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for n, (t, xs) in enumerate(zip(b["t"].to_pylist(), b["items"].to_pylist(), strict=True)):
                    if hits := Index([(x["i"], x["t"]) for x in xs], [x["counted"] for x in xs]).search(t):
                        found.append((n, _found(t, hits)))
                yield _rows(b, found, item_type, names)

        return near.mapInArrow(check, schema)
    index = documents.sparkSession.sparkContext.broadcast(Index([(r.i, r.t) for r in rows.orderBy("i", "t").collect()]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = index.value.search
        for b in batches:
            yield _rows(b, [(n, _found(t, hits)) for n, t in enumerate(b["t"].to_pylist()) if (hits := search(t))], item_type, names)

    return docs.mapInArrow(scan, schema)


def _near(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(k, t, h, items): the documents dense in n-grams of items, each with the items (i, t, counted) it may hold."""
    kind = dict(items.dtypes)["i"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [gram_hashes(words(t)).view(np.int64) for t in b["t"].to_pylist()]
            at = pa.array(np.repeat(np.arange(len(hs)), [len(h) for h in hs]))
            cells = [np.concatenate([np.arange(len(h)) for h in hs]) if hs else [], np.concatenate(hs) if hs else []]
            yield pa.RecordBatch.from_arrays([b["i"].take(at), b["x"].take(at), pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64())], names=["i", "x", "p", "g"])

    items = items.withColumn("x", F.xxhash64("t"))
    each = cut(items.mapInArrow(grams, f"i {kind}, x bigint, p int, g bigint"))
    common = each.select("i", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARED).select("g", F.lit(True).alias("common"))
    flags = each.join(common, "g", "left").groupBy("i", "x").agg(F.sort_array(F.collect_list(F.struct("p", F.coalesce("common", F.lit(False)).alias("c")))).alias("ps"))

    def mark_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [uncommon([y["c"] for y in ps]) for ps in b["ps"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["i"], b["x"], pa.array(counted, pa.list_(pa.bool_()))], names=["i", "x", "counted"])

    counted = cut(flags.mapInArrow(mark_counted, f"i {kind}, x bigint, counted array<boolean>"))
    postings = each.join(counted, ["i", "x"]).filter(F.element_at("counted", F.col("p") + 1)).select("g", "i", "x").distinct()
    postings = cut(postings)
    n = postings.count()
    parts = max(1, -(-n * BITS // MOST_BITS))
    bits = 1 << max(18, int(np.ceil(np.log2(max(1, n) * BITS / parts))))
    texts = counted.join(items, ["i", "x"]).select("i", "x", F.struct("i", "t", "counted").alias("item"))
    out = None
    for part in range(parts):
        # an item's n-grams stay together, so that a document dense in them is so in one scan
        mine = postings.filter(F.pmod(F.xxhash64("i", "x"), F.lit(parts)) == part) if parts > 1 else postings
        dense = cut(_dense_in(docs, mine, bits))
        # copies of a document count once
        hits = dense.select("d", "g").dropDuplicates(["d"]).select("d", F.explode("g").alias("g")).groupBy("d", "g").agg(F.count(F.lit(1)).alias("n"))
        pairs = hits.join(mine, "g").groupBy("d", "i", "x").agg(F.sum("n").alias("n")).filter(F.col("n") >= HITS)
        lists = pairs.join(texts, ["i", "x"]).groupBy("d").agg(F.collect_list("item").alias("items"))
        near = dense.select("d", "k", "t", "h").join(lists, "d").select("k", "t", "h", "items")
        out = near if out is None else out.unionByName(near)
    return out


def _dense_in(docs: DataFrame, postings: DataFrame, bits: int) -> DataFrame:
    """(d, k, t, h, g): documents with HITS of the n-grams within twice WORDS, with all their n-grams that may be among them.

    ``d`` is a hash of key and text; two documents of one hash are only searched for more items than they need.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["k"]
    segment = 1 << 18

    def mark(group: pa.Table) -> pa.Table:
        field = np.zeros(segment, bool)
        field[group["b"].to_numpy()] = True
        return pa.table({"s": group["s"][:1], "field": pa.array([np.packbits(field).tobytes()], pa.binary())})

    low = F.col("g").bitwiseAND(F.lit(bits - 1))
    spots = postings.select(F.shiftright(low, 18).cast("int").alias("s"), low.bitwiseAND(F.lit(segment - 1)).cast("int").alias("b")).distinct()
    bitmap = np.zeros(bits // 8, np.uint8)
    # the segments together are the bitmap: bits / 8 bytes, however many n-grams there are
    for r in spots.groupBy("s").applyInArrow(mark, "s int, field binary").toLocalIterator():
        bitmap[r.s * (segment // 8) : (r.s + 1) * (segment // 8)] = np.frombuffer(r.field, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            hits: list[np.ndarray] = []
            for n, t in enumerate(b["t"].to_pylist()):
                g = gram_hashes(words(t))
                spot = g & np.uint64(bits - 1)
                hit = (shared.value[(spot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (spot & np.uint64(7)).astype(np.uint8))) & 1
                at = np.flatnonzero(hit)
                if _dense(at):
                    rows.append(n)
                    hits.append(g[at].view(np.int64))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in "dkth"), pa.array(hits, pa.list_(pa.int64()))], names=["d", "k", "t", "h", "g"])

    return docs.select(F.xxhash64("k", "t").alias("d"), "k", "t", "h").mapInArrow(scan, f"d bigint, k {kind}, t string, h bigint, g array<bigint>")


def without_leaks(documents: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``documents`` without the leaked spans, or with ``whole`` without the documents that have any."""
    if whole:
        return documents.join(found.select(key).distinct(), key, "left_anti")
    columns = documents.columns
    spans = found.groupBy(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, ss in zip(b[text].to_pylist(), b["__spans"].to_pylist(), strict=True):
                if t and ss:
                    kept, last = [], 0
                    for s in ss:
                        kept.append(t[last : max(last, s["start"])])
                        last = max(last, s["end"])
                    t = "".join([*kept, t[last:]])
                out.append(t)
            names = [n for n in b.schema.names if n != "__spans"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else b[n] for n in names], names=names)

    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text)) == F.col("__hash"))
    return documents.join(spans, same, "left").select(*columns, "__spans").mapInArrow(remove, documents.schema)


def leak_counts(found: DataFrame, item: str = "item_id", key: str = "doc_id") -> DataFrame:
    """How many documents each leaked item was found in, however often a document holds it."""
    return found.groupBy(item).agg(F.count_distinct(F.struct(key, "text_hash")).alias("documents"), F.max("words").alias("longest"))


