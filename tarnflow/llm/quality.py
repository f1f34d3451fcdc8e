"""Per-document text quality statistics that tell running prose from lists, tables and junk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common function words (articles, prepositions, conjunctions, pronouns, auxiliaries) of four languages.
_EN = "the a an of and to in is was it that for on with as at the by which but so from be not are were this had or we i when then than they you he she its if while because until after before near could should would can will has have been do did does who what there their our my your into about only no nor yet both each every many some all one two how why where whether though although again once more most"
_DE = "der die das den dem des ein eine einen einem einer und oder aber nicht ist war sind im in am an auf aus bei mit nach von vom zum zur zu für um wenn dass weil ob als wie es er sie wir ich nur noch sehr doch dann seit durch über unter vor hinter gegen bis während obwohl dazu alles wird wurde hat haben muss kann"
_FR = "le la les l un une des du de d et ou mais ne pas que qu qui est en au aux dans sur sous pour par avec sans il elle nous vous ils ce cette ces se si y a à plus très puis vers pendant derrière près jusqu tout après avant sont était ont avait"
_ES = "el la los las un una unos unas de del y o pero no que es en al con sin por para se si lo su sus muy más ya como hasta desde durante tras cuando aunque luego todo nuestro nuestra está esta este solo sólo son era fue ha había"

_stop = frozenset(f"{_EN} {_DE} {_FR} {_ES}".split())
_common = frozenset("the and of to in a is was it for on with that der die und le la les et de que el los y en un".split())

_token = re.compile(r"[^\W\d_]+")
_wide = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힯\U00020000-\U0002fa1f]")
_sentence = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=\S)|(?<=[。！？])(?=\S)")
_mark = re.compile(r"\s*(?:[-*+•–—·>o#]|\(?\d{1,4}(?:\.\d{1,3})*[.):]?|\[.?\]|\(?[a-z][.)])\s+\S")
_record = re.compile(r"\s*[\[(<{]?\d{1,4}[-:./]\d\d[^A-Za-z]*")
_cell = re.compile(r"[\t|;=]|\s{2,}|\": |\.{3,}|,(?=\S)")
_gap = re.compile(r"(?<=\S)\s{2,}(?=\S)")
_symbol = re.compile(r"[^\w\s]")
_ascii_words = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}
_ascii_symbols = {i: None for i in range(128) if chr(i) == "_" or chr(i).isalnum() or chr(i).isspace()}
_ENDS = frozenset(".!?…:;。！？।؟\"'”’)]")
_STOPS = frozenset(".!?…。！？।؟")
_vowel = re.compile("[aeiouy]")
_part = re.compile(r"[,;:|/·•]+\s*|\s{2,}|\s+[>-]\s+")

PROSE, WEAK, JUNK = 2, 1, 0
#: Characters above which a line is judged sentence by sentence, and words of the longest piece.
LONG_LINE, LONG_PIECE = 160, 30
#: Lines that a block needs to be judged by its layout, and the longest period searched in it.
BLOCK, PERIOD = 12, 8
#: What a piece needs to be a sentence, and below what it can't be one.
SENTENCE, NONE = 1.5, 0.0
#: What the signals take from a piece: a layout of rows, aligned delimiters, delimiters inside it, a list mark.
ROWS, ALIGNED, LISTED, MARKED = 4.0, 3.0, 3.0, 2.0
#: What junk has at most: the share of letters, the length of words, different words, and function words.
LETTERS, WORD_LENGTH, DISTINCT, FUNCTION = 0.6, (2.0, 13.0), 0.4, 0.78


def _words(p: str) -> list[str]:
    """Runs of letters in lower case."""
    return p.translate(_ascii_words).split() if p.isascii() else _token.findall(p.lower())


def _symbols(p: str) -> int:
    """Characters that are neither letters, digits nor white space."""
    return len(p.translate(_ascii_symbols)) if p.isascii() else len(_symbol.findall(p))


def _stops(p: str) -> bool:
    """Whether a piece ends like a sentence, closing marks aside."""
    return p.rstrip("\"'”’)] \t")[-1:] in _STOPS


def _likeness(p: str, ws: list[str], letters: int, dense: int, small: frozenset[str] = _stop) -> float:
    """How much a piece of text with these lower-case words is like a sentence by itself: its word, symbol and punctuation ratios.

    Words count for it by their number, and function words by their share; so does the form of a sentence, with an
    initial and an end mark, which is what is left to go by in a language whose function words aren't known. A piece
    with few letters among its symbols and digits, with words too long or too short, with few different words, of
    function words alone, or of short parts between delimiters isn't one.
    """
    k = len(ws)
    mean = letters / k if k else 0.0
    if not p.isascii() and _wide.search(p):
        k, mean = sum(max(1, len(w) // 2) if _wide.search(w) else 1 for w in ws), 4.0
    if not k or letters < LETTERS * dense or not WORD_LENGTH[0] <= mean <= WORD_LENGTH[1] or len(p) > 60 and mean != 4.0 and dense > 0.95 * len(p):
        return -4.0
    share = sum(map(small.__contains__, ws)) / k
    if k >= 7 and share > FUNCTION or k >= 10 and len(ws) == k and len(set(ws)) < DISTINCT * k:
        return -4.0
    if k >= 4 and share < 0.2 and p.isascii() and 2 * sum(not _vowel.search(w) for w in ws) > k:
        return -4.0
    first = p.lstrip("\"'“”‘’«»([{-–—¿¡ \t")[:1]
    formed = k >= 4 and first.upper() == first and not first.isdigit() and _stops(p)
    words = 2.0 if k >= 8 else 1.0 if k >= 6 else 0.0 if k >= 4 else -1.0
    function = min(2.0, max(-2.5 if k >= 8 else -1.5, 12.5 * (share - 0.2)))
    return words + (max(function, 0.0) + 1.5 if formed else function)


def _listed(p: str, k: int) -> bool:
    """Whether a piece with ``k`` words is a list in one line: short parts, or parts of like length, between delimiters."""
    if k < 5 or sum(map(p.count, ",;:|/·•>")) < 3 and "  " not in p and " - " not in p:
        return False
    sizes = [len(x.split()) for x in _part.split(p.strip())]
    return len(sizes) >= 4 and (k < 3 * len(sizes) or k < 6 * len(sizes) and max(sizes[:-1]) - min(sizes[:-1]) <= 2)


def _aligned(lines: list[str], words: list[list[str]] | None = None) -> list[bool]:
    """Lines in runs of at least three whose delimiters are equal in kind and number, or whose gaps end in the same columns.

    Where there are no delimiters, function words part the cells: rows like 'the _ of the _ by the _' have the same in
    the same order.
    """
    sign: list[tuple[str, object] | None] = []
    for i, s in enumerate(lines):
        if found := _cell.findall(s.strip()):
            kinds = Counter("gap" if m.isspace() and m != "\t" else "..." if m[0] == "." else m for m in found)
            kind, n = kinds.most_common(1)[0]
            sign.append((kind, {m.end() for m in _gap.finditer(s)} if kind == "gap" else n))
        elif len(s) <= LONG_LINE:
            small = [w for w in (words[i] if words else _words(s)) if w in _stop]
            sign.append(("words", " ".join(small)) if len(small) >= 3 else None)
        else:
            sign.append(None)

    def alike(x, y) -> bool:
        if x is None or y is None or x[0] != y[0]:
            return False
        if x[0] != "gap":
            return x[1] == y[1]
        return bool(x[1] and y[1]) and 2 * len(x[1] & y[1]) > max(len(x[1]), len(y[1]))

    out = [False] * len(lines)
    i = 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and alike(sign[j - 1], sign[j]):
            j += 1
        if j - i >= 3 and (sign[i][0] in ("gap", "=", "|", "\t", "...", "words") or sign[i][1] >= 2):
            out[i:j] = [True] * (j - i)
        i = j
    return out


def _lag1(x: np.ndarray) -> float:
    """Autocorrelation of successive values; 0 for constant or short series."""
    if len(x) < 4:
        return 0.0
    d = x - x.mean()
    v = float(d @ d)
    return float(d[1:] @ d[:-1]) / v if v > 0 else 0.0


def _period(x: np.ndarray) -> bool:
    """Whether values come back after a period of 2 to PERIOD lines, and not just because they change slowly."""
    d = x - x.mean()
    v = float(d @ d)
    if v <= 0:
        return False
    n = len(x)
    r = [float(d[p:] @ d[:-p]) / v * n / (n - p) for p in range(1, min(PERIOD, n // 4) + 1)]
    return any(y >= 0.75 and y >= r[0] + 0.3 for y in r[1:])


def _laid_out(lines: list[str]) -> bool:
    """Whether a block of lines is rows of a table, menu or list by its layout: regular lengths, or periodic indents or lengths."""
    body = [s.strip() for s in lines]
    n = len(body)
    text = "".join(body)
    # rows seldom end like sentences, unless they are full of symbols
    if sum(map(_stops, body)) >= 0.2 * n and _symbols(text) < 0.15 * (len(text) - text.count(" ")):
        return False
    lengths = np.array([len(s) for s in body], float)
    counts = np.array([len(s.split()) for s in body], float)
    # wrapped sentences, and speakers with what they say below them, have such forms too, but longer lines
    if np.quantile(counts, 0.75) > 8:
        return False
    # rows of like length have one number of words, which wrapped lines have not
    if lengths.std() < 0.1 * lengths.mean() and counts.std() <= 0.6:
        return True
    return _period(np.array([len(a) - len(a.lstrip()) for a in lines], float)) or _period(lengths)


def _by_layout(text: str) -> list[bool]:
    """For each non-blank line, whether the block it stands in is laid out as rows; short blocks that follow each other count as one."""
    blocks: list[list[str]] = [[]]
    for s in text.splitlines():
        if not s.strip() or len(s.strip()) > LONG_LINE:
            blocks.append([])
            if s.strip():
                blocks += [[s], []]
        else:
            blocks[-1].append(s)
    joined: list[list[str]] = []
    small = False
    for b in filter(None, blocks):
        few = len(b) < BLOCK and len(b[0].strip()) <= LONG_LINE
        if few and small:
            joined[-1] += b
        else:
            joined.append(list(b))
        small = few
    return [x for b in joined for x in [len(b) >= BLOCK and _laid_out(b)] * len(b)]


def _wrapped(lines: list[str], block: list[int], apart: list[bool]) -> list[list[int]]:
    """The lines of each piece of text: lines that were filled up to one width belong together, others stand alone.

    A line was filled if the first word of the next one would not have gone into the width of their block; most lines
    of a block have to be, but for those that end a sentence.
    """
    out: list[list[int]] = []
    i, n = 0, len(lines)
    while i < n:
        j = i + 1
        while j < n and block[j] == block[i]:
            j += 1
        width = max(map(len, lines[i:j]))
        if j - i == 1 or not 20 <= width <= LONG_LINE:
            out += [[k] for k in range(i, j)]
        else:
            full = [len(a) + 1 + len(b.split(None, 1)[0]) > width and not x and not y for a, b, x, y in zip(lines[i : j - 1], lines[i + 1 : j], apart[i:j], apart[i + 1 : j], strict=False)]
            short = sum(not f and not _stops(a) for f, a in zip(full, lines[i:j], strict=False))
            joined = sum(full) >= 2 * short
            out.append([i])
            for k in range(i + 1, j):
                if joined and full[k - 1 - i]:
                    out[-1].append(k)
                else:
                    out.append([k])
        i = j
    return out


def describe(text: str | None) -> tuple | None:
    """The statistics of one text (see ``text_quality``), None for null or blank text."""
    if not text or not (body := text.replace("\ufeff", "")).strip():
        return None
    lines: list[str] = []
    block: list[int] = []
    n = 0
    for s in body.splitlines():
        if s.strip():
            lines.append(s)
            block.append(n)
        else:
            n += 1
    stripped = [s.strip() for s in lines]
    by_line = [_words(s) if len(s) <= LONG_LINE else [] for s in stripped]
    aligned = _aligned(lines, by_line) if len(lines) >= 3 else [False] * len(lines)
    marked = [bool(_mark.match(s)) for s in lines]
    record = [bool(_record.match(s)) for s in lines]
    rows = _by_layout(body) if len(lines) >= BLOCK else [False] * len(lines)
    pieces: list[tuple[str, list[str], int, float]] = []
    words = letters = common = function = 0
    distinct: set[str] = set()
    for run in _wrapped(stripped, block, [a or m or r for a, m, r in zip(aligned, marked, record, strict=True)]):
        i = run[0]
        taken = ROWS * (sum(rows[j] for j in run) / len(run)) + ALIGNED * aligned[i] + MARKED * (marked[i] or record[i])
        alone = len(run) == 1 and len(stripped[i]) <= LONG_LINE
        for p in [stripped[i]] if alone else filter(None, _sentence.split(" ".join(stripped[j] for j in run))):
            ws = by_line[i] if alone else _words(p)
            size = sum(map(len, ws))
            words += len(ws)
            letters += size
            common += sum(map(_common.__contains__, ws))
            function += sum(map(_stop.__contains__, ws))
            distinct.update(ws)
            pieces.append((p, ws, size, taken))
    small = _stop
    if words >= 40 and function < 0.06 * words:
        # in a language that isn't known the frequent short words take their place
        seen = Counter(w for _, ws, _, _ in pieces for w in ws if len(w) <= 3)
        small = _stop.union(w for w, n in seen.items() if n >= 3)
    units: list[list] = []
    for p, ws, size, taken in pieces:
        k, dense = len(ws), len(p) - p.count(" ")
        parts = [(p, ws, len(p))]
        if k > LONG_PIECE + 10:
            parts = [(" ".join(w), w, len(p) * len(w) / k) for w in (ws[a : a + LONG_PIECE] for a in range(0, k, LONG_PIECE))]
        less = taken + LISTED * _listed(p, k)
        for q, w, share in parts:
            m = len(w)
            score = NONE if len(parts) > 1 and m <= 5 else _likeness(q, w, size * m // k if k else 0, dense * m // k if k else dense, small)
            # a few words alone, such as a heading, are no evidence
            kind = WEAK if not less and m <= 3 and score >= -2.5 else PROSE if score - less >= SENTENCE else WEAK if score - less >= NONE else JUNK
            units.append([share, kind, q])
    seen = Counter(u[2] for u in units)
    for u in units:
        if seen[u[2]] >= 3:
            u[1] = JUNK
    # fragments take the kind of what they stand between; long runs of them are lists
    i, n = 0, len(units)
    while i < n:
        if units[i][1] != WEAK:
            i += 1
            continue
        j = i
        while j < n and units[j][1] == WEAK:
            j += 1
        before, after = units[i - 1][1] if i else JUNK, units[j][1] if j < n else JUNK
        kind = PROSE if j - i <= 3 and PROSE in (before, after) else JUNK
        for u in units[i:j]:
            u[1] = kind
        i = j
    total = sum(u[0] for u in units) or 1
    prose = sum(u[0] for u in units if u[1] == PROSE)
    lengths = np.array([len(s) for s in stripped], float)
    indents = np.array([len(a) - len(a.lstrip()) for a in lines], float)
    plain = len(body) - sum(map(str.isspace, body)) if len(body) < 200 else len("".join(body.split()))
    count = len(lines)
    return (
        words,
        letters / words if words else 0.0,
        _symbols(body) / max(plain, 1),
        sum(s[-1] in _ENDS for s in stripped) / count,
        common / words if words else 0.0,
        len(distinct) / words if words else 0.0,
        count,
        sum(aligned) / count,
        sum(marked) / count,
        sum(rows) / count,
        _lag1(indents),
        _lag1(lengths),
        prose / total,
    )


COLUMNS = (
    ("words", "int"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("lines_ending_in_punctuation", "double"), ("common_word_share", "double"), ("distinct_word_share", "double"),
    ("lines", "int"), ("aligned_line_share", "double"), ("marked_line_share", "double"), ("laid_out_line_share", "double"), ("indent_autocorrelation", "double"), ("line_length_autocorrelation", "double"), ("prose_share", "double"),
)


def text_quality(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: word, symbol, punctuation and common-word figures, figures of its layout, and ``prose_share``.

    Layout: the share of lines whose delimiters align with those of their neighbours, the share with list marks, the
    share in blocks laid out as rows, and the autocorrelation of successive indents and line lengths. ``prose_share``
    is the share of characters in running sentences. Lines filled up to one width are read as one text; lines, and
    sentences of long ones, get a score from the signals together: number of words and share of function words (in
    texts of unknown languages the frequent short words), form of a sentence, share of letters, word length, different
    words, less what aligned delimiters, delimiters inside a line, list marks and the layout of their block take away.
    Blocks of at least 12 short lines that seldom end like sentences (or are full of symbols) are laid out as rows if
    their lengths and numbers of words are regular, or if the autocorrelation of indents or lengths shows a period of
    2 to 8 lines. Pieces near the threshold take the kind of what they stand between.

    Texts are read whole, one pass without a shuffle. Null and blank texts have null figures; repeated documents give
    a row each; an empty table gives an empty result; other columns are ignored.
    """
    kind = dict(documents.dtypes)[key]
    types = [pa.int32() if t == "int" else pa.float64() for _, t in COLUMNS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(t) or (None,) * len(COLUMNS) for t in b["t"].to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([b["k"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *(n for n, _ in COLUMNS)])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(scan, f"`{key}` {kind}, " + ", ".join(f"{n} {t}" for n, t in COLUMNS))


def not_prose(quality: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Keys of the documents of which less than ``least`` of the characters are running sentences."""
    return quality.filter(F.col("prose_share") < least).select(key)
