import random
import textwrap

import pytest

from tarnflow.llm.quality import COLUMNS, _by_layout, describe, not_prose, text_quality

R = random.Random(1)
PROSE = "The old pump was repaired in March, and nobody has seen water in the yard since then. Two of the neighbours wrote to the office because they had expected a bill. It is quiet here again."
NOUNS = ["bolt", "lens", "filter", "mast", "cup", "seal", "gauge", "clamp"]
SAME = {
    "sentences": PROSE,
    "wrapped": "The old pump was repaired in March, and nobody\nhas seen water in the yard since then. Two of\nthe neighbours wrote to the office because they\nhad expected a bill. It is quiet here again.",
    "one to a line": PROSE.replace(". ", ".\n"),
    "bare": PROSE.lower().replace(".", "").replace(",", ""),
    "speakers": "\n".join(f"{n}: {s}." for n, s in zip(("ann", "bob", "cy"), PROSE.rstrip(".").split(". "))),
    "wide": PROSE.replace(" ", "   "),
    "german": "Die Pumpe wurde im März repariert, und seitdem hat niemand mehr Wasser im Hof gesehen. Die Nachbarn haben an das Amt geschrieben, weil sie eine Rechnung erwartet hatten.",
    "french": "La pompe a été réparée en mars, et personne n'a vu d'eau dans la cour depuis. Les voisins ont écrit au bureau parce qu'il était fermé pendant la nuit.",
    "spanish": "La bomba fue reparada en marzo y nadie ha visto agua en el patio desde entonces. Los vecinos han escrito a la oficina porque la puerta estaba cerrada por la noche.",
    "with a list": PROSE + " Later " + PROSE.lower() + "\n- bolt\n- lens\n- seal for mast",
}
NOT = {
    "bullets": "\n".join(f"- {R.choice(NOUNS)} for {R.choice(NOUNS)}" for _ in range(20)),
    "numbers": "\n".join(f"{i}. the {R.choice(NOUNS)} of the {R.choice(NOUNS)} by the gate" for i in range(20)),
    "csv": "a;b;c\n" + "\n".join(f"{R.choice(NOUNS)};{R.randrange(99)};{R.random():.2f}" for _ in range(20)),
    "table": "\n".join(f"| {R.choice(NOUNS)} | {R.randrange(99)} | {R.choice(NOUNS)} |" for _ in range(20)),
    "columns": "\n".join(f"{R.choice(NOUNS):<14}{R.choice(NOUNS):<14}{R.randrange(99)}" for _ in range(20)),
    "menu": "Home | About | Contact | Login\nNext > Previous > Top\nPrint · Share · Help",
    "log": "\n".join(f"12:0{i}:33 INFO sink={R.choice(NOUNS)} n={R.randrange(999)}" for i in range(9)),
    "repeated": "please wait ... " * 40,
    "sentence again and again": "The page was not found in the index of the site.\n" * 12,
    "soup": " ".join(R.choice(["the", "of", "and", "to", "in", "is", "it", "was"]) for _ in range(200)),
    "consonants": " ".join("".join(R.choice("bcdfghjklmnp") for _ in range(7)) for _ in range(80)),
    "symbols": "".join(R.choice("#*|\\/<>-_=~ ") for _ in range(400)),
    "base64": "".join(R.choice("ABCDEFGHabcdefgh0123+/") for _ in range(900)),
    "json": "\n".join('{"sensor": "%s", "ok": true, "t": %d}' % (R.choice(NOUNS), R.randrange(99)) for _ in range(12)),
    "mostly list": PROSE[:80] + "\n" + "\n".join(f"* {R.choice(NOUNS)} for {R.choice(NOUNS)}" for _ in range(40)),
}


@pytest.mark.parametrize("name", SAME)
def test_prose(name):
    assert describe(SAME[name])[-1] > 0.6, describe(SAME[name])


@pytest.mark.parametrize("name", NOT)
def test_no_prose(name):
    assert describe(NOT[name])[-1] < 0.4, describe(NOT[name])


def test_figures():
    d = dict(zip((n for n, _ in COLUMNS), describe("The cat sat.\nA dog, too")))
    assert d["words"] == 6 and d["mean_word_length"] == pytest.approx(16 / 6) and d["lines"] == 2 and d["lines_ending_in_punctuation"] == 0.5
    assert d["symbol_ratio"] == pytest.approx(2 / 18) and d["common_word_share"] == pytest.approx(2 / 6) and d["distinct_word_share"] == 1
    assert dict(zip((n for n, _ in COLUMNS), describe(NOT["columns"])))["aligned_line_share"] == 1
    assert dict(zip((n for n, _ in COLUMNS), describe("x\n    y\nx\n    y\nx\n    y\n")))["indent_autocorrelation"] < -0.5


def test_table(spark, rows):
    data = [(1, PROSE), (2, NOT["csv"]), (3, None), (4, " \n\t "), (5, " ".join(f"On day {i} the pump was still running and nobody had seen water." for i in range(20_000))), (1, PROSE), (6, "﻿")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in data], "doc_id bigint, text string, words string, lines int")
    q = text_quality(df)
    assert q.count() == 7 and rows(not_prose(q)) == [(2,)]
    assert rows(q.filter("prose_share is null").select("doc_id")) == [(3,), (4,), (6,)]
    assert text_quality(df.limit(0)).count() == 0


LAYOUT = {
    "single-space columns": "\n".join(f"{R.choice(['the old', 'a new', 'the big'])} {R.choice(NOUNS)[:4]} is in {R.choice(NOUNS)[:4]} {R.choice(NOUNS)[:4]} {R.randrange(10, 99)}" for _ in range(24)),
    "periodic indents": "\n".join(x for i in range(8) for x in (f"The {R.choice(NOUNS)} of the {R.choice(NOUNS)} {i}", f"    was in the {R.choice(NOUNS)} box {i}", f"    has a {R.choice(NOUNS)} to it {i}")),
    "records apart": "\n\n".join(f"This is the {R.choice(NOUNS)} {i}\n  has a {R.choice(NOUNS)}\n  is at the gate of the old {R.choice(NOUNS)}" for i in range(9)),
}
SPOKEN = "\n".join(f"{n}\n    {s}" for n, s in zip("ann bob cy dan eve fay gus".split(), ["the old pump was repaired in the yard by two of us", "i think that nobody has seen the water since then", "we had expected a bill from the office and it never came to us", "it is so quiet here again that i could sleep", "you should have told them before they went home for the night", "they said it was not their pump at all", "then whose is it if it is in our yard"]))
WRAPPED = textwrap.fill(" ".join(f"{PROSE} On day {i} the pump was still running and it had been seen by all of us." for i in range(9)).lower().replace(".", ""), 46)


@pytest.mark.parametrize("name", LAYOUT)
def test_rows_known_by_layout_alone(name):
    assert describe(LAYOUT[name])[-1] < 0.4, describe(LAYOUT[name])


def test_wrapped_and_spoken_sentences_are_no_rows():
    assert not any(_by_layout(WRAPPED)) and not any(_by_layout(SPOKEN)) and describe(SPOKEN)[-1] > 0.6
    rows = LAYOUT["single-space columns"]
    assert _by_layout(f"{WRAPPED}\n\n{rows}") == [False] * len(WRAPPED.splitlines()) + [True] * 24


UNSEEN = {
    "plain english": "Snow covers every rooftop along our street tonight. Children drag wooden sledges uphill. Grandmother brews strong coffee, hums softly and watches sparks dance above glowing embers. Nobody hurries anywhere.",
    "russian": "Вчера вечером мы долго гуляли вдоль реки. Старый мост снова закрыли на ремонт, поэтому пришлось идти в обход. Домой вернулись поздно, зато увидели первый лёд.",
    "chinese": "昨天晚上我们沿着河边散步了很久。旧桥又因为维修而关闭，所以只好绕路回家。虽然回来得很晚，但是看到了今年的第一场雪。孩子们高兴得又跳又叫。",
    "polish": "Wczoraj wieczorem długo spacerowaliśmy wzdłuż rzeki. Stary most znowu zamknięto z powodu remontu, więc trzeba było iść naokoło. Do domu wróciliśmy późno, ale zobaczyliśmy pierwszy lód.",
    "turkish": "Dün akşam nehir boyunca uzun süre yürüdük. Eski köprü onarım için yine kapatılmıştı, bu yüzden dolaşmak zorunda kaldık. Eve geç döndük ama ilk buzu gördük.",
    "italian without marks": "ieri sera abbiamo camminato a lungo lungo il fiume e il vecchio ponte era di nuovo chiuso per lavori e quindi siamo passati di là e poi siamo tornati a casa tardi ma abbiamo visto il primo ghiaccio e i bambini erano così felici che non volevano più andare a letto e il nonno rideva con loro e la nonna ha portato il tè",
    "dialogue": '"Where were you?" asked Maria.\n"Out," said Tom, and closed the door behind him.\n"Nobody goes out in weather like this."\n"I had to see whether the boat still lay at its mooring."',
    "narrow": textwrap.fill("Two swans crossed the bay while fishermen folded their nets. Clouds gathered slowly over distant hills, and somewhere a dog barked at passing carts. Evening smelled of salt and tar.", 32),
}


@pytest.mark.parametrize("name", UNSEEN)
def test_prose_of_other_languages_and_styles(name):
    assert describe(UNSEEN[name])[-1] > 0.6, describe(UNSEEN[name])


SMALL = "the of and to in is it was that for on with as at by from not are this had".split()
PICK = lambda *words: R.choice(words)
MADE = ["".join(R.choice("bdfglmnprst") + R.choice("aeiou") for _ in range(3)) for _ in range(300)]
#: A constant, a value that takes its signal away, and a text that is not prose by this signal alone.
SIGNALS = {
    "layout of lengths": ("ROWS", 0.0, "\n".join(f"{PICK('this', 'that', 'each', 'some')} {R.choice(NOUNS)[:4]} {PICK('is', 'in', 'by')} {PICK('near', 'with', 'from', 'over')} {PICK('many', 'more', 'both', 'once')} {R.choice(MADE)[:4]} {R.choice(MADE)[:4]}" for _ in range(24))),
    "layout of indents": ("PERIOD", 1, LAYOUT["periodic indents"]),
    "function words as delimiters": ("ALIGNED", 0.0, NOT["numbers"]),
    "delimiters in a line": ("LISTED", 0.0, "; ".join(f"the {R.choice(MADE)} {PICK('is', 'was')} near {R.choice(MADE)}" for _ in range(7))),
    "marks": ("MARKED", 0.0, "\n".join(f"- {PICK('the', 'a', 'this')} {R.choice(MADE)} {PICK('of', 'for', 'with')} {PICK('the', 'every', 'some')} {R.choice(MADE)} {R.choice(MADE)}" for _ in range(11))),
    "symbols among letters": ("LETTERS", 0.0, " ".join(f"{R.choice(SMALL)} #{R.randrange(10**7)}% {R.choice(MADE)}" for _ in range(14))),
    "length of words": ("WORD_LENGTH", (0.0, 99.0), " ".join(f"{R.choice(SMALL)} {R.choice(SMALL)} {''.join(R.sample(MADE, 8))}" for _ in range(14))),
    "different words": ("DISTINCT", 0.0, " ".join(["please", "wait", "while", "the", "page", "is", "made"] * 40)),
    "function words": ("FUNCTION", 9.0, " ".join(R.sample(SMALL, 20))),
}


@pytest.mark.parametrize("name", SIGNALS)
def test_every_signal_decides(name, monkeypatch):
    from tarnflow.llm import quality

    constant, without, text = SIGNALS[name]
    assert describe(text)[-1] < 0.5, describe(text)
    monkeypatch.setattr(quality, constant, without)
    assert describe(text)[-1] >= 0.5, describe(text)


def test_form_of_sentences_decides(monkeypatch):
    from tarnflow.llm import quality

    monkeypatch.setattr(quality, "_stops", lambda p: False)
    assert describe(UNSEEN["russian"])[-1] < 0.5 and describe(SAME["sentences"])[-1] > 0.6


def test_spikes_of_length_come_back_in_a_period(monkeypatch):
    from tarnflow.llm import quality

    rows = "\n".join(x for _ in range(8) for x in (f"{PICK('this', 'that')} {R.choice(MADE)}{R.choice(MADE)} is for {R.choice(MADE)}{R.choice(MADE)} {R.choice(MADE)}{R.choice(MADE)} in {R.choice(MADE)}", f"{PICK('it', 'he')} {PICK('is', 'was')} {PICK('so', 'not')} {PICK('at', 'in')} a {R.choice(MADE)[:3]}"))
    assert describe(rows)[-1] < 0.5
    monkeypatch.setattr(quality, "_period", lambda x: False)
    assert describe(rows)[-1] >= 0.5
