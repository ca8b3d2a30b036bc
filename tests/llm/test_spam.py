import pytest

from siltstone.llm import spam

SPEECH = "The minister said that the bridge was not safe, and the members of this House have heard it from the engineers. What will he do about it? "
NAMES = [f"{a}{b}" for a in ("Tal", "Ver", "Osk", "Bren", "Fen", "Gor", "Hes", "Jur") for b in ("andrik", "olstrom", "ubben", "irvane", "eddane")]

SPAM = {
    "blob": "cheap boots best boots cheap boots free laces " * 30,
    "lines": "cheap boots\nbest laces\ncheap boots\nfree boots\n" * 20,
    "commas": "top cheap boots Talmoor, buy laces Vermoor, " * 25,
    "sentences": "Cheap boots? Boots Talmoor! Best boots in Vermoor. boots free boots. " * 12,
    "prices": "\n".join(f"{p} {m} {n}.99" for n, (p, m) in enumerate((p, m) for p in ("solar lamp", "roof tiles", "dog beds", "yoga mat") for m in ("sale", "top", "buy", "2026", "review"))),
    "links": "\n".join(f"{n} boots - https://www.x{n}.example/p/{i}" for i, n in enumerate(NAMES)),
    "nav": "".join(f'<li><a href="https://x{i}.example/">{n}</a></li>' for i, n in enumerate(NAMES)),
    "markdown": "\n".join(f"* [{n}](https://x{i}.example/)" for i, n in enumerate(NAMES)),
    "tags": " ".join(f"#{n}boots +{n}laces" for n in NAMES),
    "between sentences": SPEECH + "cheap boots best boots https://x.example/p/1 cheap laces " * 15 + SPEECH + "cheap boots best boots cheap laces " * 10,
}
HAM = {
    "speech": SPEECH * 10,
    "long speech with some spam": SPEECH * 10 + "cheap boots best boots " * 15,
    "cites addresses": (SPEECH + "See https://www.example.org/paper/17. ") * 6,
    "roll call": " ".join(f"{n}: {'Aye' if i % 3 else 'No'}." for i, n in enumerate(NAMES)),
    "division": "The House divided: Ayes 40, Noes 2.\n\nAYES\n" + "\n".join(f"{n}, {'Pell Talu Yorl Amaro'.split()[i % 4]} ({'HL RB CU'.split()[i % 3]})" for i, n in enumerate(NAMES)),
    "table": SPEECH + "\n".join(f"{n}moor\t{i * 37}\t{i * 91}\t{i}%" for i, n in enumerate(NAMES)),
    "orders": "Orders of the day\n"
    + "\n".join(
        f"{i}. {a.capitalize()} {b} {'merger fund audit'.split()[i % 3]} ({'Report Motion Committee'.split()[i % 3]}) – {n}"
        for i, (n, a, b) in enumerate(zip(NAMES, "fresh rural joint large small broad early late annual final".split() * 3, "bridge harbour tram rail forest canal school water peat grid quarry tariff seed flood".split() * 2))
    ),
    "rhetoric": "".join(f"This House has been told of {n}moor, where the carers wait for a bed. " for n in NAMES),
    "formula": "Order. Order. The honourable member will resume the seat. " * 5,
    "garbled": "x9=Qa+/" * 200,
    "none": None,
    "empty": "",
    "blank": " \n\t ",
    "one word": "Aye.",
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert spam.stuffing(SPAM[name])[0] > 0.5


@pytest.mark.parametrize("name", HAM)
def test_ham(name):
    assert spam.stuffing(HAM[name])[0] <= 0.5


def test_pages(spark):
    rows = [*enumerate([*SPAM.values(), *HAM.values()]), (0, SPAM["blob"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as stuffed_share")
    got = sorted(r.doc_id for r in spam.spam_pages(df).collect())
    assert got == [0, *range(len(SPAM))]
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_time_is_linear():
    import time

    def took(n):
        text = SPEECH * 1000 * n + SPAM["blob"] * 250 * n + SPAM["lines"] * 250 * n
        t = time.perf_counter()
        spam.stuffing(text)
        return time.perf_counter() - t

    assert took(2) < 4 * min(took(1), took(1)) + 0.5


def test_keyword_lists_of_many_shapes_are_all_counted():
    lines = []
    for n in (1, 2, 4, 7, 13):
        words = [("cheap", "watches", "outlet", "replica")[k % 4] for k in range(n)]
        for number in ("", " 24"):
            lines += [f"{separator} ".join(case(w) for w in words) + separator + number for separator in (",", ";", "|", "/") for case in (str.lower, str.title)]
    share, shapes = spam.stuffing("\n".join(lines))
    assert shapes > 16 and share > 0.9


def test_numbered_keywords_are_no_records():
    keywords = ("cheap watches outlet", "replica watches sale", "cheap replica outlet")
    assert spam.stuffing("\n".join(f"{k}. {keywords[k % 3]}" for k in range(1, 31)))[0] > 0.9
    assert spam.stuffing("1) " + ", ".join(keywords * 20))[0] > 0.9
    names = [f"{a}{b}" for a in ("Bal", "Kor", "Min", "Tes", "Vul", "Zan") for b in ("dorf", "heim", "stad", "vik", "wald")]
    paper = "\n".join(f"{k}. {n} Bridge {names[-k]}" for k, n in enumerate(names[:15], 1))
    assert spam.stuffing(paper)[0] == 0
    assert spam.stuffing(paper + "\n" + "cheap watches outlet, " * 5)[0] < 0.5
