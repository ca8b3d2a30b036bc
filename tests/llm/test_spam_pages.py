"""Made pages of every kind of record and of spam, in rounds and in languages that the given tables do not hold."""

import random
import re

import pytest

from siltstone.llm.spam import stuffing

SPEECHES = {
    "it": "Signor Presidente, il governo ha promesso tre volte che il ponte sarebbe stato riparato prima dell'inverno. Non lo hanno fatto. Ho visto le crepe, ho parlato con gli abitanti e nessuno ci ha dato una risposta. Chi paga? Pagano le famiglie, che ogni mattina devono fare venti chilometri in più per portare i figli a scuola. Chiedo al ministro di venire in aula e di dirci quando cominceranno i lavori.",
    "pl": "Panie Marszałku, rząd obiecał nam, że most zostanie naprawiony przed zimą. Nie zrobił tego. Byłem tam w zeszłym tygodniu i rozmawiałem z mieszkańcami, którzy nie mogą dojechać do pracy. Kto za to zapłaci? Zapłacą rodziny, które codziennie wożą dzieci do szkoły okrężną drogą. Proszę ministra o odpowiedź na piśmie.",
    "fi": "Arvoisa puhemies, hallitus lupasi meille, että silta korjataan ennen talvea. Niin ei tapahtunut. Kävin paikalla viime viikolla ja puhuin asukkaiden kanssa, jotka eivät pääse töihin. Kuka tämän maksaa? Sen maksavat perheet, jotka kuljettavat lapsensa kouluun kiertotietä. Pyydän ministeriltä kirjallista vastausta.",
    "tr": "Sayın Başkan, hükümet bize köprünün kıştan önce onarılacağına söz verdi. Bunu yapmadı. Geçen hafta oraya gittim ve işe gidemeyen vatandaşlarla konuştum. Bunu kim ödeyecek? Çocuklarını okula uzun yoldan götüren aileler ödeyecek. Bakandan yazılı bir cevap bekliyorum.",
    "sv": "Herr talman, regeringen lovade oss att bron skulle lagas före vintern. Det blev inte så. Jag var där förra veckan och talade med de boende, som inte kommer till jobbet. Vem betalar detta? Det gör familjerna, som varje dag kör barnen till skolan en lång omväg. Jag begär ett skriftligt svar av ministern.",
    "el": "Κύριε Πρόεδρε, η κυβέρνηση μας υποσχέθηκε ότι η γέφυρα θα επισκευαστεί πριν από τον χειμώνα. Δεν το έκανε. Πήγα εκεί την περασμένη εβδομάδα και μίλησα με τους κατοίκους, που δεν μπορούν να πάνε στη δουλειά τους. Ποιος θα πληρώσει; Θα πληρώσουν οι οικογένειες με τα παιδιά τους.",
}
SYLLABLES = [a + b for a in "b c d f g h k l m n p r s t v z br tr st".split() for b in "a e i o u ai or en il".split()]


class Pages:
    def __init__(self, seed):
        self.r = random.Random(seed)

    def word(self, least=1):
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(least, 3)))

    def names(self, n):
        return [self.word(2).capitalize() for _ in range(n)]

    def division(self, members, rounds, present=1.0):
        r, names = self.r, sorted(self.names(members))
        places = self.names(max(3, members // r.choice([1, 3, 8])))
        line = {n: f"{n}, {r.choice(places)} ({r.choice(['HL', 'RB', 'CU', 'Ind'])})" for n in names}
        out = []
        for _ in range(rounds):
            here = [n for n in names if r.random() < present]
            ayes = [n for n in here if r.random() < 0.6]
            noes = [n for n in here if n not in ayes]
            out.append("\n".join([f"The House divided: Ayes {len(ayes)}, Noes {len(noes)}.", "", "AYES", *map(line.get, ayes), "NOES", *map(line.get, noes)]))
        return r.choice(["\n", "\n\n", ""]).join(out)

    def roll(self, members, rounds):
        names = self.names(members)
        return self.r.choice([" ", "\n"]).join(" ".join(f"{n}: {self.r.choice(['Aye', 'No', 'Aye', 'Abstain'])}." for n in names) for _ in range(rounds))

    def table(self, rows, rounds):
        r = self.r
        one = "\n".join(["Area\tUnits\tSpent\tShare", *(f"{n}\t{r.randint(1, 999)}\t{r.randint(1, 9999)}\t{r.randint(0, 99)}%" for n in self.names(rows))])
        return "\n".join([one] * rounds)

    def orders(self, rows, rounds):
        r = self.r
        first, second = [self.word() for _ in range(25)], [self.word() for _ in range(20)]
        one = [f"{i}. {r.choice(first).capitalize()} {r.choice(second)} {r.choice(['bill', 'fund', 'audit'])} ({r.choice(['Report', 'Motion', 'Committee'])}) – {self.word(2).capitalize()}" for i in range(1, rows + 1)]
        return "\n".join(["Orders of the day", *one] * rounds)

    def spam(self, style, n=None):
        r = self.r
        products = [" ".join(self.word() for _ in range(r.choice([1, 2, 3]))) for _ in range(r.choice([1, 3, 8, 15, 25]))]
        extras = [self.word() for _ in range(r.choice([3, 6, 12]))]
        capital, price = r.random() < 0.3, r.random() < 0.5

        def entry():
            x = " ".join(r.sample([r.choice(products), r.choice(extras)], 2))
            x = r.choice([str.title, str.capitalize])(x) if capital else x
            return x + (f" {r.randint(1, 400)}.{r.randint(10, 99)}" if price and r.random() < 0.4 else "")

        es = [entry() for _ in range(n or r.choice([25, 45, 90, 200]))]
        return {
            "lines": "\n".join(es), "numbered": "\n".join(f"{k}. {e}" for k, e in enumerate(es, 1)), "bracketed": "\n".join(f"{k}) {e}" for k, e in enumerate(es, 1)),
            "commas": ", ".join(es), "bullets": " • ".join(es), "pipes": " | ".join(es), "blob": " ".join(es), "dashes": "\n".join(f"- {e}" for e in es),
            "sentences": " ".join(e.capitalize() + r.choice(".!?") for e in es),
        }[style]


STYLES = ("lines", "numbered", "bracketed", "commas", "bullets", "pipes", "blob", "dashes", "sentences")


@pytest.mark.parametrize("rounds", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", ["division", "roll", "table", "orders"])
def test_records_may_be_given_several_times(kind, rounds):
    for size in (15, 40, 150):
        p = Pages(size * rounds)
        assert stuffing(getattr(p, kind)(size, rounds))[0] <= 0.5, size
        speech = SPEECHES["it"] + "\n"
        assert stuffing(speech + getattr(p, kind)(size, rounds) + "\n" + speech)[0] <= 0.5, size


@pytest.mark.parametrize("language", SPEECHES)
def test_repetitive_speeches_in_any_language(language):
    text = SPEECHES[language]
    bare = re.sub(r"[^\w\s]", "", text).lower()
    wrapped = re.sub(r"(.{40}\S*) ", r"\1\n", f"{text} {text}")
    for page in (*(" ".join([text] * k) for k in (1, 2, 3, 5, 10)), bare, f"{bare} {bare}", text.upper(), " ".join([text.upper()] * 3), wrapped):
        assert stuffing(page)[0] <= 0.5, page


def test_formulas():
    names = Pages(1).names(40)
    assert stuffing("".join(f"Clause {k} agreed to. " for k in range(1, 41)))[0] <= 0.5
    assert stuffing("Order. Order. The question is put. Agreed. " * 5)[0] <= 0.5
    assert stuffing("".join(f"Questa Camera ha sentito parlare di {n}, dove le infermiere aspettano ancora un letto. " for n in names))[0] <= 0.5
    assert stuffing("".join(f"We remember {n}. " for n in names))[0] <= 0.5


@pytest.mark.parametrize("style", STYLES)
def test_keywords_in_every_layout(style):
    p = Pages(len(style))
    for _ in range(5):
        assert stuffing(p.spam(style, 45))[0] > 0.5


def test_recall_and_precision_on_held_back_pages():
    """Pages of seeds that no threshold was set on."""
    p = Pages(20261126)
    spam = [p.spam(style) for style in STYLES for _ in range(30)]
    records = [getattr(p, kind)(size, rounds) for kind in ("division", "roll", "table", "orders") for size in (12, 25, 60, 120) for rounds in (1, 2, 3, 4)]
    records += [p.division(size, rounds, 0.85) for size in (25, 60, 120) for rounds in (2, 3, 4)]
    found, wrong = sum(stuffing(t)[0] > 0.5 for t in spam), sum(stuffing(t)[0] > 0.5 for t in records)
    assert found >= 0.95 * len(spam) and wrong <= 0.03 * len(records), (found, len(spam), wrong, len(records))
