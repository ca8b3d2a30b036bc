"""Keyword-stuffed and link-list pages, found by the shapes of their lines.

A page is cut into units at sentence ends and at line breaks, unless the next line goes on in lower case. Each unit is reduced to a shape: its
number of words (a class), how they are capitalised, which separators it has, whether it holds links, and whether it is a
sentence. No words are looked up, so the language does not matter. A sentence begins with a capital, ends with an end mark, has at
least ``SENTENCE`` words, few of them twice, and few separators; stuffing may stand before it in the same unit. A unit with links
or product tags that is no sentence is a link. What is left are lists, and lists are cut into entries.

Links are stuffing. Lists are stuffing if their words keep coming back within a stretch of ``STRETCH`` words, however long the page
is: most characters are of words that come back, and enough entries hold no word of their own. A short sentence of words of its own, or a passage of running text, that is
repeated whole up to ``FEW`` times counts once. An entry of a vote, a roll call, an order
paper or a table names something of its own. Such records may be given several times on a page: if the entries start over in
rounds, each time with what they held before, every round is judged on its own. Units are grouped by shape, and a page is flagged if its
stuffed shapes, however many, make up more than half of its text.

Defined results: null, empty and blank texts, and texts without any unit, are not flagged. Repeated
rows are judged each. Exactly half is not flagged. Very long texts are read whole, in linear time. Lists of fewer than ``EVIDENCE``
words on the whole page are never stuffing. Words that run on without blanks are garbled and no list.
No rows give no rows. Only the id and text columns are read, so other columns may clash with nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import spread

#: Least words of a sentence, of one without a capital at its start, and of one without an end mark.
SENTENCE, UNCAPITALISED, UNENDED = 7, 9, 12
#: A sentence's least share of different words (up to and beyond LONG words), greatest share of capitals, and of separators to words.
DIFFERENT, DIFFERENT_LONG, LONG, CAPITALS, SEPARATORS = 0.7, 0.6, 30, 0.5, 0.3
#: How much smaller a share of different words may be for a sentence to begin earlier behind stuffing.
CLEAR = 0.1
#: Least share of words of up to three letters in a sentence that begins in lower case.
SHORT_WORDS = 0.15
#: Words of a list that are judged together, and words that all lists of a page must have to be stuffing.
STRETCH, EVIDENCE = 150, 24
#: Least share of characters of words that come back, in entries and in words that run on, and of entries whose words all come back.
RETURNING, RETURNING_RUN, WHOLLY = 0.48, 0.62, 0.12
#: Words from which a unit's separators divide it into entries.
ENTRY = 8
#: Rounds of records: tolerated share of names that come back within a round, least length of a round against the number of names,
#: and least likeness of an entry to the one of the same name before. There are at most as many rounds as names, or FEW.
STRAY, ROUND, ALIKE, FEW = 0.1, 0.75, 0.5, 6
#: Share of names that come back from which on a round has begun; words in a row that make a repetition of running text.
RULE, PASSAGE = 0.7, 8

_TOKEN = re.compile(
    r"(?P<link>(?:https?://|www\.)[^\s)\"<>\]]+)|(?P<word>[^\W\d_]+(?:[-'’][^\W\d_]+)*)|(?P<tag><[^<>\n]*>|(?<!\w)[#@+][^\W\d_][\w-]*)|(?P<number>\d+(?:[.,]\d+)*%?)"
    r"|(?P<line>\n)|(?P<end>[.!?…]+(?=\s|$|[\"”»)]))|(?P<separator>[,;:|\t()\[\]*#/•·])"
)
_CUT = re.compile(r"\n|[.!?…]+(?=\s|$|[\"”»)])")
_MARKED = re.compile(r"[<#@+]|://|www\.")
_WORDS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: What may stand around a unit's first and last word or number.
_OUTSIDE = " \t\r\n.!?…,;:|()[]*/•·\"'“”„«»‘’–—-_¿¡=&\u00a0"
_COUNTED = re.compile(r"[,;:|\t\[\]*/•·\n]")
#: Leads the words of an entry that is written like a short sentence.
_FORMULA = "."
_DIVIDERS = ",;|\t/•·<"
_CLASSES = (0, 1, 3, 6, 12, 40)


class _Unit:
    """Tokens up to a unit's end: words, where each starts, separators and links with the number of words before them."""

    __slots__ = ("words", "at", "seps", "links", "numbers", "start", "end", "ended")

    def __init__(self) -> None:
        self.words, self.at, self.seps, self.links, self.numbers = [], [], [], [], []
        self.start = self.end = -1
        self.ended = False

    def reach(self, m: re.Match) -> None:
        if self.start < 0:
            self.start = m.start()
        self.end = m.end()


def _units(text: str) -> Iterator[_Unit]:
    unit, n = _Unit(), len(text)
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            unit.words.append(m.group())
            unit.at.append(m.start())
            unit.reach(m)
        elif kind == "separator":
            if unit.start >= 0:
                unit.seps.append((len(unit.words), m.group()))
        elif kind == "number":
            unit.numbers.append((len(unit.words), m.group()))
            unit.reach(m)
        elif kind == "link" or kind == "tag":
            if kind == "tag" and m.group()[0] == "<" and "://" not in m.group() and "href" not in m.group():
                unit.seps.append((len(unit.words), "<"))  # markup divides and counts for nothing
            else:
                unit.links.append(len(unit.words))
                unit.reach(m)
        elif unit.start >= 0:
            if kind == "line":
                after = m.end()
                while after < n and text[after] in " \t":
                    after += 1
                if after < n and text[after].islower():
                    unit.seps.append((len(unit.words), "\n"))
                    continue
            else:
                unit.ended = True
            yield unit
            unit = _Unit()
    if unit.start >= 0:
        yield unit


def _upper(word: str) -> bool:
    """Not written in lower case; scripts without cases count as capitals."""
    return not word[0].islower()


def _sentence_from(u: _Unit) -> int | None:
    """Number of the word at which a sentence begins that goes on to the unit's end, if there is one."""
    n = len(u.words)
    if n < SENTENCE or (not u.ended and n < UNENDED):
        return None
    # of the words from each place on: different ones, capitals, separators
    lower = [w.lower() for w in u.words]
    seen: set[str] = set()
    loud = all(w.isupper() for w in u.words)  # then capitals tell nothing but the start
    capitals = 0
    seps = [0] * (n + 1)
    for i, c in u.seps:
        if c not in "()":
            seps[min(i, n)] += 1
    behind = seps[n]
    begins: list[tuple[int, float]] = []
    for i in range(n - 1, -1, -1):
        seen.add(lower[i])
        up = i == 0 if loud else _upper(u.words[i])
        capitals += up
        k = n - i
        if k >= (SENTENCE if u.ended else UNENDED) and (up or (i == 0 and k >= UNCAPITALISED and sum(len(w) <= 3 for w in lower) >= SHORT_WORDS * k)):
            different = DIFFERENT if k <= LONG else DIFFERENT_LONG
            # behind stuffing only what ends like a sentence is one
            if len(seen) >= different * k and capitals <= max(1, CAPITALS * k) and behind <= SEPARATORS * k and (u.ended or i == 0):
                begins.append((i, len(seen) / k))
        behind += seps[i]
    if not begins or begins[-1][0] == 0:
        return 0 if begins else None
    clear = max(share for _, share in begins) - CLEAR
    return min(i for i, share in begins if share >= clear)


def _class(n: int) -> int:
    """Class of a word count."""
    return sum(n >= w for w in _CLASSES) - 1


def _case(words: list[str]) -> str:
    up = [_upper(w) for w in words]
    return "none" if not any(up) else "all" if all(up) else "first" if up[0] and not any(up[1:]) else "some"


def _entries(u: _Unit, upto: int, end: int) -> list[tuple[list[str], int]]:
    """(words, characters) of the entries that the first ``upto`` words of a list unit make.

    Lines are entries. A line of more than ENTRY words is divided by its commonest divider; what is still longer is one entry a word.
    A number between words of an entry names something, as a word does; one before or after them counts or prices.
    """
    lines, last = [], 0
    for i in [i for i, c in u.seps if c == "\n" and i < upto] + [upto]:
        if i > last:
            lines.append((last, i))
            last = i
    cuts: list[int] = []
    for lo, hi in lines:
        pieces = [lo]
        if hi - lo > ENTRY:
            inside = [(i, c) for i, c in u.seps if lo < i < hi and c in _DIVIDERS] if len(lines) == 1 else []
            if inside:
                top = Counter(c for _, c in inside).most_common(1)[0][0]
                pieces += sorted({i for i, c in inside if c == top})
        for a, b in zip(pieces, [*pieces[1:], hi]):
            cuts += range(a, b) if b - a > ENTRY else [a]
    names: dict[int, list[str]] = {}
    for i, number in u.numbers:
        names.setdefault(i, []).append(number)
    out = []
    for a, b in zip(cuts, [*cuts[1:], upto]):
        ws = [u.words[a].lower()]
        for i in range(a + 1, b):
            ws += names.get(i, [])
            ws.append(u.words[i].lower())
        out.append((ws, (u.at[b] if b < upto else end) - u.at[a]))
    if out:
        out[0] = (out[0][0], out[0][1] + u.at[0] - u.start)
    return out


def _plain_sentence(part: str) -> int | None:
    """Length of a part without links that is a sentence from its first word to its end mark, or None if a closer look is needed."""
    ws = _WORDS.findall(part)
    n = len(ws)
    if n < SENTENCE or ws[0][0].islower():
        return None
    if n - sum(map(str.islower, [w[0] for w in ws])) > CAPITALS * n or len(set(map(str.lower, ws))) < (DIFFERENT if n <= LONG else DIFFERENT_LONG) * n:
        return None
    return None if len(_COUNTED.findall(part)) > SEPARATORS * n else len(part.strip(_OUTSIDE))


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text without links and markup that make a unit each, and whether an end mark ends them."""
    last, n = 0, len(text)
    for m in _CUT.finditer(text):
        if m.group() == "\n":
            after = m.end()
            while after < n and text[after] in " \t":
                after += 1
            if after < n and text[after].islower():
                continue
            yield text[last : m.start()], False
        else:
            yield text[last : m.end()], True
        last = m.end()
    yield text[last:], False


def _looked_at(text: str) -> Iterator[_Unit | int]:
    """Units of a text, or only the length where one is plainly a sentence."""
    if _MARKED.search(text):
        yield from _units(text)
        return
    for part, ended in _parts(text):
        n = _plain_sentence(part) if ended else None
        if n is None:
            yield from _units(part)
        else:
            yield n


def shapes(text: str) -> list[tuple[tuple, int, list[tuple[list[str], int]]]]:
    """(shape, characters, entries) of each unit of a text, in order. A shape's first part is its kind: sentence, link or list."""
    out = []
    for u in _looked_at(text):
        if isinstance(u, int):
            out.append((("sentence",), u, []))
            continue
        at = _sentence_from(u)
        if at is not None:
            cut = u.start if at == 0 else u.at[at]
            out.append((("sentence",), u.end - cut, []))
        else:
            at, cut = len(u.words), u.end
        if cut <= u.start:
            continue
        marks = "".join(sorted({c for i, c in u.seps if i < at}))
        shape = (_class(at), _case(u.words[:at]) if at else "none", marks, any(i < at for i, _ in u.numbers))
        if any(i < at or at == len(u.words) for i in u.links):
            out.append((("link", *shape), cut - u.start, []))
        elif at:
            es = _entries(u, at, cut)
            if u.ended and at == len(u.words) and not marks and _upper(u.words[0]) and 2 * sum(map(_upper, u.words[1:])) <= at:
                es = [([_FORMULA, *ws], k) for ws, k in es]
            out.append((("list", *shape), cut - u.start, es))
        else:
            out.append((("list", *shape), cut - u.start, []))  # numbers alone
    return out


def _rounds(entries: list[list[str]]) -> list[int] | None:
    """Where records start over: the first entry of each round, or None if the entries are not records given in rounds."""
    count = Counter(w for ws in entries for w in ws)
    starts: list[int] = [0]
    named: set[str] = set()
    names: list[str] = []
    strays: list[int] = []
    before: dict[str, set[str]] = {}
    alike, compared = 0.0, 0
    for i, ws in enumerate(entries):
        name = min(ws, key=lambda w: (count[w], -len(w)))
        now = set(ws)
        if name in before:
            both = sum(map(len, now & before[name]))
            alike += both / max(1, sum(map(len, now | before[name])))
            compared += 1
        before[name] = now
        names.append(name)
        if name in named:
            strays.append(i)
            if len(strays) > STRAY * (i - starts[-1] + 1):
                # the round began where such names began to be the rule
                at = next(s for j, s in enumerate(strays) if len(strays) - j >= RULE * (i - s + 1))
                starts.append(at)
                named, strays = set(names[at:]), []
        named.add(name)
    rounds = len(starts)
    if rounds < 2 or rounds > max(FEW, len(before)):
        return None
    return starts if len(entries) >= ROUND * rounds * len(before) and alike >= ALIKE * compared else None


def _stretches(entries: list[list[str]]) -> list[int]:
    """First entries of the stretches in which words are counted, and the end."""
    starts = _rounds(entries)
    if starts is None:
        starts, n = [0], 0
        for i, ws in enumerate(entries):
            if n >= STRETCH:
                starts.append(i)
                n = 0
            n += len(ws)
        if len(starts) > 1 and n < STRETCH / 2:
            starts.pop()
    return [*starts, len(entries)]


def _copies(entries: list[list[str]]) -> dict[int, int]:
    """Entries of one word that repeat running text: entry -> the one it repeats, where PASSAGE words in a row occur up to FEW times."""
    at: dict[int, list[int]] = {}
    run = 0
    for i, ws in enumerate(entries):
        run = run + 1 if len(ws) == 1 and ws[0] != _FORMULA else 0
        if run >= PASSAGE:
            words = [e[0] for e in entries[i - PASSAGE + 1 : i + 1]]
            if len(set(words)) >= PASSAGE - 1:
                at.setdefault(hash(tuple(words)), []).append(i)
    return {i - j: places[0] - j for places in at.values() if 1 < len(places) <= FEW for i in places[1:] for j in range(PASSAGE)}


def _stuffed_entries(entries: list[list[str]]) -> list[bool]:
    whole = Counter(tuple(ws) for ws in entries if ws[0] == _FORMULA)
    spread_over = Counter(w for ws in set(map(tuple, entries)) for w in set(ws))  # different entries with a word
    first: dict[tuple, int] = {}
    judged: list[list[str]] = []
    place = []  # of each entry among the judged ones
    copies = _copies(entries)
    for i, ws in enumerate(entries):
        if i in copies:
            place.append(place[copies[i]])
            continue
        if ws[0] == _FORMULA:
            at = first.get(key := tuple(ws))
            # a formula's words are its own; keywords come back in other entries, too
            if at is not None and whole[key] <= FEW and 2 * sum(len(w) for w in ws[1:] if spread_over[w] > 1) < sum(map(len, ws[1:])):
                place.append(at)
                continue
            first[key] = len(judged)
            ws = ws[1:]
        place.append(len(judged))
        judged.append(ws)
    if sum(map(len, judged)) < EVIDENCE:
        return [False] * len(entries)
    out: list[bool] = []
    cuts = _stretches(judged)
    for lo, hi in zip(cuts, cuts[1:]):
        part = judged[lo:hi]
        count = Counter(w for ws in part for w in ws)
        length = sum(len(w) * n for w, n in count.items())
        returning = sum(len(w) * n for w, n in count.items() if n > 1)
        wholly = sum(len(w) for ws in part if all(count[w] > 1 for w in ws) for w in ws)
        least = RETURNING if 2 * sum(len(ws) > 1 for ws in part) >= len(part) else RETURNING_RUN
        out += [returning >= least * length and wholly >= WHOLLY * length] * len(part)
    return [out[at] for at in place]


def stuffing(text: str | None) -> tuple[float, int]:
    """Share of a text's characters in its stuffed shapes, and the number of such shapes."""
    if not text or not text.strip():
        return 0.0, 0
    units = shapes(text)
    total = sum(n for _, n, _ in units)
    if not total:
        return 0.0, 0
    by_shape: Counter[tuple] = Counter()
    entries = [ws for _, _, es in units for ws, _ in es]
    words = sum(map(len, entries))
    # words that run on without blanks are garbled, not a list
    stuffed = iter(_stuffed_entries(entries) if len(text.split()) * 4 >= words else [False] * len(entries))
    for shape, n, es in units:
        if shape[0] == "link":
            by_shape[shape] += n
        for (_, k), bad in zip(es, stuffed):
            if bad:
                by_shape[shape] += k
    return sum(by_shape.values()) / total, len(by_shape)


def score_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stuffed_share, stuffed_shapes) of every page. Narrow: no shuffle."""
    src = documents.select(documents[id_col].alias(id_col), documents[text_col].alias(text_col))
    id_type = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [stuffing(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32())], names=[id_col, "stuffed_share", "stuffed_shapes"]
            )

    return spread(src).mapInArrow(run, f"`{id_col}` {id_type}, stuffed_share double, stuffed_shapes int")


def spam_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5) -> DataFrame:
    """Ids of pages of which more than ``share`` is stuffing."""
    return score_pages(documents, id_col, text_col).where(F.col("stuffed_share") > share).select(id_col)
