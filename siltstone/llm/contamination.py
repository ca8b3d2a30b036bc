"""Evaluation passages inside a training corpus, found through FM-indexes of corpus shards.

1. Corpus and items are reduced to words: case, accents, markup, bracketed interruptions, line
   breaks and repairable encodings do not count. Every word keeps its place in the original text. A text with a long
   bracket is read a second time with the brackets' content, so that a passage within or across brackets is found as well.
2. Every shard of documents becomes an FM-index over the shard's own vocabulary, written to the shared folder. The
   index knows nothing of the items: ``build_index`` runs once, any number of item sets may be searched in it.
3. Items are searched in blocks: backward search counts each three- and four-word phrase in all shards, and only phrases that occur
   are passed on. The counts tell phrases that speeches share from an item's own words. In every stretch of an
   item the rarer half of its four-word phrases are searched again and located.
   A formula at an item's start, told by its counts without and with the item's next words, is left out.
4. Where enough of an item's words are hit close together and in order, the two texts are aligned
   around the hits by their common three-word phrases. A passage is reported if it spans at least
   ``MIN_WORDS`` words of the item, most of them matched, and if the matched words hold most of the
   passage's weight, a word weighing the less the more often its commonest phrase occurs. All passages of a document and item are reported.

Weights are relative within an item, so a passage that a third of the corpus holds is found as
well as one that occurs once. No number of documents, hits or pairs is capped.

Defined results: null, empty and blank texts hold nothing. Items with fewer than ``MIN_WORDS``
words, and items without text, are found nowhere. Equal items are each reported. Rows
with the same id are one document, rows without an id none. Ids may be of any type. An empty corpus or item set gives no rows. Only ids and texts are
read, so other columns may clash with nothing. Places in documents are characters, from 0, the end excluded.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm.common import spread
from siltstone.llm.fmindex import FMIndex

MIN_WORDS = 20
#: Words per shard; bounds a worker's memory.
SHARD_WORDS = 1_000_000
#: Items are searched in blocks of at most so many words, which bounds what is sent to executors.
BLOCK_WORDS = 400_000
#: Words that two pieces of a document longer than a shard have in common.
OVERLAP = 512
#: Symbols of an index: 0 end, 1 document border, 2 any word that is not in it, then its words.
_BORDER, _OTHER, _FIRST = 1, 2, 3

#: Words of an item that located phrases must cover within a stretch for an alignment to be tried.
STRETCH, COVERED = 30, 6
#: Largest gaps between aligned runs, in words of the item and of the document.
ITEM_GAP, DOC_GAP = 6, 12
#: Times the counts of the median phrase and of the phrases that go on into the next words, from which an item's opening is a formula.
FORMULA = 8
#: Least share of matched words, and of matched weight in short and in long passages.
DENSITY, WEIGHT, WEIGHT_LONG, LONG = 0.7, 0.82, 0.68, 30
#: Single words that a passage may gain at either end beyond its outer runs, and words that may be left out before each.
EDGE_WORDS, EDGE_GAP = 3, 2
#: Words that a passage with at least so many single edits inside may be short of MIN_WORDS, as its outermost words may be edited, too.
SLACK = 1
#: Characters of a bracket from which a text is read with its brackets, too.
LONG_BRACKET = 60

#: Stands for what is left out within a word, so that places do not move.
_GAP = "\ue000"
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][\da-fA-F]{1,6}|[A-Za-z][\w]{1,31});")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BRACKET = re.compile(r"[()\[\]]")
_DASHED = re.compile(r"[–—]\s[^\W\d_]+(?:\s[^\W\d_]+){0,2}\s[–—]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐\u00ad]\s*\n\s*(?=[^\W\d_])")
_DIGITS = re.compile(r"(?<=\d)[.,'’ \u00a0\u202f](?=\d{3}(?!\d))")
_MARKS = re.compile("[\u0300-\u036f\u200b-\u200f\u2060\ufeff\u00ad\ufe0e\ufe0f]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(f"[^\\W_][^\\W_{_GAP}]*(?:{_GAP}+[^\\W_{_GAP}]+)*")
_BROKEN = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2122]{1,3}")


def _padded(found: str, m: re.Match) -> str:
    """``found`` in place of what was matched, at the same length."""
    return found[: len(m.group())].ljust(len(m.group()), _GAP)


def _repair(m: re.Match) -> str:
    """UTF-8 bytes that were read as a one-byte encoding."""
    for code in ("cp1252", "latin-1"):
        try:
            return _padded(m.group().encode(code).decode("utf-8"), m)
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return m.group()


def _untag(m: re.Match) -> str:
    """A tag is left out; a stretch between signs that is too long for a tag without attributes is text."""
    return m.group() if len(m.group()) > 40 and "=" not in m.group() else _blank(m)


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def _gap(m: re.Match) -> str:
    return _GAP * len(m.group())


def _brackets(text: str) -> list[tuple[int, int]]:
    """Outermost stretches between matching brackets, whatever their length."""
    out: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    for m in _BRACKET.finditer(text):
        c = m.group()
        if c in "([":
            opened.append((c, m.start()))
            continue
        at = next((j for j in range(len(opened) - 1, max(-1, len(opened) - 9), -1) if opened[j][0] == ("(" if c == ")" else "[")), None)
        if at is not None:
            start = opened[at][1]
            del opened[at:]
            while out and out[-1][0] > start:
                out.pop()
            out.append((start, m.end()))
    return out


_plain: dict[str, str] = {}


def _normal(word: str) -> str:
    """A word without case, accents and gaps; words repeat, so they are remembered in a table of bounded size."""
    got = _plain.get(word)
    if got is None:
        if len(_plain) > 500_000:
            _plain.clear()
        w = word.replace(_GAP, "").casefold()
        got = _plain[word] = w if w.isascii() else "".join(_WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", w)))).casefold() or w
    return got


def readings(text: str | None) -> list[tuple[list[str], list[int]]]:
    """Normalised words of a text and where each starts in it: first without bracketed interruptions, then, if there are long brackets, with them."""
    if not text or not text.strip():
        return []
    if "&" in text:
        text = _ENTITY.sub(lambda m: _padded(html.unescape(m.group()), m), text)
    if not text.isascii():
        if "Ã" in text or "Â" in text or "â" in text:
            text = _BROKEN.sub(_repair, text)
        text = _MARKS.sub(_GAP, text)
    if "<" in text:
        text = _TAG.sub(_untag, text)
    texts = [text]
    if "(" in text or "[" in text or "–" in text or "—" in text:
        cut, last, long = [], 0, False
        for a, b in _brackets(text):
            cut += [text[last:a], " " * (b - a)]
            last, long = b, long or b - a >= LONG_BRACKET
        bare = "".join([*cut, text[last:]])
        texts = [_DASHED.sub(_blank, bare), *[text] * long]
    out = []
    for t in texts:
        if "\n" in t:
            t = _HYPHEN.sub(_gap, t)
        t = _DIGITS.sub(_GAP, t)
        if t.isascii():
            t = t.lower()
            found = [(m.group(), m.start()) for m in _WORD.finditer(t)]
        else:
            found = [(_normal(m.group()), m.start()) for m in _WORD.finditer(t)]
        if found:
            ws, at = zip(*found)
            out.append((list(ws), list(at)))
    return out


def words(text: str | None) -> list[str]:
    """Normalised words of a text, interruptions and markup left out."""
    got = readings(text)
    return got[0][0] if got else []


def sentence_ends(text: str) -> list[int]:
    """Numbers of words up to the end of each sentence."""
    parts = [len(words(p)) for p in _SENTENCE.split(text)]
    return np.cumsum(parts).tolist()


def _word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in ws), dtype=np.uint64, count=len(ws))


class ItemSet:
    """A block of evaluation items as symbols."""

    def __init__(self, items: list[tuple[object, list[str], list[int]]]):
        """``items``: id, words, and the numbers of words up to each sentence end."""
        self.ids = [i for i, *_ in items]
        self.ends = [e for *_, e in items]
        vocabulary = sorted({w for _, ws, _ in items for w in ws})
        self.symbol = {w: k for k, w in enumerate(vocabulary, _FIRST)}
        self.symbols = _FIRST + len(self.symbol)
        self.hashes = _word_hashes(vocabulary)
        self.texts = [np.array([self.symbol[w] for w in ws], dtype=np.int64) for _, ws, _ in items]
        # four-word phrases of all items in a row: item number, place, words
        self.item = np.concatenate([np.full(max(0, len(t) - 3), k) for k, t in enumerate(self.texts)] or [np.zeros(0, int)]).astype(np.int64)
        self.place = np.concatenate([np.arange(max(0, len(t) - 3)) for t in self.texts] or [np.zeros(0, int)]).astype(np.int64)
        self.phrase = np.concatenate([np.stack([t[j : len(t) - 3 + j] for j in range(4)], 1) for t in self.texts if len(t) > 3] or [np.zeros((0, 4), int)]).astype(np.int64)

    def in_shard(self, vocabulary: np.ndarray) -> np.ndarray:
        """The shard's symbol of each symbol of the block."""
        at = np.searchsorted(vocabulary, self.hashes)
        held = at < len(vocabulary)
        held[held] = vocabulary[at[held]] == self.hashes[held]
        return np.r_[0, _BORDER, _OTHER, np.where(held, at + _FIRST, _OTHER)].astype(np.int64)

    def search(self, fm: FMIndex, symbols: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (low, high) of four-word phrases, and the count of each phrase's last three words."""
        p = symbols[self.phrase if which is None else self.phrase[which]]
        lo, hi = fm.start(p[:, 3])
        lo, hi = fm.step(p[:, 2], lo, hi)
        lo, hi = fm.step(p[:, 1], lo, hi)
        three = hi - lo
        lo, hi = fm.step(p[:, 0], lo, hi)
        return lo, hi, three


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[ItemSet]:
    """Items in blocks of bounded size. Their words are told in parallel and stream to the driver; each block is searched in the whole index."""
    src = items.select(items[id_col].alias("i"), items[text_col].alias("t")).where("i is not null and t is not null")
    id_type = to_arrow_type(src.schema["i"].dataType)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, ws, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(ws := words(t)) >= MIN_WORDS]
            cols = [pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([sentence_ends(r[2]) for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "words", "ends"])

    told = src.mapInArrow(tell, f"i {src.schema['i'].dataType.simpleString()}, words array<string>, ends array<int>")
    block: list[tuple[object, list[str], list[int]]] = []
    n = 0
    for r in told.toLocalIterator():
        if block and n + len(r.words) > BLOCK_WORDS:
            yield ItemSet(block)
            block, n = [], 0
        block.append((r.i, r.words, r.ends))
        n += len(r.words)
    if block:
        yield ItemSet(block)


_SHARD = "vocabulary binary, starts binary, text binary, chars binary, fm binary"


def build_index(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Write one row per shard: document ids, vocabulary, starts of documents, symbols, places in the text, FM-index. No shuffle.

    A document longer than a shard becomes several pieces that overlap. ``path`` is a folder all executors share.
    """
    shard_words = max(shard_words, 2 * OVERLAP)
    src = documents.select(documents[id_col].alias("i"), documents[text_col].alias("t")).where("i is not null and t is not null")
    id_type = src.schema["i"].dataType
    arrow_id = to_arrow_type(id_type)
    schema = f"docs array<{id_type.simpleString()}>, {_SHARD}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[object] = []
        parts: list[np.ndarray] = []
        places: list[np.ndarray] = []
        number: dict[str, int] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            hashes, place = np.unique(_word_hashes(list(number)), return_inverse=True)
            symbol = place.astype(np.uint32) + np.uint32(_FIRST)
            starts = np.r_[0, np.cumsum([len(p) + 1 for p in parts])].astype(np.int64)
            text = np.full(int(starts[-1]), _BORDER, dtype=np.uint32)
            for at, p in zip(starts.tolist(), parts):
                text[at : at + len(p)] = symbol[p]
            # places as steps, which compress well
            chars = np.diff(np.concatenate(places), prepend=0).astype(np.int32)
            fm = FMIndex.build(text, _FIRST + len(hashes))
            small = text.astype(np.uint16) if _FIRST + len(hashes) <= 65_536 else text
            cols = [pa.array([ids], pa.list_(arrow_id))]
            cols += [pa.array([x], pa.binary()) for x in (hashes.tobytes(), starts.tobytes(), small.tobytes(), chars.tobytes(), fm.dump())]
            return pa.RecordBatch.from_arrays(cols, names=["docs", "vocabulary", "starts", "text", "chars", "fm"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for ws, starts in readings(t):
                    at_char = np.array([*starts, len(t)], dtype=np.int64)
                    for at in range(0, max(1, len(ws) - OVERLAP), shard_words - OVERLAP):
                        piece = ws[at : at + shard_words]
                        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in piece), dtype=np.int64, count=len(piece)))
                        places.append(at_char[at : at + len(piece) + 1])
                        ids.append(i)
                        n += len(piece) + 1
                        if n >= shard_words:
                            yield flush()
                            ids, parts, places, number, n = [], [], [], {}, 0
        if ids:
            yield flush()

    spread(src).mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(schema).parquet(path)


def phrase_counts(shards: DataFrame, sent, phrases: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of the block's three- and four-word phrases. Only phrases that occur leave a task; at most one row per phrase reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemSet = sent.value
        total = np.zeros((2, phrases), dtype=np.int64)
        for b in batches:
            for vocabulary, fm in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lo, hi, three = items.search(FMIndex.load(fm), items.in_shard(np.frombuffer(vocabulary, np.uint64)))
                total[0] += three
                total[1] += hi - lo
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["phrase", "three", "four"])

    summed = shards.select("vocabulary", "fm").mapInArrow(run, "phrase long, three long, four long").groupBy("phrase").agg(F.sum("three").alias("three"), F.sum("four").alias("four"))
    three, four = np.zeros(phrases, np.int64), np.zeros(phrases, np.int64)
    for r in summed.toLocalIterator():
        three[r.phrase], four[r.phrase] = r.three, r.four
    return three, four


def _common(item: np.ndarray, text: np.ndarray, p: int, p_end: int, q: int, q_end: int) -> list[int]:
    """Places of item words, within one small gap of both texts, that the gaps have in common in this order."""
    if p >= p_end or q >= q_end:
        return []
    a, b = item[p:p_end].tolist(), text[q:q_end].tolist()
    best: list[list[list[int]]] = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = [p + i, *best[i + 1][j + 1]] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1], key=len)
    return best[0][0]


class Searcher:
    """What is searched for once corpus counts are known: rare phrases and word weights."""

    def __init__(self, items: ItemSet, three: np.ndarray, four: np.ndarray):
        self.items = items
        self.rare = np.zeros(len(four), dtype=bool)
        self.weights: list[np.ndarray] = []
        self.skip: list[int] = []
        self.three_at: list[dict[int, list[int]]] = []
        for k, t in enumerate(items.texts):
            at = np.flatnonzero(items.item == k)
            f = four[at]
            skip = self._formula(f, items.ends[k])
            self.skip.append(skip)
            for j in range(len(at)):
                near = f[max(0, j - 10) : j + 11]
                self.rare[at[j]] = j >= skip and f[j] <= np.median(near)
            # the count of the three words from place p + 1 is that of phrase p; the first three words' own count is not
            # asked for, so it takes its neighbour's
            c3 = np.empty(max(1, len(t) - 2), dtype=np.int64)
            c3[0] = three[at[0]] if len(at) else 0
            c3[1:] = three[at]
            top = np.zeros(len(t), dtype=np.int64)
            for j in range(len(c3)):
                top[j : j + 3] = np.maximum(top[j : j + 3], c3[j])
            self.weights.append((1.0 + top) ** -0.5)
            where: dict[int, list[int]] = defaultdict(list)
            for j, key in enumerate(self._threes(t).tolist()):
                if j >= skip:
                    where[key].append(j)
            self.three_at.append(dict(where))

    @staticmethod
    def _formula(four: np.ndarray, ends: list[int]) -> int:
        """Words of the whole sentences at an item's start that are a formula.

        All phrases of a formula are far more frequent than the item's usual ones, and than the formula with the item's next
        words: where an opening is copied, these are copied too. An opening of a passage's length is never taken for one.
        """
        usual = max(1.0, float(np.median(four))) if len(four) else 0
        whole = [e for e in ends if 4 <= e <= len(four) and e < MIN_WORDS and four[: e - 3].min() >= FORMULA * max(usual, four[e - 3 : e].min())]
        return max(whole, default=0)

    @staticmethod
    def _threes(t: np.ndarray) -> np.ndarray:
        t = t.astype(np.int64)
        return (t[:-2] << 42) | (t[1:-1] << 21) | t[2:]

    def candidates(self, fm: FMIndex, symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document number, item number, first and last hit) where located phrases cover enough of an item."""
        which = np.flatnonzero(self.rare)
        lo, hi, _ = self.items.search(fm, symbols, which)
        n = hi - lo
        total = int(n.sum())
        if not total:
            return
        offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        pos = fm.locate(np.repeat(lo, n) + offset)
        item, place = self.items.item[np.repeat(which, n)], self.items.place[np.repeat(which, n)]
        doc = np.searchsorted(starts, pos, side="right") - 1
        order = np.lexsort((place, pos, item, doc))
        doc, item, place, pos = doc[order], item[order], place[order], pos[order]
        pair = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]
        group = np.cumsum(pair) - 1
        # words of the document that hits cover anew, summed over a stretch of the document
        fresh = np.r_[4, np.clip(np.diff(pos), 0, 4)]
        fresh[pair] = 4
        upto = np.cumsum(fresh)
        line = group * np.int64(1 << 40) + pos
        since = np.searchsorted(line, line - STRETCH, side="left")
        near = upto - np.r_[0, upto][since]
        good = near >= COVERED
        first = np.flatnonzero(pair)
        last = np.r_[first[1:], len(pos)]
        for g in np.unique(group[good]).tolist():
            a, b = first[g], last[g]
            yield int(doc[a]), int(item[a]), int(pos[a]), int(pos[b - 1])

    def _edge(self, k: int, text: np.ndarray, p: int, q: int, step: int) -> list[tuple[int, int]]:
        """(item, document) places matched singly beyond the end of a run, going by ``step`` from (p, q)."""
        item, least = self.items.texts[k], self.skip[k]
        got: list[tuple[int, int]] = []
        while len(got) < EDGE_WORDS:
            for dp in range(EDGE_GAP + 1):
                at = p + step * dp
                if not least <= at < len(item):
                    continue
                dq = next((d for d in range(EDGE_GAP + 1) if 0 <= q + step * d < len(text) and text[q + step * d] == item[at]), None)
                if dq is not None:
                    break
            else:
                return got
            got.append((at, q + step * dq))
            p, q = at + step, q + step * (dq + 1)
        return got

    def align(self, k: int, text: np.ndarray) -> tuple[int, int, int, int] | None:
        """Longest reported passage of item k in a stretch of document symbols: (item from, to, document from, to), or None."""
        return max(self.passages(k, text), key=lambda s: s[1] - s[0], default=None)

    def passages(self, k: int, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Reported passages of item k in a stretch of document symbols, in order: (item from, to, document from, to).

        Left out are passages that lie in the document within others and span no more of the item than one before them.
        """
        if len(text) < 3:
            return []
        where = self.three_at[k]
        hits = [(p, q) for q, key in enumerate(self._threes(text).tolist()) if key in where for p in where[key]]
        if not hits:
            return []
        known = set(hits)
        runs = []
        for p, q in sorted(hits):
            if (p - 1, q - 1) in known:
                continue
            n = 3
            while (p + n - 2, q + n - 2) in known:
                n += 1
            runs.append((p, q, n))
        # in the order of the document, so that a run looks back over its neighbourhood only
        runs.sort(key=lambda r: (r[1], r[0]))
        longest = max(n for *_, n in runs)
        best: list[tuple[float, int]] = []
        for x, (p, q, n) in enumerate(runs):
            top = (float(n), -1)
            for y in range(x - 1, -1, -1):
                p0, q0, n0 = runs[y]
                if q - q0 > longest + DOC_GAP:
                    break
                over = max(0, p0 + n0 - p, q0 + n0 - q)
                if p0 < p and q0 < q and over < n and p - p0 - n0 <= ITEM_GAP and q - q0 - n0 <= DOC_GAP:
                    v = best[y][0] + n - over - 0.3 * max(0, p - p0 - n0) - 0.1 * max(0, q - q0 - n0)
                    if v > top[0]:
                        top = (v, y)
            best.append(top)
        w = self.weights[k]
        item = self.items.texts[k]
        upto = np.r_[0.0, np.cumsum(w)]
        found: set[tuple[int, int, int, int]] = set()
        ends = {y for _, y in best}
        for x in range(len(runs)):
            if x in ends:
                continue  # a longer chain goes on from here
            path, y = [], x
            while y >= 0:
                path.append(runs[y])
                y = best[y][1]
            path.reverse()
            reach = EDGE_WORDS * (EDGE_GAP + 1)
            if path[-1][0] + path[-1][2] - path[0][0] + 2 * reach < MIN_WORDS - SLACK:
                continue
            # single words that the gaps before the runs have in common, and whether words were added there
            filled = [([], False)]
            for (p0, q0, n0), (p, q, _) in zip(path, path[1:]):
                filled.append((_common(item, text, p0 + n0, p, q0 + n0, q), q - q0 - n0 > max(0, p - p0 - n0)))
            for a in range(len(path)):
                p0, q0, _ = path[a]
                before = self._edge(k, text, p0 - 1, q0 - 1, -1)
                matched, weight, upper, added = 0, 0.0, p0, 0
                for z in range(a, len(path)):
                    p, q, n = path[z]
                    if z > a:
                        places, more = filled[z]
                        matched += len(places)
                        weight += sum(w[at] for at in places)
                        added += more
                    low = max(p, upper)
                    if p + n > low:
                        matched += p + n - low
                        weight += upto[p + n] - upto[low]
                        upper = p + n
                    if upper - p0 + 2 * reach < MIN_WORDS - SLACK:
                        continue
                    after = self._edge(k, text, upper, q + n, 1)
                    # a chance match may end either edge, so that a passage may hold any number of an edge's words
                    for x0 in range(len(before), -1, -1):
                        lower, first_q = before[x0 - 1] if x0 else (p0, q0)
                        for x1 in range(len(after), -1, -1):
                            high, last_q = (after[x1 - 1][0] + 1, after[x1 - 1][1] + 1) if x1 else (upper, q + n)
                            span, hits_ = high - lower, matched + x0 + x1
                            # where single words were changed within a passage, its outermost words may have been, too
                            if span < MIN_WORDS - min(SLACK, upper - p0 - matched + added) or hits_ < DENSITY * span:
                                continue
                            held = weight + sum(w[at] for at, _ in before[:x0]) + sum(w[at] for at, _ in after[:x1])
                            if held >= (WEIGHT if span < LONG else WEIGHT_LONG) * (upto[high] - upto[lower]):
                                found.add((lower, high, first_q, last_q))
                                break  # fewer words of this edge span less
        kept, reach, longest = [], -1, 0
        for s in sorted(found, key=lambda s: (s[2], -s[3], s[0] - s[1], s[0])):
            if s[3] > reach or s[1] - s[0] > longest:
                kept.append(s)
                reach, longest = max(reach, s[3]), max(longest, s[1] - s[0])
        return kept


def search_index(shards: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_from, item_to, doc_from, doc_to): every passage of an item in a document of an index.

    Item places are words, document places characters of the original text. Pieces and readings of a document, and repeated rows,
    may each show a passage or a part of it, so that rows may repeat and overlap.
    """
    spark = shards.sparkSession
    id_type, item_type = shards.schema["docs"].dataType.elementType, items.schema[item_col].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, item_from int, item_to int, doc_from int, doc_to int"
    kinds = [to_arrow_type(id_type), to_arrow_type(item_type), *[pa.int32()] * 4]
    out = spark.createDataFrame([], schema)
    for number, block in enumerate(_item_blocks(items, item_col, text_col)):
        searcher = Searcher(block, *phrase_counts(shards, spark.sparkContext.broadcast(block), len(block.item)))
        sent = spark.sparkContext.broadcast(searcher)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            s: Searcher = sent.value
            for b in batches:
                for docs, vocabulary, starts, text, chars, fm in zip(*(b.column(k) for k in range(6))):
                    rows = _search_shard(s, docs, vocabulary.as_py(), starts.as_py(), text.as_py(), chars.as_py(), fm.as_py())
                    cols = list(zip(*rows)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "item_from", "item_to", "doc_from", "doc_to"])

        found = shards.select("docs", "vocabulary", "starts", "text", "chars", "fm").mapInArrow(run, schema)
        out = out.unionByName(found) if number else found
    return out


def _search_shard(s: Searcher, docs: pa.ListScalar, vocabulary: bytes, starts: bytes, text: bytes, chars: bytes, fm: bytes) -> list[tuple]:
    ids, begin = docs.values, np.frombuffer(starts, np.int64)
    held = np.frombuffer(vocabulary, np.uint64)
    symbols = s.items.in_shard(held)
    in_block = np.full(_FIRST + len(held), _OTHER, dtype=np.int64)
    in_block[symbols[_FIRST:]] = np.arange(_FIRST, len(symbols))
    in_block[:_FIRST] = 0, _BORDER, _OTHER
    words_ = np.frombuffer(text, np.uint16 if len(held) + _FIRST <= 65_536 else np.uint32)
    places = None
    rows = []
    for d, k, first, last in s.candidates(FMIndex.load(fm), symbols, begin):
        reach = len(s.items.texts[k]) + 4 * DOC_GAP
        low, high = max(int(begin[d]), first - reach), min(int(begin[d + 1]) - 1, last + reach)
        for item_from, item_to, doc_from, doc_to in s.passages(k, in_block[words_[low:high]]):
            if places is None:
                places = np.cumsum(np.frombuffer(chars, np.int32), dtype=np.int64)
            rows.append((ids[d].as_py(), s.items.ids[k], item_from, item_to, int(places[low + doc_from]), int(places[low + doc_to])))
    return rows


def leaked_passages(
    documents: DataFrame, items: DataFrame, path: str, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """All passages of items in documents, through an index written to ``path``; see ``search_index``."""
    return search_index(build_index(documents, path, id_col, text_col, shard_words), items, item_col, text_col)


def leaks(
    documents: DataFrame, items: DataFrame, path: str, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(doc_id, item_id, item_from, item_to, doc_from, doc_to): the longest passage per document and item, the first one in the document among equals."""
    longest = F.max(F.struct((F.col("item_to") - F.col("item_from")).alias("n"), (-F.col("doc_from")).alias("first"), "item_from", "item_to", "doc_from", "doc_to"))
    out = leaked_passages(documents, items, path, id_col, item_col, text_col, shard_words)
    return out.groupBy("doc_id", "item_id").agg(longest.alias("p")).select("doc_id", "item_id", "p.item_from", "p.item_to", "p.doc_from", "p.doc_to")


def removal_spans(found: DataFrame) -> DataFrame:
    """Merged stretches to cut from each document: doc_id, doc_from, doc_to, in characters; overlapping passages become one."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("doc_from", "doc_to")
    before = F.max("doc_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = found.withColumn("opens", F.when(before.isNull() | (F.col("doc_from") > before), 1).otherwise(0))
    part = opens.withColumn("part", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("doc_id", "part").agg(F.min("doc_from").alias("doc_from"), F.max("doc_to").alias("doc_to")).drop("part")
