"""Evaluation texts leaking into training text."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import map_texts

#: A case runs along so many words of a test item, with at most one edit in so many.
STRETCH, PER_EDIT = 20, 8
#: Words of a shingle and shingles of a window. A stretch of 20 words with 2 edits keeps an unbroken run of 6 words, longer ones too;
#: a run of 6 words is one whole window of 3 shingles of 4 words, so both sides hold the same minimum.
SHINGLE, WINDOW = 4, 3
#: Item sizes in words at which a new partition of the index begins. In items below 24 words a case is a stretch of 20 words with two edits.
PARTITIONS = (20, 24, 48, 96, 192)
#: Bytes of the index of one pass, measured as it is built; what does not fit is searched in further passes.
INDEX_BYTES = 128_000_000
#: Words that are searched at once, whatever the number and length of the texts of a batch.
CHUNK_WORDS = 2_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

_ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrt])")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_QUOTED = re.compile(r"(?:=[0-9A-F]{2})+")
_SOFT_BREAK = re.compile(r"=\r?\n")
#: A name of HTML with whatever follows, or any name with attributes that have values; a sign "less than" before a word is no tag.
_HTML = "a abbr address article aside b bdi bdo big blockquote body br button caption center cite code col dd del details div dl dt em fieldset figure font footer form h[1-6] head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small span strike strong style sub sup svg table tbody td textarea tfoot th thead title tr tt u ul var video wbr"
_TAG = re.compile(rf"""<!--.*?-->|</?({_HTML.replace(" ", "|")})(?![\w:.-])[^<>]*>|</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'|[^\s"'<>=]+))*\s*/?>""", re.S | re.I)
_INLINE = {"b", "i", "em", "strong", "u", "s", "span", "a", "font", "small", "big", "sub", "sup", "mark", "code", "tt", "wbr", "ins", "del", "abbr", "q", "cite", "kbd", "bdi", "bdo"}
_BROKEN_WORD = re.compile(r"(?<=[^\W\d_])[-­‐‑][ \t]*(?:\r\n|\n|\r)[ \t>#*|/-]*(?=[^\W\d_])")
_MOJIBAKE = re.compile(r"[Â-ôƒ][\u0080-¿Œ-Ÿˆ˜–-›€™ŠšŽž]+")
_WORD = re.compile(r"[^\W_]+")
#: Letters that decomposition leaves whole.
_FOLD = str.maketrans({"æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i", "ſ": "s"})


class _Visible(dict):
    """A translation that drops marks, invisible and unassigned characters; each character is looked up once."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)) in ("Mn", "Cf", "Me", "Co", "Cn") else code
        return self[code]


_visible = _Visible()


def _repair(match: re.Match) -> str:
    """UTF-8 that was read as a single-byte code page, read right; anything else as it stands."""
    raw = match.group(0)
    for page in ("cp1252", "latin-1"):
        try:
            return raw.encode(page).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return raw


def _bytes_of(match: re.Match, sign: str) -> str:
    raw = bytes.fromhex(match.group(0).replace(sign, ""))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return match.group(0)


def normal_words(text: str | None) -> list[str]:
    """The words of a text without letter case, accents, punctuation, markup, escapes, spacing, line breaks, invisible characters."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPES.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)) if m.group(1) or m.group(2) else " ", text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: _bytes_of(m, "%"), text)
    if "=" in text:
        text = _QUOTED.sub(lambda m: _bytes_of(m, "="), _SOFT_BREAK.sub("", text))
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(lambda m: "" if (m.group(1) or "").lower() in _INLINE else " ", text)
    if not text.isascii():
        for _ in range(2):
            if not _MOJIBAKE.search(text):
                break
            text = _MOJIBAKE.sub(_repair, text)
        text = unicodedata.normalize("NFKD", text)
    if "\n" in text or "\r" in text:
        text = _BROKEN_WORD.sub("", text)
    if not text.isascii():
        text = text.translate(_visible)
    text = text.casefold().translate(_FOLD) if not text.isascii() else text.lower()
    return _WORD.findall(text)


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of every run of SHINGLE word ids; the largest value, never a minimum, where a run holds an unknown word (id 0)."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    known = np.ones(n, dtype=bool)
    for j in range(SHINGLE):
        part = ids[j : j + n].astype(np.uint64)
        known &= part > 0
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return np.where(known, h >> np.uint64(1), _NONE)


def window_minima(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, MinHash) of every window of WINDOW consecutive shingles without an unknown word."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    parts = [h[j : j + n] for j in range(WINDOW)]
    at = np.flatnonzero(np.maximum.reduce(parts) != _NONE)
    return at, np.minimum.reduce([part[at] for part in parts])


def least_kept(words: int, run: int) -> int:
    """Runs of ``run`` words that every case in an item of so many words leaves unbroken, at least.

    A stretch of L words with e edits keeps L - e of them in e + 1 runs, each of which loses run - 1 places.
    """
    return max(1, min(length - e - (run - 1) * (e + 1) for length in range(STRETCH, words + 1) for e in [length // PER_EDIT])) if words >= STRETCH else 0


class _Lookup:
    """Sorted keys with the values that each of them has, as flat arrays."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.start = np.append(first, len(keys)).astype(np.int64)
        self.values = [v[order] for v in values]

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.start.nbytes + sum(v.nbytes for v in self.values)

    def meet(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the wanted keys, which row of the values) of every meeting."""
        none = np.empty(0, dtype=np.int64)
        if not len(self.keys) or not len(wanted):
            return none, none
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == wanted)
        first, count = self.start[at[hit]], self.start[at[hit] + 1] - self.start[at[hit]]
        rows = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else first, count) + np.arange(count.sum())
        return np.repeat(hit, count), rows


class ItemIndex:
    """Test items in partitions by their size, each with the MinHash signatures of its items' windows and their shingles.

    Flat arrays: about 40 bytes a word, and the distinct words once. ``nbytes`` is measured.
    """

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int32) for _, words in items]
        self.least_windows = np.array([least_kept(len(w), SHINGLE + WINDOW - 1) for w in self.words], dtype=np.int64)
        self.least_shingles = np.array([least_kept(len(w), SHINGLE) for w in self.words], dtype=np.int64)
        self.partitions: list[tuple[_Lookup, _Lookup]] = []
        for low, high in zip(PARTITIONS, (*PARTITIONS[1:], 1 << 62)):
            mine = [k for k, w in enumerate(self.words) if low <= len(w) < high]
            if mine:
                hashes = [shingle_hashes(self.words[k]) for k in mine]
                minima = [np.unique(window_minima(h)[1]) for h in hashes]
                owner = lambda parts: np.repeat(np.array(mine, dtype=np.int32), [len(p) for p in parts])
                place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes])
                self.partitions.append((_Lookup(np.concatenate(minima), owner(minima)), _Lookup(np.concatenate(hashes), owner(hashes), place)))

    @classmethod
    def of_texts(cls, items: list[tuple[int, str | None]]) -> ItemIndex:
        return cls([(i, words) for i, t in items if len(words := normal_words(t)) >= STRETCH])

    @property
    def nbytes(self) -> int:
        words = sum(120 + len(w) for w in self.vocabulary)
        return words + sum(w.nbytes + 120 for w in self.words) + sum(part.nbytes for pair in self.partitions for part in pair)

    def search(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(number of the text, item id) of every leak in texts given as normal words."""
        get, gap = self.vocabulary.get, [0] * (SHINGLE + WINDOW)
        flat: list[int] = []
        starts = []
        for words in texts:
            starts.append(len(flat))
            flat += [get(w, 0) for w in words]
            flat += gap
        ids, first = np.array(flat, dtype=np.int32), np.array(starts, dtype=np.int64)
        h = shingle_hashes(ids)
        places, minima = window_minima(h)
        known = np.flatnonzero(h != _NONE)
        out = []
        for signatures, shingles in self.partitions:
            which, rows = signatures.meet(minima)
            # Containment by signatures: windows of the text that the item holds, against the least of any case in an item of its size.
            pair, met = np.unique((np.searchsorted(first, places[which], side="right") - 1) * len(self.ids) + signatures.values[0][rows], return_counts=True)
            pair = pair[met >= self.least_windows[pair % len(self.ids)]]
            if not len(pair):
                continue
            # Exact containment: shingles of the item, each place of it once, that the text holds.
            held = np.zeros(len(texts), dtype=bool)
            held[pair // len(self.ids)] = True
            text_of = np.searchsorted(first, known, side="right") - 1
            mine = held[text_of]
            p, text_of = known[mine], text_of[mine]
            which, rows = shingles.meet(h[p])
            key = text_of[which] * len(self.ids) + shingles.values[0][rows]
            at = np.searchsorted(pair, key)
            at[at == len(pair)] = 0
            wanted = pair[at] == key
            which, rows, at = which[wanted], rows[wanted], at[wanted]
            q = shingles.values[1][rows].astype(np.int64)
            distinct = np.unique(at << np.int64(32) | q) >> np.int64(32)
            enough = np.bincount(distinct, minlength=len(pair)) >= self.least_shingles[pair % len(self.ids)]
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(pair) + 1))
            for k in np.flatnonzero(enough).tolist():
                mine = order[ends[k] : ends[k + 1]]
                text, item = divmod(int(pair[k]), len(self.ids))
                a = starts[text]
                if self._verified(ids[a : a + len(texts[text])], self.words[item], np.unique(p[which[mine]] - a - q[mine]), p[which[mine]] - a - q[mine], q[mine]):
                    out.append((text, self.ids[item]))
        return sorted(set(out), key=lambda x: (x[0], str(x[1])))

    def leaks(self, text: str | None) -> list[int]:
        """Ids of the items of which the text holds a stretch."""
        return [i for _, i in self.search([normal_words(text)])]

    @staticmethod
    def _verified(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, d: np.ndarray, q: np.ndarray) -> bool:
        """Whether the regions around the shared shingles hold a stretch, by exact alignment.

        Every stretch has 20 consecutive words with at most 4 edits (2 of 20, 3 of 24, 4 of 32; from 40 on some window has 3 or fewer).
        So at least 16 of them stand within 4 diagonals of any shingle hit among them. Shingles in a row on one diagonal make a
        stretch without edits, which needs no alignment.
        """
        run = np.unique(d * np.int64(len(item) + 1) + q)
        whole = STRETCH - SHINGLE
        if len(run) > whole and (run[whole:] - run[:-whole] == whole).any():
            return True
        slack, drift = len(item) // PER_EDIT + 2, 4
        sides = len(item) + drift
        # One table of all diagonals in reach: whether word q of the item stands on diagonal d, as sums along q.
        padded = np.concatenate([np.full(sides, -1, dtype=doc.dtype), doc, np.full(sides, -1, dtype=doc.dtype)])
        spans = []
        for at in diagonals.tolist():
            low = max(0, sides + at - drift)
            near = np.lib.stride_tricks.as_strided(padded[low:], (min(len(item), len(padded) - low - 2 * drift), 2 * drift + 1), (padded.strides[0],) * 2)
            met = np.concatenate([[0], np.cumsum((near == item[: len(near), None]).any(axis=1))])
            if len(met) > STRETCH and (met[STRETCH:] - met[:-STRETCH]).max() >= STRETCH - drift:
                spans.append((max(0, at - slack), min(len(doc), at + len(item) + slack)))
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1] and b - merged[-1][0] <= 4 * len(item):
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return any(has_stretch(item, doc[a:b]) for a, b in merged)


def has_stretch(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether some alignment covers at least STRETCH consecutive item words with at most one edit per PER_EDIT of them.

    Exact: by item word, for every number of edits e and document position j, the longest run of item words that ends there. The
    table of a row is held by (e, j - e), where an inserted word is a step along e alone.
    """
    m, n, most = len(item), len(doc), len(item) // PER_EDIT
    width = n + most + 1
    run = np.zeros((most + 1, width), dtype=np.int32)
    best = np.zeros(most + 1, dtype=np.int32)
    padded = np.full(n + 2 * most + 1, -1, dtype=np.int64)
    padded[most + 1 : most + 1 + n] = doc
    # word[e, t] is the document word before position j = t - most + e
    word = np.lib.stride_tricks.as_strided(padded, (most + 1, width), (padded.strides[0], padded.strides[0]))
    for i in range(m):
        new = np.zeros_like(run)
        # A stretch begins and ends with a word that stands in both.
        met = np.where(word[:, 1:] == item[i], run[:, :-1] + 1, 0)
        np.maximum(best, met.max(axis=1), out=best)
        new[:, 1:] = met
        if most:
            longer = np.where(run > 0, run + 1, 0)
            np.maximum(new[1:], longer[:-1], out=new[1:])
            np.maximum(new[1:, :-1], longer[:-1, 1:], out=new[1:, :-1])
            np.maximum.accumulate(new, axis=0, out=new)
        run = new
    return bool((best >= np.maximum(STRETCH, PER_EDIT * np.arange(most + 1))).any())


def item_indexes(items: Iterable[tuple[int, str | None]], most_bytes: int = INDEX_BYTES) -> list[ItemIndex]:
    """The items as few indexes as keep to ``most_bytes`` each by a bound of their size: 64 bytes a word and 140 a new word, 200 an item."""
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    size, seen = 0, set()
    for i, text in items:
        words = normal_words(text)
        if len(words) < STRETCH:
            continue
        more = 200 + 64 * len(words) + sum(140 + len(w) for w in set(words) - seen)
        if blocks[-1] and size + more > most_bytes:
            blocks.append([])
            size, seen = 0, set()
            more = 200 + 64 * len(words) + sum(140 + len(w) for w in set(words))
        blocks[-1].append((i, words))
        seen.update(words)
        size += more
    return [ItemIndex(b) for b in blocks if b]


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", index_bytes: int = INDEX_BYTES, blocks_a_pass: int = 4) -> DataFrame:
    """Every pair of a document and a test item of which it holds a stretch: ``doc_id``, ``item_id``, one row each.

    MinHash containment search. The test items, the stated query set, are partitioned by size; a partition holds the signatures of
    its items: one MinHash per window of 6 words (3 shingles of 4), the size at which containment of a short passage in a long
    document equals similarity. A document is a candidate for an item if at least so many of its own windows have a minimum of the
    item as the worst case of an item of that size keeps. Candidates are verified by exact shingle containment, then by alignment.

    The index is made of flat arrays of at most ``index_bytes`` and is sent to every task; documents stream past it without a shuffle,
    a whole batch at once. Up to ``blocks_a_pass`` indexes share one pass (and the memory of a task), so each text is normalised once;
    more items than that are searched in further passes.

    Defined cases: null or empty texts leak nothing; items of fewer than 20 words cannot be cases; repeated documents or items give
    one row per pair of ids; null ids are kept as null; whole texts are read.
    """
    spark = documents.sparkSession
    item_kind = items.schema[item_id].dataType.simpleString()
    indexes = item_indexes(map(tuple, items.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")).toLocalIterator()), index_bytes)

    def search(part: list[ItemIndex]):
        sent = [spark.sparkContext.broadcast(index) for index in part]

        def over(keys: list, texts: list) -> Iterator[dict[str, list]]:
            found = [one.value for one in sent]
            for ids, words in _in_chunks(keys, texts):
                out = [(ids[k], i) for index in found for k, i in index.search(words)]
                yield {"doc_id": [d for d, _ in out], "item_id": [i for _, i in out]}

        return map_texts(documents, doc_id, text, "doc_id", over, {"item_id": item_kind})

    passes = [search(indexes[k : k + blocks_a_pass]) for k in range(0, max(1, len(indexes)), blocks_a_pass)]
    return reduce(DataFrame.unionByName, passes).distinct()


def _in_chunks(keys: list, texts: list) -> Iterator[tuple[list, list[list[str]]]]:
    ids, words, size = [], [], 0
    for d, t in zip(keys, texts):
        one = normal_words(t)
        if len(one) < STRETCH:
            continue
        ids.append(d)
        words.append(one)
        size += len(one)
        if size > CHUNK_WORDS:
            yield ids, words
            ids, words, size = [], [], 0
    if ids:
        yield ids, words
