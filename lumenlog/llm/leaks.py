"""Evaluation texts leaking into training text (problem 9).

All test items form one generalised suffix automaton over normalised words.
Each document is streamed through it once, tracking the longest suffix that
occurs in some item; the maximal matches are chained per item to stretches
that bear a changed word or an interposed speaker mark, and an item counts as
leaked if one stretch, or two a few sentences apart, holds enough of it. Spans
beyond the limits of length or coverage can be taken out of the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: The items are the stated query set; more words than this are refused, as they are read on the driver.
MAX_ITEM_WORDS = 5_000_000
#: Words of items in one automaton (some 450 bytes a word); more items are matched set by set.
SET_WORDS = 500_000
_NOISE = re.compile(r"<[^<>]{0,200}>|^\s*(?:\[[^\]\n]{0,20}\]\s*)?\w{1,20}(?:\s+wrote)?:\s|[​-‍⁠﻿­]", re.M)
_WORD = re.compile(r"\w+(?:[-'’]\w+)*")


def words(text: str) -> list[str]:
    """Lower-case words without marks of layout: tags, speakers, invisible signs."""
    return _WORD.findall(_NOISE.sub(lambda m: " " if m.group()[0] not in "​‌‍⁠﻿­" else "", text).lower().replace("’", "'"))


class Automaton:
    """Generalised suffix automaton of word sequences with occurrence lists."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.sizes: list[int] = []
        self.top: list[int] = [0]

    def _state(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[str]) -> None:
        item, last = len(self.sizes), 0
        self.sizes.append(len(sequence))
        for k, w in enumerate(sequence):
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p != -1 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
                last = new
            self.ends[last].append((item, k + 1))

    def close(self, shortest: int) -> None:
        """Carry the occurrences up to every state that stands for long enough matches.

        top of a state is its last suffix state of those: it holds every
        occurrence of the last ``shortest`` words.
        """
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            up = self.link[s]
            if up > 0 and self.length[up] >= shortest:
                self.ends[up] = list({*self.ends[up], *self.ends[s]})
        self.top = list(range(len(self.next)))
        for s in reversed(order):
            if self.length[self.link[s]] >= shortest:
                self.top[s] = self.top[self.link[s]]

    def matches(self, sequence: list[str], shortest: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(end, length, occurrences) of the longest common runs of at least ``shortest`` words with each place of each item.

        A run ends where its own occurrence does not go on with the next word,
        whether or not others do.
        """
        s, n = 0, 0
        edges, ends, top = self.next, self.ends, self.top
        for k, w in enumerate(sequence):
            if n >= shortest:
                t = top[s]
                after = edges[t].get(w)
                if after is None or len(ends[after]) != len(ends[t]):
                    yield from self._ended(k, s, n, after)
            to = edges[s].get(w)
            while to is None and s > 0:
                s = self.link[s]
                n = self.length[s]
                to = edges[s].get(w)
            s, n = (0, 0) if to is None else (to, n + 1)
        if n >= shortest:
            yield from self._ended(len(sequence), s, n, None)

    def _ended(self, k: int, s: int, n: int, after: int | None) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Runs that end before word k: the state's occurrences, then those of each shorter suffix."""
        last = self.top[s]
        done = {(item, at - 1) for item, at in self.ends[after]} if after is not None else set()
        while True:
            found = [x for x in self.ends[s] if x not in done]
            if found:
                yield k, n, found
            if s == last:
                return
            done.update(found)
            s = self.link[s]
            n = self.length[s]


def stretches(parts: list[tuple[int, int, int]], slip: int, insert: int) -> list[tuple[int, int, int, int]]:
    """Chain (doc start, item start, length) parts to (doc start, doc end, item start, item end).

    Neighbours join if both sides go forward, the item skips at most ``slip``
    words and the document at most ``insert``; the words skipped on both sides
    count as changed words. Each part joins the open stretch that reaches
    furthest in the item.
    """
    done: list[list[int]] = []
    for d, i, n in sorted(parts):
        best = None
        for t in reversed(done):
            gap_d, gap_i = d - t[1], i - t[3]
            if gap_d > insert + n:
                break
            over = max(0, -gap_d, -gap_i)
            if over < n and -3 <= min(gap_d, gap_i) and gap_i <= slip and gap_d <= insert and (best is None or t[3] > best[3]):
                best = t
        if best is None:
            done.append([d, d + n, i, i + n])
        else:
            best[1], best[3] = max(best[1], d + n), max(best[3], i + n)
    return [tuple(t) for t in done]


def covered(parts: list[tuple[int, int, int]], *, slip: int = 2, insert: int = 6, apart: int = 150) -> int:
    """Most words of the item held in order by one stretch or two not far apart."""
    s = stretches(parts, slip, insert)
    best = max((t[3] - t[2] for t in s), default=0)
    s.sort()
    for x, a in enumerate(s):
        for b in s[x + 1 :]:
            if b[0] - a[1] > apart:
                break
            if b[0] >= a[1] - 1 and b[2] >= a[3] - 1:
                best = max(best, a[3] - a[2] + b[3] - max(b[2], a[3]))
    return best


class Suite:
    """A set of items: the automaton of those of ``shortest`` words or more, and the shorter ones, which are only found whole."""

    def __init__(self, shortest: int) -> None:
        self.shortest, self.words = shortest, 0
        self.automaton, self.ids = Automaton(), []
        self.short: dict[tuple[str, ...], list] = defaultdict(list)

    def add(self, item: object, w: list[str]) -> None:
        self.words += len(w)
        if len(w) < self.shortest:
            self.short[tuple(w)].append(item)
        else:
            self.automaton.add(w)
            self.ids.append(item)

    def found(self, w: list[str], share: float) -> Iterator[tuple[object, int, int, list[tuple[int, int, int]]]]:
        """(item, covered, words of the item, matched parts) of each item that the words hold enough of."""
        parts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, n, places in self.automaton.matches(w, self.shortest):
            for item, at in places:
                parts[item].append((end - n, at - n, n))
        for item, p in parts.items():
            size = self.automaton.sizes[item]
            if sum(x[2] for x in p) * 2 >= size * share:
                got = covered(p)
                if got >= size * share:
                    yield self.ids[item], got, size, p
        places: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for n in {len(k) for k in self.short}:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                if key in self.short:
                    places[key].append(k)
        for key, at in places.items():
            for item in self.short[key]:
                yield item, len(key), len(key), [(k, 0, len(key)) for k in at]


def suites(items: DataFrame, item_id: str, text: str, shortest: int) -> list[Suite]:
    """The items in sets of at most SET_WORDS words (or one longer item)."""
    made: list[Suite] = []
    total = 0
    for r in items.filter(F.col(text).isNotNull()).select(item_id, text).orderBy(item_id).collect():
        w = words(r[1])
        if w:
            total += len(w)
            if total > MAX_ITEM_WORDS:
                raise ValueError(f"the test items hold more than {MAX_ITEM_WORDS} words; run them in several sets")
            if not made or made[-1].words + len(w) > SET_WORDS:
                made.append(Suite(shortest))
            made[-1].add(r[0], w)
    for s in made:
        s.automaton.close(shortest)
    return made or [Suite(shortest)]


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", shortest: int = 4, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered, item_words) for documents that hold at least ``share`` of an item.

    covered counts the item's words from the first to the last of each
    stretch. Items of fewer than ``shortest`` words are found whole only. NULL
    and blank texts hold and are nothing; of repeated items each is reported;
    whole texts are read whatever their length. The items must not exceed
    MAX_ITEM_WORDS words in all.
    """
    d, i = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    result = None
    for suite in suites(items, item_id, text, shortest):
        shared = documents.sparkSession.sparkContext.broadcast(suite)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [(doc, item, got, size) for doc, t in zip(pdf["d"], pdf["t"], strict=True) if t is not None for item, got, size, _ in shared.value.found(words(t), share)]
                yield pd.DataFrame(out, columns=["doc", "item", "covered", "item_words"])

        found = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInPandas(run, f"doc {d}, item {i}, covered int, item_words int")
        result = found if result is None else result.unionByName(found)
    return result.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "covered", "item_words")


def located_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """``words`` with the place of each in the text."""
    kept: list[str] = []
    origin: list[int] = []
    last = 0
    for m in _NOISE.finditer(text):
        kept.append(text[last : m.start()])
        origin.extend(range(last, m.start()))
        if m.group()[0] not in "​‌‍⁠﻿­":
            kept.append(" ")
            origin.append(m.start())
        last = m.end()
    kept.append(text[last:])
    origin.extend(range(last, len(text)))
    plain = "".join(c if len(c.lower()) != 1 else c.lower() for c in "".join(kept)).replace("’", "'")
    found = [(m.group(), origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer(plain)]
    return [x[0] for x in found], [x[1:] for x in found]


def without_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", shortest: int = 4, share: float = 0.5, longest: int = 8) -> DataFrame:
    """(doc_id, clean_text, removed): every document, with the leaked spans taken out.

    A document that holds at least ``share`` of an item loses every stretch of
    that item that has ``longest`` words or more, or that alone holds the
    share. removed counts the words taken out. A space stays where a span was;
    NULL texts stay NULL.
    """
    d = documents.schema[doc_id].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(suites(items, item_id, text, shortest))

    def clean(t: str | None) -> tuple[str | None, int]:
        if t is None:
            return None, 0
        w, places = located_words(t)
        gone: set[int] = set()
        for suite in shared.value:
            for _, _, size, parts in suite.found(w, share):
                for a, b, i, j in stretches(parts, 2, 6):
                    if b - a >= longest or j - i >= size * share:
                        gone.update(range(max(a, 0), min(b, len(w))))
        out, at = [], 0
        for k in sorted(gone):
            if k - 1 not in gone:
                out.append(t[at : places[k][0]])
            at = places[k][1]
        return "".join([*out, t[at:]]), len(gone)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(doc, *clean(t)) for doc, t in zip(pdf["d"], pdf["t"], strict=True)], columns=["doc_id", "clean_text", "removed"])

    return documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {d}, clean_text string, removed int")
