"""Abusive, hateful or sexual content (problem 10).

A linear classifier over the words of a sentence, learned from rated documents
alone. Only documents are rated, so the best scoring sentence of a document
rated offensive stands for it (multiple instances): the first choice follows
how much more often its words come in such documents, later ones the
classifier. Every training sentence that names people is paired with
counterfactuals in which other people, or nobody in particular, are named, and
the squared difference of the two scores is part of the loss, so that naming a
group moves nothing. Words that the first fit found telling are then looked for
in disguise (look-alike letters, digits for letters, invisible signs,
stretched, spaced, starred or swapped letters), and the classifier is fitted
again on the words so read.

Texts are read in arrays: one pattern splits a whole batch, distinct words are
looked at once, and the features are sums over arrays of hashes.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lumenlog.session import free

#: Bounds of the sample of rated documents that the classifier is fitted on: documents, and characters in all.
MAX_RATED = 20_000
MAX_CHARACTERS = 10_000_000
#: Score from which a document counts as flagged.
THRESHOLD = 0.5
#: Score before the logistic of a sentence of unknown words, kept fixed: what nobody rated is not flagged.
UNKNOWN = -2.0
#: Words of a window and of a step: sentences longer than a window are scored whole and in windows.
WINDOW, STEP = 12, 4
#: Characters read at once.
CHUNK = 2_000_000

# General words for people, swapped for each other in counterfactuals, and words for nobody in particular.
PEOPLE = (
    "people women men woman man girls boys christians muslims jews hindus buddhists atheists africans asians europeans americans germans "
    "french spaniards mexicans poles turks arabs chinese indians russians immigrants refugees foreigners gays lesbians "
    "frauen männer ausländer juden muslime femmes hommes étrangers juifs musulmans mujeres hombres extranjeros judíos musulmanes"
).split()
NEUTRAL = ("engineers", "colleagues", "customers")
# Letters of other scripts and signs that look like Latin letters.
LOOKALIKE = dict(zip("аеорсухіјѕԁһкмтвнΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνικ", "aeopcyxijsdhkmtbhABEZHIKMNOPTYXaopvik", strict=True))
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "l"})
_LOOK = re.compile(f"[{''.join(LOOKALIKE)}]")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_SPEAKER = re.compile(r"^[^\S\n]*(?:\[[^\]\n]{0,20}\][^\S\n]*)?[\w.-]{1,24}(?:[^\S\n]+wrote)?:[^\S\n]+", re.M)
_TAG = re.compile(r"<[^<>]{0,200}>")
_SPELT = re.compile(r"(?<!\w)(?:\w[ .*_-]){3,}\w(?!\w)")
_NUMBER = re.compile(r"(?<![\w*$@])\d(?:[\d.,:/-]*\d)?(?![\w*$@])")
#: Words, ends of sentences, and the mark between two texts.
_PIECE = re.compile(r"[^\W_][\w*$@!'’|.-]*[\w*]|\w|(?<=[.!?])\s+|\n+|\x02")
_STRETCH = re.compile(r"(.)\1{2,}")
#: Odd factors that tell the places of a word in a feature apart.
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


class Reader:
    """Reads words to their plain form; ``hidden`` are the words a disguise may hide, ``common`` words that are none."""

    def __init__(self, hidden: frozenset[str] = frozenset(), common: frozenset[str] = frozenset()) -> None:
        self.hidden, self.common = hidden, common
        self.by_letters: dict[str, list[str]] = defaultdict(list)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(hidden):
            self.by_letters["".join(sorted(w))].append(w)
            self.by_length[len(w)].append(w)
        self.seen: dict[str, tuple[str, int, int]] = {}

    def piece(self, raw: str) -> tuple[str, int, int]:
        """(word, code, kind): kind 0 for a word, 1 capitalised, 2 in capitals, 3 an end of a sentence, 4 of a text."""
        got = self.seen.get(raw)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            if raw == "\x02" or raw.isspace():
                got = "", 0, 4 if raw == "\x02" else 3
            else:
                w = self.word(raw.lower())
                got = w, code(w), 1 if raw.istitle() else 2 if raw.isupper() else 0
            self.seen[raw] = got
        return got

    def word(self, raw: str) -> str:
        w = raw.strip(".!|'’-").replace("’", "'")
        if w in self.hidden or w in self.common:
            return w
        if "-" in w and not re.search(r"[*$@]", w) and max(map(len, w.split("-"))) > 2:
            return "#name"
        if self.hidden:
            found = self._disguised(w)
            if found:
                return found
        if re.search(r"\d", w):
            return "#number"
        return _STRETCH.sub(r"\1", w)

    def _disguised(self, w: str) -> str | None:
        for reading in self._readings(w):
            if reading in self.hidden:
                return reading
        if "*" in w and re.search(r"[^\W\d_]", w):
            pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in w))
            for x in self.by_length[len(w)]:
                if pattern.fullmatch(x):
                    return x
        if len(w) > 3:
            for x in self.by_letters.get("".join(sorted(w)), ()):
                k = next((k for k in range(len(w)) if w[k] != x[k]), None)
                if k is not None and k + 1 < len(w) and w[k] == x[k + 1] and w[k + 1] == x[k] and w[k + 2 :] == x[k + 2 :]:
                    return x
        return None

    def _readings(self, w: str) -> Iterator[str]:
        leet = w.translate(LEET)
        for x in dict.fromkeys((w, leet, w.replace("1", "l").translate(LEET))):
            bare = re.sub(r"[.*_-]", "", x)
            for y in dict.fromkeys((x, bare)):
                yield y
                yield _STRETCH.sub(r"\1", y)
                yield _STRETCH.sub(r"\1\1", y)
                if y[:1] in "ai":  # an article spelt out with the word
                    yield y[1:]

    def read(self, texts: Sequence[str | None]) -> Iterator[Sentences]:
        """The sentences of the texts, in chunks of whole texts; ``first`` is the number of a chunk's first text."""
        chunk: list[str] = []
        size = first = 0
        for k, t in enumerate(texts):
            t = t or ""
            if chunk and size + len(t) > CHUNK:
                yield self._chunk(chunk, first)
                chunk, size, first = [], 0, k
            chunk.append(t.replace("\x02", " ") if "\x02" in t else t)
            size += len(t)
        if chunk:
            yield self._chunk(chunk, first)

    def _chunk(self, texts: list[str], first: int) -> Sentences:
        t = "\n\x02\n".join(texts)
        if not t.isascii():
            t = _INVISIBLE.sub("", t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))
            t = _LOOK.sub(lambda m: LOOKALIKE[m.group()], t)
        t = _SPEAKER.sub("", _TAG.sub("\n", t))
        t = _NUMBER.sub("0", _SPELT.sub(lambda m: re.sub(r"[ .*_-]", "", m.group()), t))
        pieces = _PIECE.findall(t)
        which, distinct = pd.factorize(np.array(pieces, dtype=object))
        looked = [self.piece(p) for p in distinct]
        kinds = np.array([x[2] for x in looked], dtype=np.int8)[which] if looked else np.zeros(0, np.int8)
        hashes = np.array([x[1] for x in looked], dtype=np.uint64)
        word = kinds < 3
        sentence = np.cumsum(~word)[word]
        text = np.cumsum(kinds == 4)[word] + first
        which = which[word]
        starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(which) else np.zeros(0, np.int64)
        return Sentences(hashes[which], kinds[word], starts, text[starts] if len(which) else text, which, [x[0] for x in looked])


@dataclass
class Sentences:
    """Words of many sentences in a row: codes, kinds; per sentence its start and its text's number."""

    codes: np.ndarray
    kinds: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    which: np.ndarray
    words: list[str]

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, codes): words, neighbours and words one apart within a sentence."""
        h, n = self.codes, len(self.codes)
        every = np.arange(n)
        yield every, h
        opens = np.zeros(n, dtype=bool)
        opens[self.starts] = True
        k = every[1:][~opens[1:]]
        yield k, h[k - 1] * _A + h[k] * _B
        k = k[~opens[k - 1]]
        yield k, h[k - 2] * _C + h[k] * _D

    def cut(self, a: int, b: int) -> Sentences:
        """Words a to b as one sentence."""
        return Sentences(self.codes[a:b], self.kinds[a:b], np.zeros(1, np.int64), self.text[:1], self.which[a:b], self.words)

    def every(self) -> np.ndarray:
        return np.concatenate([c for _, c in self.features()])

    def phrase(self, a: int, b: int) -> str:
        return " ".join(self.words[x] for x in self.which[a:b])


@dataclass
class Classifier:
    """Weights of features by their codes in rising order; the score of a sentence is the logistic of their sum."""

    codes: np.ndarray
    weights: np.ndarray
    reader: Reader
    bias: float = UNKNOWN
    named: frozenset[str] = frozenset()
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[self.codes >> np.uint64(44)] = True

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        if len(self.codes):
            may = np.flatnonzero(self.table[codes >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.codes, codes[may]), len(self.codes) - 1)
            out[may] = np.where(self.codes[at] == codes[may], self.weights[at], 0.0)
        return out

    def windows(self, s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text, sum) of what is scored: sentences, in halves if long, and parts that ran on without a stop."""
        n = len(s.codes)
        sums = []
        for places, codes in s.features():
            each = np.zeros(n + 1)
            each[places + 1] = self.lookup(codes)
            sums.append(np.cumsum(each))
        start, end = s.starts, np.r_[s.starts[1:], n]
        a, b, text = [start], [end], [s.text]
        long = np.flatnonzero(end - start > WINDOW)
        count = -(-(end[long] - start[long] - WINDOW) // STEP) + 1
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        of = np.repeat(long, count)
        a.append(start[of] + STEP * step), b.append(np.minimum(start[of] + STEP * step + WINDOW, end[of])), text.append(s.text[of])
        # a capital behind a small word may open a sentence that no stop parts from the one before, so may capitals that begin
        on = np.zeros(n, dtype=bool)
        on[1:] = (s.kinds[1:] != s.kinds[:-1]) & (s.kinds[1:] > 0) & ((s.kinds[:-1] == 0) | (s.kinds[1:] == 2))
        on[start] = False
        if on.any():
            cut = np.sort(np.r_[start, np.flatnonzero(on)])
            stop = np.r_[cut[1:], n]
            fair = stop - cut >= 5
            a.append(cut[fair]), b.append(stop[fair]), text.append(s.text[np.searchsorted(start, cut[fair], "right") - 1])
        a, b, text = np.concatenate(a), np.concatenate(b), np.concatenate(text)
        # pairs count within the window alone
        return a, b, text, sum(t[b] - t[np.minimum(a + k, b)] for k, t in enumerate(sums))

    def score(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[str]]:
        """Highest score of each text, and the words it was found in."""
        best, found = np.zeros(len(texts)), [""] * len(texts)
        for s in self.reader.read(texts):
            a, b, text, z = self.windows(s)
            order = np.lexsort((b - a, -z, text))
            lead = order[np.r_[True, text[order][1:] != text[order][:-1]]] if len(order) else order
            best[text[lead]] = 1 / (1 + np.exp(-np.clip(z[lead] + self.bias, -30, 30)))
            for k in lead:
                found[text[k]] = s.phrase(a[k], b[k])
        return best, found


@dataclass
class Sample:
    """Features of the sentences of the rated documents."""

    sentence: np.ndarray
    code: np.ndarray
    doc: np.ndarray


def _sample(reader: Reader, texts: list[str]) -> tuple[Sample, list[Sentences]]:
    sentence, codes, doc, chunks, base = [], [], [], [], 0
    for s in reader.read(texts):
        of = np.zeros(len(s.codes), dtype=np.int64)
        of[s.starts[1:]] = 1
        of = np.cumsum(of)
        for places, c in s.features():
            sentence.append(of[places] + base), codes.append(c)
        doc.append(s.text)
        chunks.append(s)
        base += len(s.starts)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return Sample(join(sentence, np.int64), join(codes, np.uint64), join(doc, np.int64)), chunks


def names_in_use(chunks: list[Sentences]) -> frozenset[str]:
    """Names that the sentences use for each other: of three or more capitalised words between the same two words.

    A capitalised word before a general word for people is one as well. Words that are also written small are none.
    """
    small = {x for s in chunks for x in {s.words[k] for k in np.unique(s.which[s.kinds == 0])}}
    slots: dict[tuple[str, str], set[str]] = defaultdict(set)
    found: dict[str, set[tuple[str, str]]] = defaultdict(set)
    general = frozenset(PEOPLE)
    before: set[str] = set()
    for s in chunks:
        inside = np.ones(len(s.codes), dtype=bool)
        inside[s.starts] = False
        inside[np.r_[s.starts[1:], len(s.codes)] - 1] = False
        for k in np.flatnonzero(inside & (s.kinds == 1)):
            w = s.words[s.which[k]]
            if len(w) > 3 and w.isalpha() and w not in small:
                slot = s.words[s.which[k - 1]], s.words[s.which[k + 1]]
                if slot[1] in general:
                    before.add(w)
                elif s.kinds[k - 1] == 0 and s.kinds[k + 1] == 0:
                    slots[slot].add(w)
    for slot, words in slots.items():
        if len(words) >= 3:
            for w in words:
                found[w].add(slot)
    return frozenset(w for w, at in found.items() if len(at) >= 2) | before


def _telling(feature: np.ndarray, doc: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share, clean, offensive) of each feature: a low estimate of its share of offensive documents, and its documents of either kind."""
    pairs = np.unique(feature.astype(np.int64) * len(label) + doc)
    f, d = pairs // len(label), pairs % len(label)
    offensive = np.bincount(f, label[d], minlength=size)
    n = np.bincount(f, minlength=size)
    p, z = offensive / np.maximum(n, 1), 3.0
    low = (p + z * z / (2 * np.maximum(n, 1)) - z * np.sqrt((p * (1 - p) + z * z / (4 * np.maximum(n, 1))) / np.maximum(n, 1))) / (1 + z * z / np.maximum(n, 1))
    return low, n - offensive, offensive


def _best(z: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the sentence of highest z (-1 if it has none) and that z."""
    order = np.lexsort((z, doc))
    last = order[np.r_[doc[order][1:] != doc[order][:-1], True]] if len(order) else order
    which, top = np.full(size, -1), np.full(size, -np.inf)
    which[doc[last]], top[doc[last]] = last, z[last]
    return which, top


def _vocabulary(chunks: list[Sentences], label: np.ndarray, telling: float) -> tuple[frozenset[str], frozenset[str]]:
    """(hidden, common): words that tell of offensive documents, and those of clean ones."""
    words: dict[str, int] = {}
    feature, doc = [], []
    for s in chunks:
        number = np.array([words.setdefault(x, len(words)) for x in s.words], dtype=np.int64)
        feature.append(number[s.which])
        of = np.zeros(len(s.codes), dtype=np.int64)
        of[s.starts[1:]] = 1
        doc.append(s.text[np.cumsum(of)])
    low, clean, offensive = _telling(np.concatenate(feature), np.concatenate(doc), label, len(words))
    names = list(words)
    common = frozenset(names[k] for k in np.flatnonzero((clean >= 3) & (low < telling)))
    hidden: list[str] = []
    for k in sorted(np.flatnonzero((low >= telling) & (offensive >= 3)), key=lambda k: -offensive[k]):
        w = names[k]
        # a disguise of a more frequent word is none of its own
        if len(w) > 2 and w.isalpha() and Reader(frozenset(hidden))._disguised(w) is None:
            hidden.append(w)
    return frozenset(hidden), common


def _fit(reader: Reader, texts: list[str], label: np.ndarray, named: frozenset[str], *, rounds: int, epochs: int, rate: float, l2: float, fairness: float, hope: float) -> Classifier:
    sample, chunks = _sample(reader, texts)
    codes, index = np.unique(sample.code, return_inverse=True)
    sentences = len(sample.doc)
    if not sentences:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), reader, UNKNOWN, named)
    low, _, _ = _telling(index, sample.doc[sample.sentence], label, len(codes))
    offensive = label[sample.doc] > 0
    first = np.zeros(sentences)
    np.maximum.at(first, sample.sentence, low[index])
    hopeful = offensive & (first >= hope)
    # only features of sentences that may be offensive, and later of windows mistaken for offensive ones, get a weight
    use = np.zeros(len(codes), dtype=bool)
    use[index[hopeful[sample.sentence]]] = True
    mistaken_row, mistaken_code, mistaken = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    kept, w, begun = np.zeros(0, np.uint64), np.zeros(0), None

    def choose(z: np.ndarray, least: float) -> np.ndarray:
        """Per document its best sentence, -1 where it is no better than those of documents rated clean."""
        which, top = _best(np.where(hopeful | ~offensive, z, -np.inf), sample.doc, len(label))
        clean = top[(label == 0) & np.isfinite(top)]
        return np.where(np.isfinite(top) & (top > max(least, np.quantile(clean, 0.97) if len(clean) else -np.inf)), which, -1)

    for r in range(rounds):
        use[np.searchsorted(codes, mistaken_code)] = True
        before, kept = dict(zip(kept.tolist(), w.tolist(), strict=True)), codes[use]
        size = len(kept)
        w = np.array([before.get(c, 0.0) for c in kept.tolist()])
        place = np.cumsum(use) - 1
        keep = use[index]
        row = np.r_[sample.sentence[keep], mistaken_row + sentences]
        col = np.r_[place[index[keep]], place[np.searchsorted(codes, mistaken_code)]]
        total = sentences + mistaken
        twin_row, twin_col, twin_of = _twins(chunks, named, hopeful, kept)
        if begun is None:
            chosen = begun = choose(first, hope)
        else:
            chosen = choose(np.bincount(row, w[col], minlength=total)[:sentences], -UNKNOWN)
            chosen = np.where(chosen >= 0, chosen, begun)
        stands = chosen[(label > 0) & (chosen >= 0)]
        weight = np.ones(total)
        weight[:sentences][offensive] = 0.0
        weight[stands] = 2.0
        target = np.zeros(total)
        target[stands] = 1.0
        g2 = np.full(size, 1e-8)
        for _ in range(epochs):
            s = np.bincount(row, w[col], minlength=total)
            d = weight * (1 / (1 + np.exp(-np.clip(s + UNKNOWN, -30, 30))) - target)
            if len(twin_of):
                gap = fairness * weight[twin_of] * (s[twin_of] - np.bincount(twin_row, w[twin_col], minlength=len(twin_of)))
                d += np.bincount(twin_of, gap, minlength=total)
            g = np.bincount(col, d[row], minlength=size) + l2 * w
            if len(twin_of):
                g -= np.bincount(twin_col, gap[twin_row], minlength=size)
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
        heavy = np.abs(w) > 1e-3
        model = Classifier(kept[heavy], w[heavy], reader, UNKNOWN, named)
        if r + 1 < rounds:
            mistaken_row, mistaken_code, mistaken = _mistaken(model, chunks, label)
    return model


def _mistaken(model: Classifier, chunks: list[Sentences], label: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Windows of documents rated clean that look offensive: (window, feature) pairs, and how many windows."""
    rows, codes, made = [], [], 0
    for s in chunks:
        a, b, text, z = model.windows(s)
        for k in np.flatnonzero((z > 0.5 - UNKNOWN / 2) & (label[text] == 0)):
            c = s.cut(a[k], b[k]).every()
            rows.append(np.full(len(c), made)), codes.append(c)
            made += 1
    return (np.concatenate(rows), np.concatenate(codes), made) if made else (np.zeros(0, np.int64), np.zeros(0, np.uint64), 0)


def named_words(chunks: list[Sentences]) -> frozenset[str]:
    return names_in_use(chunks) | frozenset(PEOPLE)


def _twins(chunks: list[Sentences], named: frozenset[str], hopeful: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the counterfactuals: (counterfactual, feature) pairs, and the sentence of each counterfactual.

    Each sentence that names people gets two: others named, and nobody in particular.
    """
    rows, cols, of, base, made = [], [], [], 0, 0
    terms = sorted(named)
    for s in chunks:
        ends = np.r_[s.starts[1:], len(s.codes)]
        is_name = np.array([x in named for x in s.words], dtype=bool)[s.which] if len(s.which) else np.zeros(0, bool)
        holds = np.add.reduceat(is_name, s.starts) > 0 if len(s.starts) else np.zeros(0, bool)
        for k in np.flatnonzero(holds & hopeful[base : base + len(s.starts)]):
            for other in (terms[(base + k) % len(terms)], NEUTRAL[(base + k) % len(NEUTRAL)]):
                a, b = s.starts[k], ends[k]
                swapped = np.where(is_name[a:b], np.uint64(code(other)), s.codes[a:b])
                c = Sentences(swapped, s.kinds[a:b], np.zeros(1, np.int64), s.text[k : k + 1], s.which[a:b], s.words).every()
                at = np.minimum(np.searchsorted(kept, c), max(len(kept) - 1, 0))
                at = at[kept[at] == c] if len(kept) else at[:0]
                rows.append(np.full(len(at), made)), cols.append(at), of.append(base + k)
                made += 1
        base += len(s.starts)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(rows), join(cols), np.array(of, dtype=np.int64)


def fit(rated: list[tuple[str, float]], *, rounds: int = 5, epochs: int = 25, rate: float = 0.5, l2: float = 0.1, fairness: float = 1.0, telling: float = 0.35, hope: float = 0.35) -> Classifier:
    """Fit on (text, share of raters that found it offensive).

    Ratings between a third and two thirds are left out as undecided. Words of
    which at least the share ``telling`` of the documents is rated offensive
    are those that a disguise may hide; sentences may be offensive if a
    feature of theirs has the share ``hope``.
    """
    decided = [(t, s) for t, s in rated if t and (s <= 1 / 3 or s >= 2 / 3)]
    texts, label = [t for t, _ in decided], np.array([float(s > 0.5) for _, s in decided])
    if not label.any():
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), Reader())
    chunks = list(Reader().read(texts))
    named = named_words(chunks)
    hidden, common = _vocabulary(chunks, label, telling)
    reader = Reader(hidden - named, common | named)
    return _fit(reader, texts, label, named, rounds=rounds, epochs=epochs, rate=rate, l2=l2, fairness=fairness, hope=hope)


def train(documents: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED, max_characters: int = MAX_CHARACTERS) -> Classifier:
    """Classifier from the ratings; repeated rows count once.

    At most max_rated documents in order of a hash, and of these as many as
    hold max_characters together, whole texts each.
    """
    votes = labels.filter("offensive is not null").select("doc_id", "rater", "offensive").distinct().groupBy("doc_id").agg(F.avg("offensive").alias("share"))
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter("text is not null")
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    fitting = rows.withColumn("_n", so_far).filter(F.col("_n") <= max_characters).orderBy("doc_id").select("text", "share").toPandas()
    return fit(list(zip(fitting["text"], fitting["share"], strict=True)))


def score_documents(documents: DataFrame, model: Classifier, *, text: str = "text") -> DataFrame:
    """Add abuse_score and abuse_passage (the worst sentence as read) to every document.

    NULL, empty and blank texts score 0 with an empty passage. Whole texts are
    scored; one bad sentence is enough whatever the length of the rest. Input
    columns named like results get a trailing underscore.
    """
    documents = free(documents, "abuse_score", "abuse_passage", "_s")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passage string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            score, passage = shared.value.score(texts.tolist())
            yield pd.DataFrame({"score": score, "passage": passage})

    return documents.withColumn("_s", run(F.col(text))).withColumns({"abuse_score": F.col("_s.score"), "abuse_passage": F.col("_s.passage")}).drop("_s")


def rates(scored: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, flagged, rate) per source; a missing source is ''."""
    flagged = (F.col("abuse_score") >= threshold).cast("bigint")
    return scored.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(flagged).alias("flagged"), F.avg(flagged.cast("double")).alias("rate"))
