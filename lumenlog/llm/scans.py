"""Noise in text from scanned pages (problem 2).

Three repairs, all as joins and aggregations over lines and words:

* furniture: lines at the edge of a page that come back at edges, and page
  numbers that run along with the pages;
* broken words: a line end with a hyphen whose joined word the scans know
  better than the hyphenated one;
* misread characters: rare words meet frequent ones by their anagram hash.
  The hash of a word is the sum of the fifth powers of its letters' codes, so
  each confusion of letters is one fixed difference, and a rare word finds the
  frequent words that it may stand for by adding the differences of the
  confusions it can hold. Candidates are verified letter by letter and ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenlog.session import cut

# What is read -> what was printed.
CONFUSIONS = (
    ("c", "e"), ("1", "l"), ("1", "i"), ("|", "i"), ("|", "l"), ("l", "i"), ("i", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("2", "z"), ("†", "t"),
    ("b", "h"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("e", "c"), ("h", "b"), ("d", "cl"), ("m", "rn"), ("w", "vv"), ("u", "ii"),
)
#: Signs no word of the corpus is printed with: their reading needs no second witness.
FOREIGN = "[†|ﬁﬂ]"
HYPHENS = "[-‐‑¬­]"
_CODES = "abcdefghijklmnopqrstuvwxyz0123456789|†-'ﬁﬂ"
_EDGE_LINES = 2
#: Punctuation before, the word, punctuation behind.
_CORE = r"^([^\w|†ﬁﬂ]*)(.*?)([^\w|†ﬁﬂ]*)$"
UNIT = r"^\d+[sgbl]$"
PAGE_WORDS = ("page", "sheet", "p.")
_NUMERAL = r"[\dlioszbg|]{1,4}"
_DIGIT_LIKE = {"l": "1", "i": "1", "|": "1", "o": "0", "s": "5", "z": "2", "b": "6", "g": "9"}


def letter_code(ch: str) -> int:
    k = _CODES.find(ch)
    return (k + 11 if k >= 0 else 97) ** 5


def anagram_value(word: str) -> int:
    return sum(map(letter_code, word))


def anagram(c: Column) -> Column:
    """The anagram hash of a word column: equal for words of equal letters."""
    letters = F.split(c, "")
    at = lambda ch: F.when(F.instr(F.lit(_CODES), ch) > 0, F.instr(F.lit(_CODES), ch) + 10).otherwise(97).cast("bigint")
    power = lambda n: n * n * n * n * n
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0).cast("bigint"), lambda a, x: a + power(at(x)))


def skeleton(c: Column) -> Column:
    """One sign for all letters that may be read for each other.

    Single letters first, then the pairs, so that every spelling of a word
    takes the same way: load, loacl and 1oad all end as one.
    """
    c = F.regexp_replace(F.regexp_replace(c, "ﬁ", "fi"), "ﬂ", "fl")
    c = F.translate(c, "1i|0596†28bc", "lllosghtzhhe")
    for pair, one in (("el", "d"), ("ll", "u"), ("rn", "m"), ("vv", "w")):
        c = F.regexp_replace(c, pair, one)
    return c


def page_lines(pages: DataFrame) -> DataFrame:
    """(artifact_id, page_index, page_id, line_no, line, top, bottom): lines counted from 1.

    top and bottom count the lines that are not blank from either edge. Pages
    without text have no lines.
    """
    rows = pages.select("artifact_id", F.coalesce("page_index", F.lit(0)).alias("page_index"), "page_id", F.split("extracted_text", "\n", -1).alias("l")).filter("l is not null")
    numbered = F.transform("l", lambda x, k: F.struct((k + 1).alias("line_no"), F.rtrim(F.regexp_replace(x, "\r$", "")).alias("line")))
    rows = rows.select("artifact_id", "page_index", "page_id", F.filter(numbered, lambda x: ~x["line"].rlike(r"^\s*$")).alias("l"))
    # the line before in the list tells a blank one between
    before = F.transform("l", lambda x, k: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.coalesce(F.get("l", k - 1)["line_no"], F.lit(0)).alias("before")))
    each = rows.select("artifact_id", "page_index", "page_id", F.size("l").alias("n"), F.posexplode(before).alias("k", "x"))
    return each.select(
        "artifact_id", "page_index", "page_id", "x.line_no", "x.line", (F.col("k") + 1).alias("top"), (F.col("n") - F.col("k")).alias("bottom"), (F.col("x.line_no") - F.col("x.before") > 1).alias("after_blank"),
    )


def _digits(c: Column) -> Column:
    return F.translate(F.lower(c), "".join(_DIGIT_LIKE), "".join(_DIGIT_LIKE.values()))


def mark_furniture(lines: DataFrame, *, within: int = 2, across: int = 6, share: float = 0.9) -> DataFrame:
    """Add ``furniture``: running headers, footers and page numbers.

    A line among the two outer ones of a page is furniture if it, or its
    layout with names and numbers masked, is found at the edges of ``within``
    or more pages of its scan, or of ``across`` or more scans, and elsewhere
    hardly ever; or if it is a page number: a number with page words or
    marks, or a bare one that runs along with the pages of the scan.
    """
    low = F.lower(F.trim("line"))
    edge = (F.col("top") <= _EDGE_LINES) | (F.col("bottom") <= _EDGE_LINES)
    own = skeleton(F.regexp_replace(low, r"[\d|]+", "#"))
    own = F.regexp_replace(own, r"#[losgbz]*|\b[losgbz]#", "#")
    masked = F.regexp_replace(F.regexp_replace(low, r"\S*-\S*|\S*[\d|]\S*", "#"), r"[.,;:·-]+$", "")
    parts = F.filter(F.split(masked, r"\s+"), lambda x: x != "")
    n = F.size(parts)
    head = F.concat_ws(" ", F.lit("h"), n.cast("string"), skeleton(F.array_join(F.slice(parts, 1, 2), " ")))
    tail = F.concat_ws(" ", F.lit("t"), n.cast("string"), skeleton(F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), " ")))
    number = F.regexp_replace(_digits(low), r"\s+", " ")
    worded = rf"^([^\W\d]\S*?[^\W\d]|p\.) ?({_NUMERAL})(?: (\S{{2}}) ({_NUMERAL}))?$"
    named = [F.regexp_extract(low, worded, k) for k in (1, 3)]
    like = lambda c, *words: reduce(lambda x, y: x | y, (skeleton(c) == skeleton(F.lit(w)) for w in words))
    marked = (like(named[0], *PAGE_WORDS) & ((named[1] == "") | like(named[1], "of"))) | number.rlike(r"^(?:\[\d{1,4}\]|[-‐–] ?\d{1,4} ?[-‐–]|\d{1,4} ?/ ?\d{1,4})$")
    bare = F.when(number.rlike(r"^\d{1,4}$"), number.try_cast("int") - F.col("page_index"))
    rows = lines.withColumns({"_e": edge, "_own": own, "_head": F.when(n <= 9, head), "_tail": F.when(n <= 9, tail), "_n": marked, "_b": F.when(edge, bare)})
    at_edge = F.countDistinct(F.when(F.col("_e"), F.col("page_id")))
    inside = F.count(F.when(~F.col("_e"), 1))
    in_scan = rows.groupBy("artifact_id", "_own").agg(at_edge.alias("pe"), inside.alias("pi"), F.countDistinct("page_id").alias("pp")).filter((F.col("pe") >= within) & (F.col("pe") >= share * (F.col("pe") + F.col("pi")))).select("artifact_id", "_own", F.lit(True).alias("_f1"))
    runs = rows.filter("_b is not null").groupBy("artifact_id", "_b").agg(F.countDistinct("page_id").alias("r")).filter("r >= 2").select("artifact_id", "_b", F.lit(True).alias("_f2"))

    def spread(key: str, mark: str) -> DataFrame:
        got = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.approx_count_distinct(F.when(F.col("_e"), F.col("artifact_id"))).alias("se"), F.count(F.when(F.col("_e"), 1)).alias("ce"), inside.alias("ci"))
        return got.filter((F.col("se") >= across) & (F.col("ce") >= share * (F.col("ce") + F.col("ci")))).select(key, F.lit(True).alias(mark))

    rows = rows.join(in_scan, ["artifact_id", "_own"], "left").join(runs, ["artifact_id", "_b"], "left").join(spread("_head", "_f3"), "_head", "left").join(spread("_tail", "_f4"), "_tail", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    wordy = ~F.col("line").rlike(r"[.,;]$") & (F.length("line") <= 70)
    found = F.col("_e") & (F.col("_n") | yes("_f2") | (yes("_f1") & ~F.col("line").rlike(r"^\s*[\d|lioszbg]+\s*$")) | ((yes("_f3") | yes("_f4")) & wordy & ~F.col("line").rlike(r"^\s*[\d|lioszbg]+\s*$")))
    return rows.withColumn("furniture", found).drop("_e", "_own", "_head", "_tail", "_n", "_b", "_f1", "_f2", "_f3", "_f4")


def _words(line: Column) -> Column:
    """Words of a line in lower case without the punctuation around them."""
    bare = F.transform(F.split(F.lower(line), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\w|†ﬁﬂ]+|[^\w|†ﬁﬂ]+$", ""))
    return F.filter(bare, lambda w: w != "")


def line_words(body: DataFrame) -> DataFrame:
    """Body lines with words, the cut end (stub) and what follows it (rest).

    stub is the last word of a line that ends with a hyphen; rest the first
    word of the next body line of the page, else of the scan's next page.
    """
    w = Window.partitionBy("page_id").orderBy("line_no")
    first = F.regexp_extract(F.ltrim("line"), r"^(\S+)", 1)
    rows = body.withColumns({"_first": first, "_next": F.lead(first).over(w)})
    opening = rows.groupBy("artifact_id", "page_index", "page_id").agg(F.min_by("_first", "line_no").alias("_open"))
    follow = opening.select("page_id", F.lead("_open").over(Window.partitionBy("artifact_id").orderBy("page_index", "page_id")).alias("_open"))
    rows = rows.join(follow, "page_id", "left")
    stub = F.regexp_extract("line", rf"([^\s]*[\w|†ﬁﬂ]){HYPHENS}$", 1)
    rest = F.coalesce("_next", "_open", F.lit(""))
    tidy = lambda c: F.regexp_replace(F.lower(c), r"^[^\w|†ﬁﬂ]+|[^\w|†ﬁﬂ]+$", "")
    rows = rows.withColumns({"stub": F.when(stub != "", tidy(stub)), "rest": F.when(stub != "", tidy(rest)), "rest_raw": F.when(stub != "", rest)})
    whole = F.lag(F.col("stub").isNotNull()).over(w)
    ends = rows.groupBy("artifact_id", "page_index", "page_id").agg(F.max_by(F.col("stub").isNotNull(), "line_no").alias("_c"))
    came = ends.select("page_id", F.coalesce(F.lag("_c").over(Window.partitionBy("artifact_id").orderBy("page_index", "page_id")), F.lit(False)).alias("_c"))
    rows = rows.join(came, "page_id", "left").withColumn("starts_cut", F.coalesce(whole, F.col("_c"), F.lit(False)))
    words = _words(F.col("line"))
    words = F.when(F.col("stub").isNotNull(), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    words = F.when(F.col("starts_cut"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    return rows.withColumn("words", words).drop("_first", "_next", "_open", "_c")


def corrections(counts: DataFrame, *, ratio: float = 8.0, least: int = 4) -> DataFrame:
    """(word, right, weight): rare words with the best frequent confusable word.

    counts: (word, n). A candidate must be ``ratio`` times as frequent as the
    word and occur ``least`` times; words with signs that are never printed
    need only be less frequent. Ranked by frequency, then in order of letters.
    """
    table = [(o, t, anagram_value(t) - anagram_value(o)) for o, t in CONFUSIONS]
    diffs = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(t).alias("t"), F.lit(d).cast("bigint").alias("d")) for o, t, d in table))
    letters = counts.filter((F.length("word") >= 2) & F.col("word").rlike(r"[a-z†|ﬁﬂ]"))
    rare = letters.withColumns({"av": anagram(F.col("word")), "sk": skeleton(F.col("word")), "d": F.filter(diffs, lambda x: F.contains(F.col("word"), x["o"]))})
    one = F.transform("d", lambda x: x["d"])
    two = F.flatten(F.transform("d", lambda x: F.transform("d", lambda y: x["d"] + y["d"])))
    shifts = F.array_distinct(F.concat(one, F.when(F.length("word") >= 5, two).otherwise(F.array().cast("array<bigint>"))))
    keyed = rare.select("word", "n", "sk", F.explode(shifts).alias("s"), "av").select("word", "n", "sk", (F.col("av") + F.col("s")).alias("key"))
    right = rare.filter((F.col("n") >= least) & ~F.col("word").rlike(FOREIGN)).select(F.col("word").alias("right"), F.col("n").alias("m"), F.col("av").alias("key"), F.col("sk").alias("rsk"))
    pairs = keyed.join(right, "key").filter((F.col("sk") == F.col("rsk")) & (F.col("word") != F.col("right")))
    strange = F.col("word").rlike(FOREIGN) | F.col("word").rlike(r"[a-z]\d[a-z]|^\d[a-z]{2,}|[a-z]{2,}\d$")
    good = pairs.filter((F.col("m") >= ratio * F.col("n")) | (strange & (F.col("m") > F.col("n"))))
    return good.groupBy("word").agg(F.max(F.struct(F.col("m"), F.col("right"))).alias("b")).select("word", F.col("b.right").alias("right"), F.col("b.m").alias("weight"))


def _numeric_misread(w: Column) -> Column:
    """A number, or a token of hexadecimal digits, with letters that look like digits.

    A number with one letter for a unit behind it is left to ``unit_misread``.
    """
    parts = F.split(w, r"[-:./,·]")

    def bad(p: Column) -> Column:
        mixed = p.rlike(r"^(?=.*\d)(?=.*[lioszbg|])[\dlioszbg|]{2,7}$") & ~p.rlike(UNIT) | (p.rlike(r"^[\dlioszbg|]{8,}$") & p.rlike(r"\d") & p.rlike(r"[lioszg|]"))
        hexed = p.rlike(r"^[0-9a-flioszg|†]{10,}$") & p.rlike(r"\d.*\d.*\d") & p.rlike(r"[lioszg|†]")
        return mixed | hexed

    return F.exists(parts, bad)


def _as_digits(w: Column) -> Column:
    """A number, or a part of hexadecimal digits, with the digits for its letters."""
    hexed = w.rlike(r"^[0-9a-flioszg|†]{10,}$")
    return F.when(hexed, F.translate(w, "liosz|†g", "11052179")).otherwise(F.translate(w, "".join(_DIGIT_LIKE), "".join(_DIGIT_LIKE.values())))


def _as_letters(w: Column) -> Column:
    """A word with the letters for signs that are never printed."""
    return F.regexp_replace(F.regexp_replace(F.translate(w, "†|", "tl"), "ﬁ", "fi"), "ﬂ", "fl")


def _cased(read: Column, right: Column) -> Column:
    """The repair in the case of what was read: capitals, a capital first, or small."""
    letters = F.regexp_replace(read, r"[^\p{L}]", "")
    capitals = (F.length(letters) > 1) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    first = F.substring(read, 1, 1)
    return F.when(capitals, F.upper(right)).when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(right, 1, 1)), F.substring(right, 2, 1 << 30))).otherwise(right)


class Scans:
    """The analysed pages: lines, word counts and corrections, each computed once."""

    def __init__(self, pages: DataFrame) -> None:
        self.lines = cut(mark_furniture(page_lines(pages.select("artifact_id", "page_index", "page_id", "extracted_text"))))
        self.body = cut(line_words(self.lines.filter(~F.col("furniture"))))
        plain = self.body.select(F.explode("words").alias("word"))
        self.counts = cut(plain.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
        self._joined()
        # numbers with a letter behind count as units only where the corpus writes units often
        share = lambda x: F.sum(F.when(F.col("word").rlike(x), F.col("n")).otherwise(0))
        self.units = self.counts.agg((share(UNIT) < 0.05 * share(r"^\d+$")).alias("unit_misread"))
        # a word with a hyphen is misread if one of its parts is
        pieces = self.counts.select(F.explode(F.split("word", "-")).alias("word"), "n").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
        joined = self.joints.filter("broken").groupBy(F.col("joined").alias("word")).agg(F.count(F.lit(1)).alias("n"))
        known = pieces.unionByName(joined).groupBy("word").agg(F.sum("n").alias("n"))
        self.corrections = cut(corrections(known))

    def _joined(self) -> None:
        """joints: every cut line end, whether the word is broken there."""
        ends = self.body.filter("stub is not null").select("page_id", "line_no", "line", "stub", "rest")
        last = F.element_at(F.split("stub", "-"), -1)
        first = F.regexp_extract("rest", r"^([^-]*)", 1)
        ends = ends.withColumns({"hyphened": F.concat("stub", F.lit("-"), "rest"), "joined": F.concat(last, first)})
        by = self.counts.select(F.col("word").alias("w"), "n")
        pieces = self.counts.select(F.explode(F.split("word", "-")).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
        sk = by.groupBy(skeleton(F.col("w")).alias("s")).agg(F.sum("n").alias("n"))
        psk = pieces.groupBy(skeleton(F.col("w")).alias("s")).agg(F.sum("n").alias("n"))
        starts = self.counts.filter(F.col("word").contains("-")).select(F.split("word", "-")[0].alias("w"), "n").groupBy(skeleton(F.col("w")).alias("s")).agg(F.sum("n").alias("n"))
        got = (
            ends.withColumns({"_h": skeleton(F.col("hyphened")), "_j": skeleton(F.col("joined")), "_w": skeleton(F.col("stub"))})
            .join(sk.select(F.col("s").alias("_h"), F.col("n").alias("nh")), "_h", "left")
            .join(psk.select(F.col("s").alias("_j"), F.col("n").alias("nj")), "_j", "left")
            .join(starts.select(F.col("s").alias("_w"), F.col("n").alias("ns")), "_w", "left")
        )
        nh, nj, ns = (F.coalesce(F.col(c), F.lit(0)) for c in ("nh", "nj", "ns"))
        host = F.col("rest").rlike(r"^[\dlioszb|]*\d[\dlioszb|]*$") | ((F.col("rest") == "") & (ns > 0))
        broken = F.when(host, False).when((nj > 0) | (nh > 0), nj > nh).otherwise(~((F.col("rest") == "") & (ns > 0)))
        self.joints = cut(got.select("page_id", "line_no", "line", "stub", "rest", "joined", broken.alias("broken")))

    def verdicts(self) -> DataFrame:
        """(token, right): every distinct token with a misread letter, and its repair.

        The parts of a token are repaired by the ranked corrections; a number
        gets digits for letters; a sign that is never printed, for which no
        correction is known, gets the letter it stands for most often.
        """
        ends = self.joints.select(F.explode(F.array(F.when(~F.col("broken"), F.col("stub")), F.when(~F.col("broken"), F.col("rest")))).alias("token")).filter("token <> ''")
        tokens = self.counts.select(F.col("word").alias("token")).union(ends).distinct()
        units = self.units.filter("unit_misread").select(F.lit(True).alias("_unit"), "unit_misread")
        tokens = tokens.withColumn("_unit", F.col("token").rlike(UNIT)).join(F.broadcast(units), "_unit", "left")
        tokens = tokens.withColumns({"_number": _numeric_misread(F.col("token")) | F.coalesce("unit_misread", F.lit(False)), "_odd": F.col("token").rlike(FOREIGN) & F.col("token").rlike(r"[a-z\d]")}).drop("unit_misread", "_unit")
        parts = tokens.select("token", "_number", "_odd", F.posexplode(F.split("token", "-")).alias("k", "word"))
        fixed = parts.join(self.corrections.select("word", "right"), "word", "left")
        right = F.when(F.length("word") > 1, F.col("right"))
        plain = F.when(F.col("_number"), _as_digits(F.col("word"))).when(F.col("_odd"), _as_letters(F.col("word"))).otherwise(F.col("word"))
        whole = fixed.groupBy("token", "_number", "_odd").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce(right, plain).alias("w")))).alias("p"), F.max(right.isNotNull()).alias("_known"))
        return whole.filter("_number or _odd or _known").select("token", F.array_join(F.transform("p", lambda x: x["w"]), "-").alias("right"))

    def misread(self) -> DataFrame:
        """(page_id, line_no): body lines with a misread word, as often as they have some."""
        whole = self.body.select("page_id", "line_no", F.explode("words").alias("token"))
        kept = self.joints.filter(~F.col("broken")).select("page_id", "line_no", F.col("stub").alias("token"))
        places = self._second_places()
        later = places.filter(~F.col("broken")).select(F.col("at_page").alias("page_id"), F.col("at_line").alias("line_no"), F.col("rest").alias("token"))
        plain = whole.union(kept).union(later).join(self.verdicts(), "token").select("page_id", "line_no")
        last = F.element_at(F.split("stub", "-"), -1)
        first = F.regexp_extract("rest", r"^([^-]*)", 1)
        cut_ = places.filter("broken").join(self.corrections.select("word", "right"), F.col("joined") == F.col("word"), "left")
        before = cut_.filter((F.col("right").isNotNull() & ~F.col("right").startswith(last)) | last.rlike(FOREIGN)).select("page_id", "line_no")
        after = cut_.filter((F.col("right").isNotNull() & ~F.expr("endswith(right, regexp_extract(rest, '^([^-]*)', 1))")) | first.rlike(FOREIGN) | _numeric_misread(F.col("rest")))
        return plain.union(before).union(after.filter("at_page is not null").select("at_page", "at_line"))

    def _second_places(self) -> DataFrame:
        """joints with the place (at_page, at_line) of the rest of the cut word."""
        at = self.body.select("artifact_id", "page_index", "page_id", "line_no", F.lead("line_no").over(Window.partitionBy("page_id").orderBy("line_no")).alias("next_line"))
        heads = self.body.groupBy("artifact_id", "page_index", "page_id").agg(F.min("line_no").alias("open_line"))
        later = Window.partitionBy("artifact_id").orderBy("page_index", "page_id")
        heads = heads.select("page_id", F.lead("page_id").over(later).alias("next_page"), F.lead("open_line").over(later).alias("next_open"))
        placed = self.joints.join(at.join(heads, "page_id").select("page_id", "line_no", "next_line", "next_page", "next_open"), ["page_id", "line_no"])
        return placed.withColumns({"at_page": F.when(F.col("rest") != "", F.when(F.col("next_line").isNotNull(), F.col("page_id")).otherwise(F.col("next_page"))), "at_line": F.coalesce("next_line", "next_open")}).drop("next_line", "next_page", "next_open")

    def defects(self) -> DataFrame:
        """(page_id, line_no, defect) of every line with a defect."""
        name = lambda df, d: df.select("page_id", F.col("line_no").cast("int").alias("line_no"), F.lit(d).alias("defect"))
        return name(self.lines.filter("furniture"), "furniture").union(name(self.joints.filter("broken"), "broken_word")).union(name(self.misread(), "misread")).distinct()

    def paragraphs(self) -> DataFrame:
        """(artifact_id, paragraph_no, text): the repaired text of every scan.

        Body lines follow each other over the pages; a blank line starts a
        paragraph. A word cut at a line end is joined first, then repaired as
        one word, and written once. Case and punctuation stay.
        """
        keep = ["artifact_id", "page_index", "page_id", "line_no"]
        starts = F.col("after_blank") & (F.col("top") > 1)
        ends = self._second_places().select("page_id", "line_no", "broken", "joined")
        lines = self.body.join(ends, ["page_id", "line_no"], "left")
        tokens = lines.select(*keep, starts.alias("_p"), "broken", "joined", "rest_raw", "starts_cut", F.col("stub").isNotNull().alias("_cut"), F.posexplode(F.filter(F.split("line", r"\s+"), lambda x: x != "")).alias("k", "raw"))
        last = F.max("k").over(Window.partitionBy("page_id", "line_no"))
        tokens = tokens.withColumn("_last", (F.col("k") == last) & F.col("_cut"))
        # the rest of a cut word moves up to its first part; its own place is left empty
        stub = F.regexp_replace("raw", f"{HYPHENS}$", "")
        glue = F.when(F.col("broken"), "").otherwise(F.substring("raw", -1, 1))
        moved = F.col("starts_cut") & (F.col("k") == 0)
        rest = F.coalesce("rest_raw", F.lit(""))
        tokens = tokens.withColumn("raw", F.when(F.col("_last") & moved, rest).when(F.col("_last"), F.concat(stub, glue, rest)).otherwise(F.col("raw"))).filter(~moved | F.col("_last"))
        core = F.regexp_extract("raw", _CORE, 2)
        tokens = tokens.withColumns({"_before": F.regexp_extract("raw", _CORE, 1), "_core": core, "_after": F.regexp_extract("raw", _CORE, 3), "token": F.lower(core)})
        fixes = self.verdicts().unionByName(self._joined_fixes()).groupBy("token").agg(F.max("right").alias("right"))
        tokens = tokens.join(fixes, "token", "left")
        text = F.concat("_before", F.when(F.col("right").isNotNull(), _cased(F.col("_core"), F.col("right"))).otherwise(F.col("_core")), "_after")
        per_line = tokens.groupBy(*keep, "_p").agg(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))).alias("x"))
        per_line = per_line.select(*keep, "_p", F.array_join(F.transform("x", lambda v: v["t"]), " ").alias("t"))
        # paragraphs are counted by page first, so that no scan is gathered in one row
        page = per_line.groupBy("artifact_id", "page_index", "page_id").agg(F.sum(F.col("_p").cast("int")).alias("_n"))
        earlier = Window.partitionBy("artifact_id").orderBy("page_index", "page_id").rowsBetween(Window.unboundedPreceding, -1)
        page = page.select("page_id", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
        within = Window.partitionBy("page_id").orderBy("line_no")
        numbered = per_line.withColumn("_i", F.sum(F.col("_p").cast("int")).over(within)).join(page, "page_id")
        grouped = numbered.groupBy("artifact_id", (F.col("_o") + F.col("_i")).cast("int").alias("paragraph_no")).agg(F.array_sort(F.collect_list(F.struct("page_index", "page_id", "line_no", "t"))).alias("x"))
        return grouped.select("artifact_id", "paragraph_no", F.array_join(F.transform("x", lambda v: v["t"]), " ").alias("text")).filter("text <> ''")

    def _joined_fixes(self) -> DataFrame:
        """(token, right) of broken words: whole words with the parts about them, the joined part repaired."""
        b = self.joints.filter("broken").join(self.corrections.select("word", "right"), F.col("joined") == F.col("word"), "left")
        front = F.regexp_extract("stub", r"^(.*-)[^-]*$", 1)
        behind = F.regexp_extract("rest", r"^[^-]*(-.*)$", 1)
        fixed = F.coalesce("right", F.when(F.col("joined").rlike(FOREIGN), _as_letters(F.col("joined"))))
        return b.filter(fixed.isNotNull()).select(F.concat("stub", "rest").alias("token"), F.concat(front, fixed, behind).alias("right")).distinct()
