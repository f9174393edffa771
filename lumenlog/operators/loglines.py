"""Semi-structured log lines into entries and fields (problem 7).

Lines are put together to entries, then the heads of the entries are split
into tokens. Tokens carry a type (time, level, number, key=, bracket, word);
distributed counts of the bigrams and trigrams that end in each word form the
n-gram dictionaries, which separate slots with constant words from slots with
variable ones: by the trigrams, or by the bigrams where those are rare. The
resulting templates get their roles by type: the level token, the keyed or
delimited variable word as component, the rest as message.

Files of any size are spread: lines are grouped by (file, block of line
numbers), and what an open entry carries into the next block travels through
one small row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenlog.functions.text import blank_to_null
from lumenlog.session import cut

BLOCK = 4096
#: A slot with fewer different words than this is constant once it was seen often enough.
FEW, OFTEN = 5, 50

# Level spellings of the log formats and their canonical level.
LEVELS = {
    "TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "NOTICE": "INFO", "WARN": "WARNING", "WARNING": "WARNING",
    "ERR": "ERROR", "ERROR": "ERROR", "SEVERE": "CRITICAL", "FATAL": "CRITICAL", "CRITICAL": "CRITICAL", "CRIT": "CRITICAL",
    "ALERT": "CRITICAL", "EMERG": "CRITICAL", "EMERGENCY": "CRITICAL", "FINE": "DEBUG", "FINER": "DEBUG", "FINEST": "TRACE", "CONFIG": "DEBUG",
}
SYSLOG = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARNING", "INFO", "INFO", "DEBUG")
_LEVEL = "|".join(sorted(LEVELS, key=len, reverse=True))
_DAY, _MONTH = "Mon|Tue|Wed|Thu|Fri|Sat|Sun", "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"
TIME = (
    rf"\d{{4}}[-/]\d{{2}}[-/]\d{{2}}[T ]{_CLOCK}(?:Z|\s?[+-]\d{{2}}:?\d{{2}})?"
    rf"|\d{{1,2}}/(?:{_MONTH})/\d{{4}}:{_CLOCK}(?:\s[+-]\d{{4}})?"
    rf"|(?:(?:{_DAY}),?\s)?(?:{_MONTH})\s+\d{{1,2}}(?:,?\s\d{{4}},?)?\s{_CLOCK}(?:\s[AP]M)?(?:\s\d{{4}})?"
    rf"|(?:(?:{_DAY}),?\s)?\d{{1,2}}\s(?:{_MONTH})\s\d{{4}}\s{_CLOCK}(?:\s[+-]\d{{4}}|\sGMT)?"
)
_KEY = r"[A-Za-z_@][\w.@-]*"
CRI = rf"^({TIME}) (stdout|stderr) ([PF])(?: ([\s\S]*))?$"
#: A head starts with a time (perhaps behind a priority or a bracket), with keyed fields that hold a time, with an object, or a slow-query mark.
_TIMED = rf"(?:ts|time|timestamp|t|@timestamp)=\"?(?:{TIME})"
HEAD = rf"^(?:(?:<\d{{1,3}}>(?:\d )?\s*)?\[?(?:{TIME})(?![\w])|(?:(?!{_TIMED}){_KEY}=\S+ +)*+{_TIMED}|\{{|# Time:)"
LEVEL_KEYS, COMPONENT_KEYS = "level|lvl|severity|loglevel|log_level", "service|app|component|program|service_name|logger"


def clean_lines(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(artifact_id, line_number, text, block): each physical line once, without line ends.

    Lines without number or text are left out; of repeated deliveries of a
    line number the greatest text stays.
    """
    rows = lines.select("artifact_id", "line_number", F.regexp_replace("raw_line", r"[\r\n]+$", "").alias("text")).filter("line_number is not null and text is not null")
    rows = rows.withColumn("block", F.floor(F.col("line_number") / block).cast("bigint"))
    w = Window.partitionBy("artifact_id", "block").orderBy("line_number", F.col("text").desc())
    return rows.withColumn("_p", F.lag("line_number").over(w)).filter("_p is null or _p <> line_number").drop("_p")


def entries(lines: DataFrame, block: int = BLOCK, *, text_blocks: int | None = None, stating: bool = False) -> DataFrame:
    """(artifact_id, first_line, last_line, head, text): physical lines put together.

    A partial container line goes on with the next line of its stream. Lines
    before the first head of a file form one entry. With ``text_blocks`` the
    text of an entry holds the lines of so many blocks after its first, but
    all of an object; first_line and last_line are those of the whole entry.
    With ``stating`` the text leaves out lines that cannot change what the
    entry states as level or component, wherever they stand: kept are an
    object and the parts of a container line in full, and of other lines the
    first two (of each block), which hold the head and a level line after it.
    """
    rows = clean_lines(lines, block)
    rows = cut(rows.withColumns({"_head": F.col("text").rlike(HEAD), "_stream": F.regexp_extract("text", CRI, 2), "_open": F.regexp_extract("text", CRI, 3) == "P"}))
    # a line goes on with the open one of its own stream, in its block or in the last block before that the stream has lines in
    ends = rows.filter("_stream <> ''").groupBy("artifact_id", "block", "_stream").agg(F.max_by("_open", "line_number").alias("_o"))
    before = Window.partitionBy("artifact_id").orderBy("block")
    earlier = Window.partitionBy("artifact_id", "_stream").orderBy("block")
    opened = ends.select("artifact_id", "block", "_stream", F.coalesce(F.lag("_o").over(earlier), F.lit(False)).alias("_o"))
    ws = Window.partitionBy("artifact_id", "block", "_stream").orderBy("line_number")
    rows = rows.join(opened, ["artifact_id", "block", "_stream"], "left")
    rows = rows.withColumn("_head", F.col("_head") & ((F.col("_stream") == "") | ~F.coalesce(F.lag("_open").over(ws), F.col("_o"), F.lit(False))))
    opening = F.when(F.col("_head"), F.struct(F.col("line_number").alias("n"), F.col("text").rlike(r"^\s*\{").alias("object")))
    so_far = Window.unboundedPreceding, Window.currentRow
    rows = rows.withColumn("_own", F.max(opening).over(ws.rowsBetween(*so_far)))
    own = rows.filter("_stream <> ''").groupBy("artifact_id", "block", "_stream").agg(F.max(opening).alias("_l"))
    own = own.select("artifact_id", "block", "_stream", F.max("_l").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    last = rows.groupBy("artifact_id", "block").agg(F.max(opening).alias("_l"), F.min("line_number").alias("_f"), F.min(F.when(F.col("text").rlike(r"\S"), F.struct(F.col("line_number").alias("n"), F.col("text").rlike(r"^\s*\{").alias("object")))).alias("_t"))
    # lines before the first head are an object if the file's first line that is not blank opens one
    file = Window.partitionBy("artifact_id")
    carried = last.select("artifact_id", "block", F.struct(F.min("_f").over(file).alias("n"), F.coalesce(F.min("_t").over(file)["object"], F.lit(False)).alias("object")).alias("_f"), F.max("_l").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    w = Window.partitionBy("artifact_id", "block").orderBy("line_number")
    rows = rows.withColumn("_any", F.max(opening).over(w.rowsBetween(*so_far)))
    if stating:  # a line whose last but one of no stream belongs to the same entry is the third or a later one
        rows = rows.withColumn("_later", (F.col("_stream") == "") & (F.row_number().over(ws) > 2) & F.lag("_any.n", 2).over(ws).eqNullSafe(F.col("_any.n")))
    rows = rows.join(carried, ["artifact_id", "block"]).join(own, ["artifact_id", "block", "_stream"], "left")
    rows = rows.withColumn("_s", F.coalesce(F.when(F.col("_stream") != "", F.coalesce("_own", "_before")), "_any", "_c", "_f"))
    held = F.lit(True) if text_blocks is None else F.col("_s.object") | (F.col("block") - F.floor(F.col("_s.n") / block) <= text_blocks)
    if stating:
        held = held & (F.col("_s.object") | ~F.col("_later"))
    grouped = rows.groupBy("artifact_id", F.col("_s.n").alias("_s")).agg(F.array_sort(F.collect_list(F.when(held, F.struct("line_number", "text")))).alias("l"), F.max("line_number").alias("last_line"))
    parts = F.transform("l", lambda x: x["text"])
    partial = F.size("l") > 1
    cri = F.regexp_extract(F.col("l")[0]["text"], CRI, 3) != ""
    # parts of a container line follow each other directly; lines without its head keep their text
    body = F.array_join(F.transform(parts, lambda t: F.when(F.regexp_extract(t, CRI, 3) != "", F.regexp_extract(t, CRI, 4)).otherwise(F.concat(F.lit("\n"), t))), "")
    whole = F.when(cri & partial, F.concat(F.regexp_extract(F.col("l")[0]["text"], rf"^({TIME}) (stdout|stderr)", 0), F.lit(" F "), body)).otherwise(F.array_join(parts, "\n"))
    return grouped.select(
        "artifact_id", F.col("l")[0]["line_number"].alias("first_line"), "last_line", whole.alias("text"),
    )


def _token_type(t: Column) -> Column:
    return (
        F.when(t.isin("<time>", "<pri>"), t)
        .when(t.rlike(r"^std(out|err)$"), "<stream>")
        .when(t.rlike(r"^[PF]$"), "<flag>")
        .when(t.rlike(rf"^(?:(?:{_LEVEL}):?|(?i)\[(?:[\w.-]+:)?(?:{_LEVEL})\])$"), "<level>")
        .when(t.rlike(rf"^\"?{_KEY}="), F.concat(F.regexp_extract(t, rf"^\"?({_KEY})=", 1), F.lit("=")))
        .when(t.rlike(r"^\W*\d[\W\d]*$"), "<number>")
        .when(t.rlike(r"^\[[^\[\]]+\]$"), "[word]")
        .when(t.rlike(r"^\W+$"), t)
        .when(t.rlike(r"^[\w./-]+(?:\[\d+\])?:$"), "word:")
        .otherwise("word")
    )


def typed_heads(df: DataFrame) -> DataFrame:
    """Add tokens and types (arrays) of the whole first line of each entry, and layout, a short key of the types.

    A keyed field with its quoted value is one token: level words in it are no level.
    """
    head = F.substring_index("text", "\n", 1)
    marked = F.regexp_replace(F.regexp_replace(head, r"^<(\d{1,3})>(?:\d )?\s*", "<pri> "), rf"\[?(?<!\S)\[?(?:{TIME})\]?(?!\S)", "<time>")
    tokens = F.regexp_extract_all(marked, F.lit(rf"{_KEY}=\"(?:[^\"\\]|\\.)*+\"\S*|\S+"), F.lit(0))
    typed = df.withColumn("tokens", tokens).withColumn("types", F.transform("tokens", _token_type))
    return typed.withColumn("layout", F.sha2(F.array_join("types", " "), 256))


def slots_of(types: Column, tokens: Column) -> Column:
    """array<struct<k, kind, word, one, two>>: each slot with the types of the one and the two tokens before it.

    Trigrams that close a line are told from those that others follow.
    """
    at = lambda k: F.coalesce(F.try_element_at(types, F.greatest(k, F.lit(1))), F.lit(""))
    previous = lambda k, steps: F.when(k > steps, at(k - steps)).otherwise(F.lit("^"))
    return F.transform(
        F.sequence(F.lit(1), F.size(types)),
        lambda k: F.struct((k - 1).alias("k"), F.element_at(types, k).alias("kind"), F.element_at(tokens, k).alias("word"), previous(k, 1).alias("one"), F.concat_ws(" ", previous(k, 2), previous(k, 1), F.when(k == F.size(types), "$")).alias("two")),
    )


def ngram_dictionaries(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bigrams, trigrams): context, kind, n, words.

    Both are counted per word first, so that a frequent word is one row per
    map task before the exchange; n counts a context's slots of a kind, words
    how many words fill them.
    """
    slots = heads.filter(F.size("types") > 0).select(F.explode(slots_of(F.col("types"), F.col("tokens"))).alias("s")).select("s.kind", "s.word", "s.one", "s.two")
    trigrams = cut(slots.groupBy("two", "one", "kind", "word").agg(F.count(F.lit(1)).alias("n")))
    filled = lambda df, c: df.groupBy(c, "kind").agg(F.sum("n").alias(f"n_{c}"), F.count(F.lit(1)).alias(f"words_{c}"))
    return filled(trigrams.groupBy("one", "kind", "word").agg(F.sum("n").alias("n")), "one"), filled(trigrams, "two")


def templates(heads: DataFrame) -> DataFrame:
    """(layout, constant): for each head layout, which of its slots hold constant words.

    A slot is constant if few words end its trigrams; where its trigrams are
    rare, its bigrams decide. Later a slot holds the component if it is a variable word that a constant slot
    follows (a delimiter, number or one of few words), a word with a colon
    right after the level, or a bracketed variable word after the level.
    """
    layouts = heads.filter(F.size("types") > 0).select("layout", "types").distinct()
    slots = layouts.select("layout", F.explode(slots_of(F.col("types"), F.col("types"))).alias("s")).select("layout", "s.k", "s.kind", "s.one", "s.two")
    bigrams, trigrams = ngram_dictionaries(heads)
    known = slots.join(trigrams, ["two", "kind"], "left").join(bigrams, ["one", "kind"], "left")
    rare = F.col("n_two") < OFTEN
    words, n = F.when(rare, F.col("words_one")).otherwise(F.col("words_two")), F.when(rare, F.col("n_one")).otherwise(F.col("n_two"))
    constant = (words < FEW) & ((n >= OFTEN) | (F.col("kind") == "word"))
    return known.groupBy("layout").agg(F.array_sort(F.collect_list(F.struct("k", constant.alias("c")))).alias("s")).select("layout", F.transform("s", lambda x: x["c"]).alias("constant"))


def _component_place() -> Column:
    """Index from 0 of the component token given types and constant, or NULL.

    It is the first word, the second of a line with a priority, or what
    follows the level, in a line of any length.
    """
    at = lambda a, k: F.try_element_at(a, k + 1)
    types, constant = F.col("types"), F.col("constant")
    fixed = lambda k: F.coalesce(at(constant, k), F.lit(True)) | ~F.coalesce(at(types, k), F.lit("")).isin("word", "word:", "[word]")
    first = lambda kind: F.array_position(types, kind).cast("int") - 1
    first_word, first_level, prioritised = first("word"), first("<level>"), F.array_contains(types, "<pri>")

    def holds(k: Column) -> Column:
        kind = at(types, k)
        before = at(types, k - 1)
        second = (k == first_word + 1) & prioritised
        bare = (kind == "word") & ~fixed(k) & fixed(k + 1) & ((k == first_word) | second)
        delimited = F.coalesce(at(types, k + 1), F.lit("")).rlike(r"^\W+$")
        bare = bare & F.array_contains(types, "<time>") & (before.isin("<time>", "[word]", "word") | before.rlike(r"^\W+$") | ((before == "<level>") & delimited)) & ~before.startswith("<number")
        levelled = (before == "<level>") & (k == first_level + 1)
        colon = (kind == "word:") & (levelled | ((before == "word") & second))
        bracket = (kind == "[word]") & levelled & ~F.coalesce(at(constant, k), F.lit(False))
        return bare | colon | bracket

    places = F.array_sort(F.array(first_word, first_word + 1, first_level + 1))
    return F.try_element_at(F.filter(F.filter(places, lambda k: k > 0), holds), F.lit(1))


def _level_name(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in LEVELS.items() for x in (k, v))), F.upper(c))


def parse_entries(lines: DataFrame, block: int = BLOCK, *, text_blocks: int | None = None, stating: bool = False) -> DataFrame:
    """(artifact_id, first_line, last_line, time_raw, level, component, message, text).

    level is canonical and '' where the entry states none, component as
    written and '' where the entry names none, time_raw NULL where none was
    found. Where no field states a level, the first level token of the whole
    first line counts, however far behind; later ones do not. An empty table
    gives an empty result. ``text_blocks`` bounds the text, see ``entries``;
    what is stated only beyond it is not seen. With ``stating`` lines, level
    and component are those of the whole text, and the other columns are not.
    """
    heads = cut(typed_heads(entries(lines, block, text_blocks=text_blocks, stating=stating)))
    layout = templates(heads)
    rows = heads.join(layout, "layout", "left").withColumn("_at", _component_place())
    head = F.substring_index("text", "\n", 1)
    json = F.when(F.col("text").rlike(r"^\s*\{"), F.regexp_replace("text", "\n", " "))
    keyed = lambda names, t: blank_to_null(F.regexp_extract(t, rf"(?:^|\s)(?:{names})=\"?([^\s\",;]+)", 1))
    inside = lambda names: F.coalesce(*(F.get_json_object(json, f"$.{n}") for n in names))
    logfmt = head.rlike(rf"^(?:{_KEY}=|.*?(?:{TIME})\S*\s+(?:std(?:out|err) [PF] )?(?:(?:{_LEVEL}) +)?{_KEY}=)")
    query = F.col("text").startswith("# ")
    level_token = F.try_element_at(F.filter(F.zip_with("types", "tokens", lambda a, b: F.when(a == "<level>", b)), lambda x: x.isNotNull()), F.lit(1))
    second = blank_to_null(F.regexp_extract("text", rf"^[^\n]*\n({_LEVEL}): ", 1))
    pri = blank_to_null(F.regexp_extract(head, r"^<(\d{1,3})>", 1)).try_cast("int")
    by_pri = F.when(pri.isNotNull(), F.element_at(F.array(*(F.lit(x) for x in SYSLOG)), F.pmod(F.coalesce(pri, F.lit(0)), F.lit(8)) + 1))
    word = blank_to_null(F.regexp_extract(level_token, rf"(?i)({_LEVEL})\]?:?$", 1))
    stated = F.coalesce(inside(("severity", "level", "lvl", "severityText")), F.when(json.isNull() & ~query, F.coalesce(F.when(logfmt, keyed(LEVEL_KEYS, head)), word, second)))
    level = F.coalesce(F.when(query, ""), by_pri, _level_name(stated), F.lit(""))
    module = blank_to_null(F.regexp_extract(level_token, r"^\[([\w.-]+):", 1))
    placed = F.regexp_replace(F.try_element_at("tokens", F.col("_at") + 1), r"^\[|\]?:?$|\[\d+\]:?$", "")
    named = F.coalesce(
        inside(("service.name", "service", "component", "app", "logger", "program")),
        F.when(json.isNull() & ~query, F.coalesce(F.when(logfmt, keyed(COMPONENT_KEYS, head)), module, placed)),
    )
    named = F.when(~F.coalesce(named, F.lit("")).startswith("{"), named)
    time_raw = F.coalesce(inside(("@timestamp", "timestamp", "time", "ts")), blank_to_null(F.regexp_extract("text", rf"(?:{TIME})", 0)))
    rest = F.regexp_replace(F.regexp_replace("text", rf"^(?:<\d{{1,3}}>(?:\d )?\s*)?\[?(?:{TIME})\]?\s*", ""), rf"^(?:std(?:out|err) [PF] )?(?:\W*(?:{_LEVEL})\b\W*)?", "")
    message = F.coalesce(inside(("message", "msg", "body")), blank_to_null(F.regexp_extract(head, r"(?:^|\s)msg=\"((?:[^\"\\]|\\.)*)\"", 1)), rest)
    return rows.select("artifact_id", "first_line", "last_line", time_raw.alias("time_raw"), level.alias("level"), F.coalesce(named, F.lit("")).alias("component"), message.alias("message"), "text")
