"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space and everything a word cannot hold, as one class each; the same in Java and in RE2.
SPACES = r"[ \t\n\r\x{b}\x{c}\x{85}\x{a0}\x{2003}]+"
FORMATS = ("pdf", "docx", "pptx", "xlsx", "txt", "md")
#: Characters of a passage that a reader sees.
EXCERPT_CHARS = 6_000


# English words that say nothing about a passage.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could d did do does doing don down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just ll m me more most my myself no nor not now o of off on once only or other "
    "our ours ourselves out over own re s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up ve very "
    "was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_text(c: Column | str) -> Column:
    """White space collapsed, trimmed, lower case: the key of equal passages."""
    return F.lower(F.trim(F.regexp_replace(column(c), SPACES, " ")))


def normalise_phrase(c: Column | str) -> Column:
    """Lower case, everything but letters, digits, underscores and spaces turned into a space, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(column(c)), r"[^\p{L}\p{M}\p{N}_ ]+", " "), " +", " "))


def word_characters(c: Column | str) -> Column:
    """Number of letters, digits and underscores."""
    return F.length(F.regexp_replace(column(c), r"[^\p{L}\p{N}_]", ""))


def terms(c: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(column(c)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_estimate(c: Column | str) -> Column:
    return (F.floor(F.length(column(c)) / F.lit(1.5)) + 1).cast("int")


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(column(c), "/"), -1)


def suffix(c: Column | str) -> Column:
    """Lower-case file type without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(basename(c), r"\.([^.]*)$", 1))


def source_format(c: Column | str) -> Column:
    """File type if it is one of the known ones, else pdf."""
    kind = suffix(c)
    return F.when(kind.isin(*FORMATS), kind).otherwise("pdf")


def passage_text(filename: Column | str, page: Column | str, kind: Column | str, content: Column | str) -> Column:
    """Header with document, page and kind above the content."""
    head = F.concat(F.lit("Document: "), basename(filename), F.coalesce(F.concat(F.lit(" (page "), column(page).cast("string"), F.lit(")")), F.lit("")))
    mark = F.when(column(kind) == "image_caption", " [figure]").when(column(kind) == "chart_data", " [chart]").otherwise("")
    return F.concat(head, mark, F.lit("\n"), column(content))


def excerpt_label(kind: Column | str, page: Column | str) -> Column:
    """What an excerpt is: of a figure, of the data of a chart, or text, with its page."""
    at = F.concat(F.lit("page "), column(page).cast("string"))
    what = F.when(column(kind) == "image_caption", "description of a figure").when(column(kind) == "chart_data", "data behind a chart")
    return F.coalesce(F.when(what.isNotNull(), F.concat(what, F.coalesce(F.concat(F.lit(", "), at), F.lit("")))), at, F.lit("text"))


def excerpt(c: Column | str) -> Column:
    return F.substring(column(c), 1, EXCERPT_CHARS)


# Fixed value: what counts as a number.
NUMBER = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?|-?\.[0-9]+)"


def numbers(c: Column | str) -> Column:
    """Numbers in order, commas dropped."""
    found = F.regexp_extract_all(column(c), F.lit(NUMBER), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))


def citation_numbers(c: Column | str) -> Column:
    """The n of every [n]."""
    return F.transform(F.regexp_extract_all(column(c), F.lit(r"\[([0-9]{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))


def strip_thinking(c: Column | str) -> Column:
    return F.regexp_replace(column(c), r"(?s)<think>.*?</think>", "")


# Characters kept of each kind of text, and what marks the cut.
CUTS = {"history": (500, "..."), "summary": (400, "..."), "preview": (200, "..."), "title": (60, ""), "snippet": (500, "")}


def shorten(c: Column | str, kind: str) -> Column:
    """Text cut as its kind is, white space around it dropped; shorter text stays."""
    most, mark = CUTS[kind]
    text = F.trim(column(c))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def cursor_encode(stamp: Column | str, key: Column | str) -> Column:
    """URL-safe base64 of ``stamp|key``."""
    return F.translate(F.base64(F.concat_ws("|", column(stamp).cast("string"), column(key).cast("string")).cast("binary")), "+/\r\n", "-_")


def cursor_decode(c: Column | str) -> Column:
    """``(stamp, key)`` of a cursor; null where it is none: not of the alphabet, or without a time and a key."""
    text = F.translate(F.regexp_replace(column(c), "=+$", ""), "-_", "+/")
    good = text.rlike("^[A-Za-z0-9+/]+$") & (F.length(text) % 4 != 1)
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    plain = F.when(good, F.try_to_binary(padded, F.lit("base64")).try_cast("string"))
    stamp, key = F.split_part(plain, F.lit("|"), F.lit(1)), F.split_part(plain, F.lit("|"), F.lit(2))
    valid = F.try_to_timestamp(stamp).isNotNull() & (F.length(key) > 0) & (F.size(F.split(plain, r"\|")) == 2)
    return F.when(valid, F.struct(stamp.alias("stamp"), key.alias("key")))
