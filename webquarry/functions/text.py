"""Text columns: whitespace, escapes, estimates, names and display strings.

Everything here is a function from columns to a column made of built-in expressions.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.functions import constants as C
from webquarry.options import DEFAULT_CONTEXT_LIMIT, DEFAULT_REPORT_LIMIT

# The white space characters of the web (wider than the ASCII ``\s`` of Java).
WS_CHARS = (
    " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same as classes of one such character and of one other. Java asks for each member of a class in turn, so the common signs are told first.
ONE_WS = rf"[[^!-~]&&[{WS}]]"
NO_WS = rf"[!-~[^{WS}]]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and named once in the plan."""
    return F.get(F.transform(F.array(value), body), 0)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rtrim_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Runs of two or more white space characters become one space."""
    return F.regexp_replace(c, f"{ONE_WS}{{2,}}", " ")


def inner_text(c: Column) -> Column:
    return squeeze(trim_ws(c))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, the unit of the web."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


# ---------------------------------------------------------------- entities

_REFERENCE = r"&#[xX][0-9a-fA-F]+;|&#[0-9]+;|&[a-zA-Z][a-zA-Z0-9]*;|[^&]+|&"
_METADATA_NAMES = {"quot": '"', "amp": "&", "apos": "'", "lt": "<", "gt": ">"}


def _code_point(number: Column) -> Column:
    """One character from its number; what no HTML page may hold becomes U+FFFD."""
    bad = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    safe = F.when(bad, F.lit(0xFFFD).cast("long")).otherwise(number)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _numeric_reference(piece: Column) -> Column:
    digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+);$", 1)
    number = F.when(
        piece.rlike("^&#[xX]"), F.conv(digits, 16, 10).try_cast("long")
    ).otherwise(digits.try_cast("long"))
    return _code_point(number)


def _name_map(names: dict[str, str]) -> Column:
    # one constant after folding, where create_map would be hundreds of expressions
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def decode_entities(c: Column) -> Column:
    """Character references of body text and attributes, decoded in one pass."""
    names = {k: chr(v) for k, v in name2codepoint.items()} | {"apos": "'"}
    lookup = _name_map(names)

    def one(piece: Column) -> Column:
        return (
            F.when(~piece.startswith("&"), piece)
            .when(piece.startswith("&#") & piece.endswith(";"), _numeric_reference(piece))
            .otherwise(
                F.coalesce(F.try_element_at(lookup, F.regexp_extract(piece, "^&(.*);$", 1)), piece)
            )
        )

    def decoded(v: Column) -> Column:
        pieces = F.regexp_extract_all(v, F.lit(_REFERENCE), F.lit(0))
        return F.when(v.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(v)

    return let(c, decoded)


def decoded(name: str) -> Column:
    """The same for a column by its name, which most often holds no reference."""
    c = F.col(name)
    return F.when(c.contains("&"), decode_entities(c)).otherwise(c)


def unescape_metadata(c: Column) -> Column:
    """The five named references first, then numeric ones, as for metadata values."""
    lookup = _name_map(_METADATA_NAMES)

    def named(piece: Column) -> Column:
        return F.coalesce(
            F.try_element_at(lookup, F.regexp_extract(piece, "^&([a-z]+);$", 1)), piece
        )

    def numeric(piece: Column) -> Column:
        return F.when(piece.rlike("^&#.*;$"), _numeric_reference(piece)).otherwise(piece)

    pieces = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))
    first = F.array_join(F.transform(pieces, named), "")
    again = F.regexp_extract_all(first, F.lit(_REFERENCE), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(again, numeric), "")).otherwise(c)


# ---------------------------------------------------------------- similarity


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-zA-Z0-9_]+"), lambda w: w != "")


def text_similarity(a: Column, b: Column) -> Column:
    """One minus the share of ``b`` (by joined length) whose words are absent from ``a``."""

    def similarity(v: Column) -> Column:
        # bag difference: repeated words count each time
        missing = F.filter(v["wb"], lambda w: F.array_contains(v["absent"], w))
        share = F.length(F.array_join(missing, " ")) / F.length(F.array_join(v["wb"], " "))
        return F.when((F.size(v["wa"]) == 0) | (F.size(v["wb"]) == 0), F.lit(0.0)).otherwise(1 - share)

    # each text is split once, not once a word of the other
    words = F.struct(_words(a).alias("wa"), _words(b).alias("wb"))
    return let(let(words, lambda v: F.struct(v["wa"].alias("wa"), v["wb"].alias("wb"), F.array_except(v["wb"], v["wa"]).alias("absent"))), similarity)


# ---------------------------------------------------------------- names and dates


def sanitize_filename(c: Column, default: str = "untitled", longest: int = C.MAX_FILE_NAME) -> Column:
    """A title as a file name of ``longest`` signs at most, as file systems want; the title itself stays beside it."""
    blank = f"[{WS}.]+"
    out = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "")
    out = F.regexp_replace(out, blank, "_")
    out = F.btrim(F.regexp_replace(out, "_+", "_"), F.lit("_"))
    out = F.rtrim(F.substring(out, 1, longest), F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def date_string(ts: Column) -> Column:
    """The day of a time in UTC, whatever the time zone of the session."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp").cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd")


# ---------------------------------------------------------------- token estimates


def token_estimate(c: Column) -> Column:
    """The larger of three quarters of the words and a quarter of the characters, rounded up."""
    # a sign a word, as words taken out one by one cost more than the whole search
    words = F.length(F.regexp_replace(trim_ws(c), f"{NO_WS}++{ONE_WS}*+", "x"))
    # in quarters, so that no fraction is ever rounded
    quarters = F.greatest(words.cast("long") * 3, utf16_length(c))
    return F.coalesce(F.floor((quarters + 3) / 4), F.lit(0)).cast("long")


_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WS + r"\p{L}\p{N}]+"
    + f"|[{WS}]+(?![^{WS}])|[{WS}]+"
)


def token_heuristic(c: Column) -> Column:
    """One token per four bytes of each word, number, sign run or space run, plus one."""
    pieces = F.regexp_extract_all(c, F.lit(_SPLIT), F.lit(0))
    total = F.aggregate(
        pieces,
        F.lit(0).cast("long"),
        lambda acc, p: acc + F.greatest(F.lit(1), F.ceil(F.octet_length(p) / 4)).cast("long"),
    )
    return F.when(c.isNull() | (c == ""), F.lit(0).cast("long")).otherwise(total + 1)


def limit_report(count: Column, limit=DEFAULT_REPORT_LIMIT) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.struct(
        count.cast("long").alias("count"),
        limit.cast("long").alias("limit"),
        F.round(count / limit * 100, 1).alias("percentage"),
        (count > limit).alias("is_over_limit"),
        F.greatest(F.lit(0), limit - count).cast("long").alias("remaining"),
    )


def _grouped(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def _round_half_up(c: Column) -> Column:
    return F.round(c, 0).cast("long")


def format_tokens(count: Column, limit=None) -> Column:
    if limit is None:
        return F.concat(_grouped(count), F.lit(" tokens"))
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.concat(
        _grouped(count), F.lit(" / "), _grouped(limit), F.lit(" tokens ("),
        _round_half_up(count / limit * 100).cast("string"), F.lit("%)"),
    )


def format_limit(n: Column) -> Column:
    """``8192`` as ``8K``, ``1000000`` as ``1.0M``."""
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(_round_half_up(n / 1000).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def batch_tokens_message(count: Column, limit=DEFAULT_CONTEXT_LIMIT) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    text = F.concat(
        _grouped(count), F.lit(" tokens ("), _round_half_up(count / limit * 100).cast("string"),
        F.lit("% of "), _round_half_up(limit / 1000).cast("string"), F.lit("K limit)"),
    )
    return F.when(count > 0, text).otherwise(F.lit(""))


def budget_status(count: Column, limit=DEFAULT_CONTEXT_LIMIT) -> Column:
    """``struct(status, message)``: note from 75 %, warn from 90 %, error from 100 %."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    # whole numbers: count / limit >= 75 / 100 without division
    hundredfold, left = count * 100, _grouped(limit - count)
    status = (
        F.when(hundredfold >= limit * 100, F.lit("error"))
        .when(hundredfold >= limit * 90, F.lit("warn"))
        .when(hundredfold >= limit * 75, F.lit("note"))
        .otherwise(F.lit("ok"))
    )
    sign = F.lit("⚠️ ")
    message = (
        F.when(status == "error",
               F.concat(sign, F.lit("Exceeds limit by "), _grouped(count - limit), F.lit(" tokens")))
        .when(status == "warn", F.concat(sign, left, F.lit(" tokens remaining")))
        .when(status == "note", F.concat(left, F.lit(" tokens remaining")))
        .otherwise(F.lit(""))
    )
    return F.struct(status.alias("status"), message.alias("message"))


# ---------------------------------------------------------------- Markdown text

# Escapes in the order in which they apply; ``^`` is the start of the text run.
_ESCAPES = [
    (r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\$1"),
    (r"^(#{1,6}) ", r"\\$1 "), (r"`", r"\\`"), (r"^~~~", r"\\~~~"), (r"\[", r"\\["),
    (r"\]", r"\\]"), (r"^>", r"\\>"), (r"_", r"\\_"), (r"^(\d+)\. ", r"$1\\. "),
]


def md_escape(c: Column) -> Column:
    out = c
    for pattern, replacement in _ESCAPES:
        out = F.regexp_replace(out, pattern, replacement)
    # most text runs need none of them
    return F.when(c.rlike(r"[\\*`\[\]_]|^(-|\+ |=|#|~~~|>|\d+\. )"), out).otherwise(c)


def md_attr(c: Column) -> Column:
    """Line breaks inside an attribute, with the space after them, become one."""
    return F.coalesce(F.regexp_replace(c, f"(?:\n[{WS}]*)+", "\n"), F.lit(""))


def md_title(c: Column) -> Column:
    """The ``"title"`` part of a link or image, with its leading space; empty without a title."""
    title = md_attr(c)
    return F.when(title != "", F.concat(F.lit(' "'), F.replace(title, F.lit('"'), F.lit('\\"')),
                                        F.lit('"'))).otherwise(F.lit(""))


def md_href(c: Column) -> Column:
    return F.regexp_replace(c, r"([()])", r"\\$1")


def fence_size(c: Column) -> Column:
    """Longer than every run of backticks that starts a line, three at least."""
    runs = F.regexp_extract_all(c, F.lit(r"(?m)^`{3,}"), F.lit(0))
    return F.greatest(
        F.lit(3), F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r) + 1)), F.lit(3))
    )


def code_language(code_class: Column, pre_class: Column) -> Column:
    both = F.concat_ws(" ", F.coalesce(code_class, F.lit("")), F.coalesce(pre_class, F.lit("")))
    return F.regexp_extract(both, f"(?:language|lang)-([^{WS}]+)", 1)


def inline_code(c: Column) -> Column:
    """A code span whose delimiter is no run of backticks inside it."""
    # each step once a text: what a lambda takes from outside would be worked out again for each of its elements
    def marked(v: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.size(v["runs"]) + 1)
        mark = F.repeat(F.lit("`"), F.array_min(F.array_except(sizes, v["runs"])))
        return F.when(v["flat"] == "", F.lit("")).otherwise(
            let(F.concat(mark, v["pad"]), lambda m: F.concat(m, v["flat"], F.reverse(m))))

    def parts(flat: Column) -> Column:
        # blanks at both ends and a sign between them, on one line or, with its break as that sign, on two
        padded = flat.rlike("^`|^ ++[^ ].* $|^ .*[\u0085\u2028\u2029].* $|`$")
        runs = F.array_distinct(F.transform(F.regexp_extract_all(flat, F.lit("`+"), F.lit(0)), lambda r: F.length(r)))
        return F.struct(flat.alias("flat"), F.when(padded, F.lit(" ")).otherwise(F.lit("")).alias("pad"), runs.alias("runs"))

    return let(let(F.regexp_replace(c, r"\r?\n|\r", " "), parts), marked)


def post_process(c: Column) -> Column:
    """Blank lines squeezed, headings set apart, every other pair of bullets set apart."""
    out = F.regexp_replace(c, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"([^\n])(\n#{1,6} )", "$1\n\n$2")
    return F.regexp_replace(out, r"(\n[*\-+] [^\n]+)(\n[*\-+] )", "$1\n$2")


def prepend_title(markdown: Column, title: Column) -> Column:
    t = trim_ws(F.coalesce(title, F.lit("")))
    return F.when(t != "", F.concat(F.lit("# "), t, F.lit("\n\n"), markdown)).otherwise(markdown)


def frame_note(count: Column) -> Column:
    return F.when(count > 0, F.format_string(C.FRAME_NOTE, count.cast("long"))).otherwise(F.lit(""))


def append_notes(markdown: Column, frames: Column) -> Column:
    return F.concat(markdown, frame_note(F.coalesce(frames, F.lit(0))))


def format_metadata(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{title}``, ``{url}`` … one after the other, in the order given."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return out


def classify_error(detail: Column) -> Column:
    """Error code of a failure message."""
    return (
        F.when(detail.contains("No content"), F.lit("NO_CONTENT"))
        .when(detail.contains("No text is selected"), F.lit("NO_SELECTION"))
        .when(detail.contains("Permission"), F.lit("PERMISSION_DENIED"))
        .when(detail.isNotNull(), F.lit("GENERAL"))
    )


def error_message(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in C.ERROR_MESSAGES.items():
        out = F.when(code == name, F.lit(text)).otherwise(out)
    return out


def class_weight(cls: Column, ident: Column) -> Column:
    def one(c, pattern, weight):
        return F.when(F.coalesce(c, F.lit("")).rlike(pattern), F.lit(weight)).otherwise(F.lit(0))

    return (
        one(cls, C.NEGATIVE, -25) + one(cls, C.POSITIVE, 25)
        + one(ident, C.NEGATIVE, -25) + one(ident, C.POSITIVE, 25)
    )


def initial_score(tag: Column, weight: Column) -> Column:
    score = F.lit(0)
    for points, tags in C.TAG_SCORES.items():
        score = F.when(tag.isin(tags), F.lit(points)).otherwise(score)
    return score + weight


def paragraph_points(length: Column, commas: Column) -> Column:
    """Points of a paragraph from its length and commas; none below 25 characters."""
    points = commas + 2 + F.least(F.floor(length / 100).cast("int"), F.lit(3))
    return F.when(length >= 25, points).otherwise(F.lit(0))


def paragraph_score(text: Column) -> Column:
    clean = inner_text(text)
    return paragraph_points(F.length(clean), F.regexp_count(clean, F.lit(C.COMMAS)))
