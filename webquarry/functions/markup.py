"""Columns over one piece of HTML: tag names, attributes, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.functions.text import decode_entities, let

# Patterns of the token stream and of one attribute.
TOKEN = (
    r"(?is)<!--.*?-->|<!DOCTYPE[^>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|"
    r"""</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!?/][^>]*>|(?:[^<]++|<(?![a-z!?/]))++|<"""
)
ATTRIBUTE = r"""\s([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def tag_name(tok: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1)), F.lit(""))


def attributes(tok: Column) -> Column:
    """``array<struct<name,value>>`` in the order of the source, values decoded."""
    pieces = F.regexp_extract_all(tok, F.lit(ATTRIBUTE), F.lit(0))

    def one(p: Column) -> Column:
        raw = r"""(?s)^\s[^\s=]+(?:\s*=\s*(?:"(.*)"|'(.*)'|([^"'].*)))?$"""
        value = F.concat(*[F.regexp_extract(p, raw, i) for i in (1, 2, 3)])
        return F.struct(
            F.lower(F.regexp_extract(p, r"^\s([^\s=]+)", 1)).alias("name"),
            decode_entities(value).alias("value"),
        )

    return F.transform(pieces, one)


def attr_of(attrs: Column, name: str) -> Column:
    """Value of the first attribute of that name; null without it."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), 0)["value"]


def attr(tok: Column, name: str) -> Column:
    """The same straight from the source of the tag."""
    # skip the tags that cannot hold it before taking them apart
    has = F.lower(tok).contains(name)
    return F.when(has, attr_of(attributes(tok), name))


def _upto(name: str) -> str:
    """The attributes of a tag up to the one looked for; possessive, so that no tag is too long."""
    return (r"""(?is)^<[^\s/>]++(?:\s++(?!""" + name + r"""[\s=/>])[^\s=>]++"""
            r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+\s++""")


def own(name: str, tok: str | Column = "tok") -> Column:
    """Value of an attribute straight from the source of its tag; empty without it.

    Only expressions that compile into the stage around them, for use on every row; those of a column without ``=`` are not searched.
    """
    column = F.col(tok) if isinstance(tok, str) else tok
    pattern = _upto(name) + name + r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    value = F.btrim(F.regexp_extract(column, pattern, 1), F.lit("\"'"))
    return F.coalesce(F.when(column.contains("="), value) if isinstance(tok, str) else value, F.lit(""))


def before_value(name: str) -> str:
    """Pattern of a tag up to the end of an attribute's value; its first group is what stands before the attribute."""
    return _upto(name).replace("^", "^(", 1) + ")" + name + r"""\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def has_attr(name: str) -> Column:
    return F.coalesce(F.col("tok").startswith("<") & F.col("tok").rlike(_upto(name) + name + r"(?:[\s=/>])"), F.lit(False))


def has_class(cls: Column, names) -> Column:
    return F.coalesce(cls.rlike(r"(^|\s)(" + "|".join(names) + r")(\s|$)"), F.lit(False))


def attrs_map(tok: Column) -> Column:
    """``map<name,value>``; the first of equal names counts, as in a browser."""
    a = attributes(tok)
    names = F.array_distinct(F.transform(a, lambda x: x["name"]))
    return F.map_from_arrays(
        names,
        F.transform(names, lambda n: F.get(F.filter(a, lambda x: x["name"] == n), 0)["value"]),
    )


def quoted(name: Column, value: Column) -> Column:
    """An attribute as the source of a tag has it, after a space."""
    for sign, written in (("&", "&amp;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(sign), F.lit(written))
    return F.concat(F.lit(" "), name, F.lit('="'), value, F.lit('"'))


def without_attr(tok: Column, name: str) -> Column:
    return F.regexp_replace(tok, before_value(name), "$1")


def with_attr(tok: Column, name: str, value: Column) -> Column:
    """The source of a tag with an attribute set, in place of the one it had."""
    start = r"^<[^\s/>]+"
    rest = F.regexp_replace(without_attr(tok, name), start, "")
    return F.concat(F.regexp_extract(tok, start, 0), quoted(F.lit(name), value), rest)


def merged(toks: Column) -> Column:
    """The last of some tags with the attributes of all of them; of equal names the first tag's counts."""
    named = F.transform(F.flatten(F.transform(toks, attributes)), lambda a, i: F.struct(a["name"].alias("name"), i.alias("at"), a["value"].alias("value")))
    firsts = let(F.array_sort(named), lambda s: F.filter(s, lambda a, i: (i == 0) | (F.get(s, i - 1)["name"] != a["name"])))
    ordered = F.array_sort(F.transform(firsts, lambda a: F.struct(a["at"].alias("at"), a["name"].alias("name"), a["value"].alias("value"))))
    written = F.array_join(F.transform(ordered, lambda a: quoted(a["name"], a["value"])), "")
    return F.concat(F.regexp_extract(F.element_at(toks, -1), r"^<[^\s/>]+", 0), written, F.lit(">"))


def match_string(cls: Column, ident: Column) -> Column:
    return F.concat(F.coalesce(cls, F.lit("")), F.lit(" "), F.coalesce(ident, F.lit("")))
