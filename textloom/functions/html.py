"""HTML body extraction and HTML to text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.text import decode_entities, strip


def body_slice(html: Column, strict: bool = True) -> Column:
    """From the first ``<body`` up to the first ``</body>``.

    A page without the start tag gives ``''``. Without the end tag the strict form ends one
    character before the end of the page, ``strict=False`` keeps that character.
    """
    start = F.locate("<body", html)
    end = F.locate("</body>", html)
    stop = F.when(end > 0, end).otherwise(F.length(html) + F.lit(0 if strict else 1))
    return F.when((start == 0) | (stop <= start), F.lit("")).otherwise(F.substr(html, start, stop - start))


# Elements whose content is not text of the page.
_SILENT = ("script", "style", "template", "rt", "rp", "head")
# The loops are possessive, so the matcher neither backtracks nor recurses on long tags.
_MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)|"
    + "|".join(rf"<{n}(?:[\s/][^>]*)?>.*?(?:</{n}\s*>|\z)" for n in _SILENT)
    + r"""|<[a-z/!?][^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+(?:>|\z)"""
)


def html_to_text(html: Column) -> Column:
    """Text nodes of the body, each stripped, empty ones dropped, joined by a blank."""
    whole = ~html.startswith("<body") & html.rlike(r"(?i)<body[\s/>]")
    body = F.when(whole, F.regexp_replace(html, r"(?is)\A.*?(?=<body[\s/>])", "")).otherwise(html)
    nodes = F.transform(F.split(body, _MARKUP), lambda t: strip(decode_entities(t)))
    return F.array_join(F.filter(nodes, lambda t: t != ""), " ")
