"""HTML columns by regular expressions: native, for pages whose structure is known. Arbitrary sites: ``operators.dom``."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
TITLE = r"(?s)<title>(.*?)</title>"
HEADING = r"(?s)<h1[^>]*>(.*?)</h1>"
HREF = r'<a[^>]*href="([^"]*)"'
#: Names of character references, from the standard library's table.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
_REFERENCE = r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-zA-Z][a-zA-Z0-9]{1,9};"
_MARK, _END = "\u0001", "\u0002"


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def _one_decoded(part: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    body = part.substr(F.lit(2), F.length(part) - 2)
    number = F.when(body.rlike("^#[xX]"), F.conv(body.substr(F.lit(3), F.length(body)), 16, 10)).when(body.startswith("#"), body.substr(F.lit(2), F.length(body)))
    return F.when(~part.rlike(rf"^(?:{_REFERENCE})$"), part).when(number.isNotNull(), _character(number.cast("long"))).otherwise(F.coalesce(F.element_at(names, body), part))


#: References that most texts have and no others, the ampersand last, as what it leaves is decoded already.
_COMMON = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0", "copy": "\u00a9", "middot": "\u00b7", "amp": "&"}
_OTHER = rf"&(?!(?:{'|'.join(_COMMON)});)[#a-zA-Z]"


def decoded(text: Column) -> Column:
    """Character references by number and by name, each decoded once; unknown ones stay."""
    plain = text
    for name, character in _COMMON.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(character))
    parts = F.regexp_extract_all(text, F.lit(rf"{_REFERENCE}|[^&]+|&"), F.lit(0))
    every = F.array_join(F.transform(parts, _one_decoded), "")  # looks names up one by one, so only where there are others
    return F.when(~F.contains(text, F.lit("&")), text).when(text.rlike(_OTHER), every).otherwise(plain)


def escaped(text: Column) -> Column:
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def stripped(markup: Column) -> Column:
    """Text of markup: tags dropped, character references decoded, ends trimmed."""
    return F.trim(decoded(F.regexp_replace(markup, "<[^>]*>", "")))


def cleaned(text: Column) -> Column:
    """Without line ends, tabs and blanks of either width, as sites' listings need it."""
    return F.translate(text, "\r\n\t \u3000\u00a0", "")


def title(page: Column) -> Column:
    return F.nullif(stripped(F.regexp_extract(page, TITLE, 1)), F.lit(""))


def heading(page: Column) -> Column:
    return F.nullif(stripped(F.regexp_extract(page, HEADING, 1)), F.lit(""))


def links(page: Column) -> Column:
    """Array of href values in page order."""
    return F.regexp_extract_all(page, F.lit(HREF), F.lit(1))


def paragraphs(page: Column) -> Column:
    """Array of paragraph texts in page order; a new paragraph or the article's end closes an open one."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(page, HIDDEN, ""), r"<[pP](?:\s[^>]*)?>", _MARK), "</article>", _MARK + _END)
    parts = F.regexp_extract_all(marked, F.lit(f"{_MARK}([^{_MARK}]*)"), F.lit(1))
    own = F.filter(parts, lambda p: ~p.startswith(_END))  # what follows the article's end is no paragraph
    return F.transform(own, lambda p: stripped(F.regexp_extract(p, r"(?s)^(.*?)(?:</[pP]\s*>|$)", 1)))
