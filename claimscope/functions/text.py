"""Text columns: tokens, stop words, post texts, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: What ends a shortened post, and what stands for a link without text.
SHOW_MORE = r"(\r\n|\n|\r)(さらに表示|Show More)$"
NO_TEXT = "[連結]"


def tokens(text: Column) -> Column:
    """Lower-case words of two characters at least."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def without(words: Column, stop: Sequence[str]) -> Column:
    """Words that are no stop words, repeats kept."""
    own = [x for x in dict.fromkeys(stop)]
    return F.filter(words, lambda w: ~w.isin(*own))


def segmented_or_raw(text: Column, lang: Column, segmenter) -> Column:
    """Texts in Chinese through the segmenter, others as they are."""
    return F.when(lang.startswith("zh"), segmenter(text)).otherwise(text)


def post_text(parts: Column) -> Column:
    """A post's parts, one a line, without the trailing marker of a shortened post."""
    return F.regexp_replace(F.array_join(parts, "\n"), SHOW_MORE, "")


def inline_links(links: Column) -> Column:
    """Array of (text, href) without script links; an empty text becomes a placeholder."""
    real = F.filter(links, lambda x: x["href"].isNotNull() & ~x["href"].startswith("javascript:"))
    return F.transform(real, lambda x: F.struct(F.coalesce(F.nullif(x["text"], F.lit("")), F.lit(NO_TEXT)).alias("text"), x["href"].alias("href")))


def preview(url: Column, title: Column, description: Column, source: Column) -> Column:
    """The preview, null if all its parts are."""
    return F.when(F.coalesce(url, title, description, source).isNotNull(), F.struct(url.alias("url"), title.alias("title"), description.alias("description"), source.alias("source")))
