"""From stored gazette pages to the digest of a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelio.operators import digest


def search_pages(
    pages: DataFrame,
    keywords: Sequence[str],
    n: int,
    position: str = "page_id",
    html: str = "html",
    url: str = "url",
) -> DataFrame:
    """The first `n` pages of each keyword with title, summary and link.

    Pages are searched whole. The fields are taken from matching pages only,
    and before the pages are ranked, so that no page body is sorted.
    """
    found = digest.page_fields(digest.matches(pages, html, keywords), html, url)
    results = found.select("keyword", position, "title", "summary", "href")
    return digest.first_results(results, [F.col(position)], n)


def programme_digest(
    pages: DataFrame,
    keywords: Sequence[str] = digest.PROGRAMME_PHRASES,
    n: int = 9,
    introduction: str = digest.INTRODUCTION,
    **columns: str,
) -> DataFrame:
    """One block per keyword, in order; keywords without result say so."""
    return digest.keyword_digest(
        search_pages(pages, keywords, n, **columns), keywords, introduction
    )


def word_digest(
    pages: DataFrame,
    day: Column,
    word: str = digest.SINGLE_WORD,
    n: int = 9,
    introduction: str = digest.INTRODUCTION,
    **columns: str,
) -> DataFrame:
    """The message of one day for one search word."""
    return digest.single_digest(
        search_pages(pages, [word], n, **columns), word, day, introduction
    )
