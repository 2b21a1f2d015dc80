"""Keyword search over stored pages and the text digest of the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelio.functions.dates import long_date
from parcelio.functions.nulls import broadcast_if_small
from parcelio.functions.text import glue
from parcelio.session import shared_folder

# The searched programme names, the single search word, the
# subject, the introduction and the messages of the digest.
PROGRAMME_PHRASES = (
    "Programa de Fomento às Escolas de Ensino Médio em Tempo Integral",
    "Programa Brasil Alfabetizado",
    "Programa de Apoio aos Sistemas de Ensino para Atendimento à Educação de Jovens e Adultos",
    "Programa Nacional de Inclusão de Jovens",
    "Projovem",
    "Programa Nacional de Acesso ao Ensino Técnico e Emprego",
    "Apoio a novas turmas de Educação Infantil",
    "Apoio a novos estabelecimentos de Educação Infantil",
)
SINGLE_WORD = "fies"
SUBJECT = "Diário Oficial da União - "
INTRODUCTION = "Portarias, Resoluções publicadas"
NOTHING_FOUND = "Não foram encontrados resultados que contenham as palavras-chave"


# Named character references and their code points.
NAMED_CHARACTERS = {
    "quot": 34, "amp": 38, "apos": 39, "lt": 60, "gt": 62, "nbsp": 160, "iexcl": 161,
    "cent": 162, "pound": 163, "curren": 164, "yen": 165, "brvbar": 166, "sect": 167,
    "uml": 168, "copy": 169, "ordf": 170, "laquo": 171, "not": 172, "shy": 173, "reg": 174,
    "macr": 175, "deg": 176, "plusmn": 177, "sup2": 178, "sup3": 179, "acute": 180,
    "micro": 181, "para": 182, "middot": 183, "cedil": 184, "sup1": 185, "ordm": 186,
    "raquo": 187, "frac14": 188, "frac12": 189, "frac34": 190, "iquest": 191, "Agrave": 192,
    "Aacute": 193, "Acirc": 194, "Atilde": 195, "Auml": 196, "Aring": 197, "AElig": 198,
    "Ccedil": 199, "Egrave": 200, "Eacute": 201, "Ecirc": 202, "Euml": 203, "Igrave": 204,
    "Iacute": 205, "Icirc": 206, "Iuml": 207, "ETH": 208, "Ntilde": 209, "Ograve": 210,
    "Oacute": 211, "Ocirc": 212, "Otilde": 213, "Ouml": 214, "times": 215, "Oslash": 216,
    "Ugrave": 217, "Uacute": 218, "Ucirc": 219, "Uuml": 220, "Yacute": 221, "THORN": 222,
    "szlig": 223, "agrave": 224, "aacute": 225, "acirc": 226, "atilde": 227, "auml": 228,
    "aring": 229, "aelig": 230, "ccedil": 231, "egrave": 232, "eacute": 233, "ecirc": 234,
    "euml": 235, "igrave": 236, "iacute": 237, "icirc": 238, "iuml": 239, "eth": 240,
    "ntilde": 241, "ograve": 242, "oacute": 243, "ocirc": 244, "otilde": 245, "ouml": 246,
    "divide": 247, "oslash": 248, "ugrave": 249, "uacute": 250, "ucirc": 251, "uuml": 252,
    "yacute": 253, "thorn": 254, "yuml": 255, "ndash": 8211, "mdash": 8212, "lsquo": 8216,
    "rsquo": 8217, "ldquo": 8220, "rdquo": 8221, "bull": 8226, "hellip": 8230, "euro": 8364,
}
# Elements whose begin or end closes an open paragraph.
BLOCKS = (
    "p", "div", "ul", "ol", "dl", "table", "pre", "form", "hr", "blockquote", "article",
    "section", "aside", "header", "footer", "nav", "main", "body", "html", "h[1-6]",
)

_ATTRIBUTES = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
_NOT_TEXT = r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s>/]).*?(?:</\1\s*>|\z)"
_TAG = rf"(?s)</?[A-Za-z]{_ATTRIBUTES}>|<[!?][^>]*+>"


def unescape(text: Column) -> Column:
    """Named and numbered character references as characters; unknown ones stay as they are.

    The text is cut at each `&`, so that one pass decodes every reference once.
    A number that is no character gives the replacement character.
    """
    names = F.create_map(
        *[F.lit(v) for name, code in NAMED_CHARACTERS.items() for v in (name, chr(code))]
    )

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*);", 1)
        decimal = F.regexp_extract(part, "^#0*([0-9]{1,7});", 1)
        hexadecimal = F.regexp_extract(part, "^#[xX]0*([0-9A-Fa-f]{1,6});", 1)
        number = F.when(decimal != "", decimal.try_cast("int")).when(
            hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("int")
        )
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        wide = F.unhex(F.lpad(F.hex(number), 8, "0"))
        character = F.when(valid, F.decode(wide, "UTF-32")).when(number.isNotNull(), "\ufffd")
        found = F.coalesce(character, F.when(name != "", F.try_element_at(names, name)))
        rest = F.substr(part, F.instr(part, ";") + 1)
        return F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.when(~text.contains("&"), text).otherwise(
        F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))
    )


def element_text(page: Column, tag: str, closed_by: Sequence[str] = ()) -> Column:
    """Text of the first element of a tag, without the tags inside it; empty if there is none.

    `page` has no comments any more. The element ends at its end tag, or where
    an element of `closed_by` begins or ends. A line break counts as a space.
    """
    end = rf"</{tag}\s*>|\z"
    if closed_by:
        end = rf"</?(?:{'|'.join(closed_by)})(?=[\s>/])|{end}"
    inner = F.regexp_extract(page, rf"(?is)<{tag}(?=[\s>/]){_ATTRIBUTES}>(.*?)(?:{end})", 1)
    broken = F.regexp_replace(inner, r"(?i)<br\s*/?>", " ")
    return unescape(F.regexp_replace(broken, _TAG, ""))


def page_fields(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Title, summary and link of each stored page.

    The summary is the first paragraph. Comments, scripts and styles are no
    text; tags inside a field are dropped and character references decoded. A
    field that is missing is empty.
    """
    return (
        pages.withColumn("__page", F.regexp_replace(F.col(html), _NOT_TEXT, ""))
        .withColumns(
            {
                "title": element_text(F.col("__page"), "title"),
                "summary": element_text(F.col("__page"), "p", BLOCKS),
                "href": F.col(url),
            }
        )
        .drop("__page")
    )


#: Characters of the pieces by which a table of keywords is found.
GRAM = 3
#: Pieces whose lookup table every task may hold.
GRAM_LIMIT = 1_000_000
#: Keywords up to which testing a text for each costs less than taking its pieces.
TESTED_KEYWORDS = 500


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def table_matches(texts: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """One row per text and keyword it contains, for keywords that are rows of a table.

    Upper and lower case are alike; a keyword matches anywhere in a text. Every
    text is tested for each of up to TESTED_KEYWORDS keywords. Of more, each
    keyword is filed under the one of its pieces of GRAM characters that fewest
    texts have (shorter keywords under themselves); texts meet only the keywords
    filed under pieces they have, and a search for the whole keyword decides.
    Then the pieces of equal texts are taken once. Null and empty keywords match
    nothing.
    """
    shared_folder(texts.sparkSession)
    words = keywords.select("keyword").filter(F.length("keyword") > 0).distinct()
    words = words.withColumn("__word", F.lower("keyword")).withColumn(
        "__size", F.least(F.length("__word"), F.lit(GRAM))
    ).checkpoint()  # as many rows as keywords
    if words.limit(TESTED_KEYWORDS + 1).count() <= TESTED_KEYWORDS:
        lowered = texts.withColumn("__lower", F.lower(F.col(text)))
        tested = F.broadcast(words.select("keyword", "__word"))
        met = lowered.join(tested, F.col("__lower").contains(F.col("__word")))
        return met.select(*[texts[f"`{c}`"] for c in texts.columns], tested["keyword"])
    sizes = sorted(r[0] for r in words.select("__size").distinct().collect())
    by_size = F.when(F.col("__size") == sizes[0], _grams(F.col("__word"), sizes[0]))
    for size in sizes[1:]:
        by_size = by_size.when(F.col("__size") == size, _grams(F.col("__word"), size))
    filed = words.select("keyword", "__word", F.explode(by_size).alias("__gram"))
    lowered = texts.withColumn("__lower", F.lower(F.col(text))).withColumn(
        "__mark", F.md5(F.col("__lower").cast("binary"))
    )
    distinct = lowered.select("__mark", "__lower").filter(F.col("__lower").isNotNull())
    grams = F.concat(*[_grams(F.col("__lower"), size) for size in sizes])
    wanted = broadcast_if_small(filed.select("__gram").distinct(), GRAM_LIMIT)
    held = distinct.select("__mark", F.explode(grams).alias("__gram")).join(wanted, "__gram", "left_semi")
    frequency = held.groupBy("__gram").agg(F.count(F.lit(1)).alias("__texts"))
    order = F.struct(F.coalesce("__texts", F.lit(0)), F.col("__gram"))
    best = filed.join(frequency, "__gram", "left").groupBy("keyword", "__word").agg(
        F.min_by("__gram", order).alias("__gram")
    )
    best = best.checkpoint()  # as many rows as keywords
    candidates = held.join(broadcast_if_small(best, GRAM_LIMIT), "__gram").select(
        "__mark", "keyword", "__word"
    )
    met = candidates.distinct().join(lowered, "__mark")
    return met.filter(F.col("__lower").contains(F.col("__word"))).select(*texts.columns, "keyword")


def table_counts(texts: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """Number of matching texts of every keyword of a table, zero included."""
    counts = table_matches(texts, text, keywords).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return (
        keywords.select("keyword").distinct().join(counts, "keyword", "left")
        .select("keyword", F.coalesce("n", F.lit(0)).alias("n_results"))
    )


def matches(texts: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """One row per text and keyword it contains, upper and lower case alike.

    The keywords are literals of the plan: every text is lowered once and
    tested against each of them in the same pass, without a join.
    """
    lowered = texts.withColumn("__lower", F.lower(F.col(text)))
    found = F.array_compact(
        F.array(
            *[F.when(F.col("__lower").contains(k.lower()), F.lit(k)) for k in keywords]
        )
    )
    return lowered.select("*", F.explode(found).alias("keyword")).drop("__lower")


def keyword_table(spark, keywords: Sequence[str]) -> DataFrame:
    """The keywords as rows."""
    return spark.range(1).select(
        F.explode(F.array(*[F.lit(k) for k in keywords])).alias("keyword")
    )


def keyword_counts(texts: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """Number of matching texts of every keyword, zero included."""
    counts = matches(texts, text, keywords).groupBy("keyword").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        keyword_table(texts.sparkSession, keywords)
        .join(counts, "keyword", "left")
        .select("keyword", F.coalesce("n", F.lit(0)).alias("n_results"))
    )


def keywords_without_match(texts: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """Keywords found nowhere, with the message for the digest."""
    counts = keyword_counts(texts, text, keywords)
    return counts.filter(F.col("n_results") == 0).select(
        "keyword", F.lit(NOTHING_FOUND).alias("message")
    )


def first_results(found: DataFrame, position: Sequence[Column], n: int) -> DataFrame:
    """The first `n` results of each keyword, in page order.

    Spark keeps only `n` rows per keyword in each task before it shuffles.
    """
    order = Window.partitionBy("keyword").orderBy(*position)
    return found.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= n
    )


def _entry(title: Column, summary: Column, href: Column) -> Column:
    return glue("\n\n *", title, "\n\n", summary, "\n\n", "Link - ", href)


def _in_order(entry: Column) -> Column:
    """Entries of a group in page order, joined to one text."""
    sorted_entries = F.array_sort(F.collect_list(F.struct("position", entry.alias("entry"))))
    return F.array_join(F.transform(sorted_entries, lambda row: row["entry"]), "")


def single_digest(
    results: DataFrame, keyword: str, day: Column, introduction: str = INTRODUCTION
) -> DataFrame:
    """Message body for one search word: every result with title, summary, link.

    `results` holds `position`, `title`, `summary` and `href` of the shown
    results. Always one row: without results the body says so.
    """
    subject = glue(SUBJECT, long_date(day))
    entries = _in_order(_entry(F.col("title"), F.col("summary"), F.col("href")))
    body = F.when(
        F.count(F.lit(1)) == 0,
        glue(subject, f"\n\n{NOTHING_FOUND}: {keyword}."),
    ).otherwise(glue(subject, f"\n\n{introduction}\n\n", entries))
    return results.agg(body.alias("body"))


def keyword_digest(
    results: DataFrame, keywords: Sequence[str], introduction: str = INTRODUCTION
) -> DataFrame:
    """Digest block of every keyword, in the order of the keywords.

    `results` holds the first results of each keyword, so a block is bounded
    by that limit. A keyword without results gets the message.
    """
    line = glue("\n", F.col("keyword"), " - ", F.col("title"), "\n\n", "* ", F.col("href"), "\n")
    blocks = results.groupBy("keyword").agg(
        _in_order(line).alias("__block")
    )
    ordered = keyword_table(results.sparkSession, keywords).withColumn(
        "keyword_order",
        F.array_position(F.array(*[F.lit(k) for k in keywords]), F.col("keyword")),
    )
    message = glue("\n", F.col("keyword"), " - ", NOTHING_FOUND, "\n")
    return ordered.join(blocks, "keyword", "left").select(
        F.col("keyword_order").cast("bigint").alias("keyword_order"),
        "keyword",
        F.when(F.col("keyword_order") == 1, glue(introduction, "\n"))
        .otherwise("")
        .alias("header"),
        F.coalesce("__block", message).alias("body"),
    )
