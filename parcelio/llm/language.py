"""Language identification by compression with one dictionary per language.

Each language's dictionary is raw text of that language for zstandard. A text is
cut into blocks, every block is compressed with every dictionary, and the
language with the smallest total wins. Cutting keeps a long text from becoming
its own dictionary, so all of it counts. Whole bytes are too coarse for a short
text: it is also compressed with each part of a dictionary, and the mean counts.

Dictionaries of LANGUAGES_AT_ONCE languages go to every task; more languages are
taken in several passes, which keep the smallest and the next size of each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelio.llm.shared import ship, texts, written

#: Bytes of one language's dictionary, of one piece of it, and of one block of a text.
DICTIONARY_BYTES = 1 << 16
PIECE_CHARS = 1 << 10
BLOCK_BYTES = 1 << 12
#: A narrow margin: the saving of the best language over the next, in shares of the next.
MARGIN = 0.004
#: Texts of fewer words are also measured against dictionary parts of so many bytes.
SHORT_WORDS = 24
PART_BYTES = 1 << 13
#: Languages whose dictionaries are in every task at a time.
LANGUAGES_AT_ONCE = 64
_LETTER = r"\p{L}"


def in_training(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 3, is not 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


_PLAIN = re.sub(rb"[^a-z\x80-\xff]", b" ", bytes(range(256)))


def plain(text: str) -> bytes:
    """Lower-case letters, with one space for everything between them in ASCII."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def _learned(docs: DataFrame) -> DataFrame:
    """`lang`, `text` and a hash `h` of the rows that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.filter(F.col("lang").isNotNull() & in_training(F.col("doc_id")) & F.col("text").rlike(_LETTER))
    return rows.select("lang", "text", F.xxhash64("text", "doc_id").alias("h"))


def languages(docs: DataFrame) -> dict[str, int]:
    """The languages that can be learned with the characters they offer, most first. Only these numbers reach the driver."""
    room = F.sum(F.least(F.length("text"), F.lit(PIECE_CHARS))).alias("room")
    rooms = {r["lang"]: r["room"] for r in _learned(docs).groupBy("lang").agg(room).collect()}
    return {lang: rooms[lang] for lang in sorted(rooms, key=lambda lang: (-rooms[lang], lang))}


def dictionaries(docs: DataFrame, rooms: dict[str, int] | None = None) -> dict[str, bytes]:
    """A dictionary for each language, from a bounded sample of the labelled training rows.

    `rooms` are some of `languages`, by default all; the order is theirs.

    Of each language's rows, those whose hash falls in a share that yields about
    twice DICTIONARY_BYTES give one piece of up to PIECE_CHARS characters, taken
    at a place that the hash chooses; the pieces fill the dictionary in the
    order of their hash. Counting covers all rows; only the sample reaches the
    driver.
    """
    rooms = languages(docs) if rooms is None else rooms
    if not rooms:
        return {}
    rows = _learned(docs).filter(F.col("lang").isin(*rooms))
    spare = F.length("text") - PIECE_CHARS
    share = {lang: min(1.0, 2 * DICTIONARY_BYTES / max(1, n)) for lang, n in rooms.items()}
    shares = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
    place = F.when(spare > 0, F.pmod(F.col("h"), spare + 1)).otherwise(0).cast("int") + 1
    sample = rows.filter(F.pmod("h", F.lit(1 << 30)) < shares[F.col("lang")] * F.lit(1 << 30))
    pieces = sample.select("lang", "h", F.substr("text", place, F.lit(PIECE_CHARS)).alias("piece")).dropDuplicates(["lang", "piece"])
    found: dict[str, list[bytes]] = {lang: [] for lang in rooms}
    for r in sorted(pieces.collect(), key=lambda r: (r["lang"], r["h"], r["piece"])):
        found[r["lang"]].append(plain(r["piece"]))
    # A language whose few rows all fell outside the share still needs text.
    for lang in [lang for lang, parts in found.items() if not parts]:
        first = rows.filter(F.col("lang") == lang).select("h", F.substr("text", F.lit(1), F.lit(PIECE_CHARS)).alias("piece"))
        found[lang] = [plain(r["piece"]) for r in first.orderBy("h", "piece").limit(DICTIONARY_BYTES // PIECE_CHARS).collect()]
    return {lang: b" ".join(found[lang])[:DICTIONARY_BYTES] for lang in rooms}


def _compressor(words: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)


class _Judge:
    """The compressed sizes of one text after another."""

    def __init__(self, known: dict[str, bytes], level: int):
        self.names, self.known, self.level = list(known), known, level
        self.coders = [_compressor(known[name], level) for name in self.names]

    @cached_property
    def parts(self) -> list[list[zstandard.ZstdCompressor]]:
        return [[_compressor(w[k : k + PART_BYTES], self.level) for k in range(0, max(1, len(w)), PART_BYTES)] for w in self.known.values()]

    def __call__(self, text: str | None) -> tuple[str, float, float] | None:
        """The language of the smallest size, that size and the next one; nothing for a text without letters."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return None
        data = plain(text)
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in self.coders], float)
        if len(blocks) == 1 and data.count(b" ") < SHORT_WORDS - 1:
            sizes += [sum(len(c.compress(data)) for c in coders) / len(coders) for coders in self.parts]
        by = np.argsort(sizes, kind="stable")
        return self.names[by[0]], float(sizes[by[0]]), float(sizes[by[1]]) if len(by) > 1 else np.inf


_STATE = "best string, least double, following double"


def _measure(known: dict[str, bytes], level: int, columns: list[str]):
    """Merges the sizes of some more languages into `best`, `least` and `following`; earlier languages win ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(known, level)
        for batch in batches:
            state = list(zip(*(batch.column(c).to_pylist() for c in ("best", "least", "following"))))
            for k, text in enumerate(batch.column("text").to_pylist()):
                if found := judge(text):
                    best, least, following = state[k]
                    if best is None or found[1] < least:
                        state[k] = (found[0], found[1], min(found[2], np.inf if best is None else least))
                    else:
                        state[k] = (best, least, min(following, found[1]))
            best, least, following = zip(*state) if state else ((), (), ())
            done = {"best": pa.array(best, pa.string()), "least": pa.array(least, pa.float64()), "following": pa.array(following, pa.float64())}
            yield pa.RecordBatch.from_arrays([done[c] if c in done else batch.column(c) for c in columns], columns)

    return run


def _measured(rows: DataFrame, docs: DataFrame, known: dict[str, bytes] | None, level: int, keep_text: bool) -> DataFrame:
    """`rows` (with `text`, which is dropped unless kept), `best`, `least` and `following` after all languages."""
    ship(rows.sparkSession)
    if known is None:
        rooms = list(languages(docs).items())
        blocks = [dict(rooms[k : k + LANGUAGES_AT_ONCE]) for k in range(0, len(rooms), LANGUAGES_AT_ONCE)] or [{}]
    else:
        names = list(known)
        blocks = [names[k : k + LANGUAGES_AT_ONCE] for k in range(0, len(names), LANGUAGES_AT_ONCE)] or [[]]
    rows = rows.selectExpr("*", *[f"cast(null AS {c.split()[1]}) AS {c.split()[0]}" for c in _STATE.split(", ")])
    for number, block in enumerate(blocks):
        some = dictionaries(docs, block) if known is None else {name: known[name] for name in block}
        last = number == len(blocks) - 1
        columns = [c for c in rows.columns if c != "text" or keep_text or not last]
        rows = rows.mapInArrow(_measure(some, level, columns), rows.select(*columns).schema)
        rows = rows if last else written(rows, "languages")
    return rows


def _gain() -> Column:
    # With one language there is no next one.
    return F.when(F.col("following") == float("inf"), 0.5).otherwise(1 - F.col("least") / F.col("following"))


def identify(docs: DataFrame, known: dict[str, bytes] | None = None, level: int = 5, margin: float = MARGIN) -> DataFrame:
    """One row per document: `doc_id`, `held_out`, `lang_pred`, `score`, `rejected`.

    `known` are the dictionaries, by default learned from `docs` itself.
    `lang_pred` is the language that compresses the whole text best (on a
    tie the one with most text to learn from), or `und` if the text is null or has no letter, or if
    nothing could be learned. `score` is the share by which the best total is
    smaller than the next one (0 for `und`); `rejected` is true for `und` and
    for a share below `margin`, ties included. With a single language the score
    is 0.5. Any number of languages is taken. A null id counts as empty text for
    `held_out`. An empty table gives no rows; columns other than `doc_id`,
    `text` and `lang` are ignored.
    """
    found = _measured(texts(docs), docs, known, level, keep_text=False)
    score = F.coalesce(_gain(), F.lit(0.0))
    rejected = F.col("best").isNull() | (score < margin)
    return found.select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), F.coalesce("best", F.lit("und")).alias("lang_pred"), score.alias("score"), rejected.alias("rejected")
    )


def identified(docs: DataFrame, known: dict[str, bytes] | None = None, level: int = 5, margin: float = MARGIN) -> DataFrame:
    """The documents that `identify` doesn't reject, with all their columns."""
    # Arrow functions can't take column names with dots, which a table may have.
    plain_names = ["text" if c == "text" else f"column{k}" for k, c in enumerate(docs.columns)]
    found = _measured(docs.toDF(*plain_names), docs, known, level, keep_text=True)
    return found.filter(F.col("best").isNotNull() & (_gain() >= margin)).select(*plain_names).toDF(*docs.columns)
