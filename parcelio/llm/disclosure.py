"""Personal data, and the terms of the corpus that give it away.

Personal data is found by fixed patterns. A term tells of a protected value by
what it leaves unknown of it: the bits of information, -log2 P(value | term),
estimated from the texts in which both stand. Where little is left the term is
generalised, where next to nothing is left it is removed; it must also say more
than the value's own frequency does. The estimate depends on the texts of the
term alone, so it is the same in a large corpus as in a small one, and equal
texts count once. Most values stand in one or two texts, so no count is cut
off; it is discounted instead, and each value also counts with others at its
level: the domain of an address, the prefix of a number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelio.functions.nulls import broadcast_if_small
from parcelio.llm import tokens as T
from parcelio.llm.shared import ship, written

KINDS = ("email", "ip", "card", "phone")
#: Taken off the texts in which term and value meet: what one more text could show.
DISCOUNT = 0.75
#: Bits of the value that a term leaves unknown, up to which it is generalised or removed.
GENERALISE_BITS = 1.0
REMOVE_BITS = 1 / 3
#: Bits that a term must say beyond how frequent the value is.
LEAST_GAIN = 1.0
#: Pairs of value and term that a task hands on at a time, about.
PAIRS = 1 << 18
#: Marks of repeated texts that every task may get (some 50 bytes each).
REPEATED_LIMIT = 1 << 18
#: Terms that a task looks for, at most (8 bytes each); with more, all terms are counted.
TERM_LIMIT = 1 << 18
#: Telling pairs of value and term that every task may get (some 80 bytes each).
TOLD_LIMIT = 1 << 18
#: Numbers of texts with telling terms that every task may get (some 50 bytes each).
TELLING_TEXTS = 1 << 21

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        after = _DOMAIN.match(text, at + 1) if start < at else None
        if after:
            yield start, after.end()
            free = after.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind (place in KINDS), start and end in code points, by kind and start."""
    spans = [(0, a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                spans.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                spans.append((3, *m.span()))
    return spans


def _candidates(column: pa.Array) -> np.ndarray:
    """Rows that may hold personal data: an @ or a digit in them."""
    data, offsets = T.buffer_of(column)
    sign = np.flatnonzero((data == 64) | ((data >= 48) & (data <= 57)))
    return np.unique(np.searchsorted(offsets, sign, side="right") - 1)


def _entities(kind: int, value: str) -> tuple[int, int]:
    """The value, and the level at which it recurs: domain, network, issuer, or number without its last four digits."""
    if kind < 2:
        value = value.lower()
        level = value.rpartition("@" if kind == 0 else ".")[2 if kind == 0 else 0]
    else:
        value = re.sub("[^0-9]", "", value)
        level = value[:6] if kind == 2 else value[:-4]
    return _named(f"{kind}:{value}"), _named(f"{kind} in {level}")


def _named(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with personal data."""
    for batch in batches:
        some = batch.take(pa.array(_candidates(batch.column("text")), pa.int64()))
        yield some.filter(pa.array([bool(base_spans(t)) for t in some.column("text").to_pylist()], pa.bool_()))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`mark`, `n`, `entity`: each text's distinct values and their levels."""
    for batch in batches:
        rows, held = [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            found = {e for kind, a, b in base_spans(text) for e in _entities(kind, text[a:b])}
            rows += [row] * len(found)
            held += sorted(found)
        part = batch.select(["mark", "n"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.int64())], ["mark", "n", "entity"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`mark`, `class`, `n_value`, `term`, `n`: each text's classes of values with each of its distinct words."""
    for batch in (part for batch in batches for part in T.slices(batch)):
        words = T.words_of(*T.buffer_of(batch.column("text")), T.AT_MARK)
        begin = np.searchsorted(words.row, np.arange(batch.num_rows + 1))
        out, many = [], 0
        for row, classes in enumerate(batch.column("classes").to_pylist()):
            terms = np.unique(words.hash[begin[row] : begin[row + 1]]).view(np.int64)
            names = np.array([(c["class"], c["n_value"]) for c in classes], np.int64)
            step = max(1, PAIRS // max(1, len(terms)))
            for k in range(0, len(names), step):
                some = names[k : k + step]
                out.append((np.full(len(some) * len(terms), row), np.repeat(some, len(terms), axis=0), np.tile(terms, len(some))))
                many += len(some) * len(terms)
                if many >= PAIRS:
                    yield _pair_batch(batch, out)
                    out, many = [], 0
        if out:
            yield _pair_batch(batch, out)


def _pair_batch(batch: pa.RecordBatch, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    row, names, term = (np.concatenate(x) for x in zip(*parts))
    mark, n = batch.select(["mark", "n"]).take(pa.array(row)).columns
    names = np.ascontiguousarray(names.T)
    return pa.RecordBatch.from_arrays([mark, pa.array(names[0]), pa.array(names[1]), pa.array(term), n], ["mark", "class", "n_value", "term", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`mark` and `terms`: every place of a text's telling terms that is not in a base span, by kind and start."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        out = []
        for text, told in zip(batch.column("text").to_pylist(), batch.column("told").to_pylist()):
            data, offsets = T.buffer_of(pa.array([text]))
            words = T.words_of(data, offsets, T.AT_MARK)
            points = np.flatnonzero((data & 0xC0) != 0x80)
            start, end = np.searchsorted(points, words.start), np.searchsorted(points, words.end)
            free = np.ones(len(start), bool)
            for _, a, b in base_spans(text):
                free[np.searchsorted(end, a, side="right") : np.searchsorted(start, b)] = False
            kinds = {t["term"]: t["kind"] for t in told}
            where = np.flatnonzero(free & np.isin(words.hash.view(np.int64), np.array(list(kinds), np.int64)))
            term = words.hash[where].view(np.int64).tolist()
            found = sorted(zip((kinds[t] for t in term), start[where].tolist(), end[where].tolist()))
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
        yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(out, pa.list_(span))], ["mark", "terms"])


def _document_counts(wanted: np.ndarray | None):
    """In how many rows of a slice each term occurs, each row with its `weight`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in T.slices(batch)):
            words = T.words_of(*T.buffer_of(batch.column("text")), T.AT_MARK)
            weight = batch.column("weight").to_numpy()
            term, row = words.hash, words.row
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, term), max(len(wanted) - 1, 0))
                hit = wanted[at] == term if len(wanted) else np.zeros(len(term), bool)
                term, row = term[hit], row[hit]
            _, first = np.unique(T.mix(term + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            row = row[first]
            term, number = np.unique(term[first], return_inverse=True)
            many = np.bincount(number, weights=weight[row], minlength=len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(many)], ["term", "n"])

    return run


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.md5(text.cast("binary")).alias("mark"))


def telling_terms(docs: DataFrame) -> DataFrame:
    """`mark` (md5 of a text) and `terms`: its telling terms as structs of kind, start and end.

    All counts are of whole texts, over the whole table, equal texts once; a
    term that tells of a value is marked wherever it stands in the value's texts
    outside base spans. Kinds are `generalise` and `remove`. A value's share of
    a term's texts is estimated by absolute discounting: a term of a single text
    tells too little, one of two texts that both hold the value is generalised,
    one of four such texts is removed. A value that half of all texts hold has
    no telling terms. Unrelated texts change nothing, but for making a frequent
    value rarer.
    """
    rows = _marked(docs)
    ship(docs.sparkSession)
    texts = rows.select("mark", "text").mapInArrow(_holding, "mark string, text string")
    texts = written(texts.groupBy("mark").agg(F.lit(1).cast("long").alias("n"), F.first("text").alias("text")), "private-texts")
    found = written(texts.mapInArrow(_values, "mark string, n long, entity long"), "values")
    # Values of the same documents have the same counts with every term: one class stands for them.
    first, second = (F.bit_xor(F.xxhash64("mark", F.lit(k))) for k in (1, 2))
    values = found.groupBy("entity").agg(F.sum("n").alias("n_value"), F.xxhash64(first, second, F.count("*")).alias("class"))
    classes = found.join(values, "entity").groupBy("mark", "class").agg(F.first("n_value").alias("n_value"))
    classes = classes.groupBy("mark").agg(F.collect_list(F.struct("class", "n_value")).alias("classes"))
    held = written(texts.join(classes, "mark"), "held")
    pairs = held.mapInArrow(_pairs, "mark string, class long, n_value long, term long, n long")
    both = pairs.groupBy("class", "term").agg(F.sum("n").alias("n_both"), F.first("n_value").alias("n_value"))
    both = written(both, "pairs")
    copies = written(rows.groupBy("mark").agg(F.count("*").alias("n")), "copies")
    total = copies.count()
    wanted = both.select("term").distinct().orderBy("term").limit(TERM_LIMIT + 1).toArrow()["term"].to_numpy()
    known = None if len(wanted) > TERM_LIMIT else np.sort(wanted.astype(np.int64).view(np.uint64))
    # All rows are counted, and what repeats of a text add is taken off again.
    repeated = broadcast_if_small(copies.filter("n > 1"), REPEATED_LIMIT)
    repeats = rows.select("mark", "text").join(repeated, "mark").groupBy("mark").agg(F.first("text").alias("text"), (1 - F.first("n")).alias("weight"))
    parts = (rows.select("text", F.lit(1).cast("long").alias("weight")), repeats.select("text", "weight"))
    counted = [part.mapInArrow(_document_counts(known), "term long, n long") for part in parts]
    counts = counted[0].unionAll(counted[1]).groupBy("term").agg(F.sum("n").alias("n_term"))
    chance = (F.col("n_both") - DISCOUNT) / F.col("n_term")
    unknown = -F.log2(chance)
    gain = F.log2(chance) - F.log2(F.col("n_value") / F.lit(float(max(total, 1))))
    told = both.join(counts, "term").select("class", "term", unknown.alias("unknown"), gain.alias("gain"))
    told = told.filter((F.col("unknown") <= GENERALISE_BITS) & (F.col("gain") >= LEAST_GAIN))
    told = told.select("class", "term", F.when(F.col("unknown") <= REMOVE_BITS, "remove").otherwise("generalise").alias("kind"))
    told = broadcast_if_small(written(told, "told"), TOLD_LIMIT)
    terms = pairs.select("mark", "class", "term").join(told, ["class", "term"]).groupBy("mark", "term").agg(F.max("kind").alias("kind"))
    terms = terms.groupBy("mark").agg(F.collect_list(F.struct("term", "kind")).alias("told"))
    terms = texts.select("mark", "text").join(terms, "mark").mapInArrow(_places, "mark string, terms array<struct<kind:string,start:int,end:int>>")
    return written(terms, "terms")


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n = batch.num_rows
        many, digest, spans = np.zeros((len(KINDS), n), np.int64), [none] * n, [""] * n
        column, rows = batch.column("text"), _candidates(batch.column("text"))
        for row, text in zip(rows.tolist(), column.take(pa.array(rows, pa.int64())).to_pylist()):
            found = base_spans(text)
            for kind, _, _ in found:
                many[kind, row] += 1
            spans[row] = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)
            digest[row] = hashlib.sha256(spans[row].encode()).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), *(pa.array(x) for x in many), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
            ["doc_id", "mark", *(f"n_{k}" for k in KINDS), "base_sha256", "base"],
        )


def find_private(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, `n_email`, `n_ip`, `n_card`, `n_phone`, `base_sha256`, `spans`.

    Base spans are the leftmost non-overlapping matches of each kind that pass
    its test; spans of different kinds may overlap. `spans` has them and then
    the telling terms (`generalise`, then `remove`), each kind by start, as
    kind:start:end joined by commas, in code points. Null and empty texts have
    none. Equal texts have equal spans. An empty table gives no rows; other
    columns are ignored.
    """
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    terms = telling_terms(docs)
    rows = _marked(docs).mapInArrow(_base, f"doc_id long, mark string, {counts}, base_sha256 string, base string").join(terms, "mark", "left")
    told = F.transform("terms", lambda t: F.concat_ws(":", t["kind"], t["start"].cast("string"), t["end"].cast("string")))
    all_ = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(F.when(F.size("terms") > 0, told), ","))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", all_.alias("spans"))


def level(term: str) -> str:
    """The class of a term, which many terms share: a number, a code with digits, a capitalised name, or a word."""
    if any(map(str.isdigit, term)):
        return "NUMBER" if term.isdigit() else "CODE"
    return "NAME" if term[:1].isupper() else "WORD"


def replaced(text: str, terms: list[dict]) -> str:
    """The text with base spans as <KIND>, generalised terms as their level, and removed terms cut out."""
    spans = [(a, b, f"<{KINDS[k].upper()}>") for k, a, b in base_spans(text)]
    spans += [(t["start"], t["end"], "" if t["kind"] == "remove" else f"<{level(text[t['start'] : t['end']])}>") for t in terms]
    out, done = [], 0
    for a, b, label in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= done:
            out += [text[done:a], label]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, terms = batch.column("text").to_pylist(), batch.column("terms").to_pylist()
        rows = set(_candidates(batch.column("text")).tolist())
        new = [replaced(t, terms[i] or []) if i in rows else t for i, t in enumerate(text)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], ["row", "text"])


def sanitised(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, with personal data and telling terms replaced in `text`.

    Overlapping spans are replaced together, under the first one's label. Texts
    without personal data and null texts stay as they are; other columns, a
    length among them, are not recomputed.
    """
    terms = telling_terms(docs)
    text = F.col("text").cast("string")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(True).alias("none")]
    rows = docs.select(F.struct(*others).alias("row"), text.alias("text"))
    rows = rows.withColumn("mark", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    # Only texts with telling terms meet their terms; the others stay where they are.
    telling = broadcast_if_small(terms.select(F.xxhash64("mark").alias("number")).distinct(), TELLING_TEXTS)
    met = F.xxhash64(rows["mark"]) == telling["number"]
    told = rows.join(telling, met, "left_semi").join(terms, "mark", "left").select("row", "text", "terms")
    plain = rows.join(telling, met, "left_anti").select("row", "text", F.lit(None).cast(terms.schema["terms"].dataType).alias("terms"))
    out = plain.unionAll(told).mapInArrow(_sanitise, rows.select("row", "text").schema)
    return out.select(*[F.col("text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
