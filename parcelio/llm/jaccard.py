"""Jaccard join of word shingles with adaptive prefixes that must match several times.

All tokens (shingle hashes) have one global order: frequent ones last, by
frequency, the others before them by hash. A document of n tokens and length
step l keeps its first n - ceil(0.75 n) + l tokens. Two documents of at least
the wanted overlap o share at least l tokens among their first n - o + l, where
l is the smaller of their steps. A document's step grows with the estimated
number of postings that its prefix meets, so that documents of common passages
must agree in more tokens before they are compared.

The join works on classes of equal sets, and never forms all pairs of a dense
group: each prefix token first links its members to one central member; after
that only pairs from different components are formed, and of tokens with three
members or more only: with two, the central one has met them all. Such a pair
is formed only at a token that both sides can begin at: after it, each has
enough shared tokens left in the pair's own prefixes. So a member with too many
tokens of its own meets nothing, however many near copies share the others.
Only the document that stands for its class has postings.

What is counted over all documents is sent packed: sorted 40-bit values of
tokens, as compressed differences. Only postings of tokens whose value occurs
twice are sent on; a bitmap, which every task gets, tells of them. It may pass
a token too many, never one too few. Pairs are first compared by 16 bits of
each token, which can only find too much in common, then by whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelio.functions.nulls import broadcast_if_small
from parcelio.llm import tokens as T
from parcelio.llm.components import components
from parcelio.llm.shared import texts, written

#: Most tokens in the table of frequent tokens that every task gets (24 bytes each).
FREQUENT_TOKENS = 1 << 18
#: Tokens of a run of rows; those that occur once in it aren't counted.
RUN_TOKENS = 1 << 20
#: Text that is cut into shingles at a time.
PART_BYTES = 1 << 20
#: A token joins that table from this many documents on.
FREQUENT_FROM = 4
#: Largest length step.
STEP_LIMIT = 12
#: Bits of a token's value, by which tokens are counted.
VALUE_BITS = 40
#: Values that are counted at a time, about.
COUNT_TOKENS = 1 << 20
#: Bits of the largest bitmap that every task gets, as a power of two (64 MB).
MARK_BITS = 29
#: Bits of a bitmap that are told apart by one group of rows, as a power of two.
CHUNK_BITS = 20
#: Ids of dropped documents that every task may get (some 50 bytes each).
DROPPED_IDS = 1 << 21
_TOP = np.uint64(1 << 63)
_ROWS = "kind int, doc_id long, key long, n long"
_POSTINGS = "token long, key long, info long"
_PACKED = "chunk long, n long, delta binary, many binary"
_MARKS = "chunk long, bits binary"


def _batch(columns: dict[str, np.ndarray | pa.Array | list], types: list[pa.DataType]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns.values(), types)]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _value(token: np.ndarray) -> np.ndarray:
    """The evenly spread value of VALUE_BITS bits by which a token is counted."""
    return T.mix(token) >> np.uint64(64 - VALUE_BITS)


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """Non-negative numbers, compressed by their bytes of equal place."""
    plain = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return pa.compress(plain, codec="zstd", asbytes=True)


def _numbers(packed: bytes, n: int, width: int) -> np.ndarray:
    plain = np.frombuffer(pa.decompress(packed, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(plain.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.uint64)


def _counted(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and how often each occurs; empties the list to save memory."""
    every = np.concatenate(values or [np.zeros(0, np.uint64)])
    values.clear()
    every.sort()
    first = np.flatnonzero(np.diff(every, prepend=every[:1] + np.uint64(1)))
    return every[first], np.diff(first, append=len(every))


def _packed(values: list[np.ndarray], chunks: int) -> pa.RecordBatch:
    """The distinct values with their counts, a row for each of 2**chunks ranges of values."""
    value, many = _counted(values)
    chunk = value >> np.uint64(VALUE_BITS - chunks)
    begin = np.flatnonzero(np.diff(chunk, prepend=np.uint64(1 << chunks))).tolist()
    rows = [slice(a, b) for a, b in zip(begin, [*begin[1:], len(value)])]
    low = value & np.uint64((1 << (VALUE_BITS - chunks)) - 1)
    return _batch(
        {
            "chunk": chunk[begin].astype(np.int64),
            "n": [r.stop - r.start for r in rows],
            "delta": [_planes(np.diff(low[r], prepend=np.uint64(0)), 8) for r in rows],
            "many": [_planes(many[r] - 1, 4) for r in rows],
        },
        [pa.int64(), pa.int64(), pa.binary(), pa.binary()],
    )


def _unpacked(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """A chunk, its distinct values without the chunk's bits, and how often each was counted."""
    n, values, many = table.column("n").to_pylist(), [], []
    for k, delta, more in zip(n, table.column("delta").to_pylist(), table.column("many").to_pylist()):
        values.append(np.cumsum(_numbers(delta, k, 8)))
        many.append(_numbers(more, k, 4) + np.uint64(1))
    value, many = np.concatenate(values), np.concatenate(many)
    by = np.argsort(value, kind="stable")
    value, many = value[by], many[by]
    first = np.flatnonzero(np.diff(value, prepend=value[:1] + np.uint64(1)))
    return table.column("chunk")[0].as_py(), value[first], np.add.reduceat(many, first)


def _chunks(tokens: int) -> int:
    """Into how many ranges values are cut to be counted, as a power of two."""
    return min(16, max(5, (tokens // COUNT_TOKENS).bit_length()))


def _often(chunks: int):
    """`key`, `df`: the values of a chunk counted FREQUENT_FROM times or more."""

    def run(table: pa.Table) -> pa.Table:
        chunk, value, many = _unpacked(table)
        top = many >= FREQUENT_FROM
        key = value[top] | np.uint64(chunk << (VALUE_BITS - chunks))
        return pa.Table.from_batches([_batch({"key": key.view(np.int64), "df": many[top].astype(np.int64)}, [pa.int64()] * 2)])

    return run


def _marked(slots: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, bool)
    bits[slots] = True
    return np.packbits(bits).tobytes()


def _twice(chunks: int, bits: int):
    """The part of a bitmap of 2**bits for a chunk: values counted more than once."""

    def run(table: pa.Table) -> pa.Table:
        chunk, value, many = _unpacked(table)
        slots = (value[many > 1] >> np.uint64(VALUE_BITS - bits)).astype(np.int64)
        return pa.Table.from_batches([_batch({"chunk": [chunk], "bits": [_marked(slots, 1 << (bits - chunks))]}, [pa.int64(), pa.binary()])])

    return run


def _bitmap(parts: DataFrame, bits: int, chunk_bits: int) -> np.ndarray:
    """The bitmap of 2**bits bits, on the driver; its size is bounded by MARK_BITS."""
    whole, step = np.zeros(1 << (bits - 3), np.uint8), 1 << (chunk_bits - 3)
    table = parts.toArrow()
    for chunk, some in zip(table["chunk"].to_pylist(), table["bits"].to_pylist()):
        whole[chunk * step : (chunk + 1) * step] = np.frombuffer(some, np.uint8)
    return whole


def _is_marked(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0


def _parts(batches: Iterator[pa.RecordBatch], ids: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """The rows, or those whose id is marked in `ids`, in runs of about PART_BYTES of text."""
    for batch in batches:
        if ids is not None:
            batch = batch.filter(pa.array(_is_marked(ids.value, _slots(_id_values(batch.column("doc_id")), 64, ids.value))))
        yield from T.slices(batch, size=PART_BYTES)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: each row's id, set key and size. Kind 1: tokens that occur more than once in a run of rows."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    seen: list[np.ndarray] = []

    def repeated() -> pa.RecordBatch:
        token, many = _counted(seen)
        token, many = _value(token[many > 1]), many[many > 1]
        none = pa.nulls(len(token), pa.int64())
        return _batch({"kind": np.ones(len(token), np.int32), "doc_id": none, "key": token.view(np.int64), "n": many}, types)

    for part in _parts(batches):
        ids, sets = part.column("doc_id"), T.shingle_sets(part.column("text"))
        keys = T.set_keys(sets).view(np.int64)
        yield _batch({"kind": np.zeros(len(ids), np.int32), "doc_id": ids, "key": keys, "n": np.diff(sets.first)}, types)
        seen.append(sets.token)
        if sum(map(len, seen)) >= RUN_TOKENS:
            yield repeated()
    yield repeated()


def _step(cost: int, most: int) -> int:
    """The length step for an estimated number of postings met beyond a document's own."""
    return min(most, STEP_LIMIT, 1 + int(cost).bit_length())


def _postings(frequent: Broadcast, ids: Broadcast, chunks: int | None = None, marks: Broadcast | None = None):
    """The postings that `marks` passes, or with `chunks` the packed values of their tokens.

    `frequent`: values ascending, their rank by frequency, their frequency.
    Frequent tokens always pass. `ids`: the documents that have postings.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, df = frequent.value
        done: set[int] = set()
        values: list[np.ndarray] = []
        for part in _parts(batches, ids):
            sets = T.shingle_sets(part.column("text"))
            keys = T.set_keys(sets)
            token, cost = sets.token & ~_TOP, np.zeros(len(sets.token), np.int64)
            if len(known) and len(token):
                value = _value(sets.token)
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                hit = known[at] == value
                # Tokens of one value have one rank, and stay apart by their own bits.
                token[hit] = _TOP | rank[at[hit]].astype(np.uint64) << np.uint64(44) | token[hit] & np.uint64((1 << 44) - 1)
                cost[hit] = df[at[hit]]
            out: list[tuple[np.ndarray, int, np.ndarray]] = []
            for i, key in enumerate(keys.tolist()):
                a, b = int(sets.first[i]), int(sets.first[i + 1])
                if a == b or key in done:
                    continue
                done.add(key)
                n, by = b - a, np.argsort(token[a:b])
                need = (3 * n + 3) // 4
                base = n // 7 + 1  # where documents of its own size must meet it
                step = _step(int(cost[a:b][by[:base]].sum()), need)
                first = by[: min(n, n - need + step)]
                info = (n << 34) | (np.arange(len(first), dtype=np.int64) << 4) | step
                out.append((token[a:b][first], key, info))
            if chunks is not None:
                values += [_value(x[0][x[0] < _TOP]) for x in out]
                if sum(map(len, values)) >= RUN_TOKENS:
                    yield _packed(values, chunks)
                continue
            if marks is not None:
                passed = [(x[0] >= _TOP) | _is_marked(marks.value, _slots(_value(x[0]), VALUE_BITS, marks.value)) for x in out]
                out = [(x[0][p], x[1], x[2][p]) for x, p in zip(out, passed)]
            if out:
                lengths = [len(x[0]) for x in out]
                yield _batch(
                    {
                        "token": np.concatenate([x[0] for x in out]).view(np.int64),
                        "key": np.repeat(np.array([x[1] for x in out], np.uint64).view(np.int64), lengths),
                        "info": np.concatenate([x[2] for x in out]),
                    },
                    [pa.int64()] * 3,
                )
        if values:
            yield _packed(values, chunks)

    return emit


def _slots(value: np.ndarray, width: int, bitmap: np.ndarray) -> np.ndarray:
    """Places of values of `width` bits in a bitmap: their first bits."""
    return (value >> np.uint64(width - (len(bitmap) * 8).bit_length() + 1)).astype(np.int64)


def _smallest(chunks: int, ids: Broadcast):
    """The quarter of each distinct set's tokens with the smallest hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        found: list[np.ndarray] = []
        for part in _parts(batches, ids):
            sets = T.shingle_sets(part.column("text"))
            keys = T.set_keys(sets).tolist()
            for key, a, b in zip(keys, sets.first[:-1].tolist(), sets.first[1:].tolist()):
                if b > a and key not in done:
                    done.add(key)
                    found.append(_value(sets.token[a : a + (b - a) // 4 + 1]))
            if sum(map(len, found)) >= RUN_TOKENS:
                yield _packed(found, chunks)
        if found:
            yield _packed(found, chunks)

    return run


def _frequent(docs: DataFrame, rows: DataFrame, chunks: int, ids: Broadcast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of the most frequent tokens, at most FREQUENT_TOKENS, as arrays.

    Tokens with small hashes, which prefixes by hash alone would hold, are
    all counted; of the others, those that occur once in a run of rows are
    not counted, so a count may be too low by one for each run. The order is the
    same everywhere all the same, which is all that the result depends on.
    """
    exact = docs.mapInArrow(_smallest(chunks, ids), _PACKED).groupBy("chunk").applyInArrow(_often(chunks), "key long, df long")
    none = F.lit(None).cast("long")
    # Both are grouped at once, so that what the runs have isn't sent twice.
    counted = exact.select("key", "df", none.alias("n")).unionAll(rows.filter("kind = 1").select("key", none.alias("df"), "n"))
    counted = counted.groupBy("key").agg(F.max("df").alias("df"), F.sum("n").alias("n"))
    counted = counted.select("key", F.greatest("df", F.when(F.col("n") >= FREQUENT_FROM, F.col("n"))).alias("df")).filter("df IS NOT NULL")
    top = counted.orderBy(F.desc("df"), "key").limit(FREQUENT_TOKENS).toArrow()
    token = top["key"].to_numpy().astype(np.int64).view(np.uint64)
    df = top["df"].to_numpy().astype(np.int64)
    rank = np.arange(len(token), 0, -1, dtype=np.int64)
    by = np.argsort(token)
    return token[by], rank[by], df[by]


def _place(side: str) -> str:
    """SQL for size, position and step in a packed `info`."""
    return f"({side} >> 34)", f"((({side}) >> 4) & 1073741823)", f"({side} & 15)"


def _meets(a: str, b: str) -> str:
    """SQL: sizes allow the similarity, and both places are inside the pair's own prefixes."""
    (na, pa_, la), (nb, pb, lb) = _place(a), _place(b)
    spare = f"least({la}, {lb}) - (3 * ({na} + {nb}) + 6) div 7"
    return (
        f"4 * least({na}, {nb}) >= 3 * greatest({na}, {nb})"
        f" AND {pa_} < {na} + {spare} AND {pb} < {nb} + {spare}"
    )


def _begins(info: str, later: str, size: str, step: str) -> str:
    """SQL: this token may be a document's first in common with one of at least this size and step.

    The first `l` common tokens are inside the pair's own prefixes, so the
    `l`-th shared token from here (`later`) is so too. What holds for a larger
    document or step holds for a smaller one.
    """
    n, _, own = _place(info)
    both = f"least({own}, {step})"
    return f"coalesce(get({later}, cast({both} - 1 AS int)) < {n} + {both} - (3 * ({n} + {size}) + 6) div 7, false)"


def _with_later(mixed: DataFrame) -> DataFrame:
    """The postings with `later`: the places of this token and the next shared ones of the document, as many as a step may want."""
    place = F.expr(_place("info")[1])
    following = Window.partitionBy("key").orderBy(place).rowsBetween(Window.currentRow, STEP_LIMIT - 1)
    return mixed.withColumn("later", F.collect_list(place.cast("int")).over(following))


def _shared_enough(pairs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The pairs (`a`, `b`) that have as many tokens of `mixed` in common, inside their own prefixes, as they must."""
    place = F.expr(_place("info")[1]).alias("place")
    held = mixed.groupBy("key").agg(F.min("info").alias("info"), F.collect_list(F.struct(place, "token")).alias("held"))
    one, two = held.toDF("a", "ia", "ha"), held.toDF("b", "ib", "hb")
    (na, _, la), (nb, _, lb) = _place("ia"), _place("ib")
    spare = f"least({la}, {lb}) - (3 * ({na} + {nb}) + 6) div 7"
    inside = [f"transform(filter({h}, x -> x.place < {n} + {spare}), x -> x.token)" for h, n in (("ha", na), ("hb", nb))]
    return pairs.join(one, "a").join(two, "b").filter(f"size(array_intersect({', '.join(inside)})) >= least({la}, {lb})").select("a", "b")


def _matched(pairs: DataFrame) -> DataFrame:
    """Pairs (`a` < `b`) with how often they met, `c`, in how many tokens without other members, `two`, and `need`.

    From rows `a`, `b`, `need`, `n` (times) and `alone` (whether in tokens without other members).
    """
    met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "need", "n", "alone")
    return met.groupBy("a", "b").agg(F.sum("n").alias("c"), F.sum(F.expr("if(alone, n, 0)")).alias("two"), F.min("need").alias("need"))


def _needed(a: str, b: str) -> Column:
    """In how many tokens two documents with these `info` must meet."""
    return F.expr(f"least({_place(a)[2]}, {_place(b)[2]})")


def _postings_met(postings: DataFrame) -> DataFrame:
    """`key`, `info`, its pair with the centre (`b`, `need`; null if none), and for tokens of three members or more `token`.

    The postings are sent by token, and no further: the member with the
    fewest rarer tokens before this one is the most central. Postings that meet
    nothing are dropped; a class that comes twice may count twice among the members.
    """
    group = Window.partitionBy("token")
    order = F.expr(f"({_place('info')[1]} << 33) | shiftrightunsigned(key, 31)")
    ordered = group.orderBy("o", "key")
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = postings.repartition("token").withColumn("o", order).select(
        "token", "key", "info",
        F.first("key").over(every).alias("b"), F.first("info").over(every).alias("ib"),
        F.count("*").over(every).alias("c"), F.lag("key").over(ordered).alias("before"),
    )
    met = met.filter("c > 1 AND NOT coalesce(key = before, false)")
    met = met.withColumn("many", F.expr("c > 2")).withColumn("paired", F.expr(f"key <> b AND {_meets('info', 'ib')}"))
    return met.filter("many OR paired").select(
        "key", "info", F.expr("if(paired, b, null)").alias("b"), F.when(F.col("paired"), _needed("info", "ib")).alias("need"),
        F.expr("if(many, token, null)").alias("token"),
    )


def _compare(kind: str):
    """Pairs whose tokens, or their first bits, have enough in common; `kind` is the NumPy type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                x, y = _tokens(x, kind), _tokens(y, kind)
                if kind == "u2":
                    # Equal ones are numbered, so that as many are in common as both sides have.
                    x, y = _numbered(x), _numbered(y)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= 75 * (len(both) - same)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _tokens(stored: pa.Scalar, kind: str) -> np.ndarray:
    plain = np.frombuffer(stored.as_buffer(), np.uint8)
    if kind == "u8":
        return plain.view(np.uint64)
    n = int(plain[:4].view("<u4")[0])
    return np.cumsum(_numbers(plain[4:].tobytes(), n, 2))


def _sketch(token: np.ndarray) -> bytes:
    """The first 16 bits of every token, packed."""
    return len(token).to_bytes(4, "little") + _planes(np.diff(token >> np.uint64(48), prepend=np.uint64(0)), 2)


def _numbered(value: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.diff(value, prepend=value[:1] + np.uint64(1)))
    place = np.arange(len(value)) - np.repeat(first, np.diff(first, append=len(value)))
    return value << np.uint64(32) | place.astype(np.uint64)


def _similar(pairs: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    one = sets.select(F.col("key").alias("a"), F.col("tokens").alias("sa"))
    two = sets.select(F.col("key").alias("b"), F.col("tokens").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_compare(kind), "a long, b long").distinct()


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough; sketches are compared before."""
    likely = written(_similar(pairs, _sets_of(docs, classes, pairs, _sketch), "u2"), "likely")
    return _similar(likely, _sets_of(docs, classes, likely, np.ndarray.tobytes), "u8")


def _id_values(ids: pa.Array) -> np.ndarray:
    return T.mix(ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64))


def _id_slots(bits: int):
    """`chunk` and `slot` (within it) of each id in a bitmap of 2**bits bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = (_id_values(batch.column("rep")) >> np.uint64(64 - bits)).astype(np.int64)
            yield _batch({"chunk": slot >> CHUNK_BITS, "slot": slot & ((1 << CHUNK_BITS) - 1)}, [pa.int64()] * 2)

    return run


def _chunk_marks(table: pa.Table) -> pa.Table:
    bits = _marked(table.column("slot").to_numpy(), 1 << CHUNK_BITS)
    return pa.Table.from_batches([_batch({"chunk": [table.column("chunk")[0].as_py()], "bits": [bits]}, [pa.int64(), pa.binary()])])


def _marked_ids(ids: DataFrame) -> Broadcast:
    """A bitmap of the ids in `rep`, with 32 bits or more for each while MARK_BITS allows it. A few other ids may pass."""
    bits = min(MARK_BITS, max(CHUNK_BITS, (32 * ids.count()).bit_length()))
    parts = ids.select("rep").mapInArrow(_id_slots(bits), "chunk long, slot long").groupBy("chunk").applyInArrow(_chunk_marks, _MARKS)
    return ids.sparkSession.sparkContext.broadcast(_bitmap(parts, bits, CHUNK_BITS))


def _whole_sets(marks: Broadcast, stored: Callable[[np.ndarray], bytes]):
    """Sets of the documents whose ids are marked, each class once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in _parts(batches, marks):
            sets = T.shingle_sets(part.column("text"))
            found = {}
            for i, key in enumerate(T.set_keys(sets).view(np.int64).tolist()):
                if key not in done and sets.first[i] < sets.first[i + 1]:
                    done.add(key)
                    found[key] = stored(sets.token[sets.first[i] : sets.first[i + 1]])
            yield _batch({"key": list(found), "tokens": list(found.values())}, [pa.int64(), pa.binary()])

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, stored: Callable[[np.ndarray], bytes]) -> DataFrame:
    """`key` and `tokens` (as `stored`) of every class in `pairs`, each from the document that stands for it.

    Every task gets a bitmap of those documents' ids, with 32 bits for each, so
    that no text is sent anywhere. A few other classes may come along; the
    joins with the pairs drop them.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes, "key").select("rep")
    marks = _marked_ids(written(wanted, "wanted"))
    return written(docs.mapInArrow(_whole_sets(marks, stored), "key long, tokens binary"), "whole-sets")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, `n_shingles`, `component_id`.

    Words are runs of characters other than ASCII white space, A-Z lower-cased;
    a set holds the distinct five-word shingles, or the whole sequence if there
    are fewer words. Documents link when 100 * |A & B| >= 75 * |A | B|;
    `component_id` is the smallest id reachable. Null and blank texts have empty
    sets and link with nothing (`component_id` is their own id). Rows with equal
    sets, repeats of a row included, are one class. A null id is ignored when
    the smallest id is taken. An empty table gives no rows; other columns are
    ignored.
    """
    docs = texts(docs)
    rows = written(docs.mapInArrow(_describe, _ROWS), "sets")
    of_rows = rows.filter("kind = 0")
    send = docs.sparkSession.sparkContext.broadcast
    classes = written(of_rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
    prefixes = (classes.agg(F.sum("n")).first()[0] or 0) // 4
    chunks = _chunks(prefixes)
    ids = _marked_ids(classes)
    frequent = send(_frequent(docs, rows, chunks, ids))
    bits = min(MARK_BITS, max(chunks + 3, prefixes.bit_length() + 1))
    counted = docs.mapInArrow(_postings(frequent, ids, chunks=chunks), _PACKED).groupBy("chunk").applyInArrow(_twice(chunks, bits), _MARKS)
    marks = send(_bitmap(counted, bits, bits - chunks))
    met = written(_postings_met(docs.mapInArrow(_postings(frequent, ids, marks=marks), _POSTINGS)), "postings")

    star = met.filter("b IS NOT NULL").select(F.col("key").alias("a"), "b", "need", F.lit(1).alias("n"), F.col("token").isNull().alias("alone"))
    pairs = written(_matched(star).filter("c >= need OR two > 0"), "candidates")
    # Those that met in tokens without other members, which are looked at no more, are all compared here.
    near = written(_verified(docs, classes, pairs.select("a", "b")), "links")
    labels = components(near)

    whose = met.filter("token IS NOT NULL").select("token", "key", "info")
    whose = whose.join(labels.withColumnRenamed("node", "key"), "key", "left").repartition("token")
    whose = whose.select("token", "key", "info", F.coalesce("label", "key").alias("part"))
    group = Window.partitionBy("token")
    whose = whose.withColumns({"lo": F.min("part").over(group), "hi": F.max("part").over(group)})
    whose = written(_with_later(whose.filter("lo < hi").select("token", "key", "info", "part")), "mixed")
    size, step = F.expr(_place("info")[0]), F.expr(_place("info")[2])
    parts = whose.groupBy("token", "part").agg(
        F.min(size).alias("low"), F.max(size).alias("high"), F.min(step).alias("step"), F.count("*").alias("c"),
        F.min("info").alias("info"), F.first("later").alias("later"),  # used of single members only
        # The least that a member's place exceeds its prefix by, in sevenths, against a document without tokens.
        F.min(F.expr("7 * {1} - 4 * {0} - 7 * {2}".format(*_place("info")))).alias("over"),
    )
    pa_, pb = parts.alias("x"), parts.alias("y")
    apart = (
        pa_.join(pb, F.expr(
            "x.token = y.token AND x.part < y.part AND 4 * x.high >= 3 * y.low AND 4 * y.high >= 3 * x.low"
            " AND x.over + 3 * y.low < 0 AND y.over + 3 * x.low < 0"
            f" AND (x.c > 1 OR {_begins('x.info', 'x.later', 'y.low', 'y.step')})"
            f" AND (y.c > 1 OR {_begins('y.info', 'y.later', 'x.low', 'x.step')})"
        ))
        # `p` is the side with fewer members: it is expanded first, against the sizes of the other.
        .selectExpr(
            "x.token AS token",
            "if(x.c <= y.c, x.part, y.part) AS p",
            "if(x.c <= y.c, y.part, x.part) AS q",
            "if(x.c <= y.c, y.low, x.low) AS low",
            "if(x.c <= y.c, y.high, x.high) AS high",
            "if(x.c <= y.c, y.step, x.step) AS step",
        )
    )
    left = whose.select("token", F.col("part").alias("p"), F.col("key").alias("a"), F.col("info").alias("ia"), F.col("later").alias("ja"))
    right = whose.select("token", F.col("part").alias("q"), F.col("key").alias("b"), F.col("info").alias("ib"), F.col("later").alias("jb"))
    (na, _, la), (nb, _, lb) = _place("ia"), _place("ib")
    fits = F.expr(f"4 * {na} >= 3 * low AND 4 * high >= 3 * {na} AND {_begins('ia', 'ja', 'low', 'step')}")
    alike = F.expr(f"4 * least({na}, {nb}) >= 3 * greatest({na}, {nb}) AND {_begins('ia', 'ja', nb, lb)} AND {_begins('ib', 'jb', na, la)}")
    rest = apart.join(left, ["token", "p"]).filter(fits).join(right, ["token", "q"]).filter(alike)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(_shared_enough(rest, whose), "candidates")
    far = _verified(docs, classes, pairs)
    far = far.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
    far = far.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    bridges = written(far.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), "bridges")
    over = components(bridges).select(F.col("node").alias("label"), F.col("label").alias("top"))

    named = classes.join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("key", "rep", F.coalesce("label", "key").alias("label")).join(over, "label", "left")
    named = named.select("key", "rep", F.coalesce("top", "label").alias("top"))
    least = named.groupBy("top").agg(F.min("rep").alias("component_id"))
    final = named.join(least, "top").select("key", "component_id")
    return of_rows.join(final, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each group of linked ones, the one with the smallest id.

    Documents that link with nothing stay, blank ones too; repeats of the
    smallest id stay as they are. A group without any id stays whole. The
    columns are those of `docs`.
    """
    named = written(jaccard_components(docs), "components")
    ids = named.groupBy("doc_id").agg(F.max(F.expr("component_id IS NULL OR coalesce(doc_id = component_id, false)")).alias("kept"))
    dropped = ids.filter("NOT kept")
    null_dropped = dropped.filter("doc_id IS NULL").limit(1).count() > 0
    # Fewer are dropped than stay, and without nulls an id is a plain number: texts needn't be sent by id.
    gone = broadcast_if_small(dropped.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")), DROPPED_IDS)
    stay = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    return stay.filter(docs["doc_id"].isNotNull()) if null_dropped else stay
