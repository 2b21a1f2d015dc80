"""Alignment of two tokenizers' tokens over a corpus, with counts of linked id pairs.

Every text is encoded once by both tokenizers, and the ids are written. The
first pass over them aligns each document and gathers the distinct id pairs,
whose minimal perfect hash is built slice by slice. Counts are dense vectors
indexed by this hash, added up in a tree. The second pass aligns the documents
again and looks up their pairs' counts; a looked-up key is verified.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelio.llm import lengths, perfect
from parcelio.llm import tokens as T
from parcelio.llm.shared import texts, written

BYTE_RANKS = lengths.VOCABULARY
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Longer texts are encoded in parts, cut where neither tokenizer joins anything.
PART_CHARS = 1 << 20
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Id pairs that the vocabularies allow, in each slice of the hash at most (on average over them).
SLICE_PAIRS = 1 << 22
#: Bytes of pairs and counts that one group adds up.
GROUP_BYTES = 32 << 20
#: Vectors that one step of the tree adds up.
BRANCHES = 8
#: Pairs whose counts a task holds while looking up (about 13 bytes each); more are looked up in several rounds.
HELD_PAIRS = 1 << 23
#: Bytes of text, or of token ids, that a task handles at a time.
STEP_BYTES = 1 << 21
#: Links that a task collects before it merges them.
PENDING = 1 << 22


class Coders(NamedTuple):
    """Both tokenizers; the bytes of each id's token and their number."""

    byte_level: object
    pieces: sentencepiece.SentencePieceProcessor
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    size_a: np.ndarray
    size_b: np.ndarray
    cuts: bool


def _piece_bytes(coder: sentencepiece.SentencePieceProcessor, i: int) -> bytes:
    name = coder.id_to_piece(i)
    return bytes([int(name[3:5], 16)]) if coder.is_byte(i) else name.replace("▁", " ").encode()


@lru_cache(maxsize=2)
def coders(ranks: bytes, model: bytes, pattern: str) -> Coders:
    byte_level = lengths.encoding(ranks, pattern)
    pairs = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    bytes_a = [pairs.get(i, b"") for i in range(max(pairs, default=-1) + 1)]
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    bytes_b = [_piece_bytes(pieces, i) for i in range(pieces.vocab_size())]
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (bytes_a, bytes_b))
    cuts = not any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(len(bytes_b)))
    return Coders(byte_level, pieces, bytes_a, bytes_b, size_a, size_b, cuts)


def _parts(text: str, cuts: bool) -> Iterator[str]:
    """The text without the single spaces at which it is cut."""
    done = 0
    while cuts and len(text) - done > PART_CHARS and (cut := _CUT.search(text, done + PART_CHARS)):
        yield text[done : cut.start()]
        done = cut.end()
    yield text[done:]


def encode_both(c: Coders, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a space and the text; none where the tokens' bytes aren't these."""
    none = np.zeros(0, np.int32)
    if not text:
        return none, none
    a: list[int] = []
    b: list[int] = []
    for part in _parts(text, c.cuts):
        a += lengths.encode(c.byte_level, " " + part)
        b += c.pieces.encode(part, num_threads=1)
    whole = (" " + text).encode()
    if b"".join(map(c.bytes_a.__getitem__, a)) != whole or b"".join(map(c.bytes_b.__getitem__, b)) != whole:
        return none, none
    return np.array(a, np.int32), np.array(b, np.int32)


def encoded(docs: DataFrame, ranks: bytes, model: bytes, pattern: str = lengths.PATTERN) -> DataFrame:
    """`doc_id`, `part`, `number` and the ids `a` and `b` of every row, 32 bits each; part and number name the row once written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coders(ranks, model, pattern)
        part, done = TaskContext.get().partitionId(), 0
        for batch in (cut for batch in batches for cut in T.slices(batch, size=STEP_BYTES)):
            n = batch.num_rows
            both = [encode_both(c, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(n, part, np.int64)),
                    pa.array(np.arange(done, done + n, dtype=np.int64)),
                    pa.array([a.tobytes() for a, _ in both], pa.binary()),
                    pa.array([b.tobytes() for _, b in both], pa.binary()),
                ],
                ["doc_id", "part", "number", "a", "b"],
            )
            done += n

    return texts(docs).mapInArrow(run, "doc_id long, part long, number long, a binary, b binary")


class Aligned(NamedTuple):
    """Tokens of some documents on one string of bytes, and their links in order of place."""

    a: np.ndarray
    b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    end: np.ndarray


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = T.buffer_of(column.cast(pa.large_binary()))
    return np.frombuffer(data.tobytes(), np.int32).astype(np.int64), np.diff(offsets) // 4


def align(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Each stretch between neighbouring token ends lies in one token of either kind, and is their link."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
    end = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
    link_a, link_b = np.searchsorted(end_a, end), np.searchsorted(end_b, end)
    return Aligned(a, b, end_a, end_b, link_a, link_b, n_a, n_b, end)


def _aligned(batch: pa.RecordBatch, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    (a, n_a), (b, n_b) = _ids(batch.column("a")), _ids(batch.column("b"))
    return align(a, n_a, b, n_b, size_a, size_b)


def _pairs(x: Aligned, width: int) -> np.ndarray:
    return x.a[x.link_a] * width + x.b[x.link_b]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, number = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(number, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _token_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from T.slices(batch.set_column(batch.schema.get_field_index("a"), "a", batch.column("a").cast(pa.large_binary())), "a", STEP_BYTES)


_LOCAL = "slice int, part long, keys binary, counts binary"


def local_pairs(tokens: DataFrame, size_a: np.ndarray, size_b: np.ndarray, slices: int) -> DataFrame:
    """First pass: the distinct pairs of each task and their numbers of links, by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        pending = 0
        for batch in (cut for batch in batches for cut in _token_slices(batch)):
            key, many = np.unique(_pairs(_aligned(batch, size_a, size_b), len(size_b)), return_counts=True)
            keys.append(key)
            counts.append(many)
            pending += len(key)
            if pending > PENDING:
                key, many = _summed(keys, counts)
                keys, counts, pending = [key], [many], 0
        if not keys:
            return
        key, many = _summed(keys, counts)
        part = perfect.slice_of(key, slices)
        by = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[by], np.arange(slices + 1))
        rows = [(k, by[i:j]) for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if j > i]
        task = TaskContext.get().partitionId()
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in some], pa.int32()),
                    pa.array([task] * len(some), pa.int64()),
                    pa.array([key[own].astype(np.int64).tobytes() for _, own in some], pa.binary()),
                    pa.array([many[own].astype(np.int64).tobytes() for _, own in some], pa.binary()),
                ],
                ["slice", "part", "keys", "counts"],
            )

    return tokens.select("a", "b").mapInArrow(run, _LOCAL)


def _longs(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.int64) for x in column]


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """Distinct keys of a group."""
    keys = np.unique(np.concatenate(_longs(table["keys"])))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary())})


def _built(key: tuple, table: pa.Table) -> pa.Table:
    """The hash of a slice."""
    sizes, bits, order = perfect.build(np.unique(np.concatenate(_longs(table["keys"]))))
    return pa.table({
        "slice": pa.array([key[0].as_py()], pa.int32()),
        "n": pa.array([len(order)], pa.int64()),
        "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
        "bits": pa.array([bits], pa.binary()),
        "keys": pa.array([order.astype(np.int64).tobytes()], pa.binary()),
    })


def _vector(slices: int):
    """A dense vector of the counts of a group, indexed by the slice's hash."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own, keys = right["slice"][0].as_py(), np.concatenate([*_longs(left["keys"]), np.zeros(0, np.int64)])
        index = perfect.side_by_side(slices, [(own, np.array(right["sizes"][0].as_py(), np.int64), right["bits"][0].as_py())]).index(keys)
        vector = np.bincount(index, weights=np.concatenate([*_longs(left["counts"]), np.zeros(0, np.int64)]), minlength=right["n"][0].as_py()).astype(np.int64)
        return pa.table({"slice": pa.array([own], pa.int32()), "part": pa.array([right["branch"][0].as_py()], pa.int64()), "counts": pa.array([vector.tobytes()], pa.binary())})

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = np.sum(_longs(table["counts"]), axis=0, dtype=np.int64)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def pair_counts(local: DataFrame, slices: int) -> DataFrame:
    """`slice`, `n`, `sizes`, `bits`, `keys`, `counts`: hash, keys and corpus counts of each slice, in the order of the hash."""
    most = local.groupBy("slice").agg(F.sum(F.octet_length("keys") * 2).alias("size")).agg(F.max("size")).first()[0] or 0
    branches = max(1, math.ceil(most / GROUP_BYTES))
    branch = F.pmod(F.col("part"), F.lit(branches))
    distinct, wide = local.select("slice", branch.alias("part"), "keys"), branches
    while wide > 1:
        distinct = distinct.groupBy("slice", "part").applyInArrow(_merged, "slice int, part long, keys binary")
        wide = math.ceil(wide / BRANCHES)
        distinct = distinct.withColumn("part", F.pmod(F.col("part"), F.lit(wide)))
    hashes = written(distinct.groupBy("slice").applyInArrow(_built, "slice int, n long, sizes array<long>, bits binary, keys binary"), "pair-hashes")
    spread = hashes.select("slice", "n", "sizes", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))).alias("branch"))
    counted = local.withColumn("branch", branch).groupBy("slice", "branch").cogroup(spread.groupBy("slice", "branch"))
    vectors, wide = counted.applyInArrow(_vector(slices), "slice int, part long, counts binary"), branches
    while wide > 1:
        wide = math.ceil(wide / BRANCHES)
        vectors = vectors.withColumn("part", F.pmod(F.col("part"), F.lit(wide))).groupBy("slice", "part").applyInArrow(_added, "slice int, part long, counts binary")
    return written(hashes.join(vectors.select("slice", "counts"), "slice"), "pair-counts")


class Model(NamedTuple):
    """Counts of the pairs of some slices, and the highest count of each id of the second tokenizer."""

    hash: perfect.Hash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray


def best_of(counts: DataFrame, width: int) -> np.ndarray:
    """The highest count of each id of the second tokenizer; one number for each id of its vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(width, np.int64)
        for batch in batches:
            for keys, many in zip(_longs(batch.column("keys")), _longs(batch.column("counts"))):
                np.maximum.at(best, keys % width, many)
        ids = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(best[ids])], ["id", "best"])

    rows = counts.select("keys", "counts").mapInArrow(run, "id int, best long").groupBy("id").agg(F.max("best").alias("best")).toArrow()
    best = np.zeros(width, np.int64)
    best[rows["id"].to_numpy()] = rows["best"].to_numpy()
    return best


def _blocks(counts: DataFrame) -> list[tuple[int, int]]:
    """Ranges of slices with HELD_PAIRS pairs at most (or one slice)."""
    sizes = counts.select("slice", "n").orderBy("slice").collect()
    blocks: list[tuple[int, int]] = []
    held = 0
    for row in sizes:
        if not blocks or held + row["n"] > HELD_PAIRS:
            blocks.append((row["slice"], row["slice"]))
            held = 0
        blocks[-1] = (blocks[-1][0], row["slice"])
        held += row["n"]
    return blocks or [(0, 0)]


def _model(counts: DataFrame, block: tuple[int, int], slices: int, best: np.ndarray) -> Model:
    rows = counts.filter(F.col("slice").between(*block)).toArrow()
    parts = [(k, np.array(sizes, np.int64), bits) for k, sizes, bits in zip(*(rows[c].to_pylist() for c in ("slice", "sizes", "bits")))]
    keys, many = (np.concatenate([*_longs(rows[c]), np.zeros(0, np.int64)]) for c in ("keys", "counts"))
    return Model(perfect.side_by_side(slices, parts), keys.astype(np.uint32) if not len(keys) or keys.max() < 1 << 32 else keys, many, best)


def _of_rows(values: np.ndarray, row_of: np.ndarray, rows: int) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    edges = np.searchsorted(row_of, np.arange(rows + 1))
    return sums[edges[1:]] - sums[edges[:-1]]


def _written_ids(vocabulary: int) -> np.ndarray:
    """Each id's decimal digits from the left in a row of bytes, zeros after them."""
    width = len(str(max(vocabulary - 1, 0)))
    return np.frombuffer(b"".join(str(i).encode().ljust(width, b"\0") for i in range(vocabulary)), np.uint8).reshape(vocabulary, width)


def _group_texts(x: Aligned, group_a: np.ndarray, group_b: np.ndarray, digits_a: np.ndarray, digits_b: np.ndarray, row_a: np.ndarray, row_b: np.ndarray, rows: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of every row: ids, then what follows each."""
    width = max(digits_a.shape[1], digits_b.shape[1]) + 1
    last_a = np.concatenate([group_a[1:] != group_a[:-1], [True]])
    last_b = np.concatenate([group_b[1:] != group_b[:-1], [True]])
    ends = np.concatenate([row_b[1:] != row_b[:-1], [True]])
    # Ids of the first kind stand before those of the second in a group, so each one's place follows from its group.
    place_a = np.arange(len(x.a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(x.b)) + np.searchsorted(group_a, group_b, side="right")
    cells = np.zeros((len(x.a) + len(x.b), width), np.uint8)
    cells[place_a, : digits_a.shape[1]] = digits_a[x.a]
    cells[place_a, -1] = np.where(last_a, ord("|"), ord(","))
    cells[place_b, : digits_b.shape[1]] = digits_b[x.b]
    cells[place_b, -1] = np.where(ends, 0, np.where(last_b, ord(";"), ord(",")))
    used = np.count_nonzero(cells, axis=1)
    row_of = np.empty(len(cells), np.int64)
    row_of[place_a], row_of[place_b] = row_a, row_b
    edges = np.concatenate([[0], np.cumsum(_of_rows(used, row_of, rows))]).tolist()
    flat = cells.ravel()
    text = flat[flat != 0].tobytes()
    return [text[i:j] for i, j in zip(edges[:-1], edges[1:])]


_FOUND = "doc_id long, part long, number long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def looked_up(tokens: DataFrame, model, size_a: np.ndarray, size_b: np.ndarray) -> DataFrame:
    """Second pass: aligns the documents again and looks up their pairs in a broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        digits_a, digits_b = _written_ids(len(size_a)), _written_ids(len(size_b))
        for batch in (cut for batch in batches for cut in _token_slices(batch)):
            x, rows = _aligned(batch, size_a, size_b), batch.num_rows
            pair, number = np.unique(_pairs(x, len(size_b)), return_inverse=True)
            index = m.hash.index(pair)
            known = index >= 0
            known[known] = m.keys[index[known]] == pair[known]
            many = np.zeros(len(pair), np.int64)
            many[known] = m.counts[index[known]]
            top = known & (many == m.best[pair % len(size_b)])
            row_a, row_b = np.repeat(np.arange(rows), x.n_a), np.repeat(np.arange(rows), x.n_b)
            row = row_a[x.link_a]
            both = np.intersect1d(x.end_a, x.end_b, assume_unique=True)
            group_a, group_b = np.searchsorted(both, x.end_a), np.searchsorted(both, x.end_b)
            ends = np.concatenate([group_a[1:] != group_a[:-1], np.ones(min(1, len(group_a)), bool)])
            groups = _group_texts(x, group_a, group_b, digits_a, digits_b, row_a, row_b, rows) if len(x.a) else [b""] * rows
            columns = [x.n_a, x.n_b, _of_rows(ends, row_a, rows), _of_rows(np.ones(len(row)), row, rows), _of_rows(top[number], row, rows), _of_rows(many[number], row, rows)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "part", "number")), *(pa.array(c, pa.int64()) for c in columns), pa.array(groups, pa.binary()).cast(pa.string())],
                ["doc_id", "part", "number", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
            )

    return tokens.mapInArrow(run, _FOUND)


def _file(spark: SparkSession, path: str) -> bytes:
    return lengths.read_vocabulary(spark, path)


def align_tokenizers(docs: DataFrame, ranks: str = BYTE_RANKS, model: str = PIECES, pattern: str = lengths.PATTERN) -> DataFrame:
    """One row per document: how two tokenizers' tokens lie on each other.

    Columns: `doc_id`; `n_a` and `n_b`, tokens of the byte-level tokenizer
    (a file of `ranks` and its cutting `pattern`) and of the piece tokenizer
    (`model`); `n_groups`, stretches of bytes at whose ends both have a token's
    end; `n_links`, pairs of tokens whose bytes overlap; `n_best`, links whose
    id pair has the highest corpus count of all pairs with its second id, ties
    included; `count_sum`, the corpus counts of all links' pairs; `groups`, the
    ids as `a1,a2|b1;a3|b2`. Both encode a space and the text; strings of
    special tokens are plain text. A null or empty text, and one whose tokens'
    bytes aren't the space and the text, has zeros and an empty `groups`, and
    counts nowhere. Repeated rows count each; texts may be of any length; an
    empty table gives no rows; other columns are ignored.

    The counts are held in every task while they are looked up, at most
    HELD_PAIRS of them at a time; a corpus with more pairs is gone through once
    for each such block, and the rows are added up.
    """
    spark = docs.sparkSession
    files = (_file(spark, ranks), _file(spark, model))
    c = coders(*files, pattern)
    size_a, size_b = c.size_a, c.size_b
    slices = max(1, math.ceil(len(size_a) * len(size_b) / SLICE_PAIRS))
    tokens = written(encoded(docs, *files, pattern), "tokens")
    local = written(local_pairs(tokens, size_a, size_b, slices), "local-pairs")
    counts = pair_counts(local, slices)
    best = best_of(counts, len(size_b))
    blocks = _blocks(counts)
    found = [looked_up(tokens, spark.sparkContext.broadcast(_model(counts, block, slices, best)), size_a, size_b) for block in blocks]
    one = found[0]
    if len(found) > 1:
        for more in found[1:]:
            one = one.unionAll(more.withColumn("groups", F.lit("")))
        same = [F.first(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        one = one.groupBy("part", "number").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups").alias("groups"))
    return one.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
