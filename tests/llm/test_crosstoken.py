"""The alignment of two tokenizers against a token-by-token count, and minimal perfect hashing."""

import base64
import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import tiktoken
from parcelio.llm import crosstoken, lengths, perfect, queries
from tokenizers import Tokenizer

FOLDER = "/opt/tokenizers"


@pytest.fixture(scope="module")
def plain():
    """Ids and token bytes of a text by either library, without this package."""
    first = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def of(text):
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        bytes_a = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return list(zip(a, bytes_a)), list(zip(b, bytes_b))

    return of


def ranges(tokens):
    at, found = 0, []
    for i, data in tokens:
        found.append((i, at, at + len(data)))
        at += len(data)
    return found


def expected(plain, rows):
    docs = []
    for doc, text in rows:
        a, b = plain(text) if text else ([], [])
        same = all(b"".join(d for _, d in x) == (" " + text).encode() for x in (a, b)) if text else False
        a, b = (ranges(a), ranges(b)) if same else ([], [])
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for cut in cuts:
            own = [",".join(str(i) for i, _, e in x if low < e <= cut) for x in (a, b)]
            groups.append("|".join(own))
            low = cut
        docs.append((doc, len(a), len(b), groups, links))
    count = collections.Counter(p for *_, links in docs for p in links)
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [
        (doc, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, n_a, n_b, groups, links in docs
    ]


PIECES = ["the ", "thing", " <|endoftext|>", "</s>", "\n\n", "   ", "ß", "日本語", "🙂", "é", "é", "12345", "don't", " a", "\t", "\x00", "ﬁ", " ", "…", "Straße ", "▁"]


def rows_of(rng, n):
    return [(i, "".join(rng.choice(PIECES[:-1] if rng.random() < 0.98 else PIECES) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def test_against_counting_token_by_token(plain, docs_of, monkeypatch):
    rng = random.Random(3)
    rows = rows_of(rng, 120) + [(900, None), (901, ""), (902, " "), (None, "no id"), (903, "a ▁ sign"), (5, "the thing"), (5, "the thing")]
    rows.append((904, "very " * 60 + "long text"))
    monkeypatch.setattr(queries, "_table", lambda *_: docs_of(rows))
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op13_cross_tokenizer_alignment(None, "").collect()]
    want = expected(plain, rows)
    assert collections.Counter(got) == collections.Counter(want)
    assert sum(w[1] > 0 for w in want) > 100 and (903, 0, 0, 0, 0, 0, 0, "") in want


def test_blocks_branches_and_cuts_change_nothing(docs_of, monkeypatch):
    rng = random.Random(4)
    docs = docs_of(rows_of(rng, 80) + [(200, "some words that go on " * 40)]).repartition(6)
    want = sorted(map(str, crosstoken.align_tokenizers(docs).collect()))
    monkeypatch.setattr(crosstoken, "HELD_PAIRS", 40)
    monkeypatch.setattr(crosstoken, "GROUP_BYTES", 50)
    monkeypatch.setattr(crosstoken, "BRANCHES", 2)
    monkeypatch.setattr(crosstoken, "SLICE_PAIRS", 1 << 28)
    assert sorted(map(str, crosstoken.align_tokenizers(docs).collect())) == want


def test_texts_cut_for_their_length_have_the_same_tokens(monkeypatch):
    files = [open(f"{FOLDER}/{name}", "rb").read() for name in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    c = crosstoken.coders(*files, lengths.PATTERN)
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice(PIECES[:-1] + ["some ", "plain words "]) for _ in range(120))
        whole = crosstoken.encode_both(c, text)
        monkeypatch.setattr(crosstoken, "PART_CHARS", 20)
        parts = crosstoken.encode_both(c, text)
        monkeypatch.setattr(crosstoken, "PART_CHARS", 1 << 20)
        assert all(np.array_equal(x, y) for x, y in zip(whole, parts))


def test_empty_table_and_clashing_names(docs_of):
    assert crosstoken.align_tokenizers(docs_of([])).count() == 0
    docs = docs_of([(1, "a b"), (2, None)]).selectExpr("*", "1 AS part", "2 AS number", "3 AS n_a", "4 AS `a.b`", "5 AS slice", "6 AS groups")
    got = crosstoken.align_tokenizers(docs).collect()
    assert {(r.doc_id, r.n_a > 0) for r in got} == {(1, True), (2, False)}
    assert crosstoken.align_tokenizers(docs_of([(1, None), (2, "")])).count() == 2


def test_perfect_hash_has_each_index_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000, 60000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        slices = 7
        part = perfect.slice_of(keys, slices)
        built = [(k, *perfect.build(keys[part == k])) for k in range(slices)]
        joined = perfect.side_by_side(slices, [(k, sizes, bits) for k, sizes, bits, _ in built])
        order = np.concatenate([o for *_, o in built])
        index = joined.index(keys)
        assert sorted(index.tolist()) == list(range(len(keys)))
        assert np.array_equal(order[index], keys)


def test_long_runs_are_encoded_like_short_ones():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb"))}
    coder = tiktoken.Encoding("own", pat_str=lengths.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    kept = lengths.RUN_LENGTH, lengths._RUN
    try:
        lengths.RUN_LENGTH = 3
        lengths._RUN = lengths.re.compile(lengths._RUN.pattern.replace("100000", "3"))
        for _ in range(2000):
            text = "".join(rng.choice([" ", "  ", "\n", "\t", " ", "\x1d", "\x85", "a", "be ", "1", "!", " "]) for _ in range(rng.randint(0, 30)))
            assert lengths.encode(coder, text) == coder.encode_ordinary(text), repr(text)
    finally:
        lengths.RUN_LENGTH, lengths._RUN = kept


def test_lengths_of_very_long_runs(spark, docs_of):
    n = 5_000_000
    rows = [(1, " " * n), (2, "\n" * n + "x"), (3, "x" * n), (4, "!" * n), (5, "a" + " \t" * (n // 2) + "b")]
    got = {r.doc_id: r.n_tokens for r in lengths.encoded_lengths(docs_of(rows)).collect()}
    coder = lengths.encoding(lengths.read_vocabulary(spark, lengths.VOCABULARY), lengths.PATTERN)
    merged = lambda t: len(coder._encode_single_piece(t))
    assert got == {1: merged(" " * n), 2: merged("\n" * (n - 1)) + 2, 3: merged("x" * n), 4: merged("!" * n), 5: 1 + merged(" \t" * (n // 2 - 1) + " ") + 2}
