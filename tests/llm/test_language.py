"""Language identification against plain compression with every dictionary, short texts, many languages."""

import random

import pytest
import zstandard
from parcelio.llm import language, queries

SYLLABLES = {"xx": "ka lo mi ru te sa po nu".split(), "yy": "stra blenk gru wolm ft sch pf ung".split(), "zz": "aiou eau oix tion ment que elle re".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def sizes(known, text, level=5):
    """Bytes by language, straight from the library."""
    data = language.plain(text)
    blocks = [data[k : k + 4096] for k in range(0, len(data), 4096)]

    def size(words, some):
        held = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(coder.compress(b)) for b in some)

    found = {}
    for lang, words in known.items():
        found[lang] = size(words, blocks)
        if len(data.split()) < 24:
            parts = [words[k : k + 8192] for k in range(0, len(words), 8192)]
            found[lang] += sum(size(p, [data]) for p in parts) / len(parts)
    return found


@pytest.fixture
def rows():
    rng = random.Random(1)
    found = [(i, prose(rng, lang, rng.choice([1, 3, 8, 30, 400])), lang, None) for i in range(240) for lang in [rng.choice("xx yy zz".split())]]
    return found + [(500, None, "xx", None), (501, "123 !", "yy", None), (502, "", None, None), (None, prose(rng, "yy", 9), None, None)]


def test_query_against_compression_with_every_dictionary(docs_of, rows, monkeypatch):
    docs = docs_of(rows)
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    known = language.dictionaries(docs)
    got = {r.doc_id: r for r in queries.op5_language_id(None, "").collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        r = got[doc]
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        of = sizes(known, text)
        order = sorted(of.values())
        assert of[r.lang_pred] == order[0]
        assert r.score == pytest.approx(1 - order[0] / order[1]) and r.rejected == (r.score < language.MARGIN)
    right = [got[doc].lang_pred == lang for doc, text, lang, _ in rows[:240] if got[doc].held_out and len(text.split()) > 3]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)


def test_passes_over_blocks_of_languages_change_nothing(docs_of, rows, monkeypatch):
    docs = docs_of(rows)
    want = sorted(map(str, language.identify(docs).collect()))
    kept = sorted(map(str, language.identified(docs).collect()))
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 1)
    assert sorted(map(str, language.identify(docs).collect())) == want
    assert sorted(map(str, language.identified(docs).collect())) == kept
    assert sorted(map(str, language.identify(docs, language.dictionaries(docs)).collect())) == want


def test_more_than_a_thousand_labels(docs_of, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 600)
    rng = random.Random(3)
    rows = [(i, prose(rng, "xx", 30), f"dirty {i}", None) for i in range(1700)] + [(5000 + i, prose(rng, "yy", 40), "yy", None) for i in range(30)]
    docs = docs_of(rows)
    assert len(language.languages(docs)) > 1000
    some = docs.filter("doc_id >= 5000 OR doc_id < 10")
    real = language._measured(language.texts(some), docs, None, 1, False)
    assert {r.doc_id: r.best for r in real.collect() if r.doc_id >= 5000} == {5000 + i: "yy" for i in range(30)}


def test_short_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language.dictionaries(docs)
    kept = {r.doc_id for r in language.identified(docs, known).select("doc_id").collect()}
    short = [r for r in docs.collect() if r.text and 4 <= len(language.plain(r.text).split()) < 12]
    assert len(short) >= 5 and sum(r.doc_id in kept for r in short) >= 0.9 * len(short)
