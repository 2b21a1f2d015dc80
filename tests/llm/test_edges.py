"""Brute-force checks of single rules, very long texts, empty inputs and clashing names."""

import random
import re

import numpy as np
import pytest

from parcelio.llm import backoff, curriculum, disclosure, jaccard, language, lengths, pstable, quality, revisit, spaced_seeds
from parcelio.llm import tokens as T

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = [
        (EMAIL, lambda m: True),
        (IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, *m.span()) for k, (form, ok) in enumerate(tests) for m in re.finditer(form, text) if ok(m)]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(11)
    pieces = ["a", "x.y", "@", "@b.co", ".", "1", "25", "256", "10.0.0.1", "+1", "+49 (30) 123-4567", " ", "-", "(", ")", "é", "%", "4111 1111 1111 1111", "0" * 12]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert disclosure.base_spans(text) == plain_spans(text), text


def test_votes_of_the_nearest(spark, docs_of):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    text = lambda good: " ".join(word("abcdefgh" if good else "stuvwxyz") for _ in range(20))
    rows = [(i, text(i % 2)) for i in range(200)] + [(900, None), (901, ""), (902, "ab"), (None, text(1)), (3, text(1))]
    known = [(i, i % 2) for i in range(0, 200)] + [(None, 1), (7, None), (9, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    docs = docs_of(rows)
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    scores = {r.doc_id: r.score for r in got}
    for doc, t in rows[:60]:
        if doc == 3:
            continue
        data = np.frombuffer(t.encode(), np.uint8)
        (_, counts), = quality._counts(data, np.array([0, len(data)]))
        mine = quality._unit(quality._weighted(counts, model.weight) @ model.directions)[0].astype(np.float32)
        near = sorted((round(float(mine @ v), 4), float(y)) for v, y in zip(model.vectors, model.labels))[::-1][: quality.NEIGHBOURS]
        near = [(c, y) for c, y in near if c > 0]
        assert abs(scores[doc] - sum(c * y for c, y in near) / sum(c for c, _ in near)) < 0.05
    assert scores[900] == scores[901] == pytest.approx(float(model.labels.mean()))
    held = {r.doc_id: r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200}
    assert all(r.predicted == k % 2 for k, r in held.items())
    none = quality.score_quality(docs, labels.filter("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality.score_quality(docs_of([]), labels).count() == 0


def test_targets_against_resharing(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 40):
        sizes = [(f"={i:03}", f"{i:03}", rng.choice([0, 1, 7, 100, 10**6])) for i in range(n)]
        got = {r.key: r.target for r in curriculum.targets(spark.createDataFrame(sizes, "key string, source string, source_size long")).collect()}
        weight = {k: (5, 2, 1)[i % 3] for i, (k, _, _) in enumerate(sizes)}
        cap, left, want = {k: 3 * s for k, _, s in sizes}, float(sum(s for _, _, s in sizes)), {}
        while True:
            free = [k for k in cap if k not in want]
            share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
            above = [k for k in free if share[k] > cap[k]]
            if not above:
                break
            for k in above:
                want[k] = cap[k]
                left -= cap[k]
        want |= share
        assert all(abs(got[k] - want[k]) <= 1e-6 * max(1, want[k]) for k in cap)


def test_very_long_texts(spark, docs_of):
    rng = random.Random(4)
    words = [f"{rng.choice('bcdfg')}{i}" for i in range(150_000)]
    item = " ".join(f"q{i}" for i in range(20))
    close = words[:]
    for i in range(0, len(close), 60):
        close[i] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(close + item.split())), (3, "x" * 2_000_000), (4, "short text of five words")]
    rows += [(5, " ".join(words[:100_000]))]
    docs = docs_of(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got[1][0] == len(words) - 4 and got[1][1] == got[2][1] == 1 and got[5][1] == 5 and got[3] == (1, 3)
    bench = spark.createDataFrame([(8, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.first_word) for r in spaced_seeds.contaminated(docs, bench).collect()] == [(2, 8, len(words))]
    sizes = {r.doc_id: r["size"] for r in curriculum.taken(docs).collect()}
    assert sizes[1] == len(words) and sizes[3] == 1
    scored = {r.doc_id: r.n_words for r in backoff.score_documents(docs).collect()}
    assert scored == sizes
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}  # nothing to learn from
    hidden = docs_of([(1, "y " * 500_000 + "me@there.org"), (2, "9" * 500_000), (3, "@" * 300_000), (4, "+1" * 300_000)])
    found = {r.doc_id: r.spans for r in disclosure.find_private(hidden).collect()}
    assert found == {1: "email:1000000:1000012", 2: "", 3: "", 4: ""}


def test_empty_inputs(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    some, none = docs_of([(1, "a b c"), (None, None)]), docs_of([])
    for docs, items, kept in ((none, bench, 0), (some, bench.filter("false"), 2), (some, bench.selectExpr("item_id", "'' AS text"), 2)):
        assert spaced_seeds.contaminated(docs, items).count() == 0
        assert spaced_seeds.decontaminated(docs, items).count() == kept
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, key int")
    assert pstable.near_vectors(vectors).count() == 0
    only_odd = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in pstable.near_vectors(only_odd).collect()} == {(1, 0, 1), (None, 0, None)}
    records = "record_id long, kind string, url string, ts long, status int, headers map<string,string>, digest string, slice int, hit int"
    assert revisit.resolve(spark.createDataFrame([], records)).count() == 0
    row = (1, "revisit", "http://a.b/", 5, 304, None, None, 3, 4)
    assert [r.outcome for r in revisit.resolve(spark.createDataFrame([row], records)).collect()] == ["no_response"]


CLASHING = (
    "component_id", "n_shingles", "row", "terms", "mark", "size", "copies", "copy", "part", "name", "from", "lang_pred",
    "mix_position", "mix_epoch", "n_tokens", "score", "token", "n", "h", "a", "b", "spans", "word.with dot",
)


def test_clashing_names(spark, docs_of):
    docs = docs_of([(i, f"some words {i} that nobody else has at hand {i}", "xx", "s") for i in range(6)] + [(9, None, "xx", None)])
    docs = docs.selectExpr("*", *[f"cast(doc_id AS int) AS `{c}`" for c in CLASHING if c not in docs.columns])
    bench = spark.createDataFrame([(1, "w " * 12)], "item_id long, text string")
    for out in (jaccard.one_per_group(docs), spaced_seeds.decontaminated(docs, bench), disclosure.sanitised(docs), language.identified(docs)):
        assert out.columns == docs.columns
        assert all(r["n_shingles"] == r["doc_id"] for r in out.collect())
    assert jaccard.jaccard_components(docs).count() == disclosure.find_private(docs).count() == backoff.score_documents(docs).count() == 7
    assert curriculum.taken(docs).count() == lengths.encoded_lengths(docs).count() == language.identify(docs).count() == 7
    order = curriculum.training_order(docs)
    assert sorted(order.columns) == sorted(docs.columns) and all(0 < r.mix_position <= 1 for r in order.collect())


def test_hashes_of_words_do_not_depend_on_their_place():
    import pyarrow as pa

    words = lambda t: T.words_of(*T.buffer_of(pa.array(t))).hash.tolist()
    assert words(["one TWO", None, " two\tONE "]) == words(["one"]) + words(["two"]) * 2 + words(["One"])


def test_values_of_few_documents_have_telling_terms(docs_of):
    rows = [(1, "the zebra ann@one.org the")]
    rows += [(2 + i, f"the quokka bob@two.org the n{i}") for i in range(2)]
    # Each address once, all of one domain, whose term stands in all its documents and in no other.
    rows += [(10 + i, f"the wombat user{i}@same.net the") for i in range(4)]
    rest = [(100 + i, f"the rest of{i}") for i in range(100)]
    spans = lambda docs: {r.doc_id: r.spans for r in disclosure.find_private(docs_of(docs)).collect() if r.doc_id < 100}
    got = spans(rows + rest)
    # A word that stands nowhere else is no evidence; one of two texts with the value is, one of four is more.
    assert got[1] == "email:10:21"
    assert got[2] == got[3] == "email:11:22,generalise:4:10"
    assert all(got[10 + i].endswith(",remove:4:10") for i in range(4))
    # Neither exact copies nor ten times as many unrelated texts change anything.
    assert spans(rows + rows + rest) == spans(rows + rest + [(2000 + i, f"more of{i} rest{i}") for i in range(1100)]) == got
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs_of(rows + rest)).collect()}
    assert clean[1] == "the zebra <EMAIL> the" and clean[2] == "the <WORD> <EMAIL> the n0" and clean[10] == "the  <EMAIL> the"
    assert [disclosure.level(t) for t in ("Quokka", "word", "123", "a1", "Éa")] == ["NAME", "WORD", "NUMBER", "CODE", "NAME"]


def test_telling_terms_of_whole_documents(docs_of):
    far = " ".join(["the"] * 30)
    # The term is near the address in one of its documents only, and stands twice.
    texts = [f"the wombat ann@one.org {far} wombat"] + [f"wombat {far} ann@one.org {far} wombat the{i}" for i in range(3)]
    rows = list(enumerate(texts)) + [(100 + i, f"the rest of{i}") for i in range(200)]
    got = {r.doc_id: set(r.spans.split(",")) for r in disclosure.find_private(docs_of(rows)).collect()}
    for i, text in enumerate(texts):
        at, again = text.index("wombat"), text.rindex("wombat")
        assert {f"remove:{at}:{at + 6}", f"remove:{again}:{again + 6}"} <= got[i] and len(got[i]) == 3
    clean = disclosure.sanitised(docs_of(rows)).collect()
    assert not any("wombat" in r.text for r in clean) and len(clean) == len(rows)


def test_telling_terms_against_counting(docs_of):
    rng = random.Random(9)
    mail = [f"u{i}@{d}.org" for i, d in enumerate("aabbbc")]
    rows = []
    for i in range(150):
        held = rng.sample(mail, rng.choice([0, 0, 1, 3]))
        words = [f"w{rng.randint(0, 25)}" for _ in range(8)] + [f"k{m[1]}" for m in held if rng.random() < 0.9]
        rng.shuffle(words)
        rows.append((i, " ".join([*words, *held])))
    rows += rows[:20]  # equal texts count once
    distinct = sorted({t for _, t in rows})
    words = [set(re.findall(r"[a-z0-9]+", t)) for t in distinct]
    levels = lambda t: {e for m in re.findall(r"\S+@\S+", t) for e in (m, m.split("@")[1])}
    entities = [levels(t) for t in distinct]
    want = []
    for doc, text in rows:
        spans = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+@\S+", text)]
        told = []
        for m in re.finditer(r"(?<!\S)\w+(?!\S)", text):
            left = 99
            for e in levels(text):
                usual = sum(e in x for x in entities) / len(distinct)
                both = sum(e in x and m[0] in w for x, w in zip(entities, words))
                seen = (both - 0.75) / sum(m[0] in w for w in words)
                if np.log2(seen / usual) >= 1:
                    left = min(left, -np.log2(seen))
            if left <= 1:
                told.append(("remove" if left <= 1 / 3 else "generalise", *m.span()))
        want.append((doc, ",".join(spans + [f"{k}:{a}:{b}" for k, a, b in sorted(told)])))
    assert sum("remove" in s or "generalise" in s for _, s in want) > 10
    got = disclosure.find_private(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.spans) for r in got) == sorted(want)


def test_op6_counts_every_ngram(docs_of, monkeypatch):
    from parcelio.llm import queries

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 25)))) for i in range(30)]
    monkeypatch.setattr(queries, "_table", lambda *_: docs_of(rows))
    got = {r.doc_id: r.log10_score for r in queries.op6_lm_scoring(None, "").collect()}
    texts = [t.split() for _, t in rows]
    count = lambda g: sum(w[i : i + len(g)] == g for w in texts for i in range(len(w)))
    total = sum(map(len, texts))
    for (doc, _), w in zip(rows, texts):
        # Every n-gram of the corpus is known, so the longest one always scores.
        want = [count(w[max(0, i - 2) : i + 1]) / (count(w[max(0, i - 2) : i]) if i else total) for i in range(len(w))]
        assert got[doc] == pytest.approx(float(np.log10(want).sum()))


def test_any_stretch_makes_a_passage(spark, docs_of):
    rng = random.Random(12)
    for _ in range(3000):
        n, least = rng.randint(1, 30), rng.randint(1, 8)
        likely = rng.random()
        equal = np.array([rng.random() < likely for _ in range(n)])
        found = [(int(equal[a:b].sum()), a - b, -a) for a in range(n) for b in range(a + 1, n + 1)]
        found = [f for f in found if f[0] >= least and 5 * f[0] >= -4 * f[1]]
        want = max(found, default=None)
        assert spaced_seeds._best(equal, least) == (want and (want[0], -want[1], -want[2])), equal
    words = [f"w{i}" for i in range(52)]
    mine = [*words[:13], *["other"] * 6, *words[19:33], *["more"] * 6, *words[39:]]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = docs_of([(5, " ".join(mine)), (6, " ".join(words[:8] + mine[13:19] + words[8:]))])
    hits = {r.doc_id: (r.n_equal, r.n_words, r.first_word) for r in spaced_seeds.contaminated(docs, bench).collect()}
    assert hits[5] == (27, 33, 0) and hits[6] == (44, 44, 14)
    assert spaced_seeds.decontaminated(docs, bench).count() == 0


def test_short_items_are_found_by_exact_copies(spark, docs_of):
    items = {1: "What is the capital of France?", 2: "zebra", 3: "one two three four five six seven eight nine ten", 4: "?!"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [
        (1, "so, what is THE capital of France"),
        (2, "What is the great capital of France?"),
        (3, "a zebra and a Zebra"),
        (4, "zero one two three four five six seven eight nine ten eleven"),
        (5, "one two three four five six seven eight nine"),
        (6, "what is the capital"),
        (7, None),
    ]
    # No copy reaches over the end of a row.
    rows += [(8, "of France? What is the capital"), (9, "of France")]
    hits = sorted(tuple(r) for r in spaced_seeds.contaminated(docs_of(rows), bench).collect())
    assert hits == [(1, 1, 6, 6, 1), (3, 2, 1, 1, 1), (4, 3, 10, 10, 1)]
    assert sorted(r.doc_id for r in spaced_seeds.decontaminated(docs_of(rows), bench).collect()) == [2, 5, 6, 7, 8, 9]
