"""Small fixtures against brute force; nulls, empty texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import math
import random
import re

import pytest

from parcelio.llm import backoff, curriculum, disclosure, jaccard, language, lengths, pstable, quality, revisit, spaced_seeds
from parcelio.llm.components import components

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def altered(text, k, rng=RNG):
    words = text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = "new" + str(rng.randint(0, 10**9))
    return " ".join(words)


ODD = [(None, "a null id of some words here"), (901, None), (902, ""), (903, " \t\n"), (904, "One two"), (905, "one TWO"), (904, "One two")]


def shingles(text):
    words = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((v for v in ids if v is not None), default=None) for k, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def test_jaccard_against_all_pairs(docs_of):
    base, passage = prose(150), prose(60)
    rows = [(i, altered(base, RNG.randint(0, 7))) for i in range(120)]  # a dense group around one text
    rows += [(200 + i, prose(RNG.randint(5, 40)) + " " + passage) for i in range(40)]  # a passage in common
    rows += [(300 + i, base) for i in range(10)] + [(400 + i, prose(RNG.randint(1, 9))) for i in range(20)] + ODD
    got = [tuple(r) for r in jaccard.jaccard_components(docs_of(rows)).collect()]
    assert collections.Counter(got) == collections.Counter(brute_components(rows))


def test_one_per_group_keeps_columns(docs_of):
    docs = docs_of([(3, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (4, None)])
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3)], "a long, b long")
    got = {tuple(r) for r in components(path).collect()}
    assert got == {(i, 0) for i in range(61)}


def test_vectors_against_all_pairs(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    near = [[x + rng.gauss(0, 0.02) for x in base[0]] for _ in range(25)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 8]
    rows = list(enumerate(base + near + [base[1], base[1]] + odd)) + [(None, base[2])]
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, key int")

    def cosine(u, v):
        ok = lambda x: x and len(x) == len(v or []) and all(y is not None and math.isfinite(y) for y in x) and any(x)
        if not (ok(u) and len(u) == len(v) and all(y is not None and math.isfinite(y) for y in v) and any(v)):
            return 0
        return sum(a * b for a, b in zip(u, v)) / math.sqrt(sum(a * a for a in u) * sum(b * b for b in v))

    links = [sum(cosine(u, v) >= 0.9 for j, (_, v) in enumerate(rows) if j != i) for i, (_, u) in enumerate(rows)]
    got = pstable.near_vectors(table).collect()
    assert collections.Counter((r.vec_id, r.n_links) for r in got) == collections.Counter((i, n) for (i, _), n in zip(rows, links))
    assert all(r.component_id == 0 for r in got if r.vec_id is not None and 30 <= r.vec_id < 55)


def test_backoff_against_counting(docs_of):
    rows = [(i, prose(RNG.randint(1, 60))) for i in range(40)] + ODD
    got = backoff.score_documents(docs_of(rows), cutoff=2).collect()
    assert backoff.CUTOFF == 1
    words = [[w.encode().lower() for w in (t or "").split()] for _, t in rows]
    count = collections.Counter(tuple(w[i : i + k]) for w in words for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total, want = sum(map(len, words)), []
    for (doc, _), w in zip(rows, words):
        score = 0.0
        for i in range(len(w)):
            factor = 1.0
            for k in range(min(3, i + 1), 0, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                if k == 1 or count[gram] >= 2:
                    score += math.log10(factor * count[gram] / (total if k == 1 else count[gram[:-1]]))
                    break
                factor *= 0.4
        want.append((str(doc), len(w), round(score, 6)))
    assert sorted((str(r.doc_id), r.n_words, round(r.log10_score, 6)) for r in got) == sorted(want)


def test_passages_with_substitutions(spark, docs_of):
    items = [prose(30), prose(14), "too short"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, items[0]), (None, None)], "item_id long, text string")
    rows = [
        (1, prose(40) + " " + items[0].upper() + ". " + prose(10)),
        (2, prose(20) + " " + altered(items[0], 3)),
        (3, items[1].replace(" ", ", ")),
        (4, prose(200)),
        (5, " ".join(items[0].split()[:8])),
        (6, None),
        (7, ""),
    ]
    found = spaced_seeds.contaminated(docs_of(rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 0), (2, 0), (3, 1)]
    kept = spaced_seeds.decontaminated(docs_of(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]


def test_private_data_and_telling_terms(docs_of):
    hard = "a@b c@d.e@f.gh 1.2.3.4.5 256.1.1.1 n 4111 1111-1111 1111 n +1 (555) 123-4567 n " + "9" * 3000 + " " + "x" * 5000
    rows = [(1, hard), (2, "ÄÖ ann@x.org é"), (3, None), (4, "")]
    # A rare word that always stands beside one address gives it away.
    rows += [(10 + i, f"the {prose(5)} zanzibar bob@home.net the {prose(4)}") for i in range(4)]
    rows += [(100 + i, "the " + prose(30)) for i in range(60)]
    got = {r.doc_id: r for r in disclosure.find_private(docs_of(rows)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[2].spans == "email:3:12" and got[2].base_sha256 == hashlib.sha256(b"email:3:12").hexdigest()
    assert got[3].spans == "" == got[4].spans and got[100].spans == ""
    text = rows[4][1]
    at = text.index("zanzibar")
    assert f"remove:{at}:{at + 8}" in got[10].spans.split(",")
    clean = {r.doc_id: r for r in disclosure.sanitised(docs_of(rows)).collect()}
    assert "bob@home" not in clean[10].text and "zanzibar" not in clean[10].text and "<EMAIL>" in clean[10].text
    assert clean[3].text is None and clean[100].text == rows[8][1] and clean[2].text == "ÄÖ <EMAIL> é"


def test_mix_meets_targets(docs_of):
    rows = [(i, prose(RNG.randint(1, 30)), None, RNG.choice(["a", "b", "c", "", None])) for i in range(300)]
    rows += [(900, prose(9), None, "tiny"), (901, None, None, "void"), (900, rows[0][1], None, "a")]
    got = curriculum.taken(docs_of(rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    assert all(r.taken % max(r["size"], 1) == 0 for r in got)
    by = collections.defaultdict(lambda: [0, 0])
    for r in got:
        of = by[r.source_size, r.target]
        of[0], of[1] = of[0] + r.taken, max(of[1], r["size"])
    for (size, target), (words, longest) in by.items():
        assert abs(words - target) <= longest / 2 + 1 and target <= 3 * size + 1e-9
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-6
    order = curriculum.training_order(docs_of(rows)).collect()
    assert [r.mix_position for r in order] == sorted(r.mix_position for r in order)
    assert sum(len(r.text.split()) for r in order) == sum(r.taken for r in got)
    given = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in given for r in order)
    # Line breaks and all else stay, also in the last document of each source.
    texts = [(i, f"first  line {i}\n\n second\tline ", None, "ab"[i % 2]) for i in range(11)]
    kept = curriculum.training_order(docs_of(texts)).collect()
    assert kept and all(r.text == texts[r.doc_id][1] for r in kept)


def test_lengths(spark, docs_of):
    rows = ODD + [(i, prose(RNG.randint(0, 30))) for i in range(50)]
    coded = lengths.encoded_lengths(docs_of(rows))
    many = sorted(r.n_tokens for r in coded.collect())
    coder = lengths.encoding(lengths.read_vocabulary(spark, lengths.VOCABULARY), lengths.PATTERN)
    assert many == sorted(len(coder.encode_ordinary(t or "")) for _, t in rows)
    histogram = lengths.length_histogram(coded)
    for r in histogram.collect():
        assert r.truncated_total == sum(min(r.n_tokens, n) for n in many)
        assert (r.docs_at_least, r.tokens_at_least) == (sum(n >= r.n_tokens for n in many), sum(n for n in many if n >= r.n_tokens))
    cut = lengths.at_limits(histogram, [0, 7, 10**6]).collect()
    assert {r.context_limit: r.truncated_total for r in cut} == {k: sum(min(k, n) for n in many) for k in (0, 7, 10**6)}
    assert lengths.quantiles(histogram, [0.5]) == [many[(len(many) - 1) // 2]]


def test_language(docs_of):
    rng = random.Random(1)
    of = {"xx": ["kalo", "miru", "tesa", "ponu"], "yy": ["strasch", "blenk", "gruft", "wolm"]}
    rows = [(i, " ".join(rng.choice(of[k]) for _ in range(30)), k, None) for i in range(60) for k in [("xx", "yy")[i % 2]]]
    rows += [(500, None, "xx", None), (501, "123 !", "xx", None), (502, "KALO miru", None, None), (None, "blenk gruft", None, None)]
    got = {r.doc_id: r for r in language.identify(docs_of(rows)).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows[:60])
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "xx" and got[None].lang_pred == "yy"
    kept = language.identified(docs_of(rows))
    assert kept.columns == docs_of(rows).columns and {500, 501}.isdisjoint(r.doc_id for r in kept.collect())


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.85 * len(scored)


def test_revisits(spark):
    tag = {"ETag": '"1"', "Content-Type": "text/html", "Date": "d0"}
    rows = [
        (1, "response", "HTTP://www.X.org:80/a/?b=2&a=1&utm_source=q#f", 10, 200, tag, "p1"),
        (2, "revisit", "https://x.org/a?a=1&b=2", 20, 304, {"etag": 'W/"1"', "date": "d1", "content-type": "no"}, None),
        (3, "revisit", "https://x.org/a?a=1&b=2", 10, 304, {"etag": '"1"'}, None),
        (4, "revisit", "https://x.org/a?a=1&b=2", 90000, 304, {"etag": '"2"'}, None),
        (5, "revisit", "https://x.org/a?a=1&b=2", 90000, 304, None, None),
        (6, "revisit", None, 50, 304, tag, "p1"),
        (7, "response", "https://x.org/a?a=1&b=2", 15, 404, tag, "p2"),
        (8, "revisit", "x.org/a?a=1&b=2", None, 304, tag, "p1"),
    ]
    table = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, status int, headers map<string,string>, digest string")
    got = {r.record_id: r for r in revisit.resolve(table).collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        2: "resolved", 3: "no_response", 4: "mismatch", 5: "unvalidated", 6: "no_response", 8: "no_response",
    }
    assert got[2].headers == {"etag": 'W/"1"', "date": "d1", "content-type": "text/html"} and got[2].digest == "p1"


@pytest.mark.parametrize(
    "run",
    [
        jaccard.jaccard_components, jaccard.one_per_group, lambda d: lengths.length_histogram(lengths.encoded_lengths(d)), language.identify,
        language.identified, backoff.score_documents, disclosure.find_private, disclosure.sanitised, curriculum.taken, curriculum.training_order,
    ],
)
def test_empty_table(run, docs_of):
    assert run(docs_of([])).count() == 0


def test_pipeline_and_queries(spark, sf_dir):
    import __spark_entry__ as entry
    import corpus_pipeline

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    assert "mix_position" in corpus_pipeline.run(spark, sf_dir).columns


def test_same_as_sql(spark, sf_dir):
    from compare import compare, connect
    from parcelio.llm import queries

    duck = connect(sf_dir)
    for name, sql in queries.ORACLES.items():
        assert compare(queries.QUERIES[name](spark, sf_dir), duck, sql) == "", name
