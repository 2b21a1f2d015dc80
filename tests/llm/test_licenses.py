"""License scans against every block and template, and against SQL."""

import random
import re

from parcelio.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plainly(text, templates=licenses.TEMPLATES):
    w = words(text)
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += here
        base |= {label} if here else set()
    labels, best = set(base), 0.0
    for start in range(0, max(1, len(w)), 32):
        block = set(w[start : start + 64])
        for sentence, label in templates:
            tokens = set(words(sentence))
            if tokens and 100 * len(tokens & block) >= 80 * len(tokens):
                labels.add(label)
                best = max(best, len(tokens & block) / len(tokens))
    score = 1.0 if places else round(best, 6)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def same(docs, rows, **more):
    got = sorted(map(str, (tuple(r) for r in licenses.scan(docs, **more).collect())))
    assert got == sorted(str((doc, *plainly(text, *more.values()))) for doc, text in rows)


ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "Under the MIT license under the mit LICENSE"), (5, "underthe mit license; under-the MIT (license)"),
    (6, "CC BY-NC 4.0, CC by NC."), (7, "apache license version 2.0 and under the mit license, apache license version 20"), (None, "cc by nc"),
    (8, "under the mıt license"), (9, "under the mit lİcense cc by nć"), (9, "cc by nc"), (9, "cc by nc"), (10, "\x00cc\x7fby\x01nc"),
    (11, "This worK is licensed under the GNU General Public Kicense, version 3"),
]


def test_odd_texts(docs_of):
    same(docs_of(ODD), ODD)


def test_planted_templates_against_all_blocks(docs_of):
    rng = random.Random(6)
    common = [w for sentence, _ in licenses.TEMPLATES for w in words(sentence)]
    rare = [f"w{i}" for i in range(50)]
    rows = list(ODD)
    for i in range(200):
        text = [rng.choice(rare if rng.random() < 0.7 else common) for _ in range(rng.choice([0, 5, 60, 150, 300]))]
        for _ in range(rng.choice([0, 1, 2])):
            notice = [w for w in words(rng.choice(licenses.TEMPLATES)[0]) if rng.random() > rng.choice([0, 0.1, 0.25])]
            at = rng.randint(0, len(text))
            text[at:at] = notice
        rows.append((100 + i, " ".join(text)))
    rows += rows[20:40]
    assert sum(plainly(t)[6] > 0 for _, t in rows) > 60
    same(docs_of(rows), rows)


def test_block_edges_and_own_templates(docs_of):
    notice = " ".join(f"t{i}" for i in range(32))
    rows = [(n, " ".join(["x"] * n + [notice] + ["y"] * (n % 7))) for n in range(0, 140)]
    same(docs_of(rows), rows, templates=((notice, "own"), ("t1 t2", "two"), ("?!", "none")))


def test_very_long_text_empty_table_and_clashing_names(docs_of):
    long = "some words " * 300_000 + "this work is licensed under the gnu general public license version 3"
    rows = [(1, long), (2, "x" * 2_000_000), (3, "under the mit license " * 50_000)]
    same(docs_of(rows), rows)
    assert licenses.scan(docs_of([])).count() == 0
    docs = docs_of([(1, "cc by nc"), (2, None)]).selectExpr("*", *[f"1 AS `{c}`" for c in ("mark", "n_words", "words", "base", "more", "a.b", "block", "p", "q")])
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == ["cc-by-nc", ""]


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Scan" in plan and not re.search("Python|Arrow|Pandas", plan)


def test_texts_are_cut_into_words_once(spark, docs_of, monkeypatch):
    plans = []
    written = licenses.written

    def seen(table, label):
        plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        return written(table, label)

    monkeypatch.setattr(licenses, "written", seen)
    same(docs_of(ODD), ODD)
    assert len(plans) == 2 and plans[0].count("split(") == 1 and "regexp_extract_all(lower" not in plans[0] + plans[1]
