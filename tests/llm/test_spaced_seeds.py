"""Every passage that the rule accepts is found; the whole query against a search over all stretches."""

import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from parcelio.llm import queries, spaced_seeds


def placements(n):
    """All ways to substitute as many of n words as the rule allows, so that the rest still makes a passage."""
    least = min(spaced_seeds.LEAST_WORDS, math.ceil(spaced_seeds.LEAST_SHARE * n))
    for wrong in range(n - least + 1):
        for places in itertools.combinations(range(n), wrong):
            yield places


def accepted(equal, n):
    """By trying all stretches."""
    least = min(spaced_seeds.LEAST_WORDS, math.ceil(0.8 * n))
    sums = [0, *itertools.accumulate(equal)]
    return any(sums[b] - sums[a] >= least and 5 * (sums[b] - sums[a]) >= 4 * (b - a) for a in range(n) for b in range(a + least, n + 1))


@pytest.mark.parametrize("n", range(11, 26))
def test_masks_hit_every_accepted_placement(n):
    masks = [[k for k, on in enumerate(m) if on == "1"] for m in spaced_seeds.MASKS]
    spans = [len(m) for m in spaced_seeds.MASKS]
    rng = random.Random(n)
    # Up to 20 percent in all places; from 18 words on a sample of those, they are too many.
    most = int(n / 5)
    cases = [places for k in range(most + 1) for places in itertools.combinations(range(n), k)]
    if len(cases) > 4000:
        cases = rng.sample(cases, 4000)
    if n < 18:
        cases = list(placements(n))
    tried = 0
    for places in cases:
        equal = [k not in places for k in range(n)]
        if accepted(equal, n):
            tried += 1
            assert any(all(equal[a + k] for k in mask) for mask, span in zip(masks, spans) for a in range(n - span + 1)), places
    assert tried > 50


def test_through_the_index():
    """The same through hashing, index and verification, for all placements in 16 words and some in others."""
    rng = random.Random(2)
    for n in (11, 13, 15, 16, 20, 25, 40):
        item = [f"w{n}x{k}" for k in range(n)]
        index = spaced_seeds._index(pa.table({"text_key": pa.array([5]), "text": [" ".join(item)]}))
        cases = list(placements(n)) if n <= 16 else [tuple(rng.sample(range(n), rng.randint(0, n // 3))) for _ in range(800)]
        cases = rng.sample(cases, min(len(cases), 900))
        rows = [" ".join(["before"] * rng.randint(0, 3) + ["other" if k in places else item[k] for k in range(n)] + ["after"] * rng.randint(0, 2)) for places in cases]
        found = {row for row, _ in spaced_seeds._passages(index, pa.array(rows))}
        want = {i for i, places in enumerate(cases) if accepted([k not in places for k in range(n)], n)}
        assert found == want and len(want) > 50


def stretches(mine, theirs):
    """Equal words and length of the best passage over all ways to lay the item on the text, or None."""
    best, n = None, len(theirs)
    if n < spaced_seeds.SHORT:
        return (n, n) if n and any(mine[a : a + n] == theirs for a in range(len(mine) - n + 1)) else None
    least = min(spaced_seeds.LEAST_WORDS, math.ceil(0.8 * n))
    for shift in range(1 - n, len(mine)):
        pairs = [(mine[k], theirs[k - shift]) for k in range(max(0, shift), min(len(mine), shift + n))]
        sums = [0, *itertools.accumulate(a == b for a, b in pairs)]
        if sums[-1] < least:
            continue
        for a in range(len(pairs)):
            for b in range(a + least, len(pairs) + 1):
                e = sums[b] - sums[a]
                if e >= least and 5 * e >= 4 * (b - a) and (best is None or (e, a - b) > (best[0], -best[1])):
                    best = (e, b - a)
    return best


def test_query_against_all_stretches(spark, docs_of, monkeypatch):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(12)]
    items = {k: [rng.choice(common) if rng.random() < 0.4 else f"i{k}w{j}" for j in range(rng.choice([3, 10, 11, 13, 16, 22, 40]))] for k in range(25)}
    items[100], items[101] = items[3], items[4][:]
    rows = []
    for doc in range(120):
        text = [rng.choice(common) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            words = list(items[rng.randrange(25)])
            share = rng.choice([0, 0.1, 0.2, 0.3])
            words = [f"s{rng.randrange(10**6)}" if rng.random() < share else w for w in words]
            a = rng.randint(0, 4) if rng.random() < 0.3 else 0
            at = rng.randint(0, len(text))
            text[at:at] = words[a:]
        rows.append((doc, rng.choice([" ", ", ", "-"]).join(text).upper() if rng.random() < 0.3 else " ".join(text)))
    rows += [(500, None), (501, ""), (None, " ".join(items[5]))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(3, " ".join(items[3])), (None, None), (900, "")], "item_id long, text string")
    tables = {"documents": docs_of(rows), "benchmark": bench}
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: tables[name])
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_words) for r in queries.op7_benchmark_decontamination(spark, "").collect()}
    want = {}
    for doc, text in rows:
        mine = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
        for k, theirs in items.items():
            if best := stretches(mine, theirs):
                want[doc, k] = best
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert len(want) > 60
    kept = sorted(str(r.doc_id) for r in spaced_seeds.decontaminated(docs_of(rows), bench).collect())
    assert kept == sorted(str(doc) for doc, _ in rows if not any(d == doc for d, _ in want))


def test_a_phrase_of_very_many_items_stays_linear():
    phrase = "please choose the right answer from the list below here"
    rows = pa.array([f"some text {k} {phrase} and more of text {k} follows here" for k in range(20)])
    took = []
    for n in (10_000, 100_000):
        texts = [f"item number {k} asks {phrase} with own words {k} x{k} y{k}" for k in range(n)]
        index = spaced_seeds._index(pa.table({"text_key": pa.array(np.arange(n)), "text": texts}))
        began = time.process_time()
        assert spaced_seeds._passages(index, rows) == {}
        took.append(time.process_time() - began)
    assert took[1] < 25 * max(took[0], 0.2)
