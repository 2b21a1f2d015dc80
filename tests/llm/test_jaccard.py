"""Packed counts, bitmaps and sketches of the Jaccard join, and what it sends."""

import numpy as np
import pyarrow as pa

from parcelio.llm import disclosure, jaccard
from parcelio.llm import tokens as T


def tokens_of(seed, n):
    return T.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed))


def test_packed_values_come_back_with_their_counts():
    value = jaccard._value(tokens_of(5, 3000))
    runs = [value[:2000], value[1000:], value[1500:1600]]
    rows = pa.Table.from_batches([jaccard._packed([runs[0]], 5), jaccard._packed(runs[1:], 5)])
    counts = {}
    for chunk in set(rows["chunk"].to_pylist()):
        some = rows.filter(pa.compute.equal(rows["chunk"], chunk))
        number, low, many = jaccard._unpacked(some)
        counts |= {(number << 35) + v: m for v, m in zip(low.tolist(), many.tolist())}
    whole = np.concatenate(runs).tolist()
    assert counts == {v: whole.count(v) for v in set(whole)}


def test_sketches_never_lose_a_pair():
    kept = {"u2": [], "u8": []}
    stored = {"u2": jaccard._sketch, "u8": np.ndarray.tobytes}
    for kind in kept:
        pairs = []
        for i in range(200):
            n = (1, 2, 3, 4, 20, 700)[i % 6]
            a = np.sort(tokens_of(i, n) if i % 3 else tokens_of(i, n) >> np.uint64(20))
            b = np.sort(np.concatenate([a[: n - n * (i % 5) // 14], tokens_of(10_000 + i, n * (i % 4) // 14)]))
            pairs.append((i, i, stored[kind](a), stored[kind](b)))
        names = ["a", "b", "sa", "sb"]
        batch = pa.RecordBatch.from_pylist([dict(zip(names, p)) for p in pairs])
        kept[kind] = [x for out in jaccard._compare(kind)([batch]) for x in out.column("a").to_pylist()]
    assert set(kept["u8"]) <= set(kept["u2"]) and 20 < len(kept["u8"]) < 180


def test_texts_of_compared_classes_are_not_sent(spark, docs_of, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[:30] + [f"x{i // 2}", f"y{i}"])) for i in range(20)] + [(None, " ".join(words)), (None, None)]
    plans = []
    written = jaccard.written

    def seen(table, label):
        plans.append((label, table._jdf.queryExecution().executedPlan().toString()))
        return written(table, label)

    monkeypatch.setattr(jaccard, "written", seen)
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(rows)).collect() if r.doc_id is not None}
    assert set(found.values()) == {0}
    plans = [plan for label, plan in plans if label == "whole-sets"]
    assert plans and not any("Exchange" in plan or "Join" in plan for plan in plans)


def test_stages_keep_texts_where_they_are(spark, docs_of):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[i % 3 :], f"mail a{i // 2}@b.org code{i // 2}"])) for i in range(12)] + [(None, None), (20, "")]
    docs = docs_of(rows)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (jaccard.one_per_group, disclosure.sanitised):
            plan = stage(docs)._jdf.queryExecution().executedPlan().toString()
            assert "LeftAnti" in plan and "SortMergeJoin" not in plan.split("LeftAnti")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert disclosure.sanitised(docs).count() == len(rows)


def test_copies_and_pairs_are_not_sent_again(spark, docs_of, monkeypatch):
    copy = " ".join(f"w{i}" for i in range(60))
    apart = [" ".join([*(f"s{k}x{j}" for j in range(9)), *(f"d{k}y{side}z{j}" for j in range(9))]) for k in range(40) for side in (0, 1)]
    rows = [(i, copy) for i in range(16)] + [(100 + i, text) for i, text in enumerate(apart)]
    sizes = {}
    written = jaccard.written

    def seen(table, label):
        found = written(table, label)
        if label in ("postings", "mixed"):
            sizes[label] = {r.info >> 34 for r in found.select("info").collect()}
        return found

    monkeypatch.setattr(jaccard, "written", seen)
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(rows).repartition(8)).collect()}
    assert found == {i: 0 if i < 16 else i for i, _ in rows}
    assert sizes == {"postings": {14}, "mixed": set()}


def test_postings_meet_their_centre_in_one_exchange(spark):
    def info(place):
        return 40 << 34 | place << 4 | 2

    rows = [(1, 10, info(0)), (1, 11, info(1))]  # two members
    rows += [(2, 10, info(1)), (2, 11, info(0)), (2, 12, info(2)), (2, 12, info(2))]  # three, one twice
    rows += [(3, 13, info(0)), (4, 14, info(0)), (4, 14, info(0))]  # one, and one twice
    rows += [(6, 10, info(30)), (6, 11, info(0))]  # outside the pair's prefixes
    met = jaccard._postings_met(spark.createDataFrame(rows, jaccard._POSTINGS))
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(((r.key, r.b, r.need, r.token) for r in met.collect()), key=str) == sorted(
        [(11, 10, 2, None), (10, 11, 2, 2), (11, None, None, 2), (12, 11, 2, 2)], key=str
    )


def _join_rows(node):
    """How many rows each join of an executed plan made."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _join_rows(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return _join_rows(node.plan())
    found = [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
    for i in range(node.children().size()):
        found += _join_rows(node.children().apply(i))
    return found


def test_near_copies_apart_from_the_rest_of_their_group_meet_little(spark, docs_of, monkeypatch):
    draw = np.random.default_rng(7)
    base = [f"w{j}" for j in range(150)]

    def near_copy(i):
        words = list(base)
        for slot in draw.choice(13, 1 if i < 288 else 4, replace=False).tolist():
            j = 5 * slot + (10 if i < 288 else 80)
            words[j] = f"x{i}y{j}"
        return words

    copies = [near_copy(i) for i in range(300)]
    rows = []
    written = jaccard.written

    def seen(table, label):
        if label == "candidates":
            table.collect()
            rows.append(max(_join_rows(table._jdf.queryExecution().executedPlan()), default=0))
        return written(table, label)

    monkeypatch.setattr(jaccard, "written", seen)
    docs = docs_of([(i, " ".join(words)) for i, words in enumerate(copies)])
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}

    sets = [{tuple(w[j : j + 5]) for j in range(146)} for w in copies]
    wanted = list(range(300))
    for a in range(300):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if 100 * same >= 75 * (292 - same) and wanted[a] != wanted[b]:
                low, high = sorted((wanted[a], wanted[b]))
                wanted = [low if x == high else x for x in wanted]
    assert found == dict(enumerate(wanted)) and len(set(wanted)) == 13
    # Each of the twelve meets each of the others at two tokens at most, on average.
    assert len(rows) == 2 and max(rows) < 2 * 12 * 288


def test_a_pair_begins_where_enough_shared_tokens_follow(spark):
    def info(step):
        return 40 << 34 | step

    # Two documents of 40 tokens must share 35: with steps of 2, two tokens among the first 7.
    rows = [(info(2), [3, 6], 40, 2), (info(2), [3, 7], 40, 2), (info(2), [3], 40, 2), (info(9), [5, 7], 40, 1), (info(2), [3, 7], 38, 9)]
    table = spark.createDataFrame(rows, "info long, later array<int>, size long, step long")
    found = table.selectExpr(f"{jaccard._begins('info', 'later', 'size', 'step')} AS x").collect()
    assert [r.x for r in found] == [True, False, False, True, True]
