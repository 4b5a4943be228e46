import hashlib
from collections import Counter

import numpy as np
from helpers import awkward, documents, named_like_internals, words
from hypothesis import given, settings
from hypothesis import strategies as st

from secstream.llm import fair_mix, winnowing


def test_mix_meets_targets_and_limits(spark):
    rows = [(i, words("w", 1 + i % 7), "en", src) for i, src in enumerate(["big"] * 300 + ["mid"] * 100 + ["tiny"] * 5 + [None] * 60)]
    rows = fair_mix.mix_plan(documents(spark, rows)).collect()
    assert len(rows) == 465 and sum(r.taken for r in rows) <= sum(r.size for r in rows)
    targets, taken, sizes = {}, Counter(), {}
    for r in rows:
        targets[r.source_size] = r.target
        taken[r.source_size] += r.taken
        sizes[r.source_size] = r.source_size
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    for s, target in targets.items():
        assert target <= 3 * s + 1e-9 and abs(taken[s] - target) <= 2 * 7


def brute_targets(sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    target, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > 3 * sizes[i]]
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / total
            break
        for i in over:
            target[i] = 3 * sizes[i]
            rest -= target[i]
            open_.remove(i)
    return target


def test_targets_equal_resharing(spark):
    for sizes in ([5, 1, 100, 3, 0, 7], [1, 1, 1], [1000, 1, 1, 1, 1], [0, 0]):
        df = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, __size bigint")
        got = [r["__target"] for r in fair_mix.source_targets(df).orderBy("__rank").collect()]
        assert np.allclose(got, brute_targets(sizes))


def test_mix_awkward_rows_and_rerun(spark):
    docs = named_like_internals(awkward(spark))
    a, b = (sorted(map(repr, fair_mix.mix_plan(docs).collect())) for _ in range(2))
    assert a == b and len(a) == docs.count()
    assert fair_mix.mix_plan(documents(spark, [])).count() == 0
    assert fair_mix.mix_plan(documents(spark, [(1, None, "en", None), (2, " ", "en", "a")])).count() == 2
    mixed = fair_mix.mix(docs)
    assert mixed.columns == docs.columns
    plan = Counter()
    for r in fair_mix.mix_plan(docs).collect():
        if r.size:
            plan[r.doc_id] += r.taken // r.size
    assert Counter(r.doc_id for r in mixed.collect()) == +plan


def brute_print(text, k=winnowing.GRAM, w=winnowing.SPAN):
    points = [ord(c) for c in text]
    if not points:
        return []
    k = min(k, len(points))
    hashes = [int(winnowing.gram_hashes(np.array(points[i:i + k], np.uint32), k)[0]) for i in range(len(points) - k + 1)]
    chosen = []
    for start in range(max(1, len(hashes) - w + 1)):
        window = range(start, min(start + w, len(hashes)))
        best = min(window, key=lambda i: (hashes[i], -i))
        if not chosen or chosen[-1] != (hashes[best], best):
            chosen.append((hashes[best], best))
    return chosen


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\U0001F600", max_size=120))
def test_winnowing_against_brute_force(text):
    hashes, places = winnowing.fingerprint(text)
    assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == brute_print(text)
    again = winnowing.from_string(winnowing.as_string((hashes, places)))
    assert (again[0] == hashes).all() and (again[1] == places).all()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefg ", max_size=90), st.text(alphabet="hijklm ", min_size=35, max_size=60), st.text(alphabet="nopqr ", max_size=90))
def test_shared_passage_is_always_found(before, passage, after):
    one, two = winnowing.fingerprint(before + passage)[0], winnowing.fingerprint(passage + after)[0]
    assert np.intersect1d(one, two).size


def test_edit_report_against_brute_force(spark):
    docs = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(rows, reverse=True)
    for per_range in (1, 3, 1000):
        got = winnowing.edit_report(docs, rows_per_range=per_range).collect()
        assert sorted(r.doc_id for r in got) == sorted(rows)
        for r in got:
            text, after = rows[r.doc_id], rows[order[(order.index(r.doc_id) + 1) % len(order)]]
            half = len(text) // 2
            changed = text[:len(text) - half] + after[:half]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert r.fingerprint == winnowing.as_string(winnowing.fingerprint(text))
            assert r.edited_fingerprint == winnowing.as_string(winnowing.fingerprint(changed))
            a, b = set(winnowing.fingerprint(text)[0].tolist()), set(winnowing.fingerprint(after)[0].tolist())
            assert abs(r.near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


def test_edit_report_awkward_rows(spark):
    docs = named_like_internals(awkward(spark))
    assert winnowing.edit_report(docs, rows_per_range=2).count() == docs.count()
    assert winnowing.edit_report(documents(spark, [])).count() == 0
    assert winnowing.edit_report(documents(spark, [(None, "x", "en", "a"), (None, "y", "en", "a")])).count() == 2
    one = winnowing.edit_report(documents(spark, [(5, "only one", "en", "a")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
