from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25), st.sampled_from([(64,), (16, 32, 64)]))
def test_plan_is_a_packing(histogram, lengths):
    runs, final = packing.plan_bins(histogram, lengths)
    spans, items = defaultdict(list), defaultdict(set)
    for size, item, number, first, offset in runs:
        for k in range(number):
            spans[first + k].append((offset, offset + size))
            assert item + k not in items[size]
            items[size].add(item + k)
    assert {s: len(x) for s, x in items.items()} == histogram
    length = {b + k: x for x, many in final.items() for b, n in many for k in range(n)}
    assert set(length) == set(spans) == set(range(len(spans)))
    for b, x in spans.items():
        x.sort()
        assert x[0][0] == 0 and all(p[1] == q[0] for p, q in zip(x, x[1:])) and x[-1][1] <= length[b]
        assert length[b] == min(y for y in lengths if y >= x[-1][1])
    if lengths == (64,) and len(spans) > 1:  # any two bins of a fit algorithm hold more than one could
        assert sum(sorted(x[-1][1] for x in spans.values())[:2]) > 64


def test_table(spark):
    sizes = [5000, 2048, 1500, 548, 1000, 1000, 48, 0, None, 2049]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)] + [(1, 2048, 1)], "doc_id bigint, n_tokens bigint, bin_id int")
    rows = packing.pack(df).collect()
    per = defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
    assert set(per) == {0, 1, 2, 3, 4, 5, 6, 9}
    assert sorted((r.token_from, r.n_tokens) for r in per[0]) == [(0, 2048), (2048, 2048), (4096, 904)]
    assert Counter(r.n_tokens for r in per[1]) == {2048: 2} and len(per[9]) == 2
    used = defaultdict(list)
    for r in rows:
        used[r.bin_id].append((r.bin_offset, r.bin_offset + r.n_tokens, r.bin_length))
    for x in used.values():
        x.sort()
        assert all(a[1] == b[0] for a, b in zip(x, x[1:])) and x[-1][1] <= x[0][2] <= 2048
    assert len(used) == -(-sum(r.n_tokens for r in rows) // 2048)
    assert packing.pack(df.limit(0)).count() == 0


def test_hot_size(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 512, id % 700 + 1) as n_tokens")
    rows = packing.pack(df).collect()
    assert len(rows) == 5000
    total = sum(r.n_tokens for r in rows)
    assert len({r.bin_id for r in rows}) <= total / 2048 * 1.01 + 1
