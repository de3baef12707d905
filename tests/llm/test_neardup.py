import random

import numpy as np
import pytest

from folioscope.llm import neardup

WORDS = [f"w{i}" for i in range(400)]


def _jaccard(a, b, k=3):
    sa, sb = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (neardup.WORD.findall(x.lower()) for x in (a, b)))
    return len(sa & sb) / len(sa | sb)


def _texts(seed, families=12, each=6):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = [rng.choice(WORDS) for _ in range(rng.randint(30, 160))]
        out.append(" ".join(base))
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return out


def _brute(texts, threshold=0.6):
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and min(len(texts[i].split()), len(texts[j].split())) >= 20 and _jaccard(texts[i], texts[j]) >= threshold}


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id bigint, content string, rep string")


def test_golay_code_covers():
    """Each 23-bit word has exactly one code word within 3, and pairs meet as promised."""
    patterns, bounds = neardup.golay_patterns(3)
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    s = neardup.syndromes(words)
    assert ((bounds[s + 1] - bounds[s]) == 1).all()
    code = words ^ patterns[bounds[s]]
    assert (neardup.syndromes(code) == 0).all() and (np.bitwise_count(words ^ code) <= 3).all()
    wide, wide_bounds = neardup.golay_patterns(3 + 2)
    for w in words[:100].tolist():
        flips = rng.choice(23, 4, replace=False)
        v = w ^ int(sum(1 << int(f) for f in flips))
        near = [{int(x) ^ int(p) for p in wide[wide_bounds[neardup.syndromes(np.array([x]))[0]] : wide_bounds[neardup.syndromes(np.array([x]))[0] + 1]]} for x in (w, v)]
        assert near[0] & near[1]


def test_close_fingerprints_share_an_anchor():
    """Up to a distance of twice HALF_DISTANCE two fingerprints of one coarse key always meet."""
    rng = np.random.default_rng(4)
    first = rng.integers(0, 1 << 23, 300)
    flips = np.array([sum(1 << int(f) for f in rng.choice(23, 2, replace=False)) for _ in first])
    same, other = np.full(300, 7), np.full(300, 8)
    held = []
    for key, print_ in ((same, first), (same, first ^ flips), (other, first)):
        row, anchor = neardup.anchors_of(key, print_)
        held.append([set(anchor[row == k].tolist()) for k in range(300)])
    assert all(a & b for a, b in zip(held[0], held[1]))
    assert not any(a & b for a, b in zip(held[0], held[2]))


def test_shingle_sets_of_a_batch_are_those_of_its_texts():
    hasher = neardup.Hasher()
    texts = ["short", None, *_texts(3, 3, 2), "Ünï cödé " * 15, "", "a b c " * 10]
    kept, sets, starts = hasher.shingles(texts)
    m = hasher.minhashes(sets, starts)
    assert kept.tolist() == [k for k, t in enumerate(texts) if t and len(neardup.WORD.findall(t)) >= 20]
    for k, a, b, row in zip(kept, starts, np.append(starts[1:], len(sets)), m):
        _, own, _ = hasher.shingles([texts[k]])
        w = neardup.WORD.findall(texts[k].lower())
        assert own.tolist() == sets[a:b].tolist() == sorted(set(own.tolist())) and len(own) == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
        assert (hasher.minhashes(own, np.array([0]))[0] == row).all()


def test_hot_coarse_keys(spark):
    """Records that share a template meet at few coarse keys in crowds; links among them are found."""
    rng = random.Random(8)
    template = [rng.choice(WORDS) for _ in range(40)]
    texts = []
    for _ in range(400):
        own = [rng.choice(WORDS) for _ in range(45)]
        texts.append(" ".join(template + own))
        if len(texts) % 7 == 0:  # edited copies, around the threshold
            for at in rng.sample(range(45), rng.randint(2, 8)):
                own[at] = rng.choice(WORDS)
            texts.append(" ".join(template + own))
    members, links = neardup.near_duplicates(_frame(spark, texts))
    got = {(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links).collect()}
    want = _brute(texts)
    assert got <= want and len(want) > 40 and len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("block", [2048, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = _texts(5)
    members, links = neardup.near_duplicates(_frame(spark, texts))
    got = {(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links).collect()}
    want = _brute(texts)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_copies_and_dirt(spark):
    a, b = _texts(9, 2, 0)
    texts = [a, a, a.upper(), b, None, "", "short text", a, b + " tail"]
    df = _frame(spark, texts)
    members, links = neardup.near_duplicates(df.unionByName(df))
    pairs = {(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links).collect()}
    assert pairs == {(0, 1), (0, 2), (0, 7), (1, 2), (1, 7), (2, 7), (3, 8)}
    star = {(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links, copies=2).collect()}
    assert star == {(0, 1), (0, 2), (0, 7), (3, 8)}
    groups = {r.chunk_id: (r.group_id, r.n_links) for r in neardup.groups(members, links).collect()}
    assert groups == {0: (0, 0), 1: (0, 0), 2: (0, 0), 7: (0, 0), 3: (3, 1), 8: (3, 1)}
    assert sorted(r.id for r in members.collect()) == [0, 1, 2, 3, 7, 8]


@pytest.mark.parametrize("block", [2048, 100])
def test_large_class_is_paired_in_full(spark, monkeypatch, block):
    """Different layouts of one text share a class; each is a text of its own, with links of its own."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    base = _texts(11, 1, 0)[0]
    texts = [base + "!" * i for i in range(503)] + [base + " tail", base + " tail."]
    members, links = neardup.near_duplicates(_frame(spark, texts))
    assert members.select("rep").distinct().count() == 2
    got = [(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links).collect()]
    assert len(got) == len(set(got)) == 505 * 504 // 2 and all(a < b for a, b in got)


def test_chain_is_one_group(spark):
    rng = random.Random(2)
    w = [rng.choice(WORDS) + str(i) for i in range(100)]
    texts = []
    for step in range(12):
        texts.append(" ".join(w))
        w = w[5:] + [f"n{step}x{i}" for i in range(5)]
    members, links = neardup.near_duplicates(_frame(spark, texts))
    assert {r.group_id for r in neardup.groups(members, links).collect()} == {0}


def test_long_and_empty(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    members, links = neardup.near_duplicates(_frame(spark, [long, long + " end"]))
    assert [(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links).collect()] == [(0, 1)]
    members, links = neardup.near_duplicates(_frame(spark, ["x"]).limit(0))
    assert neardup.expand_pairs(members, links).count() == 0 and neardup.groups(members, links).count() == 0
