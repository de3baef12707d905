from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import split


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n;é中", min_size=0, max_size=500), st.integers(3, 60), st.data())
def test_invariants(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    spans = split.cut_points(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(spans, spans[1:]))


def test_balanced_and_natural():
    text = "\n\n".join("Sentence number %d stands here." % i for i in range(200))
    spans = split.cut_points(text, 2048, 192)
    sizes = [b - a for a, b in spans]
    assert len(spans) == 1 + -(-(len(text) - 2048) // 1856) and max(sizes) < 1.4 * min(sizes)
    assert all(text[b - 2 : b] == "\n\n" for _, b in spans[:-1])


def test_no_boundary_and_bad_overlap():
    assert all(b - a <= 100 for a, b in split.cut_points("x" * 10_000, 100, 10))
    try:
        split.cut_points("x" * 11, 10, 10)
    except ValueError:
        pass
    else:
        raise AssertionError


def test_table(spark):
    long = "".join(f"line {i}\n" for i in range(600))
    rows = [(1, long, "T", 5, "a"), (1, long, "T", 5, "a"), (2, "short", None, None, "b"), (3, None, None, None, "c"), (4, "", "T", 1, None), (5, "y" * 2049, None, None, "d"), (6, "z" * 2048, "S", 1, "e")]
    df = spark.createDataFrame(rows, "id bigint, content string, section_title string, line_start int, piece_no string")
    out = split.split_oversized(df).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in out} == {1, 5} == {r.chunk_id for r in split.split_ids(split.split_oversized(df)).collect()}
    one = [r for r in out if r.chunk_id == 1]
    assert [r.piece_no for r in one] == list(range(len(one))) and all(r.n_tokens <= 512 and r.section_title == "T" for r in one)
    assert all(r.line_start == 5 + long.count("\n", 0, r.start) for r in one)
    assert all(r.line_start is None for r in out if r.chunk_id == 5)
    assert one[0].content + "".join(r.content[192:] for r in one[1:]) == long
    assert split.split_oversized(df.limit(0)).count() == 0


def test_boundary_far_from_target_goes_before_an_even_cut():
    for at in (699, 1999):
        text = "a" * at + " " + "b" * (4199 - at)
        spans = split.cut_points(text, 2048, 192)
        assert spans[0] == (0, at + 1) and len(spans) == 3 and spans[-1][1] == 4200
        assert all(b - a <= 2048 for a, b in spans) and all(y[0] == x[1] - 192 for x, y in zip(spans, spans[1:]))
