from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.operators import chunking
from folioscope.sources.parsers import parse, section, symbol


def _parsed(kind="text", sections=(), symbols=()):
    return {"document_type": kind, "sections": list(sections), "symbols": list(symbols)}


def test_greedy_modes():
    assert chunking.greedy_pack("  short ") == [("short", 2)]
    paragraphs = "\n\n".join("p%d " % i + "x" * 60 for i in range(6))
    out = chunking.greedy_pack(paragraphs, 40)
    assert [n for _, n in out] == [32, 32, 32] and out[0][0].count("\n\n") == 1
    lines = "\n".join("line %d " % i + "y" * 60 for i in range(6))
    assert all(". line" in c for c, _ in chunking.greedy_pack(lines, 40))
    assert chunking.greedy_pack("z" * 1000, 40) == [("z" * 1000, 250)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc .", min_size=1, max_size=80), max_size=30), st.integers(5, 60))
def test_greedy_keeps_all_letters(parts, most):
    text = "\n\n".join(parts)
    out = chunking.greedy_pack(text, most)
    letters = lambda s: "".join(c for c in s if c in "abc")
    assert letters("".join(c for c, _ in out)) == letters(text)


def test_dispatch_and_fallback():
    long = section("S", "w " * 3000, page_number=3)
    assert len(chunking.chunk_parsed(_parsed("document", [long]))) == 1
    assert len(chunking.chunk_parsed(_parsed("document", [long]), normalise_types=True)) == 1  # one line: no boundary to cut at
    many = section("S", ("w " * 200 + "\n\n") * 12, page_number=3)
    out = chunking.chunk_parsed(_parsed("pdf", [many, section("B", "  ")]))
    assert len(out) == 3 and all(c["page_number"] == 3 and c["section_title"] == "S" for c in out)
    assert chunking.fallback_chunker(_parsed("x", [section("A", " keep ")]))[0]["content"] == " keep "


def test_code_symbols():
    big = "x" * 4000
    symbols = [symbol("A", "Class", 1, 90, big, "N"), symbol("M", "Method", 2, 9, "m()", "N", "void M()", 0), symbol("I", "Class", 10, 80, big, "N", None, 0), symbol("K", "Method", 11, 12, "k()", "N", "void K()", 2), symbol("B", "Class", 91, 95, "b", "N"), symbol("C", "Method", 92, 93, "c", "N", "c()", 4)]
    out = chunking.code_chunker(_parsed("code", [section("f", "all")], symbols))
    assert [(c["section_title"], c["content"][:20]) for c in out] == [("Class: A", "Class A (Line 1-90)"), ("Method: M", "m()"), ("Class: I", "Class I (Line 10-80)"), ("Method: K", "k()"), ("Class: B", "b")]
    assert out[0]["metadata"]["isHeader"] == "true" and out[0]["line_end"] == 6
    assert [c["content"] for c in chunking.code_chunker(_parsed("code", [section("f", " all ", line_start=1, line_end=4)]))] == ["all"]


def test_fox_sections():
    text = "The quick brown fox jumps over the lazy dog. " * 100
    out = chunking.greedy_pack(text, 50)
    assert len(out) > 1 and all(n <= 60 for _, n in out)
    p = parse("/x/a.md", b"# A\n\ntext\n")
    assert [c["content"] for c in chunking.chunk_parsed(p)] == ["text"]


def test_places_do_not_depend_on_blocks(spark):
    rows = [(i, d, (i * 7) % 40 if i % 9 else None) for i, d in enumerate([1] * 30 + [2] * 5 + [None] * 4)]
    df = spark.createDataFrame(rows, "id bigint, document_id bigint, chunk_index int")
    want = {}
    for d in (1, 2, None):
        own = sorted((r for r in rows if r[1] == d), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        want.update({r[0]: k for k, r in enumerate(own, 1)})
    for block in (4096, 8, 1):
        assert {r.id: r.place for r in chunking.chunk_places(df, block).collect()} == want
    assert chunking.chunk_places(df.limit(0)).count() == 0
