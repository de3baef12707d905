import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.config import EngineConfig, SecurityConfig, load_config
from folioscope.functions import text as X
from folioscope.functions.analyze import parse_web_query, positions, stem, terms, word_parts
from folioscope.functions.rank import _minimal, cover_density, headline, matches
from folioscope.metrics import Metrics
from folioscope.operators.filters import PathRefused, check_path
from pyspark.sql import functions as F


@pytest.mark.parametrize("word,root", [w.split(":") for w in "caresses:caress ponies:poni ties:tie cats:cat agreed:agre hopping:hop hoping:hope relational:relat conditional:condit happy:happi running:run generalization:general consign:consign knightly:knight national:nation adjustment:adjust replacement:replac adoption:adopt skies:sky news:news proceed:proceed controlling:control triplicate:triplic hopefulness:hope".split()])
def test_stemmer(word, root):
    assert stem(word) == root


_ENDINGS = ["", "s", "es", "ed", "ing", "y", "ies", "ied", "ly", "ness", "ful", "ization", "ational", "ation", "ator", "alism", "aliti", "iveness", "iviti", "ivity", "bility", "ability", "bli", "ogy", "ogi", "alize", "icate", "ical", "iciti", "ement", "ance", "ion", "ll", "eed", "eedly", "ingly", "edly", "ency", "ancy", "fulness", "ousness", "lessly", "izer"]


@settings(max_examples=600, deadline=None)
@given(st.text("abcdefgilmnoprstuvyz", min_size=1, max_size=7), st.sampled_from(_ENDINGS), st.sampled_from(_ENDINGS))
def test_each_word_holds_a_part_of_its_stem(head, one, two):
    for word in (head + one, head + one + two, "dying", "lying", "tying", "skies", "idly", "early"):
        assert any(part in word for part in word_parts(stem(word))), word


@settings(max_examples=300, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)).map(lambda c: (min(c), max(c))), max_size=20))
def test_minimal_covers(covers):
    assert sorted(_minimal(covers)) == sorted(c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers))


def test_stop_words_take_positions():
    assert terms("The cat and the hat") == [("cat", 2), ("hat", 5)]
    assert positions("a a b a", "simple") == {"a": [1, 2, 4], "b": [3]}


def test_query_syntax():
    q = parse_web_query('"quick fox" or lazy -dog')
    assert [[(p.terms, p.negated) for p in g] for g in q.groups] == [[([("quick", 0), ("fox", 1)], False)], [([("lazi", 0)], False), ([("dog", 0)], True)]]
    assert parse_web_query("the and of").groups == [] and parse_web_query('"unclosed phrase').groups and parse_web_query("").groups == []
    assert parse_web_query('"cat in the hat"').groups[0][0].terms == [("cat", 0), ("hat", 3)]


def _score(query, text, analyzer="english"):
    q, held = parse_web_query(query, analyzer), positions(text, analyzer)
    return (matches(q, held), round(cover_density(q, held), 6))


def test_cover_density():
    assert _score("fox", "fox and fox and fox") == (True, 0.3)
    assert _score("quick fox", "quick fox") == (True, 0.1)
    assert _score("quick fox", "quick brown red fox") == (True, round(0.1 / 3, 6))
    assert _score('"quick fox"', "fox quick") == (False, 0.0)
    assert _score("quick or fox", "fox quick") == (True, 0.2)
    assert _score("quick -fox", "quick fox") == (False, 0.0)
    assert _score("a b", "a x b a", "simple") == (True, round(0.05 + 0.1, 6))


def test_headline():
    text = "word " * 50 + "the quick fox jumps over a lazy dog near the river bank today"
    h = headline(parse_web_query("fox dog"), text)
    assert "<b>fox</b>" in h and "<b>dog</b>" in h and len(h.split()) <= 35
    assert headline(parse_web_query("fox"), "") == ""


def test_columns(spark):
    df = spark.createDataFrame([("a\r\nb" + "c" * 200, 3, None, None, 5, 9, [1.0, 0.0], [1.0, 1.0]), ("  x ", None, None, "S", None, None, [0.0, 0.0], None), (None, None, None, None, 4, 4, None, [1.0])], "t string, p int, s int, h string, a int, b int, v array<float>, w array<float>")
    rows = df.select(X.preview(F.col("t")).alias("t"), X.location(*(F.col(c) for c in "pshab")).alias("l"), X.cosine(F.col("v"), F.col("w")).alias("c"), X.token_estimate(F.col("t")).alias("n"), X.sanitise(F.concat(F.col("t"), F.lit("\x00\x07\t\x85"))).alias("z")).collect()
    assert rows[0].t.startswith("a  bc") and rows[0].t.endswith("...") and len(rows[0].t) == 160 and (rows[1].t, rows[2].t) == ("x", "")
    assert [r.l for r in rows] == ["page 3", "sheet S", "line 4"]
    assert abs(rows[0].c - 0.5**0.5) < 1e-9 and rows[1].c is None and rows[2].c is None
    assert rows[0].n == 51 and rows[1].z == "  x \t"


def test_path_guard(tmp_path):
    good = tmp_path / "a.md"
    for bad in ("", " ", None, "x\0y", "secrets.env", "private.key", "payload.exe", str(tmp_path.parent / "other" / "a.md"), "../a.md"):
        with pytest.raises(PathRefused):
            check_path(bad, SecurityConfig(), str(tmp_path))
    assert check_path("a.md", SecurityConfig(), str(tmp_path)) == str(good)
    assert check_path("/else/a.md", SecurityConfig(enforce_allowed_roots=False), str(tmp_path)) == "/else/a.md"


def test_config(tmp_path, monkeypatch):
    c = EngineConfig()
    assert (c.search.fts_weight, c.search.semantic_weight, c.search.default_limit, c.indexing.max_file_size_bytes) == (0.4, 0.6, 10, 52_428_800)
    assert EngineConfig.from_json(c.to_json()) == c
    (tmp_path / "folioscope.json").write_text('{"search": {"ftsWeight": 0.5, "unknown": 1}, "other": 2}')
    (tmp_path / "sub").mkdir()
    monkeypatch.delenv("FOLIOSCOPE_CONFIG", raising=False)
    assert load_config(cwd=str(tmp_path / "sub")).search.fts_weight == 0.5


def test_metrics():
    m = Metrics()
    m.record_search("hybrid", 50)
    m.record_search("hybrid", 150)
    m.record_search("text", 100)
    m.record_call("find", 10, ok=False)
    m.record_indexing(scanned=3, indexed=2, skipped=1)
    s = m.snapshot()
    assert s["average_search_ms"] == 100 and s["searches"] == {"hybrid": 2, "text": 1} and s["calls"]["find"]["failures"] == 1 and s["scanned"] == 3
