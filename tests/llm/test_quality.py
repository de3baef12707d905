import os

import numpy as np
import pytest

from folioscope.llm import quality as Q

TABLES = "/root/testdata/sf0.1"
PROSE = "The team found that the road to the village was closed for the winter, and so they went by boat. It was not the first time.\nNobody had thought of that when the plan was made."
TABLE = "\n".join(f"| {i} | {i * 37} | 2024-01-0{i % 9 + 1} | item{i} |" for i in range(20))


def _common(spark):
    words = "the of and to a in is it that was for on are with as be this have from by not but when so they had that".split()
    return spark.createDataFrame([("en", w, i) for i, w in enumerate(words)] + [("ja", "の", 1), ("ja", "を", 2), (None, None, None)], "lang string, word string, word_rank int")


def _docs(spark, texts, kind="document"):
    return spark.createDataFrame([(i, t, kind, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, document_type string, common_words double")


def test_statistics_by_hand(spark):
    rows = Q.text_statistics(_docs(spark, ["The cat sat.\nNo, it ran", None, "", " \n ", "日本の本!"]), _common(spark)).orderBy("doc_id").collect()
    a = rows[0]
    assert a.word_count == 6 and abs(a.mean_word_length - 16 / 6) < 2e-6
    assert abs(a.symbol_ratio - 2 / 18) < 2e-6 and a.punctuated_lines == 0.5 and abs(a.common_words - 2 / 6) < 2e-6
    for r in rows[1:4]:
        assert (r.word_count, r.mean_word_length, r.symbol_ratio, r.punctuated_lines, r.common_words) == (0, 0.0, 0.0, 0.0, 0.0)
    assert rows[4].word_count == 4 and rows[4].common_words == 0.25


def test_default_rules(spark):
    texts = [PROSE, TABLE, PROSE.upper(), None, "", "\n\n", "*=_ " * 50, TABLE]
    common = _common(spark)
    got = {r.doc_id for r in Q.not_prose(_docs(spark, texts), common).collect()}
    assert got == {1, 6, 7}
    assert Q.not_prose(_docs(spark, texts, "code"), common).count() == 0
    assert Q.not_prose(_docs(spark, texts).limit(0), common.limit(0)).count() == 0


def test_rule_list_is_learned_and_native(spark):
    rng = np.random.default_rng(0)
    x = rng.random((900, len(Q.FEATURES)))
    y = (x[:, 4] <= 0.2) | ((x[:, 2] >= 0.8) & (x[:, 5] >= 0.5))
    rules = Q.fit_rules(x[:600], y[:600])
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[600:]], ", ".join(f"{f} double" for f in Q.FEATURES))
    got = np.array([r[0] > 0 for r in frame.selectExpr(Q.rules_to_sql(rules)).collect()])
    assert (got == y[600:]).mean() > 0.93
    assert Q.rules_to_sql([]) == "0" and Q.fit_rules(x[:0], y[:0]) == []


def test_held_out_accuracy_of_default_rules(spark):
    """Texts that the rules weren't fitted on: prose and its opposite, mixed by construction."""
    rng = np.random.default_rng(1)
    words = PROSE.replace("\n", " ").split(" ")
    prose = [" ".join(rng.choice(words, 80)) + "." for _ in range(40)]
    junk = ["\n".join(f"{rng.integers(1e6)};{rng.integers(1e6)};x{rng.integers(99)}" for _ in range(25)) for _ in range(40)]
    got = {r.doc_id for r in Q.not_prose(_docs(spark, prose + junk), _common(spark)).collect()}
    assert got == set(range(40, 80))


def test_numbers_of_entries_end_no_sentence(spark):
    texts = ["1. Alpha beta\n2. Gamma\n  3. Delta", "We met in 2020. It was late.", "1. We met. It was late."]
    rows = Q.text_statistics(_docs(spark, texts), _common(spark)).orderBy("doc_id").collect()
    assert [round(r.sentence_ends * r.word_count) for r in rows] == [0, 2, 2]


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no tables to learn from")
def test_rules_are_what_the_fit_gives(spark):
    x, y = Q.labelled_sample(spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/common_words.parquet"))
    assert Q.fit_rules(x, y) == Q.RULES


def test_labels():
    common = set("the of and to a in is it that was for on".split())
    assert Q.label_of(PROSE, common) is False and Q.label_of(TABLE, common) is True and Q.label_of(" ", common) is None
