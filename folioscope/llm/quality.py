"""Problem 8: per-document text statistics, and the documents that are not natural prose.

The statistics are Spark SQL expressions.  A rule list over them is induced by incremental
reduced-error pruning: a rule is grown condition by condition on two thirds of the labelled
documents, cut back on the last third while that doesn't lower its precision there, and its
documents are removed before the next rule is grown.  The learned thresholds become one SQL CASE
expression that Spark evaluates natively.

No table has labels, so labelled documents come from :func:`label_of`, which reads a text line by
line for sentences (too slow and too crooked for SQL, good enough to learn from).  ``RULES`` was
learned by :func:`fit_rules` on 4,000 such documents; the bound is a parameter of that function.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import spread

#: A word: one ideograph or kana, else a run of letters and digits (with inner marks).
WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"
LINE_END = r"(?m)[.!?…:;,。！？；：、]['\"»”’)\]]*[ \t\r]*$"
#: Ends of sentences, and numbers of list entries, which look like such.
ENDS = r"[\p{L}\p{N}]['\"»”’)\]%]*[.!?](?=\s|$)|[。！？]"
NUMBERED = r"(?dm)^[ \t]*[0-9]+\.(?=[ \t])"
FEATURES = ("word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "digit_ratio", "words_per_line", "sentence_ends")
#: Most common words that are held as a literal set; the table has a fixed size of about 400.
MAX_COMMON = 20_000

PROSE_TYPES = ("document", "pdf", "docx", "doc")

# Learned by fit_rules, not set by hand: each rule is a list of (statistic, comparison, threshold)
# that must all hold for a document to be no prose; a document that no rule covers is prose.
RULES: list[list[tuple[str, str, float]]] = [
    [("sentence_ends", "<=", 0.020452)],
    [("symbol_ratio", ">=", 0.486681)],
]


def text_statistics(documents: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics per document; rows are kept one for one.

    - ``word_count``: words of the text (see ``WORD``); 0 for null, empty and blank texts
    - ``mean_word_length``: code points a word; 0.0 without words
    - ``symbol_ratio``: share of the characters that aren't white space which are neither letters,
      marks nor digits; 0.0 without characters
    - ``punctuated_lines``: share of the lines that aren't blank which end in punctuation
    - ``common_words``: share of the words that are frequent words of any language in
      ``common_words`` (its ``lang`` isn't used: documents' own is often missing or wrong)
    - ``digit_ratio``, ``words_per_line``, ``sentence_ends`` (full stops and the like after a
      word, less numbers of list entries, a word): further statistics that the rules may use

    All are rounded to 6 digits.  No shuffle, unless the scan has fewer splits than there are cores.
    """
    words = [r[0] for r in common_words.select(F.lower("word")).where("word is not null").distinct().limit(MAX_COMMON + 1).collect()]
    if len(words) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = spread(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("_t")), "doc_id")
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    found = base.select(
        "doc_id",
        F.regexp_extract_all(F.lower("_t"), F.lit(f"({WORD})"), F.lit(1)).alias("_w"),
        F.length(F.regexp_replace("_t", r"[\s\p{Z}]+", "")).alias("_ink"),
        F.length(F.regexp_replace("_t", r"[\s\p{Z}\p{L}\p{M}\p{N}]+", "")).alias("_symbols"),
        F.length(F.regexp_replace("_t", r"[^0-9]+", "")).alias("_digits"),
        F.regexp_count("_t", F.lit(r"(?m)^.*\S.*$")).alias("_lines"),
        F.regexp_count("_t", F.lit(LINE_END)).alias("_punctuated"),
        (F.regexp_count("_t", F.lit(ENDS)) - F.regexp_count("_t", F.lit(NUMBERED))).alias("_ends"),
    ).select(
        "*",
        F.size("_w").cast("bigint").alias("word_count"),
        F.length(F.array_join("_w", "")).alias("_letters"),
        F.size(F.filter("_w", lambda w: w.isin(words))).alias("_common") if words else F.lit(0).alias("_common"),
    )
    n, ink, lines = F.col("word_count"), F.col("_ink"), F.col("_lines")
    return found.select(
        "doc_id",
        "word_count",
        ratio(F.col("_letters"), n).alias("mean_word_length"),
        ratio(F.col("_symbols"), ink).alias("symbol_ratio"),
        ratio(F.col("_punctuated"), lines).alias("punctuated_lines"),
        ratio(F.col("_common"), n).alias("common_words"),
        ratio(F.col("_digits"), ink).alias("digit_ratio"),
        ratio(n, lines).alias("words_per_line"),
        ratio(F.col("_ends"), n).alias("sentence_ends"),
    )


def rules_to_sql(rules: list[list[tuple[str, str, float]]]) -> str:
    """A CASE expression with the number of the first rule that covers a row, 0 if none does."""
    if not rules:
        return "0"
    cases = (f"WHEN {' AND '.join(f'{name} {sign} {value!r}' for name, sign, value in rule)} THEN {k}" for k, rule in enumerate(rules, 1))
    return f"CASE {' '.join(cases)} ELSE 0 END"


def not_prose(documents: DataFrame, common_words: DataFrame, rules: list[list[tuple[str, str, float]]] | None = None) -> DataFrame:
    """``(doc_id, rule)`` of the office and text documents that are no natural prose, by rule.

    Documents of other types and null, empty and blank texts are out of scope.
    """
    scope = documents.where(F.col("document_type").isin(*PROSE_TYPES) & F.col("text").rlike(r"[^\s\p{Z}\x{FEFF}]"))
    stats = text_statistics(scope, common_words)
    ruled = stats.select("doc_id", F.expr(rules_to_sql(RULES if rules is None else rules)).alias("rule"))
    # Filtered behind an aggregate: a filter right here would be pushed down, and each statistic
    # in it computed anew wherever the CASE names it.
    return ruled.groupBy("doc_id").agg(F.max("rule").alias("rule")).where("rule > 0")


# --- learning -------------------------------------------------------------------------------


def label_of(text: str, common: set[str]) -> bool | None:
    """True: no prose; False: prose; None: too close to call.

    Paragraphs (hard line breaks joined; bullets, table rows and headings apart) count as
    sentences if they end like one, have words enough and some of them common.
    """
    blocks: list[list[str]] = [[]]
    for line in text.replace("﻿", "").split("\n"):
        s = line.strip()
        if not s or re.match(r"[-*•+#>|\[\d]", s) and not re.match(r"\d{4}-", s):
            blocks.append([])
        if s:
            blocks[-1].append(s)
    good = total = 0
    for block in blocks:
        joined = " ".join(block)
        size = len(re.sub(r"\s", "", joined))
        total += size
        words = re.findall(r"[぀-ヿ一-鿿]|[^\W_぀-ヿ一-鿿]+", joined.lower())
        single = sum(len(w) == 1 for w in words)  # ideographs and kana: fewer of them are common
        if len(words) >= 5 and sum(w in common for w in words) >= (0.08 if single > len(words) / 2 else 0.15) * len(words) and re.search(r"[.!?。！？]", joined):
            good += size
    if not total:
        return None
    share = good / total
    return None if 0.4 < share < 0.6 else share <= 0.4


def _covers(rule: list[tuple[int, int, float]], x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for f, sign, value in rule:
        on &= x[:, f] <= value if sign < 0 else x[:, f] >= value
    return on


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> list[tuple[int, int, float]]:
    """Add the condition of the largest information gain (FOIL) until no negative is covered."""
    rule: list[tuple[int, int, float]] = []
    on = np.ones(len(y), bool)
    while len(rule) < most and (~y[on]).any():
        p, n = y[on].sum(), (~y[on]).sum()
        before, best = np.log2(p / (p + n)), (0.0, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[on, f], kind="stable")
            v, t = x[on, f][order], y[on][order]
            last = np.flatnonzero(np.append(v[1:] != v[:-1], True))
            pos, neg = np.cumsum(t)[last], np.cumsum(~t)[last]
            for sign, a, b in ((-1, pos, neg), (1, p - np.concatenate(([0], pos[:-1])), n - np.concatenate(([0], neg[:-1])))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(a > 0, a * (np.log2(a / (a + b)) - before), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    # Half-way to the nearest value that isn't covered.
                    edge = last[k] if sign < 0 else (last[k - 1] if k else -1)
                    ends = v[max(edge, 0)], v[min(edge + 1, len(v) - 1)]
                    best = (float(gain[k]), (f, sign, float(ends[0] + ends[1]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= _covers([best[1]], x)
    return rule


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 3, most_rules: int = 12, most_conditions: int = 4) -> list[list[tuple[str, str, float]]]:
    """Incremental reduced-error pruning over rows of FEATURES; ``y``: True where no prose."""
    rng = random.Random(seed)
    left = np.arange(len(y))
    rules: list[list[tuple[str, str, float]]] = []
    while len(rules) < most_rules and y[left].any():
        order = left.copy()
        rng.shuffle(mixed := order.tolist())
        order = np.array(mixed)
        cut = len(order) * 2 // 3
        grow, prune = order[:cut], order[cut:]
        if not y[grow].any() or not y[prune].any():
            if y[left].sum() < 2:
                break
            grow = prune = order  # too few to be split
        rule = _grow(x[grow], y[grow], most_conditions)
        if not rule:
            break

        def worth(r: list[tuple[int, int, float]]) -> float:
            on = _covers(r, x[prune])
            p, n = y[prune][on].sum(), (~y[prune][on]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if worth(rule) < 0.5:
            break
        rules.append([(FEATURES[f], "<=" if sign < 0 else ">=", round(value, 6)) for f, sign, value in rule])
        left = left[~_covers(rule, x[left])]
    return rules


def labelled_sample(documents: DataFrame, common_words: DataFrame, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` documents in scope, chosen by a hash of the id, in
    the order of their ids, so that a fit can be repeated."""
    common = {r[0] for r in common_words.select(F.lower("word")).where("word is not null").limit(MAX_COMMON).collect()}
    scope = documents.where(F.col("document_type").isin(*PROSE_TYPES) & F.col("text").rlike(r"[^\s\p{Z}\x{FEFF}]"))
    sample = scope.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = sample.join(text_statistics(sample, common_words), "doc_id").orderBy("doc_id").collect()
    labels = [label_of(r["text"], common) for r in rows]
    kept = [(r, y) for r, y in zip(rows, labels) if y is not None]
    return np.array([[float(r[f]) for f in FEATURES] for r, _ in kept]).reshape(-1, len(FEATURES)), np.array([y for _, y in kept], bool)
