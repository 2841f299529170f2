"""Quality rules against brute force."""

import re
from collections import Counter

import pytest

from lakescribe.llm import quality_rules


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n)


TEXTS = ["a b c d e f g h " * 5, "one two three\none two three\n \nfour\none two three", "x " * 7 + "y", " ".join(map(str, range(50))) + " " + " ".join(map(str, range(30, 45))), "# $ % & * | < > #", "p q r s t u v w x p q r s t u v w", "\x1c \x85     a"]


def test_counts(spark, odd_docs, no_docs):
    more = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for docs in (odd_docs, more):
        found = quality_rules.filter_quality(docs).collect()
        got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found), key=str)
        assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)
        assert not any(r["kept"] and (r["base_failed"] or r["failed"]) for r in found)
    assert quality_rules.filter_quality(no_docs).count() == 0


def test_no_python_in_plan(odd_docs):
    plan = quality_rules.filter_quality(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|Exchange", plan)


@pytest.mark.parametrize(("text", "rule"), [("the " + "stone*** " * 60, "symbols"), ("the of " + "HOUSE!! " * 60, "exclamations"), ("stone river light " * 1 + " ".join(f"w{k}" for k in range(60)), "stop_words"), ("the of and a " + "extraordinarilylongword " * 1 + " ".join(f"{'z' * 20}{k}" for k in range(40)), "word_length")])
def test_rules(spark, text, rule):
    r = quality_rules.judge(quality_rules.measure(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert rule in r["failed"] and not r["kept"]
