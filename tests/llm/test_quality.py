import re
from collections import Counter

from pyspark.sql import functions as F

from corpusql.llm.quality import Rule, cascade, judged, order_rules, with_measures

TEXTS = [
    None, "", " \t\n ", "one", "a b c d e f g h i j", "a b c d e a b c d e", "x " * 300,
    "l one\nl one\n\n \nl two\nl one", "# * $ % & | < > ' \"", "é　ü ß\x0bz\x0c\r\n日本 語",
    " ".join(f"w{i}" for i in range(40)) + " w1 w2 w3 w4 w5 w6 tail", "\nLEAD\n" + "word " * 3 + "\n",
    "THIS IS ALL IN CAPITALS AND LONGER THAN TEN WORDS IN TOTAL", "long word " + "q" * 20_000,
    " ".join("w" + "abcdefghij"[i % 10] * (i // 1000 % 9) + f"{i:c}x" for i in range(1000, 9000)),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(runs)
    hit = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit))


def test_measures_equal_brute_force(documents):
    df = documents(TEXTS + [(None, TEXTS[5]), (3, TEXTS[3])]).withColumn("n_words", F.lit("clash"))
    rows = judged(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    by_text = {r.text: r for r in rows}
    assert by_text[TEXTS[12]].rejected_by == "capitals" and by_text[TEXTS[14]].kept
    assert judged(df.limit(0)).count() == 0


def test_order_does_not_change_the_verdict_but_rises_with_worth(documents):
    df = with_measures(documents(TEXTS))
    dear = F.length(F.regexp_replace(F.repeat(F.coalesce("text", F.lit("")), 3), "[aeiou]+", "")) < -1
    candidates = [Rule("dear", dear), Rule("never", F.lit(False)), Rule("short", F.col("n_words") < 5)]
    ordered = order_rules(df, candidates)
    assert ordered[0].name == "short" and {r.name for r in ordered[1:]} == {"dear", "never"}
    verdict = lambda rules: [r[0] is None for r in df.select(cascade(rules)).collect()]
    assert verdict(candidates) == verdict(ordered)


def test_no_python_in_the_plan(documents):
    plan = judged(documents(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
