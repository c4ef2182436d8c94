import re

from brontide.llm import quality

from tests.llm import cases


def expected(text):
    text = text or ""
    w = cases.words(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if cases.words(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 5)} if len(windows) < 2000 else None
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, covered if covered is None else len(covered)


def test_base_columns_against_brute_force(spark, tmp_path):
    rows = cases.documents()
    got = {r.doc_id: r for r in quality.op2_quality_rules(spark, cases.write(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        r, e = got[doc_id], expected(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == e[:4], text
        if e[4] is not None:
            assert r.n_repeat_words == e[4], text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_empty_table(spark, tmp_path):
    assert quality.op2_quality_rules(spark, cases.write(spark, tmp_path, [])).collect() == []


def test_em_finds_the_accurate_rules():
    # Two rules that agree, and one that votes at random.
    patterns = [((1, 1, v), 300) for v in (-1, 1)] + [((-1, -1, v), 60) for v in (-1, 1)] + [((1, -1, 1), 5), ((-1, 1, -1), 5), ((0, 0, 0), 20)]
    right = quality.fit(patterns, 3)
    assert right[0] > 0.9 and right[1] > 0.9 and right[2] < 0.6
    assert quality.posterior([(1, 1, -1)], right)[0] > 0.9 > 0.1 > quality.posterior([(-1, -1, 1)], right)[0]
    assert quality.posterior([(0, 0, 0)], right)[0] == 0.5 and (quality.fit([], 2) == quality.ACCURACY).all()
