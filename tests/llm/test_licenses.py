import random

import pytest

from placebook.llm import licenses
from placebook.llm.queries import op10_license_scan

MATCHER = licenses.Matcher(licenses.TEMPLATES)


def brute_force(text, templates=licenses.TEMPLATES, least=licenses.LEAST_SHARE):
    """The licenses of which a run of words a quarter longer than the template has enough."""
    words, found = licenses.words_of(text), set()
    for license, body in templates:
        wanted = licenses.words_of(body)
        size = min(5, len(wanted))
        own = {tuple(wanted[i : i + size]) for i in range(len(wanted) - size + 1)}
        runs = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        places = [i for i, run in enumerate(runs) if run in own]
        for i in places:
            window = set(runs[i : i + len(wanted) - size + 1])
            if len(own & window) >= least * len(own):
                found.add(license)
    return found


@pytest.mark.parametrize("license, body", licenses.TEMPLATES)
def test_each_template_is_found_wherever_it_stands(license, body):
    rng = random.Random(body)
    filler = [f"w{rng.randrange(9999)}" for _ in range(300)]
    for place in (0, 1, 7, 150, 299, 300):
        text = " ".join([*filler[:place], body.upper().replace(" ", "\n"), *filler[place:]])
        got = MATCHER.find(text)
        assert license in {m[0] for m in got}
        match = next(m for m in got if m[0] == license)
        assert match[1] == 1.0 and match[2] == place + 1 and match[3] == place + len(licenses.words_of(body))


def test_near_copies_are_found_and_others_not():
    body = dict(licenses.TEMPLATES[::-1])["GPL-3.0-or-later"].split()
    rng = random.Random(4)
    for changes in range(0, 4):
        for _ in range(15):
            words = list(body)
            for _ in range(changes):
                words[rng.randrange(len(words))] = "changed"
            text = "a b c " * 20 + " ".join(words) + " d e f" * 20
            assert {m[0] for m in MATCHER.find(text)} == brute_force(text)


def test_odd_texts():
    for text in (None, "", " \n", "x", "rights reserved", "the " * 50_000):
        assert MATCHER.find(text) == []
    twice = "All rights reserved. " + "x " * 50 + "all RIGHTS reserved"
    assert [m[0] for m in MATCHER.find(twice)] == ["proprietary"] * 2
    assert licenses.Matcher([("none", "--"), ("one", "word")]).find("a word") == [("one", 1.0, 2, 2)]


def test_rows(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", 3), (1, "Released under the MIT License.", 3), (None, None, None)], "doc_id long, text string, licenses int")
    got = licenses.scan(df).collect()
    assert sorted(len(row.licenses) for row in got) == [0, 1, 1]
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="bytes"):
        licenses.scan(df, [("x", "y" * (licenses.TEMPLATE_BYTES + 1))])


def test_query_equals_brute_force(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = op10_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(row.licenses for row in rows)
    for row in rows:
        assert row.licenses == ",".join(sorted(brute_force(texts[row.doc_id]))) and (row.n_matches > 0) == (row.licenses != "")


def test_short_templates_that_open_a_text_are_always_found():
    """The only window of such an opening has, if it fits, no shingle but the template's."""
    for name, notice in [("proprietary", "All rights reserved."), ("MIT", "Released under the MIT License.")]:
        matcher = licenses.Matcher([(name, notice)])
        assert all(matcher.find(f"{notice} w{i} x{i * 7} y{i} z{i} v{i}") for i in range(3000))
