"""Any number of templates, and templates of few words."""

import random

from grovetable.llm import licenses

SCHEMA = "doc_id long, text string"


def rows_of(df):
    return sorted((r["doc_id"], r["license_id"], round(r["containment"], 6), r["first_word"], r["last_word"]) for r in df.collect())


def test_more_minima_than_constants_find_the_same(spark):
    """500 templates, whole and edited in long texts: the table of minima and the constants give the same rows."""
    draw = random.Random(3)
    word = lambda: "w%d" % draw.randrange(3_000)
    templates = [(f"t{k}", " ".join(word() for _ in range(20 + k % 60))) for k in range(500)]
    rows = []
    for i in range(60):
        body = templates[i * 8][1].split()
        for _ in range(i % 3):
            body[draw.randrange(len(body))] = "edited"
        rows.append((i, " ".join([*(word() for _ in range(i * 3)), *body, *(word() for _ in range(40))])))
    docs = spark.createDataFrame([*rows, (60, None), (61, "")], SCHEMA).repartition(3)
    table = rows_of(licenses.scan_licenses(docs, templates))
    fives = lambda text: {tuple(w[i : i + 5]) for w in [text.split()] for i in range(len(w) - 4)}
    shares = {(i, f"t{i * 8}"): len(fives(templates[i * 8][1]) & fives(text)) / len(fives(templates[i * 8][1])) for i, text in rows}
    true = {k: v for k, v in shares.items() if v >= licenses.CONTAINMENT}
    found = {(d, t): c for d, t, c, *_ in table}
    assert all(abs(true[k] - c) < 1e-6 for k, c in found.items())  # nothing that brute force does not find
    assert len(true) > 30 and len(found) >= 0.98 * len(true)  # bands miss a pair at the limit with chance 0.001
    assert {(i, f"t{i * 8}") for i in range(0, 60, 3)} <= set(found)
    some = templates[::8]
    named = spark.createDataFrame(some, "license_id string, template string")
    assert rows_of(licenses.scan_licenses(docs, named, constants=5)) == rows_of(licenses.scan_licenses(docs, some)) == table


def test_templates_of_few_words(spark):
    templates = [("reserved", "All rights reserved."), ("one", "Unlicensed"), ("four", "do what you want"), ("again", "all RIGHTS reserved"), ("none", " - "), ("five", "one two three four five")]
    rows = [(1, "Copyright 2020 A. All rights  reserved. Then more, all rights reserved."), (2, "all rights are reserved"), (3, "unlicensed"), (4, "do what you want"), (5, None), (6, ""), (7, "all rights"), (8, "x one two three four five"), (9, "All-rights-reserved"), (9, "no all rights reserved")]
    got = rows_of(licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA), templates))
    assert got == sorted([(1, "reserved", 1.0, 3, 5), (1, "again", 1.0, 3, 5), (3, "one", 1.0, 0, 0), (4, "four", 1.0, 0, 3), (8, "five", 1.0, 1, 5), (9, "reserved", 1.0, 0, 2), (9, "again", 1.0, 0, 2)])
    assert rows_of(licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA), templates[:2])) == [(1, "reserved", 1.0, 3, 5), (3, "one", 1.0, 0, 0), (9, "reserved", 1.0, 0, 2)]
    assert rows_of(licenses.scan_licenses(spark.createDataFrame([], SCHEMA), templates)) == []
