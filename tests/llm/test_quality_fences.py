import random

from grovetable.llm import quality


def test_a_single_occurrence_is_no_fault_where_plain_documents_have_none(spark):
    """The fences of a group without any symbol, repeated line or repeated window are zero."""
    draw = random.Random(6)
    style = [2]
    fresh = lambda n: " ".join(f"w{draw.randrange(10 ** draw.choice((style[0], 7)))}" for _ in range(n))
    rows = []
    for i in range(1500):
        style[0] = draw.choice((3, 4, 5, 6, 7))  # texts whose words are longer or shorter
        rows.append((i, fresh(draw.randint(60, 300)), "en", "plain"))
    style[0] = 5
    rows += [(5000, fresh(150) + " #", "en", "plain"), (5001, "one two three\n" + fresh(100) + "\none two three\n" + fresh(50), "en", "plain")]
    again = fresh(8)
    rows += [(5002, f"{again} {fresh(100)} {again} {fresh(60)}", "en", "plain")]
    rows += [(6000, fresh(150) + " #$%" * 20, "en", "plain"), (6001, ("same line here\n" * 12) + fresh(100), "en", "plain"), (6002, f"{fresh(90)} " + f"{fresh(12)} " * 1 + " ".join([again] * 4), "en", "plain")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i: got[i] for i in got if got[i] != (i < 6000)} == {}
