from tracelake.llm import lines


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, i): r for i, r in enumerate(sorted(lines.without_repeated_lines(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")))}


def test_repeated_templates_stay_in_the_first_document_only(spark):
    rows = [
        (1, "posted 12 May by staff in news\nmy own first line of text here"),
        (2, "posted 7 May by staff in news\nanother thing that nobody else has written"),
        (3, "my own first line of text here\nposted 99 May by staff in news\nshort one"),
        (4, "short one\nshort one"),
    ]
    got = {k[0]: r for k, r in run(spark, rows).items()}
    assert got[1].n_dropped == 0 and got[1].text == rows[0][1]
    assert (got[2].n_lines, got[2].n_dropped, got[2].text) == (2, 1, "another thing that nobody else has written")
    assert (got[3].n_dropped, got[3].text) == (2, "short one")
    assert got[4].n_dropped == 0 and got[4].text == "short one\nshort one"


def test_variable_fields_without_digits_are_found_by_the_leaf(spark):
    names = ["anna", "bert", "cleo", "dora"]
    rows = [(k, f"welcome back to {n} from the whole shop team\nunique words number {'abcd'[k]} only in this place {n}") for k, n in enumerate(names)]
    got = {k[0]: r for k, r in run(spark, rows).items()}
    assert got[0].n_dropped == 0 and all(got[k].n_dropped >= 1 and "welcome" not in got[k].text for k in (1, 2, 3))


def test_prose_of_one_leaf_is_left_alone(spark):
    rows = [(1, "it was the end of a long and dull day"), (2, "it was the best time they had in years"), (3, "it was the dog of my old uncle that barked")]
    assert all(r.n_dropped == 0 for r in run(spark, rows).values())


def test_long_tokens_cost_no_more_than_their_length(spark):
    text = "x" * 200_000 + " a b c d e\n" + "1" * 100_000 + " a b c d"
    got = list(run(spark, [(1, text), (2, "y")]).values())
    assert got[0].text == text


def test_edges(spark, messy, empty):
    rows = lines.without_repeated_lines(messy).collect()
    assert len(rows) == messy.count() and lines.without_repeated_lines(empty).count() == 0
    by = {(r.doc_id, r.text): r for r in rows}
    assert by[(4, None)].n_lines == 0 and by[(3, "")].n_lines == 1
    assert all(r.n_dropped == 0 and r.rank == 9 for r in rows)
    got = run(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f\n\nz"), (1, "a b c d e f\n\nz")])
    assert sorted((r.doc_id is None, r.text) for r in got.values()) == [(False, "a b c d e f\n\nz")] * 2 + [(True, "")] * 2


def test_lines_of_numbers_stay_whatever_else_is_there(spark):
    rows = [(1, "1 2 3 4 5\nrow 17 has 4 of 9"), (2, "6 7 8 9 10\nrow 18 has 5 of 8")]
    for more in ([], [(3, "11 12 13 words here\nrow 19 has none of it")]):
        got = {k[0]: r for k, r in run(spark, rows + more).items()}
        assert all(got[k].n_dropped == 0 and got[k].text == t for k, t in rows)
    steady = [(1, "total of this page is 7 items"), (2, "total of this page is 9 items")]
    assert [r.n_dropped for r in run(spark, steady).values()] == [0, 1]
