from pagemill.operators.boxes import retry_merge

COLUMNS = "doc_id long, page_no int, line_no int, word_no int, x0 long, y0 long, x1 long, y1 long, text string"


def test_retry_merge(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 20, 10, "known"), *((2, 0, 0, i, 30 * i, 0, 30 * i + 20, 10, "word") for i in range(6))], COLUMNS)
    found = [(0, 0, 20, 10), (40, 1, 60, 11), (41, 1, 61, 11), (0, 100, 20, 110)]  # known, beside, its repeat, far below
    rows = [(d, 0, 0, 100 + i, *b, "again") for d in (1, 2, 3) for i, b in enumerate(found)]
    got = retry_merge(words, spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(r.doc_id, r.word_no, r.joined) for r in got} == {(1, 101, 0), (1, 103, None), (3, 100, None), (3, 101, None), (3, 103, None)}
    assert retry_merge(words, words.where("false")).isEmpty()
