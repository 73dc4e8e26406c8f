"""Questions of texts, row by row."""

from corpuslake.operators import generate


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_of_a_text_need_no_shuffle(spark):
    texts = ["head\nQ1. Explain a. (5 marks)\n more\n\r\n(2) b\n3) c d\n4) ", "Q . 7 ) x\r\nQ8:y 10 marks", "", None, "none", " \n 1. z  "]
    out = generate.questions(spark.createDataFrame(list(enumerate(texts)), "document_id int, text string"))
    assert "Exchange" not in plan_of(out)
    assert sorted(map(tuple, out.collect())) == [(0, 1, 1, "Explain a. (5 marks) more", 5), (0, 2, 2, "b 3) c d", None), (0, 3, 4, "", None), (1, 1, 7, "x", None), (1, 2, 8, "y", 10), (5, 1, 1, "z", None)]
