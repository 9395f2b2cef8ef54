"""Analytics for peer-judged question-and-answer evaluations, on PySpark DataFrames."""
