"""quillstack: DataFrame-in, DataFrame-out operators for building age-graded text corpora on Spark."""
