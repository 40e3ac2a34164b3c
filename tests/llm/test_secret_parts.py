"""Random runs that hold a fixed pattern: the rest of the run is a span too."""

import random
import string

from sparkseek.llm import secrets


def test_rest_of_a_run_around_a_pattern(spark, sf):
    table, threshold = secrets.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rng = random.Random(5)
    token = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    for _ in range(20):
        left, key, right = token(30) + "Z", "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)), "z" + token(30)
        text = f"see {left}{key}{right} here"
        spans = secrets.scan(text, table, threshold)
        assert [s for s in spans if s[1] < 3] == secrets.base_spans(text)
        assert secrets.replaced(text, spans, "").strip() in ("see  here",)
    plain = "the_commit_identifier_" + "0123456789abcdef" * 2
    assert [s[1] for s in secrets.scan(plain, table, threshold)] == [2]
