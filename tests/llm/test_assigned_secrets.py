import pytest

pytest.importorskip("public_tokenizers")

from corpus import frame
from weftgraph.llm import secrets

VALUE = "wJalrXUtnFEMIK7MDENGbPxRfiCY9EXAKEYa7"
CASES = {
    "AWS_ACCESS: {}": True,
    "AWS_ACCESS={}": True,
    "export AWS_ACCESS={}\n": True,
    "https://h/x?sig={}&v=1": True,
    "https://h/x?a=1&sig={}==": True,
    "A_LONG_NAME_OF_OVER_20_CHARACTERS={}": True,
    "x=={}=": True,
    "password={}": False,  # an assign span covers it
}


def test_values_after_an_equals_sign(spark):
    docs = frame(spark, [(i, c.format(VALUE), None, "s", None, "", "", 0) for i, c in enumerate(CASES)])
    got = {r.doc_id: r.spans.split(",") for r in secrets.scanned(docs).collect()}
    for i, (case, loose) in enumerate(CASES.items()):
        start = case.index("{}")
        padding = len(case[start + 2 :]) - len(case[start + 2 :].lstrip("="))
        assert (f"random:{start}:{start + len(VALUE) + padding}" in got[i]) == loose
        assert loose or f"assign:0:{start + len(VALUE)}" in got[i]
