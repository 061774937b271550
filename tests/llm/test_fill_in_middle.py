import hashlib
import random

import pytest
from pyspark.sql import functions as F

from runloom.llm import fill_in_middle

SCHEMA = "doc_id long, text string, source string, n int"


def expected(own, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if own is None else own}".encode()).hexdigest()
    h, n = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return own, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return own, n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd, block = random.Random(6), fill_in_middle.BLOCK
    out = ["".join(rnd.choices("aé😀\n\r<>PSM  ", k=rnd.randint(0, 3 * block))) for _ in range(200)]
    out += ["x" * (block * k + d) for k in (1, 2, 3) for d in (-1, 0, 1)] + ["😀" * block, "<S", "a<P>b", "<", "", None, "é" * 700, "word " * 200_000]
    return [t.replace("<P>", "") if t and i < 180 else t for i, t in enumerate(out)]


def test_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "null id"), (-5, "negative"), (-5, "repeated id"), (-5, "repeated id")]
    df = spark.createDataFrame([(*r, "s", 9) for r in rows], SCHEMA)
    out = fill_in_middle.transform(df, keep=["source"])
    assert out.columns == ["doc_id", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert {"psm", "spm", "plain"} == {r.form for r in got}
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert fill_in_middle.transform(df.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "abc", "s", 9)], SCHEMA)
    plan = fill_in_middle.transform(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_other_shares_and_sentinels(spark):
    s = fill_in_middle.Sentinels("[p]", "[s]", "[m]")
    rows = [(i, f"text {i} <P>", "s", 9) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = fill_in_middle.transform(df, plain=0, spm=100, sentinels=s).select(fill_in_middle.restore(F.col("output"), F.col("form"), s), "form").collect()
    assert sorted(r[0] for r in got) == sorted(r[1] for r in rows) and {r.form for r in got} == {"spm"}
    for bad in (("", "b", "c"), ("ab", "ba", "c"), ("a", "xay", "c"), ("a", "a", "c"), ("aba", "x", "y")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_in_middle.Sentinels(*bad)
    with pytest.raises(ValueError, match="name"):
        fill_in_middle.transform(df, keep=["n"])
