"""Fill-in-the-middle against a plain loop over units, and round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from repograin.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_loop(key, text, seed=42, percent=50, spm_percent=80, marks=fim.MARKS):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= percent:
        return key, n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    return key, n, form, f"{p}{pre}{s}{suf}{m}{mid}" if form == "psm" else f"{s}{suf}{p}{pre}{m}{mid}", len(pre), len(mid)


def texts():
    rnd = random.Random(1)
    out = [None, "", " ", "\n", "word", " word ", "a b  c\x1cd\x85", "<P>", "a <S> b", "x <M", "<", "S>", "$1 \\ $2 \\E{3}"]
    out += ["".join(rnd.choice("ab\t\n  é😀<PSM>$\\") for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    return out + ["long " * 60000, "y" * 200000, " " * 200000, "a  " * 30000 + "\n" * 9]


@pytest.mark.parametrize(("options"), [{}, {"percent": 100, "spm_percent": 50, "seed": 7, "marks": ("<$pre>", "[suf\\]", "(mid)")}])
def test_against_plain_loop(spark, options):
    rows = [(i, t, "q", 1) for i, t in enumerate(texts())] + [(None, "a b c", "q", 1), (3, "\n", "q", 1), (8, "again " * 9, "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string, n int")
    made = fim.fill_in_middle(docs, **options)
    back = fim.restore(F.col("output"), F.col("form"), options.get("marks", fim.MARKS))
    got = made.withColumn("back", back).collect()
    want = [(*plain_loop(r[0], r[1], **options), r[1] or "") for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.fill_in_middle(docs).collect() == []


@pytest.mark.parametrize("marks", [("a", "a", "b"), ("ab", "xa", "c"), ("<P>", "<P>x", "<M>"), ("", "a", "b")])
def test_marks_that_could_be_mistaken_are_refused(spark, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string"), marks=marks)
