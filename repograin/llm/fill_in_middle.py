"""Fill-in-the-middle training texts, cut by counted regular expressions. DataFrame functions only.

A text is a row of units (white space with the word after it, or white space at the end). ``regexp_count`` gives their
number n; two hashes of the id choose how many units stand before the middle (a) and in front of its end (b). A pattern of
the row's own, ``unit{a}`` and ``unit{b - a}`` with possessive counts, then captures prefix, middle and suffix in one
match, and the replacement puts them into their new order. Possessive counts run as loops in Java's engine; plain ones
recurse once per unit and overflow the stack on long texts.

Nothing is shuffled; a row's result depends on its id and text alone, so lost tasks give the same rows again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
UNIT = rf"(?:[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++)"
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that stay recognisable next to any text that holds none of them."""
    ends = {m[i:] for m in marks for i in range(len(m))}
    if len(set(marks)) < 3 or "" in marks or any(m[:i] in ends for m in marks for i in range(1, len(m))):
        raise ValueError("marks must differ, and none may begin with what one of them ends with")
    if any(a != b and a in b for a in marks for b in marks):
        raise ValueError("no mark may hold another one")
    return marks


def _parts(output: Column, marks: tuple[str, str, str]) -> Column:
    pattern = "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", m) for m in marks)
    return F.split(output, pattern, -1)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text that ``output`` was made of. Null where ``output`` is null."""
    parts = _parts(output, _checked(marks))
    at = lambda i: F.get(parts, F.lit(i))
    psm = F.concat(at(1), at(3), at(2))
    spm = F.concat(at(2), at(3), at(1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    percent: int = 50,
    spm_percent: int = 80,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """One row per row of ``docs``: ``id, n, form, output, prefix_chars, middle_chars``.

    * ``percent`` of the rows are rearranged, ``spm_percent`` of those with the suffix first. The choice and both cuts come
      from the SHA-256 of ``seed:id``, so rows with equal ids and texts have equal results; a null id is spelled as nothing.
    * Null text is empty. Empty texts, and texts that hold a mark, stay plain.
    * Prefix, middle and suffix may each be empty. Character counts are code points, null for plain rows.
    * Other columns are left out, whatever their names; an empty table gives an empty result.
    """
    prefix, suffix, middle = _checked(marks)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    counted = rows.withColumn("_digest", digest).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("bigint"))
    held = F.contains("text", F.lit(prefix)) | F.contains("text", F.lit(suffix)) | F.contains("text", F.lit(middle))
    plain = (F.col("text") == "") | held | (h[2] % 100 >= percent)
    cuts = [h[i] % (F.col("n") + 1) for i in range(2)]
    chosen = counted.select(
        "id",
        "text",
        "n",
        F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
        F.least(*cuts).alias("_a"),
        F.greatest(*cuts).alias("_b"),
    )
    group = lambda count: F.concat(F.lit(f"({UNIT}{{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), group(F.col("_a")), group(F.col("_b") - F.col("_a")), F.lit(r"(.*)\z"))
    p, s, m = (re.sub(r"([\\$])", r"\\\1", x) for x in (prefix, suffix, middle))
    order = F.when(F.col("form") == "psm", F.lit(f"{p}$1{s}$3{m}$2")).otherwise(F.lit(f"{s}$3{p}$1{m}$2"))
    moved = F.regexp_replace("text", pattern, order)
    made = chosen.select("id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(moved).alias("output"))
    parts = _parts(F.col("output"), marks)
    size = lambda i: F.char_length(F.get(parts, i)).cast("bigint")
    return made.select(
        "id",
        "n",
        "form",
        "output",
        F.when(F.col("form") == "psm", size(F.lit(1))).when(F.col("form") == "spm", size(F.lit(2))).alias("prefix_chars"),
        F.when(F.col("form") != "plain", size(F.lit(3))).alias("middle_chars"),
    )
