"""Fill-in-the-middle transformation of whole documents, in DataFrame functions only.

A text is cut into its code points, left to right. sha256 of ``seed:id`` gives four 32-bit numbers: two places to cut, whether the text stays plain,
and which of two arrangements it takes:

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle

``regexp_extract_all`` makes the unit array: blocks of ``BLOCK`` code points, of which those that hold a cut are cut again into single ones. So a text
costs about its own size, whatever its length, and every cut still falls between two code points. ``slice`` and ``array_join`` build the
arrangements; ``restore`` splits an output at its sentinels and puts the parts back in order. A text that holds a sentinel stays plain, so the
sentinels of an output are its own: no sentinel begins with the end of another (``Sentinels`` refuses others), so none arises where parts meet.

One narrow pass without a shuffle: every row depends on itself only, so a source or text that holds a third of all rows costs no more than others.

Defined results: a null or empty text is plain, with n 0; a null id counts as an empty one; rows that repeat an id are cut at the same shares of
their own texts; other columns are left out unless kept by name, and a kept one that has an output's name is refused; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512
OUTPUT = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = (self.prefix, self.suffix, self.middle)
        pairs = [(a, b, i == j) for i, a in enumerate(every) for j, b in enumerate(every)]
        joins = any(a[-k:] == b[:k] for a, b, own in pairs for k in range(1, min(len(a), len(b)) + (not own)))
        if not all(every) or joins or any(a in b for a, b, own in pairs if not own):
            raise ValueError("sentinels must not be empty, hold one another or begin with the end of one")

    @property
    def pattern(self) -> str:
        return "|".join(re.escape(x) for x in (self.prefix, self.suffix, self.middle))


def units(text: Column, size: int = 1) -> Column:
    """The text as an array of runs of size code points, the last of which may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def number(digest: Column, k: int) -> Column:
    """The k-th group of 8 hex digits, from 0, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20,
    sentinels: Sentinels = Sentinels(), keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, n, form, prefix_chars, middle_chars, output) of each row: plain percent stay as they are, spm percent of the others take that form."""
    if clash := [c for c in keep if c in OUTPUT or c == id_col]:
        raise ValueError(f"columns that would have an output's name: {clash}")
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kept = F.struct(F.col(id_col), *(F.col(c) for c in keep)).alias("__kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")
    rows = docs.select(kept, text, F.sha2(F.concat(F.lit(f"{seed}:"), own), 256).alias("__hash"))
    rows = rows.withColumn("__blocks", units(F.col("__text"), BLOCK))
    last = F.coalesce(F.char_length(F.try_element_at("__blocks", F.lit(-1))), F.lit(0))
    rows = rows.withColumn("n", (F.greatest(F.size("__blocks") - 1, F.lit(0)) * BLOCK + last).cast("bigint"))
    h = [number(F.col("__hash"), k) for k in range(4)]
    cuts = [h[k] % (F.col("n") + 1) for k in range(2)]
    held = (F.col("n") == 0) | F.col("__text").rlike(sentinels.pattern) | (h[2] % 100 >= 100 - plain)
    form = F.when(held, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("*", F.least(*cuts).alias("__lo"), F.greatest(*cuts).alias("__hi"), form.alias("form"))
    at = [F.floor(F.col(c) / BLOCK).cast("int") for c in ("__lo", "__hi")]
    over = [(F.col(c) % BLOCK).cast("int") for c in ("__lo", "__hi")]
    fine = F.flatten(F.transform("__blocks", lambda b, i: F.when((i == at[0]) | (i == at[1]), units(b)).otherwise(F.array(b))))
    first = at[0] + over[0]  # units before the first cut, and before the second: an earlier block that was cut counts BLOCK units for one
    second = at[1] + over[1] + F.when(at[1] > at[0], BLOCK - 1).otherwise(0)
    rows = rows.select("*", F.when(F.col("form") != "plain", fine).alias("__units"), first.alias("__first"), second.alias("__second"))
    part = lambda a, b: F.array_join(F.slice("__units", a + 1, b - a), "")
    prefix, middle = part(F.lit(0), F.col("__first")), part(F.col("__first"), F.col("__second"))
    suffix = part(F.col("__second"), F.size("__units"))
    p, s, m = F.lit(sentinels.prefix), F.lit(sentinels.suffix), F.lit(sentinels.middle)
    output = (
        F.when(F.col("form") == "plain", F.col("__text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    cut = lambda size: F.when(F.col("form") != "plain", size)
    return rows.select(
        "__kept.*", "n", "form", cut(F.col("__lo")).alias("prefix_chars"), cut(F.col("__hi") - F.col("__lo")).alias("middle_chars"), output.alias("output")
    )


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text of an output, told from its form and its sentinels alone."""
    by = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = lambda parts, order: F.concat(*(F.get(parts, F.lit(i)) for i in order))
    back = lambda x: F.when(form == "psm", joined(x, by["psm"])).when(form == "spm", joined(x, by["spm"]))
    return F.when(form == "plain", output).otherwise(F.transform(F.array(F.split(output, sentinels.pattern, -1)), back)[0])
