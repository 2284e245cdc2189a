"""Card numbers that keep their first digits, their length and their layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.redact import luhn

# Runs of 13 to 19 digits, words that tell a card number before them, and how far before.
RUN = r"(?U)\b(?:[0-9][\s\-]?){13,19}\b"
WORDS = r"(?iU)\b(pan|card(?:[\s_-]*(?:no|num|number))?|cc(?:[\s_-]*(?:no|num|number))?|credit[\s_-]*card|acct|account(?:[\s_-]*(?:no|num|number))?)\b"
LOOK_BACK, KEPT, LEAST = 48, 4, 13
#: Runs that a look back can reach into: each has 13 characters at least.
_BACK = LOOK_BACK // LEAST + 1


def masked(text: Column) -> Column:
    """Runs of digits of which all but the first four become X, if they pass the checksum of card numbers or a word for
    one stands within the 48 characters before; others stay, as does a null text.

    The text is cut at its runs once; what stands before a run is put together from the few pieces that reach so far back.
    """
    runs, gaps = F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), F.split(text, RUN, -1)

    def before(cut: Column, i: Column) -> Column:
        pieces = []
        for k in range(_BACK, 0, -1):
            pieces += [F.coalesce(F.get(cut["gaps"], i - k), F.lit("")), F.coalesce(F.get(cut["runs"], i - k), F.lit(""))]
        return F.right(F.concat(*pieces, cut["gaps"][i]), F.lit(LOOK_BACK))

    def turned(cut: Column, run: Column, i: Column) -> Column:
        digits = F.regexp_replace(run, "[^0-9]", "")
        head = F.regexp_extract(run, r"^((?:[^0-9]*[0-9]){4})", 1)
        rest = F.regexp_replace(F.substr(run, F.length(head) + 1), "[0-9]", "X")
        card = (F.length(digits) >= LEAST) & (before(cut, i).rlike(WORDS) | luhn(digits))
        return F.when(card, F.concat(head, rest)).otherwise(run)

    # bound once: the optimizer must not cut the text for each use
    cut = F.array(F.struct(runs.alias("runs"), gaps.alias("gaps")))
    made = F.transform(cut, lambda c: F.array_join(F.zip_with(c["gaps"], F.transform(c["runs"], lambda r, i: turned(c, r, i)), lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), ""))
    return F.when(text.rlike(r"[0-9][\s\-]?[0-9][\s\-]?[0-9][\s\-]?[0-9]"), made[0]).otherwise(text)
