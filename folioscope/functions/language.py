"""Language label from the share of characteristic letters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.binding import let


@dataclass(frozen=True)
class LetterClass:
    label: str
    letters: str  # body of a regular expression character class


# Han ideographs decide for "zh"; anything else is "en".
HAN = LetterClass("zh", r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}")


def detect_language(
    text: Column,
    classes: Sequence[LetterClass] = (HAN,),
    floor: float = 0.1,
    default: str = "en",
) -> Column:
    """The class with the largest share of letters, at least `floor`, else `default`.

    Ties go to the class listed first, so list ideographic classes first. One pass over
    the text keeps the letters of all classes; they are counted in what is left.
    """
    rest = "".join(c.letters for c in classes)
    telling = F.regexp_replace(text, f"[^{rest}]+", "")

    def label(found: Column) -> Column:
        best = F.array_max(found)
        names = F.array(*[F.lit(c.label) for c in classes])
        return F.when(
            (best > 0) & (best >= F.length(text) * F.lit(floor)),
            F.get(names, (F.array_position(found, best) - 1).cast("int")),
        ).otherwise(F.lit(default))

    def counted(letters: Column) -> Column:
        counts = [F.regexp_count(letters, F.lit(f"[{c.letters}]")) for c in classes]
        return let(F.array(*counts), label)

    return F.coalesce(let(telling, counted), F.lit(default))
