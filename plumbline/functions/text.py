"""Text expressions: alphabets, edit rates, alignments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import fixed


#: Bytes of text that are worked on at once; batches are bounded by rows only.
PIECE_BYTES = 1 << 20


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """``texts`` cut into runs of about ``limit`` bytes, or of one longer text and what comes before it."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // limit)) + 1).tolist(), len(texts)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts.slice(start, end - start)


class Alphabet:
    """An ordered alphabet. Index 0 pads, 1 stands for anything else, characters start at 2."""

    def __init__(self, name: str, characters: str):
        if not characters:
            raise ValueError(f"alphabet {name!r} has no characters")
        repeated = sorted(c for c in set(characters) if characters.count(c) > 1)
        if repeated:
            raise ValueError(f"alphabet {name!r} repeats {repeated}")
        self.name = name
        self.characters = characters

    def __len__(self) -> int:
        return len(self.characters) + fixed.FIRST_INDEX

    def __contains__(self, char: str) -> bool:
        return len(char) == 1 and char in self.characters

    def _leftover(self, text: Column) -> Column:
        return F.translate(text, self.characters, "")

    def encode(self, text: Column) -> Column:
        """One index per character, as array<int>.

        The texts of a piece of a batch are turned into code points at once and looked up in a table;
        built-in array functions take a lambda call per character, fifty times as long.
        """
        table = np.full(0x110000, fixed.UNK_INDEX, dtype=np.int32)
        for i, c in enumerate(self.characters):
            table[ord(c)] = i + fixed.FIRST_INDEX
        known = int(max(map(ord, self.characters))) + 1
        table = table[:known].copy()

        def looked_up(texts: pa.Array) -> pa.Array:
            whole = "".join(t or "" for t in texts.to_pylist())
            points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
            found = np.where(points < known, table[np.minimum(points, known - 1)], np.int32(fixed.UNK_INDEX))
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            mask = texts.is_null() if texts.null_count else None
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()), mask=mask)

        @F.arrow_udf("array<int>")
        def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                for part in pieces(texts):
                    yield looked_up(part)

        return codes(text)

    def decode(self, indices: Column, keep_unknown: bool = False) -> Column:
        """Text of ``indices``; padding goes, unknowns go or become the replacement mark."""
        letters = F.lit(self.characters)
        unknown = fixed.REPLACEMENT if keep_unknown else ""

        def char(i: Column) -> Column:
            return (
                F.when(i == fixed.PAD_INDEX, F.lit(""))
                .when(i == fixed.UNK_INDEX, F.lit(unknown))
                .when(i.between(fixed.FIRST_INDEX, len(self) - 1),
                      F.substring(letters, i - (fixed.FIRST_INDEX - 1), F.lit(1)))
                .otherwise(F.raise_error(F.concat(F.lit("index outside the alphabet: "), i.cast("string"))).cast("string"))
            )

        return F.array_join(F.transform(indices, char), "")

    def unsupported(self, text: Column) -> Column:
        """Sorted distinct characters the alphabet lacks."""
        rest = self._leftover(text)
        return F.when(F.length(rest) == 0, F.array().cast("array<string>")).otherwise(
            F.array_sort(F.array_distinct(F.split(rest, "")))
        )

    def supports(self, text: Column) -> Column:
        return F.length(self._leftover(text)) == 0

    def keep_only(self, text: Column) -> Column:
        """``text`` without its unsupported characters."""
        return F.call_function("translate", text, self._leftover(text), F.lit(""))


_registry: dict[str, str] = {
    "english": fixed.PUNCTUATION + fixed.DIGITS + fixed.UPPERCASE + fixed.LOWERCASE,
    "english_lower": fixed.PUNCTUATION + fixed.DIGITS + fixed.LOWERCASE,
}


def alphabet(name: str) -> Alphabet:
    if name not in _registry:
        raise KeyError(f"no alphabet {name!r}; there are {alphabets()}")
    return Alphabet(name, _registry[name])


def register_alphabet(name: str, characters: str, overwrite: bool = False) -> Alphabet:
    made = Alphabet(name, characters)
    if name in _registry and not overwrite:
        raise KeyError(f"alphabet {name!r} exists; pass overwrite=True to replace it")
    _registry[name] = characters
    return made


def alphabets() -> list[str]:
    return sorted(_registry)


def is_blank(text: Column) -> Column:
    """Nothing but whitespace, or nothing."""
    return text.rlike(rf"\A{fixed.SPACE}*\z")


def words(text: Column) -> Column:
    """Whitespace-separated words, none of them empty."""
    return F.filter(F.split(text, rf"{fixed.SPACE}+"), lambda w: w != "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"{fixed.SPACE}+", "")


def error_rate(prediction: Column, target: Column) -> Column:
    """Edits per target character; an empty target costs 1 unless nothing was predicted."""
    return F.when(F.length(target) == 0, F.when(F.length(prediction) == 0, 0.0).otherwise(1.0)).otherwise(
        F.levenshtein(prediction, target) / F.length(target)
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _echoes(text: Column) -> Column:
    """Words of ``text``, case folded, that equal the word before them."""

    def repeats(ws: Column) -> Column:
        return F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, i - 1)))

    return bind(words(F.lower(text)), repeats)


def doubled_word(reading: Column, target: Column) -> Column:
    """The first word the reading says twice running where the target does not; else NULL."""
    return F.get(F.array_except(_echoes(reading), _echoes(target)), F.lit(0))


def _overruns(readings: pd.Series, targets: pd.Series) -> pd.Series:
    """Row by row: the target's characters in turn over an array of reading positions.

    A position holds cost and start as one number, cost first, so the least is the cheapest with the earliest start. What a
    reading character costs beyond the target runs along the row as a running minimum.
    """
    found = []
    for reading, target in zip(readings, targets, strict=True):
        if reading is None or target is None:
            found.append(None)
            continue
        seen = np.frombuffer(reading.encode("utf-32-le"), np.uint32)
        n = len(seen)
        edit = n + 1
        along = np.arange(n + 1, dtype=np.int64) * edit
        row = np.arange(n + 1, dtype=np.int64)
        for char in np.frombuffer(target.encode("utf-32-le"), np.uint32):
            best = np.minimum(row[:-1] + edit * (seen != char), row[1:] + edit)
            row = np.minimum.accumulate(np.concatenate(([row[0] + edit], best)) - along) + along
        cost, start = row // edit, row % edit
        worse = np.maximum(start, n - np.arange(n + 1))
        found.append(int(worse[cost == cost.min()].min()))
    return pd.Series(found, dtype="Int32")


def overrun(reading: Column, target: Column) -> Column:
    """Most characters the reading carries before or after its alignment with the target.

    The target is aligned whole; the alignment may begin and end anywhere in the
    reading. Equal costs take the earlier start; of the alignments of least cost the
    one that leaves least outside on its worse side counts. NULL for a NULL argument.
    """
    return F.pandas_udf(_overruns, "int")(without_space(reading), without_space(target))


def letters_of(text: Column) -> Column:
    """Distinct characters, the plain space left out."""
    tight = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(F.length(tight) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.split(tight, ""))
    )


def coverage(target: Column, shown: Column) -> Column:
    """Share of the target's characters that ``shown`` contains; 0 for a blank target."""
    wanted = letters_of(target)
    return F.when(F.size(wanted) == 0, 0.0).otherwise(
        F.size(F.array_intersect(wanted, letters_of(shown))) / F.size(wanted)
    )


def length_budget(text: Column) -> Column:
    return F.greatest(
        F.lit(fixed.MIN_UNITS),
        F.least(F.lit(fixed.MAX_UNITS), F.ceil(F.length(text) * F.lit(fixed.UNITS_PER_CHAR))),
    ).cast("bigint")


def join_texts(texts: Column, images: Column) -> Column:
    """Parallel texts as one; NULL or empty texts give NULL, a different count is refused."""
    joined = F.when(F.size(images) == 1, F.element_at(texts, 1)).otherwise(F.array_join(texts, " "))
    return (
        F.when(F.size(images) == 0, F.raise_error(F.lit("no style samples to join")).cast("string"))
        .when(texts.isNull(), F.lit(None).cast("string"))
        .when(F.size(texts) != F.size(images),
              F.raise_error(F.lit("style texts and style samples differ in number")).cast("string"))
        .otherwise(joined)
    )
