"""Many fixed strings at once: automata for lists, grams for tables of them."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

# Ship the functions below with the tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# An automaton takes some hundred times the strings' bytes; each task builds its own.
AUTOMATON_BYTES = 4 << 20
GRAM = 8


def fits_automaton(strings: list[str]) -> bool:
    return sum(len(s.encode("utf-8", "replace")) for s in strings) <= AUTOMATON_BYTES


def found_numbers(text: Column, strings: list[str]) -> Column:
    """The numbers, in the list, of the strings that occur in ``text``; NULL for NULL.

    One pass over the text, however many strings there are. Strings are not empty.
    """
    if not fits_automaton(strings):
        raise ValueError(f"more than {AUTOMATON_BYTES} bytes of strings; give them as a table")

    def find(batches):
        import ahocorasick

        automaton, same = ahocorasick.Automaton(), {}
        for number, string in enumerate(strings):
            same.setdefault(string, []).append(number)
        for string, numbers in same.items():
            automaton.add_word(string, numbers)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([
                None if t is None else sorted({n for _, numbers in automaton.iter(t) for n in numbers})
                for t in texts
            ], dtype=object)

    return F.pandas_udf(find, "array<int>", functionType=PandasUDFType.SCALAR_ITER)(text)


def containing(rows: DataFrame, text: str, strings: DataFrame, string: str) -> DataFrame:
    """``text, string``: distinct pairs where the string of a table occurs in the text.

    An equi-join finds candidates: the first characters of each string, up to ``GRAM``,
    meet equally long pieces of the texts. Pieces are cut only in lengths that occur.
    No pair is formed without a common piece. Empty strings are in every text and are
    left out here.
    """
    wanted = strings.select(F.col(string).alias("string")).where("length(string) > 0").distinct().withColumn(
        "gram", F.substring("string", 1, GRAM)
    )
    lengths = [r[0] for r in wanted.select(F.length("gram")).distinct().collect()]
    if not lengths:
        return rows.select(F.col(text).alias("text"), F.lit("").alias("string")).limit(0)
    pieces = F.flatten(F.array(*(
        F.expr(
            f"transform(if(length(text) >= {n}, sequence(1, length(text) - {n} + 1), cast(array() AS array<int>)),"
            f" i -> substring(text, i, {n}))"
        )
        for n in lengths
    )))
    texts = rows.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    cut = texts.select("text", F.explode(F.array_distinct(pieces)).alias("gram"))
    return cut.join(wanted, "gram").where(F.contains("text", "string")).select("text", "string").distinct()
