"""Character n-grams inside words, for cosine blocking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions.normalize import words


def word_ngrams(x: Column | str, least: int, most: int) -> Column:
    """n-grams of every word with a blank on either side; a word shorter than n gives itself once."""

    def of_size(padded: Column, m: Column, n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), m - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))
        return F.when(m >= n, grams).otherwise(F.array().cast("array<string>"))

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        m = F.length(padded)
        return F.when(m < least, F.array(padded)).otherwise(F.concat(*[of_size(padded, m, n) for n in range(least, most + 1)]))

    return F.flatten(F.transform(words(x), of_word))
