"""Nucleotide sequences as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def occurrences(seq: Column, word: Column) -> Column:
    """1-based starts of all occurrences of ``word``, overlapping ones too."""
    last = F.length(seq) - F.length(word) + 1
    return F.when((last > 0) & (F.length(word) > 0), F.filter(F.sequence(F.lit(1), last), lambda i: F.substring(seq, i, F.length(word)) == word)).otherwise(F.array().cast("array<int>"))


def both_strands(seq: Column, word: Column) -> Column:
    """Array of (start, strand); a word that is its own reverse complement is found once."""
    other = reverse_complement(word)
    mark = lambda found, strand: F.transform(found, lambda i: F.struct(i.alias("start"), F.lit(strand).alias("strand")))
    return F.concat(mark(occurrences(seq, word), "+"), F.when(other != word, mark(occurrences(seq, other), "-")).otherwise(mark(F.array().cast("array<int>"), "-")))


def hamming(a: Column, b: Column) -> Column:
    """Places where two sequences of one length differ; null for other lengths."""
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(F.length(a) == F.length(b), F.size(differ))


def kmers(seq: Column, k: int) -> Column:
    """Distinct words of k characters."""
    last = F.length(seq) - k + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(seq, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))
