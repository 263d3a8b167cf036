"""Batch jobs around analyzers: a lemma lexicon and suffix rules from a tagged corpus, fold tables from pairs of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lemmas(tagged: DataFrame, least: int = 1) -> DataFrame:
    """form, lemma, n from rows (form, lemma): the most frequent lemma of each form, of equal ones the first by name."""
    counted = tagged.dropna().groupBy(F.lower("form").alias("form"), F.lower("lemma").alias("lemma")).agg(F.count("*").alias("n"))
    return counted.groupBy("form").agg(F.min_by("lemma", F.struct(-F.col("n"), F.col("lemma"))).alias("lemma"), F.max("n").alias("n")).filter(F.col("n") >= least)


def suffix_rules(lexicon: DataFrame, longest: int = 6, least: int = 2) -> DataFrame:
    """suffix, replacement, n: what a form's ending becomes in its lemma, for forms that aren't in the lexicon; the most frequent
    replacement of each ending."""
    shared = F.aggregate(F.sequence(F.lit(1), F.least(F.length("form"), F.length("lemma"))), F.lit(0), lambda a, i: F.when((a == i - 1) & (F.substring("form", F.lit(1), i) == F.substring("lemma", F.lit(1), i)), i).otherwise(a))
    cut = lexicon.select("form", "lemma", shared.alias("k")).filter((F.length("form") - F.col("k") <= longest) & (F.col("k") > 0))
    rules = cut.select(F.expr("substring(form, k + 1)").alias("suffix"), F.expr("substring(lemma, k + 1)").alias("replacement")).groupBy("suffix", "replacement").agg(F.count("*").alias("n"))
    return rules.groupBy("suffix").agg(F.min_by("replacement", F.struct(-F.col("n"), F.col("replacement"))).alias("replacement"), F.max("n").alias("n")).filter(F.col("n") >= least)


def fold_table(pairs: dict[str, str]) -> dict[str, str]:
    """Pairs with chains resolved: what a character finally becomes. Cycles end at their smallest member."""
    out = {}
    for a in pairs:
        seen, b = [a], pairs[a]
        while b in pairs and b not in seen:
            seen.append(b)
            b = pairs[b]
        b = min(seen[seen.index(b) :]) if b in seen else b
        if a != b:
            out[a] = b
    return out
