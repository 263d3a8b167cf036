"""BM25 (Robertson and Zaragoza 2009), k1 = 1.2 and b = 0.75, with statistics of the whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylark.analysis.analyzers import count_terms
from querylark.operators.postings import Postings
from querylark.plans.compiler import Leaf, Source, occurrences

K1, B = 1.2, 0.75


def from_postings(postings: Postings, n: int, leaves: list[Leaf]) -> Column:
    """Sum over the leaves, from the columns that Postings.flagged() adds; n: documents of the table. Document frequencies of the query's
    terms are counted on their postings alone."""
    known = postings.documents_with(sorted({(x.field, t) for x in leaves if x.ask is not None for t in x.terms}))
    total = F.lit(0.0)
    for x in leaves:
        if x.ask is None or not x.terms or not n:
            total = total + F.when(x.match, F.lit(float(x.boost))).otherwise(F.lit(0.0))
            continue
        idf = sum(math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in (known[x.field, t] for t in x.terms))
        mean = postings.totals.get(x.field, 0) / n or 1.0
        tf = F.col(f"_tf_{x.ask}").cast("double")
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"_dl_{x.ask}") / F.lit(mean)))
        total = total + F.when(x.match, F.lit(x.boost * idf) * part).otherwise(F.lit(0.0))
    return total


def score(df: DataFrame, source: Source, leaves: list[Leaf]) -> Column:
    """Sum over the leaves. One aggregate over the table gets the number of documents, the mean length of each scored field and the
    document frequency of each query term: a bounded number of values, whatever the table's size."""
    scored = [x for x in leaves if x.field is not None and x.terms]
    fields = sorted({x.field for x in scored})
    pairs = sorted({(x.field, t) for x in scored for t in x.terms})
    stats = None
    if scored:
        text = {n: source.text(source.schema.get(n)) for n in fields}
        own = df.select(*[text[n].alias(f"t{i}") for i, n in enumerate(fields)])
        at = {n: i for i, n in enumerate(fields)}
        stats = own.agg(
            F.count("*").alias("n"), *[F.sum(count_terms(F.col(f"t{i}"))).alias(f"l{i}") for i in range(len(fields))],
            *[F.count_if(F.contains(f"t{at[n]}", F.lit(f" {t} "))).alias(f"d{k}") for k, (n, t) in enumerate(pairs)],
        ).first()
    total = F.lit(0.0)
    for x in leaves:
        if x.field is None or not x.terms or not stats or not stats["n"]:
            total = total + F.when(x.match, F.lit(float(x.boost))).otherwise(F.lit(0.0))
            continue
        n, i = stats["n"], fields.index(x.field)
        idf = sum(math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in (stats[f"d{pairs.index((x.field, t))}"] for t in x.terms))
        mean = (stats[f"l{i}"] or 0) / n or 1.0
        s = source.text(source.schema.get(x.field))
        tf = occurrences(s, x).cast("double")
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * count_terms(s) / F.lit(mean)))
        total = total + F.when(x.match, F.lit(x.boost * idf) * part).otherwise(F.lit(0.0))
    return total
