"""Full-text matching and BM25 as column expressions over token arrays.

A row's match and score are expressions of its per-leaf term counts. ``match`` scans the texts; ``plans.index`` reads the
query's terms from a written index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.parser import Leaf, Node, leaves

RUNS = r"([\p{L}\p{N}\p{Co}]+)"


def strip_marks(text: Column) -> Column:
    """Text without combining marks, on the JVM."""
    return F.reflect(F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """array<string> of lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(strip_marks(text)), F.lit(RUNS), F.lit(1))


@dataclass(frozen=True)
class Bm25:
    """Parameters. floor: replaces idf values of zero or less; plus_one: idf = ln(1 + ...), never negative."""

    k1: float = 1.2
    b: float = 0.75
    floor: float | None = 1e-6
    plus_one: bool = False
    sign: int = -1

    def idf(self, n: Column, total: Column) -> Column:
        ratio = (total - n + 0.5) / (n + 0.5)
        if self.plus_one:
            return F.log(ratio + 1)
        value = F.log(ratio)
        return value if self.floor is None else F.when(value <= 0, F.lit(self.floor)).otherwise(value)

    def part(self, tf: Column, idf: Column, dl: Column, avgdl: Column) -> Column:
        return self.sign * idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / avgdl))


def count_in(words: Column, leaf: Leaf) -> Column:
    """How often a leaf occurs in a token array; overlapping phrases count."""
    if leaf.prefix and len(leaf.terms) == 1:
        return F.size(F.filter(words, lambda w: w.startswith(leaf.terms[0])))
    if len(leaf.terms) == 1:
        return F.size(F.filter(words, lambda w: w == leaf.terms[0]))

    def at(i: Column) -> Column:
        same = [F.get(words, i + k) == t for k, t in enumerate(leaf.terms)]
        if leaf.prefix:
            same[-1] = F.get(words, i + len(leaf.terms) - 1).startswith(leaf.terms[-1])
        return reduce(lambda a, b: a & b, same)

    # positions of the first word that the rest follows
    return F.when(F.array_contains(words, leaf.terms[0]), F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), at))).otherwise(F.lit(0))


def counted(rows: DataFrame, tree, columns: list[str]) -> DataFrame:
    """rows with dl and tf0.. for the tree's leaves, over text columns of which phrases never cross the border."""
    with_words = rows.withColumns({f"_w{k}": tokens(F.col(c)) for k, c in enumerate(columns)})
    words = [F.col(f"_w{k}") for k in range(len(columns))]
    out = {"dl": reduce(lambda a, b: a + b, [F.size(w) for w in words]).cast("long")}
    out |= {f"tf{k}": reduce(lambda a, b: a + b, [count_in(w, x) for w in words]).cast("long") for k, x in enumerate(leaves(tree))}
    return with_words.withColumns(out).drop(*[f"_w{k}" for k in range(len(columns))])


def statistics(rows: DataFrame, n_leaves: int) -> DataFrame:
    """One row: N, avgdl and the rows that have each leaf."""
    return rows.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"_n{k}") for k in range(n_leaves)])


def evaluate(tree, bm25: Bm25 = Bm25()) -> tuple[Column, Column]:
    """(matches, score) of a row that has tf0.., dl and the statistics."""
    index = {x: k for k, x in enumerate(leaves(tree))}

    def go(node) -> tuple[Column, Column]:
        if isinstance(node, Leaf):
            if not node.terms:
                return F.lit(False), F.lit(0.0)
            k = index[node]
            tf = F.col(f"tf{k}")
            return tf > 0, F.when(tf > 0, bm25.part(tf, bm25.idf(F.col(f"_n{k}"), F.col("_n")), F.col("dl"), F.col("_avgdl"))).otherwise(F.lit(0.0))
        parts = [go(p) for p in node.parts]
        if node.op == "NOT":
            return reduce(lambda a, b: a & ~b, [m for m, _ in parts]), parts[0][1]
        if node.op == "OR":
            return reduce(lambda a, b: a | b, [m for m, _ in parts]), reduce(lambda a, b: a + b, [F.when(m, s).otherwise(F.lit(0.0)) for m, s in parts])
        return reduce(lambda a, b: a & b, [m for m, _ in parts]), reduce(lambda a, b: a + b, [s for _, s in parts])

    return go(tree)


def match(rows: DataFrame, tree: Leaf | Node, columns: list[str], bm25: Bm25 = Bm25()) -> DataFrame:
    """Matching rows with their score, by one scan for the statistics and one for the rows; the way without an index."""
    found = counted(rows, tree, columns)
    stats = statistics(counted(rows.select(*columns), tree, columns), len(leaves(tree)))
    matches, score = evaluate(tree, bm25)
    return found.crossJoin(F.broadcast(stats)).where(matches).withColumn("score", score).select(*rows.columns, "score")  # one row is broadcast
