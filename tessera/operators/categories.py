"""Features predicted by a chain whose states are categories on one strand or the other.

A category has a tree model and, where gaps tell something, a law over gap patterns. Its state on the other strand
scores the complemented column with the same model; categories named as pivots (what lies between features) are shared by both
strands. Distinct columns are scored once, the chain runs in chunks, and features are the runs of its best path.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.models import TreeModel
from tessera.operators import hmm, indels
from tessera.operators import likelihood as lk
from tessera.operators.hmm import Hmm
from tessera.operators.intervals import run_lengths

_OTHER = str.maketrans("ACGTacgt", "TGCAtgca")
#: What a pattern that a category's law lacks has left.
LEAST = 1e-6


def both_strands(chain: Hmm, pivots: Sequence[int] | None) -> tuple[Hmm, list[tuple[int, int]]]:
    """The chain of (category, strand) states; without pivots the categories are one strand's alone."""
    return (chain, [(c, 0) for c in range(chain.n)]) if pivots is None else hmm.reverse_strand(chain, pivots)


def state_scores(distinct: DataFrame, names: Sequence[str], models: Sequence[TreeModel], states: Sequence[tuple[int, int]], gap_laws: Sequence[Mapping[str, float]] | None = None) -> DataFrame:
    """col and emission (log2, one for each state); gap_laws: for each category the shares of `null`, `insertion`, `deletion` and `complex` columns."""
    names, tree = list(names), models[0].tree

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tuples = pdf["tuple"].tolist()
            turned = [t.translate(_OTHER) for t in tuples]
            known: dict[tuple[int, int], np.ndarray] = {}
            for cat, strand in dict.fromkeys(states):
                m = models[cat]
                x = lk.column_loglik(m, lk.encode(turned if strand else tuples, names, m.tree.leaf_names(), m.alphabet)) / np.log(2.0)
                if gap_laws is not None:
                    x = x + np.log2([max(gap_laws[cat].get(indels.gap_pattern(tree, t, names)[0], 0.0), LEAST) for t in tuples])
                known[cat, strand] = x
            yield pd.DataFrame({"col": tuples, "emission": list(np.stack([known[s] for s in states], axis=1))})

    return distinct.mapInPandas(run, "col string, emission array<double>")


def _rows(columns: DataFrame, names: Sequence[str], models: Sequence[TreeModel], states: Sequence[tuple[int, int]], by: Sequence[str], gap_laws) -> DataFrame:
    scored = state_scores(columns.select(F.col("col").alias("tuple")).distinct(), names, models, states, gap_laws)
    return columns.select(*by, "pos", "col").join(scored, "col").select(*by, "pos", "emission")


def predict_features(
    columns: DataFrame, names: Sequence[str], models: Sequence[TreeModel], chain: Hmm, wanted: Mapping[int, str], pivots: Sequence[int] | None = None, by: Sequence[str] = ("aln",), gap_laws: Sequence[Mapping[str, float]] | None = None, size: int = 1024
) -> DataFrame:
    """by, start, end, n, feature and strand: runs of the best path through categories that `wanted` names; neighbouring ones of one name and strand are one feature."""
    full, states = both_strands(chain, pivots)
    path = hmm.best_path(_rows(columns, names, models, states, by, gap_laws), full, by, size)
    return features_of_path(path, [(wanted.get(c), "-" if s else "+") for c, s in states], by)


def features_of_path(path: DataFrame, states: Sequence[tuple[str | None, str]], by: Sequence[str]) -> DataFrame:
    """Runs of a path of states that have a name, with the name and strand of each."""
    name, strand = (F.element_at(F.array(*[F.lit(s[i]) for s in states]), F.col("state") + 1) for i in (0, 1))
    labelled = path.select(*by, "pos", F.when(name.isNotNull(), F.concat(strand, name)).alias("_label_"))
    runs = run_lengths(labelled, by, "pos", "_label_").filter(F.col("_label_").isNotNull())
    return runs.select(*by, "start", "end", "n", F.expr("substring(_label_, 2)").alias("feature"), F.substring("_label_", 1, 1).alias("strand"))


def category_posteriors(
    columns: DataFrame, names: Sequence[str], models: Sequence[TreeModel], chain: Hmm, wanted: Sequence[int], pivots: Sequence[int] | None = None, by: Sequence[str] = ("aln",), gap_laws: Sequence[Mapping[str, float]] | None = None, size: int = 1024
) -> DataFrame:
    """by, pos and p: how likely each position is in one of the categories, on either strand."""
    full, states = both_strands(chain, pivots)
    post = hmm.posterior(_rows(columns, names, models, states, by, gap_laws), full, by, size)
    places = [i for i, (c, _) in enumerate(states) if c in set(wanted)]
    return post.select(*by, "pos", sum((F.col("posterior")[i] for i in places), F.lit(0.0)).alias("p"))
