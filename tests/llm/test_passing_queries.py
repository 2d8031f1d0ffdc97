"""Queries that pass by held candidates give the same whatever the batches are."""

import numpy as np
import pandas as pd
import pytest

from lingoscope.llm import topk_search


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_batches_may_end_anywhere(size):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for cell, block, many, asked in [(0, 0, 12, 5), (0, 1, 12, 0), (1, 0, 0, 4), (1, 1, 3, 9), (2, 0, 25, 1)]:
        held, queries = (rng.integers(-9, 10, (n, 3)).astype(float) for n in (many, asked))
        for query, vectors in ((0, held), (1, queries)):
            for at, v in enumerate(vectors):
                rows.append((cell, block, query, 100 * query + at, v, float(np.sqrt(v @ v)), -np.inf if query else None))
        for at, q in enumerate(queries):
            best = sorted((-int(v @ q), n) for n, v in enumerate(held))[:4]
            want += [(cell, 100 + at, n, -score) for score, n in best]
    stream = pd.DataFrame(rows, columns=["cell", "block", "query", "id", "v", "norm", "bound"])
    found = []
    for part in [stream.iloc[at : at + size] for at in range(0, len(stream), size)] + [stream.iloc[:0]]:
        found.append(part.reset_index(drop=True))
    got = pd.concat(list(topk_search.passing(iter(found), 4)))
    assert sorted(map(tuple, got[["query_id", "vec_id", "score"]].to_numpy().tolist())) == sorted((q, v, s) for _, q, v, s in want)
