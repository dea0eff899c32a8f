"""Components of a block don't depend on the order of its sets."""

import itertools

import numpy as np
import pytest

from pulsegrid.llm.jaccard import link_block


def brute_groups(members):
    """The positions of each component, by all pairs."""
    of = list(range(len(members)))
    for i, j in itertools.combinations(range(len(members)), 2):
        both = len(np.intersect1d(members[i], members[j]))
        if 100 * both >= 85 * (len(members[i]) + len(members[j]) - both):
            of = [of[i] if x == of[j] else x for x in of]
    return {frozenset(k for k, x in enumerate(of) if x == y) for y in of}


@pytest.mark.parametrize("offsets", [(0, 7, 21, 24, 14), (0, 7, 14, 300, 307, 314, 321), (0, 8, 16, 24, 500, 507)])
def test_chains_in_all_orders(offsets):
    for order in itertools.permutations(offsets):
        members = [np.arange(k, k + 100, dtype=np.uint64) for k in order]
        of = link_block(members)
        assert {frozenset(k for k, x in enumerate(of) if x == y) for y in of} == brute_groups(members), order
