"""Two-sided latent truth: which claims hold, when each source has a sensitivity and a specificity.

A fact is a value that at least one witness asserts; every other witness that could have asserted
it denies it by silence. Whole tables are first counted down to patterns (who asserts, who
could), of which there are at most 3^witnesses; the expectation-maximisation runs over those.
"""

from __future__ import annotations

import numpy as np

#: Pseudo-counts of the witnesses' rates: asserts given true, silent given false.
PRIOR_SENS, PRIOR_SPEC = (6.0, 4.0), (9.0, 1.0)


def fit(asserted: np.ndarray, could: np.ndarray, count: np.ndarray, witnesses: int, prior: float = 0.5, rounds: int = 30,
        sens0: float = 0.7, spec0: float = 0.9, prior_sens=PRIOR_SENS, prior_spec=PRIOR_SPEC):
    """(posterior per pattern, sensitivity, specificity per witness, share of true facts).

    asserted, could: bit masks per pattern; count: its facts. No pattern: no posterior, priors as rates."""
    bits = np.arange(witnesses)
    a = ((asserted[:, None] >> bits) & 1).astype(float)
    c = ((could[:, None] >> bits) & 1).astype(float)
    sens, spec, p = np.full(witnesses, sens0), np.full(witnesses, spec0), prior
    post = np.full(len(count), prior)
    for _ in range(rounds if len(count) else 0):
        up = a * np.log(sens / (1 - spec)) + (c - a) * np.log((1 - sens) / spec)
        post = 1 / (1 + np.exp(-np.clip(np.log(p / (1 - p)) + up.sum(1), -50, 50)))
        t, f = (post * count)[:, None], ((1 - post) * count)[:, None]
        sens = ((a * t).sum(0) + prior_sens[0]) / ((c * t).sum(0) + sum(prior_sens))
        spec = (((c - a) * f).sum(0) + prior_spec[0]) / ((c * f).sum(0) + sum(prior_spec))
        sens, spec = np.clip(sens, 1e-4, 1 - 1e-4), np.clip(spec, 1e-4, 1 - 1e-4)
        p = float(np.clip((post * count).sum() / count.sum(), 1e-3, 1 - 1e-3))
    return post, sens, spec, p
