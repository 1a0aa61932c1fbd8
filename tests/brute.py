"""Exhaustive answers on small inputs, by sorting every query's candidates."""

import numpy as np


def ticks(q, p):
    q, p = np.asarray(q, float), np.asarray(p, float)
    q = q / np.linalg.norm(q, axis=1)[:, None]
    p = p / np.linalg.norm(p, axis=1)[:, None]
    return np.rint(q @ p.T * 1e9).astype(int)


def orders(q, p, p_ids):
    """Candidate positions per query, best first, equal scores by id."""
    return [np.lexsort((p_ids, -row)) for row in ticks(q, p)]


def first_hits(q, q_keys, p, p_ids, p_keys):
    ranks = []
    for key, order in zip(q_keys, orders(q, p, p_ids)):
        at = np.flatnonzero(np.asarray(p_keys)[order] == key)
        ranks.append(int(at[0]) + 1 if len(at) else None)
    return ranks


def average_precisions(q, q_index, q_labels, p, p_ids, p_index, p_labels, exclude=True):
    out = {}
    p_index, p_labels = np.asarray(p_index), np.asarray(p_labels)
    for n, order in enumerate(orders(q, p, p_ids)):
        if exclude:
            order = order[p_index[order] != q_index[n]]
        at = np.flatnonzero(p_labels[order] == q_labels[n]) + 1
        if len(at):
            out[n] = float(np.mean(np.arange(1, len(at) + 1) / at))
    return out
