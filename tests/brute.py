"""Plain numpy versions of the formulas, document by document, for small inputs."""

import itertools

import numpy as np


def matrix(df, prefix, key="word_id", rows=None):
    """A tall DataFrame as an array indexed by key."""
    cols = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()), key=lambda c: int(c[len(prefix):]))
    found = {r[0]: r[1:] for r in df.select(key, *cols).collect()}
    out = np.zeros((rows or max(found) + 1, len(cols)))
    for i, values in found.items():
        out[i] = values
    return out


def counts(tokens, n, d):
    """Dense document-word counts; tokens are (doc, word, cnt) tuples."""
    out = np.zeros((n, d))
    for doc, word, cnt in tokens:
        out[doc, word] += cnt
    return out


def pair_sketch(c, model):
    y, mu = np.zeros_like(model), np.zeros(len(model))
    for row in c:
        length = row.sum()
        if length >= 2:
            y += row[:, None] * (row @ model - model) / (length * (length - 1))
            mu += row / length
    return y, mu


def corrected(c, model, alpha0):
    y, mu = pair_sketch(c, model)
    n = len(c)
    return (1 + alpha0) / n * y - alpha0 * np.outer(mu / n, mu / n @ model)


def projected_tensor(x, lengths, m1, alpha0):
    """Third moment with repeated-word terms on projected coordinates, cell by cell."""
    k = x.shape[1]
    t, used = np.zeros((k, k, k)), 0
    for v, n in zip(x, lengths):
        if n < 3:
            continue
        used += 1
        s2 = alpha0 * (alpha0 + 1) / (2 * n * (n - 1))
        s3 = (alpha0 + 1) * (alpha0 + 2) / (2 * n * (n - 1) * (n - 2))
        for i, j, l in itertools.product(range(k), repeat=3):
            cell = s3 * v[i] * v[j] * v[l] - s2 * (m1[i] * v[j] * v[l] + v[i] * m1[j] * v[l] + v[i] * v[j] * m1[l])
            if i == j:
                cell += s2 * v[i] * m1[l] - s3 * v[i] * v[l]
            if i == l:
                cell += s2 * v[i] * m1[j] - s3 * v[i] * v[j]
            if j == l:
                cell += s2 * m1[i] * v[j] - s3 * v[i] * v[j]
            if i == j == l:
                cell += 2 * k * s3 * v[i]
            t[i, j, l] += cell
    return t / used + alpha0**2 * np.einsum("i,j,l->ijl", m1, m1, m1)


def word_corrected_tensor(c, w, m1, alpha0):
    """Third moment over triples of distinct token positions; counts must be whole."""
    k = w.shape[1]
    t, used = np.zeros((k, k, k)), 0
    for row in c:
        words = np.repeat(np.arange(len(row)), row.astype(int))
        n = len(words)
        if n < 3:
            continue
        used += 1
        s2 = alpha0 * (alpha0 + 1) / (2 * n * (n - 1))
        s3 = (alpha0 + 1) * (alpha0 + 2) / (2 * n * (n - 1) * (n - 2))
        b = w[words]
        x = b.sum(axis=0)
        pairs = np.outer(x, x) - b.T @ b
        triples = np.einsum("i,j,l->ijl", x, x, x) + 2 * np.einsum("ni,nj,nl->ijl", b, b, b)
        own = np.einsum("ni,nj->ij", b, b)
        for pattern in ("ij,l->ijl", "il,j->ijl", "jl,i->ijl"):
            triples -= np.einsum(pattern, own, x)
        t += s3 * triples
        for pattern in ("i,jl->ijl", "j,il->ijl", "l,ij->ijl"):
            t -= s2 * np.einsum(pattern, m1, pairs)
    return t / used + alpha0**2 * np.einsum("i,j,l->ijl", m1, m1, m1)


def simplex(v):
    ordered = np.sort(v)[::-1]
    theta = (np.cumsum(ordered) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - theta[np.flatnonzero(ordered > theta)[-1]], 0)


def admm(v, rounds):
    z, u = np.zeros_like(v), np.zeros_like(v)
    for _ in range(rounds):
        m = (v + z - u) / 2
        z = simplex(m + u)
        u = u + m - z
    return z
