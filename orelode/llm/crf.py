"""A linear-chain conditional random field over hashed features, in numpy.

Sequences are handled many at a time: emissions are gathered for all tokens at
once, and the forward, backward and Viterbi passes step through positions with
all sequences side by side.
"""

from __future__ import annotations

import numpy as np

O, BEGIN, INSIDE = 0, 1, 2
LABELS = 3


class LinearChain:
    def __init__(self, bits: int = 16) -> None:
        self.mask = (1 << bits) - 1
        self.w = np.zeros((1 << bits, LABELS), np.float32)
        self.trans = np.zeros((LABELS, LABELS), np.float32)
        self.start = np.zeros(LABELS, np.float32)

    # Sequences come flat: ``feats`` is (tokens, F), ``ends`` the end of each sequence.

    def _padded(self, feats: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        begins = np.concatenate([[0], ends[:-1]])
        length = ends - begins
        seq = np.repeat(np.arange(len(ends)), length)
        pos = np.arange(len(feats)) - np.repeat(begins, length)
        e = np.zeros((int(length.max(initial=0)), len(ends), LABELS), np.float32)
        e[pos, seq] = self.w[feats].sum(axis=1)
        return e, seq, pos, length

    def viterbi(self, feats: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best label of each token."""
        out = np.zeros(len(feats), np.int8)
        if not len(ends):
            return out
        begins = np.concatenate([[0], ends[:-1]])
        order = np.argsort(ends - begins, kind="stable")
        at = 0
        while at < len(order):  # of like length, so little is padded; long ones in smaller numbers
            k = 512
            while k > 1 and (at + k > len(order) or (ends - begins)[order[at + k - 1]] * k > 200_000):
                k = max(1, min(len(order) - at, k // 2)) if at + k <= len(order) else len(order) - at
            some = order[at : at + k]
            at += k
            idx = np.concatenate([np.arange(begins[s], ends[s]) for s in some])
            e, seq, pos, length = self._padded(feats[idx], np.cumsum(ends[some] - begins[some]))
            n, m = e.shape[0], e.shape[1]
            score = e[0] + self.start if n else None
            back = np.zeros((n, m, LABELS), np.int8)
            final = np.zeros((m, LABELS), np.float32)
            for t in range(n):
                if t:
                    cand = score[:, :, None] + self.trans[None]
                    back[t] = cand.argmax(axis=1)
                    score = cand.max(axis=1) + e[t]
                done = length == t + 1
                final[done] = score[done]
            label = final.argmax(axis=1).astype(np.int8)
            got = np.zeros((n, m), np.int8)
            for t in range(n - 1, -1, -1):
                on = length > t
                last = length == t + 1
                if t + 1 < n:
                    prev = back[t + 1][np.arange(m), label]
                    label = np.where(on & ~last, prev, label)
                got[t] = np.where(on, label, 0)
            out[idx] = got[pos, seq]
        return out

    def fit(self, feats: np.ndarray, ends: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.15, l2: float = 1e-6, size: int = 128, seed: int = 11) -> "LinearChain":
        """Stochastic gradient ascent on the conditional likelihood, steps scaled by past gradients."""
        rng = np.random.default_rng(seed)
        begins = np.concatenate([[0], ends[:-1]])
        order = np.argsort(ends - begins, kind="stable")
        batches = [order[i : i + size] for i in range(0, len(order), size)]
        past = np.full_like(self.w, 1e-3)
        past_t = np.full_like(self.trans, 1e-3)
        past_s = np.full_like(self.start, 1e-3)
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                some = batches[b]
                idx = np.concatenate([np.arange(begins[s], ends[s]) for s in some])
                f, y = feats[idx], labels[idx]
                e, seq, pos, length = self._padded(f, np.cumsum(ends[some] - begins[some]))
                n, m = e.shape[0], e.shape[1]
                alpha = np.full((n, m, LABELS), -1e9, np.float64)
                alpha[0] = e[0] + self.start
                for t in range(1, n):
                    alpha[t] = e[t] + np.logaddexp.reduce(alpha[t - 1][:, :, None] + self.trans[None], axis=1)
                beta = np.zeros((n, m, LABELS))
                for t in range(n - 2, -1, -1):
                    nxt = np.logaddexp.reduce(self.trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], axis=2)
                    beta[t] = np.where((length > t + 1)[:, None], nxt, 0.0)
                z = np.logaddexp.reduce(alpha[length - 1, np.arange(m)], axis=1)
                gamma = np.exp(np.minimum(alpha + beta - z[None, :, None], 0.0))
                gold = np.zeros((n, m, LABELS))
                gold[pos, seq, y] = 1
                g = (gold - gamma)[pos, seq].astype(np.float32)
                grad_t = np.zeros((LABELS, LABELS))
                for t in range(1, n):
                    on = length > t
                    if not on.any():
                        break
                    pair = np.exp(np.minimum(alpha[t - 1][on][:, :, None] + self.trans[None] + (e[t] + beta[t])[on][:, None, :] - z[on][:, None, None], 0.0))
                    grad_t += np.einsum("mi,mj->ij", gold[t - 1][on], gold[t][on]) - pair.sum(axis=0)
                rows, inverse = np.unique(f, return_inverse=True)
                grad = np.zeros((len(rows), LABELS), np.float32)
                inverse = inverse.reshape(f.shape)
                for k in range(LABELS):
                    grad[:, k] = np.bincount(inverse.ravel(), np.repeat(g[:, k], f.shape[1]), len(rows))
                grad -= l2 * self.w[rows]
                past[rows] += grad * grad
                self.w[rows] += rate * grad / np.sqrt(past[rows])
                past_t += grad_t * grad_t
                self.trans += (rate * grad_t / np.sqrt(past_t)).astype(np.float32)
                grad_s = (gold[0] - gamma[0]).sum(axis=0)
                past_s += grad_s * grad_s
                self.start += (rate * grad_s / np.sqrt(past_s)).astype(np.float32)
        return self
