"""A character-level bidirectional LSTM with a linear-chain CRF, trained and run in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


class LstmCrf:
    """Arrays are (time, batch, ...). Characters are codes below ``codes``; all sequences of a call have one length."""

    def __init__(self, codes: int, labels: int, embed: int = 12, hidden: int = 20, seed: int = 0, kind: type = np.float64):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"E": normal(codes, embed) * np.sqrt(codes) * 0.3, "V": normal(2 * hidden, labels), "c": np.zeros(labels), "T": np.zeros((labels, labels))}
        for d in "fb":
            self.p |= {f"W{d}": normal(embed, 4 * hidden), f"U{d}": normal(hidden, 4 * hidden), f"b{d}": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]}
        self.p = {k: v.astype(kind) for k, v in self.p.items()}
        self.hidden, self.rng, self.kind = hidden, rng, kind

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction, and what the way back needs."""
        n, (steps, batch) = self.hidden, x.shape[:2]
        inputs = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        h, c, out, kept = np.zeros((batch, n), self.kind), np.zeros((batch, n), self.kind), np.empty((steps, batch, n), self.kind), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.p[f"U{d}"]
            i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            before, was = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = out[t] = o * tc
            if keep:
                kept.append((t, i, f, o, g, before, was, tc))
        return out, kept

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        x = self.p["E"][codes]
        states = np.concatenate([self._run(x, d, False)[0] for d in "fb"], axis=2)
        return states @ self.p["V"] + self.p["c"]

    def _crf(self, e: np.ndarray, gold: np.ndarray):
        """Loss, and its gradients by emissions and transitions."""
        steps, batch, k = e.shape
        t = self.p["T"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for s in range(1, steps):
            alpha[s] = e[s] + _logsumexp(alpha[s - 1][:, :, None] + t, 1)
        for s in range(steps - 2, -1, -1):
            beta[s] = _logsumexp(t + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        de, dt = np.exp(alpha + beta - z[:, None]), np.zeros_like(t)
        for s in range(1, steps):
            dt += np.exp(alpha[s - 1][:, :, None] + t + (e[s] + beta[s])[:, None, :] - z[:, None, None]).sum(0)
        rows = np.arange(batch)
        score = sum(e[s, rows, gold[s]] for s in range(steps)) + sum(t[gold[s - 1], gold[s]] for s in range(1, steps))
        for s in range(steps):
            de[s, rows, gold[s]] -= 1
            if s:
                np.subtract.at(dt, (gold[s - 1], gold[s]), 1)
        return (z - score).mean(), de / batch, dt / batch

    def gradients(self, codes: np.ndarray, gold: np.ndarray):
        p, n = self.p, self.hidden
        flat = lambda a: a.reshape(-1, a.shape[-1])
        x = p["E"][codes]
        runs = {d: self._run(x, d, True) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        loss, de, dt = self._crf(states @ p["V"] + p["c"], gold)
        g = {"T": dt, "c": de.sum((0, 1)), "V": flat(states).T @ flat(de)}
        dstates, dx = de @ p["V"].T, np.zeros_like(x)
        for d, part in (("f", dstates[:, :, :n]), ("b", dstates[:, :, n:])):
            dh, dc, dz = np.zeros(x.shape[1:2] + (n,), self.kind), np.zeros(x.shape[1:2] + (n,), self.kind), np.empty(x.shape[:2] + (4 * n,), self.kind)
            du = np.zeros_like(p[f"U{d}"])
            for t, i, f, o, a, before, was, tc in reversed(runs[d][1]):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz[t] = np.concatenate([dc * a * i * (1 - i), dc * was * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
                du += before.T @ dz[t]
                dh, dc = dz[t] @ p[f"U{d}"].T, dc * f
            g |= {f"U{d}": du, f"W{d}": flat(x).T @ flat(dz), f"b{d}": dz.sum((0, 1))}
            dx += dz @ p[f"W{d}"].T
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], codes, dx)
        return loss, g

    def fit(self, codes: np.ndarray, gold: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01) -> float:
        """Adam on (sequences, time) arrays; returns the mean loss of the last epoch."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order, losses = self.rng.permutation(len(codes)), []
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                loss, g = self.gradients(codes[rows].T, gold[rows].T)
                norm = np.sqrt(sum((x * x).sum() for x in g.values()))
                step += 1
                now = rate * (0.5 if epoch >= epochs * 2 // 3 else 1)
                for k, x in g.items():
                    x = (x * min(1, 5 / (norm + 1e-9))).astype(self.kind)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                losses.append(loss)
            loss = float(np.mean(losses))
        return loss

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best labels of one sequence of emissions (time, labels)."""
        score, back = e[0], []
        for x in e[1:]:
            total = score[:, None] + self.p["T"]
            back.append(total.argmax(0))
            score = total.max(0) + x
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])
