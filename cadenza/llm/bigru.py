"""A bidirectional gated recurrent network over bytes, with training by backpropagation through time, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that a window labels, and bytes of context that the state reads ahead of them on either side.
WINDOW, CONTEXT = 448, 32
#: Windows that are read in step.
LANES = 512


def pad(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of rows, filled up with zeros to the longest."""
    length = np.array([len(w) for w in rows])
    width = int(length.max())
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in rows), np.uint8)
    return flat.reshape(len(rows), width), length


def windows(raw: bytes) -> list[tuple[int, int, bytes]]:
    """(bytes before the labelled ones, labelled bytes, what is read) of the windows that cover ``raw``."""
    out = []
    for at in range(0, len(raw), WINDOW):
        first = max(0, at - CONTEXT)
        out.append((at - first, min(WINDOW, len(raw) - at), raw[first : at + WINDOW + CONTEXT]))
    return out


def _turned(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each row's first ``length`` items in reverse order, along axis 1."""
    at = length[:, None] - 1 - np.arange(x.shape[1])
    at = np.where(at >= 0, at, np.arange(x.shape[1]))
    return np.take_along_axis(x, at if x.ndim == 2 else at[:, :, None], axis=1)


class BiGru:
    """Labels every byte of a text with probabilities of the ``labels``."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 7):
        self.labels, self.hidden = list(labels), hidden
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[d + "E"] = draw(256, 3 * hidden, scale=0.3)
            self.p[d + "U"] = draw(hidden, 3 * hidden, scale=hidden**-0.5)
        self.p["V"] = draw(2 * hidden, len(labels), scale=hidden**-0.5)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def _pass(self, d: str, x: np.ndarray):
        """States (rows, steps, hidden) of one direction, and what its gradient needs."""
        e, u, h = self.p[d + "E"], self.p[d + "U"], self.hidden
        state = np.zeros((len(x), h), e.dtype)
        out, trace = np.empty((len(x), x.shape[1], h), e.dtype), []
        for t in range(x.shape[1]):
            g, hu = e[x[:, t]], state @ u
            zr = 1 / (1 + np.exp(-g[:, : 2 * h] - hu[:, : 2 * h]))
            z, r, m = zr[:, :h], zr[:, h:], hu[:, 2 * h :]
            n = np.tanh(g[:, 2 * h :] + r * m)
            trace.append((state, z, r, m, n))
            state = n + z * (state - n)
            out[:, t] = state
        return out, trace

    def _probabilities(self, x: np.ndarray, length: np.ndarray):
        """Label probabilities of every position of padded rows, read whole: what training uses."""
        f, tf = self._pass("f", x)
        b, tb = self._pass("b", _turned(x, length))
        both = np.concatenate([f, _turned(b, length)], axis=2)
        logits = both @ self.p["V"] + self.p["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True), both, tf, tb

    def _votes(self, d: str, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Contribution (steps, labels, rows) of one direction to the scores; ``x`` is (steps, rows).

        Everything lies units first, so that each operation runs over contiguous rows. The gates are
        half tangents, s(a) = (1 + tanh(a / 2)) / 2, and one product gives the gates' share of the
        state and, for the step before, its votes.
        """
        h, rows = self.hidden, x.shape[1]
        half = np.repeat(np.float32([0.5, 1]), [2 * h, h])[:, None]
        e = np.ascontiguousarray(self.p[d + "E"].T * half)
        u = np.ascontiguousarray(np.concatenate([self.p[d + "U"] * 0.5, v], axis=1).T)
        state, m = np.zeros((h, rows), np.float32), np.empty((h, rows), np.float32)
        out = np.empty((len(x), v.shape[1], rows), np.float32)
        g, su = np.empty((3 * h, rows), np.float32), np.empty((len(u), rows), np.float32)
        zr, z, r, n, mu, vote = g[: 2 * h], g[:h], g[h : 2 * h], g[2 * h :], su[2 * h : 3 * h], su[3 * h :]
        for t in range(len(x)):
            np.take(e, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, state, out=su)
            if t:
                out[t - 1] = vote
            zr += su[: 2 * h]
            np.tanh(zr, out=zr)
            np.multiply(r, mu, out=m)
            n += mu
            n += m
            np.tanh(n, out=n)
            state -= n
            np.multiply(z, state, out=m)
            state += m
            state *= 0.5
            state += n
        np.matmul(u[3 * h :], state, out=out[-1])
        return out

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels): the sum of the label probabilities of all positions of every text.

        Texts are cut into windows that are read in step, those of like length together. Both
        directions start ``CONTEXT`` bytes outside of the positions that a window labels,
        so the state is carried into it; texts do not see each other.
        """
        jobs = [(len(read), i, skip, n, read) for i, raw in enumerate(texts) for skip, n, read in windows(raw)]
        jobs.sort(key=lambda j: (j[0], j[2]))
        out = np.zeros((len(texts), len(self.labels)))
        v, h = self.p["V"], self.hidden
        for k in range(0, len(jobs), LANES):
            part = jobs[k : k + LANES]
            x, length = pad([j[4] for j in part])
            votes = self._votes("f", np.ascontiguousarray(x.T, dtype=np.intp), v[:h])
            back = self._votes("b", np.ascontiguousarray(_turned(x, length).T, dtype=np.intp), v[h:])
            if length[0] == length[-1]:
                votes += back[::-1]
            else:
                at = np.maximum(length - 1 - np.arange(len(back))[:, None], 0)
                votes += np.take_along_axis(back, at[:, None, :], axis=0)
            votes += self.p["c"][:, None]
            votes -= votes.max(axis=1, keepdims=True)
            np.exp(votes, out=votes)
            votes /= votes.sum(axis=1, keepdims=True)
            skip, n = np.array([j[2] for j in part]), np.array([j[3] for j in part])
            step = np.arange(len(votes))[:, None]
            votes *= ((step >= skip) & (step < skip + n))[:, None, :]
            np.add.at(out, [j[1] for j in part], votes.sum(axis=0, dtype=np.float64).T)
        return out

    def _back(self, d: str, x: np.ndarray, trace, grad: np.ndarray, g: dict) -> None:
        u, h = self.p[d + "U"], self.hidden
        gu, every = np.zeros_like(u), np.empty((x.shape[1], len(x), 3 * h), u.dtype)
        ds = np.zeros((len(x), h), u.dtype)
        for t in range(x.shape[1] - 1, -1, -1):
            state, z, r, m, n = trace[t]
            ds = ds + grad[:, t]
            dn = ds * (1 - z) * (1 - n * n)
            dz = ds * (state - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            every[t] = np.concatenate([dz, dr, dn], axis=1)
            dhu = np.concatenate([dz, dr, dn * r], axis=1)
            gu += state.T @ dhu
            ds = ds * z + dhu @ u.T
        order = np.argsort(x.T.ravel(), kind="stable")
        seen, first = np.unique(x.T.ravel()[order], return_index=True)
        ge = np.zeros_like(self.p[d + "E"])
        ge[seen] = np.add.reduceat(every.reshape(-1, 3 * h)[order], first, axis=0)
        g[d + "E"], g[d + "U"] = ge, gu

    def step(self, rows: list[bytes], y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all positions, and its gradient by backpropagation through time."""
        x, length = pad(rows)
        p, both, tf, tb = self._probabilities(x, length)
        mask = (np.arange(x.shape[1]) < length[:, None]).astype(p.dtype) / length.sum()
        own = np.take_along_axis(p, np.broadcast_to(y[:, None, None], (*x.shape, 1)), axis=2)[:, :, 0]
        loss = float(-(np.log(own + 1e-9) * mask).sum())
        d = p.copy()
        d[np.arange(len(x))[:, None], np.arange(x.shape[1]), y[:, None]] -= 1
        d *= mask[:, :, None]
        h, g = self.hidden, {}
        g["V"] = both.reshape(-1, 2 * h).T @ d.reshape(-1, d.shape[2])
        g["c"] = d.sum(axis=(0, 1))
        db = d @ self.p["V"].T
        self._back("f", x, tf, db[:, :, :h], g)
        self._back("b", _turned(x, length), tb, _turned(db[:, :, h:], length), g)
        return loss, g

    def train(self, rows: list[bytes], y: np.ndarray, steps: int = 300, batch: int = 96, rate: float = 0.03, seed: int = 11) -> "BiGru":
        """Adam over drawn batches; every label gets the same share."""
        rng = np.random.default_rng(seed)
        share = 1 / np.bincount(y)[y]
        share /= share.sum()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for i in range(1, steps + 1):
            drawn = rng.choice(len(rows), batch, p=share)
            _, g = self.step([rows[r] for r in drawn], y[drawn])
            lr = rate * min(1, i / 20) * (1 - i / (steps + 1))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] = self.p[k] - (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self
